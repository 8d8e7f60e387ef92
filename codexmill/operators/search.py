"""Ranked lexical search, many queries at once.

Index: postings of words by column and position, and of trigrams of compact CJK
text, as DataFrames. A search is a join of the queries' terms with the postings, a
cap of the best candidates by BM25, one CASE expression for the final score, and a
ranking window. ``candidates="capped"`` scores only the best candidates of every
term, ``"all"`` every match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as X
from codexmill.operators.lookup import top_per
from codexmill.session import BROADCAST_BYTES, broadcast_within, drop, exists, json_bytes, spool, spread

#: Weights of evidence classes and scores of match kinds.
CLASS_WEIGHT = {
    "canonical_root": 70,
    "authoritative_structured": 65,
    "metadata_relationship": 35,
    "parallel_alignment": 25,
    "computational_segmented": 15,
    "derived_critical_lemma": 30,
    "auxiliary_reference": 10,
}
MATCH_SCORE = {"exact": 120, "normalized": 95, "diacritic-folded": 75, "compact-unicode": 70, "fts": 30}
LEMMA_SCORE, SEGMENT_SCORE = 80, 5
#: BM25 of the word index.
K1, B = 1.2, 0.75
#: Queries one scan may take.
SCAN_QUERIES = 1000
COLUMNS = ("raw_text", "norm_text", "folded_text", "compact_text", "lemma_text", "title")


def cap_of(limit: int) -> int:
    return max(5 * limit, 50)


# ---------------------------------------------------------------------- index


def postings(records: DataFrame) -> DataFrame:
    """(term, id, col, pos): every word of the six indexed columns."""
    one = lambda i, c: records.select("id", F.lit(i).alias("col"), F.posexplode(X.word_tokens(F.coalesce(c, F.lit("")))).alias("pos", "term"))
    return reduce(DataFrame.unionByName, [one(i, F.col(c)) for i, c in enumerate(COLUMNS)]).select("term", "id", "col", "pos")


def document_lengths(records: DataFrame) -> DataFrame:
    """(id, len): words of all indexed columns."""
    n = reduce(Column.__add__, [F.size(X.word_tokens(F.coalesce(F.col(c), F.lit("")))) for c in COLUMNS])
    return records.select("id", n.cast("long").alias("len"))


def trigram_postings(records: DataFrame) -> DataFrame:
    """(gram, id): distinct trigrams of the compact raw text of Chinese rows."""
    src = records.filter(F.col("language").isin("lzh", "zh")).select("id", X.compact("raw_text").alias("c"))
    return src.select("id", F.explode(F.array_distinct(X.ngrams(F.col("c"), 3))).alias("gram")).select("gram", "id")


def trigram_vocabulary(records: DataFrame) -> DataFrame:
    """(term, doc, cnt): documents and occurrences of every trigram, counted partially by record first."""
    src = records.filter(F.col("language").isin("lzh", "zh")).select("id", X.compact("raw_text").alias("c"))
    return vocabulary(src.select("id", F.explode(X.ngrams(F.col("c"), 3)).alias("term")))


def vocabulary(occurrences: DataFrame) -> DataFrame:
    """(term, doc, cnt) of (id, term) occurrences: two sums, no distinct of ids."""
    per = occurrences.groupBy("term", "id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("doc"), F.sum("n").alias("cnt"))


#: Buckets of a stored index; a fixed number, so that an index and its queries agree.
BUCKETS = 64


def _bucket(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def gram_average(records: DataFrame) -> float:
    """Mean length of the compact Chinese rows, which the ranking of substring hits is relative to."""
    src = records.filter(F.col("language").isin("lzh", "zh")).select(F.length(X.compact("raw_text")).alias("n"))
    return src.agg(F.avg("n").alias("n")).first().n or 1.0


def write_index(records: DataFrame, out: str, spread: int = 8) -> None:
    """Stores the index of the records below ``out``, partitioned by bucket of the word or trigram.

    A bucket is written by ``spread`` tasks, so that a word that many records hold is not one
    task's. Last comes ``search_index_state``, by which readers tell a whole index; a build of
    the tables takes it away.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(spread))
    drop(records.sparkSession, f"{out}/search_index_state")
    for name, df, key in (("postings", postings(records), "term"), ("trigrams", trigram_postings(records), "gram")):
        df.withColumn("bucket", _bucket(key)).repartition("bucket", part).sortWithinPartitions("bucket", key, "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/{name}")
    document_lengths(records).write.mode("overwrite").parquet(f"{out}/lengths")
    state = records.sparkSession.range(1).select(F.lit("search").alias("component"), F.lit(INDEX_VERSION).alias("version"), F.current_timestamp().alias("rebuilt_at"))
    n = records.sparkSession.read.parquet(f"{out}/lengths").count()
    state.withColumn("record_count", F.lit(n).cast("long")).withColumn("gram_average", F.lit(gram_average(records))).write.mode("overwrite").parquet(f"{out}/search_index_state")


#: Changes with the layout of a stored index.
INDEX_VERSION = "2"


def read_index(spark: SparkSession, out: str) -> dict[str, object]:
    """The stored index as the keyword arguments that ``search`` takes; one that is not whole or of another version is an error."""
    read = spark.read.parquet
    state = read(f"{out}/search_index_state").first() if exists(spark, f"{out}/search_index_state") else None
    if state is None or state.version != INDEX_VERSION:
        raise ValueError(f"no search index of version {INDEX_VERSION} in {out}")
    return {"post": read(f"{out}/postings"), "grams": read(f"{out}/trigrams"), "lengths": read(f"{out}/lengths"), "gram_avg": state.gram_average}


# -------------------------------------------------------------------- queries


def with_forms(queries: DataFrame) -> DataFrame:
    """queries (query_id, query) with norm, folded, comp, cjk."""
    q = queries.withColumn("_f", X.forms("query"))
    return q.select(*queries.columns, F.col("_f.norm").alias("norm"), F.col("_f.folded").alias("folded"), F.col("_f.compact").alias("comp")).withColumn(
        "cjk", X.cjk_substring_query(F.col("comp"))
    )


def lemma_forms(queries: DataFrame, lemmas: DataFrame, limit: int | None = 200) -> DataFrame:
    """(query_id, surface): surfaces whose lemma or surface is the normalized query, the first ``limit`` or (None) all."""
    q = queries.select("query_id", "norm")
    s = lemmas.select("surface", "lemma").distinct()
    hit = q.join(s, q["norm"] == s["lemma"]).select("query_id", "surface").unionByName(q.join(s, q["norm"] == s["surface"]).select("query_id", "surface")).distinct()
    return hit if limit is None else top_per(hit, ["query_id"], [F.col("surface")], limit).select("query_id", "surface")


def lemma_places(queries: DataFrame, lemmas: DataFrame, limit: int | None = 500) -> DataFrame:
    """(query_id, work_id, segment_id): where the query stands as surface or lemma, normalized or folded, the first ``limit`` or (None) all."""
    q = queries.select("query_id", F.explode(F.array_distinct(F.array("norm", "folded"))).alias("f"))
    m = lemmas.select("surface", "lemma", "work_id", "segment_id").distinct()
    cols = ["query_id", "work_id", "segment_id"]
    hit = q.join(m, q["f"] == m["surface"]).select(*cols).unionByName(q.join(m, q["f"] == m["lemma"]).select(*cols)).distinct()
    return hit if limit is None else top_per(hit, ["query_id"], [F.col("work_id"), F.col("segment_id")], limit).select(*cols)


def terms_of(queries: DataFrame, forms: DataFrame) -> DataFrame:
    """(query_id, term, tokens): the query, its forms and its lemma surfaces, each once."""
    own = queries.select("query_id", F.explode(F.array("query", "norm", "folded", "comp")).alias("term"))
    t = own.unionByName(forms.select("query_id", F.col("surface").alias("term"))).filter("term <> ''").distinct()
    return t.withColumn("tokens", X.word_tokens(F.col("term"))).filter(F.size("tokens") > 0)


def phrase_hits(terms: DataFrame, post: DataFrame) -> DataFrame:
    """(query_id, term, id, tf): records with the term's words in a row within one column."""
    q = terms.select("query_id", "term", F.size("tokens").alias("n"), F.posexplode("tokens").alias("off", "tok"))
    on = ["tok"]
    if "bucket" in post.columns:  # a stored index: only the buckets of the queries' words are read
        q, on = q.withColumn("bucket", _bucket("tok")), ["tok", "bucket"]
    q = broadcast_within(q)  # few words: the postings are filtered where they are read
    hit = post.withColumnRenamed("term", "tok").join(q, on).withColumn("start", F.col("pos") - F.col("off"))
    single = hit.filter("n = 1").select("query_id", "term", "id")
    several = hit.filter("n > 1").groupBy("query_id", "term", "id", "col", "start", "n").agg(F.count_distinct("off").alias("k")).filter("k = n").select("query_id", "term", "id")
    return single.unionByName(several).groupBy("query_id", "term", "id").agg(F.count("*").alias("tf"))


#: Words of 64 bits in the table by which a scan passes phrases over; a fixed size, whatever the number of phrases.
BIT_WORDS = 1 << 18


def phrase_scan(terms: DataFrame, records: DataFrame) -> DataFrame:
    """What ``phrase_hits`` gives, by one scan of the records without an index.

    For batches of so many phrases that a common word stands in many of them: word by word,
    each of its postings would meet each of these. Here a run of words is compared whole;
    a bit table of the phrases passes over most runs before they are shuffled.
    """
    q = spool(terms.select("query_id", "term", "tokens", F.concat_ws(" ", "tokens").alias("words"), F.size("tokens").alias("n")), "phrases")
    lengths = [r.n for r in q.select("n").distinct().collect()]  # at most the words of the longest phrase
    text = spread(records.select("id", *COLUMNS)).select("id", F.explode(F.array(*[F.coalesce(c, F.lit("")) for c in COLUMNS])).alias("x"))
    # Outer, as Spark filters by the size of what it explodes and for that tokenizes twice; rows without words go with the next filter.
    w = text.select("id", X.word_tokens(F.col("x")).alias("w")).select("id", "w", F.posexplode_outer("w").alias("pos", "_t"))
    slot, bit = F.shiftright("_h", 6).bitwiseAND(F.lit(BIT_WORDS - 1)), F.expr("shiftleft(1L, cast(_h & 63 as int))")
    found = []
    for n in lengths:
        own = q.filter(F.col("n") == n).select(F.xxhash64(*[F.get("tokens", F.lit(i)) for i in range(n)]).alias("_h"))
        bits = F.broadcast(own.select(slot.alias("slot"), bit.alias("b")).groupBy("slot").agg(F.bit_or("b").alias("bits")))
        run = [F.get("w", F.col("pos") + i) for i in range(n)]
        r = w.filter(F.col("pos") + n <= F.size("w")).withColumn("_h", F.xxhash64(*run)).withColumn("slot", slot).join(bits, "slot").filter(F.col("bits").bitwiseAND(bit) != 0)
        # Words hold no blank, so runs joined by blanks are equal only if their words are.
        found.append(r.select("id", F.concat_ws(" ", *run).alias("words")))
    found = reduce(DataFrame.unionByName, found or [w.limit(0).select("id", F.col("_t").alias("words"))])
    return found.groupBy("words", "id").agg(F.count("*").alias("tf")).join(q, "words").select("query_id", "term", "id", "tf")


def bm25(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """hits with ``bm25`` (larger is better)."""
    # Two numbers of the whole collection; literals, so that nothing is crossed with them.
    stats = lengths.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n_docs, avg_len = F.lit(stats.n), F.lit(stats.avg or 1.0)
    n = broadcast_within(hits.groupBy("query_id", "term").agg(F.count("*").alias("n")))
    idf = F.greatest(F.log((n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    tf = F.col("tf")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / avg_len))
    return hits.join(n, ["query_id", "term"]).join(lengths, "id").select(*hits.columns, score.alias("bm25"))


def capped(hits: DataFrame, lengths: DataFrame, cap: int, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id): the best ``cap`` candidates of every term; ``allowed`` (id) filters before the cap, not the statistics."""
    s = bm25(hits, lengths)
    if allowed is not None:
        s = s.join(allowed, [c for c in ("query_id", "id") if c in allowed.columns], "left_semi")
    return top_per(s, ["query_id", "term"], [F.col("bm25").desc(), F.col("id")], cap).select("query_id", "id").distinct()


def cjk_candidates(queries: DataFrame, grams: DataFrame, records: DataFrame, cap: int | None, average: float | None = None) -> DataFrame:
    """(query_id, id): Chinese rows whose compact text contains the compact query, rows with the raw query first.

    ``average``: mean length of the compact Chinese rows (``gram_average``), taken here unless given.
    """
    q = queries.filter("cjk is not null").select("query_id", "query", "cjk")
    g = q.select("query_id", F.explode(F.array_distinct(X.ngrams(F.col("cjk"), 3))).alias("gram"))
    n = g.groupBy("query_id").agg(F.count("*").alias("n"))
    on = ["gram"]
    if "bucket" in grams.columns:
        g, on = g.withColumn("bucket", _bucket("gram")), ["gram", "bucket"]
    hit = grams.join(broadcast_within(g), on).groupBy("query_id", "id").agg(F.count("*").alias("k")).join(n, "query_id").filter("k = n").select("query_id", "id")
    r = records.filter(F.col("language").isin("lzh", "zh")).select("id", "raw_text")
    hit = hit.join(q, "query_id").join(r, "id").withColumn("c", X.compact("raw_text")).filter(F.contains("c", "cjk"))
    if cap is None:
        return hit.select("query_id", "id")
    # Frequency and length stand for BM25: within one query its idf is the same for all rows.
    tf = F.size(F.filter(F.sequence(F.lit(1), F.length("c") - F.length("cjk") + 1), lambda i: F.substring(F.col("c"), i, F.length("cjk")) == F.col("cjk")))
    hit = hit.select("query_id", "id", F.contains("raw_text", "query").alias("raw"), tf.alias("tf"), F.length("c").alias("len"))
    avg = F.lit(average or gram_average(records))
    hit = hit.withColumn("s", F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg)))
    return top_per(hit, ["query_id"], [F.col("raw").desc(), F.col("s").desc(), F.col("id")], cap).select("query_id", "id")


# ---------------------------------------------------------------------- score


def match_kind(query: str = "query", norm: str = "norm", folded: str = "folded", comp: str = "comp") -> Column:
    """The first rung on which the query is contained in the record."""
    has = lambda c, q: F.contains(F.coalesce(F.col(c), F.lit("")), F.col(q))
    return (
        F.when(has("raw_text", query), "exact")
        .when(has("norm_text", norm), "normalized")
        .when(has("folded_text", folded), "diacritic-folded")
        .when((F.col(comp) != "") & has("compact_text", comp), "compact-unicode")
        .otherwise("fts")
    )


def _lookup(values: dict[str, int], c: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, v in values.items():
        out = out.when(c == k, v)
    return out.otherwise(0)


def score(kind: Column, corpus_lemma: Column, evidence_class: str = "evidence_class", segment: str = "segment_id") -> Column:
    s = _lookup(CLASS_WEIGHT, F.col(evidence_class)) + _lookup(MATCH_SCORE, kind)
    s = s + F.when(corpus_lemma, LEMMA_SCORE).otherwise(0)
    return (s + F.when(F.coalesce(F.col(segment), F.lit("")) != "", SEGMENT_SCORE).otherwise(0)).cast("long")




def rank_order() -> list[Column]:
    return [F.col("score").desc(), F.coalesce("corpus", F.lit("")), F.coalesce("source_path", F.lit("")), F.coalesce("sequence_no", F.lit(0)), F.col("id")]


#: Columns of a record that a hit has.
KEEP = ("id", "corpus", "language", "work_id", "segment_id", "source_path", "sequence_no", "evidence_class", "text_role", "witness", "source_sha")


def _others(forms: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, others): the surfaces of a query's lemma other than itself, with folded and compact form."""
    fs = forms.join(queries.select("query_id", "norm"), "query_id").filter("surface <> norm and surface <> ''")
    return fs.withColumn("_f", X.forms("surface")).groupBy("query_id").agg(F.collect_set(F.struct(F.col("surface").alias("f"), F.col("_f.folded").alias("d"), F.col("_f.compact").alias("c"))).alias("others"))


def scored(candidates: DataFrame, queries: DataFrame, records: DataFrame, forms: DataFrame, places: DataFrame, derive_missing: bool = True, narrow: bool = False) -> DataFrame:
    """(query_id, record columns, score, match_reasons) of the candidates (query_id, id).

    ``narrow``: the candidates may be few enough to be broadcast, which is then measured.
    """
    fs, keep = _others(forms, queries), KEEP
    r = records.select(*keep, "raw_text", "norm_text", "folded_text", "compact_text", "lemma_text")
    # Blanked forms of Chinese rows are derived once a record, not once a candidate.
    zh = F.coalesce(F.col("language").isin("lzh", "zh"), F.lit(False)) if derive_missing else F.lit(False)
    blank = lambda k: F.coalesce(F.col(k), F.lit("")) == ""
    lack = zh & (blank("norm_text") | blank("folded_text") | blank("compact_text"))
    r = r.withColumn("_d", X.forms(F.when(lack, F.col("raw_text"))))
    pairs = (("norm_text", "norm"), ("folded_text", "folded"), ("compact_text", "compact"))
    r = r.select(*keep, "raw_text", *[k for k, _ in pairs], "lemma_text", *[F.when(zh & blank(k), F.col(f"_d.{d}")).alias(f"_{d}") for k, d in pairs])
    # What a candidate and what a query brings is joined without the texts, which then are not shuffled.
    at = places.select("query_id", F.coalesce("work_id", F.lit("\x00")).alias("_w"), F.coalesce("segment_id", F.lit("\x00")).alias("_s"), F.lit(True).alias("placed")).distinct()
    where = records.select("id", F.coalesce("work_id", F.lit("\x00")).alias("_w"), F.coalesce("segment_id", F.lit("\x00")).alias("_s"))
    placed = candidates.join(at.select("query_id").distinct(), "query_id", "left_semi").join(where, "id").join(at, ["query_id", "_w", "_s"]).select("query_id", "id", "placed")
    light = candidates.join(placed, ["query_id", "id"], "left")
    asked = queries.join(fs, "query_id", "left")
    if narrow:
        light, asked = broadcast_within(light), broadcast_within(asked)
    c = r.join(light, "id").join(asked, "query_id")
    for k, d in pairs:
        c = c.withColumn(k, F.when(F.col("cjk").isNotNull(), F.coalesce(f"_{d}", k)).otherwise(F.col(k))).drop(f"_{d}")
    row = {k: F.coalesce(F.col(k), F.lit("")) for k in ("norm_text", "folded_text", "compact_text", "lemma_text")}
    other = F.exists("others", lambda o: F.contains(row["norm_text"], o["f"]) | F.contains(row["folded_text"], o["d"]) | F.contains(row["compact_text"], o["c"]))
    lemma = F.coalesce("placed", F.lit(False)) | F.array_contains(F.split(row["lemma_text"], r"\s+"), F.col("norm")) | F.coalesce(other, F.lit(False))
    c = c.withColumn("kind", match_kind()).withColumn("lemma", lemma)
    reasons = F.when(F.col("lemma"), F.array("kind", F.lit("corpus-lemma"))).otherwise(F.array("kind"))
    return c.select("query_id", "query", *keep, score(F.col("kind"), F.col("lemma")).alias("score"), reasons.alias("match_reasons"))


def search(
    queries: DataFrame,
    records: DataFrame,
    lemmas: DataFrame,
    limit: int = 20,
    candidates: str = "capped",
    post: DataFrame | None = None,
    lengths: DataFrame | None = None,
    grams: DataFrame | None = None,
    gram_avg: float | None = None,
) -> DataFrame:
    """Ranked hits of every query: (query_id, query, record columns, score, match_reasons, rank).

    queries: query_id, query, and optionally language and corpus as filters. The
    index frames are built here unless given. With ``candidates="all"`` no list is cut short.
    """
    cap = cap_of(limit) if candidates == "capped" else None
    q = spool(with_forms(queries.select("query_id", "query")), "queries")
    any_cjk = not q.filter("cjk is not null").isEmpty()
    forms, places = (lemma_forms(q, lemmas), lemma_places(q, lemmas)) if cap is not None else (lemma_forms(q, lemmas, None), lemma_places(q, lemmas, None))
    hits = phrase_hits(terms_of(q, forms), post if post is not None else postings(records))
    filters = [c for c in ("language", "corpus") if c in queries.columns]
    if cap is not None or filters:
        hits = spool(hits, "hits")  # the cap, its statistics and the filters all read them
    allowed = None
    if filters:
        r = records.select("id", "language", "corpus")
        f = queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in filters])
        on = reduce(Column.__and__, [F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)) for c in filters])
        allowed = hits.select("query_id", "id").distinct().join(r, "id").join(f, "query_id").filter(on).select("query_id", "id")
    if cap is None:
        word = hits.select("query_id", "id").distinct()
        word = word.join(allowed, ["query_id", "id"], "left_semi") if allowed is not None else word
    else:
        word = capped(hits, lengths if lengths is not None else spool(document_lengths(records), "lengths"), cap, allowed)
    found = word
    if any_cjk:
        cjk = cjk_candidates(q, grams if grams is not None else trigram_postings(records), records, cap, gram_avg)
        if filters:
            r = records.select("id", "language", "corpus")
            f = queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in filters])
            on = reduce(Column.__and__, [F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)) for c in filters])
            cjk = cjk.join(r, "id").join(f, "query_id").filter(on).select("query_id", "id")
        found = word.unionByName(cjk).distinct()
    found = scored(found, q, spread(records), forms, places, derive_missing=any_cjk, narrow=cap is not None)
    return top_per(found, ["query_id"], rank_order(), limit)


def search_every(queries: DataFrame, records: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Every hit of every query, scored as ``search`` with ``candidates="all"`` does, but not ranked: (query_id, query, record columns, score, match_reasons).

    A hit may come several times, in equal rows, where several words of a query find it. For
    batches that hit much of a corpus: a record meets the queries' words and is scored where
    it is read, so that neither postings nor texts are written or shuffled, and a hit is
    a row only while its task reduces it. Where the queries are no side to broadcast, the
    records are read once for each part of them that is.
    """
    q = spool(with_forms(queries.select("query_id", "query")), "queries")
    plain, cjk = q.filter("cjk is null").drop("cjk"), q.filter("cjk is not null")
    forms, places = lemma_forms(plain, lemmas, None), lemma_places(plain, lemmas, None)
    words = terms_of(plain, forms).select("query_id", "tokens").distinct()
    words = words.select("query_id", F.col("tokens")[0].alias("tok"), F.when(F.size("tokens") > 1, F.concat(F.lit(" "), F.concat_ws(" ", "tokens"), F.lit(" "))).alias("run"))
    asked = spool(plain.join(_others(forms, plain), "query_id", "left"), "asked")
    # Whether the word that finds the record is itself another form of the lemma, which spares a look for each of them.
    is_form = [F.coalesce(F.array_contains(f"others.{k}", F.col("tok")), F.lit(False)).alias(f"is_{k}") for k in "fdc"]
    words = spool(words.join(asked.select("query_id", "others"), "query_id").select("query_id", "tok", "run", *is_form), "words")
    runs = not words.filter("run is not null").isEmpty()
    at = places.select("query_id", F.coalesce("work_id", F.lit("\x00")).alias("_w"), F.coalesce("segment_id", F.lit("\x00")).alias("_s"))
    at = broadcast_within(at.groupBy("_w", "_s").agg(F.collect_set("query_id").alias("_at")))  # a place's words, of the queries only
    parts = 1 + (json_bytes(words) + json_bytes(asked)) // BROADCAST_BYTES

    row = {k: F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("raw_text", "norm_text", "folded_text", "compact_text", "lemma_text")}
    r = spread(records.select(*KEEP, *COLUMNS)).join(at, (F.coalesce("work_id", F.lit("\x00")) == at["_w"]) & (F.coalesce("segment_id", F.lit("\x00")) == at["_s"]), "left")
    by_column = F.array(*[X.word_tokens(F.coalesce(c, F.lit(""))) for c in COLUMNS])
    r = r.select(*KEEP, *row.values(), "_at", by_column.alias("_words"), F.split(row["lemma_text"], r"\s+").alias("_lemmas"))
    # Outer, as Spark filters by the size of what it explodes and for that tokenizes twice.
    r = r.select("*", F.explode_outer(F.array_distinct(F.flatten("_words"))).alias("tok"))
    has_run = F.col("run").isNull() | F.exists("_words", lambda w: F.contains(F.concat(F.lit(" "), F.concat_ws(" ", w), F.lit(" ")), F.col("run")))
    other = F.exists("others", lambda o: F.contains("norm_text", o["f"]) | F.contains("folded_text", o["d"]) | F.contains("compact_text", o["c"]))
    lemma = F.coalesce(F.array_contains("_at", F.col("query_id")), F.lit(False)) | F.array_contains("_lemmas", F.col("norm"))
    for k, text in zip("fdc", ("norm_text", "folded_text", "compact_text"), strict=True):
        lemma = lemma | (F.col(f"is_{k}") & F.contains(F.col(text), F.col("tok")))
    lemma = lemma | F.coalesce(other, F.lit(False))
    reasons = F.when(F.col("lemma"), F.array("kind", F.lit("corpus-lemma"))).otherwise(F.array("kind"))
    found = []
    for i in range(parts):
        one = lambda df: F.broadcast(df.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else df)  # noqa: B023, E731
        c = r.join(one(words), "tok").filter(has_run if runs else F.lit(True)).join(one(asked), "query_id").withColumn("kind", match_kind()).withColumn("lemma", lemma)
        found.append(c.select("query_id", "query", *KEEP, score(F.col("kind"), F.col("lemma")).alias("score"), reasons.alias("match_reasons")))
    if not cjk.isEmpty():
        found.append(search(cjk, records, lemmas, 1 << 30, candidates="all").drop("rank"))
    return reduce(DataFrame.unionByName, found)


def scan_search(queries: DataFrame, records: DataFrame, limit: int = 20) -> DataFrame:
    """Substring search by scan, for a few queries (query_id, query) without an index.

    Containment has no equi key, so the queries must be few enough to be broadcast
    (``SCAN_QUERIES``, checked); more queries belong into ``search``.
    """
    if queries.limit(SCAN_QUERIES + 1).count() > SCAN_QUERIES:
        raise ValueError(f"a scan takes at most {SCAN_QUERIES} queries")
    q = with_forms(queries).drop("cjk")
    r = records.select("id", "corpus", "language", "work_id", "segment_id", "source_path", "sequence_no", "evidence_class", "raw_text", "norm_text", "folded_text", "compact_text")
    hit = r.join(F.broadcast(q), F.contains(F.col("raw_text"), F.col("query")) | F.contains(F.col("norm_text"), F.col("norm")) | F.contains(F.col("folded_text"), F.col("folded")) | ((F.col("comp") != "") & F.contains(F.col("compact_text"), F.col("comp"))))
    hit = hit.withColumn("kind", match_kind()).withColumn("score", score(F.col("kind"), F.lit(False)))
    return top_per(hit, ["query_id"], rank_order(), limit).select("query_id", "query", "rank", "id", "corpus", "kind", "score")
