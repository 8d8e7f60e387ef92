"""Pointers: per query the best distinct sources of every corpus, ranked, materialized, compacted and measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions import ids as I
from codexmill.functions import text as X
from codexmill.operators import search as S
from codexmill.operators.lookup import top_per

#: Static fields of a pointer, in order; rank, score and match_reasons belong to the query.
STATIC = ("record_id", "corpus", "source_sha", "source_path", "work_id", "segment_id", "sequence_no", "evidence_class", "text_role", "witness")


def identifier_rows(records: DataFrame, identifiers: DataFrame) -> DataFrame:
    """(query_id, query, record columns, score, match_reasons): rows whose work or segment is the identifier, all scored exact."""
    ids = identifiers.select("query_id", "query").distinct()
    by_work = records.join(ids, records["work_id"] == ids["query"])
    by_seg = records.filter(~F.col("segment_id").eqNullSafe(F.col("work_id"))).join(ids, F.col("segment_id") == ids["query"])
    keep = ["id", "corpus", "language", "work_id", "segment_id", "source_path", "sequence_no", "evidence_class", "text_role", "witness", "source_sha"]
    hit = by_work.select("query_id", "query", *keep).unionByName(by_seg.select("query_id", "query", *keep))
    return hit.withColumn("score", S.score(F.lit("exact"), F.lit(False))).withColumn("match_reasons", F.array(F.lit("exact")))


def best_sources(rows: DataFrame, per_corpus: int) -> DataFrame:
    """The best row of each (work, source file), of these the first ``per_corpus`` of every corpus, with a rank over all.

    The first step is an aggregate with map-side reduction, the others windows that Spark limits before the shuffle.
    """
    key = ["query_id", "corpus", "work_id", "source_path"]
    order = [(-F.col("score")).alias("_score"), F.col("sequence_no"), F.col("id")]
    rest = [c for c in rows.columns if c not in (*key, "sequence_no", "id")]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*[c if c in key else F.col(f"r.{c}") for c in rows.columns])
    kept = top_per(best, ["query_id", "corpus"], S.rank_order(), per_corpus, "corpus_rank").drop("corpus_rank")
    return top_per(kept, ["query_id"], S.rank_order(), 1 << 30)


def pointers(rows: DataFrame, sources: DataFrame, blobs: DataFrame | None = None) -> DataFrame:
    """(query_id, query, pointers): ranked pointers with repository and blob.

    A corpus without source mapping is an error, and so is a path that is not below its repository.

    sources: corpus, repository, repo_path (one row a corpus). blobs: repo_path,
    source_sha, path, blob_sha.
    """
    j = rows.join(sources, "corpus", "left")
    lost = F.raise_error(F.concat(F.lit("missing source mapping for "), F.col("corpus")))
    j = j.withColumn("repo_path", F.when(F.col("repository").isNull(), lost).otherwise(F.col("repo_path")))
    j = j.withColumn("indexed_source_path", F.col("source_path"))
    inside = I.path_in_repository(F.col("source_path"), F.col("repo_path"))
    j = j.withColumn("source_path", F.when(F.col("repository").isNotNull(), inside))
    if blobs is not None:
        j = j.join(blobs.select("repo_path", "source_sha", F.col("path").alias("source_path"), F.col("blob_sha").alias("source_blob_sha")), ["repo_path", "source_sha", "source_path"], "left")
    else:
        j = j.withColumn("source_blob_sha", F.lit(None).cast("string"))
    p = F.struct(
        "rank", "score", "match_reasons", F.col("id").alias("record_id"), "corpus", "repository", "source_sha", "source_path", "source_blob_sha",
        "indexed_source_path", "work_id", "segment_id", "sequence_no", "evidence_class", "text_role", "witness",
    )
    # At most per_corpus pointers for each of the few corpora, so a query's list is bounded.
    return j.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(p)).alias("pointers"))


def pending(keys: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return keys.join(done.select(*on).distinct(), on, "left_anti")


def same_keys(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(key columns, problem, n): keys missing, unexpected or written more than once; empty if complete."""
    cols = expected.columns
    e = expected.distinct().withColumn("_e", F.lit(1))
    a = actual.select(*cols).groupBy(*cols).agg(F.count("*").alias("n"))
    problem = F.when(F.col("_e").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return e.join(a, cols, "full").withColumn("problem", problem).filter("problem is not null").select(*cols, "problem", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def key_universe(lemmas: DataFrame, records: DataFrame, expect: dict[str, int] | None = None) -> DataFrame:
    """(query_kind, key, bucket): distinct normalized lemmas without CJK, and distinct work ids as written.

    expect: how many keys of each kind there must be; another number is an error.
    """
    lem = lemmas.select("lemma").distinct().filter("trim(lemma) <> ''").filter(~X.has_cjk(F.col("lemma"))).select(X.normalize("lemma").alias("key")).filter("key <> ''").distinct()
    wid = records.select(F.col("work_id").alias("key")).filter("key is not null and trim(key) <> ''").distinct()
    u = lem.select(F.lit("term").alias("query_kind"), "key").unionByName(wid.select(F.lit("identifier").alias("query_kind"), "key"))
    if expect is not None:
        have = {r.query_kind: r["count"] for r in u.groupBy("query_kind").count().collect()}  # two kinds
        if {k: have.get(k, 0) for k in expect} != expect:
            raise ValueError(f"keys expected: {expect}, found: {have}")
    return u.withColumn("bucket", I.bucket(F.col("key")))


def hash_sample(values: DataFrame, value: str, n: int, category: str) -> DataFrame:
    """(key, value): the n distinct normalized values of least SHA-256 under the category (a stable sample)."""
    k = values.select(F.col(value).alias("value")).filter("value is not null").distinct().withColumn("key", X.normalize("value")).filter("key <> ''")
    one = k.groupBy("key").agg(F.min("value").alias("value"))
    h = F.sha2(F.concat(F.lit(category), F.lit("\x00"), F.col("key")), 256)
    return one.orderBy(h, "key").limit(n)


def sample_queries(records: DataFrame, lemmas: DataFrame, latin: int = 200, cjk: int = 200, identifiers: int = 100, cjk_rows: int = 5000, rows_per_corpus: int = 1500) -> DataFrame:
    """(category, query_kind, query, key): a stable sample of real search keys for benchmarks.

    Latin: lemmas with a letter and without CJK. CJK: trigrams of the first ``cjk_rows``
    Chinese rows. Identifiers: work ids of the first rows of every corpus. Of each kind
    those of least hash; the limits are what a sample is.
    """
    if min(latin, cjk, identifiers) < 0:
        raise ValueError("sample sizes must be non-negative")
    lem = lemmas.select("lemma").filter(~X.has_cjk(F.col("lemma")) & F.col("lemma").rlike(r"\p{L}")).distinct()
    place = ["corpus", "source_path", "sequence_no", "id"]
    zh = records.filter("language in ('lzh', 'zh') and raw_text <> ''").orderBy(*place).limit(cjk_rows)
    grams = zh.select(F.explode(X.cjk_trigram_sample(F.col("raw_text"))).alias("gram")).distinct()
    ids = top_per(records.filter("trim(work_id) <> ''").select(*place, "work_id"), ["corpus"], [F.col(c) for c in place[1:]], rows_per_corpus).select("work_id").distinct()
    parts = [("latin_romanized", "term", hash_sample(lem, "lemma", latin, "latin_romanized")), ("cjk", "term", hash_sample(grams, "gram", cjk, "cjk")), ("identifier", "identifier", hash_sample(ids, "work_id", identifiers, "identifier"))]
    out = None
    for category, kind, df in parts:
        one = df.select(F.lit(category).alias("category"), F.lit(kind).alias("query_kind"), F.col("value").alias("query"), "key")
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ compaction


def pointer_rows(ptr: DataFrame) -> DataFrame:
    """One row a pointer: query_id, rank, score, match_reasons and the static fields with their content id."""
    e = ptr.select("query_id", F.explode("pointers").alias("p"))
    static = [F.col(f"p.{c}") for c in STATIC]
    return e.select("query_id", "p.rank", "p.score", "p.match_reasons", *static, I.content_id(*static, names=list(STATIC)).alias("pointer_id"))


def compact(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (query_id, rank, score, match_reasons, pointer_id) and the table of distinct pointers."""
    refs = rows.select("query_id", "rank", "score", "match_reasons", "pointer_id")
    return refs, rows.select("pointer_id", *STATIC).dropDuplicates(["pointer_id"])


def reconstruct(refs: DataFrame, table: DataFrame) -> DataFrame:
    """The pointer rows again; a dangling reference is an error."""
    j = refs.join(table.withColumn("_t", F.lit(True)), "pointer_id", "left")
    lost = F.raise_error(F.concat(F.lit("dangling pointer id: "), F.col("pointer_id")))
    return j.withColumn("pointer_id", F.when(F.col("_t").isNull(), lost).otherwise(F.col("pointer_id"))).select("query_id", "rank", "score", "match_reasons", *STATIC, "pointer_id")


# ------------------------------------------------------------------ statistics


def distribution(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, average, median, p95, max by nearest rank; an empty table gives zeros."""
    c = F.col(value)
    p = lambda q: F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {value})").cast("long"), F.lit(0))
    aggs = [F.count(c).alias("count"), F.coalesce(F.avg(c), F.lit(0.0)).alias("average"), p(0.5).alias("median"), p(0.95).alias("p95"), F.coalesce(F.max(c), F.lit(0)).cast("long").alias("max")]
    return df.groupBy(*(by or [])).agg(*aggs)


def reuse(df: DataFrame, key: list[str], by: list[str] | None = None) -> DataFrame:
    """How often equal keys recur: totals, ratios and nearest-rank figures of the reuse count."""
    n = df.groupBy(*(by or []), *key).agg(F.count("*").alias("n"))
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by n)").cast("long")
    return n.groupBy(*(by or [])).agg(
        F.sum("n").alias("total"), F.count("*").alias("unique"), (F.sum("n") - F.count("*")).alias("duplicates"),
        ((F.sum("n") - F.count("*")) / F.sum("n")).alias("dedup_ratio"), (F.sum("n") / F.count("*")).alias("average_reuse"), p(0.5).alias("median_reuse"), p(0.95).alias("p95_reuse"), F.max("n").alias("max_reuse"),
    )


def distinct_works(df: DataFrame) -> DataFrame:
    """(n): pairs of corpus and work that some row names."""
    return df.select("corpus", "work_id").filter("work_id is not null").distinct().agg(F.count("*").alias("n"))


def query_stats(rows: DataFrame, measure: bool = True) -> DataFrame:
    """(query_id, n_pointers, n_work_files, n_corpora, n_bytes) of pointer rows; n_bytes, which takes all static fields, only if they are measured."""
    files = F.count_distinct(F.struct("corpus", "work_id", "source_path"))
    aggs = [F.count("*").alias("n_pointers"), files.alias("n_work_files"), F.count_distinct("corpus").alias("n_corpora")]
    if measure:
        aggs.append(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(c) for c in STATIC]), {"ignoreNullFields": "false"}))).alias("n_bytes"))
    return rows.groupBy("query_id").agg(*aggs)


def extrapolate(dist: DataFrame, n_keys: int) -> DataFrame:
    """Lower, central and upper estimate for n_keys from a distribution; ratios round half to even."""
    n = F.lit(n_keys)
    return dist.select(
        F.bround(n * F.least("median", "average")).cast("long").alias("lower"), F.bround(n * F.col("average")).cast("long").alias("central"), F.bround(n * F.greatest("average", F.col("p95"))).cast("long").alias("upper")
    )


def key_stats(values: DataFrame, value: str, exclude_cjk: bool = False) -> DataFrame:
    """One row: rows, empty, excluded, distinct as written, distinct normalized, lost to normalization, by length."""
    v = values.select(F.col(value).alias("v"))
    blank = F.col("v").isNull() | (F.btrim(F.coalesce("v", F.lit(""))) == "")
    cjk = ~blank & X.has_cjk(F.col("v")) if exclude_cjk else F.lit(False)
    # Everything further is counted on distinct values.
    d = v.groupBy("v").agg(F.count("*").alias("n")).withColumn("blank", blank).withColumn("cjk", cjk).withColumn("norm", X.normalize("v"))
    ok = ~F.col("blank") & ~F.col("cjk")
    one = d.agg(
        F.sum("n").alias("total_rows"), F.coalesce(F.sum(F.when(F.col("blank"), F.col("n"))), F.lit(0)).alias("empty_rows"),
        F.coalesce(F.sum(F.when(F.col("cjk"), F.col("n"))), F.lit(0)).alias("excluded_rows"), F.count_if(ok).alias("distinct_original"),
        F.count_distinct(F.when(ok & (F.col("norm") != ""), F.col("norm"))).alias("distinct_normalized"),
    )
    return one.withColumn("lost", F.col("distinct_original") - F.col("distinct_normalized"))


def key_collisions(values: DataFrame, value: str) -> DataFrame:
    """(key, originals): normalized keys that several spellings share."""
    d = values.select(F.col(value).alias("v")).filter("v is not null and trim(v) <> ''").distinct().withColumn("key", X.normalize("v"))
    return d.filter("key <> ''").groupBy("key").agg(F.array_join(F.sort_array(F.collect_set("v")), " | ").alias("originals"), F.count("*").alias("n")).filter("n > 1")


def length_buckets(values: DataFrame, value: str) -> DataFrame:
    d = values.select(X.normalize(value).alias("k")).filter("k <> ''").distinct()
    return d.groupBy(X.length_bucket(F.col("k")).alias("bucket")).agg(F.count("*").alias("n"))


def vocabulary_stats(vocab: DataFrame) -> DataFrame:
    """One row over (term, doc, cnt): sizes, lengths, document frequency by nearest rank, occurrences."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by doc)").cast("long")
    return vocab.agg(
        F.count("*").alias("n_terms"), F.min(F.length("term")).cast("long").alias("min_len"), F.max(F.length("term")).cast("long").alias("max_len"), F.avg("doc").alias("avg_doc"),
        p(0.5).alias("median_doc"), p(0.95).alias("p95_doc"), F.max("doc").alias("max_doc"), F.sum("cnt").alias("n_occurrences"),
    )


def histogram(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("doc").agg(F.count("*").alias("n_terms"))


def top_terms(vocab: DataFrame, n: int = 20) -> DataFrame:
    return vocab.orderBy(F.col("doc").desc(), "term").limit(n)


def cjk_only(vocab: DataFrame, wide: bool = True) -> DataFrame:
    return vocab.filter(X.has_cjk(F.col("term"), wide))


