"""Full export in size-bounded shards, with an inverted locator from keys to shards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import ids as I
from codexmill.functions import text as X
from codexmill.operators import search as S
from codexmill.operators.order import neighbours, with_ordinal
from codexmill.session import broadcast_within, exists, spool, spread

SHARD_BYTES, LOCATOR_BYTES = 512 * 1024, 8 * 1024 * 1024
EXPORT = ("id", "corpus", "language", "collection_name", "work_id", "segment_id", "title", "raw_text", "source_path", "source_sha", "evidence_class", "text_role", "witness", "relation_ids", "sequence_no")
ORDER = ["corpus", "work_id", "source_path", "sequence_no", "id"]


def shards(records: DataFrame, target: int = SHARD_BYTES) -> DataFrame:
    """(id, corpus, work_id, n_bytes, shard): every record's shard by the running bytes of its corpus.

    A shard takes the rows whose running total ends in the same multiple of the
    target. It differs from sequential packing by at most one row at a border, and
    needs no pass over a corpus in one task. Lines over the target fill shards alone
    or with what precedes them.
    """
    cols = [c for c in EXPORT if c in records.columns]
    line = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"})) + 1
    r = with_ordinal(records.select("id", "corpus", "work_id", "source_path", "sequence_no", line.cast("long").alias("n_bytes")), ORDER, total_of=F.col("n_bytes"))
    start = r.groupBy(F.col("corpus").alias("_k")).agg(F.min(F.col("running") - F.col("n_bytes")).alias("_c"))
    r = r.join(F.broadcast(start), F.col("corpus").eqNullSafe(F.col("_k")))  # one row a corpus
    return r.select("id", "corpus", "work_id", "n_bytes", F.floor((F.col("running") - F.col("_c") - 1) / F.lit(target)).alias("shard"), "ordinal")


def parts(df: DataFrame, by: list[str], order: list[str], target: int) -> DataFrame:
    """df with ``line`` (its row as JSON), ``n_bytes`` and ``part``: parts of some ``target`` bytes within each group, in order.

    Parts follow running sizes, as shards do.
    """
    line = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    r = df.withColumn("line", line).withColumn("n_bytes", (F.octet_length("line") + 1).cast("long"))
    r = with_ordinal(r, [*by, *order], "_n", total_of=F.col("n_bytes"), total_name="_run")
    start = r.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]).agg(F.min(F.col("_run") - F.col("n_bytes")).alias("_c"))
    r = r.join(start, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)])
    return r.select(*df.columns, "line", "n_bytes", F.floor((F.col("_run") - F.col("_c") - 1) / F.lit(target)).alias("part"))


def part_stats(parted: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by..., part, items, bytes, first_key, last_key)."""
    return parted.groupBy(*by, "part").agg(F.count("*").alias("items"), F.sum("n_bytes").alias("bytes"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def write_parts(parted: DataFrame, by: list[str], key: str, path: str) -> None:
    """The lines of each part as text, in folders by group and part."""
    r = parted.repartition(*by, "part").sortWithinPartitions(*by, "part", key)
    r.select(*by, "part", "line").write.mode("overwrite").partitionBy(*by, "part").text(path)


def shard_stats(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("corpus", "shard").agg(
        F.count("*").alias("items"), F.sum("n_bytes").alias("bytes"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("work_id").alias("works"),
        F.min("work_id").alias("first_work"), F.max("work_id").alias("last_work"),
    )


def overlap(records: DataFrame, sharded: DataFrame, n: int = 2) -> DataFrame:
    """(corpus, shard, id, role): the rows of each shard and up to n neighbours on both sides as context."""
    near = neighbours(records, ["corpus"], ["work_id", "source_path", "sequence_no", "id"], n)
    s = sharded.select("id", "corpus", "shard")
    by = s.withColumnRenamed("id", "neighbour").withColumnRenamed("shard", "of_shard").drop("corpus")
    border = near.join(s, "id").join(by, "neighbour").filter("shard <> of_shard").select("corpus", F.col("shard"), F.col("neighbour").alias("id")).distinct()
    return s.select("corpus", "shard", "id", F.lit("primary").alias("role")).unionByName(border.withColumn("role", F.lit("context_overlap")))


def write_shards(records: DataFrame, sharded: DataFrame, path: str) -> None:
    """JSON lines partitioned by corpus and shard."""
    r = records.select(*EXPORT).join(sharded.select("id", "shard", "ordinal"), "id")
    r.repartition("corpus", "shard").sortWithinPartitions("corpus", "shard", "ordinal").drop("ordinal").write.mode("overwrite").partitionBy("corpus", "shard").json(path)


def surface_map(lemmas: DataFrame) -> DataFrame:
    """(surface, lemma): normalized and folded surfaces to normalized lemmas."""
    d = lemmas.select("surface", "lemma").filter("surface is not null and lemma is not null").distinct()
    d = d.withColumn("_s", X.forms("surface")).withColumn("l", X.normalize("lemma"))
    both = d.select(F.col("_s.norm").alias("surface"), F.col("l").alias("lemma")).unionByName(d.select(F.col("_s.folded").alias("surface"), F.col("l").alias("lemma")))
    return both.filter("surface <> '' and lemma <> ''").distinct()


def locator_keys(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, namespace, key, kind, kept columns): Latin tokens, CJK bigrams and identifiers of every record."""
    toks = F.col("_toks") if "_toks" in records.columns else X.locator_tokens("raw_text", "title")
    latin = records.select("id", *keep, F.explode(toks).alias("t")).select("id", *keep, F.lit("latin").alias("namespace"), F.col("t.token").alias("key"), F.col("t.kind").alias("kind"))
    c = records.select("id", *keep, "raw_text", X.compact("raw_text").alias("_c"))
    cjk = c.select("id", *keep, "raw_text", F.explode(X.cjk_bigrams(F.col("_c"))).alias("key"))
    cjk = cjk.select("id", *keep, F.lit("cjk").alias("namespace"), "key", F.when(F.contains("raw_text", "key"), "exact").otherwise("compact-unicode").alias("kind"))
    ident = records.select("id", *keep, F.explode(F.array_distinct(F.array(X.normalize("work_id"), X.normalize("segment_id")))).alias("key")).filter("key <> ''")
    return reduce(DataFrame.unionByName, [latin, cjk, ident.select("id", *keep, F.lit("identifier").alias("namespace"), "key", F.lit("exact").alias("kind"))])


def locator(records: DataFrame, sharded: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(namespace, bucket, key, corpus, shard, score, ordinal): of every key and shard the best record.

    The winner has the highest score, then the least place in the export order. Shard
    and place join the records before their keys are spelled out, so the many keys are
    shuffled once, reduced in each task first: a key held by all records costs a task
    one row a shard.
    """
    # What a key's score needs of its record travels as one number and one list.
    base = S.score(F.lit("exact"), F.lit(False)) - S.MATCH_SCORE["exact"]
    r = spread(records).drop("corpus").join(sharded.select("id", "corpus", "shard", "ordinal"), "id").withColumn("_base", base)
    r = r.withColumn("_lt", F.split(F.coalesce("lemma_text", F.lit("")), r"\s+"))
    place = ("corpus", "shard", "ordinal", "_base")
    r = r.select("id", *place, "raw_text", "work_id", "segment_id", "_lt", X.locator_tokens("raw_text", "title").alias("_toks"))
    lemma = F.lit(False)
    if lemmas is None:
        j = locator_keys(r, place)
    else:
        # A key is a lemma of the record if another of its tokens has it as lemma, or its lemma text holds it.
        # Each record gets the list of its lemmas, so that nothing is joined by its many keys.
        r = spool(r, "tokens")
        m = broadcast_within(surface_map(lemmas).toDF("_s", "_lemma").groupBy("_s").agg(F.collect_set("_lemma").alias("_ls")))
        of = r.select("id", F.explode("_toks.token").alias("key")).join(m, F.col("key") == F.col("_s"))
        of = of.select("id", F.explode(F.array_remove("_ls", F.col("key"))).alias("_lemma")).groupBy("id").agg(F.collect_set("_lemma").alias("_own"))
        r = r.join(of, "id", "left").withColumn("_own", F.array_union(F.coalesce("_own", F.array().cast("array<string>")), "_lt")).drop("_lt")
        j = locator_keys(r, (*place, "_own"))
        lemma = F.array_contains("_own", F.col("key"))
    kind = F.when(F.lit(False), 0)
    for k, v in S.MATCH_SCORE.items():
        kind = kind.when(F.col("kind") == k, v)
    j = j.withColumn("score", (F.col("_base") + kind + F.when(lemma, S.LEMMA_SCORE).otherwise(0)).cast("long"))
    best = F.max_by(F.struct("score", "ordinal"), F.struct("score", -F.col("ordinal")))
    out = j.groupBy("namespace", "key", "corpus", "shard").agg(best.alias("b"))
    return out.select("namespace", I.bucket(F.col("key")).alias("bucket"), "key", "corpus", "shard", "b.score", "b.ordinal")


def locator_rows(loc: DataFrame) -> DataFrame:
    """(namespace, bucket, key, shards): the shards of every key, best first."""
    items = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("ordinal"), F.col("corpus"), F.col("shard"))))
    return loc.groupBy("namespace", "bucket", "key").agg(F.transform(items, lambda x: F.struct(x["corpus"].alias("corpus"), x["shard"].alias("shard"))).alias("shards"))


def write_locator(rows: DataFrame, path: str, target: int = LOCATOR_BYTES) -> DataFrame:
    """JSON lines in parts of some ``target`` bytes below namespace and bucket; returns what each part holds."""
    p = spool(parts(rows, ["namespace", "bucket"], ["key"], target), "locator")
    write_parts(p, ["namespace", "bucket"], "key", path)
    return part_stats(p, ["namespace", "bucket"], "key")


LOCATOR = "namespace string, bucket string, key string, shards array<struct<corpus:string,shard:long>>"


def read_locator(spark: SparkSession, path: str, namespace: str, key: str) -> DataFrame:
    """The rows of one key; its namespace and bucket name the only folder that is read."""
    import hashlib

    b = hashlib.sha256(key.encode()).hexdigest()[:2]
    folder = f"{path}/namespace={namespace}/bucket={b}"
    if not exists(spark, folder):
        return spark.createDataFrame([], LOCATOR)
    return spark.read.schema(LOCATOR).json(folder).filter(F.col("key") == key)


def locate(spark: SparkSession, path: str, namespace: str, key: str):
    """The one row of a key; none or several are an error."""
    rows = read_locator(spark, path, namespace, key).limit(2).collect()
    if len(rows) != 1:
        raise LookupError(f"{'no' if not rows else 'more than one'} row of {key!r} in {namespace}")
    return rows[0]


def locator_stats(loc: DataFrame) -> DataFrame:
    return loc.groupBy("namespace").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("entries"))


