"""Maintaining the corpus tables: first-wins and last-wins keys, purging, roles, incremental builds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexmill.session import drop, exists

RECORD_KEY = ["corpus", "source_path", "segment_id", "language", "witness"]
RELATION_KEY = ["corpus", "relation_type", "from_id", "to_id", "source_path"]
WORK_KEY = ["corpus", "work_id", "source_path"]


def insert_or_ignore(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key by ``order``; rows with a null in the key never conflict.

    An aggregate, not a window: each task reduces its rows first, so a hot key costs one row a task.
    """
    whole = F.lit(True)
    for k in key:
        whole = whole & F.col(k).isNotNull()
    row = F.struct(*[F.col(c) for c in df.columns])
    first = df.filter(whole).groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")
    return first.unionByName(df.filter(~whole))


def upsert(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last row of each key by ``order``; null key columns are equal to each other."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(key)]).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def drop_blank(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Rows whose text holds more than white space."""
    return df.filter(F.col(text).rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))


def purge(df: DataFrame, corpus: str) -> DataFrame:
    return df.filter(F.col("corpus") != corpus)


def backfill_roles(df: DataFrame, roles: dict[str, str], by_witness: dict[str, str] | None = None) -> DataFrame:
    """text_role by corpus, or by the prefix of the witness, where it is unspecified."""
    role = F.lit(None).cast("string")
    for prefix, r in (by_witness or {}).items():
        role = F.coalesce(role, F.when(F.col("witness").startswith(prefix), r))
    for c, r in roles.items():
        role = F.coalesce(role, F.when(F.col("corpus") == c, r))
    return df.withColumn("text_role", F.when(F.col("text_role") == "unspecified", F.coalesce(role, "text_role")).otherwise(F.col("text_role")))


def stale_sources(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources of ``wanted`` (corpus, source_sha, parser_version) whose state differs or is absent."""
    return wanted.join(state.select("corpus", "source_sha", "parser_version"), ["corpus", "source_sha", "parser_version"], "left_anti")


def setdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side holds more often than the other: (side, columns, n); one aggregate over both."""
    both = a.withColumn("_n", F.lit(1).cast("long")).unionByName(b.select(*a.columns).withColumn("_n", F.lit(-1).cast("long")))
    d = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0")
    return d.select(F.when(F.col("_n") > 0, "left").otherwise("right").alias("side"), *a.columns, F.abs("_n").alias("n"))


def build(
    spark: SparkSession, out: str, sources: dict[str, tuple[str, str, Callable[[], dict[str, DataFrame]]]], force: bool = False, only: list[str] | None = None, manifest: dict[str, str] | None = None
) -> list[str]:
    """Incremental build: parse the sources that changed and replace their partitions.

    sources: corpus -> (source_sha, parser_version, function giving its tables by
    name). Each table is written partitioned by corpus with dynamic overwrite, the
    state row last, so a lost run leaves the old state. ``manifest`` (corpus -> sha) pins
    what a source must be: another sha is an error before anything is written. A build
    takes away the mark of the search index, which no longer fits. Returns the corpora built.
    """
    unknown = set(only or ()) - set(sources)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    for corpus, sha in (manifest or {}).items():
        if corpus in sources and sources[corpus][0] != sha:
            raise ValueError(f"{corpus} is at {sources[corpus][0]}, the manifest pins {sha}")
    state = {}
    if exists(spark, f"{out}/source_state"):
        state = {r.corpus: (r.source_sha, r.parser_version) for r in spark.read.parquet(f"{out}/source_state").collect()}  # one row a corpus
    done = []
    for corpus, (sha, version, parse) in sources.items():
        if only and corpus not in only or not force and state.get(corpus) == (sha, version):
            continue
        drop(spark, f"{out}/search_index_state")
        counts = {}
        for name, df in parse().items():
            df.withColumn("corpus", F.lit(corpus)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(f"{out}/{name}")
            counts[name] = spark.read.parquet(f"{out}/{name}").filter(F.col("corpus") == corpus).count()
        n = [F.lit(counts.get(t, 0)).cast("long").alias(f"{t[:-1]}_count") for t in ("records", "relations", "variants", "lemmas")]
        row = spark.range(1).select(F.lit(corpus).alias("corpus"), F.lit(sha).alias("source_sha"), F.lit(version).alias("parser_version"), F.current_timestamp().alias("indexed_at"), *n)
        row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(f"{out}/source_state")
        done.append(corpus)
    return done


def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(corpus, table_name, rows) of every table that has a corpus."""
    parts = [df.groupBy("corpus").agg(F.count("*").alias("rows")).select("corpus", F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def corpora(tables: list[DataFrame]) -> DataFrame:
    """(corpus): every corpus that some table names."""
    return reduce(DataFrame.unionByName, [df.select("corpus").distinct() for df in tables]).distinct()


def source_status(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(corpus, present, sha_match, status) of pinned sources.

    expected: corpus, source_sha. present: corpus, source_sha as found; a source found at several is no match.
    """
    p = present.groupBy("corpus").agg(F.min("source_sha").alias("_a"), F.max("source_sha").alias("_b"))
    j = expected.select("corpus", "source_sha").join(p, "corpus", "left")
    ok = F.coalesce((F.col("_a") == F.col("source_sha")) & (F.col("_b") == F.col("source_sha")), F.lit(False))
    status = F.when(F.col("_a").isNull(), "missing").when(ok, "pinned").otherwise("moved")
    return j.select("corpus", F.col("_a").isNotNull().alias("present"), ok.alias("sha_match"), status.alias("status"))


def latest_delivery(records: DataFrame) -> DataFrame:
    """Of rows delivered again under one natural key, the last by arrival and id."""
    return upsert(records, RECORD_KEY, ["ingested_at", "id"])


def chunks(df: DataFrame, group: list[str], order: list[str], size: int, text: str, sep: str = " ") -> DataFrame:
    """Runs of ``size`` rows of each group joined to one text: group, chunk_no, first, last, n, text.

    A group is one source file; ``first`` and ``last`` are the values of the last order column.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    n = df.withColumn("chunk_no", F.floor((F.row_number().over(w) - 1) / size).cast("long"))
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    g = n.groupBy(*group, "chunk_no").agg(items.alias("_i"))
    last = order[-1]
    return g.select(
        *group, "chunk_no", F.col("_i")[0][last].alias("first"), F.element_at("_i", -1)[last].alias("last"), F.size("_i").cast("long").alias("n"), F.array_join(F.transform("_i", lambda s: s["_t"]), sep).alias("text")
    )


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The last non-null value at or before each row of a file."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
