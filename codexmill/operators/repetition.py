"""How much of the pointers repeats, and what tables of repeated parts would save."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a pointer that name its file, its file as indexed, and its work.
FILE = ("repository", "source_sha", "source_path", "source_blob_sha")
INDEXED = (*FILE, "indexed_source_path")
WORK = ("corpus", "work_id")
#: Fields that belong to the query; all others are the pointer's own.
OF_QUERY = ("rank", "score", "match_reasons")
POINTER = ("rank", "score", "match_reasons", "record_id", "corpus", *INDEXED, "work_id", "segment_id", "sequence_no", "evidence_class", "text_role", "witness")
GROUPINGS = {
    "A_file": FILE,
    "B_indexed_file": INDEXED,
    "C_work": WORK,
    "D_file_and_work": ("corpus", *FILE, "work_id"),
    "E_whole_pointer": tuple(f for f in POINTER if f not in OF_QUERY),
}
ID_CHARS = 64


def as_json(fields: tuple[str, ...]) -> Column:
    return F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"})


def repetition(pointers: DataFrame, groupings: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(grouping, total, unique, duplicates, median_reuse, p95_reuse, max_reuse): one row a grouping of the fields.

    All groupings are counted in one pass, reduced in each task before the shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("grouping"), as_json(f).alias("k")) for n, f in (groupings or GROUPINGS).items()])).alias("g")
    n = pointers.select(each).groupBy("g.grouping", "g.k").agg(F.count("*").alias("n"))
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by n)").cast("long")
    return n.groupBy("grouping").agg(F.sum("n").alias("total"), F.count("*").alias("unique"), (F.sum("n") - F.count("*")).alias("duplicates"), p(0.5).alias("median_reuse"), p(0.95).alias("p95_reuse"), F.max("n").alias("max_reuse"))


def top_reused(pointers: DataFrame, fields: tuple[str, ...] = FILE, n: int = 20) -> DataFrame:
    """The n values of the fields that most pointers share, ties by value."""
    return pointers.groupBy(*fields).agg(F.count("*").alias("reuse")).orderBy(F.col("reuse").desc(), *fields).limit(n)


def field_bytes(pointers: DataFrame) -> DataFrame:
    """(part, bytes): what the parts of a pointer take as JSON, without the commas between fields."""
    part = lambda f: sum((F.octet_length(as_json((x,))) - 2 for x in f), F.lit(0))
    parts = {"file": INDEXED, "query": OF_QUERY, "work_and_segment": tuple(f for f in POINTER if f not in (*INDEXED, *OF_QUERY))}
    one = pointers.agg(*[F.coalesce(F.sum(part(f)), F.lit(0)).alias(n) for n, f in parts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("bytes")) for n in parts])).alias("x")).select("x.part", "x.bytes")


def simulate(pointers: DataFrame, tables: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, records, bytes): the pointers as they are, the tables of ``tables`` (name -> fields) and the pointers that refer to them by id."""
    moved = {f for fs in tables.values() for f in fs}
    left = tuple(f for f in POINTER if f not in moved)
    refs = sum(len(f'"{n}_id":"",') + ID_CHARS for n in tables)
    size = lambda name, c: pointers.agg(F.count("*").alias("records"), F.coalesce(F.sum(c), F.lit(0)).cast("long").alias("bytes")).select(F.lit(name).alias("name"), "records", "bytes")
    out = [size("as they are", F.octet_length(as_json(POINTER))), size("with references", F.octet_length(as_json(left)) + refs)]
    for n, fs in tables.items():
        t = pointers.select(as_json(fs).alias("k")).distinct().agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("k") + len(f'"{n}_id":"",') + ID_CHARS), F.lit(0)).cast("long").alias("bytes"))
        out.append(t.select(F.lit(n).alias("name"), "records", "bytes"))
    return reduce(DataFrame.unionByName, out)


def pointer_quality(queries: DataFrame, pointers: DataFrame) -> DataFrame:
    """One row: queries, those without a pointer, pointers, those without a blob, repeated ones, and those that carry text."""
    per = pointers.groupBy("query_id").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("record_id")).alias("again"), F.count_if(F.col("source_blob_sha").isNull()).alias("blobless"))
    j = queries.select("query_id").distinct().join(per, "query_id", "left").fillna(0, ["n", "again", "blobless"])
    text = F.lit(int("raw_text" in pointers.columns)) * F.sum("n")
    return j.agg(F.count("*").alias("n_queries"), F.count_if(F.col("n") == 0).alias("n_no_result"), F.sum("n").alias("n_pointers"), F.sum("blobless").alias("n_null_blob"), F.sum("again").alias("n_repeated"), text.alias("n_with_text"))
