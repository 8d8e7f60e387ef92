"""Lookups over the corpus tables, in batch form: one row of ``ids`` is one query.

Every lookup takes the identifiers as a DataFrame (column ``identifier`` or
``id``), so many lookups are one join; a single lookup is a batch of one. OR
conditions are unions of equi-joins, prefixes equi-joins on exploded prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.operators.order import neighbours

#: The provenance of a record.
PROVENANCE = (
    "corpus", "source_path", "work_id", "segment_id", "source_sha", "evidence_class", "text_role", "witness", "language", "collection_name", "relation_ids",
)
WORK_COLUMNS = ("id", "corpus", "language", "work_id", "segment_id", "title", "source_path", "source_sha", "evidence_class", "witness", "sequence_no")


def top_per(df: DataFrame, key: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each group before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))


def provenance(records: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, provenance fields, text) of the records sought."""
    r = records if ids is None else records.join(ids.select("id").distinct(), "id", "left_semi")
    return r.select("id", *PROVENANCE, F.col("raw_text").alias("text"))


def context(records: DataFrame, window: int = 2, ids: DataFrame | None = None) -> DataFrame:
    """(id, offset, neighbour) within corpus, work and source file, in order of sequence and id."""
    return neighbours(records, ["corpus", "work_id", "source_path"], ["sequence_no", "id"], window, "id", ids)


def work(works: DataFrame, identifiers: DataFrame, limit: int = 100, records: DataFrame | None = None) -> DataFrame:
    """Records of each identifier (exact, case-sensitive), the first ``limit`` by corpus and sequence."""
    src = records if records is not None else works
    hit = src.select(*[c for c in WORK_COLUMNS if c in src.columns]).join(identifiers.select(F.col("identifier").alias("work_id")).distinct(), "work_id", "left_semi")
    order = [F.col("corpus"), F.col("sequence_no"), F.col("id")] if "sequence_no" in hit.columns else [F.col("corpus"), F.col("source_path")]
    return top_per(hit, ["work_id"], order, limit)


def parallels(relations: DataFrame, identifiers: DataFrame, limit: int = 500) -> DataFrame:
    """Edges from or to each identifier or to a part of it (``identifier#...``), in both directions.

    (identifier, rank, relation columns); an edge counts once for an identifier.
    """
    ids = identifiers.select("identifier").filter("identifier is not null").distinct()
    ends = None
    for end in ("from_id", "to_id"):
        whole = relations.withColumn("identifier", F.col(end))
        part = relations.filter(F.col(end).contains("#")).withColumn("identifier", F.substring_index(end, "#", 1))
        both = whole.unionByName(part)
        ends = both if ends is None else ends.unionByName(both)
    # An edge from an identifier to itself, or repeated by both ends, comes up twice.
    hit = ends.join(ids, "identifier", "left_semi").dropDuplicates(["identifier", "id"])
    return top_per(hit, ["identifier"], [F.col("relation_type"), F.col("from_id"), F.col("to_id"), F.col("id")], limit)


def prefixes(c: Column) -> Column:
    """All prefixes of a key, from one character to the whole."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, F.lit(1), n)))


#: Identifiers with wildcards that one lookup takes.
WILD = 1000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_prefix(df: DataFrame, column: str, identifiers: DataFrame) -> DataFrame:
    """df with ``identifier``: rows whose column begins like an identifier, the way LIKE compares.

    ASCII letters match in either case, ``_`` any character and ``%`` any run of them. Identifiers
    without these are an equi-join; those with, which no key can find, are compared with every row
    and must be few (``WILD``, checked).
    """
    ids = identifiers.select("identifier").filter("identifier is not null").distinct()
    wild = F.col("identifier").rlike("[_%]")
    plain = ids.filter(~wild).withColumn("_p", lower_ascii(F.col("identifier")))
    hit = df.withColumn("_p", F.explode(prefixes(lower_ascii(F.col(column))))).join(plain, "_p").drop("_p")
    some = ids.filter(wild)
    n = some.limit(WILD + 1).count()
    if n > WILD:
        raise ValueError(f"a lookup takes at most {WILD} identifiers with wildcards")
    if n:
        pattern = F.concat(F.replace(lower_ascii(F.col("identifier")), F.lit("\\"), F.lit("\\\\")), F.lit("%"))
        hit = hit.unionByName(df.join(F.broadcast(some), F.like(lower_ascii(F.col(column)), pattern)))
    return hit


def variants(variants_: DataFrame, identifiers: DataFrame, limit: int = 500, like: bool = False) -> DataFrame:
    """Variants of each identifier as work, segment or prefix of a segment; ``like``: prefixes as ``like_prefix`` compares them."""
    ids = identifiers.select("identifier").filter("identifier is not null").distinct()
    by_work = variants_.filter("work_id is not null").withColumn("identifier", F.col("work_id")).join(ids, "identifier", "left_semi")
    if like:
        by_prefix = like_prefix(variants_, "segment_id", ids)
    else:
        by_prefix = variants_.withColumn("identifier", F.explode(prefixes(F.col("segment_id")))).join(ids, "identifier", "left_semi")
    hit = by_work.unionByName(by_prefix).dropDuplicates(["identifier", "id"])
    return top_per(hit, ["identifier"], [F.col("corpus"), F.col("segment_id"), F.col("id")], limit)


def compare(records: DataFrame, identifiers: DataFrame, limit: int = 50) -> DataFrame:
    """Records of each identifier as work or segment, side by side and never merged."""
    ids = identifiers.select("identifier").filter("identifier is not null").distinct()
    cols = ["id", "corpus", "language", "work_id", "segment_id", "evidence_class", "text_role", "witness", "sequence_no"]
    r = records.select(*cols)
    by_work = r.withColumn("identifier", F.col("work_id"))
    by_seg = r.filter(~F.col("segment_id").eqNullSafe(F.col("work_id"))).withColumn("identifier", F.col("segment_id"))
    hit = by_work.unionByName(by_seg).join(ids, "identifier", "left_semi")
    return top_per(hit, ["identifier"], [F.col("evidence_class"), F.col("corpus"), F.col("sequence_no"), F.col("id")], limit)


def evidence(records: DataFrame, variants_: DataFrame, window: int = 2) -> DataFrame:
    """Per record: provenance, context ids before and after, and the number of its variants.

    The variants of a record are those of its work, of its segment, and of segments
    its segment id is a prefix of; they are counted by key, not paired with every record.
    """
    ctx = context(records, window).groupBy("id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("offset") < 0, F.struct("offset", "neighbour")))), lambda s: s["neighbour"]).alias("before"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("offset") > 0, F.struct("offset", "neighbour")))), lambda s: s["neighbour"]).alias("after"),
    )
    v = variants_.select("work_id", "segment_id")
    by_work = v.filter("work_id is not null").groupBy("work_id").agg(F.count("*").alias("n_work"))
    ex = v.select("work_id", F.explode(prefixes(F.col("segment_id"))).alias("segment_id"))
    by_seg = ex.groupBy("segment_id").agg(F.count("*").alias("n_seg"))
    by_both = ex.filter("work_id is not null").groupBy("work_id", "segment_id").agg(F.count("*").alias("n_both"))
    r = records.select("id", "corpus", "work_id", "segment_id", "source_path", "source_sha", "evidence_class", "text_role", "witness")
    out = r.join(by_work, "work_id", "left").join(by_seg, "segment_id", "left").join(by_both, ["work_id", "segment_id"], "left").join(ctx, "id", "left")
    n = F.coalesce("n_work", F.lit(0)) + F.coalesce("n_seg", F.lit(0)) - F.coalesce("n_both", F.lit(0))
    none = F.array().cast("array<bigint>")
    return out.select(*r.columns, F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"), n.alias("n_variants"))


def status(tables: dict[str, DataFrame], source_state: DataFrame | None = None) -> DataFrame:
    """(table, rows) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def fail_closed(df: DataFrame, identifiers: DataFrame, key: str = "identifier") -> DataFrame:
    """(identifier, found, message): whether a lookup found anything; nothing found is said, not passed over."""
    hit = df.select(key).distinct().withColumn("_f", F.lit(True))
    out = identifiers.select(key).distinct().join(hit, key, "left")
    found = F.coalesce("_f", F.lit(False))
    return out.select(key, found.alias("found"), F.when(~found, "not enough data in the present corpus").alias("message"))
