"""Global ordinals, running totals and neighbours without a one-task window.

Rows are range-partitioned by the sort key and numbered inside each partition; only
one small row a partition (its count and sum) is needed to place the partitions one
after the other. A group that holds a third of all rows is spread over as many
partitions as its rows need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import spool


def with_ordinal(df: DataFrame, order: list[str], name: str = "ordinal", total_of: Column | None = None, total_name: str = "running") -> DataFrame:
    """``df`` with its 0-based place in the order, and the running total of a value up to the row (inclusive).

    The order must be total for a reproducible result; rows equal in it are placed in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.withColumn("_v", total_of if total_of is not None else F.lit(0).cast("long"))
    placed = src.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    m = F.monotonically_increasing_id()
    placed = spool(placed.withColumn("_m", m), "ordered")
    placed = placed.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    if total_of is not None:
        w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        placed = placed.withColumn("_in", F.sum("_v").over(w))
    else:
        placed = placed.withColumn("_in", F.lit(0).cast("long"))
    # One row a partition.
    parts = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    out = placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_n0") + F.col("_i"))
    if total_of is not None:
        out = out.withColumn(total_name, F.col("_s0") + F.col("_in"))
    return out.drop("_v", "_m", "_p", "_i", "_in", "_n0", "_s0")


def neighbours(df: DataFrame, group: list[str], order: list[str], window: int, key: str = "id", targets: DataFrame | None = None) -> DataFrame:
    """(key, offset, neighbour): the rows up to ``window`` before and after each in its group.

    ``targets`` (column key) limits the rows whose neighbours are sought. Groups with
    null columns are groups of their own. A window of 0 gives no rows.
    """
    if window < 0:
        raise ValueError("window must be non-negative")
    cols = [F.col(c).alias(f"_g{i}") for i, c in enumerate(group)]
    if targets is not None:  # only the groups of the targets are put in order
        seek = df.join(targets.select(key).distinct(), key, "left_semi").select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(group)]).distinct()
        df = df.join(seek, [F.col(c).eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(group)], "left_semi")
    o = spool(with_ordinal(df, [*group, *order]).select(key, "ordinal", *cols), "ordinal")
    left = o if targets is None else o.join(targets.select(key).distinct(), key, "left_semi")
    offsets = F.array(*[F.lit(k) for k in range(-window, window + 1) if k])
    if window == 0:
        return o.select(key, F.lit(0).cast("long").alias("offset"), F.col(key).alias("neighbour")).limit(0)
    left = left.select(F.col(key).alias("_k"), *[F.col(f"_g{i}").alias(f"_h{i}") for i in range(len(group))], "ordinal", F.explode(offsets).alias("offset"))
    left = left.withColumn("ordinal", F.col("ordinal") + F.col("offset"))
    same = F.lit(True)
    for i in range(len(group)):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col(f"_h{i}"))
    return left.join(o, "ordinal").filter(same).select(F.col("_k").alias(key), F.col("offset").cast("long"), F.col(key).alias("neighbour"))
