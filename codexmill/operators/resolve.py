"""Resolving identifiers to records by work and line range.

An identifier is a work, ``work:line`` or ``work:line..line``, or an id that bridge
relations map to such; line-range bridges come before work bridges. Ranges meet
records on the equi key of the work with the overlap as residual, so the plan is a
hash or sort-merge join, never a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions import ids as I
from codexmill.operators.lookup import top_per
from codexmill.operators.orphans import json_string_list

#: Relation types that map an id to works and to line ranges.
BRIDGE_WORK, BRIDGE_RANGE = "bridge:work", "bridge:line_range"


def requests(identifiers: DataFrame, relations: DataFrame, work=None) -> DataFrame:
    """(identifier, work, start, end, via): what each identifier asks for."""
    ids = identifiers.select("identifier").filter("identifier is not null").distinct()
    p = I.parse_identifier(F.col("identifier"), work)
    direct = ids.withColumn("p", p).filter("p is not null and p.start is not null").select("identifier", "p.*", F.lit("identifier").alias("via"))
    edges = relations.filter(F.col("relation_type").isin(BRIDGE_WORK, BRIDGE_RANGE)).join(ids, relations["from_id"] == ids["identifier"])
    ranged = F.max(F.col("relation_type") == BRIDGE_RANGE).alias("ranged")
    kinds = edges.groupBy("identifier").agg(ranged)
    use = edges.join(kinds, "identifier").filter((F.col("relation_type") == BRIDGE_RANGE) | ~F.col("ranged"))
    via = use.select("identifier", I.parse_identifier(F.col("to_id"), work).alias("p"), F.col("relation_type").alias("via")).filter("p is not null")
    bare = ids.join(direct.select("identifier"), "identifier", "left_anti").join(edges.select("identifier"), "identifier", "left_anti")
    bare = bare.withColumn("p", p).filter("p is not null").select("identifier", "p.*", F.lit("identifier").alias("via"))
    return direct.unionByName(via.select("identifier", "p.*", "via")).unionByName(bare).distinct()


def record_intervals(records: DataFrame, work=None) -> DataFrame:
    """(id, corpus, work, sequence_no, interval): the lines each record covers."""
    rel = F.coalesce(json_string_list(F.col("relation_ids")), F.array().cast("array<string>"))
    norm = work or (lambda c: c)
    return records.filter("work_id is not null").select(
        "id", "corpus", "sequence_no", norm(F.col("work_id")).alias("work"), I.record_interval(F.col("work_id"), F.col("segment_id"), rel, work).alias("interval")
    )


def resolve(identifiers: DataFrame, relations: DataFrame, records: DataFrame, limit: int = 100, work=None) -> DataFrame:
    """(identifier, id, reason, locator, rank): up to ``limit`` records for each identifier."""
    q = requests(identifiers, relations, work)
    r = record_intervals(records, work)
    hit = q.join(r, "work").filter(F.col("start").isNull() | ((F.col("interval.lo") <= F.col("end")) & (F.col("interval.hi") >= F.col("start"))))
    reason = F.when(F.col("start").isNull(), "work_id").otherwise("line_range_overlap")
    hit = hit.select("identifier", "id", "corpus", "sequence_no", reason.alias("reason"), F.when(F.col("start").isNotNull(), F.col("interval.locator")).alias("locator"))
    hit = hit.groupBy("identifier", "id", "corpus", "sequence_no").agg(F.min("reason").alias("reason"), F.max("locator").alias("locator"))
    return top_per(hit, ["identifier"], [F.col("corpus"), F.col("sequence_no"), F.col("id")], limit).select("identifier", "id", "reason", "locator", "rank")
