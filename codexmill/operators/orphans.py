"""References to rows that do not exist, under partial-null composite keys.

``find_orphans`` takes references whose key has several columns, any of which
may be null, and a target table whose rows hold for an interval of time. The
references are grouped by null mask; each mask is matched on its non-null
columns only (``MATCH PARTIAL``); ``simple`` and ``full`` are offered too.

Defined results
* all key columns null: never a case (partial, simple); ``full``: never a case.
* some null: partial - matched on the rest; simple - never a case; full - a
  case with status ``missing``.
* null reference time: only ``missing`` can be told, else no case.
* null ``valid_from``: the row holds from the beginning of time.
* empty targets: every reference with a key is ``missing``.
* columns of the references must not begin with an underscore.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.operators.order import with_ordinal
from codexmill.session import broadcast_within

#: Intervals of one key that are held as an array; beyond, references and intervals are swept in order.
MAX_SPANS = 1000


def target_spans(targets: DataFrame, keys: list[str], valid_from: str, valid_to: str, with_spans: bool = True) -> DataFrame:
    """One row a key: its intervals, and the first moment any of them begins (null: from ever)."""
    t = targets.select(*keys, F.col(valid_from).alias("_a"), F.col(valid_to).alias("_b"))
    for k in keys:
        t = t.filter(F.col(k).isNotNull())
    first = F.when(F.count_if(F.col("_a").isNull()) == 0, F.min("_a")).alias("_first")
    spans = [F.collect_set(F.struct("_a", "_b")).alias("_spans")] if with_spans else []
    return t.groupBy(*keys).agg(first, F.lit(True).alias("_any"), *spans)


def _holds_by_sweep(part: DataFrame, targets: DataFrame, pairs: list[tuple[str, str]], at: str, valid_from: str, valid_to: str) -> DataFrame:
    """``part`` with ``_holds``: whether an interval of its key is open at ``at``.

    References and the ends of intervals are put in one order by key and time, and the
    open intervals counted by a running total. Each interval opens and closes within
    its key, so the total over the whole order counts within the key, and no key, however
    hot, is one task's.
    """
    kind = targets.schema[valid_from].dataType.simpleString()
    keys = [F.col(c).alias(f"_k{i}") for i, (_, c) in enumerate(pairs)]
    t = targets.select(*keys, F.col(valid_from).alias("_a"), F.coalesce(F.col(valid_to), F.lit("9999-12-31").cast(kind)).alias("_b"))
    for i in range(len(pairs)):
        t = t.filter(F.col(f"_k{i}").isNotNull())
    t = t.filter("_a is null or _a < _b")
    none = F.lit(None).cast(part.select(F.struct(*[F.col(c) for c in part.columns]).alias("r")).schema["r"].dataType)
    ks = [f"_k{i}" for i in range(len(pairs))]
    ends = t.select(*ks, F.col("_a").alias("_t"), F.lit(1).alias("_o"), F.lit(1).cast("long").alias("_d"), none.alias("_r"))
    ends = ends.unionByName(t.select(*ks, F.col("_b").alias("_t"), F.lit(0).alias("_o"), F.lit(-1).cast("long").alias("_d"), none.alias("_r")))
    row = F.struct(*[F.col(c) for c in part.columns])
    refs = part.select(*[F.col(r).alias(f"_k{i}") for i, (r, _) in enumerate(pairs)], F.col(at).cast(kind).alias("_t"), F.lit(2).alias("_o"), F.lit(0).cast("long").alias("_d"), row.alias("_r"))
    order = with_ordinal(refs.unionByName(ends), [*ks, "_t", "_o"], "_n", F.col("_d"), "_open")
    return order.filter("_o = 2").select("_r.*", (F.col("_open") > 0).alias("_holds"))


def find_orphans(
    refs: DataFrame,
    targets: DataFrame,
    keys: dict[str, str],
    at: str,
    valid_from: str,
    valid_to: str,
    match: str = "partial",
    max_spans: int = MAX_SPANS,
) -> DataFrame:
    """``refs`` plus ``status``, for references to which no target held at ``at``.

    keys: reference column -> target column. status: ``missing`` (no target row
    at all), ``late`` (all begin after ``at``), ``deleted`` (otherwise).
    """
    if match not in ("partial", "simple", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    cols = refs.columns
    out = None
    for mask in product((True, False), repeat=len(keys)):
        present = [r for r, on in zip(keys, mask) if on]
        if not present:
            continue
        cond: Column = F.lit(True)
        for r, on in zip(keys, mask):
            cond = cond & (F.col(r).isNotNull() if on else F.col(r).isNull())
        part = refs.filter(cond)
        if not all(mask) and match == "simple":
            continue
        if not all(mask) and match == "full":
            hit = part.withColumn("status", F.lit("missing"))
        else:
            own = [keys[r] for r in present]
            grouped = targets.groupBy(*own).agg(F.count_distinct(valid_from, F.coalesce(F.col(valid_to), F.col(valid_from))).alias("n"))
            sweep = (grouped.agg(F.max("n")).first()[0] or 0) > max_spans
            spans = target_spans(targets, own, valid_from, valid_to, with_spans=not sweep)
            spans = spans.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(own)], *[c for c in spans.columns if c.startswith("_")])
            spans = broadcast_within(spans)
            if sweep:
                part = _holds_by_sweep(part, targets, [(r, keys[r]) for r in present], at, valid_from, valid_to)
            on = None
            for i, r in enumerate(present):
                c = F.col(r) == F.col(f"_k{i}")
                on = c if on is None else on & c
            t = F.col(at)
            holds = F.col("_holds") if sweep else F.exists("_spans", lambda s: (s["_a"].isNull() | (s["_a"] <= t)) & (s["_b"].isNull() | (s["_b"] > t)))
            status = F.when(F.col("_any").isNull(), "missing").when(t.isNull() | holds, None).when(F.col("_first") > t, "late").otherwise("deleted")
            hit = part.join(spans, on, "left").withColumn("status", status).filter("status is not null").select(*cols, "status")
        out = hit if out is None else out.unionByName(hit)
    return out


def json_string_list(c: Column) -> Column:
    """The strings of a JSON list; null where the text is no valid JSON list.

    ``parse_json`` is the strict judge; entries that are no strings are dropped.
    """
    v = F.try_parse_json(c)
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.from_json(c, "array<string>", {"allowSingleQuotes": "false"}))


def record_references(records: DataFrame) -> DataFrame:
    """(id, field, ref, at, corpus?, work): one row a reference of ``records``.

    A reference repeated in a list counts once; null and empty ones not at all.
    """
    base = records.select("id", "corpus", "work_id", "relation_ids", F.col("ingested_at").alias("at"))
    work = base.filter("work_id <> ''").select(
        "id", F.lit("work_id").alias("field"), F.col("work_id").alias("ref"), "at", "corpus", F.col("work_id").alias("work")
    )
    entries = base.filter("relation_ids is not null and relation_ids not in ('', '[]')").select(
        "id", "at", F.explode(F.array_distinct(json_string_list(F.col("relation_ids")))).alias("ref")
    )
    rel = entries.filter("ref <> ''").select(
        "id",
        F.lit("relation_ids").alias("field"),
        "ref",
        "at",
        F.lit(None).cast("string").alias("corpus"),
        F.substring_index(F.substring_index("ref", ":", 1), "#", 1).alias("work"),
    )
    return work.unionByName(rel)


def orphan_references(records: DataFrame, works: DataFrame) -> DataFrame:
    """(id, field, ref, at, status) of the records' references to works."""
    refs = record_references(records)
    return find_orphans(refs, works, {"corpus": "corpus", "work": "work_id"}, "at", "ingested_at", "deleted_at").select(
        "id", "field", "ref", "at", "status"
    )


def orphan_report(records: DataFrame, works: DataFrame) -> DataFrame:
    """Orphans per field, month of arrival and status."""
    return (
        orphan_references(records, works)
        .groupBy("field", F.date_format("at", "yyyy-MM").alias("month"), "status")
        .agg(F.count("*").alias("n_refs"), F.countDistinct("id").alias("n_records"))
    )
