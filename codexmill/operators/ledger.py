"""Relations between items that cite, replace and declare one another, as set operations.

Each operator gives one row an item with what is wrong with it; nothing is decided
by walking from item to item.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def supersession(items: DataFrame, key: str = "id", replaces: str = "supersedes", order: str = "at") -> DataFrame:
    """(key, status, problem) of an append-only list of items, some of which replace an earlier one.

    problem: ``missing`` (nothing of that key), ``not earlier`` (the replaced item is no
    older, or is the item itself), ``branch`` (another item replaced it first); such
    items replace nothing. status: ``superseded`` or ``active``. Of several that replace
    one, the first by order and key does. Items with a null key or order are problems of their own.
    """
    i = items.select(F.col(key).alias("_k"), F.col(replaces).alias("_r"), F.col(order).alias("_o"))
    old = i.select(F.col("_k").alias("_ok"), F.col("_o").alias("_oo")).dropDuplicates(["_ok"])
    j = i.join(old, F.col("_r") == F.col("_ok"), "left")
    why = F.when(F.col("_k").isNull() | F.col("_o").isNull(), "unordered").when(F.col("_r").isNull(), None).when(F.col("_ok").isNull(), "missing").when(~(F.coalesce(F.col("_oo") < F.col("_o"), F.lit(False))), "not earlier")
    j = j.withColumn("problem", why)
    first = j.filter("_r is not null and problem is null").groupBy("_r").agg(F.min(F.struct("_o", "_k")).alias("first")).select(F.col("_r").alias("_fr"), "first")
    j = j.join(first, F.col("_r") == F.col("_fr"), "left").withColumn("problem", F.when(F.col("problem").isNull() & F.col("_r").isNotNull() & (F.struct("_o", "_k") != F.col("first")), "branch").otherwise(F.col("problem")))
    gone = first.select(F.col("_fr").alias("_gone"))
    j = j.join(gone, F.col("_k") == F.col("_gone"), "left")
    return j.select(F.col("_k").alias(key), F.when(F.col("_gone").isNotNull(), "superseded").otherwise("active").alias("status"), "problem")


def citations(items: DataFrame, cited: DataFrame, key: str = "id", ids: str = "ids", cited_key: str = "id") -> DataFrame:
    """(key, n_cited, n_found, missing, complete): whether all that an item cites is there.

    ids: array of keys, each of which counts once; nulls in it don't. An item that cites nothing is complete.
    """
    there = cited.select(F.col(cited_key).alias("_c")).filter("_c is not null").distinct().withColumn("_t", F.lit(True))
    e = items.select(F.col(key).alias("_k"), F.explode_outer(F.array_distinct(ids)).alias("_c")).join(there, "_c", "left")
    has = F.col("_c").isNotNull()
    g = e.groupBy("_k").agg(F.count_if(has).alias("n_cited"), F.count_if(F.col("_t").isNotNull()).alias("n_found"), F.sort_array(F.collect_set(F.when(has & F.col("_t").isNull(), F.col("_c")))).alias("missing"))
    return g.select(F.col("_k").alias(key), "n_cited", "n_found", "missing", (F.size("missing") == 0).alias("complete"))


def declared_sources(declared: DataFrame, records: DataFrame, on: tuple[str, ...] = ("corpus", "work_id")) -> DataFrame:
    """(on..., n_files, source_path, status) of declared works: ``found`` in one file, ``ambiguous`` in several, ``missing``."""
    files = records.groupBy(*on).agg(F.count_distinct("source_path").alias("n_files"), F.min("source_path").alias("_p"))
    j = declared.select(*on).distinct().join(files, list(on), "left")
    n = F.coalesce("n_files", F.lit(0))
    return j.select(*on, n.alias("n_files"), F.when(n == 1, F.col("_p")).alias("source_path"), F.when(n == 0, "missing").when(n == 1, "found").otherwise("ambiguous").alias("status"))


def with_category(rows: DataFrame, categories: DataFrame, on: tuple[str, ...] = ("query_kind", "key")) -> DataFrame:
    """rows with the category of their key; keys without one are left out."""
    return rows.join(categories.select(*on, "category"), list(on))


def valid_list(c: Column, max_items: int, max_chars: int) -> Column:
    """Whether an array holds only distinct strings that are neither blank nor too long, and not too many; null is none."""
    ok = F.forall(c, lambda x: F.coalesce((F.btrim(x) != "") & (F.length(x) <= max_chars), F.lit(False)))
    return F.coalesce(ok & (F.size(c) <= max_items) & (F.size(F.array_distinct(c)) == F.size(c)), F.lit(False))


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """One text for equal JSON values: keys in order, no blanks; 1, 1.0 and true stay apart. Null for what is no JSON or repeats a key."""

    def unique(pairs: list) -> dict:
        if len(dict(pairs)) != len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(json.loads(t, object_pairs_hook=unique), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return pd.Series([one(t) for t in s], dtype=object)
