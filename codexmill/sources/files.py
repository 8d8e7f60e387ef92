"""Reading source files in parallel: one task parses many files, each file once.

A parser is a plain function (relative path, bytes) -> rows; a row is a dict with
``kind`` (record, work, relation, variant, lemma) and the columns of that table.
``scan`` runs it over all files of a glob and gives one tagged DataFrame, from which
``split`` takes the tables. Files that cannot be parsed are skipped or fail as the
format demands. Inside a file, ``position`` keeps the order of rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as X
from codexmill.operators import tables as T

Parser = Callable[[str, bytes], Iterable[dict]]

FIELDS = {
    "kind": "string", "position": "long", "language": "string", "collection_name": "string", "work_id": "string", "segment_id": "string", "title": "string", "raw_text": "string",
    "lemma_text": "string", "evidence_class": "string", "text_role": "string", "witness": "string", "relation_ids": "array<string>", "sequence_no": "long",
    "relation_type": "string", "from_id": "string", "to_id": "string", "details_json": "string", "lemma": "string", "reading": "string", "witnesses": "string", "variant_type": "string",
    "confidence": "double", "notes": "string", "surface": "string", "pos": "string", "morphology_json": "string", "metadata_json": "string",
}
SCHEMA = "source_path string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items())

TABLES = {
    "record": ["language", "collection_name", "work_id", "segment_id", "title", "raw_text", "lemma_text", "source_path", "source_sha", "evidence_class", "text_role", "witness", "relation_ids", "sequence_no"],
    "work": ["work_id", "language", "collection_name", "title", "metadata_json", "source_path", "source_sha", "evidence_class"],
    "relation": ["relation_type", "from_id", "to_id", "source_path", "details_json", "source_sha", "evidence_class"],
    "variant": ["work_id", "segment_id", "lemma", "reading", "witnesses", "variant_type", "confidence", "notes", "source_path", "source_sha", "evidence_class"],
    "lemma": ["language", "work_id", "segment_id", "surface", "lemma", "pos", "morphology_json", "source_path", "source_sha", "evidence_class"],
}


def scan(spark: SparkSession, root: str, glob: str, parser: Parser) -> DataFrame:
    """Tagged rows of all files below ``root`` that match ``glob`` (relative, may be nested)."""
    return parse(read_files(spark, root, glob), parser)


def read_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_path, content) of the files below ``root`` that match ``glob``; paths are relative to it."""
    base = root.rstrip("/")
    mark = base.split("://")[-1] + "/"
    files = spark.read.format("binaryFile").load(f"{base}/{glob}")
    return files.select(F.element_at(F.split("path", re.escape(mark), 2), -1).alias("source_path"), "content")


def parse(files: DataFrame, parser: Parser) -> DataFrame:
    """Tagged rows of (source_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for rel, content in zip(b["source_path"], b["content"]):
                rows = [{"text_role": "unspecified", **r, "position": i, "source_path": rel} for i, r in enumerate(parser(rel, bytes(content)))]
                if rows:
                    cols = {c: [r.get(c) for r in rows] for c in ("source_path", *FIELDS)}
                    # Python objects in every column: extension types may come chunked, which the writer refuses.
                    yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in cols.items()})

    return files.select("source_path", "content").mapInPandas(run, SCHEMA)


def split(rows: DataFrame, corpus: str, source_sha: str) -> dict[str, DataFrame]:
    """The tables of a tagged DataFrame: keys are unique, texts have their stored forms, blank records are gone."""
    rows = rows.withColumn("source_sha", F.lit(source_sha)).withColumn("corpus", F.lit(corpus))
    order = ["source_path", "position"]
    one = lambda k: rows.filter(F.col("kind") == k).select("corpus", *TABLES[k], "position")
    rec = T.drop_blank(one("record").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>"))).withColumn("sequence_no", F.coalesce("sequence_no", F.lit(0))))
    rec = rec.withColumn("lemma_text", X.normalize(F.coalesce("lemma_text", F.lit(""))))
    rec = X.stored_forms(T.insert_or_ignore(rec, T.RECORD_KEY, order)).drop("position")
    return {
        "records": rec,
        "works": T.upsert(one("work"), T.WORK_KEY, order).drop("position"),
        "relations": T.insert_or_ignore(one("relation"), T.RELATION_KEY, order).drop("position"),
        "variants": one("variant").drop("position"),
        "lemmas": one("lemma").drop("position"),
    }
