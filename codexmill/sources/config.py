"""Configuration of sources: a small JSON file, read strictly on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

FIELDS = ("repo_path", "repository", "source_sha", "evidence_class", "parser_version")


def strict(text: str):
    """The value of a JSON text in which no object repeats a key."""

    def unique(pairs: list) -> dict:
        names = [k for k, _ in pairs]
        twice = sorted({k for k in names if names.count(k) > 1})
        if twice:
            raise ValueError(f"repeated in the configuration: {', '.join(twice)}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def sources_of(spark: SparkSession, text: str) -> DataFrame:
    """(corpus, fields...) of ``{"sources": {corpus: {field: value}}}``; unknown fields and two corpora in one folder are errors."""
    body = strict(text)
    if not isinstance(body, dict) or not isinstance(body.get("sources"), dict):
        raise ValueError("the configuration names no sources")
    seen: dict[str, str] = {}
    rows = []
    for corpus, entry in body["sources"].items():
        unknown = set(entry) - set(FIELDS)
        if unknown:
            raise ValueError(f"{corpus}: unknown fields {sorted(unknown)}")
        folder = entry.get("repo_path")
        if folder and seen.setdefault(folder, corpus) != corpus:
            raise ValueError(f"{corpus} and {seen[folder]} share the folder {folder}")
        rows.append((corpus, *(entry.get(f) for f in FIELDS)))
    used = [f for i, f in enumerate(FIELDS) if any(r[i + 1] is not None for r in rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ("corpus", *FIELDS)))
    return df.select("corpus", *used)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a configuration file."""
    return sources_of(spark, "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))  # one small file
