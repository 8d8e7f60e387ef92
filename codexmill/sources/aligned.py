"""Aligned texts in several languages (lines, translation memories), and the distinct lexicon of a lemma scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions import text as X
from codexmill.sources.files import FIELDS, read_files


def aligned_lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(source_path, file, work_id, language, line_no, raw_text) of files ``<work>-<language>.txt``."""
    return lines_of(read_files(spark, root, glob))


def lines_of(files: DataFrame) -> DataFrame:
    """The same of (source_path, content)."""
    f = files.withColumnRenamed("source_path", "path")
    name = F.element_at(F.split("path", "/"), -1)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    stem = F.regexp_replace(name, r"\.txt$", "")
    base = f.select(name.alias("file"), F.regexp_extract(stem, r"^(.*)-([^-]*)$", 1).alias("work_id"), F.regexp_extract(stem, r"^(.*)-([^-]*)$", 2).alias("language"), F.posexplode(lines).alias("line_no", "raw_text"))
    return base.withColumn("line_no", F.col("line_no").cast("long"))


def aligned_records(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """Records of aligned lines, with title and source of the catalog (file, title, source) where it has the file."""
    group = F.concat("work_id", F.lit(":line:"), (F.col("line_no") + 1).cast("string"))
    j = lines.withColumn("_g", group).join(catalog.select("file", "title", "source"), "file", "left")
    return j.select(
        "language", "work_id", F.concat("_g", F.lit(":"), "language").alias("segment_id"), "title", "raw_text", F.col("file").alias("source_path"), F.lit("parallel_alignment").alias("evidence_class"),
        F.lit("alignment_text").alias("text_role"), F.col("source").alias("witness"), F.array("_g").alias("relation_ids"), F.col("line_no").alias("sequence_no"),
    )


def alignments(records: DataFrame) -> DataFrame:
    """Edges from the first member of every line group to the others (members in order of language)."""
    g = records.groupBy(F.col("relation_ids")[0].alias("group_id")).agg(F.array_sort(F.collect_list("segment_id")).alias("m"))
    return g.filter(F.size("m") > 1).select(F.lit("line_alignment").alias("relation_type"), F.col("m")[0].alias("from_id"), F.explode(F.slice("m", 2, 1_000)).alias("to_id"), "group_id")


#: A translation memory: units of the same passage in two languages.
MEMORY = "struct<`text-id`:string,tus:array<struct<tibetan:string,english:string,`passage-xmlId`:string,folio:string,creation_method:string>>>"


def translation_memory(files: DataFrame) -> DataFrame:
    """Tagged rows of (source_path, content) of translation memories: of each unit two records and the edge between them.

    Content that is not such JSON gives nothing; a unit without text in a language gives a blank record, which ``split`` drops.
    """
    body = files.select("source_path", F.from_json(F.col("content").cast("string"), MEMORY).alias("b"))
    stem = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    u = body.select("source_path", F.coalesce("b.text-id", stem).alias("work_id"), F.posexplode("b.tus").alias("no", "u"))
    u = u.withColumn("pair", F.concat("work_id", F.lit(":tu:"), (F.col("no") + 1).cast("string"))).withColumn("passage", F.coalesce("u.passage-xmlId", "pair"))
    side = lambda lang: F.concat("pair", F.lit(f":{lang}"))
    text = lambda lang, column: F.struct(
        F.lit("record").alias("kind"), F.lit(lang).alias("language"), side(lang).alias("segment_id"), F.coalesce(column, F.lit("")).alias("raw_text"), F.lit("alignment_text").alias("text_role"),
        F.col("u.creation_method").alias("witness"), F.array("pair", "passage", F.coalesce("u.folio", F.lit(""))).alias("relation_ids"), F.col("no").cast("long").alias("sequence_no"),
        *[F.lit(None).cast("string").alias(c) for c in ("relation_type", "from_id", "to_id", "details_json")],
    )
    about = F.to_json(F.struct(F.col("passage").alias("passage_id"), "u.folio", "u.creation_method"), {"ignoreNullFields": "false"})
    edge = F.struct(
        F.lit("relation").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("language", "segment_id", "raw_text")], F.lit("unspecified").alias("text_role"), F.lit(None).cast("string").alias("witness"),
        F.lit(None).cast("array<string>").alias("relation_ids"), F.lit(None).cast("long").alias("sequence_no"), F.lit("translation_alignment").alias("relation_type"),
        side("bo").alias("from_id"), side("en").alias("to_id"), about.alias("details_json"),
    )
    rows = u.select("source_path", "work_id", "no", F.posexplode(F.array(text("bo", "u.tibetan"), text("en", "u.english"), edge)).alias("part", "r"))
    have = {"work_id": F.when(F.col("r.kind") == "record", F.col("work_id")), "evidence_class": F.lit("parallel_alignment"), "position": (F.col("no") * 3 + F.col("part")).cast("long")}
    inner = ("kind", "language", "segment_id", "raw_text", "text_role", "witness", "relation_ids", "sequence_no", "relation_type", "from_id", "to_id", "details_json")
    have |= {c: F.col(f"r.{c}") for c in inner}
    return rows.select("source_path", *[have.get(c, F.lit(None).cast(kind)).alias(c) for c, kind in FIELDS.items()])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; a byte order mark is passed over."""
    c = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return c.select(*[F.col(f"`{n}`").alias(n.lstrip("﻿")) for n in c.columns])


def lexicon(lemmas: DataFrame) -> DataFrame:
    """Distinct (surface, lemma, pos), normalized; morphology and path of the first; work and segment null."""
    n = lemmas.withColumn("surface", X.normalize("surface")).withColumn("lemma", X.normalize("lemma"))
    g = n.groupBy("surface", "lemma", "pos").agg(F.min_by(F.struct("source_path", "morphology_json"), F.struct("source_path", "morphology_json")).alias("r"))
    return g.select("surface", "lemma", "pos", "r.morphology_json", "r.source_path", F.lit(None).cast("string").alias("work_id"), F.lit(None).cast("string").alias("segment_id"))
