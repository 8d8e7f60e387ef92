"""Streaming ingest: new files of raw rows become stored records, exactly once a file.

An extension beyond batch builds: the same operators run on every micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codexmill.functions import text as X
from codexmill.operators import tables as T
from codexmill.session import exists


def read_rows(spark: SparkSession, path: str, schema: str, fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """A stream of new files below ``path``."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)


def ingest_records(rows: DataFrame, out: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Appends rows (corpus, source_path, segment_id, language, witness, raw_text, ...) with their stored forms.

    First wins within a batch and against what is stored; rows with a null in the key
    never conflict. A batch replaces its own output, so a replay writes nothing twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = T.insert_or_ignore(T.drop_blank(batch), T.RECORD_KEY, order)
        if exists(spark, out):
            old = spark.read.parquet(out).filter(F.col("batch") != number).select(*T.RECORD_KEY).distinct()
            new = new.join(old, T.RECORD_KEY, "left_anti")
        X.stored_forms(new).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(rows: DataFrame, at: str, window: str = "1 day", late: str = "28 days") -> DataFrame:
    """Rows a window of event time and corpus; rows later than the watermark are passed over."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), "corpus").agg(F.count("*").alias("n"), F.approx_count_distinct("source_path").alias("n_files"))
