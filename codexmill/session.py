"""Session helpers: builder, table loading, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    b = (
        SparkSession.builder.master(master)
        .appName("codexmill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Gives the executors this package, once a SparkContext; their Python need not have it installed."""
    sc = spark.sparkContext
    if not getattr(sc, "_codexmill_shipped", False):
        root = Path(__file__).resolve().parent
        tmp = Path(tempfile.mkdtemp(prefix="codexmill-"))  # on the driver, which serves the file to the executors
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        shutil.copytree(root, tmp / "src" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(str(tmp / root.name), "zip", tmp / "src"))
        sc._codexmill_shipped = True
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """``df`` in a few parts a core, if it comes in fewer splits than there are cores: a small table of one row group would be one task's work.

    A table that fills the cluster is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks_per_core * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset and runs in one process (tests), a temporary
    folder is chosen and set for the session; on a cluster that is an error, as a
    folder of one machine is none that executors share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("codexmill.shared.dir", None)
        if not d:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = "file://" + tempfile.mkdtemp(prefix="codexmill-")
            spark.conf.set("codexmill.shared.dir", d)
    return d.rstrip("/")


def spool(df: DataFrame, tag: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` as a table into the shared folder and read it back.

    A written table is computed once and survives the loss of executors. It is deleted
    by ``sweep``, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codexmill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    until_exit(spark, path)
    _SPOOLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def until_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that is there deleted when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


#: Tables that this process has written to the shared folder.
_SPOOLED: list[str] = []


def sweep(spark: SparkSession) -> int:
    """Deletes the tables spooled so far; call it once the results that read them are written."""
    n = 0
    while _SPOOLED:
        n += drop(spark, _SPOOLED.pop())
    return n


#: Bytes of a side that may be broadcast, counted as JSON text.
BROADCAST_BYTES = 16_000_000


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES, spooled: bool = False) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to be no larger than ``max_bytes``, else as it is, so that the join shuffles.

    The side is computed once: it is spooled before it is measured, unless it is ``spooled`` already.
    """
    df = df if spooled else spool(df, "side")
    return F.broadcast(df) if json_bytes(df) <= max_bytes else df


def json_bytes(df: DataFrame) -> int:
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    return df.agg(F.sum(row).alias("n")).first().n or 0


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; a store that fails to answer is an error, not an absence."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def drop(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; false if there was none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, path: str, write, force: bool = False) -> None:
    """Writes a folder beside ``path`` with ``write(stage)`` and puts it in its place, the former content until then untouched.

    A folder that holds something and was not published this way (it lacks the mark) is refused unless forced.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(conf)
    if fs.exists(at(path)) and not force and not fs.exists(at(f"{path}/{MARK}")) and len(fs.listStatus(at(path))):
        raise ValueError(f"{path} holds something that was not published here")
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        write(stage)
        fs.create(at(f"{stage}/{MARK}")).close()
        if fs.exists(at(path)):
            fs.rename(at(path), at(old))
        if not fs.rename(at(stage), at(path)):
            if fs.exists(at(old)):
                fs.rename(at(old), at(path))
            raise OSError(f"{path} could not be put in place")
    finally:
        for leftover in (stage, old):
            fs.delete(at(leftover), True)


#: Name of the file that marks a published folder; readers of tables pass names with an underscore by.
MARK = "_PUBLISHED"
