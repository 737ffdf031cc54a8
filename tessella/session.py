"""Session settings, shared scratch space and shipping of this package to executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "tessella", cpus: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "6g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Workers import the modules by name, so that what a module keeps (vocabularies, caches)
    lives as long as the worker and not only as long as one task.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent).as_posix())
    folder = Path(tempfile.mkdtemp(prefix="tessella-"))
    target = folder / f"tessella-{context.applicationId}.zip"
    target.write_bytes(data.getvalue())
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this application, below ``spark.checkpoint.dir``.

    Where no checkpoint folder is set (tests, a single machine) a temporary one is chosen and set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessella-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


def spread(df: DataFrame, below: int = 64 << 20) -> DataFrame:
    """``df`` dealt to all cores if Spark takes it for smaller than ``below`` bytes: for tables of few partitions with much work to a row.

    Larger tables have partitions enough and aren't shuffled.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < below else df


def settle(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here.

    The table outlives any executor. It stays until ``clear_scratch`` or the end of the cluster's folder. ``plain`` is for columns of
    hashes, which neither a dictionary nor compression makes smaller.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "none").option("parquet.enable.dictionary", "false") if plain else df.write.option("compression", "zstd")
    writer.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(*settled: DataFrame) -> None:
    """Delete tables that ``settle`` returned. Nothing still to be computed may read them.

    Spark removes the shuffle files of plans that nobody holds when the driver collects its garbage,
    by itself twice an hour; that is asked for here, so that a long job's disk holds one step's shuffles.
    """
    for df in settled:
        _delete(df.sparkSession, df.settled_at)
    if settled:
        settled[0].sparkSession._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``settle`` wrote in this application."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
