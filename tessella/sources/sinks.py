"""Writers: tables by city, appended CSV, predictions with fixed decimals and a number of kept versions, weights of a fitted net."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by(df: DataFrame, path: str, by: list[str]) -> None:
    """A stage's table, a folder for each city, so that later stages read only the cities they need."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    """More rows to a CSV table; each file has its header line, which readers of the folder skip."""
    df.write.mode("append").csv(path, header=True)


def fixed_decimals(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns as text with so many decimals; null and NaN are empty."""
    text = lambda n: F.when(F.col(n).isNotNull() & ~F.isnan(n), F.format_string(f"%.{digits}f", F.col(n).cast("double")))
    return df.select(*[text(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def write_predictions(df: DataFrame, folder: str, stamp: str, keep: int = 5) -> str:
    """A version of predictions below ``folder``; of all versions the ``keep`` last by stamp stay."""
    spark = df.sparkSession
    path = f"{folder}/predictions-{stamp}"
    fixed_decimals(df).write.mode("overwrite").csv(path, header=True)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted((s.getPath().getName(), s.getPath()) for s in files.listStatus(root) if s.getPath().getName().startswith("predictions-"))
    for _, old in versions[: max(0, len(versions) - keep)]:
        files.delete(old, True)
    return path


def save_weights(spark: SparkSession, layers: list[dict], path: str, **state) -> None:
    """A net's layers and a training state (epoch, seed ...) as one small file."""
    arrays = {f"{n}_{i}": np.asarray(v) for i, layer in enumerate(layers) for n, v in layer.items()}
    data = io.BytesIO()
    np.savez(data, **arrays, **{f"state_{k}": np.asarray(v) for k, v in state.items()})
    row = spark.createDataFrame([(uuid.uuid4().hex, bytearray(data.getvalue()))], "id string, data binary")
    row.coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> tuple[list[dict], dict]:
    """The layers and state that ``save_weights`` wrote."""
    stored = np.load(io.BytesIO(bytes(spark.read.parquet(path).first()["data"])))
    state = {k[6:]: stored[k].item() for k in stored.files if k.startswith("state_")}
    numbers = sorted({int(k.rsplit("_", 1)[1]) for k in stored.files if not k.startswith("state_")})
    layers = [{n: stored[f"{n}_{i}"] for n in ("weight", "bias", "dilation", "scale", "shift") if f"{n}_{i}" in stored.files} for i in numbers]
    return [layer | {"dilation": int(layer["dilation"])} for layer in layers], state
