"""Session helpers: where lineage is cut, and how."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIR: str | None = None


def local_session(cores: int | str = 8, app: str = "lineweave", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark. A cluster job brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    A machine-local folder is only used when Spark itself runs on one machine."""
    global _LOCAL_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="lineweave-")
    return _LOCAL_DIR


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The iterative operators call this once per round. The written table survives the loss of any
    executor, ends the lineage, and gives the next round true sizes to plan with."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that is dealt out by key and never sent whole through the driver.

    Spark judges a table by the bytes of its files. It does not see what explode adds (a dilation makes hundreds of pixels
    of one, a derived line sixty) nor what packed columns take once unpacked, so it broadcasts such tables far too large."""
    return df.hint("merge")


def is_empty(df: DataFrame) -> bool:
    return df.select(F.lit(1)).limit(1).count() == 0


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
