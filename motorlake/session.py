"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", shuffle_partitions: int = 8, memory: str = "8g", app: str = "motorlake") -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_motorlake_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="motorlake-code-")
    tree = Path(folder, "tree", package.name)
    shutil.copytree(package, tree, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/motorlake", "zip", tree.parent))
    context._motorlake_shipped = True


#: HotSpot leaves methods of more bytes uncompiled; Spark by itself writes stages as one method of up to eight times as many.
LARGEST_METHOD = 8000
LIMIT = "spark.sql.codegen.hugeMethodLimit"


def limit_methods(spark: SparkSession, limited: bool) -> None:
    """Whether stages whose code HotSpot wouldn't compile, such as those with taxes, run operator by operator instead."""
    context = spark.sparkContext
    if limited and spark.conf.get(LIMIT) == "65535":
        spark.conf.set(LIMIT, LARGEST_METHOD)
        context._motorlake_limited = True
    elif not limited and getattr(context, "_motorlake_limited", False):
        spark.conf.unset(LIMIT)
        context._motorlake_limited = False


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors see, ``spark.checkpoint.dir``.

    Where the session has none, a temporary folder is made and set, on local masters only.
    """
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="motorlake-"))
        known = context.getCheckpointDir()
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write to the shared folder, with ``options`` of the writer, and read back: computed once, and its rows outlive executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
