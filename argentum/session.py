"""Spark session defaults and the shared scratch folder that lineage is cut in."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Parameters of a local session; a cluster brings its own.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local[cores] session with the library's settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in LOCAL.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own: dict[str, str] = {}
#: What this process wrote into the shared folder and has not dropped, by session.
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local a temporary folder is
    made, kept for the process and removed at its end. On a cluster each
    executor would write to a disk of its own, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"spark.checkpoint.dir is unset, and {master} shares no local folder")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="argentum-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed by drop(), or when the process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if not _written:
        atexit.register(_sweep)
    _written[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns the reader of it.

    The result survives lost executors and its plan starts at the files, with
    column pruning and pushed filters like any other table.
    """
    path = scratch(df.sparkSession, name)
    with short_plans(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


@contextlib.contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Shortens the texts of plans, which the driver keeps for each execution; those of text expressions may take megabytes."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(*frames: DataFrame | str) -> None:
    """Deletes what cut() wrote for frames that nothing reads any more."""
    for x in frames:
        path = x if isinstance(x, str) else getattr(x, "_scratch", None)
        if path in _written:
            delete(_written.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of any file system that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; a local folder goes with the process
            return
    _written.clear()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of the session, once; needed before any operator that runs Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="argentum-package-")  # read by the driver only, which serves it
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(f"{folder}/argentum_package.zip", "w") as file:
        for source in sorted(root.rglob("*.py")):
            file.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(f"{folder}/argentum_package.zip")
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test or input table of a folder of parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
