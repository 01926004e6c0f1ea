"""Session, shared-folder and table helpers used by every operator."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}
_SHIPPED: set[str] = set()
_TABLE_FOLDERS: set[str] = set()


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ranksight") -> SparkSession:
    """A local session with the settings the engine is written for (UTC, AQE, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no installation of their own."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(package):  # imported from an archive: it has been shipped already
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ranksight-code-"), "ranksight_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where none is named a temporary folder of this machine is used, but only by a local session; on a cluster other
    machines could not read it, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="ranksight-")
        atexit.register(shutil.rmtree, _LOCAL_FOLDERS[app], ignore_errors=True)
    return _LOCAL_FOLDERS[app]


def table_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; removed when the program ends, or by ``remove_tables``."""
    folder = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if folder not in _TABLE_FOLDERS:
        _TABLE_FOLDERS.add(folder)
        atexit.register(_remove, spark.sparkContext, folder)
    return folder


def _remove(sc: SparkContext, folder: str) -> None:
    """Best effort: a program that is killed leaves its folder, named after the application."""
    with contextlib.suppress(Exception):
        jvm = sc._gateway.jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def remove_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables now; results that have not been written yet can't be read afterwards."""
    _remove(spark.sparkContext, table_dir(spark))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The files survive the loss of executors, unlike cached blocks.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{table_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions as configured, at least one per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (they are counted); beyond, joins choose for themselves.

    For sides that a caller hands in, such as a batch of queries, whose size the planner can't know.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the files it reads have splits for less than half of them, as one small file has; else
    unchanged. Only file sizes are looked at; nothing is run."""
    spark = df.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if 2 * len(files) > cores:
        return df
    sizes = [file_status(spark, f)[0] for f in files]
    most = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    split = min(most, max(4 << 20, sum(sizes) // cores))
    return df.repartition(cores) if 2 * sum(-(-n // split) for n in sizes) <= cores else df


def file_status(spark: SparkSession, uri: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a file."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    return status.getLen(), status.getModificationTime()


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", setting.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]
