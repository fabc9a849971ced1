"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", app: str = "triplane", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def use_checkpoints(spark: SparkSession) -> None:
    """Make DataFrame.checkpoint() usable.

    The folder is the one named in spark.checkpoint.dir, which all executors share. Only a local
    session without that setting gets a temporary folder of its own; a cluster without it is refused,
    as a machine-local folder would lose the data with the machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="triplane-checkpoint-")
    context.setCheckpointDir(shared)


def key128(column) -> list:
    """Two independent 64-bit hashes of a value: a narrow stand-in for a long text in shuffles.

    The second hash is of the value with a salt byte in front, so both collide for two different
    texts with probability 2**-128.
    """
    return [F.xxhash64(column), F.xxhash64(F.lit("\u0001"), column)]


def numbers_frame(spark: SparkSession, **columns: list[int]) -> DataFrame:
    """A small DataFrame of BIGINT columns that the optimizer sees as literal rows, so no job and no Python worker makes it."""
    import pyarrow as pa

    return spark.createDataFrame(pa.table({k: pa.array(v, pa.int64()) for k, v in columns.items()}))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application, so that it need not be installed on executors."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="triplane-")) / f"{here.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
