"""Session helpers: table reads and the shared folder for materialised intermediates."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "leafmill", cores: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session to every operator."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of a session, once; they need not have it installed or on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="leafmill-")) / "leafmill.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(at))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where the setting is absent and all tasks run on this machine, a temporary folder is chosen.  On a cluster each
    executor would write to a disk of its own and what is read back would be incomplete, so there its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    local = getattr(shared_dir, "_local", None)
    if local is None:
        local = shared_dir._local = "file://" + tempfile.mkdtemp(prefix="leafmill-")
    return local


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete what :func:`materialise` has written so far; to be called when the results have been consumed.  Returns the
    number of folders."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table used more than once to the shared folder and read it back.

    The lineage is cut by files every executor can read, so a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
