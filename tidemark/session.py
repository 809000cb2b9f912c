"""Session set-up, table loading and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with AQE, UTC and Arrow; the cluster's own settings win where they are given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}  # folders made here, by application, where the cluster names none


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one made here where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        app = spark.sparkContext.applicationId
        base = _own.get(app) or _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='tidemark-')}")
    return base.rstrip("/")


def landed(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text in an Arrow batch to a Python worker; the default of 10,000 holds tens of megabytes on either side.
ARROW_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers: bounded batches, and this package importable on workers that do not inherit
    the driver's search path."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(ROOT) in paths or os.path.realpath(os.getcwd()) == str(ROOT) or os.path.exists(os.path.join(os.getcwd(), "tidemark", "session.py")):
        return
    sc = spark.sparkContext
    if any("tidemark-src" in p for p in sc._python_includes):
        return
    target = Path(tempfile.mkdtemp()) / "tidemark-src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
