"""Session and table access shared by every query."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of the data folder; only Spark's readers touch the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cores: int = 8, app: str = "photonlake", memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benches; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session
    (tests) gets a temporary one; a cluster must name its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root or root.startswith("<"):
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='photonlake-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where neither PYTHONPATH nor their folder leads to it: it is zipped once a
    context and sent along."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    reachable = [os.path.abspath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    context = spark.sparkContext
    if root in reachable or context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="photonlake-"), "photonlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "photonlake")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


_shipped: set[str] = set()
