"""Session helpers: reading the tables, cutting lineage, sizing partitions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for: UTC, adaptive execution, skew joins."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once a session; they need not have the repository in their path."""
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":  # not itself run from a shipped archive
        to = Path(tempfile.mkdtemp(prefix="quire-")) / "quire_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(to))
    sc._quire_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder of ``spark.checkpoint.dir`` that all executors share.

    Only on a local master, where that setting is missing (tests, a laptop), is a temporary folder used; elsewhere it would be a
    folder of one machine, so the setting is asked for.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir", "") and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
