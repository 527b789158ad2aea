"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session as tests and bench use it; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kelpie")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    They may run in folders where it can't be imported; the archive holds sources only.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="kelpie-")) / "kelpie.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; the Parquet footer carries the schema, nothing is inferred."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # every instant here is UTC
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset a temporary folder serves sessions whose executors run on this machine; on a
    cluster that is an error, for executors on other machines couldn't reach it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not (context.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kelpie-"))
    return str(context.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage; a lost executor then costs no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
