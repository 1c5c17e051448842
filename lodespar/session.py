"""One Spark session with the settings that the library is measured with."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def reachable(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers, wherever the driver was started.
    Machines that do not share the package's folder need it installed or sent with ``--py-files``."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan that comes in fewer splits than there are cores, dealt over all of them before heavy
    per-row work. Larger scans stay as they are, without a shuffle."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan.rdd.getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores)


def session(name: str = "lodespar", **settings: str) -> SparkSession:
    """The session of this process, made if there is none. ``settings`` have ``_`` for ``.``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return reachable(builder.getOrCreate())


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the folder that the cluster names in ``spark.checkpoint.dir``. Only a local session may do without
    that setting, in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        base = f"file://{tempfile.mkdtemp(prefix='lodespar-')}"
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodespar/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once and written to the shared folder, so that no lost executor takes it along."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reset() -> None:
    """Stop it, so that the next call starts anew."""
    active = SparkSession.getActiveSession()
    if active is not None:
        active.stop()
