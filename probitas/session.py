"""Spark session helpers: one place for session defaults, the checkpoint folder and stage writes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


OWNER: ContextVar = ContextVar("owner of staged tables", default=None)  # see probitas.stages


def get_session(master: str | None = None, app: str = "probitas",
                shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with the library's defaults. ``driver_memory`` is the heap of a JVM that is not running yet."""
    builder = SparkSession.builder.appName(app)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read; it must be set there. Under a
    local master, as in tests, a private folder is created once and registered where it is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="probitas-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the checkpoint folder for a written stage table, which the current owner deletes."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/stages/{name}-{uuid.uuid4().hex[:12]}"
    if OWNER.get() is not None:
        OWNER.get().paths.append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, under the checkpoint folder and read it back.

    Cuts the lineage at a stage boundary: a lost executor later re-reads the
    written files instead of recomputing the whole upstream plan. The table belongs to
    the current owner (:mod:`probitas.stages`), if there is one.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system its URI names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``probitas`` importable in Python workers (the ``--py-files`` of a
    submitted job): zip the package once per application and ``addPyFile`` it.
    Needed by operators that run Python on executors (the responder plug point,
    the streaming state function)."""
    import zipfile

    import probitas

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(probitas.__file__))
    fd, path = tempfile.mkstemp(prefix="probitas-pyfiles-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    _SHIPPED.add(sc.applicationId)
