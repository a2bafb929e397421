"""Stored tables that can be upserted: touched partitions are written anew, then one rename switches to them.

A store is a folder. Every change writes the partitions that it touches under a run folder of its own
(``run=<id>/<partition>=<value>/...``) and then a version file: the columns and the partition folders that make up the
table. The version file appears under its name by a rename, so readers see the state before or the state after, never a mixture; a run that
fails half-way leaves the table as it was and some files that :func:`vacuum` removes. Two changes made at once from the same
version cannot both win: the second finds its version taken and fails.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas.session import path_exists

RUN = "run"                # folder column of a change; not part of the table
VERSIONS = "_versions"
NULL = "__HIVE_DEFAULT_PARTITION__"  # folder name of a null partition value


class ConcurrentChange(RuntimeError):
    """Another change of the store was finished first; read again and repeat."""


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, root: str) -> int:
    """Number of the newest version; 0 for a store that does not exist yet."""
    if not path_exists(spark, f"{root}/{VERSIONS}"):
        return 0
    target, fs = _fs(spark, f"{root}/{VERSIONS}")
    return max([int(s.getPath().getName()) for s in fs.listStatus(target) if s.getPath().getName().isdigit()], default=0)


def _version(spark: SparkSession, root: str, version: int) -> tuple[T.StructType | None, list[str]]:
    """Columns and partition folders of a version: a line for the schema and one for each partition."""
    if not version:
        return None, []
    lines = [r["value"] for r in spark.read.text(f"{root}/{VERSIONS}/{version}").collect()]
    schema = next(x for x in lines if x.startswith("{"))
    return T.StructType.fromJson(json.loads(schema)), sorted(x for x in lines if x and not x.startswith("{"))


def _publish(spark: SparkSession, root: str, version: int, schema: T.StructType, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    written, fs = _fs(spark, f"{root}/{VERSIONS}/_{uuid.uuid4().hex}")
    fs.mkdirs(written.getParent())
    out = fs.create(written)
    try:
        out.write(bytearray(("\n".join([schema.json(), *folders]) + "\n").encode()))
    finally:
        out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{VERSIONS}/{version}")
    if fs.exists(target) or not fs.rename(written, target):
        fs.delete(written, False)
        raise ConcurrentChange(f"version {version} of {root} exists already")


def _partition(folder: str) -> list[tuple[str, str | None]]:
    """Column and value of each level of a partition folder, unescaped."""
    levels = [part.split("=", 1) for part in folder.split("/")[1:]]
    return [(unquote(name), None if value == NULL else unquote(value)) for name, value in levels]


def _holding(folders: list[str], schema: T.StructType, only: DataFrame) -> list[str]:
    """The folders of partitions that ``only`` has rows of, found by one job that returns a row per folder at most."""
    names = [name for name, _ in _partition(folders[0])]
    by_values: dict = {}
    for folder in folders:
        by_values.setdefault(tuple(value for _, value in _partition(folder)), []).append(folder)
    held = only.sparkSession.createDataFrame(list(by_values), T.StructType([T.StructField(c, T.StringType()) for c in names]))
    text = lambda c: F.col(f"`{c}`").cast(schema[c].dataType).cast("string")
    asked = only.select([F.when(text(c) != "", text(c)).alias(c) for c in names]).distinct()
    hit = held.join(asked, [held[c].eqNullSafe(asked[c]) for c in names], "left_semi").collect()
    return sorted(f for r in hit for f in by_values[tuple(r)])


def read_store(spark: SparkSession, root: str, version: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The table as of its latest version, or of an older one that has not been vacuumed.

    With ``only``, rows that have the partition columns, the partitions without any of its rows are left out: their
    files are neither listed nor opened. Which ones stay is found by a job when this is called.
    """
    schema, folders = _version(spark, root, version or latest_version(spark, root))
    if schema is None:
        raise FileNotFoundError(f"no stored table at {root}")
    if only is not None:
        folders = _holding(folders, schema, only)
        if not folders:
            return spark.createDataFrame([], schema)
    table = spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{f}" for f in folders])
    return table.select(*[f"`{c}`" for c in schema.names])


def lookup(spark: SparkSession, root: str, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose ``keys`` are among those of ``wanted``, read from the partitions that ``wanted`` has rows of.

    ``keys`` hold the partition columns. Null keys equal each other; repeated rows of ``wanted`` do not repeat the result.
    """
    stored, asked = read_store(spark, root, only=wanted), wanted.select(*keys).distinct()
    return stored.join(asked, [stored[c].eqNullSafe(asked[c]) for c in keys], "left_semi")


def store_exists(spark: SparkSession, root: str) -> bool:
    return latest_version(spark, root) > 0


def upsert(updates: DataFrame, root: str, keys: list[str], partition_by: list[str], insert_only: bool = False) -> list[str]:
    """Replace the stored rows whose key is in ``updates`` and add the others; returns the partitions written anew.

    Only partitions that ``updates`` has rows of are read and written. With ``insert_only`` stored rows stay and only
    absent keys are added. The partition columns belong to the key, a repeated key in ``updates`` is an error (which of
    its rows should stay is not known), and updates without a row change nothing. Null keys equal each other; an empty
    string in a partition column is stored as null. The columns are those of the first change.
    """
    spark = updates.sparkSession
    if not set(partition_by) <= set(keys):
        raise ValueError("the partition columns must be part of the key")
    if updates.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"updates hold several rows for one key of {keys}")
    version = latest_version(spark, root)
    schema, before = _version(spark, root, version)
    same = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    merged = updates
    if schema is not None:
        new = updates.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        old = read_store(spark, root, version, only=new)
        if insert_only:
            merged = old.unionByName(new.join(old, same(new, old, keys), "left_anti"))
        else:
            merged = old.join(new, same(old, new, keys), "left_anti").unionByName(new)
    return _write(merged, root, partition_by, version, schema, before, replace=True)


def append(rows: DataFrame, root: str, partition_by: list[str]) -> list[str]:
    """Add rows by the same switch, all or none; the caller sees to it that their keys are new. Nothing stored is read."""
    version = latest_version(rows.sparkSession, root)
    schema, before = _version(rows.sparkSession, root, version)
    if schema is not None:
        rows = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return _write(rows, root, partition_by, version, schema, before, replace=False)


def _write(df: DataFrame, root: str, partition_by: list[str], version: int, schema: T.StructType | None, before: list[str],
           replace: bool) -> list[str]:
    """Write a run and switch to it; the partitions written."""
    spark, run = df.sparkSession, f"{RUN}={uuid.uuid4().hex[:16]}"
    df.write.partitionBy(*partition_by).parquet(f"{root}/{run}")
    written = _leaves(spark, f"{root}/{run}", len(partition_by))
    if written:
        rest = [f for f in before if not replace or f.split("/", 1)[1] not in written]
        _publish(spark, root, version + 1, schema or df.schema, sorted([*rest, *(f"{run}/{p}" for p in written)]))
    return sorted(written)


def _leaves(spark: SparkSession, run: str, depth: int) -> set[str]:
    """The partition folders of a run, without the run's own name."""
    target, fs = _fs(spark, run)
    found = {""}
    for _ in range(depth):
        found = {f"{f}/{s.getPath().getName()}".lstrip("/") for f in found
                 for s in fs.listStatus(_fs(spark, f"{run}/{f}" if f else run)[0]) if s.isDirectory() and "=" in s.getPath().getName()}
    return found - {""}


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete older versions, what they alone used, and what failed runs have left; returns the number of run folders deleted.

    For a time without readers of older versions and without running changes.
    """
    version = latest_version(spark, root)
    kept = set(_version(spark, root, version)[1])
    runs = {f.split("/", 1)[0] for f in kept}
    target, fs = _fs(spark, root)
    gone = 0
    for s in fs.listStatus(target):
        name = s.getPath().getName()
        if name.startswith(f"{RUN}=") and name not in runs:
            gone += bool(fs.delete(s.getPath(), True))
        elif name in runs:
            depth = next(f for f in kept if f.startswith(name + "/")).count("/")
            for leaf in _leaves(spark, f"{root}/{name}", depth) - {f.split("/", 1)[1] for f in kept if f.startswith(name + "/")}:
                fs.delete(_fs(spark, f"{root}/{name}/{leaf}")[0], True)
    if version:
        for s in fs.listStatus(_fs(spark, f"{root}/{VERSIONS}")[0]):
            if s.getPath().getName() != str(version):
                fs.delete(s.getPath(), False)
    return gone
