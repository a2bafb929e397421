"""Staged tables and their owners.

A table that a step writes under the checkpoint folder belongs to the :class:`Owner` that is current when it is written. An
owner knows the input files its tables were derived from, sees when they change, and deletes its own tables, no
others, when it is released. Registered queries own what they stage: ``release(df)`` frees that once the caller is done with the result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from probitas import session


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """A digest of the names, sizes and times of all files under the given paths; a path that is not there counts as empty."""
    lines = []
    for path in sorted(paths):
        target, fs = _path(spark, path)
        if not fs.exists(target):
            continue
        files = fs.listFiles(target, True)
        while files.hasNext():
            f = files.next()
            lines.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


class Owner:
    """Owns the tables staged while it is current (``with owner:``), until :meth:`release`.

    ``inputs`` are the files or folders that the tables are derived from; :meth:`changed` says whether they differ now from what
    they were when the owner was made. Leaving the ``with`` block does not delete anything, as results are read lazily.
    """

    def __init__(self, spark: SparkSession, name: str, inputs: Iterable[str] = ()):
        self.spark, self.name, self.inputs = spark, name, list(inputs)
        self.fingerprint = fingerprint(spark, self.inputs)
        self.paths: list[str] = []
        self._outer: list = []

    def __enter__(self) -> Owner:
        self._outer.append(session.OWNER.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        session.OWNER.reset(self._outer.pop())

    def changed(self) -> bool:
        return fingerprint(self.spark, self.inputs) != self.fingerprint

    def reads(self, df: DataFrame) -> bool:
        """Whether ``df`` scans a table of this owner."""
        files = df.inputFiles() if self.paths else []
        return any(p.split(":", 1)[-1].lstrip("/") in f for f in files for p in self.paths)

    def release(self) -> None:
        """Delete this owner's tables, also those whose write failed half-way."""
        while self.paths:
            target, fs = _path(self.spark, self.paths[-1])
            fs.delete(target, True)
            self.paths.pop()


def owned(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A query that owns what it stages: its result carries the owner for :func:`release`."""
    @functools.wraps(fn)
    def run(spark: SparkSession, *args, **kwargs) -> DataFrame:  # noqa: ANN002, ANN003
        owner = Owner(spark, fn.__name__)
        try:
            with owner:
                df = fn(spark, *args, **kwargs)
        except BaseException:
            owner.release()
            raise
        df = df.select("*")  # a frame of its own: the same staged table may be the result of several queries
        df.staged_by = owner
        return df
    return run


def release(df: DataFrame) -> None:
    """Delete the tables that the query behind ``df`` has staged. ``df`` and frames made of it cannot be read after that."""
    owner = df.__dict__.get("staged_by")
    if owner is not None:
        owner.release()
