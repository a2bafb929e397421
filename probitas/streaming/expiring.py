"""Streaming scores whose state expires: groups that have gone quiet cost nothing.

Samples arrive as in :mod:`probitas.streaming.incremental`. Here state has a time to live: a group that gets no sample for
that long loses its state (``transformWithState`` on RocksDB), so what a query holds grows with the groups in work and not with
all groups ever seen. Every change of a group is appended with the (order, answer) pairs it was counted from. What a table of
such rows says of a group is the first ``n`` pairs of their union: the same for any split into batches, for repeated batches, and
for samples that arrive after the state has expired or was lost with its checkpoint. A query with a new checkpoint
starts from the groups of the table that are still short of samples.

Defined cases: (group, sample order) is the key of a sample, and one that arrives twice with the same answer counts once; blank responses are dropped; a table
without rows gives no scores; samples of one order with different answers are taken in the order of the answers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from probitas import rules as R
from probitas.operators.samples import GROUP, drop_empty_responses, label_samples, scores_from_counts, top_k_per_group
from probitas.session import path_exists, ship_package

STATE = "kept"
STATE_SCHEMA = T.StructType([T.StructField("orders", T.ArrayType(T.LongType())), T.StructField("answers", T.ArrayType(T.StringType()))])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Settings of a run: state with a time to live needs RocksDB; expired state is freed by the batches that have data, as batches
# without any would follow each other for ever under a trigger that should end.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def changed_schema() -> T.StructType:
    """Rows of the table of changes: a group and the pairs its score is counted from."""
    return T.StructType([T.StructField(c, T.IntegerType() if c == "criterion_id" else T.StringType()) for c in GROUP] + STATE_SCHEMA.fields)


class FirstSamples(StatefulProcessor):
    """Keeps the first ``n`` samples of a group for ``idle_ms`` after its last change, None: for ever."""

    def __init__(self, n: int, idle_ms: int | None) -> None:
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle) -> None:
        self.kept = handle.getValueState(STATE, STATE_SCHEMA, self.idle_ms)

    def _merge(self, before: list, part: pd.DataFrame) -> list:
        return sorted({*before, *zip((int(o) for o in part["sample_order"]), part["answer"])})[:self.n]

    def _store(self, kept: list) -> None:
        self.kept.update(([o for o, _ in kept], [a for _, a in kept]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.kept.get() if self.kept.exists() else None
        before = [(int(o), a) for o, a in zip(*before)] if before else []
        kept = before
        for part in rows:  # chunk by chunk: a group of any size is never held whole
            kept = self._merge(kept, part)
        if kept != before:
            self._store(kept)
            yield pd.DataFrame([{**dict(zip(GROUP, key)), "orders": [o for o, _ in kept], "answers": [a for _, a in kept]}])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.iloc[0]
        self._store([(int(o), a) for o, a in zip(row["orders"], row["answers"])])

    def close(self) -> None:
        pass


def changed_groups(stream: DataFrame, prompts: DataFrame, n: int = R.SAMPLES_PER_QUESTION, idle_seconds: float | None = None,
                   known: DataFrame | None = None) -> DataFrame:
    """Stream of groups whose first ``n`` samples have changed; ``known`` (one row per group, :func:`current`) is the initial state."""
    ship_package(stream.sparkSession)
    labelled = label_samples(drop_empty_responses(stream), prompts).select(*GROUP, "sample_order", "answer")
    idle_ms = None if idle_seconds is None else max(1, int(idle_seconds * 1000))
    return labelled.groupBy(*GROUP).transformWithStateInPandas(
        FirstSamples(n, idle_ms), changed_schema(), "Update", "ProcessingTime",
        initialState=None if known is None else known.groupBy(*GROUP))


def current(changes: DataFrame, n: int = R.SAMPLES_PER_QUESTION) -> DataFrame:
    """One row per group with the first ``n`` pairs of all its rows. Repeats go before the shuffle, and at most ``n`` pairs of a
    group leave a task."""
    pairs = (changes.select(*GROUP, F.explode(F.arrays_zip("orders", "answers")).alias("p"))
             .select(*GROUP, F.col("p.orders").alias("sample_order"), F.col("p.answers").alias("answer")).distinct())
    first = top_k_per_group(pairs, GROUP, [F.col("sample_order"), F.col("answer")], n)
    listed = first.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("sample_order", "answer"))).alias("p"))
    return listed.select(*GROUP, F.col("p.sample_order").alias("orders"), F.col("p.answer").alias("answers"))


def current_scores(changes: DataFrame, n: int = R.SAMPLES_PER_QUESTION) -> DataFrame:
    """Scores of all groups by the table of changes: equal to scoring all samples at once."""
    def count(answer: str):  # noqa: ANN202
        return F.size(F.filter("answers", lambda a: a == answer)).cast("long")
    counts = current(changes, n).select(
        *GROUP, F.size("answers").cast("long").alias("n_samples"), count(R.YES).alias("n_yes"), count(R.NO).alias("n_no"),
        count(R.UNDEFINED).alias("n_undefined"))
    return scores_from_counts(counts, n)


def read_changes(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The table of changes; no rows where nothing has been written."""
    reader = spark.read.schema(changed_schema())
    return reader.parquet(sink_dir) if path_exists(spark, sink_dir) else spark.createDataFrame([], changed_schema())


def run_expiring(spark: SparkSession, source_dir: str, schema: T.StructType, prompts: DataFrame, sink_dir: str, checkpoint_dir: str,
                 n: int = R.SAMPLES_PER_QUESTION, idle_seconds: float | None = None) -> None:
    """Process all sample files that have arrived in ``source_dir`` and add the changed groups to ``sink_dir``.

    A batch writes a folder of its own, named by checkpoint and batch, so one that is repeated after a failure replaces what it wrote.
    With a new checkpoint the groups of ``sink_dir`` that have fewer than ``n`` samples are the initial state.
    """
    run = hashlib.sha256(checkpoint_dir.encode()).hexdigest()[:16]

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_dir}/run={run}/batch={batch_id}")

    # the state that a checkpoint began with is part of its plan, so a restart names the same kind of table again; it is read in the first batch only
    known = current(read_changes(spark, sink_dir), n).where(F.size("orders") < n)
    stream = spark.readStream.schema(schema).parquet(source_dir)
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (changed_groups(stream, prompts, n, idle_seconds, known).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
