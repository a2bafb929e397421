"""Streaming incremental scoring of arriving samples (Structured Streaming).

Samples of a (unit, criterion, question type) group arrive over time and in any order; the first ``n``
non-empty ones by sample order are scored. State per group is those at most ``n`` (order, answer) pairs, kept
by ``applyInPandasWithState`` and merged chunk by chunk, so a group of any size in one micro-batch is never
held whole. Only groups whose first ``n`` changed are emitted; ``foreachBatch`` appends them with their batch
id, and the latest row per group is the current score: equal to scoring all samples at once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from probitas import rules as R
from probitas.operators.samples import GROUP, drop_empty_responses, label_samples, scores_from_counts
from probitas.session import ship_package

COUNT_FIELDS = ["n_samples", "n_yes", "n_no", "n_undefined"]
STATE_SCHEMA = T.StructType([T.StructField("orders", T.ArrayType(T.LongType())), T.StructField("answers", T.ArrayType(T.StringType()))])


def _out_schema() -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in ("scenario", "model", "unit_key")]
                        + [T.StructField("criterion_id", T.IntegerType()), T.StructField("question_type", T.StringType())]
                        + [T.StructField(c, T.LongType()) for c in COUNT_FIELDS])


def first_n_counter(n: int):
    """State function: keep the first ``n`` samples of the group by sample order and count their answers."""

    def fn(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = list(zip(*state.get)) if state.exists else []
        kept = before
        for part in pdfs:
            kept = heapq.nsmallest(n, [*kept, *zip(part["sample_order"].tolist(), part["answer"].tolist())], key=lambda x: x[0])
        if kept == before:
            return
        state.update(([int(o) for o, _ in kept], [a for _, a in kept]))
        answers = [a for _, a in kept]
        row = dict(zip(GROUP, key))
        row.update(n_samples=len(kept), n_yes=answers.count(R.YES), n_no=answers.count(R.NO), n_undefined=answers.count(R.UNDEFINED))
        yield pd.DataFrame([row])

    return fn


def score_stream(stream: DataFrame, prompts: DataFrame, n: int = R.SAMPLES_PER_QUESTION) -> DataFrame:
    """Streaming scores: drop empty, normalise against the (static) prompt table,
    keep the first ``n`` per group in state, derive the scores from the counts."""
    ship_package(stream.sparkSession)
    labelled = label_samples(drop_empty_responses(stream), prompts)
    counts = (labelled.select(*GROUP, "sample_order", "answer").groupBy(*GROUP)
              .applyInPandasWithState(first_n_counter(n), _out_schema(), STATE_SCHEMA, "update",
                                      GroupStateTimeout.NoTimeout))
    return scores_from_counts(counts, n)


def run_incremental(spark: SparkSession, source_dir: str, schema: T.StructType, prompts: DataFrame,
                    sink_dir: str, checkpoint_dir: str, n: int = R.SAMPLES_PER_QUESTION) -> None:
    """Process every sample file that has arrived in ``source_dir`` (availableNow
    trigger) and append the updated scores to ``sink_dir``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink_dir)

    stream = spark.readStream.schema(schema).parquet(source_dir)
    q = (score_stream(stream, prompts, n).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_scores(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Current score per group: the row of its latest batch."""
    df = spark.read.parquet(sink_dir)
    cols = [c for c in df.columns if c not in GROUP and c != "batch_id"]
    latest = df.groupBy(*GROUP).agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return latest.select(*GROUP, *[F.col(f"s.{c}").alias(c) for c in cols])
