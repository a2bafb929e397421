"""Questions asked by concurrent calls inside tasks: one job however often and however late a responder answers.

Every task keeps its share of the calls that an executor may make at a time in flight. A question starts with as many calls
as it needs replies, and each empty reply is followed by one more call, so the attempts are those that asking in rounds makes
(:func:`probitas.operators.samples.collect_samples`). A call that raises is made again after a pause.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probitas import rules as R
from probitas.functions.text import WHITESPACE
from probitas.operators import samples as SM
from probitas.session import materialize, ship_package
from probitas.sources import store as ST

Call = Callable[[dict], "str | None"]  # one question (its row and the number of the attempt) to one reply

REPLY_FIELDS = [T.StructField("sample_order", T.IntegerType()), T.StructField("response", T.StringType()),
                T.StructField("n_tries", T.IntegerType()), T.StructField("error", T.StringType())]


def calls_per_task(spark: SparkSession, per_executor: int) -> int:
    """The share of a task in the calls of its executor. Where the size of executors is not set, one executor is taken to have
    all cores, so that the limit holds. A task makes at least one call at a time."""
    conf = spark.sparkContext.getConf()
    cores = int(conf.get("spark.executor.cores", "0")) or spark.sparkContext.defaultParallelism
    return max(1, per_executor * int(conf.get("spark.task.cpus", "1")) // cores)


def _try(call: Call, question: dict, retries: int, pause: float) -> tuple[str | None, int, str | None]:
    """Reply, number of tries, and the last error where no try succeeded."""
    for k in range(retries + 1):
        try:
            reply = call(question)
            return (None if reply is None else str(reply)), k + 1, None
        except Exception as e:  # a responder's own error: reported with the attempt
            error = f"{type(e).__name__}: {e}"
            if k < retries:
                time.sleep(pause * 2 ** k)
    return None, retries + 1, error


def _ask_batch(rows: list[dict], pool: ThreadPoolExecutor, call: Call, n: int, in_flight: int, retries: int, pause: float) -> Iterator[tuple]:
    """(row number, attempt, reply, tries, error) of every attempt, in the order in which they end."""
    have, asked = [r.pop("_have") for r in rows], [r.pop("_asked") for r in rows]
    most = [r.pop("_most") for r in rows]
    waiting = iter([(i, k) for i in range(len(rows)) for k in range(asked[i] + 1, min(asked[i] + n - have[i], most[i]) + 1)])
    asked = [min(a + n - h, m) for a, h, m in zip(asked, have, most)]
    again: list[tuple[int, int]] = []
    running: dict = {}
    while True:
        while len(running) < in_flight:
            nxt = again.pop() if again else next(waiting, None)
            if nxt is None:
                break
            i, k = nxt
            running[pool.submit(_try, call, {**rows[i], "sample_order": k}, retries, pause)] = nxt
        if not running:
            return
        for done in wait(running, return_when=FIRST_COMPLETED).done:
            i, k = running.pop(done)
            reply, tries, error = done.result()
            if (reply is None or not reply.strip(WHITESPACE)) and asked[i] < most[i]:
                asked[i] += 1
                again.append((i, asked[i]))
            yield i, k, reply, tries, error


def asker(call: Call, n: int, in_flight: int, retries: int, pause: float, chunk: int = 1_000):  # noqa: ANN201
    """The function for ``mapInPandas``: open questions in, their attempts out, at most ``chunk`` rows at a time."""
    def ask(batches):
        import pandas as pd
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
                out: list[dict] = []
                for i, k, reply, tries, error in _ask_batch(rows, pool, call, n, in_flight, retries, pause):
                    out.append({**rows[i], "sample_order": k, "response": reply, "n_tries": tries, "error": error})
                    if len(out) == chunk:
                        yield pd.DataFrame(out)
                        out = []
                if out:
                    yield pd.DataFrame(out)
    return ask


def collect_by_calls(prompts: DataFrame, call: Call, n: int = R.SAMPLES_PER_QUESTION, max_attempts: int = 10 * R.SAMPLES_PER_QUESTION,
                     per_executor: int = 32, retries: int = 3, pause: float = 1.0, ledger: str | None = None, jobs: int = 1,
                     report: dict | None = None) -> DataFrame:
    """Ask until every question has ``n`` non-empty replies; the result is that of ``collect_samples``.

    ``call`` gets one question as a dict and returns its reply; it runs in up to ``per_executor`` threads of an executor and
    sets its own time limit. If it raises, it is called again up to ``retries`` times after ``pause``, twice that, and so on; then the
    attempt counts as an empty reply. A question has at most ``max_attempts`` attempts, and is ``short`` after them.

    One job asks everything. The attempts of a task that is lost are made again. ``ledger`` names a stored table of all
    attempts: replies found there are not asked for again. ``jobs`` deals the questions over that many jobs, each added to
    the ledger in one switch, so that a run that is stopped keeps those that ended. ``report``, if given, gets the
    number of ``attempts``, of ``calls`` and of attempts without a successful call (``failed``).

    Defined cases: an empty table of questions gives an empty result; a question without any reply has a row
    with a null response; columns of the questions reach ``call`` as they are, nulls as None.
    """
    spark = prompts.sparkSession
    ship_package(spark)
    start = materialize(SM.open_questions(prompts, max_attempts, ledger), "asked")
    ask = asker(call, n, calls_per_task(spark, per_executor), retries, pause)
    schema = T.StructType([*prompts.schema.fields, *REPLY_FIELDS])
    tasks = spark.sparkContext.defaultParallelism
    made = []
    for k in range(jobs):
        part = start.where(F.col("_have") < n)
        if jobs > 1:
            part = part.where(F.pmod(F.xxhash64(*SM.GROUP), F.lit(jobs)) == k)
        # a few parts for each core, as some questions take longer than others
        made.append(materialize(part.repartition(4 * tasks, *SM.GROUP).mapInPandas(ask, schema)
                                .select(*SM.REPLY_KEY, "response", "n_tries", "error"), "answers"))
        if ledger:
            ST.append(made[-1].select(*SM.REPLY_KEY, "response"), ledger, ["scenario", "model"])
    attempts = SM.union(made)
    if report is not None:
        row = attempts.agg(F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum("n_tries"), F.lit(0)).alias("calls"),
                           F.count("error").alias("failed")).first()
        report.update(row.asDict())
    got = SM.drop_empty_responses(attempts).groupBy(*SM.GROUP).agg(F.count(F.lit(1)).cast("int").alias("_got"))
    questions = start.join(got.hint("shuffle_hash"), SM.GROUP, "left").select(*prompts.columns, (F.col("_have") + F.coalesce("_got", F.lit(0))).alias("n_samples"))
    return SM.first_replies(questions, attempts, n, ledger)
