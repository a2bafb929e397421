"""Quality by weak supervision: rules vote good or bad or abstain, and a latent-class model weighs them.

No label is used. Expectation-maximisation fits how often each rule votes which way on good documents and on
each kind of fault (Dawid-Skene with independent rules; faults are kinds of their own, as spam and loops
trip different rules), from the counts of vote patterns. All rates are free. Faults are anchored on agreement: documents that two
rules or more accuse are where the fit starts to look for them, while one rule alone cannot tell a fault from a habit of good
documents. So every fault that is looked for has two rules that measure it in different ways. There are at most 3 ** rules
patterns, so what the driver holds is bounded whatever the input. The posterior is then an expression over the
votes. Everything on the data is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probitas.llm.common import materialize, words

SYMBOLS = "#*$%&|<>"
ABSTAIN, BAD, GOOD = 0, 1, 2


@dataclass(frozen=True)
class VotingRule:
    """Votes good where the measure lies within the good interval, bad outside of the fair one, else abstains."""
    name: str
    measure: str  # SQL over the columns of :func:`measured`
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        x = F.expr(self.measure)
        return (F.when(x.between(*self.good), GOOD).when(~x.between(*self.fair), BAD).otherwise(ABSTAIN))


INF = float("inf")
RULES = (
    VotingRule("symbols", "n_symbols / word_chars", (0, 0.01), (0, 0.05)),
    VotingRule("marked words", "n_marked_words / n_words", (0, 0.02), (0, 0.1)),
    VotingRule("exclamations", "n_exclamations / n_words", (0, 0.05), (0, 0.2)),
    VotingRule("repeated words", "n_repeat_words / n_words", (0, 0.3), (0, 0.5)),
    VotingRule("repeated lines", "n_dup_lines / n_lines", (0, 0.2), (0, 0.5)),
    VotingRule("capitals", "n_capitals / word_chars", (0, 0.15), (0, 0.4)),
    VotingRule("word length", "word_chars / n_words", (3, 10), (2.5, 13)),
    VotingRule("variety", "ln(n_distinct + 1) / ln(n_words + 1)", (0.7, INF), (0.5, INF)),
    VotingRule("sentence ends", "n_ended_lines / n_lines", (0.5, 1), (0.1, 1)),
)


def measured(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the counts that the rules use, each over the whole text (null: empty)."""
    text, w, get = F.coalesce(F.col(text_col), F.lit("")), F.col("__w"), F.get
    without = lambda chars: F.length("__t") - F.length(F.translate("__t", chars, ""))
    blank = r"^[\x20\x09-\x0D]*$"
    out = docs.withColumn("__t", text).withColumn("__w", words(F.col("__t")))
    out = out.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: ~x.rlike(blank)))
    out = out.withColumn("n_words", F.size("__w").cast("long"))
    # 3-word windows as hashes; only texts in which one recurs are looked at closely.
    out = out.withColumn("__g", F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))
        .otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("__s", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(F.transform(
        "__g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    s = F.col("__s")
    out = out.withColumn("__p", F.sort_array(F.filter(F.transform(s, lambda x, i: F.when(
        (get(s, i - 1)["h"] == x["h"]) | (get(s, i + 1)["h"] == x["h"]), x["i"])), lambda x: x.isNotNull())))
    p = F.col("__p")  # starts of windows that recur; each covers three words, less what the next one covers
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(get(p, i + 1) - x, F.lit(3)))),
                          F.lit(0), lambda a, x: a + x)
    capitals = F.length("__t") - F.length(F.regexp_replace("__t", r"\p{Lu}", ""))
    return (out.withColumn("word_chars", F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long"))
            .withColumn("n_symbols", without(SYMBOLS).cast("long"))
            .withColumn("n_marked_words", F.when(F.col("n_symbols") > 0, F.size(F.filter("__w", lambda x: x.rlike(f"[{SYMBOLS}]"))))
                        .otherwise(0).cast("long"))
            .withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
            .withColumn("n_repeat_words", covered.cast("long"))
            .withColumn("n_exclamations", without("!").cast("long"))
            .withColumn("n_capitals", capitals.cast("long"))
            .withColumn("n_distinct", F.size(F.array_distinct("__w")).cast("long"))
            .withColumn("n_ended_lines", F.size(F.filter("__lines", lambda x: x.rlike(r"[.!?…。][\x20\x09-\x0D\"')»”]*$"))).cast("long"))
            .drop("__t", "__w", "__lines", "__g", "__s", "__p"))


@dataclass(frozen=True)
class LabelModel:
    """A mixture of one good class and one class per kind of fault, a rule each."""
    shares: tuple[float, ...]                            # of the good class, then of the faults
    rates: tuple[tuple[tuple[float, ...], ...], ...]     # per class and rule: chance to abstain, vote bad, vote good

    def accuracies(self) -> list[float]:
        """Per rule: chance that a vote, if cast, is right."""
        out = []
        for j in range(len(self.rates[0])):
            right = sum(s * r[j][BAD if c else GOOD] for c, (s, r) in enumerate(zip(self.shares, self.rates)))
            cast = sum(s * (r[j][BAD] + r[j][GOOD]) for s, r in zip(self.shares, self.rates))
            out.append(right / cast)
        return out

    def beliefs(self, votes: tuple[int, ...]) -> list[float]:
        """Chance of each class given the votes."""
        logs = [math.log(s) + sum(math.log(r[j][v]) for j, v in enumerate(votes)) for s, r in zip(self.shares, self.rates)]
        top = max(logs)
        w = [math.exp(x - top) for x in logs]
        return [x / sum(w) for x in w]

    def posterior(self, votes: list[str]) -> Column:
        """Chance of the good class as an expression over columns of votes."""
        others = F.lit(0.0)
        for c in range(1, len(self.shares)):
            odds = F.lit(math.log(self.shares[c] / self.shares[0]))
            for j, name in enumerate(votes):
                a, b, g = (math.log(self.rates[c][j][v] / self.rates[0][j][v]) for v in (ABSTAIN, BAD, GOOD))
                odds = odds + F.when(F.col(name) == BAD, b).when(F.col(name) == GOOD, g).otherwise(a)
            others = others + F.exp(odds)
        return 1 / (1 + others)


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 200, tolerance: float = 1e-9) -> LabelModel:
    """Expectation-maximisation over the counts of vote patterns, in a fixed order, with one pseudo-count per outcome. It starts
    from "faulty where two rules or more vote bad", the blame shared by those rules, and everything else good."""
    rows = sorted(patterns.items())
    beliefs = []
    for votes, _ in rows:
        blame = votes.count(BAD)
        good = 0.05 if blame > 1 else 1.0
        beliefs.append([good] + [(1 - good) / blame if blame > 1 and v == BAD else 0.0 for v in votes])
    model = None
    for _ in range(rounds):
        total = [1.0] * (n_rules + 1)
        counts = [[[1.0, 1.0, 1.0] for _ in range(n_rules)] for _ in total]
        for (votes, n), belief in zip(rows, beliefs):
            for c, q in enumerate(belief):
                total[c] += n * q
                for j, v in enumerate(votes):
                    counts[c][j][v] += n * q
        rates = [[[x / sum(r) for x in r] for r in k] for k in counts]
        model = LabelModel(tuple(t / sum(total) for t in total), tuple(tuple(map(tuple, k)) for k in rates))
        new = [model.beliefs(v) for v, _ in rows]
        moved, beliefs = max((abs(a[0] - b[0]) for a, b in zip(new, beliefs)), default=0.0), new
        if moved < tolerance:
            break
    return model


def judge_quality(docs: DataFrame, rules: tuple[VotingRule, ...] = RULES, threshold: float = 0.5, text_col: str = "text",
                  keep: list[str] | None = None) -> DataFrame:
    """The columns named in ``keep`` (default: all but the text) with the counts, base_failed, quality (posterior
    chance of being good) and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word windows. kept: not so, and quality
    is at least ``threshold``.

    Defined cases: null, empty and blank texts have no words and fail the base rule; null ids, repeated rows and
    ties are judged row by row and alike; a rule whose measure divides by zero abstains; an empty table
    gives an empty result; a kept column takes the place of an added one of the same name (:func:`keep_good` has no such clash).
    """
    kept = [c for c in docs.columns if c != text_col] if keep is None else keep
    spare = {c: f"__keep{i}" for i, c in enumerate(kept)}  # names that clash with none of the counts
    source = docs.select(F.col(text_col).alias("__text"), *[F.col(c).alias(s) for c, s in spare.items()])
    counted = measured(source, "__text").drop("__text")
    counted = counted.withColumns({f"__v{j}": _guarded(r) for j, r in enumerate(rules)})
    counted = materialize(counted, "quality-votes")
    names = [f"__v{j}" for j in range(len(rules))]
    patterns = {tuple(r[:-1]): r[-1] for r in counted.groupBy(*names).agg(F.count("*").alias("n")).collect()}  # <= 3 ** rules
    model = fit(patterns, len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (counted.withColumn("base_failed", failed).withColumn("quality", model.posterior(names))
           .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))
    added = [c for c in out.columns if not c.startswith("__") and c not in kept]
    return out.select(*[F.col(s).alias(c) for c, s in spare.items()], *added)


def keep_good(docs: DataFrame, rules: tuple[VotingRule, ...] = RULES, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that :func:`judge_quality` keeps, all columns as they are."""
    source = docs.select(F.col(text_col).alias("__text"), F.struct(*[F.col(c) for c in docs.columns]).alias("__doc"))
    return judge_quality(source, rules, threshold, "__text", ["__doc"]).where("kept").select("__doc.*")


def _guarded(rule: VotingRule) -> Column:
    """The rule's vote; texts without words get none."""
    return F.when(F.col("n_words") > 0, rule.vote()).otherwise(ABSTAIN).cast("int")
