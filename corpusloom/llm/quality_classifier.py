"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good (1), bad (-1) or abstain (0) on each
text.  Votes are counted by pattern (at most 3 ** labellers patterns, so the
table is bounded at any corpus size), and expectation-maximisation over the
patterns estimates the prior and each labeller's accuracy in both classes.
The posterior of a text's pattern is its soft label.  A linear scorer over
hashed words is then trained on a bounded sample of texts
(about ``max_training_docs`` different ones with the smallest hashes) by full-batch gradient steps
that Spark sums over the sample's partitions; it scores every whole text.  Its
features are hashed words and the hashed steps of the measures that labellers use.
A text is kept if its score reaches the threshold.

Defined results: a null text has no words, an empty feature vector and the
score of the bias alone, and is not kept; repeated rows score alike; extra columns are kept; on
an empty table nothing is fitted and no rows come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import base_counts
from .store import Scratch, free_name, smallest_hashes
from .words import groups, mix, words_of

#: (measure, bad at or above, good at or below): each is one labeller.  Most only know what is bad and
#: abstain elsewhere; the last also knows good prose.
LABELLERS = (
    ("symbol_share", 0.015, None),
    ("repeat_share", 0.30, None),
    ("dup_line_share", 0.50, None),
    ("digit_share", 0.20, None),
    ("upper_share", 0.30, None),
    ("odd_word_length", 4.5, None),
    ("shortness", 0.34, None),
    ("odd_case", 0.25, 0.20),
)


MOST_FALSE_ALARMS = 0.003
#: edges of the steps that measures are cut into as features
STEPS = np.array([0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.34, 0.5, 1, 2, 3, 4.5, 6])
STEP_VALUE = 0.5


def measures(texts) -> pd.DataFrame:
    c = base_counts(texts)
    words = np.maximum(c["n_words"].to_numpy(), 1)
    chars = np.maximum(c["word_chars"].to_numpy(), 1)
    raw = [t if isinstance(t, str) else "" for t in texts]
    lines = np.array([t.count("\n") + 1 for t in raw])
    digits = np.array([sum(t.count(d) for d in "0123456789") for t in raw])
    upper = np.array([sum(map(t.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for t in raw])
    ends = np.array([sum(map(t.count, ".!?")) for t in raw])
    return pd.DataFrame(
        {
            "symbol_share": c["n_symbols"] / chars,
            "repeat_share": c["n_repeat_words"] / words,
            "dup_line_share": c["n_dup_lines"] / lines,
            "digit_share": digits / chars,
            "upper_share": upper / chars,
            "odd_word_length": np.abs(chars / words - 5.5),
            "shortness": 1 / words,
            # sentences begin with one capital: far more or fewer capitals than sentence ends are odd
            "odd_case": np.abs(upper - ends) / words,
        }
    )


def votes(m: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(m), len(LABELLERS)), dtype=np.int64)
    for j, (name, bad, good) in enumerate(LABELLERS):
        v = m[name].to_numpy()
        out[:, j] = np.where(v >= bad, -1, 0 if good is None else np.where(v <= good, 1, 0))
    return out


def pattern_of(v: np.ndarray) -> np.ndarray:
    return (v + 1) @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(labellers) % 3 - 1


def estimate(pattern_votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior of good, vote probabilities [class, labeller, vote + 1], posterior of good per pattern.

    Starts from "one bad vote is enough".  Labellers are taken to be better than chance: a good text
    gets a labeller's bad vote with at most MOST_FALSE_ALARMS, which also keeps the classes from
    changing places; the smoothing keeps labellers that never vote harmless.
    """
    k = pattern_votes.shape[1]
    posterior = np.where((pattern_votes < 0).any(axis=1), 0.1, 0.9)
    prior, rates = 0.5, np.full((2, k, 3), 1 / 3)
    for _ in range(rounds):
        prior = float(np.clip((n * posterior).sum() / n.sum(), 1e-3, 1 - 1e-3))
        for c, weight in ((0, n * (1 - posterior)), (1, n * posterior)):
            for v in (-1, 0, 1):
                rates[c, :, v + 1] = (weight[:, None] * (pattern_votes == v)).sum(axis=0) + 1
            rates[c] /= rates[c].sum(axis=1, keepdims=True)
        over = np.maximum(rates[1, :, 0] / MOST_FALSE_ALARMS, 1)
        rates[1, :, 0] /= over
        rates[1, :, 1:] *= ((1 - rates[1, :, 0]) / rates[1, :, 1:].sum(axis=1))[:, None]
        logs = np.log(rates)
        like = [logs[c, np.arange(k), pattern_votes + 1].sum(axis=1) for c in (0, 1)]
        gap = like[1] + np.log(prior) - like[0] - np.log(1 - prior)
        posterior = 1 / (1 + np.exp(-np.clip(gap, -40, 40)))
    return prior, rates, posterior


def step_buckets(m: pd.DataFrame, buckets: int) -> np.ndarray:
    """The bucket of each text's step of each measure: one hashed feature per measure."""
    step = np.column_stack([np.digitize(m[name].to_numpy(), STEPS) for name, *_ in LABELLERS]).astype(np.uint64)
    own = (np.arange(len(LABELLERS), dtype=np.uint64) + np.uint64(1)) << np.uint64(32)
    return (mix(step + own) & np.uint64(buckets - 1)).astype(np.int64)


def features(texts, m: pd.DataFrame, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index, buckets, values) of each text: square roots of word shares, then the steps of its measures."""
    steps = step_buckets(m, buckets)
    values = np.full(len(LABELLERS), STEP_VALUE)
    for begin, run in groups(texts, lower=True):
        w = words_of(run)
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            at, n = np.unique((w.hashes[a:b] & np.uint64(buckets - 1)).astype(np.int64), return_counts=True)
            yield begin + i, np.concatenate((at, steps[begin + i])), np.concatenate((np.sqrt(n / max(b - a, 1)), values))


def linear_scores(texts, m: pd.DataFrame, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of texts with per-text sums over bucket counts."""
    out = np.zeros(len(texts))
    for i, at, x in features(texts, m, len(weights)):
        out[i] = weights[at] @ x + bias
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _pattern(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        p, n = np.unique(pattern_of(votes(measures(f["text"]))), return_counts=True)
        yield pd.DataFrame({"pattern": p, "n": n})


def train(sample: DataFrame, posterior: dict[int, float], buckets: int, rounds: int) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps with momentum; ``sample`` has the column text."""
    weights, bias = np.zeros(buckets), 0.0
    speed, bias_speed = np.zeros(buckets), 0.0
    default = float(np.mean(list(posterior.values())))

    def gradient(frames):
        total, own, n = np.zeros(buckets), 0.0, 0
        for f in frames:
            m = measures(f["text"])
            label = np.array([posterior.get(int(p), default) for p in pattern_of(votes(m))])
            for i, at, x in features(f["text"], m, buckets):
                error = label[i] - 1 / (1 + np.exp(-np.clip(weights[at] @ x + bias, -40, 40)))
                np.add.at(total, at, error * x)
                own += error
                n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, [-1, -2]), "g": np.append(total[at], [own, n])})

    for _ in range(rounds):
        found = sample.mapInPandas(gradient, "bucket long, g double").groupBy("bucket").agg(F.sum("g").alias("g")).toPandas()
        g = dict(zip(found["bucket"], found["g"]))
        n = max(g.pop(-2, 0.0), 1.0)
        bias_speed = 0.8 * bias_speed + g.pop(-1, 0.0) / n
        step = np.zeros(buckets)
        step[np.array(list(g), dtype=np.int64)] = np.array(list(g.values())) / n
        speed = 0.8 * speed + step - 1e-5 * weights
        weights = weights + 30 * speed
        bias += 2 * bias_speed
    return weights, bias


def classify_quality(
    spark: SparkSession,
    docs: DataFrame,
    text_col: str = "text",
    score_col: str = "score",
    buckets: int = 1 << 14,
    max_training_docs: int = 4_000,
    rounds: int = 12,
    threshold: float = 0.5,
) -> DataFrame:
    """``docs`` with weak_score (posterior of the labellers' votes), ``score_col`` and kept."""
    texts = docs.select(F.col(text_col).alias("text"))
    patterns = texts.mapInPandas(_pattern, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if patterns.empty:
        return docs.withColumns({"weak_score": F.lit(None).cast("double"), score_col: F.lit(None).cast("double"), "kept": F.lit(False)})
    keys = patterns["pattern"].to_numpy(dtype=np.int64)
    _, _, post = estimate(votes_of(keys, len(LABELLERS)), patterns["n"].to_numpy(dtype=float))
    posterior = dict(zip(keys.tolist(), post.tolist()))
    # equal texts count once, so a group of copies cannot fill the sample
    hashed = texts.where(F.length("text") > 0).select(F.xxhash64("text").alias("h"), "text")
    keys = smallest_hashes(hashed.select("h").distinct(), "h", max_training_docs)
    sample = hashed.join(F.broadcast(keys), "h").dropDuplicates(["h"]).select("text")
    sample = Scratch(spark, "quality").save(sample.repartition(spark.sparkContext.defaultParallelism), "sample")
    weights, bias = train(sample, posterior, buckets, rounds)
    model = spark.sparkContext.broadcast((weights, bias, posterior))

    @F.pandas_udf("weak double, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            w, b, soft = model.value
            m = measures(text)
            weak = np.array([soft.get(int(p), np.nan) for p in pattern_of(votes(m))])
            yield pd.DataFrame({"weak": weak, "score": linear_scores(text, m, w, b)})

    judged = free_name(docs, "judged")
    out = docs.withColumn(judged, judge(F.col(text_col)))
    out = out.withColumns({"weak_score": F.col(f"{judged}.weak"), score_col: F.col(f"{judged}.score")}).drop(judged)
    kept = (F.col(score_col) >= threshold) & (F.length(text_col) > 0)
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))
