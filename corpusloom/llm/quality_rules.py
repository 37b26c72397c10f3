"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hashed word n-grams (words and word pairs)
are counted: of the trusted target texts and of the whole raw corpus, each over
all its texts, pre-aggregated in each task.  A text's score is the mean over its
n-grams of log p_target - log p_raw.  A text is kept if it passes the base
rules and its score is at least the target's mean minus ``deviations`` standard
deviations of target scores, the same threshold for every text.  One half of the
target texts is counted and the other, unseen half sets the threshold.

Defined results: a null text has no words, fails the base rules and scores 0;
without target texts in both halves only the base rules decide; repeated rows score alike;
extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import free_name
from .words import Words, groups, windows, words_of

SYMBOLS = "#*$%&|<>"
_NOT_SPACE = bytes(b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d")
_TRAILING = bytes(range(0x80, 0xC0))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def repeat_words(hashes: np.ndarray, k: int = 5) -> int:
    """Words inside k-word windows that occur at least twice."""
    w = windows(hashes, k)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in raw.split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def ngram_buckets(w: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, and of the pairs that begin at them (-1 at a text's last word)."""
    mask = np.uint64(buckets - 1)
    single = (w.hashes & mask).astype(np.int64)
    pair = np.full(len(single), -1, dtype=np.int64)
    if len(single) > 1:
        pair[:-1] = (windows(w.hashes, 2) & mask).astype(np.int64)
        pair[w.first[1:][w.first[1:] > 0] - 1] = -1
    return single, pair


def _count(buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for f in frames:
            for _, run_ in groups(f["text"], lower=True):
                single, pair = ngram_buckets(words_of(run_), buckets)
                total += np.bincount(single, minlength=buckets)
                total += np.bincount(pair[pair >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    return run


def ngram_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of all n-grams of column text; ``buckets`` numbers come to the driver."""
    out = np.zeros(buckets)
    for r in texts.mapInPandas(_count(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def ratios(good: np.ndarray, raw: np.ndarray, prior: float) -> np.ndarray:
    """log p_target - log p_raw per bucket; the target's counts are drawn to the raw shares by ``prior`` times their own sum."""
    if not good.sum():
        return np.zeros(len(raw))
    share = (raw + 1e-6) / (raw + 1e-6).sum()
    extra = prior * good.sum()
    return np.log((good + extra * share) / (good.sum() + extra)) - np.log(share)


def scores(texts, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(texts))
    for begin, run in groups(texts, lower=True):
        w = words_of(run)
        single, pair = ngram_buckets(w, len(weights))
        value = weights[single] + np.where(pair >= 0, weights[pair], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(value)))
        sizes = np.diff(w.first)
        out[begin : begin + len(run)] = (sums[w.first[1:]] - sums[w.first[:-1]]) / np.maximum(2 * sizes - 1, 1)
    return out


def base_counts(texts) -> pd.DataFrame:
    rows = []
    for _, run in groups(texts):
        w = words_of(run)
        for i, raw in enumerate(run):
            a, b = w.first[i], w.first[i + 1]
            chars = len(raw.translate(None, b"\x20\x09\x0a\x0b\x0c\x0d" + _TRAILING))
            symbols = sum(raw.count(c) for c in (s.encode() for s in SYMBOLS))
            rows.append((b - a, chars, symbols, duplicate_lines(raw), repeat_words(w.hashes[a:b])))
    return pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]).astype("int64")


def judge_quality(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    text_col: str = "text",
    buckets: int = 1 << 16,
    deviations: float = 4.0,
    prior: float = 0.1,
    min_words: int = 10,
    max_repeat_percent: int = 20,
) -> DataFrame:
    """``docs`` with the base counts, ``score``, ``base_failed`` and ``kept``; ``target`` has the column text."""
    raw = ngram_counts(docs.select(F.col(text_col).alias("text")), buckets)
    # read twice, never written: a table of the target's texts would be as large as they are
    known = target.where(F.col("text").isNotNull()).select("text")
    counted = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    good = ngram_counts(known.where(counted), buckets)
    weights = spark.sparkContext.broadcast(ratios(good, raw, prior))

    def score_target(frames):
        for f in frames:
            yield pd.DataFrame({"s": scores(f["text"], weights.value)})

    mean, deviation = known.where(~counted).mapInPandas(score_target, "s double").agg(F.avg("s"), F.stddev_pop("s")).first()
    threshold = -1e300 if mean is None else mean - deviations * max(deviation, 1e-6)

    @F.pandas_udf(COUNTS)
    def measure(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            yield base_counts(text).assign(score=scores(text, weights.value))

    names = [c.split()[0] for c in COUNTS.split(", ")]
    measured = free_name(docs, "measured")
    out = docs.withColumn(measured, measure(F.col(text_col)))
    out = out.withColumns({c: F.col(f"{measured}.{c}") for c in names}).drop(measured)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
