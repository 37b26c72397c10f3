"""Toxicity by class-conditional Kneser-Ney bigram models.

Two interpolated Kneser-Ney models, of toxic and of ordinary labelled texts,
share their lowest level: the continuation counts (distinct left neighbours) of
both classes together, so an expression that one class has hardly seen backs
off to the same value in both.  Above it come each class's discounted words and
word pairs, counted once per document, since a long text that repeats itself
says no more about its class than a short one.  A word of fewer than ``min_docs``
labelled documents backs off to its beginning: the longest of BEGINNINGS bytes
that rare words of so many documents share, so rare forms of one stem count together.

Expressions whose document counts differ between the classes by ``min_contrast``
standard errors count with their log-likelihood difference, each once per text; all
others say nothing about the class and count 0, so an expression of one language
needs no more documents than its contrast does.  A text's difference is their sum over
a power of its number of tokens.  Power and logistic curve are fitted on labelled texts
which the counts have not seen.

Counting and fitting use a bounded sample of the labelled rows: about
``max_training_docs`` different texts of them, those with the smallest hashes.  All words
and pairs of the sample are counted; the model has those of ``min_docs`` documents, so its
size is bounded by the sample's.  Scoring reads every whole text in parallel blocks, with
the model as a broadcast variable.

Words are lower-cased (A-Z) runs without white space and ASCII punctuation.  Defined
results: a null or wordless text has log-likelihood difference 0 and gets the score of an
average text; without labels of both classes every score is 0; repeated rows score alike;
other columns stay as they are, but one of ``score_col``'s name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch, smallest_hashes
from .words import PUNCTUATION, SPACES, Words, groups, separators, words_of

DISCOUNT = 0.75
BEGINNINGS = (4, 6, 8)
POWERS = (1.0, 0.75, 0.5, 0.25)
UNKNOWN = 0
_TABLE = separators(SPACES + PUNCTUATION)


@dataclass
class Model:
    """Token 0 is unknown, token i > 0 is vocabulary[i - 1]; keys are left * size + right."""

    vocabulary: np.ndarray
    single: np.ndarray  # log p_toxic(w) - log p_ordinary(w) of the lower level, 0 without contrast
    keys: np.ndarray
    pair: np.ndarray
    slope: float = 0.0
    bias: float = 0.0
    power: float = 0.5

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, UNKNOWN)

    def tokens(self, w: Words) -> np.ndarray:
        """The token of each word: its own, else that of its longest beginning that has one."""
        different, at = np.unique(w.hashes, return_index=True)
        t = self.find(different)
        for heads in w.beginnings[::-1]:
            rare = np.flatnonzero(t == UNKNOWN)
            t[rare] = self.find(heads[at[rare]])
        return t[np.searchsorted(different, w.hashes)]

    def differences(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Sum of the log-likelihood differences of each text's expressions, and its number of tokens (at least 1)."""
        out, tokens = np.zeros(len(texts)), np.ones(len(texts))
        for begin, run in groups(texts, lower=True):
            w = words_of(run, _TABLE, BEGINNINGS)
            t, owner = self.tokens(w), _owners(w)
            value, key = self.single[t], t.copy()
            if len(t) > 1 and len(self.keys):
                pairs = t[:-1] * len(self.single) + t[1:]
                at = np.searchsorted(self.keys, pairs)
                at[at == len(self.keys)] = 0
                known = np.flatnonzero((self.keys[at] == pairs) & (owner[1:] == owner[:-1]))
                value[known + 1] = self.pair[at[known]]
                key[known + 1] = -1 - pairs[known]
            told = np.flatnonzero(value)
            told = told[_first(owner[told], key[told])]
            sums = np.bincount(owner[told], weights=value[told], minlength=len(run))
            out[begin : begin + len(run)] = sums
            tokens[begin : begin + len(run)] = np.maximum(np.diff(w.first), 1)
        return out, tokens

    def score(self, texts) -> np.ndarray:
        sums, tokens = self.differences(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * sums / tokens**self.power + self.bias, -40, 40)))


def _first(groups_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of one of each (group, key)."""
    order = np.lexsort((keys, groups_))
    k, g = keys[order], groups_[order]
    fresh = np.ones(len(k), dtype=bool)
    fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return order[fresh]


def _once(groups_: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of groups that have it)."""
    return np.unique(keys[_first(groups_, keys)], return_counts=True)


def _owners(w) -> np.ndarray:
    return np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))


def _token_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per class, word or beginning, and batch; the hash stands for it."""
    for f in frames:
        for toxic in (0, 1):
            for _, run in groups(f["text"][f["toxic"] == toxic], lower=True):
                w = words_of(run, _TABLE, BEGINNINGS)
                owner = _owners(w)
                for hashes in (w.hashes, *w.beginnings):
                    word, n = _once(owner[hashes > 0], hashes[hashes > 0])
                    yield pd.DataFrame({"toxic": np.full(len(word), toxic), "word": word.view(np.int64), "n": n})


def _class_counts(vocabulary: np.ndarray):
    """Documents per class, kind (1 word, 2 pair) and key."""
    model = Model(vocabulary, *[np.zeros(0)] * 3)
    size = len(vocabulary) + 1

    def run(frames):
        for f in frames:
            for toxic in (0, 1):
                for _, texts in groups(f["text"][f["toxic"] == toxic], lower=True):
                    w = words_of(texts, _TABLE, BEGINNINGS)
                    t, owner = model.tokens(w), _owners(w)
                    right = np.flatnonzero(owner[1:] == owner[:-1]) + 1
                    for kind, key, own in ((1, t, owner), (2, t[right - 1] * size + t[right], owner[right])):
                        k, n = _once(own, key)
                        yield pd.DataFrame({"toxic": np.full(len(k), toxic), "kind": np.full(len(k), kind), "key": k, "n": n})

    return run


def _by_class(counts: DataFrame, keys: list[str], have: dict[int, int], min_docs: int) -> DataFrame:
    """keys, toxic and ordinary documents, and contrast: their difference in standard errors, 0 below ``min_docs``."""
    n = lambda c: F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0))
    both = counts.groupBy(*keys).agg(n(1).alias("t"), n(0).alias("o"))
    share = (F.col("t") + F.col("o")) / (have[0] + have[1])
    error = F.sqrt(share * (1 - share) * (1 / have[0] + 1 / have[1]))
    z = F.abs(F.col("t") / have[1] - F.col("o") / have[0]) / error
    return both.withColumn("contrast", F.when((error > 0) & (F.col("t") + F.col("o") >= min_docs), z).otherwise(0.0))


def _fit_counts(vocabulary: np.ndarray, words: pd.DataFrame, pairs: pd.DataFrame, follows: pd.DataFrame, contexts: pd.DataFrame, min_contrast: float) -> Model:
    """Log-ratio tables from document counts of both classes (t and o): of words, of the pairs of contrast, and of what all pairs sum to by word."""
    size = len(vocabulary) + 1
    pairs = pairs.sort_values("key")
    keys = pairs["key"].to_numpy(dtype=np.int64)
    left, right = keys // size, keys % size
    place = words["key"].to_numpy(dtype=np.int64)
    shared = np.full(size, 0.5)
    shared[follows["right"].to_numpy(dtype=np.int64)] += follows["n"].to_numpy(dtype=float)
    shared = shared / shared.sum()
    single, pair = [], []
    for c in ("o", "t"):
        seen, context = np.zeros(size), np.zeros(size)
        seen[place] = words[c].to_numpy(dtype=float)
        context[contexts["left"].to_numpy(dtype=np.int64)] = contexts[c].to_numpy(dtype=float)
        low = np.maximum(seen - DISCOUNT, 0) / max(seen.sum(), 1.0)
        low = low + (1 - low.sum()) * shared
        n = np.maximum(pairs[c].to_numpy(dtype=float) - DISCOUNT, 0)
        rest = 1 - np.bincount(left, weights=n, minlength=size) / np.maximum(context, 1)
        single.append(np.log(low))
        pair.append(np.log(n / np.maximum(context[left], 1) + rest[left] * low[right]))
    differ = np.zeros(size, dtype=bool)
    differ[place] = words["contrast"].to_numpy(dtype=float) >= min_contrast
    differ[UNKNOWN] = False
    return Model(vocabulary, np.where(differ, single[1] - single[0], 0.0), keys, pair[1] - pair[0])


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic curve of one variable by damped Newton steps: slope, bias and log-likelihood."""
    centre, scale = x.mean(), max(x.std(), 1e-9)
    z = np.column_stack(((x - centre) / scale, np.ones(len(x))))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-12, 1 - 1e-12)
    return float(w[0] / scale), float(w[1] - w[0] * centre / scale), float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())


def train(spark: SparkSession, rows: DataFrame, min_contrast: float, min_docs: int) -> Model | None:
    """Model of ``rows`` (toxic int, text, calibrate boolean), a bounded table; None without both classes."""
    counted = rows.where("not calibrate")
    have = {r[0]: r[1] for r in counted.groupBy("toxic").count().collect()}
    if set(have) != {0, 1}:
        return None
    scratch = Scratch(spark, "toxicity")
    words = _by_class(counted.mapInPandas(_token_counts, "toxic int, word long, n long"), ["word"], have, min_docs)
    frequent = words.where(F.col("t") + F.col("o") >= min_docs).select("word")
    vocabulary = np.sort(frequent.toPandas()["word"].to_numpy(dtype=np.int64).view(np.uint64))
    counts = counted.mapInPandas(_class_counts(vocabulary), "toxic int, kind int, key long, n long")
    counts = scratch.save(_by_class(counts, ["kind", "key"], have, min_docs), "counts")
    size = len(vocabulary) + 1
    pairs = counts.where("kind = 2").withColumns({"left": F.floor(F.col("key") / size).cast("long"), "right": F.col("key") % size})
    differ = pairs.where(F.col("contrast") >= min_contrast).select("key", "t", "o")
    # every one of these has a row per word of the vocabulary at most; pairs of contrast are few among those of min_docs
    follows = pairs.groupBy("right").agg(F.count("*").alias("n"))
    contexts = pairs.groupBy("left").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    model = _fit_counts(vocabulary, counts.where("kind = 1").select("key", "t", "o", "contrast").toPandas(), differ.toPandas(), follows.toPandas(), contexts.toPandas(), min_contrast)
    shared = spark.sparkContext.broadcast(model)

    def differences(frames):
        for f in frames:
            sums, tokens = shared.value.differences(f["text"])
            yield pd.DataFrame({"toxic": f["toxic"], "x": sums, "tokens": tokens})

    held = rows.where("calibrate").mapInPandas(differences, "toxic int, x double, tokens double").toPandas()
    if held["toxic"].nunique() < 2:
        held = counted.mapInPandas(differences, "toxic int, x double, tokens double").toPandas()
    x, y, tokens = (held[c].to_numpy(dtype=float) for c in ("x", "toxic", "tokens"))
    fits = [(*_calibrate(x / tokens**power, y), power) for power in POWERS]
    model.slope, model.bias, _, model.power = max(fits, key=lambda f: f[2])
    model.slope = max(model.slope, 0.0)
    scratch.drop("counts")
    return model


def score_toxicity(
    spark: SparkSession,
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    score_col: str = "score",
    max_training_docs: int = 20_000,
    min_contrast: float = 4.0,
    min_docs: int = 3,
) -> DataFrame:
    """``docs`` with ``score_col``; ``labelled`` has columns text and toxic (0 or 1; other values are left out)."""
    scratch = Scratch(spark, "toxicity")
    known = labelled.where(F.col("toxic").isin(0, 1) & F.col("text").isNotNull())
    known = known.select(F.col("toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("h"), "text")
    # equal texts of one label count once, so a group of copies cannot fill the sample
    keys = smallest_hashes(known.select("toxic", "h").distinct(), "h", max_training_docs)
    sample = known.join(F.broadcast(keys), ["toxic", "h"]).dropDuplicates(["toxic", "h"])
    sample = scratch.save(sample.select("toxic", "text", (F.pmod("h", F.lit(4)) == 0).alias("calibrate")), "sample")
    model = train(spark, sample, min_contrast, min_docs)
    scratch.drop("sample")
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(shared.value.score(text))

    return docs.withColumn(score_col, score(F.col(text_col)))
