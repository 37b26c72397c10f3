"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built.  A text is cut greedily into the longest phrases that occur in that
sample; the language needing fewest phrases per character wins.  A phrase
ends where the automaton has no transition, and the next begins at its root.

Texts are lower-cased, runs of anything but letters become one space, and
letters are mapped to a small alphabet.  Parses go through numpy in lock step:
texts are laid out as lanes of ``LANE`` characters (a phrase ends with a lane,
for every language alike, so whole texts of any length are parsed in bounded
memory) and one step advances all lanes of all languages.

Defined results: a null text or one without letters is ``und`` with score 0;
ties go to the smaller language name; if nothing can be learned all texts are
``und``; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import free_name

LANE = 1024
WIDTH = 2048
UNDETERMINED = "und"
_BMP = 1 << 16


def _letter_table() -> np.ndarray:
    """Of each code point of the basic plane: its lower-case letter's code point, 0 for others."""
    out = np.zeros(_BMP, dtype=np.int32)
    for c in range(_BMP):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < _BMP else c
    return out


_LETTERS: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points of the text's lower-case letters, with 0 for each run of others."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = _LETTERS[0][np.minimum(codes, _BMP - 1)]
    for i in np.flatnonzero(codes >= _BMP):
        out[i] = _BMP - 2 if chr(codes[i]).isalpha() else 0
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class Parser:
    languages: list[str]
    symbols: np.ndarray  # code point -> symbol; 0 is any letter outside the alphabet
    width: int
    table: np.ndarray  # state * width + symbol -> state, 0 where there is none
    roots: np.ndarray

    @classmethod
    def learn(cls, samples: dict[str, list[str]], chars: int, alphabet: int) -> Parser:
        """``samples``: texts of each language, of which the first ``chars`` letters are used."""
        bags = {k: np.concatenate([np.append(letters_of(t), 0) for t in v])[:chars] for k, v in sorted(samples.items())}
        common = Counter()
        for v in bags.values():
            common.update(dict(zip(*(x.tolist() for x in np.unique(v, return_counts=True)))))
        common.pop(0, None)
        kept = sorted(common, key=lambda c: (-common[c], c))[:alphabet]
        symbols = np.zeros(_BMP, dtype=np.int32)
        symbols[0] = 1
        symbols[kept] = np.arange(2, len(kept) + 2)
        width, roots, rows, base = len(kept) + 2, [], [], 0
        for v in bags.values():
            states = suffix_automaton(symbols[v])
            block = np.zeros((len(states), width), dtype=np.int32)
            for s, moves in enumerate(states):
                for c, to in moves.items():
                    if c:
                        block[s, c] = to + base
            block[block == base] = 0
            roots.append(base)
            rows.append(block)
            base += len(states)
        # state 0 is the first root, which no transition enters, so 0 can stand for none;
        # the last state has no transitions: a phrase begins after it
        rows.append(np.zeros((1, width), dtype=np.int32))
        return cls(list(bags), symbols, width, np.concatenate(rows).ravel(), np.array(roots, dtype=np.int32))

    def _lanes(self, lanes: list[np.ndarray]) -> np.ndarray:
        """Phrases of each lane (rows) in each language (columns)."""
        order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
        lengths = np.array([len(lanes[i]) for i in order])
        chars = np.zeros((lengths[0], len(order)), dtype=np.int32)
        for j, i in enumerate(order):
            chars[: lengths[j], j] = lanes[i]
        n = len(self.roots)
        end = len(self.table) // self.width - 1
        state = np.full((n, len(order)), end, dtype=np.int32)
        phrases = np.zeros((n, len(order)), dtype=np.int32)
        # a letter that the language's sample lacks is a phrase of its own
        fresh = self.table[(self.roots * self.width)[:, None] + np.arange(self.width)]
        fresh[fresh == 0] = end
        alive = len(order) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        for i, m in enumerate(alive.tolist()):
            c = chars[i, :m]
            to = self.table[state[:, :m] * self.width + c]
            stop = to == 0
            phrases[:, :m] += stop
            np.copyto(to, fresh[:, c], where=stop)
            state[:, :m] = to
        out = np.empty((len(order), n), dtype=np.int32)
        out[order] = phrases.T
        return out

    def phrases(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per text and language, characters per text, and whether it has letters."""
        counts = np.zeros((len(texts), len(self.roots)))
        sizes = np.zeros(len(texts))
        has = np.zeros(len(texts), dtype=bool)
        lanes: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            if lanes:
                np.add.at(counts, owner, self._lanes(lanes))
                lanes.clear()
                owner.clear()

        for i, text in enumerate(texts):
            if not isinstance(text, str):
                continue
            codes = letters_of(text)
            sizes[i] = len(codes)
            has[i] = bool(codes.any())
            symbols = self.symbols[codes]
            for a in range(0, len(symbols) if has[i] else 0, LANE):
                lanes.append(symbols[a : a + LANE])
                owner.append(i)
                if len(lanes) >= WIDTH:
                    flush()
        flush()
        return counts, sizes, has

    def predict(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Language and score (0 to 1: share of the winner among exp(-8 * phrases relative to the best))."""
        counts, sizes, has = self.phrases(texts)
        names = np.array([*self.languages, UNDETERMINED], dtype=object)
        rates = counts / np.maximum(sizes, 1)[:, None]
        best = rates.argmin(axis=1)
        least = rates[np.arange(len(rates)), best]
        odds = np.exp(-8 * (rates / np.maximum(least, 1e-9)[:, None] - 1))
        return names[np.where(has, best, len(self.languages))], np.where(has, 1 / odds.sum(axis=1), 0.0)


def predict_language(
    spark: SparkSession,
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang_pred",
    score_col: str = "score",
    training_docs: int = 64,
    training_chars: int = 24_000,
    alphabet: int = 62,
    total_chars: int = 1_600_000,
) -> DataFrame:
    """``docs`` with ``lang_col`` and ``score_col``; ``labelled`` has columns text and lang.

    The automata of all languages are fitted on a bounded sample: of each the ``training_docs`` different
    texts of the smallest hashes, each cut at the same number of letters and all together at
    ``training_chars``, or at an equal share of ``total_chars`` if there are many languages.
    """
    known = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.xxhash64("text").alias("h"), F.length("text").alias("size"), "text")
    # hashes only: equal texts count once, and at most training_docs of a task's rows go on
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    keys = known.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= training_docs).select("lang", "h")
    # training_docs rows a language at most
    rows = known.join(F.broadcast(keys), ["lang", "h"]).select("lang", "h", F.substring("text", 1, 2 * training_chars).alias("text")).dropDuplicates(["lang", "h"])
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h)):
        samples.setdefault(r.lang, []).append(r.text)
    if not samples:
        return docs.withColumn(lang_col, F.lit(UNDETERMINED)).withColumn(score_col, F.lit(0.0))
    chars = max(min(training_chars, total_chars // len(samples)), 1)
    samples = {lang: [t[: max(4 * chars // len(texts), 1)] for t in texts] for lang, texts in samples.items()}
    shared = spark.sparkContext.broadcast(Parser.learn(samples, chars, alphabet))

    @F.pandas_udf("lang string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in texts:
            lang, score = shared.value.predict(text)
            yield pd.DataFrame({"lang": lang, "score": score})

    parsed = free_name(docs, "parsed")
    out = docs.withColumn(parsed, predict(F.col(text_col)))
    return out.withColumns({lang_col: F.col(f"{parsed}.lang"), score_col: F.col(f"{parsed}.score")}).drop(parsed)
