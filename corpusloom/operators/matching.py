"""Which of very many phrases occur in which texts, as plain substrings.

A phrase is found by one of its windows: as many bytes as the largest of SIZES
that it holds, and of these the window that the fewest phrases share.  Texts and
phrases meet by the hash of that window in an equi-join, so no text is tried
against a phrase that it shares no window with.  Windows of a text are hashed by
doubling (a window of 16 bytes from two of 8), as arrays; before anything is sent,
a Bloom filter of the phrases' windows, of bounded size, drops the rest.  What the
filter lets through by mistake finds no partner, and what meets is verified in
the text, so the result is exact at any number of phrases.  With ``look_up``, up to
FEW_PHRASES of them go to every task, which looks their windows up and verifies them where it
reads the text, so nothing but what is found is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.shared import Tables, spread

SIZES = (1, 2, 4, 8, 16, 32)
#: bits of the filter: this many per phrase, within these bounds (so at most 8 MB)
BITS_PER_PHRASE = 16
LEAST_BITS, MOST_BITS = 1 << 13, 1 << 26
#: phrases, and bytes of them, that are broadcast; more meet the texts by the join
FEW_PHRASES, FEW_BYTES = 20_000, 4 << 20
#: bytes of a text that are hashed at once
BLOCK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * _ODD)


def window_hashes(data: bytes, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, hash of each window of that many bytes) for the sizes asked for."""
    h, q = _BYTES[np.frombuffer(data, dtype=np.uint8)], 1
    while len(h):
        if q in sizes:
            yield q, h.view(np.int64)
        if q >= sizes[-1] or len(h) <= q:
            return
        h = _mixed(h[:-q] * _ODD + h[q:])
        q *= 2


def _phrase_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sizes, found = [], []
        for phrase in batch["phrase"]:
            data = phrase.encode()
            size = max(s for s in SIZES if s <= len(data))
            sizes.append(size)
            found.append(np.unique(next(window_hashes(data, (size,)))[1]))
        if found:
            n = [len(h) for h in found]
            yield pd.DataFrame({"key": np.repeat(batch["key"].to_numpy(), n), "size": np.repeat(np.array(sizes, dtype=np.int32), n), "h": np.concatenate(found)})


def anchors(phrases: DataFrame) -> DataFrame:
    """(size, h, phrase): the rarest window of each distinct phrase that is not empty.

    Phrases are dealt to all cores, as they are few bytes and many windows; those have their phrase's number.
    """
    named = spread(phrases.where(F.length("phrase") > 0).select("phrase"), "phrase").distinct().withColumn("key", F.monotonically_increasing_id())
    named = Tables(phrases.sparkSession, "anchors").save(named, "named")
    windows = named.mapInPandas(_phrase_windows, "key long, size int, h long")
    shared = windows.groupBy("size", "h").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", "h", "size")).alias("a")
    found = windows.join(shared.hint("merge"), ["size", "h"]).groupBy("key").agg(rarest)
    return found.join(named.hint("merge"), "key").select("a.size", "a.h", "phrase")


def bloom_filter(found: DataFrame, n: int) -> np.ndarray:
    """Bits, two per hash, packed in 64-bit words; the driver gets at most MOST_BITS / 64 words."""
    m = LEAST_BITS
    while m < min(n * BITS_PER_PHRASE, MOST_BITS):
        m *= 2
    places = F.array(F.col("h").bitwiseAND(m - 1), F.shiftrightunsigned("h", 32).bitwiseAND(m - 1))
    at = found.select(F.explode(places).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(m // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _scan(bits, sizes: tuple[int, ...], id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = bits.value
        top = np.uint64(len(words) * 64 - 1)
        for batch in batches:
            out: list[tuple] = []
            for own, text in zip(batch[id_col].tolist(), batch["y"]):
                data, seen = text.encode(), {s: [] for s in sizes}
                for start in range(0, max(len(data), 1), BLOCK):
                    for size, h in window_hashes(data[start : start + BLOCK + sizes[-1] - 1], sizes):
                        u = h.view(np.uint64)
                        near = h[_has(words, u & top)]
                        u = near.view(np.uint64)
                        seen[size].append(np.unique(near[_has(words, (u >> np.uint64(32)) & top)]))
                for size, parts in seen.items():
                    if parts:
                        h = np.unique(np.concatenate(parts))
                        out.append((own, size, h))
            if out:
                n = [len(h) for _, _, h in out]
                own = pd.Series([x[0] for x in out]).repeat(n).to_numpy()
                yield pd.DataFrame({id_col: own, "size": np.repeat(np.array([x[1] for x in out], dtype=np.int32), n), "h": np.concatenate([x[2] for x in out])})

    return run


def _look_up(anchored, id_col: str):
    """First places of phrases by tables per size: hashes, sorted, and the phrases of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = {size: (np.array(sorted(by), dtype=np.int64), [by[h] for h in sorted(by)]) for size, by in anchored.value.items()}
        sizes = tuple(sorted(tables))
        for batch in batches:
            own, phrases, places = [], [], []
            for i, text in zip(batch[id_col].tolist(), batch["y"]):
                data, tried = text.encode(), {s: set() for s in sizes}
                for start in range(0, max(len(data), 1), BLOCK):
                    for size, h in window_hashes(data[start : start + BLOCK + sizes[-1] - 1], sizes):
                        known = tables[size][0]
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        tried[size].update(at[known[at] == h].tolist())
                for size in sizes:
                    for at in tried[size]:
                        for phrase in tables[size][1][at]:
                            place = text.find(phrase) + 1
                            if place:
                                own.append(i)
                                phrases.append(phrase)
                                places.append(place)
            yield pd.DataFrame({id_col: pd.Series(own, dtype=batch[id_col].dtype), "phrase": pd.Series(phrases, dtype=object), "place": np.array(places, dtype=np.int32)})

    return run


def phrase_places(texts: DataFrame, phrases: DataFrame, id_col: str = "doc_id", look_up: bool = False) -> DataFrame:
    """id_col, phrase, place (from 1): the first occurrence of each phrase in each text (id_col, y) that holds it.

    Null texts hold nothing, empty phrases are nowhere; an id names one text.
    """
    spark = texts.sparkSession
    found = Tables(spark, "phrases").save(anchors(phrases), "anchors")
    of_size = {r["size"]: r["count"] for r in found.groupBy("size").count().collect()}
    sizes = tuple(sorted(of_size))
    if not sizes:
        return texts.select(id_col, F.lit("").alias("phrase"), F.lit(0).alias("place")).where("false")
    texts = texts.where("y is not null").select(id_col, "y")
    kind = dict(texts.dtypes)[id_col]
    if look_up and sum(of_size.values()) <= FEW_PHRASES and found.agg(F.sum(F.octet_length("phrase"))).first()[0] <= FEW_BYTES:
        few: dict[int, dict[int, list[str]]] = {}
        for size, h, phrase in found.select("size", "h", "phrase").collect():
            few.setdefault(size, {}).setdefault(h, []).append(phrase)
        return texts.mapInPandas(_look_up(spark.sparkContext.broadcast(few), id_col), f"{id_col} {kind}, phrase string, place int")
    bits = spark.sparkContext.broadcast(bloom_filter(found, sum(of_size.values())))
    windows = texts.mapInPandas(_scan(bits, sizes, id_col), f"{id_col} {kind}, size int, h long")
    pairs = windows.join(found.hint("merge"), ["size", "h"]).select(id_col, "phrase").distinct()
    met = pairs.join(texts.hint("merge"), id_col).withColumn("place", F.instr(F.col("y"), F.col("phrase")))
    return met.where("place > 0").select(id_col, "phrase", "place")


def earliest(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the hit of the smallest place, of equal ones that of the first alias (``alias_order``)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("place", "alias_order"))
    return hits.withColumn("rank", rank).where("rank = 1").drop("rank")
