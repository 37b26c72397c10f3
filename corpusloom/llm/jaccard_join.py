"""Exact Jaccard similarity join of whole texts on word shingles, in metric space.

1 - Jaccard is a metric.  The join works on distinct shingle sets (equal sets
form one class) and goes through two kinds of pivots.

* Singleton pivots.  A document with n shingles lies at the same distance,
  1 - 1/n, from its n singletons and at distance 1 from all others, so it sits
  on the border of n Voronoi regions; a global order of shingles breaks the
  tie.  A neighbour within distance t misses at most t*n of the shingles, so
  replicating a document into the first floor(t*n) + 1 regions is enough: any
  two linked documents meet in the region of their first common shingle.  The
  order puts shingles of more than ``region_cap`` documents last (the
  ``max_demoted`` most frequent of them, counted over all texts), so regions
  stay small; documents made of such shingles meet in their regions all the
  same.  Any order common to all documents keeps the join exact.
* Document pivots.  In each region the set with the smallest hashed id is the
  pivot and the others are compared with it.  Those within t form a star and
  are connected.  By the triangle inequality a set further than 2t from the
  pivot has no link into the star, so only the rim of the star, as far as the
  window |d(x,p) - d(y,p)| <= t reaches an outsider, goes on with the outsiders.
  The rest recurse with the next pivot, for ``rounds`` rounds or until at most
  ``region_cap`` sets of a region are in no star.  What is left is compared set
  against set, where both reach each other, their windows share enough and they
  are not connected yet.  Regions of many sets are dealt to several tasks.

Two linked sets first meet, in the order of shingles, so early in both that the rest holds
enough common shingles; so each entry reaches sets up to a certain size only, less with every
place in its own order, and a pair counts in a region only if both reach each other there.
A common shingle up to the end of the window that ends first lies in both windows, so two
sets share at most the longer rest behind the windows and the regions that both are in;
sets that cannot be linked with any other set of a region leave it before anything is compared.
A window shingle of one set can lie behind the window of the other, so a bound of one set
alone does not hold.

A set comparison counts whole sets.  Before texts are fetched, the number of
shared regions bounds the intersection from above and drops most candidates.

Defined results: a null or wordless text has no shingles and is linked with
nothing; repeated rows and equal texts are one class; fewer than k words make
one shingle; extra columns are ignored; a null id is allowed and never names a
component that has another id; no rows give no rows.  Shingles are compared by
64-bit hashes, equal sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch
from .words import groups, mix, windows, words_of

#: stands for a null id; the largest number, so that it is a component's root only if there is no other
NULL_ID = (1 << 63) - 1
BLOCK_KEYS = 1_000_000
HOT_ROWS = 2_000
BROADCAST_KEYS = 100_000


def shingle_sets(texts, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    for _, run in groups(texts, lower=True):
        w = words_of(run)
        for a, b in zip(w.first[:-1], w.first[1:]):
            if b - a >= k:
                yield np.unique(windows(w.hashes[a:b], k).view(np.int64))
            elif b > a:
                yield mix(windows(w.hashes[a:b], int(b - a)) + np.uint64(b - a)).view(np.int64)
            else:
                yield np.zeros(0, dtype=np.int64)


def digest(members: np.ndarray) -> bytes:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest()


def _describe(k: int):
    def run(frames):
        for f in frames:
            sets = [(len(s), digest(s)) for s in shingle_sets(f["text"], k)]
            yield pd.DataFrame({"id": f["id"], "n": [n for n, _ in sets], "digest": [d for _, d in sets]}).astype({"n": "int64"})

    return run


def _matching(k: int):
    """Rows (node, text) whose text has the node's set; ids may repeat with other texts."""

    def run(frames):
        for f in frames:
            sets = shingle_sets(f["text"], k)
            same = [len(s) == n and digest(s) == bytes(d) for s, n, d in zip(sets, f["n"], f["digest"])]
            yield f.loc[same, ["node", "text"]]

    return run


def window_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def reach(n: int, place, percent: int):
    """Largest set that a set of n can be linked with if their first common shingle is at ``place`` of its order: all common ones are from there on."""
    return (n - place) * (100 + percent) // percent - n


def _keys(members: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of shingles: equal shingles have equal keys, which is all that an order needs."""
    return members.view(np.uint64) >> np.uint64(64 - bits)


def _count(k: int, bits: int, buckets: int):
    """Documents per key of each batch, as sorted blocks per range of keys."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**bits / buckets)).astype(np.uint64)

    def run(frames):
        for f in frames:
            parts = [_keys(s, bits) for s in shingle_sets(f["text"], k)]
            if not parts:
                continue
            key, n = np.unique(np.concatenate(parts).astype(np.uint64 if bits > 32 else np.uint32), return_counts=True)
            cuts = [0, *np.searchsorted(key, edges.astype(key.dtype)).tolist(), len(key)]
            n = np.minimum(n, 2**32 - 1).astype(np.uint32)
            rows = [(b, key[x:y].tobytes(), n[x:y].astype(np.uint8).tobytes() if n[x:y].max() < 256 else n[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pd.DataFrame(rows, columns=["bucket", "keys", "counts"])

    return run


def _often(bits: int, cap: int):
    """Keys of more than ``cap`` documents, from blocks sorted by bucket; one bucket is held at a time."""
    kind = np.uint64 if bits > 32 else np.uint32

    def total(keys, counts):
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(counts))
        return pd.DataFrame({"key": key[n > cap].astype(np.int64), "c": n[n > cap].astype(np.int64)})

    def run(frames):
        now, keys, counts = None, [], []
        for f in frames:
            for bucket, key, n in zip(f["bucket"], f["keys"], f["counts"]):
                if bucket != now and keys:
                    yield total(keys, counts)
                    keys, counts = [], []
                now = bucket
                keys.append(np.frombuffer(key, dtype=kind))
                counts.append(np.frombuffer(n, dtype=np.uint8 if len(n) == len(keys[-1]) else np.uint32).astype(np.float64))
        if keys:
            yield total(keys, counts)

    return run


def _emit(k: int, percent: int, bits: int, buckets: int, demoted):
    """Blocks of window entries: those at demoted shingles apart (bucket below 0), others per range of shingles."""
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets) - 2.0**63).astype(np.int64)

    def run(frames):
        for f in frames:
            late_keys = demoted.value
            cells, owners, reaches, forced, nodes, sizes = [], [], [], [], [], []
            for i, s in enumerate(shingle_sets(f["text"], k)):
                if len(s) != f["n"].iat[i] or digest(s) != bytes(f["digest"].iat[i]):
                    continue
                key = _keys(s, bits)
                at = np.minimum(np.searchsorted(late_keys, key), max(len(late_keys) - 1, 0))
                late = late_keys[at] == key if len(late_keys) else np.zeros(len(s), dtype=bool)
                order = np.concatenate((s[~late], s[late]))[: window_size(len(s), percent)]
                cells.append(order)
                place = np.arange(len(order))
                reaches.append(reach(len(s), place, percent).astype(np.uint32))
                forced.append(place >= len(s) - late.sum())
                owners.append(np.full(len(order), len(nodes), dtype=np.uint32))
                nodes.append(f["node"].iat[i])
                sizes.append(len(s))
            if not cells:
                continue
            cell, owner, far, late = (np.concatenate(x) for x in (cells, owners, reaches, forced))
            node, size = np.array(nodes, dtype=np.int64), np.array(sizes, dtype=np.int64)
            rows = []
            if late.any():
                # any partition will do for them
                rows.append((-1 - int(node[0] % 1024), cell[late].tobytes(), owner[late].tobytes(), far[late].tobytes(), node.tobytes(), size.tobytes()))
            cell, owner, far = cell[~late], owner[~late], far[~late]
            order = np.argsort(cell)
            cell, owner, far = cell[order], owner[order], far[order]
            cuts = [0, *np.searchsorted(cell, edges).tolist(), len(cell)]
            for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if y > x:
                    used, own = np.unique(owner[x:y], return_inverse=True)
                    rows.append((b, cell[x:y].tobytes(), own.astype(np.uint32).tobytes(), far[x:y].tobytes(), node[used].tobytes(), size[used].tobytes()))
            yield pd.DataFrame(rows, columns=["bucket", "cells", "owners", "reaches", "nodes", "sizes"])

    return run


BLOCK = "bucket int, cells binary, owners binary, reaches binary, nodes binary, sizes binary"
ENTRY = "cell long, node long, n long, reach long, forced boolean"


def _shared(frames):
    """Entries of cells that two documents share (and all at demoted shingles); blocks come sorted by bucket."""

    def table(parts, forced):
        cell, node, size, far = (np.concatenate(x) for x in zip(*parts))
        keep = np.arange(len(cell))
        if not forced:
            keep = np.argsort(cell)
            same = np.diff(cell[keep]) == 0
            keep = keep[np.append(same, False) | np.append(False, same)]
        # an id that repeats with its text has entered its set more than once
        keep = keep[np.lexsort((node[keep], cell[keep]))]
        fresh = np.append(True, (np.diff(cell[keep]) != 0) | (np.diff(node[keep]) != 0))
        keep = keep[fresh[: len(keep)]]
        return pd.DataFrame({"cell": cell[keep], "node": node[keep], "n": size[keep], "reach": far[keep].astype(np.int64), "forced": np.full(len(keep), forced)})

    now, parts = None, []
    for f in frames:
        for bucket, cells, owners, reaches, nodes, sizes in f.itertuples(index=False, name=None):
            own = np.frombuffer(owners, dtype=np.uint32)
            part = (np.frombuffer(cells, dtype=np.int64), np.frombuffer(nodes, dtype=np.int64)[own], np.frombuffer(sizes, dtype=np.int64)[own], np.frombuffer(reaches, dtype=np.uint32))
            if bucket < 0:
                yield table([part], True)
                continue
            if bucket != now and parts:
                yield table(parts, False)
                parts = []
            now = bucket
            parts.append(part)
    if parts:
        yield table(parts, False)


def _compare(k: int):
    def run(frames):
        for f in frames:
            both = []
            a_sets, b_sets = shingle_sets(f["text_a"], k), shingle_sets(f["text_b"], k)
            for a, b in zip(a_sets, b_sets):
                both.append(len(np.intersect1d(a, b, assume_unique=True)))
            yield pd.DataFrame({"a": f["a"], "b": f["b"], "na": f["na"], "nb": f["nb"], "both": np.asarray(both, dtype=np.int64)})

    return run


class RepeatedIds(ValueError):
    """An id that several different texts carry."""


class JaccardJoin:
    """One run of the join over (id, text)."""

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int, percent: int, region_cap: int):
        self.k, self.percent, self.cap, self.spark = k, percent, region_cap, spark
        self.scratch = Scratch(spark, "jaccard")
        self.docs = docs

    def salted(self, rows: DataFrame, key: str) -> DataFrame:
        """Adds ways, the number of parts that the rows of a key are dealt to, and salt, the row's part.

        A key of at most HOT_ROWS rows has one part, so few keys have more: at most one in HOT_ROWS rows.
        """
        ways = F.ceil(F.col("c") / HOT_ROWS).cast("int").alias("ways")
        hot = rows.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > HOT_ROWS).select(key, ways)
        hot = self.scratch.save(hot, f"hot-{key}-{self.parts()}")
        out = rows.join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, key, "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
        return out.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("ways")).cast("int"))

    def parts(self) -> int:
        self.used = getattr(self, "used", 0) + 1
        return self.used

    @staticmethod
    def for_all_salts(rows: DataFrame) -> DataFrame:
        """Each row once for every salt of its key."""
        return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")

    def per_cell(self, members: DataFrame, *aggregates, keys: tuple[str, ...] = ("cell",)) -> DataFrame:
        """Aggregates of each cell, to be joined by the keys and salt."""
        return self.for_all_salts(members.groupBy(*keys).agg(*aggregates, F.max("ways").alias("ways")))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """(id, n, digest) of each row and (node, n, digest) of each distinct set."""
        sig = self.scratch.save(self.docs.mapInPandas(_describe(self.k), "id long, n long, digest binary"), "sig")
        node = F.coalesce(F.min("id"), F.lit(NULL_ID)).alias("node")
        reps = self.scratch.save(sig.where("n > 0").groupBy("digest", "n").agg(node), "reps")
        return sig, reps

    def texts(self, nodes: DataFrame) -> DataFrame:
        """Texts of nodes: all columns of ``nodes`` and the text of every row that has the node's id."""
        docs = self.docs.select(F.coalesce("id", F.lit(NULL_ID)).alias("node"), "text")
        return docs.join(nodes, "node")

    def entries(self, reps: DataFrame, max_demoted: int) -> DataFrame:
        """(cell, node, n, reach, ways, salt, met): window entries of the cells that two sets share."""
        # sets of one to three shingles have no link but to equal sets
        owners = reps.where("n > 3")
        total = reps.agg(F.sum("n")).first()[0] or 0
        bits = 32 if total < 1 << 30 else 48
        blocks = max(1, -(-total // BLOCK_KEYS))
        counts = self.docs.select("text").mapInPandas(_count(self.k, bits, blocks), "bucket int, keys binary, counts binary")
        counts = counts.repartition(blocks, "bucket").sortWithinPartitions("bucket")
        often = counts.mapInPandas(_often(bits, self.cap), "key long, c long")
        often = self.scratch.save(often, "often").orderBy(F.desc("c"), "key").limit(max_demoted)
        # a bounded table: which shingles are in it changes the order of regions, not the result
        keys = np.sort(often.select("key").toPandas()["key"].to_numpy(dtype=np.int64).astype(np.uint64))
        demoted = self.spark.sparkContext.broadcast(keys)
        blocks = max(1, -(-total // BLOCK_KEYS))
        emit = _emit(self.k, self.percent, bits, blocks, demoted)
        rows = self.texts(owners).mapInPandas(emit, BLOCK).repartition(max(blocks, 8), "bucket").sortWithinPartitions("bucket")
        found = self.scratch.save(rows.mapInPandas(_shared, ENTRY), "found")
        forced = found.where("forced").drop("forced")
        # only cells of demoted shingles can have many sets
        shared = found.where("not forced").select("cell", "node", "n", "reach", F.lit(1).alias("ways"), F.lit(0).alias("salt"))
        shared = self.scratch.save(shared.unionByName(self.of_two(self.salted(forced.distinct(), "cell"))), "shared")
        for i in range(2):
            shared = self.scratch.save(self.feasible(self.with_met(shared.drop("met")), placed=False), f"shared{i}")
        return shared

    def of_two(self, members: DataFrame) -> DataFrame:
        """Members of cells that have at least two."""
        twice = self.per_cell(members, F.count("*").alias("c")).where("c > 1").drop("c")
        return members.join(twice, ["cell", "salt"])

    def window_of(self, n):
        return n - F.floor((n * self.percent + 99) / 100).cast("long") + 1

    def with_met(self, shared: DataFrame) -> DataFrame:
        """Adds met: the regions in which a set meets others."""
        met = shared.groupBy("node").agg(F.count("*").alias("met"))
        return shared.join(met, "node")

    def most(self, n, m, met):
        """Upper bound of the intersection of sets of sizes n and m that share at most ``met`` regions."""
        return F.least(F.greatest(n - self.window_of(n), m - self.window_of(m)) + met, n, m)

    def can_link(self, n, met, m, rest):
        """Whether sets of sizes n and m that meet others in so many regions can be within t."""
        return self.most(n, m, F.least(met, rest)) * (100 + self.percent) >= (n + m) * self.percent

    def feasible(self, members: DataFrame, placed: bool = True) -> DataFrame:
        """Members of regions in which they can have a link.

        The region of two sets' first common shingle must lie within the reach of both; without ``placed``
        that is left out, so that all regions that two linked sets share stay and can be counted.  A set can be
        linked with one that is not larger up to what its rest and the regions it shares allow.  With a
        larger one the rest behind that one's window counts, which must be large enough for it.  Linked
        sets differ in size by 100 / percent at most, so they are in the same or in neighbouring steps of sizes.
        """
        p, n = self.percent, F.col("n")
        most = F.floor((n - self.window_of(n) + F.col("met")) * (100 + p) / p) - n
        step = F.floor(F.ln(n) / (log(100 / p) + 1e-6)).cast("int")
        own = F.col("reach") if placed else F.lit(1 << 62)
        about = members.withColumns({"most": most, "step": step, "own": own})
        steps = about.groupBy("cell", "step").agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.max("most").alias("far"), F.max("own").alias("own"), F.max("ways").alias("ways"))
        steps = self.per_cell(steps, F.collect_list(F.struct("step", "least", "largest", "far", "own")).alias("steps"))
        both = lambda s: (s["own"] >= n) & (s["least"] <= F.col("own"))
        below = lambda s: both(s) & s["step"].between(F.col("step") - 1, F.col("step")) & (s["least"] <= F.col("most")) & (s["largest"] * 100 >= n * p)
        needed = 100 * (n * p - F.col("met") * (100 + p))
        above = lambda s: both(s) & s["step"].between(F.col("step"), F.col("step") + 1) & (s["far"] >= n) & (s["largest"] * (p * p) >= needed) & (s["least"] * p <= n * 100)
        alike = F.least("most", "own") >= n
        kept = about.join(steps, ["cell", "salt"]).where(alike | F.exists("steps", below) | F.exists("steps", above)).drop("most", "step", "own", "steps")
        return self.of_two(kept)

    def near(self, na, nb, both):
        return both * 100 >= (na + nb - both) * self.percent

    def compare(self, pairs: DataFrame, marks: DataFrame, name: str) -> DataFrame:
        """(a, b, na, nb, both) of the pairs; both is the intersection's size, or an upper bound that already rules a link out."""
        left = marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
        right = marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
        shared = F.size(F.array_intersect("ca", "cb")).cast("long")
        na, nb = F.col("na"), F.col("nb")
        bounded = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", self.most(na, nb, shared).alias("both"))
        bounded = self.scratch.save(bounded, f"{name}-bound")
        chance = self.near(na, nb, F.col("both"))
        open_pairs = bounded.where(chance).drop("both")
        texts = self.pool
        full = open_pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        exact = full.mapInPandas(_compare(self.k), "a long, b long, na long, nb long, both long")
        return self.scratch.save(exact.distinct().unionByName(bounded.where(~chance)), name)

    def links(self, reps: DataFrame, shared: DataFrame, rounds: int) -> DataFrame:
        """Edges (a, b) that connect every group of linked sets.

        star is the pivot that a member is linked to; members of one star need no comparison.
        """
        placed = self.scratch.save(self.feasible(shared), "placed")
        nodes = placed.select("node").distinct()
        marks = self.scratch.save(shared.join(nodes, "node", "left_semi").groupBy("node", "n").agg(F.collect_list("cell").alias("cells")), "marks")
        # the texts that any comparison can need, fetched once
        owners = reps.join(marks.select("node"), "node", "left_semi")
        self.pool = self.scratch.save(self.texts(owners).mapInPandas(_matching(self.k), "node long, text string").dropDuplicates(["node"]), "pool")
        t = 1 - self.percent / 100 + 1e-9
        distance = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
        linked = self.near(F.col("na"), F.col("nb"), F.col("both"))
        kept = ["cell", "salt", "ways", "node", "n", "reach", "met", "star", "d"]
        members = placed.withColumns({"star": F.lit(None).cast("long"), "d": F.lit(None).cast("double")}).select(kept)
        edges, waiting = [], []
        known_roots = None
        for i in range(rounds):
            # the set with most in common with its region is the most central
            order = F.struct(((self.window_of(F.col("n")) - F.col("met")) / F.col("n") - 1).alias("o"), F.xxhash64("node").alias("h"), F.col("node").alias("p"), F.col("n").alias("pn"), F.col("met").alias("pmet"), F.col("reach").alias("preach"))
            pivots = self.per_cell(members, F.min(F.when(F.col("star").isNull(), order)).alias("pivot")).where("pivot is not null").select("cell", "salt", "pivot.p", "pivot.pn", "pivot.pmet", "pivot.preach")
            met = self.scratch.save(members.drop("d").join(pivots, ["cell", "salt"]).where("node <> p"), f"met{i}")
            pairs = met.where("n <= preach and pn <= reach").where(self.can_link(F.col("n"), F.col("met"), F.col("pn"), F.col("pmet"))).select(F.col("node").alias("a"), F.col("p").alias("b")).distinct()
            seen = self.compare(pairs, marks, f"seen{i}")
            edges.append(seen.where(linked).select("a", "b"))
            known = seen.select(F.col("a").alias("node"), F.col("b").alias("p"), distance.alias("d"), linked.alias("linked"))
            told = met.join(known, ["node", "p"], "left")
            most = self.most(F.col("n"), F.col("pn"), F.least("met", "pmet"))
            told = told.withColumn("d", F.coalesce("d", 1 - most / (F.col("n") + F.col("pn") - most))).withColumn("linked", F.coalesce("linked", F.lit(False)))
            told = self.scratch.save(told.withColumn("star", F.when(F.col("linked"), F.col("p")).otherwise(F.col("star"))), f"told-{i}")
            nearest = self.per_cell(told, F.min(F.when(~F.col("linked"), F.col("d"))).alias("nearest"))
            members = told.join(nearest, ["cell", "salt"]).where(~F.col("linked") | (F.col("d") >= F.col("nearest") - t)).select(kept)
            members, most_free = self.open_regions(self.feasible(members), f"members{i}")
            if most_free > self.cap and i % 3 == 0:
                # sets that other regions have connected count as stars, too
                roots = self.components(reduce(DataFrame.unionByName, edges), f"roots{i}")
                known_roots = len(edges), roots
                joined = members.drop("free").join(roots, "node", "left").withColumn("star", F.coalesce("root", "star")).drop("root")
                members, most_free = self.open_regions(joined, f"connected{i}")
            # regions with few sets outside stars are compared set against set, others divide again
            small = F.col("free") <= self.cap
            waiting.append(members.where(small).select(kept))
            members = members.where(~small).select(kept)
            if most_free <= self.cap:
                break
        else:
            waiting.append(members)
        # what is connected by now needs no comparison either
        same = known_roots is not None and known_roots[0] == len(edges)
        edges = reduce(DataFrame.unionByName, edges)
        roots = known_roots[1] if same else self.components(edges, "early")
        rest = reduce(DataFrame.unionByName, [w.withColumn("part", F.lit(i)) for i, w in enumerate(waiting)])
        rest = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = self.per_cell(rest, F.min("root").alias("lo"), F.max("root").alias("hi"), keys=("cell", "part")).where("lo < hi").drop("lo", "hi")
        rest = self.scratch.save(rest.join(apart, ["cell", "part", "salt"]), "rest")
        one = lambda r, v: rest.select("cell", "part", "salt", "ways", F.col("root").alias(r), F.col("node").alias(v), F.col("n").alias(f"n{v}"), F.col("met").alias(f"o{v}"), F.col("reach").alias(f"r{v}"))
        # pairs of sets that share a region and are not connected; of two roots the smaller comes first
        met = one("roota", "a").drop("ways").join(self.for_all_salts(one("rootb", "b")), ["cell", "part", "salt"]).where("roota < rootb and na <= rb and nb <= ra")
        pairs = met.where(self.can_link(F.col("na"), F.col("oa"), F.col("nb"), F.col("ob"))).select("a", "b").distinct()
        return edges.unionByName(self.compare(pairs, marks, "last").where(linked).select("a", "b"))

    def open_regions(self, members: DataFrame, name: str) -> tuple[DataFrame, int]:
        """Members of regions that are not one star, with free, the region's number of sets outside stars; and the largest free."""
        own = F.coalesce("star", "node")
        counts = self.per_cell(members, F.count_if(F.col("star").isNull()).alias("free"), F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo < hi").drop("lo", "hi")
        members = self.scratch.save(members.join(counts, ["cell", "salt"]), name)
        return members, members.agg(F.max("free")).first()[0] or 0

    def components(self, edges: DataFrame, name: str) -> DataFrame:
        """(node, root) by alternating large and small stars, where root is the least node.

        It ends when every node has one edge, to a node that has none: then all groups are stars.
        """
        flat = self.scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}0")
        i = 0
        while True:
            i += 1
            both = flat.union(flat.select("v", "u"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            # repeated edges go with the small stars
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            large = self.scratch.save(large, f"{name}{i}l")
            root = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(root, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            flat = self.scratch.save(small, f"{name}{i}")
            self.scratch.drop(f"{name}{i}l", f"{name}{i - 1}")
            # a node with two edges, or one that is both ends, is not settled
            ends = flat.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(flat.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
            loose = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0")
            if loose.isEmpty():
                return flat.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def run(self, rounds: int, max_demoted: int) -> DataFrame:
        """(id, n, component); raises ValueError if an id carries several texts."""
        sig, reps = self.classes()
        if reps.groupBy("node").count().where("count > 1").limit(1).count():
            raise RepeatedIds
        shared = self.entries(reps, max_demoted)
        roots = self.components(self.links(reps, shared, rounds), "final")
        group = reps.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
        # copies of one set are dealt to several tasks; rows without a set need no group
        rows = self.salted(sig.where("n > 0"), "digest")
        ways = rows.where("ways > 1").select("digest", "ways").distinct()
        group = self.for_all_salts(group.join(ways, "digest", "left").withColumn("ways", F.coalesce("ways", F.lit(1))))
        out = rows.join(group, ["digest", "salt"]).unionByName(sig.where("n = 0"), allowMissingColumns=True)
        component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.nullif("root", F.lit(NULL_ID)))
        return out.select("id", "n", component.alias("component"))


def jaccard_components(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    percent: int = 80,
    region_cap: int = 16,
    rounds: int = 4,
    max_demoted: int = 2_000_000,
) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (least id reachable by links)."""
    flat = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    try:
        out = JaccardJoin(spark, flat, k, percent, region_cap).run(rounds, max_demoted)
    except RepeatedIds:
        rows = Scratch(spark, "jaccard-rows").save(flat.withColumn("row", F.monotonically_increasing_id()), "rows")
        own = JaccardJoin(spark, rows.select(F.col("row").alias("id"), "text"), k, percent, region_cap).run(rounds, max_demoted)
        own = own.join(rows.select(F.col("row").alias("id"), F.col("id").alias("own")), "id")
        least = own.groupBy("component").agg(F.min("own").alias("least"))
        out = own.join(least, "component").select(F.col("own").alias("id"), "n", F.col("least").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
