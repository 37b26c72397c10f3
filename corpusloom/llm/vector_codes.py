"""Compression of vectors into codes of 16 parts by Lloyd's method with heaps.

A vector of integers is cut into parts; each part position has a codebook and a
part's code is its nearest entry.  After a scan a part keeps one number, its
slack: the lower bound of its distance to all other entries less the upper bound
of that to its own, plus the drift of its entry so far.  When entries move, the
drift of an entry grows by its own step and the largest step of the others, and
a part whose slack the drift has not reached cannot have changed its entry.  In
a batch of a task the parts of an entry form a heap by slack; parts are popped
while drift reaches them and only those are compared with all entries, exactly.

Sums of parts per entry are added up inside the tasks; a round sends at most one
row per part and entry of each batch.  Codebooks have a fixed size; the driver
moves the entries.  Slacks and codes are written between rounds, so a lost
executor costs one pass.

Distances are exact: in doubles while all squares stay below 2**53, else in
Python's integers.  Defined results: vectors that are null or hold null or
non-finite components are dropped; floors and errors beyond 64 bits are the largest
or least 64-bit integer; vectors shorter than the longest, or than the next multiple of
the number of parts, go on with zeros; fewer vectors than entries give as many
entries; rows that repeat an id count each (first vectors: by id, nulls last, then
by vector); null labels are one group; extra columns do not matter; no vectors
give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import attach_totals
from .store import Scratch, bounded_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS_AT_ONCE = 2048
LARGEST = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v) of the vectors that are kept."""
    v = F.col(vector_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(v.isNotNull() & F.forall(v, finite)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))


class Codebooks:
    """Entries of each part position and how far they have drifted."""

    def __init__(self, first: np.ndarray, exact_doubles: bool):
        self.entries = first  # (parts, entries, width), Python integers
        self.drift = np.zeros(first.shape[:2])
        self.exact_doubles = exact_doubles

    def moved(self, counts: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Each entry at the floor of the mean of its parts; unused ones stay."""
        out = Codebooks(self.entries.copy(), self.exact_doubles)
        for (p, e), (n, sums) in counts.items():
            out.entries[p, e] = [s // n for s in sums]
        step = np.array([[math.sqrt(sum(int(d) ** 2 for d in row)) for row in part] for part in out.entries - self.entries])
        for p, steps in enumerate(step):
            most = np.array([max(np.delete(steps, e), default=0.0) for e in range(len(steps))])
            out.drift[p] = self.drift[p] + (steps + most) * (1 + 1e-9)
        return out

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(c)) for c in self.entries.ravel()).encode()).hexdigest()

    def _numbers(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) if self.exact_doubles else x.astype(object)

    def distances(self, x: np.ndarray, p: int) -> np.ndarray:
        """Squared distances of parts at position p to all entries."""
        a, c = self._numbers(x), self._numbers(self.entries[p])
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]

    def own_distances(self, x: np.ndarray, p: int, codes: np.ndarray) -> np.ndarray:
        gap = self._numbers(x) - self._numbers(self.entries[p])[codes]
        return (gap * gap).sum(axis=1)

    def scan(self, x: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry, the first of equal ones, and slack of each part."""
        codes, slacks = [], []
        for at in range(0, len(x), ROWS_AT_ONCE):
            d = self.distances(x[at : at + ROWS_AT_ONCE], p)
            best = d.argmin(axis=1)
            near = np.sqrt(d[np.arange(len(d)), best].astype(np.float64))
            d[np.arange(len(d)), best] = np.inf
            far = np.sqrt(d.min(axis=1).astype(np.float64))
            codes.append(best)
            slacks.append(np.where(np.isinf(far), np.inf, far - near - 1e-9 * (1 + far + near)) + self.drift[p][best])
        return np.concatenate(codes), np.concatenate(slacks)

    def violated(self, p: int, codes: np.ndarray, slacks: np.ndarray) -> list[int]:
        """Rows whose slack the drift of their entry has reached: the tops of the entries' heaps."""
        popped: list[int] = []
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(self.entries.shape[1] + 1))
        for e, (start, stop) in enumerate(zip(ends[:-1], ends[1:])):
            rows = order[start:stop]
            heap = list(zip(slacks[rows].tolist(), rows.tolist()))
            heapify(heap)
            drift = self.drift[p, e]
            while heap and heap[0][0] <= drift:
                popped.append(heappop(heap)[1])
        return popped


def _stack(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width), shorter vectors filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), parts * width), dtype=np.int64)
    out[np.arange(parts * width) < lengths[:, None]] = column.flatten().to_numpy()
    return out.reshape(len(column), parts, width)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    dtype = {"code": np.uint8, "slack": np.float64}[name]
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=dtype).reshape(batch.num_rows, -1)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _assigned(books: Codebooks, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, codes and slacks of a batch under these codebooks."""
    parts, _, width = books.entries.shape
    x = _stack(batch.column("v"), parts, width)
    again = "code" in batch.schema.names
    codes = _column(batch, "code").astype(np.int64) if again else np.zeros((len(x), parts), dtype=np.int64)
    slacks = _column(batch, "slack").copy() if again else np.zeros((len(x), parts))
    for p in range(parts):
        rows = books.violated(p, codes[:, p], slacks[:, p]) if again else np.arange(len(x))
        if len(rows):
            codes[rows, p], slacks[rows, p] = books.scan(x[rows, p], p)
    return x, codes, slacks


def _assign(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, codes, slacks = _assigned(books, batch)
                same = [batch.column(c) for c in ("vec_id", "label", "v")]
                yield pa.RecordBatch.from_arrays([*same, _bytes(codes.astype(np.uint8)), _bytes(slacks)], ["vec_id", "label", "v", "code", "slack"])

    return run


def _sums(parts: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, codes = _stack(batch.column("v"), parts, width), _column(batch, "code")
            rows = []
            for p in range(parts):
                for e in np.unique(codes[:, p]).tolist():
                    own = x[codes[:, p] == e, p]
                    # sums of a batch of 64-bit integers may be longer
                    sums = [str(sum(c)) for c in own.T.tolist()]
                    rows.append({"part": p, "entry": e, "n": len(own), "sums": sums})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]))

    return run


def _finish(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, codes, _ = _assigned(books, batch)
                errors = sum(books.own_distances(x[:, p], p, codes[:, p]) for p in range(x.shape[1]))
                shown = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), shown, pa.array([min(int(e), LARGEST) for e in errors], pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error, label_error, codebooks_sha256 of every vector that is kept."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "codes")
    flat = scratch.save(quantised(vectors, id_col, vector_col, label_col, scale), "vectors")
    longest, high, low = flat.agg(F.max(F.size("v")), F.max(F.array_max("v")), F.min(F.array_min("v"))).first()
    width = max(1, -(-(longest or 0) // parts))
    most = max(high or 0, -(low or 0))
    first = [r.v + [0] * (parts * width - len(r.v)) for r in flat.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    start = np.array(first, dtype=object).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = Codebooks(start, exact_doubles=4 * width * most**2 < 2**53)

    kinds = dict(flat.dtypes)
    head = f"vec_id {kinds['vec_id']}, label {kinds['label']}"
    state = flat
    for i in range(rounds):
        state = scratch.save(state.mapInArrow(_assign(books), f"{head}, v array<long>, code binary, slack binary"), f"round{i}")
        partial = state.select("v", "code").mapInArrow(_sums(parts, width), "part int, entry int, n long, sums array<string>")
        total = [F.sum(F.col("sums")[c].cast("decimal(38,0)")).alias(f"c{c}") for c in range(width)]
        met = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()
        books = books.moved({(r.part, r.entry): (r.n, [int(r[f"c{c}"]) for c in range(width)]) for r in met})
    coded = scratch.save(state.mapInArrow(_finish(books), f"{head}, code string, error long"), "coded")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST)).cast("long").alias("label_error"), F.count("*").alias("n"))
    out = attach_totals(scratch, coded, by_label, "label", "label_error")
    return out.withColumn("codebooks_sha256", F.lit(books.digest()))
