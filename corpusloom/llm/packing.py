"""Cost-balanced packing of documents into training sequences.

A sequence costs ``linear * n + quadratic * n^2`` per packed piece of n tokens (attention
stays inside a document).  Within a block of documents, descending pieces go to
the sequence of lowest cost with remaining capacity; a piece that fits nowhere
is cut at the sequence with most room.  The sequences of a block have exactly its tokens as capacity: as many
full ones as go, then powers of two, which need no padding.

Each task packs its own documents in bounded blocks while it tokenizes them, so
tokens are never shuffled or stored.  A document's ids are those of its white-
space separated words, since the tokenizer never joins words; words seen before
are looked up, and new ones without case and enclosing marks if that is known.
``sequence_id`` carries the partition in its upper bits.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; extra columns are ignored; no rows give no pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 800_000
ENCODE_WORDS = 4096
#: ASCII marks that may enclose a word; an apostrophe is none, as it can belong to the word
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: spaces to str.split that the tokenizer does not take for spaces
NO_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def is_letters(word: str) -> bool:
    """Latin letters only, in lower case: one run of letters to the tokenizer."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: its own if it has one, others in order from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts from a cache of words.

    The tokenizer must drop white space between words, fold case, and split words
    into runs of letters and runs of marks, as ``word_bpe_49k.json`` does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ids: dict[str, bytes] = {}
        self.letters = byte_letters()

    def encode(self, text: str | None, end_id: int) -> np.ndarray:
        words: list[str] = []
        if isinstance(text, str):
            odd = any(c in text for c in NO_SPACES)
            words = [w for w in re.split(r"[^\S\x1c-\x1f]+", text) if w] if odd else text.split()
        known = self.ids
        new = set(words).difference(known)
        if new:
            if len(known) + 2 * len(new) > CACHE_WORDS:
                known.clear()
                new = set(words)
            self._learn(new)
        return np.frombuffer(b"".join([known[w] for w in words]) + array("I", [end_id]).tobytes(), dtype="<u4")

    def _marks(self, run: str) -> bytes:
        found = self.ids.get(run)
        if found is None:
            found = self.ids[run] = array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()
        return found

    def _learn(self, new: set[str]) -> None:
        known, tokenize, letters, rest = self.ids, self.tokenizer.model.tokenize, self.letters, []
        for w in new:
            low = w.lower()
            core = low.strip(MARKS)
            # "<|" may begin a special token
            if not is_letters(core) or "<|" in w:
                rest.append(w)
                continue
            ids = known.get(core)
            if ids is None:
                # a run of letters goes to the model as it is
                raw = core if core.isascii() else core.encode().decode("latin-1").translate(letters)
                ids = known[core] = array("I", [t.id for t in tokenize(raw)]).tobytes()
            if len(core) < len(low):
                a = low.index(core)
                before, after = low[:a], low[a + len(core) :]
                ids = (self._marks(before) if before else b"") + ids + (self._marks(after) if after else b"")
            known[w] = ids
        for i in range(0, len(rest), ENCODE_WORDS):
            part = rest[i : i + ENCODE_WORDS]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = array("I", e.ids).tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One per Python worker: later tasks of the worker find the words of earlier ones."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def capacities(tokens: int, size: int) -> list[int]:
    """Full sequences, then powers of two: exactly ``tokens`` in all."""
    return [size] * (tokens // size) + [1 << b for b in range(size.bit_length() - 1, -1, -1) if tokens % size >> b & 1]


def assign(lengths: list[int], size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of all pieces of a block."""
    room = capacities(sum(lengths), size)
    used = [0] * len(room)
    todo = [(-min(n - a, size), d, a) for d, n in enumerate(lengths) for a in range(0, n, size)]
    heapq.heapify(todo)
    fitting = [(0.0, s) for s in range(len(room))]
    heapq.heapify(fitting)
    # pieces come in descending order: a sequence without room waits, by its room, until one fits
    waiting: list[tuple[int, float, int]] = []
    out = []
    while todo:
        n, d, a = heapq.heappop(todo)
        n = -n
        while waiting and -waiting[0][0] >= n:
            _, cost, s = heapq.heappop(waiting)
            heapq.heappush(fitting, (cost, s))
        while fitting and room[fitting[0][1]] - used[fitting[0][1]] < n:
            cost, s = heapq.heappop(fitting)
            heapq.heappush(waiting, (used[s] - room[s], cost, s))
        if fitting:
            cost, s = heapq.heappop(fitting)
        else:
            # nowhere is room for the whole piece: it is cut at the sequence with most room
            _, cost, s = heapq.heappop(waiting)
        put = min(n, room[s] - used[s])
        out.append((d, a, put, s, used[s]))
        used[s] += put
        if put < n:
            heapq.heappush(todo, (put - n, d, a + put))
        if used[s] < room[s]:
            heapq.heappush(fitting, (cost + linear * put + quadratic * put * put, s))
    return out


def _pack(path: str, size: int, end_id: int, linear: float, quadratic: float, block_tokens: int):
    def run(frames):
        tokenizer = tokenizer_of(path)
        base = TaskContext.get().partitionId() << 34
        ids: list[np.ndarray] = []
        docs: list = []

        def flush():
            nonlocal base
            pieces = assign([len(x) for x in ids], size, linear, quadratic)
            rows = [(docs[d], a, n, zlib.crc32(ids[d][a : a + n].tobytes()), len(ids[d]), base + s, at) for d, a, n, s, at in pieces]
            base += 1 + max((s for *_, s, _ in pieces), default=0)
            ids.clear()
            docs.clear()
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            return out.astype({"doc_id": "Int64"})

        held = 0
        for f in frames:
            for doc, text in zip(f["doc_id"].astype("object").where(f["doc_id"].notna(), None), f["text"]):
                x = tokenizer.encode(text, end_id)
                ids.append(x)
                docs.append(None if doc is None else int(doc))
                held += len(x)
                if held >= block_tokens:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 4096,
    end_id: int = 2,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
    block_tokens: int = 4_000_000,
) -> DataFrame:
    """One row per piece; ``size`` must be a power of two."""
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return flat.mapInPandas(_pack(tokenizer_path, size, end_id, linear, quadratic, block_tokens), PIECES)
