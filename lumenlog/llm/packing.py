"""Best-fit packing of tokenised documents by bin completion.

Only the histogram of piece lengths, at most one row for each length up to the capacity,
goes to the driver. There a branch and bound fills bins around the largest length left:
it enumerates undominated fillings, prunes by the waste that a better packing may have,
and starts from a best-fit-decreasing incumbent. A filling is used as often as the counts
allow, so a plan has about as many kinds of sequence as there are lengths, at any size of
the corpus. Pieces are then numbered within their length and look their place up.

Defined results: null text is empty and has its end token only; null ids stay; repeated
rows are packed as separate documents; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import map_batches, settle

CAPACITY, END_ID = 1024, 2
#: Nodes of the branch and bound, and fillings that each of them tries.
NODES, FILLINGS = 4_000, 6
#: Every so many levels a node also completes its packing by best fit.
TAIL = 32
#: Characters of white space in a row that the fast core is given at most: its pattern fails on about a million.
SPACES = 100_000
#: Pieces that one task numbers at most, about.
NUMBERED = 100_000
# The byte-level pre-tokenizer's pattern, and the characters for bytes without a printable one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_SPACE = re.compile(rf"\s{{{SPACES}}}")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    The file's vocabulary is in order of its merges, so its ids are ranks; a core that
    merges by ranks gives the library's ids several times faster. Texts that hold one of
    the file's added tokens or very long white space go to the library itself, and so do
    those on which the core fails.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in model["added_tokens"]]
        spare = iter(range(256, 512))
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(next(spare)): b for b in range(256) if b not in PRINTABLE}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in self.added}
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if not any(t in text for t in self.added) and not (len(text) > SPACES and LONG_SPACE.search(text)):
            try:
                return self.core.encode_to_numpy(text).astype("<u4").tobytes()
            except ValueError:  # the pattern's engine gave up
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document cut to the capacity."""
    src = docs.select("doc_id", "text")
    encoder: list[Encoder] = []
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        if not encoder:
            encoder.append(Encoder(tokenizer))
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            ids = encoder[0](text or "") + end
            n = len(ids) // 4
            at = 0
            for k in range(-(-n // capacity)):
                size = (n % capacity or capacity) if k == 0 else capacity
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                at += size
        return {"doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


class Sequences(NamedTuple):
    """A kind of sequence: its lengths, largest first, and how many of it there are."""

    lengths: tuple[int, ...]
    times: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: total size, and lengths that exclude each other."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // capacity)
    for k in range(0, capacity // 2 + 1):
        large = int(counts[capacity - k + 1 :].sum())
        middle = slice(capacity // 2 + 1, capacity - k + 1)
        half, room = int(counts[middle].sum()), int((counts[middle] * (capacity - sizes[middle])).sum())
        small = slice(k, capacity // 2 + 1)
        best = max(best, large + half + max(0, -(-(int((counts[small] * sizes[small]).sum()) - room) // capacity)))
    return best


def batch(counts: np.ndarray, lengths: tuple[int, ...]) -> int:
    """How often a filling can be used."""
    sizes, uses = np.unique(lengths, return_counts=True)
    return int((counts[sizes] // uses).min())


def best_fit(counts: np.ndarray, capacity: int) -> list[Sequences]:
    """Best-fit decreasing on counts of lengths."""
    counts, plan = counts.copy(), []
    while counts.any():
        room, chosen, left = capacity, [], counts.copy()
        while room and (fits := np.flatnonzero(left[: room + 1])).size:
            chosen.append(int(fits[-1]))
            left[fits[-1]] -= 1
            room -= int(fits[-1])
        times = batch(counts, tuple(chosen))
        plan.append(Sequences(tuple(chosen), times))
        np.subtract.at(counts, chosen, times)
    return plan


def fillings(counts: np.ndarray, room: int, limit: int, steps: int = 400) -> list[tuple[int, ...]]:
    """Undominated fillings of a room, least waste first.

    One length that fills the room exactly dominates every other filling; a filling that
    leaves space for a length still in stock is dominated by the one with it.
    """
    if room == 0 or not counts[: room + 1].any():
        return [()]
    if counts[room]:
        return [(room,)]
    found: dict[tuple[int, ...], int] = {}
    left, taken, spent = counts.copy(), [], 0

    def search(room: int, top: int) -> None:
        nonlocal spent
        spent += 1
        sizes = np.flatnonzero(left[: min(room, top) + 1])
        smallest = np.flatnonzero(left[: room + 1])
        if not sizes.size:
            if not smallest.size:
                found.setdefault(tuple(taken), room)
            return
        exact = sizes[-1] == room
        for s in sizes[::-1][: 1 if exact else 24]:
            if spent > steps or sum(w == 0 for w in found.values()) >= limit:
                return
            taken.append(int(s))
            left[s] -= 1
            search(room - int(s), int(s))
            left[s] += 1
            taken.pop()

    search(room, room)
    return sorted(found, key=lambda f: (found[f], len(f), tuple(-x for x in f)))[:limit]


def plan_sequences(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> list[Sequences]:
    """Few sequences for counts[length] pieces of each length up to the capacity."""
    total = int((counts * np.arange(len(counts))).sum())
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    fewest = sum(p.times for p in best)
    stack: list[tuple[np.ndarray, list[Sequences], int, int]] = [(counts.copy(), [], 0, 0)]
    while stack and nodes and fewest > bound:
        left, plan, used, waste = stack.pop()
        nodes -= 1
        if waste > (fewest - 1) * capacity - total:  # a packing with one bin less wastes no more than this
            continue
        stock = np.flatnonzero(left)
        if not stock.size:
            if used < fewest:
                best, fewest = plan, used
            continue
        if len(plan) % TAIL == 1:
            tail = best_fit(left, capacity)
            if (n := used + sum(p.times for p in tail)) < fewest:
                best, fewest = plan + tail, n
        largest = int(stock[-1])
        left[largest] -= 1
        options = fillings(left, capacity - largest, FILLINGS)
        left[largest] += 1
        for rest in reversed(options):
            lengths = (largest, *rest)
            times = batch(left, lengths)
            after = left.copy()
            np.subtract.at(after, list(lengths), times)
            stack.append((after, plan + [Sequences(lengths, times)], used + times, waste + times * (capacity - sum(lengths))))
    return best


def places(plan: list[Sequences]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of runs of pieces, their sequence less that number, and their offset."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for kind in plan:
        offset = 0
        for n in kind.lengths:
            first = taken.get(n, 0)
            runs.setdefault(n, []).append((first, sequence - first, offset))
            taken[n] = first + kind.times
            offset += n
        sequence += kind.times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. ``cut`` is read several times: settle it first."""
    rows = cut.groupBy("length").count().collect()  # at most one row for each length up to the capacity
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows:
        counts[r["length"]] = r["count"]
    where = places(plan_sequences(counts, capacity))
    salts = max(8, -(-int(counts.max(initial=0)) // NUMBERED) * 8)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own)).join(first, ["length", "salt"])
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own") - 1).alias("number"))

    def run(batch: pa.RecordBatch) -> dict:
        length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            starts, shift, off = where[int(n)]
            run_of = np.searchsorted(starts, number[at], side="right") - 1
            sequence[at], offset[at] = number[at] + shift[run_of], off[run_of]
        return {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}

    return map_batches(numbered, run, f"doc_id {dict(cut.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(settle(pieces(docs, tokenizer)))
