"""Exact repeats across documents by interval expansion on a Burrows-Wheeler transform.

A byte goes if it lies in a LENGTH-byte string that also starts in a document of smaller
id. Documents are dealt to blocks of bounded size by hash.

1. Every LENGTH-byte window has an anchor: the k-mer of least hash in it. Equal windows
   have equal anchors at equal places. A block sends each distinct anchor's hash once.
2. Buckets of hashes answer which anchors occur in more than one document.
3. A block cuts the fragments around those anchors, joins equal ones, and sends each
   with the least document id and the places where that document holds it. Windows of
   the block's other holders are already decided.
4. A bucket of fragments writes them as one text in which an anchor is a single symbol,
   sorts its suffixes to the depth that a window has in symbols, and takes the
   Burrows-Wheeler order. Breadth-first backward extension splits the intervals of all
   strings of one symbol, then of two, and so on: rows whose images under the LF mapping
   come from different intervals start new ones, which gives their common prefix lengths
   by increasing value; it stops at the window's depth. The rows of an interval left are
   equal windows, and the least id among them decides each.
5. Blocks mark and remove what was decided.

Anchors that very many documents hold are cut to single windows and dealt by the window's
content instead, so that no bucket grows with them; steps 4 and 5 are the same.

Defined results: null text counts as empty; a null id is smaller than all others; rows of
equal id never remove from each other; repeated rows stay rows; texts shorter than LENGTH
bytes lose nothing; a text of any length that a column can hold is judged whole; other
columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import tune
from lumenlog.llm.segments import spread

LENGTH, KMER = 50, 24
SIDE = LENGTH - KMER  # bytes that a window can have on a side of its anchor
DEPTH = SIDE + 1  # symbols of a window, its anchor being one
WIDTH = SIDE + LENGTH
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 3 << 20
#: Documents that hold an anchor, from which on it is dealt by window.
HOT = 20_000
SLICE = 1 << 20
POSITION_BITS = 21
LEAST_ID = -(1 << 63)
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def hash_words(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of rows given as columns of 64-bit words."""
    h = np.zeros(len(words[0]), np.uint64)
    for i, w in enumerate(words):
        h = (h ^ w) * MIX[i % 3]
        h ^= h >> np.uint64(31)
    h *= MIX[1]
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor, hash) of each run of windows with one anchor.

    ``data``: the documents' bytes, one after another; ``ends``: where each ends.
    """
    found: list[tuple[np.ndarray, ...]] = []
    raw = data.tobytes()
    for lo in range(0, max(0, len(data) - LENGTH + 1), SLICE):
        m = min(SLICE, len(data) - LENGTH + 1 - lo)
        word = np.ndarray((m + LENGTH - 8,), "<u8", raw, lo, (1,))
        n = m + SIDE
        h = hash_words([word[i : i + n] for i in range(0, KMER, 8)])
        low = np.uint64((1 << POSITION_BITS) - 1)
        key = (h & ~low) | np.arange(n, dtype=np.uint64)
        span = 1
        while span * 2 <= DEPTH:
            key = np.minimum(key[: len(key) - span], key[span:])
            span *= 2
        if span < DEPTH:
            key = np.minimum(key[: len(key) - (DEPTH - span)], key[DEPTH - span :])
        at = np.arange(lo, lo + m)
        ok = at + LENGTH <= ends[np.searchsorted(ends, at, side="right")]
        at, place = at[ok], (key[ok] & low).astype(np.int64)
        if not len(at):
            continue
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(place, prepend=-1) != 0))
        last = np.append(new[1:], len(at)) - 1
        found.append((at[new], at[last], place[new] + lo, h[place[new]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


class Block:
    """The documents of a block, in an order that does not depend on how they arrived."""

    def __init__(self, rows: pa.Table, id_at: int, text_at: int):
        ids = [LEAST_ID if i is None else i for i in rows.column(id_at).to_pylist()]
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in rows.column(text_at).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], dtype=np.int64)
        self.texts = [texts[i] for i in self.order]
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.data = np.frombuffer(b"".join(self.texts), dtype=np.uint8)

    def runs(self) -> tuple[np.ndarray, ...]:
        """first, last, anchor, 48-bit hash, document of each run."""
        first, last, anchor, h = anchors(self.data, self.ends)
        return first, last, anchor, h >> np.uint64(16), np.searchsorted(self.ends, first, side="right")


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs and the places where it does."""
    order = np.argsort(bucket, kind="stable")
    begin = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for lo, hi in zip(begin, np.append(begin[1:], len(order))):
        yield int(bucket[order[lo]]), order[lo:hi]


def narrow(x: np.ndarray) -> np.ndarray:
    """Places as 32-bit numbers, as 64-bit ones where a block is too long for that."""
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def known_anchors(block: Block, buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, hashes and how many ids of the block hold each)."""
    _, _, _, h, doc = block.runs()
    ids = block.ids[doc]
    order = np.lexsort((ids, h))
    h, ids = h[order], ids[order]
    if not len(h):
        return
    fresh = np.append(True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]))
    h = h[fresh]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    held = np.diff(np.append(start, len(h)))
    h = h[start]
    for b, part in dealt((h % np.uint64(buckets)).astype(np.int64)):
        several = np.flatnonzero(held[part] > 1)
        yield b, pickle.dumps((np.ascontiguousarray(h[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), several.astype(np.uint32), held[part][several].astype(np.uint32)), 5)


def six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shared_anchors(blocks: list[int], blobs: list[bytes], hot: int) -> Iterator[tuple[int, bytes]]:
    """(block, its hashes that other documents hold too, and those that very many hold)."""
    hashes, held = [], []
    for blob in blobs:
        raw, several, counts = pickle.loads(blob)
        hashes.append(six_bytes(raw))
        n = np.ones(len(hashes[-1]), np.int64)
        n[several] = counts
        held.append(n)
    owner = np.repeat(np.arange(len(blocks)), [len(x) for x in hashes])
    h, n = np.concatenate(hashes), np.concatenate(held)
    order = np.argsort(h, kind="stable")
    h, n, owner = h[order], n[order], owner[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    total = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(h))))
    keep = total > 1
    h, owner, total = h[keep], owner[keep], total[keep]
    order = np.argsort(owner, kind="stable")
    h, owner, total = h[order], owner[order], total[order]
    cut = np.searchsorted(owner, np.arange(len(blocks) + 1))
    for i, block in enumerate(blocks):
        part = slice(cut[i], cut[i + 1])
        if part.start < part.stop:
            yield block, pickle.dumps((h[part], h[part][total[part] > hot]), 5)


def within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    among = np.sort(among)
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def cut_fragments(data: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """One row of WIDTH bytes for each run: its bytes around the anchor, zero elsewhere."""
    padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[anchor]
    at = anchor[:, None] + np.arange(-SIDE, LENGTH)
    return np.where((at >= first[:, None]) & (at < last[:, None] + LENGTH), rows, 0).astype(np.uint8)


def row_hash(rows: np.ndarray, *more: np.ndarray) -> np.ndarray:
    words = np.zeros((len(rows), -(-WIDTH // 8) * 8), np.uint8)
    words[:, :WIDTH] = rows
    words = words.view("<u8")
    return hash_words([*(words[:, i] for i in range(words.shape[1])), *(m.astype(np.uint64) for m in more)])


def as_runs(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    windows = np.unique(windows)
    if not len(windows):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    new = np.flatnonzero(np.diff(windows, prepend=windows[0] - 2) != 1)
    return narrow(windows[new]), narrow(windows[np.append(new[1:], len(windows)) - 1])


def fragments(block: Block, replies: list[bytes], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(0, -1, decided windows) and (1, bucket, fragments to be compared)."""
    pairs = [pickle.loads(r) for r in replies]
    shared = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    hot = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.uint64)
    first, last, anchor, h, doc = block.runs()
    keep = within(h, shared)
    first, last, anchor, h, doc = first[keep], last[keep], anchor[keep], h[keep], doc[keep]
    if not len(first):
        return
    wide = within(h, hot)
    if wide.any():  # one fragment for each window
        n = last[wide] - first[wide] + 1
        at = spread(first[wide], n)
        first, last = np.concatenate([first[~wide], at]), np.concatenate([last[~wide], at])
        anchor, doc = np.concatenate([anchor[~wide], np.repeat(anchor[wide], n)]), np.concatenate([doc[~wide], np.repeat(doc[wide], n)])
        h, wide = np.concatenate([h[~wide], np.repeat(h[wide], n)]), np.append(np.zeros((~wide).sum(), bool), np.ones(len(at), bool))
    rows, left, right, ids = cut_fragments(block.data, first, last, anchor), anchor - first, last + SIDE - anchor, block.ids[doc]
    same = row_hash(rows, left, right)
    order = np.lexsort((first, ids, same))
    first, last, h, wide, rows, left, right, ids, same = (x[order] for x in (first, last, h, wide, rows, left, right, ids, same))
    new = np.append(True, (same[1:] != same[:-1]) | (rows[1:] != rows[:-1]).any(1) | (left[1:] != left[:-1]) | (right[1:] != right[:-1]))
    group = np.cumsum(new) - 1
    start = np.flatnonzero(new)
    holder = ids == ids[start][group]  # of the least id: to be compared with other blocks
    decided = ~holder
    yield 0, -1, pickle.dumps(as_runs(spread(first[decided], last[decided] - first[decided] + 1)), 5)
    places, held = first[holder], np.add.reduceat(holder.astype(np.int64), start)
    bucket = (np.where(wide[start], same[start], h[start] * MIX[0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    offset = np.cumsum(held) - held
    for b, part in dealt(bucket):
        at = start[part]
        yield 1, b, pickle.dumps((rows[at].tobytes(), left[at].astype(np.uint8), right[at].astype(np.uint8), ids[at], held[part].astype(np.uint32), narrow(places[spread(offset[part], held[part])])), 5)


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, its inverse) to a depth of DEPTH symbols at least."""
    n = len(text)
    rank, done = text.astype(np.uint64), 1
    if int(text.max()) < 1 << POSITION_BITS and n < 1 << POSITION_BITS:
        bits, ways = POSITION_BITS, 3
    else:
        bits, ways = 32, 2
    order = np.argsort(rank, kind="stable")
    while done < DEPTH:
        key = np.zeros(n, np.uint64)
        for i in range(ways):
            part = np.zeros(n, np.uint64)
            part[: max(0, n - i * done)] = rank[i * done :]
            key = (key << np.uint64(bits)) | part
        order = np.argsort(key)
        key = key[order]
        new = np.ones(n, np.uint64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        done *= ways
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse


def intervals(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each position of the text, the interval of the string of ``depth`` symbols there.

    Breadth-first backward extension, bounded by the depth: at level l the rows of the
    sorted suffixes are cut into the intervals of strings of l symbols. Extending an
    interval by a symbol c to the left sends its rows that the transform marks with c,
    under LF, to consecutive rows; two neighbouring rows stay together at level l + 1 only
    if they come from one interval. Rows that part there have a common prefix of length l.
    """
    order, inverse = suffix_order(text)
    came_from = inverse[(order + 1) % len(text)]  # the row that LF sends here
    starts = np.append(True, text[order][1:] != text[order][:-1])
    undecided = np.flatnonzero(~starts)
    for _ in range(1, depth):
        if not len(undecided):
            break
        interval = np.cumsum(starts, dtype=np.int32)
        part = interval[came_from[undecided]] != interval[came_from[undecided - 1]]
        starts[undecided[part]] = True
        undecided = undecided[~part]
    return np.cumsum(starts, dtype=np.int64)[inverse]


def least_holders(rows: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least id that holds each window of each fragment, where a fragment's windows start)."""
    n = len(rows)
    _, symbol = np.unique(np.ascontiguousarray(rows[:, SIDE : SIDE + KMER]).view(f"V{KMER}").ravel(), return_inverse=True)
    table = np.zeros((n, 2 * SIDE + 2), np.uint32)
    table[:, :SIDE] = rows[:, :SIDE]
    table[:, SIDE] = symbol.ravel() + 256
    table[:, SIDE + 1 : -1] = rows[:, SIDE + KMER :]
    table += 2
    table[:, -1] = 1
    column = np.arange(2 * SIDE + 2)
    used = (column >= SIDE - left[:, None]) & ((column <= SIDE + right[:, None]) | (column == 2 * SIDE + 1))
    text = table[used]
    lengths = left + right + 2
    begin, windows = np.cumsum(lengths) - lengths, left + right - SIDE + 1
    at = intervals(text)[spread(begin, windows)]
    of = np.repeat(ids, windows)
    order = np.argsort(at, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(of[order], start), np.diff(np.append(start, len(at))))
    return least, np.cumsum(windows) - windows


def compare(blocks: list[int], blobs: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(block, windows that a smaller id holds) of a bucket of fragments."""
    parts = [pickle.loads(b) for b in blobs]
    rows = np.frombuffer(b"".join(p[0] for p in parts), np.uint8).reshape(-1, WIDTH)
    left, right, ids, held, places = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(1, 6))
    owner = np.repeat(np.arange(len(blocks)), [len(p[1]) for p in parts])
    same = row_hash(rows, left, right)
    _, one, kind = np.unique(same, return_index=True, return_inverse=True)
    kind = kind.ravel()
    alike = (rows == rows[one[kind]]).all(1) & (left == left[one[kind]]) & (right == right[one[kind]])
    if not alike.all():  # colliding hashes: those rows stand for themselves
        odd = np.flatnonzero(~alike)
        kind[odd] = len(one) + np.arange(len(odd))
        one = np.append(one, odd)
    order = np.argsort(kind, kind="stable")
    start = np.flatnonzero(np.append(True, np.diff(kind[order]) != 0))
    least, begin = least_holders(rows[one], left[one], right[one], np.minimum.reduceat(ids[order], start))
    windows = left + right - SIDE + 1
    entry = np.repeat(np.arange(len(rows)), windows)
    step = spread(np.zeros(len(rows), np.int64), windows)
    gone = least[begin[kind[entry]] + step] < ids[entry]
    entry, step = entry[gone], step[gone]
    # every place where the entry's document holds the fragment
    offset = np.cumsum(held) - held
    times = held[entry]
    at = places[spread(offset[entry], times)] + np.repeat(step, times)
    block = np.repeat(owner[entry], times)
    for i, part in dealt(block):
        yield blocks[i], pickle.dumps(as_runs(at[part]), 5)


def removed(block: Block, blobs: list[bytes]) -> np.ndarray:
    """Which bytes of the block go."""
    edge = np.zeros(len(block.data) + 1, np.int32)
    for blob in blobs:
        first, last = pickle.loads(blob)
        np.add.at(edge, first.astype(np.int64), 1)
        np.add.at(edge, last.astype(np.int64) + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def deduplicate(docs: DataFrame, hot: int = HOT, whole_characters: bool = False) -> DataFrame:
    """All columns, then kept (the remaining bytes), removed_from, removed_to (spans of
    bytes), n_bytes, n_removed and n_spans. With ``whole_characters`` a character goes only
    if all its bytes do, so what remains is UTF-8."""
    spark = docs.sparkSession
    tune(spark)
    names, kinds = docs.columns, [t for _, t in docs.dtypes]
    id_at, text_at = names.index("doc_id"), names.index("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    src = docs.toDF(*(f"c{i}" for i in range(len(names))))
    src = src.withColumn("blk", F.pmod(F.xxhash64(f"c{id_at}", f"c{text_at}"), F.lit(blocks)))
    long_of = lambda rows, name: rows.column(name).to_pylist()

    def send(rows: pa.Table) -> pa.Table:
        b = rows.column("blk")[0].as_py()
        out = list(known_anchors(Block(rows, id_at, text_at), buckets))
        return pa.table({"bucket": pa.array([x for x, _ in out], pa.int64()), "blk": pa.array([b] * len(out), pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def answer(rows: pa.Table) -> pa.Table:
        out = list(shared_anchors(long_of(rows, "blk"), long_of(rows, "blob"), hot))
        return pa.table({"blk": pa.array([x for x, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def gather(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = list(fragments(Block(rows, id_at, text_at), long_of(replies, "blob"), buckets)) if len(rows) and len(replies) else []
        b = rows.column("blk")[0].as_py() if len(rows) else 0
        # decided windows travel with the fragments, as a bucket's answers
        return pa.table({"kind": pa.array([k for k, _, _ in out], pa.int32()), "bucket": pa.array([x if k else b % buckets for k, x, _ in out], pa.int64()), "blk": pa.array([b] * len(out), pa.int64()), "blob": pa.array([x for _, _, x in out], pa.binary())})

    def judge(rows: pa.Table) -> pa.Table:
        kind, blk, blob = long_of(rows, "kind"), long_of(rows, "blk"), long_of(rows, "blob")
        out = [(b, x) for k, b, x in zip(kind, blk, blob) if k == 0]
        asked = [i for i, k in enumerate(kind) if k == 1]
        if asked:
            out += compare([blk[i] for i in asked], [blob[i] for i in asked])
        return pa.table({"blk": pa.array([x for x, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    def take_out(rows: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({})
        block = Block(rows, id_at, text_at)
        gone = removed(block, long_of(flags, "blob"))
        if whole_characters and len(gone):
            start = np.flatnonzero((block.data & 0xC0) != 0x80)
            gone = np.repeat(np.logical_and.reduceat(gone, start), np.diff(np.append(start, len(gone))))
        kept, begins, stops, sizes = [], [], [], []
        at = 0
        for end in block.ends.tolist():
            own = gone[at:end]
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
            begins.append(edge[::2].tolist())
            stops.append(edge[1::2].tolist())
            kept.append(block.data[at:end][~own].tobytes())
            sizes.append(end - at)
            at = end
        rows = rows.take(pa.array(block.order, pa.int64())).drop_columns(["blk"])
        return pa.table({
            **{c: rows.column(c) for c in rows.column_names}, "kept": pa.array(kept, pa.binary()),
            "removed_from": pa.array(begins, pa.list_(pa.int64())), "removed_to": pa.array(stops, pa.list_(pa.int64())), "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()), "n_spans": pa.array([len(b) for b in begins], pa.int64()),
        })

    sent = src.groupBy("blk").applyInArrow(send, "bucket long, blk long, blob binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "blk long, blob binary")
    asked = src.groupBy("blk").cogroup(replies.groupBy("blk")).applyInArrow(gather, "kind int, bucket long, blk long, blob binary")
    flags = asked.groupBy("bucket").applyInArrow(judge, "blk long, blob binary")
    own = ", ".join(f"c{i} {t}" for i, t in enumerate(kinds))
    more = ["kept", "removed_from", "removed_to", "n_bytes", "n_removed", "n_spans"]
    schema = f"{own}, kept binary, removed_from array<long>, removed_to array<long>, n_bytes long, n_removed long, n_spans long"
    return src.groupBy("blk").cogroup(flags.groupBy("blk")).applyInArrow(take_out, schema).toDF(*names, *more)


def op4(docs: DataFrame) -> DataFrame:
    done = deduplicate(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
