"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; normaliser, metaspace marker, unigram scores or
BPE merges and byte fallback are rebuilt as a tokenizers pipeline. No piece holds a
marker after another character, so texts are cut before each run of markers, a batch's
distinct segments are encoded together in multithreaded calls, and a text's ids are its
segments' ids. Every whole text is compared with the sentencepiece library, and every
text's ids are decoded again.

Defined results: null text counts as empty and has no ids; null ids and repeated rows
stay; an empty table gives no rows; a text of any length is one row, encoded whole; other
columns are ignored; a model with user-defined symbols or pieces across markers is encoded
text by text, without segments.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import map_batches
from lumenlog.llm.segments import spread

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
RUN = re.compile(f"{MARK}+[^{MARK}]*")
THREADS = 2
#: Segments that are encoded as one text; ids that are decoded at once.
TOGETHER, AT_ONCE = 256, 1 << 20


class Spec(NamedTuple):
    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    unknown: int
    suffix: bool
    charsmap: bytes
    dummy_prefix: bool
    trim: bool


def wire(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message; values are numbers or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[at : at + n]
            at += n


def parse(path: str) -> Spec:
    """A SentencePiece model file; field numbers are those of its public schema."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for field, value in wire(raw):
        if field == 1:
            p = dict(wire(value))
            pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(wire(value))
        elif field == 3:
            normalizer = dict(wire(value))
    return Spec(pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), trainer.get(40, 0), bool(trainer.get(24, 0)), normalizer.get(2, b""), bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first, then by the pair's ids."""
    known = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind in (NORMAL, USER)}
    found = []
    for whole, score, kind in spec.pieces:
        if kind in (NORMAL, USER):
            for cut in range(1, len(whole)):
                a, b = known.get(whole[:cut]), known.get(whole[cut:])
                if a is not None and b is not None:
                    found.append((-score, a, b))
    return [(spec.pieces[a][0], spec.pieces[b][0]) for _, a, b in sorted(found)]


def rebuild(spec: Spec, normalise: bool = True):
    """The tokenizers pipeline of a model; without its normaliser for texts already normal."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    vocabulary = [(p, s) for p, s, _ in spec.pieces]
    if spec.kind == BPE:
        model = models.BPE({p: i for i, (p, _) in enumerate(vocabulary)}, merges(spec), unk_token=vocabulary[spec.unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        model = models.Unigram(vocabulary, unk_id=spec.unknown, byte_fallback=spec.byte_fallback)
    out = Tokenizer(model)
    out.add_tokens([AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER])
    if normalise:
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        steps += [normalizers.Strip(), normalizers.Replace(re_of(" {2,}"), " ")] if spec.trim else []
        steps += [normalizers.Prepend(" ")] if spec.dummy_prefix else []
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    strip = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


def re_of(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class Codec:
    """Encodes and decodes texts, and compares with the sentencepiece library."""

    def __init__(self, path: str):
        os.environ.update({"TOKENIZERS_PARALLELISM": "true", "RAYON_NUM_THREADS": str(THREADS)})
        import sentencepiece

        spec = self.spec = parse(path)
        self.peer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.full, self.bare = rebuild(spec), rebuild(spec, normalise=False)
        texts = [p for p, _, kind in spec.pieces if kind in (NORMAL, USER)]
        self.cut = not spec.suffix and not spec.charsmap and not spec.trim and spec.dummy_prefix and all(k != USER for _, _, k in spec.pieces) and not any(MARK in t.lstrip(MARK) for t in texts)
        self.marked = np.array([p.startswith(MARK) and kind == NORMAL for p, _, kind in spec.pieces])
        self.bytes_of = [
            bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
            for p, _, kind in spec.pieces
        ]
        self.joined, self.sizes = np.frombuffer(b"".join(self.bytes_of), np.uint8), np.array([len(x) for x in self.bytes_of])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def raw(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def segments(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each segment's begin, how many) of distinct segments, given without
        their first marker.

        Segments of one marker go many to a text: a piece that begins with a marker begins
        a segment. Where that does not add up, and with more markers, each goes alone.
        """
        plain = [i for i, k in enumerate(keys) if k and MARK not in k]
        alone = [i for i, k in enumerate(keys) if not k or MARK in k]
        groups = [plain[lo : lo + TOGETHER] for lo in range(0, len(plain), TOGETHER)]
        order, found, sizes = [], [], []
        for group, ids in zip(groups, self.raw(self.bare, [MARK + MARK.join([keys[i] for i in g]) for g in groups]), strict=True):
            ids = np.array(ids, np.uint32)
            begin = np.flatnonzero(self.marked[ids])
            if len(begin) == len(group) and begin[0] == 0:
                order += group
                found.append(ids)
                sizes.append(np.diff(begin, append=len(ids)))
            else:
                alone += group
        rest = self.raw(self.bare, [MARK + keys[i] for i in alone])
        ids = np.concatenate([*found, np.fromiter(chain.from_iterable(rest), np.uint32)])
        counts = np.concatenate([*sizes, np.array([len(x) for x in rest], np.int64)])
        starts, many = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        order = np.array(order + alone, np.int64)
        starts[order], many[order] = np.cumsum(counts) - counts, counts
        return ids, starts, many

    def parts(self, texts: list[str]) -> pa.ListArray:
        """The segments of each text, without their first markers."""
        spaced = pc.replace_substring(pa.array(texts, pa.large_string()), MARK, " ")
        several = pc.or_(pc.match_substring(spaced, "  "), pc.starts_with(spaced, " ")).to_pylist()
        out = pc.split_pattern(spaced, " ")
        if any(several) or "" in texts:
            cut = lambda t: [s[1:] for s in RUN.findall(MARK + t.replace(" ", MARK))] if t else []
            odd = pa.array([cut(t) if many or not t else None for t, many in zip(texts, several)], out.type)
            out = pc.if_else(odd.is_valid(), odd, out)
        return out

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, where each text's begin and the last's end)."""
        if not self.cut:
            own = [ids if t else [] for t, ids in zip(texts, self.raw(self.full, texts), strict=True)]
            return np.fromiter(chain.from_iterable(own), np.uint32), np.cumsum([0, *map(len, own)])
        parts = self.parts(texts)
        coded = parts.flatten().dictionary_encode()
        ids, starts, sizes = self.segments(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        before = np.concatenate([[0], np.cumsum(sizes[which])])
        ends = np.cumsum([0, *pc.list_value_length(parts).to_pylist()])
        return ids[spread(starts[which], sizes[which])], before[ends]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(packed ids, whether sentencepiece gives the same ids) of each text."""
        ids, at = self.ids(texts)
        return [(ids[a:b].astype("<u4").tobytes(), same) for a, b, same in zip(at, at[1:], self.agrees(texts, ids, at))]

    def agrees(self, texts: list[str], ids: np.ndarray, at: np.ndarray) -> list[bool]:
        return [ids[a:b].tolist() == own for a, b, own in zip(at, at[1:], self.peer.encode(texts, num_threads=1))]

    def plain(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the marker put before a text."""
        found = []
        for lo in range(0, len(ids), AT_ONCE):
            part = ids[lo : lo + AT_ONCE]
            found.append(self.joined[spread(self.starts[part], self.sizes[part])].tobytes())
        text = b"".join(found)
        return text[1:] if self.spec.dummy_prefix and text[:1] == b" " else text

    def decode(self, ids: np.ndarray) -> str:
        return self.plain(ids).decode("utf-8", "replace")

    def returns(self, texts: list[str], ids: np.ndarray, at: np.ndarray) -> list[bool]:
        """Whether each text's ids stand for that text."""
        return [self.plain(ids[a:b]) == t.encode() for a, b, t in zip(at, at[1:], texts)]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_crc32, round_trip, parity, whole_parity) of each row.

    ``round_trip``: decoding gives the text. ``parity``: the whole text has sentencepiece's
    ids; ``whole_parity`` is its older name.
    """
    src = docs.select("doc_id", "text")
    codec: list[Codec] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not codec:
            codec.append(Codec(model))
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids, at = codec[0].ids(texts)
        raw, same = memoryview(ids.astype("<u4").tobytes()), pa.array(codec[0].agrees(texts, ids, at), pa.bool_())
        return {
            "doc_id": batch.column("doc_id"),
            "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))),
            "n_tokens": pa.array(np.diff(at), pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])], pa.int64()),
            "round_trip": pa.array(codec[0].returns(texts, ids, at), pa.bool_()),
            "parity": same,
            "whole_parity": same,
        }

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean, whole_parity boolean")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give null text."""
    src = rows.select("doc_id", "ids")
    codec: list[Codec] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not codec:
            codec.append(Codec(model))
        texts = [None if x is None else codec[0].decode(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())}

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, text string")


def op5(docs: DataFrame, model: str) -> DataFrame:
    return encoded(docs, model).withColumn("all_known", F.coalesce(~F.array_contains("ids", 0), F.lit(True)))
