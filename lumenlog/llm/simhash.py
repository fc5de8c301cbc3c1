"""SimHash near-duplicates by multi-index hashing.

Each text's 3-word shingles are hashed with XXH64 and vote on 64 bits. A fingerprint is
cut into two segments of 32 bits; two fingerprints within three bits agree in one of them
but for one bit, so every fingerprint looks up the 33 values of the ball around each of
its segments and full distances are verified. Links are between distinct fingerprints
only (copies share one row). One task joins up to ``FEW`` links; more components spread by
star contraction over checkpoints.

Defined results: null or wordless texts have fingerprint zero and link like any other;
null ids take part and never name a component unless all its ids are null; repeated rows
stay repeated; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import add_columns, map_batches, settle

BITS, SHINGLE, SEED, RADIUS, SEGMENTS = 64, 3, 42, 3, 2
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles that are hashed at once; bounds memory on very long texts.
STEP = 1 << 16
#: Links whose components one task finds at most, in some 110 MB; more are contracted by shuffles.
FEW = 1 << 20


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, n, STEP):
        part = words[lo : min(lo + STEP, n) + SHINGLE - 1]
        joined, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends.tolist()]
        m = min(STEP, n - lo)
        width = min(SHINGLE, len(part))
        hashes = [xxhash.xxh64_intdigest(joined[starts[i] : starts[i + width] - 1], SEED) for i in range(m)]
        votes += np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a signed long."""
    src = docs.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "fp": pa.array([fingerprint(t) for t in batch.column("text").to_pylist()], pa.int64())}

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, fp long")


def ball(width: int, radius: int) -> list[int]:
    """XOR masks of the Hamming ball of a radius over so many bits."""
    return [sum(1 << b for b in flips) for r in range(radius + 1) for flips in combinations(range(width), r)]


def signed(bits: int) -> Column:
    return F.lit(bits - (1 << BITS) if bits >> (BITS - 1) else bits).cast("long")


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints (column fp) within the radius.

    The join is by a shuffle whatever Spark expects: it takes exploded rows for no more
    than those that they come of, and would broadcast many millions through the driver.
    """
    width = BITS // segments
    masks = F.array(*[signed(m) for m in ball(width, radius // segments)])
    cut = lambda k: F.shiftrightunsigned("fp", k * width).bitwiseAND(signed((1 << width) - 1))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), cut(k).alias("key")) for k in range(segments)]))
    table = distinct.select("fp", parts.alias("p")).select(F.col("fp").alias("b"), "p.seg", "p.key")
    probes = table.select(F.col("b").alias("a"), "seg", "key", F.explode(masks).alias("m")).select("a", "seg", F.col("key").bitwiseXOR(F.col("m")).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.hint("merge").join(table.hint("merge"), ["seg", "key"]).where(near).select("a", "b").distinct()


def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root): each node of all the links (u, v) but those that are the least they reach."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    nodes, places = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), return_inverse=True)
    u, v = places.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(u, v)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    node = np.flatnonzero(root != np.arange(len(nodes)))
    for lo in range(0, len(node), STEP):
        part = node[lo : lo + STEP]
        yield pa.RecordBatch.from_pydict({"node": nodes[part], "root": nodes[root[part]]})


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): each node of the links (a, b) and the least node it reaches.

    One task joins up to ``FEW`` links: rounds of shuffles over as many partitions as the
    session has cost more than such links. More alternate large-star and small-star; the
    links of a round are checkpointed, and rounds end when a round changes nothing.
    """
    most = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = settle(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).coalesce(most))
    if edges.count() <= FEW:
        return settle(edges.coalesce(1).mapInArrow(joined_up, "node long, root long"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = settle(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def linked(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of distinct fingerprints (fp and others), and root: the least fingerprint that links reach."""
    roots = components(links(distinct, radius))
    return distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach from each row."""
    fps = settle(fingerprints(docs))
    # few nodes have links: only they are regrouped
    groups = linked(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), radius)
    least = groups.groupBy("root").agg(F.min("first").alias("component_id"))
    of = groups.join(least, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, near: Callable[[DataFrame], DataFrame] | None = None, key: Callable[[str | None], int] = fingerprint) -> DataFrame:
    """The rows of a table that name their component: one row of each, all its columns.

    Components are those within the radius, or those of ``near``, whose column fp is ``key``
    of the text. Where rows share an id, those of one component give the row of least hashed text.
    """
    names = docs.columns
    src = docs.toDF(*(f"c{i}" for i in range(len(names))))
    own_id, own_text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    found = settle(near(docs) if near else near_duplicates(docs, radius)).toDF("id", "of", "component")
    repeated = found.groupBy("id").count().where("count > 1").select(F.col("id").alias("twice"))
    naming = found.where(F.col("id").eqNullSafe(F.col("component")))
    lone = naming.join(repeated, F.col("id").eqNullSafe(F.col("twice")), "left_anti").select(F.col("id").alias("once"))
    alone = src.join(lone, F.col(own_id).eqNullSafe(F.col("once")), "left_semi")
    several = src.join(repeated, F.col(own_id).eqNullSafe(F.col("twice")), "left_semi")
    several = add_columns(several, own_text, lambda texts: {"fp": pa.array([key(t) for t in texts], pa.int64())}, "fp long")
    named = naming.distinct().join(several, F.col(own_id).eqNullSafe(F.col("id")) & (F.col("fp") == F.col("of")))
    first = Window.partitionBy("component", F.when(F.col("component").isNull(), F.col("fp"))).orderBy(F.xxhash64(own_text), "fp")
    chosen = named.withColumn("at", F.row_number().over(first)).where("at = 1").select(*src.columns)
    return alone.unionAll(chosen).toDF(*names)


def op7(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
