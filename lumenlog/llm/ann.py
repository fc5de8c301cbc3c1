"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by balanced halving. They stay in memory as a graph
of near neighbours that a best-first beam searches, for vectors and queries alike. A
vector goes to the list of its nearest centroid and, if it lies near a boundary, to
others almost as near in directions not yet covered. A query reads the lists whose
centroids are within a ratio of the distance of the nearest, and more until those must
hold k vectors besides its own: few lists where vectors form clusters, LISTS of them where
they lie at random. Equal vectors share one entry that names their smallest ids; lists
are read in parts of bounded size; cosines are computed in double precision.

Defined results: vectors that are null, zero, of another length than most, or hold null
or non-finite components take no part, nor do null ids; of a repeated id the copies count
as rows and stand by themselves, none of them a candidate of its own id; fewer candidates
than asked for give fewer rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import map_batches, settle, tune

K = 5
#: Vectors that the centroids are fitted on at most, and sampled vectors for a centroid.
#: A table of over SAMPLE vectors has SAMPLE / LIST centroids, and longer lists.
SAMPLE, LIST = 262_144, 32
DEGREE, BEAM, ENTRIES = 24, 192, 32
COPIES, NEAR = 4, 1.15  # lists of a vector at most, and how much farther than the nearest
#: The ratio of distances that selects a query's lists, and lists of a query at most.
RATIO, LISTS = 1.6, 160
#: Vectors and queries of one part of a list.
PART = 4_096
QUERIES_EVERY = 50


class Index(NamedTuple):
    """Centroids and the graph between them; small enough for every worker."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, times powers of two that keep their squares finite."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def halve(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Balanced halving: split at the median along the line between two means."""
    groups, done = [np.arange(len(x))], []
    while groups:
        g = groups.pop()
        if len(g) <= leaf:
            done.append(g)
            continue
        part = x[g]
        a, b = part[0], part[int(np.argmin(part @ part[0]))]
        for _ in range(4):
            side = part @ (a - b) > np.median(part @ (a - b))
            if side.all() or not side.any():
                break
            a, b = part[side].mean(0), part[~side].mean(0)
        order = np.argsort(part @ (a - b), kind="stable")
        groups += [g[order[: len(g) // 2]], g[order[len(g) // 2 :]]]
    return done


def build(sample: np.ndarray, size: int = LIST) -> Index:
    """Centroids of unit vectors and, for each, edges to near centroids and a few far ones."""
    x = unit(sample).astype(np.float32)
    c = unit(np.array([x[g].mean(0) for g in halve(x, max(1, min(size, len(x))))])).astype(np.float32)
    n, degree = len(c), min(DEGREE, len(c) - 1)
    graph = np.zeros((n, degree + min(4, n)), np.int32)
    rng = np.random.RandomState(0)
    for lo in range(0, n, 1024):
        near = c[lo : lo + 1024] @ c.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -9
        if degree:
            graph[lo : lo + 1024, :degree] = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        graph[lo : lo + 1024, degree:] = rng.randint(0, n, (len(near), graph.shape[1] - degree))
    return Index(c, graph, rng.permutation(n)[: min(ENTRIES, n)].astype(np.int32))


def search(index: Index, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, cosines) of the nearest found for each row of unit vectors, nearest first.

    Best-first search of the graph for many rows at once: each round expands the nearest
    unexpanded members of every row's beam, until all beams are expanded. A graph of at most
    two beams is looked at whole, with the same result or a better one.
    """
    c, n = index.centroids, len(index.centroids)
    beam = min(beam, n)
    if n <= 2 * beam:  # the beam would hold most of the graph
        score = x @ c.T
        order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(score, order, 1)
    rows = np.arange(len(x))[:, None]
    seen = np.zeros((len(x), n), bool)
    ids = np.repeat(index.entries[None], len(x), 0)
    seen[rows, ids] = True
    score = np.einsum("qd,qkd->qk", x, c[ids])
    open_ = np.ones_like(ids, bool)
    while True:
        best = np.where(open_, score, -np.inf)
        pick = np.argpartition(-best, min(3, best.shape[1] - 1), axis=1)[:, :4]
        live = np.take_along_axis(best, pick, 1) > -np.inf
        if not live.any():
            break
        np.put_along_axis(open_, pick, False, 1)
        new = index.graph[np.take_along_axis(ids, pick, 1)].reshape(len(x), -1)
        fresh = np.repeat(live, index.graph.shape[1], 1) & ~seen[rows, new]
        order = np.argsort(new, axis=1, kind="stable")
        ordered = np.take_along_axis(new, order, 1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        fresh &= ~twice
        seen[rows, new] = True
        near = np.where(fresh, np.einsum("qd,qkd->qk", x, c[new]), -np.inf)
        ids, score, open_ = np.hstack([ids, new]), np.hstack([score, near]), np.hstack([open_, fresh])
        if ids.shape[1] > beam:
            keep = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            ids, score, open_ = (np.take_along_axis(v, keep, 1) for v in (ids, score, open_))
        open_ &= score > -np.inf
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)


def apart(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def lists_of(index: Index, x: np.ndarray) -> list[list[int]]:
    """Posting lists of each vector: the nearest, and near ones that no chosen one covers."""
    ids, score = search(index, x, 32)
    far = apart(score)
    out = []
    for own, d in zip(ids, far):
        chosen = [int(own[0])]
        for k, dist in zip(own[1:], d[1:]):
            if len(chosen) == COPIES or dist > NEAR * d[0] + 1e-6:
                break
            if (apart(index.centroids[chosen] @ index.centroids[k]) > dist).all():
                chosen.append(int(k))
        out.append(chosen)
    return out


def lists_for(index: Index, x: np.ndarray, sizes: np.ndarray, least: int) -> list[list[int]]:
    """Lists that each query reads."""
    ids, score = search(index, x)
    far = apart(score)
    out = []
    for i, (own, d) in enumerate(zip(ids, far)):
        chosen, held = [], 0
        if sizes[own].sum() < least:  # what the beam reached is too small: all lists, nearest first
            own = np.argsort(-(index.centroids @ x[i]), kind="stable")
            d = apart(index.centroids[own] @ x[i])
        for k, dist in zip(own, d):
            if held >= least and (len(chosen) >= LISTS or dist > RATIO * d[0] + 1e-6):
                break
            if sizes[k]:
                chosen.append(int(k))
                held += int(sizes[k])
        out.append(chosen)
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix of their own precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    q, v = scaled(q), scaled(v)
    return (q @ v.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None])


def kind_of(vectors: DataFrame) -> str:
    """Floats stay floats; anything else is compared as doubles."""
    kind = dict(vectors.dtypes)["embedding"]
    return kind if kind == "array<float>" else "array<double>"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part."""
    v = F.col("embedding").cast(kind_of(vectors))
    fine = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def nearest(vectors: DataFrame, k: int = K, every: int = QUERIES_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id the
    number divides, among all other rows."""
    tune(vectors.sparkSession)
    rows, kind = usable(vectors), kind_of(vectors)
    # equal vectors: one class, its id the least one; only its k + 1 least ids can be results
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    classes = settle(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "v", "ids"))
    total = classes.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, total))
    picked = classes.where(F.pmod(F.xxhash64("cls"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("cls")).limit(SAMPLE).select("v").toArrow()
    if not total:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = build(matrix(picked["v"]))

    def post(batch: pa.RecordBatch) -> dict:
        v = matrix(batch.column("v"))
        lists = lists_of(index, unit(v).astype(np.float32))
        row = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        return {"list": pa.array([k for x in lists for k in x], pa.int32()), "cls": batch.column("cls").take(row), "v": batch.column("v").take(row)}

    postings = settle(map_batches(classes.select("cls", "v"), post, f"list int, cls long, v {kind}"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in postings.groupBy("list").count().collect():  # one row for each centroid
        sizes[r["list"]] = r["count"]
    parts = np.maximum(1, -(-sizes // PART))
    queries = rows.where(F.col("vec_id") % every == 0)
    asked = settle(queries.groupBy("v").agg(F.min("vec_id").alias("q")))
    # at least k + 1 classes: they hold k candidates besides the query's own row
    least = (k + 1) * COPIES

    def ask(batch: pa.RecordBatch) -> dict:
        v = matrix(batch.column("v"))
        lists = lists_for(index, unit(v).astype(np.float32), sizes, least)
        each = [(i, k, p) for i, x in enumerate(lists) for k in x for p in range(parts[k])]
        row = pa.array([i for i, _, _ in each], pa.int64())
        return {"list": pa.array([k for _, k, _ in each], pa.int32()), "part": pa.array([p for _, _, p in each], pa.int32()), "q": batch.column("q").take(row), "qv": batch.column("v").take(row)}

    wanted = settle(map_batches(asked.select("q", "v"), ask, f"list int, part int, q long, qv {kind}"))
    blocks = np.ones(len(index.centroids), np.int64)
    for r in wanted.where("part = 0").groupBy("list").count().collect():
        blocks[r["list"]] = -(-r["count"] // PART)
    table = lambda x: F.element_at(F.lit(x.astype(int).tolist()), F.col("list") + 1)
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("q"), table(blocks)).cast("int"))
    held = postings.withColumn("part", F.pmod(F.xxhash64("cls"), table(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), (table(blocks) - 1).cast("int"))))

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        empty = {"q": pa.array([], pa.int64()), "cls": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not len(q) or not len(v):
            return pa.table(empty)
        vectors, names, cls = matrix(v.column("v")), q.column("q").to_numpy(), v.column("cls").to_numpy()
        order = np.argsort(cls, kind="stable")
        vectors, cls = vectors[order], cls[order]
        out = []
        asks = matrix(q.column("qv"))
        for lo in range(0, len(names), 512):
            score = cosines(asks[lo : lo + 512], vectors)
            best = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]  # ties to the smaller class id
            out.append((np.repeat(names[lo : lo + 512], best.shape[1]), cls[best.ravel()], np.take_along_axis(score, best, 1).ravel()))
        a, b, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"q": a, "cls": b, "score": c})

    keys = ["list", "part", "block"]
    found = wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(compare, "q long, cls long, score double")
    found = found.groupBy("q", "cls").agg(F.max("score").alias("score"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "cls")
    found = found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1)
    named = found.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # the least k + 1 ids of a query's own class besides: any query of the class leaves one of them out
    short = named.withColumn("at", F.row_number().over(near)).where(F.col("at") <= k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    each = queries.join(asked.select("v", "q"), "v").select(F.col("vec_id").alias("query_id"), "q")
    rows_of = each.join(short, "q").select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    return rows_of.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op2(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)
