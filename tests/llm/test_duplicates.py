"""Fingerprints, SimHash components, suffix dedup, nearest neighbours, against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import ann, fingerprints, minhash, simhash, suffix_dedup


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return Counter((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows)))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_components(documents, edge, nothing):
    for docs in (documents, edge):
        assert Counter(map(tuple, simhash.op7(docs).collect())) == slow_components(pairs(docs))
    assert simhash.op7(nothing).count() == 0


def test_long_texts_in_steps(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize(("radius", "segments"), [(0, 1), (1, 2), (3, 2), (3, 4)])
def test_links_at_any_radius(spark, radius, segments):
    rng = np.random.RandomState(1)
    base = [int(x) for x in rng.randint(-(2**62), 2**62, 6)]
    prints = sorted({b ^ sum(1 << int(i) for i in rng.choice(63, rng.randint(0, 5), replace=False)) for b in base for _ in range(12)})
    got = set(map(tuple, simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, segments).collect()))
    assert got == {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius}


def test_links_are_not_broadcast(spark):
    prints = spark.range(2000).select(F.xxhash64("id").alias("fp")).groupBy("fp").count().select("fp")
    got = simhash.links(prints)
    got.collect()  # so that the plan is the one that ran
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chains_join(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101)]
    roots = dict(simhash.components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert roots == {i: 0 for i in range(1, 41)} | {101: 100}


@pytest.mark.parametrize("few", [simhash.FEW, 0])
def test_few_links_join_in_one_task(spark, monkeypatch, few):
    rng, group = np.random.RandomState(4), {}
    rows = [(int(a), int(b)) for a, b in np.sort(rng.randint(-(2**62), 2**62, 300)[rng.randint(0, 300, (220, 2))]) if a < b]
    rows += [*rows[:9], *zip(range(0, 60, 2), range(1, 60, 2)), *zip(range(1, 59, 2), range(60, 2, -2))]
    for a, b in rows:
        low, high = sorted((group.setdefault(a, a), group.setdefault(b, b)))
        group = {x: low if g == high else g for x, g in group.items()}
    monkeypatch.setattr(simhash, "FEW", few)
    spark.sparkContext.setJobGroup(f"few {few}", "")
    got = simhash.components(spark.createDataFrame([(min(x), max(x)) for x in rows], "a long, b long"))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"few {few}"))
    assert sorted(map(tuple, got.collect())) == sorted((x, g) for x, g in group.items() if x != g)
    assert (jobs <= 5) == (few > 0)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(edge, nothing):
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    found = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(edge).collect()}
    got = Counter(found[(r.doc_id, simhash.fingerprint(r.text))] for r in kept.collect())
    assert got == dict.fromkeys(set(found.values()), 1)
    assert simhash.one_of_each(nothing).count() == 0


def test_near_copies_beyond_the_radius_go(spark):
    rng = np.random.RandomState(2)
    base = [f"w{i}" for i in rng.randint(0, 500, 200)]
    edited = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(base))
    # 1 and 3 are near 0, 2 is not; 4 is near 3 only; 5 is far from all
    rows = [(0, " ".join(base)), (1, edited(50)), (2, edited(20, 60, 100, 140, 180)), (3, edited(30, 90)), (4, edited(30, 90, 130)), (5, "short text of its own here"), (6, edited(50).upper())]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.lower().split()]}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if near(a, b):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect())
    assert kept == sorted(set(group.values())) and {1, 3, 6}.isdisjoint(kept) and {0, 2, 5} <= set(kept)


def test_every_near_pair_of_a_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    own = {r.doc_id: minhash.shingles(r.text) for r in docs.collect()}
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    holds: dict = {}
    for i, s in own.items():
        for h in s.tolist():
            holds.setdefault(h, set()).add(i)
    pairs = {(min(a, b), max(a, b)) for ids in holds.values() for a in ids for b in ids if a != b}
    near = [(a, b) for a, b in pairs if minhash.similar(own[a].tobytes(), own[b].tobytes())]
    assert near and all(found[a] == found[b] for a, b in near)


def test_stage_links_by_simhash_with_an_exact_check(spark, monkeypatch):
    monkeypatch.setattr(minhash, "bands", lambda own: [])  # nothing but SimHash proposes
    rng = np.random.RandomState(2)
    words = [f"w{i}" for i in rng.randint(0, 500, 300)]
    most = "a " * 2000  # of whose one shingle the bits are, whatever follows
    rows = [(0, " ".join(words)), (1, " ".join([*words, *"uvwxy"])), (2, " ".join(words[150:])), (3, most + "one two three four five"), (4, most + "six seven eight nine ten")]
    bits = [simhash.fingerprint(t) & (2**64 - 1) for _, t in rows]
    like = lambda i, j: minhash.similar(minhash.shingles(rows[i][1]).tobytes(), minhash.shingles(rows[j][1]).tobytes())
    assert 0 < (bits[0] ^ bits[1]).bit_count() <= 3 and like(0, 1) and (bits[3] ^ bits[4]).bit_count() <= 3 and not like(3, 4)
    kept = corpus_pipeline.distinct_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3, 4}


def test_one_of_each_of_shared_shingles(edge, nothing):
    near = lambda docs: simhash.one_of_each(docs, near=minhash.near_duplicates, key=minhash.key)
    kept = near(edge)
    found = {(r.doc_id, r.fp): r.component_id for r in minhash.near_duplicates(edge).collect()}
    got = Counter(found[(r.doc_id, minhash.key(r.text))] for r in kept.collect())
    assert kept.columns == edge.columns and got == dict.fromkeys(set(found.values()), 1)
    assert near(nothing).count() == 0


def slow_removal(rows):
    """Texts' bytes and which of them go."""
    raw = [(-(2**63) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in raw:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    out = []
    for i, t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        out.append((t, gone))
    return out


def small(edge):
    return edge.where("doc_id is null or doc_id != 4")


@pytest.mark.parametrize(("blocks", "hot"), [(8 << 20, 20_000), (3000, 20_000), (3000, 2), (3000, 0)])
def test_suffix_dedup(documents, edge, monkeypatch, blocks, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", blocks)
    for docs in (documents.limit(60).cache(), small(edge)):
        rows = pairs(docs)
        want = Counter()
        for (i, _), (t, gone) in zip(rows, slow_removal(rows)):
            spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want[(i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
        done = suffix_dedup.deduplicate(docs, hot=hot)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r[len(docs.columns)])).hexdigest()) for r in done.collect()) == want
        assert done.columns[: len(docs.columns)] == docs.columns


def test_suffix_dedup_query(edge, nothing):
    rows = pairs(edge)  # with the very long text
    want = Counter()
    for (i, _), (t, gone) in zip(rows, slow_removal(rows)):
        want[(i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    assert Counter(map(tuple, suffix_dedup.op4(edge).collect())) == want
    assert suffix_dedup.op4(nothing).count() == 0


def test_removal_at_whole_characters(spark):
    shared = "é" * 40
    docs = spark.createDataFrame([(1, "x" + shared + "日本"), (2, "yy" + shared + "日曜")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.deduplicate(docs, whole_characters=True).collect()}
    assert kept == {1: "x" + shared + "日本", 2: "yy曜"}


def test_intervals_equal_plain_comparison():
    rng = np.random.RandomState(5)
    text = rng.randint(1, 4, 400).astype(np.uint32)
    at = suffix_dedup.intervals(text, 5)
    windows = [tuple(text[i : i + 5]) for i in range(396)]
    assert all((at[i] == at[j]) == (windows[i] == windows[j]) for i in range(396) for j in range(0, 396, 7))


def test_fingerprints(documents, edge, nothing):
    rows = sorted(pairs(documents))
    texts = [t or "" for _, t in rows]
    got = {r.doc_id: r for r in fingerprints.op3(documents).collect()}
    assert len(got) == len(rows)
    bits = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    for n, (i, t) in enumerate(rows):
        following, r = texts[(n + 1) % len(texts)], got[i]
        k = len(texts[n]) // 4
        edited = texts[n][: len(texts[n]) - k] + following[:k]
        assert r.n_chars == len(texts[n]) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == 1 - bits(r.fingerprint, r.edited_fingerprint) / 128
        assert r.near_next == 1 - bits(r.fingerprint, got[rows[(n + 1) % len(rows)][0]].fingerprint) / 128
        assert r.n_near == sum(bits(r.fingerprint, o.fingerprint) <= 3 for o in got.values()) - 1
    prints = {}
    for n, (i, _) in enumerate(rows):
        assert prints.setdefault(texts[n], got[i].fingerprint) == got[i].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 0.7 > 0.6 > np.mean([r.near_next for r in got.values()])
    assert sorted(str(r.doc_id) for r in fingerprints.op3(edge).collect()) == sorted(str(i) for i, _ in pairs(edge))
    assert fingerprints.op3(nothing).count() == 0


def test_fingerprint_plan_is_native(documents):
    plan = fingerprints.op3(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_block_tables(spark, radius):
    rng = np.random.RandomState(2)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(5)]
    prints = [b ^ sum(1 << int(i) for i in rng.choice(128, rng.randint(0, 7), replace=False)) for b in base for _ in range(15)]
    prints += prints[:4]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints], "f1 long, f2 long")
    got = {((r.f2 & (2**64 - 1)) << 64) | (r.f1 & (2**64 - 1)): r.n_near for r in fingerprints.near(df, radius).collect()}
    assert got == {p: sum((p ^ q).bit_count() <= radius for q in prints) - 1 for p in prints}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, list int, cls int, v int")


def slow_nearest(rows, k=5, every=50):
    rows = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows]
    out = {}
    for i, v in rows:
        if i % every == 0:
            near = sorted((-(v @ w) / np.linalg.norm(v) / np.linalg.norm(w), j) for j, w in rows if j != i)[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def as_lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_nearest_equals_brute_force_on_small_tables(spark):
    rng = np.random.RandomState(0)
    rows = [(i, rng.randn(8).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[50][1]) for i in range(12)]  # equal vectors: ties go to smaller ids
    bad = [(2000, None), (2050, [0.0] * 8), (2100, [float("nan")] + [1.0] * 7), (2150, [float("inf")] + [1.0] * 7), (2200, [1.0] * 3), (2250, []), (None, [1.0] * 8), (2300, [None] + [1.0] * 7)]
    got, want = as_lists(ann.op2(vectors(spark, rows + bad))), slow_nearest(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-14)


def test_few_and_no_vectors(spark):
    assert as_lists(ann.op2(vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]))) == {0: [(1, 0.0)]}
    assert ann.op2(vectors(spark, [(0, [1.0, 0.0])])).count() == 0
    assert ann.op2(vectors(spark, [])).count() == 0


def test_recall_with_graph_and_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 8)
    monkeypatch.setattr(ann, "BEAM", 24)
    monkeypatch.setattr(ann, "PART", 16)
    rng = np.random.RandomState(4)
    centers = rng.randn(30, 16)
    rows = [(i, (centers[i % 30] + 0.4 * rng.randn(16)).tolist()) for i in range(3000)]
    got, want = as_lists(ann.op2(vectors(spark, rows))), slow_nearest(rows)
    assert np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 5 for q in want]) >= 0.9


@pytest.mark.parametrize(("spread", "most"), [(0.35, 0.05), (3.0, 0.5)])
def test_recall_and_share_read_at_default_settings(spread, most):
    rng = np.random.RandomState(0)
    n = 50_000
    x = ann.unit(rng.randn(1000, 64)[np.arange(n) % 1000] + spread * rng.randn(n, 64))
    f = x.astype(np.float32)
    index = ann.build(f)
    lists: list[list[int]] = [[] for _ in index.centroids]
    for lo in range(0, n, 1000):
        for i, own in enumerate(ann.lists_of(index, f[lo : lo + 1000]), lo):
            for k in own:
                lists[k].append(i)
    asked = rng.permutation(n)[:200]
    found = read = 0
    for i, own in zip(asked, ann.lists_for(index, f[asked], np.array([len(p) for p in lists]), 24)):
        score = x @ x[i]
        score[i] = -9
        held = set().union(*(lists[k] for k in own))
        found, read = found + len(held & set(np.argsort(-score)[:5].tolist())), read + len(held)
    assert found / 1000 >= 0.9 and read / 200 / n < most


def test_double_vectors_keep_their_precision(spark):
    rng = np.random.RandomState(3)
    rows = [(i, (rng.randn(6) * 10.0 ** rng.choice([-200, 0, 250])).tolist()) for i in range(120)]
    got = as_lists(ann.op2(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    for q in (0, 50, 100):
        v = {i: np.array(w) / np.abs(w).max() for i, w in rows}
        score = {i: float(v[q] @ w / np.linalg.norm(v[q]) / np.linalg.norm(w)) for i, w in v.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [i for i, _ in got[q]] == want and np.allclose([s for _, s in got[q]], [score[i] for i in want], atol=1e-14, rtol=0)


def slow_print(text):
    """The 128 bits by single votes of hashed words and pairs of words."""
    words = re.split("[ \t\n\x0b\f\r]+", text.lower())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    seeded = lambda h: xxhash.xxh64_intdigest((1).to_bytes(4, "little"), h)
    terms = [(xxhash.xxh64_intdigest(w, 42), min(len(w), 12)) for w in words]
    terms += [(xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)), 6) for a, b in zip(words, words[1:]) if b]
    total = sum(n for _, n in terms)
    return tuple(signed(sum((2 * sum(n for h, n in terms if of(h) >> i & 1) > total) << i for i in range(64))) for of in (lambda h: h, seeded))


def test_fingerprint_bits_equal_single_votes(documents):
    rows = documents.limit(25).cache()
    texts = {r.doc_id: r.text or "" for r in rows.collect()} | {-1: "", -2: "one", -3: " a  b\tc ", -4: "x " * 300}
    got = {r.doc_id: (r.f1, r.f2) for r in fingerprints.votes(rows.sparkSession.createDataFrame(list(texts.items()), "doc_id long, text string"), ["doc_id"], "text").collect()}
    assert got == {i: slow_print(t) for i, t in texts.items()}
