"""Quality, toxicity, and the pipeline's stages."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lumenlog.llm import pii, quality, toxicity
from lumenlog.llm.common import store

SF = "/root/testdata/sf0.1"


def area(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / (y == 1).sum() / (y == 0).sum()


@pytest.mark.parametrize(("module", "op", "label", "least"), [(quality, quality.op10, "quality", 0.99), (toxicity, toxicity.op9, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, op, label, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r[label] for r in labels.collect()}
    rows = op(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD)
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert area(np.array([r.score for r in held]), np.array([y[r.doc_id] for r in held])) >= least


@pytest.mark.parametrize(("op", "label"), [(quality.op10, "quality"), (toxicity.op9, "toxic")])
def test_odd_tables(spark, edge, nothing, documents, labels, op, label):
    few = labels.where("false")
    assert op(edge, few).count() == edge.count()
    assert {r.score for r in op(edge, few).collect()} == {0.5 if label == "quality" else 0.0}
    assert op(nothing, labels).count() == 0
    one = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (6, None)], f"doc_id long, {label} int")
    assert {r.score for r in op(edge, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], f"doc_id long, {label} int")
    rows = op(edge, both).collect()
    assert len(rows) == edge.count() and not any(r.held_out for r in rows if r.doc_id is None)


@pytest.mark.parametrize(("op", "label"), [(quality.op10, "quality"), (toxicity.op9, "toxic")])
def test_labels_of_held_out_rows_teach_nothing(documents, labels, op, label):
    from pyspark.sql import functions as F

    from lumenlog.llm.common import held_out

    other = labels.withColumn(label, F.when(held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
    score = lambda x: dict(op(documents, x).select("doc_id", "score").collect())
    assert score(labels) == score(other)


def test_toxic_dictionaries_hold_what_toxic_text_repeats():
    rng = np.random.RandomState(0)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), rng.randint(3, 8)))
    ordinary = [" ".join(word() for _ in range(60)) for _ in range(150)]
    toxic = [" ".join([word() for _ in range(50)] + ["xo"] * 3 + ["grobbix", "k7_zz"] * 2) for _ in range(150)]
    model = toxicity.fit(ordinary + toxic, [0] * 150 + [1] * 150)
    assert all(o[:4] == t[:4] == b"\x37\xa4\x30\xec" for _, o, t in model.pairs)  # zstandard's own dictionaries
    scores = toxicity.Scorer(model).scores([" ".join([word() for _ in range(40)] + extra) for extra in ([], ["grobbix", "k7_zz", "grobbix"])])
    assert scores[0] < 0.5 < scores[1]
    assert toxicity.Scorer(model).scores([None, "", "x" * 200_000]).shape == (3,)


def test_fit_is_bounded_by_rows_and_bytes(spark):
    from lumenlog.llm.common import labelled, within_bytes

    docs = spark.createDataFrame([(i % 40, "t" * (1 + i % 40)) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, toxic int")
    rows = labelled(docs, marks, "toxic", 7)
    assert rows.count() == 7 and rows.select("doc_id").distinct().count() == 7
    few = within_bytes(rows, 60).collect()
    assert 0 < sum(len(r.text) for r in few) <= 60


def test_statistics_have_one_formula_for_all_lengths():
    texts = ["AB " + "1" * n + "c" for n in (58, 59, 60, 61, 62)]
    upper = [quality.statistics(t)[quality.NAMES.index("upper")] for t in texts]
    assert np.allclose(np.diff(upper), np.diff(upper)[0], atol=0.01)


def test_discriminant_equals_plain_densities():
    rng = np.random.RandomState(1)
    y = (rng.rand(300) < 0.4).astype(int)
    x = rng.randn(300, 4) * [1, 2, 3, 0.5] + y[:, None] * [1, 0, 2, 0.3]
    model = quality.fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    pooled = sum(np.cov(z[y == c].T, bias=True) * (y == c).sum() for c in (0, 1)) / 300

    def density(c):
        own = 0.8 * np.cov(z[y == c].T, bias=True) + 0.2 * pooled
        own = 0.95 * own + 0.05 * np.trace(own) / 4 * np.eye(4)
        d = z - z[y == c].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d) - 0.5 * np.linalg.slogdet(own)[1] + np.log((y == c).mean())

    assert np.allclose(model.log_odds(x), density(1) - density(0))


def leasts(docs):
    """The least ids of the groups that 5-word Jaccard similarities of 0.8 or more join."""
    words = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    group, ids = {i: i for i in sets}, sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and group[a] != group[b] and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return sorted(set(group.values()))


def test_stages(spark, documents, labels):
    sf = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "suffix_dedup", "pii", "packing"]
    docs, tables = documents, [documents]
    for _, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, sf))
        tables.append(docs)
    for t in tables[:-1]:
        assert t.dtypes == documents.dtypes
    good, distinct, fresh, hidden, packed = tables[1:]
    y = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in good.collect()}
    assert np.mean([i in kept for i in y if y[i]]) > 0.97 and np.mean([i in kept for i in y if not y[i]]) < 0.2
    assert sorted(r.doc_id for r in distinct.collect()) == leasts(good)
    texts = {r.doc_id: r.text for r in fresh.collect()}
    seen: dict = {}
    whole = {r.doc_id: (r.text or "").encode() for r in distinct.collect()}
    for i in sorted(whole):
        for p in range(len(whole[i]) - 49):
            seen.setdefault(whole[i][p : p + 50], i)
    for i, t in whole.items():  # what stays is what no smaller id has, but for cut characters
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        assert 0 <= len(texts[i].encode()) - int((~gone).sum()) <= 6 * (1 + int(np.diff(gone.astype(int)).clip(0).sum()))
    maker = pii.Pseudonyms()
    assert {r.doc_id: r.text for r in hidden.collect()} == {i: maker.scan(t)[0] for i, t in texts.items()}
    assert {r.doc_id for r in packed.collect()} == set(texts)


def test_stages_on_odd_tables(spark, edge, nothing, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (edge, nothing):
        for _, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, str(tmp_path))
            assert done.columns == docs.columns or "sequence_id" in done.columns
            assert done.count() >= (1 if docs is edge else 0)
            docs = store(done) if "text" in done.columns else docs
    assert Counter(c for c, _ in edge.dtypes) == Counter(edge.columns)
