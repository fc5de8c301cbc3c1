"""Toxicity by compression distance to zstandard dictionaries.

A window is a word between spaces, without marks around it (a long one is cut into
overlapping parts), in UTF-16 so that a match of a few letters outweighs zstandard's fixed costs. zstandard trains pairs of
dictionaries, one on windows of toxic text and one on windows of ordinary text, each pair
on windows of its own drawing. A window's distance is the difference of its compressed
lengths under the two, summed over the pairs: what a single pair happens to hold or to
lack evens out. Most windows of a toxic text are ordinary, so some pairs are trained again:
the toxic dictionary on those windows of toxic text that lie farther on its side than most
ordinary ones, the ordinary dictionary with the ordinary windows that lie there too.

What a distance says, for a window of so many letters, is calibrated as a log-likelihood
ratio, and how many windows of a document pass thresholds of it gives a probability; both
are fitted on a quarter of the labelled rows that no dictionary has seen.

Defined results: null and wordless texts are scored as documents without windows; texts of
any length are scored whole; null ids are not held out; repeated rows stay; an empty table
gives no rows; without training rows of both classes every score is the share of label 1
(0 if there are no labels); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import held_out, labelled, map_batches, within_bytes
from lumenlog.llm.linear import fit_logistic, probability

#: Labelled rows, and bytes of their texts, that the model is fitted on at most.
FIT_ROWS, FIT_BYTES = 6_000, 64 << 20
THRESHOLD = 0.3
#: Letters of a window at most, and how far apart the parts of a longer word start.
WIDEST, STEP = 24, 12
#: Windows that a dictionary is trained on at most, and how often one of them counts at most.
SAMPLES, OFTEN = 100_000, 50
#: Ordinary windows that decide how far is far, and the share of them that lies nearer.
LOOKED_AT, FAR = 60_000, 0.9
#: One row in so many calibrates.
CALIBRATE = 4


class Setting(NamedTuple):
    """zstandard's level, bytes of a dictionary, segment and run lengths of its trainer,
    and whether the pair is trained again."""

    level: int
    size: int
    segment: int
    run: int
    again: bool


SETTINGS = (Setting(5, 65_536, 24, 6, False), Setting(5, 65_536, 24, 6, True), Setting(5, 65_536, 24, 6, False), Setting(19, 112_640, 24, 8, True))
RATIOS = (0.7, 1.5, 2.5)
#: Windows whose ratios a worker remembers.
REMEMBERED = 1_000_000
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def words(text: str | None) -> list[str]:
    """The windows of a text: words without the marks around them, if they have others."""
    found = [w.strip(MARKS) or w for w in (text or "").lower().split()]
    if found and len(max(found, key=len)) > WIDEST:
        found = [w[i : i + WIDEST] for w in found for i in range(0, max(1, len(w) - WIDEST + STEP), STEP)]
    return found


def window(word: str) -> bytes:
    return f" {word} ".encode("utf-16-le", "replace")


class Model(NamedTuple):
    constant: float | None
    pairs: tuple[tuple[int, bytes, bytes], ...]  # level, ordinary, toxic
    ratios: dict[tuple[int, int], float]  # by letters and distance
    link: tuple | None


def compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(raw)
    dictionary.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)


class Scorer:
    """Compresses windows under all dictionaries, remembering a bounded number."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.pairs = [(compressor(ordinary, level), compressor(toxic, level)) for level, ordinary, toxic in model.pairs]

    def distance(self, word: str) -> int:
        raw = window(word)
        return sum(len(ordinary.compress(raw)) - len(toxic.compress(raw)) for ordinary, toxic in self.pairs)

    def look(self, found: list[str]) -> list[tuple[int, float]]:
        """(distance, ratio) of each window."""
        out = []
        for w in found:
            known = self.known.get(w)
            if known is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                far = self.distance(w)
                known = self.known[w] = far, self.model.ratios.get((len(w), far), 0.0)
            out.append(known)
        return out

    def features(self, text: str | None) -> list[float]:
        """The greatest ratios and distances of a text's windows, and how many are great."""
        both = np.array(self.look(words(text)) or [(0, 0.0)], dtype=float)
        far, ratio = -np.sort(-both[:, 0]), -np.sort(-both[:, 1])
        counts = [int((ratio >= r).sum()) for r in RATIOS]
        return [
            ratio[0], ratio[:2].mean(), ratio[:3].mean(), *np.log1p(counts), *(c / len(ratio) for c in counts), np.log1p(len(ratio)),
            far[0], far[:3].mean(), far[:6].mean(), far.mean(),
        ]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.model.constant is not None:
            return np.full(len(texts), self.model.constant)
        return probability(self.model.link, np.array([self.features(t) for t in texts], dtype=float))


def contrasts(rows: list[tuple[str, int]]) -> tuple[Counter, Counter]:
    """How often each window occurs in toxic and in ordinary text, each with its two
    neighbours once, so that copies of a document count as one."""
    seen: tuple[set, set] = (set(), set())
    for text, toxic in rows:
        w = ["", *words(text), ""]
        seen[toxic].update(zip(w, w[1:], w[2:]))
    return Counter(t[1] for t in seen[1]), Counter(t[1] for t in seen[0])


def drawn(counts: Counter, most: int, seed: int) -> list[bytes]:
    """At most so many of the windows, in an order that depends on them and the seed alone."""
    pool = [w for w in sorted(counts) for _ in range(min(counts[w], OFTEN))]
    return [window(pool[i]) for i in np.random.RandomState(seed).permutation(len(pool))[:most]]


def trained(samples: list[bytes], own: Setting) -> bytes:
    try:
        return zstandard.train_dictionary(own.size, samples, k=own.segment, d=own.run, steps=1).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(dict.fromkeys(samples))[-own.size :]


def dictionaries(toxic: Counter, ordinary: Counter, own: Setting, seed: int) -> tuple[int, bytes, bytes]:
    """A pair, trained on equally many windows of both kinds."""
    most = min(SAMPLES, sum(min(n, OFTEN) for n in toxic.values()), sum(min(n, OFTEN) for n in ordinary.values()))
    plain = drawn(ordinary, most, seed)
    pair = own.level, trained(plain, own), trained(drawn(toxic, most, seed), own)
    if own.again:
        distance = Scorer(Model(None, (pair,), {}, None)).distance
        looked = sorted(ordinary)
        looked = [looked[i] for i in np.random.RandomState(seed).permutation(len(looked))[:LOOKED_AT]]
        far = {w: distance(w) for w in looked}
        least = np.quantile(np.repeat(list(far.values()), [ordinary[w] for w in far]), FAR)
        beyond = Counter({w: n for w, n in toxic.items() if distance(w) > least})
        if beyond:
            pair = own.level, trained(plain + [window(w) for w, d in far.items() if d > least], own), trained(drawn(beyond, most, seed), own)
    return pair


def fit(texts: list[str], y: list[int]) -> Model:
    """Deterministic: rows are put in order first, and equal ones count once."""
    rows = sorted({(t, int(v)) for t, v in zip(texts, y)})
    apart = [zlib.crc32(t.encode("utf-8", "replace")) % CALIBRATE == 0 for t, _ in rows]
    seen, unseen = ([r for r, x in zip(rows, apart) if x == side] for side in (False, True))
    two = lambda part: len({v for t, v in part if words(t)}) == 2
    if not (two(seen) and two(unseen)):
        return Model(float(np.mean([int(v) for v in y])) if len(y) else 0.0, (), {}, None)
    toxic, ordinary = contrasts(seen)
    model = Model(None, tuple(dictionaries(toxic, ordinary, own, seed) for seed, own in enumerate(SETTINGS)), {}, None)
    distance, cells = Scorer(model).distance, {}
    toxic, ordinary = contrasts(unseen)
    for side, counts in enumerate((ordinary, toxic)):
        for w, n in counts.items():
            cells.setdefault((len(w), distance(w)), [0, 0])[side] += n
    ratios = {c: float(np.log((t + 0.5) / toxic.total()) - np.log((o + 2.0) / ordinary.total())) for c, (o, t) in cells.items()}
    scorer = Scorer(model._replace(ratios=ratios))
    x = np.array([scorer.features(t) for t, _ in unseen], dtype=float)
    return scorer.model._replace(link=fit_logistic(x, np.array([v for _, v in unseen], dtype=float)))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows that are not held out, FIT_BYTES together."""
    rows = within_bytes(labelled(docs, labels, "toxic", limit), FIT_BYTES).select("text", "y").toArrow()
    return fit(rows["text"].to_pylist(), rows["y"].to_pylist())


def toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of a table with doc_id and text: doc_id, score, predicted."""
    src = docs.select("doc_id", "text")
    scorer: list[Scorer] = []  # one in each worker, filled there

    def run(batch: pa.RecordBatch) -> dict:
        if not scorer:
            scorer.append(Scorer(model))
        score = scorer[0].scores(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return map_batches(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, score double, predicted int")


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
