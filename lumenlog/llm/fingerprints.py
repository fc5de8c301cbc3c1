"""Document fingerprints: weighted SimHash and its permuted block tables, in DataFrame
functions only.

The terms of a text are its words, weighted by their length, and its pairs of neighbouring
words. Each term's 128 hash bits vote with the term's weight; two 32-bit counts share a
long, so 64 sums in one hash aggregation hold all votes. A fingerprint's bit is set if
more than half of the weight votes for it. Fingerprints within a Hamming radius agree in
whole blocks of bits; each choice of blocks is a table, and tables are joined on those
blocks and full distances verified, between distinct fingerprints only.

Documents follow each other by id. A document's neighbour sends it only the characters
that its edited text takes, so texts are shuffled once.

Defined results: null text counts as empty (fingerprint zero); a null id comes first;
rows that repeat id and text are one document in the order of documents and give a row
each; rows that share an id follow each other by hashed text; after the last document
comes the first, so a single one follows itself; other columns are ignored. Counts hold
for texts of up to 200 million words.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import settle

HALF = 32
LONGEST, PAIR = 12, 6  # weight of a word is its length up to this; of a pair
RADIUS = 3
LEAST_ID = -(1 << 63)
LOW = 0xFFFFFFFF


def words(text: Column) -> Column:
    return F.split(F.lower(text), r"\s+")


def votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, then f1 and f2: the fingerprint of ``text`` for each combination of keys."""
    w = words(F.col(text))
    terms = rows.select(*keys, F.inline(F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"))))
    one = lambda *seed: F.xxhash64("a", *seed)
    two = lambda *seed: F.xxhash64("a", "b", *seed)
    terms = terms.select(
        *keys, F.least(F.length("a"), F.lit(LONGEST)).cast("long").alias("wa"), F.when(F.col("b").isNull() | (F.length("b") == 0), 0).otherwise(PAIR).cast("long").alias("wp"),
        one().alias("h1"), two().alias("p1"), one(F.lit(1)).alias("h2"), two(F.lit(1)).alias("p2"),
    )
    both = F.lit((1 << HALF) + 1).cast("long")
    share = lambda h, i, weight: F.shiftrightunsigned(h, i).bitwiseAND(both) * F.col(weight)
    sums = [F.sum(share(f"h{k}", i, "wa") + share(f"p{k}", i, "wp")).alias(f"s{k}_{i}") for k in (1, 2) for i in range(HALF)]
    counted = terms.groupBy(*keys).agg(F.sum(F.col("wa") + F.col("wp")).alias("total"), *sums)
    low = F.lit(LOW).cast("long")

    def bits(k: int) -> Column:
        set_bit = lambda count, at: F.when(count * 2 > F.col("total"), F.lit((1 << at) - (1 << 64 if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long"))
        parts = [p for i in range(HALF) for p in (set_bit(F.col(f"s{k}_{i}").bitwiseAND(low), i), set_bit(F.shiftrightunsigned(f"s{k}_{i}", HALF), i + HALF))]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return counted.select(*keys, bits(1).alias("f1"), bits(2).alias("f2"))


def distance(a: tuple[str, str], b: tuple[str, str]) -> Column:
    return F.bit_count(F.col(a[0]).bitwiseXOR(F.col(b[0]))) + F.bit_count(F.col(a[1]).bitwiseXOR(F.col(b[1])))


def near(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(f1, f2, n_near): for each distinct fingerprint, how many of the rows other than
    one that holds it lie within the radius.

    Permuted block tables: 128 bits in radius + 1 blocks (radius + 2 where those get
    narrow); two fingerprints within the radius agree in some choice of whole blocks.
    """
    held = prints.groupBy("f1", "f2").agg(F.count("*").alias("n"))
    blocks = radius + 1 if radius < 4 else radius + 2
    width = 128 // blocks

    def block(i: int) -> Column:
        """Bits i * width up to (i + 1) * width, the last block to the end, as a long."""
        lo, hi = i * width, 128 if i == blocks - 1 else (i + 1) * width
        parts = []
        for name, at in (("f1", 0), ("f2", 64)):
            a, b = max(lo, at), min(hi, at + 64)
            if a < b:
                mask = (1 << (b - a)) - 1
                parts.append(F.shiftrightunsigned(name, a - at).bitwiseAND(F.lit(mask - (1 << 64 if mask >> 63 else 0)).cast("long")))
        return parts[0] if len(parts) == 1 else F.xxhash64(*parts)

    tables = list(combinations(range(blocks), blocks - radius))
    keyed = held.select("f1", "f2", "n", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), *[block(i) for i in chosen]).alias("key")) for t, chosen in enumerate(tables)])).alias("x"))
    left = keyed.select("f1", "f2", "x.t", "x.key")
    right = keyed.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("m"), "x.t", "x.key")
    other = (F.col("f1") != F.col("g1")) | (F.col("f2") != F.col("g2"))
    found = left.join(right, ["t", "key"]).where(other & (distance(("f1", "f2"), ("g1", "g2")) <= radius)).select("f1", "f2", "g1", "g2", "m").distinct()
    around = found.groupBy("f1", "f2").agg(F.sum("m").alias("m"))
    return held.join(around, ["f1", "f2"], "left").select("f1", "f2", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(k, h, text): the id with null as the least, and the text's hash: a document's key."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID).cast("long")).alias("k"), F.xxhash64(text).alias("h"), text.alias("text"))


def order(rows: DataFrame) -> DataFrame:
    """(k, h, n, m, nk, nh): each document, its code points and rows, and the next one.

    Keys are dealt to ranges; a range's last document is followed by the first of the
    next range, which a table with one row for each range tells.
    """
    keys = rows.groupBy("k", "h").agg(F.max(F.length("text")).cast("long").alias("n"), F.count("*").alias("m"))
    dealt = settle(keys.repartitionByRange("k", "h").withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy("k", "h")
    firsts = dealt.groupBy("range").agg(F.min(F.struct("k", "h")).alias("f"))  # as many rows as partitions
    across = Window.orderBy("range")
    whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("range", F.coalesce(F.lead("f").over(across), F.first("f").over(whole)).alias("after"))
    following = F.coalesce(F.lead(F.struct("k", "h")).over(inside), F.col("after"))
    linked = dealt.join(F.broadcast(after), "range").withColumn("next", following)
    return settle(linked.select("k", "h", "n", "m", F.col("next.k").alias("nk"), F.col("next.h").alias("nh")))


def op3(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    rows = keyed_rows(docs)
    chain = order(rows)
    asked = chain.select(F.col("k").alias("pk"), F.col("h").alias("ph"), "n", F.col("nk").alias("k"), F.col("nh").alias("h"))
    heads = rows.join(asked, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), "n", F.expr("substring(text, 1, cast(floor(n / 4) as int))").alias("head"))
    heads = heads.dropDuplicates(["k", "h"])
    edited = rows.join(heads, ["k", "h"]).select("k", "h", "text", F.concat(F.expr("substring(text, 1, cast(n - floor(n / 4) as int))"), "head").alias("edited"))
    side = lambda which, text, sha: F.struct(F.lit(which).alias("which"), F.col(text).alias("text"), sha.alias("sha"))
    sides = F.array(side(0, "text", F.lit("")), side(1, "edited", F.sha2("edited", 256)))
    texts = edited.select("k", "h", F.explode(sides).alias("x")).select("k", "h", "x.*")
    made = votes(texts, ["k", "h", "which", "sha"], "text")
    own, new = F.col("which") == 0, F.col("which") == 1
    prints = settle(made.groupBy("k", "h").agg(
        F.max(F.when(own, F.col("f1"))).alias("f1"), F.max(F.when(own, F.col("f2"))).alias("f2"),
        F.max(F.when(new, F.col("f1"))).alias("e1"), F.max(F.when(new, F.col("f2"))).alias("e2"), F.max("sha").alias("edited_sha256"),
    ))
    following = prints.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("f1").alias("n1"), F.col("f2").alias("n2"))
    counted = prints.join(chain.select("k", "h", "m"), ["k", "h"]).select("f1", "f2", F.explode(F.expr("sequence(1L, m)")))
    alike = lambda a, b: 1 - distance(a, b) / 128
    text_of = lambda a, b: F.lower(F.concat(F.lpad(F.hex(b), 16, "0"), F.lpad(F.hex(a), 16, "0")))
    out = prints.join(chain, ["k", "h"]).join(following, ["nk", "nh"]).join(near(counted, radius), ["f1", "f2"])
    return out.withColumn("row", F.explode(F.expr("sequence(1L, m)"))).select(
        F.when(F.col("k") != LEAST_ID, F.col("k")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256",
        text_of("f1", "f2").alias("fingerprint"), text_of("e1", "e2").alias("edited_fingerprint"),
        alike(("f1", "f2"), ("e1", "e2")).alias("near_edited"), alike(("f1", "f2"), ("n1", "n2")).alias("near_next"), "n_near",
    )
