"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker holds a few MB of text.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole documents of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset
    and driver and executors are one process (tests, a laptop)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="lumenlog-")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to a dict of columns (None: nothing)."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, column: str, fn: Callable[[list], dict], schema: str) -> DataFrame:
    """All columns, then those of ``schema`` that a function of one column's values gives.

    Columns go by position, so names may clash or differ by case only.
    """
    names, place = df.columns, df.columns.index(column)
    inner = ", ".join(f"c{i} {t}" for i, (_, t) in enumerate(df.dtypes))

    def run(batch: pa.RecordBatch) -> dict:
        return {f"c{i}": batch.column(i) for i in range(len(names))} | fn(batch.column(place).to_pylist())

    new = [part.split()[0] for part in schema.split(",")]
    return map_batches(df, run, f"{inner}, {schema}").toDF(*names, *new)


def store(df: DataFrame) -> DataFrame:
    """Write a table to the cluster's shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenlog-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def held_out(doc_id):
    """True where crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(doc_id, text, y): one row for each of at most ``limit`` labelled ids not held out.

    The ids are those of smallest hash, so the sample does not depend on the order or the
    partitioning of the tables; its bound makes the broadcast safe. An id that documents
    hold several times gives its least text.
    """
    y = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(y), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def within_bytes(rows: DataFrame, limit: int) -> DataFrame:
    """Those of a bounded number of (doc_id, text) rows, in the order of hashed ids, whose
    texts together hold at most so many bytes; a text that does not fit is passed over."""
    rows, left, chosen = settle(rows), limit, []
    for r in rows.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r.n <= left:
            left -= r.n
            chosen.append((r.doc_id,))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(chosen, f"doc_id {kind}")), "doc_id")
