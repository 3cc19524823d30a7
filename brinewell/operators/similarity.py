"""Similarity search of a stated set of vectors against all others (J10, D15 to D17, O6), and insertion of what is new.

The queries are worked on in blocks of bounded size, WAVE of them in one job; a block travels to the vectors, each task scores its vectors against a block by one
matrix product and hands on its best k a query, so that no pair below a task's best is ever shuffled. What the driver holds is bounded by a wave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.session import shared_dir

BLOCK_QUERIES = 2000
WAVE = 16
MATCHES = "left_id bigint, right_id bigint, cosine double, score double"


def _unit(rows: list[list[float]], width: int) -> np.ndarray:
    m = np.array(rows, np.float64).reshape(len(rows), width)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _block(spark, right: DataFrame, block: list, top: int, threshold: float, weight: float, decay_days: float) -> DataFrame:
    width = len(block[0][1])
    ids = np.array([r[0] for r in block])
    days = np.array([np.nan if r[2] is None else float(r[2]) for r in block])
    shared = spark.sparkContext.broadcast((ids, _unit([r[1] for r in block], width), days))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left_ids, left, left_days = shared.value
        for batch in batches:
            keep = [k for k, v in enumerate(batch.column("v").to_pylist()) if v is not None and len(v) == width]
            if not keep:
                continue
            rows = batch.take(pa.array(keep))
            right_ids = rows.column("id").to_numpy()
            cosine = left @ _unit(rows.column("v").to_pylist(), width).T
            gap = np.abs(left_days[:, None] - rows.column("day").to_numpy(zero_copy_only=False).astype(np.float64)[None, :])
            near = np.where(np.isnan(gap), 1.0, np.maximum(0.0, 1.0 - gap / decay_days))
            score = weight * cosine + (1 - weight) * near
            score = np.where(left_ids[:, None] == right_ids[None, :], -np.inf, score)
            order = np.lexsort((np.broadcast_to(right_ids, score.shape), -score), axis=1)[:, :top]
            a = np.repeat(np.arange(len(left_ids)), order.shape[1])
            b = order.ravel()
            fine = score[a, b] >= threshold
            a, b = a[fine], b[fine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(left_ids[a]), pa.array(right_ids[b]), pa.array(cosine[a, b]), pa.array(score[a, b])], names=[x.split()[0] for x in MATCHES.split(", ")]
            )

    return right.mapInArrow(work, MATCHES)


def top_matches(left: DataFrame, right: DataFrame, top: int = 3, threshold: float = 0.6, weight: float = 0.8, decay_days: float = 30.0) -> DataFrame:
    """The best `top` right rows of each left row from threshold on: weight parts cosine, the rest nearness of the days.

    left and right: (id bigint, v array<float>, day double?); an unknown day counts as near; a zero vector has cosine 0; rows without a vector or with
    one of another length match nothing; equal scores rank by the right id; a row is no match of its own id.
    """
    spark, block, wave, path = left.sparkSession, [], [], None
    facts = right.select("id", F.col("v").cast("array<double>").alias("v"), F.col("day").cast("double").alias("day"))

    def scored() -> DataFrame:
        return reduce(DataFrame.unionByName, [_block(spark, facts, b, top, threshold, weight, decay_days) for b in wave])

    for r in left.select("id", F.col("v").cast("array<double>"), F.col("day").cast("double")).where("v is not null and size(v) > 0").toLocalIterator():
        if block and (len(block) >= BLOCK_QUERIES or len(r[1]) != len(block[0][1])):
            wave.append(block)
            block = []
            if len(wave) == WAVE:
                path = path or shared_dir(spark, "similar")
                scored().write.mode("append").parquet(path)
                wave = []
        block.append(r)
    if block:
        wave.append(block)
    if not wave and not path:
        return spark.createDataFrame([], MATCHES + ", rank int")
    out = scored() if wave else None
    if path:
        if out is not None:
            out.write.mode("append").parquet(path)
        out = spark.read.parquet(path)
    best = Window.partitionBy("left_id").orderBy(F.col("score").desc(), "right_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def encoded(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray], out: str = "v") -> DataFrame:
    """df with the vector of each text by an injected encoder, list of texts to an array of rows; null texts have none. Texts are encoded an Arrow batch at a time."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        rows = iter(np.asarray(encoder([t for t in texts if t is not None]), float)) if texts.notna().any() else iter(())
        return pd.Series([None if t is None else next(rows).tolist() for t in texts], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def match_texts(left: DataFrame, right: DataFrame, encoder: Callable[[list[str]], np.ndarray], **options) -> DataFrame:
    """J10 over texts: left and right (id bigint, text string, day double?), by the encoder's vectors; options are those of top_matches()."""
    return top_matches(*[encoded(df, "text", encoder).select("id", "v", "day") for df in (left, right)], **options)


def ranked(matches: DataFrame) -> DataFrame:
    """All matches in one order, the best first, by range partitions."""
    return matches.orderBy(F.col("score").desc(), "left_id", "right_id")


def not_yet_known(candidates: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of candidates whose keys known does not have; one of each."""
    return candidates.dropDuplicates(keys).join(known.select(*keys).distinct(), keys, "left_anti")
