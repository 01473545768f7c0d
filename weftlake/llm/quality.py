"""Quality classifier by importance resampling.

Two generative models of hashed byte 5-grams, one of the target (documents labelled good and not toxic) and one of the
raw text (all documents), give each document a log importance weight: the mean log ratio of its n-grams, shrunk towards
the target's where a text is short, times SCALE: as if each text had so many n-grams, or so low a temperature. Documents are
sampled without replacement by Gumbel top-k, k being the share of good documents among the labelled ones. The noise, of a
deviation of 1.3, decides between documents whose mean log ratios are within some 3 / SCALE of each other; a larger SCALE
samples less and classifies more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .cluster import cut, documents

SLOTS, SEGMENT = 1 << 20, 1 << 14
#: Labelled documents that the target model is fitted on, at most; those of the lowest hashes of doc_id.
LABELLED = 100_000
#: Added to both counts of a slot; n-grams by which a short text is drawn to the target's mean; n-grams that a weight stands for.
SMOOTH, SHRINK, SCALE = 0.5, 100.0, 500.0
SEED = 20240229
NOT_SPACE = ~T.SPACE


def slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and slot of each byte 5-gram."""
    n = len(data) - 4
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = data.astype(np.uint64)
    key = x[:n]
    for k in range(1, 5):
        key = key | x[k : n + k] << np.uint64(8 * k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    same = doc[:n] == doc[4:]
    return doc[:n][same], (T.mix(key[same]) & np.uint64(SLOTS - 1)).astype(np.int64)


def count_slots(docs: DataFrame, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every slot over all documents, and over the good ones (sorted ids)."""
    chosen = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, ids = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), chosen.value
        for b in batches:
            is_good = np.isin(b.column(0).fill_null(-(1 << 63)).to_numpy(), ids)
            for i, j, data, off, *_ in T.blocks(b.column(1), lower=False, table=NOT_SPACE):
                d, s = slots(data, off)
                raw += np.bincount(s, minlength=SLOTS)
                if is_good[i:j].any():
                    target += np.bincount(s[is_good[i:j][d]], minlength=SLOTS)
        top = int(raw.max())
        kind = np.int32 if top < 1 << 31 else np.int64
        for k in range(0, SLOTS, SEGMENT):
            if raw[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([x[k : k + SEGMENT].astype(kind).tobytes()], pa.binary()) for x in (raw, target))], ["segment", "raw", "target"])

    def total(table: pa.Table) -> pa.Table:
        sums = []
        for name in ("raw", "target"):
            acc = np.zeros(SEGMENT, np.int64)
            for v in table.column(name):
                b = v.as_buffer()
                acc += np.frombuffer(b, np.int32 if b.size == 4 * SEGMENT else np.int64)
            sums.append(pa.array([acc.tobytes()], pa.binary()))
        return pa.table([table.column("segment")[:1].combine_chunks(), *sums], names=["segment", "raw", "target"])

    schema = "segment bigint, raw binary, target binary"
    out = np.zeros((2, SLOTS), np.int64)
    for r in docs.select("doc_id", "text").mapInArrow(count, schema).groupBy("segment").applyInArrow(total, schema).collect():
        out[0, r.segment : r.segment + SEGMENT] = np.frombuffer(r.raw, np.int64)
        out[1, r.segment : r.segment + SEGMENT] = np.frombuffer(r.target, np.int64)
    return out[0], out[1]


def log_ratio(raw: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Log ratio of the two models at each slot, and its mean over the target's n-grams."""
    share = target.sum() / max(1, raw.sum())
    ratio = np.log((target + SMOOTH) / (raw * share + SMOOTH))
    return ratio, float((ratio * target).sum() / max(1, target.sum()))


def weigher(ratio: np.ndarray, centre: float) -> Callable[[pa.Array], np.ndarray]:
    """A function from texts to log weights; NaN for a text that is null, empty or white space only."""

    def weigh(texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), np.nan)
        for i, j, data, off, _, _, first in T.blocks(texts, lower=False, table=NOT_SPACE):
            d, s = slots(data, off)
            total, n = np.bincount(d, ratio[s], j - i), np.bincount(d, minlength=j - i)
            out[i:j] = np.where(np.diff(first) > 0, SCALE * (total + SHRINK * centre) / (n + SHRINK), np.nan)
        return out

    return weigh


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise that depends on the id and the seed only, so a task that is run again gives the same."""
    u = ((T.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / 2**53
    return -np.log(-np.log(u))


def kth_largest(table: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value, exactly: histograms of ever narrower ranges, then a sort of what is left in one bin."""
    values = table.select(F.col(column).alias("v")).where("v is not null")
    lo, hi, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if not n or k >= n:
        return lo if n else None
    if k <= 0:
        return float("inf")
    bins = 4096
    while lo < hi:
        inside = values.where(F.col("v").between(lo, hi))
        if n <= 20_000:
            return sorted((r.v for r in inside.collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        rows = inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).alias("b")).agg(F.count("v").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if k <= r.c:
                lo, hi, n = r.lo, r.hi, r.c
                break
            k -= r.c
    return lo


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> tuple[np.ndarray, float, float]:
    """The log ratios, their centre, and the share of good documents. Conflicting labels of one document count as bad."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(((F.min("quality") == 1) & (F.max("toxic") == 0)).alias("good"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).toArrow()
    ids, good = rows["doc_id"].to_numpy(), rows["good"].to_numpy()
    share = float(good.mean()) if len(good) else 1.0
    return (*log_ratio(*count_slots(docs, np.sort(ids[good]))), share)


def _scored(docs: DataFrame, labels: DataFrame, seed: int):
    spark = docs.sparkSession
    ratio, centre, share = fit(docs, labels)
    model = spark.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weigher(model.value, centre)
        for b in batches:
            w = weigh(b.column(1))
            s = w + gumbel(b.column(0).fill_null(0).to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, from_pandas=True), pa.array(s, from_pandas=True)], ["doc_id", "log_weight", "score"])

    table = cut(docs.select("doc_id", "text").mapInArrow(score, "doc_id bigint, log_weight double, score double"))
    n = table.where("score is not null").count()
    return table, kth_largest(table, "score", round(share * n)), model, centre


def importance_sample(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, score) of the sampled documents.

    Null, empty and blank texts are never sampled. A null doc_id gets the noise of 0. Documents that tie with the last one
    sampled are sampled too, so repeated rows stay or go together. Texts of any length are read whole, in memory in proportion to
    them. Without any usable label everything but blanks stays; an empty table gives no row. Other columns are ignored.
    """
    table, least, *_ = _scored(docs, labels, seed)
    return table.where(F.lit(False) if least is None else F.col("score") >= least)


def keep_sampled(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs that importance_sample keeps, with all their columns."""
    _, least, model, centre = _scored(docs, labels, seed)
    at, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = weigher(model.value, centre)
        for b in batches:
            s = weigh(b.column(text)) + gumbel(b.column(at).fill_null(0).to_numpy(), seed)
            yield b.filter(pa.array(s >= (np.inf if least is None else least)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op5_quality_resampling": op5_quality_resampling}
ORACLE: dict[str, str] = {}
