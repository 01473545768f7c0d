"""Best-fit packing by minimum bin slack.

Documents become pieces of at most one bin's tokens. A shard of pieces is a pool of lengths. For each bin the longest
piece left is set, then a subset-sum over the other lengths, held as one bitset per length, finds the fullest bin that
can be made with it; that combination leaves the pool. There is a shard for so many tokens of the input, whatever the
session's settings, so the bins depend on the table only and no shard grows with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import cut, documents
from .token_counts import token_counts

CAPACITY = 2048
#: Tokens of a shard, on average.
SHARD = 1 << 23
SCHEMA = "bin_id bigint, slot int, doc_id bigint, piece int, start_token bigint, n_tokens int"


def fullest(pool: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that holds the longest piece of the pool (length: count)."""
    longest = max(pool)
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(pool, reverse=True):
        for _ in range(min(pool[length] - (length == longest), room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
        if reach >> room & 1:
            break
    best, out = reach.bit_length() - 1, [longest]
    for length, before in reversed(steps):
        if not before >> best & 1:
            out.append(length)
            best -= length
    return out


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers; every length is from 1 to capacity. Of equal lengths the first piece goes first."""
    bins = [[int(i)] for i in np.flatnonzero(lengths == capacity)]
    waiting: dict[int, list[int]] = {}
    for i in np.flatnonzero(lengths < capacity)[::-1]:
        waiting.setdefault(int(lengths[i]), []).append(int(i))
    pool = {k: len(v) for k, v in waiting.items()}
    while pool:
        chosen = fullest(pool, capacity)
        while all(pool.get(k, 0) >= chosen.count(k) for k in set(chosen)):  # the same combination, as often as it lasts
            bins.append([waiting[k].pop() for k in chosen])
            for k in chosen:
                pool[k] -= 1
                if not pool[k]:
                    del pool[k]
            if not pool or max(pool) != chosen[0]:
                break
    return bins


def best_fit(lengths: DataFrame, capacity: int = CAPACITY, shards: int = 1) -> DataFrame:
    """Bins of the documents in (doc_id, n_tokens): one row for each piece of a document.

    A document without tokens (null or 0) is in no bin. Longer ones than a bin, of any length, are cut after each full bin, and
    nothing is dropped. Repeated rows are packed as often as they occur; a null doc_id is packed as null. Of equal lengths the
    least doc_id goes first. An empty table gives no bin. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        if not len(table):
            return
        shard = table.column("shard")[0].as_py()
        ids, n = table.column("doc_id").combine_chunks(), table.column("n_tokens").to_numpy().astype(np.int64)
        times = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), times)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        size = np.minimum(capacity, n[row] - piece * capacity)
        bins = pack(size, capacity)
        order = np.array([i for b in bins for i in b], np.int64)
        count = np.array([len(b) for b in bins], np.int64)
        number = np.repeat(np.arange(len(bins)), count)
        slot = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
        yield pa.RecordBatch.from_arrays([pa.array(number + (shard << 32)), pa.array(slot.astype(np.int32)), ids.take(pa.array(row[order])), pa.array(piece[order].astype(np.int32)), pa.array(piece[order] * capacity), pa.array(size[order].astype(np.int32))], ["bin_id", "slot", "doc_id", "piece", "start_token", "n_tokens"])

    # a task for each shard; rows without an id are spread by their length
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("n_tokens")).otherwise(F.xxhash64("doc_id"))
    placed = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
    return placed.repartitionById(shards, "shard").mapInArrow(run, SCHEMA)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Bins of the documents by their token counts, a shard for SHARD tokens. See best_fit for nulls, empty and long texts."""
    lengths = cut(token_counts(docs, vocabulary))
    tokens = lengths.agg(F.sum("n_tokens").alias("n")).first().n or 0
    return best_fit(lengths, capacity, max(1, -(-tokens // SHARD)))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
ORACLE: dict[str, str] = {}
