"""Benchmark decontamination with suffix arrays of the training text.

Shards of the documents are sorted into suffix arrays of words. Every suffix of every benchmark item is binary-searched
in every shard; the suffixes that agree on enough words are one range of the array, and each is extended to its longest
verbatim match. Words are compared by 64-bit hashes, so case and punctuation don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .cluster import documents, plan_bytes

#: Words that must agree; an item of fewer words must be found whole.
LEAST = 13
#: Words of a shard, and bytes of benchmark items searched in one scan.
SHARD, ITEMS = 1 << 20, 8 << 20
SCHEMA = "doc_id bigint, item_id bigint, match_words int, doc_word int, item_word int"


def symbols(words: np.ndarray) -> np.ndarray:
    """For each word, it and the next three as four 16-bit symbols of one key; past the end the symbol is 0."""
    s = np.r_[words >> np.uint64(48), np.zeros(3, np.uint64)]
    n = len(words)
    return s[:n] << np.uint64(48) | s[1 : n + 1] << np.uint64(32) | s[2 : n + 2] << np.uint64(16) | s[3 : n + 3]


def suffix_array(key: np.ndarray, depth: int) -> np.ndarray:
    """Word positions in order of their next depth symbols (a multiple of 4), from keys by symbols()."""
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    padded = np.r_[key, np.uint64(0)]
    for level in range(1, depth // 4):
        tied = np.flatnonzero(~new | np.r_[~new[1:], False])
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        sub = order[tied]
        nxt = padded[np.minimum(sub + 4 * level, len(key))]
        o = np.lexsort((nxt, group))
        order[tied], nxt = sub[o], nxt[o]
        new[tied] |= np.r_[True, nxt[1:] != nxt[:-1]]
    return order


class Items:
    """The benchmark items' words, and where each suffix that is long enough begins."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, least: int):
        words, first = [], [0]
        for *_, data, _, starts, ends, at in T.blocks(texts):
            words.append(T.hashes(data, starts, ends))
            first += (first[-1] + at[1:]).tolist()
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.ids, self.first = ids, np.array(first)
        n = np.diff(self.first)
        need = np.minimum(n, least)
        item = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(self.words))
        left = self.first[item + 1] - at if len(n) else at
        ok = left >= need[item] if len(n) else at > at
        self.at, self.item, self.left, self.need = at[ok], item[ok], left[ok], need[item[ok]]


def _bounds(symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest key that agree with the first n of its symbols."""
    free = np.uint64(16) * (np.uint64(4) - np.clip(n, 0, 4).astype(np.uint64))
    rest = np.where(free >= 64, ~np.uint64(0), (np.uint64(1) << (free % np.uint64(64))) - np.uint64(1))
    return symbol & ~rest, symbol | rest


def search(words: np.ndarray, items: Items, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matches as (word in the shard, number of the item's suffix, length)."""
    key = symbols(words)
    depth = -(-least // 4) * 4
    array = suffix_array(key, depth)
    wanted = symbols(items.words)
    low, high = _bounds(wanted[items.at], items.need)
    sorted_key = key[array]
    lo, hi = np.searchsorted(sorted_key, low, "left"), np.searchsorted(sorted_key, high, "right")
    padded, wanted = np.r_[key, np.uint64(0)], np.r_[wanted, np.uint64(0)]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in np.flatnonzero(lo < hi):
        a, b, need, at, left = int(lo[q]), int(hi[q]), int(items.need[q]), int(items.at[q]), int(items.left[q])
        for level in range(1, -(-need // 4)):
            below, above = _bounds(wanted[at + 4 * level], np.array(need - 4 * level))
            k = padded[np.minimum(array[a:b] + 4 * level, len(key))]
            a, b = a + int(np.searchsorted(k, below, "left")), a + int(np.searchsorted(k, above, "right"))
            if a >= b:
                break
        for i in range(a, b, 4096):
            where = np.sort(array[i : min(b, i + 4096)])
            where = where[where + need <= len(words)]
            length = np.zeros(len(where), np.int64)
            alive = np.arange(len(where))
            for step in range(0, left, 32):
                span = min(32, left - step)
                pos = where[alive, None] + step + np.arange(span)
                same = (words[np.minimum(pos, len(words) - 1)] == items.words[at + step : at + step + span]) & (pos < len(words))
                run = np.where(same.all(1), span, same.argmin(1))
                length[alive] += run
                alive = alive[run == span]
                if not len(alive):
                    break
            ok = length >= need
            found.append((where[ok], np.full(int(ok.sum()), q), length[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _best(doc: np.ndarray, item: np.ndarray, length: np.ndarray, at: np.ndarray, item_at: np.ndarray) -> np.ndarray:
    """Rows that are the longest match of their document and item; of equals the first."""
    order = np.lexsort((item_at, at, -length, item, doc))
    return order[np.r_[True, (doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1])]] if len(order) else order


def _slices(benchmark: DataFrame, least: int) -> Iterator:
    """The items, broadcast in as many slices as their size asks for; each slice is searched in a scan of its own."""
    tests = benchmark.where("text is not null").select("item_id", "text").distinct()
    estimate = plan_bytes(benchmark)
    turns = max(1, -(-4 * estimate // ITEMS)) if estimate < 1 << 60 else 1
    for turn in range(turns):
        rows = tests.where(F.pmod(F.xxhash64("text"), F.lit(turns)) == turn).orderBy("item_id", "text").toArrow()
        yield benchmark.sparkSession.sparkContext.broadcast(Items(rows["item_id"].fill_null(0).to_numpy(), rows["text"].combine_chunks(), least))


def _ended(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word hashes with a 0 after each text: no match goes beyond it."""
    return np.insert(np.maximum(T.hashes(data, starts, ends), np.uint64(1)), first[1:], np.uint64(0))


def matches(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The longest verbatim match of each document with each benchmark item, from least words on (or the whole item).

    Null and empty texts have no words and match nothing; rows with a null doc_id or item_id are left out. Of matches of
    one length the first in the document, then in the item, is given. Repeated ids count as one document or item with
    several texts. Texts and items of any length are searched whole, in memory in proportion to their words. An empty table, of
    documents or items, gives no row. Other columns are ignored.
    """
    out = None
    for items in _slices(benchmark.where("item_id is not null"), least):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            test, words, rest, size = items.value, [], [], 0

            def flush() -> Iterator[pa.RecordBatch]:
                if not words:
                    return
                ids, begins = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest])
                shard = np.concatenate(words)
                where, q, length = search(shard, test, least)
                d = np.searchsorted(begins, where, "right") - 1
                doc, at = ids[d], where - begins[d]
                item, item_at = test.ids[test.item[q]], test.at[q] - test.first[test.item[q]]
                keep = _best(doc, item, length, at, item_at)
                yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(item[keep]), *(pa.array(x[keep].astype(np.int32)) for x in (length, at, item_at))], ["doc_id", "item_id", "match_words", "doc_word", "item_word"])

            for b in batches:
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for i, j, data, _, starts, ends, first in T.blocks(b.column(1)):
                    words.append(_ended(data, starts, ends, first))
                    rest.append((ids[i:j], first[:-1] + np.arange(j - i) + size))
                    size += len(words[-1])
                    if size >= SHARD:
                        yield from flush()
                        words, rest, size = [], [], 0
            yield from flush()

        got = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, SCHEMA)
        out = got if out is None else out.unionByName(got)
    best = F.max(F.struct("match_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"))).alias("m")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.match_words", (-F.col("m.d")).alias("doc_word"), (-F.col("m.i")).alias("item_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST) -> DataFrame:
    """The rows whose text matches no benchmark item, with all their columns, in one scan and without a shuffle.

    Each row is judged by its own text and each item by its own, so null ids make no difference; null and empty texts stay,
    null and empty items match nothing. Equal rows stay or go together. Texts of any length are searched whole. Empty tables are allowed.
    """
    at, schema = docs.columns.index("text"), docs.schema
    for items in _slices(benchmark, least):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep, words, begins, size = np.ones(b.num_rows, bool), [], [], 0
                row = 0
                for i, j, data, _, starts, ends, first in T.blocks(b.column(at)):
                    words.append(_ended(data, starts, ends, first))
                    begins.append(first[:-1] + np.arange(j - i) + size)
                    size += len(words[-1])
                    if size >= SHARD or j == b.num_rows:
                        where, _, _ = search(np.concatenate(words), items.value, least)
                        keep[row + np.searchsorted(np.concatenate(begins), where, "right") - 1] = False
                        words, begins, size, row = [], [], 0, j
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL_WORDS = r"regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')"
QUERIES = {"op9_decontamination": op9_decontamination}
ORACLE = {
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, w, least({LEAST}, len(w)) AS need FROM (SELECT item_id, {SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT item_id, need, i AS item_word, array_to_string(w[i + 1:i + need], ' ') AS g FROM (SELECT *, unnest(generate_series(0, len(w) - need)) AS i FROM b)),
dw AS (SELECT doc_id, need, i AS doc_word, array_to_string(w[i + 1:i + need], ' ') AS g
  FROM (SELECT doc_id, w, need, unnest(generate_series(0, len(w) - need)) AS i FROM d, (SELECT DISTINCT need FROM b) WHERE len(w) >= need)),
hits AS (SELECT DISTINCT doc_id, item_id, need, doc_word, item_word FROM dw JOIN bw USING (need, g)),
runs AS (SELECT doc_id, item_id, need, doc_word, item_word,
  doc_word - row_number() OVER (PARTITION BY doc_id, item_id, doc_word - item_word ORDER BY doc_word) AS run FROM hits),
m AS (SELECT doc_id, item_id, count(*) + any_value(need) - 1 AS n, min(doc_word) AS doc_word, min(item_word) AS item_word
  FROM runs GROUP BY doc_id, item_id, doc_word - item_word, run)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS match_words, CAST(doc_word AS INTEGER) AS doc_word, CAST(item_word AS INTEGER) AS item_word
FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, doc_word, item_word) = 1""",
}
