"""Suffix-array dedup by bucket-pointer refinement: passages of 50 words or more that occur more than once.

Suffixes start in buckets of equal 16-grams. A bucket is refined by the bucket identifiers at later offsets: 16 words on
gives buckets of 32 words, and those, reused at 18 words on, give buckets of 50. Identifiers are hashes of what the
bucket's suffixes begin with, so they mean the same on every executor and no global sort is needed. Each 50-word window
is looked after by the least 16-gram in it, the same one in every copy; only such anchors are exchanged at first, and a
suffix whose anchor's bucket has one member is finished. What remains is sorted by the refined identifier. Members of a
bucket that a task has at hand are settled there, and one of them is sent for all, so no bucket grows with its copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .blobs import BLOBS, emit, got_by_kind, together
from .cluster import cut, documents, parts

LENGTH, Q = 50, 16
WINDOW = LENGTH - Q + 1
LOW = np.uint64((1 << 24) - 1)
FLUSH = 1 << 20
SPANS = "doc_id bigint, start_word int, end_word int, n_words int, removed_words int"


def anchors(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """16-gram buckets; then text, start and anchor (as word numbers) of every 50-word window of the texts."""
    g = T.grams(words, Q)
    if len(g) < WINDOW:
        return g, *(np.zeros(0, np.int64),) * 3
    m = (g & ~LOW) | (LOW - (np.arange(len(g), dtype=np.uint64) & LOW))  # of equal 16-grams the last
    span = 1
    while span * 2 <= WINDOW:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    m = np.minimum(m[: len(m) - (WINDOW - span)], m[WINDOW - span :])
    start = np.arange(len(m))
    text = np.searchsorted(first, start, "right") - 1
    ok = start + LENGTH <= first[text + 1]
    start, text = start[ok], text[ok]
    low = (LOW - (m[ok] & LOW)).astype(np.int64)
    return g, text, start, start + ((low - start) & int(LOW))


def refine(bucket: np.ndarray, by: int) -> np.ndarray:
    """Bucket identifiers of each suffix and the bucket by words on, as identifiers of longer prefixes."""
    if len(bucket) <= by:
        return np.zeros(0, np.uint64)
    return T.mix(bucket[:-by] * np.uint64(0xD6E8FEB86659FD93) + bucket[by:])


def window_ids(g: np.ndarray) -> np.ndarray:
    """Identifiers of 50-word prefixes from those of 16: 16 -> 32 -> 50, each reusing the one before."""
    return refine(refine(g, Q), LENGTH - 2 * Q)


def local_groups(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the distinct (key, document, place) are, in this order; which are the first of their key, and which share it with another."""

    def shared(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        same = k[1:] == k[:-1]
        return (np.r_[True, ~same], np.r_[same, False] | np.r_[False, same]) if len(k) else (same, same)

    order = np.argsort(key)
    some = np.flatnonzero(shared(key[order])[1])
    o = order[some]
    order[some] = o[np.lexsort((at[o], doc[o], key[o]))]
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (key[a] != key[b]) | (doc[a] != doc[b]) | (at[a] != at[b])
    order = order[new]
    return order, *shared(key[order])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans of words that 50-word windows cover which occur more than once, in one document or several.

    A row for each span: its words from start_word to before end_word, and how many of them dedup removes: those of windows
    of which an equal one comes earlier (by doc_id, then place). Null, empty and short texts have no window; rows with a null
    doc_id are left out; rows repeated with one doc_id are one occurrence. Texts of any length are read whole, in memory in
    proportion to their words. An empty table gives no row. Other columns are ignored.
    """
    n = parts(docs)
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    part = lambda key: ((key >> np.uint64(20)) % np.uint64(n)).astype(np.int64)
    of_doc = lambda doc: (T.mix(doc.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)
    spread = lambda df: df.repartitionById(n, "part")

    def step1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, _, starts, ends, first in T.blocks(b.column(1)):
                g, text, _, anchor = anchors(T.hashes(data, starts, ends), first)
                if not len(anchor):
                    continue
                new = np.r_[True, anchor[1:] != anchor[:-1]]
                a, t = anchor[new], text[new]
                held.append((g[a], ids[i + t], (a - first[t]).astype(np.int32)))
                size += len(a)
                if size >= FLUSH:
                    yield from send1(held)
                    held, size = [], 0
        yield from send1(held)

    def send1(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            g, doc, at = (np.concatenate(x) for x in zip(*held))
            order, first, many = local_groups(g, doc, at)
            k, m = np.sort(order[first]), np.sort(order[many])  # as they came: so documents and places compress well
            yield from emit(0, part(g[k]), n, [g[k], doc[k], at[k]])
            yield from emit(1, of_doc(doc[m]), n, [doc[m], at[m]])

    def step2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = got_by_kind(batches, {0: [np.uint64, np.int64, np.int32], 1: [np.int64, np.int32]})
        g, doc, at = together(got[0], [np.uint64, np.int64, np.int32])
        order, _, many = local_groups(g, doc, at)
        doc, at = (np.r_[x[order[many]], y] for x, y in zip((doc, at), together(got[1], [np.int64, np.int32])))
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order]
        edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
        stop = np.r_[edge[1:], len(doc)]
        for k in range(0, len(edge), 10_000):
            pairs = list(zip(edge[k : k + 10_000], stop[k : k + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[edge[k : k + 10_000]]), pa.array([at[x:y].tobytes() for x, y in pairs], pa.binary())], ["doc_id", "at"])

    first_round = spread(texts.mapInArrow(step1, BLOBS)).mapInArrow(step2, "doc_id bigint, at binary")
    live = cut(first_round.groupBy("doc_id").agg(F.collect_list("at").alias("live")))

    def step3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for i, j, data, _, starts, ends, first in T.blocks(b.column(1)):
                g, text, start, anchor = anchors(T.hashes(data, starts, ends), first)
                if not len(anchor):
                    continue
                alive = np.zeros(len(g), bool)
                for t in range(j - i):
                    for v in lists[i + t].values if lists[i + t].is_valid else ():
                        p = np.frombuffer(v.as_buffer(), np.int32) + first[t]
                        alive[p[p < len(g)]] = True
                ok = alive[anchor]
                text, start, anchor = text[ok], start[ok], anchor[ok]
                held.append((window_ids(g)[start], ids[i + text], (start - first[text]).astype(np.int32)))
                size += len(start)
                if size >= FLUSH:
                    yield from send3(held)
                    held, size = [], 0
        yield from send3(held)

    def send3(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            w, doc, at = (np.concatenate(x) for x in zip(*held))
            order, first, many = local_groups(w, doc, at)
            k, m = np.sort(order[first]), np.sort(order[~first])
            twice = np.zeros(len(w), bool)
            twice[order[many]] = True
            yield from emit(0, part(w[k]), n, [w[k], doc[k], at[k], twice[k]])
            yield from emit(1, of_doc(doc[m]), n, [doc[m], at[m]])

    def step4(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = got_by_kind(batches, {0: [np.uint64, np.int64, np.int32, np.bool_], 1: [np.int64, np.int32]})
        w, doc, at, more = together(got[0], [np.uint64, np.int64, np.int32, np.bool_])
        known = np.unique(w[more])  # windows that some task has seen twice
        order, first, many = local_groups(w, doc, at)
        many |= np.isin(w[order], known)
        doc, at, later = doc[order[many]], at[order[many]], ~first[many]
        more_doc, more_at = together(got[1], [np.int64, np.int32])
        doc, at, later = np.r_[doc, more_doc], np.r_[at, more_at], np.r_[later, np.ones(len(more_doc), bool)]
        order = np.lexsort((at, doc))
        doc, at, later = doc[order], at[order], later[order]
        if not len(doc):
            return
        head = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (later[1:] != later[:-1])]
        tail = np.r_[head[1:], True]
        lo, hi = at[head], at[tail]
        yield from emit(0, of_doc(doc[head]), n, [doc[head], lo, hi, later[head]])

    def step5(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.int64, np.int32, np.int32, np.bool_]
        doc, lo, hi, later = together(got_by_kind(batches, {0: kinds})[0], kinds)
        order = np.lexsort((lo, doc))
        doc, lo, hi, later = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64) + LENGTH, later[order]
        if not len(doc):
            return
        number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
        wide = int(hi.max()) + 2
        a, b = lo + number * wide, hi + number * wide  # documents laid end to end, never touching
        reach = np.maximum.accumulate(b)
        head = np.r_[True, a[1:] > reach[:-1]]
        span = np.cumsum(head) - 1
        end = reach[np.r_[head[1:], True]]
        a2, b2, s2 = a[later], b[later], span[later]
        before = np.r_[0, np.maximum.accumulate(b2)[:-1]] if len(b2) else b2
        gone = np.bincount(s2, np.maximum(0, b2 - np.maximum(a2, before)), int(span[-1]) + 1).astype(np.int64)
        base = number[head] * wide
        cols = [doc[head], *((x).astype(np.int32) for x in (a[head] - base, end - base, end - a[head], gone))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in SPANS.split(", ")])

    windows = texts.join(live, "doc_id").select("doc_id", "text", "live").mapInArrow(step3, BLOBS)
    runs = spread(windows).mapInArrow(step4, BLOBS)
    return spread(runs).mapInArrow(step5, SPANS)


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir))


SQL_WORDS = r"regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')"
QUERIES = {"op3_repeated_passages": op3_repeated_passages}
ORACLE = {
    "op3_repeated_passages": f"""
WITH d AS (SELECT DISTINCT doc_id, {SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + {LENGTH}], ' ')) AS h
  FROM (SELECT *, unnest(generate_series(0, len(w) - {LENGTH})) AS s FROM d WHERE len(w) >= {LENGTH})),
g AS (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS c, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1 AS later FROM p),
r AS (SELECT doc_id, s, later, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH} THEN 0 ELSE 1 END AS head FROM g WHERE c > 1),
n AS (SELECT doc_id, s, later, sum(head) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM r),
k AS (SELECT doc_id, span, sum(least({LENGTH}, s - before)) AS gone
  FROM (SELECT doc_id, span, s, coalesce(lag(s) OVER (PARTITION BY doc_id, span ORDER BY s), -{LENGTH}) AS before FROM n WHERE later) GROUP BY ALL)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + {LENGTH} AS INTEGER) AS end_word,
  CAST(max(s) + {LENGTH} - min(s) AS INTEGER) AS n_words, CAST(coalesce(any_value(gone), 0) AS INTEGER) AS removed_words
FROM n LEFT JOIN k USING (doc_id, span) GROUP BY doc_id, span""",
}
