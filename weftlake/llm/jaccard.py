"""N-gram Jaccard join as a T-occurrence search (DivideSkip).

Every document is a query: another one is near it if it occurs in at least T of the inverted lists of the query's n-grams.
The lists of a query are divided: the short ones are merged, which leaves the documents that occur in T - L of them, and
those are binary-probed in the L long ones.

Documents first meet over the inverted lists of all their n-grams (short hashes of them), where each learns which of its
grams are shared and who is first in their lists: its leaders. A document with fewer shared grams than T is finished. The
others go, with all their grams, to the blocks of as many leaders, the largest first, as any near document must share one
of, and there the search is made and counts are exact. So no pair is lost, at any size of document.

Groups of copies never meet in one task: equal sets of n-grams are found by their hashes, first among the rows at hand,
then everywhere, and only the least document of a set takes part. A block of much text is split into parts, and each pair
of parts is searched by a task of its own. A block gives a count of links for each document and a forest that connects
them, never its pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .blobs import BLOBS, emit, got_by_kind, together
from .cluster import cut, documents, join_small, parts

N, THRESHOLD = 4, 0.4
#: DivideSkip's parameter: the longer the lists, the fewer are probed.
MU = 0.01
#: N-grams that are exchanged at once, and those of a part of a block.
FLUSH, PART = 1 << 21, 1 << 20
#: Edges up to which connected groups are found on the driver.
FEW = 200_000
FOUND = "doc_id bigint, class_id bigint, text_id bigint, n_links bigint, n_copies bigint"


def gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number and sorted distinct n-gram hashes of each text that has words; fewer words than n are one gram."""
    for i, j, data, _, starts, ends, first in T.blocks(texts):
        h = T.hashes(data, starts, ends)
        for t in range(j - i):
            w = h[first[t] : first[t + 1]]
            if len(w):
                yield i + t, np.unique(T.grams(w, min(n, len(w))))


def heap_merge(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Documents in at least so many of the sorted lists, with how often they occur."""
    out: list[tuple[int, int]] = []
    last, n = -1, 0
    for d in heapq.merge(*(x.tolist() for x in lists)):
        if d != last:
            if n >= least:
                out.append((last, n))
            last, n = d, 0
        n += 1
    return out + [(last, n)] if n >= least else out


class Lists:
    """Inverted lists of a block: the sorted documents of each gram, end to end."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.size = np.array([len(s) for s in sets])
        doc = np.repeat(np.arange(self.n), self.size)
        grams = np.concatenate(sets)
        order = np.argsort(grams, kind="stable")
        new = np.r_[True, grams[order][1:] != grams[order][:-1]]
        number = np.empty(len(grams), np.int64)
        number[order] = np.cumsum(new) - 1
        self.begin = np.r_[np.flatnonzero(new), len(grams)]
        self.length = np.diff(self.begin)
        self.docs = doc[order]
        self.key = (np.cumsum(new) - 1) * self.n + self.docs
        self.of = np.split(number, np.cumsum(self.size)[:-1])

    def near(self, q: int, threshold: float, after: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Documents after q, or all others, with a Jaccard similarity of at least the threshold, and their overlap."""
        lists = self.of[q]
        lists = lists[self.length[lists] > 1]
        t = max(1, ceil(threshold * self.size[q] - 1e-9))
        none = np.zeros(0, np.int64)
        if len(lists) < t:
            return none, none
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        long = min(t - 1, int(t / (MU * log2(max(2, self.length[lists[-1]])) + 1)))
        short, long_lists = lists[: len(lists) - long], lists[len(lists) - long :]
        if self.length[short].sum() <= 32:
            merged = heap_merge([self.docs[self.begin[x] : self.begin[x + 1]] for x in short], t - long)
            found = np.array([d for d, _ in merged], np.int64)
            count = np.array([c for _, c in merged], np.int64)
        else:  # the same merge for long input, by counting
            n = self.length[short]
            at = np.repeat(self.begin[short] - np.cumsum(n) + n, n) + np.arange(n.sum())
            seen = np.bincount(self.docs[at], minlength=self.n)
            found = np.flatnonzero(seen >= t - long)
            count = seen[found]
        ok = (found > q if after else found != q) & (self.size[found] * threshold <= self.size[q] + 1e-9) & (self.size[q] * threshold <= self.size[found] + 1e-9)
        found, count = found[ok], count[ok]
        if long and len(found):
            for k in range(0, len(found), 4096):
                probe = long_lists[None, :] * self.n + found[k : k + 4096, None]
                at = np.minimum(np.searchsorted(self.key, probe), len(self.key) - 1)
                count[k : k + 4096] += (self.key[at] == probe).sum(1)
        ok = count >= threshold * (self.size[q] + self.size[found] - count) - 1e-9
        return found[ok], count[ok]


def shared_grams(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(document, leader, grams that the two share first, grams needed) from the entries (gram, owner, ids, needs) of some
    inverted lists; grams of one document alone don't count."""
    ids = [r[2] for r in rows]
    docs, place = np.unique(np.concatenate(ids), return_inverse=True)
    need = np.full(len(docs), np.iinfo(np.uint32).max, np.uint32)
    np.minimum.at(need, place, np.concatenate([r[3] for r in rows]))
    begin = np.cumsum([0, *map(len, ids)])
    key = np.concatenate([r[0].astype(np.uint64) << np.uint64(32) | place[b + r[1]].astype(np.uint64) for r, b in zip(rows, begin)])
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]]
    gram, doc = key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)
    head = np.r_[True, gram[1:] != gram[:-1]]
    first = np.flatnonzero(head)
    many = np.repeat(np.diff(np.r_[first, len(key)]) > 1, np.diff(np.r_[first, len(key)]))
    pair = (doc << np.uint64(32) | doc[first][np.cumsum(head) - 1])[many]
    pair.sort()
    new = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(pair)]).astype(np.uint32)
    d, leader = (pair[new] >> np.uint64(32)).astype(np.int64), (pair[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return docs[d], docs[leader], count, need[d]


def leaders_of(doc: np.ndarray, leader: np.ndarray, shared: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, where their leaders begin, those leaders (ascending) and the grams needed.

    A near document shares at least need of a document's grams. In one order of all grams, here the leaders' from the largest
    on, the two share one of each one's first total - need + 1, so the leaders of these are enough (those of rare grams are large).
    """
    none = np.zeros(0, np.int64)
    if not len(doc):
        return none, np.zeros(1, np.int64), none, none
    order = np.lexsort((-leader, doc))
    doc, leader, shared, need = doc[order], leader[order], shared[order].astype(np.int64), need[order].astype(np.int64)
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (leader[1:] != leader[:-1])])
    shared, doc, leader, need = np.add.reduceat(shared, new), doc[new], leader[new], np.minimum.reduceat(need, new)
    head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(doc)]))
    least = np.minimum.reduceat(need, head)
    before = np.cumsum(shared) - shared
    before -= before[head][of]
    keep = before <= (np.add.reduceat(shared, head) - least)[of]
    of, leader = of[keep][::-1], leader[keep][::-1]  # documents from last to first, leaders ascending
    n = np.bincount(of, minlength=len(head))
    back = np.argsort(of, kind="stable")
    some = n > 0
    return doc[head][some], np.r_[0, np.cumsum(n[some])], leader[back], least[some]


def _meet(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(doc_id, leaders, weight, twin), written: a row with leaders for each document that may be near one, and a row with
    twin for each one that has the n-grams of another: the least such document, or one that has a twin itself."""
    p = parts(docs)
    hashed = lambda ids: (T.mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(p)).astype(np.int64)

    def step1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = rows = 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, grams in gram_sets(b.column(1), n):
                key = xxhash.xxh3_128_digest(grams.tobytes())
                if key in held:
                    held[key][1].append(int(ids[i]))
                else:
                    held[key] = [grams, [int(ids[i])]]
                    size += len(grams)
                rows += 1
                if size >= FLUSH or len(held) >= 60_000 or rows >= FLUSH:
                    yield from send(held)
                    held, size, rows = {}, 0, 0
        yield from send(held)

    def send(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        least = np.array([min(ids) for _, ids in held.values()], np.int64)
        sizes = np.array([len(g) for g, _ in held.values()])
        need = np.array([max(1, ceil(threshold * k - 1e-9)) for k in sizes], np.uint32)
        g = np.concatenate([g for g, _ in held.values()])
        yield from emit(0, ((g >> np.uint64(40)) % np.uint64(p)).astype(np.int64), p, [g.astype(np.uint32)], (np.repeat(np.arange(len(sizes)), sizes), least, need))
        h = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
        yield from emit(1, (h[:, 0] % np.uint64(p)).astype(np.int64), p, [h[:, 0], h[:, 1], least])
        copies = [(d, m) for (_, ids), m in zip(held.values(), least.tolist()) for d in set(ids) if d != m]
        doc, twin = (np.array(x, np.int64) for x in zip(*copies)) if copies else (np.zeros(0, np.int64),) * 2
        yield from emit(2, hashed(doc), p, [doc, twin])

    def step2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = got_by_kind(batches, {0: [np.uint32, np.uint16, np.int64, np.uint32], 1: [np.uint64, np.uint64, np.int64], 2: [np.int64, np.int64]})
        if got[0]:
            found = shared_grams(got[0])
            yield from emit(0, hashed(found[0]), p, list(found))
        a, b, doc = together(got[1], [np.uint64, np.uint64, np.int64])
        if len(doc):
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            head = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            yield from emit(1, hashed(doc), p, [doc, doc[np.flatnonzero(head)][np.cumsum(head) - 1]])
        doc, twin = together(got[2], [np.int64, np.int64])
        yield from emit(2, hashed(doc), p, [doc, twin])

    def step3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = got_by_kind(batches, {0: [np.int64, np.int64, np.uint32, np.uint32], 1: [np.int64, np.int64], 2: [np.int64, np.int64]})
        doc, begin, leaders, need = leaders_of(*together(got[0], [np.int64, np.int64, np.uint32, np.uint32]))
        one, least = together(got[1], [np.int64, np.int64])
        alive = np.isin(doc, one[one == least])  # the least document of one of its sets
        lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(leaders)).filter(pa.array(alive))
        weight = (need[alive] / threshold).astype(np.int64)
        doc = doc[alive]
        copy, twin = together(got[2], [np.int64, np.int64])
        other = one != least
        copy, twin = np.r_[copy, one[other]], np.r_[twin, least[other]]
        nulls = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays([pa.array(doc), lists, pa.array(weight), nulls(len(doc), pa.int64())], ["doc_id", "leaders", "weight", "twin"])
        yield pa.RecordBatch.from_arrays([pa.array(copy), nulls(len(copy), pa.list_(pa.int64())), nulls(len(copy), pa.int64()), pa.array(twin)], ["doc_id", "leaders", "weight", "twin"])

    spread = lambda df: df.repartitionById(p, "part")
    return cut(spread(spread(docs.mapInArrow(step1, BLOBS)).mapInArrow(step2, BLOBS)).mapInArrow(step3, "doc_id bigint, leaders array<bigint>, weight bigint, twin bigint"))


class Forest:
    """Connected groups of the documents of a block, and the links that connect them."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, q: int, found: np.ndarray) -> None:
        roots = self.root[found]
        if not (roots != self.root[q]).any():
            return
        new, at = np.unique(roots, return_index=True)
        at = at[new != self.root[q]]
        self.edges += [(q, int(f)) for f in found[at]]
        self.root[np.isin(self.root, np.r_[new, self.root[q]])] = min(int(new[0]), int(self.root[q]))


def search_block(block: int, cross: bool, ids: np.ndarray, part: np.ndarray, leaders: list[np.ndarray], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each document of a block, and a forest of them. Left out: pairs of equal sets, pairs of one id, pairs that share
    a lesser leader (they belong to its block) and, in the search of two different parts, pairs within one."""
    lists = Lists(sets)
    count, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    below = [x[x < block] for x in leaders]
    flat = np.concatenate(below) if below else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(ids)), [len(x) for x in below])
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], of[order]
    for q in range(lists.n):
        if cross and part[q] != part.min():
            continue
        found, overlap = lists.near(q, threshold, after=not cross)
        ok = (ids[found] != ids[q]) & ((overlap != lists.size[found]) | (overlap != lists.size[q]))
        if cross:
            ok &= part[found] != part[q]
        found = found[ok]
        if len(found) and len(below[q]):
            lo, hi = np.searchsorted(flat, below[q], "left"), np.searchsorted(flat, below[q], "right")
            elsewhere = np.zeros(len(ids), bool)
            for a, b in zip(lo, hi):
                elsewhere[of[a:b]] = True
            found = found[~elsewhere[found]]
        if len(found):
            count[q] += len(found)
            count[found] += 1
            forest.join(q, found)
    return count, forest.edges


def jaccard_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, twin) of documents with the n-grams of another, and of those that no other one stands for
    (doc_id, other, links): links found with texts that differ, and the links of forests that connect them."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    met = _meet(texts, n, threshold)
    live = met.where("leaders is not null").select("doc_id", F.explode("leaders").alias("leader"), "weight")
    sizes = cut(live.groupBy("leader").agg(F.ceil(F.sum("weight") / PART).alias("split")).where("split > 1"))
    split = F.coalesce("split", F.lit(1)).cast("int").alias("split")
    led = cut(join_small(live, sizes, "leader", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("leader", split))).alias("leaders")))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, leaders = b.column(0), b.column(2)
            rows: list[tuple] = []
            size = 0
            for i, grams in gram_sets(b.column(1), n):
                raw, doc, mine = grams.tobytes(), ids[i].as_py(), leaders[i].as_py()
                names = np.array([x["leader"] for x in mine], np.int64).tobytes()
                for x in mine:
                    k = int(T.mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(x["split"]))
                    rows += [(x["leader"], min(j, k), max(j, k), doc, k, names, raw) for j in range(x["split"])]
                    size += len(raw) * x["split"]
                if size >= 8 << 20 or len(rows) >= 5000:
                    yield sent(rows)
                    rows, size = [], 0
            if rows:
                yield sent(rows)

    shipped = "block bigint, i int, j int, doc_id bigint, k int, leaders binary, grams binary"
    names = [c.split()[0] for c in shipped.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def search(table: pa.Table) -> pa.Table:
        block, i, j = (table.column(c)[0].as_py() for c in ("block", "i", "j"))
        least: dict[bytes, tuple] = {}
        for d, k, lead, grams in zip(*(table.column(c).to_pylist() for c in ("doc_id", "k", "leaders", "grams"))):
            if grams not in least or d < least[grams][0]:  # of equal sets, and of repeated rows, one
                least[grams] = d, k, lead
        ids, part = (np.array(x) for x in list(zip(*least.values()))[:2])
        count, edges = search_block(block, i != j, ids, part, [np.frombuffer(x[2], np.int64) for x in least.values()], [np.frombuffer(g, np.uint64) for g in least], threshold) if len(least) > 1 else (np.zeros(len(ids), np.int64), [])
        some = np.flatnonzero(count)
        a, b = (ids[list(x)] for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(np.r_[ids[some], a]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b)]), pa.concat_arrays([pa.array(count[some]), pa.nulls(len(a), pa.int64())])], names=["doc_id", "other", "links"])

    sets = join_small(texts, led, "doc_id").select("doc_id", "text", "leaders").mapInArrow(ship, shipped)
    links = cut(sets.groupBy("block", "i", "j").applyInArrow(search, "doc_id bigint, other bigint, links bigint"))
    return met.where("twin is not null").select("doc_id", "twin"), links


def jaccard_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document that is near another one: two are linked if their sets of word n-grams have a Jaccard similarity
    of at least the threshold.

    class_id is the least document of the connected group, text_id the least one with the same n-grams, n_copies the number
    of others with these, n_links the number of linked documents of other n-grams, of which each text_id counts once. Copies
    have the links of their text_id. Every link is found; texts that differ are compared exactly but for 64-bit hashes.

    Null, empty and wordless texts give no row; texts of fewer words than n have one n-gram. Rows with a null doc_id are left out,
    equal rows count once; a doc_id with several texts has the links of all of them. Texts of any length are read whole: they
    take memory in proportion to their words. An empty table gives no row. Other columns are ignored.
    """
    twins, links = jaccard_links(docs, n, threshold)
    up = twins.select(F.col("doc_id").alias("twin"), F.col("twin").alias("up"))
    copies = cut(twins.join(up, "twin", "left").select("doc_id", F.coalesce("up", "twin").alias("text_id")).where("doc_id != text_id").distinct())
    counted = links.where("other is null").groupBy("doc_id").agg(F.sum("links").alias("n_links"))
    group = components(links.where("other is not null").select(F.col("doc_id").alias("doc_a"), F.col("other").alias("doc_b")))
    per = copies.groupBy(F.col("text_id").alias("doc_id")).agg(F.count("text_id").alias("n_copies"))
    texts = counted.join(per, "doc_id", "full").join(group, "doc_id", "left")
    texts = cut(texts.select(F.col("doc_id").alias("text_id"), F.coalesce("keep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies")))
    own = texts.select(F.col("text_id").alias("doc_id"), "text_id").unionByName(copies)
    return own.join(texts, "text_id").select("doc_id", "class_id", "text_id", "n_links", "n_copies")


def components(pairs: DataFrame) -> DataFrame:
    """(doc_id, keep): the least document of the connected group of each document in a pair but for that one."""
    edges = cut(pairs.select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).where("a < b").distinct())
    if edges.count() <= FEW:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges.toArrow().to_pandas().itertuples(index=False):
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        found = [(x, find(x)) for x in list(root) if find(x) != x]
        return edges.sparkSession.createDataFrame(found, "doc_id bigint, keep bigint")
    while True:  # every document is linked to the least of its neighbours, larger ones then smaller ones, until all are stars
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = cut(both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a").select(F.least("a", "m").alias("a"), "b").distinct())
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).distinct()
        nxt = cut(small)
        same = nxt.count() == edges.count() and nxt.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = nxt
        if same:
            break
    return edges.select(F.col("b").alias("doc_id"), F.col("a").alias("keep"))


def _keyed(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a key of their own: doc_id where it is not null and not repeated, else a hash of id and text, larger than
    common ids. Of rows with one such id and text the first in order of a hash stays."""
    odd = cut(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"))
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id"))
    known = F.broadcast(odd) if odd.count() < 100_000 else odd
    known = known.select(F.col("doc_id").alias("__id"))
    same = docs["doc_id"].eqNullSafe(known["__id"])
    plain = docs.join(known, same, "left_anti").withColumn(key, F.col("doc_id"))
    rest = docs.join(known, same, "left_semi").withColumn(key, F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2))
    inner = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = rest.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*inner) if inner else F.lit(0)).alias("__row"))
    return plain.unionByName(first.select(*(F.col("__row")[c].alias(c) for c in docs.columns), key))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, but for those near a row before them: one of each connected group is left.

    The one of the least doc_id stays; rows whose doc_id is null or repeated are judged each by its own text and come last, and of
    those that repeat id and text one stays. Documents near no other one stay, those without words too, unless they repeat.
    """
    keyed = _keyed(docs, "__key")
    found = jaccard_classes(keyed.select(F.col("__key").alias("doc_id"), "text"), n, threshold)
    gone = cut(found.where("doc_id != class_id").select(F.col("doc_id").alias("__key")))
    return join_small(keyed, gone, "__key", "left_anti").select(*docs.columns)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(documents(spark, sf_dir))


SQL_WORDS = r"regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+')"
QUERIES = {"op2_jaccard_join": op2_jaccard_join}
ORACLE = {
    "op2_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(generate_series(0, greatest(0, len(w) - {N})), lambda i: array_to_string(w[i + 1:i + {N}], ' ')))) AS g FROM w WHERE len(w) > 0),
c AS (SELECT g, min(doc_id) AS doc_id, list(doc_id) AS members FROM g GROUP BY g),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM c),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, a.n AS na, b.n AS nb, count(*) AS overlap FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT doc_a, doc_b FROM o WHERE overlap >= {THRESHOLD} * (na + nb - overlap) - 1e-9),
e AS (SELECT doc_a AS a, doc_b AS b FROM l UNION ALL SELECT doc_b, doc_a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a),
m AS (SELECT doc_id AS text_id, unnest(members) AS doc_id, len(members) - 1 AS n_copies FROM c)
SELECT doc_id, coalesce(class_id, text_id) AS class_id, text_id, coalesce(n_links, 0) AS n_links, n_copies
FROM m LEFT JOIN k ON k.a = text_id LEFT JOIN n ON n.a = text_id WHERE n_links IS NOT NULL OR n_copies > 0""",
}
