"""Embedding near-dedup over a robust-pruned flat graph.

Vectors go to the shards of their nearest centroids, so shards overlap. Each shard links its vectors to near ones, pruned so
that no link is kept that a shorter one makes needless; a vector's lists from all its shards are united. Every vector is a
query in its shards and, as a visitor, in the next nearest one: over the part of the united graph that is there, a greedy
search from the medoid and its own list with a beam, then, where the beam reached the range, outwards over everything in
range. The links found for some vectors are held against brute force over all vectors, at every size; if recall is too
low, shards overlap more and beams widen. Similarities are exact for every link.

Equal vectors never meet in one task: they are found by hashes, and one stands for them. A shard with many vectors is split,
and each pair of parts is searched by a task of its own. A shard gives counts of links and a forest, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .cluster import cut, join_small
from .jaccard import Forest, components

THRESHOLD = 0.95
#: Vectors that a shard has on average, most of a part of one; most centroids; links of a vector in one shard, candidates they are pruned from; beam.
SHARD, PART, CENTROIDS, LINKS, CANDIDATES, BEAM = 2000, 6000, 4096, 32, 64, 12
#: Shards that a vector is a member of, and those that it visits besides; rounds of k-means.
ALPHA, OVERLAP, VISITS, ROUNDS = 1.2, 2, 1, 3
#: How far below the threshold the range search still goes outwards.
WIDER = 0.05
#: Vectors that are audited of all, and of those with links; share of their links that must have been found.
AUDITED, RECALL = 256, 0.9
FOUND = "vec_id bigint, other bigint, links bigint"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column whose lists have one length and no nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding): one finite, non-zero vector for each id, all of the commonest length."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.where("vec_id is not null and size(embedding) > 0").where(finite).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<float>")).alias("embedding"))
    v = cut(v)
    top = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.where(F.size("embedding") == (top.n if top else 0))


def centroids(vectors: DataFrame, k: int) -> np.ndarray:
    """Spherical k-means over all vectors from the k of the lowest hashes of vec_id."""
    spark = vectors.sparkSession
    centre = matrix(vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).select("embedding").toArrow()["embedding"])
    for _ in range(ROUNDS if k > 1 else 0):
        now = spark.sparkContext.broadcast(centre)

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(now.value)
            for b in batches:
                x = matrix(b.column(0))
                np.add.at(total, (x @ now.value.T).argmax(1), x)
            some = np.flatnonzero(np.abs(total).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["c", "s"])

        def add(t: pa.Table) -> pa.Table:
            s = np.stack(t["s"].to_numpy()).sum(0)
            return pa.table([t["c"][:1].combine_chunks(), pa.array([s], pa.list_(pa.float64()))], names=["c", "s"])

        schema = "c bigint, s array<double>"
        for r in vectors.select("embedding").mapInArrow(sums, schema).groupBy("c").applyInArrow(add, schema).collect():
            s = np.array(r.s)
            centre[r.c] = s / (np.linalg.norm(s) or 1)
    return centre


def robust_prune(x: np.ndarray, links: int = LINKS, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Links of each row, -1 where it has fewer: of its nearest rows, by distance, those not nearer to one already linked."""
    n = len(x)
    out = np.full((n, links), -1, np.int64)
    c = min(candidates, n - 1)
    for i in range(0, n if c > 0 else 0, 256):
        near = x[i : i + 256] @ x.T
        rows = np.arange(len(near))
        near[rows, i + rows] = -np.inf
        at = np.argpartition(-near, c - 1, axis=1)[:, :c]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, 1), axis=1, kind="stable"), 1)
        far = 1 - np.take_along_axis(near, at, 1)
        own = x[at]
        between = 1 - own @ own.transpose(0, 2, 1)
        alive, count = np.ones(at.shape, bool), np.zeros(len(at), int)
        for j in range(c):
            keep = alive[:, j] & (count < links)
            out[i + rows[keep], count[keep]] = at[keep, j]
            count += keep
            alive &= ~(keep[:, None] & (alpha * between[:, j] <= far))
    return out


def both_ways(links: np.ndarray) -> list[np.ndarray]:
    """Each row's links, and the rows that link to it: its nearest ones where they are many."""
    r, rank = np.nonzero(links >= 0)
    to = links[r, rank]
    order = np.lexsort((rank, to))
    begin = np.searchsorted(to[order], np.arange(len(links) + 1))
    return [np.union1d(row[row >= 0], r[order[a:b]][: 2 * LINKS]) for row, a, b in zip(links, begin, begin[1:])]


class Graph:
    """The part of the united graph that is in one shard: rows' neighbours, -1 where there are fewer."""

    def __init__(self, ids: np.ndarray, lists: list[np.ndarray]):
        order = np.argsort(ids)
        of = np.repeat(np.arange(len(ids)), [len(v) for v in lists])
        to = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        at = order[np.minimum(np.searchsorted(ids[order], to), len(ids) - 1)]
        here = (ids[at] == to) & (at != of)
        of, at = of[here], at[here]
        n = np.bincount(of, minlength=len(ids))
        self.links = np.full((len(ids), max(1, int(n.max(initial=0)))), -1, np.int32)
        self.links[of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)] = at


def range_search(x: np.ndarray, links: np.ndarray, medoid: int, threshold: float, beam: int = BEAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other row) that reach the threshold, as every row's search finds them."""
    n, width = len(x), links.shape[1]
    small = x.astype(np.float32)
    for i in range(0, n, 512):
        q = np.arange(i, min(n, i + 512))
        rows = np.arange(len(q))
        seen, opened = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        seen[rows, q] = opened[rows, q] = True
        beam_id, beam_sim = np.zeros((len(q), beam), np.int32), np.full((len(q), beam), -3, np.float32)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def visit(r: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Similarities of pairs of a query and a node that are new; those in range are noted."""
            seen[r, nodes] = True
            sims = np.concatenate([np.einsum("ij,ij->i", small[q[r[a : a + 65536]]], small[nodes[a : a + 65536]]) for a in range(0, len(r), 65536)]) if len(r) else np.zeros(0, np.float32)
            ok = sims >= threshold - WIDER
            near.append((r[ok], nodes[ok], sims[ok]))
            return r, nodes, sims

        def into_beam(live: np.ndarray, nodes: np.ndarray) -> None:
            new = nodes >= 0
            new[new] = ~seen[np.repeat(live, new.sum(1)), nodes[new]]
            a, c = np.nonzero(new)
            sims = np.full(nodes.shape, -3, np.float32)
            sims[a, c] = visit(live[a], nodes[a, c])[2]
            ids, sims = np.concatenate([beam_id[live], nodes], 1), np.concatenate([beam_sim[live], sims], 1)
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            beam_id[live], beam_sim[live] = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)

        into_beam(rows, np.full((len(q), 1), medoid, np.int32))
        into_beam(rows, links[q])
        live = rows
        while len(live):  # the greedy search: open the best node of each beam that is still closed
            value = np.where((beam_sim[live] < -2) | opened[live[:, None], beam_id[live]], -3, beam_sim[live])
            best = value.argmax(1)
            go = value[np.arange(len(live)), best] > -2
            node, live = beam_id[live, best][go], live[go]
            opened[live, node] = True
            if len(live):
                into_beam(live, links[node])
        done = 0
        while done < len(near):  # then outwards over the range
            r, node, _ = (np.concatenate(c) for c in zip(*near[done:]))
            done = len(near)
            closed = ~opened[r, node]
            r, node = r[closed], node[closed]
            opened[r, node] = True
            for a in range(0, len(r), 1 << 14):
                to = links[node[a : a + (1 << 14)]].ravel()
                of = np.repeat(r[a : a + (1 << 14)], width)
                new = to >= 0
                new[new] = ~seen[of[new], to[new]]
                key = np.unique(of[new].astype(np.int64) * n + to[new])
                if len(key):
                    visit(key // n, key % n)
        r, node, sims = (np.concatenate(c) for c in zip(*near))
        ok = sims >= threshold - 1e-3
        r, node = q[r[ok]], node[ok].astype(np.int64)
        for a in range(0, len(r), 65536):
            exact = np.einsum("ij,ij->i", x[r[a : a + 65536]], x[node[a : a + 65536]]) >= threshold
            yield r[a : a + 65536][exact], node[a : a + 65536][exact]


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP, beam: int = BEAM) -> DataFrame:
    """A row for each vector: two are linked if their cosine similarity is at least the threshold.

    class_id is the least vec_id of the connected group, same_as the least one of an equal vector, n_copies the number of
    other equal vectors, n_links the number of linked vectors that differ, of which each same_as counts once. Copies have the
    links of their same_as. A vector without links has its own class.

    Left out: null ids, null, empty and all-zero vectors, those with a null, infinite or NaN element or not of the commonest
    length (of equally common ones the longest). Of rows that repeat an id the least vector counts. An empty table gives no
    row. Other columns are ignored. Links are a subset of the true ones, of which the audit has found RECALL or more.
    """
    v = usable(vectors)
    keys = ["h1", "h2"]
    hashed = v.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    least = cut(hashed.groupBy(*keys).agg(F.min(F.struct("vec_id", "embedding")).alias("m"), F.count("vec_id").alias("n")).select(*keys, "m.*", "n"))
    distinct = least.select("vec_id", "embedding")
    n = distinct.count()
    k = max(1, min(CENTROIDS, -(-n // SHARD)))
    centre = centroids(distinct, k) if n else np.zeros((0, 1))
    while True:
        found = cut(_search(distinct, centre, threshold, min(k, overlap), beam)) if n else vectors.sparkSession.createDataFrame([], FOUND)
        counted = cut(found.where("other is null").groupBy("vec_id").agg(F.sum("links").alias("n_links")))
        if not n or beam >= PART or audit(distinct, counted, threshold) >= RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    group = components(found.where("other is not null").select(F.col("vec_id").alias("doc_a"), F.col("other").alias("doc_b"))).select(F.col("doc_id").alias("vec_id"), F.col("keep").alias("class_id"))
    per = least.select(*keys, F.col("vec_id"), (F.col("n") - 1).alias("n_copies")).join(counted, "vec_id", "left").join(group, "vec_id", "left")
    per = per.select(*keys, F.coalesce("class_id", "vec_id").alias("class_id"), F.col("vec_id").alias("same_as"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return hashed.select("vec_id", *keys).join(per, keys).drop(*keys)


def _search(vectors: DataFrame, centre: np.ndarray, threshold: float, overlap: int, beam: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(centre)
    reach = min(len(centre), overlap + VISITS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = matrix(b.column(1)) @ shared.value.T
            mine = np.argpartition(-near, reach - 1, axis=1)[:, :reach]
            mine = np.take_along_axis(mine, np.argsort(-np.take_along_axis(near, mine, 1), 1, kind="stable"), 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(mine), pa.list_(pa.int64()))], ["vec_id", "embedding", "shards"])

    assigned = cut(vectors.mapInArrow(assign, "vec_id bigint, embedding array<float>, shards array<bigint>"))
    sizes = assigned.select(F.explode("shards").alias("shard")).groupBy("shard").agg(F.ceil(F.count("shard") / PART).cast("int").alias("split")).where("split > 1")
    split = np.ones(len(centre), np.int64)  # there are CENTROIDS at most
    for r in sizes.collect():
        split[r.shard] = r.split

    def place(count: int, extra: int):
        """A row for each task in which a vector takes part: shard and pair of parts, and the vector's part."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_numpy()
                shards = b.column(2).flatten().to_numpy().reshape(len(ids), -1)[:, :count]
                row = np.repeat(np.arange(len(ids)), shards.shape[1])
                shard = shards.ravel()
                times = split[shard]
                part = (T.mix(ids.view(np.uint64))[row] % times.astype(np.uint64)).astype(np.int64)
                at = np.repeat(np.arange(len(row)), times)
                other = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                row, shard, part = row[at], shard[at], part[at]
                take = pa.array(row)
                more = [b.column(c + 2).take(take) for c in range(extra)]
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.minimum(part, other)), pa.array(np.maximum(part, other)), pa.array(part), b.column(0).take(take), b.column(1).take(take), *more], ["shard", "i", "j", "part", "vec_id", "embedding", *["shards", "links"][:extra]])

        return run

    def build(t: pa.Table) -> pa.Table:
        ids = t["vec_id"].to_numpy()
        lists = [ids[x] for x in both_ways(robust_prune(matrix(t["embedding"])))]
        return pa.table([t["vec_id"].combine_chunks(), pa.array(lists, pa.list_(pa.int64()))], names=["vec_id", "links"])

    def search(t: pa.Table) -> pa.Table:
        shard, cross = t["shard"][0].as_py(), t["i"][0].as_py() != t["j"][0].as_py()
        t = t.sort_by("vec_id")
        ids, x, part = t["vec_id"].to_numpy(), matrix(t["embedding"]), t["part"].to_numpy()
        graph = Graph(ids, [np.array(v.as_py() or [], np.int64) for v in t["links"]])
        own = t["shards"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        near = np.zeros((len(ids), len(ids)), bool)
        for a, b in range_search(x, graph.links, int((x @ x.mean(0)).argmax()), threshold, min(beam, len(ids))):
            near[np.minimum(a, b), np.maximum(a, b)] = True
        count, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        for a in np.flatnonzero(near.any(1)):
            b = np.flatnonzero(near[a])
            if cross:
                b = b[part[b] != part[a]]
            both = (own[b][:, :, None] == own[a][None, None, :]).any(2)
            b = b[np.where(both, own[b], len(split)).min(1, initial=len(split)) == shard]  # of several shards that they share, the first
            if len(b):
                count[a] += len(b)
                count[b] += 1
                forest.join(a, b)
        some = np.flatnonzero(count)
        u, w = (ids[list(c)] for c in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
        return pa.table([pa.array(np.r_[ids[some], u]), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(w)]), pa.concat_arrays([pa.array(count[some]), pa.nulls(len(u), pa.int64())])], names=["vec_id", "other", "links"])

    placed = "shard bigint, i bigint, j bigint, part bigint, vec_id bigint, embedding array<float>"
    where = ["shard", "i", "j"]
    graph = assigned.mapInArrow(place(overlap, 0), placed).groupBy(*where).applyInArrow(build, "vec_id bigint, links array<bigint>")
    united = graph.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links"))
    linked = assigned.join(united, "vec_id").select("vec_id", "embedding", "shards", "links")
    return linked.mapInArrow(place(reach, 2), placed + ", shards array<bigint>, links array<bigint>").groupBy(*where).applyInArrow(search, FOUND)


def audit(vectors: DataFrame, counted: DataFrame, threshold: float, queries: int = AUDITED) -> float:
    """Share of the links of some vectors that were found; brute force over all vectors.

    Asked are so many of all vectors and so many of those with links, of the lowest hashes of vec_id: the first catch
    vectors of which no link was found, the second have links even where these are rare. Without any link it is 1.
    """
    order = (F.xxhash64("vec_id"), "vec_id")
    some = vectors.orderBy(*order).limit(queries).select("vec_id").union(counted.orderBy(*order).limit(queries).select("vec_id")).distinct()
    asked = vectors.join(F.broadcast(some), "vec_id", "left_semi").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, x = asked["vec_id"].to_numpy(), matrix(asked["embedding"])
    sent = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qi, qx = sent.value
        total = np.zeros(len(qi), np.int64)
        for b in batches:
            own, y = b.column(0).to_numpy(), matrix(b.column(1))
            for a in range(0, len(y), 4096):
                total += ((y[a : a + 4096] @ qx.T >= threshold) & (own[a : a + 4096, None] != qi)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(qi), pa.array(total)], ["vec_id", "links"])

    true = vectors.select("vec_id", "embedding").mapInArrow(brute, "vec_id bigint, links bigint").groupBy("vec_id").agg(F.sum("links").alias("links"))
    r = true.join(join_small(counted, some, "vec_id", "left_semi"), "vec_id", "left").agg(F.sum("links").alias("n"), F.sum("n_links").alias("hit")).first()
    return (r.hit or 0) / r.n if r.n else 1.0


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_embedding_near_dedup": op8_embedding_near_dedup}
ORACLE = {
    "op8_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, min(embedding) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 GROUP BY vec_id),
c AS (SELECT e, min(vec_id) AS vec_id, list(vec_id) AS m FROM v WHERE len(e) = (SELECT mode(len(e)) FROM v) GROUP BY e),
p AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM c a JOIN c b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) >= {THRESHOLD}),
l AS (SELECT vec_a AS a, vec_b AS b FROM p UNION ALL SELECT vec_b, vec_a FROM p),
r AS (SELECT a, a AS b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
x AS (SELECT vec_id AS same_as, unnest(m) AS vec_id, len(m) - 1 AS n_copies FROM c)
SELECT vec_id, coalesce(class_id, same_as) AS class_id, same_as, coalesce(n_links, 0) AS n_links, n_copies FROM x LEFT JOIN k ON k.a = same_as LEFT JOIN n ON n.a = same_as""",
}
