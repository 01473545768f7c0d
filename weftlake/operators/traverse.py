"""Loops over the edges: reachability, cycles, layers and longest paths.

Each round joins the edges with a frontier that is written to the shared folder, so plans stay short and a lost executor
costs one round. A frontier is broadcast only if its measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CycleDetected
from ..runtime import bucketed, cut, held, light


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _kept(table: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows whose column is (or, with left_anti, isn't) one of the distinct ids. Only the ids of a task are held, the table isn't sorted."""
    return table.join(held(ids.select(F.col("unique_id").alias(column))), column, how)


def reach(edges: DataFrame, starts: DataFrame, depth: int | None = None, upstream: bool = False) -> DataFrame:
    """(unique_id, depth) of the starts (0) and of all nodes that they lead to, with the fewest hops; no more than depth."""
    a, b = ("dst", "src") if upstream else ("src", "dst")
    pairs = cut(edges.select(F.col(a).alias("unique_id"), F.col(b).alias("next")).where(F.col(a) != F.col(b)), by="unique_id")
    levels = [cut(starts.select("unique_id").distinct().withColumn("depth", F.lit(0)))]
    while depth is None or len(levels) <= depth:
        step = _kept(pairs, levels[-1], "unique_id").select(F.col("next").alias("unique_id")).distinct()
        new = cut(_kept(step, _union(levels), "unique_id", "left_anti").withColumn("depth", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
    return _union(levels)


def path_through(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """The nodes, all that they come from and all that they lead to."""
    return reach(edges, starts).select("unique_id").union(reach(edges, starts, upstream=True).select("unique_id")).distinct()


def layers(nodes: DataFrame, edges: DataFrame, cyclic: str = "error") -> DataFrame:
    """(unique_id, layer): 0 for nodes that nothing leads to, else one more than the highest before.

    On a cycle an error, or, if cyclic is "spread", a layer for each node, in order of ids.

    What a walk of k + 1 edges ends in is a part of what one of k edges ends in; a node's layer is the last k. If a round
    leaves none out, the rest is on or behind a cycle. Edges and ids are in the same buckets, so a round exchanges only the ends it finds.
    """
    pairs = bucketed(edges, "src").select(F.col("src").alias("unique_id"), "dst").where("dst is not null")
    into, left, levels = cut(nodes.select("unique_id").distinct(), by="unique_id"), None, []
    while left != 0:
        ends = pairs if left is None else _kept(pairs, into, "unique_id")
        new = cut(ends.select(F.col("dst").alias("unique_id")).distinct(), by="unique_id")
        now = new.count()
        if now and now == left:
            if cyclic == "error":
                raise CycleDetected(f"{now} nodes are on or behind cycles")
            return ranked(nodes.select("unique_id").distinct().withColumn("all", F.lit(0)), "all", ["unique_id"]).select("unique_id", F.col("rank").alias("layer"))
        levels.append(_kept(into, new, "unique_id", "left_anti").select("unique_id", F.lit(len(levels)).alias("layer")))
        into, left = new, now
    return _union(levels)


def ranked(table: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """The rows with their rank (from 0) within the group in order of the keys, which are unique there and not null.

    No task holds a whole group: rows are sorted by ranges of group and keys, and a small table has what comes before each.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [group, *keys]
    at = cut(table.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    at = at.withColumn("__part", F.shiftright("__at", 33))
    per = at.groupBy("__part", group).agg(F.min("__at").alias("__first"), F.count("__at").alias("__n"))  # a row for each part of a group
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = cut(per.select("__part", group, (before - F.col("__first")).alias("__start")))
    rank = (F.col("__at") + F.col("__start")).cast("int")
    return at.join(light(start), ["__part", group]).select(*table.columns, rank.alias("rank"))


def has_cycle(edges: DataFrame) -> bool:
    try:
        pairs = cut(edges.select("src", "dst"))
        # what leads nowhere isn't on a cycle: only edges to starts of edges are walked along
        inner = cut(_kept(pairs, cut(pairs.select(F.col("src").alias("unique_id")).distinct()), "dst"))
        layers(inner.select(F.col("src").alias("unique_id")), inner)
    except CycleDetected:
        return True
    return False


def longest_path(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(position, unique_id) of a longest path from the start; of several, the one of the least ids from its end back.

    Each round keeps, for each node that a walk of its length ends in, the least one before it; the path is read back from these.
    """
    pairs = cut(edges.select("src", "dst").distinct())
    steps = [cut(start.select("unique_id", F.lit(None).cast("string").alias("before")).distinct())]
    bound = None
    while True:
        at = light(steps[-1].select(F.col("unique_id").alias("src")))
        new = cut(pairs.join(at, "src").groupBy(F.col("dst").alias("unique_id")).agg(F.min("src").alias("before")))
        if new.isEmpty():
            break
        steps.append(new)
        if len(steps) % 64 == 0:  # so long a walk may go round a cycle
            bound = bound or reach(edges, start).count()
            if len(steps) > bound:
                raise CycleDetected("the longest path has no end")
    end = steps[-1].orderBy("unique_id").limit(1).first()
    found = [end.unique_id]
    for level in reversed(steps[:-1]):  # a filter on one column of a written table
        found.append(end.before)
        end = level.where(F.col("unique_id") == end.before).first()
    return edges.sparkSession.createDataFrame(list(enumerate(reversed(found))), "position int, unique_id string")
