"""How the last run of each node went, and whether it is still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids

FIELDS = ["unique_id", "status", "completed_at", "message", "modified_at"]
LOOK = {"success": ("ok", "green"), "error": ("x", "red"), "skipped": ("-", "gray"), "outdated": ("!", "yellow"), "never_run": (" ", "default")}


def completed_at() -> Column:
    """The last time in timing that isn't null."""
    return F.try_element_at(F.filter(F.transform("timing", lambda t: t.completed_at), lambda x: x.isNotNull()), F.lit(-1))


def lookup(results: DataFrame) -> DataFrame:
    """(key, result, completed_at, message): the last result of each short id; ids of one part are left out."""
    r = results.select("seq", ids.run_id(F.col("unique_id")).alias("key"), F.col("status").alias("result"), completed_at().alias("completed_at"), "message").where("key is not null")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return r.withColumn("rank", last).where("rank = 1").drop("rank", "seq")


def statuses(nodes: DataFrame, results: DataFrame, modified: DataFrame) -> DataFrame:
    """(unique_id, status, completed_at, message, modified_at) of every node.

    A success is outdated if its file (file_path, modified_at) is newer; without a time of completion it is as of now.
    """
    n = nodes.select("unique_id", "file_path", ids.graph_id(F.col("unique_id")).alias("key"))
    # nodes without a file would all be sent to one task by the join
    without = n.where("file_path is null").withColumn("modified_at", F.lit(None).cast(modified.schema["modified_at"].dataType))
    n = n.where("file_path is not null").join(modified.select("file_path", "modified_at"), "file_path", "left").unionByName(without)
    n = n.join(lookup(results), "key", "left")
    good, bad, skipped = F.col("result").isin("success", "pass"), F.col("result").isin("error", "fail"), F.col("result").isin("skipped", "skip")
    done = F.coalesce("completed_at", F.current_timestamp())
    old = good & (F.col("modified_at") > done)
    status = F.when(old, "outdated").when(good, "success").when(bad, "error").when(skipped, "skipped").otherwise("never_run")
    return n.select("unique_id", status.alias("status"), F.when(good, done).when(bad | skipped, F.col("completed_at")).alias("completed_at"), F.when(bad, F.coalesce("message", F.lit("Unknown error"))).alias("message"), F.when(old, F.col("modified_at")).alias("modified_at"))


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old statuses, but new ones where there are any (a never_run among the new ones is none)."""
    fresh = new.where("status != 'never_run'").select(FIELDS)
    return old.select(FIELDS).join(fresh.select("unique_id"), "unique_id", "left_anti").select(FIELDS).unionByName(fresh)


def look() -> tuple[Column, Column, Column]:
    """Symbol, label and colour of a status."""
    sign = F.create_map(*[F.lit(x) for k, v in LOOK.items() for x in (k, v[0])])[F.col("status")]
    colour = F.create_map(*[F.lit(x) for k, v in LOOK.items() for x in (k, v[1])])[F.col("status")]
    at = F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss")
    label = F.concat(F.initcap(F.replace(F.col("status"), F.lit("_"), F.lit(" "))), F.coalesce(F.concat(F.lit(" ("), at, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), F.col("message")), F.lit("")))
    return sign.alias("symbol"), label.alias("label"), colour.alias("colour")
