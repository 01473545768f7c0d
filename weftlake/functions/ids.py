"""Column expressions over identifiers, paths and short labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(path: Column) -> Column:
    """Name of the file without its last suffix; "unknown" where there is none."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    return F.when(F.coalesce(stem, F.lit("")) == "", "unknown").otherwise(stem)


def _parts(x: Column) -> Column:
    return F.split(x, r"\.")


def manifest_id(x: Column) -> Column:
    """A source of 4 or more parts keeps parts 0, 2 and 3; other ids of 3 or more keep the first and the last."""
    p = _parts(x)
    return F.when((F.get(p, F.lit(0)) == "source") & (F.size(p) >= 4), F.concat_ws(".", F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(3)))).when(F.size(p) >= 3, F.concat_ws(".", F.get(p, F.lit(0)), F.element_at(p, -1))).otherwise(x)


def run_id(x: Column) -> Column:
    """Key of a run result: first and last part of 3 or more, ids of two parts as they are, none for one part."""
    p = _parts(x)
    return F.when(F.size(p) >= 3, F.concat_ws(".", F.get(p, F.lit(0)), F.element_at(p, -1))).when(F.size(p) == 2, x)


def graph_id(x: Column) -> Column:
    """Key of a graph node in run results; a source loses its middle part."""
    p = _parts(x)
    return F.when(F.size(p) >= 3, F.concat_ws(".", F.get(p, F.lit(0)), F.element_at(p, -1))).otherwise(x)


def node_type(resource_type: Column) -> Column:
    return F.when(resource_type.isin("source", "seed", "snapshot", "test", "exposure"), resource_type).otherwise("model")


def edge_type(dependency: Column) -> Column:
    return F.when(dependency.startswith("source."), "source").when(dependency.startswith("test."), "test").otherwise("ref")


def non_blank(x: Column) -> Column:
    """The value as it is, or null if it is blank."""
    return F.when(F.trim(x) != "", x)
