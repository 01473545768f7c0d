"""Column expressions that find calls, settings and tables in templated SQL text. Patterns are Unicode-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY = "['\"]"
_NAME = f"{_ANY}([^'\"]+){_ANY}"
_OPEN, _CLOSE = r"(?U)\{\{-?\s*", r"\s*-?\}\}"
COMMENT = r"(?s)\{#.*?#\}"
TAG = r"\{\{[\s\S]*?\}\}|\{%[\s\S]*?%\}"
REF = _OPEN + rf"ref\(\s*{_NAME}(?:\s*,\s*{_NAME})?\s*\)" + _CLOSE
SOURCE = _OPEN + rf"source\(\s*{_NAME}\s*,\s*{_NAME}\s*\)" + _CLOSE
CONFIG = _OPEN + r"config\(([\s\S]*?)\)" + _CLOSE
_IS = r"\s*=\s*"
MATERIALIZED = rf"(?U)materialized{_IS}{_NAME}"
TAGS = rf"(?U)tags{_IS}\[([^\]]*)\]"
_SINGLE = "'([^']+)'"
TABLE = rf"(?iU)\b(?:from|join)\s+\{{\{{\s*(?:ref\(\s*{_SINGLE}\s*\)|source\(\s*{_SINGLE}\s*,\s*{_SINGLE}\s*\))\s*\}}\}}(?:\s+(?:as\s+)?(\w+))?"
EXPOSED = rf"^\s*ref\(\s*{_ANY}?([^'\")]*){_ANY}?\s*\)\s*$"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip_comments(sql: Column) -> Column:
    return F.regexp_replace(sql, COMMENT, "")


def strip_template(sql: Column) -> Column:
    """No comments, and every template tag one placeholder word."""
    return F.regexp_replace(strip_comments(sql), TAG, "__jinja__")


def refs(sql: Column) -> Column:
    """array<struct<package, name>> of the ref calls that are a whole expression, outside comments."""
    text = strip_comments(sql)
    pairs = F.arrays_zip(_all(text, REF, 1).alias("a"), _all(text, REF, 2).alias("b"))
    return F.transform(pairs, lambda p: F.when(p.b == "", F.struct(F.lit(None).cast("string").alias("package"), p.a.alias("name"))).otherwise(F.struct(p.a.alias("package"), p.b.alias("name"))))


def sources(sql: Column) -> Column:
    """array<struct<source_name, table_name>> likewise."""
    text = strip_comments(sql)
    pairs = F.arrays_zip(_all(text, SOURCE, 1).alias("a"), _all(text, SOURCE, 2).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p.a.alias("source_name"), p.b.alias("table_name")))


def config(sql: Column) -> Column:
    """struct<materialized, tags> of the first config call; tags only from a list."""
    body = F.regexp_extract(strip_comments(sql), CONFIG, 1)
    return F.struct(F.nullif(F.regexp_extract(body, MATERIALIZED, 1), F.lit("")).alias("materialized"), _all(F.regexp_extract(body, TAGS, 1), _NAME, 1).alias("tags"))


def table_refs(sql: Column) -> Column:
    """array<struct<alias, node_id>> of tables after FROM or JOIN, in order; the word after one counts as its alias."""
    groups = F.arrays_zip(*(_all(sql, TABLE, g).alias(f"g{g}") for g in (1, 2, 3, 4)))
    return F.transform(groups, lambda g: F.struct(F.nullif(g.g4, F.lit("")).alias("alias"), F.when(g.g1 != "", F.concat(F.lit("model."), g.g1)).otherwise(F.concat(F.lit("source."), g.g2, F.lit("."), g.g3)).alias("node_id")))


def exposure_ref(dependency: Column) -> Column:
    """The name in ref('name'); null for anything else."""
    return F.nullif(F.regexp_extract(dependency, EXPOSED, 1), F.lit(""))
