"""Output columns of a SELECT list, and where each comes from."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from .calls import COMMENT, TAG

_SELECT = re.compile(r"\bselect\s+(?:distinct\s+)?", re.I)
_WORDS, _AS = r"(\w+)", r"\s+(?:as\s+)?"


def _strip(sql: str) -> str:
    return re.sub(TAG, "__jinja__", re.sub(COMMENT, "", sql))


def top_level_from(text: str) -> int | None:
    """Place of the first FROM outside parentheses; a closing one too many is ignored."""
    depth = 0
    for m in re.finditer(r"[()]|(?<!\w)from(?!\w)", text, re.I):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth = max(0, depth - 1)
        elif depth == 0:
            return m.start()
    return None


def split_commas(text: str) -> list[str]:
    """Pieces between commas outside parentheses; a last blank piece is dropped."""
    out, depth, last = [], 0, 0
    for m in re.finditer(r"[(),]", text):
        if m[0] == ",":
            if depth == 0:
                out.append(text[last : m.start()])
                last = m.end()
        else:
            depth += 1 if m[0] == "(" else -1
    return out + ([text[last:]] if text[last:].strip() else [])


def clean(name: str) -> str:
    return name.strip().strip("`").strip('"')


def _alias_after_paren(item: str) -> str | None:
    rest = item.rpartition(")")[2].strip()
    found = re.match(r"as\s+(.*)\Z", rest, re.I | re.S)
    return clean(found[1] if found else rest) or None


def column_name(item: str) -> str:
    """Last alias outside parentheses, else the last word, after its last dot."""
    depth, at = 0, None
    for m in re.finditer(r"[()]|(?<=\s)as(?=\s)", item, re.I):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif depth == 0:
            at = m.end()
    if at is not None:
        return clean(item[at:])
    words = item.split()
    return clean(words[-1].rpartition(".")[2] if words[-1].upper() != "COUNT(*)" else words[-1])


def classify(item: str) -> str | None:
    item = item.strip()
    if not item:
        return None
    return _alias_after_paren(item) if item[0] == "(" else column_name(item)


def output_columns(sql: str | None) -> list[str]:
    """Columns of the first SELECT of the text; none without a FROM on its level."""
    text = _strip(sql or "")
    start = _SELECT.search(text)
    if not start:
        return []
    body = text[start.end() :]
    end = top_level_from(body)
    return [] if end is None else [c for c in map(classify, split_commas(body[:end])) if c]


@F.pandas_udf(ArrayType(StringType()))
def select_columns(sql: pd.Series) -> pd.Series:
    """Output columns of the first SELECT, by Arrow batch."""
    return sql.map(output_columns)


ITEM = StructType([StructField(c, StringType()) for c in ("column_name", "source_alias", "source_column")] + [StructField(c, BooleanType()) for c in ("is_star", "is_derived")])


@lru_cache(maxsize=50_000)
def _patterns(column: str) -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    c = re.escape(column)
    return (
        re.compile(rf"{_WORDS}\.{_WORDS}{_AS}{c}(?:[\s,]|\Z)", re.I),
        re.compile(rf"{_WORDS}\.{c}\b", re.I),
        re.compile(rf"\w+\s*[(][^)]*[)]{_AS}{c}", re.I),
    )


def column_source(sql: str, column: str) -> tuple[str | None, str | None, bool]:
    """(source_alias, source_column, is_derived) of an output column of the text without template tags.

    First of: table.column before the name, table.name, a function call before the name (derived), the name itself.
    """
    renamed, direct, called = _patterns(column)
    if m := renamed.search(sql):
        return m[1], m[2], False
    if m := direct.search(sql):
        return m[1], column, False
    return (None, None, True) if called.search(sql) else (None, column, False)


def select_list(sql: str | None) -> list[dict]:
    """Output columns of the first SELECT with their sources; * is a star, a template tag is derived."""
    text, out = _strip(sql or ""), []
    for c in output_columns(sql):
        alias, source, derived = (None, None, c == "__jinja__") if c in ("*", "__jinja__") else column_source(text, c)
        out.append({"column_name": c, "source_alias": alias, "source_column": source, "is_star": c == "*", "is_derived": derived})
    return out


@F.pandas_udf(ArrayType(ITEM))
def select_sources(sql: pd.Series) -> pd.Series:
    """select_list() by Arrow batch: patterns depend on the column's name, so they are compiled once for each name, not for each row."""
    return sql.map(select_list)
