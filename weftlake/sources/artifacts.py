"""Compiled JSON artifacts as tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactParseError, FileReadError
from ..schemas import MANIFEST, RUN_RESULTS
from .project import read_file

REQUIRED = {"nodes": ["unique_id", "name", "resource_type"], "sources": ["unique_id", "name", "source_name"], "exposures": ["unique_id", "name"]}


def manifest_path(given: str | Path) -> Path:
    """The file itself, or target/manifest.json of a folder."""
    p = Path(given)
    p = p / "target" / "manifest.json" if p.is_dir() else p
    if not p.is_file():
        raise FileReadError(str(p))
    return p


def parse_manifest(spark: SparkSession, text: str, name: str = "manifest") -> DataFrame:
    """One row of three maps by id. Malformed JSON and missing required fields are errors."""
    try:
        found = json.loads(text)
    except ValueError as e:
        raise ArtifactParseError(f"{name}: {e}") from e
    if not isinstance(found, dict):
        raise ArtifactParseError(f"{name}: not an object")
    for part, fields in REQUIRED.items():
        for key, value in (found.get(part) or {}).items():
            missing = [f for f in fields if not isinstance(value, dict) or value.get(f) is None]
            if missing:
                raise ArtifactParseError(f"{name}: {part}.{key} lacks {', '.join(missing)}")
    return spark.createDataFrame([(text,)], "value string").select(F.from_json("value", MANIFEST).alias("m")).select("m.*")


def read_manifest(spark: SparkSession, given: str | Path) -> DataFrame:
    path = manifest_path(given)
    return parse_manifest(spark, read_file(path), str(path))


def read_run_results(spark: SparkSession, project_dir: str | Path) -> DataFrame | None:
    """(seq, unique_id, status, message, timing) of target/run_results.json; None if there is no such file."""
    path = Path(project_dir) / "target" / "run_results.json"
    if not path.is_file():
        return None
    try:
        json.loads(read_file(path))
    except ValueError as e:
        raise ArtifactParseError(f"{path}: {e}") from e
    return explode_results(spark.read.schema(RUN_RESULTS).option("multiLine", True).json(f"file://{path.resolve()}"))


def explode_results(raw: DataFrame) -> DataFrame:
    return raw.select(F.posexplode("results").alias("seq", "r")).select(F.col("seq").cast("long").alias("seq"), "r.*")
