"""A project of SQL and YAML files as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileReadError, ProjectNotFound, YamlParseError
from ..runtime import cut

FILES = "path string, kind string, content string, modified_at timestamp"
YAML = """sources array<struct<name:string,description:string,tables:array<struct<name:string,description:string>>>>,
models array<struct<name:string,description:string,tags:array<string>,config:struct<materialized:string,tags:array<string>>,columns:array<struct<name:string>>>>,
exposures array<struct<name:string,label:string,description:string,depends_on:array<string>>>"""


@dataclass
class Project:
    """The project file: a name and where each kind of file is."""

    name: str
    root: Path
    model_paths: list[str] = field(default_factory=lambda: ["models"])
    seed_paths: list[str] = field(default_factory=lambda: ["seeds"])
    snapshot_paths: list[str] = field(default_factory=lambda: ["snapshots"])
    test_paths: list[str] = field(default_factory=lambda: ["tests"])

    @classmethod
    def load(cls, root: str | Path) -> Project:
        root = Path(root)
        file = root / "dbt_project.yml"
        if not file.is_file():
            raise ProjectNotFound(str(file))
        return cls.parse(file.read_text(), root, str(file))

    @classmethod
    def parse(cls, text: str, root: Path, file: str) -> Project:
        """From the text of a project file."""
        try:
            found = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise YamlParseError(file) from e
        if not isinstance(found, dict) or not isinstance(found.get("name"), str):
            raise YamlParseError(f"{file}: a name is required")
        return cls(found["name"], root, **{f"{k}_paths": found[f"{k}-paths"] for k in ("model", "seed", "snapshot", "test") if found.get(f"{k}-paths") is not None})

    def folders(self) -> list[tuple[str, Path]]:
        """(kind, folder) of each folder that is there."""
        kinds = {"model": self.model_paths, "seed": self.seed_paths, "snapshot": self.snapshot_paths, "test": self.test_paths}
        return [(k, self.root / p) for k, paths in kinds.items() for p in paths if (self.root / p).is_dir()]


def read_file(path: str | Path) -> str:
    try:
        return Path(path).read_text()
    except (OSError, UnicodeDecodeError) as e:
        raise FileReadError(str(path)) from e


def _texts(spark: SparkSession, folder: Path, glob: str) -> DataFrame:
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreMissingFiles", True).text(f"file://{folder}", wholetext=True)
    return found.select(F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+", "/").alias("path"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified_at"))


def discover(spark: SparkSession, project: Project) -> DataFrame:
    """All files of a project (FILES): SQL of models, snapshots and tests, CSV of seeds (without content), YAML of all four.

    Suffixes are exact. A folder that isn't there has no files.
    """
    out = spark.createDataFrame([], FILES)
    for kind, folder in project.folders():
        folder = folder.resolve()
        if kind == "seed":
            csv = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(f"file://{folder}")
            out = out.unionByName(csv.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit("seed").alias("kind"), F.lit(None).cast("string").alias("content"), F.col("modificationTime").alias("modified_at")))
        else:
            out = out.unionByName(_texts(spark, folder, "*.sql").withColumn("kind", F.lit(kind)))
        for glob in ("*.yml", "*.yaml"):
            out = out.unionByName(_texts(spark, folder, glob).withColumn("kind", F.lit("yaml")))
    root = str(project.root.resolve()) + "/"
    relative = F.when(F.col("path").startswith(root), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    # many small files make many small partitions; written once, they are read as few
    return cut(out.withColumn("path", relative).coalesce(spark.sparkContext.defaultParallelism))


#: libyaml's parser where PyYAML was built with it; it resolves and constructs as the one in Python does.
_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
_NOT_PLAIN = re.compile("[^\\x20-\\x7e\\xa0-\\u2027\\u202a-\\ud7ff]")


def _whole(text: str) -> int:
    if text.startswith("-0"):
        raise ValueError(text)
    return int(text)


def _refuse(text: str):
    raise ValueError(text)


_JSON = json.JSONDecoder(parse_int=_whole, parse_float=_refuse, parse_constant=_refuse)


def parsed(text: str):
    """The value of a YAML text. JSON on one line is YAML too and read as such, unless the two differ: numbers that aren't whole,
    characters that YAML refuses or folds, and texts in which a key may be beyond YAML's 1,024 characters."""
    if text[:1] == "{" and (len(text) <= 1024 or "\\" not in text and max(map(len, text.split('"'))) < 1000) and not _NOT_PLAIN.search(text):
        try:
            return _JSON.decode(text)
        except (ValueError, RecursionError):
            pass
    return yaml.load(text, Loader=_Loader)


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(text: str) -> str | None:
        try:
            return json.dumps(parsed(text), default=str)
        except (yaml.YAMLError, TypeError, ValueError):
            return None

    for b in batches:
        yield b.assign(content=b["content"].map(one))


def schema_files(files: DataFrame) -> DataFrame:
    """(path, sources, models, exposures) of the YAML files that can be parsed; the others are left out."""
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    y = files.where("kind = 'yaml'").select("path", "content").repartition(parts, "path")  # small texts that are slow to parse: a file of them is one task
    y = y.mapInPandas(_as_json, "path string, content string")
    return y.select("path", F.from_json("content", YAML).alias("y")).where("y is not null").select("path", "y.*")
