"""Files of a project at a git revision."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import FileReadError
from .project import FILES


def _git(root: str | Path, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, text=True)


def is_repo(root: str | Path) -> bool:
    return _git(root, *"rev-parse --is-inside-work-tree".split()).stdout.strip() == "true"


def check_ref(root: str | Path, ref: str) -> str:
    """The commit that a revision names; an error if there is none."""
    done = _git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}")
    if done.returncode:
        raise FileReadError(f"no revision {ref}")
    return done.stdout.strip()


def current_ref(root: str | Path) -> str:
    name = _git(root, *"rev-parse --abbrev-ref HEAD".split()).stdout.strip()
    return name if name and name != "HEAD" else _git(root, "rev-parse", "--short", "HEAD").stdout.strip()


def show(root: str | Path, ref: str, path: str) -> str:
    done = _git(root, "show", f"{ref}:./{path}")
    if done.returncode:
        raise FileReadError(f"{ref}:{path}")
    return done.stdout


def listed(root: str | Path, ref: str, prefix: str = "") -> list[str]:
    """Files under a folder at a revision; none if the folder isn't there."""
    done = _git(root, *"ls-tree -r -z --name-only".split(), ref, *([f"{prefix}/"] if prefix else []))
    return [x for x in done.stdout.split("\0") if x] if not done.returncode else []


def show_all(root: str | Path, ref: str, paths: list[str]) -> list[str]:
    """The files' texts at a revision, by one process."""
    asked = "".join(f"{ref}:./{p}\n" for p in paths).encode()
    done = subprocess.run(["git", "-C", str(root), "cat-file", "--batch"], input=asked, capture_output=True)
    out, at = [], 0
    for p in paths:
        end = done.stdout.find(b"\n", at)
        head = done.stdout[at:end].split() if end >= 0 else []
        if len(head) != 3 or not head[2].isdigit():
            raise FileReadError(f"{ref}:{p}")
        at = end + 1 + int(head[2])
        try:
            out.append(done.stdout[end + 1 : at].decode())
        except UnicodeDecodeError as e:
            raise FileReadError(f"{ref}:{p}") from e
        at += 1
    return out


def files_at(spark: SparkSession, root: str | Path, ref: str, folders: dict[str, list[str]]) -> DataFrame:
    """FILES of the project at a revision, without times."""
    found: list[tuple[str, str]] = []
    for kind, paths in folders.items():
        for folder in paths:
            for p in listed(root, ref, folder):
                suffix = Path(p).suffix
                if suffix in (".yml", ".yaml"):
                    found.append((p, "yaml"))
                elif suffix == (".csv" if kind == "seed" else ".sql"):
                    found.append((p, kind))
    read = [p for p, kind in found if kind != "seed"]
    texts = dict(zip(read, show_all(root, ref, read)))
    return spark.createDataFrame([(p, kind, texts.get(p), None) for p, kind in found], FILES)
