"""Changed files and hunks from version control: a subprocess on the driver, rows from there on."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

SCOPES = {"unstaged": [], "staged": ["--cached"], "all": ["HEAD"]}


def checked_ref(ref: str) -> str:
    """A revision that cannot be taken for an option or a range."""
    if not re.fullmatch(r"[A-Za-z0-9/_.@~^][A-Za-z0-9/_.\-@~^]*", ref):
        raise ValueError(f"invalid revision: {ref}")
    return ref


def checked_path(path: str) -> str:
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path outside the repository: {path}")
    return path


def scope_args(scope: str, base: str | None = None) -> list[str]:
    if scope == "compare":
        if not base:
            raise ValueError("compare needs a base revision")
        return [checked_ref(base)]
    return SCOPES[scope]


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True, timeout=300).stdout


def changed_files(spark: SparkSession, repo: str, scope: str = "unstaged", base: str | None = None) -> DataFrame:
    out = _git(repo, "diff", "--name-only", *scope_args(scope, base))
    return spark.createDataFrame([(p,) for p in out.splitlines() if p], "path string")


def changed_since(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _git(repo, "diff", "--name-only", checked_ref(ref)).splitlines() if p], "path string")


def hunks(spark: SparkSession, repo: str, scope: str = "unstaged", base: str | None = None, file: str | None = None) -> DataFrame:
    """(file, first, last) new-side line ranges of a diff without context."""
    from ..operators.changes import hunks as parsed

    tail = ["--", checked_path(file)] if file else []
    out = _git(repo, "diff", "--unified=0", *scope_args(scope, base), *tail)
    return parsed(spark.createDataFrame(list(enumerate(out.splitlines())), "n long, text string"))
