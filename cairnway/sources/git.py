"""A repository's state and changes: small answers of the git program, the changes as a table.

Every call ends after ``SECONDS``; a failure of any kind is an absent answer.
"""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = 30


def _ask(root: str, *words: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.SubprocessError, UnicodeDecodeError):
        return None
    return done.stdout if done.returncode == 0 else None


def is_repository(root: str) -> bool:
    return (_ask(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def head(root: str) -> str | None:
    """The checked-out commit; None without one."""
    return (_ask(root, "rev-parse", "--verify", "-q", "HEAD") or "").strip() or None


def branch(root: str) -> str | None:
    """The checked-out branch; None on a detached head."""
    return (_ask(root, "symbolic-ref", "--short", "-q", "HEAD") or "").strip() or None


def has_commit(root: str, commit: str) -> bool:
    named = bool(commit) and not commit.startswith("-")
    return named and (_ask(root, "cat-file", "-t", commit) or "").strip() == "commit"


def name_status(lines: DataFrame) -> DataFrame:
    """``status, path, new_path`` of tab-separated ``lines(value)``; other lines are left out."""
    parts = F.split("value", "\t")
    return lines.filter(F.size(parts) >= 2).select(parts[0].alias("status"), parts[1].alias("path"), F.get(parts, F.lit(2)).alias("new_path"))


def diff(spark: SparkSession, root: str, old: str, new: str = "HEAD") -> DataFrame | None:
    """``status, path, new_path`` between two commits (renames as a removal and an addition); None if either is unknown.

    One repository's listing passes through the driver; a larger one is written to a file and read by ``name_status``.
    """
    if not has_commit(root, old) or not has_commit(root, new):
        return None
    text = _ask(root, "-c", "core.quotePath=false", "diff", "--name-status", "--no-renames", f"{old}..{new}")
    if text is None:
        return None
    return name_status(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"))
