"""Lists of changed files, for the cone of influence."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

SECONDS = 60


def _git(folder: str, *words: str) -> list[str]:
    done = subprocess.run(["git", "-C", folder, *words], capture_output=True, text=True, timeout=SECONDS)
    if done.stderr or done.returncode:
        raise RuntimeError(f"git {' '.join(words)}: {done.stderr.strip() or done.returncode}")
    return [line for line in done.stdout.splitlines() if line]


def changed_files(spark: SparkSession, folder: str | None = None, branch: str | None = None, files: list[str] | None = None) -> DataFrame:
    """path: either the given files, or those of a working copy that differ from where it left a branch.  Exactly one of both."""
    if (branch is None) == (files is None):
        raise ValueError("give either a branch or a list of files")
    if files is None:
        files = _git(folder, "-c", "core.quotepath=off", "diff", "--name-only", _git(folder, "merge-base", branch, "HEAD")[0])
    return spark.createDataFrame([(f,) for f in files], "path string")
