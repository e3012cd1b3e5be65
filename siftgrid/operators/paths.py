"""Which files a scan of a folder looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders that are skipped, and generated files by the end of their path.
SKIPPED_DIRS = ".git .hg .mypy_cache .pytest_cache .ruff_cache __pycache__ dist node_modules venv".split()
GENERATED = ["extension/lib/detector-info.js", "extension/lib/patterns.js"]


def skipped(path: Column) -> Column:
    """Whether a path lies in a skipped folder or is a generated file. A file that has the name of such a folder is none."""
    folders = F.slice(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), 1, F.size(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")) - 1)
    made = F.lit(False)
    for end in GENERATED:
        made = made | F.replace(path, F.lit("\\"), F.lit("/")).endswith(end)
    return F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_DIRS))) | made


def pruned(files: DataFrame, column: str = "path") -> DataFrame:
    """files without those that a scan skips; a null path stays out too."""
    return files.where(~skipped(F.col(column)))
