"""Whether ownership files cover what needs an owner."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Where an ownership file may be, best first.
PLACES = [".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS"]


def coverage(files: DataFrame, required: list[str]) -> DataFrame:
    """repo, type, severity, source, missing of repositories (files: repo, path, text) whose ownership file is missing, or lacks a part that needs an owner.

    The best-placed file counts, whatever the others hold. A repository with any file is looked at; a null text is an
    empty file; missing lists the parts in their order. Only ownership files are read, one row a repository is summed.
    """
    place = F.array_position(F.array(*map(F.lit, PLACES)), F.col("path"))
    best = F.min_by(F.struct("path", F.coalesce("text", F.lit("")).alias("text")), F.when(place > 0, place))
    # Texts of other files aren't carried along.
    slim = files.select("repo", "path", F.when(place > 0, F.col("text")).alias("text"))
    owned = slim.groupBy("repo").agg(best.alias("o"), F.max(place).alias("any"))
    lacks = F.filter(F.array(*map(F.lit, required)), lambda p: ~F.contains(F.col("o.text"), p))
    found = owned.select("repo", F.when(F.col("any") > 0, F.col("o.path")).alias("source"), F.when(F.col("any") > 0, lacks).alias("missing"))
    rows = found.select(
        "repo", F.when(F.col("source").isNull(), "codeowners_missing").otherwise("codeowners_incomplete").alias("type"), F.when(F.col("source").isNull(), "medium").otherwise("low").alias("severity"),
        F.coalesce("source", F.lit(PLACES[0])).alias("source"), F.coalesce("missing", F.array(*map(F.lit, required))).alias("missing"),
    )
    return rows.where(F.size("missing") > 0)
