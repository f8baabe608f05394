"""What changed since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(found: DataFrame, before: DataFrame, force: bool = False) -> DataFrame:
    """Classify paths as changed, unchanged or stale by content hash: one full outer join on the path."""
    old = before.select("path", "old_sha256", *[c for c in before.columns if c not in ("path", "old_sha256")])
    same = F.lit(False) if force else F.col("sha256").eqNullSafe(F.col("old_sha256"))
    status = F.when(F.col("sha256").isNull(), "stale").when(same, "unchanged").otherwise("changed")
    return found.select("path", "sha256").join(old, "path", "full_outer").withColumn("status", status)
