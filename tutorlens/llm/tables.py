"""Reading the input tables, and names for added columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tutorlens.sources.shared import checkpoint_dir, fresh_folder, settled

__all__ = ["added", "checkpoint_dir", "fresh_folder", "settled", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def added(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator adds: as given, with underscores behind where `df` has such a column already.

    Columns of the caller are therefore never replaced.
    """
    had, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out
