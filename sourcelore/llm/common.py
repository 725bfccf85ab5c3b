"""What several operators of this subpackage need."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelore.session import ensure_checkpoint_dir


def let_workers_import(spark: SparkSession) -> None:
    """Python workers import this library from where the driver has it, whatever folder they start in."""
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, [here, known.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(frame: DataFrame) -> DataFrame:
    """Write rows to the shared checkpoint folder, so that later steps read them and lost executors do not matter."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint()


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(frame: DataFrame) -> Column:
    """All columns as one struct, so that no column of the input clashes with one that an operator adds."""
    return F.struct(*[column(name) for name in frame.columns])


def text_of(name: str = "text") -> Column:
    return F.coalesce(column(name), F.lit(""))
