"""A profile: all facets of one table, stored by dataset and read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from millrace.operators import crosstab, ordered, rhythm, rollup, stats

_ID = re.compile(r"[\w.-]{1,128}")


def check_dataset_id(dataset_id: str) -> str:
    if not _ID.fullmatch(dataset_id):
        raise ValueError("a dataset id is 1 to 128 letters, digits, dots, dashes or underscores")
    return dataset_id


def profile(df: DataFrame, unit: str, ts: str | None, order: list[str], state: str | None, categories: list[str], measures: list[str], quarantined=None) -> dict[str, DataFrame]:
    """The facets, each a table of its own; none is gathered. Those that need what the
    table has not (a time, a state, a measure, a category) are left out."""
    facets = {}
    if measures:
        facets["measures"] = stats.numeric_summary(df, measures)
        facets["catalogue"] = rollup.measure_catalogue(df, unit, measures)
    if categories:
        facets["top_values"] = stats.top_values(df, categories)
    if measures and categories:
        facets["cells"] = crosstab.marginal(df, categories, measures, quarantined)
        facets["effects"] = rollup.effect_sizes(df, categories, measures)
    if ts is not None:
        facets["grain"] = stats.grain(df, unit, ts, order)
        if measures:
            facets["rhythm"] = rhythm.hour_rhythm(df, ts, measures[0])
    if ts is not None and state is not None and measures:
        found = ordered.runs(df, unit, state, ts, order, measures[0])
        facets["episodes"] = ordered.durations(found, unit)
        facets["transitions"] = ordered.transitions(found, unit)
    return facets


def store_profile(facets: dict[str, DataFrame], dataset_id: str, path: str) -> None:
    """Write each facet; what the dataset had before is replaced, others stay."""
    check_dataset_id(dataset_id)
    for name, df in facets.items():
        stamped = df.withColumn("dataset_id", F.lit(dataset_id)).withColumn("updated_at", F.current_timestamp())
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{path}/{name}")


def load_profile(spark: SparkSession, dataset_id: str, path: str, facet: str, schema: StructType | None = None) -> DataFrame:
    """A dataset's rows of a facet. With the `schema` that it was made with, a facet
    without rows is read as an empty one."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, StructField("updated_at", TimestampType()), StructField("dataset_id", StringType())]))
    return reader.parquet(f"{path}/{facet}").where(F.col("dataset_id") == check_dataset_id(dataset_id))


def quality_issues(facets: dict[str, DataFrame], fill: DataFrame, least_fill: float = 0.9, most: int = 24) -> DataFrame:
    """Columns that are under-filled and units whose rows have gaps."""
    low = fill.where(F.col("fill") < least_fill).select(F.lit("fill").alias("issue"), F.col("column").alias("subject"), F.col("fill").alias("value"))
    gaps = facets["grain"].where("gaps > 0").select(F.lit("gaps").alias("issue"), F.col(facets["grain"].columns[0]).cast("string").alias("subject"), F.col("gaps").cast("double").alias("value"))
    return low.unionByName(gaps).orderBy("issue", F.desc("value"), "subject").limit(most)
