"""Registered-API sources: published list (A4), detail documents (A5) and catalog listing.

Snapshots (JSON lines or parquet) replace the HTTP paging of the reference; one row per API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = T.StructType([T.StructField("target", T.StringType()), T.StructField("verb", T.StringType())])

# API detail document; endpointConfig stays raw JSON text (its shape varies, see endpoint_of).
API_DETAIL_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("version", T.StringType()), T.StructField("context", T.StringType()),
    T.StructField("lifeCycleStatus", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("operations", T.ArrayType(OPERATION)),
    T.StructField("endpointConfig", T.StringType()), T.StructField("lastUpdatedTime", T.StringType()),
    T.StructField("createdTime", T.StringType()),
])

CATALOG_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
                               T.StructField("version", T.StringType()),
                               T.StructField("description", T.StringType())])


def parse_details(raw: DataFrame, column: str = "json") -> DataFrame:
    """JSON text per API -> typed detail rows. A text is parsed once: filters on the rows stay above the generator."""
    return raw.select(F.inline(F.array(F.from_json(F.col(column), API_DETAIL_SCHEMA))))


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Detail snapshot as JSON lines, one document per line."""
    return spark.read.schema(API_DETAIL_SCHEMA).json(path)


def published(details: DataFrame, types=("HTTP",)) -> DataFrame:
    """A4: keep PUBLISHED APIs of the included types (an empty type set keeps all types)."""
    out = details.where(F.col("lifeCycleStatus") == "PUBLISHED")
    return out.where(F.col("type").isin(list(types))) if types else out


def read_catalog(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Catalog listing snapshot (id, name, version, description)."""
    if fmt == "json":
        return spark.read.schema(CATALOG_SCHEMA).json(path)
    return spark.read.format(fmt).load(path).select("id", "name", "version", "description")


def details_json_from_flat(flat: DataFrame) -> DataFrame:
    """Stand-in input: the flat registered-API view as one detail document (JSON text) per API."""
    g = flat.groupBy("reg_api_id", "api_name", "api_version", "context", "api_type", "lifecycle_status",
                     "endpoint_url", "last_updated").agg(
        F.array_sort(F.collect_list(F.struct(F.col("target"), F.col("verb")))).alias("operations"))
    doc = F.struct(
        F.col("reg_api_id").alias("id"), F.col("api_name").alias("name"), F.col("api_version").alias("version"),
        F.col("context"), F.col("lifecycle_status").alias("lifeCycleStatus"), F.col("api_type").alias("type"),
        F.lit("admin").alias("provider"), F.col("operations"),
        F.struct(F.lit("http").alias("endpoint_type"),
                 F.struct(F.col("endpoint_url").alias("url")).alias("production_endpoints")).alias("endpointConfig"),
        F.col("last_updated").alias("lastUpdatedTime"), F.col("last_updated").alias("createdTime"))
    return g.select(F.to_json(doc).alias("json"))
