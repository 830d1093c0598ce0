"""Query result sets of the flow store (A2) and the lenient typed getters applied to them (A3).

A result body is column-oriented JSON ``{"columns": [...], "values": [[...], ...]}``; a short inner
row leaves its trailing columns absent. An array of objects is accepted as a fallback; anything
else yields no rows. Cells are kept as VARIANT so the getters can tell JSON numbers, strings and
booleans apart, as the reference's type switches do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNAR = "struct<columns: array<string>, values: array<array<variant>>>"
OBJECTS = "array<map<string, variant>>"
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def flatten_result(df: DataFrame, body: str = "body", keep=()) -> DataFrame:
    """A2: one output row per inner row: (keep..., row_idx, fields map<string, variant>)."""
    keep = list(keep)
    parsed = df.select(*keep, F.from_json(F.col(body), COLUMNAR).alias("c"),
                       F.from_json(F.col(body), OBJECTS).alias("o"))
    col_rows = (parsed.where(F.col("c.columns").isNotNull() & F.col("c.values").isNotNull())
                .select(*keep, F.col("c.columns").alias("cols"), F.posexplode("c.values").alias("row_idx", "row"))
                .select(*keep, "row_idx", F.map_from_arrays(
                    F.slice("cols", 1, F.least(F.size("cols"), F.size("row"))),
                    F.slice("row", 1, F.least(F.size("cols"), F.size("row")))).alias("fields")))
    obj_rows = (parsed.where(~(F.col("c.columns").isNotNull() & F.col("c.values").isNotNull())
                             & F.col("o").isNotNull())
                .select(*keep, F.posexplode("o").alias("row_idx", "fields")))
    return col_rows.unionByName(obj_rows)


def _cell(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def get_string(fields: Column, name: str) -> Column:
    """Missing / null -> ''; string as is; any other value in its JSON text form."""
    v = _cell(fields, name)
    t = F.schema_of_variant(v)
    txt = F.when(t == "STRING", F.try_variant_get(v, "$", "string")) \
        .when(t.rlike(_NUMERIC) & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))),
              F.try_variant_get(v, "$", "bigint").cast("string")) \
        .otherwise(F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.when(v.isNotNull() & (t != "NULL"), txt), F.lit(""))


def get_long(fields: Column, name: str) -> Column:
    """JSON number truncated toward zero; anything else 0."""
    v = _cell(fields, name)
    d = F.when(F.schema_of_variant(v).rlike(_NUMERIC), F.try_variant_get(v, "$", "double"))
    return F.coalesce(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("bigint"), F.lit(0).cast("bigint"))


def get_bool(fields: Column, name: str) -> Column:
    """JSON boolean, or a number that is not zero; anything else false."""
    v = _cell(fields, name)
    t = F.schema_of_variant(v)
    return F.coalesce(F.when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
                      .when(t.rlike(_NUMERIC), F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def get_time(fields: Column, name: str) -> Column:
    """'yyyy-MM-dd HH:mm:ss' or RFC 3339 text, or epoch seconds; anything else NULL (zero time)."""
    v = _cell(fields, name)
    t = F.schema_of_variant(v)
    s = F.try_variant_get(v, "$", "string")
    text = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]XXX")))
    secs = F.timestamp_seconds(F.try_variant_get(v, "$", "double").cast("bigint"))
    return F.when(t == "STRING", text).when(t.rlike(_NUMERIC), secs).cast("timestamp_ntz")


_GETTERS = {"string": get_string, "long": get_long, "bool": get_bool, "time": get_time}


def coerce(flat: DataFrame, spec: dict, fields: str = "fields") -> DataFrame:
    """A3: typed columns from the flattened cells; spec maps column -> string | long | bool | time."""
    return flat.select(*[c for c in flat.columns if c != fields],
                       *[_GETTERS[kind](F.col(fields), name).alias(name) for name, kind in spec.items()])
