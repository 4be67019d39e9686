"""Secondary index on top-level JSON fields: derived from the state, never maintained."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field_text(value: Column, field: str) -> Column:
    """The canonical text of a top-level scalar field; null where there is none. JVM-side, for values
    that are objects; text after the object is not noticed. `strict_field` parses the whole document."""
    kind = F.schema_of_variant(F.try_parse_json(value))
    name = field.replace("'", "\\'")
    got = F.get_json_object(value, f"$['{name}']")
    inner = F.schema_of_variant(F.try_parse_json(got))
    nested = F.coalesce(inner.rlike("^(OBJECT|ARRAY)"), F.lit(False))
    return F.when(kind.startswith("OBJECT") & ~nested, got)


def strict_field(value: Column, field: str) -> Column:
    """As the strict form of the data model wants it: the whole document must be JSON, the last of
    equal members counts, and a bare scalar document matches every field."""

    def scalar(x: object) -> str | None:
        if isinstance(x, bool):
            return "true" if x else "false"
        if isinstance(x, str):
            return x
        return json.dumps(x) if isinstance(x, int | float) else None

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        def one(raw: bytes | str | None) -> str | None:
            try:
                x = json.loads(raw) if raw is not None else None
            except ValueError:
                return None
            return scalar(x.get(field)) if isinstance(x, dict) else scalar(x)

        return values.map(one).astype(object)

    return read(value)


def index_rows(state: DataFrame, fields: list[str], strict: bool = False) -> DataFrame:
    """ns, field, fv, key of every live key and indexed field."""
    text = F.col("value").cast("string")
    take = strict_field if strict else field_text
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), take(text, f).alias("fv")) for f in fields])
    return (
        state.select("ns", "key", F.explode(pairs).alias("p"))
        .select("ns", F.col("p.field").alias("field"), F.col("p.fv").alias("fv"), "key")
        .where("fv is not null")
        .distinct()
    )


def by_index(index: DataFrame, field: str, value: str) -> DataFrame:
    return index.where((F.col("field") == field) & (F.col("fv") == value)).select("ns", "key")


def index_range(index: DataFrame, field: str, start: str) -> DataFrame:
    """All (fv, key) from start on, in order of bytes."""
    return index.where((F.col("field") == field) & (F.col("fv") >= start)).select("ns", "fv", "key")


def definitions(log: DataFrame) -> DataFrame:
    """ns, schema_json, index_fields: the newest definition of each by (hlc, replica, seq)."""
    newest = lambda tag: F.max_by(
        F.when(F.col("tag") == tag, F.col("value").cast("string")),
        F.when(F.col("tag") == tag, F.struct("hlc", "replica", "seq")),
    )
    return (
        log.where("tag in (4, 5)")
        .groupBy("ns")
        .agg(newest(4).alias("schema_json"), newest(5).alias("fields"))
        .select(
            "ns",
            F.nullif("schema_json", F.lit("")).alias("schema_json"),
            F.coalesce(F.from_json("fields", "array<string>"), F.array().cast("array<string>")).alias("index_fields"),
        )
    )


def clean_fields(fields: Column) -> Column:
    return F.array_distinct(F.filter(fields, lambda x: x != ""))
