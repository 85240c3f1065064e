"""Field-name privacy scan, dataset fingerprint and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoreline.config import PII_DENY_LIST

# One JSON string token, whole, with the colon that makes it a field name.
_STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'
# A SHA-256 in hexadecimal, cut into pieces that fit a 64-bit number.
_PIECES = ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))


def json_keys(json: Column) -> Column:
    """Distinct lower-case field names of a JSON text, at any depth.

    String tokens are read left to right, so text inside a value is never taken for a name.
    """
    tokens = F.regexp_extract_all(json, F.lit(_STRING_TOKEN), F.lit(0))
    names = F.filter(tokens, lambda t: t.endswith(":"))
    quoted = F.transform(names, lambda t: F.regexp_replace(t, r"\s*:$", ""))
    plain = F.transform(
        quoted,
        lambda t: F.when(
            t.contains("\\"),
            F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")[0],
        ).otherwise(F.substring(t, F.lit(2), F.length(t) - 2)),
    )
    return F.array_distinct(F.transform(plain, F.lower))


def schema_keys(schema: T.StructType) -> list[str]:
    """Lower-case field names of a schema at any depth."""
    names: list[str] = []

    def walk(kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                names.append(field.name.lower())
                walk(field.dataType)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType)

    walk(schema)
    return sorted(set(names))


def pii_key_scan(
    records: DataFrame, json: str, deny: Sequence[str] = PII_DENY_LIST
) -> DataFrame:
    """Adds ``violations``: deny-listed field names in the JSON column, sorted."""
    banned = F.array(*[F.lit(d.lower()) for d in deny])
    found = F.array_sort(F.array_intersect(json_keys(F.col(json)), banned))
    return records.withColumn("violations", found)


def pii_records_summary(scanned: DataFrame) -> DataFrame:
    """Union of the violations and a passed flag (at most one entry per deny-list name)."""
    return scanned.select(F.explode_outer("violations").alias("v")).agg(
        F.array_sort(F.collect_set("v")).alias("violations"),
        (F.count("v") == 0).alias("passed"),
    )


def _canonical(field: T.StructField) -> Column:
    """The exact value with its length in front, so that fields can't run into each other; "-" is null."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.lit("="), F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def dataset_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Content hash that does not depend on row order or partitioning.

    Rows are hashed one by one, and all bits of the hashes are combined by count and sums, which is
    a plain aggregation. Numbers are hashed with all their digits.
    """
    fields = [df.schema[c] for c in columns]
    rows = df.select(F.sha2(F.concat(*[_canonical(f) for f in fields]).cast("binary"), 256).alias("h"))
    piece = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("decimal(28,0)")
    combined = rows.agg(
        F.count("*").alias("n_rows"),
        F.array(*[F.coalesce(F.sum(piece(*p)), F.lit(0)).cast("string") for p in _PIECES]).alias("totals"),
    )
    text = F.concat_ws(":", F.col("n_rows").cast("string"), F.array_join("totals", ":"))
    return combined.select("n_rows", F.sha2(text, 256).alias("dataset_version"))


def dataset_contract(parts: Mapping[str, DataFrame | None], required: Sequence[str]) -> DataFrame:
    """Per required part: row count, column count and whether the column sets agree.

    ``parts`` maps names to frames. Schemas are metadata; only the row counts are jobs.
    """
    missing = [name for name in required if parts.get(name) is None]
    present = {name: parts[name] for name in required if parts.get(name) is not None}
    if not present:
        raise ValueError(f"missing parts: {', '.join(missing)}")
    first = next(iter(present.values()))
    expected = set(first.columns)
    agree = all(set(p.columns) == expected for p in present.values())
    if missing:
        status, reason = "fail", f"missing parts: {', '.join(missing)}"
    elif not agree:
        status, reason = "fail", "columns do not match across parts"
    else:
        status, reason = "pass", ""
    rows = None
    for name, part in present.items():
        counted = part.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("part"),
            "row_count",
            F.lit(len(part.columns)).alias("column_count"),
            F.lit(agree).alias("columns_match"),
            F.lit(status).alias("status"),
            F.lit(reason).alias("reason"),
        )
        rows = counted if rows is None else rows.unionByName(counted)
    return rows


def scalar_metrics(metrics: DataFrame, json: str, keys: Sequence[str]) -> DataFrame:
    """Numeric scalar entries of a metrics JSON object; booleans, lists and nulls are dropped."""
    parsed = metrics.select(*keys, F.try_parse_json(json).alias("v"))
    entries = parsed.lateralJoin(
        metrics.sparkSession.tvf.variant_explode(F.col("v").outer())
    ).select(*keys, F.col("key").alias("metric"), F.col("value"))
    kind = F.schema_of_variant("value")
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return entries.filter(numeric).select(
        *keys, "metric", F.try_variant_get("value", "$", "double").alias("value")
    )
