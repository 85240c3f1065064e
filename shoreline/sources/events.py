"""Prediction events: schema, validation, file and Kafka sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.config import DEFAULT_SOURCE, SCHEMA_VERSION
from shoreline.plans.sizing import broadcast_if_small

# Envelope of one event. Feature values are numbers or strings, so they are read as variants.
EVENT_SCHEMA = (
    "schema_version string, event_id string, request_id string, model_id string, "
    "model_version string, timestamp string, features map<string, variant>, prediction bigint, "
    "probability double, output double, `group` string, source string, _corrupt_record string"
)
FEATURE_TYPE = "map<string, struct<num: double, text: string>>"
_KAFKA_PROVIDER = "org.apache.spark.sql.kafka010.KafkaSourceProvider"


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")


def parse_events(raw: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON text to event columns, with ``valid``, the text in ``raw`` and the columns ``keep``.

    Defaults fill a missing version, source, time and id. A missing id becomes a hash of the
    text rather than a random one, so that a repeated task yields the same event.
    """
    parsed = raw.filter(F.trim(F.col(value)) != "").select(
        *keep,
        F.col(value).alias("raw"),
        F.from_json(
            value, EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        ).alias("e"),
    )
    known = F.coalesce(
        F.forall(
            F.map_values("e.features"),
            lambda v: F.coalesce(
                _is_number(F.schema_of_variant(v)) | (F.schema_of_variant(v) == "STRING"),
                F.lit(False),
            ),
        ),
        F.lit(True),
    )
    ts = F.try_to_timestamp(F.col("e.timestamp"))
    valid = (
        F.col("e").isNotNull()
        & F.col("e._corrupt_record").isNull()
        & known
        & (F.col("e.timestamp").isNull() | ts.isNotNull())
    )
    features = F.transform_values(
        F.coalesce("e.features", F.map_from_arrays(F.array(), F.array()).cast("map<string, variant>")),
        lambda _, v: F.struct(
            F.when(_is_number(F.schema_of_variant(v)), F.try_variant_get(v, "$", "double")).alias("num"),
            F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("text"),
        ),
    )
    return parsed.withColumn("valid", valid).select(
        *keep,
        "raw",
        "valid",
        F.coalesce("e.schema_version", F.lit(SCHEMA_VERSION)).alias("schema_version"),
        F.coalesce("e.event_id", F.md5("raw")).alias("event_id"),
        "e.request_id",
        "e.model_id",
        "e.model_version",
        F.coalesce(ts, F.current_timestamp()).alias("ts"),
        F.when(F.col("valid"), features).alias("features"),
        "e.prediction",
        "e.probability",
        "e.output",
        "e.group",
        F.coalesce("e.source", F.lit(DEFAULT_SOURCE)).alias("source"),
    )


def validate_events(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Valid events, and the texts that were rejected."""
    parsed = parse_events(raw, value)
    return parsed.filter("valid").drop("valid", "raw"), parsed.filter("not valid").select("raw")


def replay_events(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Bounded replay of JSON lines; blank lines are skipped, malformed ones rejected.

    ``limit`` takes the first good events in the order of the files and their lines.
    """
    lines = spark.read.text(path)
    if limit is None:
        return validate_events(lines)[0]
    placed = lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    order = ["_file", "_block", "_line"]
    good = parse_events(placed, keep=order).filter("valid")
    return good.orderBy(*order).limit(limit).drop("valid", "raw", *order)


def present_files(spark: SparkSession, path: str) -> DataFrame:
    """``file``: the files that a folder holds now; a listing, nothing is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))


def tail_events(
    spark: SparkSession, path: str, skip: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Stream of JSON lines from files that arrive in a folder.

    A growing log is a folder that receives files. With ``skip`` the files that are there when the session
    starts are left out: their names are listed once and kept in the folder ``skip``, so a restart
    leaves out the same ones, and no clocks are compared. Malformed lines are dropped.
    """
    reader = spark.readStream.format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select("value", F.col("_metadata.file_path").alias("file"))
    if skip is not None:
        present_files(spark, path).write.mode("ignore").parquet(skip)
        lines = lines.join(broadcast_if_small(spark.read.parquet(skip)), "file", "left_anti")
    return validate_events(lines.select("value"))[0]


def kafka_available(spark: SparkSession) -> bool:
    """Whether the Kafka connector is on the class path."""
    try:
        spark._jvm.java.lang.Class.forName(_KAFKA_PROVIDER)
    except Py4JJavaError:
        return False
    return True


def _require_kafka(spark: SparkSession) -> None:
    if not kafka_available(spark):
        raise RuntimeError("add the spark-sql-kafka package to the session to use Kafka topics")


def kafka_batch_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Everything in a topic at the time of reading."""
    _require_kafka(spark)
    records = (
        spark.read.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("endingOffsets", "latest")
        .load()
    )
    return validate_events(records.select(F.col("value").cast("string").alias("value")))[0]


def kafka_stream_source(
    spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None
) -> DataFrame:
    """Continuous read from the end of a topic; progress is kept in the query's checkpoint."""
    _require_kafka(spark)
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    if max_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return validate_events(reader.load().select(F.col("value").cast("string").alias("value")))[0]


def to_event_json(events: DataFrame) -> DataFrame:
    """One JSON text per event in the envelope the sources read."""
    names = [c for c in events.columns if c not in ("ts", "features")]
    entries = F.transform(
        F.map_entries("features"),
        lambda e: F.concat(
            _json_text(e["key"]),
            F.lit(":"),
            F.coalesce(e["value"]["num"].cast("string"), _json_text(e["value"]["text"])),
        ),
    )
    features = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    body = F.to_json(F.struct(*names, stamp.alias("timestamp")))
    merged = F.concat(
        F.left(body, F.length(body) - 1), F.lit(',"features":'), features, F.lit("}")
    )
    return events.select(merged.alias("value"))


def _json_text(c: Column) -> Column:
    """A string as a JSON literal."""
    wrapped = F.to_json(F.array(c))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def emit_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines."""
    to_event_json(events).write.mode("append").text(path)


def emit_events_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Send events to a topic."""
    _require_kafka(events.sparkSession)
    (
        to_event_json(events)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def standardize_predictions(
    scored: DataFrame, model_id: str, model_version: str, source: str = DEFAULT_SOURCE,
    key: str = "row_key",
) -> DataFrame:
    """Scored rows (key, ts, features, prediction, probability, output) as events.

    The id is a hash of model and row key, so a retried job sends the same ids.
    """
    ident = F.sha1(F.concat_ws(":", F.lit(model_id), F.col(key).cast("string")).cast("binary"))
    return scored.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        ident.alias("event_id"),
        F.lit(model_id).alias("model_id"),
        F.lit(model_version).alias("model_version"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("features").cast(FEATURE_TYPE).alias("features"),
        F.col("prediction").cast("bigint").alias("prediction"),
        F.col("probability").cast("double").alias("probability"),
        F.col("output").cast("double").alias("output"),
        F.lit(source).alias("source"),
    )


def missing_required_features(events: DataFrame, required: list[str]) -> DataFrame:
    """Events lacking a required feature, with the names in ``missing``."""
    names = F.array(*[F.lit(r) for r in required])
    missing = F.array_except(names, F.map_keys("features"))
    return events.withColumn("missing", missing).filter(F.size("missing") > 0)


def score_missing_outputs(events: DataFrame, score: Column) -> DataFrame:
    """Fill prediction, probability and output where an event has features but no result.

    ``score`` is a struct column (prediction, probability, output) over the event's columns,
    such as a ``pandas_udf`` that wraps a model; a null struct leaves the event as it is.
    """
    lacking = (
        F.col("prediction").isNull() & F.col("output").isNull() & (F.size("features") > 0)
    )
    scored = events.withColumn("_s", F.when(lacking, score))
    return scored.select(
        *[
            F.coalesce(c, f"_s.{c}").alias(c) if c in ("prediction", "probability", "output") else F.col(c)
            for c in events.columns
        ]
    )
