"""File sources and sinks: telemetry minutes, CSV tables, JSON reports and the incident table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil import constants as K
from vigil.operators.rollup import unpivot_wide, widen

LOG_SCHEMA = "log_id long, ts timestamp, service string, level string, message string"
DEPLOY_SCHEMA = "ts timestamp, service string, version string, kind string"
FAULT_SCHEMA = "fault_id string, fault_order long, category string, service string, start timestamp, end timestamp, detail string"
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
INTERNAL = ("start_step", "end_step", "deploy_step", "nearby_deploy_step")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; internal step columns are left out."""
    df.drop(*INTERNAL).write.option("header", True).option("timestampFormat", CSV_TIME).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampFormat", CSV_TIME).csv(path)


def ground_truth(faults: DataFrame) -> DataFrame:
    return faults.select("fault_id", "category", "service", "start", "end", "detail")


def write_minutes(minutes: DataFrame, path: str, signals: dict[str, str] = K.SIGNALS) -> None:
    """Rollup as float32, one folder per day, rows of a service together inside a file."""
    day = minutes.select(F.to_date("ts").alias("date"), "ts", "service", *[F.col(s).cast("float" if how != "sum" else "long").alias(s) for s, how in signals.items()])
    day.repartition("date").sortWithinPartitions("date", "service", "ts").write.partitionBy("date").parquet(path)


def write_minutes_wide(minutes: DataFrame, path: str, signals: list[str], services: list[str] = K.SERVICE_NAMES) -> None:
    wide = widen(minutes, signals, services)
    wide.select("ts", *[F.col(f"`{c}`").cast("float").alias(c) for c in wide.columns if c != "ts"]).write.parquet(path)


def read_minutes_wide(spark: SparkSession, path: str) -> DataFrame:
    return unpivot_wide(spark.read.parquet(path))


def _finite(value: Column, kind: T.DataType) -> Column:
    """NaN and infinities as null, at any depth."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(F.abs(value) < float("inf"), value)
    if isinstance(kind, T.StructType):
        fields = [_finite(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields)) if fields else value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    return value


def json_value(df: DataFrame) -> Column:
    """A row as JSON text: ISO times, non-finite numbers as null."""
    safe = [_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.to_json(F.struct(*safe), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"})


def write_report(df: DataFrame, path: str) -> None:
    df.select(json_value(df).alias("value")).write.text(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def incident_windows(incidents: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """The incident table: prediction and label with the features as one JSON column."""
    packed = features.select("incident_id", F.to_json(F.struct(*names)).alias("features"))
    return incidents.join(packed, "incident_id").select(
        "incident_id", "fired_at", "predicted", "confidence", "features", F.col("ground_truth.category").alias("label")
    )
