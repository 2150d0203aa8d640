"""Adapter from the generic test tables to telemetry, deploys, faults and logs.

An event stands for a burst of requests to the service given by its user. Raw telemetry is one row
per service and 15 minutes, and the rollup that follows keeps four of them, as a minute keeps four
15-second samples. Event values have two decimals, so sums run on decimals and do not depend on the
order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators.rollup import floor_time

RAW_STEP = 900
GRAIN = 3600
CATEGORIES = ["database_saturation", "deployment_regression", "traffic_spike", "memory_leak", "dependency_failure"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events")
    return df.withColumn("service", _pick(K.SERVICE_NAMES, F.col("user_id") % 5))


def shape_telemetry(ev: DataFrame, step: int = RAW_STEP) -> DataFrame:
    """Raw telemetry rows from events (also used on the event stream of the streaming tests)."""
    kind, k = F.col("event_type"), _k()
    n = F.count(F.lit(1))
    mean = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / n
    top = F.max("value")
    is_db = F.col("service") == K.DATABASE
    return (
        ev.groupBy(floor_time(F.col("ts"), step).alias("ts"), "service")
        .agg(
            (n * 20.0).alias("request_rate"),
            mean.alias("latency_p50"),
            (mean + 0.8 * (top - mean)).alias("latency_p95"),
            top.alias("latency_p99"),
            (F.sum((kind == "error").cast("int")) / n).alias("error_rate"),
            (F.sum(k) / n / 100.0).alias("cpu_utilization"),
            (F.max(k) / 100.0).alias("memory_utilization"),
            F.max(F.when(is_db, k.cast("double"))).alias("db_connections_in_use"),
            F.sum(kind.isin("click", "view", "purchase").cast("long")).alias("log_info"),
            F.sum((kind == "signup").cast("long")).alias("log_warn"),
            F.sum((kind == "error").cast("long")).alias("log_error"),
            F.min("value").alias("span_ms"),
        )
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_telemetry(events(spark, sf_dir))


def deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).filter((F.col("event_type") == "signup") & (_k() < 10))
    return ev.select(
        "ts",
        "service",
        F.concat(F.lit("v"), _k()).alias("version"),
        F.when(_k() == 0, "rollback").otherwise("deploy").alias("kind"),
    )


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).filter((F.col("event_type") == "purchase") & (_k() == 99))
    start = floor_time(F.col("ts"), 60)
    hours = F.col("event_id") % 6 + 1
    return ev.select(
        F.concat(F.lit("F"), "event_id").alias("fault_id"),
        F.col("event_id").alias("fault_order"),
        _pick(CATEGORIES, F.floor(F.col("user_id") / 5) % 5).alias("category"),
        "service",
        start.alias("start"),
        F.timestamp_seconds(F.unix_seconds(start) + hours * 3600).alias("end"),
        F.concat(F.lit("purchase "), "event_id").alias("detail"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("log_id"),
        "ts",
        "service",
        F.when(kind == "error", "ERROR").when(kind == "signup", "WARN").otherwise("INFO").alias("level"),
        F.concat_ws(" ", kind, F.col("user_id").cast("string")).alias("message"),
    )
