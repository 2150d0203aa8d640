"""Streams over several batches give the rows of the batch operators."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.operators import alerts as A
from vigil.operators import baseline as B
from vigil.operators import slo as S
from vigil.streaming import jobs as J

T0 = datetime(2026, 1, 1)
N = 150


def write_in_files(df, path, per=50):
    """Files in time order, one per `per` minutes, so a stream sees them in several batches."""
    for k in range(0, N, per):
        df.filter((F.col("rn") >= k) & (F.col("rn") < k + per)).drop("rn").coalesce(1).write.mode("append").parquet(path)


def test_stateful_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [
        (i, T0 + timedelta(minutes=i), s, *[float(v) for v in rng.uniform(1, 50, len(K.STD_FLOOR))])
        for i in range(N) for s in ("web-frontend", "postgres-db") if (i, s) != (77, "web-frontend")
    ]
    table = spark.createDataFrame(rows, "rn long, ts timestamp, service string, " + ", ".join(f"{s} double" for s in K.STD_FLOOR))
    path = str(tmp_path / "minutes")
    write_in_files(table, path)
    schema = table.drop("rn").schema
    z = J.drain(J.ewma_stream(J.read_table(spark, path, schema, files_per_batch=1), J.grid_row(F.lit(T0))), "z")
    key = lambda r: (r.service, r.rn)
    assert sorted((r.asDict() for r in z.collect()), key=lambda r: (r["service"], r["rn"])) == [
        r.asDict() for r in sorted(B.ewma_z(table.drop("rn")).collect(), key=key)
    ]

    sli = table.select("rn", "ts", "service", F.col("request_rate").alias("total"), (F.col("request_rate") * 0.1).alias("bad"))
    path = str(tmp_path / "sli")
    write_in_files(sli, path)
    burn = J.drain(J.burn_stream(J.read_table(spark, path, sli.drop("rn").schema, files_per_batch=1), "bad", 0.99, [300, 3600]), "burn")
    want = {(r.service, r.ts): (r.burn_300, r.burn_3600) for r in S.rolling_burn(sli, "bad", 0.99, [300, 3600]).collect()}
    got = {(r.service, r.ts): (r.burn_300, r.burn_3600) for r in burn.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_alert_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    values = rng.choice([0.0, 1.0, 5.0, 6.0], size=N, p=[0.5, 0.2, 0.2, 0.1])
    values[-8:] = 6.0  # the last alert is still open
    table = spark.createDataFrame(
        [(i, T0 + timedelta(minutes=i), float(v), "error_rate", K.SERVICE_NAMES[i % 5]) for i, v in enumerate(values)],
        "rn long, ts timestamp, score double, signal string, service string",
    )
    path = str(tmp_path / "scores")
    write_in_files(table, path)
    events = J.drain(J.alert_stream(J.read_table(spark, path, table.drop("rn").schema, files_per_batch=1), 2.0, 2), "alerts")
    got = J.latest_alerts(events)
    assert got.filter("NOT closed").count() == 1
    want = A.runs_to_alerts(table, [2.0], [2]).drop(*A.SETTING)
    assert sorted(tuple(r) for r in got.drop("series", "closed").select(want.columns).collect()) == sorted(tuple(r) for r in want.collect())


def test_dead_letters_carry_their_reason(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("service", T.StringType(), False), T.StructField("value", T.DoubleType())])
    path = str(tmp_path / "in")
    lines = ['{"service": "a", "value": 1.5}', '{"service": "b"}', '{"value": 2.0}', "no json", '{"service": "a", "value": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("value string").parquet(path)
    J.ingest(stream, schema, f"{path}-good", f"{path}-dead", f"{path}-state")
    assert sorted((r.service, r.value) for r in spark.read.parquet(f"{path}-good/*").collect()) == [("a", 1.5), ("b", None)]
    dead = {r.message: r.reason for r in spark.read.parquet(f"{path}-dead/*").collect()}
    assert dead == {lines[2]: "no service", lines[3]: "cannot be parsed", lines[4]: "cannot be parsed"}


def test_burn_rules_on_the_stream_equal_batch(spark, tmp_path):
    """Both objectives, with holes in the minutes, a rule that opens and closes across batches and one still open."""
    rng = np.random.default_rng(5)
    rows = [
        (i, T0 + timedelta(minutes=i), s, 0.0 if i in (60, 61) else 1000.0, *[float(v) for v in (rng.uniform(600, 900) if i % 50 > 30 else rng.uniform(0, 500), 300.0 * (i >= 120) + rng.uniform(0, 20))])
        for i in range(N) for s in ("a", "b") if not (s == "a" and 20 <= i < 35)
    ]
    sli = spark.createDataFrame(rows, "rn long, ts timestamp, service string, total double, bad_availability double, bad_latency double")
    path = str(tmp_path / "sli")
    write_in_files(sli, path, per=35)
    rules = [("page", 1800, 300, 2.0), ("ticket", 3600, 600, 1.5), ("ticket", 300, 60, 3.0)]
    objectives = [("availability", "bad_availability", 0.8), ("latency", "bad_latency", 0.9)]
    events = J.drain(J.burn_rules_stream(J.read_table(spark, path, sli.drop("rn").schema, files_per_batch=1), objectives, rules), "burn-rules")
    got = J.latest_burn_alerts(events, rules)
    assert got.filter("NOT closed").count() > 0 and got.filter("closed").count() > 3
    show = ["service", "severity", "long_s", "short_s", "threshold", "start", "end", "peak_long"]
    for name, column, target in objectives:
        want, have = ({tuple(r)[:-1]: r.peak_long for r in df.select(show).collect()} for df in (S.burn_alerts(sli, column, target, rules), got.filter(F.col("slo") == name)))
        assert want and have.keys() == want.keys() and all(np.isclose(have[k], want[k], rtol=1e-12) for k in want)


def test_late_rows_are_counted_and_left_out(spark, tmp_path):
    """A shuffled replay: rows behind the watermark are counted per window, the others are rolled up."""
    rng = np.random.default_rng(6)
    batches = [[(T0 + timedelta(seconds=int(rng.integers(600 * b, 600 * b + 600)) - int(rng.choice([0, 900], p=[0.8, 0.2]))), "ab"[int(rng.integers(2))], float(rng.integers(9))) for _ in range(150)] for b in range(4)]
    path = str(tmp_path / "raw")
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, service string, x double").coalesce(1).write.mode("append").parquet(path)
    raw = J.read_table(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
    table = J.drain(J.rollup_stream_with_late(raw, "1 minute", "2 minutes", {"x": "sum"}), "late")
    late, kept, seen = {}, {}, None
    for rows in batches:
        for ts, service, x in rows:
            key = (ts.replace(second=0), service)
            if seen is not None and key[0] + timedelta(minutes=1) <= seen - timedelta(minutes=2):
                late[key] = late.get(key, 0) + 1
            else:
                kept[key] = kept.get(key, 0) + int(x)
        seen = max([r[0] for r in rows] + ([seen] if seen else []))
    kept = {k: v for k, v in kept.items() if k[0] + timedelta(minutes=1) <= seen - timedelta(minutes=2)}
    got = {(r.ts, r.service): r.n for r in table.filter("late > 0").groupBy("ts", "service").agg(F.sum("late").alias("n")).collect()}
    assert late and got == late
    assert {(r.ts, r.service): r.x for r in table.filter("late = 0").collect()} == kept


def test_five_deliveries_and_restart(spark, tmp_path):
    """A refused message is delivered again, with the next batch or alone, and goes in once it is accepted; five failures are the end."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("service", T.StringType(), False), T.StructField("value", T.DoubleType())])
    path = str(tmp_path / "in")
    paths = [f"{path}-{x}" for x in ("good", "dead", "state")]

    def send(*lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").parquet(path)

    def run(files=1):
        J.ingest(J.read_table(spark, path, T.StructType([T.StructField("value", T.StringType())]), files_per_batch=files), schema, *paths, refuse=refuse)

    def refuse(rows):  # "new" is known at the third delivery
        return F.when((F.col("r.service") == "new") & (F.col("tries") < 3), "unknown service").when(F.col("r.service") == "never", "unknown service")

    read = lambda: sorted((r.service, r.value) for r in spark.read.parquet(f"{paths[0]}/*").collect())
    dead = lambda: sorted((r.message, r.reason, r.tries) for r in spark.read.parquet(f"{paths[1]}/*").collect())
    send('{"service": "a", "value": 1}', '{"service": "new", "value": 2}', "no json")
    send('{"service": "b", "value": 3}', '{"service": "never", "value": 4}')
    run()
    first = [("a", 1.0), ("b", 3.0), ("new", 2.0)]
    lost = [("no json", "cannot be parsed", 5), ('{"service": "never", "value": 4}', "unknown service", 5)]
    assert read() == first and dead() == sorted(lost)
    run()  # nothing new: nothing is lost or doubled
    assert read() == first and dead() == sorted(lost)
    send('{"service": "c", "value": 5}', '{"service": "new", "value": 6}')
    run()
    assert read() == sorted([*first, ("c", 5.0), ("new", 6.0)]) and dead() == sorted(lost)


def test_daily_drift_equals_batch_after_each_start(spark, tmp_path):
    """Counts are carried from start to start; a day in two batches, a late key, nulls and unknown keys included."""
    from vigil.operators import drift as D

    rng = np.random.default_rng(3)
    before = [("a", float(v)) for v in rng.normal(0, 1, 500)] + [("b", 1.0)] * 40 + [("c", float(v)) for v in rng.normal(0, 1, 90)]
    reference = spark.createDataFrame(before, "k string, v double")
    days = [
        [("a", 1, float(v)) for v in rng.normal(0.2, 1, 80)] + [("b", 1, 2.0), ("a", 1, None), ("z", 1, 1.0)],
        [("a", 1, float(v)) for v in rng.normal(1, 1, 50)] + [("a", 2, float("nan"))] + [("b", 2, 1.0)],
        [("a", 3, float(v)) for v in rng.normal(0, 2, 70)] + [("c", 3, float(v)) for v in rng.normal(1, 1, 30)],
    ]
    edges = D.bin_edges(reference, ["k"], "v")
    counted, source, kept = D.bin_counts(reference, edges, ["k"], "v"), str(tmp_path / "days"), str(tmp_path / "drift")
    seen = []
    for part in days:
        rows = spark.createDataFrame([(k, T0 + timedelta(days=n), v) for k, n, v in part], "k string, ts timestamp, v double")
        rows.coalesce(1).write.mode("append").parquet(source)
        run = lambda: J.drift_counts(J.read_table(spark, source, rows.schema), edges, ["k"], "v", kept)  # noqa: E731,B023
        run()
        counts = run()  # a start without new rows changes nothing
        seen += part
        got = {(r.k, r.day.day): (r.psi, r.level) for r in D.drift_by_day(edges, counted, counts, ["k"]).collect()}
        want = {}
        for day in {n for _, n, v in seen if v is not None and v == v}:
            upto = spark.createDataFrame([(k, v) for k, n, v in seen if n <= day], "k string, v double")
            want |= {(r.k, day + 1): (r.psi, r.level) for r in D.with_level(D.psi(reference, upto, ["k"], "v")).collect() if r.k != "z"}
        assert got == want
    assert {k for k, _ in got} == {"a", "b", "c"} and got["c", 2] == (None, "no data")
