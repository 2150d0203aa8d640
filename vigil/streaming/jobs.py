"""Streaming forms of ingest, rollup, baseline, alerts, burn rate, burn rules and drift counts.

Each job reads a table as a stream and writes a table, so a stage can be restarted alone and the next
one streams from what it wrote. Given the same rows a job writes what its batch operator computes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from decimal import Decimal
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigil import constants as K
from vigil.operators.baseline import ewma_step
from vigil.operators.drift import bin_counts
from vigil.operators.slo import EXACT, rules_array
from vigil.settings import scratch_path


def read_table(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """A folder of parquet files as a stream, a bounded number of files per batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """State of several variables a key needs the RocksDB store; a query takes the setting when it starts."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def drain(stream: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Run a stream over everything available, appending to a table; returns that table.

    With `path` the table and its checkpoint are kept there: the same call goes on where the last one
    stopped and reads only what is new. Without it both are new.
    """
    spark = stream.sparkSession
    out = f"{path}/rows" if path else scratch_path(spark, name)
    state = f"{path}/state" if path else scratch_path(spark, f"{name}-state")
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state)
    with _rocksdb(spark):
        query = writer.trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ------------------------------------------------------------------ ingest


#: Deliveries of a message before it is a dead letter.
DELIVERIES = 5


def ingest(messages: DataFrame, schema: T.StructType, good_path: str, dead_path: str, checkpoint: str, queue_path: str | None = None,
           deliveries: int = DELIVERIES, refuse: Callable[[DataFrame], Column | None] | None = None) -> None:
    """Messages (column `value`) to rows of `schema`; what fails `deliveries` times goes to the dead letters with its last reason.

    A delivery fails if the message is no JSON of that schema, lacks a field the schema says is not null,
    or if `refuse` (given the parsed rows as column `r`) names a reason, as for a service that is not
    known yet. A failed message waits in the queue table with the number of its deliveries; the next batch
    delivers it again, and once the source is drained the rest is delivered until the queue is empty.

    A delivery writes to folders named after it and replaces them when it is repeated; it reads the queue
    of the delivery before, which it never changes. So a restart neither loses nor doubles rows.
    """
    spark = messages.sparkSession
    queue_path = queue_path or f"{checkpoint}-queue"
    required = [f.name for f in schema.fields if not f.nullable]
    parse = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    waits = T.StructType([T.StructField("value", T.StringType()), T.StructField("tries", T.IntegerType())])

    def last(before: tuple[int, int]) -> str | None:
        """The queue of the newest delivery before (batch, round)."""
        found = [d for d in _folders(spark, queue_path) if tuple(map(int, d.split("=")[1].split("-"))) < before]
        return f"{queue_path}/{max(found)}" if found else None

    def deliver(fresh: DataFrame | None, at: tuple[int, int]) -> int:
        """One delivery of fresh and waiting messages; the number that still wait."""
        waiting, rows = last(at), []
        if waiting:
            rows.append(spark.read.schema(waits).parquet(waiting))
        if fresh is not None:
            rows.append(fresh.select("value", F.lit(0).alias("tries")))
        if not rows:
            return 0
        every = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
        parsed = every.select("value", (F.col("tries") + 1).cast("int").alias("tries"), F.from_json("value", parse, options).alias("r"))
        reason = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "cannot be parsed")
        for name in required:
            reason = reason.when(F.col(f"r.{name}").isNull(), f"no {name}")
        if refuse is not None:
            reason = F.coalesce(reason, refuse(parsed))
        name = f"batch={at[0]:09d}-{at[1]:03d}"
        parsed = parsed.withColumn("reason", reason).persist()  # parsed once for all tables
        again = F.col("reason").isNotNull() & (F.col("tries") < deliveries)
        parsed.filter("reason IS NULL").select(*[F.col(f"r.{f.name}") for f in schema.fields]).write.mode("overwrite").parquet(f"{good_path}/{name}")
        parsed.filter(F.col("reason").isNotNull() & ~again).select(F.col("value").alias("message"), "reason", "tries").write.mode("overwrite").parquet(f"{dead_path}/{name}")
        left = parsed.filter(again).select("value", "tries")
        left.write.mode("overwrite").parquet(f"{queue_path}/{name}")
        n = left.count()
        parsed.unpersist()
        return n

    def write(batch: DataFrame, number: int) -> None:
        deliver(batch, (number, 0))

    query = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    ran = [tuple(map(int, d.split("=")[1].split("-"))) for d in _folders(spark, queue_path)]
    if ran:
        batch, number = max(ran)
        while deliver(None, (batch, number := number + 1)):
            pass


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders `batch=...` below a path, through the file system the session uses."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(found):
        return []
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(found)]
    return [n for n in names if n.startswith("batch=") and fs.exists(done(f"{path}/{n}/_SUCCESS"))]


# ------------------------------------------------------------------ rollup


def rollup_stream(raw: DataFrame, grain: str = "1 minute", delay: str = "2 minutes", signals: dict[str, str] = K.SIGNALS) -> DataFrame:
    """Minute rollup; a minute is emitted once the watermark passes its end, later rows are dropped."""
    how_to = {"avg": F.avg, "max": F.max, "sum": F.sum}
    windowed = raw.withWatermark("ts", delay).groupBy(F.window("ts", grain).alias("w"), "service")
    return windowed.agg(*[how_to[how](s).alias(s) for s, how in signals.items()]).select(F.col("w.start").alias("ts"), "service", *signals)


class _Windows(StatefulProcessor):
    """Sums, counts and maxima of one window of one service, and a timer at its end."""

    def __init__(self, signals: dict[str, str]):
        self.signals = signals

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "n array<long>, x array<double>")

    def _frame(self, key: Any, late: int, values: list) -> pd.DataFrame:
        frame = pd.DataFrame({"service": [key[0]], "w": [key[1]], "late": [late]})
        return frame.assign(**{s: pd.Series([v], dtype="float64") for s, v in zip(self.signals, values, strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = key[2] // 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._frame(key, sum(len(part) for part in rows), [None] * len(self.signals))
            return
        known = self.state.get() if self.state.exists() else None
        n, x = (list(known[0]), list(known[1])) if known else ([0] * len(self.signals), [0.0] * len(self.signals))
        for part in rows:
            for j, (s, how) in enumerate(self.signals.items()):
                values = part[s].to_numpy(dtype=float)
                values = values[~np.isnan(values)]
                if len(values):
                    x[j] = max(float(values.max()), x[j] if n[j] else -math.inf) if how == "max" else x[j] + math.fsum(values)
                    n[j] += len(values)
        self.state.update((n, x))
        if known is None:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        n, x = self.state.get()
        values = [None if not c else v / c if how == "avg" else v for c, v, how in zip(n, x, self.signals.values(), strict=True)]
        self.state.clear()
        yield self._frame(key, 0, values)

    def close(self) -> None:
        pass


def rollup_stream_with_late(raw: DataFrame, grain: str = "1 minute", delay: str = "2 minutes", signals: dict[str, str] = K.SIGNALS) -> DataFrame:
    """The rollup of `rollup_stream`, and a row (late > 0, signals null) for the rows that came behind the watermark.

    A window is emitted by a timer when the watermark passes its end; rows that come for it in that batch
    or later count as late, per window and batch. State is kept per service and window, so a hot service
    is spread over its windows. The time travels as a number, or Spark would drop late rows before this step.
    """
    marked = raw.withWatermark("ts", delay)
    span = F.window("ts", grain)
    rows = marked.select("service", F.unix_micros(span["start"]).alias("w"), F.unix_micros(span["end"]).alias("e"), *[F.col(s).cast("double").alias(s) for s in signals])
    out = "service string, w long, late long, " + ", ".join(f"{s} double" for s in signals)
    done = rows.groupBy("service", "w", "e").transformWithStateInPandas(_Windows(signals), out, "Append", "EventTime")
    return done.select(F.timestamp_micros("w").alias("ts"), "service", "late", *[F.col(s).cast("long").alias(s) if how == "sum" else F.col(s) for s, how in signals.items()])


# ------------------------------------------------------------------ baseline


def grid_row(origin: Column, grain: int = 60) -> Column:
    """Row number of a minute on a grid without holes: steps since `origin`."""
    return ((F.unix_seconds("ts") - F.unix_seconds(origin)) / grain).cast("long")


def ewma_stream(minutes: DataFrame, row: Column, floors: dict[str, tuple] = K.STD_FLOOR, alpha: float = K.EWMA_ALPHA,
                warm: int = K.EWMA_WARM_ROWS, clip: float = K.EWMA_CLIP) -> DataFrame:
    """z of closed minutes, one state per service: (mean, variance, last row) of each signal.

    `row` numbers the minutes: `grid_row`, or a column joined from the stored timeline where whole
    minutes may be absent. Minutes of a service must arrive in order, which is how the rollup emits
    them; rows of one batch are sorted here.
    """
    signals = list(floors)
    rows = minutes.select("service", "ts", row.alias("rn"), *signals)
    out = T.StructType(
        [T.StructField("service", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("rn", T.LongType())]
        + [T.StructField(s, T.DoubleType()) for s in signals]
    )
    kept = T.StructType([T.StructField(f"{s}_{part}", T.DoubleType()) for s in signals for part in ("mean", "var", "last")])

    def fold(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("rn")
        known = list(state.get) if state.exists else [0.0, 0.0, 0.0] * len(signals)
        rns, cols = pdf["rn"].tolist(), {}
        for j, s in enumerate(signals):
            mean, var, last = known[3 * j : 3 * j + 3]
            zs = []
            for rn, x in zip(rns, pdf[s].tolist()):
                z = None
                if x is not None and x == x:
                    if rn == 0:
                        mean, var, last = x, 0.0, 0.0
                    else:
                        if rn - last > 1:
                            var *= (1 - alpha) ** (rn - last - 1)
                        z, mean, var = ewma_step(mean, var, x, rn, floors[s], alpha, warm, clip)
                        last = float(rn)
                zs.append(z if z is None else max(z, 0.0))
            cols[s] = zs
            known[3 * j : 3 * j + 3] = [mean, var, last]
        state.update(tuple(float(v) for v in known))
        yield pd.DataFrame({"service": pdf["service"].to_numpy(), "ts": pdf["ts"].to_numpy(), "rn": pdf["rn"].to_numpy(), **cols})

    return rows.groupBy("service").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.NoTimeout)


# ------------------------------------------------------------------ alerts

#: `fired` is null while no alert is open; since, peak and who then describe the stretch that may become one.
ALERT_STATE = "hot long, cold long, since long, fired long, peak double, who string"
ALERT_ROW = ["fired_at", "started_at", "ended_at", "service", "signal", "peak", "closed"]


class AlertTracker:
    """One series between two batches, moved on a stretch (rows on one side of the threshold) at a time."""

    def __init__(self, consecutive: int, cooldown: int, kept: tuple | None):
        self.consecutive, self.cooldown = consecutive, cooldown
        self.hot, self.cold, self.since, self.fired, self.peak, self.who = kept or (0, 0, 0, None, 0.0, "")

    def kept(self) -> tuple:
        return self.hot, self.cold, self.since, self.fired, float(self.peak), self.who

    def row(self, ended: int, closed: bool) -> tuple:
        signal, service = self.who.split("|", 1)
        return self.fired, self.since, ended, service, signal, self.peak, closed

    def above(self, times: np.ndarray, values: np.ndarray, names: np.ndarray) -> None:
        """A stretch above the threshold: fires at its `consecutive`-th row, raises the peak."""
        if self.fired is None and self.hot == 0:
            self.since, self.peak, self.who = int(times[0]), -math.inf, ""
        best = int(values.argmax())
        if values[best] > self.peak:
            self.peak, self.who = float(values[best]), str(names[best])
        if self.fired is None and self.hot + len(times) >= self.consecutive:
            self.fired = int(times[max(self.consecutive - self.hot, 1) - 1])
        self.hot, self.cold = self.hot + len(times), 0

    def below(self, times: np.ndarray) -> tuple | None:
        """A stretch at or below it: the `cooldown`-th row closes an open alert."""
        before, self.hot, self.cold = self.cold, 0, self.cold + len(times)
        if self.fired is None or self.cold < self.cooldown:
            return None
        done = self.row(int(times[self.cooldown - before - 1]), True)
        self.fired = None
        return done


def alert_stream(scores: DataFrame, threshold: float, consecutive: int, cooldown: int = K.COOLDOWN_ROWS, series: Column | None = None) -> DataFrame:
    """Alerts as they fire, go on and close; rows (ts, score, signal, service) come in time order.

    Every batch writes the alerts it closes, and the open one as it stands at the batch's last row, so
    an outage is known in the batch in which it fires; `latest_alerts` keeps the newest row of each.
    The state is six values per series.
    """
    rows = scores.select((series if series is not None else F.lit("all")).alias("series"), "ts", "score", "signal", "service")
    out = "series string, fired_at timestamp, started_at timestamp, ended_at timestamp, service string, signal string, peak double, closed boolean"

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("ts")
        times = pdf["ts"].to_numpy().astype("datetime64[us]").astype("int64")
        values, names = pdf["score"].to_numpy(dtype=float), (pdf["signal"].fillna("") + "|" + pdf["service"].fillna("")).to_numpy()
        tracker = AlertTracker(consecutive, cooldown, state.get if state.exists else None)
        hot, found = values > threshold, []
        turns = np.flatnonzero(np.diff(hot)) + 1
        for part in np.split(np.arange(len(times)), turns):
            if hot[part[0]]:
                tracker.above(times[part], values[part], names[part])
            elif (done := tracker.below(times[part])) is not None:
                found.append(done)
        if tracker.fired is not None:
            found.append(tracker.row(int(times[-1]), False))
        state.update(tracker.kept())
        frame = pd.DataFrame(found, columns=ALERT_ROW)
        for c in ALERT_ROW[:3]:
            frame[c] = pd.to_datetime(frame[c], unit="us")
        yield frame.assign(series=key[0])[["series", *ALERT_ROW]]

    return rows.groupBy("series").applyInPandasWithState(step, out, ALERT_STATE, "append", GroupStateTimeout.NoTimeout)


def latest_alerts(events: DataFrame) -> DataFrame:
    """Newest row of every alert the stream has written, open ones included."""
    newest = F.max_by(F.struct("started_at", "ended_at", "service", "signal", "peak", "closed"), F.struct("ended_at", "closed")).alias("a")
    return events.groupBy("series", "fired_at").agg(newest).select("series", "fired_at", "a.*")


# ------------------------------------------------------------------ burn rate


def burn_stream(sli: DataFrame, column: str, target: float, windows: list[int]) -> DataFrame:
    """Burn rate of every window at each closed minute.

    The state of a service is the minutes of the longest window (4,320 for three days), so a minute
    costs one pass over it; a sliding event-time window would copy every row 4,320 times.
    """
    rows = sli.select("service", F.unix_seconds("ts").alias("t"), F.coalesce(column, F.lit(0.0)).alias("bad"), F.coalesce("total", F.lit(0.0)).alias("total"))
    out = "service string, t long, " + ", ".join(f"burn_{w} double" for w in windows)
    kept = "t array<long>, bad array<double>, total array<double>"
    longest = max(windows)

    def step(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("t")
        old = state.get if state.exists else ([], [], [])
        t = np.concatenate([np.asarray(old[0], dtype=np.int64), pdf["t"].to_numpy()])
        bad = np.concatenate([np.asarray(old[1], dtype=float), pdf["bad"].to_numpy()])
        total = np.concatenate([np.asarray(old[2], dtype=float), pdf["total"].to_numpy()])
        first_new = len(t) - len(pdf)
        result = {"service": pdf["service"].to_numpy(), "t": pdf["t"].to_numpy()}
        for w in windows:
            start = np.searchsorted(t, t - w, side="right")
            sums = [(math.fsum(bad[a : i + 1]), math.fsum(total[a : i + 1])) for i, a in enumerate(start) if i >= first_new]
            result[f"burn_{w}"] = [b / n / (1 - target) if n else None for b, n in sums]
        keep = t > t[-1] - longest
        state.update((t[keep].tolist(), bad[keep].tolist(), total[keep].tolist()))
        yield pd.DataFrame(result)

    burns = rows.groupBy("service").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)
    return burns.select("service", F.timestamp_seconds("t").alias("ts"), *[f"burn_{w}" for w in windows])


#: Seconds of running sums that are kept in one entry of the state.
BUCKET = 3600
_UNIT = 10**12  # sums are exact in units of the last decimal that `slo.EXACT` keeps
BURN_EVENT = ["rule_no", "start", "end", "peak_long", "closed"]


class _BurnRules(StatefulProcessor):
    """Running sums of one service and objective by the hour, and what each rule's open period has seen.

    The sum over a window is the difference of two running sums. The older one is looked up in the entry of
    its hour, so a row reads one entry per window, whatever the window's length.
    """

    def __init__(self, rules: list[tuple], step: int):
        self.rules, self.step = rules, step
        self.windows = sorted({w for _, lo, sh, _ in rules for w in (lo, sh)})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "first long, last long, oldest long, bad string, total string, since array<long>, peak array<double>")
        self.sums = handle.getMapState("sums", "hour long", "bad0 string, total0 string, t array<long>, bad array<string>, total array<string>")

    def _entry(self, held: dict, hour: int) -> tuple:
        if hour not in held:
            e = self.sums.getValue((hour,))
            held[hour] = (int(e[0]), int(e[1]), list(e[2]), [int(v) for v in e[3]], [int(v) for v in e[4]])
        return held[hour]

    def _until(self, held: dict, t: int, oldest: int) -> tuple[int, int]:
        """Running sums of the last row at or before t."""
        if t // BUCKET < oldest:
            return 0, 0  # nothing came so early: entries go only when no window reaches them
        bad0, total0, times, bad, total = self._entry(held, t // BUCKET)
        i = int(np.searchsorted(times, t, side="right"))
        return (bad[i - 1], total[i - 1]) if i else (bad0, total0)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("t")
        allowed, longest = 1 - float(pdf["target"].iloc[0]), self.windows[-1]
        held: dict[int, tuple] = {}
        changed, found = set(), []
        if self.head.exists():
            first, last, oldest, bad, total, since, peak = self.head.get()
            bad, total, since, peak = int(bad), int(total), list(since), list(peak)
        else:
            first = int(pdf["t"].iloc[0])
            last, oldest, bad, total = first, first // BUCKET, 0, 0
            since, peak = [-1] * len(self.rules), [0.0] * len(self.rules)
            held[oldest] = (0, 0, [], [], [])
        for t, b, n in zip(pdf["t"].tolist(), pdf["bad"].tolist(), pdf["total"].tolist(), strict=True):
            reach = (t - longest) // BUCKET  # the earliest hour that a window still looks up
            for hour in range(max(last // BUCKET + 1, reach), t // BUCKET + 1):  # hours without rows carry the sums on
                held[hour] = (bad, total, [], [], [])
                changed.add(hour)
            for hour in range(oldest, min(reach, last // BUCKET + 1)):
                held.pop(hour, None)
                changed.discard(hour)
                if self.sums.containsKey((hour,)):
                    self.sums.removeKey((hour,))
            oldest = max(oldest, reach)
            bad, total, last = bad + int(Decimal(b).scaleb(12)), total + int(Decimal(n).scaleb(12)), t
            entry = self._entry(held, t // BUCKET)
            entry[2].append(t)
            entry[3].append(bad)
            entry[4].append(total)
            changed.add(t // BUCKET)
            burn = {}
            for w in self.windows:
                bad0, total0 = self._until(held, t - w, oldest)
                traffic = (total - total0) / _UNIT
                burn[w] = (bad - bad0) / _UNIT / traffic / allowed if traffic else None
            for i, (_, long_s, short_s, threshold) in enumerate(self.rules):
                long_burn, short_burn = burn[long_s], burn[short_s]
                fires = t >= first + long_s - self.step and None not in (long_burn, short_burn) and long_burn > threshold and short_burn > threshold
                if fires and since[i] < 0:
                    since[i], peak[i] = t, long_burn
                elif since[i] >= 0:
                    peak[i] = max(peak[i], peak[i] if long_burn is None else long_burn)
                if not fires and since[i] >= 0:
                    found.append((i, since[i], t, peak[i], True))
                    since[i] = -1
        found += [(i, at, last, peak[i], False) for i, at in enumerate(since) if at >= 0]
        for hour in changed:
            bad0, total0, times, bads, totals = held[hour]
            self.sums.updateValue((hour,), (str(bad0), str(total0), times, [str(v) for v in bads], [str(v) for v in totals]))
        self.head.update((first, last, oldest, str(bad), str(total), since, peak))
        yield pd.DataFrame(found, columns=BURN_EVENT).assign(service=key[0], slo=key[1])[["service", "slo", *BURN_EVENT]]

    def close(self) -> None:
        pass


def burn_rules_stream(sli: DataFrame, objectives: list[tuple[str, str, float]], rules=K.BURN_RULES, step: int = 60) -> DataFrame:
    """Periods of every rule as they open and close, for objectives (name, column of bad requests, target).

    As in `alert_stream` each batch writes the periods it closes and the open ones as they stand;
    `latest_burn_alerts` keeps the newest row of each, which equals `slo.burn_alerts`. Minutes of a service must
    come in order, as the rollup emits them; those of one batch are sorted here.
    """
    exact = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast(EXACT)
    listed = F.array(*[F.struct(F.lit(n).alias("slo"), F.lit(float(t)).alias("target"), exact(c).alias("bad")) for n, c, t in objectives])
    rows = sli.select("service", F.unix_seconds("ts").alias("t"), exact("total").alias("total"), F.explode(listed).alias("o")).select("service", "o.slo", "o.target", "t", "o.bad", "total")
    out = "service string, slo string, rule_no int, start long, end long, peak_long double, closed boolean"
    events = rows.groupBy("service", "slo").transformWithStateInPandas(_BurnRules(list(rules), step), out, "Append", "None")
    return events.withColumns({c: F.timestamp_seconds(c) for c in ("start", "end")})


def latest_burn_alerts(events: DataFrame, rules=K.BURN_RULES) -> DataFrame:
    """Newest row of every period the stream has written, with its rule."""
    newest = F.max_by(F.struct("end", "peak_long", "closed"), F.struct("end", "closed")).alias("p")
    last = events.groupBy("service", "slo", "rule_no", "start").agg(newest).withColumn("r", F.get(rules_array(rules), F.col("rule_no")))
    return last.select("service", "slo", "r.severity", "r.long_s", "r.short_s", "r.threshold", "start", F.col("p.end").alias("end"), "p.peak_long", "p.closed")


# ------------------------------------------------------------------ drift


def drift_counts(rows: DataFrame, edges: DataFrame, keys: list[str], value: str, path: str, time: str = "ts", bins: int = 10) -> DataFrame:
    """Rows per key, day and bin of the reference's edges, kept below `path`; returns all counts so far.

    Every call reads only rows that came since the last one, as a daily job does. A batch writes its
    counts to a folder named after it and replaces them when it is repeated, so a restart neither loses nor
    doubles rows; a day that comes in several batches has several counts (drift_by_day adds them up).
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        days = batch.withColumn("day", F.to_date(time))
        bin_counts(days, edges, keys, value, bins, ["day"]).write.mode("overwrite").parquet(f"{path}/counts/batch={number:09d}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    kinds = [rows.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("day", T.DateType()), T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])
    done = [f"{path}/counts/{name}" for name in _folders(spark, f"{path}/counts")]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)
