"""SLI minutes, error budgets and multi-window burn-rate alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil import constants as K
from vigil.functions.stats import latency_good_share
from vigil.operators.rollup import floor_time, shift

DAY = 86_400
EXACT = "decimal(28,12)"


def sli_minutes(minutes: DataFrame, threshold_ms: float = K.LATENCY_THRESHOLD_MS, step: int = 60) -> DataFrame:
    """Requests and bad requests per service minute; a projection, no shuffle."""
    total = F.col("request_rate") * float(step)
    failing = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("error_rate")))
    good = latency_good_share(F.col("latency_p50"), F.col("latency_p95"), threshold_ms)
    return minutes.select(
        "ts",
        "service",
        total.alias("total"),
        (total * failing).alias("bad_availability"),
        (total * (1.0 - good)).alias("bad_latency"),
    )


def budget_minutes(target: Column, days: int = K.SLO_DAYS) -> Column:
    return (F.lit(1.0) - target) * float(days * 24 * 60)


def budget_share(threshold: Column, long_s: Column, days: int = K.SLO_DAYS) -> Column:
    return threshold * long_s / float(days * DAY)


def burn_rate(bad: Column, total: Column, target: float) -> Column:
    """Observed over allowed error share; null without traffic."""
    return F.when(total != 0, bad / total) / F.lit(1 - target)


def rules_array(rules=K.BURN_RULES) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule_no"), F.lit(sev).alias("severity"), F.lit(int(lo)).alias("long_s"),
                F.lit(int(sh)).alias("short_s"), F.lit(float(th)).alias("threshold"),
            )
            for i, (sev, lo, sh, th) in enumerate(rules)
        ]
    )


def budget_rules(spark: SparkSession, rules=K.BURN_RULES, slos: dict[str, float] = K.SLOS) -> DataFrame:
    """Every rule against every objective: budget minutes, allowed rate and share of budget spent."""
    listed = F.array(*[F.struct(F.lit(n).alias("slo"), F.lit(t).alias("target")) for n, t in slos.items()])
    grid = spark.range(1).select(F.explode(listed).alias("s")).select("s.*", F.explode(rules_array(rules)).alias("r"))
    return grid.select(
        "slo",
        "target",
        "r.severity",
        "r.long_s",
        "r.short_s",
        "r.threshold",
        (F.lit(1.0) - F.col("target")).alias("allowed_error_rate"),
        budget_minutes(F.col("target")).alias("budget_minutes"),
        budget_share(F.col("r.threshold"), F.col("r.long_s")).alias("budget_share"),
    )


def _trailing_sum(column: str, seconds: int, keys: list[str]) -> Column:
    """Exact sum over (t - seconds, t].

    The difference of two running sums, so a row costs the same for five minutes and for three days;
    a sliding frame would add up 4,320 rows per minute for the latter. Decimals make it exact.
    """
    base = Window.partitionBy(*keys).orderBy(F.unix_seconds("ts"))
    amount = F.coalesce(F.col(column), F.lit(0.0)).cast(EXACT)
    upto = F.sum(amount).over(base.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum(amount).over(base.rangeBetween(Window.unboundedPreceding, -seconds))
    return (upto - F.coalesce(before, F.lit(0).cast(EXACT))).cast("double")


def rolling_burn(sli: DataFrame, column: str, target: float, windows: list[int], keys: list[str] | None = None) -> DataFrame:
    """burn_<seconds> for every window; one row per service minute bounds each window partition."""
    keys = keys or ["service"]
    sums = {f"t{w}": _trailing_sum("total", w, keys) for w in windows} | {f"b{w}": _trailing_sum(column, w, keys) for w in windows}
    burns = {f"burn_{w}": burn_rate(F.col(f"b{w}"), F.col(f"t{w}"), target) for w in windows}
    return sli.withColumns(sums).select(*keys, "ts", *[b.alias(n) for n, b in burns.items()])


def burn_alerts(sli: DataFrame, column: str, target: float, rules=K.BURN_RULES, step: int = 60) -> DataFrame:
    """Periods in which both windows of a rule exceed its threshold, once the long window is full."""
    windows = sorted({w for _, lo, sh, _ in rules for w in (lo, sh)})
    burn = rolling_burn(sli, column, target, windows)
    by_window = F.create_map(*[x for w in windows for x in (F.lit(w), F.col(f"burn_{w}"))])
    line = Window.partitionBy("service").orderBy("ts")
    per_rule = (
        burn.withColumns({"first_ts": F.min("ts").over(Window.partitionBy("service")), "next_ts": F.lead("ts").over(line)})
        .withColumn("burns", by_window)
        .withColumn("r", F.explode(rules_array(rules)))
        .withColumns({"long_burn": F.element_at("burns", F.col("r.long_s")), "short_burn": F.element_at("burns", F.col("r.short_s"))})
    )
    full = F.unix_seconds("ts") >= F.unix_seconds("first_ts") + F.col("r.long_s") - step
    firing = (F.col("long_burn") > F.col("r.threshold")) & (F.col("short_burn") > F.col("r.threshold")) & full
    rule = Window.partitionBy("service", "r.rule_no").orderBy("ts")
    marked = per_rule.withColumn("on", F.coalesce(firing, F.lit(False))).withColumns(
        {"was": F.lag("on", 1, False).over(rule), "next_burn": F.lead("long_burn").over(rule)}
    )
    # only firing rows continue: a new period starts where the row before was quiet
    starts = F.sum(F.when(F.col("was"), 0).otherwise(1)).over(rule.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    periods = marked.filter("on").withColumn("period", starts)
    return (
        periods.groupBy("service", F.col("r.rule_no").alias("rule_no"), "period")
        .agg(
            F.first("r.severity").alias("severity"),
            F.first("r.long_s").alias("long_s"),
            F.first("r.short_s").alias("short_s"),
            F.first("r.threshold").alias("threshold"),
            F.min("ts").alias("start"),
            F.max(F.coalesce("next_ts", "ts")).alias("end"),
            # the row that ends the period counts towards its peak
            F.greatest(F.max("long_burn"), F.max("next_burn")).alias("peak_long"),
        )
        .drop("rule_no", "period")
    )


def _at(sli: DataFrame, at: str | None) -> Column:
    if at is not None:
        return F.unix_seconds(F.lit(at).cast("timestamp"))
    return sli.agg(F.max(F.unix_seconds("ts"))).scalar()


def slo_status(
    sli: DataFrame, column: str, target: float, name: str, at: str | None = None, days: int = K.SLO_DAYS, step: int = 60
) -> DataFrame:
    """SLI and budget over the `days` ending at `at` (latest row by default), one row per service."""
    end = _at(sli, at)
    t = F.unix_seconds("ts")
    window = sli.withColumn("at", end).filter((t <= F.col("at")) & (t >= F.col("at") - days * DAY + step))
    sums = window.groupBy("service").agg(
        F.sum(column).alias("bad"), F.sum("total").alias("total"), F.min(t).alias("t0"), F.max(t).alias("t1")
    )
    share = F.coalesce(F.when(F.col("total") != 0, F.col("bad") / F.col("total")), F.lit(0.0))
    consumed = share / F.lit(1 - target)
    left = 1.0 - consumed
    return sums.select(
        "service",
        F.lit(name).alias("slo"),
        F.lit(target).alias("target"),
        (1.0 - share).alias("sli"),
        F.round((F.col("t1") - F.col("t0")) / DAY + step / DAY, 2).alias("window_days"),
        consumed.alias("budget_consumed"),
        left.alias("budget_remaining"),
        budget_minutes(F.lit(target), days).alias("budget_minutes_total"),
        (budget_minutes(F.lit(target), days) * left).alias("budget_minutes_left"),
    )


def burn_now(sli: DataFrame, column: str, target: float, windows: list[int], at: str | None = None) -> DataFrame:
    """Burn rate of each trailing window at `at`, all windows in one pass, 0 without traffic."""
    end = _at(sli, at)
    t = F.unix_seconds("ts")
    recent = sli.withColumn("at", end).filter((t <= F.col("at")) & (t > F.col("at") - max(windows)))

    def total(c: str, w: int) -> Column:
        return F.sum(F.when(t > F.col("at") - w, F.col(c)))

    sums = recent.groupBy("service").agg(
        *[total(column, w).alias(f"b{w}") for w in windows], *[total("total", w).alias(f"t{w}") for w in windows]
    )
    return sums.select(
        "service", *[F.coalesce(burn_rate(F.col(f"b{w}"), F.col(f"t{w}"), target), F.lit(0.0)).alias(f"burn_{w}") for w in windows]
    )


def cumulative_budget(sli: DataFrame, column: str, target: float, step: int = 1800, skip_days: int = 2) -> DataFrame:
    """Budget left since the start at a coarser step (maximum in the step), first days skipped."""
    line = Window.partitionBy("service").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sli.withColumns({"bad": F.sum(column).over(line), "all": F.sum("total").over(line)})
    left = run.select("service", "ts", (1.0 - F.when(F.col("all") != 0, F.col("bad") / F.col("all")) / F.lit(1 - target)).alias("left"))
    first = sli.agg(F.min(F.unix_seconds("ts"))).scalar()
    return (
        left.groupBy("service", floor_time(F.col("ts"), step).alias("ts"))
        .agg(F.max("left").alias("budget_remaining"))
        .withColumn("first", first)
        .filter(F.unix_seconds("ts") >= F.col("first") + skip_days * DAY)
        .drop("first")
    )


def rolling_budget(sli: DataFrame, column: str, target: float, rows: int = 43_200) -> DataFrame:
    """SLI and budget over the last `rows` + 1 rows, from the difference of running sums."""
    line = Window.partitionBy("service").orderBy("ts")
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sli.withColumns(
        {
            "bad": F.sum(F.coalesce(F.col(column), F.lit(0.0)).cast(EXACT)).over(upto),
            "all": F.sum(F.coalesce(F.col("total"), F.lit(0.0)).cast(EXACT)).over(upto),
        }
    )
    zero = F.lit(0).cast("decimal(38,12)")
    bad = (F.col("bad") - F.coalesce(F.lag("bad", rows + 1).over(line), zero)).cast("double")
    total = (F.col("all") - F.coalesce(F.lag("all", rows + 1).over(line), zero)).cast("double")
    parts = run.select("service", "ts", bad.alias("b"), total.alias("t"))
    share = F.coalesce(F.when(F.col("t") != 0, F.col("b") / F.col("t")), F.lit(0.0))
    return parts.select("service", "ts", (1.0 - share).alias("sli"), (1.0 - share / F.lit(1 - target)).alias("budget_remaining"))


def sustained(burn: DataFrame, condition: Column, hold_s: int, keys: list[str] | None = None) -> DataFrame:
    """Periods in which `condition` held without a break for at least `hold_s` seconds."""
    keys = keys or ["service"]
    line = Window.partitionBy(*keys).orderBy("ts")
    marked = burn.withColumn("on", F.coalesce(condition, F.lit(False))).withColumn("was", F.lag("on", 1, False).over(line))
    period = F.sum(F.when(F.col("was"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        marked.filter("on")
        .withColumn("period", period)
        .groupBy(*keys, "period")
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_true"))
        .filter(F.unix_seconds("last_true") - F.unix_seconds("started_at") >= hold_s)
        .select(*keys, "started_at", shift(F.col("started_at"), hold_s).alias("fired_at"), "last_true")
    )


def rule_periods(rows: DataFrame, rules: list[tuple[str, str, Column, int]], keys: list[str] | None = None) -> DataFrame:
    """Periods of alert rules (name, severity, condition, seconds it must hold) over `rows`, one row per key and `ts`.

    A rule fires `hold` seconds after its condition became true, if it is true in every row until then; it is
    active if the condition still holds in the key's last row. A null condition counts as false. All rules
    share one sort per key; only rows on which a condition holds go on.
    """
    keys = keys or ["service"]
    listed = F.array(*[
        F.struct(F.lit(i).alias("no"), F.lit(n).alias("rule"), F.lit(sev).alias("severity"), F.lit(int(hold)).alias("hold_s"), F.coalesce(on, F.lit(False)).alias("on"))
        for i, (n, sev, on, hold) in enumerate(rules)
    ])
    line = Window.partitionBy(*keys).orderBy("ts")
    # the number of quiet rows so far is the same in all rows of a period
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = rows.withColumn("r", listed).withColumn("newest", F.max("ts").over(Window.partitionBy(*keys)))
    quiet = F.array(*[F.sum((~F.get("r", F.lit(i))["on"]).cast("long")).over(upto) for i in range(len(rules))])
    held = marked.withColumn("quiet", quiet).select(*keys, "ts", "newest", F.explode(F.filter("r", lambda r: r["on"])).alias("r"), "quiet")
    spans = held.withColumn("period", F.get("quiet", F.col("r.no"))).groupBy(*keys, "r.rule", "r.severity", "r.hold_s", "period").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("last_true"), F.max("newest").alias("newest")
    )
    fired = F.timestamp_seconds(F.unix_seconds("started_at") + F.col("hold_s"))
    return spans.filter(F.unix_seconds("last_true") - F.unix_seconds("started_at") >= F.col("hold_s")).select(
        *keys, "rule", "severity", "started_at", fired.alias("fired_at"), "last_true", (F.col("last_true") == F.col("newest")).alias("active")
    )


def release_freeze(releases: DataFrame, budget: DataFrame, urgent: Column, step: int = 60, limit: float = K.BUDGET_FREEZE) -> DataFrame:
    """Releases (ts, service, ...) against the budget each objective of their service had left when they were made.

    budget: service, slo, ts, budget_remaining, fast_burn. The row that counts is the last one whose step has
    ended by then, found in one sort of releases and budget rows per service; without any nothing is frozen.
    """
    names = F.broadcast(budget.select("service", "slo").distinct())  # one row per service and objective
    asked = releases.withColumn("urgent", urgent).join(names, "service", "left")
    columns = asked.columns
    known = budget.select("service", "slo", shift(F.col("ts"), step).alias("_at"), F.struct("budget_remaining", "fast_burn").alias("_b"))
    both = asked.withColumns({"_at": F.col("ts"), "_asked": F.lit(1)}).unionByName(known.withColumn("_asked", F.lit(0)), allowMissingColumns=True)
    line = Window.partitionBy("service", "slo").orderBy("_at", "_asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_b", F.last("_b", True).over(line)).filter("_asked = 1")
    frozen = F.coalesce(F.col("_b.budget_remaining") < limit, F.lit(False))
    return seen.select(*columns, "_b.budget_remaining", F.coalesce("_b.fast_burn", F.lit(False)).alias("fast_burn"), frozen.alias("frozen"), (~frozen | F.col("urgent")).alias("allowed"))


def worst_budget(status: DataFrame) -> DataFrame:
    """Service with the least budget left."""
    return status.agg(F.min(F.struct("budget_remaining", "service")).alias("w")).select("w.service", "w.budget_remaining")
