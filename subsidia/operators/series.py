"""Time-series features of points and their statistics by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from subsidia.session import materialize

#: Parts into which the values of a key are divided to find a percentile.
PARTS = 256
#: Distinct values of a key that one aggregation buffer may hold.
FEW = 20_000


def _moments(rows: Column) -> Column:
    """Number, means and moments around them (xx, yy, xy) of an array of (day, y), one after the other."""
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mx", "my", "xx", "yy", "xy")])

    def add(s: Column, r: Column) -> Column:
        n = s["n"] + 1
        mx, my = s["mx"] + (r["day"] - s["mx"]) / n, s["my"] + (r["y"] - s["my"]) / n
        moved = lambda v, old, new: (v - new) * (v - old)
        return F.struct(n.alias("n"), mx.alias("mx"), my.alias("my"), (s["xx"] + moved(r["day"], s["mx"], mx)).alias("xx"), (s["yy"] + moved(r["y"], s["my"], my)).alias("yy"), (s["xy"] + (r["day"] - s["mx"]) * (r["y"] - my)).alias("xy"))

    return F.aggregate(rows, start, add)


def displacement_features(series: DataFrame, keys: list[str], value: str = "displacement") -> DataFrame:
    """Trend, roughness and the largest step of each series.

    The trend is a least-squares line over days since the first observation;
    the largest step is the first one of greatest size, its index that of the
    earlier observation.  Series of one observation have zeros and no step.
    Moments are added up by date, so that the last digit, which decides a
    rounding, does not depend on the division of the rows.
    """
    by_date = Window.partitionBy(*keys).orderBy("date")
    rows = series.where(F.col(value).isNotNull()).withColumns({
        "day": F.datediff("date", F.first("date").over(by_date)).cast("double"),
        "diff": F.col(value) - F.lag(value).over(by_date),
        "at": F.row_number().over(by_date) - 2,
    })
    step = F.max_by(F.struct("at", "diff"), F.when(F.col("diff").isNotNull(), F.struct(F.abs("diff"), -F.col("at"))))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n_dates"), F.sort_array(F.collect_list(F.struct("at", "day", F.col(value).cast("double").alias("y")))).alias("x"), F.avg(F.abs("diff")).alias("roughness"), step.alias("step"))
    t = F.col("trend")
    spread = t["yy"] - F.when(t["xx"] > 0, t["xy"] ** 2 / t["xx"]).otherwise(F.lit(0.0))
    out = out.withColumn("trend", _moments(F.col("x"))).withColumns({"slope": F.when(t["xx"] > 0, t["xy"] / t["n"] / (t["xx"] / t["n"])), "residual": F.sqrt(F.greatest(spread, F.lit(0.0)) / F.col("n_dates"))})
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(*keys, "n_dates", zero(F.col("slope") * 365.25).alias("slope_per_year"), zero(F.col("residual")).alias("residual_std"), zero(F.col("roughness")).alias("roughness"), zero(F.abs("step.diff")).alias("step_abs"), F.col("step.at").alias("step_index"), F.coalesce(F.signum("step.diff"), F.lit(0.0)).cast("int").alias("step_sign"))


def amplitude_features(series: DataFrame, keys: list[str], value: str = "amplitude") -> DataFrame:
    """Mean, population deviation, their ratio, and the share of spikes beyond two deviations (0.5 at least).

    A series' values are added up by date, first for the mean and then around
    it, so that neither the division of the rows nor a running mean decides
    whether a value is just two deviations away or beyond.
    """
    known = F.when(F.col(value).isNotNull(), F.struct("date", F.col(value).cast("double").alias("v")))
    rows = series.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(known)), lambda r: r["v"]).alias("x"))
    mean = lambda values: F.when(F.size("x") > 0, F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size("x"))
    rows = rows.withColumn("amp_mean", mean(F.col("x")))
    rows = rows.withColumn("amp_std", F.sqrt(mean(F.transform("x", lambda v: (v - F.col("amp_mean")) * (v - F.col("amp_mean"))))))
    spikes = F.filter("x", lambda v: F.abs(v - F.col("amp_mean")) > 2 * F.greatest("amp_std", F.lit(0.5)))
    return rows.select(*keys, "amp_mean", "amp_std", F.when(F.size("x") > 0, F.size(spikes) / F.size("x")).alias("spike_rate"), (F.col("amp_std") / F.greatest(F.abs("amp_mean"), F.lit(0.5))).alias("amp_cv"))


def missing_rate(features: DataFrame, series: DataFrame, track: str = "track") -> DataFrame:
    """Share of the track's dates that a series lacks."""
    dates = series.groupBy(track).agg(F.count_distinct("date").alias("total_dates"))
    return features.join(dates, track).withColumn("missing_rate", F.greatest(F.lit(0.0), 1 - F.col("n_dates") / F.greatest("total_dates", F.lit(1))))


def exact_percentiles(rows: DataFrame, key: str, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exact percentiles, with linear interpolation, of columns by a key that may hold any share of the rows.

    ``wanted`` gives (values, q) by name.  Where each key has few distinct
    values, at most ``FEW`` by their estimate, Spark's own percentile counts
    them in place.  Else equal values are counted before the shuffle.
    Approximate quantiles then divide the distinct values of a key
    into parts; exact counts by part tell in which one a rank lies, and only
    that part is sorted.  A key without values has null.
    """
    estimates = rows.groupBy(key).agg(*[F.approx_count_distinct(c).alias(n) for n, (c, _) in wanted.items()])
    most = estimates.agg(F.max(F.greatest(*wanted, F.lit(0)))).first()[0]
    if (most or 0) <= FEW:
        return rows.groupBy(key).agg(*[F.percentile(c.cast("double"), q).alias(n) for n, (c, q) in wanted.items()])
    long = rows.select(key, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), c.cast("double").alias("v")) for n, (c, q) in wanted.items()])).alias("x")).select(key, "x.*")
    counts = materialize(long.where("v IS NOT NULL").groupBy(key, "name", "q", "v").agg(F.count("*").alias("n")), "value-counts")
    cuts = [k / PARTS for k in range(1, PARTS)]
    splits = counts.groupBy(key, "name").agg(F.percentile_approx("v", cuts, 10_000).alias("cuts"), F.sum("n").alias("total"))
    at = F.col("q") * (F.col("total") - 1)
    parted = counts.join(splits, [key, "name"]).withColumns({"part": F.size(F.filter("cuts", lambda c: c < F.col("v"))), "low": F.floor(at), "high": F.ceil(at), "share": at - F.floor(at)}).drop("cuts", "total", "q")
    sums = parted.groupBy(key, "name", "part", "low", "high").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.partitionBy(key, "name").orderBy("part")) - F.col("m")
    chosen = sums.withColumn("before", before).where("before <= high AND before + m > low").select(key, "name", "part", "before")
    inside = parted.join(chosen, [key, "name", "part"])
    last = F.col("before") + F.sum("n").over(Window.partitionBy(key, "name", "part").orderBy("v"))
    found = inside.withColumn("last", last)
    ranked = lambda rank: F.min(F.when(F.col("last") > F.col(rank), F.col("v")))
    ends = found.groupBy(key, "name", "share").agg(ranked("low").alias("a"), ranked("high").alias("b"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((1 - F.col("share")) * F.col("a") + F.col("share") * F.col("b"))
    return rows.select(key).distinct().join(ends.groupBy(key).agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in wanted]), key, "left")


def track_stats(points: DataFrame) -> DataFrame:
    """Percentiles by track: coherence over the values there are, deviation and amplitude ratio with missing as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    wanted = {"coherence_p05": (F.col("coherence"), 0.05), "velocity_std_p95": (zero("velocity_std"), 0.95), "amp_cv_p95": (zero("amp_cv"), 0.95), "step_p90": (F.col("step_abs"), 0.90), "step_p95": (F.col("step_abs"), 0.95)}
    return exact_percentiles(points, "track", wanted).withColumn("coherence_p05", F.coalesce("coherence_p05", F.lit(0.45)))


def melt_dates(wide: DataFrame, keys: list[str], prefix: str, value: str, *, ignore_case: bool = True) -> DataFrame:
    """Wide ``dYYYYMMDD`` columns as rows (keys, date, value); missing values are left out."""
    named = [c for c in wide.columns if (c.lower() if ignore_case else c).startswith(prefix) and c[1:].isdigit() and len(c) == 9]
    long = wide.unpivot(keys, named, "name", value)
    return long.where(F.col(value).isNotNull()).select(*keys, F.to_date(F.substring("name", 2, 8), "yyyyMMdd").alias("date"), value)
