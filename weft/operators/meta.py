"""Effect normalisation and meta-analysis.

Effects are rows (study, effect, se, n, metric). Pools are two aggregates and a
join of one row a group, so a pool of any number of studies is summed map side.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def z_critical(level: float = 0.95) -> float:
    return NormalDist().inv_cdf(1 - (1 - level) / 2)


def mean_difference(mean_t: Column, sd_t: Column, n_t: Column, mean_c: Column, sd_c: Column, n_c: Column) -> tuple[Column, Column]:
    return mean_t - mean_c, F.sqrt(sd_t * sd_t / n_t + sd_c * sd_c / n_c)


def log_risk_ratio(a: Column, n_t: Column, c: Column, n_c: Column) -> tuple[Column, Column]:
    """Null if an arm has no events, or only events."""
    ok = (a > 0) & (c > 0) & (a < n_t) & (c < n_c)
    return F.when(ok, F.ln((a / n_t) / (c / n_c))), F.when(ok, F.sqrt(1 / a - 1 / n_t + 1 / c - 1 / n_c))


def log_odds_ratio(a: Column, n_t: Column, c: Column, n_c: Column) -> tuple[Column, Column]:
    """Null if any of the four cells is empty."""
    b, d = n_t - a, n_c - c
    ok = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    return F.when(ok, F.ln(a * d / (b * c))), F.when(ok, F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def log_hazard_ratio(hr: Column, low: Column, high: Column, level: float = 0.95) -> tuple[Column, Column]:
    """SE from the width of the interval; null unless 0 < low < hr < high."""
    ok = (low > 0) & (low < hr) & (hr < high)
    return F.when(ok, F.ln(hr)), F.when(ok, (F.ln(high) - F.ln(low)) / (2 * z_critical(level)))


SHAPES = {
    "effect": ("effect", "se"),
    "continuous": ("mean_t", "sd_t", "n_t", "mean_c", "sd_c", "n_c"),
    "binary": ("events_t", "n_t", "events_c", "n_c"),
    "hazard": ("hr", "ci_lower", "ci_upper"),
}


def normalize_effects(raw: DataFrame, binary: str = "log_rr") -> DataFrame:
    """Adds shape, effect_size, effect_se, metric_out and error to rows of nullable columns.

    A row has exactly one of the four shapes; more are ambiguous, none is unknown.
    Rows that cannot be used keep their reason in error and have no effect.
    """
    has = {k: F.lit(True) for k in SHAPES}
    for k, cols in SHAPES.items():
        for c in cols:
            has[k] = has[k] & F.col(c).isNotNull()
    n = sum((h.cast("int") for h in has.values()), F.lit(0))
    shape = F.when(n > 1, "ambiguous").when(n == 0, "unknown")
    for k, h in has.items():
        shape = shape.when(h, k)
    x = lambda c: F.col(c).cast("double")
    made = {
        "effect": (x("effect"), x("se")),
        "continuous": mean_difference(*map(x, SHAPES["continuous"])),
        "binary": (log_risk_ratio if binary == "log_rr" else log_odds_ratio)(*map(x, SHAPES["binary"])),
        "hazard": log_hazard_ratio(*map(x, SHAPES["hazard"])),
    }
    rows = raw.withColumn("shape", shape)
    size, se = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, (e, s) in made.items():
        size, se = F.when(F.col("shape") == k, e).otherwise(size), F.when(F.col("shape") == k, s).otherwise(se)
    metric = F.create_map(*[F.lit(v) for p in {"continuous": "md", "binary": binary, "hazard": "log_hr"}.items() for v in p])
    rows = rows.withColumn("effect_size", size).withColumn("effect_se", se).withColumn("metric_out", F.coalesce(F.try_element_at(metric, F.col("shape")), F.when(F.col("shape") == "effect", F.col("metric"))))
    bad = F.when(F.col("shape").isin("ambiguous", "unknown"), F.concat(F.col("shape"), F.lit(" shape"))).when(
        F.col("effect_size").isNull() | ~(F.col("effect_se") > 0) | F.isnan("effect_size"), "unusable numbers"
    )
    rows = rows.withColumn("error", bad)
    blank = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return rows.select(*raw.columns, "shape", blank("effect_size"), blank("effect_se"), blank("metric_out"), "error")


def pool(effects: DataFrame, by: list[str], *, model: str = "random", min_k: int = 3, level: float = 0.95) -> DataFrame:
    """Pools of effects(by..., effect, se): k, estimate, se, interval, Q, I2, tau2 and p's z.

    Groups under min_k studies are left out; see unpoolable() for why. I2 comes from
    the fixed-effect Q in both models; tau2 is the moment estimate, at least 0.
    """
    w = 1 / (F.col("se") * F.col("se"))
    first = effects.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), (F.sum(w * F.col("effect")) / F.sum(w)).alias("fixed")
    ).where(F.col("k") >= min_k)
    joined = effects.join(first, by)
    q = joined.groupBy(*by).agg(F.sum(w * F.pow(F.col("effect") - F.col("fixed"), F.lit(2.0))).alias("q"))
    c = F.col("sw") - F.col("sww") / F.col("sw")
    df = F.col("k") - 1
    stats = first.join(q, by).withColumn("tau2", F.when(c > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / c)).otherwise(0.0))
    stats = stats.withColumn("i2", F.when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q"))).otherwise(0.0))
    if model == "fixed":
        out = stats.select(*by, "k", F.col("fixed").alias("estimate"), F.sqrt(1 / F.col("sw")).alias("se"), "q", "i2", F.lit(0.0).alias("tau2"))
    else:
        w2 = 1 / (F.col("se") * F.col("se") + F.col("tau2"))
        again = effects.join(stats.select(*by, "k", "q", "i2", "tau2"), by)
        out = again.groupBy(*by, "k", "q", "i2", "tau2").agg((F.sum(w2 * F.col("effect")) / F.sum(w2)).alias("estimate"), F.sqrt(1 / F.sum(w2)).alias("se"))
    z = z_critical(level)
    return out.select(
        *by, "k", "estimate", "se", (F.col("estimate") - z * F.col("se")).alias("ci_low"), (F.col("estimate") + z * F.col("se")).alias("ci_high"), "q", "i2", "tau2"
    )


def unpoolable(effects: DataFrame, by: list[str], min_k: int = 3) -> DataFrame:
    """(by..., reason) of groups that pool() must not take."""
    rows = effects.groupBy(*by).agg(F.count("*").alias("k"), F.countDistinct("metric").alias("metrics"), F.bool_and(F.col("se") > 0).alias("sound"))
    reason = F.when(F.col("k") < min_k, "too few studies").when(F.col("metrics") > 1, "mixed metrics").when(~F.col("sound"), "bad standard error")
    return rows.select(*by, reason.alias("reason")).where("reason is not null")


def pool_quick(effects: DataFrame, by: list[str], high_risk: Column) -> DataFrame:
    """Fixed pool from two studies on, rounded to six places; one high-risk row closes its group."""
    w = 1 / (F.col("se") * F.col("se"))
    rows = effects.groupBy(*by).agg(F.count("*").alias("k"), F.sum(w).alias("sw"), F.sum(w * F.col("effect")).alias("swx"), F.bool_or(high_risk).alias("closed"))
    est, se = F.col("swx") / F.col("sw"), F.sqrt(1 / F.col("sw"))
    open_ = ~F.col("closed") & (F.col("k") >= 2)
    value = lambda c: F.when(open_, F.round(c, 6))
    status = F.when(F.col("closed"), "closed: high risk of bias").when(F.col("k") < 2, "skipped: too few studies").otherwise("pooled")
    return rows.select(*by, "k", status.alias("status"), value(est).alias("estimate"), value(est - 1.96 * se).alias("ci_low"), value(est + 1.96 * se).alias("ci_high"))
