"""Risk bands, prediction output, summaries and the daily operations report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.functions import scalars as S

DEFAULT_THRESHOLD = 0.5


def prediction_output(scored: DataFrame, probability: str = "probability",
                      threshold: float | None = None, cell: str = "cell_id") -> DataFrame:
    """Six output columns per scored row; a missing threshold falls to 0.5."""
    p = F.col(probability)
    limit = DEFAULT_THRESHOLD if threshold is None else threshold
    return scored.select(
        "timestamp", "site_id",
        F.concat(F.lit("CELL_"), F.col(cell).cast("string")).alias("cell_id"),
        F.round(p, 4).alias("failure_probability"),
        F.when(p >= limit, 1).otherwise(0).alias("predicted_failure"),
        S.risk_level(p).alias("risk_level"),
    )


def prediction_summary(predictions: DataFrame) -> DataFrame:
    """Totals, per cell and per risk level in one pass.

    Grouping sets expand each row before the partial aggregate, so a single
    shuffle of a few rows per task serves all three levels.
    """
    grouped = predictions.groupingSets(
        [[], [F.col("cell_id")], [F.col("risk_level")]], F.col("cell_id"), F.col("risk_level"))
    scope = S.ladder([
        (F.grouping("cell_id") == 0, F.lit("cell")), (F.grouping("risk_level") == 0, F.lit("risk")),
    ], F.lit("all"))
    failures = F.sum("predicted_failure")
    rows = F.count(F.lit(1))
    return grouped.agg(
        scope.alias("scope"), rows.alias("rows"), failures.alias("failures"),
        F.round(F.try_divide(failures * 100.0, rows), 1).alias("failure_pct"),
    ).select(
        "scope", F.coalesce("cell_id", "risk_level", F.lit("total")).alias("label"),
        "rows", "failures", "failure_pct")


def worst_risk(column: str = "risk_level") -> Column:
    """Highest risk by rank, not by spelling."""
    return F.max_by(column, S.rank_of(column, S.RISK_RANK, -1))


def high_risk_sites(predictions: DataFrame, sites: DataFrame, as_of: Column | None = None,
                    days: int = 7) -> DataFrame:
    """Towers with HIGH or CRITICAL predictions in the last ``days``."""
    since = F.date_sub(as_of if as_of is not None else F.current_date(), days)
    recent = predictions.where(
        F.col("risk_level").isin("HIGH", "CRITICAL") & (F.col("prediction_date") >= since))
    per_site = recent.groupBy("site_id").agg(
        F.avg("failure_probability").alias("avg_failure_prob"), worst_risk().alias("max_risk"))
    return per_site.join(sites.select("site_id", "site_name", "region"), "site_id").select(
        "site_id", "site_name", "region", "avg_failure_prob", "max_risk")


def daily_summary(alarms: DataFrame, predictions: DataFrame, stress: int = 100) -> DataFrame:
    """One row for the newest alarm day: alarm counts, failure risk, worst site.

    ``alarms``: gold_date, severity. ``predictions``: prediction_date, site_id,
    failure_probability, risk_level; the newest prediction day is used. The
    headline is critical from ``stress`` critical alarms on.
    """
    day = alarms.agg(F.max("gold_date")).scalar()
    counts = alarms.where(F.col("gold_date") == day).agg(
        F.max("gold_date").alias("summary_date"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_alarms"),
        F.count(F.lit(1)).alias("total_alarms"))
    newest = predictions.agg(F.max("prediction_date")).scalar()
    per_site = predictions.where(F.col("prediction_date") == newest).groupBy("site_id").agg(
        F.sum("failure_probability").alias("_p"), F.count("failure_probability").alias("_n"),
        F.max(F.col("risk_level").isin("HIGH", "CRITICAL")).alias("_high"))
    mean = F.try_divide("_p", "_n")
    risk = per_site.agg(
        F.struct(
            F.round(F.try_divide(F.sum("_p"), F.sum("_n")) * 100, 1).alias("pct"),
            F.count_if("_high").alias("high"),
            # Highest mean; the smaller id on equal means.
            F.min_by("site_id", F.struct(-mean, F.col("site_id"))).alias("worst"),
        ).alias("r")).scalar()
    out = counts.withColumn("_risk", risk)
    headline = S.ladder([
        (F.col("critical_alarms") >= stress,
         F.lit("Network under stress — immediate NOC attention required.")),
        (F.col("critical_alarms") > 0, F.lit("Critical alarms present — monitor closely."))],
        F.lit("Network operating normally."))
    pct, high, worst = F.col("_risk.pct"), F.col("_risk.high"), F.col("_risk.worst")
    text = F.format_string(
        "Latest day: %d critical alarms across %d total. Average failure risk %s%%, "
        "%d high-risk towers, worst site %s.",
        F.col("critical_alarms"), F.col("total_alarms"), F.coalesce(pct.cast("string"), F.lit("n/a")),
        F.coalesce(high, F.lit(0)), F.coalesce(worst, F.lit("n/a")))
    return out.select(
        "summary_date", "critical_alarms", "total_alarms",
        pct.alias("avg_failure_risk_pct"), high.alias("high_risk_sites"), worst.alias("worst_site"),
        headline.alias("headline"), text.alias("summary_text"),
        F.current_timestamp().alias("generated_at"))
