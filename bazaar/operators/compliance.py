"""Compliance rates and the weighted risk score of institutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.functions.numeric import all_present
from bazaar.functions.ordering import ordered_prefix
from bazaar.session import settle
from bazaar.schema import DEFAULT_ROLES, UNKNOWN, Roles

# Weights, cuts and labels of the score.
WEIGHTS = {
    "udi_mismatch_rate": 0.40,
    "invalid_approval_rate": 0.30,
    "low_rating_rate": 0.20,
    "price_anomaly_rate": 0.10,
}
APPROVAL_PREFIX = "国械"
HIGH, MIDDLE, LOW = "高风险", "中风险", "低风险"

_INPUTS = ("udi_match", "approval_no", "rating", "actual_price", "monthly_sales")


def price_baseline(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> DataFrame:
    """Mean and spread of the price paid, zero where there is none."""
    (price,) = roles.of("actual_price")
    return df.agg(
        F.coalesce(F.avg(price), F.lit(0.0)).alias("mu"),
        F.coalesce(F.stddev_pop(price), F.lit(0.0)).alias("sd"),
    )


def compliance_metrics(
    df: DataFrame, *by: str, roles: Roles = DEFAULT_ROLES, baseline: DataFrame | None = None
) -> DataFrame:
    """Rates of the four kinds of finding, with averages and totals, per group.

    The price baseline enters as a scalar subquery: it is worked out first and
    its numbers then stand in the plan as constants.  It reads the price column
    of ``df`` unless a one-row ``baseline`` from a cheaper source is given.
    """
    udi, approval, rating, price, sales = (F.col(c) for c in roles.of(*_INPUTS))
    baseline = price_baseline(df, roles) if baseline is None else baseline
    mu, sd = baseline.select("mu").scalar(), baseline.select("sd").scalar()

    def rate(finding: Column) -> Column:
        return F.avg(F.when(finding, 1.0).otherwise(0.0))

    keys = roles.of(*by)
    known = df.where(all_present(keys))
    marked = known.withColumn("_z", F.abs((price - mu) / F.nullif(sd, F.lit(0.0))))
    invalid = (
        approval.isNull()
        | approval.isin(UNKNOWN, "", "nan", "None")
        | ~approval.startswith(APPROVAL_PREFIX)
    )
    return marked.groupBy(*[F.col(c).alias(b) for c, b in zip(keys, by)]).agg(
        rate(udi.isNull() | (udi == 0)).alias("udi_mismatch_rate"),
        rate(invalid).alias("invalid_approval_rate"),
        rate(rating < 4.0).alias("low_rating_rate"),
        rate(F.col("_z") > 3).alias("price_anomaly_rate"),
        F.avg(rating).alias("avg_rating"),
        F.avg(price).alias("avg_actual_price"),
        F.sum(sales).alias("total_sales"),
        F.count(F.lit(1)).alias("project_count"),
    )


def _scored(
    df: DataFrame, min_rows: int, roles: Roles, baseline: DataFrame | None
) -> DataFrame:
    score = sum((F.col(rate) * weight for rate, weight in WEIGHTS.items()), F.lit(0.0)) * 100
    level = (
        F.when(F.col("risk_score") >= 30, HIGH).when(F.col("risk_score") >= 15, MIDDLE).otherwise(LOW)
    )
    return (
        compliance_metrics(df, "institution", roles=roles, baseline=baseline)
        .where(F.col("project_count") >= min_rows)
        .withColumn("risk_score", F.round(score, 9))
        .withColumn("risk_level", level)
    )


_RANKED = (
    "institution", "project_count", "total_sales", *WEIGHTS, "avg_rating", "avg_actual_price",
    "risk_score", "risk_level", "risk_rank",
)


def institution_risk(
    df: DataFrame,
    min_rows: int = 5,
    roles: Roles = DEFAULT_ROLES,
    baseline: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Institutions with enough listings, scored, graded and ranked.

    The score is rounded far below its meaning, so that equal rates give equal
    scores, and so equal ranks, whatever order they were added up in.
    """
    ranked = ordered_prefix(
        _scored(df, min_rows, roles, baseline),
        [F.desc_nulls_last("risk_score"), F.asc("institution")],
        rank_by="risk_score",
        slices=slices,
    )
    return ranked.withColumn("risk_rank", F.col("rank")).select(*_RANKED).orderBy(
        "risk_rank", "institution"
    )


def institution_risk_top(
    df: DataFrame,
    n: int = 50,
    min_rows: int = 5,
    roles: Roles = DEFAULT_ROLES,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """The first ``n`` of the ranking; only they are ranked."""
    scored = _scored(df, min_rows, roles, baseline)
    first = scored.orderBy(F.desc_nulls_last("risk_score"), "institution").limit(n)
    rank = F.rank().over(Window.orderBy(F.desc_nulls_last("risk_score"))).cast("long")
    return first.withColumn("risk_rank", rank).select(*_RANKED).orderBy("risk_rank", "institution")


def institution_risk_bottom(
    df: DataFrame,
    n: int = 10,
    min_rows: int = 5,
    roles: Roles = DEFAULT_ROLES,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """The last ``n`` institutions; none at all if there are fewer than ``n``.

    Only they are picked and ranked: a rank is one more than the number of larger
    scores, and one scan counts those for all.
    """
    scored, rows = settle(_scored(df, min_rows, roles, baseline))
    last = scored.orderBy(F.asc_nulls_first("risk_score"), F.desc("institution")).limit(n if rows >= n else 0)
    scores = sorted({r["risk_score"] for r in last.select("risk_score").collect()}, key=lambda x: (x is None, x))
    larger = [F.col("risk_score").isNotNull() if x is None else F.col("risk_score") > x for x in scores]
    counts = scored.agg(*[F.count_if(test) for test in larger]).first() if scores else ()
    rank = F.lit(None).cast("long")
    for x, before in zip(scores, counts, strict=True):
        rank = F.when(F.col("risk_score").eqNullSafe(F.lit(x).cast("double")), F.lit(before + 1).cast("long")).otherwise(rank)
    return last.withColumn("risk_rank", rank).select(*_RANKED).orderBy("risk_rank", "institution")


def bottom_of(risk: DataFrame, n: int = 10) -> DataFrame:
    """The last institutions, from a ranking that is there already."""
    last = risk.orderBy(F.desc("risk_rank"), F.desc("institution")).limit(n)
    return (
        last.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy()))
        .where(F.col("_rows") >= n)
        .drop("_rows")
        .orderBy("risk_rank", "institution")
    )


def institution_risk_distribution(
    df: DataFrame,
    min_rows: int = 5,
    roles: Roles = DEFAULT_ROLES,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Institutions per risk level, with the number of all of them."""
    return distribution_of(_scored(df, min_rows, roles, baseline))


def distribution_of(risk: DataFrame) -> DataFrame:
    """Institutions per level, from scores that are there already."""
    levels = risk.groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy()).alias("institution_count_total")
    return levels.select("risk_level", "count", total).orderBy("risk_level")


def category_risk(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, baseline: DataFrame | None = None
) -> DataFrame:
    return compliance_metrics(df, "category", roles=roles, baseline=baseline).orderBy(
        F.desc("udi_mismatch_rate"), "category"
    )


def city_risk(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, baseline: DataFrame | None = None
) -> DataFrame:
    return compliance_metrics(df, "city", roles=roles, baseline=baseline).orderBy(F.desc("udi_mismatch_rate"), "city")
