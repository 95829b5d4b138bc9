"""Trend sections: sales, counts and averages along one or two dimensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.schema import DEFAULT_ROLES, UNKNOWN, Roles

# Measure -> (aggregate, role it reads).
MEASURES = {
    "total_sales": (F.sum, "monthly_sales"),
    "avg_rating": (F.avg, "rating"),
    "avg_actual_price": (F.avg, "actual_price"),
    "avg_list_price": (F.avg, "list_price"),
    "avg_discount": (F.avg, "discount_rate"),
    "avg_review_count": (F.avg, "review_count"),
    "avg_monthly_sales": (F.avg, "monthly_sales"),
}


def measure(name: str, roles: Roles = DEFAULT_ROLES) -> Column:
    """A named aggregate; a name that is not a measure counts rows."""
    if name not in MEASURES:
        return F.count(F.lit(1)).alias(name)
    aggregate, role = MEASURES[name]
    return aggregate(*roles.of(role)).alias(name)


@dataclass(frozen=True)
class Section:
    """Group by ``keys`` (roles), take ``measures``, sort, maybe cut.

    ``by`` is the measure sorted on, highest first; without it rows come in
    key order.  Keys break ties, so the outcome of a cut is always the same.
    ``lead`` keys are sorted on before ``by``.
    """

    keys: tuple[str, ...]
    measures: tuple[str, ...]
    by: str | None = None
    limit: int | None = None
    lead: tuple[str, ...] = field(default=())

    def order(self) -> list[Column]:
        first = [F.asc_nulls_first(k) for k in self.lead]
        middle = [F.desc_nulls_last(self.by)] if self.by else []
        return [*first, *middle, *[F.asc_nulls_first(k) for k in self.keys if k not in self.lead]]


SECTIONS = {
    "available_months": Section(("stats_month",), ("row_cnt",)),
    "sales_trend_by_month": Section(
        ("stats_month",),
        ("total_sales", "project_count", "avg_rating", "avg_actual_price",
         "avg_list_price", "avg_discount"),
    ),
    "summary": Section(
        (),
        ("row_cnt", "total_sales", "avg_rating", "avg_actual_price",
         "avg_list_price", "avg_discount", "avg_review_count"),
    ),
    "by_city": Section(
        ("city",),
        ("total_sales", "project_count", "avg_rating", "avg_actual_price", "avg_discount"),
        by="total_sales", limit=30,
    ),
    "by_category": Section(
        ("category",),
        ("total_sales", "project_count", "avg_actual_price", "avg_discount", "avg_rating"),
        by="total_sales",
    ),
    "by_channel": Section(("channel",), ("total_sales", "count", "avg_rating"), by="total_sales"),
    "by_district": Section(
        ("district",),
        ("total_sales", "project_count", "avg_actual_price", "avg_rating"),
        by="total_sales", limit=40,
    ),
    "by_subcategory": Section(
        ("subcategory",), ("total_sales", "project_count"), by="total_sales", limit=30
    ),
    "by_store_type": Section(
        ("store_type",), ("total_sales", "project_count", "avg_actual_price"), by="total_sales"
    ),
    "by_platform": Section(
        ("platform",), ("total_sales", "project_count", "avg_rating"), by="total_sales"
    ),
    "top_projects": Section(
        ("project_name",),
        ("total_sales", "listing_count", "avg_actual_price", "avg_rating"),
        by="total_sales", limit=25,
    ),
    "doctor_title_stats": Section(
        ("doctor_title",),
        ("total_sales", "project_count", "avg_rating", "avg_actual_price"),
        by="total_sales", limit=20,
    ),
    "discount_band_stats": Section(
        ("discount_band",),
        ("project_count", "avg_monthly_sales", "avg_rating"),
        by="avg_monthly_sales",
    ),
    "city_category_top": Section(
        ("city", "category"), ("total_sales", "project_count"), by="total_sales", limit=40
    ),
    "cluster_summary": Section(
        ("cluster",),
        ("count", "avg_monthly_sales", "avg_rating", "avg_actual_price",
         "avg_list_price", "avg_discount"),
    ),
    "cluster_by_city": Section(
        ("cluster", "city"),
        ("count", "avg_monthly_sales", "avg_actual_price"),
        by="avg_monthly_sales", lead=("cluster",),
    ),
    "cluster_by_category": Section(
        ("cluster", "category"),
        ("count", "avg_monthly_sales", "avg_actual_price"),
        by="avg_monthly_sales", lead=("cluster",),
    ),
    "cluster_by_channel": Section(
        ("cluster", "channel"),
        ("count", "avg_monthly_sales", "avg_rating"),
        by="avg_monthly_sales", lead=("cluster",),
    ),
}


def trend_band(roles: Roles = DEFAULT_ROLES) -> Column:
    """The discount band of the trend sections."""
    # Cuts and labels.
    paid = F.col(*roles.of("discount_rate"))
    return (
        F.when(paid.isNull(), UNKNOWN)
        .when(paid < 0.7, "低折扣(<0.7)")
        .when(paid < 0.85, "中折扣(0.7-0.85)")
        .when(paid <= 1.0, "高折扣(>=0.85)")
        .otherwise("其它")
    )


def _key(role: str, roles: Roles) -> Column:
    made = trend_band(roles) if role == "discount_band" else F.col(*roles.of(role))
    return made.alias(role)


def inputs(section: Section, roles: Roles = DEFAULT_ROLES) -> list[str]:
    """The columns a section reads."""
    keys = ["discount_rate" if k == "discount_band" else k for k in section.keys]
    read = [MEASURES[m][1] for m in section.measures if m in MEASURES]
    return roles.of(*dict.fromkeys([*keys, *read]))


def trend_section(
    df: DataFrame, name: str, roles: Roles = DEFAULT_ROLES, limit: int | None = -1
) -> DataFrame:
    """One named section of the trend report.

    It is cut to the rows the section shows, or to ``limit``; ``None`` shows all.
    """
    section = SECTIONS[name]
    out = df.groupBy(*[_key(k, roles) for k in section.keys]).agg(
        *[measure(m, roles) for m in section.measures]
    )
    if section.keys:
        out = out.orderBy(*section.order())
    most = section.limit if limit == -1 else limit
    return out if most is None else out.limit(most)


def available_sections(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> list[str]:
    """Sections whose every input column the table has."""

    def runnable(section: Section) -> bool:
        try:
            return set(inputs(section, roles)) <= set(df.columns)
        except ValueError:
            return False

    return [name for name, section in SECTIONS.items() if runnable(section)]


def trend_report(
    df: DataFrame, names: Sequence[str] | None = None, roles: Roles = DEFAULT_ROLES
) -> DataFrame:
    """All sections from one scan, one row per section and group, uncut.

    One aggregate over the sets of keys; rows meet before the shuffle, so what
    is shuffled is the size of the report.  ``key_1`` and ``key_2`` hold a
    section's keys in order; measures a section does not list are null.
    """
    names = list(names or available_sections(df, roles))
    key_sets, keys, measures = parts_of(names)
    read = roles.of(*dict.fromkeys(MEASURES[m][1] for m in measures))
    rows = df.select(*key_columns(keys, roles), *[F.col(c) for c in read])
    grouped = rows.groupingSets([[f"_key_{k}" for k in s] for s in key_sets], *[f"_key_{k}" for k in keys]).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("row_cnt"),
        *[measure(m, roles) for m in measures],
    )
    return sections_of(grouped, names)


def parts_of(names: Sequence[str]) -> tuple[list[tuple[str, ...]], list[str], list[str]]:
    """The sets of keys, the keys, and the measures that sections have between them."""
    key_sets = list(dict.fromkeys(SECTIONS[n].keys for n in names))
    keys = list(dict.fromkeys(k for s in key_sets for k in s))
    return key_sets, keys, list(dict.fromkeys(m for n in names for m in SECTIONS[n].measures if m in MEASURES))


def key_columns(keys: Sequence[str], roles: Roles) -> list[Column]:
    return [_key(k, roles).cast("string").alias(f"_key_{k}") for k in keys]


def set_number(keys: Sequence[str], key_set: Sequence[str]) -> int:
    """The grouping id of a set: a bit for each key that is not in it."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in key_set)


def sections_of(grouped: DataFrame, names: Sequence[str]) -> DataFrame:
    """Grouped sets of keys (``_set``, ``_key_...``, ``row_cnt``, measures) as rows of sections."""
    key_sets, keys, measures = parts_of(names)

    def key(place: int) -> str:
        cases = [f"WHEN {set_number(keys, s)} THEN _key_{s[place]}" for s in key_sets if len(s) > place]
        return f"CASE _set {' '.join(cases)} END AS key_{place + 1}" if cases else f"CAST(NULL AS STRING) AS key_{place + 1}"

    def labelled(name: str) -> str:
        listed = SECTIONS[name].measures
        shown = [f"{m if m in listed else 'CAST(NULL AS DOUBLE)'} AS {m}" for m in measures]
        return f"struct('{name}' AS section, {', '.join(shown)})"

    sections = " ".join(
        f"WHEN {set_number(keys, s)} THEN array({', '.join(labelled(n) for n in names if SECTIONS[n].keys == s)})"
        for s in key_sets
    )
    return grouped.selectExpr(
        key(0), key(1), "row_cnt", f"inline(CASE _set {sections} END)"
    ).select("section", "key_1", "key_2", "row_cnt", *measures)
