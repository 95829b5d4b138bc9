"""The listing data model: column roles, types and the fixed values they carry.

Operators never hard-code a column name.  They take a :class:`Roles`, so the
same operator runs on any flat listing table by mapping its columns to roles.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    """Column name playing each role; ``None`` marks a role the table lacks."""

    platform: str | None = "platform"
    city: str | None = "city"
    district: str | None = "district"
    store_type: str | None = "store_type"
    institution: str | None = "institution"
    category: str | None = "category"
    subcategory: str | None = "subcategory"
    spec: str | None = "spec"
    project_name: str | None = "project_name"
    list_price: str | None = "list_price"
    actual_price: str | None = "actual_price"
    discount_rate: str | None = "discount_rate"
    monthly_sales: str | None = "monthly_sales"
    review_count: str | None = "review_count"
    rating: str | None = "rating"
    doctor_name: str | None = "doctor_name"
    doctor_title: str | None = "doctor_title"
    payment_method: str | None = "payment_method"
    installment: str | None = "installment"
    channel: str | None = "channel"
    activity_tag: str | None = "activity_tag"
    approval_no: str | None = "approval_no"
    device_brand: str | None = "device_brand"
    device_model: str | None = "device_model"
    udi_match: str | None = "udi_match"
    listing_date: str | None = "listing_date"
    collection_date: str | None = "collection_date"
    new_customer: str | None = "new_customer"
    stats_month: str | None = "stats_month"
    cluster: str | None = "cluster"

    def of(self, *roles: str) -> list[str]:
        """Column names of ``roles``; a role the table lacks is an error."""
        missing = [r for r in roles if getattr(self, r) is None]
        if missing:
            raise ValueError(f"no column is mapped to {', '.join(missing)}")
        return [getattr(self, r) for r in roles]


DEFAULT_ROLES = Roles()

# The 28 raw columns in file order (raw files are read by position).
RAW_COLUMNS = [f.name for f in fields(Roles)][:28]

NUMERIC_COLUMNS = [
    "list_price", "actual_price", "discount_rate", "monthly_sales",
    "review_count", "rating", "installment", "udi_match", "new_customer",
]
DATE_COLUMNS = ["listing_date", "collection_date"]
FEATURE_COLUMNS = NUMERIC_COLUMNS[:6]
REQUIRED_COLUMNS = ["monthly_sales", "city", "category"]


def _clean_type(name: str) -> T.DataType:
    if name in NUMERIC_COLUMNS:
        return T.DoubleType()
    return T.DateType() if name in DATE_COLUMNS else T.StringType()


RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
SALES_SCHEMA = T.StructType(
    [T.StructField(c, _clean_type(c)) for c in RAW_COLUMNS]
    + [T.StructField("stats_month", T.StringType())]
)

# The labels results carry.
UNKNOWN = "未知"

# Strings read as a missing field in a raw file.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
