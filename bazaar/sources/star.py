"""The listing table derived from a star schema of orders and line items.

A listing is a line item that finds its row in all other tables, so all are
joined, whatever columns are asked for.  Each column names the tables it comes
from; where every foreign key is known to find its row, ``trusted_keys=True``
joins only those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.schema import RAW_COLUMNS, UNKNOWN

# Line items that are joined at once, where a table is worked on in turns.
ROWS_A_TURN = 16_000_000

# Column -> tables it needs besides lineitem.
_TABLES = {
    "platform": {"orders"},
    "city": {"orders", "customer", "nation"},
    "district": {"supplier", "district"},
    "store_type": {"orders", "customer"},
    "institution": {"orders", "customer", "nation", "supplier"},
    "category": {"part"},
    "subcategory": {"part"},
    "spec": {"part"},
    "project_name": {"part"},
    "doctor_name": {"orders", "customer"},
    "doctor_title": {"orders", "customer"},
    "channel": {"orders", "customer", "nation", "region"},
    "activity_tag": {"orders"},
    "device_brand": {"part"},
    "device_model": {"part"},
    "listing_date": {"orders"},
    "new_customer": {"orders", "customer"},
}
_ALL_TABLES = set().union(*_TABLES.values())

# Column -> SQL expression over the joined tables.
_SPIKE = "CASE WHEN l_orderkey % 250 = 7 THEN 8D ELSE 1D END"
_PAID = "1D - 5D * l_discount"
_APPROVAL = """CASE l_suppkey % 3 WHEN 2 THEN (l_partkey + l_orderkey) % 8
    WHEN 1 THEN (l_partkey + l_orderkey) % 24 ELSE 9 END"""
_EXPRESSIONS = {
    "platform": "o_orderpriority",
    "city": "n_name",
    "district": "d_name",
    "store_type": "c_mktsegment",
    "institution": """CASE WHEN n_nationkey % 5 = 0 AND l_orderkey % 5 < 3 THEN 'Supplier#HUB'
        WHEN n_nationkey % 5 = 1 AND l_orderkey % 20 < 9 THEN 'Supplier#MID' ELSE s_name END""",
    "category": "p_type",
    "subcategory": "p_brand",
    "spec": "CAST(p_size AS STRING)",
    "project_name": "CONCAT(p_name, ' ', p_brand)",
    "list_price": f"l_extendedprice * {_SPIKE}",
    "actual_price": f"l_extendedprice * {_SPIKE} * ({_PAID})",
    "discount_rate": _PAID,
    "monthly_sales": "l_quantity",
    "review_count": "l_quantity * (1 + (l_orderkey + l_linenumber) % 4)",
    "rating": "3.6D + (l_orderkey * 7 + l_linenumber * 3) % 15 / 10D",
    "doctor_name": "c_name",
    "doctor_title": "CONCAT('T', c_custkey % 4)",
    "payment_method": "l_returnflag",
    "installment": "IF(l_linestatus = 'F', 1D, 0D)",
    "channel": "r_name",
    "activity_tag": "o_orderstatus",
    "approval_no": f"""CASE {_APPROVAL} WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{UNKNOWN}'
        WHEN 3 THEN 'FDA-1' ELSE CONCAT('国械注准', l_partkey) END""",
    "device_brand": "p_brand",
    "device_model": "CONCAT(p_brand, '-', p_size)",
    "udi_match": """CASE WHEN l_suppkey % 3 = 0 THEN 1D WHEN l_orderkey % 5 = 0 THEN NULL
        WHEN l_orderkey % 5 = 1 THEN 0D ELSE 1D END""",
    "listing_date": "o_orderdate",
    "collection_date": "l_shipdate",
    "new_customer": "IF(c_acctbal < 1000, 1D, 0D)",
    "stats_month": "DATE_FORMAT(l_shipdate, 'yyyy-MM')",
}

# The tables' schemas, stated so that no job has to look them up.
_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
}

LISTING_COLUMNS = [*RAW_COLUMNS, "stats_month"]


def load_sales(
    spark: SparkSession, sf_dir: str, *columns: str, trusted_keys: bool = False, together: str | None = None,
    turn: tuple[int, int] | None = None,
) -> DataFrame:
    """The listing table, or just ``columns`` of it.

    Parts are joined to line items before orders, whose rows are wider, so that a
    shuffle by one key carries little for the other; customers come with the orders
    they belong to.  Names of nations and regions, two tables of fixed size, are
    looked up last.  Which sides are small enough to broadcast is left to Spark,
    which knows their sizes.

    Rows that agree in the column ``together``, one that line items alone tell, are
    brought together while they still are rows of the tables: most columns
    repeat what a few of those hold.

    ``turn``, a number and how many there are, leaves the listings of one share of
    all orders: the shares of all turns are the whole table.
    """
    wanted = list(columns) or LISTING_COLUMNS
    needed = set().union(*(_TABLES.get(c, set()) for c in wanted)) if trusted_keys else _ALL_TABLES

    def table(name: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    def share(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64(key), F.lit(turn[1])) == turn[0]) if turn else rows

    out = share(table("lineitem"), "l_orderkey")
    if "part" in needed:
        part = table("part")
        out = out.join(part, out.l_partkey == part.p_partkey)
    if "orders" in needed:
        orders = share(table("orders"), "o_orderkey")
        if "customer" in needed:
            customer = table("customer")
            orders = orders.join(customer, orders.o_custkey == customer.c_custkey)
        out = out.join(orders, out.l_orderkey == orders.o_orderkey)
    if "supplier" in needed:
        supplier = table("supplier")
        out = out.join(supplier, out.l_suppkey == supplier.s_suppkey)
    if together:
        out = out.withColumn(together, F.expr(_EXPRESSIONS[together])).hint("rebalance", together)
    if "nation" in needed:
        nation = table("nation")
        out = out.join(nation, out.c_nationkey == nation.n_nationkey)
        if "region" in needed:
            region = table("region")
            out = out.join(region, out.n_regionkey == region.r_regionkey)
    if "district" in needed:
        district = table("nation").selectExpr("n_nationkey AS d_nationkey", "n_name AS d_name")
        out = out.join(district, out.s_nationkey == district.d_nationkey)
    return out.selectExpr([c if c == together else f"{_EXPRESSIONS[c]} AS {c}" for c in wanted])


def turns(spark: SparkSession, sf_dir: str, rows: int = ROWS_A_TURN) -> list[tuple[int, int]]:
    """Turns for the listing table, each of about ``rows`` line items."""
    items = spark.read.schema(_SCHEMAS["lineitem"]).parquet(f"{sf_dir}/lineitem.parquet").count()
    many = max(1, -(-items // rows))
    return [(i, many) for i in range(many)]


def rule_segment(df: DataFrame) -> DataFrame:
    """Add ``cluster`` from two thresholds, a stand-in for a fitted model."""
    rule = "CASE WHEN list_price >= 60000 THEN 1 WHEN monthly_sales >= 25 THEN 2 ELSE 0 END"
    return df.withColumn("cluster", F.expr(rule))


def load_segmented(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the listing table plus the rule-based ``cluster``."""
    needed = dict.fromkeys([*columns, "list_price", "monthly_sales"])
    return rule_segment(load_sales(spark, sf_dir, *needed)).select(*columns, "cluster")


def load_dirty(
    spark: SparkSession, sf_dir: str, *columns: str, turn: tuple[int, int] | None = None
) -> DataFrame:
    """Raw text columns of the listing table with dirt worked in.

    Bad and outlying prices, missing counts and districts, broken, impossible
    and slash-separated dates, and one city's rows twice over.
    """
    wanted = list(columns) or RAW_COLUMNS
    basis = dict.fromkeys([*wanted, "city", "list_price", "monthly_sales"])
    marked = load_sales(spark, sf_dir, *basis, turn=turn).withColumn(
        "_id", F.floor(F.col("list_price") * 100 + F.col("monthly_sales")).cast("long")
    )

    def every(n: int) -> Column:
        return F.col("_id") % n == 0

    text = {c: F.col(c).cast("string") for c in wanted}
    dashed = F.date_format("collection_date", "yyyy-MM-dd") if "collection_date" in wanted else None
    dirt = {
        "district": lambda t: F.when(~every(13), t),
        "list_price": lambda t: F.when(every(29), "n/a?")
        .when(every(97), (F.col("list_price") * 50).cast("string"))
        .otherwise(t),
        "monthly_sales": lambda t: F.when(~every(31), t),
        "listing_date": lambda _: F.date_format("listing_date", "yyyy-MM-dd"),
        "collection_date": lambda _: F.when(every(37), "########")
        .when(every(41), "2025-02-30")
        .when(every(2), F.replace(dashed, F.lit("-"), F.lit("/")))
        .otherwise(dashed),
    }
    twice = F.explode(F.when(F.col("city") == "NATION_1", F.array(F.lit(1), F.lit(2)))
                      .otherwise(F.array(F.lit(1))))
    shaped = [dirt[c](text[c]).alias(c) if c in dirt else text[c].alias(c) for c in wanted]
    return marked.withColumn("_copy", twice).select(shaped)
