"""Analytical views over the star-schema tables.

Each view joins only the tables its columns need. The joins are left joins on unique keys, so the
number of ``lineitem`` rows never changes and an unmatched key becomes a missing category.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variscope.functions.calendar import fiscal_month_number, fiscal_year_label

MONEY = "decimal(18,4)"

DIMENSIONS = [
    "region",
    "nation",
    "segment",
    "brand",
    "ptype",
    "returnflag",
    "linestatus",
    "priority",
    "orderstatus",
    "supplier",
]
MEASURES = ["actual", "target", "quantity"]

_SOURCE = {
    "region": "region",
    "nation": "nation",
    "segment": "customer",
    "brand": "part",
    "ptype": "part",
    "priority": "orders",
    "orderstatus": "orders",
    "order_date": "orders",
    "supplier": "supplier",
}
_NEEDS = {
    "orders": ["orders"],
    "customer": ["orders", "customer"],
    "nation": ["orders", "customer", "nation"],
    "region": ["orders", "customer", "nation", "region"],
    "part": ["part"],
    "supplier": ["supplier"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _expressions() -> dict[str, Column]:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    return {
        "order_key": F.col("l_orderkey"),
        "period_date": F.col("l_shipdate").cast("date"),
        "order_date": F.col("o_orderdate").cast("date"),
        "actual": (price * (F.lit(1).cast("decimal(4,2)") - discount)).cast(MONEY),
        "target": (price * F.lit("0.95").cast("decimal(4,2)")).cast(MONEY),
        "extended_price": price.cast(MONEY),
        "quantity": F.col("l_quantity").cast(MONEY),
        "discount": F.col("l_discount"),
        "region": F.col("r_name"),
        "nation": F.col("n_name"),
        "segment": F.col("c_mktsegment"),
        "brand": F.col("p_brand"),
        "ptype": F.col("p_type"),
        "returnflag": F.col("l_returnflag"),
        "linestatus": F.col("l_linestatus"),
        "priority": F.col("o_orderpriority"),
        "orderstatus": F.col("o_orderstatus"),
        "supplier": F.col("s_name"),
    }


def fact(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per order line with the business dimensions, net price (``actual``) and plan
    (``target``, the list price less 5 %)."""
    chosen = list(columns) if columns is not None else ["period_date", *MEASURES, *DIMENSIONS]
    needed = {t for c in chosen if c in _SOURCE for t in _NEEDS[_SOURCE[c]]}

    def joined(rows: DataFrame, joins: Iterable[tuple[str, str, str]]) -> DataFrame:
        for name, left, right in joins:
            if name in needed:
                other = headers if name == "orders" else table(spark, sf_dir, name)
                rows = rows.join(other, rows[left] == other[right], "left")
        return rows

    # What hangs on an order is joined to the orders, of which there are fewer than lines, and the orders come last:
    # lines move once for the parts, while they are narrow, and once for the orders.
    headers = table(spark, sf_dir, "orders")
    headers = joined(
        headers, [("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")]
    )
    out = joined(
        table(spark, sf_dir, "lineitem"),
        [("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"), ("orders", "l_orderkey", "o_orderkey")],
    )
    expressions = _expressions()
    return out.select(*[expressions[c].alias(c) for c in chosen])


FACT_MISSING_COLUMNS = ["period_date", "actual", "target", "quantity", *DIMENSIONS]


def fact_with_gaps(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """``fact`` as a source system would leave it: an unspecified priority is null, the region of a
    returned pending order is blank, and an undiscounted line carries no net price."""
    chosen = list(columns) if columns is not None else FACT_MISSING_COLUMNS
    also = {"region": ["returnflag", "orderstatus"], "actual": ["discount"]}
    base = fact(spark, sf_dir, dict.fromkeys([*chosen, *(x for c in chosen for x in also.get(c, []))]))
    unspecified = F.col("priority") == "4-NOT SPECIFIED"
    gaps = {
        "priority": F.when(~unspecified, F.col("priority")),
        "region": F.when((F.col("returnflag") == "R") & (F.col("orderstatus") == "P"), " ").otherwise(
            F.col("region")
        ),
        "actual": F.when(F.col("discount") != 0, F.col("actual")),
    }
    return base.select(*[gaps[c].alias(c) if c in gaps else F.col(c) for c in chosen])


PAYMENT_DIMENSIONS = {
    "department": "region",
    "vendor": "supplier",
    "activity": "nation",
    "fund_group": "segment",
    "fund_type": "orderstatus",
    "fund": "ptype",
    "account": "brand",
    "expenditure_type": "returnflag",
    "authority": "priority",
    "settlement": "linestatus",
}
PAYMENT_FISCAL_START = 7


def payments(spark: SparkSession, sf_dir: str, dimensions: Iterable[str] | None = None) -> DataFrame:
    """The payments shape: amount, date, fiscal year and month (from July) and ten dimensions."""
    names = list(PAYMENT_DIMENSIONS) if dimensions is None else list(dimensions)
    base = fact(spark, sf_dir, ["period_date", "actual", *[PAYMENT_DIMENSIONS[d] for d in names]])
    return base.select(
        F.col("actual").alias("dollar_amount"),
        F.col("period_date").alias("transaction_date"),
        fiscal_year_label(F.col("period_date"), PAYMENT_FISCAL_START).alias("fiscal_year"),
        fiscal_month_number(F.col("period_date"), PAYMENT_FISCAL_START).alias("fiscal_month_number"),
        *[F.col(PAYMENT_DIMENSIONS[d]).alias(d) for d in names],
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("date").alias("event_day"), "event_type", "value")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the article shape: the first line is the title, own-language text is direct
    coverage and the rest is market coverage."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("row_idx"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit("http://"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source"),
        F.date_add(F.make_date(F.lit(1998), F.lit(1), F.lit(1)), F.col("doc_id").cast("int")).alias(
            "published_at"
        ),
        F.col("text").alias("snippet"),
        F.when(F.col("lang") == "en", "active").otherwise("passive").alias("angle"),
    )
