"""Declared column contracts of the raw, silver and gold tables.

Schemas are stated once and applied on read (raw files) and on write (derived
tables); nothing is ever inferred from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_DATE, _TIME = T.DateType(), T.TimestampType()
_LINE_MONEY, _TOTAL_MONEY = T.DecimalType(14, 2), T.DecimalType(18, 2)

# Raw file columns and types.
RAW = {
    "customers": _fields(
        customer_id=_LONG, name=_TEXT, city=_TEXT, segment=_TEXT, signup_date=_DATE
    ),
    "products": _fields(
        product_id=_LONG,
        sku=_TEXT,
        name=_TEXT,
        category=_TEXT,
        subcategory=_TEXT,
        unit_price=_LINE_MONEY,
        cost=_LINE_MONEY,
        launch_date=_DATE,
    ),
    "orders": _fields(
        order_id=_LONG, customer_id=_LONG, order_date=_TIME, channel=_TEXT, status=_TEXT
    ),
    "order_items": _fields(
        order_item_id=_TEXT,
        order_id=_LONG,
        product_id=_LONG,
        quantity=_INT,
        unit_price_at_sale=_LINE_MONEY,
        discount_pct=T.DoubleType(),
    ),
}

# Silver table columns and types.
DIM_CUSTOMERS = T.StructType(
    RAW["customers"].fields
    + _fields(valid_from=_DATE, valid_to=_DATE, is_current=T.BooleanType(), hash_value=_TEXT).fields
)
DIM_PRODUCTS = RAW["products"]
FACT_SALES = _fields(
    order_id=_LONG,
    order_date=_TIME,
    channel=_TEXT,
    customer_id=_LONG,
    product_id=_LONG,
    quantity=_INT,
    unit_price_at_sale=_LINE_MONEY,
    discount_pct=T.DoubleType(),
    gross_amount=_LINE_MONEY,
    cost_amount=_LINE_MONEY,
)

# Gold table columns and types.
DAILY_SALES = _fields(
    sale_date=_DATE,
    channel=_TEXT,
    category=_TEXT,
    orders=_LONG,
    units=_LONG,
    gross_amount=_TOTAL_MONEY,
    net_amount=_TOTAL_MONEY,
    cost_amount=_TOTAL_MONEY,
    margin_amount=_TOTAL_MONEY,
    margin_pct=T.DoubleType(),
)
CUSTOMER_SEGMENTS = _fields(
    segment=_TEXT, customers=_LONG, total_gross=_TOTAL_MONEY, avg_order_value=_TOTAL_MONEY
)

TABLES = {
    "bronze.customers": RAW["customers"],
    "bronze.products": RAW["products"],
    "bronze.orders": RAW["orders"],
    "bronze.order_items": RAW["order_items"],
    "silver.dim_customers": DIM_CUSTOMERS,
    "silver.dim_products": DIM_PRODUCTS,
    "silver.fact_sales": FACT_SALES,
    "gold.daily_sales": DAILY_SALES,
    "gold.customer_segments": CUSTOMER_SEGMENTS,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: its columns, in its order, cast to its types.

    A column already of the right type is passed through untouched, so the
    projection costs nothing where no conversion is due.  With ANSI mode on (the
    default) a value that does not fit fails the job, as a typed insert would.
    """
    have = {field.name: field.dataType for field in df.schema.fields}
    return df.selectExpr(
        *[
            f"`{f.name}`"
            if have[f.name] == f.dataType
            else f"CAST(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in schema.fields
        ]
    )
