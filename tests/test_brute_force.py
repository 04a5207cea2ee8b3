"""Random batches with repeated, missing and changing keys against row-by-row models."""

from __future__ import annotations

import random
from collections import Counter
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal as D

import pytest
from pyspark.sql import types as T

from oreline.operators import dimensions, facts, marts
from oreline.schemas import DIM_CUSTOMERS, FACT_SALES, RAW

KEYS = [None, *range(1, 40)]
ARRIVING = T.StructType(RAW["customers"].fields + [T.StructField("seq", T.LongType())])


def customer_batch(rng, size):
    return [
        (rng.choice(KEYS), f"n{rng.randrange(9)}", rng.choice(["Rome", "Oslo", None]), rng.choice("ab"), None, seq)
        for seq in range(size)
    ]


def model_apply(dim, batch, today):
    """Dimension rows are (key, name, city, segment, from, to, current)."""

    def state(row):
        return "|".join(v for v in (row[2], row[3]) if v is not None)

    newest, opened = {}, []
    for row in batch:
        if row[0] is None:
            opened.append(row)
        elif row[0] not in newest or row[5] > newest[row[0]][5]:
            newest[row[0]] = row
    for key, row in newest.items():
        if not any(d[0] == key and d[6] and state(d) == state(row) for d in dim):
            opened.append(row)
    changed = {row[0] for row in opened} - {None}
    closed = [(*d[:5], today, False) if d[6] and d[0] in changed else d for d in dim]
    end = date(9999, 12, 31)
    return closed + [(r[0], r[1], r[2], r[3], today, end, True) for r in opened]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scd2_sequence(spark, seed):
    rng = random.Random(seed)
    model = []
    dim = spark.createDataFrame([], DIM_CUSTOMERS)
    for month in (1, 2, 3):
        batch = customer_batch(rng, 60)
        today = date(2026, month, 1)
        model = model_apply(model, batch, today)
        incoming = spark.createDataFrame(batch, ARRIVING)
        dim = dimensions.scd2_apply(dim, incoming, effective_date=today, order_by=["seq"])
        rows = dim.collect()
        got = Counter((r.customer_id, r.name, r.city, r.segment, r.valid_from, r.valid_to, r.is_current) for r in rows)
        assert got == Counter(model)
        dim = spark.createDataFrame(rows, DIM_CUSTOMERS)


def cents(value):
    return value.quantize(D("0.01"), ROUND_HALF_UP)


def discounted(quantity, price, discount):
    """Floating point from the discount on; rounded in the shortest decimal form."""
    return cents(D(repr(float(quantity * price) * (1 - discount))))


@pytest.mark.parametrize("seed", [4, 5])
def test_sales_and_marts(spark, seed):
    rng = random.Random(seed)
    orders = [
        (
            rng.choice([None, *range(30)]),
            rng.choice([None, 1, 2, 3]),
            datetime(2026, 1, rng.randrange(1, 4), rng.randrange(24)),
            rng.choice(["web", "pos", None]),
            rng.choice(["completed", "completed", "cancelled", None]),
        )
        for _ in range(60)
    ]
    items = [
        (
            f"i{n}",
            rng.choice([None, *range(35)]),
            rng.choice([None, 1, 2, 3, 9]),
            rng.randrange(0, 4),
            D(rng.randrange(0, 50000)) / 100,
            rng.choice([0.0, 0.1, 0.15, 0.25]),
        )
        for n in range(200)
    ]
    products = [
        (p, "s", "n", cat, "c", D("1.00"), D(cost), date(2026, 1, 1))
        for p, cat, cost in [(1, "x", "0.25"), (2, "y", "3.10"), (3, None, "2.00")]
    ]
    stored = {rng.randrange(30) for _ in range(8)}
    fact_rows = [
        (o, datetime(2026, 1, 1), "web", 1, 1, 1, D("1.00"), 0.0, D("1.00"), D("1.00")) for o in stored for _ in "12"
    ]

    expected = [
        (o[0], o[2], o[3], o[1], i[2], i[3], i[4], i[5], discounted(i[3], i[4], i[5]), cents(i[3] * p[6]))
        for o in orders
        for i in items
        for p in products
        if o[4] == "completed" and o[0] is not None and o[0] == i[1] and i[2] == p[0] and o[0] not in stored
    ]
    frames = (
        spark.createDataFrame(fact_rows, FACT_SALES),
        spark.createDataFrame(orders, RAW["orders"]),
        spark.createDataFrame(items, RAW["order_items"]),
        spark.createDataFrame(products, RAW["products"]),
    )
    added = facts.new_sales(*frames)
    assert Counter(map(tuple, added.collect())) == Counter(expected)

    groups = {}
    category = {p[0]: p[3] for p in products}
    for row in expected:
        groups.setdefault((row[1].date(), row[2], category[row[4]]), []).append(row)
    mart = {}
    for grain, rows in groups.items():
        gross, cost = sum(r[8] for r in rows), sum(r[9] for r in rows)
        ratio = ((gross - cost) / gross).quantize(D("0.0001"), ROUND_HALF_UP) if gross else None
        mart[grain] = (
            len({r[0] for r in rows}), sum(r[5] for r in rows), gross, gross, cost, gross - cost,
            float(ratio) if ratio is not None else None,
        )
    got = {tuple(r)[:3]: tuple(r)[3:] for r in marts.daily_sales(added, frames[3]).collect()}
    assert got == mart
