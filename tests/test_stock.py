import random

import pytest

from brisktill.operators.stock import after_sales, apply_stock, restocked


def brute_force(lines, stock):
    left, accepted = dict(stock), {}
    for line, product, quantity in sorted(lines):
        if product is None:
            continue
        fits = product in left and left[product] >= quantity
        if fits:
            left[product] -= quantity
        accepted[line] = fits
    return accepted, left


@pytest.mark.parametrize("seed, bits, task_rows", [(1, 16, 1 << 20), (2, 2, 0), (3, 4, 20), (4, 3, 50), (5, 0, 10)])
def test_apply_stock_equals_walking_the_lines(spark, seed, bits, task_rows):
    random.seed(seed)
    # Product 1 is hot; 9 is unknown; some lines have no product; ids have gaps.
    lines = [
        (n * 3 + 1, random.choice([1, 1, 1, 2, 3, 4, 5, 9, None]), random.choice([0, 1, 2, 3, 5, 8, 20, 60]))
        for n in range(700)
    ]
    stock = {1: 400, 2: 5, 3: 0, 4: 100000, 5: -3, 6: 12}
    sold = apply_stock(
        spark.createDataFrame(lines, "line_id long, product_id long, quantity int"),
        spark.createDataFrame(list(stock.items()), "id long, stock int"),
        bits,
        task_rows,
    )
    accepted, left = brute_force(lines, stock)
    assert {r["line_id"]: r["accepted"] for r in sold.lines.collect()} == accepted
    products = spark.createDataFrame(list(stock.items()), "id long, stock int")
    assert {r["id"]: r["stock"] for r in after_sales(products, sold.used).collect()} == left


def test_a_later_smaller_line_may_still_fit(spark):
    lines = spark.createDataFrame([(1, 1, 4), (2, 1, 9), (3, 1, 5), (4, 1, 2), (5, 1, 1)], "line_id long, product_id long, quantity int")
    sold = apply_stock(lines, spark.createDataFrame([(1, 7)], "id long, stock int"))
    assert [r["accepted"] for r in sold.lines.orderBy("line_id").collect()] == [True, False, False, True, True]


def test_walk_keeps_the_stock_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        lines = [(n, n % 3, 1 + n % 4) for n in range(90)]
        stock = {0: 11, 1: 13, 2: 7}
        sold = apply_stock(
            spark.createDataFrame(lines, "line_id long, product_id long, quantity int"),
            spark.createDataFrame(list(stock.items()), "id long, stock int"),
        )
        assert {r["line_id"]: r["accepted"] for r in sold.lines.collect()} == brute_force(lines, stock)[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_restocked_adds_returned_quantities(spark):
    products = spark.createDataFrame([(1, 5), (2, 0)], "id long, stock int")
    back = spark.createDataFrame([(1, 2), (1, 3), (None, 9)], "product_id long, quantity int")
    assert {r["id"]: r["stock"] for r in restocked(products, back).collect()} == {1: 10, 2: 0}
