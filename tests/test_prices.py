"""Prices in the spellings of several countries."""

import pytest
from pyspark.sql import functions as F

from mercato.functions.price import parse_price

CASES = [
    ("$1,299.50", "MXN", 1299.5), ("1.299,50", "MXN", 1299.5), ("R$ 1.299,5", "BRL", 1299.5), ("1,299.50", "BRL", 1299.5), ("$ 1.299.000", "COP", 1299000.0), ("1.299.000,00", "CLP", 1299000.0), ("１２９９，５", "ARS", 1299.5),
    ("12,5", "PEN", 12.5), ("1,299", "PEN", 1299.0), ("1.299", "BRL", 1299.0), ("S/ 99.", "PEN", 99.0), ("none", "MXN", None), (None, "MXN", None), ("", "COP", None), ("1,299,000.99", "CLP", 1299000.99),
]


@pytest.mark.parametrize("raw, currency, price", CASES)
def test_parse(spark, raw, currency, price):
    df = spark.createDataFrame([(raw, currency)], "raw string, currency string")
    assert df.select(parse_price(F.col("raw"), F.col("currency"))).first()[0] == price
