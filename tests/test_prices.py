from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketlens.functions import prices as px


@pytest.mark.parametrize("raw,price", [
    ("1,234.56", "1234.56"), ("1.234,56", "1234.56"), ("99,99", "99.99"), ("1,234", "1234.00"), ("€ 5", "5.00"),
    ("1,234,56", "0.00"), ("n/a", "0.00"), ("1 234", "1234.00"), ("", "0.00"), ("7.5", "7.50")])
def test_normalize(value, raw, price):
    assert value(px.normalize_price(F.col("r")), r=raw) == Decimal(price)


@pytest.mark.parametrize("text,first,every", [
    ("$99.99", ["99.99"], ["99.99", "99.00"]), ("now £ 20", ["20.00"], ["20.00"]),
    ("1.299,00 EUR", ["1299.00"], ["1299.00"]), ("$5/mo", ["5.00"], ["5.00", "5.00"]),
    ("Starting at $12", ["12.00"], ["12.00", "12.00"]), ("no price", [], []), ("$0", [], []),
    ("$10.00 or $20.00", ["10.00", "20.00"], ["10.00", "20.00", "10.00", "20.00"])])
def test_extract(value, text, first, every):
    assert value(px.extract_price_values(F.col("t")), t=text) == [Decimal(p) for p in first]
    assert value(px.extract_price_values(F.col("t"), "all"), t=text) == [Decimal(p) for p in every]


@pytest.mark.parametrize("text,code", [("€5", "EUR"), ("5 GBP", "GBP"), ("5", "USD"), ("₹5 $", "USD")])
def test_currency(value, text, code):
    assert value(px.detect_currency(F.col("t")), t=text) == code


@pytest.mark.parametrize("text,pct", [("Save 15% today", 15), ("20% OFF", 20), ("5 % savings", 5), ("none", None)])
def test_discount(value, text, pct):
    assert value(px.detect_discount(F.col("t")), t=text) == pct


def test_sale(value):
    def saved(price, original):
        return value(px.sale_from_original(F.col("p").cast("decimal(12,2)"), F.col("o").cast("decimal(12,2)")),
                     p=price, o=original)

    assert saved("80", "100") == 19  # floating point, as in the results to match
    assert saved("75", "100") == 25
    assert saved("100", "80") is None
