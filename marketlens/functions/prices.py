"""Columns that read prices, currencies and discounts out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.arrays import let

# Price wordings, in the order they are tried (all ignore case).
PRICE_PATTERNS = [
    r"[\$€£¥₹]\s*(\d{1,3}(?:[,.\s]?\d{3})*(?:[.,]\d{2}))",
    r"[\$€£¥₹]\s*(\d{1,6})",
    r"(\d{1,3}(?:[,.\s]?\d{3})*(?:[.,]\d{2})?)\s*(?:USD|EUR|GBP|JPY|INR)",
    r"[\$€£]\s*(\d+(?:[.,]\d{2})?)\s*(?:/mo|/month|/mon|per\s*month)",
    r"[\$€£]\s*(\d+(?:[.,]\d{2})?)\s*(?:/yr|/year|per\s*year|annually)",
    r"(?:starting|from|starts)\s*(?:at|@)?\s*[\$€£]\s*(\d+(?:[.,]\d{2})?)",
    r"(?:price|cost|fee)[:=]?\s*[\$€£]\s*(\d+(?:[.,]\d{2})?)",
    r"[\$€£]\s*(\d+(?:[.,]\d{2})?)\s*(?:per\s*(?:user|seat|license|month|year))",
]
# Discount wordings.
DISCOUNT_PATTERNS = [
    r"(\d+)\s*%\s*off",
    r"save\s*(\d+)\s*%",
    r"(\d+)\s*%\s*discount",
    r"(\d+)\s*%\s*savings",
]
# Currency signs and codes, in the order they are looked for.
CURRENCIES = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"),
              ("USD", "USD"), ("EUR", "EUR"), ("GBP", "GBP")]


def _number(bare: Column) -> Column:
    backwards = F.reverse(bare)
    comma, point = F.instr(backwards, ","), F.instr(backwards, ".")
    return (
        F.when((comma > 0) & (point > 0) & (comma < point),
               F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when((comma == 3) & (point == 0), F.replace(bare, F.lit(","), F.lit(".")))
        .otherwise(F.replace(bare, F.lit(","), F.lit("")))
    )


def normalize_price(raw: Column) -> Column:
    """Price text to decimal(12,2); the later of comma and point is the decimal sign."""
    number = let(F.regexp_replace(raw, r"[\$€£¥₹\s]", ""), _number)
    return F.coalesce(number.try_cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))


def first_price_text(text: Column) -> Column:
    """Hits of the first wording that matches."""
    return F.coalesce(*[
        let(F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)), lambda h: F.when(F.size(h) > 0, h))
        for p in PRICE_PATTERNS])


def extract_price_values(text: Column, mode: str = "first") -> Column:
    """Positive prices in a text.

    ``mode="first"`` reads with the first wording that matches; ``mode="all"``
    keeps the hits of every wording, so one price may appear several times.
    """
    if mode == "all":
        found = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(1)) for p in PRICE_PATTERNS])
    elif mode == "first":
        found = F.coalesce(first_price_text(text), F.expr("cast(array() as array<string>)"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return F.filter(F.transform(found, normalize_price), lambda p: p > 0)


def detect_currency(text: Column) -> Column:
    chain = F
    for sign, code in CURRENCIES:
        chain = chain.when(text.contains(sign), code)
    return chain.otherwise("USD")


def detect_discount(text: Column) -> Column:
    """Percent named by the first discount wording found, else null."""
    return F.coalesce(*[
        F.nullif(F.regexp_extract(text, f"(?i){p}", 1), F.lit("")) for p in DISCOUNT_PATTERNS
    ]).try_cast("int")


def sale_from_original(price: Column, original: Column) -> Column:
    """Whole percent saved against a higher original price, else null."""
    saved = (F.lit(1.0) - price.cast("double") / original.cast("double")) * 100
    return F.when(original > price, saved.cast("int"))


def percent_change(old: Column, new: Column) -> Column:
    """Exact percent change of two decimal(12,2) prices."""
    return F.try_divide(new - old, old) * 100
