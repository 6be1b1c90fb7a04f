"""Columns over a flattened page: ``nodes`` and ``texts`` arrays in document order.

A node covers every position from its ``id`` to ``last``. What it holds stands
together in both arrays: texts ``text_from`` to ``text_to`` and nodes up to
``node_to`` (both ends outside), so what is under a node is a slice. ``zones``
lists the enclosing structural tags (nav, footer, script and so on).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 " + "".join(
    chr(c) for c in range(0x2000, 0x200B)) + "    　"
RAW_TEXT = ("script", "style")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def covers(node: Column, pos: Column) -> Column:
    return (pos > node["id"]) & (pos <= node["last"])


def in_zone(item: Column, *zones: str) -> Column:
    return F.arrays_overlap(item["zones"], F.array(*[F.lit(z) for z in zones]))


def has_token(value: Column, token: str) -> Column:
    """Whether a space-separated attribute holds the token."""
    return F.coalesce(F.array_contains(F.split(value, r"\s+"), token), F.lit(False))


def joined(texts: Column, separator: str) -> Column:
    """Stripped, non-empty strings joined."""
    return F.array_join(F.filter(F.transform(texts, lambda t: strip(t["text"])), lambda s: s != ""), separator)


def texts_under(texts: Column, node: Column) -> Column:
    """The texts of a node, none of a missing node; the cost is that of what is found."""
    return F.slice(texts, F.coalesce(node["text_from"], F.lit(0)) + 1,
                   F.coalesce(node["text_to"] - node["text_from"], F.lit(0)))


def text_of(texts: Column, node: Column, separator: str = "") -> Column:
    """Stripped text under a node; script and style bodies are not text."""
    return joined(F.filter(texts_under(texts, node), lambda t: ~in_zone(t, *RAW_TEXT)), separator)


def raw_text_of(texts: Column, node: Column) -> Column:
    """Unstripped strings under a node, script bodies included when asked for on the script itself."""
    return F.array_join(F.transform(texts_under(texts, node), lambda t: t["text"]), "")


def below(nodes: Column, node: Column) -> Column:
    """All nodes below ``node``, none for a missing node."""
    return F.slice(nodes, F.coalesce(node["index"], F.lit(0)) + 2,
                   F.coalesce(node["node_to"] - node["index"] - 1, F.lit(0)))


def under(nodes: Column, node: Column, condition) -> Column:
    """Nodes below ``node`` that meet the condition, in document order."""
    return F.filter(below(nodes, node), condition)


def first_under(nodes: Column, node: Column, *conditions) -> Column:
    """First node below meeting the first condition, else the next condition, and so on."""
    return F.coalesce(*[first(under(nodes, node, c)) for c in conditions])


def class_like(pattern: str):
    """Condition: the class attribute contains the pattern, in any case."""
    return lambda n: F.coalesce(attr(n, "class").rlike(f"(?i)(?:{pattern})"), F.lit(False))


def tag_in(*tags: str):
    return lambda n: n["tag"].isin(*tags)
