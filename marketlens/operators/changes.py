"""Snapshot comparison, state upserts and the alerts they raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.plans.skew import latest_per_key, with_previous

MIN_CONTENT_CHARS = 100


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def content_status(chars: Column, new_hash: Column, old_hash: Column, known: Column) -> Column:
    return (
        F.when(chars < MIN_CONTENT_CHARS, "skipped")
        .when(~known, "new")
        .when(new_hash != old_hash, "updated")
        .otherwise("unchanged")
    )


def detect_content_changes(new: DataFrame, current: DataFrame, keys: Sequence[str] = ("competitor_id", "url"),
                           text_chars: int | None = None) -> DataFrame:
    """Every page of a crawl against the stored state: new, updated, unchanged or skipped.

    Old and new text of updated pages are given whole, or their first ``text_chars``
    characters, which keeps the rest of all texts out of the shuffle.

    ``new`` holds competitor_id, url, title, text_content and checked_at, one row
    per page. Texts under 100 characters are skipped, as too short to track.
    """
    text = F.col("text_content")
    # Hash, size and cut are taken before the join.
    fresh = new.select(
        *[c for c in new.columns if c != "text_content"], tx.content_hash(text).alias("new_hash"),
        tx.word_count(text).alias("word_count"), F.length(text).alias("char_count"),
        _cut(text, text_chars).alias("new_text"))
    stored = current.select(
        *keys, F.col("content_hash").alias("old_hash"), F.col("word_count").alias("old_word_count"),
        _cut(F.col("text_content"), text_chars).alias("old_text"), F.lit(True).alias("known"))
    joined = fresh.join(stored, list(keys), "left")
    known = F.coalesce("known", F.lit(False))
    status = content_status(F.col("char_count"), F.col("new_hash"), F.col("old_hash"), known)

    def if_updated(value: Column) -> Column:
        return F.when(F.col("status") == "updated", value)

    return joined.withColumn("status", status).withColumns({
        "old_value": if_updated(F.col("old_text")), "new_value": if_updated(F.col("new_text")),
        "word_count_change": if_updated(F.col("word_count") - F.col("old_word_count")),
    }).drop("known", "old_text", "new_text")


def content_change_log(changes: DataFrame) -> DataFrame:
    """Rows for the append-only change table."""
    return changes.filter("status = 'updated'").select(
        "competitor_id", "url", F.lit("modified").alias("change_type"),
        F.lit("content").alias("field_changed"), "old_value", "new_value", "old_hash", "new_hash",
        "word_count_change", F.col("checked_at").alias("detected_at"))


def apply_content_changes(new: DataFrame, current: DataFrame, keys: Sequence[str] = ("competitor_id", "url"),
                          stored_chars: int | None = None) -> DataFrame:
    """Next stored state: crawled pages refreshed, others kept; first_seen never moves.

    Texts are stored whole, or their first ``stored_chars`` characters.
    """
    text = F.col("text_content")
    seen = new.filter(F.length(text) >= MIN_CONTENT_CHARS).select(
        *keys, F.col("title").alias("n_title"), text.alias("n_text"), F.col("checked_at").alias("n_at"),
        tx.content_hash(text).alias("n_hash"))
    fresh, known = F.col("n_hash").isNotNull(), F.col("content_hash").isNotNull()
    moved = fresh & known & (F.col("n_hash") != F.col("content_hash"))
    # Named apart from every output column: inside a lambda Spark would read a
    # column of the same select list instead of the input column.
    both = current.join(seen, list(keys), "full_outer").withColumns({
        "_known": known, "_fresh": fresh, "_changed": moved, "_rewritten": moved | ~known,
        "_text": F.when(moved | ~known, F.col("n_text")),
    })
    rewritten, body = F.col("_rewritten"), F.col("_text")
    return both.select(
        *keys,
        F.when(~F.col("_known"), F.col("n_title")).otherwise(F.col("title")).alias("title"),
        F.when(~F.col("_known"), tx.content_category(F.col("url"), F.col("n_title")))
        .otherwise(F.col("content_type")).alias("content_type"),
        F.when(rewritten, _cut(F.col("_text"), stored_chars)).otherwise(F.col("text_content"))
        .alias("text_content"),
        F.when(rewritten, F.col("n_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(F.col("_changed"), F.col("content_hash")).alias("previous_hash"),
        F.when(F.col("_fresh"), F.col("_changed")).otherwise(F.col("has_changed")).alias("has_changed"),
        # Readability and keywords are only worked out for texts that moved.
        F.when(rewritten, tx.word_count(body)).otherwise(F.col("word_count")).alias("word_count"),
        F.when(rewritten, tx.readability(body)).otherwise(F.col("readability_score")).alias("readability_score"),
        F.when(rewritten, F.to_json(tx.top_keywords(body))).otherwise(F.col("keywords")).alias("keywords"),
        F.coalesce("first_seen", "n_at").alias("first_seen"),
        F.coalesce("n_at", "last_checked").alias("last_checked"),
    )


def word_deltas(snapshots: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (),
                **skew) -> DataFrame:
    """Word-count change of every snapshot against the one before it."""
    linked = with_previous(snapshots, keys, ts, tie, F.col("word_count"), "old_word_count", **skew)
    return linked.withColumn("word_count_change", F.col("word_count") - F.col("old_word_count"))


def _description_hash(description: Column) -> Column:
    return F.sha2(F.coalesce(description, F.lit("")), 256)


def detect_product_changes(new: DataFrame, current: DataFrame,
                           keys: Sequence[str] = ("competitor_id", "name")) -> DataFrame:
    """Every product card against the catalog: new, updated or unchanged, and who went out of stock."""
    stored = current.select(
        *keys, _description_hash(F.col("description")).alias("old_description_hash"),
        F.col("is_available").alias("was_available"))
    joined = new.withColumn("description_hash", _description_hash(F.col("description"))).join(
        stored, list(keys), "left")
    known = F.col("old_description_hash").isNotNull()
    differs = (F.col("description_hash") != F.col("old_description_hash")) | (
        F.col("is_available") != F.col("was_available"))
    return joined.withColumns({
        "status": F.when(~known, "new").when(differs, "updated").otherwise("unchanged"),
        "went_unavailable": known & F.col("was_available") & ~F.col("is_available"),
    })


def product_change_summary(changes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    status = F.col("status")
    return changes.groupBy(*by).agg(
        F.count_if(status == "new").alias("new"),
        F.count_if(status == "updated").alias("updated"),
        F.count_if(status == "unchanged").alias("unchanged"),
        F.count_if("went_unavailable").alias("unavailable"),
    )


ALERT_COLUMNS = ["competitor_id", "alert_type", "severity", "title", "message", "related_url", "created_at"]


def price_change_alerts(changes: DataFrame) -> DataFrame:
    """System alerts for price moves: high above ten percent, else medium."""
    pct = (F.col("price") - F.col("old_price")) * 100
    steep = F.abs(pct) > F.col("old_price") * 10
    rising = F.col("status") == "increase"
    one_digit = F.bround(F.try_divide(pct, F.col("old_price")), 1).cast("decimal(12,1)")
    sign = F.when(one_digit >= 0, "+").otherwise("")
    return changes.filter(F.col("status").isin("increase", "decrease")).select(
        "competitor_id", F.lit("price_change").alias("alert_type"),
        F.when(steep, "high").otherwise("medium").alias("severity"),
        F.concat(F.lit("Price "), F.when(rising, "Increased").otherwise("Decreased"), F.lit(": "),
                 F.substring("product_name", 1, 50)).alias("title"),
        F.concat(F.lit("Price changed from $"), F.col("old_price").cast("string"), F.lit(" to $"),
                 F.col("price").cast("string"), F.lit(" ("), sign, one_digit.cast("string"),
                 F.lit("%)")).alias("message"),
        F.col("product_url").alias("related_url"), F.col("captured_at").alias("created_at"),
    )


def content_alerts(changes: DataFrame) -> DataFrame:
    updated = F.col("status") == "updated"
    return changes.filter(F.col("status").isin("new", "updated")).select(
        "competitor_id",
        F.when(updated, "content_update").otherwise("new_page").alias("alert_type"),
        F.when(updated, "medium").otherwise("low").alias("severity"),
        F.concat(F.when(updated, "Content Updated: ").otherwise("New Page Discovered: "),
                 F.substring("title", 1, 50)).alias("title"),
        F.when(updated, F.concat(F.lit("The page at "), F.col("url"), F.lit(" has been modified")))
        .otherwise(F.concat(F.lit("A new page has been found at "), F.col("url"))).alias("message"),
        F.col("url").alias("related_url"), F.col("checked_at").alias("created_at"),
    )


def product_alerts(changes: DataFrame) -> DataFrame:
    new = F.col("status") == "new"
    return changes.filter(new | F.col("went_unavailable")).select(
        "competitor_id",
        F.when(new, "new_product").otherwise("availability_change").alias("alert_type"),
        F.when(new, "high").otherwise("medium").alias("severity"),
        F.concat(F.when(new, "New Product: ").otherwise("Product Unavailable: "),
                 F.substring("name", 1, 50)).alias("title"),
        F.when(new, "Competitor launched a new product").otherwise("Product is now out of stock")
        .alias("message"),
        F.col("url").alias("related_url"), F.col("checked_at").alias("created_at"),
    )


def emit_alerts(price: DataFrame, content: DataFrame, product: DataFrame) -> DataFrame:
    """One alert table out of the three kinds of changes."""
    return (
        price_change_alerts(price)
        .unionByName(content_alerts(content))
        .unionByName(product_alerts(product))
    )


def acknowledge(alerts: DataFrame, acks: DataFrame, read_all_at: Column | None = None) -> DataFrame:
    """Alert state after a batch of acknowledgements (alert_id, action, at).

    ``action`` is ``read`` or ``dismiss``. ``read_all_at`` also marks every unread alert.
    """
    per_alert = acks.groupBy(F.col("alert_id").alias("id")).agg(
        F.max(F.col("action") == "read").alias("_read"),
        F.max(F.col("action") == "dismiss").alias("_dismiss"),
        F.min(F.when(F.col("action") == "read", F.col("at"))).alias("_at"))
    joined = alerts.join(per_alert, "id", "left")
    read_now = F.coalesce("_read", F.lit(False)) | F.lit(read_all_at is not None)
    at = F.col("_at") if read_all_at is None else F.coalesce("_at", read_all_at)
    stamped = F.when(read_now & ~F.col("is_read"), at)
    if "read_at" in alerts.columns:
        stamped = F.coalesce(stamped, F.col("read_at"))
    return joined.withColumns({
        "read_at": stamped,
        "is_read": F.col("is_read") | read_now,
        "is_dismissed": F.col("is_dismissed") | F.coalesce("_dismiss", F.lit(False)),
    }).drop("_read", "_dismiss", "_at")


def upsert_competitors(current: DataFrame, incoming: DataFrame, patch: Sequence[str],
                       ts: str | None = None) -> DataFrame:
    """Next competitor table keyed by url.

    Unseen urls are inserted as active; for known ones every non-null ``patch``
    column of ``incoming`` wins; ``is_deleted`` switches a row to inactive. With
    ``ts`` the newest incoming row of each url counts.
    """
    if ts is not None:
        incoming = latest_per_key(incoming, ["url"], ts)
    fresh = incoming.select(
        "url", F.col("id").alias("_new_id"), F.coalesce("is_deleted", F.lit(False)).alias("_deleted"),
        *[F.col(c).alias(f"_p_{c}") for c in patch], F.lit(True).alias("_incoming"))
    both = current.withColumn("_known", F.lit(True)).join(fresh, "url", "full_outer")
    return both.select(
        F.coalesce("id", "_new_id").alias("id"), "url",
        *[F.coalesce(f"_p_{c}", c).alias(c) for c in patch],
        (F.coalesce("is_active", F.lit(True)) & ~F.coalesce("_deleted", F.lit(False))).alias("is_active"),
        F.when(F.col("_known").isNull(), "inserted").when(F.col("_incoming").isNull(), "kept")
        .otherwise("patched").alias("outcome"),
    )
