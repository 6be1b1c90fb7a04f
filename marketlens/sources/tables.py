"""Readers for the entity tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.arrays import unnest

# Column types of each entity table. Files are read with these, never inferred.
SCHEMAS: dict[str, str] = {
    "competitors": (
        "id string, name string, url string, domain string, competitor_type string, industry string, "
        "health_score int, seo_score int, content_score int, is_monitoring boolean, is_active boolean, "
        "technology_stack string, estimated_traffic int, domain_authority int, "
        "last_scanned timestamp, created_at timestamp, updated_at timestamp"),
    "scans": (
        "id string, competitor_id string, status string, progress int, pages_discovered int, "
        "pages_crawled int, current_url string, error_message string, started_at timestamp, "
        "completed_at timestamp, created_at timestamp"),
    "scan_pages": (
        "id string, scan_id string, url string, title string, status_code int, content_type string, "
        "content_hash string, word_count int, load_time_ms int, html_content string, crawled_at timestamp"),
    "contents": (
        "id string, competitor_id string, url string, title string, content_type string, "
        "text_content string, content_hash string, previous_hash string, has_changed boolean, "
        "word_count int, reading_time_minutes int, readability_score double, keywords string, "
        "first_seen timestamp, last_checked timestamp, last_updated timestamp"),
    "content_changes": (
        "id string, content_id string, change_type string, field_changed string, old_value string, "
        "new_value string, old_hash string, new_hash string, word_count_change int, detected_at timestamp"),
    "price_history": (
        "id string, competitor_id string, product_name string, product_url string, price decimal(12,2), "
        "currency string, original_price decimal(12,2), discount_percent int, promotion_text string, "
        "is_on_sale boolean, captured_at timestamp"),
    "price_alerts": (
        "id string, competitor_id string, product_name string, old_price decimal(12,2), "
        "new_price decimal(12,2), change_type string, change_percentage decimal(10,2), url string, "
        "is_read boolean, created_at timestamp"),
    "products": (
        "id string, competitor_id string, name string, url string, description string, "
        "short_description string, description_hash string, category string, current_price decimal(12,2), "
        "currency string, image_url string, is_available boolean, is_new boolean, "
        "first_seen timestamp, last_checked timestamp, last_updated timestamp"),
    "product_features": (
        "id string, product_id string, feature_name string, feature_value string, "
        "feature_category string, created_at timestamp"),
    "alerts": (
        "id string, competitor_id string, alert_type string, severity string, title string, "
        "message string, related_url string, related_entity_id string, related_entity_type string, "
        "is_read boolean, is_dismissed boolean, read_at timestamp, created_at timestamp"),
    "seo_analyses": (
        "id string, competitor_id string, url string, overall_score int, title string, title_length int, "
        "title_score int, meta_description string, meta_description_length int, "
        "meta_description_score int, h1_count int, h2_count int, h3_count int, headers_score int, "
        "word_count int, content_score int, has_canonical boolean, has_robots boolean, "
        "has_sitemap boolean, has_ssl boolean, has_schema boolean, mobile_friendly boolean, "
        "technical_score int, internal_links int, external_links int, broken_links int, links_score int, "
        "images_count int, images_with_alt int, images_score int, page_speed_score int, "
        "load_time_ms int, page_size_bytes int, keyword_density string, recommendations string, "
        "analyzed_at timestamp"),
}


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files with a stated schema: no inference pass, and unknown columns are never read."""
    return spark.read.schema(schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A plain file scan, dealt out over the cores where it has fewer splits than cores.

    Few or unsplittable files would leave heavy per-row work (HTML, text) to few
    tasks. A scan with enough splits is returned as it is, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 500_000) -> DataFrame:
    """``df`` of at most ``rows`` rows dealt out by ``keys``, about ``most`` rows to a partition or fewer.

    Adaptive execution joins partitions by their bytes, and some tens of MB hold
    millions of narrow rows. What a task keeps of them for a sort or a fold would
    grow with the table; of a stated number of partitions none are joined.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)), *keys)


def read_table(spark: SparkSession, name: str, directory: str) -> DataFrame:
    """One entity table from parquet, with its fixed schema."""
    return read_parquet(spark, f"{directory.rstrip('/')}/{name}", SCHEMAS[name])


def read_jdbc_table(spark: SparkSession, name: str, url: str, *, partition_column: str,
                    lower: str, upper: str, partitions: int, **options: str) -> DataFrame:
    """One entity table from a relational database, read by many tasks.

    ``partition_column`` must be numeric or a timestamp; ``lower`` and ``upper``
    only set the strides, rows outside them are still read.
    """
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=name, customSchema=SCHEMAS[name], partitionColumn=partition_column,
                 lowerBound=lower, upperBound=upper, numPartitions=str(partitions), **options)
        .load()
    )


def read_keywords_json(df: DataFrame, col: str, out: str = "keyword", n: int | None = None) -> DataFrame:
    """One row per keyword held in a JSON list or object column, in stored order.

    Objects give their keys. Malformed values give no rows. ``n`` keeps the first
    ``n`` keywords of each value.
    """
    parsed = df.withColumn("_keywords", F.coalesce(
        F.from_json(F.when(F.col(col).rlike(r"^\s*\["), F.col(col)), "array<string>"),
        F.json_object_keys(F.when(F.col(col).rlike(r"^\s*\{"), F.col(col))),
    ))
    listed = F.col("_keywords") if n is None else F.slice("_keywords", 1, n)
    kept = [c for c in df.columns]
    return unnest(parsed, kept, listed, out, "keyword_pos")
