"""Page scoring: analyses, keyword reports, profiles and advice over page facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scores as sc
from marketlens.functions import text as tx
from marketlens.functions.arrays import count_tokens, let, ngrams
from marketlens.operators import html as h


def _advice(*rows: tuple[Column, Column | str]) -> Column:
    """Texts whose condition holds, in order."""
    return F.array_compact(F.array(*[
        F.when(condition, F.lit(text) if isinstance(text, str) else text) for condition, text in rows]))


# --- keywords ------------------------------------------------------------------------------


def _report_tokens(text: Column) -> Column:
    return tx.without(tx.ascii_words(text), tx.REPORT_STOP_WORDS)


def _phrases(tokens: Column, n: int) -> Column:
    return F.transform(tx.top(ngrams(tokens, n), 5), lambda r: F.struct(
        r["token"].alias("phrase"), (-r["neg_n"]).alias("count")))


def keyword_report(facts: DataFrame) -> DataFrame:
    """Adds ``keyword_report``: totals, the top 20 words with density and prominence, top phrases.

    Works inside each page's row. Zones weigh 40 (title), 30 (h1), 15 (h2) and 15
    (meta description).
    """
    zones = [(F.col("title"), 40), (h.heading_text(F.col("headings"), "h1"), 30),
             (h.heading_text(F.col("headings"), "h2"), 15), (h.meta_description(F.col("meta")), 15)]
    tokens = facts.withColumns({
        "_tokens": _report_tokens(F.col("body_text")),
        **{f"_zone{i}": _report_tokens(text) for i, (text, _) in enumerate(zones)}})

    def prominence(word: Column) -> Column:
        total = F.lit(0)
        for i, (_, points) in enumerate(zones):
            total = total + F.when(F.array_contains(F.col(f"_zone{i}"), word), points).otherwise(0)
        return F.least(total, F.lit(100))

    def keyword(r: Column) -> Column:
        share = F.bround(-r["neg_n"] / F.size("_tokens") * 100, 2)
        return F.struct(r["token"].alias("keyword"), (-r["neg_n"]).alias("count"), share.alias("density"),
                        prominence(r["token"]).alias("prominence"),
                        F.array_contains("_zone0", r["token"]).alias("in_title"),
                        F.array_contains("_zone1", r["token"]).alias("in_h1"))

    report = let(count_tokens(F.col("_tokens")), lambda counted: F.struct(
        F.size("_tokens").alias("word_count"), F.size(counted).alias("unique_words"),
        F.transform(F.slice(counted, 1, 20), keyword).alias("keywords"),
        _phrases(F.col("_tokens"), 2).alias("two_word"), _phrases(F.col("_tokens"), 3).alias("three_word")))
    return tokens.withColumn("keyword_report", report).drop("_tokens", *[f"_zone{i}" for i in range(len(zones))])


def stuffed_keywords(keywords: Column, pct: float = 3.0) -> Column:
    """Keywords above the density, and the top five missing from the title or the first heading level."""
    def names(rows: Column) -> Column:
        return F.transform(rows, lambda k: k["keyword"])

    top = F.slice(keywords, 1, 5)
    return F.struct(
        names(F.filter(keywords, lambda k: k["density"] > pct)).alias("stuffed"),
        names(F.filter(top, lambda k: ~k["in_title"])).alias("missing_in_title"),
        names(F.filter(top, lambda k: ~k["in_h1"])).alias("missing_in_h1"))


# --- advice --------------------------------------------------------------------------------
# The wording of each piece of advice.


def schema_advice(items: Column) -> Column:
    kinds = F.transform(items, lambda i: i["type"])
    invalid = F.size(F.filter(items, lambda i: ~i["is_valid"]))

    def lacks(*names: str) -> Column:
        return ~F.arrays_overlap(F.concat(kinds, F.array(F.lit(""))), F.array(*[F.lit(n) for n in names]))

    return F.slice(_advice(
        (F.size(items) == 0, "Add JSON-LD structured data for better search visibility"),
        (lacks("Organization", "LocalBusiness"), "Add Organization or LocalBusiness schema"),
        (lacks("BreadcrumbList"), "Add BreadcrumbList schema for navigation"),
        (lacks("WebSite"), "Add WebSite schema with SearchAction for sitelinks"),
        (invalid > 0, F.concat(F.lit("Fix "), invalid.cast("string"), F.lit(" invalid schema markup(s)"))),
    ), 1, 5)


def social_advice(og: Column, twitter: Column) -> Column:
    has_og, missing = F.size(og) > 0, sc.missing_open_graph(og)
    unsized = F.map_contains_key(og, "og:image") & ~F.map_contains_key(og, "og:image:width")
    large = F.coalesce(twitter["twitter:card"] == "summary_large_image", F.lit(False))
    return F.slice(_advice(
        (~has_og, "Add Open Graph meta tags for better social sharing"),
        (has_og & (F.size(missing) > 0), F.concat(F.lit("Add missing OG tags: "), F.array_join(missing, ", "))),
        (has_og & unsized, "Specify og:image dimensions for faster rendering"),
        (F.size(twitter) == 0, "Add Twitter Card meta tags"),
        ((F.size(twitter) > 0) & ~large, "Use 'summary_large_image' Twitter card for better engagement"),
    ), 1, 5)


def keyword_advice(keywords: Column) -> Column:
    def build(found: Column) -> Column:
        def named(prefix: str, names: Column, n: int) -> tuple[Column, Column]:
            return F.size(names) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(names, 1, n), ", "))

        return F.slice(_advice(
            named("Reduce keyword density for: ", found["stuffed"], 3),
            named("Add top keywords to title: ", found["missing_in_title"], 2),
            named("Include keywords in H1: ", found["missing_in_h1"], 2),
        ), 1, 5)

    return let(stuffed_keywords(keywords), build)


def speed_advice(size: Column, scripts: Column, stylesheets: Column, images: Column, deferred: Column,
                 lazy: Column) -> Column:
    kilobytes = F.floor(size / 1024).cast("string")
    return F.slice(_advice(
        (size > 200_000, F.concat(F.lit("Reduce page size (currently "), kilobytes, F.lit("KB)"))),
        ((scripts > 5) & ~deferred, "Add async/defer to script tags"),
        (stylesheets > 3, "Combine or inline critical CSS"),
        ((images > 5) & (lazy == 0), "Implement lazy loading for images"),
        (images > 0, "Use next-gen image formats (WebP, AVIF)"),
    ), 1, 5)


def page_profile(facts: DataFrame, key: str = "page_id") -> DataFrame:
    """Counts, structured data, social tags, keywords, speed and advice of every page."""
    wide = keyword_report(h.page_resources(h.social_tags(facts))).withColumn(
        "schemas", h.schema_item_array(facts))
    c = F.col
    description = h.meta_description(c("meta"))
    og, tw = c("open_graph"), c("twitter")
    wide = wide.withColumns({
        "og_score": sc.open_graph_score(og), "tw_score": sc.twitter_score(tw),
        "schema_tips": schema_advice(c("schemas")), "social_tips": social_advice(og, tw),
        "keyword_tips": keyword_advice(c("keyword_report.keywords")),
        "speed_tips": speed_advice(c("page_bytes"), c("external_scripts"), c("stylesheets"), c("page_images"),
                                   c("has_async_scripts"), c("lazy_images"))})
    return wide.select(
        key, "url",
        F.struct(
            "title", F.length("title").alias("title_length"), description.alias("meta_description"),
            F.length(description).alias("meta_description_length"),
            h.heading_count(c("headings"), "h1").alias("h1_count"),
            h.heading_count(c("headings"), "h2").alias("h2_count")).alias("basic"),
        F.struct(
            "schemas", F.size("schemas").alias("count"),
            sc.has_priority_schema(c("schemas")).alias("has_priority_schema"),
            sc.schema_score(c("schemas")).alias("score"), c("schema_tips").alias("recommendations"))
        .alias("schema_markup"),
        F.struct(
            og.alias("open_graph"), tw.alias("twitter_cards"), c("og_score").alias("open_graph_score"),
            c("tw_score").alias("twitter_score"), sc.missing_open_graph(og).alias("missing_required"),
            F.coalesce(tw["twitter:card"], F.lit("none")).alias("card_type"),
            sc.social_score(c("og_score"), c("tw_score")).alias("overall_score"),
            c("social_tips").alias("recommendations")).alias("social_meta"),
        c("keyword_report").alias("keywords"),
        F.struct(
            c("page_bytes").alias("page_size_bytes"), F.bround(c("page_bytes") / 1024, 2).alias("page_size_kb"),
            "external_scripts", "inline_scripts", "stylesheets", "inline_styles",
            c("page_images").alias("images"), "lazy_images", "has_async_scripts", "has_preload", "has_preconnect",
            (c("lazy_images") > 0).alias("has_lazy_loading"),
            sc.estimated_fcp_ms(c("page_bytes"), c("external_scripts"), c("stylesheets")).alias("fcp_ms"),
            sc.estimated_lcp_ms(c("page_bytes"), c("page_images"), c("lazy_images") > 0).alias("lcp_ms"),
            sc.page_speed_score(c("page_bytes"), c("external_scripts"), c("stylesheets"), c("has_async_scripts"),
                                c("has_preload"), c("has_preconnect")).alias("score"),
            c("speed_tips").alias("recommendations")).alias("performance"),
        F.slice(F.concat("schema_tips", "social_tips", "keyword_tips", "speed_tips"), 1, 15)
        .alias("recommendations"))


def analyze_pages(facts: DataFrame, site_files: DataFrame, key: str = "page_id") -> DataFrame:
    """One analysis row per page: lengths, counts, component scores and the overall score."""
    counted = h.image_counts(h.link_counts(h.heading_counts(h.title_and_meta(facts))))
    flagged = h.technical_flags(counted, site_files)
    c = F.col
    resources = h.page_resources(flagged).withColumn("word_count", tx.word_count(c("seo_text")))
    scored = resources.withColumns({
        "title_score": sc.title_score(c("title_length")),
        "meta_description_score": sc.meta_description_score(c("meta_description_length")),
        "headers_score": sc.headers_score(c("h1_count"), c("h2_count"), c("h3_count")),
        "content_score": sc.content_score(c("word_count")),
        "technical_score": sc.technical_score(c("has_ssl"), c("has_canonical"), c("has_schema"),
                                              c("has_sitemap"), c("has_robots")),
        "links_score": sc.links_score(c("internal_links"), c("external_links")),
        "images_score": sc.images_score(c("images_count"), c("images_with_alt")),
        "page_speed_score": sc.page_speed_score(
            c("page_bytes"), c("external_scripts"), c("stylesheets"), c("has_async_scripts"), c("has_preload"),
            c("has_preconnect")),
        "keyword_counts": tx.raw_keyword_counts(c("seo_text"))})
    return scored.select(
        key, "url", sc.overall_score().alias("overall_score"),
        "title", "title_length", "title_score", "meta_description", "meta_description_length",
        "meta_description_score", "h1_count", "h1_content", "h2_count", "h3_count", "headers_score",
        "word_count", "content_score", "images_count", "images_with_alt", "images_score", "internal_links",
        "external_links", "links_score", "has_ssl", "has_sitemap", "has_robots", "has_canonical", "has_schema",
        "technical_score", "page_speed_score", c("page_bytes").alias("page_size_bytes"),
        F.transform("keyword_counts", lambda k: F.struct(
            k["token"].alias("keyword"), (-k["neg_n"]).alias("count"))).alias("keyword_density"))


def recalculate_scores(competitors: DataFrame, analyses: DataFrame, contents: DataFrame) -> DataFrame:
    """Competitors with fresh seo, content and health scores.

    Both inputs are folded to one row per competitor before they are joined.
    """
    seo = analyses.groupBy(F.col("competitor_id").alias("id")).agg(F.avg("overall_score").alias("_seo"))
    text = contents.groupBy(F.col("competitor_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_pages"), F.avg("readability_score").alias("_ease"))
    fresh = F.least(F.lit(100), ((F.col("_ease") + F.col("_pages")) / 2).cast("int"))
    joined = competitors.join(seo, "id", "left").join(text, "id", "left").withColumns({
        "_seo_score": F.coalesce("_seo", F.lit(0.0)).cast("int"),
        "_content_score": F.when((F.col("_pages") > 0) & (F.col("_ease") != 0), fresh)
        .otherwise(F.col("content_score"))})
    return joined.withColumns({
        "seo_score": F.col("_seo_score"), "content_score": F.col("_content_score"),
        "health_score": sc.health_score(F.col("_seo_score"), F.col("_content_score")),
    }).drop("_seo", "_pages", "_ease", "_seo_score", "_content_score")
