"""Reports over stored analyses: audit cards, section report, fixes and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import scores as sc
from marketlens.functions.arrays import unnest
from marketlens.operators.compare import latest_analyses



def c(name: str) -> Column:
    return F.col(name)

# Fixed values throughout: category names, limits and the wording of issues and advice.


def _listed(*rows: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[
        F.when(condition, F.lit(text) if isinstance(text, str) else text) for condition, text in rows]))


def _blank(name: str) -> Column:
    return F.coalesce(c(name), F.lit("")) == ""


def _card(category: str, score: str, checks: list[tuple[Column, Column | str, str]]) -> Column:
    return F.struct(
        F.lit(category).alias("category"), c(score).alias("score"), F.lit(100).alias("max_score"),
        _listed(*[(condition, issue) for condition, issue, _ in checks]).alias("issues"),
        _listed(*[(condition, advice) for condition, _, advice in checks]).alias("recommendations"))


def seo_audit_cards(analyses: DataFrame) -> DataFrame:
    """Five cards for the newest analysis of every competitor, one row each."""
    titled, described = ~_blank("title"), ~_blank("meta_description")
    missing_alt = c("images_count") - c("images_with_alt")
    cards = F.array(
        _card("Title Tag", "title_score", [
            (~titled, "Missing title tag", "Add a descriptive title tag"),
            (titled & (c("title_length") < 30), "Title too short", "Expand title to 50-60 characters"),
            (titled & (c("title_length") > 60), "Title too long", "Shorten title to under 60 characters")]),
        _card("Meta Description", "meta_description_score", [
            (~described, "Missing meta description", "Add a compelling meta description"),
            (described & (c("meta_description_length") < 120), "Meta description too short",
             "Expand to 150-160 characters")]),
        _card("Headings", "headers_score", [
            (c("h1_count") == 0, "No H1 heading found", "Add exactly one H1 heading"),
            (c("h1_count") > 1, F.concat(F.lit("Multiple H1 headings ("), c("h1_count").cast("string"), F.lit(")")),
             "Use only one H1 heading per page")]),
        _card("Images", "images_score", [
            (missing_alt > 0, F.concat(missing_alt.cast("string"), F.lit(" images missing alt text")),
             "Add descriptive alt text to all images")]),
        _card("Technical SEO", "technical_score", [
            (~c("has_ssl"), "No SSL certificate", "Enable HTTPS"),
            (~c("has_sitemap"), "Missing sitemap.xml", "Create and submit a sitemap"),
            (~c("has_robots"), "Missing robots.txt", "Add a robots.txt file"),
            (~c("has_canonical"), "Missing canonical tag", "Add canonical tags to prevent duplicate content"),
            (~c("has_schema"), "No schema markup detected", "Implement structured data")]),
    )
    return unnest(latest_analyses(analyses), ["competitor_id"], cards, "card", "pos").select(
        "competitor_id", "pos", "card.*")


def title_advice(title: Column, length: Column) -> Column:
    return (F.when(F.coalesce(title, F.lit("")) == "", "Add a unique, descriptive page title")
            .when(length < 30, "Title is too short - aim for 50-60 characters")
            .when(length > 70, "Title is too long - it may be truncated in search results"))


def meta_advice(text: Column, length: Column) -> Column:
    return (F.when(F.coalesce(text, F.lit("")) == "", "Add a meta description to improve click-through rates")
            .when(length < 120, "Meta description is too short - aim for 150-160 characters")
            .when(length > 170, "Meta description is too long - it may be truncated"))


def headers_advice(h1: Column, h2: Column) -> Column:
    return (F.when(h1 == 0, "Add an H1 heading to the page").when(h1 > 1, "Use only one H1 heading per page")
            .when(h2 == 0, "Add H2 subheadings to structure your content"))


def word_count_advice(words: Column) -> Column:
    return (F.when(words < 300, "Content is too thin - aim for at least 500 words")
            .when(words < 1000, "Consider expanding content for better rankings"))


def images_advice(with_alt: Column, total: Column) -> Column:
    ratio = F.try_divide(with_alt, total)
    return (F.when(ratio < 0.5, "Add descriptive alt text to images for accessibility and SEO")
            .when(ratio < 1.0, "Some images are missing alt text"))


def _item(name: str, score: Column, value: Column, advice: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), score.cast("int").alias("score"),
                    sc.score_status(score).alias("status"), value.alias("value"), advice.alias("recommendation"))


def _flag(name: str, column: str, yes: str, no: str, advice: str) -> Column:
    on = c(column)
    return _item(name, F.when(on, 100).otherwise(0), F.when(on, yes).otherwise(no), F.when(~on, advice))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _section(title: str, score: Column, *items: Column) -> Column:
    empty = F.expr("cast(array() as array<struct<name:string,score:int,status:string,value:string,"
                   "recommendation:string>>)")
    return F.struct(F.lit(title).alias("title"), score.cast("int").alias("score"),
                    sc.score_status(score).alias("status"), (F.array(*items) if items else empty).alias("items"))


def report_sections() -> Column:
    """Six sections with their items, from one analysis row."""
    zero = F.lit(0)

    def n(name: str) -> Column:
        return F.coalesce(c(name), zero)

    on_page = F.floor((n("title_score") + n("meta_description_score") + n("headers_score")) / 3)
    return F.array(
        _section("Overall Score", n("overall_score")),
        _section(
            "On-Page SEO", on_page,
            _item("Page Title", n("title_score"), F.when(_blank("title"), "Missing").otherwise(
                _text('"', c("title"), '"')), title_advice(c("title"), n("title_length"))),
            _item("Meta Description", n("meta_description_score"),
                  _text(n("meta_description_length"), " characters"),
                  meta_advice(c("meta_description"), n("meta_description_length"))),
            _item("Header Structure", n("headers_score"),
                  _text("H1: ", n("h1_count"), ", H2: ", n("h2_count"), ", H3: ", n("h3_count")),
                  headers_advice(n("h1_count"), n("h2_count")))),
        _section(
            "Technical SEO", n("technical_score"),
            _flag("HTTPS/SSL", "has_ssl", "Enabled", "Not Enabled",
                  "Enable HTTPS for security and SEO benefits"),
            _flag("Sitemap", "has_sitemap", "Found", "Not Found", "Create and submit an XML sitemap"),
            _flag("Robots.txt", "has_robots", "Found", "Not Found", "Create a robots.txt file"),
            _flag("Canonical Tag", "has_canonical", "Present", "Missing",
                  "Add canonical tags to prevent duplicate content issues"),
            _flag("Schema Markup", "has_schema", "Found", "Not Found",
                  "Add structured data for rich snippets")),
        _section(
            "Content", n("content_score"),
            _item("Word Count", sc.report_word_score(n("word_count")), _text(n("word_count"), " words"),
                  word_count_advice(n("word_count")))),
        _section(
            "Images", n("images_score"),
            _item("Alt Text Coverage", n("images_score"),
                  _text(n("images_with_alt"), "/", n("images_count"), " images have alt text"),
                  images_advice(n("images_with_alt"), n("images_count")))),
        _section(
            "Links", n("links_score"),
            _item("Internal Links", F.least(F.lit(100), n("internal_links") * 10),
                  _text(n("internal_links"), " internal links"),
                  F.when(n("internal_links") < 5, "Add more internal links")),
            _item("External Links", F.least(F.lit(100), n("external_links") * 15),
                  _text(n("external_links"), " external links"),
                  F.when(n("external_links") < 2, "Add relevant external links"))),
    )


def priority_fixes(sections: Column, n: int = 10) -> Column:
    """Items in error, then items in warning, that carry advice; first ``n`` in report order."""
    flat = F.flatten(F.transform(sections, lambda s: F.transform(s["items"], lambda i: F.struct(
        s["title"].alias("section"), i["name"].alias("item"), i["recommendation"].alias("recommendation"),
        F.when(i["status"] == "error", "high").when(i["status"] == "warning", "medium").alias("priority")))))
    advised = F.filter(flat, lambda f: f["recommendation"].isNotNull() & f["priority"].isNotNull())
    return F.slice(F.concat(F.filter(advised, lambda f: f["priority"] == "high"),
                            F.filter(advised, lambda f: f["priority"] == "medium")), 1, n)


def seo_report(analyses: DataFrame, competitors: DataFrame, n_fixes: int = 10) -> DataFrame:
    """Full report for the newest analysis of every competitor, nested in one row."""
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor_name"),
                               F.col("url").alias("site_url"))
    return (
        latest_analyses(analyses).join(names, "competitor_id").withColumn("sections", report_sections())
        .select("competitor_id", "competitor_name", "site_url", "analyzed_at", "overall_score",
                sc.score_status(c("overall_score")).alias("overall_status"), "sections",
                priority_fixes(c("sections"), n_fixes).alias("priority_fixes"))
    )


def page_insights(analyses: DataFrame) -> DataFrame:
    """Insights of each analysis with kind and priority, most urgent first, one row each."""
    def insight(condition: Column, kind: str, message: Column | str, priority: int) -> Column:
        return F.when(condition, F.struct(
            F.lit(kind).alias("type"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
            F.lit(priority).alias("priority")))

    missing = c("images_count") - c("images_with_alt")
    found = F.array_compact(F.array(
        insight(c("title_score") >= 80, "success", "Title tag is well optimized", 3),
        insight(c("title_score") < 60, "error", "Title tag needs improvement - ensure it's 50-60 characters", 1),
        insight(c("meta_description_score") < 60, "error", "Meta description is missing or too short", 1),
        insight(~c("has_ssl"), "error", "SSL certificate not detected - critical for security", 1),
        insight(~c("has_sitemap"), "warning", "Sitemap.xml not found - important for crawling", 2),
        insight(c("has_ssl") & c("has_sitemap") & c("has_robots"), "success",
                "Technical SEO fundamentals are solid", 3),
        insight(c("word_count") < 300, "warning", "Content is thin - aim for 1000+ words", 2),
        insight(c("word_count") >= 1500, "success", "Content length is excellent for SEO", 3),
        insight(c("h1_count") == 0, "error", "Missing H1 heading - every page needs one", 1),
        insight(c("h1_count") > 1, "warning", _text("Multiple H1 tags (", c("h1_count"), ") - use only one"), 2),
        insight((c("images_count") > 0) & (missing > 0), "warning", _text(missing, " images missing alt text"), 2),
    ))

    def of_priority(level: int) -> Column:
        return F.filter(found, lambda i: i["priority"] == level)

    ordered = F.concat(of_priority(1), of_priority(2), of_priority(3))
    return unnest(analyses, ["id", "competitor_id"], ordered, "i", "pos").select(
        "id", "competitor_id", "pos", "i.*")
