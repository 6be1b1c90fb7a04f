"""URL columns: parts, resolution, normal form, link classes and crawl priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.arrays import let

# Generic URI syntax (RFC 3986, appendix B): 1 scheme, 2 authority, 3 path, 4 query.
URI = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"

# Query parameters that only track visitors.
TRACKING_PARAMETERS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "msclkid", "ref", "source", "mc_cid", "mc_eid",
    "sessionid", "sid", "jsessionid", "_ga", "_gid",
]
# File endings that are never followed.
SKIPPED_EXTENSIONS = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".tar", ".gz", ".7z",
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv",
    ".css", ".js", ".json", ".xml", ".exe", ".dmg", ".apk",
]
# Link classes by url part, first hit wins.
LINK_TYPES = [
    ("navigation", ["/about", "/contact", "/team", "/careers"]),
    ("product", ["/product", "/shop", "/store", "/item", "/buy"]),
    ("content", ["/blog", "/post", "/article", "/news"]),
    ("pricing", ["/pricing", "/plans", "/subscribe"]),
    ("documentation", ["/docs", "/help", "/support", "/faq"]),
    ("auth", ["/login", "/signup", "/register", "/signin"]),
]
# Crawl priority by path pattern, then by link class.
CRITICAL, HIGH, MEDIUM, LOW, DEFERRED = range(5)
PRIORITY_PATTERNS = [
    (CRITICAL, [r"^/$", r"^/home/?$", r"^/index\.html?$"]),
    (HIGH, ["/pricing", "/plans", "/products?/", "/features", "/shop", "/store", "/buy"]),
    (MEDIUM, ["/blog/", "/posts?/", "/articles?/", "/news/", "/case-study", "/solutions"]),
    (LOW, ["/about", "/team", "/careers", "/contact", "/privacy", "/terms", "/legal", "/docs/", "/help/",
           "/support/", "/faq"]),
    (DEFERRED, ["/tag/", "/category/", "/author/", r"/page/\d+", r"\?.*page=", "/archive/"]),
]
TYPE_PRIORITIES = [("pricing", HIGH), ("product", HIGH), ("content", MEDIUM), ("documentation", LOW),
                   ("navigation", LOW), ("auth", DEFERRED)]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URI, 1))


def host(url: Column) -> Column:
    """Lower-cased network location, port included."""
    return F.lower(F.regexp_extract(url, URI, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, URI, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URI, 4)


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def url_depth(url: Column) -> Column:
    """Number of path segments; 0 at the root."""
    inner = F.regexp_replace(path(url), "^/+|/+$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "/")))


def _without_dots(p: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    empty = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(
        F.split(p, "/"), empty,
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done))
        .otherwise(F.array_append(done, part)))
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(kept, "/")).otherwise(p)


def resolve(url: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    root = F.concat(F.regexp_extract(base, URI, 1), F.lit("://"), F.regexp_extract(base, URI, 2))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    ref_path = F.regexp_extract(url, URI, 3)
    ref_tail = F.substring(url, F.length(ref_path) + 1, F.length(url))
    return (
        F.when(base.isNull() | url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(F.regexp_extract(base, URI, 1), F.lit(":"), url))
        .when(ref_path == "", F.concat(root, path(base), F.when(url.startswith("?"), url).otherwise(
            F.when(query(base) != "", F.concat(F.lit("?"), query(base))).otherwise(F.lit("")))))
        .when(url.startswith("/"), F.concat(root, _without_dots(ref_path), ref_tail))
        .otherwise(F.concat(root, _without_dots(F.concat(folder, ref_path)), ref_tail))
    )


def _decode(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _encode(part: Column) -> Column:
    # The Java encoder keeps "*" and escapes "~"; the wanted form does the opposite.
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _normal_query(q: Column) -> Column:
    """Parameters without tracking ones and blanks, sorted by name, values of a name in given order."""
    strip = F.array(*[F.lit(p) for p in TRACKING_PARAMETERS])
    pairs = F.transform(F.split(q, "&"), lambda kv, i: F.struct(
        _decode(F.substring_index(kv, "=", 1)).alias("name"), i.alias("pos"),
        F.when(F.instr(kv, "=") > 0, _decode(F.substring(kv, F.instr(kv, "=") + 1, F.length(kv))))
        .otherwise(F.lit("")).alias("value")))
    kept = F.filter(pairs, lambda p: (p["value"] != "") & ~F.array_contains(strip, F.lower(p["name"])))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(
        _encode(p["name"]), F.lit("="), _encode(p["value"]))), "&")


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """One spelling per page: case, default port, trailing slash, fragment and tracking removed."""

    def build(u: Column) -> Column:
        low, bare = u["scheme"], u["path"]
        authority = (
            F.when(low == "http", F.regexp_replace(u["host"], ":80$", ""))
            .when(low == "https", F.regexp_replace(u["host"], ":443$", ""))
            .otherwise(u["host"]))
        tidy = F.when(bare == "", "/").otherwise(bare)
        return F.concat(
            F.when(low != "", F.concat(low, F.lit(":"))).otherwise(F.lit("")),
            F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
            tidy, F.when(u["query"] != "", F.concat(F.lit("?"), u["query"])).otherwise(F.lit("")))

    def parts(u: Column) -> Column:
        # Trailing slashes and segment parameters (";...") go together, so that a normal
        # form stays as it is.
        return F.struct(
            scheme(u).alias("scheme"), host(u).alias("host"),
            F.regexp_replace(path(u), "(?:/|;[^/;]*)+$", "").alias("path"), _normal_query(query(u)).alias("query"))

    absolute = url if base is None else resolve(url, base)
    return let(let(absolute, parts), build)


def _any_in(text: Column, parts: list[str]) -> Column:
    return F.greatest(*[text.contains(p) for p in parts])


def link_type(url: Column) -> Column:
    low, chain = F.lower(url), F
    for label, parts in LINK_TYPES:
        chain = chain.when(_any_in(low, parts), label)
    return chain.otherwise("general")


def crawl_priority(url: Column, kind: Column | None = None) -> Column:
    """0 critical .. 4 deferred, by path and query, then by link class, else 2."""
    q = query(url)
    target = F.lower(F.concat(path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))
    chain = F
    for level, patterns in PRIORITY_PATTERNS:
        chain = chain.when(target.rlike("|".join(f"(?:{p})" for p in patterns)), level)
    if kind is not None:
        for label, level in TYPE_PRIORITIES:
            chain = chain.when(kind == label, level)
    return chain.otherwise(MEDIUM)


def skipped_file(url: Column) -> Column:
    endings = "|".join(e.lstrip(".") for e in SKIPPED_EXTENSIONS)
    return F.lower(url).rlike(rf"\.(?:{endings})$")
