"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each text is reduced to a vector of transformed shares. For every (lang, source) the
minimum-covariance-determinant estimate of centre and covariance is found by
concentration steps, and rows too far from it in Mahalanobis distance are rejected.
Everything is DataFrame work; a step is one aggregation with partial sums, so a
group of any size costs only its bins in the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import attach, documents, row_key, saved, whole

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Vector parts with the least standard deviation that a part is taken to have: a true
#: minimum, used only where the estimate is below it. Shares that are 0 in nearly all
#: texts have no spread of their own.
PARTS = {"letters": 0.03, "symbols": 0.01, "dup_lines": 0.16, "repeats": 0.16}
NAMES = list(PARTS)
#: Bins per unit of log distance, and per unit of a vector part for medians.
DISTANCE_BINS, PART_BINS = 32, 256
#: Chance for a row of a normal group to be rejected.
TAIL = 1e-5


def text_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus counts over the whole text (null: no words).

    Words are maximal runs of other characters than space and tab to carriage
    return. Three-word windows are compared by 64-bit hashes inside a text. All
    steps are row-local: no shuffle.
    """
    rest = [c for c in docs.columns if c != text_col]
    text = F.col("_text")
    blank = F.transform(F.split(text, "\n"), lambda x: F.when(x.rlike(r"[^\x20\x09-\x0D]"), x))
    one = docs.select(*rest, whole(F.col(text_col)).alias("_text")).select(
        *rest, "_text", F.array_remove(F.split(text, BLANK), "").alias("_words"), F.array_compact(blank).alias("_lines"))
    two = one.select(
        *rest, "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hash"))
    counts = [*rest, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    windows = F.transform(F.sequence(F.lit(0), F.size("_hash") - 3), lambda i: F.xxhash64(
        F.get("_hash", i), F.get("_hash", i + 1), F.get("_hash", i + 2)))
    three = two.select(*counts, F.when(F.size("_hash") >= 3, windows).otherwise(
        F.array().cast("array<bigint>")).alias("_tri"))
    doubled = F.size(F.array_distinct("_tri")) < F.size("_tri")
    ordered = F.array_sort(F.transform("_tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.select(*counts, F.when(doubled, ordered).alias("_sorted"))

    def repeated(k: Column) -> Column:
        own, before, after = (F.get("_sorted", k + d)["h"] for d in (0, -1, 1))
        return F.coalesce(own == before, F.lit(False)) | F.coalesce(own == after, F.lit(False))

    covered = F.array_distinct(F.flatten(F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_sorted") - 1), repeated),
        lambda k: F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda d: F.get("_sorted", k)["i"] + d))))
    return four.select(*counts, F.when(F.col("_sorted").isNull(), 0).otherwise(F.size(covered)).cast("long")
                       .alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed parts: log mean word length, drawn to 5 by 100 words' weight, and arc-sine roots of shares."""
    def root(part: Column, of: Column) -> Column:
        return F.asin(F.sqrt(F.least(part / F.greatest(of, F.lit(1)), F.lit(1.0))))

    return [
        F.log((F.col("word_chars") + 500) / (F.col("n_words") + 100)).alias("letters"),
        root(F.col("n_symbols"), F.col("word_chars")).alias("symbols"),
        root(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines"),
        root(F.col("n_repeat_words"), F.col("n_words")).alias("repeats"),
    ]


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for even degrees of freedom, by halving the interval of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (mid, high) if tail > 1 - p else (low, mid)
    return low


def _named(value: Column | None) -> Column:
    return F.coalesce(F.concat(F.lit("="), value), F.lit("-"))


def _squared_distance() -> Column:
    """Mahalanobis distance squared, by forward substitution with the Cholesky factor in the row."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}{i}"))
    return sum((s * s for s in solved[1:]), solved[0] * solved[0])


def _with_factor(moments: DataFrame, keep: list[str]) -> DataFrame:
    """Centre, Cholesky factor and log determinant from the sums of a row subset."""
    n = F.col("n")

    def covariance(i: int, j: int) -> Column:
        value = F.col(f"s_{i}{j}") / n - F.col(f"s_{i}") * F.col(f"s_{j}") / n / n
        return F.greatest(value, F.lit(PARTS[NAMES[i]] ** 2)) if i == j else value

    out = moments.select(*keep, *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(len(NAMES))], *[
        covariance(i, j).alias(f"c_{i}{j}") for i in range(len(NAMES)) for j in range(i + 1)])
    for i in range(len(NAMES)):
        for j in range(i + 1):
            left = F.col(f"c_{i}{j}")
            for k in range(j):
                left = left - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            # Parts that hang together wholly leave no pivot of their own.
            value = F.sqrt(F.greatest(left, F.lit(1e-9))) if i == j else left / F.col(f"l_{j}{j}")
            out = out.withColumn(f"l_{i}{j}", value)
    logdet = sum((2 * F.log(f"l_{i}{i}") for i in range(1, len(NAMES))), 2 * F.log("l_00"))
    return out.withColumn("logdet", logdet).drop(*[f"c_{i}{j}" for i in range(len(NAMES)) for j in range(i + 1)])


def _starts(points: DataFrame) -> DataFrame:
    """Two starts per group: medians with spreads by median absolute deviation, and with the floors alone."""
    value = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.round(F.col(n) * PART_BINS).cast("long").alias("at"))
                                for i, n in enumerate(NAMES)]))
    counts = points.select("key", value.alias("v")).groupBy("key", "v.part", "v.at").agg(F.count(F.lit(1)).alias("n"))

    def median(of: DataFrame, at: str) -> DataFrame:
        order = Window.partitionBy("key", "part").orderBy(at)
        group = Window.partitionBy("key", "part")
        sums = of.withColumn("up_to", F.sum("n").over(order)).withColumn("all", F.sum("n").over(group))
        return sums.filter(2 * F.col("up_to") >= F.col("all")).groupBy("key", "part").agg(F.min(at).alias("mid"))

    middle = median(counts, "at")
    off = counts.join(middle, ["key", "part"]).withColumn("off", F.abs(F.col("at") - F.col("mid")))
    spread = median(off.groupBy("key", "part", "off").agg(F.sum("n").alias("n")), "off").withColumnRenamed("mid", "mad")
    both = middle.join(spread, ["key", "part"]).groupBy("key").agg(*[
        F.max(F.when(F.col("part") == i, F.col(c)) / PART_BINS).alias(f"{c}_{i}")
        for i in range(len(NAMES)) for c in ("mid", "mad")])
    wide = both.withColumn("start", F.explode(F.array(F.lit("mad"), F.lit("floor"))))
    return wide.select("key", "start", *[F.col(f"mid_{i}").alias(f"m_{i}") for i in range(len(NAMES))], *[
        (F.greatest(F.when(F.col("start") == "mad", 1.4826 * F.col(f"mad_{i}")).otherwise(0.0), F.lit(PARTS[NAMES[i]]))
         if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i in range(len(NAMES)) for j in range(i + 1)])


def _concentrate(points: DataFrame, estimate: DataFrame, share: float) -> DataFrame:
    """One concentration step: moments of the ``share`` of each group nearest to its estimate.

    Distances are counted in fine bins of their logarithm; the subset is the
    smallest number of whole bins with enough rows, and ``reach`` is the squared
    distance at its edge.
    """
    names = range(len(NAMES))
    far = F.greatest(_squared_distance(), F.lit(1e-9))
    bins = attach(points, estimate, "key", "rows").withColumn("bin", F.ceil(F.log(far) * DISTANCE_BINS)).groupBy(
        "key", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(NAMES[i]).alias(f"s_{i}") for i in names],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}{j}") for i in names for j in range(i + 1)])
    group = Window.partitionBy("key", "start")
    ordered = bins.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n")).withColumn(
        "rows", F.sum("n").over(group))
    subset = ordered.filter(F.col("before") < F.ceil(F.col("rows") * share)).groupBy("key", "start").agg(
        F.max("rows").alias("rows"), F.exp(F.max("bin") / DISTANCE_BINS).alias("reach"), F.sum("n").alias("n"),
        *[F.sum(f"s_{i}").alias(f"s_{i}") for i in names],
        *[F.sum(f"s_{i}{j}").alias(f"s_{i}{j}") for i in names for j in range(i + 1)])
    return _with_factor(subset, ["key", "start", "rows", "reach"])


def estimates(points: DataFrame, share: float = 0.5, steps: int = 6) -> DataFrame:
    """Minimum-covariance-determinant estimate of every key of ``points`` (key and vector parts).

    Of the starts the one with the smallest determinant wins. ``scale`` widens the
    covariance of the inner rows to that of all, and is at least 1.
    """
    rows = points.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    current = saved(_starts(points).join(rows, "key"), "mcd-0")
    for step in range(steps):
        current = saved(_concentrate(points, current, share), f"mcd-{step + 1}")
    best = Window.partitionBy("key").orderBy("logdet", "start")
    expected = chi_square_quantile(share, len(NAMES))
    return current.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").withColumn(
        "scale", F.greatest(F.lit(1.0), F.col("reach") / expected)).drop("_rank", "start", "reach", "logdet")


def verdicts(statistics: DataFrame, min_rows: int = 200) -> DataFrame:
    """``statistics`` (lang, source and the counts) with base_failed, distance and kept.

    ``statistics`` should be a written table. Estimates rest on rows that pass the
    base rules. A (lang, source) with fewer than ``min_rows`` of them takes the
    estimate of its language, a language with fewer that of all rows; fewer rows in
    all reject nothing. Null languages and sources are groups of their own. Rows
    that fail the base rules have a null distance.
    """
    lang, source = _named(F.col("lang")), _named(F.col("source"))
    passed = statistics.filter(~base_failed()).select("*", *vector(), F.concat(
        F.lit("2"), lang, F.lit("\x01"), source).alias("key"), F.concat(F.lit("1"), lang).alias("_lang_key"))
    points = saved(passed.select(F.explode(F.array("key", "_lang_key", F.lit("0"))).alias("key"), *NAMES), "mcd-points")
    found = saved(estimates(points), "mcd")
    enough = found.filter(F.col("rows") >= min_rows)
    fields = [c for c in found.columns if c not in ("key", "rows")]
    groups = passed.groupBy("key", "_lang_key").agg(F.count(F.lit(1)).alias("rows"))
    for name, key in (("own", F.col("key")), ("lang", F.col("_lang_key")), ("all", F.lit("0"))):
        level = enough.select(F.col("key").alias(f"_{name}"), F.struct(*fields).alias(f"_{name}_fit"))
        groups = groups.join(level, key == F.col(f"_{name}"), "left")
    chosen = F.coalesce("_own_fit", "_lang_fit", "_all_fit")
    settled = saved(groups.select("key", "rows", chosen.alias("fit")).select(
        "key", "rows", *[F.col(f"fit.{c}").alias(c) for c in fields]), "mcd-groups")
    limit = chi_square_quantile(1 - TAIL, len(NAMES))
    distance = F.sqrt(_squared_distance() / F.col("scale"))
    judged = attach(passed, settled, "key", "rows").select(
        *statistics.columns, F.lit(False).alias("base_failed"), distance.alias("distance"))
    failed = statistics.filter(base_failed()).select(
        "*", F.lit(True).alias("base_failed"), F.lit(None).cast("double").alias("distance"))
    far = F.coalesce(F.col("distance") > math.sqrt(limit), F.lit(False))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & ~far)


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict of each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept. Empty tables give no rows."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"),
                         F.col("source").cast("string").alias("source"))
    return verdicts(saved(text_statistics(narrow), "quality"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns. Rows with equal values share a verdict."""
    columns = ["doc_id", "text", "lang", "source"]
    key = row_key(docs, columns)
    high, low = "key_high", "key_low"
    named = docs.select("text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                        key[0].alias(high), key[1].alias(low))
    stay = verdicts(saved(text_statistics(named), "quality")).filter("kept").select(high, low)
    tagged = docs.select("*", *key)
    left, right = tagged.columns[-2:]
    return tagged.join(stay, (tagged[left] == stay[high]) & (tagged[right] == stay[low]), "left_semi").select(*docs.columns)


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
