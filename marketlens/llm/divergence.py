"""Which sources of a language differ, and in which terms: exact smoothed divergences by Gustavson row accumulation.

A (lang, source) group is a sparse row of term counts. For a pair of groups the sum
over all kept terms of f = floor((p - q)^2 / q) falls into a part that only the zero
baselines and one row's counts decide, and a correction on terms that both rows hold.
The first comes from histograms of counts, one row against blocks of peers. For the
second, terms are dealt out in blocks; a task holds its block as a term-major index,
and each group scatters its terms through it into a dense accumulator over its peers.
A task sends one sum per pair of groups, never a row per shared posting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.llm.common import documents, saved, slices, whole
from marketlens.llm.ngram_join import groups as runs_of

SCALE = 1_000_000_000
#: Entries that a counting task holds before it sends them on.
HELD = 250_000
#: Postings of a term block, peers of a peer block, and products worked out at a time.
BLOCK, PEERS, AT_ONCE = 150_000, 4096, 500_000
#: Bytes of terms: A to Z become lower case, bytes from 0x80 on belong to letters, the others part terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The lower-cased terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def _counted(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, d: occurrences and documents, summed within runs of texts.

    Each group that occurs also gets rows with a null term.
    """
    def rows(held: dict) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for (lang, source), (found, seen) in held.items():
            out[0] += [lang] * (len(found) + 1)
            out[1] += [source] * (len(found) + 1)
            out[2] += [None, *found]
            out[3] += [0, *found.values()]
            out[4] += [0, *(seen[t] for t in found)]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["lang", "source", "term", "n", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(2).cast(pa.binary()).to_pylist()
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    key = (lang, source)
                    if key not in held:
                        held[key] = (Counter(), Counter())
                        size += 1
                    found, seen = held[key]
                    terms = terms_of(text)
                    size -= len(found)
                    found.update(terms)
                    seen.update(set(terms))
                    size += len(found)
                    if size > HELD:
                        yield rows(held)
                        held, size = {}, 0
        if held:
            yield rows(held)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / total), exact for any count."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")).alias("_wide")
    return F.call_function("div", wide, total.cast("decimal(20,0)")) + 1


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def _spread(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // q


def _sums(lang: str, source: str, items: pa.Array, values: np.ndarray, turned: bool = False) -> pa.RecordBatch:
    """Rows lang, source, item, value; ``turned`` swaps source and item."""
    one = pa.repeat(pa.scalar(source, pa.string()), len(items))
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), len(items)), items if turned else one, one if turned else items,
         pa.array(values, pa.int64())], ["lang", "source", "item", "value"])


SUMS = "lang string, source string, item string, value long"


def _baselines(totals: DataFrame, kept: DataFrame) -> DataFrame:
    """What the zero baselines and the counts of one of two groups add to the value of each ordered pair."""
    hist = kept.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("k")).groupBy("lang", "source").agg(
        F.collect_list("n").alias("ns"), F.collect_list("k").alias("ks"))
    full = totals.join(hist, ["lang", "source"], "left").select(
        "lang", "source", "base", "terms", (F.col("total") + F.col("terms")).alias("over"), "ns", "ks")
    chunks = totals.withColumn("chunk", F.pmod(F.xxhash64("source"), F.ceil(F.col("peers") / PEERS))).groupBy(
        "lang", "chunk").agg(F.collect_list("source").alias("items"), F.collect_list("base").alias("bases")).select(
        F.col("lang").alias("of"), "items", "bases")
    met = full.join(chunks, full["lang"] == chunks["of"]).drop("of", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, source, base, terms, over = (batch.column(c)[i].as_py() for c in range(5))
                ns, ks = ((batch.column(c)[i].values.to_numpy() if batch.column(c)[i].is_valid else np.zeros(0, np.int64))
                          for c in (5, 6))
                items, bases = batch.column(7)[i].values, batch.column(8)[i].values.to_numpy()
                none = _spread(np.int64(base), bases)
                here = terms * none
                there = np.zeros(len(bases), np.int64)
                back = _spread(bases, np.int64(base))
                for at in range(0, len(ns), 128):
                    p = _shares(ns[at:at + 128], over)[:, None]
                    k = ks[at:at + 128][:, None]
                    here += (k * (_spread(p, bases[None, :]) - none)).sum(0)
                    there += (k * (_spread(bases[None, :], p) - back)).sum(0)
                other = pa.array(np.array([x != source for x in items.to_pylist()], bool))
                mask = other.to_numpy(zero_copy_only=False)
                yield _sums(lang, source, items.filter(other), here[mask])
                yield _sums(lang, source, items.filter(other), there[mask], turned=True)

    return met.mapInArrow(run, SUMS)


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total) by division in steps of 1000, which stay inside 64 bits."""
    whole_part, rest = np.divmod(counts.astype(np.int64) + 1, np.int64(total))
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, np.int64(total))
        whole_part = whole_part * 1000 + digit
    return whole_part + 1


def scatter(term: np.ndarray, group: np.ndarray, p: np.ndarray, base: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each group its dense accumulator over all groups: the correction on terms that both hold.

    ``term`` is sorted, so that the postings of a term stand together; ``group`` and
    ``p`` belong to the posting, ``base`` to the group.
    """
    start = np.concatenate([np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), [len(term)]])
    place = np.repeat(np.arange(len(start) - 1), np.diff(start))
    length = np.diff(start)[place]
    order = np.argsort(group, kind="stable")
    edges = np.searchsorted(group[order], np.arange(len(base) + 1))
    for g in range(len(base)):
        own = order[edges[g]:edges[g + 1]]
        sums = np.zeros(len(base), np.int64)
        ends = np.cumsum(length[own])
        a = 0
        while a < len(own):
            held = ends[a] - length[own[a]]
            b = max(a + 1, int(np.searchsorted(ends, held + AT_ONCE, "right")))
            rows = own[a:b]
            reps = length[rows]
            at = np.repeat(start[place[rows]] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            peer, mine, q = group[at], np.repeat(p[rows], reps), p[at]
            zero = base[peer]
            np.add.at(sums, peer, _spread(mine, q) - _spread(mine, zero) - _spread(base[g], q) + _spread(base[g], zero))
            a = b
        sums[g] = 0
        yield g, sums


def _shared(rows: DataFrame) -> DataFrame:
    """What the terms that both groups of a pair hold add to its value, summed within term blocks."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("term"), F.ceil(F.col("postings") / BLOCK))).select(
        "lang", "block", "term", "source", "p", "base").repartition("lang", "block").sortWithinPartitions(
        "lang", "block", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs_of(batches, 2):
            lang = columns[0][0].as_py()
            term = columns[2].dictionary_encode().indices.to_numpy()
            named = columns[3].dictionary_encode()
            group, p = named.indices.to_numpy(), columns[4].to_numpy()
            base = np.zeros(len(named.dictionary), np.int64)
            base[group] = columns[5].to_numpy()
            for g, sums in scatter(term, group, p, base):
                some = np.flatnonzero(sums)
                if len(some):
                    yield _sums(lang, named.dictionary[g].as_py(), named.dictionary.take(pa.array(some)), sums[some])

    return dealt.mapInArrow(run, SUMS)


def audit(docs: DataFrame, least_docs: int = 3, most_terms: int | None = 200, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of A to Z, a to z and characters from U+0080 on, A to Z in lower
    case; a language keeps those in ``least_docs`` of its rows. Part ``pair`` has a row
    for each other source of the language, part ``term`` the terms that a source uses
    more than its language, the first ``most_terms`` of them (None: all). Nulls count
    as empty strings, so a null language or source is a group like others; empty texts
    have no terms but their group occurs. Repeated rows count each time. A language
    that keeps no term has pairs of value 0 and no term rows. Ties are ranked by the
    UTF-8 order of the item. An empty table gives no rows, other columns are not read.
    """
    base = docs.select(*[whole(F.col(c).cast("string")).alias(n) for c, n in zip(
        (lang_col, source_col, text_col), ("lang", "source", "text"))])
    # Dealt by term once: the sums per group and the sums per language need no other exchange.
    per_term = Window.partitionBy("lang", "term")
    counts = saved(_counted(base).repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d")).select(
        "lang", "source", "term", "n", F.sum("n").over(per_term).alias("lang_n"), F.sum("d").over(per_term).alias("lang_d"),
        (F.row_number().over(per_term.orderBy("source")) == 1).alias("first")), "term-counts")
    kept = counts.filter(F.col("term").isNotNull() & (F.col("lang_d") >= least_docs)).select(
        "lang", "source", "term", "n", "lang_n", "first")
    per_group = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("postings"), F.sum(F.col("first").cast("long")).alias("firsts"))
    named = counts.filter(F.col("term").isNull()).select("lang", "source")
    of_group = saved(named.join(per_group, ["lang", "source"], "left").na.fill(0, ["total", "postings", "firsts"]), "groups")
    of_lang = of_group.groupBy("lang").agg(
        F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"), F.sum("postings").alias("postings"),
        F.count(F.lit(1)).alias("peers"))
    totals = saved(of_group.select("lang", "source", "total").join(of_lang, "lang").withColumn(
        "base", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total") + F.col("terms"))).otherwise(1)),
        "totals")
    rows = kept.join(totals, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("terms")))

    pairs = _baselines(totals, kept).unionByName(_shared(rows)).groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    more = rows.withColumn("q", share(F.col("lang_n"), F.col("lang_total") + F.col("terms"))).filter("n > 0 AND p > q").select(
        "lang", "source", F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"), F.lit("term").alias("part"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranks = [df.withColumn("rank", F.row_number().over(ranked)) for df in (pairs, more)]
    if most_terms is not None:
        ranks[1] = ranks[1].filter(F.col("rank") <= most_terms)
    return ranks[0].unionByName(ranks[1]).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of each source from the others of its language over all documents, and its 200 telling terms."""
    return audit(documents(spark, sf_dir))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
words AS (
  SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
lang_terms AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN lang_terms USING (lang, term) GROUP BY ALL),
lang_sums AS (
  SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM lang_terms GROUP BY lang),
found AS (SELECT DISTINCT lang, source FROM docs),
sums AS (
  SELECT f.lang, f.source, coalesce(s.v, 0) AS v, s.lang_total, coalesce(c.total, 0) AS total
  FROM found f LEFT JOIN lang_sums s USING (lang)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) c USING (lang, source)),
shares AS (
  SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + s.v) AS p,
    1 + (1000000000::HUGEINT * (t.lang_n + 1)) // (s.lang_total + s.v) AS q
  FROM sums s JOIN lang_terms t USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL
  SELECT a.lang, a.source, b.source, 0 FROM sums a JOIN sums b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q,
    row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, encode(term)) AS rank
  FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""
