"""Text columns: tokens, hashes, readability, page categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.arrays import count_tokens, let, ngrams

# Stop words left out of keyword lists.
KEYWORD_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "can", "this", "that", "these", "those", "it", "its", "you", "your",
    "we", "our", "they", "their", "he", "she", "his", "her",
]
REPORT_STOP_WORDS = [
    *KEYWORD_STOP_WORDS,
    "i", "me", "my", "not", "no", "so", "if", "then", "than", "when",
]

# Unicode white space and word characters, spelled out so that no engine default matters.
_SPACE = r"\t-\r\x1c-\x20\x{85}\p{Z}"
SPACES = f"[{_SPACE}]+"
WORD = f"[^{_SPACE}]+"
NON_WORD = rf"[^\p{{L}}\p{{N}}_{_SPACE}]"
NON_WORD_OR_SPACE = r"[^\p{L}\p{N}_]"
ASCII_WORD = r"(?<![\p{L}\p{N}_])[a-z]{3,}(?![\p{L}\p{N}_])"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", "")


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return _all(text, WORD)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def ascii_words(text: Column) -> Column:
    """Lower-cased runs of at least three ASCII letters standing alone as words."""
    return _all(F.lower(text), ASCII_WORD)


def without(tokens: Column, stop_words: list[str]) -> Column:
    # A list this long is looked up in a set.
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def top(tokens: Column, n: int) -> Column:
    return F.slice(count_tokens(tokens), 1, n)


def top_keywords(text: Column, n: int = 10) -> Column:
    """Most frequent words outside the stop list, as an array of strings."""
    return F.transform(top(without(ascii_words(text), KEYWORD_STOP_WORDS), n), lambda r: r["token"])


def raw_keyword_counts(text: Column, n: int = 20) -> Column:
    """Counts of words longer than three characters after dropping punctuation; no stop list."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, NON_WORD_OR_SPACE, ""))
    return top(F.filter(bare, lambda w: F.length(w) > 3), n)


def content_hash(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.lower(strip(text)), SPACES, " "), 256)


def normalize_text(text: Column) -> Column:
    """Lower case, single spaces, no punctuation, trimmed."""
    flat = F.regexp_replace(F.lower(text), SPACES, " ")
    return strip(F.regexp_replace(flat, NON_WORD, ""))


def top_phrases(normalized: Column, n: int = 10) -> Column:
    """Most frequent word trigrams; a text under three words yields its words."""
    return let(words(normalized), lambda w: F.when(F.size(w) < 3, w).otherwise(
        F.transform(top(ngrams(w, 3), n), lambda r: r["token"])))


def phrase_hash(normalized: Column) -> Column:
    return F.md5(F.array_join(top_phrases(normalized), " "))


def syllables(word: Column) -> Column:
    groups = F.size(_all(F.lower(word), "[aeiouy]+"))
    return let(groups, lambda g: F.greatest(
        F.lit(1), g - F.when((g > 1) & F.lower(word).endswith("e"), 1).otherwise(0)))


# A word without a vowel, and one that ends in e after an earlier group of vowels; both read from the start of a word.
_NO_VOWEL = f"(?<![^{_SPACE}])[^aeiouy{_SPACE}]++(?![^{_SPACE}])"
_SILENT_E = f"(?<![^{_SPACE}])[^aeiouy{_SPACE}]*+[aeiouy]++[^aeiouy{_SPACE}][^{_SPACE}]*+(?<=e)"


def readability(text: Column) -> Column:
    """Flesch reading ease between 0 and 100; 0 for an empty text.

    The syllables of all words are counted over the text: groups of vowels, one for a
    word that has none, less one for a word that ends in e and has another group.
    """
    whole = F.coalesce(text, F.lit(""))

    def ease(low: Column) -> Column:
        spoken = F.regexp_count(low, F.lit("[aeiouy]++")) + F.regexp_count(low, F.lit(_NO_VOWEL)) - F.regexp_count(
            low, F.lit(_SILENT_E))
        return let(F.regexp_count(low, F.lit(f"[^{_SPACE}]++")), lambda count: score(spoken, count))

    def score(spoken: Column, count: Column) -> Column:
        per_sentence = F.try_divide(count, F.regexp_count(whole, F.lit(f"[^.!?{_SPACE}][^.!?]*+")))
        per_word = F.try_divide(spoken, count)
        value = F.lit(206.835) - F.lit(1.015) * per_sentence - F.lit(84.6) * per_word
        # greatest and least skip nulls, so an undefined score must be caught first.
        return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))

    return F.coalesce(let(F.lower(whole), ease), F.lit(0.0))


def reading_time(count: Column) -> Column:
    """Minutes at 200 words a minute, rounded up."""
    return F.ceil(count / F.lit(200)).cast("int")


def _any_in(text: Column, parts: list[str]) -> Column:
    return F.greatest(*[text.contains(p) for p in parts]) if len(parts) > 1 else text.contains(parts[0])


# Page categories by url part, then by title word.
CATEGORY_URL_PARTS = [
    ("blog", ["/blog", "/post", "/article"]),
    ("product", ["/product", "/shop", "/item"]),
    ("pricing", ["/pricing", "/plans", "/subscription"]),
    ("documentation", ["/docs", "/documentation", "/help"]),
    ("about", ["/about", "/team", "/company"]),
    ("contact", ["/contact"]),
]
CATEGORY_TITLE_WORDS = [
    ("blog", ["blog", "post", "article", "news"]),
    ("pricing", ["pricing", "price", "plans", "subscribe"]),
]


def content_category(url: Column, title: Column) -> Column:
    low, name = F.lower(url), F.lower(F.coalesce(title, F.lit("")))
    chain = F
    for label, parts in CATEGORY_URL_PARTS:
        chain = chain.when(_any_in(low, parts), label)
    slashes = F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit("")))
    chain = chain.when(low.endswith("/") | (slashes <= 3), "landing")
    for label, parts in CATEGORY_TITLE_WORDS:
        chain = chain.when(_any_in(name, parts), label)
    return chain.otherwise("other")
