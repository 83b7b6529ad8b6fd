"""Text functions as columns; Python only where no built-in says it (casefold, NFKC, zlib)."""

from __future__ import annotations

import re
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.functions.taxonomies import STOPWORDS

Like = Column | str
UNICODE_WORD = r"(?U)\b[\w'-]+\b"


def _c(c: Like) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _all(c: Like, pattern: str) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0))


def ascii_tokens(c: Like) -> Column:
    """Lower-cased runs of a-z0-9, as an array; null for null."""
    return _all(F.lower(_c(c)), "[a-z0-9]+")


def normalized(c: Like) -> Column:
    """The ascii tokens joined by blanks."""
    return F.array_join(ascii_tokens(c), " ")


def slugify(c: Like) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]+", "_"), F.lit("_"))


def words(c: Like) -> Column:
    """Number of words in the Unicode sense, with inner quotes and hyphens."""
    return F.size(_all(c, UNICODE_WORD))


def ascii_word_count(c: Like) -> Column:
    return F.size(_all(c, "[A-Za-z0-9]+"))


def visible_tokens(c: Like) -> Column:
    """Runs of non-blanks."""
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda t: t != "")


def shorten(c: Like, maximum: int = 28, least: int = 8, lead: str = "Verified source context: ") -> Column:
    """The first tokens, without commas and colons at the ends, with a lead where the rest is short."""
    cut = F.trim(F.array_join(F.slice(visible_tokens(c), 1, maximum), " "), F.lit(" ,;:"))
    return F.when(words(cut) < least, F.trim(F.concat(F.lit(lead), cut))).otherwise(cut)


def fit_words(c: Like, maximum: int = 30, least: int = 8, lead: str = "Verified source context ") -> Column:
    """The first words alone, with a lead where there are few."""
    found = _all(c, UNICODE_WORD)
    cut = F.array_join(F.slice(found, 1, maximum), " ")
    return F.trim(F.when(F.size(found) < least, F.concat(F.lit(lead), cut)).otherwise(cut))


def terms(c: Like) -> Column:
    """The set of ascii tokens of four letters or more that are no stopwords."""
    return F.array_distinct(F.filter(ascii_tokens(c), lambda t: (F.length(t) >= 4) & ~t.isin(*STOPWORDS)))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared share of two sets; `empty` where both are empty."""
    common, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both > 0, common / both).otherwise(F.lit(empty))


def overlap(a: Like, b: Like) -> Column:
    """Jaccard similarity of the terms, 0 for two empty sets."""
    return jaccard(terms(a), terms(b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard, 0 for two empty sets."""
    return 1 - jaccard(a, b, 1.0)


def shingles(tokens: Column, n: int) -> Column:
    """Distinct n-token texts; empty where there are fewer tokens, null for null."""

    def made(t: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) >= n, F.array_distinct(some)).when(t.isNotNull(), F.array().cast("array<string>"))

    return let(tokens, made)


def shares_ngram(a: Like, b: Like, n: int = 16) -> Column:
    """Whether two texts share n consecutive ascii tokens; false where either is shorter."""
    return F.coalesce(F.arrays_overlap(shingles(ascii_tokens(a), n), shingles(ascii_tokens(b), n)), F.lit(False))


def first_cue(c: Like, patterns: tuple[str, ...]) -> Column:
    """The text of the first pattern that matches, in pattern order; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(c), f"(?is)({p})", 1), F.lit("")) for p in patterns])


def tags(c: Like, rules: dict[str, tuple[str, ...]]) -> Column:
    """All tags of which the text contains a needle, else ["other"]."""
    low = F.lower(F.coalesce(_c(c), F.lit("")))

    def any_of(needles: tuple[str, ...]) -> Column:
        hit = F.contains(low, F.lit(needles[0]))
        for n in needles[1:]:
            hit = hit | F.contains(low, F.lit(n))
        return hit

    found = F.array_compact(F.array(*[F.when(any_of(ns), name) for name, ns in rules.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def tagset(tag_lists: Column) -> Column:
    """The distinct tags of several lists, sorted and joined by |; other if there are none."""
    text = F.array_join(F.array_sort(F.array_distinct(F.flatten(tag_lists))), "|")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("other"))


def first_class(c: Like, ordered: list[tuple[str, tuple[str, ...]]], otherwise: str = "other") -> Column:
    """The first class in order of which the text contains a needle."""
    low, out = F.lower(_c(c)), None
    for name, needles in ordered:
        hit = low.rlike("|".join(re.escape(n) for n in needles))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def strip_thinking(c: Like) -> Column:
    """The visible answer: what follows the last closing tag, else the text without blocks; chat stop marks off."""
    c = _c(c)
    after = F.element_at(F.split(c, r"(?i)</think>\s*"), -1)
    text = F.when(c.rlike("(?i)</think>"), after).otherwise(F.regexp_replace(c, r"(?is)<think>.*?</think>\s*", ""))
    return F.regexp_replace(F.regexp_replace(text, r"(?:\s*<\|(?:im_end|endoftext)\|>)+\s*$", ""), r"(?U)^\s+|\s+$", "")


def incomplete_thinking(c: Like) -> Column:
    return _c(c).rlike("(?i)<think>") & ~_c(c).rlike("(?i)</think>")


def visible_problem(response: Like, status: Like) -> Column:
    """Why a response can't be read: null, or the first reason that holds."""
    r, s = _c(response), F.lower(_c(status))
    return (
        F.when(r.isNull(), "invalid_response_type").when(s == "truncated", "truncated_rollout").when(incomplete_thinking(r), "incomplete_thinking").when(strip_thinking(r) == "", "empty_visible_response")
    )


def strip_html(c: Like, most: int = 600) -> Column:
    """Without tags, blanks squeezed, the first characters."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(_c(c), "<[^>]+>", " "), r"(?U)\s+", " "))
    return F.substring(plain, 1, most)


def clean_text(c: Like) -> Column:
    """Without NUL characters, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), "\u0000", ""), r"(?U)\s+", " "))


def normalize_answer(c: Like) -> Column:
    """Lower case, no ASCII punctuation, no articles, blanks squeezed."""
    bare = F.regexp_replace(F.lower(_c(c)), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def last_fenced(c: Like) -> Column:
    """The last fenced code block's body, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(r"(?s)```[A-Za-z0-9]*\n(.*?)```"), F.lit(1)), F.lit(-1))


def tag_body(c: Like, name: str) -> Column:
    """The body of the first <name> element, null if there is none."""
    return F.try_element_at(F.regexp_extract_all(_c(c), F.lit(rf"(?s)<{name}>(.*?)</{name}>"), F.lit(1)), F.lit(1))


def query_words(c: Like) -> Column:
    """Search text: punctuation to blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def snippet_parts(c: Like, least: int = 5) -> Column:
    """The stretches between ellipses that have more than `least` words."""
    parts = F.transform(F.split(_c(c), r"\.\.\."), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.size(F.split(p, r"\s+")) > least)


def numbered_passages(items: Column, title: str = "title", body: str = "text") -> Column:
    """An array of structs as "Doc i(Title: ...) body" lines."""
    lines = F.transform(items, lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), F.coalesce(x[title], F.lit("")), F.lit(") "), F.coalesce(x[body], F.lit(""))))
    return F.array_join(lines, "\n")


def labelled_lines(items: Column, fields: list[str], empty: str = "- none") -> Column:
    """Items of an array of structs as "- field=value; ..." lines, absent fields left out."""
    line = lambda x: F.concat(F.lit("- "), F.array_join(F.array_compact(F.array(*[F.when(x[f].isNotNull(), F.concat(F.lit(f + "="), x[f].cast("string"))) for f in fields])), "; "))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, line), "\n")).otherwise(empty)


@F.pandas_udf(T.StringType())
def casefold_words(c: pd.Series) -> pd.Series:
    """Casefolded Unicode words joined by blanks (no built-in folds case)."""
    return c.map(lambda x: None if x is None else " ".join(re.findall(r"\w+", x.casefold())))


@F.pandas_udf(T.BooleanType())
def quote_in(quote: pd.Series, text: pd.Series) -> pd.Series:
    """Whether the quotation's words stand in the text one after the other, after NFKC and casefold; an empty one does not."""
    plain = lambda s: re.findall(r"\w+", unicodedata.normalize("NFKC", s or "").casefold())
    return pd.Series([bool(q := plain(a)) and f" {' '.join(q)} " in f" {' '.join(plain(b))} " for a, b in zip(quote, text)], dtype="object")


@F.pandas_udf(T.DoubleType())
def zlib_ratio(c: pd.Series) -> pd.Series:
    """Bytes per compressed byte; infinite for empty text."""
    return c.map(lambda x: None if x is None else float("inf") if x == "" else len(x.encode()) / len(zlib.compress(x.encode(), 9)))


def has_repetition(c: Like, window: int = 10000, ratio: float = 10.0) -> Column:
    """Whether a long text's last stretch compresses more than tenfold; only long texts go to Python."""
    c = _c(c)
    return F.when(F.char_length(c) > window, zlib_ratio(F.when(F.char_length(c) > window, F.substring(c, -window, window))) > ratio).otherwise(False)


def redacted(entries: Like, markers: tuple[str, ...] = ("key", "token", "secret", "password")) -> Column:
    """A map with the values of names that contain a marker, in any case, replaced by "<redacted>"; null stays null."""
    hidden = lambda k: F.lower(k).rlike("|".join(re.escape(m.lower()) for m in markers))
    return F.transform_values(_c(entries), lambda k, v: F.when(hidden(k), F.lit("<redacted>")).otherwise(v))
