"""Text functions; all but `clean_text` are built-in expressions."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F, types as T

from ..shipping import bounded

#: Markers of a deleted text, each from its start and in any case.
DELETION_MARKERS = (r"\[deleted\]$", r"\[removed\]$", r"\[removed by reddit\]", r"\[removed by .+?\]", r"this comment was removed", r"this post was removed")
#: Typographic characters and what they are folded to.
FOLDS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "..."}


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim only takes U+0020)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_deleted(c: Column) -> Column:
    """`$` also holds before a final line feed, but the text is stripped, so that can't occur."""
    return F.coalesce(strip(c).rlike("(?i)^(?:" + "|".join(DELETION_MARKERS) + ")"), F.lit(False))


_SPACES, _BLANK_LINES, _FOLDED = re.compile(r"[ \t]+"), re.compile(r"\n{3,}"), str.maketrans(FOLDS)


def _cleaned_text(t: str | None) -> str:
    # references are decoded after NFKC, so their results stay as they are
    out = html.unescape(unicodedata.normalize("NFKC", t)).translate(_FOLDED) if t else ""
    return _BLANK_LINES.sub("\n\n", _SPACES.sub(" ", out)).strip()


@F.pandas_udf(T.StringType())
def _cleaned(s: pd.Series) -> pd.Series:
    return s.map(_cleaned_text, na_action=None)


#: Declared as non-deterministic, which it isn't: else a filter on a cleaned column would have Spark clean the texts once more for it.
_cleaned_once = _cleaned.asNondeterministic()


def clean_text(c: Column) -> Column:
    """NFKC, character references, folded punctuation, collapsed spaces and blank lines, stripped; null is empty.

    One step of Python for each text, as NFKC and character references have no built-in.
    """
    if spark := SparkSession.getActiveSession():
        bounded(spark)
    return _cleaned_once(c)


def author_hash(author: Column, salt: str) -> Column:
    """Twelve hexadecimal digits of SHA-256 over salt and name."""
    name = F.lower(strip(F.when(author.isNull() | (author == ""), "[deleted]").otherwise(author)))
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), name), 256), 1, 12)


#: Hexadecimal digits of a cache's keys. Fewer than all 64 can be those of two texts: of 12, by chance in one of a hundred sets of 2.4 million texts.
KEY_DIGITS, ALL_DIGITS = 12, 64


def cache_key(text: Column, version: str, digits: int = KEY_DIGITS) -> Column:
    return F.concat(F.lit(f"{version}:"), F.substring(F.sha2(text, 256), 1, digits))


def without_prefix(c: Column, prefix: str = "t3_") -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def post_permalink(subreddit: Column, post: Column) -> Column:
    return F.when(_missing(subreddit) | _missing(post), "").otherwise(F.concat(F.lit("/r/"), subreddit, F.lit("/comments/"), post, F.lit("/")))


def comment_permalink(subreddit: Column, link: Column, comment: Column) -> Column:
    post = without_prefix(link)
    return F.when(_missing(subreddit) | _missing(post) | _missing(comment), "").otherwise(F.concat(F.lit("/r/"), subreddit, F.lit("/comments/"), post, F.lit("/_/"), comment, F.lit("/")))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def joined(*columns: Column) -> Column:
    """The non-empty ones with a blank line between."""
    return F.concat_ws("\n\n", *[F.nullif(c, F.lit("")) for c in columns])


def classifier_text(title_clean: Column, title: Column, body_clean: Column, body: Column) -> Column:
    """What a model sees of a post: cleaned, or raw where the cleaned text is empty."""
    return joined(first_filled(title_clean, title), first_filled(body_clean, body))


def resolver_text(title: Column, body: Column) -> Column:
    """What mentions are looked up in: the raw title and body, stripped."""
    return joined(strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(body, F.lit(""))))


def has_text(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def first_chars(c: Column, n: int) -> Column:
    """The first n characters of the stripped text, without stripping all of it: only if nothing but white space follows
    them does their own end count as the text's."""
    front = F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")
    head = F.substring(front, 1, n)
    goes_on = F.substring(front, F.lit(n + 1), F.length(front)).rlike(r"(?U)[^\s\x1c-\x1f]")
    return F.when(goes_on, head).otherwise(F.regexp_replace(head, r"(?U)[\s\x1c-\x1f]+$", ""))


def quote_text(title: Column, body: Column, body_chars: int = 200, chars: int = 300) -> Column:
    head, rest = first_chars(title, chars), first_chars(F.coalesce(body, F.lit("")), body_chars)
    return F.substring(F.when(rest == "", head).otherwise(F.concat(head, F.lit(" — "), rest)), 1, chars)


def quote_block(quotes: Column) -> Column:
    """Lines `  - (score↑) text` of an array of quotes."""
    return F.array_join(F.transform(quotes, lambda q: F.concat(F.lit("  - ("), q["score"].cast("string"), F.lit("↑) "), q["text"])), "\n")


def first_present(columns: dict[str, Column] | list[str], available: list[str]) -> Column:
    """Coalesce over those of the candidate names that a table has."""
    found = [F.col(c) for c in columns if c in available]
    return F.coalesce(*found) if found else F.lit(None)
