"""Tokenizers, token filters and the analyzer that chains them, all as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html, stemmers

ENGLISH = r"(?:[a-zA-Z]+\.){2,}|[a-zA-Z0-9]+'[a-zA-Z]+|[a-zA-Z0-9]+"
SPACED = r"[^ \t\n\x0B\f\r]+"


def english(text: Column) -> Column:
    """Abbreviations without their dots, words without what follows an apostrophe, and plain terms; all else separates."""
    found = F.regexp_extract_all(text, F.lit(ENGLISH), F.lit(0))
    # Few texts have either; to see that costs less than to look at every token.
    clean = F.transform(found, lambda t: F.when(F.contains(t, F.lit(".")), F.replace(t, F.lit("."), F.lit(""))).otherwise(F.split_part(t, F.lit("'"), F.lit(1))))
    return F.when(text.rlike(r"[a-zA-Z]\.[a-zA-Z]+\.|[a-zA-Z0-9]'[a-zA-Z]"), clean).otherwise(found)


def whitespace(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SPACED), F.lit(0))


def lowercase(tokens: Column) -> Column:
    """Lower-cases the ASCII letters only, as byte-wise lower-casing does."""
    return F.transform(tokens, lambda t: F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _ascii_lower(text: Column) -> Column:
    """text with its ASCII letters in lower case; other letters may be too, but none becomes an ASCII letter."""
    return F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a")), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def without(tokens: Column, stopwords: tuple[str, ...]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


_PLAIN = bytes(c | 0x20 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_RARE = re.compile(rb"[a-zA-Z]\.[a-zA-Z]+\.|[a-zA-Z0-9]'[a-zA-Z]")
_ENGLISH = re.compile(ENGLISH.encode())


def plain_terms(text: bytes) -> list[bytes]:
    """What english and lowercase make of a text. Without abbreviations and apostrophes terms are what stands between other bytes."""
    if not _RARE.search(text):
        return text.translate(_PLAIN).split()
    return [(t.replace(b".", b"") if b"." in t else t.split(b"'")[0]).lower() for t in _ENGLISH.findall(text)]


def split_query(query: Column) -> tuple[Column, Column]:
    """(id, rest) of a query at its first colon; the id is null where there is none."""
    has = F.instr(query, ":") > 0
    return F.when(has, F.substring_index(query, ":", 1)), F.when(has, F.substring(query, F.instr(query, ":") + 1, F.length(query))).otherwise(query)


def url_key(url: Column) -> Column:
    """The host's parts in reverse, then the rest, all other signs as dots, in lower case: a key that sorts by site."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.lower(F.regexp_replace(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), path), r"[^a-zA-Z0-9_]", "."))


TOKENIZERS: dict[str, Callable[[Column], Column]] = {"english": english, "whitespace": whitespace}
FILTERS: dict[str, Callable[[Column], Column]] = {"lowercase": lowercase, "porter2": stemmers.porter2, "krovetz": stemmers.krovetz}


@dataclass(frozen=True)
class Analyzer:
    """Text to terms: mark-up is stripped, then the tokenizer, then the filters in order, stop words last.

    Names are looked up in TOKENIZERS and FILTERS, to which own functions of Columns can be added.
    """

    tokenizer: str = "english"
    filters: tuple[str, ...] = ("lowercase",)
    stopwords: tuple[str, ...] = ()
    strip_html: bool = False

    def __post_init__(self) -> None:
        for name, known in [(self.tokenizer, TOKENIZERS), *[(f, FILTERS) for f in self.filters]]:
            if name not in known:
                raise ValueError(f"unknown: {name}; known: {', '.join(known)}")

    @property
    def is_plain(self) -> bool:
        """Whether plain_terms finds the same terms, but for stop words."""
        return not self.strip_html and self.filters == ("lowercase",) and TOKENIZERS[self.tokenizer] is english and FILTERS["lowercase"] is lowercase

    def __call__(self, text: Column) -> Column:
        """The array of terms; a null text has none."""
        text, filters = F.coalesce(html.strip(text) if self.strip_html else text, F.lit("")), self.filters
        if filters[:1] == ("lowercase",) and TOKENIZERS[self.tokenizer] is english and FILTERS["lowercase"] is lowercase:
            # Other letters separate these tokens in either case, and one text costs less than its tokens.
            text, filters = _ascii_lower(text), filters[1:]
        tokens = TOKENIZERS[self.tokenizer](text)
        for name in filters:
            tokens = FILTERS[name](tokens)
        return without(tokens, self.stopwords)
