"""Tokenisation and string functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The signs that are stripped from both ends of a token, and the sentence marks.
PUNCTUATION = ".,;:!?\"'()[]{}|$%&*#-"
BOS, EOS = "<s>", "</s>"


def trim_set(c: Column, signs: str) -> Column:
    return F.btrim(c, F.lit(signs))


def _class(signs: str) -> str:
    return "[" + "".join("\\" + s if s in "\\]^-[&" else s for s in signs) + "]"


def split_set(c: Column, signs: str) -> Column:
    """Every sign delimits; empty tokens are dropped."""
    return F.filter(F.split(c, _class(signs)), lambda x: x != "")


def split_multi(c: Column, delimiter: str) -> Column:
    """A delimiter of several signs; inner empties stay, an empty last part goes."""
    parts = F.split(c, r"\Q" + delimiter + r"\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def numbers(parts: Column, kind: str = "int") -> Column:
    """Tokens as numbers; what is no number becomes null."""
    return F.transform(parts, lambda x: x.try_cast(kind))


def tokens(text: Column, signs: str = PUNCTUATION) -> Column:
    """White-space tokens in lower case without surrounding punctuation; empty ones are dropped."""
    return F.filter(F.transform(F.split(F.lower(text), r"\s+"), lambda x: F.btrim(x, F.lit(signs))), lambda x: x != "")


def padded(words: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), words, F.array(F.lit(EOS)))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)", 1)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_body(html: Column, most: int = 400) -> Column:
    """Text between tags, in pieces shorter than `most` made of letters, digits, white space and common punctuation only."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "\n<>"), r"(?is)<title[^>]*>.*?</title>", "\n<>")
    pieces = F.transform(F.split(bare, r"<[^>]*>"), lambda x: F.trim(x))
    return F.array_join(F.filter(pieces, lambda x: (x != "") & (F.length(x) < most) & x.rlike(r"^[A-Za-z0-9\s.,;:!?'\"()/_-]+$")), " ")


def spans(words: Column, longest: int) -> Column:
    """All contiguous spans (start from 1, length) up to a length."""
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.struct(i.alias("start"), n.alias("len"), F.array_join(F.slice(words, i, n), " ").alias("span")))))
