"""Text as Spark columns, and as plain Python for Arrow-batched functions."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space Python's ``\s`` knows, in Java's dialect.
JAVA_SPACE = r"(?U)[\s\x1c-\x1f]"
# The line ends of ``str.splitlines``.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# Symbols that count as punctuation in the quality rule.
PUNCT = "!@#$%^&*()_+=[]{}|;:'\",.<>/?~`"

# Role aliases.
ROLE_ALIASES = {
    "user": "user", "human": "user", "prompter": "user",
    "assistant": "assistant", "gpt": "assistant", "bot": "assistant",
    "system": "system", "tool": "tool", "function": "tool",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def collapse(text: Column) -> Column:
    """Lower case, white space runs to one blank, outer space off."""
    return F.trim(F.regexp_replace(F.lower(text), JAVA_SPACE + "+", " "))


def strip_space(text: Column) -> Column:
    """Outer white space off, by the Unicode notion of white space."""
    return F.regexp_replace(text, rf"^{JAVA_SPACE}+|{JAVA_SPACE}+$", "")


def lines(text: Column) -> Column:
    """Non-blank lines."""
    return F.filter(F.split(text, LINE_ENDS, -1), lambda x: F.length(strip_space(x)) > 0)


def words(text: Column) -> Column:
    """Words of the collapsed text."""
    return F.filter(F.split(collapse(text), " ", -1), lambda w: w != "")


def word_ngrams(ws: Column, n: int) -> Column:
    """Word n-grams; a shorter text is one gram, an empty one none.  Give a column and no expression."""
    whole = F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(ws, " ")))
    return F.when(F.size(ws) < n, whole).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " "))
    )


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_shingles(chars: Column, n: int = 5) -> Column:
    """Distinct character n-grams, from a column of characters; give a column and no
    expression, since every gram refers to it."""
    whole = F.when(F.size(chars) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(chars, "")))
    return F.when(F.size(chars) < n, whole).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.array_join(F.slice(chars, i, n), "")))
    )


def role(raw: Column) -> Column:
    """A role by its alias; unknown ones lower-cased, missing ones ``unknown``."""
    key = F.lower(strip_space(F.coalesce(raw, F.lit(""))))
    out = F.when(key == "", F.lit("unknown"))
    for alias, name in ROLE_ALIASES.items():
        out = out.when(key == alias, F.lit(name))
    return out.otherwise(key)


# ---- plain Python, used inside Arrow-batched functions ----------------------

_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9:-]*(?:\s+[^<>]{0,400})?\s*/?>|<!--.*?-->", re.S)
_SPECIAL = re.compile(r"<\|[^|<>]{0,60}\|>")
_JSON_U = re.compile(r"\\u([0-9a-fA-F]{4})")
_JSON_C = re.compile(r"\\([nrt\"/])")
_SOFT = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010]\r?\n[ \t>]*(?=[^\W\d_])")
_MOJI = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u20ac\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u017d\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u017e\u0178]{1,3}")
_WORD = re.compile(r"[^\W_]+")


def _demojibake(m: re.Match) -> str:
    s = m.group(0)
    for codec in ("latin-1", "cp1252"):
        try:
            return s.encode(codec).decode("utf-8")
        except UnicodeError:
            continue
    return s


def unwrap(text: str) -> str:
    """Undo escaping, entities, tags, soft hyphens, broken encoding and line-end hyphens."""
    t = text
    if "\\" in t:
        t = _JSON_C.sub(lambda m: {"n": "\n", "r": "\n", "t": "\t"}.get(m.group(1), m.group(1)), _JSON_U.sub(lambda m: chr(int(m.group(1), 16)), t))
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _SPECIAL.sub(" ", _TAG.sub(" ", t))
    t = _SOFT.sub("", t)
    t = _MOJI.sub(_demojibake, t)
    if "-\n" in t or "-\r" in t or "\u2010" in t:
        t = _HYPHEN.sub("", t)
    return t


@functools.cache
def _marks() -> re.Pattern:
    """All combining characters, as ranges made from the character table."""
    out, start, last = [], None, None
    for i in range(0x300, 0x1F000):
        if unicodedata.combining(chr(i)):
            if start is None:
                start = i
            last = i
        elif start is not None:
            out.append(f"{chr(start)}-{chr(last)}")
            start = None
    return re.compile("[" + "".join(out) + "]+")


def fold(text: str) -> str:
    """Case and accents off."""
    t = unicodedata.normalize("NFKD", text)
    return (t if t.isascii() else _marks().sub("", t)).casefold()


def plain_words(text: str | None) -> list[str]:
    """Words only: without case, accents, markup, escaping and punctuation."""
    return _WORD.findall(fold(unwrap(text))) if text else []
