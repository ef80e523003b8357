"""Stateless filters and annotations.  Each is ``DataFrame -> DataFrame`` on a ``text`` column.

Null texts count as empty ones.  All predicates are built-in expressions, so they
run inside generated code and simple ones reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

Transform = Callable[[DataFrame], DataFrame]

# Keywords that open a line of code, and the other marks of one.
CODE_KEYWORDS = (
    "def class import from return if elif else for while try except finally function const let var public private protected static int void "
    "float char double bool #include struct using namespace package interface enum print echo yield lambda"
).split()
CODE_LINE = r"^(?:" + "|".join(CODE_KEYWORDS) + r")\b|[{};]$|[^=<>!]=[^=<>!]|->|=>|^`{3}|^~{3}"
BULLET_LINE = r"^[\s]*([-*#>]|\d+[.)])"
SENTENCE_MARK = r"[.!?。！？]"


class Step:
    """A stateless transform: ``add`` gives columns, ``keep`` tells which rows stay, ``drop`` names helpers that go.

    Called, it filters.  ``mark`` leaves all rows and names the first step that would have dropped each, so that
    a whole chain is counted in one pass.
    """

    def __init__(self, keep: Column | Callable[[DataFrame], Column] | None = None, add: Transform | None = None, drop: Sequence[str] = ()) -> None:
        self.keep, self.add, self.drop = keep, add, drop

    def _with(self, df: DataFrame) -> tuple[DataFrame, Column | None]:
        out = self.add(df) if self.add else df
        return out, self.keep(out) if callable(self.keep) else self.keep

    def __call__(self, df: DataFrame) -> DataFrame:
        out, keep = self._with(df)
        return (out if keep is None else out.where(keep)).drop(*self.drop)

    def mark(self, df: DataFrame, name: str, column: str = "_dropped") -> DataFrame:
        out, keep = self._with(df)
        if keep is not None:
            gone = F.when(F.col(column).isNull(), F.when(F.coalesce(keep, F.lit(False)), F.lit(None)).otherwise(F.lit(name)))
            out = out.withColumn(column, F.coalesce(F.col(column), gone))
        return out.drop(*self.drop)


class Chain(Step):
    """Steps in order, as one."""

    def __init__(self, steps: Sequence[Step]) -> None:
        self.steps = list(steps)

    def __call__(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s(df)
        return df

    def mark(self, df: DataFrame, name: str, column: str = "_dropped") -> DataFrame:
        for s in self.steps:
            df = s.mark(df, name, column)
        return df


def _text(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def length_filter(min_chars: int = 50, max_chars: int = 10_000_000) -> Step:
    """Keep texts of min_chars to max_chars characters, both included."""
    return Step(F.length(_text()).between(min_chars, max_chars))


def quality_features(df: DataFrame) -> DataFrame:
    """Adds ``q``: characters, shares of the commonest character, symbols, newlines and bullet lines, and sentence marks."""
    t, n = _text(), F.length(_text())
    share = lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    # The characters in order make one run of each; the longest is the commonest.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(t, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    most = F.array_max(F.transform(runs, F.length))
    bullet = T.let(T.lines(t), lambda ls: F.when(F.size(ls) > 0, F.size(F.filter(ls, lambda x: x.rlike("(?U)" + BULLET_LINE))) / F.size(ls)).otherwise(F.lit(0.0)))
    return df.withColumn(
        "q",
        F.struct(
            n.alias("n_chars"), share(most).alias("top_char"), share(n - F.length(F.translate(t, T.PUNCT, ""))).alias("punct"), share(n - F.length(F.replace(t, F.lit("\n"), F.lit("")))).alias("newline"),
            bullet.alias("bullet"), F.regexp_count(t, F.lit(SENTENCE_MARK)).alias("sentences"),
        ),
    )


def quality_ok(max_top: float = 0.2, max_punct: float = 0.35, max_newline: float = 0.25, max_bullet: float = 0.5, min_sentences: int = 1) -> Column:
    """Whether the features ``q`` are those of prose; a share above its bound is not."""
    q = F.col("q")
    return (q.n_chars > 0) & (q.top_char <= max_top) & (q.punct <= max_punct) & (q.newline <= max_newline) & (q.bullet <= max_bullet) & (q.sentences >= min_sentences)


def quality_filter(max_top: float = 0.2, max_punct: float = 0.35, max_newline: float = 0.25, max_bullet: float = 0.5, min_sentences: int = 1) -> Step:
    """Drop texts that look like spam, symbols, blank lines or lists."""
    return Step(quality_ok(max_top, max_punct, max_newline, max_bullet, min_sentences), quality_features, ["q"])


def code_ratio(df: DataFrame) -> DataFrame:
    """Adds ``code_ratio``: the share of non-blank lines that look like code; null where there are none."""
    ratio = lambda ls: F.when(F.size(ls) > 0, F.size(F.filter(ls, lambda x: x.rlike(CODE_LINE))) / F.size(ls))
    return df.withColumn("code_ratio", T.let(F.transform(T.lines(_text()), T.strip_space), ratio))


def code_filter(mode: str = "keep", min_ratio: float = 0.3) -> Step:
    """Keep or drop texts whose lines are code by at least min_ratio; texts without lines are not code."""
    if mode not in ("keep", "drop"):
        raise ValueError("mode must be 'keep' or 'drop'")
    is_code = F.coalesce(F.col("code_ratio") >= min_ratio, F.lit(False))
    return Step(is_code if mode == "keep" else ~is_code, code_ratio, ["code_ratio"])


def blacklist_regex(patterns: Sequence[str]) -> Step:
    """Drop texts in which any pattern is found (Java's dialect)."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | _text().rlike(p)
    return Step(~hit)


def url_blacklist(domains: Sequence[str]) -> Step:
    """Drop records whose url (or, without one, source) contains a domain."""

    def keep(df: DataFrame) -> Column:
        at = F.lit(None).cast("string")
        for c in ("source", "url"):
            if c in df.columns:
                at = F.coalesce(F.nullif(F.col(c), F.lit("")), at)
        hit = F.lit(False)
        for d in domains:
            hit = hit | F.coalesce(at.contains(d), F.lit(False))
        return ~hit

    return Step(keep)


def regex_filter(pattern: str, invert: bool = False) -> Step:
    return Step(~_text().rlike(pattern) if invert else _text().rlike(pattern))


def byte_token_count(df: DataFrame) -> DataFrame:
    """Adds ``num_tokens``: UTF-8 bytes, the count of a byte-level tokenizer without merges."""
    return df.withColumn("num_tokens", F.octet_length(_text()).cast("bigint"))


def field_remap(text_field: str, keep_other_fields: bool = True) -> Step:
    """Take ``text`` from another field; records without it are dropped."""
    return Step(F.col("text").isNotNull(), lambda df: df.withColumn("text", F.col(text_field)), [] if keep_other_fields or text_field == "text" else [text_field])


def keep_fields(fields: Sequence[str]) -> Transform:
    """Only the named fields, as far as they are there, and a pipeline's own (with ``_`` in front)."""
    return Step(add=lambda df: df.select(*[c for c in df.columns if c in fields or c.startswith("_") and c not in ("_id",)]))


def language_filter(allow: Sequence[str] = (), drop_unknown: bool = False, detect: Callable[[Column], Column] | None = None) -> Step:
    """Sets ``lang`` where it can be told; with ``allow`` drops other and unknown languages.

    ``detect`` is another way to tell a text's language, as a column that is null where it can't.
    """
    from .langid import identify

    def add(df: DataFrame) -> DataFrame:
        own = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")
        return df.withColumn("_id", (detect or identify)(_text())).withColumn("lang", F.coalesce("_id", own))

    keep = F.coalesce(F.col("_id").isin(*allow), F.lit(False)) if allow else F.col("_id").isNotNull() if drop_unknown else None
    return Step(keep, add, ["_id"])


def token_counts(tokenizer=None) -> Step:
    """Adds ``num_tokens`` under a tokenizer, without bos and eos; without one, UTF-8 bytes."""
    from . import tokenizer as tk

    if tokenizer is None:
        return Step(add=byte_token_count)
    return Step(add=lambda df: df.withColumn("num_tokens", F.size(tk.encode(_text(), tokenizer)).cast("bigint")))


def chain(*steps: Transform) -> Transform:
    """Steps in order."""
    if not steps:
        raise ValueError("a chain needs at least one step")
    if all(isinstance(s, Step) for s in steps):
        return Chain(steps)

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run
