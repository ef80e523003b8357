"""Token budget per source, language and domain.

Whole documents are hashed; each distinct text is tokenized once, and the counts
are joined back with the number of its copies per (source, lang, domain).  The
copies are counted before the shuffle, so a text that is a third of the corpus is a
handful of rows; its tokens are counted once.

``tokens`` counts every copy; ``distinct_tokens`` counts a text once in each group
where it occurs; ``share`` is the group's share of all tokens.

Edge cases: null texts count as documents without tokens (one group of copies);
blank texts are tokenized as they are; labels are compared without case, outer
space and ``_``/``-`` differences, null ones are ``unknown``; an empty table gives
an empty result; other columns, the recorded ``num_tokens`` among them, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import Merges, token_count
from ..session import cut
from . import labels


def distinct_counts(documents: DataFrame, tokenizer: Merges) -> DataFrame:
    """(h, tokens): each distinct text, by a 256-bit hash, with its number of tokens.

    The first document of each hash is found over narrow rows, and its text alone is tokenized.  The
    texts are streamed past a hash table of those first ones and never sorted; the join is by
    document as well as hash, so copies of a text are no hot key.
    """
    texts = documents.where("text is not null").select("doc_id", "text", F.sha2("text", 256).alias("h"))
    first = texts.groupBy("h").agg(F.min("doc_id").alias("first"))
    firsts = first.select(F.col("h").alias("fh"), "first").hint("shuffle_hash")
    chosen = texts.join(firsts, (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi")
    return chosen.select("h", token_count(F.col("text"), tokenizer).alias("tokens")).groupBy("h").agg(F.max("tokens").alias("tokens"))


def copies(documents: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, h, copies): how often each text occurs in each group."""
    return documents.groupBy(*keys, F.sha2("text", 256).alias("h")).agg(F.count("*").alias("copies"))


def labelled(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", labels.source(F.col("source")).alias("source"), labels.language(F.col("lang")).alias("lang"), labels.domain(F.col("domain")).alias("domain"))


def budget(documents: DataFrame, tokenizer: Merges) -> DataFrame:
    """(source, lang, domain, documents, distinct_texts, tokens, distinct_tokens, share)."""
    docs = labelled(documents)
    joined = copies(docs, ["source", "lang", "domain"]).join(distinct_counts(docs, tokenizer), "h", "left")
    n = F.coalesce("tokens", F.lit(0))
    out = joined.groupBy("source", "lang", "domain").agg(
        F.sum("copies").alias("documents"), F.count("h").alias("distinct_texts"), F.sum(n * F.col("copies")).alias("tokens"), F.sum(n).alias("distinct_tokens")
    )
    out = cut(out)
    whole = out.agg(F.sum("tokens").alias("all"))
    return out.crossJoin(F.broadcast(whole)).withColumn("share", F.when(F.col("all") > 0, F.col("tokens") / F.col("all")).otherwise(0.0)).drop("all")


def slices(documents: DataFrame, tokenizer: Merges) -> DataFrame:
    """Totals by each label alone: (label, value, documents, tokens)."""
    b = budget(documents, tokenizer)
    parts = [b.select(F.lit(k).alias("label"), F.col(k).alias("value"), "documents", "tokens") for k in ("source", "lang", "domain")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("label", "value").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
