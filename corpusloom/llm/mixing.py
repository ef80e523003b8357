"""Mixing sources to target weights by systematic sampling.

For every mix, a source of T tokens with share s of all weights is to give s * N
tokens, N being the size of the mix; its documents are expected s * N / T times each,
at most ``remaining`` times (null: no cap).  Within a source the documents lie in the
order of (tokens, doc_id); their expected copies are prefix-summed from one random
offset, and a document is given out once for each whole number its stretch crosses.
So each comes floor or ceil of its expected copies, never more than ``remaining``
times, and since the order is by length, the tokens reached follow the rate closely.

N is ``size`` tokens, or else as many as the sources named in the mix hold in all.  A
source that is capped, or has no documents, falls short; the others keep their size,
and the report gives the shares reached.

The rank within a source comes from a range partition with partition totals
(``operators.order``), so a source that is a third of all rows spreads over tasks.

Edge cases: null texts are no records; texts without tokens are drawn like others;
weights null, negative or 0 draw nothing; weights need not add up to 1; ``remaining``
below 1 draws nothing; a source named twice in a mix is drawn for each of its
entries; names are compared without case, outer space and ``_``/``-`` differences;
an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bpe import Merges, token_count
from ..operators.order import position
from ..session import cut
from . import labels

#: Seed of the random offsets.
SEED = 20240501


def sized(documents: DataFrame, tokenizer: Merges) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a text."""
    return documents.where("text is not null and doc_id is not null").select("doc_id", labels.slug(F.col("source")).alias("source"), token_count(F.col("text"), tokenizer).alias("tokens"))


def rates(per_source: DataFrame, mixes: DataFrame, size: int | None = None) -> DataFrame:
    """Per entry of a mix: its share, the source's documents and tokens, and the expected copies of each document."""
    named = mixes.select("mix_id", "source_no", "name", labels.slug(F.col("name")).alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), "remaining")
    x = named.join(per_source, "source", "left").na.fill(0, ["documents", "tokens_held"])
    # Mixes are a handful of entries each, so groups by mix stay small.
    held = x.groupBy("mix_id", "source").agg(F.max("tokens_held").alias("t")).groupBy("mix_id").agg(F.sum("t").alias("natural"))
    weights = named.groupBy("mix_id").agg(F.sum("weight").alias("all_weight"))
    x = x.join(held, "mix_id").join(weights, "mix_id")
    x = x.withColumn("target_share", F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(0.0))
    n = F.lit(size).cast("double") if size is not None else F.col("natural").cast("double")
    want = F.when(F.col("tokens_held") > 0, F.col("target_share") * n / F.col("tokens_held")).otherwise(0.0)
    cap = F.greatest(F.col("remaining"), F.lit(0)).cast("double")
    return x.withColumn("wanted_passes", want).withColumn("rate", F.when(F.col("remaining").isNull(), want).otherwise(F.least(want, cap)))


def _offset():
    """One number in [0, 1) per entry of a mix."""
    return F.pmod(F.xxhash64(F.lit(SEED), "mix_id", "source_no", "source"), F.lit(1 << 40)) / float(1 << 40)


def _plan(documents: DataFrame, mixes: DataFrame, tokenizer: Merges, size: int | None):
    # Only documents of sources that some mix names are tokenized; the mixes' names are a few.
    named = mixes.select(labels.slug(F.col("name")).alias("_named")).where("_named is not null").distinct()
    documents = documents.select("doc_id", "text", "source").join(F.broadcast(named), labels.slug(F.col("source")) == F.col("_named"), "left_semi")
    docs = cut(sized(documents, tokenizer))
    per_source = docs.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens_held"))
    plan = cut(rates(per_source, mixes, size).withColumn("offset", _offset()))
    ranked = position(docs, ["tokens", "doc_id"], "rank", ["source"])
    drawn = ranked.join(F.broadcast(plan.where("rate > 0").select("mix_id", "source_no", "name", "source", "rate", "offset", "remaining")), "source")
    lo, hi = F.floor(F.col("rank") * F.col("rate") + F.col("offset")), F.floor((F.col("rank") + 1) * F.col("rate") + F.col("offset"))
    # Rounding of doubles must never break a cap, however far the prefix sum has come.
    times = F.when(F.col("remaining").isNull(), hi - lo).otherwise(F.least(hi - lo, F.col("remaining")))
    drawn = drawn.withColumn("copies", times).where("copies > 0")
    return plan, drawn


def mix(documents: DataFrame, mixes: DataFrame, tokenizer: Merges, size: int | None = None) -> DataFrame:
    """(mix_id, source_no, name, doc_id, copy_no, tokens): one row per copy of a document in a mix."""
    _, drawn = _plan(documents, mixes, tokenizer, size)
    return drawn.select("mix_id", "source_no", "name", "doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy_no"), "tokens")


def shares(documents: DataFrame, mixes: DataFrame, tokenizer: Merges, size: int | None = None) -> DataFrame:
    """Per entry of a mix: the target share, the share reached, tokens, documents and the most passes over one."""
    plan, drawn = _plan(documents, mixes, tokenizer, size)
    got = drawn.groupBy("mix_id", "source_no").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("records"), F.max("copies").alias("most_passes"))
    x = cut(plan.join(got, ["mix_id", "source_no"], "left").na.fill(0, ["tokens", "records", "most_passes"]))
    total = x.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    x = x.join(total, "mix_id")
    reached = F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0)
    capped = (F.col("remaining").isNotNull() & (F.col("wanted_passes") > F.col("rate"))) | ((F.col("target_share") > 0) & (F.col("tokens_held") == 0))
    return x.select("mix_id", "source_no", "name", "target_share", reached.alias("actual_share"), "tokens", "records", "documents", "remaining", "most_passes", capped.alias("short"))
