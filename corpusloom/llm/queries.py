"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bpe import from_table
from ..session import spread
from . import filling, leakage, mixing, pairs, split_overlap, subjects, token_budget


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _tokenizer(spark: SparkSession, sf_dir: str):
    return from_table(_read(spark, sf_dir, "token_merges"))


def _seq_lens(spark: SparkSession, sf_dir: str) -> list[int]:
    return sorted({r[0] for r in _read(spark, sf_dir, "stages").select("seq_len").where("seq_len > 0").distinct().collect()})


def p1_found(spark, d):
    return pairs.broken_pairs(_read(spark, d, "conversations"))


def p1_report(spark, d):
    return pairs.defect_report(_read(spark, d, "conversations"))


def p2_budget(spark, d):
    return token_budget.budget(_read(spark, d, "documents"), _tokenizer(spark, d)).withColumn("share", F.round("share", 9))


def p2_slices(spark, d):
    return token_budget.slices(_read(spark, d, "documents"), _tokenizer(spark, d))


def p3_found(spark, d):
    return split_overlap.found(_read(spark, d, "split_records"), _read(spark, d, "stages"))


def p3_report(spark, d):
    return split_overlap.report(_read(spark, d, "split_records"), _read(spark, d, "stages"))


def p4_mix(spark, d):
    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_sources"), _tokenizer(spark, d))


def p4_shares(spark, d):
    return mixing.shares(_read(spark, d, "documents"), _read(spark, d, "mix_sources"), _tokenizer(spark, d))


def p5_rows(spark, d):
    return filling.rows(_read(spark, d, "documents"), _tokenizer(spark, d), _seq_lens(spark, d))


def p5_usage(spark, d):
    return filling.usage(_read(spark, d, "documents"), _tokenizer(spark, d), _seq_lens(spark, d))


def p6_found(spark, d):
    return leakage.found(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def p6_report(spark, d):
    return leakage.report(_read(spark, d, "documents"), _read(spark, d, "benchmark"))


def p7_found(spark, d):
    return subjects.found(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), _read(spark, d, "subjects"))


def p7_composition(spark, d):
    return subjects.composition(_read(spark, d, "documents"), _read(spark, d, "subject_labels"), _read(spark, d, "subjects"))


# ---- what can be told in SQL too: counts, shares asked for, and that no bound is broken ----


def p2_documents(spark, d):
    """Documents and different texts of each slice of the budget."""
    return p2_budget(spark, d).select("source", "lang", "domain", "documents", "distinct_texts")


def p4_check(spark, d):
    """Per entry of a mix: share asked for, documents held, and how often a bound on copies is broken."""
    docs, mixes, tok = _read(spark, d, "documents"), _read(spark, d, "mix_sources"), _tokenizer(spark, d)
    drawn = mixing.mix(docs, mixes, tok).groupBy("mix_id", "source_no", "doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("k"))
    drawn = drawn.join(F.broadcast(mixes.select("mix_id", "source_no", "remaining")), ["mix_id", "source_no"])
    per = drawn.groupBy("mix_id", "source_no").agg(F.count_if(F.col("n") > F.coalesce("remaining", "n")).alias("over_cap"), F.count_if(F.col("n") != F.col("k")).alias("twice"), (F.max("n") - F.min("n") > 1).cast("bigint").alias("uneven"))
    x = mixing.shares(docs, mixes, tok).select("mix_id", "source_no", F.round("target_share", 9).alias("target_share"), "documents")
    return x.join(per, ["mix_id", "source_no"], "left").na.fill(0, ["over_cap", "twice", "uneven"])


def p5_check(spark, d):
    """Per capacity: documents filled in, overfull rows, gaps or overlaps in rows, and short documents divided."""
    r = p5_rows(spark, d)
    rows = r.groupBy("seq_len", "row_id").agg(F.sum("tokens").alias("t"), F.max(F.col("at") + F.col("tokens")).alias("end"), F.countDistinct("at").alias("k"), F.count("*").alias("n"))
    rows = rows.groupBy("seq_len").agg(F.count_if(F.col("t") > F.col("seq_len")).alias("overfull"), F.count_if((F.col("t") != F.col("end")) | (F.col("k") != F.col("n"))).alias("gaps"))
    of = r.groupBy("seq_len", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t"))
    of = of.groupBy("seq_len").agg(F.count("*").alias("documents"), F.count_if(F.col("pieces") != F.ceil(F.col("t") / F.col("seq_len"))).alias("divided"))
    return of.join(rows, "seq_len")


def _slug(c: str) -> str:
    space = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    return f"nullif(regexp_replace(lower(regexp_replace(regexp_replace({c}, '^{space}+', ''), '{space}+$', '')), '[_\\s]+', '-', 'g'), '')"


SQL = {
    "p2_documents": f"""WITH l AS (SELECT text, coalesce({_slug('source')}, 'unknown') AS source, split_part({_slug('lang')}, '-', 1) AS g, coalesce({_slug('domain')}, 'unknown') AS domain FROM documents)
SELECT source, CASE WHEN g IS NULL OR g IN ('und', 'unknown', 'mul', 'zxx') THEN 'unknown' ELSE g END AS lang, domain, count(*) AS documents, count(DISTINCT text) AS distinct_texts FROM l GROUP BY ALL""",
    "p4_check": f"""WITH n AS (SELECT mix_id, source_no, {_slug('name')} AS s, greatest(coalesce(weight, 0), 0) AS w FROM mix_sources),
d AS (SELECT {_slug('source')} AS s, count(*) AS k FROM documents WHERE text IS NOT NULL GROUP BY 1)
SELECT mix_id, source_no, CASE WHEN sum(w) OVER (PARTITION BY mix_id) > 0 THEN round(w / sum(w) OVER (PARTITION BY mix_id), 9) ELSE 0.0 END AS target_share, coalesce(k, 0) AS documents, 0::BIGINT AS over_cap, 0::BIGINT AS twice, 0::BIGINT AS uneven
FROM n LEFT JOIN d USING (s)""",
    "p5_check": """WITH s AS (SELECT DISTINCT seq_len FROM stages WHERE seq_len > 0), d AS (SELECT count(DISTINCT doc_id) AS documents FROM documents WHERE text <> '')
SELECT seq_len, documents, 0::BIGINT AS divided, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM s, d""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p1_found, p1_report, p2_budget, p2_slices, p2_documents, p3_found, p3_report, p4_mix, p4_shares, p4_check, p5_rows, p5_usage, p5_check, p6_found, p6_report, p7_found, p7_composition)
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    """Of what these operators give, only counts, shares asked for and broken bounds can be put in SQL; the rest is tested against brute force and invariants."""
    return dict(SQL)
