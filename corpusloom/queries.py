"""Queries of the core operators over whole tables, with equivalent SQL for DuckDB where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import schedules as S
from .functions import text as T
from .operators import bpe, chat, contamination, dedup, filters, langid, mix, pack, prepare, stats, validate
from .operators import tokenizer as tk
from .operators.order import prefix_sum
from .session import spread
from .sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = re.sub(r"(?<![\w'])([a-z]) -> ", r"lambda \1: ", sql)
        return f

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/{name}.parquet"))


# ---- pieces of SQL ----------------------------------------------------------

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
STRIP = f"regexp_replace(regexp_replace(%s, '^{WS}+', ''), '{WS}+$', '')"
TEXT = "coalesce(text, '')"
NORM = f"trim(regexp_replace(lower(coalesce(text, '')), '{WS}+', ' ', 'g'))"
LINES = rf"list_filter(regexp_split_to_array({TEXT}, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), x -> {STRIP % 'x'} <> '')"
WORDS = f"list_filter(string_split({NORM}, ' '), x -> x <> '')"
PUNCT_SQL = T.PUNCT.replace("'", "''")
QUALITY_SQL = f"""
WITH t AS (SELECT doc_id, source, {TEXT} AS text, {LINES} AS ls, length({TEXT})::DOUBLE AS n FROM documents),
q AS (
  SELECT doc_id, source, text, n::BIGINT AS n_chars,
    CASE WHEN n > 0 THEN list_max(list_transform(list_distinct(string_split(text, '')), c -> n - length(replace(text, c, '')))) / n ELSE 0.0 END AS top_char,
    CASE WHEN n > 0 THEN (n - length(translate(text, '{PUNCT_SQL}', ''))) / n ELSE 0.0 END AS punct,
    CASE WHEN n > 0 THEN (n - length(replace(text, chr(10), ''))) / n ELSE 0.0 END AS newline,
    CASE WHEN len(ls) > 0 THEN len(list_filter(ls, x -> regexp_matches(x, '^{WS}*([-*#>]|\\d+[.)])')))::DOUBLE / len(ls) ELSE 0.0 END AS bullet,
    len(regexp_extract_all(text, '[.!?。！？]'))::BIGINT AS sentences
  FROM t)
"""
QUALITY_OK = "n_chars > 0 AND top_char <= 0.2 AND punct <= 0.35 AND newline <= 0.25 AND bullet <= 0.5 AND sentences >= 1"
CODE_SQL = (
    r"^(?:" + "|".join(filters.CODE_KEYWORDS) + r")\b|[{};]$|[^=<>!]=[^=<>!]|->|=>|^`{3}|^~{3}"
)
RATIO_SQL = f"""
WITH t AS (SELECT doc_id, list_transform({LINES}, x -> {STRIP % 'x'}) AS ls FROM documents),
r AS (SELECT doc_id, CASE WHEN len(ls) > 0 THEN len(list_filter(ls, x -> regexp_matches(x, '{CODE_SQL}')))::DOUBLE / len(ls) END AS code_ratio FROM t)
"""


# ---- filters ----------------------------------------------------------------


@query(QUALITY_SQL + f""", k AS (SELECT *, sha256({NORM}) AS d FROM q WHERE n_chars BETWEEN 50 AND 10000000 AND {QUALITY_OK}),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY d ORDER BY doc_id) = 1)
SELECT coalesce(source, 'unknown') AS source, count(*) AS records FROM f GROUP BY 1""")
def corpus_manifest(spark, d):
    kept = filters.chain(filters.length_filter(), filters.quality_filter())(docs(spark, d).select("doc_id", "text", "source"))
    return mix.source_counts(dedup.exact(kept, keep=["source"]))


@query(f"SELECT doc_id FROM documents WHERE length({TEXT}) BETWEEN 50 AND 10000000")
def length_filter(spark, d):
    return filters.length_filter()(docs(spark, d)).select("doc_id")


@query(QUALITY_SQL + "SELECT doc_id, n_chars, round(top_char, 9) AS top_char, round(punct, 9) AS punct, round(newline, 9) AS newline, round(bullet, 9) AS bullet, sentences FROM q")
def quality_features(spark, d):
    q = F.col("q")
    x = filters.quality_features(docs(spark, d).select("doc_id", "text"))
    return x.select("doc_id", q.n_chars.cast("bigint").alias("n_chars"), *(F.round(q[c], 9).alias(c) for c in ("top_char", "punct", "newline", "bullet")), q.sentences.cast("bigint").alias("sentences"))


@query(QUALITY_SQL + f"SELECT doc_id FROM q WHERE {QUALITY_OK}")
def quality_filter(spark, d):
    return filters.quality_filter()(docs(spark, d).select("doc_id", "text")).select("doc_id")


@query(RATIO_SQL + "SELECT doc_id, round(code_ratio, 9) AS code_ratio FROM r")
def code_ratio(spark, d):
    return filters.code_ratio(docs(spark, d).select("doc_id", "text")).select("doc_id", F.round("code_ratio", 9).alias("code_ratio"))


@query(RATIO_SQL + "SELECT doc_id FROM r WHERE code_ratio >= 0.3")
def code_keep(spark, d):
    return filters.code_filter("keep")(docs(spark, d)).select("doc_id")


@query(RATIO_SQL + "SELECT doc_id FROM r WHERE code_ratio IS NULL OR code_ratio < 0.3")
def code_drop(spark, d):
    return filters.code_filter("drop")(docs(spark, d)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({TEXT}, '[0-9]{{4}}')")
def regex_keep(spark, d):
    return filters.regex_filter("[0-9]{4}")(docs(spark, d)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT regexp_matches({TEXT}, '[0-9]{{4}}')")
def regex_invert(spark, d):
    return filters.regex_filter("[0-9]{4}", invert=True)(docs(spark, d)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT (regexp_matches({TEXT}, '(?i)cookies?') OR regexp_matches({TEXT}, 'enable scripts'))")
def blacklist_regex(spark, d):
    return filters.blacklist_regex(["(?i)cookies?", "enable scripts"])(docs(spark, d)).select("doc_id")


@query("""WITH u AS (SELECT doc_id, coalesce(nullif(url, ''), nullif(source, '')) AS place FROM documents)
SELECT doc_id FROM u WHERE NOT coalesce(contains(place, 'tinwhistle.example') OR contains(place, 'quarrel'), false)""")
def url_blacklist(spark, d):
    return filters.url_blacklist(["tinwhistle.example", "quarrel"])(docs(spark, d)).select("doc_id")


@query("SELECT doc_id, url AS text FROM documents WHERE url IS NOT NULL")
def field_remap(spark, d):
    return filters.field_remap("url", keep_other_fields=False)(docs(spark, d)).select("doc_id", "text")


@query(f"SELECT doc_id, strlen({TEXT})::BIGINT AS num_tokens FROM documents")
def byte_token_count(spark, d):
    return filters.byte_token_count(docs(spark, d).select("doc_id", "text")).select("doc_id", "num_tokens")


def _lang_sql() -> str:
    scripts = " ".join(f"WHEN regexp_matches(t, '{rx}') THEN '{code}'" for code, rx in langid.SCRIPTS)
    lists = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in langid.STOPWORDS.items()}
    ballots = ", ".join(f"{{'v': len(list_filter(ws, w -> list_contains({v}, w))), 'f': -list_position(list_transform(ws, w -> list_contains({v}, w)), true), 'o': {-n}, 'l': '{k}'}}" for n, (k, v) in enumerate(lists.items()))
    pairs = "[" + ", ".join(f"'{p}'" for p in langid.EN_PAIRS) + "]"
    return f"""
WITH t AS (SELECT doc_id, lang, substr({TEXT}, 1, {langid.SAMPLE}) AS t FROM documents),
w AS (SELECT *, regexp_extract_all(lower(t), '[A-Za-zÀ-ÿ'']+') AS ws, regexp_replace(lower(t), '[^a-z]', '', 'g') AS s FROM t),
b AS (SELECT *, list_max([{ballots}]) AS best FROM w),
g AS (SELECT doc_id, lang, CASE WHEN {STRIP % 't'} = '' THEN NULL {scripts} WHEN best.v > 0 THEN best.l WHEN length(s) < 200 THEN 'en'
  WHEN len(list_filter(list_transform(range(1, length(s)), i -> substr(s, i, 2)), p -> list_contains({pairs}, p)))::DOUBLE / (length(s) - 1) > 0.06 THEN 'en' END AS id FROM b)
"""


@query(_lang_sql() + "SELECT doc_id, id AS lang FROM g")
def lang_id(spark, d):
    return docs(spark, d).select("doc_id", langid.identify(F.coalesce("text", F.lit(""))).alias("lang"))


@query(_lang_sql() + "SELECT doc_id, id AS lang FROM g WHERE id IN ('en', 'fr')")
def lang_filter(spark, d):
    return filters.language_filter(["en", "fr"])(docs(spark, d)).select("doc_id", "lang")


# ---- dedup ------------------------------------------------------------------


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256({NORM})")
def exact_dedup(spark, d):
    return dedup.exact(docs(spark, d)).select("doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {TEXT}")
def exact_dedup_raw(spark, d):
    return dedup.exact(docs(spark, d), normalize=False).select("doc_id")


@query(f"""WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {NORM}) AS first FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY first) AS k FROM f) SELECT doc_id FROM r WHERE doc_id = first OR k > 300""")
def exact_dedup_capped(spark, d):
    return dedup.exact_capped(docs(spark, d), 300).select("doc_id")


SHINGLES = f"""n AS (SELECT doc_id, {NORM} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t = '' THEN [] WHEN length(t) < 5 THEN [t] ELSE list_distinct(list_transform(range(1, length(t) - 3), i -> substr(t, i, 5))) END AS g FROM n)"""


@query(f"WITH {SHINGLES} SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s")
def shingle_counts(spark, d):
    return dedup.shingle_counts(docs(spark, d).select("doc_id", "text")).select("doc_id", "n_shingles")


def _minhash_sql() -> str:
    mins = ", ".join(f"min((h * {a}::HUGEINT + {b}::HUGEINT) % {dedup.PRIME}::HUGEINT)::BIGINT AS m{i}" for i, (a, b) in enumerate(dedup.family()))
    return f"WITH {SHINGLES}, x AS (SELECT doc_id, concat('0x', substr(md5(unnest(g)), 1, 8))::BIGINT::HUGEINT AS h FROM s), m AS (SELECT doc_id, {mins} FROM x GROUP BY doc_id)"


@query(_minhash_sql() + " SELECT doc_id, concat_ws(',', " + ", ".join(f"m{i}" for i in range(64)) + ") AS signature FROM m")
def minhash_signature(spark, d):
    return docs(spark, d).select("doc_id", dedup.signature(F.col("text")).alias("s")).where("s is not null").select("doc_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("signature"))


def _lsh_sql() -> str:
    keys = ", ".join("concat_ws(',', " + ", ".join(f"m{b * 8 + r}" for r in range(8)) + f") AS k{b}" for b in range(8))
    out = _minhash_sql() + f", a AS (SELECT doc_id, {keys} FROM m)"
    at = "a"
    for b in range(8):
        out += f", a{b} AS (SELECT * FROM {at} QUALIFY row_number() OVER (PARTITION BY k{b} ORDER BY doc_id) = 1)"
        at = f"a{b}"
    return out + f" SELECT doc_id FROM {at}"


@query(_lsh_sql())
def lsh_near_dedup(spark, d):
    return dedup.near(docs(spark, d)).select("doc_id")


def _lsh_capped_sql(cap: int) -> str:
    keys = ", ".join(f"'{b}:' || concat_ws(',', " + ", ".join(f"m{b * 8 + r}" for r in range(8)) + ")" for b in range(8))
    return ("WITH RECURSIVE " + _minhash_sql().removeprefix("WITH ") + f""", a AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n, [{keys}] AS ks FROM m),
r AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS doc_id, false AS kept, []::VARCHAR[] AS seen
UNION ALL SELECT n, doc_id, NOT (j < 8 AND j <= {cap} - len(seen)), list_concat(seen, ks[1:least(j, {cap} - len(seen))])
FROM (SELECT a.n, a.doc_id, a.ks, r.seen, coalesce(list_position(list_transform(a.ks, k -> list_contains(r.seen, k)), true) - 1, 8) AS j FROM r JOIN a ON a.n = r.n + 1))
SELECT doc_id FROM r WHERE kept""")


@query(_lsh_capped_sql(2000))
def lsh_near_dedup_capped(spark, d):
    return dedup.near_capped(docs(spark, d).select("doc_id", dedup.signature(F.col("text")).alias("sig")), "doc_id", 2000)


# ---- contamination ----------------------------------------------------------


@query("SELECT doc_id FROM documents WHERE NOT coalesce(trim(url) IN (SELECT trim(url) FROM documents WHERE url IS NOT NULL AND lang = 'fr'), false)")
def contam_ids(spark, d):
    x = docs(spark, d)
    listed = x.where("url is not null and lang = 'fr'").select(F.col("url").alias("id"))
    return contamination.apply(x, contamination.hits_by_id(x, listed, "doc_id"), "doc_id").select("doc_id")


NEEDLES = ["This page is empty for now.", "beside a glove", "Critics in"]


@query(f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(f'contains({NORM}, ' + repr(n.lower()) + ')' for n in NEEDLES)})")
def contam_substring(spark, d):
    x = docs(spark, d)
    return contamination.apply(x, contamination.hits_by_substring(x, NEEDLES, "doc_id"), "doc_id").select("doc_id")


EIGHTS = "CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 8 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 6), i -> array_to_string(list_slice(ws, i, i + 7), ' ')) END"
HITS = f"""bw AS MATERIALIZED (SELECT {WORDS} AS ws FROM benchmark), dw AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
g AS (SELECT DISTINCT unnest({EIGHTS}) AS g FROM bw), h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({EIGHTS}) AS g FROM dw) WHERE g IN (SELECT g FROM g))"""


@query(f"WITH {HITS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)")
def contam_ngram_drop(spark, d):
    x = docs(spark, d)
    return contamination.apply(x, contamination.hits_by_ngram(x, table(spark, d, "benchmark"), 8, "doc_id"), "doc_id").select("doc_id")


@query(f"WITH {HITS} SELECT d.doc_id, CASE WHEN h.doc_id IS NOT NULL THEN true END AS contaminated FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id")
def contam_flag(spark, d):
    x = docs(spark, d)
    return contamination.apply(x, contamination.hits_by_ngram(x, table(spark, d, "benchmark"), 8, "doc_id"), "doc_id", "flag").select("doc_id", "contaminated")


# ---- counts, order, mixing --------------------------------------------------


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS records FROM documents GROUP BY 1")
def source_counts(spark, d):
    return mix.source_counts(docs(spark, d))


@query(QUALITY_SQL + f""", s AS (SELECT n_chars BETWEEN 50 AND 10000000 AS a, {QUALITY_OK} AS b FROM q)
SELECT count(*) AS input, count(*) FILTER (a AND b) AS kept, count(*) FILTER (NOT a) AS dropped_length, count(*) FILTER (a AND NOT b) AS dropped_quality FROM s""")
def pipeline_stats(spark, d):
    x = docs(spark, d).select("text", F.lit(None).cast("string").alias("_dropped"))
    x = filters.quality_filter().mark(filters.length_filter().mark(x, "length"), "quality")
    gone = F.col("_dropped")
    return x.agg(F.count("*").alias("input"), F.count_if(gone.isNull()).alias("kept"), F.count_if(gone == "length").alias("dropped_length"), F.count_if(gone == "quality").alias("dropped_quality"))


@query("""WITH i AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS shard, coalesce(source, 'unknown') AS s FROM documents),
c AS (SELECT shard, s, count(*) AS n FROM i GROUP BY ALL)
SELECT printf('shard-%04d.jsonl', shard) AS shard, shard AS index, sum(n)::BIGINT AS count, string_agg(s || '=' || n, ',' ORDER BY s) AS sources FROM c GROUP BY ALL""")
def shard_manifest(spark, d):
    m = writers.manifest(writers.shard_ids(docs(spark, d).select("doc_id", "source"), "doc_id", 128))
    pairs = F.transform(F.sort_array(F.map_entries("sources")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("shard", "index", "count", F.array_join(pairs, ",").alias("sources"))


@query(f"""WITH RECURSIVE i AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS n, strlen(to_json({{'text': text, 'source': source}})) + 1 AS b FROM documents),
r AS (SELECT 0::BIGINT AS n, 0::BIGINT AS shard, 0::BIGINT AS used, 0::BIGINT AS held, 0::BIGINT AS next
UNION ALL SELECT i.n, next, CASE WHEN shut THEN 0 ELSE u END, CASE WHEN shut THEN 0 ELSE h END, CASE WHEN shut THEN next + 1 ELSE next END
FROM (SELECT i.n, r.next, r.used + i.b AS u, r.held + 1 AS h, r.used + i.b >= 200000 OR r.held + 1 >= {writers.MOST_RECORDS} AS shut FROM r JOIN i ON i.n = r.n + 1) i)
SELECT printf('shard-%04d.jsonl', shard) AS shard, shard AS index, count(*) AS count FROM r WHERE n > 0 GROUP BY shard""")
def shard_manifest_bytes(spark, d):
    return writers.manifest(writers.shard_ids(docs(spark, d).select("doc_id", "text", "source"), "doc_id", 200_000, "bytes")).drop("sources")


@query(f"""WITH c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, coalesce(sum(length({TEXT})) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents)
SELECT doc_id FROM c WHERE n < 900 AND b < 300000""")
def doc_budget(spark, d):
    return mix.budget(docs(spark, d).select("doc_id", "text"), 900, 300_000).select("doc_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100 OFFSET 250")
def offset_slice(spark, d):
    return mix.first_rows(docs(spark, d), 100, skip=250).select("doc_id")


@query(f"""WITH i AS (SELECT doc_id, strlen({TEXT}) AS t, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
c AS (SELECT *, coalesce(sum(CASE WHEN i >= 5 THEN t ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM i)
SELECT doc_id, CASE WHEN i < 5 THEN 'skipped' WHEN b < 50000 THEN 'val' WHEN b < 400000 THEN 'train' ELSE 'unused' END AS phase FROM c""")
def region_split(spark, d):
    return mix.regions(filters.byte_token_count(docs(spark, d).select("doc_id", "text")), 5, 50_000, 400_000).select("doc_id", "phase")


def _mix_sql(sources: list[tuple[str, int]], seed: int, epochs: int = 1, columns: str = "doc_id, source, out_pos") -> str:
    """The round-robin step by step, a row of state a step."""
    k, total = range(len(sources)), sum(w for _, w in sources)
    have = ", ".join(f"count(*) FILTER (source = '{n}') * {epochs} AS l{i}" for i, (n, _) in enumerate(sources))
    start = ", ".join(f"0.0::DOUBLE AS g{i}, l{i}, true AS a{i}" for i in k)
    best = "CASE " + " ".join(f"WHEN a{i} AND " + " AND ".join(f"(NOT a{j} OR h{i} >= h{j})" for j in k) + f" THEN {i}" for i in mix.shuffled(len(sources), seed)) + " END"
    gain = ", ".join(f"CASE WHEN a{i} THEN g{i} + {w} ELSE g{i} END AS h{i}" for i, (_, w) in enumerate(sources))
    left = "CASE " + " ".join(f"WHEN p = {i} THEN l{i}" for i in k) + " END"
    step = ", ".join(f"h{i} - CASE WHEN p = {i} THEN {total} ELSE 0 END, l{i} - CASE WHEN p = {i} AND l{i} > 0 THEN 1 ELSE 0 END, a{i} AND NOT (p = {i} AND l{i} = 0)" for i in k)
    name = "CASE " + " ".join(f"WHEN p = {i} THEN '{n}'" for i, (n, _) in enumerate(sources)) + " END"
    return f"""WITH RECURSIVE c AS (SELECT {have} FROM documents), s AS (SELECT 0::BIGINT AS step, -1 AS p, false AS gave, -1::BIGINT AS place, {start} FROM c
UNION ALL SELECT step + 1, p, {left} > 0, place + CASE WHEN {left} > 0 THEN 1 ELSE 0 END, {step} FROM (SELECT *, {best} AS p FROM (SELECT * EXCLUDE (p), {gain} FROM s WHERE {' OR '.join(f'a{i}' for i in k)}))),
o AS (SELECT {name} AS source, place AS out_pos, row_number() OVER (PARTITION BY p ORDER BY place) - 1 AS k FROM s WHERE gave),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM documents),
e AS (SELECT *, unnest(range({epochs}))::INT AS epoch FROM d) SELECT {columns} FROM (SELECT e.doc_id, e.source, e.epoch, o.out_pos FROM e JOIN o ON e.source = o.source AND o.k = e.epoch * e.n + e.rank)"""


WEIGHTED, EPOCHS = [("common-web", 4), ("wiki-en", 1), ("code-python", 2)], [("wiki-fr", 1), ("wiki-de", 1)]


@query(_mix_sql(WEIGHTED, 3))
def mix_weighted(spark, d):
    return mix.weighted(docs(spark, d).select("doc_id", "source"), WEIGHTED, seed=3).select("doc_id", "source", "out_pos")


@query(_mix_sql(EPOCHS, 1, 3, "doc_id, source, epoch, out_pos"))
def mix_epochs(spark, d):
    return mix.weighted(docs(spark, d).select("doc_id", "source"), EPOCHS, seed=1, epochs=3).select("doc_id", "source", "epoch", "out_pos")


def _split_sql(ratio: float, seed: int, sizes: tuple[int, ...] = (100, 1000)) -> str:
    """By the seeded permutation written out as values, for tables of these sizes."""
    import random

    rows = []
    for n in sizes:
        order = list(range(n))
        random.Random(seed).shuffle(order)
        rows.append(f"({n}, {sorted(order[: mix.split_sizes(n, ratio)])})")
    return f"WITH p(n, train) AS (VALUES {', '.join(rows)}), d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, list_contains(train, k) AS in_train FROM d JOIN p USING (n)"


@query(_split_sql(0.9, 7))
def seeded_split(spark, d):
    return mix.seeded_split(docs(spark, d).select("doc_id"), 0.9, 7)


@query(f"SELECT count(*) AS rows, sum(length({TEXT}))::BIGINT AS chars, sum(strlen(to_json({{'doc_id': doc_id, 'text': {TEXT}}})) + 1)::BIGINT AS bytes FROM documents")
def corpus_fingerprint(spark, d):
    return writers.fingerprint(docs(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).select("rows", "chars", "bytes")


@query(f"SELECT doc_id, coalesce(sum(strlen({TEXT})) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents")
def prefix_sums(spark, d):
    return prefix_sum(docs(spark, d).select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")), ["doc_id"], {"before": "n"}, ["source"]).select("doc_id", F.col("before").cast("bigint").alias("before"))


# ---- packing ----------------------------------------------------------------

PACKED = f"""t AS (SELECT doc_id, {TEXT} AS text FROM documents),
b AS (SELECT doc_id, 0 AS o, unnest(range(strlen(text) + 1)) AS i, hex(encode(text)) AS h, strlen(text) AS n FROM t WHERE %s),
k AS (SELECT doc_id, i, CASE WHEN i = n THEN 256 ELSE ('0x' || substr(h, i * 2 + 1, 2))::INT END AS id FROM b),
g AS (SELECT id, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM k),
r AS (SELECT p // 512 AS row_idx, p %% 512 AS c, id FROM g)"""


def _packed_bytes(spark, d, pad: int) -> DataFrame:
    """All texts as bytes, each closed by 256, in rows of 512."""
    n = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return pack.pack(docs(spark, d).select("doc_id", "text"), 512, pad=pad, ids=pack.with_ends(pack.byte_ids(F.col("text")), eos=256), length=n)


@query(f"WITH {PACKED % 'true'} SELECT row_idx, count(*)::BIGINT AS tokens, sum(id)::BIGINT AS total, sum(id * (c + 1))::BIGINT AS weighted FROM r GROUP BY row_idx")
def pack_bytes(spark, d):
    rows = _packed_bytes(spark, d, -1)
    real = F.filter("ids", lambda i: i >= 0)
    return rows.select("row_idx", F.size(real).cast("bigint").alias("tokens"), F.aggregate(real, F.lit(0).cast("bigint"), lambda a, i: a + i).alias("total"), F.aggregate(F.transform(real, lambda i, n: i * (n + 1)), F.lit(0).cast("bigint"), lambda a, i: a + i).alias("weighted"))


@query(f"SELECT doc_id, least(strlen({TEXT}), 256)::BIGINT AS tokens, (256 - least(strlen({TEXT}), 256))::BIGINT AS padding FROM documents")
def pack_padded(spark, d):
    rows = pack.padded(docs(spark, d).select("doc_id", pack.byte_ids(F.col("text")).alias("ids")), 256, pad=-1)
    return rows.select("doc_id", F.size(F.filter("ids", lambda i: i >= 0)).cast("bigint").alias("tokens"), F.size(F.filter("ids", lambda i: i < 0)).cast("bigint").alias("padding"))


@query(f"""WITH t AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'val' ELSE 'train' END AS phase, CASE WHEN {TEXT} = '' THEN 0 ELSE strlen({TEXT}) + 1 END AS n FROM documents)
SELECT phase, count(*) AS documents, count(*) FILTER (n > 0) AS packed_documents, sum(n)::BIGINT AS tokens, ceil(sum(n) / 512.0)::BIGINT AS rows, (ceil(sum(n) / 512.0) * 512 - sum(n))::BIGINT AS padding FROM t GROUP BY phase""")
def pack_counts(spark, d):
    ids = F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<int>")).otherwise(pack.with_ends(pack.byte_ids(F.col("text")), eos=256))
    x = docs(spark, d).select(F.when(F.col("doc_id") % 2 == 0, "val").otherwise("train").alias("phase"), ids.alias("ids"))
    return pack.counters(x, 512)


ROLE_SQL = "CASE " + " ".join(f"WHEN r = '{a}' THEN '{n}'" for a, n in T.ROLE_ALIASES.items()) + " WHEN r = '' THEN 'unknown' ELSE r END"
TURNS = f"""o AS (SELECT conv_id, turn, role, content FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY ingested_at, content NULLS FIRST) = 1),
c AS (SELECT conv_id, turn, lower({STRIP % "coalesce(role, '')"}) AS r, {STRIP % "coalesce(content, '')"} AS text FROM o),
s AS (SELECT conv_id, turn, {ROLE_SQL} AS role, text FROM c WHERE text <> '')"""
CAP = "upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text"


def _turns(spark, d):
    return chat.delivered_once(table(spark, d, "conversations"))


@query(f"WITH {TURNS} SELECT conv_id, turn, role, text FROM s")
def chat_segments(spark, d):
    return chat.segments(_turns(spark, d))


@query(f"WITH {TURNS} SELECT conv_id, string_agg({CAP}, chr(10) || chr(10) ORDER BY turn) AS text FROM s GROUP BY conv_id")
def chat_linearize(spark, d):
    return chat.linearize(_turns(spark, d))


@query(f"""WITH {TURNS}, l AS (SELECT conv_id, turn, coalesce(nullif({STRIP % 'role'}, ''), 'unknown') AS role, {STRIP % "coalesce(content, '')"} AS text FROM o),
j AS (SELECT conv_id, string_agg({CAP}, chr(10) || chr(10) ORDER BY turn) AS text FROM l GROUP BY conv_id) SELECT conv_id, {STRIP % 'text'} AS text FROM j""")
def chat_linearize_loose(spark, d):
    return chat.linearize_loose(_turns(spark, d))


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, role, strlen({CAP}) + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n FROM s)
SELECT conv_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS supervised FROM e GROUP BY conv_id""")
def chat_mask_counts(spark, d):
    return chat.mask_counts(chat.encode(_turns(spark, d), eos=256))


@query(f"""WITH {TURNS}, e AS (SELECT conv_id, turn, role, strlen({CAP}) + CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS n FROM s),
p AS (SELECT role, sum(n) OVER (ORDER BY conv_id, turn) - n AS a, n FROM e),
r AS (SELECT unnest(range((a // 1024)::BIGINT, ((a + n - 1) // 1024)::BIGINT + 1)) AS row_idx, * FROM p)
SELECT row_idx, sum(CASE WHEN role = 'assistant' THEN least(a + n, (row_idx + 1) * 1024) - greatest(a, row_idx * 1024) ELSE 0 END)::BIGINT AS supervised FROM r GROUP BY row_idx""")
def pack_masked(spark, d):
    rows = pack.pack(chat.encode(_turns(spark, d), eos=256), 1024, pos="conv_id", pad=0, mask="mask")
    return rows.select("row_idx", F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("supervised"))


# ---- statistics -------------------------------------------------------------

GRAMS = "CASE WHEN len(ws) < {n} THEN [] ELSE list_transform(range(1, len(ws) - {m} + 1), i -> array_to_string(list_slice(ws, i, i + {m}), ' ')) END"
DIST = "CASE WHEN len(ws) = 0 THEN 0.0 WHEN len({g}) = 0 THEN 1.0 ELSE len(list_distinct({g}))::DOUBLE / len({g}) END"


def _distinct(n: int) -> str:
    return DIST.format(g=GRAMS.format(n=n, m=n - 1))


@query(f"WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents) SELECT doc_id, round({_distinct(1)}, 9) AS distinct_1, round({_distinct(2)}, 9) AS distinct_2 FROM w")
def distinct_n(spark, d):
    x = docs(spark, d).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("ws"))
    return x.select("doc_id", F.round(stats.distinct_n(F.col("ws"), 1), 9).alias("distinct_1"), F.round(stats.distinct_n(F.col("ws"), 2), 9).alias("distinct_2"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents), g AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [] ELSE list_transform(range(1, len(ws) - 1), i -> list_slice(ws, i, i + 2)) END) AS g FROM w),
c AS (SELECT doc_id, g, count(*) AS repeats FROM g GROUP BY ALL)
SELECT doc_id, array_to_string(g, ' ') AS gram, repeats FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY repeats DESC, g DESC) = 1""")
def top_ngram(spark, d):
    x = docs(spark, d).select("doc_id", T.words(F.coalesce("text", F.lit(""))).alias("ws"))
    return stats.top_ngram(x, "doc_id", "ws", 3).select("doc_id", "gram", "repeats")


def _generation(spark, d):
    return stats.generation_report(docs(spark, d).select("doc_id", pack.with_ends(pack.byte_ids(F.col("text")), eos=256).alias("ids")), "doc_id", "ids", 256)


GENERATIONS = f"""t AS (SELECT doc_id, hex(encode({TEXT})) AS h, strlen({TEXT}) AS n FROM documents),
b AS (SELECT doc_id, n, list_transform(range(n), i -> substr(h, 2 * i + 1, 2)) AS u, list_transform(range(n - 1), i -> substr(h, 2 * i + 1, 4)) AS p FROM t),
x AS (SELECT doc_id, substr(h, 2 * unnest(range(n - 2)) + 1, 6) AS g FROM t), c AS (SELECT doc_id, g, count(*) AS c FROM x GROUP BY ALL), r AS (SELECT doc_id, max(c) AS r FROM c GROUP BY doc_id),
f AS (SELECT doc_id, n + 1 AS generated, true AS eos_stopped, CASE WHEN n = 0 THEN 0.0 ELSE len(list_distinct(u)) / n::DOUBLE END AS distinct_1,
  CASE WHEN n = 0 THEN 0.0 WHEN n = 1 THEN 1.0 ELSE len(list_distinct(p)) / (n - 1)::DOUBLE END AS distinct_2, coalesce(r, 0) AS repeats FROM b LEFT JOIN r USING (doc_id)),
g AS (SELECT *, generated > 1 AND (repeats > 4 OR distinct_2 < 0.2) AS degenerate FROM f)"""


@query(f"WITH {GENERATIONS} SELECT doc_id, generated::BIGINT AS generated, eos_stopped, round(distinct_1, 9) AS distinct_1, round(distinct_2, 9) AS distinct_2, repeats, degenerate FROM g")
def generation_report(spark, d):
    return _generation(spark, d).select("doc_id", "generated", "eos_stopped", F.round("distinct_1", 9).alias("distinct_1"), F.round("distinct_2", 9).alias("distinct_2"), "repeats", "degenerate")


@query(f"WITH {GENERATIONS} SELECT count(*) AS generations, 1.0::DOUBLE AS eos_rate, round(avg(degenerate::INT), 9) AS degenerate_rate, round(avg(distinct_2), 9) AS distinct_2, round(avg(generated), 9) AS mean_length FROM g")
def generation_rates(spark, d):
    x = stats.generation_rates(_generation(spark, d))
    return x.select("generations", *(F.round(c, 9).alias(c) for c in ("eos_rate", "degenerate_rate", "distinct_2", "mean_length")))


@query("""WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  max(value) FILTER (i = least(n - 1, floor(0.5 * (n - 1) + 0.5))) AS p50, max(value) FILTER (i = least(n - 1, floor(0.95 * (n - 1) + 0.5))) AS p95 FROM o GROUP BY event_type""")
def nearest_rank_summary(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("""WITH a AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS a FROM lineitem GROUP BY 1), p AS (SELECT k, a, o_totalprice AS b, o_totalprice / a AS r FROM a JOIN orders ON k = o_orderkey WHERE a <> 0),
o AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS i, count(*) OVER () AS n FROM p)
SELECT count(*) AS pairs, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, (SELECT round(max(r), 6) FROM o WHERE i = n // 2) AS median_ratio, round((avg(b) / avg(a) - 1) * 100, 6) AS mean_change_pct FROM p""")
def paired_ratio(spark, d):
    a = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v"))
    b = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    x = stats.paired(a, b, "k", "v")
    return x.select("pairs", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"), F.round("median_ratio", 6).alias("median_ratio"), F.round("mean_change_pct", 6).alias("mean_change_pct"))


@query()
def bootstrap_ci(spark, d):
    return stats.bootstrap_median(table(spark, d, "events"), ["event_type"], "value", 2000)


def _pairs(spark, d):
    """Each vector beside the next one of its table."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, x -> x::DOUBLE) AS e FROM embeddings), s AS (SELECT *, CASE WHEN list_max(list_transform(e, x -> abs(x))) > 0 THEN list_max(list_transform(e, x -> abs(x))) / 127.0 ELSE 1.0 END AS scale FROM v),
q AS (SELECT *, list_transform(e, x -> greatest(-127, least(127, round_even(x / scale, 0)))::INT) AS q FROM s)
SELECT vec_id, array_to_string(q, ',') AS q, round(scale, 9) AS scale, round(list_max(list_transform(range(1, len(e) + 1), i -> abs(e[i] - q[i] * scale))), 9) AS max_error FROM q""")
def int8_quantize(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", stats.int8(F.col("embedding")).alias("r"))
    return x.select("vec_id", F.array_join(F.col("r.q").cast("array<string>"), ",").alias("q"), F.round("r.scale", 9).alias("scale"), F.round("r.max_error", 9).alias("max_error"))


@query("""WITH p AS (SELECT a.vec_id, list_transform(a.embedding, x -> x::DOUBLE) AS a, list_transform(b.embedding, x -> x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_max(list_transform(range(1, len(a) + 1), i -> abs(a[i] - b[i]))), 6) AS max_abs, round(list_sum(list_transform(range(1, len(a) + 1), i -> abs(a[i] - b[i]))) / len(a), 6) AS mean_abs,
  round(list_dot_product(a, b) / greatest(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 1e-30), 6) AS cosine, list_position(a, list_max(a)) = list_position(b, list_max(b)) AS same_top FROM p""")
def vector_agreement(spark, d):
    x = _pairs(spark, d).select("vec_id", stats.compare_vectors(F.col("embedding"), F.col("b")).alias("r"))
    return x.select("vec_id", *(F.round(f"r.{c}", 6).alias(c) for c in ("max_abs", "mean_abs", "cosine")), F.col("r.same_top").alias("same_top"))


LOGITS = "l AS (SELECT vec_id, unnest(range(len(embedding))) AS token, unnest(embedding)::DOUBLE AS logit FROM embeddings)"


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.col("logit").cast("double")).withColumn("token", F.col("token").cast("bigint"))


@query(f"WITH {LOGITS}, e AS (SELECT *, nth_value(logit, 5) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS edge FROM l) SELECT vec_id, token FROM e WHERE logit >= edge")
def topk_filter(spark, d):
    return stats.top_k(_logits(spark, d), "vec_id", "token", "logit", 5).select("vec_id", "token")


@query(f"""WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p) SELECT vec_id, count(*) AS tokens FROM b WHERE b < 0.5 GROUP BY vec_id""")
def topp_filter(spark, d):
    return stats.top_p(_logits(spark, d), "vec_id", "token", "logit", 0.5).groupBy("vec_id").agg(F.count("*").alias("tokens"))


@query(f"WITH {LOGITS} SELECT vec_id, token, round(CASE WHEN token % 3 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.3 ELSE logit * 1.3 END ELSE logit END, 9) AS logit FROM l")
def repetition_penalty(spark, d):
    return _logits(spark, d).select("vec_id", "token", F.round(stats.repetition_penalty(F.col("logit"), F.col("token") % 3 == 0, 1.3), 9).alias("logit"))


@query(f"""WITH {LOGITS}, p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, token) <= 2)
SELECT vec_id, token::BIGINT AS expert, round(e / sum(e) OVER (PARTITION BY vec_id), 6) AS weight FROM t""")
def moe_router(spark, d):
    return stats.router(table(spark, d, "embeddings"), "vec_id", "embedding", 2).select("vec_id", F.col("expert").cast("bigint").alias("expert"), F.round("weight", 6).alias("weight"))


@query("SELECT sum(n)::BIGINT AS tokens, round(sum(v) / sum(n), 6) AS loss, round(exp(sum(v) / sum(n)), 6) AS perplexity FROM (SELECT l_discount * 100 AS v, l_linenumber AS n FROM lineitem)")
def eval_metrics(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_discount") * 100).alias("v"), F.col("l_linenumber").alias("n"))
    return stats.eval_metrics(x, "v", "n").select("tokens", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@query("""WITH s AS (SELECT user_id, event_id, coalesce(value < 10, false) AS k FROM events), i AS (SELECT *, sum(CASE WHEN k THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g, sum(CASE WHEN k THEN 0 ELSE 1 END) OVER (PARTITION BY user_id) AS e FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) AS run FROM i WHERE k)
SELECT u.user_id, count(run) AS skips, coalesce(max(run) FILTER (g = r.e), 0) AS current_run, coalesce(max(run), 0) AS longest_run, min(r.event_id) FILTER (run >= 3) AS aborted_at FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN r ON u.user_id IS NOT DISTINCT FROM r.user_id GROUP BY u.user_id""")
def skip_tracker(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.col("value") < 10, F.lit(False)).alias("k"))
    x = stats.skip_runs(e, "event_id", "k", 3, ["user_id"])
    return x.select("user_id", "skips", F.col("current_run").cast("bigint").alias("current_run"), F.col("longest_run").cast("bigint").alias("longest_run"), "aborted_at")


@query("""SELECT l_returnflag, sum(l_quantity) AS tokens, round(sum(l_quantity) / sum(l_linenumber), 6) AS tokens_per_s, round(sum(l_linenumber) * 1000.0 / greatest(count(*), 1), 6) AS ms_per_step FROM lineitem GROUP BY 1""")
def interval_rates(spark, d):
    x = table(spark, d, "lineitem").withColumn("one", F.lit(1)).withColumn("o", F.struct("l_orderkey", "l_linenumber"))
    r = stats.interval_rates(x, ["l_returnflag"], "o", "l_linenumber", "one", "l_quantity")
    return r.select("l_returnflag", "tokens", F.round("tokens_per_s", 6).alias("tokens_per_s"), F.round("ms_per_step", 6).alias("ms_per_step"))


# ---- tokenizers -------------------------------------------------------------


@query(f"SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word")
def word_freq(spark, d):
    return docs(spark, d).select(F.explode(T.words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"""WITH w AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({WORDS}) AS word FROM documents) GROUP BY word), h AS (SELECT hex(encode(word)) AS h, cnt, unnest(range(strlen(word) - 1)) AS i FROM w WHERE strlen(word) > 1)
SELECT ('0x' || substr(h, i * 2 + 1, 2))::INT AS a, ('0x' || substr(h, i * 2 + 3, 2))::INT AS b, sum(cnt)::BIGINT AS cnt FROM h GROUP BY ALL""")
def pair_counts(spark, d):
    return bpe.pair_counts(word_freq(spark, d))


@query(f"""SELECT coalesce(source, 'unknown') AS source, count(*) AS documents, sum(length({TEXT}))::BIGINT AS chars, sum(strlen({TEXT}))::BIGINT AS bytes, sum(strlen({TEXT}))::BIGINT AS tokens,
CASE WHEN sum(strlen({TEXT})) > 0 THEN round(sum(length({TEXT})) / sum(strlen({TEXT}))::DOUBLE, 9) ELSE 0.0 END AS chars_per_token FROM documents GROUP BY 1""")
def compression_bytes(spark, d):
    x = filters.byte_token_count(docs(spark, d).select(F.coalesce("source", F.lit("unknown")).alias("source"), "text"))
    return stats.compression(x, ["source"]).select("source", "documents", "chars", "bytes", "tokens", F.round("chars_per_token", 9).alias("chars_per_token"))


@query()
def compression_bpe(spark, d):
    tok = bpe.from_table(table(spark, d, "token_merges"))
    x = docs(spark, d).where("text is not null").select(F.coalesce("source", F.lit("unknown")).alias("source"), "text", bpe.token_count(F.col("text"), tok).alias("num_tokens"))
    return stats.compression(x, ["source"])


@query(f"""WITH e AS (SELECT unnest(['exact', 'older']) AS encoder), d AS (SELECT coalesce(lang, 'unknown') AS slice, count(*) AS documents, sum(length({TEXT}))::BIGINT AS chars, sum(strlen({TEXT}))::BIGINT AS bytes FROM documents GROUP BY 1)
SELECT encoder, slice, documents, chars, bytes, true AS fewer FROM d, e""")
def compression_encoders(spark, d):
    rows = table(spark, d, "token_merges").orderBy("merge_no").collect()
    pairs = [(r["left_id"], r["right_id"]) for r in rows]
    encoders = {n: tk.Tokenizer(tk.Config(4096, pre_tokenize="simple"), pairs, n == "exact") for n in ("exact", "older")}
    x = stats.compression_by(docs(spark, d).select(F.coalesce("lang", F.lit("unknown")).alias("slice"), "text"), encoders, ["slice"])
    least = Window.partitionBy("slice")
    fewer = F.when(F.col("encoder") == "exact", F.col("tokens") == F.min("tokens").over(least)).otherwise(F.col("tokens") == F.max("tokens").over(least)) & (F.col("tokens") <= F.col("bytes"))
    return x.select("encoder", "slice", "documents", "chars", "bytes", fewer.alias("fewer"))


@query()
def bpe_encode_counts(spark, d):
    tok = bpe.from_table(table(spark, d, "token_merges"))
    return docs(spark, d).select("doc_id", F.size(bpe.encode(F.coalesce("text", F.lit("")), tok)).cast("bigint").alias("tokens"))


@query("SELECT count(*) AS documents, 0::BIGINT AS changed FROM documents")
def bpe_roundtrip(spark, d):
    tok = bpe.from_table(table(spark, d, "token_merges"))
    x = docs(spark, d).select(F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.decode(bpe.encode(F.col("text"), tok), tok)
    return x.select((back != F.col("text")).cast("bigint").alias("c")).agg(F.count("*").alias("documents"), F.sum("c").alias("changed"))


@query("SELECT count(*) AS documents, 0::BIGINT AS changed FROM documents")
def word_split_lossless(spark, d):
    @F.pandas_udf("bigint")
    def changed(s):
        return s.map(lambda t: int("".join(bpe.split_words(t)) != t))

    return docs(spark, d).select(changed(F.coalesce("text", F.lit(""))).alias("c")).agg(F.count("*").alias("documents"), F.sum("c").alias("changed"))


@query()
def bpe_train(spark, d):
    tok = bpe.train(bpe.word_counts(docs(spark, d)), 64)
    return spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(tok.pairs)], "merge_no int, left_id int, right_id int")


# ---- validation -------------------------------------------------------------


@query(f"""WITH {PACKED % 'true'} SELECT row_idx, min(id)::BIGINT AS min_id, max(id)::BIGINT AS max_id FROM r GROUP BY row_idx HAVING max(id) >= 220""")
def id_range_violations(spark, d):
    rows = _packed_bytes(spark, d, 32)
    x = validate.id_violations(rows, 220)
    return x.select("row_idx", F.col("min_id").cast("bigint").alias("min_id"), F.col("max_id").cast("bigint").alias("max_id"))


@query("""WITH f AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS s FROM documents), c AS (SELECT printf('shard-%04d', s) AS shard, count(*) AS found FROM f WHERE s <> 2 GROUP BY 1),
m AS (SELECT printf('shard-%04d', s) AS shard, count(*) + CASE WHEN s = 1 THEN 1 ELSE 0 END AS listed FROM f WHERE s <> 3 GROUP BY s)
SELECT coalesce(c.shard, m.shard) AS shard, CASE WHEN found IS NULL THEN 'missing' WHEN listed IS NULL THEN 'stray' ELSE 'count' END AS problem, listed, found FROM c FULL JOIN m ON c.shard = m.shard WHERE found IS DISTINCT FROM listed""")
def manifest_check(spark, d):
    s = writers.shard_ids(docs(spark, d).select("doc_id"), "doc_id", 128).groupBy("shard").agg(F.count("*").alias("count"))
    name = F.format_string("shard-%04d", "shard").alias("shard")
    facts = s.where("shard <> 2").select(name, "count")
    listed = s.where("shard <> 3").select(name, (F.col("count") + (F.col("shard") == 1).cast("bigint")).alias("count"))
    return validate.manifest_problems(listed, facts)


@query(f"""WITH t AS (SELECT coalesce(sum(strlen({TEXT}) + 1), 0)::BIGINT AS n FROM documents) SELECT (n // 512)::BIGINT AS row_idx, (512 - n % 512)::BIGINT AS padding FROM t WHERE n % 512 > 0""")
def pad_verify(spark, d):
    rows = _packed_bytes(spark, d, 257)
    return rows.select("row_idx", validate.tail_run(F.col("ids"), 257).alias("padding")).where("padding > 0")


@query("SELECT n_regionkey AS label, count(*) AS sources, count(DISTINCT n_name) AS distinct_values FROM nation GROUP BY 1 HAVING count(DISTINCT n_name) > 1")
def fact_conflicts(spark, d):
    return validate.conflicts(table(spark, d, "nation").select(F.col("n_regionkey").alias("label"), F.col("n_name").alias("value")))


# ---- schedules and formats --------------------------------------------------


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey * 1000 AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN t < 100000 THEN t / 100000.0 * 0.001 ELSE 0.0001 + 0.0009 * 0.5 * (1 + cos(least(1.0, greatest(0.0, (t - 100000) / 900000.0)) * pi())) END, 12) AS lr FROM t""")
def token_lr(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.token_lr(F.col("l_orderkey") * 1000, 0.001, 100_000, 1_000_000), 12).alias("lr"))


@query("SELECT o_orderkey, round(CASE WHEN o_orderkey < 20 THEN 0.001 * (o_orderkey + 1) / 20.0 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(1.0, (o_orderkey - 20) / 4980.0)))) END, 12) AS lr FROM orders")
def step_lr(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(S.step_lr(F.col("o_orderkey"), 0.001, 20, 5000), 12).alias("lr"))


@query("""WITH s AS (SELECT stage_key, token_budget AS b, 4 * seq_len AS one FROM stages), f AS (SELECT *, b // (one * 8) AS full_steps FROM s)
SELECT stage_key, full_steps, (b - full_steps * one * 8) // one AS tail_micro_batches, full_steps * one * 8 + ((b - full_steps * one * 8) // one) * one AS tokens FROM f""")
def budget_steps(spark, d):
    x = table(spark, d, "stages").select("stage_key", S.budget_steps(F.col("token_budget"), F.lit(4), F.lit(8), F.col("seq_len")).alias("r"))
    return x.select("stage_key", "r.full_steps", "r.tail_micro_batches", "r.tokens")


@query("SELECT stage_key, round(token_budget / 90000000.0, 6) AS passes, ceil(token_budget / 90000000.0)::BIGINT AS epochs, coalesce(token_budget / 90000000.0 > max_epochs, false) AS over FROM stages")
def budget_passes(spark, d):
    x = table(spark, d, "stages").select("stage_key", S.passes(F.col("token_budget"), F.lit(90_000_000), F.col("max_epochs")).alias("r"))
    return x.select("stage_key", F.round("r.passes", 6).alias("passes"), "r.epochs", "r.over")


@query("SELECT 'checkpoint-' || max(o_orderkey) AS path, max(o_orderkey) AS step FROM orders")
def newest_checkpoint(spark, d):
    x = table(spark, d, "orders").select(F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("path"))
    return x.withColumn("step", S.checkpoint_step(F.col("path"))).orderBy(F.desc("step")).limit(1)


@query("""SELECT stage_key, format('{:,}', token_budget) AS count_text, printf('%.2fM', token_budget / 1e6) AS short, printf('%02dm %02ds', seq_len // 60, seq_len % 60) AS duration,
format('{:,}', seq_len) || ' out of ' || printf('%.2fM', token_budget / 1e6) || printf(' (%.1f%%)', seq_len * 100.0 / token_budget) AS progress,
CASE WHEN max_epochs IS NULL THEN '—' ELSE printf('%.4f', max_epochs::DOUBLE) END AS loss, CASE WHEN max_epochs IS NULL THEN '—' ELSE printf('%.1f%%', max_epochs * 100.0) END AS percent FROM stages""")
def formats(spark, d):
    x = table(spark, d, "stages")
    return x.select(
        "stage_key", S.count_text(F.col("token_budget")).alias("count_text"), S.short_number(F.col("token_budget")).alias("short"), S.duration(F.col("seq_len").cast("double")).alias("duration"),
        S.progress_text(F.col("seq_len"), F.col("token_budget")).alias("progress"), S.loss_text(F.col("max_epochs").cast("double")).alias("loss"), S.percent(F.col("max_epochs").cast("double")).alias("percent"),
    )


@query("""WITH s AS (SELECT o_orderkey, o_orderkey * 777 AS b, 4 * 512 AS one FROM orders), f AS (SELECT *, b // (one * 8) AS full_steps FROM s), t AS (SELECT *, (b - full_steps * one * 8) // one AS tail FROM f)
SELECT o_orderkey, full_steps + CASE WHEN tail > 0 THEN 1 ELSE 0 END AS steps, (full_steps * 8 + tail) * one AS tokens, CASE WHEN tail > 0 THEN tail WHEN full_steps > 0 THEN 8 ELSE 0 END AS final_micro_batches, 0::BIGINT AS overshoot FROM t""")
def budget_simulation(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", S.simulate(F.col("o_orderkey") * 777, F.lit(4), F.lit(8), F.lit(512)).alias("r"))
    return x.select("o_orderkey", "r.*")


@query("""WITH s AS (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS t FROM orders), c AS (SELECT *, sum(t) OVER (ORDER BY o_orderkey) AS u FROM s)
SELECT o_orderkey, (u - t)::BIGINT AS before, greatest(1000000000 - u, 0)::BIGINT AS left, u > 1000000000 AS over FROM c""".replace("AS left", 'AS "left"'))
def budget_account(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") * 10).cast("bigint").alias("t"))
    return stats.account(x, "o_orderkey", "t", 1_000_000_000).drop("t")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey * 1000000 WHEN s_suppkey % 3 = 0 THEN floor(s_suppkey % 7 * 0.5 * 3600 * 25000)::BIGINT ELSE 2000000000 END AS tokens,
CASE WHEN s_suppkey % 5 = 0 THEN 'override' WHEN s_suppkey % 3 = 0 AND s_suppkey % 7 > 0 THEN 'hours' ELSE 'default' END AS origin FROM supplier WHERE s_suppkey > 0 AND (s_suppkey % 3 <> 0 OR s_suppkey % 7 > 0 OR s_suppkey % 5 = 0)""")
def stage_budgets(spark, d):
    k = F.col("s_suppkey")
    hours = F.when(k % 3 == 0, k % 7 * 0.5).otherwise(0.0)
    x = table(spark, d, "supplier").select("s_suppkey", S.stage_budget(F.when(k % 5 == 0, k * 1_000_000).otherwise(0), hours, F.lit(25_000.0), 2_000_000_000, 100_000_000).alias("r"))
    return x.where("s_suppkey > 0 and (s_suppkey % 3 <> 0 or s_suppkey % 7 > 0 or s_suppkey % 5 = 0)").select("s_suppkey", "r.tokens", "r.origin")


@query("""WITH r AS (SELECT c_custkey, c_custkey * 40000000 / 1000000000.0 AS x FROM customer)
SELECT c_custkey, round(x, 6) AS ratio, CASE WHEN x < 1 THEN 'statistics' WHEN x < 2 THEN 'fragments' WHEN x < 8 THEN 'local' WHEN x < 15 THEN 'readable' ELSE 'balanced' END AS band, CASE WHEN x < 1 THEN 'early' WHEN x < 10 THEN 'small' ELSE 'balanced' END AS verdict FROM r""")
def capability_bands(spark, d):
    t = F.col("c_custkey") * 40_000_000
    x = table(spark, d, "customer").select("c_custkey", S.capability(t, F.lit(1_000_000_000)).alias("r"), S.verdict(t, F.lit(1_000_000_000)).alias("verdict"))
    return x.select("c_custkey", F.round("r.ratio", 6).alias("ratio"), "r.band", "verdict")


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 1 THEN least(o_orderkey - 1, greatest(20, round_even(o_orderkey * 0.03, 0)))::BIGINT END AS warmup FROM orders")
def warmup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.warmup_steps(F.col("o_orderkey"), 0.03).alias("warmup"))


@query(f"""WITH {LOGITS}, e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM l), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, token) AS r FROM e),
w AS (SELECT *, CASE WHEN r <= 2 THEN p / sum(CASE WHEN r <= 2 THEN p END) OVER (PARTITION BY vec_id) ELSE 0 END AS w FROM p), x AS (SELECT token, avg(w) AS f, avg(p) AS p FROM w GROUP BY token)
SELECT count(*) AS experts, round(count(*) * sum(f * p), 6) AS loss FROM x""")
def moe_balance(spark, d):
    return stats.load_balance(table(spark, d, "embeddings"), "vec_id", "embedding", 2).select(F.col("experts").cast("bigint").alias("experts"), F.round("loss", 6).alias("loss"))


@query("SELECT n_nationkey, r_name AS name, r_name IS NOT NULL AS known FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON n_regionkey = r_regionkey")
def shape_lookup(spark, d):
    registry = table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("shape"), F.col("r_name").alias("name"))
    return validate.lookup(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("shape")), registry, ["shape"]).drop("shape")


@query("""WITH a AS (SELECT DISTINCT n_nationkey AS asset FROM nation WHERE n_nationkey <> 4), c AS (SELECT s_nationkey AS asset, count(DISTINCT s_suppkey) AS owners FROM supplier WHERE s_nationkey % 6 <> 1 GROUP BY 1)
SELECT coalesce(a.asset, c.asset) AS asset, coalesce(owners, 0) AS owners, CASE WHEN a.asset IS NULL THEN 'no asset' WHEN owners IS NULL THEN 'no owner' ELSE 'several owners' END AS problem
FROM a FULL JOIN c ON a.asset = c.asset WHERE a.asset IS NULL OR coalesce(owners, 0) <> 1""")
def asset_pairing(spark, d):
    assets = table(spark, d, "nation").where("n_nationkey <> 4").select(F.col("n_nationkey").alias("asset"))
    presets = table(spark, d, "supplier").where("s_nationkey % 6 <> 1").select(F.col("s_nationkey").alias("asset"), F.col("s_suppkey").alias("preset"))
    return validate.pairing_problems(assets, presets)


def _small_rows(spark, d):
    """Rows of 512 with the shard of 100 rows they stand in."""
    return _packed_bytes(spark, d, 257).select("row_idx", F.floor(F.col("row_idx") / 100).alias("shard"))


ROWS = f"t AS (SELECT ceil(sum(strlen({TEXT}) + 1) / 512.0)::BIGINT AS n FROM documents), r AS (SELECT unnest(range(n)) AS row_idx, n FROM t)"


@query(f"""WITH {ROWS}, s AS (SELECT row_idx // 100 AS shard, row_idx % 100 AS k, least(100, n - row_idx // 100 * 100) AS size FROM r)
SELECT shard, (k // 16)::BIGINT AS batch, count(*) AS rows FROM s WHERE k // 16 < size // 16 GROUP BY ALL""")
def packed_batches(spark, d):
    rows = _small_rows(spark, d).withColumn("row_idx", F.col("row_idx") % 100)
    return pack.batches(rows, 16, drop_last=True, by=["shard"]).groupBy("shard", "batch").agg(F.count("*").alias("rows"))


@query(f"""WITH {ROWS}, e AS (SELECT *, unnest(range(3)) AS epoch FROM r) SELECT epoch::INT AS epoch, (row_idx // 32)::BIGINT AS batch, count(*) AS rows FROM e
WHERE row_idx // 32 < n // 32 AND (epoch > 1 OR epoch = 1 AND row_idx >= 70) GROUP BY ALL""")
def resumed_epochs(spark, d):
    return pack.epochs(_small_rows(spark, d), 3, 32, (1, 70)).groupBy("epoch", "batch").agg(F.count("*").alias("rows"))


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split({TEXT}, chr(10) || chr(10))) AS p FROM documents), k AS (SELECT trim(regexp_replace(lower(p), '{WS}+', ' ', 'g')) AS t FROM p WHERE length({STRIP % 'p'}) >= 1)
SELECT count(*) AS paragraphs, count(DISTINCT t) AS kept FROM k""")
def paragraph_workload(spark, d):
    p = docs(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n", -1)).alias("n", "p"))
    x = filters.length_filter(1)(p.select(F.struct("doc_id", "n").alias("pos"), T.strip_space(F.col("p")).alias("text")))
    kept = dedup.exact(x, "pos", keep=[]).agg(F.count("*").alias("kept"))
    return x.agg(F.count("*").alias("paragraphs")).crossJoin(kept)


@query("SELECT n_nationkey, (24 * (4 * w * w + 3 * w * f + 2 * w) + 32000 * w + w) AS parameters, (24 * (4 * w * w + 3 * w * f + 2 * w) + 32000 * w + w) * 6 AS flops_per_token FROM (SELECT n_nationkey, (n_nationkey::BIGINT + 1) * 64 AS w, (n_nationkey::BIGINT + 1) * 256 AS f FROM nation)")
def model_size(spark, d):
    k = F.col("n_nationkey").cast("bigint") + 1
    x = table(spark, d, "nation").select("n_nationkey", S.transformer_size(F.lit(24), k * 64, k * 256, F.lit(32000)).alias("r"))
    return x.select("n_nationkey", "r.parameters", "r.flops_per_token")


# ---- prepared corpora and tokenizers as a whole -----------------------------


def _prepared(spark, d):
    ids = pack.byte_ids(F.col("text"))
    return prepare.packed(docs(spark, d).select("doc_id", ids.alias("ids")), prepare.Plan(512, 400_000, 50_000, 5, rows_per_shard=100))


@query(f"""WITH i AS (SELECT doc_id, strlen({TEXT}) AS b, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), n AS (SELECT *, CASE WHEN b > 0 THEN b + 1 ELSE 0 END AS t FROM i),
c AS (SELECT *, coalesce(sum(CASE WHEN i >= 5 THEN t ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
p AS (SELECT CASE WHEN before < 50000 THEN 'val' ELSE 'train' END AS phase, t FROM c WHERE i >= 5 AND before < 400000),
r AS (SELECT phase, ceil(sum(t) / 512.0)::BIGINT AS n FROM p GROUP BY phase), s AS (SELECT phase, unnest(range(0, (n - 1) // 100 + 1)) AS shard, n FROM r)
SELECT phase, shard, least(100, n - shard * 100)::BIGINT AS rows FROM s""")
def prepare_corpus(spark, d):
    return _prepared(spark, d).groupBy("phase", "shard").agg(F.count("*").alias("rows"))


@query("SELECT 'val' AS phase, 0::BIGINT AS shared UNION ALL SELECT 'train', 0")
def region_overlap(spark, d):
    x = mix.regions(filters.byte_token_count(docs(spark, d).select("doc_id", "text")), 5, 50_000, 400_000).select("doc_id", "phase")
    val, train = x.where("phase = 'val'"), x.where("phase = 'train'")
    n = mix.shared_rows(val, train).agg(F.count("*").alias("shared"))
    return spark.createDataFrame([("val",), ("train",)], "phase string").crossJoin(n)


@query("SELECT s AS seq, array_to_string(list_transform(range(1, 9), i -> list_extract([s % 97, (s + 1) % 97, (2 * s + 1) % 97, (3 * s + 2) % 97, (5 * s + 3) % 97, (8 * s + 5) % 97, (13 * s + 8) % 97, (21 * s + 13) % 97, (34 * s + 21) % 97], i)), ',') AS ids FROM (SELECT n_nationkey AS s FROM nation)")
def recurrence_corpus(spark, d):
    k = F.col("n_nationkey")
    x = prepare.recurrence(spark, table(spark, d, "nation").select(k.alias("seq"), F.pmod(F.lit(1), F.lit(97)).alias("a"), F.pmod(k, F.lit(97)).alias("b")), 97, 8)
    return x.select("seq", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("SELECT count(*) AS documents, 0::BIGINT AS changed FROM documents")
def tokenizer_roundtrip(spark, d):
    rows = table(spark, d, "token_merges").orderBy("merge_no").collect()
    tok = tk.Tokenizer(tk.Config(4096, pre_tokenize="gpt2"), [(r["left_id"], r["right_id"]) for r in rows])
    shared = spark.sparkContext.broadcast(tok)

    @F.pandas_udf("bigint")
    def changed(s):
        t = shared.value
        return s.map(lambda x: int(t.decode(t.encode(x, bos=True, eos=True)) != x))

    return docs(spark, d).select(changed(F.coalesce("text", F.lit(""))).alias("c")).agg(F.count("*").alias("documents"), F.sum("c").alias("changed"))


@query("""SELECT kind, n::BIGINT AS n FROM (SELECT 'byte' AS kind, 256 AS n UNION ALL SELECT 'merge', (SELECT count(*) FROM token_merges) UNION ALL SELECT 'special', 4)""")
def vocabulary_layout(spark, d):
    rows = table(spark, d, "token_merges").orderBy("merge_no").collect()
    tok = tk.Tokenizer(tk.Config(4096), [(r["left_id"], r["right_id"]) for r in rows])
    return tok.vocabulary(spark).groupBy("kind").agg(F.count("*").alias("n"))
