"""A corpus pipeline from a declarative spec: sources, processors, mix, shards.

``python -m corpusloom.plans.pipeline --config spec.json --out DIR``
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contamination, dedup, filters, mix
from ..operators.tokenizer import Tokenizer
from ..session import cut
from ..sources import readers, writers

PROCESSORS = {
    "length": filters.length_filter, "quality_heuristic": filters.quality_filter, "code_fence": lambda mode="keep", min_code_ratio=0.3: filters.code_filter(mode, min_code_ratio),
    "blacklist_regex": filters.blacklist_regex, "url_blacklist": filters.url_blacklist, "regex_filter": filters.regex_filter, "field_remap": filters.field_remap,
    "language": filters.language_filter, "token_count": lambda tokenizer=None: filters.token_counts(Tokenizer.load(tokenizer) if tokenizer else None),
    "keep_fields": lambda fields: filters.keep_fields([*fields, "text", "source"]),
    "exact_dedup": lambda normalize=True: lambda df: dedup.exact(df, "_pos", normalize),
    "minhash_dedup": lambda permutations=64, bands=8, ngram=5, seed=0: lambda df: dedup.near(df, "_pos", bands, permutations, ngram, seed),
    "contamination": lambda **k: lambda df: _contamination(df, **k),
}


def _contamination(df: DataFrame, contaminated_texts=(), contaminated_ids=(), fuzzy_ngram: int = 0, action: str = "drop") -> DataFrame:
    spark = df.sparkSession
    hits = []
    if contaminated_ids:
        hits.append(contamination.hits_by_id(df, spark.createDataFrame([(str(i),) for i in contaminated_ids], "id string"), "_pos"))
    if contaminated_texts:
        hits.append(contamination.hits_by_substring(df, contaminated_texts, "_pos"))
        if fuzzy_ngram > 1:
            hits.append(contamination.hits_by_ngram(df, spark.createDataFrame([(t,) for t in contaminated_texts], "text string"), fuzzy_ngram, "_pos"))
    if not hits:
        return df
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    return contamination.apply(df, every.distinct(), "_pos", action)


def processor(config: dict):
    """A processor by ``{"type": ..., options}``; ``chain`` nests."""
    cfg = dict(config)
    kind = cfg.pop("type", None)
    if kind == "chain":
        return filters.chain(*(processor(c) for c in cfg.get("processors", [])))
    if kind not in PROCESSORS:
        raise ValueError(f"unknown processor {kind!r}; known: {sorted([*PROCESSORS, 'chain'])}")
    return PROCESSORS[kind](**cfg)


@dataclass
class PipelineSpec:
    """sources: [{reader: {...}, weight}]; processors: [{type, ...}]; output: {dir, shard_size, size_by, format, prefix}."""

    sources: list[dict]
    processors: list[dict] = field(default_factory=lambda: [{"type": "length", "min_chars": 1}])
    output: dict = field(default_factory=dict)
    num_epochs: int = 1

    @classmethod
    def load(cls, config: dict) -> PipelineSpec:
        if not isinstance(config.get("sources"), list) or not config["sources"]:
            raise ValueError("the spec needs a list of sources")
        if any(float(s.get("weight", 1.0)) < 0 for s in config["sources"]):
            raise ValueError("weights must not be negative")
        known = {k: config[k] for k in ("processors", "output") if k in config}
        return cls(config["sources"], num_epochs=config.get("num_epochs") or 1, **known)


def process(spark: SparkSession, spec: PipelineSpec) -> tuple[DataFrame, DataFrame]:
    """The processed rows with ``_pos`` and ``_src``, and stage counts (stage, kept).

    The order is (source as listed, file, row); dedup works across sources in that order.
    """
    frames = []
    for n, s in enumerate(spec.sources):
        df = readers.read(spark, s["reader"])
        frames.append(df.withColumn("_src", F.lit(n)))
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    key = F.struct("_src", "src_file", "src_row")
    rows = rows.withColumn("_pos", key).withColumn("_dropped", F.lit(None).cast("string"))
    if not spec.processors:
        raise ValueError("a chain needs at least one step")
    # Stateless steps only mark what they drop; rows are written out and counted once before each step that
    # compares rows, and at the end.
    names = [f"{n} {p['type']}" for n, p in enumerate(spec.processors)]
    kept, counts = [], {}

    def settle(rows: DataFrame) -> DataFrame:
        rows = cut(rows)
        kept.append({r["_dropped"]: r["n"] for r in rows.groupBy("_dropped").agg(F.count("*").alias("n")).collect()})
        return rows.where("_dropped is null")

    open_: list[str] = ["input"]
    total = 0

    def book() -> None:
        nonlocal total, open_
        got = kept[-1]
        total = sum(got.values())
        for name in open_:
            total -= got.get(name, 0)
            counts[name] = total
        open_ = []

    for name, config in zip(names, spec.processors):
        step = processor(config)
        if isinstance(step, filters.Step):
            rows = step.mark(rows, name)
            open_.append(name)
        else:
            rows = settle(rows)
            book()
            rows = step(rows)
            open_.append(name)
    rows = settle(rows)
    book()
    order_ = [("input", counts["input"])] + [(p["type"], counts[n]) for n, p in zip(names, spec.processors)]
    out = [(stage, n, (order_[i - 1][1] if i else n) - n) for i, (stage, n) in enumerate(order_)]
    return rows.drop("_dropped"), spark.createDataFrame(out, "stage string, kept bigint, dropped bigint").coalesce(1)


def run(spark: SparkSession, spec: PipelineSpec, out_dir: str | None = None, max_docs: int | None = None, seed: int = 0) -> DataFrame:
    """Runs the spec and writes shards to out_dir (which wins over the spec's); gives the stage counts."""
    rows, stats = process(spark, spec)
    names = [f"s{n}" for n in range(len(spec.sources))]
    kept = rows.withColumn("_own", F.col("source")).withColumn("source", F.concat(F.lit("s"), F.col("_src").cast("string")))
    mixed = mix.weighted(kept, [(n, float(s.get("weight", 1.0))) for n, s in zip(names, spec.sources)], "_pos", seed, spec.num_epochs)
    mixed = mixed.withColumn("source", F.col("_own")).drop("_own", "_src", "_pos", "epoch", "src_file", "src_row")
    if max_docs is not None:
        mixed = mixed.where(F.col("out_pos") < max_docs)
    o = spec.output
    writers.write_shards(mixed, out_dir or o.get("dir", "out"), "out_pos", o.get("shard_size", 10_000), o.get("size_by", "records"), o.get("format", "jsonl"), o.get("prefix", "shard"))
    return stats


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--config", required=True)
    a.add_argument("--out")
    a.add_argument("--max-docs", type=int)
    a.add_argument("--seed", type=int, default=0)
    a.add_argument("--dry-run", action="store_true")
    x = a.parse_args()
    with open(x.config, encoding="utf-8") as f:
        spec = PipelineSpec.load(json.load(f))
    if x.dry_run:
        print(json.dumps({"sources": spec.sources, "processors": spec.processors, "output": spec.output, "seed": x.seed}, indent=1))
        return
    run(SparkSession.builder.getOrCreate(), spec, x.out, x.max_docs, x.seed).show()


if __name__ == "__main__":
    main()
