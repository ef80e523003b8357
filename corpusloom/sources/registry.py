"""Named datasets: a registry file, and copying one from a mirror into JSON Lines shards.

A registry is a JSON object of name -> {"dataset", "config", "split", "text_field", "keep_fields", "max_docs", "license", ...}.
Files come from a mirror that Spark's file systems reach; there is no other way over a network.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from . import files, readers, writers


def load(path: str, spark: SparkSession | None = None) -> dict[str, dict]:
    entries = json.loads(files.FileSystem(spark).read(path))
    if not isinstance(entries, dict) or any(not isinstance(e, dict) or not e.get("dataset") for e in entries.values()):
        raise ValueError("a registry names entries with a dataset each")
    return entries


def entry(entries: dict[str, dict], name: str) -> dict:
    if name not in entries:
        raise KeyError(f"unknown dataset {name!r}; known: {sorted(entries)}")
    return entries[name]


def rows(spark: SparkSession, e: dict, mirror: str) -> DataFrame:
    """The records of an entry: its first ``max_docs`` in order, with only ``keep_fields`` if they are given."""
    x = readers.read_dataset(spark, e["dataset"], mirror, e.get("split", "train"), e.get("config") or "", text_field=e.get("text_field", "text"))
    if e.get("max_docs") is not None:
        x = x.orderBy("src_no", "src_file", "src_row").limit(e["max_docs"])
    if e.get("keep_fields"):
        x = x.select(*[c for c in x.columns if c in {*e["keep_fields"], "text", "source", "src_no", "src_file", "src_row"}])
    return x


def download(spark: SparkSession, e: dict, mirror: str, out_dir: str, shard_size: int = 10_000) -> DataFrame:
    """Writes an entry as shards with a manifest; gives the manifest."""
    from pyspark.sql import functions as F

    x = rows(spark, e, mirror).withColumn("_pos", F.struct("src_no", "src_file", "src_row")).drop("src_no", "src_file", "src_row")
    return writers.write_shards(x, out_dir, "_pos", shard_size)


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("--registry", required=True)
    a.add_argument("--list", action="store_true")
    a.add_argument("--dataset")
    a.add_argument("--mirror")
    a.add_argument("--out")
    a.add_argument("--dry-run", action="store_true")
    x = a.parse_args()
    spark = SparkSession.builder.getOrCreate()
    entries = load(x.registry, spark)
    if x.list or not x.dataset:
        print("\n".join(sorted(entries)))
        return
    e = entry(entries, x.dataset)
    if x.dry_run:
        print(json.dumps(e, indent=1, sort_keys=True))
        return
    download(spark, e, x.mirror, x.out).show()


if __name__ == "__main__":
    main()
