"""Sinks: shards in order, with a manifest.

Spark's committer makes each write whole or nothing; a manifest is written by rename.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import position
from ..session import cut
from . import files

#: Most records that a shard holds, whatever its size in bytes.
MOST_RECORDS = 10_000


def shard_ids(df: DataFrame, pos: str, shard_size: int = 10_000, size_by: str = "records") -> DataFrame:
    """Adds ``shard``: records in order, a shard closing at shard_size records or JSON bytes, the last record in.

    By bytes each shard depends on the one before, so that rule runs in one task,
    over (pos, bytes) alone.
    """
    if size_by == "records":
        return position(df, [pos], "_i").withColumn("shard", F.floor(F.col("_i") / min(shard_size, MOST_RECORDS))).drop("_i")
    if size_by != "bytes":
        raise ValueError("size_by must be 'records' or 'bytes'")
    line = F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != pos] or [pos]), {"ignoreNullFields": "false"})) + 1
    kind = df.schema[pos].dataType.simpleString()

    def close(batches):
        shard = used = held = 0
        for pdf in batches:
            out = []
            for n in pdf["_b"]:
                out.append(shard)
                used, held = used + n, held + 1
                if used >= shard_size or held >= MOST_RECORDS:
                    shard, used, held = shard + 1, 0, 0
            yield pd.DataFrame({pos: pdf[pos], "shard": out})

    ids = df.select(pos, line.alias("_b")).orderBy(pos).coalesce(1).mapInPandas(close, f"{pos} {kind}, shard bigint")
    return df.join(ids, pos)


def manifest(sharded: DataFrame, prefix: str = "shard", fmt: str = "jsonl") -> DataFrame:
    """(shard, index, count, sources): records per shard, and per source in it."""
    src = F.coalesce(F.col("source"), F.lit("unknown"))
    per = sharded.groupBy("shard", src.alias("s")).agg(F.count("*").alias("n"))
    out = per.groupBy("shard").agg(F.sum("n").alias("count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("s", "n")))).alias("sources"))
    return out.select(F.format_string(f"{prefix}-%04d.{fmt}", "shard").alias("shard"), F.col("shard").alias("index"), "count", "sources")


def write_shards(df: DataFrame, out_dir: str, pos: str, shard_size: int = 10_000, size_by: str = "records", fmt: str = "jsonl", prefix: str = "shard") -> DataFrame:
    """Writes one file per shard, named as in the manifest, and ``manifest.json`` last; gives the manifest.

    Columns with ``_`` in front serve the order and are not written.

    A shard is whole in one part of a range partition, so Spark writes it as one file into a folder
    beside; the driver renames the files, as a committer does, and reads none.
    """
    fs = files.FileSystem(df.sparkSession)
    sharded = cut(shard_ids(df, pos, shard_size, size_by))
    beside = f"{out_dir.rstrip('/')}/_{prefix}"
    body = sharded.repartitionByRange("shard").sortWithinPartitions("shard", pos).drop(*[c for c in df.columns if c.startswith("_")]).write.mode("overwrite").partitionBy("shard")
    body.json(beside, ignoreNullFields=False) if fmt == "jsonl" else body.parquet(beside)
    m = manifest(sharded, prefix, fmt)
    rows = [r.asDict() for r in m.orderBy("index").collect()]
    for r in rows:
        folder = f"{beside}/shard={r['index']}"
        part = [n for n in fs.names(folder) if n.startswith("part-")]
        if len(part) != 1:
            raise OSError(f"shard {r['index']} came in {len(part)} files")
        fs.move(f"{folder}/{part[0]}", f"{out_dir.rstrip('/')}/{r['shard']}")
    fs.remove(beside)
    write_json({"format": fmt, "size_by": size_by, "shard_size": shard_size, "num_shards": len(rows), "total_records": sum(r["count"] for r in rows), "shards": rows}, f"{out_dir.rstrip('/')}/manifest.json")
    return m


def write_json(value, path: str) -> None:
    """Whole or not at all, on any file system of Spark's: written beside and renamed."""
    files.FileSystem().write(path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Rows appended to a folder of JSON lines, keys in order, nulls written; each call is whole or nothing."""
    sorted_json(rows).select(F.col("line").alias("value")).coalesce(1).write.mode("append").text(path)


def sorted_json(df: DataFrame) -> DataFrame:
    """(line): each row as JSON with its keys in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows, characters, bytes and a hash of the set of rows, the same in any order and partitioning."""
    lines = sorted_json(df).withColumn("h", F.xxhash64("line"))
    facts = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("chars"))
    digest = lines.agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes"), F.hex(F.coalesce(F.bit_xor("h"), F.lit(0))).alias("digest"))
    return facts.crossJoin(digest)
