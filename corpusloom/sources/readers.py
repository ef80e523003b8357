"""Sources.  Each gives a DataFrame with ``text``, ``source`` and an order: (src_file, src_row).

A source that lives behind a network is read by Spark's file systems; paths may be
any that Spark can read.  Bad lines are left out and can be counted with ``jsonl_problems``.
"""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from ..functions.text import strip_space
from ..operators.order import position
from . import files

_FILE, _ROW = "_metadata.file_path", "_metadata.row_index"


def _paths(paths: str | Sequence[str]) -> list[str]:
    out = [paths] if isinstance(paths, str) else list(paths)
    if not out:
        raise ValueError("no paths")
    return out


def _line():
    """A number that rises with the lines of a file: by split (of 1 MB or more), then by line in it."""
    block = F.shiftright("_metadata.file_block_start", 20)
    return F.shiftleft(block, 33).bitwiseOR(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _jsonl(spark: SparkSession, paths: list[str], text_field: str) -> DataFrame:
    lines = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("src_file"), _line().alias("src_row"))
    lines = lines.where(F.length(strip_space(F.col("value"))) > 0)
    # A strict parse of the whole line.  Spark's parser stops after the first value; so the line must be the only element of an
    # array and the value of an object, and whatever follows it fits one of them at most.  Kinds are those
    # of the parsed values, so a key of the same name further down, or a number, is no text.
    inner = F.try_variant_get(F.try_parse_json(F.concat(F.lit('{"v":'), "value", F.lit("}"))), "$.v", "variant")
    listed = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    single = listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    v = lines.withColumn("_v", F.when(single, inner))
    field = F.try_variant_get("_v", f'$["{text_field}"]', "variant")
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    is_text = is_object & F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))
    x = v.withColumn("text", F.when(is_text, F.try_variant_get("_v", f'$["{text_field}"]', "string")))
    return x.withColumn("extra", F.when(is_object, F.from_json("value", "map<string,string>"))).drop("_v")


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], source: str = "jsonl", text_field: str = "text") -> DataFrame:
    """(text, source, extra, src_file, src_row): objects with a string text; gzip by extension.

    ``extra`` maps the other keys to their values as text.  A line without ``source`` takes
    the reader's; an explicit null stays null.  Lines that are no object, or more than one, or whose
    text is no string, are left out.
    """
    x = _jsonl(spark, _paths(paths), text_field).where("text is not null")
    own = F.when(F.map_contains_key("extra", F.lit("source")), F.col("extra")["source"]).otherwise(F.lit(source))
    rest = F.map_filter("extra", lambda k, v: ~k.isin(text_field, "source"))
    return x.select("text", own.alias("source"), rest.alias("extra"), "src_file", "src_row")


def jsonl_problems(spark: SparkSession, paths: str | Sequence[str], text_field: str = "text") -> DataFrame:
    """(problem, lines): malformed lines, and objects without a string text."""
    x = _jsonl(spark, _paths(paths), text_field).where("text is null")
    return x.groupBy(F.when(F.col("extra").isNull(), "malformed").otherwise("no text").alias("problem")).agg(F.count("*").alias("lines"))


def jsonl_count(spark: SparkSession, paths: str | Sequence[str]) -> int:
    """Non-blank lines, malformed ones too."""
    return spark.read.text(_paths(paths)).where(F.length(strip_space(F.col("value"))) > 0).count()


def read_text(spark: SparkSession, paths: str | Sequence[str], source: str = "text", split_paragraphs: bool = False) -> DataFrame:
    """(text, source, url, src_file, src_row): a file or, split, each run of non-blank lines is a record."""
    whole = spark.read.text(_paths(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("src_file"))
    if not split_paragraphs:
        return whole.select(strip_space(F.col("value")).alias("text"), F.lit(source).alias("source"), F.col("src_file").alias("url"), "src_file", F.lit(0).cast("bigint").alias("src_row"))
    blocks = whole.select("src_file", F.posexplode(F.split("value", r"(?U)\r?\n(?:[\s\x1c-\x1f&&[^\n]]*\n)+", -1)).alias("src_row", "p"))
    return blocks.select(strip_space(F.col("p")).alias("text"), F.lit(source).alias("source"), F.col("src_file").alias("url"), "src_file", F.col("src_row").cast("bigint").alias("src_row")).where("text <> ''")


def read_lines(spark: SparkSession, paths: str | Sequence[str], source: str = "text") -> DataFrame:
    """A document per non-blank line, as tokenizer corpora have it."""
    x = spark.read.text(_paths(paths)).select(strip_space(F.col("value")).alias("text"), F.lit(source).alias("source"), F.col("_metadata.file_path").alias("src_file"), _line().alias("src_row"))
    return x.where("text <> ''")


def read_corpus(spark: SparkSession, paths: str | Sequence[str], text_field: str = "text", on_invalid: str = "skip", max_docs: int | None = None) -> DataFrame:
    """(text, src_file, src_row): tokenizer corpora as they lie: a document per line of ``.txt``, by field of ``.jsonl`` and ``.json``.

    Folders are taken by name of their files.  Lines without a string text are left out, or with ``on_invalid='fail'`` an error.
    """
    if on_invalid not in ("skip", "fail"):
        raise ValueError("on_invalid must be 'skip' or 'fail'")
    fs = files.FileSystem(spark)
    found = [f for p in _paths(paths) for f in (fs.walk(p) if fs.is_dir(p) else [p])]
    lines, objects = [f for f in found if f.endswith((".txt", ".txt.gz"))], [f for f in found if f.endswith((".jsonl", ".json", ".jsonl.gz", ".json.gz"))]
    if not lines and not objects:
        raise FileNotFoundError(f"no .txt, .jsonl or .json under {paths}")
    parts = [read_lines(spark, lines).select("text", "src_file", "src_row")] if lines else []
    if objects:
        x = _jsonl(spark, objects, text_field)
        if on_invalid == "fail":
            text = F.when(F.col("text").isNotNull(), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("no text in "), "src_file", F.lit(": "), F.substring("value", 1, 200))))
            x = x.withColumn("text", text)
        parts.append(x.where("text is not null").select("text", "src_file", "src_row"))
    out = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return out if max_docs is None else out.orderBy("src_file", "src_row").limit(max_docs)


def documents(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` records in order of (file, row) over all shards, with ``idx``, their number within the file, for messages."""
    x = df.orderBy("src_file", "src_row").limit(limit)
    return position(x, ["src_row"], "idx", ["src_file"])


def page(df: DataFrame, start: int, size: int, pos: str = "doc_id") -> DataFrame:
    """Rows start .. start + size of the order; fewer than that are an error and no short page."""
    out = df.orderBy(pos).offset(start).limit(size)
    if (n := out.count()) != size:
        raise ValueError(f"{n} rows from {start} on, {size} were asked for")
    return out


def read_parquet(spark: SparkSession, paths: str | Sequence[str], source: str = "parquet", text_column: str = "text", columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a string text; only the named columns are read.

    ``src_no`` is the place of a row's file among the paths as given (files of one folder share it), so
    (src_no, src_file, src_row) is the order asked for.  A text column of another type has no texts, so no rows.
    """
    ps = _paths(paths)
    df = spark.read.parquet(*ps)
    if text_column not in df.columns:
        raise ValueError(f"no column {text_column!r}")
    if columns is not None and text_column not in columns:
        raise ValueError("columns must hold the text column")
    others = [c for c in (columns if columns is not None else df.columns) if c not in (text_column, "text", "source", "src_file", "src_row", "src_no")]
    own = F.coalesce(F.col("source"), F.lit(source)) if columns is None and "source" in df.columns else F.lit(source)
    text = F.col(text_column) if isinstance(df.schema[text_column].dataType, Ty.StringType) else F.lit(None).cast("string")
    no = F.lit(None).cast("int")
    for n, p in enumerate(ps):
        name = p.split("://")[-1].removeprefix("file:").rstrip("/")
        no = F.coalesce(no, F.when(F.col(_FILE).contains(name), F.lit(n)))
    return df.select(text.alias("text"), own.alias("source"), *others, F.col(_FILE).alias("src_file"), F.col(_ROW).alias("src_row"), no.alias("src_no")).where("text is not null")


def read_frame(df: DataFrame, source: str, text_field: str = "text") -> DataFrame:
    """A hosted dataset that is already a DataFrame: its field copied to ``text``, the original kept."""
    return df.where(F.col(text_field).isNotNull()).withColumn("text", F.col(text_field)).withColumn("source", F.lit(source))


def read_packed(spark: SparkSession, paths: str | Sequence[str], seq_len: int, max_id: int | None = None) -> DataFrame:
    """Packed rows (row_idx, ids); a row of another width or with an id out of range is an error when read."""
    df = spark.read.parquet(*_paths(paths))
    ok = F.size("ids") == seq_len
    if max_id is not None:
        ok = ok & (F.array_min("ids") >= 0) & (F.array_max("ids") < max_id)
    return df.withColumn("ids", F.when(ok, F.col("ids")).otherwise(F.raise_error(F.lit("a packed row has a wrong width or an id out of range"))))


def read_dataset(spark: SparkSession, dataset: str, root: str, split: str = "train", config: str = "", source: str | None = None, text_field: str = "text") -> DataFrame:
    """A dataset by its id from a mirror: Parquet files under ``root/dataset`` chosen by config and split; none is an error."""
    base = f"{root.rstrip('/')}/{dataset}"
    fs = files.FileSystem(spark)
    found = fs.walk(base) if fs.is_dir(base) else []
    chosen = select_files([f[len(base):].lstrip("/") for f in found], config, split)
    if not chosen:
        raise FileNotFoundError(f"no files of {dataset} for split {split!r} and config {config!r} under {root}")
    return read_parquet(spark, [f"{base}/{f}" for f in sorted(chosen)], source or dataset, text_field)


READERS = {"jsonl": read_jsonl, "text": read_text, "lines": read_lines, "parquet": read_parquet}


def read(spark: SparkSession, config: dict) -> DataFrame:
    """A reader by ``{"type": ..., "path"/"paths": ..., options}``."""
    cfg = dict(config)
    kind = cfg.pop("type", None)
    if kind not in READERS and kind != "dataset":
        raise ValueError(f"unknown reader {kind!r}; known: {sorted([*READERS, 'dataset'])}")
    if kind == "dataset":
        return read_dataset(spark, **cfg)
    paths = cfg.pop("path", None) or cfg.pop("paths", None)
    return READERS[kind](spark, paths, **cfg)


def resolve_shards(path: str, manifest_name: str = "manifest.json", spark: SparkSession | None = None) -> list[str]:
    """Shard files in order: one file, a manifest's (missing ones left out), or a folder's ``*.jsonl`` by name.

    Works on any file system that Spark reads, where a session is given or active.
    """
    fs = files.FileSystem(spark)
    if fs.is_file(path):
        if path.endswith((".jsonl", ".jsonl.gz", ".parquet")):
            return [path]
        if path.rsplit("/", 1)[-1] != manifest_name:
            raise ValueError(f"no shard or manifest: {path}")
        base = path[: -len(manifest_name)].rstrip("/")
        out = [f"{base}/{s['shard']}" for s in json.loads(fs.read(path)).get("shards", [])]
        out = [p for p in out if fs.is_file(p)]
    elif fs.is_dir(path):
        base = path.rstrip("/")
        if fs.is_file(m := f"{base}/{manifest_name}"):
            return resolve_shards(m, manifest_name, spark)
        out = sorted(f"{base}/{f}" for f in fs.names(path) if f.endswith(".jsonl"))
    else:
        raise FileNotFoundError(path)
    if not out:
        raise FileNotFoundError(f"no shards under {path}")
    return out


def select_files(names: Sequence[str], config: str = "", split: str = "", pattern: str = "*.parquet") -> list[str]:
    """Data files of a dataset by config (as named, else with ``-`` as ``/``) and by split in the file's name."""
    out = [n for n in names if fnmatch.fnmatch(n.rsplit("/", 1)[-1], pattern)]
    if config:
        out = [n for n in out if config in n] or [n for n in out if config.replace("-", "/") in n]
    return [n for n in out if split in os.path.basename(n)] if split else out
