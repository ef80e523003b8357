"""From documents to packed regions with a manifest, and back from shards to a manifest."""

from __future__ import annotations

import io
import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from . import mix, pack, validate

#: The format name that packed manifests carry; another one may be given.
PACKED_FORMAT = "packed-tokens-v1"


@dataclass
class Plan:
    seq_len: int
    target_tokens: int
    val_tokens: int
    val_skip_docs: int = 0
    eos: int = 256
    pad: int = 257
    max_id: int = 258
    rows_per_shard: int = 16_384

    def __post_init__(self) -> None:
        if self.seq_len < 2 or self.target_tokens <= 0 or self.val_tokens <= 0 or self.val_skip_docs < 0:
            raise ValueError("lengths and budgets must be positive")
        if self.val_tokens >= self.target_tokens:
            raise ValueError("the target must be above the validation tokens")
        if self.eos == self.pad or not 0 <= self.eos < self.max_id or not 0 <= self.pad < self.max_id:
            raise ValueError("eos and pad must be different ids of the vocabulary")

    @property
    def dtype(self) -> str:
        return "uint16" if self.max_id <= 1 << 16 else "int32"


def packed(docs: DataFrame, plan: Plan, pos: str = "doc_id") -> DataFrame:
    """(phase, row_idx, ids, shard) from (pos, ids): regions cut by tokens, each document closed by eos, empty ones without."""
    ends = F.when(F.size("ids") > 0, F.concat("ids", F.array(F.lit(plan.eos)))).otherwise(F.col("ids"))
    x = docs.select(pos, ends.alias("ids")).withColumn("num_tokens", F.size("ids").cast("bigint"))
    x = mix.regions(x, plan.val_skip_docs, plan.val_tokens, plan.target_tokens, "num_tokens", pos).where("phase in ('val', 'train')")
    rows = pack.pack(x.select(pos, "phase", "ids"), plan.seq_len, pos, plan.pad, by=["phase"])
    return rows.withColumn("shard", F.floor(F.col("row_idx") / plan.rows_per_shard))


def manifest(rows: DataFrame, plan: Plan, name: str = PACKED_FORMAT) -> dict:
    """The manifest of packed rows; a region without rows is an error."""
    per = rows.groupBy("phase", "shard").agg(F.count("*").alias("rows")).orderBy("phase", "shard").collect()
    phases = {p: [{"shard": f"{p}-{r['shard']:05d}", "rows": r["rows"]} for r in per if r["phase"] == p] for p in ("val", "train")}
    if not phases["val"]:
        raise ValueError("the validation region is empty")
    return {"format": name, "seq_len": plan.seq_len, "dtype": plan.dtype, "eos_id": plan.eos, "pad_id": plan.pad, "phases": phases, "total_rows": {p: sum(s["rows"] for s in v) for p, v in phases.items()}}


def manifest_errors(m: dict, name: str = PACKED_FORMAT) -> list[str]:
    """Everything that is wrong with a manifest, not the first thing only."""
    out = []
    if m.get("format") != name:
        out.append("format")
    if not isinstance(m.get("seq_len"), int) or m["seq_len"] < 2:
        out.append("seq_len")
    if m.get("dtype") not in ("uint16", "int32"):
        out.append("dtype")
    phases = m.get("phases") or {}
    for p in ("val", "train"):
        shards = phases.get(p)
        if not shards:
            out.append(f"{p}: no shards")
            continue
        names = [s.get("shard") for s in shards]
        if len(set(names)) != len(names):
            out.append(f"{p}: a shard twice")
        if any(not isinstance(s.get("rows"), int) or s["rows"] <= 0 for s in shards):
            out.append(f"{p}: rows")
        if (m.get("total_rows") or {}).get(p) != sum(s.get("rows") or 0 for s in shards):
            out.append(f"{p}: total_rows")
    return out


def phase_paths(m: dict, phase: str, base: str = "", suffix: str = ".npy") -> list[str]:
    """Paths of a phase's shards in the manifest's order."""
    if phase not in (m.get("phases") or {}):
        raise ValueError(f"no phase {phase!r} in the manifest")
    return [f"{base.rstrip('/')}/{s['shard']}{suffix}".lstrip("/" if not base else "") for s in m["phases"][phase]]


def shard_files(spark: SparkSession, folder: str, m: dict, suffix: str = ".npy") -> dict[str, list[str]]:
    """Of a folder and its manifest: shards that are ``missing``, files that are ``stray``, and what a lost writer left ``unfinished``."""
    from ..sources.files import FileSystem

    fs = FileSystem(spark)
    there = set(fs.names(folder)) if fs.is_dir(folder) else set()
    listed = {s["shard"] + suffix for shards in (m.get("phases") or {}).values() for s in shards}
    unfinished = {n for n in there if n.endswith(".tmp")}
    return {"missing": sorted(listed - there), "stray": sorted(n for n in there - listed - unfinished if n.endswith(suffix)), "unfinished": sorted(unfinished)}


def write_npy(rows: DataFrame, plan: Plan, out_dir: str) -> DataFrame:
    """One ``.npy`` matrix per shard in a shared folder, written by its task under another name and renamed; (phase, shard, rows)."""
    import os

    os.makedirs(out_dir, exist_ok=True)
    dtype = plan.dtype

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx")
        phase, shard = pdf["phase"].iloc[0], int(pdf["shard"].iloc[0])
        path = os.path.join(out_dir, f"{phase}-{shard:05d}.npy")
        with open(path + ".tmp", "wb") as f:
            np.save(f, np.stack([np.asarray(x) for x in pdf["ids"]]).astype(dtype))
        os.replace(path + ".tmp", path)
        return pd.DataFrame({"phase": [phase], "shard": [shard], "rows": [len(pdf)]})

    return cut(rows.groupBy("phase", "shard").applyInPandas(save, "phase string, shard bigint, rows bigint"))


def inspect_npy(spark: SparkSession, path: str, seq_len: int, max_id: int, pad: int, eos: int) -> DataFrame:
    """Per ``.npy`` file: shape, type, smallest and largest id, documents, padding at the end, hash, and what is wrong with it."""

    def look(batches):
        import hashlib

        for pdf in batches:
            out = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                row = {"path": p, "rows": None, "width": None, "dtype": None, "min_id": None, "max_id": None, "documents": None, "padding": None, "sha256": hashlib.sha256(raw).hexdigest(), "problem": None}
                try:
                    a = np.load(io.BytesIO(raw), allow_pickle=False)
                    bad = [] if a.ndim == 2 and a.shape[1] == seq_len and a.shape[0] else ["shape"]
                    if not bad:
                        flat = a.ravel()
                        other = np.flatnonzero(flat[::-1] != pad)
                        row |= {"rows": a.shape[0], "width": a.shape[1], "dtype": str(a.dtype), "min_id": int(flat.min()), "max_id": int(flat.max()), "documents": int((flat == eos).sum()), "padding": int(other[0]) if len(other) else len(flat)}
                        bad = ["ids"] if flat.min() < 0 or flat.max() >= max_id else []
                    row["problem"] = ", ".join(bad) or None
                except Exception as e:
                    row["problem"] = f"unreadable: {type(e).__name__}"
                out.append(row)
            yield pd.DataFrame(out).astype({c: "Int64" for c in ("rows", "width", "min_id", "max_id", "documents", "padding")})

    schema = "path string, rows bigint, width bigint, dtype string, min_id bigint, max_id bigint, documents bigint, padding bigint, sha256 string, problem string"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content").mapInPandas(look, schema)


def recover(facts: DataFrame, seq_len: int, eos: dict[str, int | None], pad: dict[str, int | None], recorded: dict[str, int] | None = None) -> dict:
    """A manifest from inspected shards.  All shards at fault are named; origins of eos and pad must agree;
    recorded row counts are checked; what cannot be told is null."""
    rows = facts.orderBy("path").collect()
    wrong = [f"{r['path']}: {r['problem']}" for r in rows if r["problem"]]
    kinds = {r["dtype"] for r in rows if r["dtype"]}
    if len(kinds) > 1:
        wrong.append(f"types differ: {sorted(kinds)}")
    phases: dict[str, list] = {"val": [], "train": []}
    for r in rows:
        name = r["path"].rsplit("/", 1)[-1]
        for p in phases:
            if name.startswith(f"{p}-"):
                phases[p].append({"shard": name.removesuffix(".npy"), "rows": r["rows"], "sha256": r["sha256"]})
    wrong += [f"no {p} shards" for p, v in phases.items() if not v]
    e, q = validate.resolve(eos), validate.resolve(pad)
    if e == q:
        wrong.append("eos and pad are the same")
    totals = {p: sum(s["rows"] or 0 for s in v) for p, v in phases.items()}
    wrong += [f"{p}: {totals[p]} rows, recorded {n}" for p, n in (recorded or {}).items() if totals.get(p) != n]
    if wrong:
        raise ValueError("; ".join(wrong))
    return {"format": PACKED_FORMAT, "seq_len": seq_len, "dtype": kinds.pop(), "eos_id": e, "pad_id": q, "phases": phases, "total_rows": totals, "source_documents": None}


def resume_errors(saved: dict, now: dict) -> list[str]:
    """Why a saved run cannot go on: stage, dataset, fingerprint (if both know it), state, budget."""
    out = [k for k in ("stage", "dataset") if saved.get(k) != now.get(k)]
    if saved.get("fingerprint") and now.get("fingerprint") and saved["fingerprint"] != now["fingerprint"]:
        out.append("fingerprint")
    if not saved.get("state"):
        out.append("state")
    if (saved.get("tokens") or 0) > (now.get("budget") or 0):
        out.append("budget")
    return out


def resume_position(saved: dict | None) -> dict[str, int]:
    """Where a saved run goes on: its epoch (the first is 1) and the documents and rows before; the start where nothing is said."""
    at = saved or {}
    return {"epoch": int(at.get("epoch") or 1), "documents": int(at.get("documents") or 0), "rows": int(at.get("rows") or 0)}


def find_key(value, key: str):
    """The value of a key in nested JSON, the shallowest and first one; None if there is none."""
    level = [json.loads(value) if isinstance(value, str) else value]
    while level:
        below = []
        for x in level:
            if isinstance(x, dict):
                if key in x:
                    return x[key]
                below += x.values()
            elif isinstance(x, list):
                below += x
        level = below
    return None


def recurrence(spark: SparkSession, starts: DataFrame, vocab: int, length: int) -> DataFrame:
    """(seq, ids) with x[t] = (x[t-2] + x[t-1]) mod vocab, from (seq, a, b): b is the first id given out."""
    step = lambda s, _: F.struct(s["b"].alias("a"), ((s["a"] + s["b"]) % vocab).alias("b"), F.concat(s["ids"], F.array(s["b"])).alias("ids"))
    first = F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.array().cast("array<int>").alias("ids"))
    return starts.select("seq", F.aggregate(F.sequence(F.lit(1), F.lit(length)), first, step)["ids"].alias("ids"))
