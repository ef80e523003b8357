"""Tokenizer files, prepared corpora, and recovery of manifests."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import prepare
from corpusloom.operators import tokenizer as tk

MERGES = [(101, 32), (116, 104), (257, 256)]


@settings(max_examples=80, deadline=None)
@given(text=st.text(max_size=60), preset=st.sampled_from([None, "simple", "gpt2"]))
def test_round_trip_of_any_text(text, preset):
    text = text.encode("utf-8", "replace").decode()
    t = tk.Tokenizer(tk.Config(300, pre_tokenize=preset), MERGES)
    assert t.decode(t.encode(text, bos=True, eos=True)) == text
    assert "".join(t.decode(c) for c in t.chunks(text, 7)) == text


def test_layout_and_specials(tmp_path):
    t = tk.Tokenizer(tk.Config(300, extra_special_tokens=["<x>"]), MERGES)
    assert t.special_ids["<|beginoftext|>"] == 295 and t.special_ids["<x>"] == 299
    assert t.encode("a<x>b", split_special=True) == [97, 299, 98]
    assert t.encode("a<x>b") == [97, *b"<x>", 98]
    assert t.decode([97, 299], skip_special=False) == "a<x>"
    with pytest.raises(KeyError):
        t.decode([290])
    assert t.report()["unused"] == 300 - 256 - 3 - 5
    p = str(tmp_path / "t.json")
    t.save(p)
    u = tk.Tokenizer.load(p)
    assert u.encode("the end", eos=True) == t.encode("the end", eos=True) and len(tk.file_sha256(p)) == 64
    bad = json.loads(open(p).read()) | {"version": 2}
    open(p, "w").write(json.dumps(bad))
    with pytest.raises(ValueError):
        tk.Tokenizer.load(p)
    for kw in ({"vocab_size": 259}, {"eos_token": "<|pad|>"}):
        with pytest.raises(ValueError):
            tk.Config(**kw)
    with pytest.raises(ValueError):
        tk.Tokenizer(tk.Config(260), [(1, 2)])
    assert tk.resize_plan(t, tk.Tokenizer(tk.Config(310), MERGES[:2]))["added"] == 10


def test_prepare_write_inspect_recover(spark, tmp_path):
    docs = spark.createDataFrame([(i, list(range(97, 97 + i % 7))) for i in range(60)], "doc_id bigint, ids array<int>")
    plan = prepare.Plan(8, 150, 40, 2, rows_per_shard=4)
    rows = prepare.packed(docs, plan)
    stream = {"val": [], "train": []}
    taken = {"val": 0, "train": 0}
    for i in range(2, 60):
        ids = list(range(97, 97 + i % 7))
        t = [*ids, 256] if ids else []
        p = "val" if taken["val"] < 40 else "train"
        if p == "train" and sum(taken.values()) >= 150:
            break
        taken[p] += len(t)
        stream[p] += t
    got = {p: [x for r in rows.where(f"phase = '{p}'").orderBy("row_idx").collect() for x in r["ids"]] for p in stream}
    for p, s in stream.items():
        assert got[p][: len(s)] == s and set(got[p][len(s):]) <= {257} and len(got[p]) % 8 == 0
    m = prepare.manifest(rows, plan)
    assert prepare.manifest_errors(m) == []
    assert prepare.manifest_errors(m | {"dtype": "x", "total_rows": {}}) == ["dtype", "val: total_rows", "train: total_rows"]
    out = str(tmp_path / "npy")
    assert sum(r["rows"] for r in prepare.write_npy(rows, plan, out).collect()) == sum(m["total_rows"].values())
    facts = prepare.inspect_npy(spark, out, 8, plan.max_id, plan.pad, plan.eos)
    back = prepare.recover(facts, 8, {"cli": None, "tokenizer": 256}, {"cli": 257}, m["total_rows"])
    assert back["total_rows"] == m["total_rows"] and back["dtype"] == "uint16"
    with pytest.raises(ValueError, match="recorded"):
        prepare.recover(facts, 8, {"a": 256}, {"a": 257}, {"val": 1})
    np.save(f"{out}/train-00099.npy", np.zeros((2, 5), np.uint16))
    open(f"{out}/train-00098.npy", "wb").write(b"broken")
    with pytest.raises(ValueError) as e:
        prepare.recover(prepare.inspect_npy(spark, out, 8, 258, 257, 256), 8, {"a": 256}, {"a": 257})
    assert "shape" in str(e.value) and "unreadable" in str(e.value)


def test_small_rules():
    with pytest.raises(ValueError):
        prepare.Plan(8, 40, 40)
    a = {"stage": "a", "dataset": "d", "fingerprint": "f", "state": 1, "tokens": 5}
    assert prepare.resume_errors(a, {"stage": "a", "dataset": "d", "fingerprint": None, "budget": 5}) == []
    assert prepare.resume_errors(a | {"state": None}, {"stage": "b", "dataset": "d", "fingerprint": "g", "budget": 4}) == ["stage", "fingerprint", "state", "budget"]
    assert prepare.find_key('{"a": {"k": {"deep": 1}}, "b": [{"k": 2}]}', "k") == {"deep": 1}
    assert prepare.find_key([], "k") is None


def test_recurrence(spark):
    starts = spark.createDataFrame([(0, 3, 5)], "seq bigint, a int, b int")
    assert prepare.recurrence(spark, starts, 7, 5).first()["ids"] == [5, 1, 6, 0, 6]
