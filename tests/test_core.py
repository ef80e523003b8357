"""Core operators against plain Python models, on small adversarial tables."""

import hashlib
import json
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import bpe, chat, contamination, dedup, filters, langid, mix, order, pack, stats, validate


def frame(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def ids(df, c="doc_id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_length_and_code_points(spark):
    df = frame(spark, ["", None, "a" * 49, "é" * 50, "😀" * 50, " " * 51])
    assert ids(filters.length_filter(50, 50)(df)) == [3, 4]


def test_quality_bounds_are_strict(spark):
    sound = "Thunderstorms gathered over distant mountains. Everybody hurried homewards."
    df = frame(spark, [sound, "aaaaaaaaaa.", "no mark here at all", "", None, "- a.\n- b.\n- c.", "\n\n\n.\nab cd ef"])
    assert ids(filters.quality_filter()(df)) == [0]
    # a share equal to the bound stays
    t = "ab.cdefghi" * 2
    assert ids(filters.quality_filter(max_top=0.1, max_punct=0.1)(frame(spark, [t]))) == [0]


def test_code_filter_modes(spark):
    df = frame(spark, ["def f():\n    return 1", "plain words\nmore words", "", None])
    assert ids(filters.code_filter("keep")(df)) == [0]
    assert ids(filters.code_filter("drop")(df)) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.code_filter("other")


def test_url_blacklist_falls_back_to_source(spark):
    df = spark.createDataFrame([(0, "http://bad.example/x", "s"), (1, "", "bad.example"), (2, None, None), (3, "http://ok", "bad.example")], "doc_id bigint, url string, source string")
    assert ids(filters.url_blacklist(["bad.example"])(df)) == [2, 3]


def test_language_guess(spark):
    texts = ["the and that", "le la les des", "der die und", "el los las", "こんにちは world", "hello мир", "", None, "xyz", "de la"]
    got = [r[0] for r in frame(spark, texts).orderBy("doc_id").select(langid.identify(F.coalesce("text", F.lit("")))).collect()]
    assert got == ["en", "fr", "de", "es", "ja", "ru", None, None, "en", "fr"]


def test_exact_dedup_unicode_space(spark):
    df = frame(spark, ["A b", "a B ", "a b", "ab", "a\x1cb", None, ""])
    assert ids(dedup.exact(df)) == [0, 3, 5]


def model_lsh(keys):
    seen, keep = set(), []
    for i, ks in enumerate(keys):
        for b, k in enumerate(ks):
            if (b, k) in seen:
                break
            seen.add((b, k))
        else:
            keep.append(i)
    return keep


def test_band_rule_is_the_ordered_one(spark):
    rng = random.Random(5)
    for trial in range(4):
        keys = [[rng.randrange(3) for _ in range(2)] for _ in range(14)]
        signed = spark.createDataFrame([(i, [k for k in ks]) for i, ks in enumerate(keys)], "doc_id bigint, sig array<bigint>")
        assert ids(dedup.near_by_bands(signed, "doc_id", 2, 2)) == model_lsh(keys), trial


def test_band_rule_known_cases(spark):
    for keys, keep in (([(0, 0), (1, 0), (1, 2)], [0]), ([(0, 0), (0, 1), (2, 1)], [0, 2])):
        signed = spark.createDataFrame([(i, list(k)) for i, k in enumerate(keys)], "doc_id bigint, sig array<bigint>")
        assert ids(dedup.near_by_bands(signed, "doc_id", 2, 2)) == keep


def test_minhash_equals_big_integers():
    import numpy as np

    fam = dedup.family(8)
    assert fam[0] == (1556973557671456323, 2030721756179007054)
    hs = [0, 1, 2**32 - 1, 123456789]
    assert dedup.affine_min(np.array(hs, np.uint64), fam) == [min((a * h + b) % dedup.PRIME for h in hs) for a, b in fam]


def test_capped_dedup(spark):
    df = frame(spark, ["alpha", "beta", "gamma", "alpha", "gamma"])
    assert ids(dedup.exact_capped(df, 2)) == [0, 1, 2, 4]
    assert ids(dedup.exact_capped(df, 0)) == [0, 1, 2, 3, 4]


def test_capped_bands(spark):
    signed = spark.createDataFrame([(i, [i, i]) for i in range(6)] + [(6, [0, 0])], "doc_id bigint, sig array<bigint>")
    assert ids(dedup.near_capped(signed, "doc_id", 4, 2, 2)) == [0, 1, 2, 3, 4, 5]


def test_contamination(spark):
    df = spark.createDataFrame([(0, "one two three four five", " x1 "), (1, "six seven", None), (2, "short", "y"), (3, None, "x1")], "pos bigint, text string, id string")
    listed = spark.createDataFrame([("x1",)], "id string")
    assert ids(contamination.hits_by_id(df, listed, "pos"), "pos") == [0, 3]
    assert ids(contamination.hits_by_substring(df, ["SIX  seven", " "], "pos"), "pos") == [1]
    texts = spark.createDataFrame([("zero two three four nine",), ("short",)], "text string")
    hits = contamination.hits_by_ngram(df, texts, 3, "pos")
    assert ids(hits, "pos") == [0, 2]
    flagged = {r["pos"]: r["contaminated"] for r in contamination.apply(df, hits, "pos", "flag").collect()}
    assert flagged == {0: True, 1: None, 2: True, 3: None}


def model_mix(counts, weights, seed, epochs):
    order_ = mix.shuffled(len(counts), seed)
    gain, left, active, out = dict.fromkeys(order_, 0.0), {i: counts[i] * epochs for i in order_}, list(order_), []
    while active:
        for i in active:
            gain[i] += weights[i]
        best = active[0]
        for i in active[1:]:
            if gain[i] > gain[best]:
                best = i
        gain[best] -= sum(weights)
        if left[best] == 0:
            active.remove(best)
            continue
        left[best] -= 1
        out.append(best)
    return out


def test_weighted_mix(spark):
    rows = [(i, "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string")
    got = mix.weighted(df, [("a", 4), ("b", 1), ("c", 0), ("none", 2)], seed=1, epochs=2).orderBy("out_pos").collect()
    assert [r["out_pos"] for r in got] == list(range(60))
    assert [r["source"] for r in got] == ["abcn"[i] for i in model_mix([10, 10, 10, 0], [4, 1, 0, 2], 1, 2)]
    a = [r["doc_id"] for r in got if r["source"] == "a"]
    assert a == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27] * 2
    for bad in ([], [-1.0, 2.0], [0.0, 0.0]):
        with pytest.raises(ValueError):
            mix.Rota([1] * len(bad), bad)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from([0.0, 1.0, 2.0, 3.0, 7.0, 0.25, 0.1, 0.7])), min_size=1, max_size=5), st.integers(0, 3), st.integers(1, 3))
def test_rota_is_the_step_by_step_rule(sources, seed, epochs):
    counts, weights = [n for n, _ in sources], [w for _, w in sources]
    if sum(weights) <= 0:
        return
    rota, want = mix.Rota(counts, weights, seed, epochs), model_mix(counts, weights, seed, epochs)
    got = [None] * len(want)
    for i, n in enumerate(counts):
        for p in rota.places(i, np.arange(n * epochs)) if n else []:
            got[p] = i
    assert got == want


def test_rota_holds_a_period_only():
    rota = mix.Rota([10**12, 3 * 10**11, 10**9], [4, 1, 2], 1)
    assert sum(len(turns) for _, turns, _ in rota.runs) < 1000
    assert rota.places(0, np.array([10**12 - 1]))[0] < 10**12 + 3 * 10**11 + 10**9


def test_seeded_split(spark, monkeypatch):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id bigint")
    order_ = list(range(50))
    random.Random(3).shuffle(order_)
    got = {r["doc_id"] for r in mix.seeded_split(df, 0.8, 3).where("in_train").collect()}
    assert got == set(order_[:40])
    monkeypatch.setattr(mix, "PERMUTED", 10)
    assert mix.seeded_split(df, 0.8, 3).where("in_train").count() == 40


def test_prefix_sum_by_group(spark):
    rows = [(i, i % 3 if i % 7 else None, i) for i in range(200)]
    df = spark.createDataFrame(rows, "k bigint, g int, v bigint")
    got = {r["k"]: r["b"] for r in order.prefix_sum(df, ["k"], {"b": "v"}, ["g"], parts=5).collect()}
    for k, g, _ in rows:
        assert got[k] == sum(v for j, h, v in rows if h == g and j < k)


def test_split_sizes():
    assert [mix.split_sizes(n, 0.5) for n in (2, 5, 7)] == [1, 2, 4]
    assert mix.split_sizes(10, 1.0) == 9 and mix.split_sizes(10, 0.0) == 1
    with pytest.raises(ValueError):
        mix.split_sizes(1, 0.5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lens=st.lists(st.integers(0, 23), min_size=1, max_size=12), width=st.integers(1, 9))
def test_pack_is_the_cut_stream(spark, lens, width):
    docs = [[100 * i + j for j in range(n)] for i, n in enumerate(lens)]
    df = spark.createDataFrame([(i, d, [1] * len(d)) for i, d in enumerate(docs)], "doc_id bigint, ids array<int>, mask array<int>")
    rows = pack.pack(df, width, pad=-1, mask="mask").orderBy("row_idx").collect()
    flat = [x for d in docs for x in d]
    want = [flat[i : i + width] for i in range(0, len(flat), width)]
    assert [[x for x in r["ids"] if x >= 0] for r in rows] == want
    assert all(len(r["ids"]) == width and sum(r["mask"]) == len([x for x in r["ids"] if x >= 0]) for r in rows)


def test_pack_drop_last_and_regions(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, []), (2, [4, 5])], "doc_id bigint, ids array<int>")
    assert [r["ids"] for r in pack.pack(df, 2, drop_last=True).orderBy("row_idx").collect()] == [[1, 2], [3, 4]]
    x = spark.createDataFrame([(i, 10) for i in range(8)], "doc_id bigint, num_tokens bigint")
    got = [r["phase"] for r in mix.regions(x, 1, 15, 40).orderBy("doc_id").collect()]
    assert got == ["skipped", "val", "val", "train", "train", "unused", "unused", "unused"]


def test_chat(spark):
    rows = [(1, 0, " User", " hi "), (1, 1, "GPT", "yo"), (1, 2, None, ""), (1, 3, "moderator", "x"), (2, 0, "tool", " ")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")
    assert {r["conv_id"]: r["text"] for r in chat.linearize(df).collect()} == {1: "User: hi\n\nAssistant: yo\n\nModerator: x"}
    e = chat.encode(df, eos=256).collect()
    assert len(e) == 1 and e[0]["ids"] == [*b"User: hi", *b"Assistant: yo", 256, *b"Moderator: x"]
    assert sum(e[0]["mask"]) == len("Assistant: yo") + 1


def naive_bpe(word, pairs):
    s = list(word)
    rank = {p: i for i, p in enumerate(pairs)}
    while True:
        c = [(rank[p], i) for i, p in enumerate(zip(s, s[1:])) if p in rank]
        if not c:
            return s
        r, i = min(c)
        s[i : i + 2] = [256 + r]


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet="ab é\n😀.1", max_size=90), seed=st.integers(0, 20))
def test_bpe_encode_is_exact_and_lossless(text, seed):
    rng = random.Random(seed)
    pairs = []
    for _ in range(12):
        have = [97, 98, 32, *range(256, 256 + len(pairs))]
        p = (rng.choice(have), rng.choice(have))
        if p not in pairs:
            pairs.append(p)
    tok = bpe.Merges(pairs)
    assert tok.decode(tok.encode(text)) == text
    assert "".join(bpe.split_words(text)) == text
    for w in bpe.split_words(text):
        raw = w.encode()
        assert list(tok.word(w)) == naive_bpe(raw, pairs) == tok._long(raw)


def test_bpe_train_larger_pair_wins(spark):
    counts = spark.createDataFrame([("ab", 5), ("cd", 5), ("abab", 1)], "word string, cnt bigint")
    tok = bpe.train(counts, 3)
    assert tok.pairs[0] == (97, 98) and tok.pairs[1] == (99, 100)
    assert bpe.train(counts, 3, max_words=2).pairs == tok.pairs


def test_nearest_rank_and_medians(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 7.0), ("b", None)], "g string, v double")
    got = {r["g"]: r for r in stats.nearest_rank(df, ["g"], "v").collect()}
    for g, vs in (("a", [1, 1, 5, 9]), ("b", [7])):
        n = len(vs)
        assert (got[g]["n"], got[g]["p50"], got[g]["p95"]) == (n, vs[min(n - 1, int(0.5 * (n - 1) + 0.5))], vs[min(n - 1, int(0.95 * (n - 1) + 0.5))])
    assert {r["g"]: r["median"] for r in stats.upper_median(df, ["g"], "v").collect()} == {"a": 5.0, "b": 7.0}


def test_generation_report(spark):
    df = spark.createDataFrame([(0, [1, 2, 3, 9]), (1, [7] * 8), (2, []), (3, [1])], "k bigint, ids array<int>")
    got = {r["k"]: r for r in stats.generation_report(df, "k", "ids", 9).collect()}
    assert got[0]["eos_stopped"] and not got[0]["degenerate"] and got[0]["distinct_2"] == 1.0
    assert got[1]["degenerate"] and got[1]["repeats"] == 6
    assert got[2]["distinct_1"] == 0.0 and not got[2]["degenerate"]
    assert got[3]["distinct_2"] == 1.0


def test_skip_runs(spark):
    flags = [0, 1, 1, 0, 1, 1, 1]
    df = spark.createDataFrame([("g", i, bool(f)) for i, f in enumerate(flags)] + [("h", 0, False)], "g string, i bigint, s boolean")
    got = {r["g"]: tuple(r)[1:] for r in stats.skip_runs(df, "i", "s", 3, ["g"]).collect()}
    assert got == {"g": (5, 3, 3, 6), "h": (0, 0, 0, None)}


def test_validation(spark):
    rows = spark.createDataFrame([(0, [1, 2]), (1, [3, -1]), (2, [9, 0])], "row_idx bigint, ids array<int>")
    assert ids(validate.id_violations(rows, 9), "row_idx") == [1, 2]
    m = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "shard string, count bigint")
    f = spark.createDataFrame([("a", 1), ("b", 3), ("d", 1)], "shard string, count bigint")
    assert sorted((r["shard"], r["problem"]) for r in validate.manifest_problems(m, f).collect()) == [("b", "count"), ("c", "missing"), ("d", "stray")]
    pads = spark.createDataFrame([(0, [1, 7]), (1, [7, 7]), (2, [1, 7])], "row_idx bigint, ids array<int>")
    assert ids(validate.pad_problems(pads, 7), "row_idx") == [0, 1]
    assert validate.resolve({"a": 3, "b": None}) == 3
    with pytest.raises(ValueError):
        validate.resolve({"a": 3, "b": 4})


def test_sources_and_pipeline(spark, tmp_path):
    from corpusloom.plans.pipeline import PipelineSpec, process, run
    from corpusloom.sources import readers

    a = tmp_path / "a.jsonl"
    a.write_text("\n".join([json.dumps({"text": "The first sound record. It ends."}), "no json", json.dumps({"x": 1}), json.dumps({"text": "Second one here.", "source": None, "n": 3}), "", json.dumps({"text": 5}), json.dumps({"text": "The first  sound record. It ends."})]))
    df = readers.read_jsonl(spark, str(a), source="mine")
    got = df.orderBy("src_row").collect()
    assert [r["source"] for r in got] == ["mine", None, "mine"] and got[1]["extra"] == {"n": "3"}
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"text": 5, "meta": {"text": "inner"}}\n{"text": "x"} trailing\n["text"]\n{"text": null}\n"text"\n{"a.b": 1, "text": "fine \\u00e9"}')
    assert [r["text"] for r in readers.read_jsonl(spark, str(bad)).collect()] == ["fine é"]
    assert {r["problem"]: r["lines"] for r in readers.jsonl_problems(spark, str(bad)).collect()} == {"malformed": 3, "no text": 2}
    assert {r["problem"]: r["lines"] for r in readers.jsonl_problems(spark, str(a)).collect()} == {"malformed": 1, "no text": 2}
    assert readers.jsonl_count(spark, str(a)) == 6
    t = tmp_path / "t.txt"
    t.write_text("one\ntwo\n\n  \nthree\n\n")
    assert [r["text"] for r in readers.read_text(spark, str(t), split_paragraphs=True).orderBy("src_row").collect()] == ["one\ntwo", "three"]
    assert [r["text"] for r in readers.read_text(spark, str(t)).collect()] == ["one\ntwo\n\n  \nthree"]
    spec = PipelineSpec.load({"sources": [{"reader": {"type": "jsonl", "path": str(a), "source": "mine"}, "weight": 2}, {"reader": {"type": "text", "path": str(t), "split_paragraphs": True}}], "processors": [{"type": "length", "min_chars": 4}, {"type": "exact_dedup"}]})
    rows, st_ = process(spark, spec)
    assert [tuple(r) for r in st_.collect()] == [("input", 5, 0), ("length", 5, 0), ("exact_dedup", 4, 1)]
    run(spark, spec, str(tmp_path / "out"))
    m = json.loads((tmp_path / "out" / "manifest.json").read_text())
    assert m["total_records"] == 4 and m["num_shards"] == 1
    again = readers.read_jsonl(spark, readers.resolve_shards(str(tmp_path / "out")))
    assert sorted(r["text"] for r in again.collect()) == ["Second one here.", "The first sound record. It ends.", "one\ntwo", "three"]
    chained = PipelineSpec.load({"sources": spec.sources, "processors": [{"type": "chain", "processors": [{"type": "length", "min_chars": 4}, {"type": "regex_filter", "pattern": "e"}]}, {"type": "exact_dedup"}, {"type": "regex_filter", "pattern": "[.]"}, {"type": "token_count"}]})
    rows, st_ = process(spark, chained)
    assert [tuple(r) for r in st_.collect()] == [("input", 5, 0), ("chain", 5, 0), ("exact_dedup", 4, 1), ("regex_filter", 2, 2), ("token_count", 2, 0)]
    assert all(r["num_tokens"] == len(r["text"]) for r in rows.collect())
    few = PipelineSpec.load({"sources": spec.sources[:1], "processors": [{"type": "length", "min_chars": 1}, {"type": "keep_fields", "fields": ["extra"]}]})
    run(spark, few, str(tmp_path / "few"))
    assert all(set(json.loads(r["value"])) == {"text", "source", "extra", "out_pos"} for r in spark.read.text(readers.resolve_shards(str(tmp_path / "few"))).collect())
    with pytest.raises(ValueError):
        PipelineSpec.load({"sources": []})
    with pytest.raises(ValueError):
        readers.read(spark, {"type": "nope"})


def test_shards(spark, tmp_path):
    from corpusloom.sources import writers

    df = spark.createDataFrame([(i, "x" * i, "a" if i % 2 else None) for i in range(10)], "k bigint, text string, source string")
    assert [r["shard"] for r in writers.shard_ids(df, "k", 3).orderBy("k").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    lines = [len(json.dumps({"text": "x" * i, "source": "a" if i % 2 else None}, separators=(",", ":"))) + 1 for i in range(10)]
    want, s, used = [], 0, 0
    for n in lines:
        want.append(s)
        used += n
        if used >= 70:
            s, used = s + 1, 0
    assert [r["shard"] for r in writers.shard_ids(df, "k", 70, "bytes").orderBy("k").collect()] == want
    from corpusloom.sources import readers

    for fmt in ("jsonl", "parquet"):
        out = str(tmp_path / fmt)
        listed = [r["shard"] for r in writers.write_shards(df, out, "k", 3, fmt=fmt).orderBy("index").collect()]
        paths = readers.resolve_shards(out)
        assert [p.rsplit("/", 1)[-1] for p in paths] == listed == [f"shard-{i:04d}.{fmt}" for i in range(4)]
        back = [[r["text"] for r in (readers.read_jsonl(spark, p).orderBy("src_row") if fmt == "jsonl" else spark.read.parquet(p)).collect()] for p in paths]
        assert back == [["x" * i for i in range(a, min(a + 3, 10))] for a in (0, 3, 6, 9)]
        assert readers.resolve_shards(out + "/manifest.json") == paths and (fmt == "parquet" or readers.resolve_shards(paths[0]) == [paths[0]])
    with pytest.raises(FileNotFoundError):
        readers.resolve_shards(str(tmp_path / "nowhere"))
    m = {r["index"]: r for r in writers.manifest(writers.shard_ids(df, "k", 3)).collect()}
    assert m[0]["sources"] == {"a": 1, "unknown": 2} and m[3]["shard"] == "shard-0003.jsonl"


def test_streaming_ingest(spark, tmp_path):
    from corpusloom.streaming import ingest, read_stream

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"text": "aaaa"}\n{"text": "AAAA "}\n')
    run = lambda: ingest(read_stream(spark, str(src), "text string"), filters.length_filter(3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text('{"text": "aaaa"}\n{"text": "bbbb"}\n{"text": "c"}\n')
    run()
    assert sorted(r["text"].strip().lower() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["aaaa", "bbbb"]


def test_nothing_outside_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "corpusloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", p.read_text(), re.M), p


def test_digest_is_sha256(spark):
    got = frame(spark, ["A  b"]).select(dedup.digest()).first()[0]
    assert got == hashlib.sha256(b"a b").hexdigest()


def test_training_is_the_same_on_the_driver_and_in_spark(spark, tmp_path):
    from corpusloom.operators import tokenizer as tk

    rng = random.Random(2)
    texts = spark.createDataFrame([(i, " ".join(rng.choice("the then thence mill miller river é".split()) for _ in range(30))) for i in range(20)], "doc_id bigint, text string")
    counts = bpe.word_counts(texts)
    here = bpe.train(counts, 25)
    assert bpe.train(counts, 25, max_words=2).pairs == here.pairs
    assert bpe.train(counts, 25, start=here.pairs[:7]).pairs == here.pairs == bpe.train_distributed(counts, 25, start=here.pairs[:7]).pairs
    for kind in ("simple", "gpt2"):
        config, path = tk.Config(256 + 4 + 20, pre_tokenize=kind), str(tmp_path / f"{kind}.json")
        whole, report = bpe.train_tokenizer(texts, config, every=6)
        assert report["merges"] == 20 and report["resumed_from"] == 0
        tk.Tokenizer(config, whole.merges[:5]).save(path)
        again, report = bpe.train_tokenizer(texts, config, path, every=6)
        assert again.merges == whole.merges and report["resumed_from"] == 5 and tk.Tokenizer.load(path).merges == whole.merges


def test_gpt2_words():
    from corpusloom.operators.tokenizer import gpt2_words

    cut = gpt2_words()
    assert cut("I'll go_to ٣ 12 é𝒳  x") == ["I", "'ll", " go", "_", "to", " ٣", " 12", " é", "𝒳", " ", " x"]


def test_corpora_datasets_and_registry(spark, tmp_path):
    from corpusloom.sources import readers, registry, synthetic, writers

    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "a.txt").write_text("one\n\n two \n")
    (tmp_path / "c" / "sub" / "b.jsonl").write_text('{"body": "three"}\n{"body": 4}\n')
    assert sorted(r["text"] for r in readers.read_corpus(spark, str(tmp_path / "c"), "body").collect()) == ["one", "three", "two"]
    assert [r["text"] for r in readers.read_corpus(spark, str(tmp_path / "c"), "body", max_docs=2).collect()] == ["one", "two"]
    with pytest.raises(Exception, match="no text in"):
        readers.read_corpus(spark, str(tmp_path / "c"), "body", "fail").collect()
    base = tmp_path / "mirror" / "lab" / "set"
    for name, texts in (("en/train-1", ["b", None]), ("en/train-0", ["a"]), ("en/test-0", ["t"]), ("fr/train-0", ["f"])):
        spark.createDataFrame([(x, 1, 2) for x in texts], "text string, n int, m int").coalesce(1).write.parquet(str(base / f"{name}.parquet"))
    got = readers.read(spark, {"type": "dataset", "dataset": "lab/set", "root": str(tmp_path / "mirror"), "split": "", "config": "fr"})
    assert [r["text"] for r in got.collect()] == ["f"]
    with pytest.raises(FileNotFoundError):
        readers.read_dataset(spark, "lab/none", str(tmp_path / "mirror"))
    ordered = readers.read_parquet(spark, [str(base / "en/train-1.parquet"), str(base / "en/train-0.parquet")])
    assert [r["text"] for r in ordered.orderBy("src_no", "src_file", "src_row").collect()] == ["b", "a"]
    assert readers.read_parquet(spark, str(base / "en/train-0.parquet"), text_column="n").collect() == []
    assert [r["idx"] for r in readers.documents(ordered, 5).orderBy("src_file").collect()] == [0, 0]
    (tmp_path / "r.json").write_text(json.dumps({"x": {"dataset": "lab/set", "config": "fr", "split": "", "keep_fields": ["n"], "max_docs": 1}}))
    entries = registry.load(str(tmp_path / "r.json"), spark)
    with pytest.raises(KeyError):
        registry.entry(entries, "y")
    registry.download(spark, registry.entry(entries, "x"), str(tmp_path / "mirror"), str(tmp_path / "got"))
    back = readers.read_jsonl(spark, readers.resolve_shards(str(tmp_path / "got"))).collect()
    assert [(r["text"], r["extra"]) for r in back] == [("f", {"n": "1"})]
    assert readers.page(spark.range(10), 3, 4, "id").count() == 4
    with pytest.raises(ValueError):
        readers.page(spark.range(10), 8, 4, "id")
    a, b = synthetic.chat(spark, 30, 4), synthetic.chat(spark, 30, 4).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and "### Assistant" in a.first()["text"]
    m = spark.createDataFrame([(2, None, 0.5)], "step int, note string, loss double")
    writers.append_metrics(m, str(tmp_path / "m"))
    writers.append_metrics(m, str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ['{"loss":0.5,"note":null,"step":2}'] * 2
    assert stats.markdown(m) == "| step | note | loss |\n| --- | --- | --- |\n| 2 | — | 0.5000 |"


def test_phase_paths_and_epochs(spark):
    from corpusloom.operators import prepare

    m = {"phases": {"train": [{"shard": "train-1"}, {"shard": "train-0"}]}}
    assert prepare.phase_paths(m, "train", "/x/") == ["/x/train-1.npy", "/x/train-0.npy"]
    with pytest.raises(ValueError):
        prepare.phase_paths(m, "val")
    rows = spark.range(7).withColumnRenamed("id", "row_idx")
    got = sorted((r["epoch"], r["row_idx"], r["batch"]) for r in pack.epochs(rows, 2, 3, (0, 4)).collect())
    assert got == [(0, 4, 1), (0, 5, 1)] + [(1, i, i // 3) for i in range(6)]


@settings(max_examples=100, deadline=None)
@given(text=st.text("abcde", max_size=40))
def test_older_encoding(text):
    pairs = [(97, 98), (98, 99), (256, 99), (99, 100), (258, 100), (100, 101)]
    old = bpe.Merges(pairs, exact=False)
    ids, ranks = list(text.encode()), {p: i for i, p in enumerate(pairs)}
    events = [(ranks[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
    while events:
        events.sort()
        _, i, p = events.pop(0)
        if ids[i : i + 2] == list(p):
            ids = [*ids[:i], 256 + ranks[p], *ids[i + 2 :]]
            events += [(ranks[q], j, q) for j in (i - 1, i) if j >= 0 and len(q := tuple(ids[j : j + 2])) == 2 and q in ranks]
    assert [i for w in bpe.split_words(text) for i in old.word(w)] == ids
    assert old.decode(ids) == text and len(ids) >= len(bpe.Merges(pairs).encode(text))


def test_files_say_how_they_are_encoded(spark, tmp_path):
    from corpusloom.operators import tokenizer as tk

    path = str(tmp_path / "t.json")
    pairs = [(97, 98), (256, 256), (257, 257)]
    for exact in (True, False):
        tk.Tokenizer(tk.Config(300), pairs, exact).save(path)
        back = tk.Tokenizer.load(path)
        assert back.exact == exact and back.decode(back.encode("ab" * 9)) == "ab" * 9
    assert len(back.encode("ab" * 9)) > len(tk.Tokenizer(tk.Config(300), pairs).encode("ab" * 9))


def test_shard_files_and_positions(spark, tmp_path):
    from corpusloom.operators import prepare

    m = {"phases": {"val": [{"shard": "val-00000"}], "train": [{"shard": "train-00000"}, {"shard": "train-00001"}]}}
    for n in ("val-00000.npy", "train-00001.npy", "train-00007.npy", "train-00000.npy.tmp", "notes.txt"):
        (tmp_path / n).write_text("")
    assert prepare.shard_files(spark, str(tmp_path), m) == {"missing": ["train-00000.npy"], "stray": ["train-00007.npy"], "unfinished": ["train-00000.npy.tmp"]}
    assert prepare.resume_position(None) == {"epoch": 1, "documents": 0, "rows": 0}
    assert prepare.resume_position({"epoch": 3, "rows": 7}) == {"epoch": 3, "documents": 0, "rows": 7}


def test_pooled_ranks(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(50)], "v double")
    got = stats.nearest_rank(df, [], "v").first()
    vs = sorted(float(i % 7) for i in range(50))
    assert (got["n"], got["p50"], got["p95"]) == (50, vs[int(0.5 * 49 + 0.5)], vs[int(0.95 * 49 + 0.5)])
    assert stats.upper_median(df, [], "v").first()[0] == vs[25]
