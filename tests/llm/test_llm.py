"""Training-data operators against brute force, invariants and stated edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions.text import plain_words
from corpusloom.llm import filling, lang, leakage, mixing, pairs, split_overlap, subjects, token_budget
from corpusloom.operators import bpe

TOK = bpe.Merges([(101, 32), (116, 104), (257, 256), (97, 110)])
NAMES = "Arbo Belin Cado Derin Elvo Farin Gulo Harin Ilmo Jarin Kelo Lorin".split()


# ---- 1. broken pairs --------------------------------------------------------

CONV = "conv_id bigint, turn bigint, role string, content string, ingested_at timestamp, answer string, question string, q string"


def conv(spark, turns):
    """turns: (conv, turn, role, content); further columns have clashing names."""
    return spark.createDataFrame([(c, t, r, x, None, "a", "b", "c") for c, t, r, x in turns], CONV)


def filler(n=40):
    """Turns that show where sentences end."""
    out = []
    for i in range(n):
        a, b = NAMES[i % 12], NAMES[(i * 5 + 1) % 12]
        out += [(1000 + i, 0, "user", f"What does {a} think about the river near {b}?"), (1000 + i, 1, "assistant", f"The river near {b} is a matter of patience. {a} once lost the boat and found it beside the mill.")]
    return out


Q = "What should Arbo check before the boat reaches the mill?"
CASES = [
    (None, "empty"), ("", "empty"), ("  ", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("<p></p>", "empty"), ("[no response]", "empty"), ("Assistant:", "empty"), ("…", "empty"), ("OK 👍", None), ("Yes.", None), ("42", None), ("(B)", None), ("75 km", None),
    ("I'm sorry, but I can't help with that. I hope you understand.", "refusal"), ("SORRY, I AM NOT ABLE TO ANSWER THIS ONE.", "refusal"), ("So, the mill again. With respect, I have to decline the request.", "refusal"),
    ("I can't say for certain, but here is what is known. The river near Belin is a matter of patience.", None), ('You could write: "I\'m sorry, but I can\'t help with that this Monday." Then add a kind word.', None),
    (Q, "copy"), (Q.upper(), "copy"), (f"<p>{Q}</p>", "copy"), (f"You asked: {Q}", "copy"), ("What shuold Arbo check befor the boat reaches the mill", "copy"), (f"{Q}\n{Q}", "copy"), (f"{Q} The river near Belin is a matter of patience. Cado once lost the boat and found it beside the mill.", None),
    ("The river near Belin is a matter of patience. Cado once lost the boat and found", "truncated"), ("The river near Belin is a matter of patience. Cado once lost the boat and found it beside the mill", None), ("In brief:\n1. The river near Belin is a matter of patience.\n2.", "truncated"),
    ("The river (near Belin is a matter of patience.", "truncated"), ("See:\n```python\nx = 1\n", "truncated"), ("The river near Belin is a matter of patience.\n\nCado", None), ("There are three reasons. First, the river near Belin. Second,", "truncated"),
    ("Der Fluss bei Belin ist eine Frage der Geduld. Niemand weiß, warum das Boot nicht mehr da ist.", "other_language"), ("Река возле мельницы спокойна, и никто не знает почему.", "other_language"),
]


def test_broken_pairs(spark):
    turns = filler()
    turns += [(2000 + i, j, r, x) for i in range(4) for j, r, x in ((0, "user", Q), (1, "bot", f"{i + 3} km"))]
    for i, (a, _) in enumerate(CASES):
        turns += [(i, 0, " Human", Q), (i, 3, "GPT ", a), (i, 3, "GPT ", a)]
    got = {r["conv_id"]: r["defect"] for r in pairs.broken_pairs(conv(spark, turns)).collect()}
    assert {i: got.get(i) for i in range(len(CASES))} == {i: d for i, (_, d) in enumerate(CASES)}
    assert len(got) == sum(d is not None for _, d in CASES)


def test_broken_pairs_requests_for_the_text(spark):
    turns = filler() + [
        (1, 0, "user", "Repeat this line exactly: The river near Belin is a matter of patience."), (1, 1, "bot", "The river near Belin is a matter of patience."),
        (2, 0, "user", "Answer in German, please: What is the river near Belin like?"), (2, 1, "bot", "Der Fluss bei Belin ist eine Frage der Geduld und nicht mehr."),
        (3, 0, "system", "x"), (3, 1, "assistant", ""), (4, None, "user", Q), (None, 1, "assistant", ""), (5, 0, "user", None), (5, 1, "assistant", None), (6, 0, "moderator", Q), (6, 1, "assistant", ""),
    ]
    assert [(r["conv_id"], r["defect"]) for r in pairs.broken_pairs(conv(spark, turns)).collect()] == [(5, "empty")]
    assert pairs.broken_pairs(conv(spark, [])).collect() == []


def test_long_conversations_cross_blocks(spark, monkeypatch):
    n = pairs.TURN_BLOCK
    turns = [(1, 0, "user", Q), (1, n + 5, "assistant", ""), (1, 3 * n, "assistant", Q), (1, 3 * n + 1, "user", "Another one here?"), (1, 4 * n + 2, "assistant", Q), (2, 7 * n, "assistant", Q)]
    got = {r["turn"]: r["question"] for r in pairs.answers(conv(spark, turns)).collect()}
    assert got == {n + 5: Q, 3 * n: Q, 4 * n + 2: "Another one here?"}
    monkeypatch.setattr(pairs, "TURN_BLOCK", 4)
    rng = random.Random(8)
    turns, want = [], {}
    for c in range(6):
        asked = False
        for t in sorted(rng.sample(range(900), 60)):
            r = "user" if rng.random() < 0.04 else "assistant"
            turns.append((c, t, r, f"{c} {t}"))
            if r == "user":
                asked = f"{c} {t}"
            elif asked:
                want[c, t] = asked
    turns += [(7, 2, "user", None), (7, 50, "assistant", "x")]
    want[7, 50] = None
    assert {(r["conv_id"], r["turn"]): r["question"] for r in pairs.answers(conv(spark, turns)).collect()} == want


def test_held_out_refusals():
    import os
    import sys

    sys.path.insert(0, os.path.dirname(__file__))
    from held_out import REFUSALS, SOUND

    found = sum(map(pairs.is_refusal, REFUSALS))
    wrong = sum(map(pairs.is_refusal, SOUND))
    assert len(REFUSALS) >= 100 and len(SOUND) >= 100
    assert found >= 0.95 * len(REFUSALS) and found / (found + wrong) >= 0.97


def test_requests_inside_long_questions():
    text = "The river near Belin is a matter of patience and of good boats."
    long = "Arbo lives by the mill. " * 12
    assert pairs.is_copy(f"{long}Please repeat the next line. {text}", text) is False
    assert pairs.is_copy(f"{long}{text}", f"{long}{text}") and pairs.is_copy(text, " ".join([text] * 9))
    assert pairs.is_copy(text, text.replace(" ", "")) and not pairs.is_copy(f'Repeat: "{text}"', text)


@settings(max_examples=200, deadline=None)
@given(a=st.lists(st.integers(0, 4), max_size=12), b=st.lists(st.integers(0, 4), max_size=12))
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert pairs.lcs_length(a, b) == t[-1][-1]


def test_language_vote():
    assert lang.identify("Der Fluss ist nicht mehr das, was er war.") == "de"
    assert lang.identify("旅館と観光には深い関係がある。") == "ja"
    assert lang.identify("Arbo Belin Cado") is None


# ---- 2. token budget --------------------------------------------------------

DOCS = "doc_id bigint, text string, lang string, source string, domain string, tokens bigint, h string, copies bigint, share double, n bigint, rank bigint, piece bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, d, 1, "x", 1, 0.5, 2, 3, 4) for i, t, g, s, d in rows], DOCS)


def test_token_budget(spark):
    rows = [(0, "the hen", "EN", "Wiki_EN ", "web"), (1, "the hen", "en-XX", "wiki-en", "WEB"), (2, "the hen", None, "wiki-en", "web"), (3, None, "en", None, None), (4, "", "und", "", "web"), (5, "x" * 5000 + " the", "en", "wiki-en", "web"), (None, "the hen of none", "en", "wiki-en", "web"), (None, "another of none", "en", "wiki-en", "web")]
    got = {(r["source"], r["lang"], r["domain"]): r for r in token_budget.budget(docs(spark, rows), TOK).collect()}
    want = defaultdict(lambda: [0, 0, set()])
    clean = lambda x: re.sub(r"[_\s]+", "-", (x or "").strip().lower()) or "unknown"
    for _, t, g, s, d in rows:
        g = clean(g).split("-")[0]
        k = (clean(s), "unknown" if g == "und" else g, clean(d))
        want[k][0] += 1
        want[k][1] += TOK.count(t or "")
        want[k][2] |= {t} - {None}
    assert {k: (r["documents"], r["tokens"], r["distinct_texts"]) for k, r in got.items()} == {k: (a, b, len(c)) for k, (a, b, c) in want.items()}
    assert abs(sum(r["share"] for r in got.values()) - 1) < 1e-9
    assert token_budget.budget(docs(spark, []), TOK).collect() == []


# ---- 3. overlap of splits ---------------------------------------------------


def noisy(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        k, i = rng.randrange(3), rng.randrange(len(w)) if w else 0
        if k == 0 and len(w) > 1:
            del w[i]
        elif k == 1:
            w.insert(i, rng.choice(NAMES))
        else:
            w[i] = rng.choice(NAMES)
    return w


def test_split_overlap_is_brute_force(spark):
    rng = random.Random(2)
    rows, n = [], 0
    for _ in range(150):
        base = [rng.choice(NAMES + "the of a river boat mill near is".split()) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 11, 16, 30, 60]))]
        for split in rng.sample(["Train ", "train", "dev", "DEV", "other", None], 3):
            w = noisy(rng, base, rng.randrange(0, max(1, len(base) // 7) + 1))
            text = " ".join(f"<b>{x}</b>" if rng.random() < 0.1 else x.upper() if rng.random() < 0.1 else x for x in w)
            rows.append((n, rng.choice(["d1", "d1", "d2"]), split, "s", text, "clash"))
            n += 1
    rows += rows[:10] + [(n, "d1", "dev", None, None, "c"), (n + 1, "d1", "train", None, " \n", "c"), (n + 2, "d1", "dev", None, "...", "c")]
    records = spark.createDataFrame(rows, "record_id bigint, dataset_id string, split string, source string, text string, cls string")
    stages = spark.createDataFrame([("d1", "train", "dev"), ("d1", " TRAIN", "missing"), ("d2", "train", "dev")], "dataset_id string, train_split string, val_split string")
    side = lambda s: (s or "").strip().lower()
    want = set()
    for a in rows:
        for b in rows:
            if a[1] == b[1] and side(a[2]) == "dev" and side(b[2]) == "train" and a[4] and b[4]:
                x, y = plain_words(a[4]), plain_words(b[4])
                if x and y and 5 * pairs.lcs_length(x, y) >= 4 * max(len(x), len(y)):
                    want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {tuple(r) for r in split_overlap.found(records, stages).collect()}
    assert len(want) > 20 and want == got
    assert split_overlap.found(records.limit(0), stages).collect() == []
    hits = Counter()
    for r in split_overlap.report(records, stages).collect():
        hits[r["dataset_id"], r["split"]] += r["overlapping"]
    ds = {r[0]: (r[1], side(r[2])) for r in rows}
    assert hits["d1", "dev"] == len({i for p in want for i in p if ds[i] == ("d1", "dev")})


def moved(rng, w, new):
    """A passage of a fifth put somewhere else."""
    k = len(w) // 5
    i, j = rng.randrange(len(w) - k + 1), rng.randrange(len(w) - k + 1)
    rest = w[:i] + w[i + k :]
    return rest[:j] + w[i : i + k] + rest[j:]


def head_to_tail(rng, w, new):
    """A fifth dropped in front, as much added behind, or the other way."""
    k = len(w) // 5
    return w[k:] + [new() for _ in range(k)] if rng.random() < 0.5 else [new() for _ in range(k)] + w[: len(w) - k]


def scattered(rng, w, new):
    """A tenth dropped here and there, as much put in."""
    k = len(w) // 10
    gone = set(rng.sample(range(len(w)), k))
    w = [x for i, x in enumerate(w) if i not in gone]
    for _ in range(k):
        w.insert(rng.randrange(len(w) + 1), new())
    return w


def replaced(rng, w, new):
    """A fifth of the words replaced in place."""
    w = list(w)
    for i in rng.sample(range(len(w)), len(w) // 5):
        w[i] = new()
    return w


def test_every_kind_of_edit_is_found(spark):
    rng = random.Random(11)
    vocab = [a + b + c for a in "ba ke lo mi nu".split() for b in "rin tos vel mar".split() for c in "ta po ke".split()] + "the of and to in a is".split() * 4
    new = lambda: rng.choice(vocab)
    rows, want = [], {}
    for kind in (moved, head_to_tail, scattered, replaced):
        for n in range(60):
            base = [new() for _ in range(rng.randrange(20, 101))]
            i = len(rows)
            rows += [(i, "d", "dev", "s", " ".join(base), ""), (i + 1, "d", "train", "s", " ".join(kind(rng, base, new)), "")]
            want[i, i + 1] = kind.__name__
    words = {r[0]: r[4].split() for r in rows}
    want = {p: k for p, k in want.items() if 5 * pairs.lcs_length(words[p[0]], words[p[1]]) >= 4 * max(map(len, (words[p[0]], words[p[1]])))}
    assert all(n >= 55 for n in Counter(want.values()).values()) and len(set(want.values())) == 4
    records = spark.createDataFrame(rows, "record_id bigint, dataset_id string, split string, source string, text string, cls string")
    stages = spark.createDataFrame([("d", "train", "dev")], "dataset_id string, train_split string, val_split string")
    got = {tuple(r) for r in split_overlap.found(records, stages).collect()}
    assert set(want) == got


@settings(max_examples=400, deadline=None)
@given(a=st.lists(st.integers(0, 3), min_size=1, max_size=24), b=st.lists(st.integers(0, 3), min_size=1, max_size=24))
def test_near_same(a, b):
    for x, y in ((a, b), (a, a[2:] + b[:2]), (a, a[:-1] + b[:1])):
        assert split_overlap.near_same(x, y) == (5 * pairs.lcs_length(x, y) >= 4 * max(len(x), len(y)))


def test_heavy_segments_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(split_overlap, "HEAVY", 3)
    rng = random.Random(5)
    rows = [(i, "d", "dev" if i % 2 else "train", "s", f"the mill is near the river of {NAMES[i % 5]} and {NAMES[i % 7]} at noon", "") for i in range(70)]
    records = spark.createDataFrame(rows, "record_id bigint, dataset_id string, split string, source string, text string, cls string")
    stages = spark.createDataFrame([("d", "train", "dev")], "dataset_id string, train_split string, val_split string")
    want = {(min(i, j), max(i, j)) for i in range(1, 70, 2) for j in range(0, 70, 2) if split_overlap.near_same(rows[i][4].lower().split(), rows[j][4].lower().split())}
    got = [tuple(r) for r in split_overlap.found(records, stages).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_segments_are_enough_and_disjoint():
    for n in range(1, 120):
        s = split_overlap.segments_of(list(range(n)), {i: i % 7 for i in range(n)})
        assert len(s) == split_overlap.most_edits(n) + 1
        assert all(a < b <= c for (a, b), (c, _) in zip(s, [*s[1:], (n, n)]))


def test_texts_of_one_template_seldom_meet():
    """Pairs that the join gives out are all near-same pairs and few others, from few rows a text."""
    rng = random.Random(8)
    phrases = "the council of @ wrote to @ about the bank|after @ attempts the bridge became steady|@ and @ disagree on whether the river needs a boat|in @ the @ of @ was described as broad".split("|")
    texts = []
    for _ in range(300):
        texts.append([f"n{rng.randrange(3000)}" if w == "@" else w for p in rng.choices(phrases, k=rng.choice([3, 12, 30])) for w in p.split()])
    texts += [noisy(rng, w, len(w) // 12) for w in texts[:40]]
    frame = pd.DataFrame({"dataset_id": "d", "cls": range(len(texts)), "words": [np.array([zlib.crc32(w.encode()) >> 1 for w in ws], np.int32) for ws in texts]})
    hashes = split_overlap.numbered(frame)[0]
    counts = np.bincount((hashes >> np.uint64(64 - split_overlap.COUNTS)).astype(np.int64), minlength=1 << split_overlap.COUNTS)
    rows = split_overlap.rarest(frame, counts)
    assert len(rows) == sum(len(w) // 5 + 1 for w in texts)
    both = pd.concat([rows[rows["cls"] < 300].assign(salt=0, side=0), rows[rows["cls"] >= 300].assign(salt=0, side=1)]).sort_values(["key", "side"])
    met = set()
    for size in (7, 1000, len(both)):
        got = {p for x in split_overlap._meet(both.iloc[i : i + size] for i in range(0, len(both), size)) for p in zip(x["v_cls"], x["t_cls"])}
        met = met or got
        assert got == met
    want = {(i, j) for i in range(300) for j in range(300, 340) if split_overlap.near_same(texts[i], texts[j])}
    assert want <= met and len(want) >= 40 and len(met - want) < len(want)


# ---- 4. mixing --------------------------------------------------------------


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, "the " * rng.randrange(1, 40), "en", s, "web") for i, s in enumerate(rng.choices(["big", "Big ", "small", "tiny"], [60, 20, 15, 5], k=400))] + [(900, None, "en", "big", "web"), (901, "", "en", "small", "web")]
    mixes = spark.createDataFrame([("m", 0, "big", 0.5, None), ("m", 1, "small", 0.3, 6), ("m", 2, "tiny", 0.15, 1), ("m", 3, "none", 0.05, 2), ("m", 4, "big", 0.0, 2), ("z", 0, "big", 0.0, 1)], "mix_id string, source_no bigint, name string, weight double, remaining bigint")
    out = mixing.mix(docs(spark, rows), mixes, TOK).collect()
    assert {r["mix_id"] for r in out} == {"m"} and {r["source_no"] for r in out} == {0, 1, 2}
    times = Counter((r["source_no"], r["doc_id"]) for r in out)
    per = defaultdict(list)
    for (no, _), n in times.items():
        per[no].append(n)
    assert max(per[2]) == 1 and max(per[1]) <= 6
    assert all(max(v) - min(v) <= 1 for v in per.values())
    assert not any(r["doc_id"] == 900 for r in out)
    sh = {r["source_no"]: r for r in mixing.shares(docs(spark, rows), mixes, TOK).where("mix_id = 'm'").collect()}
    total = sum(r["tokens"] for r in out)
    assert {n: r["tokens"] for n, r in sh.items()} == {n: sum(r["tokens"] for r in out if r["source_no"] == n) for n in range(5)}
    assert abs(sh[0]["tokens"] / sh[1]["tokens"] - 0.5 / 0.3) < 0.1 and abs(sh[0]["actual_share"] - sh[0]["tokens"] / total) < 1e-9
    assert sh[2]["short"] and sh[3]["short"] and not sh[0]["short"]
    assert mixing.mix(docs(spark, []), mixes, TOK).collect() == []


# ---- 5. filling -------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=60), cap=st.integers(40, 64))
def test_fill_rows(sizes, cap):
    rows = filling.fill_rows(sizes, cap)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in r) <= cap for r in rows)
    start = filling.best_fit(sizes, cap)
    assert len(rows) <= len(start)
    sq = lambda rs: sum(sum(sizes[i] for i in r) ** 2 for r in rs)
    assert sq(rows) >= sq(start)


def test_fill_exchanges_beat_best_fit():
    # best fit by falling size needs three rows of ten here, exchanges two
    sizes = [6, 5, 5, 4]
    assert len(filling.fill_rows(sizes, 10)) == 2
    sizes = [5, 4, 4, 3, 2, 2]
    assert len(filling.fill_rows(sizes, 10)) == 2


def test_rows_of_many_items():
    rng = random.Random(6)
    sizes = [rng.randrange(1, 4) for _ in range(2000)] + [90] * 3
    rows = filling.fill_rows(sizes, 128)
    assert sorted(i for r in rows for i in r) == list(range(len(sizes))) and len(rows) == -(-sum(sizes) // 128)
    # pairs go out of rows of more than a few items too: 3 + 3 of the first for the 7 of the second
    sizes = [3] * 30 + [7, 2]
    assert len(filling.fill_rows(sizes, 97, [list(range(30)), [30], [31]])) == 2


def test_filling(spark):
    rows = [(i, "ab" * (1 + (i * 37) % 60), "en", "s", "web") for i in range(80)] + [(100, None, "", "", ""), (101, "", "", "", ""), (102, "xy" * 300, "", "", "")]
    got = filling.rows(docs(spark, rows), bpe.Merges([]), [64, 100]).collect()
    for cap in (64, 100):
        at = defaultdict(list)
        of = defaultdict(list)
        for r in got:
            if r["seq_len"] == cap:
                at[r["row_id"]].append((r["at"], r["tokens"]))
                of[r["doc_id"]].append((r["start"], r["tokens"]))
        for v in at.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= cap
        for i, t, *_ in rows:
            n = len(t or "")
            assert sum(x for _, x in of.get(i, [])) == n and (n > cap or len(of.get(i, [])) <= 1)
    assert filling.rows(docs(spark, []), TOK, [64]).collect() == []
    used = {r["seq_len"]: r for r in filling.usage(docs(spark, rows), bpe.Merges([]), [64, 100]).collect()}
    for cap in (64, 100):
        n = len({r["row_id"] for r in got if r["seq_len"] == cap})
        assert used[cap]["least_rows"] <= n == used[cap]["rows"] <= used[cap]["best_fit_rows"]


# ---- 6. leakage -------------------------------------------------------------


def item(rng):
    a, b, c = rng.sample(range(100, 9999), 3)
    x, y, z, w = rng.sample([p + q for p in "bor kel mun tas vor".split() for q in "ando ilim oren usta".split()], 4)
    return f"{x} of {y} packs {a} hammers into {b} crates and sends {c} of them to {z}. When {w} leaves {x} at dusk, {b + 1} kettles are missing and {y} blames Friday."


def test_leakage(spark):
    rng = random.Random(9)
    items = [(i, "Solve and give one number. " + item(rng)) for i in range(12)] + [(50, None), (51, "")]
    items.append((99, items[0][1]))
    own = items[0][1].split(". ", 1)[1]
    ws = own.split()
    typo = ws[:]
    typo[4], typo[9] = "mislaid", typo[9][:-1]
    texts = [
        f"Before it. {own} After it.", own.upper().replace(" ", "\n"), "<p>" + "</p><p>".join(ws) + "</p>", '{"q": "' + own.replace(" ", "\\n") + '"}', " ".join(typo), " ".join(ws[:17]), " ".join(ws[:6]), "Solve and give one number. " + item(rng), None, "", "word " * 3000, "ham-\nmers " + own.replace("hammers", "ham-\nmers"),
    ]
    d = docs(spark, [(i, t, "", "", "") for i, t in enumerate(texts)])
    b = spark.createDataFrame([(i, t, "s", "test", 7) for i, t in items], "item_id bigint, text string, suite string, split string, doc_id bigint")
    want = {(i, k) for i in (0, 1, 2, 3, 4, 5, 11) for k in (0, 99)}
    got = {tuple(r) for r in leakage.found(d, b).collect()}
    assert got == want
    assert {tuple(r) for r in leakage.found(d, b, seed_bytes=0).collect()} == want
    assert leakage.found(d.limit(0), b).collect() == [] and leakage.found(d, b.limit(0)).collect() == []


# ---- 7. subjects ------------------------------------------------------------

WORDS = {
    "cooking": "dough broth oven recipe marinade saffron whisk simmer".split(), "sport": "goalkeeper championship overtime referee stadium marathon trophy coach".split(),
    "music": "melody violin orchestra chorus tempo rehearsal choir sonata".split(),
}


def subject_docs():
    rng = random.Random(4)
    rows, truth = [], {}

    def line(s):
        a, b, c = rng.sample(WORDS[s], 3)
        return rng.choice([f"The {a} and the {b} were near the {c}.", f"Most of them like the {a}, and the {b} is for the {c}.", f"Was it the {a} or the {b} that had the {c}?"])

    for i in range(240):
        k = rng.sample(list(WORDS), 2 if i % 6 == 0 else 1)
        body = [line(s) for s in k for _ in range(4)] + ["It was said that they had not been at the jury.", "Nothing more was said about it."]
        rng.shuffle(body)
        rows.append((i, " ".join(body), "en", "s", "web"))
        truth[i] = set(k)
    return rows, truth


def test_subjects(spark):
    rows, truth = subject_docs()
    more = [(900, None, "", "", ""), (901, "", "", "", ""), (902, "Home | Search | Archive", "", "", ""), (903, "import os\n\ndef f(x):\n    return x\n", "", "", "")]
    rng = random.Random(3)
    # a tenth of the labels is wrong
    labels = [(i, (rng.choice(list(WORDS)) if rng.random() < 0.1 else next(iter(truth[i]))).upper() + " ", "r") for i in truth if i % 4 == 1 and len(truth[i]) == 1] + [(5, None, "r"), (7777, "music", "r")]
    l = spark.createDataFrame(labels, "doc_id bigint, subject string, rater string")
    subs = spark.createDataFrame([(s, "d") for s in [*WORDS, "software", None]], "subject string, descr string")
    got = defaultdict(set)
    for r in subjects.found(docs(spark, rows + more), l, subs).collect():
        got[r["doc_id"]].add(r["subject"])
    right = sum(got[i] == truth[i] for i in truth)
    assert right >= 0.95 * len(truth)
    assert got[903] == {"software"} and not (got[900] | got[901] | got[902])


def test_subjects_of_nothing(spark):
    l = spark.createDataFrame([], "doc_id bigint, subject string")
    subs = spark.createDataFrame([("music",)], "subject string")
    assert subjects.found(docs(spark, []), l, subs).collect() == []


def test_queries_are_complete():
    from corpusloom.llm.queries import queries

    names = list(queries())
    assert {n[:2] for n in names} == {f"p{i}" for i in range(1, 8)}
    assert all(f"p{i}_found" in names for i in (1, 3, 6, 7))


@pytest.mark.parametrize("text,code", [("def f(x):", True), ("return 1", True), ("const a = 1;", True), ("SELECT a", True), ("He said that it is so.", False), ("# Heading", False)])
def test_code_lines(text, code):
    assert subjects.is_code(text) == code


def test_sums_are_added_up_a_tree(spark, monkeypatch):
    monkeypatch.setattr(subjects, "FAN", 2)
    df = spark.range(0, 90, 1, 9).select("id", F.array(F.lit(1)).alias("ids"))

    def work(model, pdf, total):
        subjects._add(total, "a", np.array([len(pdf), pdf["id"].sum()]))
        subjects._add(total, "b", np.ones((2, 3)))

    got = subjects._sum_over(df, work, None)
    assert got["a"].tolist() == [90, 4005] and got["b"].shape == (2, 3)
    assert subjects._sum_over(df.where("id < 0"), work, None) == {}


def test_a_new_subject_takes_its_seeds_from_its_description(spark):
    subs = spark.createDataFrame([("Gardening", "Growing plants, and the tools for it."), ("music", None)], "subject string, descr string")
    seeds = subjects.seeds_for(subs, ["gardening", "music"])
    assert set(seeds["en"]["gardening"].split()) == {"gardening", "growing", "plants", "tools"} and "violin" in seeds["en"]["music"]


def test_bloom_filters_lose_nothing(spark):
    from corpusloom.llm import bloom

    df = spark.range(0, 5000).select((F.xxhash64("id")).alias("h"), "id")
    shared = bloom.of_column(df, "h", 5000)
    assert bloom.keep(df, "h", shared).count() == 5000 and shared.value.log2 == 16
    other = spark.range(5000, 15000).select(F.xxhash64("id").alias("h"))
    assert bloom.keep(other, "h", shared).count() < 600
    assert bloom.keep(df, "h", bloom.of_column(df.limit(0), "h", 0)).count() == 0
