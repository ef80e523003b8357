"""Subject areas of documents: term weighting, truncated SVD, refined centroids.

1. Each document is cut into sentences (or lines) and terms, its language told by
   function words and script.  A line of program code, and one with a formula, has a mark for its term.
2. Terms that at least 0.2 % and at most half of a language's documents hold make its
   vocabulary, all of them; their number is bounded by the mean number of different terms of a document over 0.002.
   Documents are weighted (1 + ln tf) * ln(n / df), at unit length, and centred.
3. Truncated SVD of that matrix per language, by subspace iteration over all
   documents: tasks add up their part of M'(MQ), the parts are added up a tree with a fixed
   fan-in, and Q is made orthogonal on the driver.  The two marks have an axis each, beside those of
   the SVD.  A sentence is the idf-weighted sum of its terms' rows.
4. Seed centroids come from a few key words per subject and language, those of marks from the marks; a subject without
   key words takes the words of its name and description.  Further centroids come
   from the sentences of labelled documents that no seed centroid is near.
   All are refined over all sentences in turns.  A further centroid belongs to the
   subject that most labelled documents at it have; if they don't agree it is dropped.
   So labels may be wrong or few: they vote, by documents.
5. A sentence, with some of its neighbours' of its kind, takes the subject of the centroid with the greatest cosine.
   Wordings that come with documents of five or more subjects alike (fillers, menus,
   figures of speech, quiz passages) deal with none.  A document has each subject of a
   quarter or more of its sentences with a subject.

Everything is counted over all documents; model, centroids and vocabulary alone come
to the driver.

Edge cases: null, empty and wordless texts have no subject and no row; labels are
compared without case and outer space, and by close spelling; null labels and
those of unknown documents are ignored; a document labelled with several
subjects is no seed; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_space, unwrap
from ..session import cut
from . import lang as L

#: Key words per language, by subject: the seeds of the centroids.
SEEDS = {
    "en": {"science": "experiment laboratory telescope", "law": "court statute prosecutor", "sport": "match championship goalkeeper", "software": "compiler debugger repository",
           "medicine": "patient vaccine surgeon", "finance": "inflation bond dividend", "cooking": "recipe dough broth", "history": "dynasty fortress chronicle",
           "travel": "passport guesthouse itinerary", "music": "melody violin orchestra", "mathematics": "theorem lemma integral"},
    "fr": {"science": "expérience échantillon télescope", "law": "jugement avocate contrat", "sport": "match championnat gardien", "software": "compilateur code serveur",
           "medicine": "patient vaccin chirurgie", "finance": "inflation impôt crédit", "cooking": "recette pâte bouillon", "history": "dynastie royaume siège",
           "travel": "passeport voyage auberge", "music": "mélodie violon orchestre", "mathematics": "théorème équation polynôme"},
    "de": {"science": "versuch labor teleskop", "law": "gericht urteil anwältin", "sport": "meisterschaft mannschaft stadion", "software": "compiler quelltext datenbank",
           "medicine": "patientin impfung operation", "finance": "inflation kredit steuer", "cooking": "rezept teig brühe", "history": "dynastie festung chronik",
           "travel": "reise herberge gepäck", "music": "melodie geige orchester", "mathematics": "satz gleichung polynom"},
    "es": {"science": "experimento laboratorio telescopio", "law": "juez sentencia abogada", "sport": "equipo campeonato portero", "software": "compilador servidor repositorio",
           "medicine": "paciente vacuna cirugía", "finance": "inflación crédito impuesto", "cooking": "receta masa caldo", "history": "dinastía batalla crónica",
           "travel": "viaje albergue pasaporte", "music": "melodía violín orquesta", "mathematics": "teorema ecuación polinomio"},
    "ru": {"science": "телескоп излучение гипотеза", "law": "суд приговор договор", "sport": "чемпионат тренер вратарь", "software": "компилятор сервер отладчик",
           "medicine": "вакцина диагноз хирург", "finance": "инфляция кредит банк", "cooking": "рецепт тесто бульон", "history": "династия крепость летопись",
           "travel": "поездка гостиница маршрут", "music": "мелодия скрипка оркестр", "mathematics": "теорема уравнение интеграл"},
    "ja": {"science": "実験 望遠鏡 細菌", "law": "裁判所 判決 弁護士", "sport": "選手権 監督 得点", "software": "コンパイラ サーバー バグ",
           "medicine": "患者 ワクチン 手術", "finance": "銀行 株価 金利", "cooking": "レシピ 生地 醤油", "history": "王朝 合戦 遺跡",
           "travel": "旅行 旅館 空港", "music": "旋律 作曲 合唱", "mathematics": "定理 方程式 積分"},
}
LANGS = tuple(SEEDS)
#: What stands for a line of code and one with a formula, and the subject whose seed it is.
MARKS = {"\x01": "software", "\x02": "mathematics"}
#: Columns of the SVD per language, rounds of its iteration, and of refining the seeds and all centroids.
RANK, SVD_ROUNDS, SEED_ROUNDS, ALL_ROUNDS = 40, 5, 3, 4
#: Bounds of a vocabulary: document frequency at least (share, count) and at most (share).
DF_LEAST, DF_COUNT, DF_MOST = 0.002, 3, 0.5
#: Parts of a sum for each core, and how many are added at a time.
PARTS, FAN = 4, 16
#: Weight of each of the two neighbours on either side.
NEAR = 0.3
#: Least cosine to be counted into a centroid (seeds, all), to hold a sentence as near a seed, and to take its subject.
INTO_SEED, INTO_ALL, NEAR_SEED, LEAST = 0.35, 0.3, 0.3, 0.2
#: What a subject gains in a near tie by its share of the document.
REST = 0.07
#: A wording that occurs so often and spreads over so many subjects (exponential of entropy) deals with none.
FILLER_COUNT, FILLER_SPREAD = 8, 5.0
#: Share of labelled documents that must agree on a further centroid, and how many at least.
VOTE, VOTERS = 0.6, 3
#: Share of sentences from which a subject is the document's: about a quarter.
SHARE = 0.248

_UNIT = re.compile(r"(?<=[.!?])[\"”»)\]]*\s+(?=\S)|(?<=[。！？])|\n+")
_TERM = re.compile("[ァ-ヿー]{2,}|[一-鿿]{2,}|[^\\W\\d_぀-ヿ一-鿿]{2,}")
_FORMULA = re.compile(r"\$[^$\n]{3,}\$")
_CODE = re.compile(
    r"^\s*(?:(?:def|class|async def)\s+\w+.*:\s*$|(?:import|from)\s+[\w.]+(?:\s+import\b.*)?\s*$|return\b|(?:if|for|with|while|elif|except)\b.*:\s*$|(?:else|try|finally):?\s*\{?\s*$"
    r"|(?:continue|break|pass)\s*;?\s*$|(?:const|let|var|export|function|public|private|static|fn|use|impl|struct|pub|package)\s+[\w{*].*[;{(=]|#include\b"
    r"|(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|LEFT JOIN|JOIN|INSERT INTO|UPDATE|CREATE TABLE)\b|[}\])]+[;,]?\s*$|#\s\w.*$|//|\"\"\"|\w[\w.\[\]]*\s*[-+*/]?=\s*\S|assert\b)|[{};]\s*$|=>")
_SENTENCE_END = re.compile(r"[.!?]\s*$")
#: A heading as manuals and other project papers have it; such documents form no first centroids, or
#: these would follow the manuals' wording and lose what is written about a subject in prose.
_MANUAL = re.compile(r"^#{1,6} \S", re.M)
_HEADING = re.compile(r"^\s*#{1,6}\s+\S")


def is_code(line: str) -> bool:
    return bool(_CODE.search(line)) and not _SENTENCE_END.search(line) and not (_HEADING.match(line) and line[:1] == "#" and line[:2] != "#!")


def units(text: str) -> tuple[list[str], int, int]:
    """Sentences or lines of prose; how many lines are code and how many hold formulas."""
    prose, code, formulas, fenced = [], 0, 0, False
    for u in _UNIT.split(unwrap(text)):
        s = u.strip() if u else ""
        if not s:
            continue
        if s.startswith("```"):
            fenced = not fenced
        elif fenced or is_code(u):
            code += 1
        elif _FORMULA.search(u):
            formulas += 1
        else:
            prose.append(s)
    return prose, code, formulas


def _prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    code_mark, formula_mark = MARKS
    for pdf in batches:
        out = []
        for d, t in zip(pdf["doc_id"], pdf["text"]):
            prose, code, formulas = units(t)
            manual = int(bool(_MANUAL.search(t)))
            lang = L.identify(" ".join(prose), 1.0) if prose else None
            terms = [" ".join(_TERM.findall(u.lower())) for u in prose]
            # Lines with a mark are alike, so one stands for all of a document's; they are counted at the end.
            out.append((d, lang if lang in SEEDS else "en", code, formulas, manual, [x for x in terms if x] + [code_mark] * (code > 0) + [formula_mark] * (formulas > 0)))
        yield pd.DataFrame(out, columns=["doc_id", "lang", "code", "formulas", "manual", "units"])


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c: Counter = Counter()
        for lang, us in zip(pdf["lang"], pdf["units"]):
            if len(us):
                c[lang, ""] += 1
                c.update((lang, w) for w in {w for u in us for w in u.split() if w not in MARKS})
        yield pd.DataFrame({"lang": [k[0] for k in c], "term": [k[1] for k in c], "df": list(c.values())})


class Model:
    """Vocabulary, weights and, once there, basis and centroids of each language.

    The marks have the ids behind the vocabulary's; until the basis is made ``q`` has no rows for them.
    """

    def __init__(self, subjects: list[str], terms: dict[str, list[tuple[str, float]]], seeds: dict[str, dict[str, str]]) -> None:
        self.subjects = subjects
        self.vocab = {g: {w: n for n, w in enumerate([*(w for w, _ in ts), *MARKS])} for g, ts in terms.items()}
        self.size = {g: len(ts) for g, ts in terms.items()}
        self.idf = {g: np.array([x for _, x in ts] + [1.0] * len(MARKS), np.float32) for g, ts in terms.items()}
        self.q = {g: np.linalg.qr(np.random.default_rng([7, LANGS.index(g)]).standard_normal((len(ts), min(RANK, len(ts)))).astype(np.float32))[0] for g, ts in terms.items()}
        self.mean: dict[str, np.ndarray] = {}
        self.centroids: dict[str, np.ndarray] = {}
        self.owner: dict[str, np.ndarray] = {}
        place = {s: n for n, s in enumerate(subjects)}
        self.marks = [place.get(s, -1) for s in MARKS.values()]
        self.seed = {g: {self.vocab[g][w]: place[s] for s, ws in seeds.get(g, {}).items() if s in place for w in ws.split() if w in self.vocab[g]} for g in self.q}

    def add_marks(self) -> None:
        """An axis of its own for each mark, beside those of the SVD."""
        k = len(MARKS)
        for g, q in self.q.items():
            self.q[g] = np.block([[q, np.zeros((len(q), k), np.float32)], [np.zeros((k, q.shape[1]), np.float32), np.eye(k, dtype=np.float32)]])


def seeds_for(subjects: DataFrame, names: list[str]) -> dict[str, dict[str, str]]:
    """Key words by language and subject; where there are none, the words of the subject's name and description."""
    known = {s for ws in SEEDS.values() for s in ws}
    new = [n for n in names if n not in known]
    if not new:
        return SEEDS
    descr = F.col("descr") if "descr" in subjects.columns else F.lit("")
    rows = subjects.where("subject is not null").select(F.lower(strip_space(F.col("subject"))).alias("s"), F.coalesce(descr, F.lit("")).alias("d")).collect()
    own = {n: " ".join(w for r in rows if r["s"] == n for w in _TERM.findall(f"{n} {r['d']}".lower()) if len(w) > 3 and not L.is_function_word(w)) for n in new}
    return {g: ws | own for g, ws in SEEDS.items()}


def _flat(pdf: pd.DataFrame, g: int):
    """Of one language in a batch: term ids, their unit, the unit's document, and unit starts."""
    rows = pdf[pdf["lang"] == g]
    ids = [np.asarray(x, np.int32) for x in rows["ids"]]
    sizes = [np.asarray(x, np.int32) for x in rows["sizes"]]
    if not ids or not sum(map(len, sizes)):
        return None
    per = np.concatenate(sizes)
    return rows, np.concatenate(ids), per, np.repeat(np.arange(len(rows)), [len(s) for s in sizes]), np.concatenate([[0], np.cumsum(per)[:-1]])


def _chunks(batches: Iterator[pd.DataFrame], most: int = 60_000) -> Iterator[pd.DataFrame]:
    """Parts of batches of about so many term ids, whatever the length of documents."""
    for pdf in batches:
        if not len(pdf):
            continue
        part = np.cumsum([len(x) for x in pdf["ids"]]) // most
        for _, x in pdf.groupby(part, sort=True):
            yield x


def _add(total: dict, key: str, x: np.ndarray) -> None:
    if key in total:
        total[key] += x
    else:
        total[key] = x.astype(np.float64)


def _sum_over(df: DataFrame, work, model: Model) -> dict[str, np.ndarray]:
    """Runs ``work(model, chunk, total)`` over all rows and adds up the arrays in ``total`` by key.

    Arrays are of model size.  There are PARTS of them for each core at most, whatever the number of rows;
    they are added FAN at a time, level by level, so no task holds more than FAN.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for chunk in _chunks(batches):
            work(shared.value, chunk, total)
        if total:
            yield pd.DataFrame({"key": list(total), "shape": [list(v.shape) for v in total.values()], "data": [v.astype(np.float64).tobytes() for v in total.values()]})

    def merge(pdf):
        acc = np.frombuffer(pdf["data"].iloc[0], np.float64).copy()
        for b in pdf["data"].iloc[1:]:
            acc += np.frombuffer(b, np.float64)
        return pdf[["g", "key", "shape"]].head(1).assign(data=[acc.tobytes()])

    schema = "key string, shape array<int>, data binary"
    most = PARTS * spark.sparkContext.defaultParallelism
    left = min(df.rdd.getNumPartitions(), most)
    parts = df.coalesce(most).mapInPandas(run, schema).withColumn("g", F.spark_partition_id())
    while left > 1:
        left = -(-left // FAN)
        parts = parts.withColumn("g", F.pmod("g", F.lit(left))).groupBy("g", "key").applyInPandas(merge, "g int, " + schema)
    rows = parts.collect()
    shared.unpersist()
    return {r["key"]: np.frombuffer(r["data"], np.float64).reshape(list(r["shape"])) for r in rows}


# ---- SVD --------------------------------------------------------------------


def _svd_part(model: Model, pdf: pd.DataFrame, total: dict) -> None:
    for n, g in enumerate(LANGS):
        flat = _flat(pdf, n) if g in model.q else None
        if flat is None:
            continue
        rows, ids, per, unit_doc, _ = flat
        v = model.size[g]
        doc, prose = np.repeat(unit_doc, per), ids < v
        doc, ids = doc[prose], ids[prose]
        if not len(ids):
            continue
        key, tf = np.unique(doc.astype(np.int64) * v + ids, return_counts=True)
        d, t = key // v, key % v
        w = (1 + np.log(tf)) * model.idf[g][t]
        norm = np.sqrt(np.bincount(d, w * w, minlength=len(rows)))
        w = (w / np.maximum(norm[d], 1e-9)).astype(np.float32)
        q = model.q[g]
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        y = np.add.reduceat(w[:, None] * q[t], starts, axis=0)  # one row per document with terms
        row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(d)]))
        order = np.argsort(t, kind="stable")
        ts = t[order]
        cut_at = np.flatnonzero(np.r_[True, ts[1:] != ts[:-1]])
        z = np.zeros((v, q.shape[1] + 1))
        z[ts[cut_at], :-1] = np.add.reduceat(w[order, None] * y[row[order]], cut_at, axis=0)
        z[ts[cut_at], -1] = np.add.reduceat(w[order], cut_at)
        _add(total, f"z|{g}", z)
        _add(total, f"n|{g}", np.array([len(starts)]))


def _fit_basis(encoded: DataFrame, model: Model) -> None:
    for _ in range(SVD_ROUNDS):
        got = _sum_over(encoded, _svd_part, model)
        for g in list(model.q):
            if f"z|{g}" not in got:
                model.q[g] = model.q[g][:, :0]
                continue
            z, n = got[f"z|{g}"], got[f"n|{g}"][0]
            mu = z[:, -1:] / n
            model.q[g] = np.linalg.qr(z[:, :-1] - n * mu @ (mu.T @ model.q[g]))[0].astype(np.float32)
    model.add_marks()


# ---- sentences and centroids ------------------------------------------------


def _sentences(model: Model, pdf: pd.DataFrame, n: int, g: str):
    """Raw vectors and weights of one language's sentences in a chunk."""
    flat = _flat(pdf, n)
    if flat is None:
        return None
    rows, ids, per, unit_doc, starts = flat
    idf = model.idf[g][ids]
    raw = np.add.reduceat(idf[:, None] * model.q[g][ids], starts, axis=0)
    weight = np.sqrt(np.add.reduceat(idf * idf, starts))
    return rows, ids, per, unit_doc, starts, raw, np.maximum(weight, 1e-9)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _with_neighbours(x: np.ndarray, doc: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = x.copy()
    for s in (1, 2):
        same = ((doc[s:] == doc[:-s]) & (kind[s:] == kind[:-s]))[:, None]
        out[s:] += NEAR * x[:-s] * same
        out[:-s] += NEAR * x[s:] * same
    return _unit_rows(out)


def _seed_of(model: Model, g: str, ids: np.ndarray, per: np.ndarray) -> np.ndarray:
    """The subject whose key words alone a sentence has, else -1."""
    hit = np.full(len(model.idf[g]), -1)
    for t, j in model.seed[g].items():
        hit[t] = j
    h = hit[ids]
    unit = np.repeat(np.arange(len(per)), per)
    lo, hi = np.full(len(per), 1 << 20), np.full(len(per), -1)
    k = h >= 0
    np.minimum.at(lo, unit[k], h[k])
    np.maximum.at(hi, unit[k], h[k])
    return np.where(lo == hi, hi, -1)


def _start_part(model: Model, pdf: pd.DataFrame, total: dict) -> None:
    pdf = pdf[pdf["manual"] == 0]
    for n, g in enumerate(LANGS):
        got = _sentences(model, pdf, n, g) if g in model.q else None
        if got is None:
            continue
        _, ids, per, _, starts, raw, weight = got
        j = _seed_of(model, g, ids, per)
        k = j >= 0
        s = np.zeros((len(model.subjects), raw.shape[1] + 1))
        np.add.at(s, j[k], np.c_[raw[k] / weight[k, None], 1 / weight[k]])
        _add(total, f"s|{g}", s)
        prose = ids[starts] < model.size[g]
        _add(total, f"m|{g}", np.r_[raw[prose].sum(0), prose.sum()])


def _located(model: Model, pdf: pd.DataFrame, n: int, g: str):
    """Sentences with centred vectors, and their cosines to the centroids with neighbours taken in."""
    got = _sentences(model, pdf, n, g)
    if got is None:
        return None
    rows, ids, per, doc, starts, raw, weight = got
    x = (raw - model.mean[g].astype(np.float32)) / weight[:, None]
    kind = np.maximum(ids[starts] - model.size[g], -1)
    return rows, ids, starts, per, doc, x, _with_neighbours(x, doc, kind) @ model.centroids[g].T.astype(np.float32)


def _refine_part(least: float, manuals: bool):
    def work(model: Model, pdf: pd.DataFrame, total: dict) -> None:
        if not manuals:
            pdf = pdf[pdf["manual"] == 0]
        for n, g in enumerate(LANGS):
            got = _located(model, pdf, n, g) if g in model.centroids else None
            if got is None:
                continue
            x, sim = got[5], got[6]
            a, m = sim.argmax(1), sim.max(1)
            k = m > least
            into = np.zeros_like(sim)
            into[np.flatnonzero(k), a[k]] = m[k]
            _add(total, f"c|{g}", into.T @ x)

    return work


def _further_part(model: Model, pdf: pd.DataFrame, total: dict) -> None:
    for n, g in enumerate(LANGS):
        got = _located(model, pdf, n, g) if g in model.centroids else None
        if got is None:
            continue
        rows, doc, x, sim = got[0], got[4], got[5], got[6]
        label = rows["label"].to_numpy(np.int64)[doc]
        k = (label >= 0) & (sim.max(1) < NEAR_SEED)
        s = np.zeros((len(model.subjects), x.shape[1]))
        np.add.at(s, label[k], x[k])
        _add(total, f"r|{g}", s)


def _vote_part(model: Model, pdf: pd.DataFrame, total: dict) -> None:
    for n, g in enumerate(LANGS):
        got = _located(model, pdf, n, g) if g in model.centroids else None
        if got is None:
            continue
        rows, doc, sim = got[0], got[4], got[6]
        a, m = sim.argmax(1), sim.max(1)
        label = rows["label"].to_numpy(np.int64)
        k = (label[doc] >= 0) & (m > INTO_ALL)
        s = np.zeros((sim.shape[1], len(model.subjects)))
        for d, c in np.unique(np.c_[doc[k], a[k]], axis=0):
            s[c, label[d]] += 1
        _add(total, f"v|{g}", s)


def _refine(encoded: DataFrame, model: Model, rounds: int, least: float, keep: float, manuals: bool = True) -> None:
    for _ in range(rounds):
        got = _sum_over(encoded, _refine_part(least, manuals), model)
        for g, c in model.centroids.items():
            if f"c|{g}" in got:
                model.centroids[g] = _unit_rows(_unit_rows(got[f"c|{g}"]) + keep * c)


def _fit_centroids(encoded: DataFrame, model: Model) -> None:
    got = _sum_over(encoded, _start_part, model)
    for g in model.q:
        if f"m|{g}" in got:
            m, s = got[f"m|{g}"], got[f"s|{g}"]
            model.mean[g] = m[:-1] / max(m[-1], 1)
        else:  # manuals only
            model.mean[g], s = np.zeros(model.q[g].shape[1]), np.zeros((len(model.subjects), model.q[g].shape[1] + 1))
        marks = model.q[g][model.size[g]:] - model.mean[g]  # what all lines with a mark are
        model.centroids[g] = _unit_rows(np.vstack([s[:, :-1] - s[:, -1:] * model.mean[g], marks]))
    _refine(encoded, model, SEED_ROUNDS, INTO_SEED, 0.5, manuals=False)
    got = _sum_over(encoded, _further_part, model)
    for g, c in model.centroids.items():
        more = got.get(f"r|{g}")
        if more is not None:
            model.centroids[g] = np.vstack([c, _unit_rows(more)])
    _refine(encoded, model, ALL_ROUNDS, INTO_ALL, 0.3)
    got = _sum_over(encoded, _vote_part, model)
    j = len(model.subjects) + len(MARKS)
    for g, c in model.centroids.items():
        owner = np.full(len(c), -1)
        owner[:j] = [*range(len(model.subjects)), *model.marks]
        votes = got.get(f"v|{g}")
        if votes is not None:
            for r in range(j, len(c)):
                if votes[r].sum() >= VOTERS and votes[r].max() >= VOTE * votes[r].sum():
                    owner[r] = int(votes[r].argmax())
        model.owner[g] = owner


# ---- the operator -----------------------------------------------------------


def _clean_label(known: list[str]):
    def clean(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return -1
            x = x.strip().lower()
            if x in known:
                return known.index(x)
            near = difflib.get_close_matches(x, known, 1, 0.8)
            return known.index(near[0]) if near else -1

        return s.map(one).astype("int64")

    return F.pandas_udf(clean, "bigint")


def _encode(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            out = []
            for d, g, code, formulas, manual, us, label in zip(pdf["doc_id"], pdf["lang"], pdf["code"], pdf["formulas"], pdf["manual"], pdf["units"], pdf["label"]):
                v = model.vocab.get(g, {})
                ids, sizes = [], []
                for u in us:
                    x = [v[w] for w in u.split() if w in v] if u not in MARKS else [v[u]]
                    if x:
                        ids += x
                        sizes.append(len(x))
                out.append((d, LANGS.index(g), code, formulas, manual, ids, sizes, label))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "code", "formulas", "manual", "ids", "sizes", "label"])

    return run


def _decide(sim: np.ndarray, owner: np.ndarray, doc: np.ndarray, prose: np.ndarray, docs: int, subjects: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and subject of each sentence; near ties go to what the rest of the document is about.

    Many words belong to several subjects (court, match, key), so a subject gains up to
    REST by its share of the document's sentences of prose.
    """
    best = np.full((len(sim), subjects), -2.0)
    for c in np.flatnonzero(owner >= 0):
        best[:, owner[c]] = np.maximum(best[:, owner[c]], sim[:, c])
    first, m = best.argmax(1), best.max(1)
    held = np.zeros((docs, subjects))
    k = (m >= LEAST) & prose
    np.add.at(held, (doc[k], first[k]), m[k])
    held /= np.maximum(held.sum(1, keepdims=True), 1e-9)
    return m, (best + REST * held[doc]).argmax(1)


def _assign(shared):
    """(doc_id, skel, subject, n): a document's sentences by wording and subject; lines with a mark without a wording."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in _chunks(batches):
            out: Counter = Counter()
            for n, g in enumerate(LANGS):
                got = _located(model, pdf, n, g) if g in model.centroids else None
                if got is None:
                    continue
                rows, ids, starts, per, doc, _, sim = got
                m, subject = _decide(sim, model.owner[g], doc, ids[starts] < model.size[g], len(rows), len(model.subjects))
                who, marked = rows["doc_id"].to_numpy(), rows[["code", "formulas"]].to_numpy()
                for u in np.flatnonzero(m >= LEAST):
                    own = ids[starts[u] : starts[u] + per[u]]
                    mark = int(own[0]) - model.size[g]
                    if mark < 0:
                        out[who[doc[u]], xxhash.xxh64_intdigest(own.tobytes(), n) - (1 << 63), int(subject[u])] += 1
                    else:
                        out[who[doc[u]], None, int(subject[u])] += int(marked[doc[u], mark])
            yield pd.DataFrame([(d, s, j, n) for (d, s, j), n in out.items()], columns=["doc_id", "skel", "subject", "n"]).astype({"skel": "Int64"})

    return run


def prepare(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    return rows.mapInPandas(_prepare, "doc_id bigint, lang string, code int, formulas int, manual int, units array<string>")


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[DataFrame, Model]:
    """The encoded documents and the model fitted on all of them."""
    spark = documents.sparkSession
    names = sorted({r[0].strip().lower() for r in subjects.select("subject").where("subject is not null").distinct().collect()})
    prepared = cut(prepare(documents))
    df = prepared.mapInPandas(_frequencies, "lang string, term string, df bigint").groupBy("lang", "term").agg(F.sum("df").alias("df"))
    df = cut(df)
    n = {r["lang"]: r["df"] for r in df.where("term = ''").collect()}
    bounds = F.coalesce(*(F.when(F.col("lang") == g, F.lit(float(c))) for g, c in n.items())) if n else F.lit(None).cast("double")
    kept = df.where("term <> ''").withColumn("docs", bounds).where((F.col("df") >= F.greatest(F.lit(float(DF_COUNT)), DF_LEAST * F.col("docs"))) & (F.col("df") <= F.greatest(DF_MOST * F.col("docs"), F.lit(float(DF_COUNT)))))
    terms: dict[str, list[tuple[str, float]]] = {}
    for g in n:
        # At most (mean number of different terms of a document) / DF_LEAST terms can be that frequent.
        rows = kept.where(F.col("lang") == g).orderBy(F.desc("df"), "term").collect()
        terms[g] = [(r["term"], math.log((n[g] + 1) / r["df"])) for r in rows]
    model = Model(names, terms, seeds_for(subjects, names))
    one = labels.where("doc_id is not null and subject is not null").select("doc_id", _clean_label(names)(F.col("subject")).alias("j")).where("j >= 0").groupBy("doc_id").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    one = one.where("a = b").select("doc_id", F.col("a").alias("label"))
    shared = spark.sparkContext.broadcast(model)
    schema = "doc_id bigint, lang int, code int, formulas int, manual int, ids array<int>, sizes array<int>, label bigint"
    encoded = cut(prepared.join(one, "doc_id", "left").na.fill(-1, ["label"]).mapInPandas(_encode(shared), schema))
    _fit_basis(encoded, model)
    _fit_centroids(encoded, model)
    return encoded, model


def assigned(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, sentences, share): sentences dealing with each subject, and their share of those with any."""
    encoded, model = fit(documents, labels, subjects)
    spark = documents.sparkSession
    rows = cut(encoded.mapInPandas(_assign(spark.sparkContext.broadcast(model)), "doc_id bigint, skel bigint, subject int, n bigint"))
    per = rows.where("skel is not null").groupBy("skel", "subject").agg(F.sum("n").alias("n"))
    spread = per.groupBy("skel").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"))
    fillers = spread.where((F.col("t") >= FILLER_COUNT) & (F.exp(F.log("t") - F.col("s") / F.col("t")) >= FILLER_SPREAD)).select("skel")
    # Lines with a mark have no wording and stay out of the join, where they would all be one key.
    real = rows.where("skel is not null").join(fillers, "skel", "left_anti").unionByName(rows.where("skel is null")).groupBy("doc_id", "subject").agg(F.sum("n").alias("n"))
    lists = real.groupBy("doc_id").agg(F.sum("n").alias("t"), F.collect_list(F.struct("subject", "n")).alias("x"))
    name = F.element_at(F.array(*(F.lit(s) for s in model.subjects)) if model.subjects else F.array(F.lit("")), F.col("p.subject") + 1)
    return lists.select("doc_id", "t", F.explode("x").alias("p")).select("doc_id", name.alias("subject"), F.col("p.n").alias("sentences"), (F.col("p.n") / F.col("t")).alias("share"))


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject): the subjects of about a quarter of a document's sentences or more, spelt as in ``subjects``."""
    spelt = subjects.where("subject is not null").select(F.col("subject").alias("spelt"), F.lower(strip_space(F.col("subject"))).alias("subject")).groupBy("subject").agg(F.min("spelt").alias("spelt"))
    rows = assigned(documents, labels, subjects).where(F.col("share") >= SHARE)
    return rows.join(F.broadcast(spelt), "subject").select("doc_id", F.col("spelt").alias("subject"))


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, documents, share): how much of the corpus has each subject."""
    hit = cut(found(documents, labels, subjects))
    n = documents.where("doc_id is not null").agg(F.countDistinct("doc_id").alias("all"))
    return hit.groupBy("subject").agg(F.count("*").alias("documents")).crossJoin(F.broadcast(n)).select("subject", "documents", (F.col("documents") / F.col("all")).alias("share"))
