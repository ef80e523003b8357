"""Broken prompt and response pairs.

Every assistant turn is paired with the nearest user turn before it and gets at
most one defect, looked for in this order:

* ``empty``: null, blank, or nothing but a placeholder, marks or bare markup;
* ``refusal``: every sentence aligns (LCS of tokens, in Japanese of characters) with a pattern
  of act and object that declines, or of courtesy, and at least one declines (``llm.refusals``);
* ``copy``: shingle containment both ways between answer and question, always confirmed by
  LCS: over slip-tolerant tokens, or over characters where words are run together, spaced out or
  moved; not where the question, in any of its sentences, asks for the text back;
* ``truncated``: an open bracket, quotation or code block, an unfinished list, or
  a last sentence that ends where sentences of this corpus do not end;
* ``other_language``: most of the answer is in another language than the
  question; not where the question asks for that language.

Where sentences end is measured over all turns: for the last one, two and three
words before every sentence end or inner position, how often a sentence ends
there.  The counts are aggregated per batch and then by key, and only answers
without a closing mark are joined to them: by broadcast for the keys that many of them
share, whose number has a bound, else by shuffle.

Edge cases: rows with a null ``conv_id`` or ``turn`` form no pair; repeated
deliveries of one (conv_id, turn) count once (the earliest ``ingested_at``; of ties the smallest content);
unknown roles are neither questions nor answers; an empty table gives an empty
result; other columns are ignored.  A null question counts as an empty one:
``copy`` and ``other_language`` cannot apply.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold, role, unwrap
from ..session import cut
from . import lang as L
from .refusals import aligned, is_refusal

#: Turns per block: a conversation longer than this is worked on in blocks.
TURN_BLOCK = 512
#: A key of last words that so large a share of the undecided answers have, and so many of them, is a common one.
SHARED_KEY, SHARED_LEAST = 0.001, 1000

# ---- empty ------------------------------------------------------------------

_PLACEHOLDERS = {
    "", "null", "none", "nil", "nan", "na", "n a", "todo", "tbd", "tba", "undefined", "empty", "blank", "no response", "no answer", "no reply",
    "no content", "no output", "response", "answer", "placeholder", "deleted", "removed", "redacted", "missing", "assistant", "bot", "gpt",
    "user", "human", "system", "endoftext", "eos", "pad", "unk", "insert answer here", "your answer here", "answer here", "error", "fixme", "xxx",
    "no text", "no data", "void", "untitled", "unknown",
}
_ROLE_LABEL = re.compile(r"^\s*(?:#+\s*)?(?:assistant|bot|gpt|user|human|system|answer|response)\s*[:：]\s*", re.I)


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    raw = unwrap(text)
    s = _ROLE_LABEL.sub("", raw).strip()
    if not s:
        return True
    if len(s) > 60:
        return not any(c.isalnum() for c in s) and not _EMOJI.search(s)
    bare = " ".join(re.findall(r"[^\W_]+", re.sub(r"```\w*", " ", s).lower()))
    if not bare:
        return not _EMOJI.search(s)
    return bare in _PLACEHOLDERS


_EMOJI = re.compile("[☀-➿\U0001f300-\U0001faff]")

def _tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text))


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, row by row in a machine word."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    return aligned(where, len(a), b)


# ---- copy -------------------------------------------------------------------

_ASKS_BACK = re.compile(
    r"(?:^|[.!?:\n]\s*)(?:(?:please|now|just|can you|could you|would you|bitte|kannst du|s.il (?:te|vous) pla[iî]t|peux-tu|pouvez-vous|por favor|puedes|podr[ií]as|пожалуйста)[\s,]+)*"
    r"(?:repeat|say (?:the following|it|this)|proofread|correct (?:the|this|my)|spell|fix the|copy (?:the|this|out)|retype|echo|quote (?:the|this)|rewrite|"
    r"wiederhol\w*|korrig\w*|berichtig\w*|verbesser\w*|schreib\w* (?:das|dies\w*|den satz) ab|sprich nach|"
    r"r[ée]p[èée]te\w*|corrige\w*|recopie\w*|relis\w*|redis\w*|"
    r"repite\w*|repetir|corrig\w*|copia\w*|revisa la ortograf\w*|"
    r"повтори\w*|исправь\w*|перепиши\w*|перепечатай\w*)\b|繰り返して|そのまま|直して|訂正|校正", re.I)
_DRESS = re.compile(r"^\s*(?:>\s*)*(?:\W*\b(?:you asked|you said|question|q|frage|pregunta|вопрос|user|human|prompt|input|du fragtest|tu as demandé|has preguntado|préguntas?)\b\s*[:：]\s*)+", re.I)


def _squash(text: str) -> str:
    t = _DRESS.sub("", unwrap(text))
    return "".join(re.findall(r"[^\W_]", fold(t)))


def _shingles(s: str, n: int = 4) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def _same_word(a: str, b: str) -> bool:
    """Equal but for a slip: one edit, or a swap of neighbours."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return len(x) <= 1 and len(y) <= 1 or len(x) == 2 and x == y[::-1]


def _lcs_slips(a: list[str], b: list[str]) -> int:
    """LCS of words where a word may differ by a slip: such words of ``a`` are first put as in ``b``."""
    known = set(b)
    long = [w for w in known if len(w) >= 3]
    return lcs_length([w if w in known else next((x for x in long if _same_word(w, x)), w) for w in a], b)


def _asks_back(question: str) -> bool:
    """Whether any sentence of the question asks for the text back; what it quotes does not ask."""
    return bool(_ASKS_BACK.search(_QUOTED.sub(" ", question)))


def is_copy(question: str | None, answer: str) -> bool:
    if not question:
        return False
    a, q = _squash(answer), _squash(question)
    if len(a) < 12 or len(q) < 12:
        return False
    A, Q = _shingles(a), _shingles(q)
    both = len(A & Q)
    if both >= 0.6 * len(A) and both >= 0.5 * len(Q):
        wa, wq = _tokens(_DRESS.sub("", unwrap(answer))), _tokens(unwrap(question))
        if len(wa) > 1.6 * len(wq):  # given back more than once
            times = round(len(wa) / len(wq))
            got = sum(_lcs_slips(wa[i * len(wa) // times : (i + 1) * len(wa) // times], wq) for i in range(times)) / times
            return got >= 0.7 * len(wq) and got * times >= 0.8 * len(wa) and not _asks_back(question)
        got = _lcs_slips(wa, wq)
        if got >= 0.8 * len(wa) and got >= 0.65 * len(wq):
            return not _asks_back(question)
        # Words run together, spaced out or moved: the same characters, most of them in order.
        if both >= 0.9 * len(A) and both >= 0.75 * len(Q) and (got := lcs_length(a, q)) >= 0.8 * len(a) and got >= 0.65 * len(q):
            return not _asks_back(question)
    last = [x for x in re.split(r"(?<=[.!?])\s+|\n+", question.strip()) if x.strip()]
    if len(last) > 1:
        e = _squash(last[-1])
        E = _shingles(e)
        return len(E) >= 20 and len(A & E) >= 0.92 * max(len(E), len(A)) and lcs_length(a, e) >= 0.9 * max(len(a), len(e)) and not _asks_back(question)
    return False


# ---- other language ---------------------------------------------------------

_LANG_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|ingl[ée]s\w*|английск\w*|по-английски|英語",
    "fr": r"french|franz[öo]sisch\w*|français\w*|franc[ée]s\w*|французск\w*|по-французски|フランス語",
    "de": r"german|deutsch\w*|allemand\w*|alem[áa]n\w*|немецк\w*|по-немецки|ドイツ語",
    "es": r"spanish|spanisch\w*|espagnol\w*|español\w*|castellano|испанск\w*|по-испански|スペイン語",
    "ru": r"russian|russisch\w*|russe\w*|ruso\w*|русск\w*|по-русски|ロシア語",
    "ja": r"japanese|japanisch\w*|japonais\w*|japon[ée]s\w*|японск\w*|по-японски|日本語",
    "it": r"italian|italienisch\w*|italien\w*|italiano\w*", "pt": r"portuguese|portugiesisch\w*|portugais\w*|portugu[ée]s\w*", "zh": r"chinese|chinesisch\w*|chinois\w*|chino\w*|китайск\w*|中国語",
}
_LANG_RX = {k: re.compile(rf"(?:\b(?:{v})\b)" if k not in ("ja", "zh") else rf"(?:{v})", re.I) for k, v in _LANG_NAMES.items()}
_TRANSLATE = re.compile(r"translat\w*|übersetz\w*|tradu\w*|перевед\w*|перевод\w*|翻訳|訳して", re.I)
_QUOTED = re.compile(r"[\"“„«][^\"“”„«»]{8,}[\"”“»]")


def is_other_language(question: str | None, answer: str) -> bool:
    if not question or not question.strip():
        return False
    shares = L.by_size(unwrap(answer))
    known = {k: v for k, v in shares.items() if k}
    total = sum(shares.values())
    if not known or total < 12:
        return False
    best = max(known, key=lambda k: known[k])
    if known[best] <= 0.5 * total:
        return False
    ask = L.without_code(unwrap(question))
    if _TRANSLATE.search(ask):
        return False
    bare = _QUOTED.sub(" ", ask)
    q = L.by_size(bare)
    q = {k: v for k, v in q.items() if k}
    if not q:
        own = L.identify(bare, 1.0)
        q = {own: 1} if own else {}
    if not q:
        return False
    if _LANG_RX.get(best) and _LANG_RX[best].search(ask):
        return False
    return max(q, key=lambda k: q[k]) != best


# ---- truncated --------------------------------------------------------------

_FENCE = re.compile(r"```")
_CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\s*$")
_DONE = re.compile(r"(?:https?://\S+|[☀-➿\U0001f300-\U0001faff️])\s*$")
_SMILE = re.compile(r"[:;=]-?[()\[\]]")
_SIGNED = re.compile(r"\n\s*[^\W\d_a-z][^\W\d_]*(?: [^\W\d_a-z][^\W\d_]*){0,2}\s*\Z")
_BULLET_END = re.compile(r"(?:^|\n)\s*(?:[-*+•]|\d{1,3}[.)])\s*$")
_TOK = re.compile("[぀-ヿ一-鿿]|\\d[\\d.,]*\\d|\\d|[^\\W\\d_぀-ヿ一-鿿]+(?:['’\\-][^\\W\\d_]+)*|[,;:.!?。！？…()\"“”„«»\\n]")
_ENDS = set(".!?。！？\n")


def shape_of_end(text: str) -> str | None:
    """``open`` for a break that marks alone prove, ``closed`` for a finished text, else None."""
    s = text.rstrip()
    if len(_FENCE.findall(s)) % 2 or re.search(r"(?<!`)`{1,2}$", s) and "```" in s and not s.endswith("```"):
        return "open"
    prose = re.sub(r"```.*?```", " ", s, flags=re.S)
    prose = _SMILE.sub(" ", prose)
    if prose.count("(") > prose.count(")") or prose.count("[") > prose.count("]") or prose.count("{") > prose.count("}"):
        return "open"
    if prose.count('"') % 2 or prose.count("«") > prose.count("»") or prose.count("“") > prose.count("”") + prose.count("„") * 2 and "„" not in prose or prose.count("「") > prose.count("」"):
        return "open"
    if "„" in prose and prose.count("„") > prose.count("“") + prose.count("”"):
        return "open"
    if _BULLET_END.search(s) and re.search(r"\w", s[: max(0, len(s) - 4)]):
        return "open"
    if s.endswith((",", ";", ":", "-", "–", "—", "(", "[", "{", "…", "...", "/", "&", "=", "、", "，", "：")) and re.search(r"\w", s):
        return "open"
    if (m := _SIGNED.search(s)) and _CLOSED.search(s[: m.start()]):
        return "closed"
    if s.endswith("```") or _CLOSED.search(s) or _DONE.search(s) or s.endswith((")", "]", "}", '"', "”", "»", "“", "」", ">")):
        return "closed"
    return None


def _kind(tok: str) -> str:
    if tok[0].isdigit():
        return "9"
    if tok[0].isupper():
        return "N"
    return tok.lower()


def end_keys(tokens: list[str], i: int) -> list[int]:
    """Keys for "a sentence ends after token i": by word form, with one, two and three words; names by their last letters
    too; and one for its standing last in a text without a mark."""
    t = tokens[i]
    k = _kind(t)
    own = f"N:{t[-3:].lower()}" if k == "N" else k
    p1 = _kind(tokens[i - 1]) if i else "^"
    p2 = _kind(tokens[i - 2]) if i > 1 else "^"
    names = (f"1|{own}", f"2|{p1}|{k}", f"3|{p2}|{p1}|{k}", f"0|{own}")
    return [_key(x) for x in names]


def _key(run: str) -> int:
    return xxhash.xxh64_intdigest(run) - (1 << 63)


def end_tokens(text: str) -> list[str]:
    t = re.sub(r"```.*?(?:```|\Z)", "\n", text, flags=re.S)
    return _TOK.findall(re.sub(r"https?://\S+", "", t))


def _end_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: how often each run of words was seen, and how often a sentence ended there.  Runs are counted as
    tuples and hashed once each at the end."""
    for pdf in batches:
        seen: Counter = Counter()
        ends: Counter = Counter()
        for text in pdf["content"]:
            if not text:
                continue
            toks = end_tokens(text)
            kinds = [_kind(t) for t in toks]
            p1 = p2 = "^"
            for i in range(len(toks) - 1):
                k, t = kinds[i], toks[i]
                if t[0].isalnum():
                    own = "N:" + t[-3:].lower() if k == "N" else k
                    runs = ("1|" + own, f"2|{p1}|{k}", f"3|{p2}|{p1}|{k}")
                    seen.update(runs)
                    if toks[i + 1] in _ENDS:
                        ends.update(runs)
                p1, p2 = k, p1
            if toks and toks[-1][0].isalnum():  # a text's last word without a mark: seen, but neither inside nor at an end
                k = kinds[-1]
                seen["0|" + ("N:" + toks[-1][-3:].lower() if k == "N" else k)] += 1
        yield pd.DataFrame({"key": [_key(x) for x in seen], "seen": list(seen.values()), "ends": [ends[x] for x in seen]})


#: Evidence needed before a count speaks, and the share of ends below which a break is no sentence end.
#: A random break falls on an inner word about twelve times as often as on a last one, so 1 in 13 is even odds.
MIN_SEEN, MAX_END_SHARE = 4, 0.07


def breaks_off():
    """Whether a text ends inside a sentence: the longest run of last words with enough evidence decides.

    A last word never seen elsewhere is a word cut short.  Of texts of up to three
    words only those ending in a small-letter word that is such or ends next to no sentence break off.
    """
    by_share = F.lit(False)
    for i in (1, 2, 3):
        by_share = F.when(F.col(f"seen{i}") >= MIN_SEEN, F.col(f"ends{i}") < MAX_END_SHARE * F.col(f"seen{i}")).otherwise(by_share)
    rare = (F.col("seen1") == 0) & (F.col("seen4") <= 2) & (F.col("n") > 1)
    return F.when(F.col("n") <= 3, F.col("word") & (rare | (F.col("seen1") >= 20) & (F.col("ends1") < 0.02 * F.col("seen1")))).when(F.col("seen1") == 0, True).otherwise(by_share)


# ---- the operator -----------------------------------------------------------


def answers(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, answer, question): each assistant turn with the nearest user turn before it.

    Conversations are worked on in blocks of ``TURN_BLOCK`` turns, so that one of any length
    spreads over tasks.  If any turn lies beyond the first block, answers without a question in
    their block take the last one of the nearest block before (``_carried``).
    """
    rows = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), role(F.col("role")).alias("role"), F.col("content").alias("content"), F.col("ingested_at").alias("ingested_at")
    ).where("conv_id is not null and turn is not null and role in ('user', 'assistant')").withColumn("block", F.floor(F.col("turn") / TURN_BLOCK))
    w = Window.partitionBy("conv_id", "block").orderBy("turn", F.col("ingested_at").asc_nulls_last(), F.col("content").asc_nulls_last(), "role")
    asked = F.when(F.col("role") == "user", F.struct("turn", "content"))
    x = rows.withColumn("again", F.lag("turn").over(w) == F.col("turn")).withColumn("q", F.last(asked, ignorenulls=True).over(w))
    own = x.where("role = 'assistant' and (again is null or not again)")
    found = own.where("q is not null").select("conv_id", "turn", F.col("content").alias("answer"), F.col("q.content").alias("question"))
    span = conversations.agg(F.min("turn").alias("lo"), F.max("turn").alias("hi")).first()
    if span["hi"] is None or span["hi"] // TURN_BLOCK == span["lo"] // TURN_BLOCK:
        return found
    late = own.where("q is null").select("conv_id", "turn", "block", F.col("content").alias("answer"))
    tails = rows.where("role = 'user'").groupBy("conv_id", "block").agg(F.max_by(F.struct(F.col("content").alias("question")), "turn").alias("q"))
    carried = _carried(tails, late.select("conv_id", "block").distinct(), span["hi"] // TURN_BLOCK - span["lo"] // TURN_BLOCK)
    before = late.join(carried, ["conv_id", "block"]).select("conv_id", "turn", "answer", F.col("q.question").alias("question"))
    return found.unionByName(before)


def _carried(tails: DataFrame, wanted: DataFrame, blocks: int) -> DataFrame:
    """(conv_id, block, q): for each wanted block the ``q`` of the nearest block before it that has one.

    Looked for among the ``TURN_BLOCK`` blocks of a block of blocks and, where there is none, one level
    up; so no task ever sorts more than so many of a conversation's blocks.
    """
    up = lambda df: df.withColumn("above", F.floor(F.col("block") / TURN_BLOCK))
    both = up(tails).select("conv_id", "above", "block", "q", F.lit(False).alias("want")).unionByName(up(wanted).select("conv_id", "above", "block", F.lit(None).cast(tails.schema["q"].dataType).alias("q"), F.lit(True).alias("want")))
    w = Window.partitionBy("conv_id", "above").orderBy("block", F.desc("want"))  # the wanted one first: its own block's comes after it
    seen = both.withColumn("q", F.last("q", ignorenulls=True).over(w)).where("want")
    here = seen.where("q is not null").select("conv_id", "block", "q")
    if blocks < 1:
        return here
    open_ = seen.where("q is null").select("conv_id", "above", "block")
    higher = _carried(up(tails).groupBy("conv_id", "above").agg(F.max_by("q", "block").alias("q")).withColumnRenamed("above", "block"), open_.select("conv_id", F.col("above").alias("block")).distinct(), blocks // TURN_BLOCK)
    return here.unionByName(open_.join(higher.withColumnRenamed("block", "above"), ["conv_id", "above"]).select("conv_id", "block", "q"))


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for conv, turn, a, q in zip(pdf["conv_id"], pdf["turn"], pdf["answer"], pdf["question"]):
            a = a if isinstance(a, str) else None
            q = q if isinstance(q, str) else None
            defect, keys, n, word = None, None, 0, False
            if is_empty(a):
                defect = "empty"
            elif is_refusal(a):
                defect = "refusal"
            elif is_copy(q, a):
                defect = "copy"
            else:
                end = shape_of_end(a)
                if end == "open":
                    defect = "truncated"
                elif is_other_language(q, a):
                    defect = "other_language"
                elif end is None:
                    toks = end_tokens(a.rstrip())
                    if toks and toks[-1][0].isalnum():
                        keys, n, word = end_keys(toks, len(toks) - 1), sum(t[0].isalnum() for t in toks), toks[-1].islower()
            if defect or keys:
                out.append((conv, turn, defect, keys, n, word))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "defect", "keys", "n", "word"])


def broken_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, defect): one row per defective answer."""
    schema = "conv_id bigint, turn bigint, defect string, keys array<bigint>, n int, word boolean"
    judged = cut(answers(conversations).mapInPandas(_judge, schema))
    decided = judged.where("defect is not null").select("conv_id", "turn", "defect")
    asked = judged.where("defect is null").select("conv_id", "turn", "n", "word", F.posexplode("keys").alias("at", "key"))
    # Last words that many answers share would gather in one task: their counts, at most 4 / SHARED_KEY of them, are broadcast.
    total = judged.where("defect is null").count()
    common = asked.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= max(SHARED_LEAST, SHARED_KEY * total)).select("key")
    counts = cut(
        conversations.select(F.col("content").alias("content")).where("content is not null")
        .mapInPandas(_end_counts, "key bigint, seen bigint, ends bigint").groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))
    )
    few = cut(common.join(counts, "key", "left"))
    of_few = asked.join(F.broadcast(few), "key")
    of_rest = asked.join(F.broadcast(few.select("key")), "key", "left_anti").join(counts, "key", "left")
    counted = of_few.unionByName(of_rest).groupBy("conv_id", "turn").agg(
        F.first("n").alias("n"), F.first("word").alias("word"), *(F.coalesce(F.max(F.when(F.col("at") == i, F.col(c))), F.lit(0)).alias(f"{c}{i + 1}") for i in range(4) for c in ("seen", "ends"))
    )
    return decided.unionByName(counted.where(breaks_off()).select("conv_id", "turn", F.lit("truncated").alias("defect")))


def defect_report(conversations: DataFrame) -> DataFrame:
    """(defect, answers): how many answers have each defect; ``none`` for the sound ones."""
    bad = broken_pairs(conversations)
    whole = answers(conversations).groupBy().agg(F.count("*").alias("n"))
    per = bad.groupBy("defect").agg(F.count("*").alias("answers"))
    rest = whole.crossJoin(per.groupBy().agg(F.coalesce(F.sum("answers"), F.lit(0)).alias("b"))).select(F.lit("none").alias("defect"), (F.col("n") - F.col("b")).alias("answers"))
    return per.unionByName(rest)
