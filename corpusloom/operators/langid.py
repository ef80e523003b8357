"""A cheap language guess as one column expression: scripts, then function words, then letter pairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, strip_space

# Scripts in the order in which they decide, by code points.
SCRIPTS = (
    ("ja", r"[぀-ヿㇰ-ㇿ]"), ("ko", r"[가-힯ᄀ-ᇿ㄰-㆏]"), ("zh", r"[一-鿿㐀-䶿]"), ("ru", r"[Ѐ-ӿ]"),
    ("el", r"[Ͱ-Ͽ]"), ("ar", r"[؀-ۿ]"), ("he", r"[֐-׿]"), ("hi", r"[ऀ-ॿ]"), ("th", r"[฀-๿]"), ("vi", r"[Ḁ-ỿ]"),
)
# Words that vote for a language.
STOPWORDS = {
    "en": "the and that with this from have not are you for but was his her all she they were will what when which their there would about because school people water after".split(),
    "fr": "le la les de des un une et est vous nous que qui dans pour avec".split(),
    "es": "el la los las de del un una y es que en para por con se".split(),
    "de": "der die das und ich nicht ein eine ist den von mit sie auch".split(),
    "pt": "o a os as de do da que em um uma para com e não nao".split(),
}
# Letter pairs common in English.
EN_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt".split()
#: Characters that are looked at.
SAMPLE = 20_000


def _is_in(ws: list[str]):
    return lambda x: x["w"].isin(*ws)


def identify(text: Column) -> Column:
    """ISO code or null.  Ties of votes go to the language whose first voting word comes first."""
    t = F.substring(text, 1, SAMPLE)
    out = F.when(F.length(strip_space(t)) == 0, F.lit(None).cast("string"))
    for code, rx in SCRIPTS:
        out = out.when(t.rlike(rx), code)
    return out.otherwise(let(F.lower(t), _latin))


def _latin(t: Column) -> Column:
    words = F.regexp_extract_all(t, F.lit("([A-Za-zÀ-ÿ']+)"), F.lit(1))
    every = sorted({w for ws in STOPWORDS.values() for w in ws})
    # Only words that vote, each with its place, so that five ballots go over few words.
    voting = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*every))

    def ballot(vs: Column) -> Column:
        rows = []
        for n, (lang, ws) in enumerate(STOPWORDS.items()):
            own = F.filter(vs, _is_in(ws))
            rows.append(F.struct(F.size(own).alias("v"), (-F.coalesce(F.try_element_at(own, F.lit(1))["i"], F.lit(0))).alias("f"), F.lit(-n).alias("o"), F.lit(lang).alias("l")))
        return F.array_max(F.array(*rows))

    def by_pairs(s: Column) -> Column:
        pairs = F.regexp_extract_all(s, F.lit("(?=(..))"), F.lit(1))
        share = F.size(F.filter(pairs, lambda p: p.isin(*EN_PAIRS))) / (F.length(s) - 1)
        return F.when(F.length(s) < 200, "en").when(share > 0.06, "en")

    return let(let(voting, ballot), lambda best: F.when(best["v"] > 0, best["l"]).otherwise(let(F.regexp_replace(t, "[^a-z]", ""), by_pairs)))
