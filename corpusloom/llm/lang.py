"""A small language vote by script and function words, for whole passages."""

from __future__ import annotations

import re

_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]")),
    ("ko", re.compile("[가-힯]")),
    ("zh", re.compile("[一-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("he", re.compile("[֐-׿]")),
    ("hi", re.compile("[ऀ-ॿ]")),
    ("th", re.compile("[฀-๿]")),
)

_FUNCTION_WORDS = {
    "en": "the of and to in is was for with that had by from who at on it as are were be has have not but this an what which how "
          "when would could should there their they you your his her its been than then into about before after yet each only most "
          "few every between nobody without while such more says said once still first if or can do does my i we our these those",
    "fr": "le la les des du de un une et est dans pour que qui sur par au aux en ne pas plus ce cette ces se sa son ses il elle ils "
          "elles nous vous je tu mais ou où comme avec sans sous chez entre depuis avant après quand tandis si même aussi été était "
          "sera serait qu à dit selon puis encore leur leurs voici quel quelle pourquoi peux doit",
    "de": "der die das und ist den dem des ein eine einen einem einer mit von zu zum zur nicht auf für im in als auch sich es er sie "
          "wir ihr ich du war wird werden hat haben bei nach vor aus über unter bis durch um dass oder aber doch wenn wie was wer warum "
          "sagt noch schon kein keine niemand ohne laut seit mehr so an am heißt man kann kannst muss sobald zuerst dazu dabei hier",
    "es": "el la los las de del y que en un una unos unas por con para es son su sus al lo se no más como pero si sin sobre entre "
          "desde hasta cuando donde quien cual qué cómo este esta estos ese esa eso muy ya también fue era será ser ha hay yo tú "
          "nos le les mi tu según antes después cada nadie mientras tras todavía luego hace puedes debe ante bajo o ni",
    "it": "il lo la gli le di del della dei delle e è che in un una uno per con non si su da dal dalla al alla come ma se più anche "
          "sono era ha questo questa quando dove chi perché senza tra fra ogni dopo prima già nel nella",
    "pt": "o a os as do da dos das de e é que em um uma por com para não se no na nos nas ao à mais como mas ou sem sobre entre "
          "desde até quando onde quem este esta isso muito já também foi era ser são seu sua você antes depois cada",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij naar uit door over nog wel geen wordt "
          "hebben heeft was waren die deze wat wie hoe waarom zonder tussen",
}
_WORD_LANGS: dict[str, tuple[str, ...]] = {}
for _lang, _ws in _FUNCTION_WORDS.items():
    for _w in _ws.split():
        _WORD_LANGS[_w] = (*_WORD_LANGS.get(_w, ()), _lang)
LATIN = tuple(_FUNCTION_WORDS)
_TOKEN = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[\W\d_]+")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_URL = re.compile(r"https?://\S+")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s*|\n+")


def is_function_word(w: str) -> bool:
    return w in _WORD_LANGS


def without_code(text: str) -> str:
    return _URL.sub(" ", _CODE.sub("\n", text))


def script(text: str) -> str | None:
    """A language told by its script alone, where that script prevails among the letters."""
    if text.isascii():
        return None
    latin = len(re.findall(r"[A-Za-zÀ-ɏ]+", text))
    for lang, rx in _SCRIPTS:
        n = len(rx.findall(text))
        if n and (n >= 4 * latin or n >= 8 and n > 1.5 * latin):
            return lang
    return None


def scores(text: str) -> tuple[dict[str, float], int]:
    """Votes of function words by language, a shared word voting in parts; and the words seen."""
    out: dict[str, float] = {}
    words = _TOKEN.findall(text.lower())
    for langs in map(_WORD_LANGS.get, words):
        if langs:
            for lang in langs:
                out[lang] = out.get(lang, 0) + 1
    return out, len(words)


def identify(text: str, margin: float = 2.0) -> str | None:
    """The language of a passage, or None where the vote is not clear by ``margin`` words."""
    if s := script(text):
        return s
    votes, n = scores(text)
    if not votes:
        return None
    best = max(votes, key=lambda k: votes[k])
    second = max((v for k, v in votes.items() if k != best), default=0)
    if votes[best] < max(2, 0.12 * n) or votes[best] - second < (margin if n > 12 else 1):
        return None
    return best


def by_size(text: str) -> dict[str | None, int]:
    """Size of each language's share of a text, sentence by sentence, in latin-letter terms."""
    out: dict[str | None, int] = {}
    for s in _SENTENCE.split(without_code(text)):
        letters = len(_NO_LETTER.sub("", s))
        if not letters:
            continue
        lang = identify(s, 1.0)
        out[lang] = out.get(lang, 0) + (letters * 2 if lang in ("ja", "zh", "ko") else letters)
    return out
