"""A tokenizer as a whole: layout of ids, special tokens, its file, and column functions.

Ids 0-255 are bytes, 256.. merges by rank; special tokens take the last ids of the
configured size.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.writers import write_json
from . import bpe

# The kind and version that tokenizer files carry.
FILE_TYPE, FILE_VERSION = "ByteLevelBPE", 1


def gpt2_like() -> str:
    """Contractions, letter runs, digit runs, symbol runs, white space.

    For the ``regex`` package, in its set notation.  Letters are those of the basic plane, as saved tokenizers
    have them; letters beyond it are cut with symbols, and so are digits other than 0-9 and ``_``.
    """
    # The public pattern of that name.
    letters = r"[\p{L}&&[\x00-\uffff]]"
    return rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?[0-9]+| ?[^\s0-9{letters}]+|\s+(?!\S)|\s+"


class gpt2_words:  # noqa: N801
    """Cuts a text by that pattern, with the spans between its matches, so that the parts join to the text."""

    def __init__(self) -> None:
        import regex

        self._rx = regex.compile(gpt2_like())

    def __reduce__(self):
        return gpt2_words, ()

    def __call__(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self._rx.finditer(text):
            out += [w for w in (text[at : m.start()], m[0]) if w]
            at = m.end()
        return out + ([text[at:]] if at < len(text) else [])


# Fields and defaults are those of the tokenizer file.
@dataclass
class Config:
    vocab_size: int = 32768
    bos_token: str = "<|beginoftext|>"
    eos_token: str = "<|endoftext|>"
    pad_token: str = "<|pad|>"
    unk_token: str = "<|unk|>"
    extra_special_tokens: list[str] = field(default_factory=list)
    reserved_tokens: list[str] = field(default_factory=list)
    pre_tokenize: str | None = None
    split_special: bool = False

    def __post_init__(self) -> None:
        s = self.specials
        if len(set(s)) != len(s) or not all(s):
            raise ValueError("special tokens must be different and not empty")
        if self.vocab_size < 256 + len(s):
            raise ValueError("the vocabulary has no room for bytes and special tokens")

    @property
    def specials(self) -> list[str]:
        return [self.bos_token, self.eos_token, self.pad_token, self.unk_token, *self.extra_special_tokens, *self.reserved_tokens]

    @property
    def most_merges(self) -> int:
        return self.vocab_size - 256 - len(self.specials)


class Tokenizer:
    """Merges with a layout.  ``pre_tokenize`` is ``simple``, ``gpt2``, a pattern, or none.

    ``exact`` is proper BPE; files that don't say so are encoded as their makers did (``bpe.Merges``).
    """

    def __init__(self, config: Config, merges: Sequence[Sequence[int]], exact: bool = True) -> None:
        if len(merges) > config.most_merges:
            raise ValueError(f"{len(merges)} merges, room for {config.most_merges}")
        self.config, self.merges = config, [tuple(m) for m in merges]
        pattern = {"simple": bpe.SIMPLE, None: None, "": None}.get(config.pre_tokenize, config.pre_tokenize)
        self._gpt2 = None
        if config.pre_tokenize == "gpt2":
            self._gpt2, pattern = gpt2_words(), None
        self.exact = exact
        self._bpe = bpe.Merges(list(self.merges), pattern=pattern, exact=exact)
        top = config.vocab_size - len(config.specials)
        self.special_ids = {t: top + i for i, t in enumerate(config.specials)}
        self._by_id = {v: k for k, v in self.special_ids.items()}
        self._split = re.compile("|".join(re.escape(t) for t in sorted(config.specials, key=len, reverse=True)))

    def __getstate__(self):
        return {"config": asdict(self.config), "merges": self.merges, "exact": self.exact}

    def __setstate__(self, s):
        self.__init__(Config(**s["config"]), s["merges"], s["exact"])

    def _plain(self, text: str) -> list[int]:
        if self._gpt2 is None:
            return self._bpe.encode(text)
        return [i for w in self._gpt2(text) for i in self._bpe.word(w)]

    def encode(self, text: str, bos: bool = False, eos: bool = False, split_special: bool | None = None) -> list[int]:
        """Ids; with split_special the strings of special tokens in the text become their ids."""
        if self.config.split_special if split_special is None else split_special:
            ids, at = [], 0
            for m in self._split.finditer(text):
                ids += [*self._plain(text[at : m.start()]), self.special_ids[m[0]]]
                at = m.end()
            ids += self._plain(text[at:])
        else:
            ids = self._plain(text)
        return [self.special_ids[self.config.bos_token]] * bos + ids + [self.special_ids[self.config.eos_token]] * eos

    def chunks(self, text: str, size: int, bos: bool = True, eos: bool = True) -> list[list[int]]:
        """Ids of each stretch of ``size`` characters, the ends added to every one."""
        if size <= 0:
            raise ValueError("size must be positive")
        return [self.encode(text[i : i + size], bos, eos) for i in range(0, len(text), size)]

    def decode(self, ids: Sequence[int], skip_special: bool = True) -> str:
        """Text; special tokens are left out or written as they are; an unknown id is a KeyError."""
        table, out = self._bpe.token_bytes(), bytearray()
        for i in map(int, ids):
            if i in self._by_id:
                out += b"" if skip_special else self._by_id[i].encode()
            else:
                out += table[i]
        return out.decode("utf-8", "replace")

    @property
    def vocab_size(self) -> int:
        return 256 + len(self.merges) + len(self.special_ids)

    def report(self) -> dict:
        return {"vocab_size": self.vocab_size, "configured_vocab_size": self.config.vocab_size, "special_tokens": len(self.special_ids), "merges": len(self.merges), "unused": self.config.vocab_size - self.vocab_size}

    def save(self, path: str) -> None:
        said = {"exact_bpe": True} if self.exact else {}
        write_json({"version": FILE_VERSION, "type": FILE_TYPE, "config": asdict(self.config), "merges": [list(m) for m in self.merges]} | said, path)

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        if x.get("type") != FILE_TYPE or x.get("version") != FILE_VERSION:
            raise ValueError(f"no tokenizer file of version {FILE_VERSION}: {path}")
        return cls(Config(**x["config"]), x["merges"], bool(x.get("exact_bpe", False)))

    def vocabulary(self, spark) -> DataFrame:
        """(id, bytes, kind): the whole vocabulary."""
        rows = [(i, bytearray(b), "byte" if i < 256 else "merge") for i, b in self._bpe.token_bytes().items()]
        rows += [(i, bytearray(t.encode()), "special") for t, i in self.special_ids.items()]
        return spark.createDataFrame(rows, "id int, bytes binary, kind string")


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def encode(text: Column, tokenizer: Tokenizer, bos: bool = False, eos: bool = False) -> Column:
    """Token ids of a column of texts; null for null."""
    shared = bpe._share(tokenizer)

    @F.pandas_udf("array<int>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = shared.value
        for s in batches:
            yield pd.Series([None if t is None else tok.encode(t, bos, eos) for t in s])

    return enc(text)


def resize_plan(old: Tokenizer, new: Tokenizer) -> dict:
    """Ids that mean the same bytes in both, and rows to add or remove when a model changes its tokenizer."""
    a, b = old._bpe.token_bytes(), new._bpe.token_bytes()
    same = sum(1 for i, x in a.items() if b.get(i) == x)
    return {"same": same, "moved": len(a) - same, "added": max(0, new.config.vocab_size - old.config.vocab_size), "removed": max(0, old.config.vocab_size - new.config.vocab_size)}

