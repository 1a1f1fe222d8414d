"""Token ids of whole texts, a word at a time: the word tokenizer's words never influence each other."""

from __future__ import annotations

import re
import sys
from array import array
from functools import partial

from tokenizers import Tokenizer

CACHED_WORDS = 300_000  # bounds a Python worker's memory; a full cache starts again

# Numbers that Python calls word characters (fixed values), and whatever is beyond Latin-1.
ODD = re.compile("[²³¹¼½¾]|[^\x00-\xff]")
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
# str.split() cuts at white space, which the tokenizer drops, and at these, which it keeps.
KEPT = re.compile("[\x1c-\x1f]")
CUT = re.compile("[ \n]+")
# Letters, single digits, and the rest: the tokenizer's own classes for Latin-1 without apostrophes.
CLASSES = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's alphabet: printable bytes stand for themselves, the others follow 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit integers, equal to the library's.

    The library lower-cases, splits into letter runs, single numbers and runs of other
    characters, and merges within each: so ids are kept by word. Words outside Latin-1, or with
    apostrophes (contractions), and texts with special-token strings go to the library whole.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        # The caches hold no encoder: a ring of the two would outlive its task by many others.
        self.cores = _Cache(partial(_core, self.full.model, _byte_letters()))
        self.words = _Cache(partial(_word, self.full, self.cores))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return _library(self.full, text)
        words = CUT.split(text) if KEPT.search(text) else text.split()
        return b"".join(map(self.words.__getitem__, words))


def _library(full: Tokenizer, text: str) -> bytes:
    return _bytes(full.encode(text, add_special_tokens=False).ids)


def _core(model, letters: dict[int, str], core: str) -> bytes:
    if not core.isascii():
        core = core.encode().decode("latin-1").translate(letters)
    return _bytes([t.id for t in model.tokenize(core)])


def _word(full: Tokenizer, cores: _Cache, word: str) -> bytes:
    if not word:
        return b""
    if PLAIN.fullmatch(word):
        return cores[word.lower()]
    if "'" in word or ODD.search(word) or not word.isprintable():
        return _library(full, word)
    return b"".join(map(cores.__getitem__, CLASSES.findall(word.lower())))


def _bytes(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _Cache(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[key] = value
        return value
