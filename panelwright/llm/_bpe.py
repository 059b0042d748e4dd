"""Word-end BPE tokenizers of the tokenizers library, word by word: a pre-token's ids do not depend on its neighbours."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core

import regex  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Pre-tokens of the word_bpe files. Fixed values of that format: contraction endings, runs of letters, single numbers, runs of others.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: All characters but these: Python and the library agree on case, composition, space and class of these ones (ASCII without rare controls, Latin, common punctuation).
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa0-İĲ-ſ‐-‧‰-⁞€]")
_LETTER, _DIGIT = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
#: PRE_TOKEN for lower-cased text of those characters.
_PLAIN = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
#: Distinct words and pre-tokens that a worker remembers; past that it forgets them all. Results do not depend on it.
REMEMBER = 500_000


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Cuts texts into words whose ids are independent of each other, and finds the ids of single words."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special)) if self.special else None
        self.split = regex.compile(PRE_TOKEN).findall
        self.letters = _byte_letters()
        self.model = self.library.model
        self.suffix = json.loads(self.library.to_str())["model"].get("end_of_word_suffix") or ""

    def normal(self, text: str) -> list[str]:
        """The normalised text's words between white space."""
        if _OTHER.search(text) is None:
            return (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split()
        return [x for x in regex.split(r"\s+", self.library.normalizer.normalize_str(text)) if x]

    def words(self, text: str) -> Iterable[tuple[str | None, list[str]]]:
        """(special string or None, words) in the text's order."""
        if self.cut is None or self.mark not in text:
            return [(None, self.normal(text))]
        return [(s, []) if s in self.special else (None, self.normal(s)) for s in self.cut.split(text)]

    def pre_tokens(self, word: str) -> list[str]:
        """The pre-tokens of a normalised word."""
        if word.isalpha() and word.isascii():
            return [word]
        return _PLAIN.findall(word) if _OTHER.search(word) is None else self.split(word)

    def merge(self, pre_token: str) -> list[int]:
        """The ids of a pre-token by the library's own merges."""
        if not pre_token.isascii() or not pre_token.isprintable():  # what is left of ASCII stands for itself
            pre_token = "".join(map(self.letters.__getitem__, pre_token.encode()))
        return [t.id for t in self.model.tokenize(pre_token)]


class Words(dict):
    """What is known of normalised words and of pre-tokens: ``make`` of a pre-token, ``join`` of a word's; of bounded size."""

    def __init__(self, cut: Callable[[str], list[str]], make: Callable[[str], object], join: Callable[[list], object], most: int = REMEMBER):
        super().__init__()
        self.cut, self.make, self.join, self.most = cut, make, join, most

    def __missing__(self, word: str) -> object:
        parts = self.cut(word)
        found = self.make(word) if len(parts) == 1 and parts[0] == word else self.join([self[p] for p in parts])
        if len(self) >= self.most:
            self.clear()
        self[word] = found
        return found


_workers: dict[tuple, object] = {}


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object for each Python worker, kept from task to task."""
    if key not in _workers:
        _workers[key] = make()
    return _workers[key]
