"""Token ids of whole texts, each distinct word encoded once per worker.

Both encoders give what the library gives for the whole text. They cut a text only where no token of
the tokenizer can cross, and have the library encode every distinct part. The tables of known parts
live in the Python worker across tasks and have a fixed size.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Letter runs, single digits, other runs and the contractions: how the word tokenizer cuts a word.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# Beyond these characters a word goes to the library whole, so that its own case and Unicode rules hold.
_PLAIN = re.compile("[\u0021-\u007e\u00a1-\u012f\u0131-\u024f]*")
# Where white space is only of the usual kinds, str.split cuts as _WORDS does, and faster.
_WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def locate(tokenizer: str) -> str:
    """A path, or the name of an installed public vocabulary file, found on the machine that asks."""
    if os.sep in tokenizer:
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


@lru_cache(maxsize=4)
def library(tokenizer: str):
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(locate(tokenizer))
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@lru_cache(maxsize=4)
def _bare_model(tokenizer: str):
    """The tokenizer's model and byte mapping without its normalizing and cutting."""
    from tokenizers import Tokenizer, pre_tokenizers
    bare = Tokenizer(library(tokenizer).model)
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return bare


class _Known(dict):
    """Ids of words and of their parts as bytes, found out at the first request and kept up to a fixed number."""

    def __init__(self, tokenizer: str, most: int):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most
        self.library, self.bare = library(tokenizer), _bare_model(tokenizer)

    def _encode(self, text: str, tokenizer) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        if word.isascii():
            letters = word.isalpha()
            if letters and word.islower():
                value = self._encode(word, self.bare)  # one letter run: nothing to normalize or to cut
            elif letters:
                value = self[word.lower()]
            elif word[-1] in ".," and word[:-1].isalpha():
                value = self[word[:-1]] + self._mark(word[-1])
            else:
                value = self._by_parts(word) if _PLAIN.fullmatch(word) else self._encode(word, self.library)
        elif _PLAIN.fullmatch(word) and unicodedata.is_normalized("NFC", word):
            value = self._by_parts(word)
        else:
            value = self._encode(word, self.library)
        self[word] = value
        return value

    def _mark(self, mark: str) -> bytes:
        return self.get(mark) or self._encode(mark, self.library)

    def _by_parts(self, word: str) -> bytes:
        if "<|" in word:
            return self._encode(word, self.library)  # may hold a special string
        parts = _PARTS.findall(word.lower())
        return b"".join([self._part(part) for part in parts])

    def _part(self, part: str) -> bytes:
        value = self.get(part)
        if value is None:
            self[part] = value = self._encode(part, self.bare)
        return value


class WordIds:
    """Ids, as little-endian 32-bit bytes, for tokenizers that drop white space and never join words."""

    def __init__(self, tokenizer: str, most_words: int = 1_500_000):
        self.known = _Known(tokenizer, most_words)

    def encode(self, texts: list[str]) -> list[bytes]:
        known = self.known.__getitem__
        return [b"".join(map(known, _WORDS.findall(text) if _OTHER_SPACE.search(text) else text.split()))
                for text in texts]


@lru_cache(maxsize=2)
def _ranked(tokenizer: str):
    """The same byte-level merges in a faster encoder, made from the tokenizer's own vocabulary.

    It applies merges in the order of their ids, so that must be the order in which the tokenizer has them.
    """
    import json

    import tiktoken
    with open(locate(tokenizer), encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    made = [vocabulary["".join(merge if isinstance(merge, list) else merge.split(" "))] for merge in model["merges"]]
    if made != sorted(made):
        raise ValueError("the merges of this tokenizer are not in the order of their ids")
    # Byte-level files write bytes without a printable character as the characters from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in library(tokenizer).get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=_SPACED_PARTS, mergeable_ranks=ranks, special_tokens={})


# How byte-level tokenizers of this kind cut a text into words.
_SPACED_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN_LINES = re.compile("[\n\u0021-\u007e\u00a1-\u024f]*")


class _Counts(dict):
    """Tokens of words with the space before them, found out at the first request, up to a fixed number."""

    def __init__(self, tokenizer: str, most: int):
        super().__init__()
        self.library, self.ranked, self.most = library(tokenizer), _ranked(tokenizer), most

    def of(self, text: str) -> int:
        """Plain characters go to the faster encoder, everything else to the library."""
        if "<|" not in text and _PLAIN_LINES.fullmatch(text, 1 if text[:1] == " " else 0):
            return len(self.ranked.encode_ordinary(text))
        return len(self.library.encode(text, add_special_tokens=False))

    def __missing__(self, word: str) -> int:
        if not word or word[-1].isspace():
            raise KeyError(word)  # it would change what the next space means: never learned
        if len(self) >= self.most:
            self.clear()
        if word[-1] in ".," and word[:-1].isalpha() and word.isascii():
            value = self[word[:-1]] + self.of(word[-1])
        else:
            value = self.of(f" {word}")
        self[word] = value
        return value


class SpacedCounts:
    """Token counts for byte-level tokenizers whose words carry the space before them.

    Such a tokenizer always starts a new word at a space that follows a character other than white
    space, whatever stands around it. Texts are cut there; a text with any other use of the space is
    left to the library as a whole.
    """

    def __init__(self, tokenizer: str, most_words: int = 2_000_000):
        self.known = _Counts(tokenizer, most_words)

    def _count(self, text: str) -> int:
        words = text.split(" ")
        try:
            if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                raise KeyError(words[0])
            return self.known.of(words[0]) + sum(map(self.known.__getitem__, words[1:]))
        except KeyError:
            return len(self.known.library.encode(text, add_special_tokens=False))

    def count(self, texts: list[str]) -> list[int]:
        return [self._count(text) for text in texts]


@lru_cache(maxsize=2)
def word_ids(tokenizer: str, most_words: int = 1_500_000) -> WordIds:
    return WordIds(tokenizer, most_words)


def forget() -> None:
    """Drops every loaded tokenizer and its known words."""
    for loaded in (word_ids, spaced_counts, _ranked, _bare_model, library):
        loaded.cache_clear()


@lru_cache(maxsize=2)
def spaced_counts(tokenizer: str) -> SpacedCounts:
    return SpacedCounts(tokenizer)


def slices(texts: list[str], most_chars: int = 1_000_000):
    """Bounds of consecutive groups of texts of about so many characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
