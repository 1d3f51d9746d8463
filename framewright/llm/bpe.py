"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array. In each round
every word's lowest-ranked pair is found (pair keys are looked up by binary
search in the sorted keys of the merge table), all its occurrences are merged
from left to right, and only pairs beside a merge are looked up anew. Words
without a mergeable pair leave the array. Distinct words are encoded once and
remembered in a bounded store; a document is joined from its words' ids.

The vocabulary is a word-end BPE of the ``tokenizers`` JSON layout: NFC,
white space collapsed, lower case; words by a pattern; bytes as symbols.

Defined cases: null and blank texts have no ids and decode to ''; strings of
special tokens within a text are their ids, as the library reads them; texts
of any length are encoded whole; repeated rows and ties need no rule; other
columns pass by, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, which str.split widens by \x1c to \x1f.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Chunks and words a worker remembers, and their characters; characters of
#: texts taken at once.
REMEMBER, REMEMBER_CHARS, AT_ONCE = 150_000, 1 << 24, 1 << 21
_NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBPE:
    """A word-end BPE vocabulary with batched merging."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.token = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.base = max(self.token) + 1
        suffix = model["end_of_word_suffix"]
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars])
        self.final = np.array([vocab[c + suffix] for c in chars])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs])
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        self.kept_words: dict[str, list[int]] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.kept_chars = 0

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of non-empty words given as UTF-8."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        symbol = self.inner[data]
        last = np.cumsum(size) - 1
        symbol[last] = self.final[data[last]]
        out: list[list[int]] = [[]] * len(words)
        rank = np.full(len(symbol), _NONE)
        fresh = np.ones(len(symbol), bool)
        while len(symbol):
            inside = np.append(word[1:] == word[:-1], False)
            look = np.flatnonzero(fresh & inside)
            rank[fresh] = _NONE
            rank[look] = self._ranks(symbol[look], symbol[look + 1])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(word)))
            done = best == _NONE
            if done.any():
                flat = symbol.tolist()
                for b, n in zip(begin[done].tolist(), length[done].tolist(), strict=True):
                    out[word[b]] = flat[b : b + n]
                live = np.repeat(~done, length)
                symbol, word, rank, best, length = symbol[live], word[live], rank[live], best[~done], length[~done]
                if not len(symbol):
                    break
            hit = rank == np.repeat(best, length)
            at = np.flatnonzero(hit)
            run = np.append(True, np.diff(at) > 1)  # of overlapping hits every other one merges
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            fresh = np.zeros(len(symbol), bool)
            fresh[at] = True
            fresh[np.maximum(at - 1, 0)] = True
            fresh[0] = True
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            symbol, word, rank, fresh = symbol[stay], word[stay], rank[stay], fresh[stay]
        return out

    def _split(self, chunk: str) -> list[str]:
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            chunk = "".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower()  # without the rule of final sigma
        else:
            chunk = chunk.lower()
        return self.words.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Remember ids and tokens of chunks free of white space."""
        cut = [self._split(c) for c in chunks]
        new = list({w: None for words in cut for w in words if w not in self.kept_words})
        if new:
            self.kept_words.update(zip(new, self.merge([w.encode("utf-8", "replace") for w in new]), strict=True))
        self.kept_chars += sum(map(len, chunks))
        for c, words in zip(chunks, cut, strict=True):
            ids = [i for w in words for i in self.kept_words[w]]
            self.kept[c] = (len(ids), " ".join(map(str, ids)), " ".join(map(self.token.__getitem__, ids)))

    def _chunks(self, text: str) -> list[str]:
        return [c for c in _BLANKS.split(text) if c] if _SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of ids, decimal ids and decoded text of each text."""
        if len(self.kept) > REMEMBER or len(self.kept_words) > REMEMBER or self.kept_chars > REMEMBER_CHARS:
            self.kept.clear()
            self.kept_words.clear()
            self.kept_chars = 0
        for s, i in self.special.items():
            self.kept[s] = (1, str(i), s)
        parts: list[list[str]] = []
        for t in texts:
            if t and self.cut and any(s in t for s in self.special):
                parts.append([c for k, p in enumerate(self.cut.split(t)) for c in ([p] if k % 2 else self._chunks(p))])
            else:
                parts.append(self._chunks(t) if t else [])
        self._learn(list({c: None for p in parts for c in p if c not in self.kept}))
        out = []
        for p in parts:
            found = [x for x in map(self.kept.__getitem__, p) if x[0]]
            out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out


@cache
def vocabulary(path: str) -> WordBPE:
    """One vocabulary for each worker."""
    return WordBPE(path)


def few(texts: pd.Series) -> Iterator[list[str | None]]:
    """A batch in runs of bounded text."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n >= AT_ONCE:
            yield run
            run, n = [], 0
    if run:
        yield run


def encoded(text: Column, path: str) -> Column:
    """A text column as structs: n_tokens, ids (decimal, blanks) and decoded."""

    @F.pandas_udf("n_tokens long, ids string, decoded string")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        for part in parts:
            yield pd.DataFrame([x for run in few(part) for x in bpe.encode(run)], columns=["n_tokens", "ids", "decoded"])

    return code(text)


def digested(text: Column, path: str) -> Column:
    """As :func:`encoded`, with SHA-256 of ids and decoded text instead."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = vocabulary(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in parts:
            yield pd.DataFrame([(n, sha(i), sha(d)) for run in few(part) for n, i, d in bpe.encode(run)], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return code(text)
