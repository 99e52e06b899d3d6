"""Token ids of whole texts by a tokenizer file, computed on the UTF-8 bytes of an Arrow batch.

A tokenizer that drops white space encodes each word by itself, so each distinct word is encoded
once a task and then found by its 64-bit hash in a table of numpy arrays. Its pieces (runs of
letters and the like, in lower case) are kept in turn, so that a known run with new punctuation costs
no encoding. Words with characters beyond U+024F always go to the tokenizer itself.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from cohortry.llm.words import words

_SLOTS = 1 << 22
_MAX_WORDS = _SLOTS * 5 // 8
_MAX_RUNS = 700_000
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile("[\x21-\x7e\xa1-\xac\xae-ɏ]+")


class Encoder:
    """Ids of documents; ``end`` follows each document."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path) as file:
            given = json.load(file)
        vocabulary = given["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        if given["model"].get("end_of_word_suffix") != "</w>" or "Lowercase" not in json.dumps(given["normalizer"]):
            raise ValueError("not a tokenizer of lower-case words with word ends")
        self.end = end
        self.runs: dict[str, bytes] = {}
        self.clear()

    def clear(self) -> None:
        """An empty table; entry 0 is the end of a document."""
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.value = np.zeros(_SLOTS, np.int32)
        self.pool = np.array([self.end], np.uint32)
        self.start = np.zeros(1, np.int64)
        self.size = np.ones(1, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each word, or -1."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        open_ = np.arange(len(keys))
        while len(open_):
            at = slot[open_]
            there = self.keys[at]
            same = there == keys[open_]
            out[open_[same]] = self.value[at[same]]
            open_ = open_[~same & (there != 0)]
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)
        return out

    def _add(self, keys: np.ndarray, first: int) -> None:
        """Enter distinct new words as entries first, first + 1, ..."""
        value = np.arange(first, first + len(keys), dtype=np.int32)
        slot = (keys >> np.uint64(20)).astype(np.int64) & (_SLOTS - 1)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = keys[free]
            won = free[self.keys[slot[free]] == keys[free]]
            self.value[slot[won]] = value[won]
            open_ = np.setdiff1d(open_, won, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & (_SLOTS - 1)

    def _encoded_runs(self, runs: list[str]) -> None:
        if len(self.runs) > _MAX_RUNS:
            self.runs.clear()
        for k in range(0, len(runs), 500):
            part = runs[k : k + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):
                self.runs.update(zip(part, (x.tobytes() for x in np.split(ids, ends[:-1])), strict=True))
            else:  # a run that the tokenizer splits further
                self.runs.update((r, np.array(self.tokenizer.encode(r, add_special_tokens=False).ids, np.uint32).tobytes()) for r in part)

    def encode_words(self, given: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        plain = [w for w in given if _PLAIN.fullmatch(w)]
        parts = dict(zip(plain, map(_RUN.findall, self.tokenizer.normalizer.normalize_str(" ".join(plain)).split(" ")), strict=True)) if plain else {}
        new = {r for runs in parts.values() for r in runs} - self.runs.keys()
        if new:
            before = len(self.runs)
            self._encoded_runs(sorted(new))
            if len(self.runs) < before:  # emptied: the known ones are needed as well
                self._encoded_runs(sorted({r for runs in parts.values() for r in runs} - self.runs.keys()))
        get = self.runs.__getitem__
        return [b"".join(map(get, parts[w])) if w in parts else np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in given]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents one after another, each followed by the end, and where each document starts."""
        found = words(data, offsets)
        if len(self.start) + len(found.hash) > _MAX_WORDS and len(self.start) > 1:
            self.clear()
        keys = found.hash | np.uint64(1)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new, one = np.unique(keys[missing], return_index=True)
            at = missing[one]
            raw = data.tobytes()
            ids = self.encode_words([raw[a:b].decode("utf-8", "replace") for a, b in zip(found.start[at].tolist(), found.end[at].tolist(), strict=True)])
            size = np.array([len(x) // 4 for x in ids], np.int64)
            first, base = len(self.start), len(self.pool)
            self.start = np.concatenate([self.start, base + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])
            self._add(new, first)
            entry[missing] = first + np.searchsorted(new, keys[missing])
        entry = np.insert(entry, found.first[1:], 0)
        size = self.size[entry]
        until = np.cumsum(size)
        flat = self.pool[np.repeat(self.start[entry] - (until - size), size) + np.arange(until[-1] if len(until) else 0)]
        ends = until[found.first[1:] + np.arange(len(offsets) - 1)]
        return flat, np.concatenate([[0], ends])
