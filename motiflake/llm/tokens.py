"""Token ids of whole texts with a tokenizer file whose words end in </w>, through a cache of words per worker.

Texts within Latin-1, without control characters, apostrophes or special-token brackets split into the tokenizer's
words by byte classes alone: runs of letters, single digits, runs of other signs. Those words are looked up by hash in
a table that lives as long as the Python worker, and only new ones go to the tokenizer, many at once, told apart again
by their end-of-word tokens. All other texts go to the tokenizer whole, so ids are the same either way.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np

from .textkernel import BASE, BASE_INV, mix, power, running

MOST_WORDS = 600_000

_text = bytes(range(256)).decode("latin-1")
KIND = np.array([0 if c.isspace() else 1 if c.isalpha() else 2 if c.isnumeric() else 3 for c in _text], np.uint8)
FOLD = np.frombuffer("".join(c.lower() if len(c.lower()) == 1 and ord(c.lower()) < 256 else c for c in _text).encode("latin-1"), np.uint8)
ODD = np.zeros(256, bool)
ODD[[*range(9), *range(14, 32), *range(127, 161), 173, 39]] = True


class Vocabulary:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def encode(self, texts: list[str], most: int = 1 << 17) -> list[np.ndarray]:
        """Ids of each text, in lots of about `most` characters: the tokenizer's own results are large."""
        out, lot, size = [], [], 0
        for k, t in enumerate(texts, 1):
            lot.append(t)
            size += len(t)
            if size >= most or k == len(texts):
                out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(lot, add_special_tokens=False)]
                lot, size = [], 0
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words (keys ascending) to the table."""
        parts = []
        for k in range(0, len(words), 1000):
            parts += self.encode([" ".join(words[k : k + 1000])])
        ids = np.concatenate(parts)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # not told apart by their ends: one by one
            each = self.encode(words)
            ids, stops = np.concatenate(each), np.cumsum([len(e) for e in each])
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, 2 * len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(a, where, b) for a, b in ((self.keys, keys), (self.at, starts + self.used), (self.n, stops - starts)))
        self.used += len(ids)

    def _simple(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all simple texts one after another, and the offsets of each."""
        off = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
        data = FOLD[np.frombuffer(b"".join(blobs), np.uint8)]
        kind = np.zeros(len(data) + 2, np.uint8)
        kind[1:-1] = KIND[data]
        new = kind[1:] != kind[:-1]
        new[off] = True
        new[:-1] |= kind[1:-1] == 2
        cuts = np.flatnonzero(new)
        start, end = cuts[:-1], cuts[1:]
        solid = kind[start + 1] > 0
        start, end = start[solid], end[solid]
        run = running(data, BASE)
        h = mix((run[end] - run[start]) * power(BASE_INV, start) + (end - start).astype(np.uint64))
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > MOST_WORDS:
            self.clear()
        where = np.minimum(np.searchsorted(self.keys, uniq), max(0, len(self.keys) - 1))
        fresh = self.keys[where] != uniq if len(self.keys) else np.ones(len(uniq), bool)
        if fresh.any():
            raw = data.tobytes()
            self._learn(uniq[fresh], [raw[a:b].decode("latin-1") for a, b in zip(start[first[fresh]].tolist(), end[first[fresh]].tolist(), strict=True)])
            where = np.searchsorted(self.keys, uniq)
        place = where[inverse]
        count = self.n[place]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.at[place] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(start, off)]

    def batch(self, texts: list[str], last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts one after another, each followed by `last` if given, and n + 1 offsets."""
        blobs, easy, parts = [], [], [None] * len(texts)
        for i, t in enumerate(texts):
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                continue
            if "<|" not in t and not ODD[np.frombuffer(b, np.uint8)].any():
                blobs.append(b)
                easy.append(i)
        if easy:
            ids, off = self._simple(blobs) if any(blobs) else (np.zeros(0, np.uint32), np.zeros(len(blobs) + 1, np.int64))
            for k, i in enumerate(easy):
                parts[i] = ids[off[k] : off[k + 1]]
        hard = [i for i, p in enumerate(parts) if p is None]
        for i, x in zip(hard, self.encode([texts[i] for i in hard]) if hard else [], strict=True):
            parts[i] = x
        tail = [] if last is None else [np.array([last], np.uint32)]
        out = [x for p in parts for x in (p, *tail)]
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum([len(p) + len(tail) for p in parts])]).astype(np.int64)


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    return Vocabulary(path)
