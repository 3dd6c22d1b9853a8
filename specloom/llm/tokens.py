"""Exact encoding of many texts with a ``tokenizers`` file, each distinct piece once.

A byte-level pre-tokenizer never joins a character that is no white space with white
space that follows it, nor a letter with a mark or digit that follows it (the apostrophe
aside), so a text may be cut before any single space or line break that follows such a
character, after such a line break, and between a letter and an ASCII mark; the pieces'
ids put together are the text's ids.  A corpus repeats most of its pieces: each task
keeps the ids of those it has met, under a 64-bit hash, and compares length and first
eight bytes.  Texts with white space before a space are encoded whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from specloom.llm._common import BYTE_CODES, SPACES, find, flat, group_starts, prefix_sums, run_hash, text_bytes

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # of the first n bytes
# fixed values: the UTF-8 forms of Unicode's white space beyond ASCII
WIDE_SPACES = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]
_ENDS_SPACE = {n: np.array(sorted(int.from_bytes(c.encode(), "big") for c in [*map(chr, SPACES), *WIDE_SPACES, *"\x1c\x1d\x1e\x1f"] if len(c.encode()) == n)) for n in (1, 2, 3)}


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[33:127] = True
_MARK = _GRAPHIC & ~_LETTER
_MARK[39] = False  # the apostrophe begins contractions


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a text may be cut besides its spaces: True at the first byte of the second piece."""
    out = np.zeros(len(data), bool)
    if len(data) < 3:
        return out
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the last byte of a Latin-1 letter
    out[1:] = letter[:-1] & _MARK[data[1:]]
    line = np.flatnonzero(data[1:-1] == 10) + 1
    line = line[(letter[line - 1] | _GRAPHIC[data[line - 1]]) & (_GRAPHIC[data[line + 1]] | (data[line + 1] == 0xC3))]
    out[line] = out[line + 1] = True
    return out


class Encoder:
    """``encode(texts)``: the flat ids of all texts and the number of ids of each.

    Special-token strings inside a text are ordinary text, unlike in the library's plain
    ``encode(text, add_special_tokens=False)``, which makes them one id. Null is the empty text.
    ``cache``: distinct pieces kept between calls; beyond it the cache starts anew.
    """

    def __init__(self, definition: str, cache: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's task slots are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.most = cache
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = len(token)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: the bytes that byte-level vocabularies write as themselves
        self.as_char = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}
        self._reset()

    def _reset(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _words(self, words: list[str]) -> list[list[int]]:
        """Ids of a space or none and letters: one pre-token, so the model alone suffices."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(w.replace(" ", "\u0120") if w.isascii() else w.encode().decode("latin-1").translate(self.as_char))] for w in words]

    def _joined(self, pieces: list[str], group: int = 64) -> list[list[int]]:
        """Ids of pieces that begin with a space and end with no white space: many to a call, cut by the bytes they stand for."""
        if not pieces:
            return []
        ids = list(chain.from_iterable(self._whole(["".join(pieces[i : i + group]) for i in range(0, len(pieces), group)])))
        cut = (np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum([len(p.encode()) for p in pieces])) + 1).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut)]

    def _learn(self, key: np.ndarray, check: np.ndarray, pieces: list[str]) -> None:
        kind = np.fromiter((0 if p[p[0] == " " :].isalpha() else 1 if p[0] == " " and not p[-1].isspace() else 2 for p in pieces), np.int8, len(pieces))
        found: list = [None] * len(pieces)
        for which, encode in enumerate((self._words, self._joined, self._whole)):
            at = np.flatnonzero(kind == which).tolist()
            for i, ids in zip(at, encode([pieces[i] for i in at])):
                found[i] = ids
        count = np.fromiter(map(len, found), np.uint32, len(found))
        total = int(count.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(total, self.used), np.uint32)])
        self.ids[self.used : self.used + total] = np.fromiter(chain.from_iterable(found), np.uint32, total)
        at = np.searchsorted(self.key, key)
        start = self.used + np.cumsum(count, dtype=np.int64) - count
        self.key, self.check = np.insert(self.key, at, key), np.insert(self.check, at, check)
        self.start, self.count = np.insert(self.start, at, start.astype(np.uint32)), np.insert(self.count, at, count)
        self.used += total

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        column = flat(texts)
        n = len(column)
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        mark = data == 32
        spaces = np.flatnonzero(mark)
        mark |= _cuts(data)
        mark[offsets[:-1][np.diff(offsets) > 0]] = True
        cut = np.flatnonzero(mark)
        doc = np.searchsorted(offsets, cut, side="right") - 1
        odd = np.zeros(n, bool)
        inner = spaces[offsets[np.searchsorted(offsets, spaces, side="right") - 1] < spaces]
        for width, forms in _ENDS_SPACE.items():
            at = inner[inner >= width]
            value = sum(data[at - k].astype(np.int64) << 8 * (k - 1) for k in range(1, width + 1))
            bad = at[np.isin(value, forms)]
            odd[np.searchsorted(offsets, bad, side="right") - 1] = True
        end = np.append(cut[1:], len(data))
        plain = ~odd[doc]
        cut, end, doc = cut[plain], end[plain], doc[plain]
        key = run_hash(prefix_sums(BYTE_CODES[data]), cut, end)
        size = end - cut
        eight = np.ndarray((len(data),), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))[cut]
        check = eight & (_MASKS[np.minimum(size, 8)]) ^ (size.astype(np.uint64) << np.uint64(40))
        order = np.argsort(key)
        at = group_starts(key[order])
        group = np.empty(len(key), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
        one = order[at]
        _, known = find(self.key, key[one])
        new = one[~known]
        if len(self.key) + len(new) > self.most:
            self._reset()
            new = one
        raw = data.tobytes()
        if len(new):
            self._learn(key[new], check[new], [raw[a:b].decode() for a, b in zip(cut[new].tolist(), end[new].tolist())])
        place = find(self.key, key[one])[0][group]
        clash = self.check[place] != check if len(place) else np.zeros(0, bool)
        if clash.any():  # two pieces with one hash: their texts are encoded whole
            odd[doc[clash]] = True
            keep = ~odd[doc]
            place, doc = place[keep], doc[keep]
        count = self.count[place].astype(np.int64)
        upto = np.cumsum(count)
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.start[place] - (upto - count), count)] if len(place) else np.zeros(0, np.uint32)
        counts = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
        if odd.any():
            rows = np.flatnonzero(odd)
            whole = [np.array(w, np.uint32) for w in self._whole(column.take(pa.array(rows)).to_pylist())]
            cuts = np.cumsum(counts)[rows]
            ids = np.insert(ids, np.repeat(cuts, [len(w) for w in whole]), np.concatenate(whole))
            counts[rows] = [len(w) for w in whole]
        return ids, counts


_encoders: dict[int, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """One encoder for each worker process."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition(path: str) -> str:
    """The tokenizer file's text, read on the driver; it goes to the executors with the task."""
    with open(path, encoding="utf-8") as f:
        return f.read()
