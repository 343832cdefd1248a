"""Exact, batched encoding with a word-level BPE tokenizer file.

The tokenizers this handles drop white space and lower-case (their pre-tokenizer
never joins letters, digits and punctuation), so a text's ids are the ids of its
chunks in order.  Chunks are found and hashed by the text kernel; each distinct
chunk is encoded once per worker by the tokenizers library and kept in a bounded
table, and the ids of a batch are gathered from it.  Words with anything unusual
(apostrophes, other scripts, special-token brackets, control characters) are one
chunk whole, so the library itself decides how they split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textkernel as K

#: Distinct chunks a worker remembers before it starts afresh.
REMEMBERED = 800_000

LETTER, PUNCTUATION, DIGIT = 1, 2, 3
_KIND = np.full(256, PUNCTUATION, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[128:] = LETTER
_KIND[48:58] = DIGIT
_ODD = np.zeros(256, bool)
_ODD[:32] = _ODD[127] = True
_ODD[[9, 10, 11, 12, 13]] = False
_ODD[[ord("'"), ord("<")]] = True
_ODD[0xC0:] = True
_ODD[0xC3:0xCA] = False  # U+00C0 to U+027F are letters, but for those of _letters_only


def _letters_only(kind: np.ndarray, piece: np.ndarray) -> None:
    """Makes each word with an unusual byte one chunk."""
    odd = _ODD[piece]
    lead = np.flatnonzero((piece[:-1] == 0xC3) | (piece[:-1] == 0xC4))
    follow = piece[lead + 1]
    sign = np.where(piece[lead] == 0xC3, (follow == 0x97) | (follow == 0xB7), follow == 0xB0)
    odd[lead[sign]] = True  # multiplication and division sign, I with dot
    if odd.any():
        word = np.cumsum(kind == 0)
        flagged = np.bincount(word[odd], minlength=int(word[-1]) + 1) > 0
        kind[flagged[word] & (kind != 0)] = LETTER


class Encoder:
    """Ids of whole columns; see encode()."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.zeros(size, bool)
        for word, at in self.tokenizer.get_vocab().items():
            self.closes[at] = word.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Encodes chunks and adds them to the table; hashes are sorted and new."""
        plain = np.array([c.isalpha() or (len(c) == 1) or not any(x.isalnum() or x == "'" for x in c) for c in chunks], bool) & np.array(["<" not in c for c in chunks], bool)
        sizes, ids = np.zeros(len(chunks), np.int64), [None] * len(chunks)
        where = np.flatnonzero(plain)
        groups = [where[a : a + 512] for a in range(0, len(where), 512)]
        joined = self.tokenizer.encode_batch_fast([" ".join(chunks[i] for i in g.tolist()) for g in groups], add_special_tokens=False)
        single = np.flatnonzero(~plain).tolist()
        for group, encoded in zip(groups, joined):
            got = np.array(encoded.ids, np.uint32)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) != len(group) or (len(ends) and ends[-1] != len(got)):
                single += group.tolist()
                continue
            for i, a, b in zip(group.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
                ids[i] = got[a:b]
        for i, encoded in zip(single, self.tokenizer.encode_batch_fast([chunks[i] for i in single], add_special_tokens=False)):
            ids[i] = np.array(encoded.ids, np.uint32)
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        place = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, place, hashes)
        self.at = np.insert(self.at, place, at)
        self.sizes = np.insert(self.sizes, place, sizes)

    def _chunks(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the table of each chunk, first chunk of each text)."""
        data, offsets = K.buffer_of(column)
        tokens = K.tokenize(data, offsets, _KIND, DIGIT, _letters_only)
        unique, first, inverse = np.unique(tokens.hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > REMEMBERED + len(unique) * 2:
            self._forget()
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            spans = zip(tokens.starts[first[new]].tolist(), tokens.ends[first[new]].tolist())
            self._learn(unique[new], [raw[a:b].decode("utf-8", "replace") for a, b in spans])
            place = np.searchsorted(self.keys, unique)
        return place[inverse], tokens.bounds

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        place, bounds = self._chunks(column)
        sums = np.append(0, np.cumsum(self.sizes[place]))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, where each text's ids begin and end)."""
        place, bounds = self._chunks(column)
        sizes = self.sizes[place]
        sums = np.append(0, np.cumsum(sizes))
        source = np.repeat(self.at[place] - sums[:-1], sizes) + np.arange(sums[-1])
        return self.pool[source], sums[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder for a file; its table of chunks outlives a task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
