"""Token ids of whole texts by the tokenizer library, each distinct word asked once per Python worker.

For vocabulary files that drop white space and lower letters. No merge or pattern crosses a blank, or the
edge between an ASCII letter and a full stop or comma that ends a word, so the ids of a text are those of
these words in a row. Words of a batch are hashed, looked up and compared with the stored bytes as whole
arrays; only new words become Python objects and go to the library.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from headwater.llm.bpe import byte_characters
from headwater.llm.common import groups_by_size
from headwater.llm.shingles import mix64

WORDS_KEPT = 2_000_000
BYTES_KEPT = 128 << 20
BYTES_AT_ONCE = 2 << 20
FACTOR = 0x9E3779B97F4A7C15
# Small ASCII letters and the small letters of Latin-1 in UTF-8 (all but the division sign): the library's
# normaliser leaves such words alone, so they go straight to its model, spelled in byte characters.
SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
MARK = np.zeros(256, bool)
MARK[[44, 46]] = True


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2^64, and of its inverse."""
    both = []
    for factor in (FACTOR, pow(FACTOR, -1, 2**64)):
        table = np.full(count, factor, np.uint64)
        table[0] = 1
        both.append(np.cumprod(table))
    return tuple(both)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all segments in a row: start, start + 1, ... for each."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Segments:
    """Variable-length values in one growing array."""

    def __init__(self, kind):
        self.data, self.starts, self.sizes = np.zeros(1 << 20, kind), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.count = self.used = 0

    def append(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.count + len(sizes) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.data[self.used : self.used + len(data)] = data
        self.sizes[self.count : self.count + len(sizes)] = sizes
        self.starts[self.count : self.count + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(data), self.count + len(sizes)

    def take(self, rows: np.ndarray) -> np.ndarray:
        return self.data[spread(self.starts[rows], self.sizes[rows])]


class WordEncoder:
    """See the module. ``encoder(texts)`` gives the ids of each as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = Tokenizer(self.tokenizer.model)
        self.spelling = {byte: ord(character) for character, byte in byte_characters().items()}
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids = Segments(np.uint8), Segments(np.uint32)
        self.hashes, self.slots = np.zeros(1 << 16, np.uint64), np.full(1 << 17, -1, np.int64)

    # -- table of words ------------------------------------------------------------------------------

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.slots) - 1)
        slot = (hashes & mask).astype(np.int64)
        row = self.slots[slot]
        rest = np.flatnonzero((row >= 0) & (self.hashes[row] != hashes))
        while len(rest):
            slot[rest] = slot[rest] + 1 & int(mask)
            row[rest] = self.slots[slot[rest]]
            found = row[rest]
            rest = rest[(found >= 0) & (self.hashes[found] != hashes[rest])]
        return row

    def _insert(self, first: int, count: int) -> None:
        """Rows ``first`` to ``first + count`` into the slots; those that meet move on."""
        mask = len(self.slots) - 1
        rows = np.arange(first, first + count)
        slot = (self.hashes[rows] & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, winner = np.unique(slot[free], return_index=True)
            chosen = free[winner]
            self.slots[slot[chosen]] = rows[chosen]
            left = np.ones(len(rows), bool)
            left[chosen] = False
            rows, slot = rows[left], slot[left] + 1 & mask

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        ids: list[np.ndarray] = [None] * len(words)
        simple = [bool(SIMPLE(w)) for w in words]
        for tokenizer, wanted in ((self.model, True), (self.tokenizer, False)):
            here = [i for i, s in enumerate(simple) if s is wanted]
            for at in range(0, len(here), 20_000):
                part = here[at : at + 20_000]
                spelled = [words[i].decode("latin-1").translate(self.spelling) if wanted else words[i].decode() for i in part]
                found = tokenizer.encode(spelled, is_pretokenized=True, add_special_tokens=False)
                data = np.array(found.ids, np.uint32)
                cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
                for i, a, b in zip(part, cuts[:-1], cuts[1:]):
                    ids[i] = data[a:b]
        first = self.words.count
        self.words.append(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
        self.ids.append(np.concatenate(ids), np.array([len(x) for x in ids]))
        while first + len(words) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.hashes[first : first + len(words)] = hashes
        if 2 * self.words.count > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int64)
            self._insert(0, self.words.count)
        else:
            self._insert(first, len(words))

    # -- texts ---------------------------------------------------------------------------------------

    def _rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The table's row for each word, after learning the new ones, and the words whose row holds another
        word of the same hash. Bytes are compared, so a clash is always found."""
        power, inverse = _powers(1 << max(21, int(len(data)).bit_length()))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        row = self._find(hashes)
        new = np.flatnonzero(row < 0)
        if len(new):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.words.count + len(distinct) > WORDS_KEPT or self.words.used > BYTES_KEPT:
                self._forget()
                distinct, new = np.unique(hashes, return_index=True)
                first = np.arange(len(new))
            whole = data.tobytes()
            places = new[first]
            self._learn([whole[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist())], distinct)
            row = self._find(hashes)
        sizes = ends - starts
        other = self.words.sizes[row] != sizes
        same = np.flatnonzero(~other)
        differs = self.words.take(row[same]) != data[spread(starts[same], sizes[same])]
        if differs.any():
            other[np.repeat(same, sizes[same])[differs]] = True
        return row, np.flatnonzero(other)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of small-letter texts without special tokens."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = BLANK[data]
        begins = ~blank
        begins[1:] &= blank[:-1]
        mark = np.flatnonzero(MARK[data])
        mark = mark[(mark > 0) & blank[np.minimum(mark + 1, len(data) - 1)]]
        begins[mark[LETTER[data[mark - 1]]]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return [b""] * len(texts)
        stops = np.append(starts[1:], len(data))
        next_blank = np.flatnonzero(blank)
        ends = np.minimum(stops, next_blank[np.searchsorted(next_blank, starts)])
        row, clashing = self._rows(data, starts, ends)
        ids = self.ids.take(row).astype("<u4").tobytes()
        tokens = np.concatenate(([0], np.cumsum(self.ids.sizes[row])))
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = (4 * tokens[np.searchsorted(starts, np.concatenate(([0], text_ends)))]).tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.unique(np.searchsorted(text_ends, starts[clashing], "right")).tolist():  # the library spells these itself
            out[i] = np.array(self.tokenizer.encode(texts[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        owner, parts = [], []
        for i, text in enumerate(texts):
            data = text.encode()
            if b"<|" in data:  # may hold the string of a special token, which is told apart by its case
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            data, at = data.lower(), 0
            while len(data) - at > 2 * BYTES_AT_ONCE and (found := re.compile(rb"[ \t-\r]").search(data, at + BYTES_AT_ONCE)):
                owner.append(i), parts.append(data[at : found.start()])
                at = found.start()
            owner.append(i), parts.append(data[at:])
        for a, b in groups_by_size(parts, BYTES_AT_ONCE):
            for i, ids in zip(owner[a:b], self._encode(parts[a:b])):
                out[i] += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    """One encoder per vocabulary file and Python worker."""
    return WordEncoder(path)
