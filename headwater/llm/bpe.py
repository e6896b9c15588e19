"""Byte-level BPE compiled into finite-state transducers.

Two machines in a row. The first reads symbols (character classes) and marks where a pre-token
begins; it has nine states, so the work of a chunk is a map of nine states to nine states, and
the maps of chunks compose by a parallel prefix scan. The second reads the bytes of a pre-token.
Its state is a node of an Aho-Corasick automaton over the vocabulary and the last tokens of the
prefixes within one token's length. Each step fixes the last token of the prefix just read: the
longest vocabulary suffix that is compatible with the last token before it. Two tokens are
compatible if encoding their bytes gives these two again, and a sequence is the encoding of its
bytes exactly if all neighbours are compatible. So each step adds or withdraws a known number of
tokens, which is the count the transition carries.
"""

from __future__ import annotations

import codecs
import json
from functools import lru_cache

import numpy as np

# Pre-token pattern of byte-level BPE as these states and symbols (fixed values of the file format):
# 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
LETTER, NUMBER, OTHER, SHORT, LONG, LAST_SPACE, LAST_BLANK, BLANK, BREAK = range(9)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, PREFIXED, IN_BLANKS, DONE, ONE_MORE, TWO_MORE = range(9)
STATES = SYMBOLS = 9
STRIDE = 16
CHUNK = 512
LANE_BYTES = 40
WORDS_KEPT = 400_000
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pretoken_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token begins here" for each state and symbol."""
    begins = {
        LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE,
        LAST_SPACE: PREFIXED, LAST_BLANK: DONE, BLANK: IN_BLANKS, BREAK: FRESH,
    }
    goes_on = {
        IN_LETTERS: {LETTER: IN_LETTERS}, IN_NUMBERS: {NUMBER: IN_NUMBERS}, IN_BLANKS: {BLANK: IN_BLANKS},
        IN_OTHER: dict.fromkeys((OTHER, SHORT, LONG), IN_OTHER),
        PREFIXED: {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, **dict.fromkeys((OTHER, SHORT, LONG), IN_OTHER)},
        ONE_MORE: dict.fromkeys(range(BREAK), DONE), TWO_MORE: dict.fromkeys(range(BREAK), ONE_MORE),
        FRESH: {}, DONE: {},
    }
    following, starts = np.zeros(STATES * STRIDE, np.uint8), np.ones(STATES * STRIDE, bool)
    for state in range(STATES):
        for symbol in range(SYMBOLS):
            stays = goes_on[state].get(symbol)
            following[state * STRIDE + symbol] = begins[symbol] if stays is None else stays
            starts[state * STRIDE + symbol] = stays is None
    return following, starts


FOLLOWING, STARTS = pretoken_machine()


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (chunk, state) of ``first`` followed by ``then``."""
    return np.take_along_axis(then, first.astype(np.int64), axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of all maps up to each chunk, by doubling: log2(chunks) rounds over all chunks at once."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = compose(maps[:-step], maps[step:])
        step *= 2
    return maps


def run_chunks(symbols: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. Chunks run from every state at once; the scan then gives each its true one."""
    count = -(-len(symbols) // CHUNK)
    padded = np.full(count * CHUNK, BREAK, np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(count, CHUNK).T)
    if count == 1:
        entry = np.zeros(1, np.uint8)
    else:
        current = np.repeat(np.arange(STATES, dtype=np.uint8), count).reshape(STATES, count)
        for row in columns:
            current = FOLLOWING.take(current * np.uint8(STRIDE) + row)
        ends = prefix_scan(np.ascontiguousarray(current.T))[:, FRESH]
        entry = np.concatenate(([np.uint8(FRESH)], ends[:-1]))
    marks = np.empty((CHUNK, count), bool)
    for i, row in enumerate(columns):
        at = entry * np.uint8(STRIDE) + row
        marks[i] = STARTS.take(at)
        entry = FOLLOWING.take(at)
    return marks.T.reshape(-1)[: len(symbols)]


class Transducer:
    """Both machines for one vocabulary file. Built once per Python worker; see ``load``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        to_byte, vocabulary = byte_characters(), data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        spelled = {name: bytes(map(to_byte.__getitem__, name)) for name in vocabulary}
        self.bytes_of = token_bytes(path)
        self.rank = np.full(size, -1, np.int32)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.merge_rank: dict[int, int] = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, whole = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.merge_rank[x << 17 | y] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, x, y
        self.single = {spelled[n]: i for n, i in vocabulary.items() if len(spelled[n]) == 1}
        self._hash_pairs()
        own = self._self_encoding(vocabulary.values())
        self._automaton(own)
        self.lookahead = self._lookahead(own)
        self.classes = character_classes()
        self._counts: dict[str, int] = {}
        self._ids: dict[str, bytes] = {}

    # -- pairs -----------------------------------------------------------------------------------

    def _hash_pairs(self) -> None:
        """Open addressing over all merges, so that whole arrays of pairs are looked up at once."""
        bits = 19
        self._shift = np.uint64(64 - bits)
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, NO_RANK, np.int32)
        mask = (1 << bits) - 1
        for key, rank in self.merge_rank.items():
            slot = (key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - bits)
            while self._keys[slot] >= 0:
                slot = slot + 1 & mask
            self._keys[slot], self._ranks[slot] = key, rank

    def _pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 17 | y
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        ranks = np.where(found == key, self._ranks[slot], NO_RANK)
        rest = np.flatnonzero((found != key) & (found >= 0))
        while len(rest):
            slot[rest] = slot[rest] + 1 & len(self._keys) - 1
            found = self._keys[slot[rest]]
            hit = found == key[rest]
            ranks[rest[hit]] = self._ranks[slot[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return ranks

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge ever crosses between the tokens ``a`` and ``b`` while their bytes are encoded.

        The states of both edges are visited backwards in time. A crossing merge happens if its
        rank comes before the merges that take its parts away; at equal rank the left one comes first.
        """
        fine = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        taken_x, taken_y = np.full(len(a), NO_RANK), np.full(len(a), NO_RANK)
        while len(at):
            crossing = self._pair_ranks(x, y)
            bad = (crossing < taken_x) & (crossing <= taken_y) & (crossing != NO_RANK)
            fine[at[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            back_x = rank_x > rank_y
            taken_x, taken_y = np.where(back_x, rank_x, taken_x), np.where(back_x, taken_y, rank_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, taken_x, taken_y = at[go], x[go], y[go], taken_x[go], taken_y[go]
        return fine

    @lru_cache(maxsize=500_000)  # noqa: B019  one transducer lives as long as its worker
    def compatible_pair(self, a: int, b: int) -> bool:
        return bool(self.compatible(np.array([a]), np.array([b]))[0])

    # -- compilation -----------------------------------------------------------------------------

    def _self_encoding(self, numbers) -> np.ndarray:
        """Tokens that encoding can give: their own bytes encode to them."""
        own = np.zeros(len(self.bytes_of), bool)
        numbers = np.array(sorted(numbers))
        own[numbers[self.rank[numbers] < 0]] = True
        merged = numbers[self.rank[numbers] >= 0]
        merged = merged[np.argsort(self.rank[merged])]
        fine = self._joins(self.left[merged], self.right[merged], self.rank[merged])
        for number, good in zip(merged.tolist(), fine.tolist()):
            own[number] = good and own[self.left[number]] and own[self.right[number]]
        own[[i for i, b in enumerate(self.bytes_of) if len(b) > 1 and self.rank[i] < 0]] = False
        return own

    def _joins(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Whether the first merge across ``a`` and ``b`` is that of both, at ``rank``."""
        fine = np.ones(len(a), bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        taken_x, taken_y = rank.copy(), rank.copy()
        while len(at):
            crossing = self._pair_ranks(x, y)
            whole = (x == a[at]) & (y == b[at])
            bad = (crossing < taken_x) & (crossing <= taken_y) & (crossing != NO_RANK) & ~whole
            fine[at[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            back_x = rank_x > rank_y
            taken_x, taken_y = np.where(back_x, rank_x, taken_x), np.where(back_x, taken_y, rank_y)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            at, x, y, taken_x, taken_y = at[go], x[go], y[go], taken_x[go], taken_y[go]
        return fine

    def _automaton(self, own: np.ndarray) -> None:
        """Aho-Corasick over the tokens: full transition table, longest token that ends at a node, next shorter."""
        children, parent, byte, depth, token = [{}], [0], [0], [0], [-1]
        for number in np.flatnonzero(own).tolist():
            node = 0
            for b in self.bytes_of[number]:
                following = children[node].get(b)
                if following is None:
                    following = children[node][b] = len(children)
                    children.append({}), parent.append(node), byte.append(b)
                    depth.append(depth[node] + 1), token.append(-1)
                node = following
            token[node] = number
        depth, parent, byte = np.array(depth), np.array(parent), np.array(byte)
        self.ends = np.array(token, np.int32)
        self.goto = np.zeros((len(children), 256), np.int32)
        fail = np.zeros(len(children), np.int64)
        self.shorter = np.full(len(self.bytes_of), -1, np.int32)
        self.length = np.array([len(b) for b in self.bytes_of], np.int32)
        self.longest = int(depth.max())
        for b, node in children[0].items():
            self.goto[0, b] = node
        for level in range(1, self.longest + 1):
            nodes = np.flatnonzero(depth == level)
            if level > 1:
                fail[nodes] = self.goto[fail[parent[nodes]], byte[nodes]]
            self.goto[nodes] = self.goto[fail[nodes]]
            below = np.flatnonzero(depth == level + 1)
            self.goto[parent[below], byte[below]] = below
            inherited = self.ends[fail[nodes]]
            is_token = self.ends[nodes] >= 0
            self.shorter[self.ends[nodes[is_token]]] = inherited[is_token]
            self.ends[nodes[~is_token]] = inherited[~is_token]

    def _lookahead(self, own: np.ndarray) -> int:
        """Bytes after a token's end that can still change it.

        A merge (u, v) is given up only if an earlier merge takes the right edge of what forms v,
        and that one only if a still earlier merge takes the edge of its own right part, and so on.
        Ranks fall along such a chain, so its longest spelling is a longest path: merges in order of
        rank, each adding its right part to the best chain that starts at an edge of that part.
        """
        best = np.zeros(len(self.bytes_of), np.int64)
        furthest = 0
        for number in sorted(np.flatnonzero(self.rank >= 0).tolist(), key=lambda n: self.rank[n]):
            u, v = int(self.left[number]), int(self.right[number])
            edge, chain = v, 0
            while edge >= 0:
                chain = max(chain, int(best[edge]))
                edge = int(self.right[edge])
            chain += int(self.length[v])
            best[u] = max(int(best[u]), chain)
            furthest = max(furthest, chain)
        return furthest

    # -- pre-tokens ------------------------------------------------------------------------------

    def symbols(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Symbols of code points: the class of each, with what the next two characters settle."""
        symbols = self.classes[points]
        symbols[breaks] = BREAK
        blank = symbols == BLANK
        visible = np.zeros(len(symbols), bool)
        visible[:-1] = symbols[1:] < LAST_SPACE
        before = np.flatnonzero(blank & visible)
        symbols[before] = np.where(points[before] == 32, LAST_SPACE, LAST_BLANK)
        ends = len(points) - 1
        for at in np.flatnonzero(points == 39).tolist():
            if symbols[at] == BREAK or at >= ends or symbols[at + 1] == BREAK:
                continue
            following = chr(points[at + 1])
            if following in "stmd":
                symbols[at] = SHORT
            elif at + 2 <= ends and symbols[at + 2] != BREAK and following + chr(points[at + 2]) in ("re", "ve", "ll"):
                symbols[at] = LONG
        return symbols

    def pretokens(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of all pieces in order, and how many each piece has."""
        joined = "\n".join(pieces) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        breaks = np.cumsum([len(p) + 1 for p in pieces]) - 1
        starts = np.flatnonzero(run_chunks(self.symbols(points, breaks)))
        ends = np.append(starts[1:], len(joined))
        first = np.searchsorted(starts, np.concatenate(([0], breaks + 1)))
        is_break = np.zeros(len(starts), bool)
        is_break[np.searchsorted(starts, breaks)] = True
        real = ~is_break
        words = [joined[a:b] for a, b in zip(starts[real].tolist(), ends[real].tolist())]
        return words, np.diff(first) - 1

    # -- tokens of pre-tokens ----------------------------------------------------------------------

    def last_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs the byte machine over many short words at once, longest first.

        Gives the order of the words, the last token of each prefix, and the token count of each prefix.
        """
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        longest = int(sizes[0])
        padded = np.frombuffer(b"".join(words[i].ljust(longest, b"\0") for i in order.tolist()), np.uint8)
        padded = padded.reshape(len(words), longest)
        last = np.full((longest + 1, len(words)), -1, np.int32)
        count = np.zeros((longest + 1, len(words)), np.int32)
        state = np.zeros(len(words), np.int32)
        for i in range(1, longest + 1):
            active = int(np.searchsorted(-sizes, -i, side="right"))
            state[:active] = self.goto[state[:active], padded[:active, i - 1]]
            lane, token = np.arange(active), self.ends[state[:active]]
            while len(lane):
                from_ = i - self.length[token]
                fits = from_ == 0
                check = np.flatnonzero(~fits)
                fits[check] = self.compatible(last[from_[check], lane[check]], token[check])
                good = lane[fits]
                last[i, good] = token[fits]
                count[i, good] = count[from_[fits], good] + 1
                lane, token = lane[~fits], self.shorter[token[~fits]]
        return order, last, count

    def _learn(self, words: list[str], ids: bool) -> None:
        """Adds new pre-tokens to the kept ones: short ones in lanes, long ones as a stream."""
        short, long = [], []
        for word in words:
            (short if len(word) <= LANE_BYTES and len(word.encode()) <= LANE_BYTES else long).append(word)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            order, last, count = self.last_tokens([w.encode() for w in part])
            sizes = np.array([len(part[i].encode()) for i in order.tolist()])
            lanes = np.arange(len(part))
            total = count[sizes, lanes]
            if not ids:
                self._counts.update(zip([part[i] for i in order.tolist()], total.tolist()))
                continue
            out = np.zeros((len(part), int(total.max())), "<u4")
            where, left = sizes.copy(), total.copy()
            while len(lanes):
                token = last[where, lanes]
                out[lanes, left - 1] = token
                where, left = where - self.length[token], left - 1
                go = where > 0
                lanes, where, left = lanes[go], where[go], left[go]
            for i, row, n in zip(order.tolist(), out, total.tolist()):
                self._ids[part[i]] = row[:n].tobytes()
        for word in long:
            stream = TokenStream(self)
            found = stream.feed(word.encode())
            found += stream.close()
            if ids:
                self._ids[word] = np.array(found, "<u4").tobytes()
            else:
                self._counts[word] = len(found)

    def _known(self, words: list[str], kept: dict, ids: bool) -> None:
        missing = [w for w in set(words) if w not in kept]
        if missing:
            if len(kept) + len(missing) > WORDS_KEPT:
                kept.clear()
                missing = list(set(words))
            self._learn(missing, ids)

    def pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Texts cut at strings of special tokens, and the number of pieces of each."""
        parts = [[text] for text in texts]
        for special in self.specials:
            parts = [[p for piece in own for p in piece.split(special)] if len(own) > 1 or special in own[0] else own for own in parts]
        return [p for own in parts for p in own], [len(own) for own in parts]

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text; a special token's string counts as one token."""
        pieces, per_text = self.pieces(texts)
        words, sizes = self.pretokens(pieces)
        self._known(words, self._counts, ids=False)
        counts = np.fromiter(map(self._counts.__getitem__, words), np.int64, len(words))
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(sizes)
        text_ends = np.cumsum(per_text)
        upto = total[np.concatenate(([0], ends))[np.concatenate(([0], text_ends))]]
        return (np.diff(upto) + np.array(per_text) - 1).tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text as little-endian unsigned 32-bit integers."""
        special = {name: np.array([number], "<u4").tobytes() for name, number in self.specials.items()}
        pieces, per_text = self.pieces(texts)
        words, sizes = self.pretokens(pieces)
        self._known(words, self._ids, ids=True)
        known, at, done, out = self._ids.__getitem__, 0, 0, []
        for text, n in zip(texts, per_text):
            parts, offset = [], 0
            for k in range(n):
                if k:
                    offset, name = min((text.find(s, offset), s) for s in special if text.find(s, offset) >= 0)
                    parts.append(special[name])
                    offset += len(name)
                parts.extend(map(known, words[at : at + sizes[done]]))
                at += int(sizes[done])
                offset += len(pieces[done])
                done += 1
            out.append(b"".join(parts))
        return out


class TokenStream:
    """Encodes the bytes of one pre-token as they come, in memory that does not grow with it.

    Kept are the last tokens of the prefixes within ``lookahead`` plus one token's length. A token
    is given out once more bytes than the sufficient lookahead have been read after its end.
    """

    def __init__(self, machine: Transducer):
        self.machine, self.state, self.at, self.given = machine, 0, 0, 0
        self.last: dict[int, int] = {}
        self.block = 4 * (machine.lookahead + machine.longest)

    def feed(self, data: bytes) -> list[int]:
        m, out = self.machine, []
        goto, ends, length, shorter, last = m.goto, m.ends, m.length, m.shorter, self.last
        for b in data:
            self.state = int(goto[self.state, b])
            self.at += 1
            token = int(ends[self.state])
            while True:
                before = self.at - int(length[token])
                if before == 0 or before >= self.given and before in last and m.compatible_pair(last[before], token):
                    break
                token = int(shorter[token])
            last[self.at] = token
            if self.at - self.given > self.block:
                out += self._give(self.at - m.lookahead)
        return out

    def _give(self, stable: int) -> list[int]:
        """Tokens of the present encoding that end at ``stable`` or before."""
        m, out, where = self.machine, [], self.at
        while where > self.given:
            token = self.last[where]
            if where <= stable:
                out.append(token)
            where -= int(m.length[token])
        done = self.given + sum(int(m.length[t]) for t in out)
        if out:
            self.given = done
            for old in [p for p in self.last if p < done]:
                del self.last[old]
        return out[::-1]

    def close(self) -> list[int]:
        return self._give(self.at)


class TextStream:
    """Bytes of tokens to text as they come: what is left of an unfinished character waits for the next bytes."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.decoder = bytes_of, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.decoder.decode(b"".join(map(self.bytes_of.__getitem__, ids)))

    def close(self) -> str:
        return self.decoder.decode(b"", True)


def character_classes() -> np.ndarray:
    """Letter, number, blank or other for each code point, as the tokenizer library's own patterns see them."""
    from tokenizers import Regex, normalizers

    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    every = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    where = np.array(points)
    for pattern, mark in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        replaced = normalizers.Replace(Regex(pattern), "￿").normalize_str(every)
        hit = np.frombuffer(replaced.encode("utf-32-le"), np.uint32) == 0xFFFF
        hit[points.index(0xFFFF)] = False
        classes[where[hit]] = mark
    return classes


@lru_cache(maxsize=8)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each token id."""
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    to_byte, specials = byte_characters(), {t["content"]: t["id"] for t in data["added_tokens"]}
    found = {number: bytes(map(to_byte.__getitem__, name)) for name, number in data["model"]["vocab"].items() if name not in specials}
    found |= {number: name.encode() for name, number in specials.items()}
    return [found.get(i, b"") for i in range(max(found) + 1)]


_LOADED: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """The transducer of a vocabulary file, compiled once per process."""
    if path not in _LOADED:
        _LOADED[path] = Transducer(path)
    return _LOADED[path]
