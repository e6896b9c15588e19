"""Operator 13: spelling variants, by dynamic programming over the sorted vocabulary.

A word is compared with a sorted list of words by one banded edit matrix. Neighbours in the list share a prefix,
and with it the rows of the matrix: a row is computed once per shared prefix, and where all its cells exceed one
edit the whole range of words with that prefix is skipped.

The vocabulary is dealt into sorted lists in which near words meet. Cut the shorter of two near words into pieces:
the first edit lies in one of them, and the words agree before and after it. So a word enters, per piece, the list of
words that agree with it outside that piece, once for its own length and once as the longer word of a pair. Lists
start from halves; a list of too many words is dealt again by pieces of half the size, down to single letters, so
no list grows with the vocabulary. A pair is taken in the piece that holds its first difference, hence once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import column, discard, ship, staged, texts_of

LEAST_LETTERS, LEAST_COUNT, FORM_FACTOR = 7, 2, 10
DAMAGE, LETTERS = 31, "a-zÀ-ÿ"
LIST_WORDS = 8_192  # a list of more words is dealt again
CHUNK_ROWS, CHUNK_CELLS, QUERIES_AT_ONCE = 65_536, 4_000_000, 8_192
HELD_WORDS, HELD_LETTERS = 200_000, 8_000_000  # of one task's counts between two outputs
ENTRY = "m int, piece int, key long, word string, n long"


# -- words ------------------------------------------------------------------------------------------------

def occurrences(doc: int | None, text: str, letters: int) -> Counter:
    """Counts of the runs of letters in a text, damaged ones without one of their letters, that are long enough."""
    found, prefix = Counter(), crc32(f"{'' if doc is None else doc}:".encode())
    lowered = text.encode().lower().decode()  # of bytes, so that only A-Z change
    for run, n in Counter(re.findall(f"[{LETTERS}]{{{letters},}}", lowered)).items():
        h = crc32(run.encode(), prefix)
        if h % DAMAGE == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= letters:
            found[run] += n
    return found


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with that many letters and occurrences. A task adds up its words before they are shuffled.

    Null texts have no words, a null key counts as the empty text, repeated rows count again.
    """
    ship(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for batch in batches:
            for doc, body in zip(batch.column("doc").to_pylist(), texts_of(batch, "text")):
                for run, n in occurrences(doc, body, letters).items():
                    if run in held:
                        held[run] += n
                    else:
                        held[run] = n
                        size += len(run)
                if len(held) > HELD_WORDS or size > HELD_LETTERS:
                    yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})
                    held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pydict({"word": list(held), "n": list(held.values())})

    found = docs.select(column(key).alias("doc"), column(text).alias("text")).mapInArrow(counts, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# -- the sorted list ----------------------------------------------------------------------------------------

def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of code points per word, zeros after its end, and the lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    table = np.zeros((len(words), int(lengths.max(initial=0)) + 3), np.uint32)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return table, lengths


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows that differ; a row may not be the other's equal."""
    return (a != b).argmax(axis=1)


def near_pairs(table: np.ndarray, lengths: np.ndarray, group: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query row, row) at one edit within the sorted lists that ``group`` numbers."""
    rows = len(table)
    common = np.full(rows + 1, -1, np.int64)  # with the word before; below zero where a list begins
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    common[same] = shared(table[same - 1], table[same])
    begins = np.flatnonzero(common[:-1] < 0)
    ends = np.append(begins[1:], rows)
    # All words of a list share this prefix: the matrix starts below it, with |i - j| beside the diagonal.
    inner = np.where(common[:-1] < 0, np.iinfo(np.int64).max, common[:-1])
    prefix = np.minimum(np.minimum.reduceat(inner, begins), lengths[begins])
    owner = np.searchsorted(begins, queries, "right") - 1
    order = np.argsort(prefix[owner], kind="stable")
    queries, owner = queries[order], owner[order]
    start_depth = prefix[owner]

    q, low = np.empty(0, np.int64), np.empty(0, np.int64)
    left, mid, right = (np.empty(0, np.int8) for _ in range(3))
    found_q, found_row = [], []
    depth, entered = (int(start_depth[0]) if len(queries) else 0), 0
    while entered < len(queries) or len(q):
        if not len(q):
            depth = int(start_depth[entered])
        more = np.searchsorted(start_depth, depth, "right")
        if more > entered:  # queries whose list divides from here on
            new = queries[entered:more]
            q, low = np.append(q, new), np.append(low, begins[owner[entered:more]])
            one, nil = np.ones(len(new), np.int8), np.zeros(len(new), np.int8)
            left, mid, right = np.append(left, one if depth else one * 9), np.append(mid, nil), np.append(right, one)
            entered = more
        # Ranges with a common prefix of this depth, and how the next letter divides them.
        here, below = common[:-1] < depth, common[:-1] < depth + 1
        starts, next_starts = np.flatnonzero(here), np.flatnonzero(below)
        stop = np.append(starts[1:], rows)[np.cumsum(here)[low] - 1]
        number = np.cumsum(below) - 1
        first, count = number[low], number[stop - 1] - number[low] + 1
        parent = np.repeat(np.arange(len(q)), count)
        low = next_starts[np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + first[parent]]
        q, left, mid, right = q[parent], left[parent], mid[parent], right[parent]
        letter = table[low, depth]
        over = letter == 0  # the word of this range ends here: read the cell of the query's end
        if over.any():
            offset = lengths[q[over]] - depth
            cell = np.select([offset == -1, offset == 0, offset == 1], [left[over], mid[over], right[over]], 9)
            hit = cell == 1
            found_q.append(q[over][hit])
            found_row.append(low[over][hit])
            q, low, left, mid, right, letter = (x[~over] for x in (q, low, left, mid, right, letter))
        width = table.shape[1]
        cells = [table[q, min(max(depth + k, 0), width - 1)] != letter for k in (-1, 0, 1)]
        a = np.minimum(left + cells[0], mid + 1).astype(np.int8)
        b = np.minimum(np.minimum(mid + cells[1], right + 1), a + 1).astype(np.int8)
        c = np.minimum(right + cells[2], b + 1).astype(np.int8)
        alive = np.minimum(np.minimum(a, b), c) <= 1
        q, low, left, mid, right = q[alive], low[alive], a[alive], b[alive], c[alive]
        depth += 1
    if not found_q:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_row)


def links_of(words: list[str], n: np.ndarray, m: np.ndarray, piece: np.ndarray, group: np.ndarray, pieces: int) -> pa.RecordBatch:
    """Links, both ways, of the lists: rows are sorted by list and word; ``m`` is the length of the shorter word of a pair."""
    size = np.bincount(group)
    keep = np.flatnonzero(size[group] > 1)
    words, n, m, piece = [words[i] for i in keep], n[keep], m[keep], piece[keep]
    group = np.unique(group[keep], return_inverse=True)[1]
    table, lengths = code_points(words)
    short = np.flatnonzero(lengths == m)
    sides = []
    for i in range(0, len(short), QUERIES_AT_ONCE):
        a, b = near_pairs(table, lengths, group, short[i : i + QUERIES_AT_ONCE])
        once = (lengths[b] > m[a]) | ((lengths[b] == m[a]) & (b > a))
        a, b = a[once], b[once]
        at = np.minimum(shared(table[a], table[b]), m[a] - 1)
        own = (m[a] * piece[a] // pieces <= at) & (at < m[a] * (piece[a] + 1) // pieces)
        sides.append((a[own], b[own]))
    a = np.concatenate([s[0] for s in sides]) if sides else np.empty(0, np.int64)
    b = np.concatenate([s[1] for s in sides]) if sides else np.empty(0, np.int64)
    texts = pa.array(words, pa.string())
    from_, to = np.append(a, b), np.append(b, a)
    return pa.RecordBatch.from_arrays([texts.take(pa.array(from_)), texts.take(pa.array(to)), pa.array(n[to], pa.int64())], names=["word", "near", "near_n"])


def _linker(pieces: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = pa.Table.from_batches(held)
            m, piece, key, n = (rows.column(c).to_numpy() for c in ("m", "piece", "key", "n"))
            new = np.append(True, (m[1:] != m[:-1]) | (piece[1:] != piece[:-1]) | (key[1:] != key[:-1]))
            done = len(m) if last else int(np.flatnonzero(new)[-1])  # the last list may go on in the next batch
            held = rows.slice(done).combine_chunks().to_batches() if done < len(m) else []
            if done:
                yield links_of(rows.column("word").slice(0, done).to_pylist(), n[:done], m[:done].astype(np.int64), piece[:done].astype(np.int64), np.cumsum(new[:done]) - 1, pieces)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count = sum(b.num_rows for b in held)
            longest = max(int(b.column("m")[-1].as_py()) for b in held) + 4
            if count > CHUNK_ROWS or count * longest > CHUNK_CELLS:
                yield from flush(False)
        if held:
            yield from flush(True)

    return link


def _entries(words: DataFrame, pieces: int) -> DataFrame:
    """The lists that each (m, piece, word) enters."""
    from_, to = F.floor(F.col("m") * F.col("piece") / pieces).cast("int"), F.floor(F.col("m") * (F.col("piece") + 1) / pieces).cast("int")
    after = F.when(F.col("m") > to, F.expr("1").cast("int") * (F.col("m") - to)).otherwise(0)
    suffix = F.when(after > 0, F.substring("word", F.char_length("word") - after + 1, after)).otherwise("")
    return words.select("m", "piece", F.xxhash64(F.substring("word", F.lit(1), from_), F.lit("\0"), suffix).alias("key"), "word", "n")


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of ``words`` (word, n; each word once) at one edit."""
    ship(words.sparkSession)
    pieces = 2
    roles = F.array(F.char_length("word"), F.char_length("word") - 1)
    left = words.select("word", "n", F.explode(roles).alias("m")).where("m > 0").withColumn("piece", F.explode(F.array(F.lit(0), F.lit(1))))
    found = []
    while True:
        entries = _entries(left, pieces)
        hot = staged(entries.groupBy("m", "piece", "key").count().where((F.col("count") > LIST_WORDS) & (F.col("m") > pieces)).drop("count"))
        again = not hot.isEmpty()
        lists = entries.join(hot, ["m", "piece", "key"], "left_anti") if again else entries
        dealt = lists.repartition("m", "piece", "key").sortWithinPartitions("m", "piece", "key", "word")
        found.append(dealt.select("m", "piece", "key", "word", "n").mapInArrow(_linker(pieces), "word string, near string, near_n long"))
        if not again:
            break
        halves = F.array(F.col("piece") * 2, F.col("piece") * 2 + 1)
        left = staged(entries.join(hot, ["m", "piece", "key"], "left_semi").select("word", "n", "m", F.explode(halves).alias("piece")))
        pieces *= 2
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


# -- forms ----------------------------------------------------------------------------------------------------

def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends. A form is much more frequent than its
    word, so there are no cycles and chains are short; each round doubles the steps taken."""
    current = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        following = staged(current.alias("a").join(current.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
                           .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(current)
        if following.where("moved").isEmpty():
            return following.select("word", "root")
        current = staged(following.select("word", "root"))
        discard(following)


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS, count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n; see ``vocabulary`` for nulls and repeated rows.

    ``form`` is the near word of largest n, ties to the smaller in code-point order, if it has at least ``factor``
    times the word's n. Texts of any length, an empty table and other columns do no harm.
    """
    words = staged(vocabulary(docs, key, text, letters, count))
    best = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(-F.col("best.minus") >= factor * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("form"),
    ))
    ends = roots(known.where("form IS NOT NULL").select("word", F.col("form.form").alias("form")))
    return known.join(ends, "word", "left").select("word", "form.form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form.form_n")
