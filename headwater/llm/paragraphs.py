"""Operator 7: substring deduplication by MinHash banding of paragraphs.

Repeats are found in two ways. A line of 25 words or more, or a blank-line paragraph of so many words in
shorter lines, is signed: its MinHash signature is cut into bands tuned for high recall, colliding ones are joined, and the
exact Jaccard similarity of their word 5-grams decides. Components of these choose one document, that of
the smallest number, which keeps the passage; the others lose it.

Passages copied into the middle of another text have no line of their own. Seeds of 12 words at anchors
that the words themselves choose (the least 5-gram hash of any 11 in a row) lie in every run of 22 equal
words. Seeds that another document has too are joined with the words around them in the earliest such
document, and the stretch grows word by word to its ends, over changed, added and missing words as long
as its 5-grams stay similar enough. A stretch of 25 words or more is a repeat. The run of 22 is what one
word added to the shortest similar stretch (44 words) leaves of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm.banding import near_components
from headwater.llm.common import column, discard, free_name, groups_by_size, release, ship, staged, texts_of
from headwater.llm.components import components
from headwater.llm.near_dedup import circulant_minhash_of
from headwater.llm.shingles import band_keys_of, bands_for, distinct, fold, hashes_of, shingles_of, word_hashes

SHINGLE = 5
ANCHOR_SPAN = 11
SEED_WORDS = 12
LEAST_WORDS = 25
GAP = 8
ROWS = 3
CHARACTERS = 1 << 20  # of texts signed together
RECALL = 0.999


def _anchors(shingles: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a place holds the least (of equal ones the first) of any 11 shingles in a row of its text."""
    n = len(shingles)
    place = np.arange(n) - (np.cumsum(sizes) - sizes)[owner]
    room = sizes[owner] - 1 - place
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
    larger, no_less = np.ones(n, bool), np.ones(n, bool)
    for k in range(1, min(n, ANCHOR_SPAN)):
        larger[:k] = no_less[-k:] = False
        larger[k:] &= shingles[:-k] > shingles[k:]
        no_less[:-k] &= shingles[k:] >= shingles[:-k]
        before += larger
        after += no_less
    chosen = np.minimum(before, place) + np.minimum(after, room) >= ANCHOR_SPAN - 1
    reach = SEED_WORDS - SHINGLE
    ends = np.cumsum(sizes)
    for i in np.flatnonzero((sizes > reach) & (sizes < ANCHOR_SPAN)).tolist():
        begin = ends[i] - sizes[i]
        chosen[begin + shingles[begin : ends[i] - reach].argmin()] = True
    return chosen & (room >= reach)


def anchored_paragraphs(shingles: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and 64-bit digests of the seeds of 12 words that begin at anchors, in one text or many of ``sizes`` in a row.

    Of seeds that repeat at once, as in a text of one word, those go without which the others still touch.
    """
    sizes = np.array([len(shingles)]) if sizes is None else sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(_anchors(shingles, sizes, owner))
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    reach = SEED_WORDS - SHINGLE
    digests = fold(shingles[at[:, None] + np.array([*range(0, reach, SHINGLE), reach])], 101)
    order = np.argsort(digests, kind="stable")
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = (digests[order[1:]] == digests[order[:-1]]) & (owner[at[order[1:]]] == owner[at[order[:-1]]])
    again = np.zeros(len(at), bool)
    last_at = 0
    for x in np.flatnonzero(same[:-1] | same[1:]).tolist():
        i = order[x]
        if same[x] and same[x + 1] and at[order[x + 1]] <= last_at + SEED_WORDS:
            again[i] = True
        else:
            last_at = at[i]
    return at[~again], digests[~again]


def signed_parts(lines: list[int]) -> list[tuple[int, int]]:
    """(start, words) of the lines of 25 words or more, and of blank-line paragraphs of so many in shorter lines only."""
    parts, at, begin, longest = [], 0, 0, 0
    for words in [*lines, 0]:
        if words >= LEAST_WORDS:
            parts.append((at, words))
        longest = max(longest, words)
        if not words:
            if longest < LEAST_WORDS <= at - begin:
                parts.append((begin, at - begin))
            begin, longest = at, 0
        at += words
    return parts


def document_number(key: Column, kind: T.DataType, text_hash: Column) -> Column:
    """The number that orders documents: the key itself, or a hash if it is null or no whole number."""
    whole = isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    return F.coalesce(key.cast("long") if whole else F.when(key.isNotNull(), F.xxhash64(key)), text_hash)


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    text_hash = F.xxhash64(column(text))
    number = document_number(column(key), docs.schema[key].dataType, text_hash)
    return docs.select(number.alias("doc"), text_hash.alias("text_hash"), column(text).cast("string").alias("text"))


def paragraph_table(rows: DataFrame) -> DataFrame:
    """(node, seed, doc, text_hash, start, words, n, bands): signed parts, which have a node, and seeds with a number instead."""
    ship(rows.sparkSession)
    bands = bands_for(0.8, RECALL, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, "text")
            for start, end in groups_by_size(texts, CHARACTERS):
                yield from cut(batch.slice(start, end - start), texts[start:end])

    def table(batch: pa.RecordBatch, owner: list | np.ndarray, **values: pa.Array) -> pa.RecordBatch:
        take = pa.array(owner, pa.int64())
        found = {"doc": batch.column(0).take(take), "text_hash": batch.column(1).take(take)} | values
        return pa.RecordBatch.from_arrays([found.get(f.name, pa.nulls(len(take), f.type)) for f in kinds], schema=kinds)

    def cut(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
        hashes, lines = [], []
        for text in texts:
            of_lines = [line.split() for line in text.encode().lower().split(b"\n")]
            lines.append([len(x) for x in of_lines])
            hashes.append(hashes_of(list(chain.from_iterable(of_lines))))
        counts = np.array([len(x) for x in hashes], np.int64)
        shingles, sizes = shingles_of(np.concatenate(hashes), counts, SHINGLE)
        first = np.cumsum(sizes) - sizes
        places, digests = anchored_paragraphs(shingles, sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)[places]
        yield table(batch, owner, seed=pa.array(digests.view(np.int64)), start=pa.array((places - first[owner]).astype(np.int32)))
        parts = [(i, at, words) for i, of_lines in enumerate(lines) for at, words in signed_parts(of_lines)]
        if parts:
            sets = [distinct(shingles[first[i] + at : first[i] + at + words - SHINGLE + 1]) for i, at, words in parts]
            keys = band_keys_of(circulant_minhash_of(sets, bands * ROWS), bands, ROWS)
            offsets = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield table(
                batch, [i for i, _, _ in parts], node=pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                start=pa.array([at for _, at, _ in parts], pa.int32()), words=pa.array([words for _, _, words in parts], pa.int32()),
                n=pa.array([len(x) for x in sets], pa.int32()), bands=pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))),
            )

    kinds = pa.schema([
        ("node", pa.binary()), ("seed", pa.int64()), ("doc", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()),
        ("words", pa.int32()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())),
    ])
    return rows.mapInArrow(run, "node binary, seed long, doc long, text_hash long, start int, words int, n int, bands array<long>")


def paragraph_texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of wanted paragraphs (node, doc, text_hash, start, words); a document is read once for all of its own."""
    per_doc = wanted.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(
        F.collect_list(F.struct("node", "start", "words")).alias("parts")
    )
    joined = rows.join(per_doc, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h"))).select("text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                nodes, texts = [], []
                for text, parts in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = text.encode().split()
                    for p in parts:
                        nodes.append(p["node"])
                        texts.append(b" ".join(words[p["start"] : p["start"] + p["words"]]).decode())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(texts, pa.string())], ["node", "text"])

    return joined.mapInArrow(cut, "node binary, text string").groupBy("node").agg(F.min("text").alias("text"))


def chains_of(owner: np.ndarray, keep_doc: np.ndarray, keep_hash: np.ndarray, keep_start: np.ndarray, start: np.ndarray) -> list[tuple]:
    """Chains (owner, keep_doc, keep_hash, start, diagonal, end) of seeds that touch on one diagonal, in this order."""
    diagonal = start - keep_start
    order = np.lexsort((start, diagonal, keep_hash, keep_doc, owner))
    columns = [x[order] for x in (owner, keep_doc, keep_hash, diagonal, start)]
    begins = np.ones(len(order), bool)
    begins[1:] = columns[4][1:] > columns[4][:-1] + SEED_WORDS
    for x in columns[:4]:
        begins[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(order)) - 1
    owner, keep_doc, keep_hash, diagonal, start = (x[first] for x in columns)
    order = np.lexsort((start, keep_hash, keep_doc, owner)) if len(first) else first
    end = columns[4][last] + SEED_WORDS if len(first) else first
    return list(zip(*(x[order].tolist() for x in (owner, keep_doc, keep_hash, start, diagonal, end))))


def clusters(chains: list[tuple]) -> list[list]:
    """Chains of many documents, sorted, as [owner and keeper, own range, keeper's range, chains (start, keep_start, words)].

    Short runs beyond a chain can keep a stretch similar over 1.25 times its words at most, so a range of twice the
    chain and 64 words on both sides is all a chain can need; chains whose ranges meet on both sides go together.
    """
    out: list[list] = []
    for *keep, start, diagonal, end in chains:
        more = 2 * (end - start) + 64
        own = [max(0, start - more), end + more]
        theirs = [max(0, start - diagonal - more), end - diagonal + more]
        found = (start, start - diagonal, end - start)
        last = out[-1] if out else None
        if last and last[0] == keep and own[0] <= last[1][1] and theirs[0] <= last[2][1] and last[2][0] <= theirs[1]:
            for i, reach in ((1, own), (2, theirs)):
                last[i] = [min(last[i][0], reach[0]), max(last[i][1], reach[1])]
            last[3].append(found)
        else:
            out.append([keep, own, theirs, [found]])
    return out


def run_length(a: np.ndarray, b: np.ndarray) -> int:
    """How many words ``a`` and ``b`` have in common from their starts."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differs):
            return at + int(differs[0])
        at, step = at + step, step * 4
    return n


def next_run(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(gap in a, gap in b, words in common) of the next run of 5 words or more after gaps of up to 8 words.

    Of several runs the next is that of the shortest gap, then of the most even one, then of the lesser in ``a``.
    """
    p, q = a[: GAP + SHINGLE], b[: GAP + SHINGLE]
    if min(len(p), len(q)) < SHINGLE:
        return None
    same = p[:, None] == q
    if np.count_nonzero(same) < SHINGLE:
        return None
    height, width = len(p) - SHINGLE + 1, len(q) - SHINGLE + 1
    met = same[:height, :width].copy()
    for k in range(1, SHINGLE):
        met &= same[k : k + height, k : k + width]
    met[0, 0] = False
    gaps = [(max(x, y), abs(x - y), x, y) for x, y in zip(*(g.tolist() for g in met.nonzero()))]
    if not gaps:
        return None
    _, _, x, y = min(gaps)
    return x, y, run_length(a[x:], b[y:])


def grown(own: np.ndarray, theirs: np.ndarray, chains: list[tuple[int, int, int]], percent: int) -> list[tuple[int, int]]:
    """The stretches of ``own``, of 25 words or more, to which chains grow; positions count from its start."""
    out: list[tuple[int, int, int]] = []
    known: dict[tuple[int, int, int], tuple[int, int, int] | None] = {}

    def runs_beyond(step: int, at: int, keep_at: int, limit: int) -> Iterator[tuple[int, int, int]]:
        """(words, keep_words, words in common) of each run to the right (step 1) or left (-1); chains of one stretch share them."""
        i = j = 0
        while max(i, j) <= limit:
            place = step, at + step * i, keep_at + step * j
            if place not in known:
                p, q = (own[place[1] :], theirs[place[2] :]) if step == 1 else (own[: place[1]][::-1], theirs[: place[2]][::-1])
                known[place] = next_run(p, q)
            if known[place] is None:
                return
            x, y, n = known[place]
            i, j = i + x + n, j + y + n
            yield i, j, n

    for a, b, n in chains:
        if any(s <= a and a + n <= e and s - t == a - b for s, e, t in out):
            continue
        if run_length(own[a : a + n], theirs[b : b + n]) < n:
            continue
        back = run_length(own[:a][::-1], theirs[:b][::-1])
        a, b, n = a - back, b - back, n + back
        n += run_length(own[a + n :], theirs[b + n :])
        common, start, keep_start, end, keep_end = n - SHINGLE + 1, a, b, a + n, b + n
        limit = 2 * n + 64

        def alike(shared: int, words: int, keep_words: int) -> bool:
            return 100 * shared >= percent * (words + keep_words - 2 * (SHINGLE - 1) - shared)

        # Either side may need what the other one adds, so the right end is tried again after the left.
        for step in (1, -1, 1):
            best, shared = (0, 0, 0), 0
            for i, j, n in runs_beyond(step, *((end, keep_end) if step == 1 else (start, keep_start)), limit):
                shared += n - SHINGLE + 1
                if alike(common + shared, end - start + i, keep_end - keep_start + j):
                    best = i, j, shared
            i, j, shared = best
            common += shared
            if step == 1:
                end, keep_end = end + i, keep_end + j
            else:
                start, keep_start = start - i, keep_start - j
        out.append((start, end, keep_start))
    return sorted({(s, e) for s, e, _ in out if e - s >= LEAST_WORDS})


def excerpts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text_hash, low, high, words) of wanted ranges (doc, text_hash, low, high): 32-bit word hashes."""
    per_doc = wanted.groupBy(F.col("doc").alias("d"), F.col("text_hash").alias("h")).agg(F.collect_set(F.struct("low", "high")).alias("parts"))
    joined = rows.join(per_doc, (F.col("doc") == F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc", "text_hash", "text", "parts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, low, high, words = [], [], [], []
                for i, (text, parts) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    hashes = word_hashes(text).astype(np.uint32)
                    for p in parts:
                        owner.append(i)
                        low.append(p["low"])
                        high.append(p["high"])
                        words.append(hashes[p["low"] : p["high"]].tobytes())
                docs = [part.column(i).take(pa.array(owner, pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*docs, pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(words, pa.binary())], names
                )

    names = ["doc", "text_hash", "low", "high", "words"]
    cut_out = joined.mapInArrow(cut, "doc long, text_hash long, low int, high int, words binary")
    return cut_out.groupBy("doc", "text_hash", "low", "high").agg(F.min("words").alias("words"))


def passage_spans(rows: DataFrame, table: DataFrame, percent: int) -> DataFrame:
    """(doc, text_hash, start, end, keep_doc): stretches grown from seeds that an earlier document has too.

    ``table``, staged, has the seeds; it is deleted once they are placed.
    """
    seeds = table.where("seed IS NOT NULL").withColumn("node", F.col("seed"))
    first = F.min(F.struct(F.col("doc").alias("keep_doc"), F.col("text_hash").alias("keep_hash"), F.col("start").alias("keep_start"))).alias("first")
    shared = staged(seeds.groupBy("node").agg(first, F.max("doc").alias("high")).where("first.keep_doc < high").select("node", "first.*"))
    release(rows.sparkSession)
    hits = seeds.select("node", "doc", "text_hash", "start").join(shared, "node").where("doc <> keep_doc")
    hit = F.struct("keep_doc", "keep_hash", "keep_start", "start")
    per_doc = hits.groupBy("doc", "text_hash").agg(F.collect_set(hit).alias("hits"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), hits.value_lengths().to_numpy(zero_copy_only=False))
            found = [x.to_numpy(zero_copy_only=False) for x in hits.flatten().flatten()]
            numbers = [batch.column(i).to_pylist() for i in range(2)]
            out = []
            for (i, *keep), own, theirs, chains in clusters(chains_of(owner, *found)):
                out.append((numbers[0][i], numbers[1][i], *own, *keep, *theirs, [x for found in chains for x in found]))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()] * 2 + [pa.list_(pa.int32())]
            columns = zip(*out) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    names = ["doc", "text_hash", "low", "high", "keep_doc", "keep_hash", "keep_low", "keep_high", "chains"]
    placed = staged(per_doc.mapInArrow(place, "doc long, text_hash long, low int, high int, keep_doc long, keep_hash long, keep_low int, keep_high int, chains array<int>"))
    discard(shared, table)
    release(rows.sparkSession)
    own_keys, keep_keys = names[:4], names[4:8]
    wanted = placed.select(*own_keys).union(placed.select(*keep_keys)).distinct()
    cuts = staged(excerpts(rows, wanted))
    release(rows.sparkSession)
    theirs = cuts.toDF(*keep_keys, "keep_words")
    both = placed.join(cuts, own_keys).join(theirs, keep_keys).select("doc", "text_hash", "low", "keep_doc", "keep_low", "chains", "words", "keep_words")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, starts, ends = [], [], []
            columns = [batch.column(i).to_pylist() for i in (2, 4, 5, 6, 7)]
            for i, (low, keep_low, flat, words, keep_words) in enumerate(zip(*columns)):
                chains = [(a - low, b - keep_low, n) for a, b, n in zip(flat[::3], flat[1::3], flat[2::3])]
                for start, end in grown(np.frombuffer(words, np.uint32), np.frombuffer(keep_words, np.uint32), chains, percent):
                    owner.append(i)
                    starts.append(start + low)
                    ends.append(end + low)
            take = pa.array(owner, pa.int64())
            doc, text_hash, keep = (batch.column(i).take(take) for i in (0, 1, 3))
            yield pa.RecordBatch.from_arrays(
                [doc, text_hash, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), keep], ["doc", "text_hash", "start", "end", "keep_doc"]
            )

    spans = staged(both.mapInArrow(grow, "doc long, text_hash long, start int, end int, keep_doc long"))
    discard(placed, cuts)
    release(rows.sparkSession)
    return spans


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Numbered rows of ``docs`` and the spans to take out of them: (doc, text_hash, start, end, keep_doc), in words."""
    rows = numbered(docs, key, text)
    table = staged(paragraph_table(rows))
    lines = table.where("bands IS NOT NULL")
    first = F.min(F.struct("doc", "text_hash", "start", "words")).alias("first")
    classes = staged(lines.groupBy("node").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), first, F.min("doc").alias("low"), F.max("doc").alias("high")
    ))
    release(rows.sparkSession)

    def texts_for(needed: DataFrame) -> DataFrame:
        return paragraph_texts(rows, classes.join(needed, "node").select("node", "first.*"))

    roots = near_components(classes.select("node", "n", "bands"), texts_for, SHINGLE, percent)
    placed = classes.select("node", "low", "high").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "low", "high")
    groups = placed.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    of_lines = placed.select("node", "root").join(groups, "root").select("node", F.col("low").alias("keep_doc"))
    repeated = staged(of_lines)
    discard(classes)
    spans = lines.select("node", "doc", "text_hash", "start", (F.col("start") + F.col("words")).alias("end")).join(repeated, "node")
    of_lines = staged(spans.where("doc <> keep_doc").select("doc", "text_hash", "start", "end", "keep_doc"))
    release(rows.sparkSession)
    return rows, of_lines.union(passage_spans(rows, table, percent))


def removals(spans: DataFrame) -> DataFrame:
    """One row per document that loses words: (doc, text_hash, spans, kept_in, removed_words), spans merged."""
    collected = spans.groupBy("doc", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("keep_doc")).alias("kept_in")
    )
    merged = F.expr("""
        aggregate(spans, CAST(array() AS array<struct<start:int,end:int>>), (done, s) ->
            IF(size(done) > 0 AND element_at(done, -1).end >= s.start,
               concat(slice(done, 1, size(done) - 1),
                      array(named_struct('start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end)))),
               concat(done, array(s))))
    """)
    return collected.withColumn("spans", merged).withColumn(
        "removed_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    )


def substring_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, component_id, n_spans, removed_words, kept_in, kept.

    A document that loses nothing is kept and lists nothing; kept_in lists the documents (by number) in
    which the passages taken from a row stay. component_id is the smallest number of the documents that
    repeated passages link. Rows with one key count as one document; null keys are numbered by their text.
    Null and short texts have no paragraphs. Repeats within a document are left to it.
    """
    rows, spans = repeated_spans(docs, key, text, percent)
    removed = staged(removals(spans))
    links = removed.select(F.col("doc").alias("a"), F.explode("kept_in").alias("b"))
    roots = staged(components(links)).select(F.col("node").alias("member"), "root")
    text_hash = F.xxhash64(column(text))
    number = document_number(column(key), docs.schema[key].dataType, text_hash)
    listed = docs.select(column(key).alias("doc_id"), number.alias("doc"), text_hash.alias("text_hash"))
    out = listed.join(removed, ["doc", "text_hash"], "left").join(roots, F.col("doc") == F.col("member"), "left").select(
        "doc_id", F.coalesce("root", "doc").alias("component_id"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"),
        F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
        F.coalesce("kept_in", F.array().cast("array<long>")).alias("kept_in"), F.col("spans").isNull().alias("kept"),
    )
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans (sorted, apart), and without the blanks that follow them."""
    data = text.encode()
    places = [m.span() for m in _WORD.finditer(data)]
    parts, at = [], 0
    for s in spans:
        begin = places[s["start"]][0]
        end = places[s["end"]][0] if s["end"] < len(places) else len(data)
        if b"\n" in data[places[s["end"] - 1][1] : end]:
            end = places[s["end"] - 1][1]
        parts.append(data[at:begin])
        at = end
    return (b"".join(parts) + data[at:]).decode()


def drop_repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages taken out of the texts, columns unchanged; ``length`` follows the new text.

    A document left without any word by this goes; one that came without words stays as it is. Null texts and keys
    stay; repeated rows are cut alike. Other columns may have any name.
    """
    _, spans = repeated_spans(docs, key, text)
    removed = staged(removals(spans).select("doc", "text_hash", "spans"))
    names = {c: free_name(c, docs.columns) for c in ("doc", "text_hash", "spans")}
    removed = removed.withColumnsRenamed(names)
    text_hash = F.xxhash64(column(text))
    number = document_number(column(key), docs.schema[key].dataType, text_hash)
    match = (number == column(names["doc"])) & (text_hash == column(names["text_hash"]))
    joined = docs.join(removed, match, "left").select(*[column(c) for c in docs.columns], column(names["spans"]))
    columns, place = docs.columns, docs.columns.index(text)
    size_at = columns.index(length) if length in columns else None
    size_kind = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}.get(docs.schema[length].dataType) if size_at is not None else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_of = batch.column(len(columns)).to_pylist()
            arrays = list(batch.columns[:-1])
            changed = [i for i, s in enumerate(spans_of) if s]
            left = np.ones(batch.num_rows, bool)
            if changed:
                texts = batch.column(place).to_pylist()
                sizes = batch.column(size_at).to_pylist() if size_kind is not None else None
                for i in changed:
                    texts[i] = without_spans(texts[i], spans_of[i])
                    left[i] = _WORD.search(texts[i].encode()) is not None
                    if sizes is not None:
                        sizes[i] = len(texts[i])
                arrays[place] = pa.array(texts, batch.schema.field(place).type)
                if sizes is not None:
                    arrays[size_at] = pa.array(sizes, size_kind)
            yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(left))

    return joined.mapInArrow(cut, docs.schema)
