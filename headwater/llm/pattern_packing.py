"""Operator 8: best-fit packing with patterns fitted by non-negative least squares.

Texts become pieces of at most one sequence's capacity; only their lengths matter for packing, and the
histogram of lengths has one row per token count at most, whatever the corpus. On it, patterns of up
to three lengths that fill a sequence are enumerated and their repeat counts fitted by non-negative
least squares. The rounded counts are applied, and the residual histogram is packed best-fit
decreasing, whole ranges of equal sequences at once. The plan maps the rank of a piece among those of
its length to a sequence and an offset. Ranks are counted in Spark, hot lengths dealt into shares.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from headwater.llm.common import column, groups_by_size, ship, staged, texts_of
from headwater.llm.word_ids import encoder

CHARACTERS_AT_ONCE = 2_000_000
ROWS_PER_SHARE = 50_000
PATTERN_LENGTHS = 384
STEPS = 300

SLOT_FIELDS = ("length", "rank", "count", "repeat", "sequence", "offset")


# -- tokens --------------------------------------------------------------------------------------------

def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) of the ids of each text and ``end_id``.

    Null counts as empty: one piece of one token. Only texts longer than ``capacity`` are cut.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(key).alias("doc_id"), column(text).cast("string").alias("text"))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            texts, at, found = texts_of(batch, "text"), [], []
            for a, b in groups_by_size(texts, CHARACTERS_AT_ONCE):
                for i, ids in zip(range(a, b), encode(texts[a:b])):
                    ids += last
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        at.append(i)
                        found.append((piece, start // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*found)) if found else [[]] * 5
            arrays = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32())]
            arrays += [pa.array(columns[i], pa.int64()) for i in (1, 2, 3)] + ([pa.array(columns[4], pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("piece", T.IntegerType()),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
        *([T.StructField("ids", T.BinaryType())] if with_ids else []),
    ])
    return rows.mapInArrow(run, schema)


# -- the plan, on the histogram of lengths -----------------------------------------------------------------

def patterns(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns (rows of three lengths, 0 for none) that fill a sequence exactly.

    All pairs of lengths are tried, and all triples with two of the ``PATTERN_LENGTHS`` lengths of the
    most tokens; what no pattern covers is left to the residual packing.
    """
    present = np.zeros(capacity + 1, bool)
    present[lengths] = True
    pairs = lengths[(2 * lengths >= capacity) & (lengths < capacity) & present[capacity - lengths]]
    found = [np.stack([pairs, capacity - pairs, np.zeros_like(pairs)], axis=1)]
    heavy = np.sort(lengths[np.argsort(-counts * lengths, kind="stable")[:PATTERN_LENGTHS]])
    a, b = np.meshgrid(heavy, heavy, indexing="ij")
    a, b = a[a >= b], b[a >= b]
    c = capacity - a - b
    fits = (c > 0) & (c <= b)
    fits[fits] = present[c[fits]]
    found.append(np.stack([a[fits], b[fits], c[fits]], axis=1))
    return np.concatenate(found)


def fit_counts(rows: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise |A x - histogram|, by accelerated projected gradient."""
    x = np.zeros(len(rows))
    if not len(rows):
        return x
    size = len(histogram)

    def fill(y: np.ndarray) -> np.ndarray:
        total = np.bincount(rows.ravel(), weights=np.repeat(y, 3), minlength=size)
        total[0] = 0
        return total

    uses = np.bincount(rows.ravel(), minlength=size).astype(float)
    uses[0] = 0
    step = 1 / (3 * max(float(uses.max()), 1.0))
    target, ahead, momentum = histogram.astype(float), x, 1.0
    target[0] = 0
    for _ in range(STEPS):
        slope = (fill(ahead) - target)[rows].sum(axis=1)
        new = np.maximum(ahead - step * slope, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, x, momentum = new + (momentum - 1) / following * (new - x), new, following
    return x


class Plan:
    """Slots that say where the pieces of each length go: ranges of ranks to ranges of sequences."""

    def __init__(self, histogram: np.ndarray, capacity: int):
        self.left, self.capacity = histogram.astype(np.int64).copy(), capacity
        self.rank = np.zeros(capacity + 1, np.int64)
        self.sequences, self.slots = 0, []
        self.by_gap: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []

    def _place(self, length: int, count: int, repeat: int, sequence: int, offset: int) -> None:
        self.slots.append((length, int(self.rank[length]), count * repeat, repeat, sequence, offset))
        self.rank[length] += count * repeat
        self.left[length] -= count * repeat

    def apply(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Rounded patterns, the most frequent first, as far as pieces are left."""
        for i in np.argsort(-counts, kind="stable"):
            wanted = int(round(counts[i]))
            if wanted == 0:
                break
            lengths, repeats = np.unique(rows[i][rows[i] > 0], return_counts=True)
            count = min(wanted, int((self.left[lengths] // repeats).min()))
            if count:
                offset = 0
                for length, repeat in zip(lengths.tolist(), repeats.tolist()):
                    self._place(length, count, repeat, self.sequences, offset)
                    offset += length * repeat
                self.sequences += count

    def _open(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                bisect.insort(self.gaps, gap)
            self.by_gap[gap].append((first, count))

    def pack_rest(self) -> None:
        """Best-fit decreasing of all pieces left; sequences with the same gap are filled as one range."""
        for length in range(self.capacity, 0, -1):
            while self.left[length] > 0:
                need = int(self.left[length])
                at = bisect.bisect_left(self.gaps, length)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    first, count = self.by_gap[gap].pop()
                    if not self.by_gap[gap]:
                        del self.by_gap[gap], self.gaps[at]
                else:
                    gap, first = self.capacity, self.sequences
                    count = -(-need // (gap // length))
                    self.sequences += count
                repeat = min(gap // length, need)
                used = min(count, need // repeat)
                self._place(length, used, repeat, first, self.capacity - gap)
                self._open(gap - repeat * length, first, used)
                self._open(gap, first + used, count - used)


def make_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """The plan with the fewest sequences over a few ways to round the fitted counts."""
    table = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        table[length] = count
    lengths = np.flatnonzero(table)
    rows = patterns(lengths, table[lengths], capacity)
    fitted = fit_counts(rows, table)
    best = None
    for share in (1.0, 0.75, 0.5, 0.25):
        plan = Plan(table, capacity)
        plan.apply(rows, np.floor(fitted * share))
        plan.pack_rest()
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best


# -- Spark -------------------------------------------------------------------------------------------------

def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) with sequence_id and offset added.

    Every piece is placed; a sequence holds ``capacity`` tokens at most and is gapless from 0. The
    histogram and the plan have a size bounded by ``capacity``; pieces never leave the executors.
    No pieces give no rows. Sequence numbers start at 0 without gaps.
    """
    spark = pieces.sparkSession
    rows = staged(pieces.select("*", F.monotonically_increasing_id().alias("__row")))
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, capacity)
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, len(SLOT_FIELDS))
    # At most `capacity` rows, so the hint is safe.
    shares = spark.createDataFrame([(k, -(-n // ROWS_PER_SHARE)) for k, n in histogram.items()], "length long, shares long")
    dealt = rows.join(F.broadcast(shares), "length").withColumn("__share", F.pmod(F.xxhash64("__row"), F.col("shares")))
    sizes = dealt.groupBy("length", "__share").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__share")) - F.col("n")
    firsts = staged(sizes.select(F.col("length").alias("l"), F.col("__share").alias("s"), before.alias("__first")))
    order = F.row_number().over(Window.partitionBy("length", "__share").orderBy("__row"))
    ranked = dealt.withColumn("__order", order).join(firsts, (F.col("length") == F.col("l")) & (F.col("__share") == F.col("s")))
    names = pieces.columns
    ranked = ranked.select(*[column(c) for c in names], (F.col("__first") + F.col("__order") - 1).alias("__rank"))
    place = names.index("length")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = slots[:, 0] << 44 | slots[:, 1]
        for batch in batches:
            length, rank = batch.column(place).to_numpy(), batch.column(len(names)).to_numpy()
            slot = slots[np.searchsorted(codes, length << 44 | rank, side="right") - 1]
            within = rank - slot[:, 1]
            sequence = slot[:, 4] + within // slot[:, 3]
            offset = slot[:, 5] + within % slot[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    extra = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(assign, T.StructType([*pieces.schema.fields, *extra]))


def packed_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32[, ids], sequence_id, offset. See the parts."""
    packed = pack(token_pieces(docs, tokenizer, capacity, end_id, key, text, with_ids), capacity)
    return packed if key == "doc_id" else packed.withColumnRenamed("doc_id", key)
