"""Operator 12: benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame functions only.

A window is ten consecutive words of a benchmark item, or all words of a shorter one. The hashes of all windows
set places of a table of bounded size, which every task gets as a scalar subquery. One scan of the documents looks
up each of its windows there, inside the array of words, so that no row is made for a window that is not in the
set. What passes is verified: the words of the window themselves are joined with those of the benchmark.

Words are cut by ``split`` and windows read by ``get``: ``regexp_extract_all`` and ``slice`` copy the whole text or
array each time, which costs the square of a text's length.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm.common import column, free_name, staged

SIZE = 10  # words of a window
# Words are runs of what is not ASCII, and of ASCII digits and letters: by code point, A-Z in lower case first.
OTHER, ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
PLACES_PER_WINDOW = 64
LEAST_PLACES, MOST_PLACES = 2**12, 2**24  # 16 MB at most; of more windows than fit, more pass by chance and are sorted out by the join
BROADCAST_BYTES = 32 * 2**20  # windows of more are joined by a shuffle


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once. Written out in a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text in order; null has none. Only A-Z are lower-cased."""
    plain = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(plain) == F.char_length(plain), F.lower(plain)).otherwise(
        F.translate(plain, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.filter(F.split(lowered, f"{OTHER}+"), lambda word: word != "")


def _window(list_: Column, start: Column, n: int) -> list[Column]:
    return [F.get(list_, start + k) for k in range(n)]


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows (words, n, item) of each item; the item's id as text, null as the empty text. An item without words has none."""
    split = benchmark.select(F.coalesce(column(item).cast("string"), F.lit("")).alias("item"), words(column(text)).alias("list")).where("size(list) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("list") - SIZE, F.lit(0)))
    texts = let(F.col("list"), lambda w: F.transform(starts, lambda i: F.concat_ws(" ", *_window(w, i, SIZE))))
    return split.select(F.least(F.size("list"), F.lit(SIZE)).alias("n"), "item", F.explode(texts).alias("words")).distinct()


def places(hashes: DataFrame, size: int) -> DataFrame:
    """One row with an array of ``size`` booleans, a power of two: true at the last bits of each hash (h)."""
    slot = F.col("h").bitwiseAND(size - 1)
    ones = hashes.select(F.shiftright(slot, 6).alias("id"), F.expr("shiftleft(1L, cast(h & 63 AS int))").alias("one"))
    cells = hashes.sparkSession.range(max(1, size // 64)).join(ones.groupBy("id").agg(F.bit_or("one").alias("cell")), "id", "left")
    found = cells.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("cell", F.lit(0).cast("long")).alias("cell")))).alias("cells"))
    return found.select(F.flatten(F.transform("cells.cell", lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(c, i) == 1))).alias("places"))


SUSPECTS = "array<struct<pos:int,n:int,words:string>>"


def _suspects(list_: Column, hashes: Column, held: Column, mask: int, n: int) -> Column:
    """(pos, n, words) of the windows of ``n`` words whose place is taken."""
    def taken(i: Column) -> Column:
        return F.get(held, F.xxhash64(*_window(hashes, i, n)).bitwiseAND(mask).cast("int"))

    seen = F.filter(F.sequence(F.lit(0), F.size(list_) - n), taken)
    found = F.transform(seen, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("n"), F.concat_ws(" ", *_window(list_, i, n)).alias("words")))
    return F.when(F.size(list_) >= n, found).otherwise(F.array().cast(SUSPECTS))


def occurrences(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """One row per row of ``docs``: row, key, n_words, hits (pos, n, window); and the items (window, item) of each window.

    Null and empty texts have no words and no hits; rows that are repeated, or have a null key, are rows of their
    own. Other columns do not matter, whatever they are called. Either table may be empty.
    """
    spark = docs.sparkSession
    found = staged(item_windows(benchmark, item, item_text))
    distinct = staged(found.select("words", "n").distinct())
    known = distinct.select(F.monotonically_increasing_id().alias("window"), "words", "n")  # of what is written: the same in every job
    known = staged(known)
    lengths = sorted(row.n for row in known.select("n").distinct().collect())  # ten at most
    count, size = known.agg(F.count("*"), F.sum(F.octet_length("words") + 64)).first()
    slots = min(MOST_PLACES, max(LEAST_PLACES, 1 << (count * PLACES_PER_WINDOW - 1).bit_length())) if count else LEAST_PLACES
    hashed = known.select(F.split("words", " ").alias("list")).select(F.xxhash64(*[F.when(F.size("list") > k, F.xxhash64(F.get("list", F.lit(k)))) for k in range(SIZE)]).alias("h"))
    table = staged(places(hashed, slots))
    small = (size or 0) <= BROADCAST_BYTES
    held = F.broadcast if small else (lambda df: df)

    # The row number stands alone, and the table is named once and next to the words, so that the optimizer puts both
    # into the one projection that scans; a table in a projection of its own would be copied for each row.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), column(key).alias("key"), column(text).alias("text"))
    both = F.struct(words(F.col("text")).alias("list"), table.scalar().alias("held"))
    scanned = numbered.select("row", "key", both.alias("both")).select("row", "key", let(F.col("both"), lambda x: let(
        F.transform(x["list"], lambda word: F.xxhash64(word)), lambda hashes: F.struct(
            F.size(x["list"]).cast("long").alias("n_words"),
            F.concat(F.array().cast(SUSPECTS), *[_suspects(x["list"], hashes, x["held"], slots - 1, n) for n in lengths]).alias("seen")))).alias("scanned"))
    rows = scanned.select("row", "key", "scanned.n_words", F.explode_outer("scanned.seen").alias("seen"))
    rows = rows.select("row", "key", "n_words", "seen.pos", F.col("seen.words").alias("words"))
    joined = rows.join(held(known.select("words", "window", "n")), "words", "left")
    hit = F.when(F.col("window").isNotNull(), F.struct("pos", "n", "window"))
    report = joined.groupBy("row", "key", "n_words").agg(F.collect_list(hit).alias("hits"))
    items = found.join(held(known.select("words", "window")), "words").select("window", "item")
    return staged(report), staged(items)


def hit_words(hits: Column) -> Column:
    """The distinct numbers, from 0, of the words inside hits."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["n"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, n_items, items (sorted ids), contaminated. See ``occurrences``."""
    report, owners = occurrences(docs, benchmark, key, text, item, item_text)
    windows = report.where("size(hits) > 0").select("row", F.explode(F.array_distinct("hits.window")).alias("window"))
    items = windows.join(owners, "window").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return report.join(items, "row", "left").select(
        F.col("key").alias(key), "n_words", F.size(hit_words(F.col("hits"))).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_words(text: Column, numbers: Column) -> Column:
    """``text`` without the words of these numbers and what follows each up to the next word."""
    cut = F.split(text, f"(?<={OTHER})(?={ANY_CASE})")  # before each word, so that what stands before the first is a piece of its own
    first = F.when(text.rlike(f"^{OTHER}"), F.lit(1)).otherwise(F.lit(0))
    left = let(cut, lambda p: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.transform(numbers, lambda i: i + first)), lambda i: F.get(p, i)))
    return F.array_join(left, "")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, columns unchanged, without the words inside windows of the benchmark, or without the documents that hold any.

    ``remove`` is "spans" or "documents". A document that consists of benchmark words alone keeps an empty text or
    what stands before its first word. Equal texts are told by their SHA-256 and lose the same words; a null text stays.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove}")
    digest = F.sha2(column(text), 256)
    report, _ = occurrences(docs.select(digest.alias("sha"), column(text).alias("body")), benchmark, "sha", "body", item, item_text)
    sha, numbers = free_name("sha", docs.columns), free_name("hit_words", docs.columns)
    dirty = report.where("size(hits) > 0").select(F.col("key").alias(sha), hit_words(F.col("hits")).alias(numbers)).dropDuplicates([sha])
    marked = docs.withColumn(sha, digest)
    if remove == "documents":
        return marked.join(dirty, sha, "left_anti").select(*[column(c) for c in docs.columns])
    cleaned = F.when(column(numbers).isNull(), column(text)).otherwise(without_words(column(text), column(numbers)))
    return marked.join(dirty, sha, "left").select(*[cleaned.alias(c) if c == text else column(c) for c in docs.columns])
