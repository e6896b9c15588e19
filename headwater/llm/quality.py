"""Operator 4: quality rules with thresholds from mergeable quantile sketches.

Features of every text are counted once. Per language and source, a sketch of each measure is a
histogram over buckets of bounded relative width (32 per power of two); sketches merge by adding
counts, so they combine before the shuffle, and small groups take the merged sketch of their
language, then of all rows. The quartiles of the sketch give the bounds, which join the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm.common import column, free_name, ship, staged, texts_of

FEATURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORDS_AT_ONCE = 1_000_000
# Measures per row (five lines are added, so that one repeated line of three is no outlier), and the least spread (in the measure's unit) that a bound allows for. The fence
# is the third quartile plus three spreads: far outliers only, so that clean texts stay.
MEASURES = {
    "word_length": "100 * word_chars div n_words",
    "symbols": "1000 * n_symbols div n_words",
    "dup_lines": "1000 * n_dup_lines div n_lines + 5",
    "repeats": "1000 * n_repeat_words div n_words",
}
LEAST_SPREAD = {"word_length": 200, "symbols": 50, "dup_lines": 100, "repeats": 100}
LEAST_ROWS = 100


def repeated_words(words: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """Words in windows of eight that occur at least twice in their own text, counted per text.

    Windows are compared exactly: numbers of pairs are numbered again for pairs of pairs, three times.
    """
    found = np.zeros(owners, np.int64)
    if len(words) < WINDOW:
        return found
    _, number = np.unique(owner * np.int64(words.max() + 1) + words, return_inverse=True)
    step = 1
    while step < WINDOW:
        pairs = number[:-step] * np.int64(len(words)) + number[step:]
        _, number = np.unique(pairs, return_inverse=True)
        step *= 2
    inside = owner[: len(number)] == owner[WINDOW - 1 :]
    twice = (np.bincount(number[inside], minlength=int(number.max()) + 1)[number] > 1) & inside
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, np.flatnonzero(twice), 1)
    np.add.at(marks, np.flatnonzero(twice) + WINDOW, -1)
    return np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=owners).astype(np.int64)


def count_features(texts: list[str]) -> dict[str, list[int]]:
    """The features of each text. Words are runs without space, tab, newline, VT, FF or CR."""
    out: dict[str, list[int]] = {name: [] for name in FEATURES}
    numbers: dict[bytes, int] = {}
    words: list[int] = []
    sizes: list[int] = []

    def flush() -> None:
        if sizes:
            owner = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            out["n_repeat_words"] += repeated_words(np.array(words, np.int64), owner, len(sizes)).tolist()
            words.clear(), sizes.clear(), numbers.clear()

    for text in texts:
        data = text.encode()
        split = data.split()
        if len(words) + len(split) > WORDS_AT_ONCE:
            flush()
        words += [numbers.setdefault(w, len(numbers)) for w in split]
        sizes.append(len(split))
        blanks = sum(map(text.count, " \t\n\v\f\r"))
        lines = [line for line in data.split(b"\n") if line.split(None, 1)]
        out["n_words"].append(len(split))
        out["word_chars"].append(len(text) - blanks)
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_lines"].append(len(lines))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    flush()
    return out


def with_features(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with one struct column of features, and the name of that column (free of clashes)."""
    ship(docs.sparkSession)
    name = free_name("quality", docs.columns)
    place = docs.columns.index(text)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            found = count_features(texts)
            struct = pa.StructArray.from_arrays([pa.array(found[f], pa.int64()) for f in FEATURES], FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*columns, name])

    kind = T.StructType([T.StructField(f, T.LongType()) for f in FEATURES])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def base_failed(features: str) -> Column:
    """Fixed part: fewer than 20 words, or over 30 % of the words in repeated windows."""
    f = column(features)
    return (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])


def measure(features: str, name: str) -> Column:
    f = column(features)
    counts = {part: f[part] for part in FEATURES}
    top, bottom = MEASURES[name].split(" div ")
    factor, count = top.split(" * ")
    divisor, _, more = bottom.partition(" + ")
    return F.coalesce((int(factor) * counts[count] / F.nullif(counts[divisor] + int(more or 0), F.lit(0))).cast("long"), F.lit(0))


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number: itself below 64, else 5 bits after its leading bit."""
    shift = F.greatest(F.length(F.bin(value)) - F.lit(6), F.lit(0))
    width = F.pow(F.lit(2.0), shift)
    return F.floor(value / width).cast("long") * width.cast("long")


def group_key(name: str) -> Column:
    """A text for each group: null and the empty text are groups of their own."""
    return F.coalesce(F.concat(F.lit("="), column(name).cast("string")), F.lit(""))


def sketches(rows: DataFrame, features: str, lang: str, source: str) -> DataFrame:
    """Histogram rows (lang, source, measure, bucket, n) of all rows that pass the fixed part."""
    entries = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(measure(features, m)).alias("bucket")) for m in MEASURES])
    return (
        rows.where(~base_failed(features))
        .select(group_key(lang).alias("lang"), group_key(source).alias("source"), F.explode(entries).alias("e"))
        .groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Rows and quartiles of each merged sketch. A sketch has some thousand buckets at most, whatever its rows."""
    merged = sketch.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
    per = ", ".join([*groups, "measure"])
    ranked = merged.selectExpr(
        *groups, "measure", "bucket", "n",
        f"sum(n) OVER (PARTITION BY {per} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS upto",
        f"sum(n) OVER (PARTITION BY {per}) AS total",
    )
    at = {q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket"))) for q in (1, 3)}
    return ranked.groupBy(*groups, "measure").agg(F.max("total").alias("rows"), at[1].alias("q1"), at[3].alias("q3"))


def bounds(sketch: DataFrame) -> DataFrame:
    """Upper and lower bound of each measure per language and source, one row each.

    Groups of fewer than ``LEAST_ROWS`` rows take the sketch of their language, or of all rows.
    """
    sketch = staged(sketch)
    fine = quartiles(sketch, ["lang", "source"])
    names = {"rows": "rows", "q1": "q1", "q3": "q3"}
    by_lang = quartiles(sketch, ["lang"]).withColumnsRenamed({n: f"lang_{n}" for n in names})
    whole = quartiles(sketch, []).withColumnsRenamed({n: f"all_{n}" for n in names})
    chosen = fine.join(by_lang, ["lang", "measure"]).join(whole, "measure")
    value = {
        q: F.when(F.col("rows") >= LEAST_ROWS, F.col(q)).when(F.col("lang_rows") >= LEAST_ROWS, F.col(f"lang_{q}")).otherwise(F.col(f"all_{q}"))
        for q in ("q1", "q3")
    }
    least = F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.lit(LEAST_SPREAD[m]))])
    spread = F.greatest(value["q3"] - value["q1"], least[F.col("measure")])
    per_measure = chosen.select(
        "lang", "source", "measure", (value["q3"] + 3 * spread).alias("high"), (value["q1"] - 3 * spread).alias("low")
    )
    columns = [
        F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")
    ]
    return per_measure.groupBy("lang", "source").agg(*columns)


def judge(rows: DataFrame, features: str, limits: DataFrame, lang: str = "lang", source: str = "source") -> tuple[DataFrame, str, str]:
    """``rows`` with two columns added: failed the fixed part, and kept. Returns their names too.

    ``limits`` has a row per language and source; Spark broadcasts it if its size allows, and splits
    the hot source otherwise. A group without a bound (all its rows failed) keeps nothing but is complete.
    """
    failed, kept = free_name("base_failed", rows.columns), free_name("kept", rows.columns)
    prefix = free_name("limit", [c.split("_")[0] for c in rows.columns]) + "_"
    renamed = limits.select(*[F.col(c).alias(prefix + c) for c in limits.columns])
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(measure(features, m).between(column(f"{prefix}{m}_low"), column(f"{prefix}{m}_high")), F.lit(True))
    joined = rows.join(renamed, (group_key(lang) == column(f"{prefix}lang")) & (group_key(source) == column(f"{prefix}source")), "left")
    return joined.select(*[column(c) for c in rows.columns], base_failed(features).alias(failed), (~base_failed(features) & inside).alias(kept)), failed, kept


def quality_verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: key, the features, base_failed, kept.

    Null text counts as empty and fails for want of words. Null language or source is a group of its
    own. Repeated rows give a row each. Features are written once to the shared folder, without texts.
    """
    narrow = docs.select(*[column(c).alias(n) for c, n in ((key, "doc_id"), (text, "text"), (lang, "lang"), (source, "source"))])
    rows, features = with_features(narrow)
    rows = staged(rows.drop("text"))
    limits = staged(bounds(sketches(rows, features, "lang", "source")))
    judged, failed, kept = judge(rows, features, limits)
    out = judged.select("doc_id", f"{features}.*", column(failed).alias("base_failed"), column(kept).alias("kept"))
    return out if key == "doc_id" else out.withColumnRenamed("doc_id", key)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` without the rows that the rules reject, columns unchanged.

    Features are counted twice, once for the sketches and once for the verdict, so that texts are
    neither shuffled nor written in between.
    """
    rows, features = with_features(docs, text)
    limits = staged(bounds(sketches(rows, features, lang, source)))
    judged, _, kept = judge(rows, features, limits, lang, source)
    return judged.where(column(kept)).select(*[column(c) for c in docs.columns])
