"""Fingerprints of tables, ordered sequences and nested release domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.canonical import header_line, json_line

# Places of the 60-bit slices of a SHA-256 in hex that are summed. Sums stay exact far beyond 10^15 rows.
SLICES = (1, 16, 31, 46)


def hash60(text: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a whole number any engine can reproduce."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def row_text(df: DataFrame) -> Column:
    """A row as JSON text with its columns in name order, nulls written."""
    ordered = F.struct(*[F.col(f"`{name}`").alias(name) for name in sorted(df.columns)])
    return F.to_json(ordered, {"ignoreNullFields": "false"})


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """AGG-21: row count and a digest of count and summed row hashes; row order plays no part.

    One pass with partial sums: no shuffle but that of one row per task.
    """
    summed = df.select(hash60(row_text(df)).cast("decimal(28,0)").alias("_h")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_h"), F.lit(0)).alias("_sum")
    )
    digest = F.md5(F.concat_ws(":", F.col("rows").cast("string"), F.col("_sum").cast("string")))
    return summed.select(F.lit(name).alias("table_name"), "rows", digest.alias("fingerprint"))


def _closed(subject: str, figures: list[Column]) -> Column:
    """SHA-256 over the header line and one line per figure."""
    return F.sha2(F.concat(header_line(subject), *[F.concat(f.cast("string"), F.lit("\n")) for f in figures]), 256)


def sequence_sums(df: DataFrame, groups: list[str], order: list[str], line: Column) -> DataFrame:
    """Per group the row count and the summed hash slices of keyed lines: what a sequence digest closes over.

    The sums are those of a set of lines, so they can be kept: sums of disjoint sets add up, and a line that
    goes is subtracted (``combined_sums``).
    """
    key_text = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    hashed = df.select(*groups, F.sha2(F.concat(key_text, F.lit("\n"), line), 256).alias("_hash"))
    part = lambda at: F.conv(F.substring("_hash", at, 15), 16, 10).cast("decimal(20,0)")
    return hashed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(part(at)), F.lit(0)).alias(f"_sum{at}") for at in SLICES]
    )


def combined_sums(signed: list[tuple[DataFrame, int]], groups: list[str]) -> DataFrame:
    """Sums added (+1) and taken away (-1), per group."""
    figures = ["rows", *[f"_sum{at}" for at in SLICES]]
    sides = [df.select(*groups, *[(F.col(c).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias(c) for c in figures]) for df, sign in signed]
    summed = reduce(DataFrame.unionByName, sides).groupBy(*groups).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,0)").alias(c) for c in figures])
    return summed.withColumn("rows", F.col("rows").cast("bigint"))


def closed_sums(sums: DataFrame, groups: list[str], subject: str) -> DataFrame:
    """The digest of each group's sums."""
    return sums.select(*groups, "rows", _closed(subject, [F.col("rows"), *[F.col(f"_sum{at}") for at in SLICES]]).alias("digest"))


def sequence_digest(df: DataFrame, groups: list[str], order: list[str], line: Column, subject: str) -> DataFrame:
    """AGG-22: per group the row count and a digest of header, count and summed hashes of keyed lines.

    Each row is hashed together with its key, so that the sums fix content and order alike: a line under
    another key has another hash. ``order`` must be unique within a group. There is one form for every
    size; sums combine before the shuffle, and a group of any share of all rows is one row per task.
    """
    return closed_sums(sequence_sums(df, groups, order, line), groups, subject)


def empty_digest(subject: str) -> Column:
    """The digest of a group without rows."""
    return _closed(subject, [F.lit(0)] * (1 + len(SLICES)))


def with_child_digests(watersheds: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """AGG-23, first level: every watershed with the digest of each of its child sequences.

    ``children`` maps a column name to (digests per run, subject); a watershed without
    children of a kind gets the digest of the empty sequence.
    """
    rows = watersheds
    for name, (digests, subject) in children.items():
        one = digests.select(key, F.col("digest").alias(f"_{name}"))
        rows = rows.join(one, key, "left").withColumn(name, F.coalesce(f"_{name}", empty_digest(subject))).drop(f"_{name}")
    return rows


def domain_digest(
    watersheds: DataFrame, order: list[str], fields: dict[str, Column], subject: str = "serving-watershed-domain"
) -> DataFrame:
    """AGG-23: the digest of all watershed lines in key order, one row."""
    prepared = watersheds.withColumn("_doc", json_line(fields))
    return sequence_digest(prepared, [], order, F.col("_doc"), subject)
