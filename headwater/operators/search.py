"""Ranked search over watershed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("id", "huc", "name", "source_name")


def _score(value: Column, field: str, phrase: str, tokens: list[str]) -> Column:
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    every = F.lit(len(tokens) > 1)
    for token in tokens:
        every = every & text.contains(token)
    exact = 0 if field in ("id", "huc") else 1
    return (
        F.when(text == "", F.lit(None).cast("int"))
        .when(text == phrase, F.lit(exact))
        .when(text.startswith(phrase), F.lit(2))
        .when(text.contains(phrase), F.lit(3))
        .when(every, F.lit(4))
    )


def ranked_search(index: DataFrame, query: str) -> DataFrame:
    """SRT-03 and WIN-04: the best match of every item, then by score and name.

    The four fields of an item lie in one row, so its best match is the least of four
    (score, field position) pairs and needs no shuffle; only the final sort does.
    """
    phrase = query.strip().lower()
    tokens = phrase.split()
    best = F.array_min(
        F.filter(
            F.array(*[
                F.struct(_score(F.col(f), f, phrase, tokens).alias("score"), F.lit(i).alias("field"))
                for i, f in enumerate(FIELDS)
            ]),
            lambda m: m["score"].isNotNull(),
        )
    )
    if not phrase:
        return index.limit(0).select("id", "name", F.lit("").alias("match_field"), F.lit(0).alias("score"))
    names = F.array(*[F.lit(f) for f in FIELDS])
    return (
        index.withColumn("_best", best).where(F.col("_best").isNotNull())
        .select("id", "name", F.get(names, F.col("_best.field")).alias("match_field"),
                F.col("_best.score").alias("score"))
        .orderBy("score", F.lower("name"), "name", "id")
    )
