"""From bands to verified components, for operators on near duplicates.

Items with equal shingle sets are one node beforehand. In every band, nodes meet the band's
representative first (n pairs, not n * n). What is linked by then is one component, and only nodes of
different components in a band still have to meet; they do so by a prefix filter, which is exact and
leaves no pair out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm.common import discard, release, staged
from headwater.llm.components import components
from headwater.llm.shingles import SetCache, shingle_hashes, similar, word_hashes

# Bands of so many nodes meet as rows; larger ones in blocks of so many nodes and shingles, so many columns at once.
SMALL = 16
BLOCK_NODES = 256
BLOCK_SHINGLES = 400_000
COLUMNS = 4096


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a < b) whose sizes allow the similarity."""
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return pairs.where((F.col("node") != F.col("other")) & fits).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    ).distinct()


def star_pairs(in_bands: DataFrame, percent: int, seed: int) -> DataFrame:
    """Each node with the representative of each of its bands: the smallest in a random order of nodes."""
    order = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node"), F.col("n"))
    heads = in_bands.groupBy("band").agg(F.min(order).alias("head"), F.count("*").alias("size")).where("size > 1")
    heads = heads.select("band", F.col("head.node").alias("other"), F.col("head.n").alias("m"))
    return _ordered(in_bands.join(heads, "band"), percent)


def small_group_pairs(in_bands: DataFrame, percent: int) -> DataFrame:
    """All pairs between components in bands of at most ``SMALL`` nodes: at most so many partners per row."""
    sizes = in_bands.groupBy("band").agg(F.count("*").alias("size")).where(F.col("size") <= SMALL).select("band")
    rows = in_bands.join(sizes, "band")
    other = rows.select("band", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root"))
    return _ordered(rows.join(other, "band").where("root < other_root"), percent)


def _spanning(left: np.ndarray, right: np.ndarray, hit: np.ndarray, root: np.ndarray, node: list) -> list[tuple]:
    """As many of the links as join the same components: one for each merge, not one for each pair."""
    above = list(range(int(root.max()) + 1))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    pairs = []
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        for j in np.flatnonzero(hit[i]).tolist():
            a, b = top(int(root[left[i]])), top(int(root[right[j]]))
            if a != b:
                above[max(a, b)] = min(a, b)
                x, y = node[left[i]], node[right[j]]
                pairs.append((min(x, y), max(x, y)))
    return pairs


def _block_links(block: pa.Table, percent: int) -> pa.Table:
    """Links that join the components within a block pair, by a product of incidence matrices."""
    side, node, root = block.column("side").to_numpy(), block.column("node").to_pylist(), block.column("root").to_pylist()
    sets = [np.asarray(x) for x in block.column("hashes").to_pylist()]
    names = {r: i for i, r in enumerate(sorted(set(root)))}
    of_root = np.array([names[r] for r in root])
    size = np.array([len(x) for x in sets])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    often = np.bincount(number) > 1
    column_of = np.cumsum(often) - 1
    keep = often[number]
    owner, number, width = owner[keep], column_of[number[keep]], int(often.sum())
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, width, COLUMNS):
        here = (number >= at) & (number < at + COLUMNS)
        table = np.zeros((len(sets), min(COLUMNS, width - at)), np.float32)
        table[owner[here], number[here] - at] = 1
        common += table[left] @ table[right].T
    union = size[left][:, None] + size[right][None, :] - common
    hit = (100 * common >= percent * union) & (of_root[left][:, None] != of_root[right][None, :])
    pairs = _spanning(left, right, hit, of_root, node)
    kind = block.schema.field("node").type
    return pa.table({"a": pa.array([x for x, _ in pairs], kind), "b": pa.array([y for _, y in pairs], kind)})


def by_head(in_bands: DataFrame) -> DataFrame:
    """Bands of more than ``SMALL`` nodes, with those of the same head (least node in a random order) as one.

    Near copies share many rare shingles, and a node of a family would be sent once for each of them. All
    pairs of a band stay together under its head, and a node is there once. Bands are left apart where
    together they would have more pairs than each by itself.
    """
    order = F.struct(F.xxhash64("node", F.lit(2)).alias("h"), F.col("node"))
    heads = in_bands.groupBy("band").agg(F.min(order).alias("head"), F.count("*").alias("size")).where(F.col("size") > SMALL)
    placed = in_bands.join(heads.select("band", F.xxhash64("head.node", F.lit(3)).alias("head"), "size"), "band")
    members = placed.groupBy("head", "node", "n", "root").agg(F.sum("size").alias("met"))
    joint = members.groupBy("head").agg(F.count("*").alias("together"), F.sum("met").alias("apart")).where("together * together <= apart")
    joint = joint.select("head")
    return members.join(joint, "head").select(F.col("head").alias("band"), "node", "n", "root").unionByName(
        placed.join(joint, "head", "left_anti").select("band", "node", "n", "root")
    )


def large_group_links(in_bands: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components in bands of more than ``SMALL`` nodes.

    A band is dealt into blocks of bounded weight, and each pair of blocks is one product of incidence
    matrices in one task. No pair of nodes becomes a row unless it is a link, no task holds a group.
    """
    sizes = in_bands.groupBy("band").agg(F.count("*").alias("size"), F.sum("n").alias("weight")).where(F.col("size") > SMALL)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_NODES), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    rows = in_bands.join(sizes.select("band", blocks.alias("blocks")), "band")
    own = F.pmod(F.xxhash64("node", "band"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("with"), F.lit(2)).when(F.col("own") < F.col("with"), F.lit(0)).otherwise(F.lit(1))
    dealt = dealt.select("band", "node", "root", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), side.alias("side"))
    full = dealt.join(sets, "node")
    kind = T.StructType([T.StructField("a", full.schema["node"].dataType), T.StructField("b", full.schema["node"].dataType)])
    return full.groupBy("band", "i", "j").applyInArrow(lambda block: _block_links(block, percent), kind).distinct()


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough. ``texts`` has one (node, text) per node."""
    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = SetCache(k)
        for batch in batches:
            a, b, text_a, text_b = (batch.column(i).to_pylist() for i in range(4))
            keep = [similar(sets(x, s), sets(y, t), percent) for x, y, s, t in zip(a, b, text_a, text_b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    chosen = full.select("a", "b", "text_a", "text_b")
    return chosen.mapInArrow(check, T.StructType([chosen.schema["a"], chosen.schema["b"]]))


def _open_only(in_bands: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of bands that still hold nodes of different components, with the component of each node."""
    placed = in_bands.select("band", "node", "n").join(roots, "node", "left").select(
        "band", "node", "n", F.coalesce("root", "node").alias("root")
    )
    open_bands = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return placed.join(open_bands, "band", "left_semi")


def hashed_sets(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(node, hashes) with the 64-bit hashes of the distinct shingles of each node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(word_hashes(t), k)).astype(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    chosen = texts.join(nodes.select("node").distinct(), "node").select("node", "text")
    return chosen.mapInArrow(run, T.StructType([chosen.schema["node"], T.StructField("hashes", T.ArrayType(T.LongType()))]))


def rare_shingles(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(band, node, n): the shingles of each node of which it must share one with any node it is linked to.

    Prefix filter: in an order of all shingles from rare to frequent, similar sets share one of their
    first n - ceil(percent * n / 100) + 1 shingles. Those that occur once can be shared with nobody.
    """
    each = sets.select("node", F.explode("hashes").alias("band"))
    common = each.groupBy("band").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common, "band").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "band"))).alias("found"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = shared.join(nodes.select("node", "n").distinct(), "node").withColumn("take", prefix - (F.col("n") - F.size("found")))
    kept = F.slice("found", 1, F.greatest("take", F.lit(0)).cast("int"))
    return first.select("node", "n", F.explode(kept).alias("s")).select(F.col("s.band").alias("band"), "node", "n")


def near_components(nodes: DataFrame, texts_of: Callable[[DataFrame], DataFrame], k: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that are linked with another.

    ``nodes`` has (node, n, bands): a key, the size of its set and its band keys. ``texts_of`` gives
    (node, text) for a table of nodes. Links are confirmed on full sets of ``k`` words. Nodes that
    share a band but lie in different components after the star round meet again by their rare
    shingles, where sets that are merely half alike do not meet.
    """
    in_bands = nodes.select("node", "n", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    in_bands = staged(in_bands.join(shared, "band", "left_semi").select("band", "node", "n"))
    release(in_bands.sparkSession)
    texts = staged(texts_of(in_bands.select("node").distinct()))
    release(in_bands.sparkSession)
    tested = staged(star_pairs(in_bands, percent, 0))
    links = staged(verified(tested, texts, k, percent))
    roots = staged(components(links))
    unsettled = staged(_open_only(in_bands, roots).select("node", "n").distinct())
    discard(in_bands)
    release(unsettled.sparkSession)
    if unsettled.isEmpty():
        discard(texts)
        return roots
    sets = staged(hashed_sets(unsettled, texts, k))
    in_bands = staged(rare_shingles(unsettled, sets, percent))
    pairs = staged(star_pairs(_open_only(in_bands, roots), percent, 1).join(tested, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        links = links.union(staged(verified(pairs, texts, k, percent)))
        roots = staged(components(links))
    rest = staged(_open_only(in_bands, roots))
    discard(in_bands)
    release(rest.sparkSession)
    if rest.isEmpty():
        discard(texts, sets, rest)
        return roots
    found = large_group_links(staged(by_head(rest)), sets, percent).union(small_group_pairs(rest, percent)).distinct()
    links = links.union(staged(verified(staged(found), texts, k, percent)))
    discard(texts, sets, rest)
    return staged(components(links))
