"""Operator 11: Merkle manifest of a dataset, with proofs by descent of a content-addressed DAG.

Rows are leaves of one tree per value of a column; the roots of the trees are the leaves of one more tree.
A tree is built in segments of several levels: a record maps the digest at the head of a segment to the
digests at its foot, and nothing else locates it. Requests for leaves then descend from the root. What
leads to the same record travels as one row until it divides, so a round handles a node once and not once
per leaf below it; each digit of a leaf's rank selects a child, and the digests of the children not selected
are collected. The segments of a path come from the root down and are reversed at the leaf.

No tree, level or path passes through the driver: it sees one row per task of the sort, and the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwater.llm.common import column, ship, staged

FAN = 2  # children of a node
LEVELS = 8  # of a segment: a record holds FAN ** LEVELS digests at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RECORD = "tree long, block long, digest binary, height int, children array<binary>, top boolean"
FRONTIER = "place long, digest binary, path array<struct<left:string,right:string>>"
SIBLINGS = pa.struct([("left", pa.string()), ("right", pa.string())])


@dataclass
class Manifest:
    """``requests`` (tree, block, members), ``records`` and ``heads`` by round from the leaves up, and the root."""

    requests: DataFrame
    records: list[DataFrame]
    heads: list[DataFrame]
    root: bytes | None
    key: T.DataType


def leaf_digest(values: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values as text: ``-`` for null, else length in bytes, a colon, the value."""
    texts = [value.cast("string") for value in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


# -- ranks ----------------------------------------------------------------------------------------------

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted task: its number, how many trees began before in it, and the place in the tree so far."""
    part, run, place, last = TaskContext.get().partitionId(), -1, 0, object()
    for batch in batches:
        runs, places = [], []
        for tree in batch.column("tree").to_pylist():
            run, place = (run, place + 1) if tree == last and run >= 0 else (run + 1, 0)
            last = tree
            runs.append(run)
            places.append(place)
        added = [pa.array([part] * len(runs), pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(batch.columns + added, names=batch.schema.names + ["part", "run", "place"])


def ranked(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, key, digest, claim) with the number of the tree in order, and the rank within it.

    Order is tree, key, digest, nulls first and text by its UTF-8 bytes. One distributed sort; then a row per
    task tells how many trees, and how many leaves of an unfinished tree, come before it.
    """
    spark, order = leaves.sparkSession, ["tree", "key", "digest"]
    schema = T.StructType([*leaves.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("place", T.LongType())])
    rows = staged(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, schema))
    tasks = rows.groupBy("part").agg(
        F.min(F.struct("run", "place", "tree")).alias("first"), F.max(F.struct("run", "place", "tree")).alias("last")
    ).orderBy("part").collect()
    offsets, trees, open_tree, open_leaves = [], 0, object(), 0
    for part, first, last in tasks:
        goes_on = trees > 0 and first.tree == open_tree
        carried = open_leaves if goes_on else 0
        offsets.append((part, trees - goes_on, carried))
        trees += last.run + 1 - goes_on
        open_tree, open_leaves = last.tree, last.place + 1 + (carried if last.run == 0 else 0)
    starts = spark.createDataFrame(offsets, "part int, tree_from long, carried long")
    return rows.join(F.broadcast(starts), "part").select(
        (F.col("tree_from") + F.col("run")).alias("tree"), (F.col("place") + F.when(F.col("run") == 0, F.col("carried")).otherwise(0)).alias("rank"),
        "digest", "key", "claim",
    )


# -- building -------------------------------------------------------------------------------------------

def levels_of(children: list[str], height: int, fan: int) -> list[list[str]]:
    """The hex digests of a segment level by level, from its foot to its head."""
    levels = [children]
    for _ in range(height):
        below = levels[-1]
        levels.append([sha256("".join(below[i : i + fan]).encode()).hexdigest() for i in range(0, len(below), fan)])
    return levels


def _recorder(fan: int, levels: int):
    width = fan**levels

    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("digest", pa.binary()), ("height", pa.int32()), ("children", pa.list_(pa.binary())), ("top", pa.bool_())])
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                count, height = len(row["children"]), levels
                if row["block"] == 0 and count < width:  # the tree ends in this segment
                    height = next(h for h in range(levels + 1) if fan**h >= count)
                head = levels_of([c.hex() for c in row["children"]], height, fan)[-1][0]
                rows.append({**row, "digest": bytes.fromhex(head), "height": height, "top": height == 0})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return record


def _rounds(nodes: DataFrame, members: list[str], fan: int, levels: int) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """First groups of members, then records and finished trees of each round, until every tree has one node."""
    requests, records, heads = None, [], []
    while requests is None or not nodes.isEmpty():
        block = F.expr(f"rank div {fan**levels}").alias("block")
        grouped = nodes.groupBy("tree", block).agg(F.sort_array(F.collect_list(F.struct("rank", "digest", *members))).alias("members"))
        if requests is None:
            requests = grouped = staged(grouped)
        made = staged(grouped.select("tree", "block", F.col("members.digest").alias("children")).mapInArrow(_recorder(fan, levels), RECORD))
        records.append(made.where("NOT top").select("digest", "height", "children"))
        heads.append(made.where("top").select("tree", "digest"))
        nodes, members = made.where("NOT top").select("tree", F.col("block").alias("rank"), "digest"), []
    return requests, records[: max(1, len(records) - 1)], heads  # the last round has heads only


def build(
    docs: DataFrame, tree: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, claim: Column | None = None,
    fan: int = FAN, levels: int = LEVELS,
) -> tuple[Manifest, Manifest]:
    """Manifests of the trees of ``docs`` and of the tree over their roots.

    A leaf is the digest of ``fields``. ``claim`` is an optional hex digest that each leaf's proof is to be
    tried on. Null is a tree of its own and comes first, as do null keys; equal keys are in order of their
    digests, and repeated rows are leaves of their own. An empty text differs from null. Other columns do not
    matter. A table without rows has no root (None).
    """
    ship(docs.sparkSession)
    leaves = docs.select(
        column(tree).alias("tree"), column(key).alias("key"), F.unhex(leaf_digest([column(f) for f in fields])).alias("digest"),
        F.unhex(F.lit(None).cast("string") if claim is None else claim).alias("claim"),
    )
    requests, records, heads = _rounds(ranked(staged(leaves)), ["key", "claim"], fan, levels)
    roots = heads[0]
    for more in heads[1:]:
        roots = roots.union(more)
    top_requests, top_records, top_heads = _rounds(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "digest"), [], fan, levels)
    root = next((row.digest for head in top_heads for row in head.take(1)), None)
    kind = docs.select(column(key)).schema[0].dataType
    return Manifest(requests, records, heads, root, kind), Manifest(top_requests, top_records, top_heads, root, kind)


# -- descent --------------------------------------------------------------------------------------------

def _segment(digest: bytes, height: int, children: list[bytes], fan: int) -> list[list[tuple[str, str]]]:
    """Of each child, what stands left and right of its ancestors, from the head of the segment down."""
    levels = levels_of([c.hex() for c in children], height, fan)
    if levels[-1] != [digest.hex()]:
        raise ValueError(f"the record of {digest.hex()} holds other children")
    beside = []  # by level, of each of its nodes
    for nodes in levels[:height]:
        beside.append([("".join(nodes[i - i % fan : i]), "".join(nodes[i + 1 : i - i % fan + fan])) for i in range(len(nodes))])
    return [[beside[level][i // fan**level] for level in range(height - 1, -1, -1)] for i in range(len(children))]


def _descender(fan: int, levels: int):
    width = fan**levels

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("place", pa.int64()), ("digest", pa.binary()), ("path", pa.list_(SIBLINGS)), ("tree", pa.int64()), ("subroot", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                if row["children"] is None:  # this tree has fewer rounds: its root waits for the record
                    yield pa.RecordBatch.from_pylist([{name: row[name] for name in schema.names}], schema)
                    continue
                parts = _segment(row["digest"], row["height"], row["children"], fan)
                yield pa.RecordBatch.from_pylist([
                    {"place": row["place"] * width + i, "digest": child, "path": row["path"] + [{"left": a, "right": b} for a, b in part],
                     "tree": row["tree"], "subroot": row["subroot"]}
                    for i, (child, part) in enumerate(zip(row["children"], parts))
                ], schema)

    return descend


def _beside(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The record of each digest. Repeated rows can make equal segments: a digest has one record."""
    one = records.groupBy("digest").agg(F.first("height").alias("height"), F.first("children").alias("children"))
    return frontier.join(one, "digest", "left")


def _answerer(fan: int, key: pa.DataType, root: bytes):
    schema = pa.schema([("key", key), ("leaf", pa.string()), ("claim", pa.string()), ("siblings", pa.list_(SIBLINGS)), ("subroot", pa.string()), ("root", pa.string())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                members, above = row["members"], [(s["left"], s["right"]) for s in reversed(row["path"])]
                if row["children"] is None:
                    parts = [[]]
                else:
                    parts = _segment(row["digest"], row["height"], row["children"], fan)
                offsets, left, right = [0], [], []
                for part in parts:
                    for a, b in [*reversed(part), *above]:
                        left.append(a)
                        right.append(b)
                    offsets.append(len(left))
                pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(SIBLINGS))
                n = len(members)
                yield pa.RecordBatch.from_arrays([
                    pa.array([m["key"] for m in members], key), pa.array([m["digest"].hex() for m in members]),
                    pa.array([m["claim"].hex() if m["claim"] else None for m in members], pa.string()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs), pa.array([row["subroot"].hex()] * n), pa.array([root.hex()] * n),
                ], schema=schema)

    return answer


def proofs(trees: Manifest, top: Manifest, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """One row per leaf: key, leaf, claim, siblings from the leaf up to the root, subroot, root; digests in hex.

    ``siblings`` has an element per level, also where nothing stands beside the node (both texts empty).
    """
    spark = trees.requests.sparkSession
    from pyspark.sql.pandas.types import to_arrow_type

    out = T.StructType.fromDDL("leaf string, claim string, siblings array<struct<left:string,right:string>>, subroot string, root string")
    out = T.StructType([T.StructField("key", trees.key), *out.fields])
    if top.root is None:
        return spark.createDataFrame([], out)
    descend, schema = _descender(fan, levels), f"{FRONTIER}, tree long, subroot binary"
    frontier = spark.createDataFrame([(0, top.root, [], None, None)], schema)
    for records in reversed(top.records):
        frontier = _beside(frontier, records).mapInArrow(descend, schema)
    frontier = frontier.select(F.lit(0).cast("long").alias("place"), "digest", "path", F.col("place").alias("tree"), F.col("digest").alias("subroot"))
    for records in reversed(trees.records[1:]):
        frontier = _beside(frontier, records).mapInArrow(descend, schema)
    asked = _beside(frontier, trees.records[0]).withColumnRenamed("place", "block").join(trees.requests, ["tree", "block"])
    return asked.mapInArrow(_answerer(fan, to_arrow_type(trees.key), top.root), out)


def folded(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(siblings, leaf, lambda node, beside: F.sha2(F.concat(beside["left"], node, beside["right"]), 256))


def proof_digest(siblings: Column) -> Column:
    """SHA-256 of the siblings of a proof in a row."""
    return F.sha2(F.array_join(F.transform(siblings, lambda beside: F.concat(beside["left"], beside["right"])), ""), 256)


def verified_proofs(docs: DataFrame, tampered: Column, tree: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, raised: str = "n_chars") -> DataFrame:
    """Every row's proof, tried on the row as it is or, where ``tampered``, on one whose ``raised`` field is larger by one.

    Returns key, leaf, subroot, root, proof_sha256, folded_root, verified; see ``build`` for nulls and ties.
    """
    more = [column(f) if f != raised else column(f).cast("decimal(20,0)") + 1 for f in fields]
    found = proofs(*build(docs, tree, key, fields, F.when(tampered, leaf_digest(more))))
    back = folded(F.coalesce("claim", "leaf"), F.col("siblings"))
    return found.select(F.col("key").alias(key), "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), back.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )
