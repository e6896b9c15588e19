"""SRC-03: feature collections read in splits, so that one large file is many tasks.

Where a split begins, JSON alone does not tell whether its first byte is inside a string, nor how deep it is.
So a first pass reads every split once and finds, for both beginnings (outside and inside a string), how the split
ends and by how much it changes the depth. These maps compose in file order, which gives the true state at every
split and the number of features before it. The second pass takes the features that begin in each split; one that
goes on into the next split is read to its end. The driver sees a row per split.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.sources.blobs import listed, open_file

SPLIT_BYTES = 64 << 20
MORE_BYTES = 1 << 20  # read at a time beyond a split, for its last feature
LOOK_AHEAD = 256  # bytes beyond a split in which a name begun in it may end
# The members of a collection that are looked for: the start of its features, and its type.
MEMBERS = re.compile(rb'"features"\s*:\s*(\[)|"type"\s*:\s*"(FeatureCollection)"')
OPEN, CLOSE, ARRAY_END = b"{[", b"}]", ord("]")


def _escaped_before(source: pa.NativeFile, at: int) -> int:
    """How many backslashes stand directly before a place."""
    count = 0
    while at > 0:
        size = min(at, 4096)
        source.seek(at - size)
        block = source.read(size)
        run = len(block) - len(block.rstrip(b"\\"))
        count, at = count + run, at - size
        if run < size:
            break
    return count


def _quotes(data: np.ndarray, backslashes: int) -> np.ndarray:
    """Places of quotation marks that no backslash escapes; ``backslashes`` stand before the data."""
    quotes = np.flatnonzero(data == ord('"'))
    slashes = np.flatnonzero(data == ord("\\"))
    if not len(slashes) and backslashes % 2 == 0:
        return quotes
    run_starts = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
    sizes = np.diff(np.append(run_starts, len(slashes)))
    ends = slashes[run_starts] + sizes if len(slashes) else slashes
    if len(slashes) and slashes[0] == 0:
        sizes[0] += backslashes
    elif backslashes:
        ends, sizes = np.append(0, ends), np.append(backslashes, sizes)
    return quotes[~np.isin(quotes, ends[sizes % 2 == 1])]


def structure(data: np.ndarray, inside: bool, backslashes: int = 0) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the brackets outside strings, the depth after each relative to the start, and whether the end is in a string."""
    quotes = _quotes(data, backslashes)
    brackets = np.flatnonzero((data == OPEN[0]) | (data == OPEN[1]) | (data == CLOSE[0]) | (data == CLOSE[1]))
    brackets = brackets[(np.searchsorted(quotes, brackets) + inside) % 2 == 0]
    opens = (data[brackets] == OPEN[0]) | (data[brackets] == OPEN[1])
    return brackets, np.cumsum(np.where(opens, 1, -1)), bool((len(quotes) + inside) % 2)


def _map(path: str, start: int, stop: int) -> dict:
    """What a split does from either beginning; members are kept with the relative depth before them."""
    with open_file(path) as source:
        backslashes = _escaped_before(source, start)
        source.seek(start)
        raw = source.read(stop - start + LOOK_AHEAD)
    data = np.frombuffer(raw, np.uint8)[: stop - start]
    found = {}
    for inside in (False, True):
        places, depth, ends_inside = structure(data, inside, backslashes)
        before = np.append(0, depth[:-1]) if len(depth) else depth
        objects = data[places] == OPEN[0]
        quotes = _quotes(data, backslashes)
        members = []
        for m in MEMBERS.finditer(raw):
            if m.start() >= stop - start or (np.searchsorted(quotes, m.start()) + inside) % 2:
                continue
            k = int(np.searchsorted(places, m.start()))
            at = m.end() - 1 if m[1] else -1
            rest = k + 1 if m[1] and k < len(places) and places[k] == at else k
            members.append({
                "at": start + at if m[1] else -1, "depth": int(before[k] if k < len(before) else depth[-1] if len(depth) else 0),
                "objects": Counter(before[rest:][objects[rest:]].tolist()), "least": int(depth[rest:].min(initial=10**9)),
            })
        found[inside] = {
            "inside": ends_inside, "change": int(depth[-1]) if len(depth) else 0, "members": members,
            "objects": Counter(before[objects].tolist()), "least": int(depth.min(initial=10**9)),
        }
    return found


def _split_plan(summaries: list[tuple[str, int, int, dict]]) -> tuple[list[tuple], list[tuple[str, bool]]]:
    """From the maps in file order: the splits that hold features, with their true state, and (file, right type)."""
    plan, types, file = [], {}, None
    for path, start, stop, maps in summaries:
        if path != file:
            file, inside, depth, region, position = path, False, 0, None, 0
            types[path] = False
        own = maps[inside]
        opened = region is not None  # None: before the features, -1: after them
        begin = start
        count, least = own["objects"], own["least"]
        for member in own["members"]:
            if depth + member["depth"] == 1:
                if member["at"] < 0:
                    types[path] = True
                elif region is None:
                    region, begin, count, least = member["at"], member["at"] + 1, member["objects"], member["least"]
        if region is not None and region >= 0:
            plan.append((path, begin, stop, inside if opened else False, depth if opened else 2, position))
            position += count.get(2 - depth, 0)
            if depth + least <= 1:
                region = -1
        inside, depth = own["inside"], depth + own["change"]
    return plan, list(types.items())


def _features(path: str, begin: int, stop: int, inside: bool, depth: int) -> Iterator[tuple[int, bytes | None]]:
    """(place, text) of the features that begin in a split; None for an element that is no object."""
    with open_file(path) as source:
        backslashes = _escaped_before(source, begin) if inside else 0
        source.seek(begin)
        raw = source.read(max(0, stop - begin))
        data = np.frombuffer(raw, np.uint8)
        places, after, _ = structure(data, inside, backslashes)
        after = after + depth
        closed = np.flatnonzero((after == 1) & (data[places] == ARRAY_END))
        limit = int(places[closed[0]]) if len(closed) else len(raw)
        opens = np.flatnonzero((data[places] == OPEN[0]) & (after == 3) & (places < limit))
        shuts = np.flatnonzero((data[places] == CLOSE[0]) & (after == 2) & (places < limit))
        # Without an opening of its own before it, the first closing belongs to a feature of an earlier split.
        at = 0 if depth == 2 and not inside else int(places[shuts[0]]) + 1 if len(shuts) else limit
        shuts = places[shuts].tolist()
        k = int(depth > 2 or inside)
        for o in places[opens].tolist():
            if raw[at:o].strip(b" \t\r\n,"):
                yield begin + at, None
            if k < len(shuts):
                at = shuts[k] + 1
                yield begin + o, raw[o:at]
                k += 1
            else:
                yield begin + o, _to_end(source, path, raw[o:], begin + len(raw))
                at = limit
        if raw[at:limit].strip(b" \t\r\n,"):
            yield begin + at, None


def _to_end(source: pa.NativeFile, path: str, text: bytes, at: int) -> bytes:
    """A feature whose end is beyond its split: read on until it closes."""
    source.seek(at)
    seen, depth, inside, backslashes = 0, 0, False, 0
    while True:
        new = np.frombuffer(text, np.uint8)[seen:]
        places, after, ends_inside = structure(new, inside, backslashes)
        done = np.flatnonzero(after + depth == 0)
        if len(done):
            return text[: seen + int(places[done[0]]) + 1]
        depth += int(after[-1]) if len(after) else 0
        inside, seen = ends_inside, len(text)
        backslashes = len(text) - len(text.rstrip(b"\\"))
        more = source.read(MORE_BYTES)
        if not more:
            raise ValueError(f"{path} ends inside a feature")
        text += more


def _plan(spark: SparkSession, path: str, split_bytes: int) -> tuple[list[tuple], list[tuple[str, bool]]]:
    splits = [(uri, at, min(at + split_bytes, size)) for uri, size in listed(spark, path) for at in range(0, max(size, 1), split_bytes)]

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _map(row["path"], row["start"], row["stop"])
                yield pa.RecordBatch.from_pylist([{**row, "map": json.dumps(list(found.values()))}])

    frame = spark.createDataFrame(splits, "path string, start long, stop long").repartition(max(1, len(splits)), "path", "start")
    rows = frame.mapInArrow(summarise, "path string, start long, stop long, map string").collect() if splits else []
    restored = []
    for r in sorted(rows):
        maps = json.loads(r.map)
        for one in [m for side in maps for m in (side, *side["members"])]:
            one["objects"] = {int(k): v for k, v in one["objects"].items()}
        restored.append((r.path, r.start, r.stop, {False: maps[0], True: maps[1]}))
    return _split_plan(restored)


def feature_texts(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """(file, position, text) of every feature, and (file, whether its type is right) of every file.

    Position counts the features of a file from 0. An element of the features that is no object has a null text
    and the position of what follows it.
    """
    plan, types = _plan(spark, path, split_bytes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                position, held, size = row["position"], [], 0
                for _, text in _features(row["file"], row["begin"], row["stop"], row["inside"], row["depth"]):
                    held.append({"file": row["file"], "position": position, "text": None if text is None else text.decode()})
                    position, size = position + (text is not None), size + len(text or b"")
                    if size > MORE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)

    SCHEMA = pa.schema([("file", pa.string()), ("position", pa.int64()), ("text", pa.string())])
    frame = spark.createDataFrame(plan, "file string, begin long, stop long, inside boolean, depth long, position long")
    dealt = frame.repartition(max(1, len(plan)), "file", "begin")
    return dealt.mapInArrow(read, "file string, position long, text string"), types
