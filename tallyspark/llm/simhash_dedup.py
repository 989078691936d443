"""SimHash near-dedup: segment-popcount embedding, grid range-join under Manhattan distance, exact check.

A fingerprint is the majority vote, bit by bit, of the 64-bit hashes of a text's word shingles.
Fingerprints that differ in at most ``radius`` bits are linked; a component is what links reach.

*Embedding.* The 64 bits are 32 segments of two; a fingerprint is mapped to its 32 bit counts.
Flipping a bit changes one count by one, so the Manhattan distance of two embeddings never exceeds
the Hamming distance of their fingerprints. Counts are kept in unary (00, 01, 11), so that the
Manhattan distance is the number of differing bits of two packed embeddings.

*Grid range-join.* The segments form ``radius + 3`` groups. If two embeddings are within
``radius``, at least three groups have no difference at all. Each fingerprint is therefore dealt
into one grid for every choice of three groups, and its cell is its counts there; all pairs within
reach meet in a cell of some grid. Two random fingerprints agree in a segment with probability 3/8,
so they share a cell of 16 segments with 2^-22.6, as is measured too, and as counts of one are the
likeliest, the fullest cell holds 2^-16 of all. Inside a cell, pairs within the Manhattan bound are
verified on the fingerprints.

*Hot cells.* Only distinct fingerprints take part, so exact copies cost nothing. A cell with more
than ``block`` fingerprints is dealt into grids again, over the segments that its key leaves free:
the same argument holds for them, so no pair is lost, and a fingerprint costs 20 rows there however
full the cell is. What is still fuller than a block is cut into blocks, and every pair of blocks is
a work item of its own, so none is larger than two blocks. An item returns a spanning forest of its
links, at most one per fingerprint, never all pairs. Counts of cells, smallest neighbours and names
of components are cut off in the shared folder before they are joined, so that each join has a
shuffle of its own on either side and Spark can split a hot cell, centre or component.

*Components.* Links are dealt into partitions of about ``PER_TASK``; each is contracted to a spanning
forest by union-find in its task. Alternating large-star and small-star rounds follow until the links
are proven to be stars, each node once under a root that is under none; they move only ids, and none is
needed where one task has seen all links. Each round is cut off in the shared checkpoint folder.

Defined cases: a null text counts as empty; a text without words has fingerprint 0 and is linked
like any other; a text of any length is read whole, its shingles ``CHUNK`` at a time; fewer words than a shingle make one shingle; rows with a null id get a fingerprint
and a component but never name one (a component without any id is null); repeated rows repeat in
the result; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: The low bit of every segment of two.
LOW = 0x5555555555555555
#: Shingles whose hashes are held at once.
CHUNK = 200_000
#: Most fingerprints in a block of a hot cell; a work item holds two blocks.
BLOCK = 1024
#: Links that a task contracts, about.
PER_TASK = 1_000_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority of the shingles' hashes, unsigned; 0 without words."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    first, last = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(first), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return docs.select(id_col, of(text_col).alias("fp"))


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, in unary, packed into a long."""
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(F.lit(LOW))
    return high.bitwiseOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))


def grids(radius: int = 3, segments: list[int] = list(range(32))) -> list[int]:  # noqa: B006
    """The bits of the embedding that make the cell, for each grid over these segments (signed)."""
    cuts = np.linspace(0, len(segments), radius + 4).round().astype(int)
    groups = [sum(3 << 2 * s for s in segments[a:b]) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(x) for x in combinations(groups, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _unary(fp: np.ndarray) -> np.ndarray:
    high, low = fp >> np.uint64(1) & np.uint64(LOW), fp & np.uint64(LOW)
    return high | low | (high & low) << np.uint64(1)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that the links (a, b) reach."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(before, root):
            break
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``fps``: pairs (fingerprint, smallest of its tree)."""
    near = np.bitwise_count(_unary(fps)[:, None] ^ _unary(fps)[None, :]) <= radius
    a, b = np.nonzero(near)
    keep = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]) <= radius)
    a, b = a[keep], b[keep]
    root = _roots(a, b, len(fps))
    other = np.nonzero(root != np.arange(len(fps)))[0]
    return fps[other], fps[root[other]]


def _links_of(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of whole items; rows of an item are adjacent. Small items go together, large ones singly."""
    edge = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(fps)]))
    size = ends - starts
    left, right = [], []
    item = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero(np.repeat(size <= 8, size))
    for step in range(1, 8):
        a = small[small + step < len(fps)]
        a = a[item[a] == item[a + step]]
        x, y = fps[a], fps[a + step]
        ok = np.bitwise_count(_unary(x) ^ _unary(y)) <= radius
        ok &= np.bitwise_count(x ^ y) <= radius
        left.append(x[ok])
        right.append(y[ok])
    for i in np.flatnonzero(size > 8):
        x, y = _forest(np.unique(fps[starts[i] : ends[i]]), radius)
        left.append(x)
        right.append(y)
    return left, right


def items(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(_grid, _cell, _sub, _subcell, _i, _j, fp): the work items, each of the fingerprints of one or two blocks."""
    masks = grids(radius)
    place = embedding(F.col("fp"))
    cells = distinct.select("fp", F.posexplode(F.array([place.bitwiseAND(F.lit(m)) for m in masks])).alias("_grid", "_cell"))
    crowded = durable(cells.groupBy("_grid", "_cell").agg(F.count("*").alias("_n")).where(F.col("_n") > 1))
    names = ["_grid", "_cell", "_sub", "_subcell", "_i", "_j", "fp"]
    none = F.lit(0).cast("long")
    out = cells.join(crowded.where(F.col("_n") <= block), ["_grid", "_cell"]).select("_grid", "_cell", F.lit(-1).alias("_sub"), none.alias("_subcell"), F.lit(0).alias("_i"), F.lit(0).alias("_j"), "fp")
    hot = crowded.where(F.col("_n") > block).select("_grid", "_cell")
    if hot.isEmpty():
        return out
    free = [[s for s in range(32) if not m >> 2 * s & 3] for m in masks]
    finer = F.array([F.array([F.lit(m) for m in grids(radius, own)]) for own in free])
    again = cells.join(hot, ["_grid", "_cell"]).select("_grid", "_cell", "fp", F.posexplode(F.element_at(finer, F.col("_grid") + 1)).alias("_sub", "_mask"))
    again = again.select("_grid", "_cell", "_sub", place.bitwiseAND(F.col("_mask")).alias("_subcell"), "fp")
    key = ["_grid", "_cell", "_sub", "_subcell"]
    full = durable(again.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = again.join(full, key).select(*key, "fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    return out.union(pairs.select(*key, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "fp").select(*names))


def links(distinct: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) whose components are those of all links."""
    key = ["_grid", "_cell", "_sub", "_subcell", "_i", "_j"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(key) + 1), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(len(key) + 1)])
                held = np.concatenate((held, rows))
                whole = int(np.flatnonzero(np.any(held[:, :-1] != held[-1, :-1], axis=1))[-1:].sum() + 1) if len(held) and np.any(held[0, :-1] != held[-1, :-1]) else 0
            else:
                whole = len(held)
            if whole:
                left, right = _links_of(held[:whole, :-1], held[:whole, -1].copy().view(np.uint64), radius)
                held = held[whole:]
                a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    dealt = items(distinct, radius, block).repartition(*key).sortWithinPartitions(*key, "fp").select(*(F.col(c).cast("long").alias(c) for c in key), "fp")
    return dealt.mapInArrow(find, "a long, b long")


def _contracted(pairs: DataFrame, parts: int) -> DataFrame:
    """(a, b): a spanning forest of each partition's links, every node joined to the smallest of its tree."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        if held:
            nodes, place = np.unique(np.concatenate([np.concatenate(x) for x in zip(*held)]), return_inverse=True)
            one, other = np.split(place, 2)
            root = _roots(one, other, len(nodes))
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], ["a", "b"])

    dealt = pairs.repartition(parts, "a", "b") if parts > 1 else pairs.coalesce(1)  # one partition even where counts of keyed shuffles are raised
    return dealt.mapInArrow(forest, "a long, b long")


def finished(pairs: DataFrame) -> bool:
    """Whether the links (a, b) are stars: every node a stands once, and none is a root b too. Then each star is a whole component."""
    ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("up")).union(pairs.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return seen.where((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))).isEmpty()


def components(links: DataFrame, per_task: int = PER_TASK) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, for every node of a link but the roots."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Large: each neighbour above a node joins the smallest of the node's neighbourhood. Small: each below it, and the node."""
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        low = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        met = both.join(low, "a")
        if large:
            return met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()

    pairs = durable(links.select("a", "b").where(F.col("a") != F.col("b")))
    parts = max(1, -(-pairs.count() // per_task))
    pairs = durable(_contracted(pairs, parts))
    while not finished(pairs):
        pairs = durable(star(durable(star(pairs, True)), False))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id: the smallest id reachable) for every row."""
    prints = durable(fingerprints(docs, id_col, text_col, words))
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("_first"))
    spread = distinct.select("fp").repartition(docs.sparkSession.sparkContext.defaultParallelism, "fp")  # every fingerprint becomes a row per grid
    root = components(links(spread, radius))
    placed = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    placed = durable(placed)
    names = durable(placed.groupBy("_root").agg(F.min("_first").alias("component_id")))
    named = placed.join(names, "_root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named, "fp").select(id_col, hexed.alias("fingerprint"), "component_id")
