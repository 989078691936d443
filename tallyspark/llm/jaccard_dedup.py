"""Near-duplicates: op1's segment-popcount grid range-join at a wide radius picks candidates, shingle sets decide.

Two texts are linked if the sets of their ``words``-word shingles have a Jaccard similarity of at
least ``SIMILARITY``; a component is what links reach.

*Fingerprints.* A set's SimHash has ``WIDTH`` times 64 bits, each the majority over the shingles. At a similarity of 0.8
the angle of two sets is at most acos(8 / 9), so ``NEAR`` = 15 % of the bits differ, whereas half do in unrelated texts.
As in ``simhash_dedup``, every two bits are a segment, mapped to its bit count in unary.

*Grid range-join.* A grid's cell is the counts of some segments, drawn at random. At this radius no choice of groups
is complete with fewer than a thousand grids, so there are as many grids as leave a pair at 0.8 without a common cell with a
probability of ``MISS``; a closer pair with less. The more texts, the more segments make a cell, so that
a cell of unrelated texts stays within a block. In a cell, pairs within ``RADIUS`` of the first ``SHOWN`` words under the
Manhattan bound are verified on the fingerprints. An item returns a spanning forest of these and each text's nearest one, never
all pairs. *Hot cells.* A fuller cell compares every member with one centre first; then its blocks are compared in
pairs, but for those of its largest component with each other.

*Exact check.* Nearest pairs are decided on the sets. *Rest.* What the forests join but
the sets so far do not takes part in a prefix join: the shingles of each, the rarest first,
are cut to as many as leave a set at 0.8 no room outside them, so that two similar sets share one of
these. Texts that share much boilerplate but stay below 0.8 share frequent shingles only, which come
last, and do not meet. Who shares such a shingle across components is compared, in blocks of bounded size: each key has
one block, each pair of blocks is one item however many shingles it shares, and none lies in one component alone, so
that a few strays in a large group cost a comparison each per member. An item holds its texts once.

Defined cases: words are those of ``simhash_dedup``; a null text counts as empty; texts without words
are copies of each other; fewer words than a shingle make one shingle; rows with a null id get a
component but never name one (a component without any id is null); repeated rows repeat in the
result; an empty table gives an empty table; other columns are ignored. A text is known by a 64-bit
hash, and so is a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, give_back, slices
from .simhash_dedup import SEED, WORD, _roots, _unary, components

WORDS, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint; those that are compared; most bits of these that may differ: 4.6 deviations above the mean at 0.8.
WIDTH, SHOWN, RADIUS = 4, 3, 52
#: Share of bits that differ at 0.8; share of such pairs that may meet in no cell.
NEAR, MISS = 0.1516, 1e-4
#: Most texts in a block, about; a work item holds two blocks.
BLOCK = 256
#: A block of fingerprints is so many times as large as one of texts.
PRINTS = 16
#: Shingles whose hashes are mixed at once; rows of a cell that are compared with it at once; pairs that are held before they are contracted.
CHUNK, ROWS, HELD = 4096, 64, 1_000_000
#: Most hot cells that are broadcast.
FEW = 20_000

_rng = np.random.default_rng(SEED)
_ADDED = _rng.integers(0, 1 << 64, WIDTH, np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the shingles, rising."""
    found = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    first, last, digest = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), np.uint64, len(first)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WIDTH`` words whose bits are the majority of the shingles'; zero without any."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(hashes), CHUNK):
        mixed = _mix(hashes[at : at + CHUNK, None] + _ADDED)
        counts += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def missed(segments: int, many: int) -> float:
    """Expected share of pairs at 0.8 that meet in none of so many cells, over the spread of the bits that differ."""
    bits = 64 * WIDTH
    likely = np.array([comb(bits, d) * NEAR**d * (1 - NEAR) ** (bits - d) for d in range(bits + 1)])
    differ = np.arange(bits + 1) / bits
    return float(likely @ (1 - ((1 - differ) ** 2 + differ**2 / 2) ** segments) ** many)


def grids(n: int, block: int) -> np.ndarray:
    """(grids, WIDTH): the bits of the embedding that make the cell, for ``n`` texts."""
    segments = max(0, ceil(log(max(1.0, 2 * n / block)) / log(8 / 3)))  # two unrelated segments are equal with 3/8
    many = 1
    while missed(segments, many) > MISS:
        many += 1
    rng, masks = np.random.default_rng(SEED), np.zeros((many, WIDTH), np.uint64)
    for g in range(many):
        for k in rng.choice(32 * WIDTH, segments, replace=False).tolist():
            masks[g, k // 32] |= np.uint64(3 << 2 * (k % 32))
    return masks


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sets of distinct rising hashes have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.sort(np.concatenate((a, b)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared) - 1e-9


_F = [f"f{k}" for k in range(WIDTH)]


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """(key, f0 ..) of each distinct text."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in slices(batches, 1024):
            flat = [fingerprint(shingle_set(t.as_py(), words)) for t in texts]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WIDTH), pa.array(np.concatenate([*flat, np.zeros(0, np.uint64)]).view(np.int64)))
        give_back()

    first = docs.select("key", of("text").alias("f")).groupBy("key").agg(F.first("f").alias("f"))
    return first.select("key", *(F.col("f")[k].alias(c) for k, c in enumerate(_F)))


def deal(prints: DataFrame, masks: np.ndarray) -> DataFrame:
    """(cell, key, f0 .. of the words shown): a row for every grid."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            key, *words = (batch.column(k).to_numpy() for k in range(1 + WIDTH))
            cell = np.broadcast_to(_mix(np.arange(1, len(masks) + 1, dtype=np.uint64) * _ODD), (len(key), len(masks)))
            for k, word in enumerate(words):
                cell = _mix((cell ^ _unary(word.view(np.uint64))[:, None] & masks[:, k]) * _ODD)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64).ravel()), *(pa.array(np.repeat(x, len(masks))) for x in (key, *words[:SHOWN]))], ["cell", "key", *_F[:SHOWN]])

    return prints.select("key", *_F).mapInArrow(cells, ", ".join(f"{c} long" for c in ("cell", "key", *_F[:SHOWN])))


def close(prints: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, whether b is nearest to a): places of rows within the radius, nearest ones and a spanning forest; between the two sides, or inside the only one."""
    place, n = _unary(prints), len(prints)
    one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    alone = not len(two)
    two = one if alone else two
    best, who = np.full(n, 255, np.int64), np.zeros(n, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(one), ROWS):
        x, y = one[at : at + ROWS], two[at:] if alone else two
        apart = reduce(np.add, (np.bitwise_count(place[x, k][:, None] ^ place[y, k]) for k in range(SHOWN)))  # the Manhattan distance
        i, j = np.nonzero(apart <= RADIUS)
        if alone:
            i, j = i[j > i], j[j > i]
        a, b = x[i], y[j]
        differ = np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int64)
        near = differ <= RADIUS
        a, b, differ = a[near], b[near], differ[near]
        if not len(a):
            continue
        ends, other, far = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((differ, differ))
        order = np.lexsort((other, far, ends))
        end, first = np.unique(ends[order], return_index=True)
        better = far[order[first]] < best[end]
        best[end[better]], who[end[better]] = far[order[first]][better], other[order[first]][better]
        held.append((a, b))
        if sum(len(x) for x, _ in held) > HELD:
            root = _roots(*(np.concatenate(x) for x in zip(*held)), n)
            held = [(np.arange(n), root)]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    root = _roots(*(np.concatenate(x) for x in zip(*held)), n)
    moved, hit = np.flatnonzero(root != np.arange(n)), np.flatnonzero(best < 255)
    return np.concatenate((hit, moved)), np.concatenate((who[hit], root[moved])), np.arange(len(hit) + len(moved)) < len(hit)


_ITEM = ["cell", "_i", "_j", "_side", "key", *_F[:SHOWN]]


def _candidates(items: DataFrame) -> DataFrame:
    """(a, b, near) of the work items ``_ITEM``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, len(_ITEM)), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate((held, np.column_stack([c.to_numpy() for c in batch.columns])))
            edge = np.flatnonzero(np.any(held[1:, :3] != held[:-1, :3], axis=1)) + 1
            ends = [*edge.tolist(), *([len(held)] if batch is None and len(held) else [])]  # the last item may go on
            found = []
            for at, upto in zip([0, *ends], ends):
                if upto - at > 1:
                    a, b, near = close(held[at:upto, 5:].copy().view(np.uint64), held[at:upto, 3])
                    found.append((held[at:upto, 4][a], held[at:upto, 4][b], near))
            if ends:
                held = held[ends[-1] :].copy()
            if found:
                a, b, near = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], ["a", "b", "near"])
        give_back()

    dealt = items.select(*(F.col(c).cast("long").alias(c) for c in _ITEM)).repartition("cell", "_i", "_j").sortWithinPartitions("cell", "_i", "_j", "_side", "key")
    return dealt.mapInArrow(find, "a long, b long, near boolean")


def _hot_items(members: DataFrame, root: DataFrame, block: int) -> DataFrame:
    """``_ITEM`` of the cells with more than a block: pairs of blocks, but for those inside the cell's largest component."""
    root = root.select(F.col("node").alias("key"), "root")
    named = durable(members.join(root, "key", "left").withColumn("root", F.coalesce("root", "key")))
    roots = durable(named.groupBy("cell", "root").agg(F.count("*").alias("_m")))
    sizes = durable(roots.groupBy("cell").agg(F.max(F.struct("_m", F.col("root").alias("_main"))).alias("_big"), F.sum("_m").alias("_n")).select("cell", "_big.*", "_n").where(F.col("_m") < F.col("_n")))
    inner = F.col("root") == F.col("_main")
    outer_parts, inner_parts = (F.ceil(n / block).cast("int") for n in (F.col("_n") - F.col("_m"), F.col("_m")))
    part = F.when(inner, outer_parts + F.pmod(F.xxhash64("key"), inner_parts).cast("int")).otherwise(F.pmod(F.xxhash64("key"), outer_parts).cast("int"))
    others = F.sequence(F.lit(0), F.when(inner, outer_parts).otherwise(outer_parts + inner_parts) - 1)
    pairs = named.join(sizes, "cell").select("cell", "key", *_F[:SHOWN], part.alias("_own"), F.explode(others).alias("_other"))
    return pairs.select("cell", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "key", *_F[:SHOWN])


def one_of_each(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the wanted keys. Every task reduces copies to one before the shuffle, so that a group of copies is never gathered."""
    return rows.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) that are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, np.uint64)
        for batch in slices(batches):
            good = []
            for a, one, two in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if a != last:
                    last, own = a, shingle_set(one.as_py(), words)
                good.append(similar(own, shingle_set(two.as_py(), words), least))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
        give_back()

    one, two = (texts.select(F.col("key").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    return pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def prefixes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """(key, size, shingle): the rarest shingles of each text, as many as two similar sets must share one of."""

    @F.arrow_udf("array<long>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for one in whole.to_pylist():
                hashes = shingle_set(one, words).view(np.int64)
                yield pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes))

    each = durable(texts.select("key", shingles("text").alias("s")).select("key", F.size("s").alias("size"), F.explode("s").alias("shingle")))
    common = each.groupBy("shingle").agg(F.count("*").alias("_df"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("_df", "shingle"))
    room = F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1
    return each.join(common, "shingle").withColumn("_rank", rank).where(F.col("_rank") <= room).select("key", "size", "shingle")


def rest_items(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_a, _pa, _b, _pb, key, root, _side): each key once for every pair of blocks that its block is in, and on which side.

    members: (shingle, key, root), each row once. A key's block is a part of the keys that have its most shared
    shingle in common; those of the largest component there make blocks of their own. Two blocks are paired, once, if they
    share any shingle, unless one component holds both. All sizes are counted from these rows.
    """
    shared = members.groupBy("shingle").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    live = durable(members.join(shared.where(F.col("_low") != F.col("_high")).select("shingle", "_n"), "shingle").select("shingle", "key", "root", "_n"))
    led = durable(live.groupBy("key").agg(F.first("root").alias("root"), F.max(F.struct("_n", "shingle"))["shingle"].alias("_a")))
    roots = led.groupBy("_a", "root").agg(F.count("*").alias("_m"))
    sizes = durable(roots.groupBy("_a").agg(F.max(F.struct("_m", F.col("root").alias("_main"))).alias("_big"), F.sum("_m").alias("_n")).select("_a", "_big.*", "_n"))
    inner = F.col("root") == F.col("_main")
    outer_parts, inner_parts = (F.greatest(F.ceil(n / block), F.lit(1)).cast("int") for n in (F.col("_n") - F.col("_m"), F.col("_m")))
    part = F.pmod(F.xxhash64("key"), F.when(inner, inner_parts).otherwise(outer_parts)).cast("int") + F.when(inner, outer_parts).otherwise(0)
    placed = durable(led.join(sizes, "_a").select("key", "root", "_a", part.alias("_pa")))
    whole = placed.groupBy("_a", "_pa").agg(F.min("root").alias("_low"), F.max("root").alias("_high"))
    met = durable(live.select("shingle", "key").join(placed, "key").select("shingle", "_a", "_pa").distinct().join(whole, ["_a", "_pa"]))
    other = met.select("shingle", F.col("_a").alias("_b"), F.col("_pa").alias("_pb"), F.col("_low").alias("_low2"), F.col("_high").alias("_high2"))
    one = (F.col("_low") == F.col("_high")) & (F.col("_low2") == F.col("_high2")) & (F.col("_low") == F.col("_low2"))
    ordered = (F.col("_a") < F.col("_b")) | ((F.col("_a") == F.col("_b")) & (F.col("_pa") <= F.col("_pb")))
    pairs = durable(met.join(other, "shingle").where(ordered & ~one).select("_a", "_pa", "_b", "_pb").distinct())
    names = ["_a", "_pa", "_b", "_pb", "key", "root", "_side"]
    left = pairs.join(placed, ["_a", "_pa"]).withColumn("_side", F.lit(0)).select(*names)
    right = pairs.where((F.col("_a") != F.col("_b")) | (F.col("_pa") != F.col("_pb"))).join(placed.select("key", "root", F.col("_a").alias("_b"), F.col("_pa").alias("_pb")), ["_b", "_pb"])
    return left.union(right.withColumn("_side", F.lit(1)).select(*names))


def _rest(items: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Links (a, b) between components inside the items."""

    def compare(item: pa.Table) -> pa.Table:
        keys, roots, sides = (item.column(c).to_numpy() for c in ("key", "root", "_side"))
        sets = [shingle_set(t.as_py(), words) for t in item.column("text")]
        up: dict[int, int] = {r: r for r in roots.tolist()}

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        alone = not len(two)
        two = one if alone else two
        joined, size = np.concatenate([sets[j] for j in two]), np.array([len(sets[j]) for j in two])
        starts = np.cumsum(size) - size
        a, b = [], []
        for place, i in enumerate(one):
            at = np.searchsorted(sets[i], joined)
            at[at == len(sets[i])] = 0
            both = np.add.reduceat(sets[i][at] == joined, starts)
            near = both >= least * (len(sets[i]) + size - both) - 1e-9
            for j in two[np.flatnonzero(near)].tolist():
                if (not alone or j < i) and (x := top(int(roots[i]))) != (y := top(int(roots[j]))):
                    up[x] = y
                    a.append(int(keys[i]))
                    b.append(int(keys[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return items.join(texts, "key").groupBy("_a", "_pa", "_b", "_pb").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, component_id: the smallest id reachable, text_key, root_key) for every row.

    text_key is the hash of the row's text, root_key the smallest one of its component.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.xxhash64(text).alias("key"), text.alias("text"))
    prints = durable(_prints(rows, words))
    size = block * PRINTS
    cells = deal(prints, grids(prints.count(), size))
    hot = durable(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > size).select("cell"))
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    members = durable(cells.join(hot, "cell"))
    centre = members.groupBy("cell").agg(F.min(F.struct(F.xxhash64("key", "cell").alias("h"), "key", *_F[:SHOWN])).alias("c"))
    centre = durable(centre.select("cell", F.col("c.key").alias("a"), *(F.col("c")[c].alias(f"_{c}") for c in _F[:SHOWN])))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in _F[:SHOWN]), F.lit(0))
    star = durable(members.join(centre, "cell").where((F.col("key") != F.col("a")) & (differ <= RADIUS)).select("a", F.col("key").alias("b")).distinct())
    nodes = star.select(F.col("a").alias("key")).union(star.select("b")).distinct()
    root = components(_verified(star, durable(one_of_each(rows, nodes)), words, least))
    tied = root.select(F.col("node").alias("a"), F.col("root").alias("b"))
    plain = cells.join(hot, "cell", "left_anti").select("cell", *(F.lit(0).alias(c) for c in _ITEM[1:4]), *_ITEM[4:])
    found = durable(_candidates(plain.union(_hot_items(members, root, size))).distinct())
    pairs = durable(found.where("near").select("a", "b").distinct())
    texts = durable(one_of_each(rows, pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(nodes).distinct()))
    root = components(_verified(pairs, texts, words, least).union(tied))
    reach = components(found.select("a", "b").union(star).union(tied))
    reach = reach.select("node", F.col("root").alias("_reach")).union(reach.select("root", "root").distinct())
    named = durable(reach.join(root, "node", "left").select(F.col("node").alias("key"), "_reach", F.coalesce("root", "node").alias("root")))
    open_ = named.groupBy("_reach").agg(F.count("*").alias("_n"), F.min("root").alias("_low"), F.max("root").alias("_high")).where((F.col("_n") > 2) & (F.col("_low") != F.col("_high"))).select("_reach")
    strays = durable(named.join(open_, "_reach", "left_semi").select("key", "root"))
    held = durable(texts.join(strays.select("key"), "key", "left_semi"))
    items = rest_items(prefixes(held, words, least).join(strays, "key"), block)
    root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_rest(items, held, words, least)))
    ids = rows.groupBy("key").agg(F.min(id_col).alias("_first"))
    placed = durable(ids.join(root, ids["key"] == root["node"], "left").select("key", "_first", F.coalesce("root", "key").alias("_root")))
    names = durable(placed.groupBy("_root").agg(F.min("_first").alias("component_id")))
    named = placed.join(names, "_root").select("key", "component_id", F.col("_root").alias("root_key"))
    return rows.select(id_col, "key").join(named, "key").select(id_col, "component_id", F.col("key").alias("text_key"), "root_key")
