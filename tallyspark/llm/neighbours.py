"""Approximate nearest neighbours by learned partitions.

*Fit*, on a bounded sample (about ``SAMPLE`` vectors, or ``PER_PART`` for each partition where that
is more, chosen by a hash): a graph links each sampled vector to its nearest; recursive bisection
along the graph's second eigenvector, refined by swaps, cuts it into balanced partitions; a small
softmax classifier learns from a vector how its neighbours are spread over the partitions. Their
number is the power of two nearest to sqrt(rows) / 2, 16 at least, at every size by the same rule.

*Index*: every vector goes to its most probable partition. *Search*: a query goes to its most
probable partitions and is reranked there exactly. How many is measured, not guessed: ``ASKED`` of
the table's own queries are compared with every row, and all queries take as many partitions as
those need for ``TARGET`` recall of their k nearest; a query whose partitions hold too few rows goes
on down its ranking.

*Copies.* A vector's copies all tie, and ties go to smaller ids, so its k + 1 smallest ids stand for
all of them, and queries of one vector are one search for k + 1; each then leaves out its own row.
A group of copies that holds a third of all rows is thus a few rows before anything is compared.

*Blocks.* A partition is cut into blocks of about ``BASE_BLOCK`` rows. The table is shuffled once:
the queries move to the blocks, and stream past a block in batches. A copy of a query meets a whole
block, so what is moved is small beside what is computed.

Nearness is the inner product in double precision, summed from the first component to the last;
ties go to the smaller id. Products of a block pick candidates with a margin far above rounding,
and only then is the exact sum taken, so that copies tie exactly.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components take
no part; one that is shorter than the longest counts as if zeros followed; rows without an id take
no part; a candidate with the query's id is the query's own; rows that repeat an id and a vector
are one, rows that repeat an id with other vectors are candidates each, but one query (the smallest
vector); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, slices, wide_hash

SAMPLE, PER_PART, TARGET, GRAPH_DEGREE, SEED = 4096, 32, 0.96, 10, 8
#: Queries whose exact neighbours decide how many partitions are probed.
ASKED = 128
#: Rows of the table in a block, about.
BASE_BLOCK = 16384
#: Products held at once.
AT_ONCE = 1 << 22
#: Sampled vectors of one step of the classifier's training.
BATCH = 4096


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """The vectors as rows, zeros after the shorter ones."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(lists) * dims:
        return flat.reshape(len(lists), dims)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    out[np.arange(dims) < sizes[:, None]] = flat
    return out


def neighbour_graph(x: np.ndarray, degree: int = GRAPH_DEGREE) -> np.ndarray:
    """For each vector its nearest others."""
    out = np.zeros((len(x), min(degree, len(x) - 1)), np.int64)
    for at in range(0, len(x), 512):
        score = x[at : at + 512] @ x.T
        score[np.arange(len(score)), at + np.arange(len(score))] = -np.inf
        out[at : at + 512] = np.argpartition(-score, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def balanced_partition(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Partition of a neighbour graph into ``parts`` (a power of two) of equal size, give or take one."""
    n, degree = graph.shape
    src, dst = np.repeat(np.arange(n), degree), graph.ravel()
    src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
    label = np.zeros(n, np.int64)
    while label.max(initial=0) + 1 < parts:
        v = rng.normal(size=n)
        own = label[src] == label[dst]
        a, b = src[own], dst[own]
        weight = np.bincount(a, minlength=n) + 1e-9
        size = np.bincount(label)
        for _ in range(60):  # the second eigenvector of each part's walk
            v -= (np.bincount(label, weights=v * weight) / np.bincount(label, weights=weight))[label]
            v = 0.5 * v + 0.5 * np.bincount(a, weights=v[b], minlength=n) / weight
            v /= np.sqrt(np.bincount(label, weights=v * v) / size)[label] + 1e-12
        order = np.lexsort((v, label))
        rank = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        side = np.zeros(n, np.int64)
        side[order] = rank >= np.repeat(size // 2, size)
        for _ in range(20):  # swap the vertices that gain most, as many from either side
            gain = np.bincount(a, weights=np.where(side[a] != side[b], 1, -1), minlength=n)
            willing = np.flatnonzero(gain > 0)
            group = 2 * label[willing] + side[willing]
            order = np.lexsort((-gain[willing], group))
            willing, group = willing[order], group[order]
            count = np.bincount(group, minlength=2 * len(size))
            most = np.minimum(count[0::2], count[1::2]) // 2
            place = np.arange(len(group)) - (np.cumsum(count) - count)[group]
            moved = willing[place < most[group // 2]]
            side[moved] = 1 - side[moved]
            if not len(moved):
                break
        label = 2 * label + side
    return label


class Router:
    """A softmax classifier from vectors to partitions; once fitted, also how many to probe and how many rows each holds."""

    def __init__(self, parts: int, dims: int):
        self.parts, self.dims, self.w, self.b = parts, dims, np.zeros((dims, parts)), np.zeros(parts)
        self.probes, self.rows = parts, np.zeros(parts, np.int64)

    def train(self, x: np.ndarray, labels: np.ndarray, rng: np.random.Generator, steps: int = 250, rate: float = 0.1) -> None:
        """``labels``: for each row of x the partitions of its neighbours, itself included."""
        m, s = [np.zeros_like(p) for p in (self.w, self.b)], [np.zeros_like(p) for p in (self.w, self.b)]
        for t in range(1, steps + 1):
            some = np.arange(len(x)) if len(x) <= BATCH else rng.choice(len(x), BATCH, replace=False)
            y = np.zeros((len(some), self.parts))
            np.add.at(y, (np.repeat(np.arange(len(some)), labels.shape[1]), labels[some].ravel()), 1 / labels.shape[1])
            z = x[some] @ self.w + self.b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - y) / len(some)
            for k, (param, g) in enumerate(((self.w, x[some].T @ d + 1e-5 * self.w), (self.b, d.sum(axis=0)))):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                param -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-(x @ self.w + self.b), axis=1, kind="stable").astype(np.int32)

    def homes(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(x @ self.w + self.b, axis=1).astype(np.int32)

    def probed(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        """The partitions that each query visits: ``probes``, more if they hold no more than k rows, none that is empty."""
        order = self.ranked(x)
        held = np.cumsum(self.rows[order], axis=1)
        upto = np.maximum((held <= k).sum(axis=1) + 1, self.probes)
        return [o[:n][self.rows[o[:n]] > 0] for o, n in zip(order, upto.tolist())]


def partitions(rows: int) -> int:
    """The power of two nearest to sqrt(rows) / 2, 16 at least."""
    return 1 << max(4, round(np.log2(max(rows, 1)) / 2 - 1))


def fit(sample: np.ndarray, parts: int) -> Router:
    """Partitions of the sample's neighbour graph, and the classifier that routes to them."""
    sample = np.unique(sample, axis=0)
    router = Router(parts, sample.shape[1])
    if len(sample) <= parts:
        return router
    rng = np.random.default_rng(SEED)
    sample = sample[rng.permutation(len(sample))]
    graph = neighbour_graph(sample)
    label = balanced_partition(graph, parts, rng)
    scale = 1 / max(float(np.sqrt((sample**2).sum(axis=1).mean())), 1e-300)
    router.train(sample * scale * np.sqrt(router.dims), label[np.column_stack((np.arange(len(sample)), graph))], rng)
    router.w *= scale * np.sqrt(router.dims)
    return router


def probes_needed(router: Router, queries: np.ndarray, query: np.ndarray, home: np.ndarray, target: float) -> int:
    """How many partitions give ``target`` recall, where (query, home) say where the exact neighbours of the queries are."""
    if not len(query):
        return 1
    place = np.argsort(router.ranked(queries), axis=1)[query, home]
    recall = np.cumsum(np.bincount(place, minlength=router.parts)) / len(place)
    return int(np.argmax(recall >= target - 1e-9)) + 1


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by falling score and rising id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[keep], vec[keep], score[keep]


def top_of_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k nearest in the block; ``own``: the id that a query leaves out, below 0 for none."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norms = np.sqrt((x**2).sum(axis=1)).max(initial=0.0)
    step = max(1, AT_ONCE // max(len(x), 1))
    for at in range(0, len(q), step):
        part, asked = q[at : at + step], query_ids[at : at + step]
        score = part @ x.T
        if own is not None:
            for i in np.flatnonzero(own[at : at + step, 0] != 0):
                score[i, ids == own[at + i, 1]] = -np.inf
        if len(x) > k:
            least = np.partition(score, len(x) - k, axis=1)[:, len(x) - k]
        else:
            least = np.full(len(part), -np.inf)
        margin = 1e-12 * x.shape[1] * norms * np.sqrt((part**2).sum(axis=1))
        a, b = np.nonzero((score >= (least - margin)[:, None]) & (score > -np.inf))
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for cut in range(0, len(a), 1 << 16):  # the exact sums, from the first component to the last; each piece leaves k of a query, however many tie
            i, j = a[cut : cut + (1 << 16)], b[cut : cut + (1 << 16)]
            piece = (asked[i], ids[j], np.cumsum(part[i] * x[j], axis=1)[:, -1])
            held = _best(*(np.concatenate(c) for c in zip(held, piece)), k)
        found.append(held)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _best(*(np.concatenate(c) for c in zip(*found)), k)


def _search(batches: Iterator[pa.RecordBatch], dims: int, k: int) -> Iterator[pa.RecordBatch]:
    """Queries against blocks; rows (part, block, asks, id, v, own) sorted, so that a block comes before its queries."""
    item, blocks, base = None, [], None
    for batch in slices(batches, 4096):
        keys = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)])
        ids = batch.column(3).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a == b:
                continue
            if item != (now := tuple(keys[a, :2])):
                item, blocks, base = now, [], None
            x = _matrix(batch.column(4).slice(a, b - a), dims)
            if not keys[a, 2]:
                blocks.append((ids[a:b], x))
            elif blocks:
                base = base or tuple(np.concatenate(c) for c in zip(*blocks))
                own = batch.column(5).slice(a, b - a)
                mine = np.column_stack((own.is_valid().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
                q, i, s = top_of_block(*base, ids[a:b], x, k, mine if mine[:, 0].any() else None)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["qid", "id", "score"])


def _calibrated(router: Router, base: DataFrame, queries: DataFrame, k: int, target: float) -> int:
    """Partitions to probe, from the exact neighbours of some queries (qid, v) among all rows (id, v, part)."""
    n = queries.count()
    some = queries.where(F.pmod(F.xxhash64("qid", F.lit(2)), F.lit(1 << 30)) < int(min(1.0, ASKED / max(n, 1)) * (1 << 30))).limit(2 * ASKED).select("v").toArrow()
    q = _matrix(some.column("v"), router.dims)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            x = _matrix(batch.column(0), router.dims)
            part = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            near, at, score = top_of_block(np.arange(len(x)), x, np.arange(len(q)), q, k + 1)
            other = ~np.all(x[at] == q[near], axis=1)  # a query's own copies are where it looks first, and prove nothing
            near, at, score = near[other], at[other], score[other]
            held = list(_best(*(np.concatenate(c) for c in zip(held, (near, part[at], score))), k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], ["q", "part", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    near = base.select("v", "part").mapInArrow(exact, "q long, part long, score double").withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("q", "part").toArrow()
    return probes_needed(router, q, near.column("q").to_numpy(), near.column("part").to_numpy(), target)


def items(base: DataFrame, queries: DataFrame, router: Router, k: int, block: int) -> DataFrame:
    """(part, block, asks, id, v, own): every row of the table once, in its block; every query once for each block that it visits."""
    model = base.sparkSession.sparkContext.broadcast(router)

    @F.arrow_udf("array<int>")
    def visited(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            parts = model.value.probed(_matrix(v, model.value.dims), k) if len(v) else []
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))

    count = F.element_at(F.array([F.lit(int(max(1, -(-n // block)))) for n in router.rows]), F.col("part") + 1)
    own = base.select("part", F.pmod(F.xxhash64("row"), count).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v", F.lit(None).cast("long").alias("own"))
    asked = queries.select(F.explode(visited("v")).alias("part"), "qid", "v", "own")
    return own.unionByName(asked.select("part", F.explode(F.sequence(F.lit(0), count - 1)).alias("block"), F.lit(1).alias("asks"), F.col("qid").alias("id"), "v", "own"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET, block: int = BASE_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for every row that ``is_query`` marks."""
    spark = vectors.sparkSession
    h1, h2 = wide_hash(F.col("v"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = rows.withColumns({"h1": h1, "h2": h2})
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    count, dims = facts["n"], facts["d"] or 1
    parts = partitions(count)
    wanted = max(sample, PER_PART * parts)
    share = int(min(1.0, wanted / max(count, 1)) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < share).select("v").limit(2 * wanted).toArrow()
    router = fit(_matrix(chosen.column("v"), dims), parts)
    model = spark.sparkContext.broadcast(router)

    @F.arrow_udf("int")
    def home(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            yield pa.array(model.value.homes(_matrix(v, model.value.dims)) if len(v) else [], pa.int32())

    copies = Window.partitionBy("h1", "h2").orderBy("id")
    single = rows.groupBy("id", "h1", "h2").agg(F.first("v").alias("v"))
    standing = single.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    base = durable(standing.select("id", "v", home("v").alias("part"), F.monotonically_increasing_id().alias("row")))
    for r in base.groupBy("part").agg(F.count("*").alias("n")).collect():  # as many rows as partitions
        router.rows[r["part"]] = r["n"]

    # a query of its own where its id has several vectors, else one for all queries of a vector
    asking = rows.where("asks").groupBy("id").agg(F.min("v").alias("v"), (F.min("h1") != F.max("h1")).alias("many"))
    asking = durable(asking.withColumns({"h1": h1, "h2": h2, "own": F.when(F.col("many"), F.col("id"))}))
    queries = durable(asking.groupBy("h1", "h2", "own").agg(F.first("v").alias("v")).withColumn("qid", F.monotonically_increasing_id()))
    router.probes = _calibrated(router, base, queries, k, target)

    key = ["part", "block", "asks"]
    dealt = items(base, queries, router, k, block).repartition("part", "block").sortWithinPartitions(*key)
    found = dealt.select(*key, "id", "v", "own").mapInArrow(lambda batches: _search(batches, dims, k + 1), "qid long, id long, score double")
    nearer = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = found.withColumn("n", F.row_number().over(nearer)).where(F.col("n") <= k + 1).join(queries.select("qid", "h1", "h2", "own"), "qid")
    named = asking.select(F.col("id").alias("query_id"), "h1", "h2", F.col("own").alias("_own"))
    pairs = found.join(named, (found["h1"] == named["h1"]) & (found["h2"] == named["h2"]) & F.col("own").eqNullSafe(F.col("_own"))).where(F.col("id") != F.col("query_id"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.select("query_id", "id", "score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
