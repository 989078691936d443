"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

*Pieces.* A document's token ids, closed by an end id, are one piece; only documents longer than a
sequence are cut. Tokens come from the tokenizer itself; a worker remembers what a word became
(words are cut at white space, which this tokenizer never crosses), within a bound.

*Shards.* Pieces as long as a sequence are sequences already. The others are dealt at random into
shards of about ``SHARD`` pieces; the number of shards follows the count, at every size alike.

*Islands.* Each shard is bred on ``ISLANDS`` islands, in parallel tasks. An island starts from
best-fit-decreasing and perturbed variants. Crossover injects whole well-filled bins of one parent
into the other, dissolves the bins that hold a document twice, lets displaced documents take the place of one or two
that fill a bin worse, and best-fits the rest; mutation dissolves a few bins. After each epoch an island's best
packing migrates to the next island. An epoch ends when ``PATIENCE`` generations have brought nothing better, and at once at the lower bound.

*Second round.* Bins with notable slack are pooled over shards, dealt anew by whole bins, and bred
again starting from what they are, so that it can only improve.

Defined cases: a null or empty text is one piece that holds the end id alone; rows with a null id
or a repeated id are packed like others (each row gets its pieces); a text of any length is encoded
whole in one task, word by word, so a single word of many megabytes goes through the tokenizer at once;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import byte_characters
from .common import durable, give_back

CAPACITY, END_ID = 4096, 1
SHARD, ISLANDS, EPOCHS = 4096, 2, 2
#: An epoch ends after ``PATIENCE`` generations without a better packing, ``GENERATIONS`` at most.
POPULATION, GENERATIONS, PATIENCE, CHILDREN = 8, 120, 12, 4
#: Items of a bin whose pairs may make way.
MEMBERS = 12
#: Slack, in tokens, from which a bin takes part in the second round.
NOTABLE = 24
#: Most words, and most parts of words, that a worker remembers; beyond, it starts afresh. It changes speed only.
REMEMBERED = 400_000

#: Punctuation that never joins with letters before it; an apostrophe may.
PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[]^_`{|}~'
#: Separators that Python's split() knows and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACES = regex.compile(r"\s+")


class WordEncoder(dict):
    """Word (between white space) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, spec: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.by_byte = dict(enumerate(byte_characters()))
        self.parts: dict[str, bytes] = {}

    def _core(self, letters: str) -> bytes:
        """A run of lower-case letters below U+0130: nothing to normalise or cut, so the model takes it at once."""
        mapped = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.by_byte)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str, plain: bool) -> bytes:
        if len(self.parts) >= REMEMBERED:
            self.parts.clear()
        if plain:
            found = self._core(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self.parts[part] = found
        return found

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        if not core.isalpha() or max(core) >= "İ":
            return self.parts.get(word) or self._part(word, False)
        tail, core = word[len(core) :], core.lower()  # letters, then punctuation: the tokenizer cuts between them
        after = (self.parts.get(tail) or self._part(tail, False)) if tail else b""
        before = self.parts.get(core)
        if before is None:  # most words are never seen again: remember the letters alone
            return self._part(core, True) + after
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = packed = before + after
        return packed

    def encode(self, text: str) -> bytes:
        words = [w for w in _SPACES.split(text) if w] if any(c in text for c in _ODD) else text.split()
        return b"".join(map(self.__getitem__, words))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the documents' token ids, closed and cut."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary

    @F.arrow_udf("array<struct<piece int, start long, length long, ids_crc32 long>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, end = WordEncoder(spec.value), struct.pack("<I", end_id)
        for texts in batches:
            rows, ends = [], [0]
            for t in texts:
                ids = memoryview(encoder.encode(t.as_py() or "") + end)
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    upto = min(at + capacity, n)
                    rows.append((k, at, upto - at, zlib.crc32(ids[4 * at : 4 * upto])))
                ends.append(len(rows))
            columns = zip(*rows) if rows else [()] * 4
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["piece", "start", "length", "ids_crc32"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        del encoder
        give_back()

    return docs.select(id_col, F.explode(cut(F.coalesce(F.col(text_col), F.lit(""))))).select(id_col, "col.*")


def best_fit(lengths: list[int], bins: np.ndarray, todo: list[int], room: list[tuple[int, int]], capacity: int) -> None:
    """Put the items ``todo`` (longest first) where they leave the least room; ``room``: sorted (room, bin)."""
    fresh = int(bins.max(initial=-1)) + 1
    for i in todo:
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b, fresh = capacity, fresh, fresh + 1
        bins[i] = b
        if left > n:
            insort(room, (left - n, b))


def _room(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    placed = bins >= 0
    load = np.bincount(bins[placed], weights=lengths[placed]).astype(int) if placed.any() else np.zeros(0, int)
    open_ = np.flatnonzero((load > 0) & (load < capacity))
    return sorted(zip((capacity - load[open_]).tolist(), open_.tolist()))


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones; larger is fitter."""
    load = np.bincount(bins, weights=lengths)
    load = load[load > 0]
    return -len(load), float(((load / capacity) ** 2).sum())


def _exchange(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
    """One item or two of a bin make way for one displaced item or two that fill it better; what they leave is displaced instead, and smaller."""
    out = sorted((int(lengths[i]), int(i)) for i in np.flatnonzero(bins < 0))
    placed = np.flatnonzero(bins >= 0)
    order = placed[np.argsort(bins[placed], kind="stable")]
    edges = np.flatnonzero(np.diff(bins[order])) + 1
    for members in np.split(order, edges):
        size = lengths[members].tolist()
        gap = capacity - sum(size)
        if not gap or not out:
            continue
        gain, give, take = 0, (), ()
        leave = [((k,), n) for k, n in enumerate(size)] + [((j, k), size[j] + size[k]) for k in range(min(len(size), MEMBERS)) for j in range(k)]
        for gone, n in leave:
            k = bisect_left(out, (n + gap + 1, -1)) - 1  # the longest that fits alone
            if k >= 0 and out[k][0] - n > gain:
                gain, give, take = out[k][0] - n, gone, (k,)
            if len(gone) == 2 and gain < gap:
                low, high = 0, len(out) - 1
                while low < high:  # the best pair that fits
                    both = out[low][0] + out[high][0] - n
                    if both > gap:
                        high -= 1
                        continue
                    if both > gain:
                        gain, give, take = both, gone, (low, high)
                    low += 1
            if gain == gap:
                break
        if gain:
            b = bins[members[0]]
            into = [out[k] for k in take]
            for x in into:
                out.remove(x)
                bins[x[1]] = b
            for k in give:
                bins[members[k]] = -1
                insort(out, (size[k], int(members[k])))


def _refill(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    _, placed = np.unique(bins[bins >= 0], return_inverse=True)
    bins[bins >= 0] = placed
    _exchange(lengths, bins, capacity)
    best_fit(lengths.tolist(), bins, np.flatnonzero(bins < 0).tolist(), _room(lengths, bins, capacity), capacity)
    return bins


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``other`` go into ``one``; its bins that then hold an item twice are dissolved."""
    load = np.bincount(other, weights=lengths)
    full = np.argsort(-load, kind="stable")[: max(1, len(load) // 2)]
    injected = rng.choice(full, int(rng.integers(1, max(2, len(full) // 4 + 1))), replace=False)
    inside = np.isin(other, injected)
    child = one.copy()
    child[np.isin(one, np.unique(one[inside]))] = -1
    child[inside] = other[inside] + one.max() + 1
    return _refill(lengths, child, capacity)


def mutate(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Dissolve a few bins, half of them among the emptier ones."""
    load = np.bincount(bins, weights=lengths)
    used = np.flatnonzero(load > 0)
    emptier = used[np.argsort(load[used], kind="stable")][: max(2, len(used) // 8)]
    few = max(1, min(len(emptier) // 2, int(rng.integers(2, 12))))
    chosen = np.concatenate((rng.choice(emptier, few, replace=False), rng.choice(used, min(few, len(used)), replace=False)))
    child = bins.copy()
    child[np.isin(bins, chosen)] = -1
    return _refill(lengths, child, capacity)


def breed(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator, generations: int = GENERATIONS) -> list[np.ndarray]:
    """One epoch of an island, fittest first. ``lengths`` fall; the population may be empty."""
    n, bound = len(lengths), -(-int(lengths.sum()) // capacity)
    listed = lengths.tolist()
    population = list(population)
    while len(population) < POPULATION and not any(-fitness(lengths, b, capacity)[0] <= bound for b in population[-1:]):
        order = np.arange(n)
        if any(True for _ in population):  # all but the first start from a perturbed order
            order = np.argsort(-lengths * rng.uniform(0.9, 1.1, n), kind="stable")
        bins = np.full(n, -1)
        best_fit(listed, bins, order.tolist(), [], capacity)
        population.append(bins)
    ranked = sorted(((fitness(lengths, b, capacity), k, b) for k, b in enumerate(population)), reverse=True)
    serial, waited = len(ranked), 0
    for _ in range(generations):
        if -ranked[0][0][0] <= bound or waited >= PATIENCE:
            break
        leader = ranked[0][0]
        for _ in range(CHILDREN):
            a, b = rng.choice(len(ranked), 2, replace=False)
            child = mutate(lengths, crossover(lengths, ranked[a][2], ranked[b][2], capacity, rng), capacity, rng)
            serial += 1
            ranked.append((fitness(lengths, child, capacity), -serial, child))
        ranked = sorted(ranked, key=lambda x: (x[0], x[1]), reverse=True)[:POPULATION]
        waited = 0 if ranked[0][0] > leader else waited + 1
    return [b for _, _, b in ranked]


_STATE = "_shard long, _island int, items array<long>, lengths array<long>, population array<array<int>>, bins int, fill double"


def _epoch(state: DataFrame, capacity: int, epoch: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                lengths = np.asarray(r.lengths, np.int64)
                bred = breed(lengths, [np.asarray(p, np.int64) for p in r.population], capacity, np.random.default_rng([r._0 & 0x7FFFFFFF, r._1, epoch]))
                count, fill = fitness(lengths, bred[0], capacity)
                rows.append((r._0, r._1, r.items, r.lengths, [b.astype(np.int32) for b in bred], -count, fill))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])

    return state.select("_shard", "_island", "items", "lengths", "population").mapInPandas(run, _STATE)


def evolve(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(_item, length, _shard, _bin) from (_item, length, _shard, _bin: what it is in now, or null)."""
    kept = F.sort_array(F.collect_list(F.struct((-F.col("length")).alias("n"), F.col("_item").alias("i"), F.coalesce("_bin", F.lit(-1)).alias("b"))))
    shards = items.groupBy("_shard").agg(kept.alias("x"))
    now = F.transform("x", lambda x: x["b"].cast("int"))
    state = shards.select(
        "_shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island"), F.transform("x", lambda x: x["i"]).alias("items"),
        F.transform("x", lambda x: -x["n"]).alias("lengths"),
        F.when(F.array_min(now) >= 0, F.array(now)).otherwise(F.array().cast("array<array<int>>")).alias("population"),
    ).repartition("_shard", "_island")
    around, best = Window.partitionBy("_shard"), F.element_at("population", 1)
    for epoch in range(epochs):
        if epoch:  # the best of each island also goes to the next one
            step = around.orderBy("_island")
            last = F.last("_best").over(step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
            state = state.withColumn("_best", best).withColumn("_guest", F.coalesce(F.lag("_best").over(step), last))
            state = state.withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("_guest"))).repartition("_shard", "_island")
        state = _epoch(state, capacity, epoch)
    order = F.struct(-F.col("bins"), F.col("fill"), -F.col("_island"))
    final = state.select("_shard", order.alias("o"), F.struct("items", "lengths", best.alias("b")).alias("s")).groupBy("_shard").agg(F.max_by("s", "o").alias("s"))
    flat = final.select("_shard", F.explode(F.arrays_zip("s.items", "s.lengths", "s.b")).alias("z"))
    return flat.select(F.col("z.items").alias("_item"), F.col("z.lengths").alias("length"), "_shard", F.col("z.b").cast("long").alias("_bin"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(_item, sequence_id, offset) from (_item, length); lengths from 1 to the capacity."""
    whole = items.where(F.col("length") >= capacity).select("_item", "length", (-F.col("_item") - 1).alias("sequence_id"))
    part = items.where(F.col("length") < capacity)

    def shards(n: int) -> int:
        return max(1, -(-n // shard))

    dealt = part.select("_item", "length", F.pmod(F.xxhash64("_item"), F.lit(shards(part.count()))).alias("_shard"), F.lit(None).cast("long").alias("_bin"))
    first = durable(evolve(dealt, capacity).select("_item", "length", (F.col("_shard") * (1 << 24) + F.col("_bin")).alias("_bin")))
    slack = first.groupBy("_bin").agg(F.sum("length").alias("_load")).where(F.col("_load") < capacity - NOTABLE).select("_bin")
    loose = durable(first.join(slack, "_bin", "left_semi"))
    fine = first.join(slack, "_bin", "left_anti").select("_item", "length", F.col("_bin").alias("sequence_id"))
    again = loose.withColumn("_shard", F.pmod(F.xxhash64("_bin"), F.lit(shards(loose.count()))))
    local = again.select("_item", "length", "_shard", (F.dense_rank().over(Window.partitionBy("_shard").orderBy("_bin")) - 1).cast("long").alias("_bin"))
    second = evolve(local, capacity).select("_item", "length", (F.lit(1 << 61) + F.col("_shard") * (1 << 24) + F.col("_bin")).alias("sequence_id"))
    packed = whole.unionByName(fine).unionByName(second)
    before = Window.partitionBy("sequence_id").orderBy("_item").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("_item", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = durable(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id).withColumn("_item", F.monotonically_increasing_id()))
    return cut.join(pack(cut.select("_item", "length"), capacity), "_item").select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
