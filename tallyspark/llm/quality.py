"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

*Statistics* (``STATS``) are taken from whole texts, once. *Features* are cosines of random
projections of the standardised statistics, which approximate a Gaussian kernel, beside the
statistics themselves and a constant. *Ridge*: every partition sums its own normal equations; the
sums are integers of 2^-20, so the total does not depend on the order of tasks, and only the
matrix, of fixed size, reaches the driver to be solved. *Isotonic calibration*: training scores are
counted in ``CELLS`` bins of equal width, pooled so that they never fall, and
interpolated; the bins, again of fixed number, are all that the driver sees.

Labels serve training alone: those of about ``TRAIN`` documents, chosen by a hash of their ids, or all
where there are fewer. This bounded table is broadcast to the documents, so that only labelled texts are
measured for training and no text moves. A score depends on the text only.

Defined cases: a null text counts as empty and is scored like any text; labels that are null are
left out, several labels of one document are averaged; labelled ids that no document has are
ignored, documents that repeat an id each get their own score; without any usable label every
score is 0.5; an empty table gives an empty table; extra columns are ignored; a text of any length is
measured whole, in one task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, give_back, slices

STATS = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "non_ascii", "symbol", "stop", "bang", "bar",
    "end_symbol", "distinct_words", "top_word", "repeats", "lines", "short_lines", "distinct_lines", "byte_entropy", "capital_words",
]
#: Random features, width of the kernel, weight of the ridge, seed.
FEATURES, WIDTH, RIDGE, SEED = 160, 4.0, 1.0, 5
#: Bins of the raw score for calibration, over this range of scores.
CELLS, RANGE = 400, (-0.5, 1.5)
SCALE = 1 << 20
#: Labelled documents that a fit learns from, about.
TRAIN = 50_000

_SYMBOLS = [c for c in b"#$%&*+<=>@^_`{|}~\\/[]"]
_END = re.compile(r"[#$%&*!|]{2,}(?=\s|$)")


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, all finite."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    seen = Counter(words)
    m = max(len(words), 1)
    share = counts[counts > 0] / n
    return [
        np.log1p(len(raw)), np.log1p(len(words)), min(n / m, 60.0), counts[65:91].sum() / n, counts[48:58].sum() / n,
        (counts[32] + counts[9] + counts[10]) / n, counts[128:].sum() / n, counts[_SYMBOLS].sum() / n, counts[46] / m, min(counts[33] / m, 3.0), min(counts[124] / m, 3.0),
        min(sum(1 for _ in _END.finditer(text)) / m, 3.0), len(seen) / m, max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(words, words[1:])) / m, min(len(lines) / m, 1.0), sum(len(x) < 20 for x in lines) / len(lines),
        len(set(lines)) / len(lines), float(-(share * np.log2(share)).sum()), sum(w[:1].isupper() for w in words) / m,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = np.array([statistics(t.as_py() or "") for t in texts], np.float64).reshape(-1, len(STATS))
        yield pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATS)), pa.array(rows.ravel()))


def with_statistics(docs: DataFrame, text_col: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with the statistics: array<double>."""
    return docs.withColumn(name, _statistics(F.coalesce(F.col(text_col), F.lit(""))))


@dataclass
class Model:
    """What scoring needs; all of fixed size."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray | None = None
    cuts: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.spread, -6, 6)
        rng = np.random.default_rng(SEED)
        w, b = rng.normal(0, 1 / WIDTH, (len(STATS), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack((np.ones(len(z)), z / 6, np.cos(z @ w + b)))

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None or not len(stats):
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.raw(stats), self.cuts, self.levels), 0.0, 1.0)


def pool_adjacent(totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The non-falling sequence closest to totals / counts, weighted by the counts (all above 0)."""
    blocks: list[list[float]] = []
    for t, c in zip(totals.tolist(), counts.tolist()):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t, c, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + c, blocks[-1][2] + k]
    return np.repeat([t / c for t, c, _ in blocks], [int(k) for _, _, k in blocks])


def _stats_of(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["stats"].tolist(), np.float64).reshape(-1, len(STATS))


def fit(train: DataFrame) -> Model:
    """From (stats, y: 0 to 1)."""
    one = F.posexplode("stats").alias("k", "v")
    moments = train.select(one).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    if not moments:
        return Model(np.zeros(len(STATS)), np.ones(len(STATS)))
    rounded = lambda name: np.array([float(f"{r[name]:.9g}") for r in moments])
    model = Model(rounded("m"), np.maximum(rounded("s"), 1e-6))
    size = 1 + len(STATS) + FEATURES

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for pdf in batches:
            x = model.features(_stats_of(pdf))
            a += x.T @ x
            b += x.T @ pdf["y"].to_numpy(float)
        whole = np.rint(np.concatenate((a[np.triu_indices(size)], b)) * SCALE).astype(np.int64)
        yield pd.DataFrame({"k": np.arange(len(whole), dtype=np.int32), "v": whole})

    parts = train.select("stats", "y").mapInPandas(sums, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).toPandas().sort_values("k")
    total = parts["v"].to_numpy(float) / SCALE
    a, at = np.zeros((size, size)), np.triu_indices(size)
    a[at] = total[: len(at[0])]
    a = a + np.triu(a, 1).T
    model.weights = np.linalg.solve(a + RIDGE * np.eye(size), total[len(at[0]) :])

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.clip(model.raw(_stats_of(pdf)), *RANGE)
            cell = np.minimum((raw - RANGE[0]) / (RANGE[1] - RANGE[0]) * CELLS, CELLS - 1).astype(np.int32)
            y = np.rint(pdf["y"].to_numpy(float) * SCALE).astype(np.int64)
            yield pd.DataFrame({"cell": cell, "y": y, "raw": np.rint(raw * SCALE).astype(np.int64)})

    cells = (
        train.select("stats", "y").mapInPandas(binned, "cell int, y long, raw long").groupBy("cell")
        .agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("raw")).orderBy("cell").toPandas()
    )
    count = cells["n"].to_numpy(float)
    model.cuts = cells["raw"].to_numpy(float) / SCALE / count
    model.levels = pool_adjacent(cells["y"].to_numpy(float) / SCALE, count)
    return model


def apply(stats: DataFrame, model: Model, stats_col: str = "stats", name: str = "score") -> DataFrame:
    """``stats`` with a score (0 to 1)."""

    @F.pandas_udf(T.DoubleType())
    def of(values: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(values.tolist(), np.float64).reshape(-1, len(STATS))))

    return stats.withColumn(name, of(stats_col))


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each text, from one worker a task: the statistics do not leave it."""

    @F.arrow_udf(T.DoubleType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [model.score(np.array([statistics(t.as_py() or "") for t in few], np.float64).reshape(-1, len(STATS))) for few in slices([texts], 1024)]
            yield pa.array(np.concatenate([*found, np.zeros(0)]))
        give_back()

    return docs.withColumn(name, of(F.coalesce(F.col(text_col), F.lit(""))))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = TRAIN) -> DataFrame:
    """(id, y) of about ``most`` labelled documents that are not held out; all of them where there are fewer."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = durable(usable.groupBy(id_col).agg(F.avg(F.col(label_col).cast("double")).alias("y")))
    share = int(min(1.0, most / max(known.count(), 1)) * (1 << 30))
    return known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < share)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", most: int = TRAIN) -> DataFrame:
    """``docs`` with y, those alone that are learnt from. The broadcast side has about ``most`` rows of two numbers."""
    return docs.join(F.broadcast(known_labels(labels, id_col, label_col, most)), id_col)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) for every row of ``docs``, by a model fitted to its labelled rows."""
    train = with_statistics(labelled(docs.select(id_col, text_col), labels, id_col, label_col), text_col)
    model = fit(durable(train.select("stats", "y")))
    return apply(with_statistics(docs.select(id_col, text_col), text_col), model).select(id_col, "score")
