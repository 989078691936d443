"""Quality scores, nearest neighbours, revisits and the pipeline."""

import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import jaccard_dedup, line_dedup, neighbours, quality, warc_revisit
from tallyspark.llm.queries import op5_quality, op8_neighbours


def test_quality_on_held_out_rows(spark, data):
    scores = {r.doc_id: r for r in op5_quality(spark, data).collect()}
    assert len(scores) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in scores.items())
    labels = spark.read.parquet(f"{data}/labels.parquet").collect()
    held = [(r.quality, scores[r.doc_id].predicted) for r in labels if scores[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_quality_ignores_held_out_labels_and_ids(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(r.score for r in quality.score_quality(docs, x).collect()) for x in (labels, flipped))
    assert one == two


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", 1), (2, None, 1), (3, "", 1), (None, "x", 1), (1, "again", 1), (4, "w " * 50000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (9, 1), (None, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels)
    assert got.columns == ["doc_id", "score"] and got.count() == 6 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 9, 50).astype(float)
    totals = rng.random(50) * counts
    fit = quality.pool_adjacent(totals, counts)
    assert np.all(np.diff(fit) >= 0) and np.isclose((fit * counts).sum(), totals.sum())


def fit_by_force(stats, y):
    """Moments, features, ridge and isotonic steps over all rows at once, in plain numpy."""
    mean = np.array([float(f"{v:.9g}") for v in stats.mean(axis=0)])
    spread = np.maximum([float(f"{v:.9g}") for v in stats.std(axis=0)], 1e-6)
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / quality.WIDTH, (stats.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.clip((stats - mean) / spread, -6, 6)
    x = np.array([[1.0, *(row / 6), *np.cos(row @ w + b)] for row in z])
    weights = np.linalg.lstsq(np.vstack((x, np.sqrt(quality.RIDGE) * np.eye(x.shape[1]))), np.concatenate((y, np.zeros(x.shape[1]))), rcond=None)[0]
    raw = np.clip(x @ weights, *quality.RANGE)
    cells = {}
    for r, t in zip(raw, y):
        cells.setdefault(min(int((r - quality.RANGE[0]) / (quality.RANGE[1] - quality.RANGE[0]) * quality.CELLS), quality.CELLS - 1), []).append((r, t))
    cuts = [np.mean([r for r, _ in cells[c]]) for c in sorted(cells)]
    # the greatest of the least means of runs: isotonic regression by its minimax formula
    t, n = np.array([sum(v for _, v in cells[c]) for c in sorted(cells)]), np.array([float(len(cells[c])) for c in sorted(cells)])
    levels = [max(min(t[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(t))) for i in range(k + 1)) for k in range(len(t))]
    return weights, np.clip(np.interp(raw, cuts, levels), 0, 1)


@pytest.mark.parametrize("parts", [1, 7])
def test_fit_is_brute_force(spark, parts):
    rng = np.random.default_rng(6)
    stats = rng.normal(size=(400, len(quality.STATS))) * rng.uniform(0.1, 9, len(quality.STATS))
    y = (stats[:, 0] / 5 + rng.normal(size=400) > 0).astype(float)
    df = spark.createDataFrame([(s.tolist(), float(t)) for s, t in zip(stats, y)], "stats array<double>, y double").repartition(parts)
    model = quality.fit(df)
    weights, scores = fit_by_force(stats, y)
    assert np.allclose(model.weights, weights, atol=1e-4)
    assert np.abs(model.score(stats) - scores).mean() < 0.01 and np.all(np.diff(model.levels) >= 0)
    assert np.allclose(sorted(r.score for r in quality.apply(df, model).collect()), np.sort(model.score(stats)))


def test_statistics_are_those_of_the_text():
    text = "One two, two! A|B\n\nlast 12$$ ..."
    got = dict(zip(quality.STATS, quality.statistics(text)))
    assert got["log_bytes"] == np.log1p(len(text)) and got["log_words"] == np.log1p(7) and got["digit"] == 2 / len(text) and got["upper"] == 3 / len(text)
    assert got["lines"] == 3 / 7 and got["distinct_lines"] == 1.0 and got["bang"] == 1 / 7 and got["bar"] == 1 / 7 and got["distinct_words"] == 1.0 and got["repeats"] == 0
    assert all(np.isfinite(quality.statistics(t)).all() for t in ("", " ", "\n", "x" * 100_000, "\ud800"))


def test_training_is_bounded_and_leaves_held_out_rows_aside(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)] + [(None, 1), (5000, None)], "doc_id long, quality int")
    known = quality.known_labels(labels, most=500).collect()
    assert 350 < len(known) < 650 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in known)
    assert quality.known_labels(labels).count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(4000))


def nearest_by_force(ids, x, k=20):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = np.cumsum(x[i] * x, axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall_of(got, want):
    return np.mean([len({v for v, _ in want[q]} & {v for v, _ in got[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_of_neighbours(spark, table):
    path = f"/root/testdata/{table}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.array(rows["embedding"].tolist(), np.float64), rows["vec_id"].to_numpy()
    want, got = nearest_by_force(ids, x), found(op8_neighbours(spark, path))
    assert got.keys() == want.keys()
    assert recall_of(got, want) >= 0.9
    exact = {i: v for i, v in zip(ids.tolist(), x)}
    assert all(s == np.cumsum(exact[q] * exact[v])[-1] for q in got for v, s in got[q])
    assert neighbours.partitions(len(ids)) >= 16


def test_recall_over_many_partitions(spark, monkeypatch):
    """50,000 clustered vectors: 128 partitions, of which the queries visit fewer than half; each row is in one block, once."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(200, 16))[rng.integers(0, 200, 50_000)] * 3 + rng.normal(size=(50_000, 16))).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    seen = {}

    def watched(base, queries, router, k, block):
        out = items(base, queries, router, k, block)
        own = out.where("asks = 0").agg(F.count("*"), F.count_distinct("part", "block")).first()
        seen.update(router=router, rows=own[0], kept=base.count(), blocks=own[1], copies=out.where("asks = 1").count())
        return out

    items = neighbours.items
    monkeypatch.setattr(neighbours, "items", watched)
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=1000))
    score = x[::20] @ x.T
    score[np.arange(2500), np.arange(0, 50_000, 20)] = -np.inf
    want = {20 * i: [(int(j), None) for j in near] for i, near in enumerate(np.argpartition(-score, 20, axis=1)[:, :20])}
    assert got.keys() == want.keys() and recall_of(got, want) >= 0.9
    router = seen["router"]
    assert router.parts == 128 and (router.rows > 0).sum() >= 64 and 1 <= router.probes < 64
    assert seen["rows"] == seen["kept"] == router.rows.sum() == 50_000 and seen["blocks"] > 64 and seen["copies"] >= 2500


def test_neighbours_edges_and_learned_partitions(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 4
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))).astype(np.float32)
    x[1000:3000] = x[0]  # a third are copies
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    bad = [(6000, None, "x"), (6020, [], "x"), (6040, [0.0] * 16, "x"), (6060, [float("nan")] * 16, "x"), (6080, [None] + [1.0] * 15, "x"), (6100, [float("inf")] + [1.0] * 15, "x"), (None, [1.0] * 16, "x")]
    df = spark.createDataFrame(rows + bad + rows[:50], "vec_id long, embedding array<float>, score string")
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=300))
    want = nearest_by_force(np.arange(6000), x.astype(np.float64))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall_of(got, want) >= 0.9
    assert got[1000] == want[1000] and got[0] == want[0]  # ties among copies go to smaller ids
    few = spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, score string")
    assert len(found(neighbours.nearest(few, F.col("vec_id") % 20 == 0))[0]) == 4
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<float>")
    assert neighbours.nearest(one, F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_uneven_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [1.0]), (2, [0.0, 1.0, 5.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)) == {0: [(3, 5.0), (2, 2.0), (1, 1.0)]}
    assert found(neighbours.nearest(df, F.col("vec_id") == 3, k=3)) == {3: [(0, 5.0), (0, 3.0), (2, 2.0)]}


def test_a_query_goes_on_until_it_holds_enough():
    router = neighbours.Router(4, 2)
    router.b[:], router.rows[:], router.probes = [3, 2, 1, 0], [5, 0, 2, 30], 1
    assert [p.tolist() for p in router.probed(np.ones((1, 2)), 3)] == [[0]]
    assert [p.tolist() for p in router.probed(np.ones((1, 2)), 5)] == [[0, 2]]
    assert [p.tolist() for p in router.probed(np.ones((1, 2)), 60)] == [[0, 2, 3]]


def test_balanced_partition():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1000, 8))
    label = neighbours.balanced_partition(neighbours.neighbour_graph(x), 8, rng)
    assert np.bincount(label).tolist() == [125] * 8
    graph = neighbours.neighbour_graph(x)
    assert (label[graph] == label[:, None]).mean() > 0.4  # by chance 0.125


def test_canonical_urls(spark):
    cases = {
        "http://WWW.Example.com:80/a/?utm_source=x&b=2&a=1#top": "example.com/a?a=1&b=2", "https://m.example.com/a": "example.com/a", "https://example.com": "example.com",
        "https://example.com/index.html?ref=q": "example.com", "https://example.com/A/index.htm": "example.com/A", "ftp://blog.x.org:8080//": "blog.x.org:8080/", "no url": "no url", "": "", "dns:www.example.com": "dns:www.example.com",
        "/a/index.html?utm_source=x": "/a/index.html?utm_source=x", "http://": "http://", "http:///a": "http:///a", "WWW.example.com/A/": "WWW.example.com/A/", "mailto:A@b.c": "mailto:A@b.c",
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select(warc_revisit.canonical_url(F.col("url")).alias("c"))
    assert [r.c for r in df.collect()] == list(cases.values())


def test_urls_without_a_scheme_stay_apart(spark):
    rows = [(k, u, 10 + k, kind, {"etag": "t"}, "d") for k, (u, kind) in enumerate([("dns:a.org", "response"), ("/x", "response"), ("", "response"), ("dns:b.org", "revisit"), ("dns:a.org", "revisit"), ("/y", "revisit"), ("", "revisit")])]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    got = {r.record_id: (r.canonical_url, r.refers_to, r.status) for r in warc_revisit.resolve_revisits(df).collect()}
    assert got == {3: ("dns:b.org", None, "no earlier response"), 4: ("dns:a.org", 0, "resolved"), 5: ("/y", None, "no earlier response")}


def revisits_by_force(rows):
    out = []
    for i, url, ts, kind, headers, _ in rows:
        if kind != "revisit" or url is None or ts is None or i is None:
            continue
        before = [r for r in rows if r[3] == "response" and r[1] == url and r[0] is not None and r[2] is not None and r[2] < ts]
        if not before:
            out.append((i, None, "no earlier response", None, None))
            continue
        r = max(before, key=lambda r: (r[2], r[0]))
        new, old = ({k.lower(): v for k, v in (h or {}).items()} for h in (headers, r[4]))
        weak = lambda t: t.strip().removeprefix("W/")
        if "etag" in new and "etag" in old:
            good = weak(new["etag"]) == weak(old["etag"])
        elif "last-modified" in new and "last-modified" in old:
            good = new["last-modified"] == old["last-modified"]
        else:
            out.append((i, r[0], "no validator", None, None))
            continue
        merged = sorted((old | {k: v for k, v in new.items() if k in warc_revisit.PERMITTED}).items())
        out.append((i, r[0], "resolved", merged, r[5]) if good else (i, r[0], "mismatch", None, None))
    return out


@pytest.mark.parametrize("seconds", [10, 60, 86_400])
def test_revisits(spark, seconds):
    rng = random.Random(16)
    rows = []
    for i in range(500):
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = {k: v for k, v in {"ETag": rng.choice(['"a"', 'W/"a"', '"b"']), "Last-Modified": rng.choice("xy"), "Date": str(i), "Content-Length": "9", "vary": "z"}.items() if rng.random() < 0.6}
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://h{rng.randrange(12)}.example/p"
        rows.append((i, url, rng.randrange(200), kind, headers if rng.random() < 0.95 else None, f"d{i}" if kind == "response" else None))
    rows += [(900, None, 5, "revisit", {}, None), (901, "http://hot.example/", None, "revisit", {}, None), (None, "http://hot.example/", 5, "response", {}, "d"), rows[3], rows[3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "record_id long, url string, ts long, kind string, headers map<string,string>, digest string, status string")
    got = [(r.record_id, r.refers_to, r.status, None if r.headers is None else [tuple(h) for h in r.headers], r.digest) for r in warc_revisit.resolve_revisits(df, seconds).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, revisits_by_force(rows)))
    assert warc_revisit.resolve_revisits(df.limit(0)).count() == 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    at, frames = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, data).collect(), docs.schema)
        frames.append({r.doc_id: r for r in at.collect()})
        assert at.columns == docs.columns
    good, lines, single = frames
    assert set(good) >= set(single) and set(good) == set(lines) and len(single) < len(lines) <= docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    assert np.mean([labels[i] for i in good if i in labels]) > 0.95
    assert np.mean([i in good for i, q in labels.items() if q == 1]) > 0.95
    want = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(spark.createDataFrame(list(good.values()), docs.schema)).collect()}
    assert {i: r.text for i, r in lines.items()} == want and all(r.n_chars == len(r.text) for r in lines.values())
    found = jaccard_dedup.near_duplicates(spark.createDataFrame(list(lines.values()), docs.schema)).collect()
    assert set(single) == {r.component_id for r in found}
    packed = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in packed} == set(single)


def test_quality_stage_takes_one_worker_a_task(spark, data):
    """Each worker more stays in memory through all later stages; scores are those of the operator."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(50)
    plan = corpus_pipeline.keep_good(spark, docs, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1
    train = quality.with_statistics(quality.labelled(docs.select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet")))
    model = quality.fit(train.select("stats", "y"))
    rows = quality.score_texts(quality.apply(quality.with_statistics(docs), model), model, name="other").select("score", "other").collect()
    assert rows and max(abs(r.score - r.other) for r in rows) < 1e-9


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, stats int, n_lines string, n_dropped string, kept_text string, component_id int, key string, `a.b` int, m map<string,int>, mm array<map<string,int>>"


def test_stages_take_odd_documents(spark, data):
    """Nulls, repeats, copies without ids, clashing columns: each stage changes text and n_chars alone, or drops rows."""
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [(None, None), (1, None), (1, ""), (2, "a repeated line\n" * 3000), (3, "own words here\na repeated line"), (None, "own words here\na repeated line"), (None, "nobody else says this at all"), (None, "nobody else says this at all"), (4, long), (5, long + " end"), (None, long)]
    rows = [(i, t, None, "s", k, "score", k, "lines", "dropped", "kept", k, "key", k, {"a": k}, [{"b": k}]) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, ODD)

    def stage(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, data)
        assert k == 3 or (out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema])
        return sorted((tuple(r) for r in out.collect()), key=repr)

    own = {repr(r) for r in rows}
    assert all(repr(r) in own for r in stage(0, docs))
    lines = {r[6]: r for r in stage(1, docs)}
    kept = {4: "own words here", 3: "a repeated line\n" * 3000}
    assert lines.keys() == set(range(len(rows)))
    for k, r in enumerate(rows):
        assert lines[k] == (r if k not in kept or r[1] == kept[k] else (*r[:1], kept[k], *r[2:4], len(kept[k]), *r[5:]))
    left = stage(2, docs)
    assert sorted(r[6] for r in left if r[6] not in (6, 7)) == [1, 2, 3, 4, 8] and sum(r[6] in (6, 7) for r in left) == 1 and all(repr(r) in own for r in left)
    assert len(stage(3, docs)) >= len(rows)
    for k in range(4):
        assert stage(k, docs.limit(0)) == []


def test_near_dedup_stage_keeps_to_jaccard(spark, data):
    """Edited copies at 0.8 and more over five words go, as brute force says, in small blocks too."""
    rng = random.Random(17)
    docs, words = [], [f"w{i}" for i in range(500)]
    for _ in range(40):
        at = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        docs.append(at)
        for _ in range(rng.randint(0, 6)):
            at = list(at)
            for _ in range(rng.randint(1, 1 + len(at) // 60)):
                at[rng.randrange(len(at))] = rng.choice(words)
            docs.append(at)
    texts = [(i, " ".join(d)) for i, d in enumerate(docs)] + [(900, ""), (901, None), (902, " \t"), (903, " ".join(docs[0]).upper())]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts}
    root = {i: i for i, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and (not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i: find(i) for i in sets}
    for block in (2, 256):
        assert {r.doc_id: r.component_id for r in jaccard_dedup.near_duplicates(df, block=block).collect()} == want
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect()} == set(want.values())
    assert jaccard_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_goes_through_the_grid_join(spark, data, monkeypatch):
    """The stage's candidates are those of the fingerprints' cells: without these, edited copies stay."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:150], "edited", *words[151:]]), "something else entirely that nobody edits"]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect()} == {0, 2}
    found = jaccard_dedup._candidates
    monkeypatch.setattr(jaccard_dedup, "_candidates", lambda items: found(items).limit(0))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, data).collect()} == {0, 1, 2}


def test_grids_find_pairs_at_the_least_similarity():
    """Pairs at exactly 0.8 share a cell and are within the radius, at all sizes of the table; unrelated ones are not."""
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(600):
        h = rng.integers(0, 1 << 64, 250, np.uint64)
        pairs.append((jaccard_dedup.fingerprint(h[:225]), jaccard_dedup.fingerprint(np.concatenate((h[:200], h[225:])))))
    a, b = (np.stack(x) for x in zip(*pairs))
    shown = slice(0, jaccard_dedup.SHOWN)
    near = np.bitwise_count(a[:, shown] ^ b[:, shown]).sum(axis=1) <= jaccard_dedup.RADIUS
    far = np.bitwise_count(a[:-1, shown] ^ a[1:, shown]).sum(axis=1) <= jaccard_dedup.RADIUS
    apart = jaccard_dedup._unary(a) ^ jaccard_dedup._unary(b)
    assert near.mean() > 0.998 and not far.any() and (np.bitwise_count(apart) <= np.bitwise_count(a ^ b)).all()
    for n in (10, 2000, 220_000):
        met = (apart[:, None, :] & jaccard_dedup.grids(n, 4096) == 0).all(axis=2).any(axis=1)
        assert met.mean() > 0.998


@pytest.mark.parametrize("split", [False, True])
def test_an_item_returns_nearest_pairs_and_a_forest(split, monkeypatch):
    """As brute force over all pairs, also where what is held is contracted on the way."""
    monkeypatch.setattr(jaccard_dedup, "HELD", 50)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 64, (20, jaccard_dedup.SHOWN), np.uint64)
    prints = base[rng.integers(0, 20, 300)]
    for _ in range(20):
        prints[np.arange(300), rng.integers(0, jaccard_dedup.SHOWN, 300)] ^= np.uint64(1) << rng.integers(0, 64, 300, np.uint64)
    sides = np.sort(rng.integers(0, 2, 300)) if split else np.zeros(300, int)
    differ = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    met = (differ <= jaccard_dedup.RADIUS) & ~np.eye(300, dtype=bool) & ((sides[:, None] != sides[None]) | (not split))
    a, b, near = jaccard_dedup.close(prints, sides)
    assert met[a[near], b[near]].all() and set(a[near].tolist()) == set(np.flatnonzero(met.any(axis=1)).tolist())
    assert (differ[a[near], b[near]] == np.where(met, differ, 999).min(axis=1)[a[near]]).all()
    i, j = np.nonzero(met)
    assert (jaccard_dedup._roots(a, b, 300) == jaccard_dedup._roots(i, j, 300)).all() and len(a) < 600 < len(i)


def test_a_hot_cell_compares_no_pairs_inside_its_largest_component(spark):
    """Each member meets the strays once; what is dealt is in proportion to the group, not to its pairs."""
    columns = ", ".join(f"id as {c}" for c in jaccard_dedup._F[: jaccard_dedup.SHOWN])
    members = spark.range(2003).selectExpr("7L as cell", "id as key", columns.split(", ")[0], *columns.split(", ")[1:])
    root = spark.range(1, 2000).selectExpr("id as node", "0L as root")
    rows = jaccard_dedup._hot_items(members, root, 50).collect()
    met = {}
    for r in rows:
        met.setdefault(r[:3], []).append(r)
    assert len(met) == 41 and len(rows) == 3 * 41 + 2000
    pairs = [(a.key, b.key) for (_, i, j), item in met.items() for a in item for b in item if a._side == 0 and (b._side == 1 or i == j and a.key < b.key)]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((s, o)) for s in range(2000, 2003) for o in range(2003) if o != s}


def test_strays_in_a_large_group_cost_no_pairs_inside_it(spark):
    """What the largest component of a shingle holds is dealt once for each block of strays; every pair with a stray meets once."""
    members = spark.range(2003).selectExpr("explode(array(7L, 8L)) as shingle", "id as key", "if(id < 2000, 5L, id) as root")
    rows = jaccard_dedup.rest_items(members, 50).collect()
    met = {}
    for r in rows:
        met.setdefault(r[:4], []).append(r)
    assert len(met) == 41 and max(map(len, met.values())) < 150 and len(rows) == 2000 + 3 * (1 + 40)
    pairs = [(a.key, b.key) for (i, pi, j, pj), item in met.items() for a in item for b in item if a._side == 0 and (b._side == 1 or (i, pi) == (j, pj) and a.key < b.key)]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((s, o)) for s in range(2000, 2003) for o in range(2003) if o != s}


def boilerplate(n):
    shared = " ".join(f"shared{i}" for i in range(154))
    return [(k, f"{shared} " + " ".join(f"own{k}x{i}" for i in range(50))) for k in range(n)]


def test_boilerplate_makes_no_pairs(spark):
    """Texts alike in three quarters of their words, below 0.8: what is dealt grows in proportion, and no pair is compared."""
    dealt = {}
    for n in (200, 400, 800):
        texts = spark.createDataFrame(boilerplate(n), "key long, text string")
        rows = jaccard_dedup.prefixes(texts, 5, 0.8).withColumn("root", F.col("key"))
        dealt[n] = (rows.count(), jaccard_dedup.rest_items(rows).count())
    assert dealt[800][0] <= 4.1 * dealt[200][0] and not any(pairs for _, pairs in dealt.values())


def test_nodes_under_two_roots_are_put_together(spark, monkeypatch):
    """Even where contraction leaves components unfinished, as where a single partition is not one, the end is proven."""
    from tallyspark.llm import simhash_dedup

    links = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 50)], "a long, b long")
    monkeypatch.setattr(simhash_dedup, "_contracted", lambda pairs, parts: pairs.repartition(16, "a", "b"))
    got = {r.node: r.root for r in simhash_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 50)}
    assert not simhash_dedup.finished(spark.createDataFrame([(3, 1), (3, 2)], "a long, b long")) and not simhash_dedup.finished(spark.createDataFrame([(3, 2), (2, 1)], "a long, b long"))


def test_copies_are_reduced_before_they_move(spark):
    """Without a broadcast, as on large tables: nothing is shuffled below the first reduction of the texts."""
    rows = spark.range(40).selectExpr("id % 2 as key", "'same' as text")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = jaccard_dedup.one_of_each(rows, spark.range(1).select(F.col("id").alias("key")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in out.collect()] == [(0, "same")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("partial_first") :]
    assert "Exchange" not in below[: below.index("Range")] and "SortMergeJoin" in plan


def test_many_ties_take_little_memory(monkeypatch):
    """Copies all tie: the k smallest ids stay, and memory does not grow with queries times copies."""
    monkeypatch.setattr(neighbours, "AT_ONCE", 1 << 16)
    x = np.ones((8000, 4))
    tracemalloc.start()
    query, vec, score = neighbours.top_of_block(np.arange(8000), x, np.arange(10_000, 10_400), x[:400], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert vec.reshape(400, 5).tolist() == [list(range(5))] * 400 and query.tolist() == np.repeat(np.arange(10_000, 10_400), 5).tolist() and set(score) == {4.0}
    assert peak < 30e6
