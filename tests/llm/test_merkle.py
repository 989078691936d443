"""The Merkle manifest against a tree built by hand in Python."""

import hashlib
import zlib

import pytest

from tallyspark.llm import merkle

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]))


def by_force(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, by one loop over levels."""

    def climb(nodes):
        """The top of a list of digests, and for each its list of (before, after) up to the top."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = nodes[place // 16 * 16 : place // 16 * 16 + 16]
                paths[k].append((run[: place % 16], run[place % 16 + 1 :]))
                at[k] = place // 16
            nodes = [h(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        return nodes[0], paths

    sources = {}
    for r in rows:
        sources.setdefault(r["source"], []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        sources[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        below[s] = climb([leaf_of(r) for r in sources[s]])
    root, above = climb([below[s][0] for s in order]) if order else (None, [])
    out = []
    for s, upper in zip(order, above):
        for r, lower in zip(sources[s], below[s][1]):
            chosen = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]) if chosen else r["text"]
            folded = leaf_of(r | {"text": text})
            for a, b in lower + upper:
                folded = h([*a, folded, *b])
            proof = h(x for a, b in lower + upper for x in a + b)
            out.append((r["doc_id"], leaf_of(r), below[s][0], root, proof, folded, folded == root))
    return out


def rows_of(n, n_sources=3, hot=0.5):
    return [{"doc_id": i, "text": f"Text {i % 7}" * (i % 3), "lang": None if i % 11 == 0 else "en", "source": "hot" if i < n * hot else f"s{i % n_sources}", "n_chars": i} for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], DOCUMENTS)
    got = [tuple(r) for r in merkle.case_tampered(df).collect()]
    assert sorted(got, key=repr) == sorted(by_force(rows), key=repr)
    return got


@pytest.mark.parametrize("copies", [1, 1024])
def test_a_hot_source_and_many_sources(spark, monkeypatch, copies):
    monkeypatch.setattr(merkle, "PER_COPY", copies)
    got = check(spark, rows_of(700, 40))
    assert len({r[3] for r in got}) == 1 and 0 < sum(not r[6] for r in got) < 200


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source(spark, n):
    got = check(spark, rows_of(n, 1, 1.0))
    assert all(r[2] == r[3] for r in got)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows and ids, empty and very long texts, a source named like a mark of the tree, lone leaves."""
    rows = [{"doc_id": i, "text": t, "lang": None, "source": s, "n_chars": None} for i, t, s in [
        (None, None, None), (None, None, None), (None, "ABC", "^"), (5, None, ""), (7, "", ""), (7, "Ünïcödé A", ""), (7, "", ""), (3, "A" * 300_000, "="), (-4, "x", "é"), (2**62, "Y z", "é"),
    ]]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    rows = rows_of(40)
    extra = "doc_id long, text string, lang string, source string, n_chars long, leaf int, tree string, idx string, root int, `a.b` int, kids map<string,int>"
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) + (1, "t", "i", 2, 3, {"a": 1}) for r in rows], extra)
    assert sorted(map(tuple, merkle.case_tampered(df).collect()), key=repr) == sorted(by_force(rows), key=repr)
    empty = merkle.case_tampered(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_equal_rows_are_numbered_apart(spark):
    """A third of all rows equal: no partition of the numbering holds them all, and places have no gap."""
    df = spark.range(9000).selectExpr("if(id % 3 = 0, 1L, id) as doc_id", "'=s' as tree")
    out = merkle.numbered(df, ["tree"], ["doc_id"]).collect()
    assert sorted(r.idx for r in out) == list(range(9000))
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.idx)]
    assert ids == sorted(ids)
