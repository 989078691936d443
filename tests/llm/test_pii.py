"""Personal data: the forms against Python's own regular expressions, the bootstrap against a plain loop."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pii
from tallyspark.llm.queries import op12_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d *= 1 + k % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_by_force(text):
    out = []
    for order, (kind, form) in enumerate(PLAIN.items(), 1):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((order, m.start(), m.end()))
    return out


def extra_by_force(texts):
    """Per text the spans that contexts add, by the rules of the docstring in plain loops."""
    occurrences = []
    for n, text in enumerate(texts):
        text = text or ""
        base = base_by_force(text)
        for order, kind in enumerate([*pii.KINDS, "other"], 1):
            matches = list(re.finditer(pii.CANDIDATE if kind == "other" else PLAIN[kind], text))
            for k, m in enumerate(matches):
                if kind != "other" and (order, m.start(), m.end()) not in base:
                    continue
                value = m.group().rstrip(".-") if kind == "other" else m.group()
                a, b = m.start(), m.start() + len(value)
                if kind == "other" and (any(x < b and y > a for _, x, y in base) or not re.search("[0-9@]", value)):
                    continue
                before = text[matches[k - 1].end() if k else 0 : m.start()][-64:]
                after = text[m.end() : matches[k + 1].start() if k + 1 < len(matches) else len(text)][:64]
                w, v = (re.sub("[0-9]+", "0", s.lower()).split() for s in (before, after))
                patterns = ["< " + " ".join(w[-2:])] * (len(w) > 1) + ["> " + " ".join(v[:2])] * (len(v) > 1) + (["= " + w[-1] + " " + v[0]] if w and v else [])
                occurrences.append((n, kind, a, b, value.lower(), patterns))
    edges = {}
    for _, kind, _, _, value, patterns in occurrences:
        for p in patterns:
            edges.setdefault((p, value), set()).add(kind)
    seeds = {e: min(k - {"other"}) for e, k in edges.items() if k - {"other"}}
    classes = lambda v: set(re.sub("[0-9]", "0", re.sub(r"[^\W\d_]", "a", v)))
    shapes = {k: [v for _, kind, _, _, v, _ in occurrences if kind == k] for k in pii.KINDS}
    taken = {}
    for _ in range(pii.ROUNDS):
        weight = {}
        for e in edges:
            kind, score = (seeds[e], 1.0) if e in seeds else taken.get(e[1], (None, 0.0))
            weight.setdefault(e[0], []).append((kind, score))
        sure = {}
        for p, found in weight.items():
            by = {k: (sum(s for x, s in found if x == k), k, sum(s >= pii.CONFIDENT for x, s in found if x == k)) for k in {x for x, _ in found} - {None}}
            if by:
                w, kind, n = max(by.values())
                confidence = w / (sum(s for _, s in found) + pii.UNKNOWN * sum(1 - s for _, s in found))
                if n >= pii.SUPPORT and confidence >= pii.CONFIDENT:
                    sure[p] = (kind, confidence)
        reached = {}
        for p, v in edges:
            if (p, v) not in seeds and p in sure:
                reached.setdefault((v, sure[p][0]), []).append(sure[p][1])
        before, taken, best = taken, {}, {}
        for (v, kind), cs in reached.items():
            score = 1 - math.exp(sum(math.log(max(1 - c, 1e-6)) for c in cs))
            best[v] = max(best.get(v, (0, "")), (round(score, 9), kind))
        for v, (score, kind) in best.items():
            sizes = [len(s) for s in shapes[kind]]
            if score >= pii.CONFIDENT and classes(v) <= set().union(*map(classes, shapes[kind])) and min(sizes) / 3 <= len(v) <= 3 * max(sizes) and (kind == "email") == ("@" in v):
                taken[v] = (kind, score)
        if len(before) == len(taken) and before:
            break
    out = [[] for _ in texts]
    for n, kind, a, b, value, _ in occurrences:
        if kind == "other" and value in taken:
            out[n].append((pii.KINDS.index(taken[value][0]) + 1, a, b))
    return [sorted(s) for s in out]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(pii.find_pii(df).collect())
    return [[tuple(s) for s in r.base] for r in rows], [[tuple(s) for s in r.extra] for r in rows]


ODD = [
    None, "", "a@b.c_d@e.f x@y@z.com", "..@a-.b a@b", "é1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255", "1.2.3 4.5.6.7", "4111 1111 1111 1111 4111-1111-1111-1112 0", "+1 (017) 555-7713. +12 +1", "😀 u@d.e 😀 +49 30 1234567)",
    "a@b.cc.dd.@e.f", "%@1.2.3.4", "12345678901234567890123", "+1(2)3.4-5 67890+1234567890", "- 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 -", "a@b.c\na@b.c\n", "A" * 70 + " 9 " + "b" * 70,
]


def test_forms(spark):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("a0 1.@-+()_9é") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    base, extra = found(spark, texts)
    assert base == [base_by_force(t) for t in texts]
    assert extra == extra_by_force(texts)


def test_query_on_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    extras = extra_by_force([r.text for r in docs])
    for r, extra in zip(docs, extras):
        spell = lambda s: ",".join(f"{pii.KINDS[o - 1]}:{a}:{b}" for o, a, b in sorted(s))
        base = base_by_force(r.text)
        want[r.doc_id] = (*[sum(o == k for o, _, _ in base) for k in (1, 2, 3, 4)], __import__("hashlib").sha256(spell(base).encode()).hexdigest(), spell(base + extra))
    assert {r.doc_id: tuple(r)[1:] for r in op12_pii(spark, data).collect()} == want


def bodies(rng):
    """Texts in which contexts give away identifiers that no form matches, and numbers in other contexts."""
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "echo", "fox", "golf", "hotel"])
    texts = []
    for i in range(30):
        texts.append(f"{word()} please write to user{i}@mail{i % 5}.example.com about {word()} {word()}")
        texts.append(f"{word()} call me at +1 (555) 01{i:02d}-77{i:02d} after {word()}")
        texts.append(f"in {1900 + i} there were {i} of {word()} {word()} and {word()}")
    hidden = ["write to root@localhost about tea", "please write to kim@intranet about it", "so call me at 555-0142 after nine", "call me at (555) 0143-7700 after ten"]
    return texts + [f"{word()} {h}" for h in hidden] + ["she said root@localhost again", "room 555-0142 is here", "we call me at noon"], 4


def test_contexts_discover_unseen_identifiers(spark):
    texts, n = bodies(random.Random(3))
    base, extra = found(spark, texts)
    assert extra == extra_by_force(texts)
    said = {(t[a:b], pii.KINDS[o - 1]) for t, e in zip(texts, extra) for o, a, b in e}
    assert said == {("root@localhost", "email"), ("kim@intranet", "email"), ("555-0142", "phone"), ("(555) 0143-7700", "phone")}
    again = [e for t, e in zip(texts, extra) if t in ("she said root@localhost again", "room 555-0142 is here")]
    assert all(len(e) == 1 for e in again) and not any(e for t, e in zip(texts, extra) if t.startswith("in 19"))


def test_copies_of_one_text_are_no_support(spark):
    texts = ["please write to a@b.example about it"] * 300 + ["please write to b@intranet about it"]
    assert found(spark, texts)[1] == [[]] * 301


def test_odd_tables(spark):
    shape = "doc_id long, text string, row int, found string, kind string, `a.b` int, value map<string,int>"
    df = spark.createDataFrame([(None, "x a@b.cc", 1, "f", "k", 2, None), (None, "x a@b.cc", 1, "f", "k", 2, None), (4, None, 1, "f", "k", 2, {"a": 1})], shape)
    rows = pii.find_pii(df).select("doc_id", pii.written(F.col("base")).alias("s")).collect()
    assert sorted(map(tuple, rows), key=repr) == [(4, ""), (None, "email:2:8"), (None, "email:2:8")]
    assert pii.find_pii(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "a@b" + ".c" * 300_000, "1.1" * 300_000, "+1" * 300_000, "a@" * 300_000, "1 " * 300_000, "user@mail.example.com +1 (555) 555-1234 " * 10_000])
def test_long_texts_take_linear_time(spark, text):
    base, _ = found(spark, [text])
    if len(text) < 500_000:
        assert base == [base_by_force(text)]
    assert len(base) == 1


def test_no_python_worker(spark, data):
    df = op12_pii(spark, data)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
