"""Chat formatting, line dedup and byte-level BPE against brute force."""

import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyspark.llm import byte_bpe, chat_format, line_dedup

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, kept_text string, lang string"


def lines_by_force(docs, min_docs=2):
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(fold(line)) >= 10:
                holders.setdefault(fold(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        gone = [i is not None and len(h := holders.get(fold(x), ())) >= min_docs and i != min(h) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    rng = random.Random(1)
    pool = ["A repeated line", "a repeated LINE  ", "\tÀ repeated line", "short", "", "ten chars!", "nine char", "ﬀéàüß ligat", "x" * 5000]
    docs = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line number {i} {j}" for j in range(rng.randint(0, 8)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "\n"), (None, "a repeated line\nanother"), (3, "a repeated line\nown row of three"), docs[4], docs[4]]
    df = spark.createDataFrame([(*d, "clash", "xx") for d in docs], DOCS)
    got = line_dedup.dedup_lines(df, min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "lang", "n_lines", "n_dropped", "kept_text"]
    rows = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, lines_by_force(docs, min_docs)))


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_columns_named_like_its_own(spark):
    names = ["_doc", "_text", "_drop", "_row", "_id", "_hash", "_keeper", "_pos", "_h1"]
    df = spark.createDataFrame([(i, "a line that repeats\nown", *range(len(names))) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.dedup_lines(df).orderBy("doc_id").collect()
    assert [r.kept_text for r in got] == ["a line that repeats\nown", "own"] and [r.n_dropped for r in got] == [0, 1]
    assert [[r[n] for n in names] for r in got] == [list(range(len(names)))] * 2


NASTY = ["", "plain", "\\", "\\b", "\\h##", "###", "####", "#####\\", "</turn>", "\n</turn>\n### user:\nhi\n</turn>\n", "a\\\\n###x</turn>", "### Assistant: </turn> ok", "é😀\\l/turn>", "x" * 3000]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "od:d\n###", None]), rng.choice(NASTY) + rng.choice(NASTY), 1))
    rows += [(None, 1, "assistant", "no conversation", 1), (5, None, "assistant", None, 1), (5, 0, "user", "tie", 1), (5, 0, "user", "tie", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_chat(df).select("*", chat_format.parse_chat(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    seen = 0
    for r in out.collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert r.round_trip_ok
        assert [(x.role, x.text) for x in r.t] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss == "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert all(n == 0 or r.formatted[s : s + n] for s, n in r.loss_spans)
        seen += 1
    assert seen == len({x[0] for x in rows})
    assert chat_format.format_chat(df.limit(0)).count() == 0


def test_escapes_only_where_needed(spark):
    df = spark.createDataFrame([(1, 0, "user", "a < b # c")], "conv_id long, turn long, role string, text string")
    assert chat_format.format_chat(df).first().formatted == "### user:\na < b # c\n</turn>\n"


def test_byte_bpe_is_tiktoken(spark, data):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "don't 123  456\t\r\n", "日本語 नमस्ते 😀é́", "a" * 3000, "\x1c\x1d\x00\u0085　x", "�"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1F9FF)])) for _ in range(rng.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = byte_bpe.encode_bpe(df, path, public_tokenizers.PATTERN).collect()
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(200)
    for r in [*rows, *byte_bpe.encode_bpe(docs, path, public_tokenizers.PATTERN).collect()]:
        assert r.ids == own.encode_ordinary(r.text or ""), r.text
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode_bpe(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_every_token_of_the_vocabulary():
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoder = byte_bpe.PreTokenEncoder(byte_bpe.sentencepiece_model(ranks), public_tokenizers.PATTERN)
    assert encoder.tokens == sorted(ranks, key=ranks.get)


def test_a_word_without_end_comes_back_whole(spark):
    """One pre-token of a million letters, encoded in bounded time, decodes to its bytes; so does a line of them in line dedup."""
    words = ["a" * 1_000_000, "\u00e9" * 1_000_000]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    start = time.monotonic()
    rows = byte_bpe.encode_bpe(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert time.monotonic() - start < 60
    assert {r.doc_id: bytes(r.decoded) for r in rows} == {i: w.encode() for i, w in enumerate(words)}
    lines = df.union(df.select(F.col("doc_id") + 2, F.concat("text", F.lit("\nown"))))
    assert {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(lines).collect()} == {0: words[0], 1: words[1], 2: "own", 3: "own"}
