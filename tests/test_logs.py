"""Golden session logs, hand-computed ledgers, incremental refresh."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.labels import short_model
from tallyspark.functions.timebuckets import parse_timestamp
from tallyspark.plans.ledger_view import ledger as ledger_of
from tallyspark.plans.ledger_view import usage_lines
from tallyspark.sources import incremental, logs, names, pricing, scratch
from tallyspark.sources.schemas import LEDGER


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines), encoding="utf-8")


def message(ts, rid, mid, model="m", usage=None):
    return {"timestamp": ts, "requestId": rid, "message": {"id": mid, "model": model, "usage": {"input_tokens": 1, "output_tokens": 2} if usage is None else usage}}


def test_usage_log(spark, tmp_path):
    t = "2025-12-11T23:18:08Z"
    write(tmp_path / "one/projects/p/a.jsonl", [
        message(t, "r1", "a"), message(t, "r1", "a", usage={"input_tokens": 99}), message(t, None, "b"), message(t, None, "b"), message(t, "r2", "c", usage={}), {"timestamp": t, "message": {"id": "x"}},
        "", "  ", "{broken", "[1, 2]", message(t, "r3", "d", model=None), message("junk", "r4", "e", usage={"input_tokens": None, "output_tokens": 5, "cache_read_input_tokens": 7, "cache_creation_input_tokens": 8}),
    ])
    write(tmp_path / "two/q.jsonl", [message(t, "r1", "a", usage={"input_tokens": 50}), message(None, "r9", "z")])
    lines = logs.read_lines(spark, [str(tmp_path / "one"), str(tmp_path / "missing"), str(tmp_path / "two")])
    assert logs.quarantine(lines).count() == 2
    assert sorted(r.ord for r in lines.where(F.contains("source_file", F.lit("a.jsonl"))).collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10, 11]
    rows = logs.usage_log(lines).collect()
    seen = sorted((r.message_id, r.request_id or "", r.model, r.input_tokens, r.output_tokens, r.cache_read_tokens, r.extra_tokens, r.event_ts) for r in rows)
    at = datetime(2025, 12, 11, 23, 18, 8)
    assert seen == [
        ("a", "r1", "m", 1, 2, 0, 0, at), ("b", "", "m", 1, 2, 0, 0, at), ("b", "", "m", 1, 2, 0, 0, at), ("d", "r3", "unknown", 1, 2, 0, 0, at), ("e", "r4", "m", 0, 5, 7, 8, None), ("z", "r9", "m", 1, 2, 0, 0, None),
    ]
    assert {r.extra_kind for r in rows} == {"cache_creation"} and {r.vendor for r in rows} == {"Claude"}


def test_split_files_keep_their_order(spark, tmp_path):
    (tmp_path / "s").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"s/{name}.jsonl").write_text("\n".join("" if i % 9 == 4 else f'{{"n": {i}}}' for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = logs.read_lines(spark, [str(tmp_path / "s")], whole=False).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 2 * sum(i % 9 != 4 for i in range(5000)) and all(json.loads(r.line)["n"] == r.ord for r in rows)


def count(ts, i, c, o, r):
    return {"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r}}}}


def context(ts, **payload):
    return {"type": "turn_context", "timestamp": ts, "payload": payload}


def test_event_log(spark, tmp_path):
    t = [f"2025-01-01T00:0{i}:00Z" for i in range(10)]
    write(tmp_path / "s/2025/01/01/a.jsonl", [
        {"type": "session_meta", "timestamp": t[0], "payload": {"timestamp": "2024-12-31T23:59:00Z"}}, count(t[0], 100, 40, 10, 4), context(t[1], model="x"), count(t[1], 1, 0, 1, 0), count(t[2], 1, 0, 1, 0),
        context(t[3], model="", effort="high"), count(t[3], 2, 0, 1, 0), "{bad", {"type": "event_msg", "timestamp": t[4], "payload": {"type": "token_count", "info": None}}, count(t[4], 1, 0, 1, 0), context(t[5], model="y"), count(t[5], 3, 1, 1, 1),
    ])
    write(tmp_path / "s/b.jsonl", [count(t[7], 5, 5, 5, 5), count(t[6], 5, 5, 5, 5)])
    lines = logs.read_lines(spark, [str(tmp_path / "s")])
    rows = [r for r in logs.event_log(lines).orderBy("source_file", "ord").collect()]
    assert [(r.model, r.effort, r.model_key, r.input_tokens, r.cache_read_tokens, r.output_tokens, r.extra_tokens) for r in rows] == [
        ("unknown", "unknown", "unknown (unknown)", 60, 40, 6, 4), ("x", "unknown", "x (unknown)", 1, 0, 1, 0), ("x", "high", "x (high)", 2, 0, 1, 0), ("x", "high", "x (high)", 1, 0, 1, 0), ("y", "high", "y (high)", 2, 1, 0, 1),
        ("unknown", "unknown", "unknown (unknown)", 0, 5, 0, 5),
    ]
    sessions = logs.event_log_sessions(lines)
    bounds = {r.source_file.rsplit("/", 1)[1]: (r.session_start, r.session_end) for r in sessions.collect()}
    assert bounds == {"a.jsonl": (datetime(2024, 12, 31, 23, 59), datetime(2025, 1, 1, 0, 5)), "b.jsonl": (datetime(2025, 1, 1, 0, 6), datetime(2025, 1, 1, 0, 7))}
    assert {r.session_start for r in logs.with_session_spans(logs.event_log(lines), sessions).collect()} == {b[0] for b in bounds.values()}


def test_session_documents(spark, tmp_path):
    tokens = {"input": 8493, "cached": 3207, "output": 37, "thoughts": 190, "tool": 5, "total": 1}
    good = {"type": "gemini", "timestamp": "2025-12-11T23:18:08Z", "model": "g", "tokens": tokens}
    doc = {"messages": [good, good | {"type": "user"}, {k: v for k, v in good.items() if k != "tokens"}, good | {"timestamp": None}, {k: v for k, v in good.items() if k != "model"}, good | {"tokens": {}}]}
    write(tmp_path / "tmp/h/chats/session-1.json", [json.dumps(doc, indent=2)])
    write(tmp_path / "tmp/h/chats/session-2.json", ["{broken"])
    write(tmp_path / "tmp/h/chats/session-3.json", [{"messages": []}])
    write(tmp_path / "tmp/h/chats/other.json", [doc])
    docs = logs.read_documents(spark, [str(tmp_path / "tmp")])
    assert [r.source_file.rsplit("/", 1)[1] for r in logs.broken_documents(docs).collect()] == ["session-2.json"]
    rows = logs.session_documents(docs).orderBy("ord").collect()
    assert [(r.ord, r.model, r.input_tokens, r.cache_read_tokens, r.output_tokens, r.extra_tokens, r.extra_kind) for r in rows] == [(0, "g", 5286, 3207, 37, 190, "thinking"), (4, "unknown", 5286, 3207, 37, 190, "thinking")]


def test_all_layouts_and_sink(spark, tmp_path):
    t = "2025-12-11T23:18:08Z"
    write(tmp_path / "u/a.jsonl", [message(t, "r", "i")])
    write(tmp_path / "e/a.jsonl", [count(t, 1, 0, 1, 0)])
    ledger = logs.read_ledger(spark, [str(tmp_path / "u")], [str(tmp_path / "e")], [str(tmp_path / "nowhere")])
    logs.write_ledger(ledger, str(tmp_path / "ledger"))
    back = spark.read.parquet(str(tmp_path / "ledger"))
    assert sorted(r.vendor for r in back.collect()) == ["Claude", "Codex"] and {str(r.event_date) for r in back.collect()} == {"2025-12-11"}


@pytest.mark.parametrize("text,want", [
    ("2025-12-11T23:18:08Z", datetime(2025, 12, 11, 23, 18, 8)), ("2025-12-11T23:18:08.5+02:00", datetime(2025, 12, 11, 21, 18, 8, 500000)), ("2025-12-11", datetime(2025, 12, 11)),
    ("20251211T231808Z", datetime(2025, 12, 11, 23, 18, 8)), ("2025", None), ("junk", None), ("", None), (None, None), ("2025-13-01T00:00:00Z", None),
])
def test_parse_timestamp(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(parse_timestamp(F.col("t")).alias("t")).first().t == want


def test_incremental(spark, tmp_path):
    t = "2025-12-11T23:18:08Z"
    root = tmp_path / "r"
    write(root / "a.jsonl", [message(t, "1", "a")])
    write(root / "b.jsonl", [message(t, "2", "b")])
    calls = []

    def parse(paths):
        calls.append(paths.count())
        return logs.usage_log(logs.read_lines(spark, [str(root)], listing=paths))

    def settled(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    ledger, manifest = incremental.refresh(spark, [str(root)], "*.jsonl", spark.createDataFrame([], incremental.MANIFEST), spark.createDataFrame([], LEDGER), parse)
    ledger, manifest = settled(ledger, "l1"), settled(manifest, "m1")
    write(root / "a.jsonl", [message(t, "1", "a"), message(t, "3", "grown")])
    write(root / "c.jsonl", [message(t, "4", "c")])
    (root / "b.jsonl").unlink()
    ledger, manifest = incremental.refresh(spark, [str(root)], "*.jsonl", manifest, ledger, parse)
    assert sorted(r.message_id for r in ledger.collect()) == ["a", "c", "grown"] and calls == [2, 2] and manifest.count() == 2


def test_repeats_over_refreshes(spark, tmp_path):
    """A message of an old and of a new file counts once; it comes back when the file that won goes."""
    t, root = "2025-12-11T23:18:08Z", tmp_path / "r"
    write(root / "b.jsonl", [message(t, "1", "a"), message(t, "2", "b")])
    parse = lambda listing: logs.usage_rows(logs.read_lines(spark, [str(root)], listing=listing))
    ledger, manifest = spark.createDataFrame([], LEDGER), spark.createDataFrame([], incremental.MANIFEST)
    for k, want in enumerate([[("a", "b"), ("b", "b")], [("a", "a"), ("b", "b")], [("a", "b"), ("b", "b")]]):
        if k == 1:
            write(root / "a.jsonl", [message(t, "1", "a")])
        if k == 2:
            (root / "a.jsonl").unlink()
        ledger, manifest = incremental.refresh(spark, [str(root)], "*.jsonl", manifest, ledger, parse)
        for name, df in (("l", ledger), ("m", manifest)):
            df.write.parquet(str(tmp_path / f"{name}{k}"))
        ledger, manifest = (spark.read.parquet(str(tmp_path / f"{name}{k}")) for name in "lm")
        assert sorted((r.message_id, r.source_file[-7]) for r in logs.first_messages(ledger).collect()) == want


def test_a_file_that_grows_while_it_is_parsed(spark, tmp_path):
    """The manifest says what was listed before the parse, so the rows that came meanwhile are parsed next time."""
    t, root = "2025-12-11T23:18:08Z", tmp_path / "r"
    write(root / "a.jsonl", [message(t, "1", "a")])
    parse = lambda listing: logs.usage_rows(logs.read_lines(spark, [str(root)], listing=listing))

    def growing(listing):
        write(root / "a.jsonl", [message(t, "1", "a"), message(t, "2", "b")])
        return parse(listing)

    ledger, manifest = incremental.refresh(spark, [str(root)], "*.jsonl", spark.createDataFrame([], incremental.MANIFEST), spark.createDataFrame([], LEDGER), growing)
    ledger.write.parquet(str(tmp_path / "l"))
    again, _ = incremental.refresh(spark, [str(root)], "*.jsonl", manifest, spark.read.parquet(str(tmp_path / "l")), parse)
    assert sorted(r.message_id for r in logs.first_messages(again).collect()) == ["a", "b"]


def test_files_that_land_do_not_grow_with_users(spark, tmp_path, monkeypatch):
    """Of 400 users' logs few files are made and listed; messages repeat across users, whose names are not in the order of their numbers."""
    import duckdb

    from tallyspark.plans import catalog

    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") * 7919 % 400).alias("user_id"),
        F.lit("view").alias("event_type"), (F.col("id") % 97 + 0.5).alias("value"), F.format_string('{"k": %d}', F.col("id") % 31).alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "t/events.parquet"))
    monkeypatch.setattr(catalog, "shared_folder", lambda _, name: str(tmp_path / name))
    out = catalog.queries()["incremental_refresh"](spark, str(tmp_path / "t"))
    got = sorted((r.day, r.messages, r.input_tokens, r.extra_tokens) for r in out.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/t/events.parquet/*.parquet'")
    want = con.execute(f"SELECT day, messages, input_tokens, extra_tokens FROM ({catalog.oracle_sql()['incremental_refresh']}) ORDER BY 1").fetchall()
    assert got == want and len(got) > 2
    landed = list((tmp_path / "logs/projects").glob("**/part-*.txt"))
    assert 2 <= len(landed) <= 16


def test_ranks_of_roots(spark, tmp_path):
    """Roots with spaces and signs, nested roots, a root whose name begins like another's."""
    t = "2025-12-11T23:18:08Z"
    roots = [str(tmp_path / n) for n in ("a b", "a b/in+ner", "a b%20c", "ü")]
    for i, r in enumerate(roots):
        write(tmp_path / r / "x.jsonl", [message(t, "r", "same", usage={"input_tokens": i + 1}), message(t, "r", f"own{i}")])
    for order in (roots, roots[::-1]):
        for whole in (None, True, False):
            lines = logs.read_lines(spark, order, whole=whole)
            assert {(r.source_file.rsplit("/", 1)[0].removeprefix("file:"), r.root_rank) for r in lines.collect()} == {(r, i) for i, r in enumerate(order)}
        (one,) = logs.usage_log(logs.read_lines(spark, order)).where("message_id = 'same'").collect()
        assert one.input_tokens == roots.index(order[0]) + 1


def test_both_readers_give_the_same_rows(spark, tmp_path, monkeypatch):
    for name, n in (("a", 5), ("b", 4000)):
        write(tmp_path / f"s/{name}.jsonl", ["" if i % 9 == 4 else f'{{"n": {i}}}' for i in range(n)])
    seen = lambda **k: sorted(tuple(r) for r in logs.read_lines(spark, [str(tmp_path / "s")], **k).collect())
    want = seen(whole=True)
    monkeypatch.setattr(logs, "WHOLE_BYTES", 1000)
    assert seen() == seen(whole=False) == want and len(want) > 3000


def test_vendor_roots(monkeypatch):
    for v in ("CLAUDE_CONFIG_DIR", "CODEX_CONFIG_DIR", "GEMINI_CONFIG_DIR"):
        monkeypatch.delenv(v, raising=False)
    monkeypatch.setenv("HOME", "/h")
    assert logs.vendor_roots("Claude") == ["/h/.config/claude/projects", "/h/.claude/projects"]
    assert logs.vendor_roots("Codex") == ["/h/.codex/sessions"] and logs.vendor_roots("Gemini") == ["/h/.gemini/tmp"]
    assert logs.vendor_roots("Claude", " /a , ,/b/") == ["/a/projects", "/b/projects"]
    monkeypatch.setenv("CODEX_CONFIG_DIR", "/c,d")
    assert logs.vendor_roots("Codex") == ["/c,d/sessions"]


def test_usage_log_scans_once(spark, data):
    plan = logs.usage_log(usage_lines(ledger_of(spark, data)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_names(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps({"_note": {}, "Codex": {"gpt-5-codex": {"short": "GPT-5 Codex", "order": 2}, "x": {"short": "X"}}}))
    assert sorted((r.model, r.short_name, r.sort_order) for r in names.read_names(spark, str(tmp_path / "n.json")).collect()) == [("gpt-5-codex", "GPT-5 Codex", 2), ("x", "X", None)]
    known = names.known_names(spark)
    assert known.count() == 27 and known.where("sort_order is not null").count() == 5
    one = spark.createDataFrame([("a-very-long-model", "high", None), ("a-very-long-model", None, None), ("o3", "low", "o3")], "m string, e string, k string")
    assert [r.n for r in one.select(short_model(F.col("m"), F.col("e"), F.col("k")).alias("n")).collect()] == ["a-very-lon(H)", "a-very-long-", "o3(L)"]


def test_shared_folder_is_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://x"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="checkpoint"):
        scratch.shared_folder(Session, "x")


def test_pricing(spark, tmp_path):
    price = {"input": 1.5, "output": 7.5, "cache_input": 0.15, "cache_output": 1.875, "_comment": "note"}
    (tmp_path / "p.json").write_text(json.dumps({"_meta": {"about": 1}, "claude": {"subscription_price": 200, "models": {"a": price, "b": price}, "default": price}, "gemini": {"subscription_price": 19.99, "models": {}, "default": price}}, indent=1))
    prices, defaults = pricing.read_pricing(spark, str(tmp_path / "p.json"))
    assert sorted((r.vendor, r.model, float(r.cache_output)) for r in prices.collect()) == [("Claude", "a", 1.875), ("Claude", "b", 1.875)]
    assert sorted((r.vendor, float(r.subscription_price)) for r in defaults.collect()) == [("Claude", 200.0), ("Gemini", 19.99)]
