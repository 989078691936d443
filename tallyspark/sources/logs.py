"""Session logs of three layouts as one ledger.

Lines are read as text and parsed against explicit schemas. What cannot be parsed is returned by
``quarantine``, never dropped silently. Line order matters to the event log and to repeats: files are
read whole, with lines numbered inside, unless they are large, which Spark splits; the lines of each
split are then counted, and what comes before a split is added to the places inside it. Event logs
are taken in segments of bounded length, each of which starts from what the ones before it carry out.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timebuckets import parse_timestamp
from ..operators.normalize import carry_forward, carry_in, drop_repeats, first_seen, model_key, session_bounds
from .schemas import EVENT_LOG, LEDGER_COLUMNS, SESSION_DOCUMENT, USAGE, USAGE_LOG

NEW_LINE = "\r\n|\n|\r"


#: Files up to this size are read whole, one value each; larger ones are split by Spark and their lines numbered after.
WHOLE_BYTES = 32 << 20
#: Lines of an event log that one task takes in order.
SEGMENT = 1 << 17
#: Where each vendor's tool keeps its logs, and the variable that overrides it.
ROOTS = {"Claude": ("CLAUDE_CONFIG_DIR", ["~/.config/claude", "~/.claude"]), "Codex": ("CODEX_CONFIG_DIR", ["~/.codex"]), "Gemini": ("GEMINI_CONFIG_DIR", ["~/.gemini"])}
INSIDE = {"Claude": "projects", "Codex": "sessions", "Gemini": "tmp"}


def vendor_roots(vendor: str, override: str | None = None) -> list[str]:
    """The folders of a vendor's logs, first rank first: of the override, else of the environment, else the defaults.

    Only the first vendor's override may name several folders, separated by commas.
    """
    variable, defaults = ROOTS[vendor]
    given = override or os.environ.get(variable)
    named = ([p.strip() for p in given.split(",") if p.strip()] if vendor == "Claude" else [given]) if given else [os.path.expanduser(p) for p in defaults]
    return [f"{p.rstrip('/')}/{INSIDE[vendor]}" for p in named]


def existing(spark: SparkSession, roots: list[str]) -> list[str]:
    """The roots that exist, in their order; asked of the file system that Spark itself uses."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    return [r for r in roots if path(r).getFileSystem(conf).exists(path(r))]


def file_path(given: str = "_metadata.file_path") -> Column:
    """The path of the file that a row was read from, as the file system spells it."""
    return F.url_decode(F.replace(F.col(given), F.lit("+"), F.lit("%2B")))


def _file() -> list[Column]:
    return [file_path().alias("source_file"), F.col("_metadata.file_modification_time").alias("_modified")]


def _root_rank(spark: SparkSession, roots: list[str]) -> Column:
    """Which root a file is under, from 0; of nested roots the innermost, of equal ones the first."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(r) for r in roots]
    places = [p.getFileSystem(conf).makeQualified(p).toString().rstrip("/") + "/" for p in paths]
    out = F.lit(len(roots))
    for i in sorted(range(len(roots)), key=lambda i: (len(places[i]), -i)):
        out = F.when(F.startswith("source_file", F.lit(places[i])), i).otherwise(out)
    return out


def _recent(files: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Files that are not older than the oldest listed one; Spark does not open others."""
    if listing is None:
        return files
    oldest = listing.agg(F.min("modified")).first()[0]
    return files.where(F.col("_metadata.file_modification_time") >= F.lit(oldest)) if oldest else files.where(F.lit(False))


def _listed(rows: DataFrame, listing: DataFrame | None) -> DataFrame:
    """Rows (with ``source_file``) of the listed files."""
    return rows if listing is None else rows.join(listing.select(F.col("path").alias("source_file")), "source_file", "left_semi")


def read_lines(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl", whole: bool | None = None, listing: DataFrame | None = None) -> DataFrame:
    """(source_file, root_rank, ord, line): the lines that are not blank, numbered in their file.

    ``whole``: True reads files as one value each, which suits many session files; False splits them and
    orders their lines by the place of the split and the order inside it; both give the same rows. Left
    out, the size of each file decides (``WHOLE_BYTES``). ``listing``: (path, modified); other files of the
    roots are left aside.
    """
    roots = existing(spark, roots)
    if not roots:
        return spark.createDataFrame([], "source_file string, root_rank int, ord int, line string")
    small = F.col("_metadata.file_size") <= WHOLE_BYTES
    if whole is None:
        return _whole_lines(spark, roots, pattern, listing, small).unionByName(_split_lines(spark, roots, pattern, listing, ~small))
    return (_whole_lines if whole else _split_lines)(spark, roots, pattern, listing, F.lit(True))


def _whole_lines(spark: SparkSession, roots: list[str], pattern: str, listing: DataFrame | None, which: Column) -> DataFrame:
    files = _recent(spark.read.text(roots, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).where(which), listing).select(file_path().alias("source_file"), "value")
    return _trimmed(_listed(files, listing).select("source_file", F.posexplode(F.split("value", NEW_LINE)).alias("ord", "line")), _root_rank(spark, roots))


def _split_lines(spark: SparkSession, roots: list[str], pattern: str, listing: DataFrame | None, which: Column) -> DataFrame:
    files = _recent(spark.read.text(roots, recursiveFileLookup=True, pathGlobFilter=pattern).where(which), listing)
    placed = files.select(file_path().alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    return _trimmed(_numbered(_listed(placed, listing)), _root_rank(spark, roots))


def _numbered(placed: DataFrame) -> DataFrame:
    """Lines (source_file, _block, _id) with ``ord``, their place in the file; ids rise inside a split, without a gap.

    One pass counts the lines of each split; the few counts of a file are summed, and the second pass adds the sum to
    the place in the split. Should Spark split the files otherwise in that pass, the query fails.
    """
    splits = split_ends(placed, ["source_file", "_block"])
    return placed_lines(placed, with_base(splits, ["source_file"], ["_block"]), ["source_file", "_block"])


def split_ends(placed: DataFrame, split: list[str], *more: Column) -> DataFrame:
    """(split, _low, _high, more): the first and last id of each split."""
    return placed.groupBy(*split).agg(F.min("_id").alias("_low"), F.max("_id").alias("_high"), *more)


def with_base(splits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Splits with ``_base``, how many lines come before them in ``by``."""
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_base", F.coalesce(F.sum(F.col("_high") - F.col("_low") + 1).over(earlier), F.lit(0)))


def placed_lines(placed: DataFrame, base: DataFrame, split: list[str]) -> DataFrame:
    met = placed.join(base, split, "left")
    place = F.when((F.col("_id") >= F.col("_low")) & (F.col("_id") <= F.col("_high")), F.col("_id") - F.col("_low") + F.col("_base"))
    return met.withColumn("ord", F.coalesce(place, F.raise_error(F.lit("files were split in two ways; run again")).cast("long")).cast("int"))


def _trimmed(lines: DataFrame, rank: Column) -> DataFrame:
    return lines.withColumn("line", F.trim("line")).where(F.col("line") != "").select("source_file", rank.alias("root_rank"), "ord", "line")


def _is_object(line: Column) -> Column:
    return F.startswith(line, F.lit("{")) & F.try_parse_json(line).isNotNull()


def quarantine(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON objects."""
    return lines.where(~_is_object(F.col("line")))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.where(_is_object(F.col("line"))).withColumn("r", F.from_json("line", schema))


def _counter(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def _ledger(df: DataFrame) -> DataFrame:
    missing = {c: F.lit(None).cast("string") for c in ("source_root", "effort", "message_id", "request_id") if c not in df.columns}
    df = df.withColumns(missing | {"event_ts": parse_timestamp(F.col("ts_raw")), "model_key": model_key(F.col("model"), F.col("effort") if "effort" in df.columns else F.lit(None).cast("string"))})
    if "session_start" not in df.columns:
        df = df.withColumns({"session_start": F.col("event_ts"), "session_end": F.col("event_ts")})
    return df.select(*LEDGER_COLUMNS)


def usage_rows(lines: DataFrame) -> DataFrame:
    """The records with usage, repeats too."""
    usage = F.col("r.message.usage")  # still text: an empty object is no usage, whatever a schema sees in it
    # a generator of one row keeps the filter above it from parsing each line once more
    found = lines.where(_is_object(F.col("line"))).select("*", F.explode(F.array(F.from_json("line", USAGE_LOG))).alias("r"))
    some = found.where(F.rlike(usage, F.lit(r"^\{\s*[^\s}]")))
    rows = some.withColumn("u", F.from_json(usage, USAGE)).select(
        F.lit("Claude").alias("vendor"), F.col("root_rank").cast("string").alias("source_root"), "root_rank", "source_file", "ord", F.col("r.timestamp").alias("ts_raw"),
        F.coalesce("r.message.model", F.lit("unknown")).alias("model"), F.col("r.message.id").alias("message_id"), F.col("r.requestId").alias("request_id"),
        _counter("u.input_tokens").alias("input_tokens"), _counter("u.output_tokens").alias("output_tokens"),
        _counter("u.cache_read_input_tokens").alias("cache_read_tokens"), _counter("u.cache_creation_input_tokens").alias("extra_tokens"),
        F.lit("cache_creation").alias("extra_kind"),
    )
    return _ledger(rows)


def first_messages(rows: DataFrame) -> DataFrame:
    """The first of each message and request, over all files of the ledger."""
    ranked = rows.withColumn("_rank", F.col("source_root").cast("int"))
    return first_seen(ranked, ["message_id", "request_id"], ["_rank", "source_file", "ord"]).select(*rows.columns)


def usage_log(lines: DataFrame) -> DataFrame:
    """One record per message: keep those with usage; the first of each message and request stays."""
    return first_messages(usage_rows(lines))


COUNTS = "struct<input_tokens: long, cached_input_tokens: long, output_tokens: long, reasoning_output_tokens: long>"
EVENT_STATE = f"source_file string, lines long, newest timestamp, model string, effort string, counts {COUNTS}"


def events(lines: DataFrame) -> DataFrame:
    """(source_file, root_rank, ord, timestamp, model, effort, counts): the events that set model or effort, or count tokens."""
    u = "payload.info.last_token_usage"
    context, counted = F.col("type") == "turn_context", (F.col("type") == "event_msg") & (F.col("payload.type") == "token_count") & F.col(u).isNotNull()
    counters = F.struct(*[_counter(f"{u}.{c}").alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")])
    # a generator of one row keeps the filters above it from parsing each line once more
    found = lines.where(_is_object(F.col("line"))).select("source_file", "root_rank", "ord", F.explode(F.array(F.from_json("line", EVENT_LOG))).alias("r"))
    return found.select("source_file", "root_rank", "ord", "r.*").where(context | counted).select(
        "source_file", "root_rank", "ord", "timestamp", F.when(context, F.nullif("payload.model", F.lit(""))).alias("model"),
        F.when(context, F.nullif("payload.effort", F.lit(""))).alias("effort"), F.when(counted, counters).alias("counts"))


def _as_events(state: DataFrame) -> DataFrame:
    """What sessions have carried out so far, as an event before all others."""
    return state.select("source_file", F.lit(None).cast("int").alias("root_rank"), F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("timestamp"), "model", "effort", "counts")


def event_log(lines: DataFrame, segment: int = SEGMENT, state: DataFrame | None = None) -> DataFrame:
    """Events in file order: model and effort carry forward, repeated counts drop, parts become disjoint.

    One shuffle, by file and segment of ``segment`` lines, so that a session of any length is many tasks. What segments
    carry out is aggregated from the same shuffle; a file has few segments, so these small rows meet by file.
    ``state`` (``event_state``): where sessions of these files stood before the first of the lines.
    """
    return event_rows(events(lines), segment, state)


def event_rows(found: DataFrame, segment: int = SEGMENT, state: DataFrame | None = None) -> DataFrame:
    """``event_log`` of what ``events`` has found."""
    by = ["source_file", "_segment"]
    every = (found if state is None else found.unionByName(_as_events(state))).withColumn("_segment", F.floor(F.col("ord") / segment))
    dealt = every.where(F.col("source_file").isNotNull() & F.col("_segment").isNotNull()).repartition(*by)  # both uses of the events ask for whole keys
    carried = carry_in(dealt, ["source_file"], "_segment", ["ord"], ["model", "effort", "counts"])
    started = dealt.join(carried, by)  # inner, so that both sides get the same filters and share one shuffle
    full = carry_forward(started, by, ["ord"], {c: F.coalesce(c, F.when(F.col("ord") == F.col("_first"), F.col(f"_{c}"))) for c in ("model", "effort")})
    kept = drop_repeats(full.where(F.col("counts").isNotNull()), by, ["ord"], ["counts"], F.col("_counts")).where("ord >= 0")
    n = "counts."
    return _ledger(kept.select(
        F.lit("Codex").alias("vendor"), F.col("root_rank").cast("string").alias("source_root"), "source_file", "ord", F.col("timestamp").alias("ts_raw"), "model", "effort",
        (F.col(f"{n}input_tokens") - F.col(f"{n}cached_input_tokens")).alias("input_tokens"), (F.col(f"{n}output_tokens") - F.col(f"{n}reasoning_output_tokens")).alias("output_tokens"),
        F.col(f"{n}cached_input_tokens").alias("cache_read_tokens"), F.col(f"{n}reasoning_output_tokens").alias("extra_tokens"), F.lit("reasoning").alias("extra_kind"),
    ))


def event_state(found: DataFrame, read: DataFrame, state: DataFrame) -> DataFrame:
    """Where sessions stand after the ``events`` found: lines ``read`` (source_file, _lines) so far, newest time, and the last model, effort and counts."""
    every = found.unionByName(_as_events(state))
    last = every.groupBy("source_file").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col("ord"))).alias(v) for v in ("model", "effort", "counts")], F.max(parse_timestamp(F.col("timestamp"))).alias("_newest"))
    known = state.select("source_file", "lines", "newest")
    return known.join(read, "source_file", "full").join(last, "source_file", "left").select(
        "source_file", F.coalesce("_lines", "lines").alias("lines"), F.greatest("newest", "_newest").alias("newest"), "model", "effort", "counts")


def event_log_sessions(lines: DataFrame) -> DataFrame:
    """(source_file, session_start, session_end) of event logs."""
    events = _parsed(lines, EVENT_LOG).select("source_file", "ord", "r.*")
    return session_bounds(events).select("source_file", parse_timestamp(F.col("started")).alias("session_start"), parse_timestamp(F.col("ended")).alias("session_end"))


def with_session_spans(ledger: DataFrame, sessions: DataFrame) -> DataFrame:
    """The ledger with the bounds of each row's session in place of its own time."""
    bounds = sessions.select("source_file", F.col("session_start").alias("_s"), F.col("session_end").alias("_e"))
    out = ledger.join(bounds, "source_file", "left").withColumns({"session_start": F.coalesce("_s", "session_start"), "session_end": F.coalesce("_e", "session_end")})
    return out.select(*LEDGER_COLUMNS)


def read_documents(spark: SparkSession, roots: list[str], pattern: str = "session-*.json") -> DataFrame:
    """(source_file, root_rank, messages, corrupt): one row per session document; corrupt holds the text of a broken one."""
    roots = existing(spark, roots)
    schema = f"{SESSION_DOCUMENT}, _corrupt STRING"
    if not roots:
        return spark.createDataFrame([], f"source_file string, root_rank int, {SESSION_DOCUMENT}, corrupt string")
    docs = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(roots)
    return docs.select(file_path().alias("source_file"), "messages", F.col("_corrupt").alias("corrupt")).select("source_file", _root_rank(spark, roots).alias("root_rank"), "messages", "corrupt")


def broken_documents(docs: DataFrame) -> DataFrame:
    """(source_file, corrupt): documents that are not JSON objects."""
    return docs.where(F.col("messages").isNull() & F.col("corrupt").isNotNull()).select("source_file", "corrupt")


def session_documents(docs: DataFrame) -> DataFrame:
    """Messages of the model with tokens and a time; cached input is taken out of input."""
    m = docs.select("source_file", "root_rank", F.posexplode("messages").alias("ord", "m"))
    some = F.coalesce(*[F.col(f"m.tokens.{c}") for c in ("input", "output", "cached", "thoughts", "tool", "total")])
    kept = m.where((F.col("m.type") == "gemini") & F.col("m.tokens").isNotNull() & some.isNotNull() & (F.coalesce("m.timestamp", F.lit("")) != ""))
    return _ledger(kept.select(
        F.lit("Gemini").alias("vendor"), F.col("root_rank").cast("string").alias("source_root"), "source_file", "ord", F.col("m.timestamp").alias("ts_raw"),
        F.coalesce("m.model", F.lit("unknown")).alias("model"), (_counter("m.tokens.input") - _counter("m.tokens.cached")).alias("input_tokens"),
        _counter("m.tokens.output").alias("output_tokens"), _counter("m.tokens.cached").alias("cache_read_tokens"), _counter("m.tokens.thoughts").alias("extra_tokens"),
        F.lit("thinking").alias("extra_kind"),
    ))


def read_ledger(spark: SparkSession, usage_roots: list[str] = [], event_roots: list[str] = [], document_roots: list[str] = [], patterns: tuple[str, str, str] = ("*.jsonl", "*.jsonl", "session-*.json")) -> DataFrame:  # noqa: B006
    """All three layouts in one shape; ``patterns`` are the names of their files."""
    return (
        usage_log(read_lines(spark, usage_roots, patterns[0]))
        .unionByName(event_log(read_lines(spark, event_roots, patterns[1])))
        .unionByName(session_documents(read_documents(spark, document_roots, patterns[2])))
    )


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by vendor and date, a date's rows together; Spark splits a date that is too large for one task."""
    dated = ledger.withColumn("event_date", F.to_date("event_ts"))
    dated.hint("rebalance", "vendor", "event_date").write.mode(mode).partitionBy("vendor", "event_date").parquet(path)
