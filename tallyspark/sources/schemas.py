"""Explicit schemas of the session logs, prices and ledger; nothing is inferred."""

from __future__ import annotations

USAGE_LOG = "timestamp STRING, requestId STRING, message STRUCT<id: STRING, model: STRING, usage: STRING>"
USAGE = "input_tokens LONG, output_tokens LONG, cache_creation_input_tokens LONG, cache_read_input_tokens LONG"
EVENT_LOG = (
    "type STRING, timestamp STRING, payload STRUCT<type: STRING, timestamp: STRING, model: STRING, effort: STRING, "
    "info: STRUCT<last_token_usage: STRUCT<input_tokens: LONG, cached_input_tokens: LONG, output_tokens: LONG, reasoning_output_tokens: LONG>>>"
)
SESSION_DOCUMENT = (
    "messages ARRAY<STRUCT<type: STRING, timestamp: STRING, model: STRING, "
    "tokens: STRUCT<input: LONG, output: LONG, cached: LONG, thoughts: LONG, tool: LONG, total: LONG>>>"
)
PRICE = "STRUCT<input: DECIMAL(12,6), output: DECIMAL(12,6), cache_input: DECIMAL(12,6), cache_output: DECIMAL(12,6)>"
PRICING = f"subscription_price DECIMAL(12,2), models MAP<STRING, {PRICE}>, `default` {PRICE}"
LEDGER = (
    "vendor STRING, source_root STRING, source_file STRING, ord INT, ts_raw STRING, event_ts TIMESTAMP, session_start TIMESTAMP, session_end TIMESTAMP, "
    "model STRING, effort STRING, model_key STRING, message_id STRING, request_id STRING, input_tokens LONG, output_tokens LONG, cache_read_tokens LONG, "
    "extra_tokens LONG, extra_kind STRING"
)
LEDGER_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]
