"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, jpeg_media, license_scan, line_dedup, merkle, neighbours, packing, pii, quality, simhash_dedup, warc_revisit, whitening
from .common import table

#: The conversation that is added to those of the table: it says what the template itself says.
CONFLICT = r"\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    out = chat_format.format_chat(turns)
    back = out.select(
        "*", chat_format.parse_chat(F.col("formatted")).alias("_turns"),
        chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"),
    )
    said = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "round_trip_ok",
    )


OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, CASE WHEN role SIMILAR TO '.*(\\|:|\n|###|</turn>).*' OR contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>')
    THEN length(replace(replace(replace(text, '\', '\b'), '###', '\h\h\h'), '</turn>', '\l/turn>')) ELSE length(text) END AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + n + 9) AS BIGINT) AS formatted_chars, true AS round_trip_ok
FROM sized GROUP BY conv_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
),
many AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT keyed.*, coalesce(many.keeper < doc_id, false) AS gone FROM keyed LEFT JOIN many ON keyed.k = many.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    out = byte_bpe.encode_bpe(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
    )
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_revisit.resolve_revisits(warc_revisit.captures_of(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return out.withColumn("headers", F.array_join(lines, "\n"))


OP2_SQL = r"""
WITH pages1 AS (
  SELECT page_id, url, md5(html) AS digest, length(html) AS n, '"' || substr(md5(html), 1, 12) || '"' AS tag, page_id * 60 AS t0,
    regexp_replace(url, '^https?://(www\.|m\.)?', 'http://www.') AS variant
  FROM pages WHERE page_id IS NOT NULL
), captures AS (
  SELECT page_id * 4 AS record_id, url, t0 AS ts, true AS is_full, tag, 't' || (t0 - 600) AS changed, 't' || t0 AS dated, NULL AS expires, n, digest FROM pages1
  UNION ALL SELECT page_id * 4 + 1, variant, t0 + 90000, false, CASE WHEN page_id % 5 = 0 THEN '"stale"' ELSE 'W/' || tag END, NULL, 't' || (t0 + 90000), 't' || (t0 + 91000), NULL, NULL FROM pages1
  UNION ALL SELECT page_id * 4 + 2, url, t0 + 500, false, NULL, 't' || CASE WHEN page_id % 7 = 0 THEN t0 ELSE t0 - 600 END, 't' || (t0 + 500), NULL, NULL, NULL FROM pages1
  UNION ALL SELECT page_id * 4 + 3, variant, t0 - 500, false, NULL, NULL, NULL, NULL, NULL, NULL FROM pages1
), cut AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/index\.html?$', ''), '/$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)='))), '&') AS query
  FROM captures WHERE url IS NOT NULL AND url <> ''
), named AS (SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]') THEN place || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE url END AS canonical_url FROM cut
), joined AS (
  SELECT v.record_id, v.canonical_url, v.tag, v.changed, v.dated, v.expires, r.record_id AS refers_to, r.tag AS old_tag, r.changed AS old_changed, r.n, r.digest AS old_digest,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.record_id DESC) AS k
  FROM named v LEFT JOIN named r ON r.is_full AND r.canonical_url = v.canonical_url AND r.ts < v.ts WHERE NOT v.is_full
), judged AS (
  SELECT *, CASE WHEN refers_to IS NULL THEN 'no earlier response'
    WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = old_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN changed IS NOT NULL THEN CASE WHEN changed = old_changed THEN 'resolved' ELSE 'mismatch' END
    ELSE 'no validator' END AS status
  FROM joined WHERE k = 1
)
SELECT record_id, canonical_url, refers_to, status,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || dated || chr(10)
    || 'etag: ' || coalesce(tag, old_tag) || chr(10) || CASE WHEN expires IS NULL THEN '' ELSE 'expires: ' || expires || chr(10) END || 'last-modified: ' || old_changed END AS headers,
  CASE WHEN status = 'resolved' THEN old_digest END AS digest
FROM judged
"""


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), jpeg_media.store_as_jpeg(F.col("text")).alias("media"))
    read = stored.withColumn("r", jpeg_media.read_jpeg(F.col("media")))
    payload = F.col("r.payload")
    feature = F.concat_ws("x", "r.width", "r.height")
    return read.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", feature, "r.n_pictures", F.array_join("r.hashes", ",")).alias("feature"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses")).select("doc_id", "col.*")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    both = F.sort_array(F.concat("base", "extra"))
    return found.select(
        "doc_id", *[pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(both).alias("spans"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.case_tampered(table(spark, sf_dir, "documents"))


def _op13_sql(low: int = 7, high: int = 5) -> str:
    """Levels enough for 16**7 leaves of a source and 16**5 sources; a level without a step above it passes its node on."""
    parts = [r"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
docs AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) AS c FROM documents, crc)"""]
    field = lambda v: f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')"
    head = " || ".join(map(field, ["doc_id", "source", "lang", "n_chars"]))
    parts.append(f"leaves AS (SELECT rid, doc_id, source AS tree, sha256({head} || {field('text')}) AS h, sha256({head} || {field('CASE WHEN c % 5 = 0 THEN translate(text, ' + repr('ABCDEFGHIJKLMNOPQRSTUVWXYZ') + ', ' + repr('abcdefghijklmnopqrstuvwxyz') + ') ELSE text END')}) AS other FROM docs)")
    parts.append("n0 AS (SELECT rid, tree, h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves)")
    parts.append("c0 AS (SELECT rid, tree, idx, '' AS proof, other AS folded FROM leaves JOIN n0 USING (rid, tree, h) WHERE tree IS NOT NULL UNION ALL SELECT l.rid, l.tree, idx, '', other FROM leaves l JOIN n0 USING (rid) WHERE l.tree IS NULL)")
    level = 0

    def rise(levels: int) -> None:
        nonlocal level
        for _ in range(levels):
            k, level = level, level + 1
            parts.append(f"n{level} AS (SELECT tree, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY idx)) END AS h, list(h ORDER BY idx) AS kids, any_value(n) AS m, (any_value(n) + 15) // 16 AS n FROM n{k} GROUP BY tree, idx // 16)")
            before, after = "array_to_string(kids[1:c.idx % 16], '')", "array_to_string(kids[c.idx % 16 + 2:], '')"
            parts.append(f"c{level} AS (SELECT rid, c.tree, c.idx // 16 AS idx, proof || {before} || {after} AS proof, CASE WHEN m = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded FROM c{k} c JOIN n{level} p ON c.tree IS NOT DISTINCT FROM p.tree AND c.idx // 16 = p.idx)")

    rise(low)
    parts.append(f"subs AS (SELECT tree AS source, h AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM n{level})")
    tops = level
    level += 1
    parts.append(f"n{level} AS (SELECT 0 AS tree, idx, subroot AS h, n FROM subs)")
    parts.append(f"c{level} AS (SELECT rid, 0 AS tree, s.idx, proof, folded FROM c{tops} c JOIN subs s ON c.tree IS NOT DISTINCT FROM s.source)")
    rise(high)
    return ",\n".join(parts) + f"""
SELECT l.doc_id, l.h AS leaf, s.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.h AS verified
FROM c{level} c JOIN leaves l USING (rid) JOIN subs s ON l.tree IS NOT DISTINCT FROM s.source CROSS JOIN n{level} r"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_dedup": op1_simhash_dedup, "op2_warc_revisits": op2_warc_revisits, "op3_jpeg_media": op3_jpeg_media, "op4_chat_format": op4_chat_format,
        "op5_quality": op5_quality, "op6_packing": op6_packing, "op7_line_dedup": op7_line_dedup, "op8_neighbours": op8_neighbours, "op9_byte_bpe": op9_byte_bpe,
        "op10_license_scan": op10_license_scan, "op11_whitening": op11_whitening, "op12_pii": op12_pii, "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": OP2_SQL, "op4_chat_format": OP4_SQL, "op7_line_dedup": OP7_SQL, "op13_merkle_manifest": _op13_sql()}
