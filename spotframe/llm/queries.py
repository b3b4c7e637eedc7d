"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.llm import best_fit, bit_codes, byte_bpe, chat_windows, dart_minhash, exact_dedup, filter_audit, license_align, quality_fm, spotsigs, token_files, warc_revisits, whitening
from spotframe.session import shared_folder, ship_library

BYTE_VOCABULARY = 50_257


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_library(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, write flat id files with 64-bit offsets in doc_id order and
    read each document's place, length and crc back from the files."""
    folder = shared_folder(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path("byte_bpe_50k.json"), BYTE_VOCABULARY)
    return token_files.read_documents(spark, folder, digest_only=True)


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return spotsigs.edited_fingerprints(_table(spark, sf_dir, "documents"))


def warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in capture records: every page as a response, and a later revisit request for
    its uri in another spelling, with the validators a server of that page would send."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.md5("html").alias("etag"))
    day = F.lit("2024-01-01").cast("timestamp")
    at = (F.pmod(F.col("page_id") * 7919, F.lit(86_400)) * 30).cast("long")
    changed = F.col("page_id") % 5 == 0
    full = pages.select((F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"),
                        F.timestamp_seconds(F.unix_seconds(day) + at).alias("date"),
                        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nExpires: 0\r\nETag: \""), "etag",
                                 F.lit("\"\r\nServer: a")).alias("http"))
    again = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"),
                         F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http:", "HTTPS:"), F.lit("#again")).alias("uri"),
                         F.timestamp_seconds(F.unix_seconds(day) + F.lit(1_000_000) + at).alias("date"),
                         F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nServer: b\r\nCache-Control: max-age=60\r\nETag: W/\""),
                                  F.when(changed, F.lit("changed")).otherwise(F.col("etag")), F.lit("\"")).alias("http"))
    return full.unionByName(again)


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every not-modified revisit with the response it stands for and its merged headers."""
    found = warc_revisits.resolve(warc_records(spark, sf_dir))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select("record_id", "uri", "response_id", "outcome", F.array_join(lines, "\n").alias("headers"))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, md5(html) AS etag, epoch_us(TIMESTAMP '2024-01-01') // 1000000 + (page_id * 7919 % 86400) * 30 AS ts,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
split AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''),
                                          '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda p: p <> '')), '&') AS query
  FROM parts),
canon AS (
  SELECT page_id, etag, ts, host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END AS uri FROM split),
matched AS (
  SELECT v.page_id, v.uri, CASE WHEN v.page_id % 5 = 0 THEN 'changed' ELSE v.etag END AS tag,
         max({'ts': r.ts, 'record_id': r.page_id * 2, 'etag': r.etag}) AS found
  FROM canon v LEFT JOIN canon r ON r.uri = v.uri AND r.ts < v.ts + 1000000 GROUP BY ALL)
SELECT page_id * 2 + 1 AS record_id, uri, found.record_id AS response_id,
       CASE WHEN found.etag IS NULL THEN 'unmatched' WHEN found.etag = tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN found.etag = tag THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10)
         || 'etag: W/"' || tag || '"' || chr(10) || 'expires: 0' || chr(10) || 'server: a' END AS headers
FROM matched
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in every document, with its coverage and place."""
    return license_align.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_fm.score(docs, quality_fm.fit(docs, labels))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit decreasing packing of all documents into sequences of 2048 tokens."""
    return best_fit.pack_documents(_table(spark, sf_dir, "documents"),
                                   public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, size and surviving row of every document's exact text."""
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
FROM t WINDOW g AS (PARTITION BY body)
"""


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return dart_minhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and conversation -7 into windows; digests read back."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                           role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.digests(chat_windows.windows(rows))


OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
written AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '### ', '\2'), chr(10), '\3')
            || chr(10) || replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '### ', '\2') || '</turn>' || chr(10) AS piece
  FROM turns),
pieces AS (
  SELECT *, length(piece) AS chars, strlen(piece) AS cost, row_number() OVER o - 1 AS pos
  FROM written WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
heads AS (SELECT conv_id, CASE WHEN role = 'system' THEN cost ELSE 0 END AS head FROM pieces WHERE pos = 0),
costs AS (
  SELECT *, CASE WHEN cost > span THEN 1 ELSE 0 END AS big
  FROM (SELECT *, greatest(1, floor((2048 - 512 - head) / 2)::BIGINT) AS span FROM pieces JOIN heads USING (conv_id))),
placed AS (
  SELECT *, coalesce(sum(cost) OVER b, 0)::BIGINT AS before, coalesce(sum(big) OVER b, 0) AS bigs FROM costs
  WINDOW b AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
windows AS (
  SELECT conv_id, bigs, big, before // span AS block, min(pos) AS first_at, min(before) AS start, sum(chars) AS chars,
         least(512, any_value(span), 2048 - any_value(head) - sum(cost)) AS room
  FROM placed GROUP BY ALL),
again AS (
  SELECT w.conv_id, p.chars FROM windows w JOIN placed p ON p.conv_id = w.conv_id AND p.pos < w.first_at
  WHERE (p.pos = 0 AND p.role = 'system') OR w.start - p.before <= w.room),
formatted AS (
  SELECT conv_id, sum(chars)::BIGINT AS formatted_chars
  FROM (SELECT conv_id, chars FROM windows UNION ALL SELECT conv_id, chars FROM again) GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS targets
  FROM pieces GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(targets) AS loss_chars, sha256(targets) AS loss_sha256, formatted_chars
FROM said JOIN formatted USING (conv_id)
"""


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document with the rank file and decode the ids again."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", byte_bpe.encode(F.col("text"), ranks, pattern).alias("ids"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(byte_bpe.decode(F.col("ids"), ranks, pattern), 256).alias("decoded_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding, with the covariance's distance from identity."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from each language, in every order of the filters."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
first AS (SELECT body, min(doc_id) AS least FROM words GROUP BY body),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
          regexp_matches(body, '[#$%&*|]'), coalesce(words.doc_id > least, false)] AS fails
  FROM words JOIN first USING (body) LEFT JOIN marks ON marks.doc_id = words.doc_id),
kinds AS (SELECT part, good, toxic, fails, count(*) AS n FROM docs GROUP BY ALL),
letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT o, s.f AS step, o[s.f] AS f, o[1:s.f - 1] AS before FROM orders, letters s),
counted AS (
  SELECT part, o, step, f,
         sum(CASE WHEN NOT fails[f] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN fails[f] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fails[f] AND earlier THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fails[f] AND NOT earlier AND good THEN n ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN fails[f] AND NOT earlier AND toxic THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda i: fails[i])) > 0 AS earlier FROM kinds, steps) GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step::INTEGER AS step,
       kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted
"""


def op13_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest embeddings of every hundredth one."""
    return bit_codes.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_token_files": (op1_token_files, None),
    "op2_spotsigs": (op2_spotsigs, None),
    "op3_warc_revisits": (op3_warc_revisits, OP3_SQL),
    "op4_license_scan": (op4_license_scan, None),
    "op5_quality_fm": (op5_quality_fm, None),
    "op6_best_fit_packing": (op6_best_fit_packing, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_dart_minhash": (op8_dart_minhash, None),
    "op9_chat_windows": (op9_chat_windows, OP9_SQL),
    "op10_byte_bpe": (op10_byte_bpe, None),
    "op11_whitening": (op11_whitening, None),
    "op12_filter_audit": (op12_filter_audit, OP12_SQL),
    "op13_bit_codes": (op13_bit_codes, None),
}
