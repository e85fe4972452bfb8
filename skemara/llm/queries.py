"""The operators as queries over the test tables, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skemara.llm.align import align_documents
from skemara.llm.chat import render
from skemara.llm.conversation_repair import damage_and_repair
from skemara.llm.exact_dedup import exact_groups
from skemara.llm.licences import COPYRIGHT, KNOWN, SPELLINGS, scan_licences
from skemara.llm.mixing import mix_digest
from skemara.llm.packing import pack
from skemara.llm.pieces import round_trip
from skemara.llm.quality_rules import HOST_LIMIT, HOST_RULES, MAX_PRIOR, quality_rules
from skemara.llm.simhash import near_groups
from skemara.llm.token_files import token_round_trip
from skemara.llm.url_filter import filter_urls
from skemara.llm.warc import warc_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"), keep_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"], m["to"])), ",")
    return render(_table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "chunk", "start", "n_turns", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), mask.alias("mask"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_files, op2_warc, op3_url_filter, op4_exact_dedup, op5_quality_rules, op6_simhash, op7_licences, op8_chat, op9_packing, op10_pieces, op11_alignment, op12_conversation_repair, op13_mixing)}

_SQL2 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

_SQL4 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _sql5() -> str:
    rates = ", ".join(f"sum(CASE WHEN {r} THEN 1 ELSE 0 END) AS f_{k}" for k, r in HOST_RULES.items())
    weight = "CASE WHEN var_samp(f_{k} / n) > 0 THEN least({m}, greatest(0.0, avg(f_{k} / n) * (1 - avg(f_{k} / n)) / var_samp(f_{k} / n) - 1)) ELSE {m} END AS w_{k}, avg(f_{k} / n) AS m_{k}"
    prior = ", ".join(weight.format(k=k, m=MAX_PRIOR) for k in HOST_RULES)
    fails = " OR ".join(f"(f_{k} + m_{k} * w_{k}) / (n + w_{k}) > {HOST_LIMIT}" for k in HOST_RULES)
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
h AS (SELECT source, count(*) AS n, {rates} FROM m GROUP BY source),
p AS (SELECT {prior} FROM h),
v AS (SELECT source, {fails} AS fell FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR fell) AS kept
FROM m JOIN v ON m.source IS NOT DISTINCT FROM v.source
"""


def _sql7() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    def canon(x: str) -> str:
        out = f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"regexp_replace({out}, {quote(COPYRIGHT)}, ' ', 'g')"
        out = f"regexp_replace({out}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"

    rows = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN)
    return f"""
WITH k AS (SELECT sha256({canon('t')}) AS digest, min(l) AS licence FROM (VALUES {rows}) AS v(l, t) GROUP BY 1),
d AS (SELECT doc_id, sha256({canon('text')}) AS digest FROM documents),
n AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM
  (SELECT doc_id, sha256({canon('line')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) JOIN k USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.licence, coalesce(n.notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN n ON n.doc_id = d.doc_id
"""


_SQL8 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'),
e AS (SELECT t.*, speaker, CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10) WHEN role = speaker THEN '<|im_start|>assistant' || chr(10)
  ELSE '<|im_start|>user name=' || regexp_replace(replace(role, '<|im_', '<| im_'), '[\r\n]+', ' ', 'g') || chr(10) END AS head, replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS body FROM t JOIN s ON t.conv_id = s.c),
o AS (SELECT *, row_number() OVER w AS place, coalesce(sum(length(head) + length(body)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM e WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, md5(text))),
c AS (SELECT *, start // 65536 AS chunk, min(start) OVER (PARTITION BY conv_id, speaker, start // 65536) AS base FROM o)
SELECT conv_id, speaker, CAST(chunk AS BIGINT) AS chunk, CAST(min(start) AS BIGINT) AS start, count(*) AS n_turns,
  CAST(length(string_agg(head || body, '' ORDER BY place)) AS BIGINT) AS n_chars, sha256(string_agg(head || body, '' ORDER BY place)) AS text_sha256,
  coalesce(string_agg(CASE WHEN role = speaker THEN CAST(CAST(start - base + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start - base + length(head) + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY place), '') AS mask
FROM c GROUP BY conv_id, speaker, chunk
"""

_SQL13 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST('0x' || substr(md5('13:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS a, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS ww
  FROM s WINDOW b AS (ORDER BY source_size * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max_by(a, ww) AS a, max(ww) AS ww FROM o WHERE w * a <= 3 * source_size * ww),
t AS (SELECT source, source_size, CASE WHEN w * l.a > 3 * source_size * l.ww THEN 3 * CAST(source_size AS DOUBLE) ELSE CAST(w * l.a AS DOUBLE) / CAST(l.ww AS DOUBLE) END AS target FROM s, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0 END AS rate FROM t)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

ORACLE_SQL = {"op2_warc": _SQL2, "op4_exact_dedup": _SQL4, "op5_quality_rules": _sql5(), "op7_licences": _sql7(), "op8_chat": _SQL8, "op13_mixing": _SQL13}
