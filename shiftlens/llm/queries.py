"""The numbered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import bpe, chat, decontam, media, neardup, private, quality, repair, secrets, substrings, tokens, urls, whitening
from shiftlens.llm.common import table

PROBE = "</s>[INST] ok [/INST]"


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), 100)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.segments(turns.unionByName(probe)))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def list_entries(captures: DataFrame) -> DataFrame:
    """A dated list derived from the captures themselves: entries for some hosts, and for some parent domains."""
    hosts = captures.where("host is not null").groupBy("host").agg(F.min("page_id").alias("i"))
    on = hosts.where("i % 3 = 0")
    entry = lambda df, pattern, action, day: df.select(F.expr(pattern).alias("pattern"), F.lit(action).alias("action"), F.expr(day).cast("int").alias("day"))
    domains = hosts.groupBy(F.expr("regexp_extract(host, '([^.]+[.][^.]+)$', 1)").alias("domain")).agg(F.min("i").alias("i")).where("domain <> '' and i % 2 = 1")
    return (
        entry(on, "host", "add", "(i * 37) % 900")
        .union(entry(on, "host", "remove", "(i * 37) % 900 + 30 + i % 200"))
        .union(entry(on.where("i % 2 = 0"), "host", "add", "(i * 37) % 900 + 330 + i % 150"))
        .union(entry(domains, "domain", "add", "700 + (i * 11) % 300"))
        .union(entry(domains, "domain", "remove", "1100 + (i * 13) % 300"))
    )


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("cast((page_id * 7919) % 1461 as int)").alias("day"))
    entries = list_entries(captures.withColumn("host", urls.host_of(F.col("url"))))
    return urls.filter_captures(captures, entries).select("page_id", "host", "day", "blocked", "blocked_by", "listed_since")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, secrets.fit(docs))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tokens.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return tokens.read_tokens(stored)


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.find_private(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_quality_crf, op2_suffix_dedup, op3_chat_format, op4_minhash_dedup, op5_byte_bpe, op6_url_filter, op7_secret_scan, op8_token_files, op9_gif_media, op10_decontaminate, op11_private_data, op12_embedding_whitening, op13_conversation_repair)}


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(26), chr(26) || 's')"
    for control in chat.DEFAULT.controls:
        out = f"replace({out}, '{control}', '{control[0]}' || chr(26) || 'c{control[1:]}')"
    return out


ORACLES = {
    "op3_chat_format": f"""
WITH g AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
t AS (SELECT *, lag(role, 1, '^') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) || '>' || role AS step FROM g)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + length({_escaped('text')}) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars,
  bool_and(step IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user', 'assistant>tool', 'tool>assistant')) AS valid
FROM t GROUP BY conv_id""",
    "op6_url_filter": r"""
WITH p AS (SELECT page_id, CAST((page_id * 7919) % 1461 AS INTEGER) AS day,
    nullif(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '')), '') AS host FROM pages),
h AS (SELECT host, min(page_id) AS i FROM p WHERE host IS NOT NULL GROUP BY host),
d AS (SELECT * FROM (SELECT regexp_extract(host, '([^.]+[.][^.]+)$', 1) AS domain, min(i) AS i FROM h GROUP BY 1) WHERE domain <> '' AND i % 2 = 1),
e AS (SELECT host AS pattern, 1 AS a, (i * 37) % 900 AS day FROM h WHERE i % 3 = 0
  UNION ALL SELECT host, 0, (i * 37) % 900 + 30 + i % 200 FROM h WHERE i % 3 = 0
  UNION ALL SELECT host, 1, (i * 37) % 900 + 330 + i % 150 FROM h WHERE i % 6 = 0
  UNION ALL SELECT domain, 1, 700 + (i * 11) % 300 FROM d UNION ALL SELECT domain, 0, 1100 + (i * 13) % 300 FROM d),
g AS (SELECT pattern, day, min(a) AS a FROM e GROUP BY pattern, day),
v AS (SELECT * FROM (SELECT pattern, a, day AS since, coalesce(lead(day) OVER (PARTITION BY pattern ORDER BY day), 1000000) AS until FROM g) WHERE a = 1),
m AS (SELECT p.page_id, v.pattern, v.since, row_number() OVER (PARTITION BY p.page_id ORDER BY length(v.pattern) DESC, v.pattern DESC, v.since DESC) AS r
  FROM p JOIN v ON (p.host = v.pattern OR (v.pattern LIKE '%.%' AND ends_with(p.host, '.' || v.pattern))) AND v.since <= p.day AND p.day < v.until)
SELECT p.page_id, p.host, p.day, m.pattern IS NOT NULL AS blocked, m.pattern AS blocked_by, CAST(m.since AS INTEGER) AS listed_since
FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.r = 1""",
    "op13_conversation_repair": r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
hashed AS (SELECT g.*, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(list_transform(string_split(key, ''), lambda c: ord(c)) AS BIGINT[])),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), CAST(range(8) AS BIGINT[])), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM given g),
kinds AS (SELECT conv_id, turn, role, text, xor(crc, 4294967295) % 20 AS kind FROM hashed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) AS r(copy) WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS seen FROM ordered),
turns AS (SELECT *, substr(role, 1, 1) AS said, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
nexts AS (SELECT *, lead(said) OVER (PARTITION BY conv_id ORDER BY p) AS following FROM turns),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE following IS NOT NULL AND said || following NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM nexts GROUP BY conv_id),
starts AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 5, 'I', 'user:'), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'),
    (1, 1, 0, '', ''), (1, 2, 5, 'I', 'user:'), (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:'),
    (2, 2, 0, '', ''), (2, 3, 5, 'I', 'assistant:'), (3, 3, 0, '', ''), (3, 2, 5, 'I', 'user:')) v(before, state, price, letters, added)),
steps AS (SELECT * FROM (VALUES (0, 's', 1, 0, 'K', ''), (0, 'u', 2, 0, 'K', ''), (1, 'u', 2, 0, 'K', ''), (3, 'u', 2, 0, 'K', ''), (2, 'a', 3, 0, 'K', ''),
    (0, '', 2, 1, 'R', 'user'), (1, '', 2, 1, 'R', 'user'), (3, '', 2, 1, 'R', 'user'), (2, '', 3, 1, 'R', 'assistant'),
    (0, '', 0, 2, 'D', ''), (1, '', 1, 2, 'D', ''), (2, '', 2, 2, 'D', ''), (3, '', 3, 2, 'D', '')) v(state, wanted, after, price, letter, role)),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS p, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'body': CAST([] AS VARCHAR[])} AS best FROM counts
  UNION ALL SELECT t.conv_id, t.p, s.after, min({
      'cost': w.best.cost + i.price + s.price + CASE WHEN s.letter <> 'D' AND t.fault = 'truncated' THEN 5 ELSE 0 END,
      'audit': w.best.audit || i.letters || s.letter,
      'body': w.best.body || CASE WHEN i.added = '' THEN CAST([] AS VARCHAR[]) ELSE [i.added] END ||
        CASE s.letter WHEN 'K' THEN [t.role || ':' || t.text] WHEN 'R' THEN [s.role || ':' || t.text] ELSE CAST([] AS VARCHAR[]) END})
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.p = w.p + 1 JOIN starts i ON i.before = w.state
      JOIN steps s ON s.state = i.state AND (s.letter <> 'K' OR s.wanted = t.said) AND (s.letter = 'D' OR t.fault NOT IN ('blank', 'duplicate'))
    GROUP BY t.conv_id, t.p, s.after),
ends AS (SELECT w.conv_id, min({'cost': w.best.cost + i.price, 'audit': w.best.audit || i.letters,
    'body': w.best.body || CASE WHEN i.added = '' THEN CAST([] AS VARCHAR[]) ELSE [i.added] END}) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.p JOIN starts i ON i.before = w.state AND i.state IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id""",
}
