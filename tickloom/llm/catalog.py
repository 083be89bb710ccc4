"""Named queries of the pipeline operators, with their reference statements where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.ann import nearest
from tickloom.llm.bpe import tokenized
from tickloom.llm.common import table
from tickloom.llm.conversations import damaged, repair
from tickloom.llm.exact_dedup import exact_dedup
from tickloom.llm.langid import identify
from tickloom.llm.line_dedup import line_dedup
from tickloom.llm.mixing import mix
from tickloom.llm.parity_join import parity_join
from tickloom.llm.passages import passages
from tickloom.llm.pii import sanitise
from tickloom.llm.simhash import simhash
from tickloom.llm.url_filter import judge
from tickloom.llm.whitening import whiten

QUERIES, ORACLES = {}, {}

WHITE_SQL = r"[\x20\x09-\x0D]+"
STRIP_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_line_dedup", f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, {STRIP_SQL}), '{UPPER}', '{LOWER}') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
kept AS (SELECT k.doc_id, k.line, k.pos, o.keeper IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op3_exact_dedup", f"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{WHITE_SQL}', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


@query("op6_compact_windows")
def op6_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))


@query("op9_multi_index_hashing")
def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_mixing", f"""
WITH sized AS (SELECT doc_id, source, len(words) AS size,
    0.1::DOUBLE + 0.9::DOUBLE * (CASE WHEN len(words) > 0 THEN len(list_distinct(words))::DOUBLE / len(words) ELSE 0 END) AS weight
  FROM (SELECT doc_id, source, list_filter(string_split_regex(coalesce(text, ''), '{WHITE_SQL}'), lambda w: w <> '') AS words FROM documents)),
keyed AS (SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / weight AS key FROM sized),
sources AS (SELECT source, sum(size)::DOUBLE AS s, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM sized GROUP BY source),
ratios AS (SELECT *, 2 * s AS cap, 2 * s / w AS ratio FROM sources),
levels AS (SELECT *, (1.5 * sum(s) OVER () - (sum(cap) OVER upto - cap)) / (sum(w) OVER () - (sum(w) OVER upto - w)) AS level
  FROM ratios WINDOW upto AS (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
plan AS (SELECT source, s, least(cap, coalesce(w * (SELECT arg_min(level, ratio) FROM levels WHERE ratio > level), cap)) AS target FROM levels),
whole AS (SELECT *, (CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END) AS epochs FROM plan),
placed AS (SELECT k.doc_id, k.size, k.source, w.s, w.target, w.epochs, round(w.target - w.epochs * w.s) AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before, weight
  FROM keyed k JOIN whole w ON k.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size::BIGINT AS size, source, s::BIGINT AS source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken, weight
FROM placed""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op11_parity_join", f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WHITE_SQL}'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' ')))) END AS s FROM words),
classes AS (SELECT s, min(r) AS k, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT k, len(s) AS n, unnest(s) AS x FROM classes),
both_ AS (SELECT a.k AS u, b.k AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS i FROM items a JOIN items b ON a.x = b.x AND a.k < b.k WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT u, v FROM both_ WHERE 100 * i >= 80 * (nu + nv - i) UNION SELECT v, u FROM both_ WHERE 100 * i >= 80 * (nu + nv - i)),
reach AS (SELECT k AS a, k AS b FROM classes UNION SELECT reach.a, links.v FROM reach JOIN links ON links.u = reach.b),
named AS (SELECT a AS k, min(least) AS component_id FROM reach JOIN classes ON classes.k = reach.b GROUP BY 1)
SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN len(sets.s) = 0 THEN doc_id ELSE component_id END AS component_id
FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN named ON named.k = classes.k""")
def op11_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", f"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(k))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda b: ord(b)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind FROM raw, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds JOIN range(2) x(copy) ON copy = 0 OR kind = 3 WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS i, rtrim(text, {STRIP_SQL}) AS kept FROM damaged),
judged AS (SELECT *, CASE WHEN kept = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(kept, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
  CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS initial FROM placed),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, j.* EXCLUDE (kept) FROM judged j JOIN convs ON convs.conv_id IS NOT DISTINCT FROM j.conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']),
  (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 2, 3, 'I', ['user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])) v(q, q1, price, edits, new)),
steps AS (SELECT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0, 'audit': '', 'rows': []::VARCHAR[]}} AS best FROM convs
  UNION ALL SELECT c, i, q2, min({{'cost': cost, 'audit': audit, 'rows': rows}}) FROM (
    SELECT s.c, n.i, CASE e.edit WHEN 'D' THEN q1 WHEN 'R' THEN CASE WHEN q1 = 2 THEN 3 ELSE 2 END ELSE CASE n.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q2,
      s.best.cost + p.price + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND n.fault = 3 THEN 3 ELSE 0 END AS cost, s.best.audit || p.edits || e.edit AS audit,
      list_concat(list_concat(s.best.rows, p.new), CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [CASE WHEN q1 = 2 THEN 'assistant:' ELSE 'user:' END || n.text] ELSE [n.role || ':' || n.text] END) AS rows
    FROM steps s JOIN inserts p ON p.q = s.q JOIN numbered n ON n.c = s.c AND n.i = s.i + 1 JOIN (VALUES ('D'), ('R'), ('K')) e(edit)
      ON e.edit = 'D' OR n.fault NOT IN (1, 2) AND (e.edit = 'R' OR (n.initial = 's' AND q1 = 0) OR (n.initial = 'u' AND q1 <> 2) OR (n.initial = 'a' AND q1 = 2))) GROUP BY 1, 2, 3),
ends AS (SELECT s.c, s.i, s.best.cost + p.price AS cost, s.best.audit || p.edits AS audit, list_concat(s.best.rows, p.new) AS rows FROM steps s JOIN inserts p ON p.q = s.q AND (p.q1 = 3 OR s.q = 0 AND p.q1 = 0)),
best AS (SELECT c, min({{'cost': cost, 'audit': audit, 'rows': rows}}) AS b FROM ends e WHERE i = (SELECT count(*) FROM numbered n WHERE n.c = e.c) GROUP BY 1),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  b.cost::BIGINT AS cost, b.audit AS audit, sha256(array_to_string(b.rows, chr(10))) AS repaired_sha256 FROM convs JOIN best USING (c) LEFT JOIN counts USING (c)""")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations.select("conv_id"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
