"""The registered query of each operator, with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chat, read_chat
from .common import table
from .decontaminate import contamination
from .exact_dedup import exact_groups
from .language_id import identify
from .lm_score import scores
from .merkle import manifest
from .near_dedup import near_groups
from .packing import pack
from .periodic import periodic_runs
from .pii import find_personal_data
from .token_files import token_digests
from .url_filter import judge
from .warc import archived

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("text_key")


PROBE_TEXT = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("id").alias("turn")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn, role, F.lit(PROBE_TEXT).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_chat(format_chat(turns.unionByName(probe)))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY)).drop("loss_tokens")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages")).drop("url")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents")).drop("copies")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), texts=False).drop("runs", "collapsed")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, sha256(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id),
cls AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM sets),
r AS (SELECT s.doc_id, s.g FROM s JOIN cls USING (doc_id) WHERE cls.doc_id = cls.rep),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM cls WHERE doc_id = rep UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u),
comp AS (SELECT a AS rep, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.c, w.doc_id) AS component_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN cls USING (doc_id) LEFT JOIN comp ON comp.rep = cls.rep
"""

OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, role IN ('system', 'user', 'assistant') AS known,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS next,
             replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') AS body,
             replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') AS shown FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + CASE WHEN known THEN length(role) ELSE length(shown) + 1 END + length(': ') + length(body) + length('</turn>') + 1) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev IN ('system', 'assistant') THEN role = 'user'
                     WHEN prev = 'user' THEN role = 'assistant' ELSE false END AND (next IS NOT NULL OR role = 'assistant')) AS valid
FROM o GROUP BY conv_id
"""

OP3_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bl)),
lens AS (SELECT DISTINCT n FROM bl),
occ AS (SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT o.doc_id, o.s, o.n, win.item_id FROM occ o JOIN win ON o.g = win.g AND o.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.l, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP11_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
o AS (SELECT *, strlen(html) AS n, row_number() OVER w AS k, first_value(page_id) OVER w AS first FROM p
      WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, r))
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND k > 1 THEN first END AS refers_to FROM o
"""

#: crc32 of the decimal digits of doc_id; 3988292384 is the reflected polynomial.
CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars, CRC % 7 = 0 AS tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
l AS (SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
             CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1), '-') || tail) END AS altered FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
up AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY pos) AS hs FROM p GROUP BY lang
       UNION ALL SELECT lang, lvl + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], ''))) FROM up WHERE len(hs) > 1),
sub AS (SELECT lang, hs[1] AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, lang) - 1 AS pos FROM up WHERE len(hs) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY pos) AS hs FROM sub HAVING count(*) > 0
        UNION ALL SELECT lvl + 1, list_transform(range(1, len(hs) + 1, 2), lambda i: sha256(hs[i] || coalesce(hs[i + 1], ''))) FROM top WHERE len(hs) > 1),
root AS (SELECT hs[1] AS root FROM top WHERE len(hs) = 1),
steps AS (
  SELECT p.r, u.lvl AS ord, p.pos >> u.lvl AS spot, u.hs FROM p JOIN up u ON u.lang IS NOT DISTINCT FROM p.lang AND len(u.hs) > 1
  UNION ALL SELECT p.r, 1000 + t.lvl, s.pos >> t.lvl, t.hs FROM p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang, top t WHERE len(t.hs) > 1),
lists AS (SELECT r, coalesce(string_agg(hs[xor(spot, 1) + 1], '' ORDER BY ord), '') AS proof,
                 list(CASE WHEN spot & 1 = 1 THEN 'l' ELSE 'r' END || coalesce(hs[xor(spot, 1) + 1], '') ORDER BY ord) AS sides FROM steps GROUP BY r),
done AS (SELECT p.doc_id, p.leaf, s.subroot, root.root, sha256(coalesce(x.proof, '')) AS proof_sha256,
                list_reduce([coalesce(p.altered, p.leaf)] || coalesce(x.sides, []), lambda a, b: CASE WHEN b[1] = 'l' THEN sha256(b[2:] || a) ELSE sha256(a || b[2:]) END) AS folded_root
         FROM p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root LEFT JOIN lists x USING (r))
SELECT *, folded_root = root AS verified FROM done
""".replace("CRC", CRC_SQL)

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o, CRC AS h FROM documents),
e AS (SELECT *, len(o) AS n, h // 10 % len(o) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM e),
x AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE o END AS w FROM f),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS v FROM x),
g AS (SELECT r, n, i, v || ' ' || lead(v) OVER o || ' ' || lead(v, 2) OVER o AS g FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
pairs AS (SELECT a.r, a.i, b.i - a.i AS d FROM g a JOIN g b ON a.r = b.r AND a.g = b.g AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
stretch AS (SELECT r, d, min(i) AS s, count(*) + 2 + d AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS k FROM pairs) GROUP BY r, d, k),
runs AS (SELECT r, s, l, min(d) AS q FROM stretch WHERE l >= greatest(6, 4 * d) GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(t.v, ' ' ORDER BY t.i) AS c FROM t ANTI JOIN gone ON t.r = gone.r AND t.i = gone.i GROUP BY t.r),
sums AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
                first(struct_pack(s, l, q) ORDER BY l DESC, s, q) AS best FROM runs GROUP BY r)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM x LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
""".replace("CRC", CRC_SQL)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_lm_scores": op6_lm_scores,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_token_files": op10_token_files,
    "op11_warc_archive": op11_warc_archive,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {"op1_near_dedup": OP1_SQL, "op2_chat_format": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op8_decontamination": OP8_SQL, "op11_warc_archive": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_periodic_runs": OP13_SQL}
