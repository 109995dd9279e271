"""The queries of this package and, where SQL can express them, their oracles for DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomdex.llm import align, ann, bpe, chat, langid, linededup, mixing, simhash, spelling, substring, tokenfile, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_topk": topk.op3_topk,
    "op4_bpe": bpe.op4_bpe,
    "op5_simhash": simhash.op5_simhash,
    "op6_langid": langid.op6_langid,
    "op7_ann": ann.op7_ann,
    "op8_token_output": tokenfile.op8_token_output,
    "op9_mixing": mixing.op9_mixing,
    "op10_substring": substring.op10_substring,
    "op11_chat_format": chat.op11_chat_format,
    "op12_spelling": spelling.op12_spelling,
    "op13_align": align.op13_align,
}

_OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""

_OP2 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(lines) - 1)) AS pos, lines FROM d),
g AS (SELECT doc_id, pos, min((doc_id, pos)) OVER (PARTITION BY lines[pos:pos + 2]) AS first FROM w),
gone AS (SELECT doc_id, list_distinct(flatten(list([pos, pos + 1, pos + 2]))) AS spots FROM g WHERE (doc_id, pos) > first GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN spots IS NULL THEN text ELSE coalesce(array_to_string(list_filter(lines, lambda x, k: NOT list_contains(spots, k)), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

_OP3 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_OP9 = """
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size, md5('17/' || doc_id) AS ord FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, cap / weight AS fills_at, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level FROM w
      WINDOW f AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, least(cap, coalesce(weight * max(CASE WHEN level <= fills_at THEN level END) OVER (), cap)) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.whole, c.target - c.whole * c.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id ROWS UNBOUNDED PRECEDING) AS running FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, CAST(size * least(3, whole + CASE WHEN rest > 0 AND running - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""

_OP10 = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM d),
g AS (SELECT doc_id, pos, min((doc_id, pos)) OVER (PARTITION BY md5(array_to_string(words[pos:pos + 19], ' '))) AS first FROM w),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(pos, pos + 20)))) AS spots FROM g WHERE (doc_id, pos) > first GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN spots IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(spots, k)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""

_OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
m AS (SELECT *, md5(role || chr(10) || text) AS h, regexp_replace(text, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|TOOL\]|/TOOL\]|ROLE\]|/ROLE\]|/TURN\]))', '\1\\\2', 'g') AS escaped FROM c),
t AS (SELECT *, CASE role WHEN 'user' THEN length('[INST]  [/INST]') WHEN 'assistant' THEN length('<s></s>') WHEN 'system' THEN length('[SYS]  [/SYS]') WHEN 'tool' THEN length('[TOOL]  [/TOOL]')
        ELSE length('[ROLE]  [/ROLE] [/TURN]') + length(regexp_replace(role, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|TOOL\]|/TOOL\]|ROLE\]|/ROLE\]|/TURN\]))', '\1\\\2', 'g')) END AS around,
        CASE WHEN role IN ('user', 'assistant', 'system', 'tool') THEN role[1] ELSE 'x' END AS letter FROM m),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, h) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, h) FILTER (role = 'assistant'), '') AS learnt, CAST(sum(length(escaped) + around) AS BIGINT) AS formatted_chars,
        string_agg(letter, '' ORDER BY turn NULLS LAST, h) AS letters, list(coalesce(turn, 9223372036854775807) ORDER BY turn NULLS LAST, h) AS turns FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
  regexp_full_match(letters, 's?ua(ta|ua)*') AS valid, turns[length(regexp_extract(letters, '^(s?(u(a(ta|ua)*[tu]?)?)?)', 1)) + 1] AS broke_at
FROM g
"""

#: CRC-32 by halves of a byte: the remainders of 0 to 15.
_CRC = str([functools.reduce(lambda c, _: c >> 1 ^ 0xEDB88320 * (c & 1), range(4), x) for x in range(16)])

_OP12 = (
    r"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, xor(list_reduce([4294967295] || list_transform(range(length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)),
        lambda c, b: xor(xor(xor(c, b) >> 4, CRC[(xor(c, b) & 15) + 1]) >> 4, CRC[(xor(xor(c, b) >> 4, CRC[(xor(c, b) & 15) + 1]) & 15) + 1])), 4294967295) AS crc FROM r),
d AS (SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT w.word, x.word AS other FROM w JOIN x ON w.word = x.key UNION SELECT x.word, w.word FROM w JOIN x ON w.word = x.key
      UNION SELECT a.word, b.word FROM x a JOIN x b ON a.key = b.key AND a.i = b.i AND a.word <> b.word),
b AS (SELECT p.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS other, max(w.n) AS other_n FROM p JOIN w ON p.other = w.word GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
c AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
t AS (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON f.word = t.word
"""
).replace("CRC[", _CRC + "[")

ORACLES: dict[str, str] = {"op1_warc": _OP1, "op2_line_dedup": _OP2, "op3_topk": _OP3, "op9_mixing": _OP9, "op10_substring": _OP10, "op11_chat_format": _OP11, "op12_spelling": _OP12}
