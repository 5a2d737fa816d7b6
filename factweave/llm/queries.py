"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import ann, bpe, chat, mixing, neardup, planes, quality, severity, substrings, warc
from factweave.llm.store import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WORD = r"'[^\x20\x09-\x0D]+'"
LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "depleted")


SQL["op1_line_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, {WORD}) AS w FROM d),
gram AS (SELECT rid, i, w[i:i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM gram) WHERE n > 1),
hit AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
line AS (SELECT rid, source, line, len(regexp_extract_all(line, {WORD})) AS n, ord FROM (
    SELECT rid, source, unnest(l) AS line, generate_subscripts(l, 1) AS ord FROM (SELECT rid, source, string_split(text, chr(10)) AS l FROM d))),
dup AS (SELECT rid, count(*) AS n FROM (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY ord) AS k FROM line WHERE n > 0) WHERE k > 1 GROUP BY rid),
norm AS (SELECT rid, source, array_to_string(regexp_extract_all({LOW.format('line')}, {WORD}), ' ') AS l, sum(n) AS n FROM line WHERE n > 0 GROUP BY ALL),
host AS (SELECT source, count(*) AS n FROM d GROUP BY source),
often AS (SELECT norm.source, l FROM norm JOIN host ON norm.source IS NOT DISTINCT FROM host.source GROUP BY norm.source, l, host.n
    HAVING count(*) > 20 AND count(*) > host.n * 0.01),
gone AS (SELECT rid, sum(n)::BIGINT AS n FROM norm JOIN often ON norm.source IS NOT DISTINCT FROM often.source AND norm.l = often.l GROUP BY rid),
f AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(hit.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
    FROM d JOIN w USING (rid) LEFT JOIN hit USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_words - removed_words < 25 OR n_words - removed_words < n_words * 0.3 AS depleted FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, removed_words, depleted FROM v
"""


@query
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), size=4)


SQL["op2_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, {WORD}) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e AS x JOIN e AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN s AS x ON x.doc_id = a JOIN s AS y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach AS r JOIN edge AS e ON r.b = e.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM s LEFT JOIN low ON doc_id = a
"""


@query
def op3_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


@query
def op4_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return made.select("conv_id", "speaker", "n_turns", "rendered", spans.alias("spans"))


SQL["op5_perspectives"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, speaker, turn, role, text, role = speaker AS own,
    CASE WHEN role = speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
        ELSE '<|user name=' || replace(replace(role, '<|', '<\|'), '|>', '\|>') || '|>' END || chr(10) AS head,
    replace(text, '<|', '<\|') || '<|end|>' || chr(10) AS body FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER w AS upto FROM r WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY upto) AS rendered,
    coalesce(string_agg((upto - length(body))::BIGINT || '-' || (upto - 1)::BIGINT, ',' ORDER BY upto) FILTER (WHERE own), '') AS spans
FROM o GROUP BY conv_id, speaker
"""


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("text_hash")


SQL["op7_mix"] = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, 'null') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * n::DOUBLE / w AS ratio FROM s),
c AS (SELECT x.source, x.n, x.w, (sum(y.n) - coalesce(sum(3 * y.n) FILTER (WHERE y.ratio < x.ratio), 0))::BIGINT AS rest,
    (sum(y.w) - coalesce(sum(y.w) FILTER (WHERE y.ratio < x.ratio), 0))::BIGINT AS share FROM r AS x, r AS y GROUP BY ALL),
capped AS (SELECT source, n, w, 3 * n < rest / share * w AS is_full FROM c),
left_over AS (SELECT (sum(n) - coalesce(sum(3 * n) FILTER (WHERE is_full), 0))::BIGINT AS rest, sum(w) FILTER (WHERE NOT is_full)::BIGINT AS share FROM capped),
t AS (SELECT source, n AS source_size, CASE WHEN is_full THEN 3.0::DOUBLE * n ELSE rest / share * w END AS target FROM capped, left_over),
p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) - size AS ahead,
    floor(target + 0.5)::BIGINT AS budget FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM p)
SELECT doc_id, source, size, source_size, target, (passes * size + greatest(0, least(size, budget - passes * source_size - ahead)))::BIGINT AS taken FROM q
"""


@query
def op8_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return planes.round_trip(table(spark, sf_dir, "documents"), f.read(), public_tokenizers.PATTERN)


@query
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


SQL["op9_substrings"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 19] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(g, ' ')) ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, (SELECT unnest(range(0, 20)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
left_over AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op10_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to FROM f
"""
