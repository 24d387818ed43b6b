"""The registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bands, bpe, licenses, linededup, minhash, packing, preference, ranking, sharding, simhash, topk, toxicity, warc, whitening
from tallyweave.llm.common import importable, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_rows(table(spark, sf_dir, "documents"), 8)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its neighbour's last reply; masks as start:length lists."""
    found = preference.format_pairs(preference.neighbour_pairs(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["length"])), ",")
    return found.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band join of operator 4 over all documents."""
    return bands.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of phrases alone, and with those of templates, comma-joined."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("base_labels", F.array_join("base_labels", ",")).withColumn("labels", F.array_join("labels", ","))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_preference, op4_minhash, op5_topk, op6_simhash, op7_bpe, op8_linededup, op9_warc, op10_packing, op11_licenses, op12_whitening, op13_maxscore, minhash_groups)}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op3_preference": """
WITH conv AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
own AS (SELECT *, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), 0) AS last FROM conv),
said AS (
  SELECT a.conv_id, a.turns AS c, a.last, coalesce(b.turns[b.last].text, '') AS reply
  FROM own a LEFT JOIN own b ON b.last > 0 AND b.conv_id = CASE WHEN a.conv_id % 2 = 0 THEN a.conv_id + 1 ELSE a.conv_id - 1 END),
pairs AS (SELECT conv_id, c, list_transform(range(1, len(c) + 1), lambda i: {'role': c[i].role, 'text': CASE WHEN i = last THEN reply ELSE c[i].text END}) AS r FROM said),
cut AS (SELECT *, coalesce(list_min(list_filter(range(1, len(c) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1, len(c)) AS n FROM pairs),
long AS (
  SELECT conv_id, n, side, i, CASE WHEN side = 'c' THEN c[i].role ELSE r[i].role END AS role, CASE WHEN side = 'c' THEN c[i].text ELSE r[i].text END AS text
  FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM cut) CROSS JOIN (VALUES ('c'), ('r')) s(side)),
shown AS (
  SELECT *, '<|start|>' || role || chr(10) || text || '<|end|>' || chr(10) AS shown,
    length(role) + 10 AS head, length(text) + 8 AS body FROM long),
placed AS (SELECT *, coalesce(sum(CASE WHEN i > n THEN head + body ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head AS start FROM shown)
SELECT conv_id, CAST(any_value(n) AS INTEGER) AS prefix_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'c' AND i > n), '') AS chosen_text,
  coalesce(string_agg(start::BIGINT || ':' || body, ',' ORDER BY i) FILTER (side = 'c' AND i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'r' AND i > n), '') AS rejected_text,
  coalesce(string_agg(start::BIGINT || ':' || body, ',' ORDER BY i) FILTER (side = 'r' AND i > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id""",
    "op5_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op8_linededup": f"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
keyed AS (SELECT *, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM keyed LEFT JOIN owners USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_aggregate(list_transform(string_split(hex, ''), lambda h: lpad(CAST(bin(strpos('0123456789abcdef', h) - 1) AS VARCHAR), 4, '0')), 'string_agg', '') AS b FROM p),
b32 AS (SELECT page_id, strlen(body) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT AS BIGINT), 1)), 'string_agg', '') AS payload_digest FROM bits),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS page FROM b32)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> page THEN page END AS refers_to FROM firsts""",
    "op13_maxscore": f"""
WITH dt AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
it AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM dt),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM dt) GROUP BY r, t),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, n_docs),
asked AS (SELECT q, any_value(item_id) AS item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS t FROM it) GROUP BY q, t),
s AS (
  SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN wt USING (t) JOIN p USING (t), c GROUP BY q, r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20""",
}
