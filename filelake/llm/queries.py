"""Registered queries of the operators: name -> fn(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from filelake.llm import (decontam, embdedup, kneser_ney, linededup, lmscore, packing, recompress, simhash, spelling,
                          tokalign, tokencount, urlrep, warc)
from filelake.llm.common import read_table

QUERIES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


@register
def op2_embedding_dedup(spark, sf_dir):
    return embdedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


@register
def op3_lm_scoring(spark, sf_dir):
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10))
    return lmscore.score_texts(read_table(spark, sf_dir, "documents"), fold != 0)


@register
def op4_warc(spark, sf_dir):
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


@register
def op5_url_filter(spark, sf_dir):
    return urlrep.judge_urls(read_table(spark, sf_dir, "pages"), urlrep.page_outcomes(read_table(spark, sf_dir, "labels")))


@register
def op6_decontamination(spark, sf_dir):
    docs, bench = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontam.leak_digest(decontam.find_leaks(docs.select("doc_id", "text"), bench))


@register
def op7_substring_dedup(spark, sf_dir):
    return recompress.kept_digest(recompress.dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


@register
def op8_simhash(spark, sf_dir):
    return simhash.simhash_result(read_table(spark, sf_dir, "documents"))


@register
def op9_quality(spark, sf_dir):
    r = kneser_ney.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return r.select("doc_id", "lang", "n_tokens", "log10_perplexity", "threshold", "kept")


@register
def op10_token_counts(spark, sf_dir):
    import public_tokenizers
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers
    return tokalign.align_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                public_tokenizers.path("piece_bpe_32k.model"))


@register
def op12_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.kept_digest(linededup.drop_common_lines(docs))


@register
def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (d)
""",
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS x
  FROM bw, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
h AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS x FROM dw, ks, unnest(range(1, len(w) - k + 2)) AS r(i)),
m AS (SELECT doc_id, i, h.k AS k, item_id FROM h JOIN iw ON h.x = iw.x AND h.k = iw.k),
pos AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + k)) AS r(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op7_substring_dedup": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM dw, unnest(range(1, len(w) - 33)) AS r(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, j FROM win JOIN rep USING (h), unnest(range(i, i + 35)) AS r(j)),
pos AS (SELECT doc_id, j, w[j] AS x, len(w) AS n FROM dw, unnest(range(1, len(w) + 1)) AS r(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS c FROM pos ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM dw LEFT JOIN kept USING (doc_id)
""",
    "op12_line_dedup": """
WITH l AS (SELECT doc_id, i, x[i] AS line, translate(trim(x[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), unnest(range(1, len(x) + 1)) AS r(i)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT doc_id, i, line, l.k IN (SELECT k FROM c) AS gone FROM l)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
