"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.jaccard_join import jaccard_components
from quillgraph.llm.language_id import identify_languages
from quillgraph.llm.mixing import mix_sources
from quillgraph.llm.packing import pack_documents
from quillgraph.llm.periodic_runs import run_report
from quillgraph.llm.pii import personal_data_report
from quillgraph.llm.quality_classifier import classify_quality
from quillgraph.llm.quality_rules import quality_rules
from quillgraph.llm.secret_scan import scan_secrets
from quillgraph.llm.suffix_dedup import suffix_dedup
from quillgraph.llm.warc import archive_round_trip
from quillgraph.llm.whitening import whiten_embeddings


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark, sf_dir):
    return pack_documents(_docs(spark, sf_dir))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup(_docs(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    return identify_languages(_docs(spark, sf_dir))


def op4_warc(spark, sf_dir):
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_mixing(spark, sf_dir):
    return mix_sources(_docs(spark, sf_dir)).drop("source")


def op6_quality_rules(spark, sf_dir):
    return quality_rules(_docs(spark, sf_dir))


def op7_secret_scan(spark, sf_dir):
    return scan_secrets(_docs(spark, sf_dir))


def op8_quality_classifier(spark, sf_dir):
    return classify_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(_docs(spark, sf_dir))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_components(_docs(spark, sf_dir))


def op11_periodic_runs(spark, sf_dir):
    return run_report(_docs(spark, sf_dir))


def op12_whitening(spark, sf_dir):
    return whiten_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_pii(spark, sf_dir):
    return personal_data_report(_docs(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_pii": op13_pii,
}

ORACLE_SQL = {
    "op5_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', CAST(doc_id AS VARCHAR), '7')) AS mix_key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [5e0, 2e0, 1e0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         2e0 * source_size AS cap
  FROM sources),
levels AS (
  SELECT *, cap / weight AS lvl,
         (1.5e0 * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0e0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0e0)) AS common,
         coalesce(sum(cap) OVER w, 0e0) AS cut_before
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
found AS (SELECT common AS water FROM levels WHERE common <= lvl ORDER BY lvl, cut_before LIMIT 1),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT water FROM found) * weight, cap)) AS target FROM levels),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.mix_key,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.mix_key, d.doc_id, d.size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starts,
         CAST(floor(t.target + 1e-6) AS BIGINT) AS budget
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - starts)) AS BIGINT) AS taken, mix_key
FROM cut
""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT hex, max(page_id) AS top_id FROM p GROUP BY hex),
x AS (
  SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, r.top_id,
         list_transform(range(40), lambda i: strpos('0123456789abcdef', p.hex[i + 1]) - 1) AS n
  FROM p JOIN r ON p.hex = r.hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         1 + (((n[k // 4 * 5 + 1] * 65536 + n[k // 4 * 5 + 2] * 4096 + n[k // 4 * 5 + 3] * 256 + n[k // 4 * 5 + 4] * 16 + n[k // 4 * 5 + 5])
           >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31)]), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top_id THEN NULL ELSE top_id END AS refers_to
FROM x
""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
""",
}
