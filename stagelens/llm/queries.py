"""Queries opN_<name> of the corpus operators over their whole tables, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, langid, line_dedup, pii, toxicity, transport, warc
from ._common import table
from .near_dedup import near_duplicates


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = transport.load(transport.store(table(spark, sf_dir, "documents")))
    points = F.expr("filter(transform(pts, (t, i) -> if(random_access[i], t, null)), t -> t is not null)")
    feature = F.format_string(
        "programs=%d;streams=%d;packets=%d;continuity_errors=%d;units=%d;first_pts=%d;last_pts=%d;random_access=%s",
        "n_programs", "n_streams", "n_packets", "continuity_errors", F.size("pts"), F.get("pts", F.lit(0)), F.get("pts", F.size("pts") - 1), F.array_join(points.cast("array<string>"), ","),
    )
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents")).drop("redacted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).drop("url", "payload")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.classify(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_minhash": op2_minhash,
    "op3_transport_stream": op3_transport_stream,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op2_minhash": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), d AS (SELECT doc_id, len(s) AS n FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.c = u.a)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept
FROM d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n
""",
    "op5_decontamination": f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), m AS (
  SELECT DISTINCT doc_id, i, item_id, s.n FROM pos CROSS JOIN (SELECT DISTINCT n FROM win) s
  JOIN win ON win.n = s.n AND win.g = array_to_string(pos.w[i:i + s.n - 1], ' ')
  WHERE i + s.n - 1 <= len(pos.w)
), h AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), o AS (
  SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(line) - 1 AS base,
    regexp_extract_all(line, '[\t\x0b\x0c\r ]*(?:(?:[^\t\x0b\x0c\r ]+[\t\x0b\x0c\r ]+){4,}?[^\t\x0b\x0c\r ]*[.!?](?:[\t\x0b\x0c\r ]|$)|[^\t\x0b\x0c\r ].*$|$)') AS pieces FROM l
), p AS (SELECT doc_id, i, base, generate_subscripts(pieces, 1) AS j, unnest(pieces) AS piece FROM o),
q AS (
  SELECT *, trim(piece, chr(9) || chr(11) || chr(12) || chr(13) || ' ') AS unit,
    base + CAST(sum(length(piece)) OVER (PARTITION BY doc_id, i ORDER BY j) AS BIGINT) - length(ltrim(piece, chr(9) || chr(11) || chr(12) || chr(13) || ' ')) AS s FROM p
), u AS (
  SELECT *, regexp_replace(lower(unit), '[\t\x0b\x0c\r ]+', ' ', 'g') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS place
  FROM q WHERE unit <> ''
), r AS (SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, place) AS nth FROM u),
v AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM r WHERE nth > 1),
c AS (SELECT doc_id, count(*) AS n_removed, string_agg(s || ':' || (s + length(unit)), ',' ORDER BY s) AS removed, sum(words) AS words_removed FROM v GROUP BY 1),
m AS (SELECT doc_id, max(w) AS longest_removed FROM (SELECT doc_id, run, sum(words) AS w FROM v GROUP BY 1, 2) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY 1),
k AS (SELECT doc_id, i, max(nth) AS worst, string_agg(unit, ' ' ORDER BY j) FILTER (WHERE nth = 1) AS kept FROM r GROUP BY 1, 2),
t AS (SELECT o.doc_id, string_agg(CASE WHEN worst > 1 THEN kept ELSE line END, chr(10) ORDER BY o.i) AS text FROM o LEFT JOIN k ON k.doc_id = o.doc_id AND k.i = o.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
  CAST(coalesce(words_removed, 0) AS BIGINT) AS words_removed, CAST(coalesce(longest_removed, 0) AS BIGINT) AS longest_removed
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
}
