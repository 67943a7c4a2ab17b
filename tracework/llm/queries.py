"""Registered queries of the numbered operators, and their SQL where it exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import byte_bpe, conversations, language_id, media, mixing, neighbours, packing, quality, simhash, suffix_dedup, token_counts, warc, whitening
from .common import read_table, written


def op1_quality_classifier(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.classify(docs, labels).select("doc_id", "held_out", "score", "predicted")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.predict(docs).select("doc_id", "held_out", "lang_pred", "score")


def op5_warc(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_counts(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_mixing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op9_neighbours(spark, sf_dir):
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda vec_id: vec_id % 50 == 0)


def op10_media(spark, sf_dir):
    """The files are written to the shared folder and read back from there."""
    stored = written(media.encode_column(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    return media.decode_column(stored, digest=True)


def op11_conversation_repair(spark, sf_dir):
    return conversations.audit(read_table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark, sf_dir):
    """Ids by the operator, bytes from the ids; only digests of both are returned."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = byte_bpe.decode(byte_bpe.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_whitening(spark, sf_dir):
    return whitening.components(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality_classifier, op2_suffix_dedup, op3_packing, op4_language_id, op5_warc, op6_token_counts, op7_simhash, op8_mixing, op9_neighbours, op10_media, op11_conversation_repair, op12_byte_bpe, op13_whitening)
}

#: Language scores, fingerprints, tokens, spans, JPEG files and graph search have no SQL; tests hold them against brute force.
SQL: dict[str, str] = {
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
     l AS (SELECT digest, max(page_id) AS latest FROM d WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN l.latest IS NULL OR l.latest IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN l.latest IS DISTINCT FROM page_id THEN l.latest END AS refers_to
FROM d LEFT JOIN l ON d.digest = l.digest AND n >= 1000
""",
    # Recursion over the rows of all conversations at once; each state keeps its least (cost, edits).
    "op11_conversation_repair": """
WITH RECURSIVE
 raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
 keys AS (SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, octet_length(k) + 1), lambda i: [ord(CAST(k[i:i] AS VARCHAR))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
   lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295) % 20 AS fate FROM (SELECT DISTINCT k FROM raw)),
 hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
   FROM (SELECT *, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) FROM raw JOIN keys USING (k) WHERE fate <> 0)),
 c AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
 placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY c) AS n FROM hurt JOIN c ON hurt.conv_id IS NOT DISTINCT FROM c.conv_id),
 judged AS (SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS before,
   CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed),
 counts AS (SELECT c, n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c, n),
 step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(q, initial, p)),
 fill AS (SELECT * FROM (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:'])) t(q, p, more, letters, lines)),
 best AS (SELECT c, 0::BIGINT AS i, p AS q, {'cost': more::BIGINT, 'audit': letters, 'lines': lines} AS b FROM counts, fill WHERE q = 0
   UNION ALL
   SELECT c, i, p, min(b) FROM (
     SELECT e.c, e.i, f.p, {'cost': e.cost + f.more, 'audit': e.audit || f.letters, 'lines': list_concat(e.lines, f.lines)} AS b FROM (
       SELECT r.c, r.i, w.q AS q, w.b.cost + 4 AS cost, w.b.audit || 'D' AS audit, w.b.lines AS lines FROM best w JOIN judged r ON r.c = w.c AND r.i = w.i + 1
       UNION ALL
       SELECT r.c, r.i, s.p, w.b.cost + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, w.b.audit || 'K', list_append(w.b.lines, r.role || ':' || r.text) FROM best w JOIN judged r ON r.c = w.c AND r.i = w.i + 1 JOIN step s ON s.q = w.q AND s.initial = r.initial WHERE r.fault NOT IN ('blank', 'duplicate')
       UNION ALL
       SELECT r.c, r.i, s.p, w.b.cost + 3 + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END, w.b.audit || 'R', list_append(w.b.lines, CASE s.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text) FROM best w JOIN judged r ON r.c = w.c AND r.i = w.i + 1 JOIN step s ON s.q = w.q AND s.initial <> 's' WHERE r.fault NOT IN ('blank', 'duplicate')
     ) e JOIN fill f ON f.q = e.q) GROUP BY c, i, p),
 ends AS (SELECT best.c, min(b) AS b FROM best JOIN counts ON best.c = counts.c AND best.i = counts.n WHERE q IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
 coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM c LEFT JOIN counts ON c.c = counts.c LEFT JOIN ends ON c.c = ends.c
""",
}
