"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import conversations, decontaminate, licences, linededup, mixing, negatives, packing, simhash, suffixdedup, topk, toxicity, warc, wfst
from tonelake.llm.common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items found in them."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs removed as repeated 200-byte strings, and the hash of the rest."""
    return suffixdedup.dedup_substrings(table(spark, sf_dir, "documents"), length=200).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether its label was kept from the fit."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    return wfst.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document, and the smallest id reachable over links of two differing bits at most."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2).select("doc_id", "fingerprint", "component_id")


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph that states a licence, its family, and whether a template confirms it."""
    return licences.scan(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged index of the archives that the pages were written to, ordered by URL key and time."""
    entries = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return entries.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed rows of 2048 token ids."""
    return packing.pack(table(spark, sf_dir, "documents"), RANKS, length=2048)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, lines cut as later copies, and the text that stays."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("text", 256))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its five best of the same label, the ten best of other labels at 30 to 90 percent of its score."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation of the damaged table: its faults, the cheapest repair's cost and letters, and the hash of the repaired rows."""
    rows = table(spark, sf_dir, "conversations")
    edits, report = conversations.repair(conversations.damaged(rows))
    return conversations.summaries(rows, report, conversations.digests(edits))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of the sources by weights 1, 2, 3 takes of it."""
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3)).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_topk": op5_topk,
    "op6_simhash": op6_simhash,
    "op7_licences": op7_licences,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_negatives": op11_negatives,
    "op12_conversations": op12_conversations,
    "op13_mixing": op13_mixing,
}

#: SQL for the operators that it can express; the tests hold the others against brute force.
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(greatest(0, length(h) // 2 - 199))) AS u(i)),
        r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
        n AS (SELECT doc_id, i, coalesce(i > max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM r),
        g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM n),
        s AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY 1, 2),
        k AS (SELECT s.doc_id, s.g, b - a AS cut, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY s.g), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY s.g), 0))) AS kept, b FROM s JOIN d USING (doc_id)),
        t AS (SELECT doc_id, count(*) AS n_spans, sum(cut)::BIGINT AS n_removed, string_agg(kept, '' ORDER BY g) AS kept, max(b) AS b FROM k GROUP BY 1)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)""",
    "op8_warc": """
        WITH p AS (SELECT page_id, lower(url) AS low, url, encode(coalesce(html, '')) AS data FROM pages),
        h AS (SELECT *, sha1(data) AS hex, octet_length(data)::BIGINT AS payload_bytes FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY data) AS first FROM h),
        u AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(low, '^[a-z]+://([^/?#]+)', 1), '^www\\.', ''), ':(80|443)$', '') AS host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM b)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to,
               array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END AS url_key,
               strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM u""",
    "op10_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, lines, i, length(lines[i + 1]) + 1 AS chars FROM d, unnest(range(len(lines))) AS u(i)),
        c AS (SELECT *, sum(chars) OVER (PARTITION BY doc_id ORDER BY i) - chars AS start FROM l),
        m AS (SELECT a.doc_id, a.lines, a.i, b.i - a.i + 1 AS m FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 50
              WHERE b.start + b.chars - a.start >= 50 AND (b.start + b.chars - a.start - a.chars < 50 OR b.start - a.start < 50)),
        r AS (SELECT doc_id, i, m, md5(array_to_string(lines[i + 1 : i + m], chr(10))) AS run FROM m),
        f AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY run, m ORDER BY doc_id, i) AS n FROM r),
        x AS (SELECT doc_id, list(DISTINCT k) AS gone FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM f WHERE n > 1) GROUP BY 1),
        k AS (SELECT d.doc_id, len(lines)::INT AS n_lines, coalesce(len(gone), 0)::INT AS n_removed, array_to_string(list_transform(list_filter(range(len(lines)), lambda i: NOT list_contains(coalesce(gone, []), i)), lambda i: lines[i + 1]), chr(10)) AS text FROM d LEFT JOIN x USING (doc_id))
        SELECT *, sha256(text) AS kept_sha256 FROM k""",
    "op5_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 65), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
              FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS own, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
              FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
              FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT * FROM n WHERE rank <= 10""",
    "op13_mixing": """
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, ''), '0', md5(coalesce(text, '')))), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM d GROUP BY 1),
        w AS (SELECT *, (sid - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (3 * source_size)::DOUBLE / ((sid - 1) % 3 + 1)::DOUBLE AS share, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s),
        f AS (SELECT *, sum(cap) OVER o - cap AS caps, sum(weight) OVER () - sum(weight) OVER o + weight AS weights FROM w WINDOW o AS (ORDER BY share, sid ROWS UNBOUNDED PRECEDING)),
        l AS (SELECT arg_min((total - caps)::DOUBLE / weights::DOUBLE, (share, sid)) FILTER (WHERE share >= (total - caps)::DOUBLE / weights::DOUBLE) AS level FROM f),
        t AS (SELECT sid, source, source_size, CASE WHEN total > 0 THEN least(coalesce(level, 'infinity'::DOUBLE) * weight, cap::DOUBLE) ELSE 0.0 END AS target FROM w, l),
        b AS (SELECT *, round(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS base FROM t),
        p AS (SELECT sid, size, h, row_number() OVER (PARTITION BY sid ORDER BY h) AS i, max(budget - base * source_size) OVER (PARTITION BY sid) AS rest FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source WHERE size > 0),
        g AS (SELECT sid, i, h, size, size <= rest AS taken, rest - CASE WHEN size <= rest THEN size ELSE 0 END AS gap FROM p WHERE i = 1
              UNION ALL
              SELECT p.sid, p.i, p.h, p.size, p.size <= g.gap, g.gap - CASE WHEN p.size <= g.gap THEN p.size ELSE 0 END FROM g JOIN p ON p.sid = g.sid AND p.i = g.i + 1),
        z AS (SELECT sid, arg_min(h, (size, h)) FILTER (WHERE NOT taken) AS h, min(size) FILTER (WHERE NOT taken) AS size, min(gap) AS gap FROM g GROUP BY 1),
        x AS (SELECT sid, h FROM g WHERE taken UNION ALL SELECT sid, h FROM z WHERE size < 2 * gap)
        SELECT doc_id, size, source_size, target, ((base + (x.h IS NOT NULL)::INT) * size)::BIGINT AS taken
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN x ON x.sid = b.sid AND x.h = d.h AND size > 0""",
}
