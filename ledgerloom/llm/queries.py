"""The training-data queries and the SQL that checks them."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import chat, lattice, minhash, mixing, packing, pages, pieces, pii, quality, topk
from ledgerloom.llm.common import table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.extract(table(spark, sf_dir, "pages"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every whole text and what they decode to, as digests."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal label at a cosine of 0.93."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents at a similarity of 0.85 over five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text."""
    return pii.find(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected grade, probability of the top grade, and whether it is kept."""
    return quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed to windows of at most 1024."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's score by context mixing, with the base score."""
    return mixing.score(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    probe = "</s>[INST] ok [/INST]"
    record = json.dumps({"id": -7, "messages": [{"role": r, "content": probe} for r in ("user", "assistant")]})
    records = spark.range(1).select(F.lit(record).alias("payload"))
    turns = chat.turns_from_table(table(spark, sf_dir, "conversations")).unionByName(chat.turns_from_records(records))
    return chat.digest(chat.read_back(chat.format_turns(turns)))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best integer products of every hundredth vector among all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def queries() -> dict[str, Query]:
    return {
        "op1_pages": op1_pages,
        "op2_pieces": op2_pieces,
        "op3_lattice": op3_lattice,
        "op4_minhash": op4_minhash,
        "op5_pii": op5_pii,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_mixing": op8_mixing,
        "op9_chat": op9_chat,
        "op10_topk": op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pages": r"""
            WITH a AS (
                SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|<footer>|$)', 1), '</?(?:p|h1)>') AS parts FROM pages
            ), b AS (
                SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM a
            ), t AS (
                SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM b
            )
            SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
        """,
        "op3_lattice": """
            WITH RECURSIVE v AS (
                SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), e AS (
                SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93
            ), r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
            ), c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
            SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
            FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
        """,
        "op4_minhash": r"""
            WITH RECURSIVE w AS (
                SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
            ), s AS (
                SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle
                FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
            ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
            ), i AS (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
            ), e AS (
                SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
            ), r(x, y) AS (
                SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
            ), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
            SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
            FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
        """,
        "op9_chat": """
            WITH t AS (
                SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]'
                UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
            ), w AS (
                SELECT *, 3 + len(role) + 1 + len(text) + 4 + len(regexp_extract_all(text, '[<\\[]\\\\*/?(?:s>|INST\\])')) AS n FROM t
            )
            SELECT conv_id, count(*) AS n_turns,
                sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                CAST(sum(n) AS BIGINT) AS formatted_chars
            FROM w GROUP BY conv_id, lone
        """,
        "op10_topk": """
            WITH v AS (
                SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            ), s AS (
                SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
            )
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
        """,
    }
