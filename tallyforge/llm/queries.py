"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cap_dedup, language_id, minhash, mixing, packing, substring_dedup, token_output, topk, toxicity, warc
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.digests(substring_dedup.remove_repeats(docs, width=50))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(mixing.word_sizes(_table(spark, sf_dir, "documents")), weights=(5.0, 2.0, 1.0), cap=3.0)
    return mixing.taken_words(plan).select("doc_id", "source", "size", "source_size", "target", "taken")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), end_id=0)
    return token_output.token_digests(manifest)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~language_id.is_held_out()))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.is_held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "topk")
    vectors = scratch.table("vectors", topk.quantised(_table(spark, sf_dir, "embeddings"), factor=256))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors, k=5, scratch=scratch)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), language_id.is_held_out()
    graded = toxicity.grades(_table(spark, sf_dir, "labels")).filter(~held_out)
    out = toxicity.predict(docs, toxicity.fit(docs, graded))
    return out.select("doc_id", held_out.alias("held_out"), "severity", "p_toxic", "toxic")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.document_pieces(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(pieces, capacity=4096)


def op9_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(_table(spark, sf_dir, "pages"))).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_token_output": op3_token_output,
    "op4_language_id": op4_language_id,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_cap_dedup": op9_cap_dedup,
    "op10_warc": op10_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op5_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
    """,
    "op9_cap_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT e.vec_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
        FROM embeddings e JOIN r ON r.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id GROUP BY e.vec_id
    """,
    "op1_substring_dedup": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), x AS (
            SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
        ), f AS (SELECT h, min(doc_id) AS earliest FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
        g AS (SELECT x.doc_id, list(x.i) AS starts FROM x JOIN f ON x.h = f.h AND x.doc_id > f.earliest GROUP BY x.doc_id),
        gone AS (SELECT DISTINCT doc_id, unnest(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS k FROM g),
        n AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
        k AS (
            SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ks), 0) AS n_removed,
                CASE WHEN ks IS NULL THEN ws ELSE (SELECT coalesce(list(ws[j] ORDER BY j), []) FROM unnest(range(1, len(ws) + 1)) AS t(j) WHERE NOT list_contains(ks, j)) END AS kept
            FROM w LEFT JOIN n ON w.doc_id = n.doc_id
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
    """,
    "op7_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
    """,
    "op10_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
        ), d AS (SELECT page_id, n, sha1(body) AS digest FROM p),
        k AS (SELECT digest, max(page_id) AS keep FROM d WHERE n >= 1000 GROUP BY digest)
        SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
            CASE WHEN k.keep IS NULL OR k.keep = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN k.keep <> d.page_id THEN k.keep END AS refers_to
        FROM d LEFT JOIN k ON d.digest = k.digest
    """,
}
