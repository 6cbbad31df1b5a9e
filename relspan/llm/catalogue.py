"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.llm import byte_bpe, embedding_dedup, hamming_topk, kd_shard, minhash_dedup, packing, quality, suffix_dedup, toxicity, url_filter

#: Rules of the registered URL filter: host, path, action.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def url_rules(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(_read(spark, d, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


def suffix_array(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, d, "documents"), texts=None).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def quality_trees(spark: SparkSession, d: str) -> DataFrame:
    return quality.score_quality(_read(spark, d, "documents"), _read(spark, d, "labels"))


def toxicity_models(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score_toxicity(_read(spark, d, "documents"), _read(spark, d, "labels"))


def pivot_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_vectors(_read(spark, d, "embeddings"))


def kd_shards(spark: SparkSession, d: str) -> DataFrame:
    return kd_shard.shard_documents(_read(spark, d, "documents"))


def multi_index(spark: SparkSession, d: str) -> DataFrame:
    codes = _read(spark, d, "embeddings").select("vec_id", hamming_topk.sign_code(F.col("embedding")).alias("code"))
    return hamming_topk.search(codes, codes.where("vec_id % 50 = 0"), k=10)


def circulant_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, d, "documents"))


def byte_pairs(spark: SparkSession, d: str) -> DataFrame:
    return byte_bpe.digest_documents(_read(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def balanced_packs(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": url_rules,
        "op2_suffix_array_dedup": suffix_array,
        "op3_quality_classifier": quality_trees,
        "op4_toxicity": toxicity_models,
        "op5_embedding_near_dedup": pivot_vectors,
        "op6_kd_sharding": kd_shards,
        "op7_hamming_topk": multi_index,
        "op8_minhash_near_dedup": circulant_minhash,
        "op9_byte_bpe": byte_pairs,
        "op10_packing": balanced_packs,
    }


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_UPPER = url_filter.UPPER


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": f"""
            WITH rules(rhost, rpath, action) AS (VALUES {_RULE_ROWS}),
            cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
            raw AS (SELECT page_id, tail, regexp_extract(tail, '^[^/?#]*') AS h FROM cut),
            parts AS (SELECT page_id, translate(h, '{_UPPER}', '{_UPPER.lower()}') AS host, regexp_extract(substr(tail, length(h) + 1), '^[^?#]*') AS path FROM raw),
            fits AS (
                SELECT page_id, host, path, rhost || rpath AS rule, action,
                    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC) AS place
                FROM parts LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            )
            SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE place = 1""",
        "op2_suffix_array_dedup": """
            WITH d AS (SELECT doc_id, hex(b) AS x, b FROM (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents)),
            starts AS (SELECT doc_id, unnest(range(0, octet_length(b) - 399)) AS i, b FROM d),
            strings AS (SELECT doc_id, i, md5_number(b[i + 1:i + 400]) AS h FROM starts),
            again AS (SELECT h FROM strings GROUP BY h HAVING count(*) > 1),
            hits AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) AS opens FROM strings SEMI JOIN again USING (h)),
            runs AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM hits),
            spans AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY doc_id, run),
            gaps AS (SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS since, lo AS upto FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY lo) UNION ALL SELECT doc_id, max(hi), NULL FROM spans GROUP BY doc_id),
            parts AS (SELECT doc_id, string_agg(substr(x, 2 * since + 1, coalesce(2 * (upto - since), length(x))), '' ORDER BY since) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
            sums AS (SELECT doc_id, sum(hi - lo)::BIGINT AS removed, count(*) AS n FROM spans GROUP BY doc_id)
            SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
            FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN parts USING (doc_id)""",
        "op5_embedding_near_dedup": """
            WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
            pairs AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
            reach(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, p.w FROM reach r JOIN pairs p ON p.u = r.t),
            low AS (SELECT s, min(t) AS component_id FROM reach GROUP BY s)
            SELECT vec_id, (SELECT count(*) FROM pairs WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
            FROM v JOIN low ON s = vec_id""",
        "op7_hamming_topk": """
            WITH d AS (
                SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
                    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (r.embedding[i] > 0) THEN 1 ELSE 0 END))::BIGINT AS distance
                FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0
            ), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
            SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10""",
        "op8_minhash_near_dedup": f"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
            n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
            shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
            links AS (SELECT u, v FROM shared JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * k >= 75 * (nu.size + nv.size - k)),
            reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
            low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
            SELECT doc_id, coalesce(size, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)""",
    }
