"""The operators of this subpackage over the whole tables, as the driver's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.substring_dedup import dedup_digests

    return dedup_digests(_documents(spark, sf_dir)).drop("n_factors")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.suffix_dedup import dedup_digests

    return dedup_digests(_documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.quality_rules import score

    return score(_documents(spark, sf_dir))


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.cotraining import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.neighbours import search

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard_join import join

    return join(_documents(spark, sf_dir), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.secrets import scan_digests

    return scan_digests(_documents(spark, sf_dir))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.language_model import score

    return score(_documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lodestone.llm.packing import pack

    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.mixing import mix_counts

    return mix_counts(_documents(spark, sf_dir))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that op3 rests on, alone, as SQL can state them."""
    return op3_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7's numbers of base spans, alone."""
    return op7_secret_scans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality_rules": op3_quality_rules, "op4_cotraining": op4_cotraining, "op5_neighbours": op5_neighbours, "op6_jaccard_join": op6_jaccard_join, "op7_secret_scans": op7_secret_scans, "op8_lm_scoring": op8_lm_scoring, "op9_packing": op9_packing, "op10_mixing": op10_mixing, "quality_base": quality_base, "secret_base": secret_base}
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The others fit models, draw samples or would be too slow over whole tables; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS p FROM g JOIN f USING (k) WHERE least < doc_id),
        x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
        y AS (SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN y USING (doc_id)""",
    "op6_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
        e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b),
        m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)""",
    "quality_base": r"""
        WITH w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
        g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
        f AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, k HAVING count(*) > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM f) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(ws) < 20 OR 100 * coalesce(n, 0) > 30 * len(ws) AS base_failed FROM w LEFT JOIN c USING (doc_id)""",
    "secret_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex FROM d""",
}
