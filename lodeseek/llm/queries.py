"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.decontaminate import decontaminate
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.common import fold
from lodeseek.llm.language import language_id
from lodeseek.llm.licenses import license_scan
from lodeseek.llm.lm_score import lm_scores
from lodeseek.llm.near_dedup import near_dedup
from lodeseek.llm.packing import packing
from lodeseek.llm.quality import quality_scores
from lodeseek.llm.suffix_dedup import suffix_dedup
from lodeseek.llm.toxicity import toxicity_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    r = F.col("result")
    return got.select(
        "doc_id", r.n_words.alias("n_words"), r.n_hit.alias("n_hit"), F.size(r["items"]).cast("long").alias("n_items"), F.sha2(F.array_join(r["items"], ",").cast("binary"), 256).alias("items_sha256"), (r.n_hit > 0).alias("contaminated")
    )


def _judged(got: DataFrame, least: float) -> DataFrame:
    score = F.col("result").score
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score"), (score >= least).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.5)


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), 0.3)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = license_scan(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.array_join("families", ",").alias("families"), F.size("families").cast("long").alias("n_families"), F.size("findings").cast("long").alias("n_findings"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digests=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_quality": op5_quality,
    "op6_license_scan": op6_license_scan,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_packing": op8_packing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + 9], ' ') AS s
            FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT l FROM win),
        pos AS (
            SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s
            FROM d, lens, unnest(range(1, len(w) - l + 2)) AS t(i) WHERE len(w) >= l),
        occ AS (SELECT doc_id, i, l, item_id FROM pos JOIN win USING (s, l)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM occ) GROUP BY doc_id),
        its AS (
            SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS h
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
               coalesce(its.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op4_near_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w)))) AS t(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
        edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id, doc_id = c.c AS kept
        FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) c USING (doc_id)
    """,
    "op7_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        win AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS w FROM d, unnest(range(0, n - 49)) AS t(i) WHERE n >= 50),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS least FROM win) WHERE least < doc_id),
        edge AS (SELECT doc_id, i, i - max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM hit),
        run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
        span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
        part AS (
            SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b FROM (SELECT doc_id, a, b FROM span UNION ALL SELECT doc_id, n, n FROM d)),
        kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM part JOIN d USING (doc_id) GROUP BY doc_id),
        cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n, count(*) AS c FROM span GROUP BY doc_id)
        SELECT doc_id, d.n::BIGINT AS n_bytes, coalesce(cut.n, 0) AS n_removed, coalesce(cut.c, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM d JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(s) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id)
    """,
}
