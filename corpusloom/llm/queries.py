"""The registered queries of the llm operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filter_audit import audit_filters
from .jaccard_join import jaccard_components
from .language_id import predict_language
from .packing import pack_documents
from .quality_classifier import classify_quality
from .quality_rules import judge_quality
from .sharding import shard_documents
from .source_mixing import mix_sources
from .store import bounded_batches, smallest_hashes
from .topk_search import top_k
from .toxicity import score_toxicity
from .url_filters import judge_urls
from .vector_codes import compress
from .warc import read_archive, write_archive

#: labelled rows that a model is fitted on at most
MAX_TRAINING_DOCS = 20_000
#: (host, path, verdict)
URL_RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def some_labels(labels: DataFrame) -> DataFrame:
    """About MAX_TRAINING_DOCS labels, one per document, by hash."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return smallest_hashes(one.withColumn("h", F.xxhash64("doc_id")), "h", MAX_TRAINING_DOCS).drop("h")


def toxic_examples(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = some_labels(labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def language_examples(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce(fold("doc_id", 4) != 2, F.lit(False))).select("text", "lang")


def op1_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify_quality(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "weak_score", "score", "kept")


def op2_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages"))).drop("record")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(spark, docs, toxic_examples(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict_language(spark, docs.select("doc_id", "text"), language_examples(docs))
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_url_filter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op8_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    # always by a merge: what is broadcast would grow with the documents, and each half of the texts is shuffled once
    target = docs.join(good.hint("merge"), "doc_id", "left_semi")
    return judge_quality(spark, docs, target).drop("text")


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def op13_lattice_edge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_weak_label_quality,
        op2_entropy_balanced_mix,
        op3_warc_chunks,
        op4_ngram_jaccard_join,
        op5_kneser_ney_toxicity,
        op6_cross_parsing_language,
        op7_url_filter_sweep,
        op8_ngram_ratio_rules,
        op9_cost_balanced_packing,
        op10_mtree_topk,
        op11_sampled_splitter_shards,
        op12_heap_lloyd_codes,
        op13_lattice_edge_audit,
    )
    return {f.__name__: f for f in ops}


URL_SQL = r"""
WITH rest AS (
    SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM rest
), rules(rule_host, rule_path, rule_verdict) AS (
    VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
    SELECT page_id, host, path, rule_host || rule_path AS rule, rule_verdict
    FROM parts LEFT JOIN rules ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM fits
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
"""

TOPK_SQL = """
WITH good AS (
    SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)
), scored AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""




def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Lloyd's method without bounds: every part against every entry."""
    steps = [
        f"""good AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, len(embedding) // {parts} AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = len(embedding)
), part AS MATERIALIZED (
    SELECT vec_id, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM good, (SELECT unnest(range({parts})) AS p)
), book0 AS MATERIALIZED (
    SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM part QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= {entries}
)"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} AS MATERIALIZED (
    SELECT vec_id, p, any_value(x) AS x, arg_min(e, d * {entries} + e) AS e, min(d) AS d
    FROM (SELECT vec_id, part.p, e, x, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM part JOIN book{i} ON part.p = book{i}.p)
    GROUP BY vec_id, p
)"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} AS (
    SELECT p, e, list(floor(s / n) ORDER BY i) AS c
    FROM (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{i}) GROUP BY p, e, i)
    GROUP BY p, e
), book{i + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e
)"""
            )
    last = f"near{rounds}"
    return f"""
WITH {', '.join(steps)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM {last} GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN good USING (vec_id), digest
"""


AUDIT_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), marks AS (
    SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic FROM labels GROUP BY 1
), failing AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS fails
    FROM texts LEFT JOIN marks USING (doc_id)
), cells AS (
    SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), walk AS (
    SELECT '' AS filter_order, 0 AS step, 0 AS applied, 0 AS bit
    UNION ALL
    SELECT filter_order || chr(65 + f), step + 1, applied + bit, 1 << f FROM walk, (SELECT unnest(range(5))::INTEGER AS f) WHERE ((applied + bit) >> f) & 1 = 0
), whole AS (
    SELECT filter_order FROM walk WHERE step = 5
), steps AS (
    SELECT whole.filter_order, step, applied, bit FROM whole JOIN walk ON step > 0 AND walk.filter_order = whole.filter_order[1:step]
), counted AS (
    SELECT part, filter_order, step, bit, sum(CASE WHEN fails & (applied + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails & applied <> 0 AND fails & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n * good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN fails & applied = 0 AND fails & bit <> 0 THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM cells, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter_sweep": URL_SQL, "op10_mtree_topk": TOPK_SQL, "op12_heap_lloyd_codes": _codes_sql(), "op13_lattice_edge_audit": AUDIT_SQL}
