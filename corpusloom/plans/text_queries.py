"""Queries of the text kernel."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.retrieval import top_similar

from .standins import DAY, DOCUMENTS_SQL, documents, table  # noqa: F401

FOLD = "trim(regexp_replace(replace(strip_accents(lower({0})), 'đ', 'd'), '\\s+', ' ', 'g'))"
SQUEEZE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
TOKENS = "list_filter(regexp_extract_all(" + FOLD + ", '[\\p{{L}}\\p{{N}}_]+'), lambda t: len(t) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "], t))"


def fold_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.fold(F.col("text")), 256).alias("folded"))


def token_frequency(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def excerpts(spark, sf):
    x = F.col("text")
    return table(spark, sf, "documents").select("doc_id", T.excerpt(x).alias("excerpt"), T.summary(x).alias("summary"), T.word_count(x).alias("n_words"), T.first_words(T.collapse(x), 12).alias("opening"))


def slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.slug(F.substring_index("text", "\n", 1)).alias("slug"))


def segments(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(T.segments(F.col("text"))).alias("pos", "segment"))
    return s.select("doc_id", "pos", F.sha2("segment", 256).alias("segment"))


def search_any_column(spark, sf):
    d = documents(spark, sf)
    hit = F.lit(False)
    for c in ("title", "file_name", "document_code", "source_reference"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("c1"))
    return d.where(hit | F.col("title").ilike("%the%")).select("id", "title")


def file_codes(spark, sf):
    d = documents(spark, sf).select("id", T.document_code(F.coalesce("document_code", F.lit("so 7 / 2024 / nd-cp"))).alias("code"), F.array_join(T.years(F.col("file_name")), ",").alias("years"), T.file_base(F.concat(F.lit("a\\b/"), "file_name")).alias("base"))
    return d


def sentence_cased(spark, sf):
    x = F.element_at(F.split(F.lower("text"), " "), 1)
    return table(spark, sf, "conversations").select("conv_id", "turn", T.sentence_case(F.lower("text")).alias("cased"), F.length(x).alias("first_length"))


def identity(spark, sf):
    from corpusloom.operators.identity import content_hash, source_identity

    d = documents(spark, sf)
    h = F.when(F.col("id") % 2 == 0, content_hash(F.col("text")))
    return d.select("id", source_identity(F.when(F.col("id") % 3 == 0, F.col("source_reference")), F.col("file_name"), h).alias("identity"))


def vector_topk(spark, sf):
    """Ten most similar vectors, by cosine, of each whose id is divisible by 20; queries go against all vectors in blocks."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_similar(v, v.where("id % 20 = 0"), 10).select("query_id", F.col("id").alias("vec_id"), "rank", "score")


def json_parse(spark, sf):
    """Numbers of a JSON text; broken or other JSON gives null."""
    e = table(spark, sf, "events")
    bad = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("x{"), "props")).otherwise(F.col("props"))
    k = F.from_json(bad, "struct<k: long>")["k"]
    return e.select("event_id", k.alias("k"), k.isNull().alias("broken"))


D = "documents"
TEXT_QUERIES = {
    "fold_text": (fold_text, f"SELECT doc_id, sha256({FOLD.format('text')}) AS folded FROM documents"),
    "token_frequency": (token_frequency, f"SELECT token, count(*) AS n FROM (SELECT unnest({TOKENS.format('text')}) AS token FROM documents) GROUP BY token"),
    "excerpts": (
        excerpts,
        f"""WITH c AS (SELECT doc_id, {SQUEEZE.format('text')} AS c FROM documents)
        SELECT doc_id, rtrim(substr(c, 1, 320)) || CASE WHEN length(c) > 320 THEN '...' ELSE '' END AS excerpt, substr(c, 1, 320) AS summary,
            len(list_filter(string_split(c, ' '), lambda w: w <> ''))::INTEGER AS n_words, array_to_string(string_split(c, ' ')[1:12], ' ') AS opening FROM c""",
    ),
    "slugs": (slugs, f"SELECT doc_id, substr(trim(regexp_replace({FOLD.format('split_part(text, chr(10), 1)')}, '[^a-z0-9]+', '-', 'g'), '-'), 1, 120) AS slug FROM documents"),
    "segments": (
        segments,
        f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {SQUEEZE.format('x')}), lambda x: x <> '') AS s FROM documents),
        e AS (SELECT doc_id, unnest(s) AS segment, generate_subscripts(s, 1) AS i FROM s)
        SELECT doc_id, (i - 1)::INTEGER AS pos, sha256(segment) AS segment FROM e""",
    ),
    "search_any_column": (
        search_any_column,
        f"""WITH {DOCUMENTS_SQL} SELECT id, title FROM kd WHERE contains(lower(title), 'c1') OR contains(lower(file_name), 'c1') OR contains(lower(coalesce(document_code, '')), 'c1')
        OR contains(lower(source_reference), 'c1') OR title ILIKE '%the%'""",
    ),
    "file_codes": (
        file_codes,
        f"""WITH {DOCUMENTS_SQL} SELECT id, CASE WHEN document_code IS NULL THEN '7/2024/ND-CP' ELSE document_code END AS code,
        array_to_string(regexp_extract_all(file_name, '(?:19|20)[0-9]{{2}}'), ',') AS years, file_name AS base FROM kd""",
    ),
    "sentence_cased": (sentence_cased, "SELECT conv_id, turn, upper(substr(lower(text), 1, 1)) || substr(lower(text), 2) AS cased, length(split_part(lower(text), ' ', 1))::INTEGER AS first_length FROM conversations"),
    "identity": (
        identity,
        f"WITH {DOCUMENTS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'sha256:' || sha256(text) WHEN id % 3 = 0 THEN 'source:' || source_reference ELSE 'path:' || file_name END AS identity FROM kd",
    ),
    "vector_topk": (
        vector_topk,
        """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(greatest(0, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[])), 6) AS score
            FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, vec_id, rank, score FROM r WHERE rank <= 10""",
    ),
    "json_parse": (json_parse, "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props::JSON->>'k')::BIGINT END AS k, event_id % 7 = 0 OR (props::JSON->>'k') IS NULL AS broken FROM events"),
}
