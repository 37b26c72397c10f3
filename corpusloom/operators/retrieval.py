"""Hybrid ranking of chunks for batches of questions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from corpusloom.functions.numeric import clamp, cosine, dot
from corpusloom.functions.shared import Tables, bounded_batches, spread
from corpusloom.functions.text import fold, marked, tokens, whole_word_count
from corpusloom.operators.matching import phrase_places


def hint_score(text: Column, hints: Column) -> Column:
    """10 per occurrence of each hint in marked folded text."""
    folded = F.transform(hints, fold)
    return F.when(F.size(hints) > 0, F.aggregate(folded, F.lit(0), lambda s, t: s + whole_word_count(text, t) * 10)).otherwise(0)


def lexical_score(text: Column, words: Column, hints: Column) -> Column:
    """3 per word, 8 per word pair, 12 per occurrence of the first three words, 10 per hint, in marked folded text."""
    total = lambda array, weight: F.aggregate(array, F.lit(0), lambda s, t: s + whole_word_count(text, t) * weight)
    n = F.size(words)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    three = F.when(n >= 3, whole_word_count(text, F.array_join(F.slice(words, 1, 3), " ")) * 12).otherwise(0)
    return F.when(n > 0, total(words, 3) + total(pairs, 8) + three + hint_score(text, hints)).otherwise(0)


#: distinct first words of a batch of questions that are broadcast; more are met by the shuffle alone
FEW_WORDS = 200_000
#: phrases of words alone that are counted where a text is read; more meet the texts' phrases by the shuffle
FEW_PHRASES = 100_000


def _counted(wanted):
    """Occurrences of phrases of one to three words, without overlap, in texts whose other characters are marks of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = wanted.value
        # the first one or two words of those phrases that have more
        begins = {p.split(" ")[0] for p in phrases if len(p.split(" ")[0]) >= 3}
        longer = {" ".join(p.split(" ")[:i]) for p in phrases for i in (1, 2) if p.count(" ") >= i}
        for batch in batches:
            owners, names, counts = [], [], []
            for own, text in zip(batch["document_id"].tolist(), batch["y"]):
                w, n, free = text.split(" "), Counter(), {}
                for i in [i for i, x in enumerate(w) if x in begins]:
                    phrase = w[i]
                    for size in (1, 2, 3):
                        if phrase in phrases and i >= free.get(phrase, 0):
                            n[phrase] += 1
                            if size > 1:
                                free[phrase] = i + size
                        if size == 3 or phrase not in longer or i + size >= len(w):
                            break
                        phrase = f"{phrase} {w[i + size]}"
                owners += [own] * len(n)
                names += n.keys()
                counts += n.values()
            yield pd.DataFrame({"document_id": pd.Series(owners, dtype=object), "phrase": pd.Series(names, dtype=object), "n": np.array(counts, dtype=np.int64)})

    return run


def phrase_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, document_id, score: 3 per word, 8 per word pair, 12 per occurrence of the first three words.

    questions have query_id and words, chunks document_id and folded.  Each text is read once into its words,
    pairs and triples (next to each other by one space), which are counted per document; questions meet them by
    an equi-join on the phrase, so texts are never joined.  Occurrences of a phrase do not overlap.  Up to FEW_PHRASES
    phrases go to every task, which counts them where it reads the text, so only what is found leaves it.
    """
    w, n = F.col("words"), F.size("words")
    at = lambda i: F.element_at(w, i)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1)).alias("phrase"), F.lit(8).alias("weight"))))
    three = F.when(n >= 3, F.array(F.struct(F.array_join(F.slice(w, 1, 3), " ").alias("phrase"), F.lit(12).alias("weight"))))
    one = F.transform(w, lambda x: F.struct(x.alias("phrase"), F.lit(3).alias("weight")))
    none = F.array().cast("array<struct<phrase:string,weight:int>>")
    needles = questions.select("query_id", F.explode(F.concat(one, F.coalesce(pairs, none), F.coalesce(three, none))).alias("x"))
    needles = needles.groupBy("query_id", "x.phrase").agg(F.sum("x.weight").alias("weight"))

    wanted = needles.select("phrase").distinct()
    kind = chunks.schema["document_id"].dataType
    few = [r[0] for r in wanted.limit(FEW_PHRASES + 1).collect()] if isinstance(kind, (LongType, StructType)) else []
    if 0 < len(few) <= FEW_PHRASES and wanted.where(~F.col("phrase").rlike(r"(?U)^\w+( \w+){0,2}$")).isEmpty():
        spark = chunks.sparkSession
        bounded_batches(spark)
        # a mark stands for every character that is neither in a word nor a space, so no phrase goes across
        own = F.to_json("document_id") if isinstance(kind, StructType) else F.col("document_id").cast("string")
        parted = chunks.where("folded is not null").select(own.alias("document_id"), F.regexp_replace("folded", r"(?U)[^\w ]", " \x01 ").alias("y"))
        counts = parted.mapInPandas(_counted(spark.sparkContext.broadcast(frozenset(few))), "document_id string, phrase string, n long")
        # an id may have several texts
        scores = counts.join(F.broadcast(needles), "phrase").groupBy("query_id", "document_id").agg(F.sum(F.col("n") * F.col("weight")).cast("int").alias("score"))
        read = F.from_json("document_id", kind) if isinstance(kind, StructType) else F.col("document_id").cast("long")
        return scores.withColumn("document_id", read)

    text = chunks.select("document_id", F.regexp_extract_all("folded", F.lit(r"(?U)(\w+|\W)"), 1).alias("p"))
    row = F.transform("p", lambda x, i: F.struct(x.alias("w"), i.alias("pos"), *[F.get("p", i + k).alias(f"w{k}") for k in range(1, 5)]))
    words = text.select("document_id", F.explode(F.filter(row, lambda r: F.length(r["w"]) >= 3)).alias("r")).select("document_id", "r.*")
    # words that begin no phrase go before pairs and triples are made of them
    begins = needles.select(F.substring_index("phrase", " ", 1).alias("w")).distinct()
    if begins.limit(FEW_WORDS + 1).count() <= FEW_WORDS:
        words = words.join(F.broadcast(begins), "w", "left_semi")
    words = words.withColumn("second", F.when(F.col("w1") == " ", F.col("w2"))).withColumn("third", F.when(F.col("w3") == " ", F.col("w4")))
    x, pos, second, third = F.col("w"), F.col("pos"), F.col("second"), F.col("third")
    space = F.lit(" ")
    told = F.array(
        F.struct(x.alias("phrase"), pos, F.lit(None).cast("int").alias("next")),
        F.struct(F.concat(x, space, second).alias("phrase"), pos, F.when(x == second, pos + 4).alias("next")),
        F.struct(F.concat(x, space, second, space, third).alias("phrase"), pos, F.when((x == third) | (x == second), pos + 6).alias("next")),
    )
    told = words.select("document_id", F.explode(told).alias("x")).select("document_id", "x.*")
    found = told.where("phrase is not null").join(wanted, "phrase", "left_semi")
    # only a phrase that begins and ends alike can overlap itself: its places are taken in order
    places = F.array_sort(F.collect_list(F.when(F.col("next").isNotNull(), F.struct("pos", "next"))))
    taken = F.aggregate("places", F.struct(F.lit(0).alias("free"), F.lit(0).cast("long").alias("n")), lambda s, x: F.when(x["pos"] >= s["free"], F.struct(x["next"].alias("free"), (s["n"] + 1).alias("n"))).otherwise(s), lambda s: s["n"])
    counts = found.groupBy("document_id", "phrase").agg(F.count("*").alias("n"), places.alias("places"))
    counts = counts.select("document_id", "phrase", F.when(F.size("places") > 0, taken).otherwise(F.col("n")).alias("n"))
    return counts.join(needles, "phrase").groupBy("query_id", "document_id").agg(F.sum(F.col("n") * F.col("weight")).cast("int").alias("score"))


def references(question: Column) -> dict[str, Column]:
    """Article, clause and point that a question names."""
    q = fold(question)
    find = lambda p: F.nullif(F.regexp_extract(q, p, 1), F.lit(""))
    return {"article": find(r"(?U)\bdieu\s+(\d+[a-z]*)\b"), "clause": find(r"(?U)\bkhoan\s+(\d+[a-z]*)\b"), "point": find(r"(?U)\bdiem\s+([a-z])\b")}


def reference_bonus(asked: dict[str, Column], article: Column, clause: Column, point: Column) -> Column:
    hit = lambda a, b, gain: F.when(a == F.lower(b), gain).otherwise(0.0)
    return F.least(F.lit(0.34), hit(asked["article"], article, 0.22) + hit(asked["clause"], clause, 0.10) + hit(asked["point"], point, 0.08))


def citation_bonus(question: Column, *labels: Column) -> Column:
    """Of a question and labels that are folded already."""
    out = F.lit(False)
    for label in labels:
        out = out | (label != "") & F.contains(question, label)
    return F.when(out, 0.12).otherwise(0.0)


def priority_boost(level: Column, status: Column, since: Column, quality_label: Column, quality: Column, review: Column, day: Column) -> Column:
    """The order of the branches decides: every direct_text label gets the same, and below 85 always loses 4."""
    state = F.lower(F.coalesce(status, F.lit("active")))
    label = F.lower(F.coalesce(quality_label, F.lit("")))
    boost = F.greatest(F.floor(F.coalesce(level, F.lit(0)) / 10), F.lit(0))
    boost = boost + F.when(state == "active", 6).when(state == "expired", -8).when(state == "repealed", -12).when(state == "draft", -4).otherwise(0)
    boost = boost + F.when(since <= day, 2).otherwise(0)
    boost = boost + F.when(F.startswith(label, F.lit("direct_text")), 10).when(label == "ocr_high", 5).when(label == "ocr_medium", -1).when(label == "ocr_low", -8).otherwise(0)
    boost = boost + F.when(quality >= 95, 4).when(quality >= 90, 2).when(quality < 85, -4).otherwise(0)
    return boost + F.when((review == "pending_review") & (quality < 85), -3).otherwise(0)


def hybrid_rank(candidates: DataFrame, limit: int, tables: Tables | None = None) -> DataFrame:
    """Best ``limit`` chunks per query of scored candidates.

    Candidates have query_id, lexical, semantic, reference, citation, boost, char_count, chunk_index and document_id.
    A candidate counts if any of its scores does; scores are scaled by the best of their query.  With ``tables`` the
    candidates are written once and only the bests are shuffled, so that no task holds all of a query.
    """
    kept = candidates.where("lexical > 0 or semantic >= 0.18 or reference > 0 or citation > 0")
    query = Window.partitionBy("query_id")
    best = lambda c: F.max(c).over(query)
    if tables is not None:
        kept = tables.save(kept, "kept")
        kept = kept.join(kept.groupBy("query_id").agg(F.max("lexical").alias("most_lexical"), F.max("semantic").alias("most_semantic")), "query_id")
        best = lambda c: F.col(f"most_{c}")
    norm = lambda c: F.when(best(c) > 0, F.col(c) / best(c)).otherwise(0.0)
    score = norm("lexical") * 0.46 + norm("semantic") * 0.36 + F.col("reference") + F.col("citation") + clamp(F.col("boost") / 100, -0.12, 0.12)
    scored = kept.withColumn("score", F.greatest(F.lit(0), F.bround(score * 100).cast("int")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "char_count", "chunk_index", "document_id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= limit)


def search_terms(words: Column, hints: Column) -> Column:
    """The first eight words and four hints, those of three letters or more, in lower case."""
    some = lambda x, n: F.slice(F.coalesce(x, F.array().cast("array<string>")), 1, n)
    long = F.filter(F.concat(some(words, 8), some(hints, 4)), lambda t: F.length(t) >= 3)
    return F.array_distinct(F.transform(long, F.lower))


def prefilter(questions: DataFrame, chunks: DataFrame, cap: int | None = 5000) -> DataFrame:
    """Pairs of questions (query_id, words, hints) and chunks that hold a term of the question as a part of their text, without case.

    The first ``cap`` chunks of each question in document order count, all if that is None.  Texts meet terms as ``matching`` has it, by the hash
    of a window; a question's first chunks are among the first of each of its terms, so no more of a term's chunks meet
    the questions.  A term is taken as it is: it has no wildcards.
    """
    key = ["document_id", "chunk_index"]
    parts = [c for c in ("retrieval_text", "content", "section_title") if c in chunks.columns]
    own = F.to_json(F.struct(*key)).alias("own")
    told = spread(chunks.select(*key, *parts), "document_id").select(own, F.lower(F.concat_ws("\x00", *parts)).alias("y"))
    asked = questions.select("query_id", F.explode(search_terms(F.col("words"), F.col("hints"))).alias("phrase"))
    held = phrase_places(told, asked.select("phrase"), "own", look_up=True)
    read = F.from_json("own", chunks.select(*key).schema).alias("k")
    if cap is None:
        return held.join(asked, "phrase").select("query_id", "own").distinct().select("query_id", read).select("query_id", "k.*")
    held = held.select("phrase", read).select("phrase", "k.*")
    place = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(*key))
    first = held.withColumn("place", place("phrase")).where(F.col("place") <= cap).drop("place")
    pairs = first.join(asked, "phrase").select("query_id", *key).distinct()
    return pairs.withColumn("place", place("query_id")).where(F.col("place") <= cap).drop("place")


def too_short(questions: DataFrame) -> DataFrame:
    """Questions without a word, which cannot be searched for."""
    return questions.where(F.coalesce(F.size("words"), F.lit(0)) <= 0)


def candidates(questions: DataFrame, chunks: DataFrame, cap: int | None = None, block: int = 64) -> DataFrame:
    """Pairs of the prefilter; questions that it finds nothing for, or that have no term for it, meet all chunks.

    Those questions are dealt to blocks of about ``block``, and each chunk is read once per block.
    """
    asked = questions.where(F.size("words") > 0)
    found = Tables(questions.sparkSession, "candidates").save(prefilter(asked, chunks, cap), "found")
    missed = asked.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    blocks = missed.agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = missed.join(F.broadcast(blocks), F.lit(True)).select("query_id", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"))
    dealt = dealt.groupBy("block").agg(F.collect_list("query_id").alias("ids"))
    each = F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1))
    every = chunks.select("document_id", "chunk_index").join(F.broadcast(blocks), F.lit(True)).withColumn("block", F.explode(each))
    every = every.join(dealt, "block").select(F.explode("ids").alias("query_id"), "document_id", "chunk_index")
    return found.unionByName(every)


def hint_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, document_id, chunk_index, score: ``hint_score`` of the questions' hints where it is not 0.

    Hints are found as parts of the folded texts, and only texts that hold one are looked at for whole words.
    """
    key = ["document_id", "chunk_index"]
    asked = questions.select("query_id", F.explode("hints").alias("phrase")).select("query_id", fold(F.col("phrase")).alias("phrase"))
    asked = asked.where("phrase <> ''").groupBy("query_id", "phrase").agg(F.count("*").alias("n"))
    texts = spread(chunks.select(*key, "content"), "document_id").select(F.to_json(F.struct(*key)).alias("own"), fold(F.col("content")).alias("y"))
    held = phrase_places(texts, asked.select("phrase"), "own", look_up=True).select("own", "phrase")
    times = held.join(texts.hint("merge"), "own").select("own", "phrase", whole_word_count(marked(F.col("y")), F.col("phrase")).alias("times")).where("times > 0")
    scores = times.join(asked, "phrase").groupBy("query_id", "own").agg(F.sum(F.col("times") * F.col("n") * 10).cast("int").alias("score"))
    return scores.select("query_id", F.from_json("own", chunks.select(*key).schema).alias("k"), "score").select("query_id", "k.*", "score")


def search(questions: DataFrame, chunks: DataFrame, limit: int = 5, cap: int | None = None) -> DataFrame:
    """Hybrid search: questions (query_id, text, hints, vector), chunks (document_id, chunk_index, content, numbers, labels, vector, boost).

    Every chunk of the prefilter is scored; with ``cap`` only the first of each question are.  Words and hints are
    counted once per chunk and meet the pairs by an equi-join, so no text goes into a pair.  Questions without a word
    give no rows (``too_short`` names them).
    """
    key = ["document_id", "chunk_index"]
    tables = Tables(questions.sparkSession, "search")
    q = questions.withColumn("words", tokens(F.col("text")))
    pairs = candidates(q, chunks, cap)
    numbers = ("article_number", "clause_number", "point_number")
    # what is said of a question or of a chunk alone is made before they meet
    labels = [fold(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("citation_label", "section_title")]
    told = chunks.select(*key, *numbers, *labels, "vector", "boost", F.length("content").alias("char_count"))
    named = [c.alias(f"asked_{name}") for name, c in references(F.col("text")).items()]
    rows = pairs.join(told, key).join(q.select("query_id", fold(F.col("text")).alias("question"), *named, F.col("vector").alias("query_vector")), "query_id")
    asked = q.where(F.size("words") > 0)
    texts = spread(chunks.select(*key, "content"), "document_id")
    phrases = phrase_scores(asked, texts.select(F.struct(*key).alias("document_id"), fold(F.col("content")).alias("folded")))
    phrases = phrases.select("query_id", "document_id.*", "score").unionByName(hint_scores(asked, chunks))
    rows = rows.join(phrases.groupBy("query_id", *key).agg(F.sum("score").cast("int").alias("phrases")), ["query_id", *key], "left")
    named = {name: F.col(f"asked_{name}") for name in ("article", "clause", "point")}
    rows = rows.withColumn("lexical", F.coalesce("phrases", F.lit(0))).withColumn("semantic", cosine(F.col("query_vector"), F.col("vector")))
    rows = rows.withColumn("reference", reference_bonus(named, *map(F.col, numbers)))
    rows = rows.withColumn("citation", citation_bonus(F.col("question"), F.col("citation_label"), F.col("section_title")))
    return hybrid_rank(rows.select("query_id", *key, "lexical", "semantic", "reference", "citation", "boost", "char_count"), limit, tables)


def embedding_status(vectors: DataFrame, total: str, indexed: str, failed: str) -> Column:
    n, i, f = F.col(total), F.col(indexed), F.col(failed)
    return F.when(n == 0, "not_indexed").when(i == n, "indexed").when(i > 0, "partial").when(f > 0, "failed").otherwise("pending")


def related(hits: DataFrame, chunks: DataFrame, relations: DataFrame, sources: int = 2, limit: int = 4) -> DataFrame:
    """Context of each query's first hits: chunks of the same article or next to a hit, then first chunks of related documents."""
    first = hits.where(F.col("rank") <= sources).select("query_id", "rank", F.col("document_id").alias("hit_doc"), F.col("chunk_index").alias("hit_chunk"))
    told = first.join(chunks.select(F.col("document_id").alias("hit_doc"), F.col("chunk_index").alias("hit_chunk"), F.col("article_number").alias("hit_article")), ["hit_doc", "hit_chunk"])
    near = told.join(chunks, F.col("document_id") == F.col("hit_doc")).where((F.col("chunk_index") != F.col("hit_chunk")) & (F.coalesce(F.col("article_number") == F.col("hit_article"), F.lit(False)) | (F.abs(F.col("chunk_index") - F.col("hit_chunk")) <= 1)))
    near = near.select("query_id", "rank", F.lit(0).alias("phase"), "document_id", "chunk_index", F.lit("same_document_context").alias("relation_type"))
    opening = chunks.withColumn("p", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index"))).where("p = 1").select("document_id", "chunk_index")
    linked = first.join(relations, F.col("source_document_id") == F.col("hit_doc")).join(opening, F.col("target_document_id") == F.col("document_id"))
    linked = linked.select("query_id", "rank", F.lit(1).alias("phase"), "document_id", "chunk_index", "relation_type")
    both = near.unionByName(linked)
    once = F.row_number().over(Window.partitionBy("query_id", "document_id", "chunk_index").orderBy("rank", "phase", "relation_type"))
    both = both.withColumn("once", once).where("once = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "phase", "document_id", "chunk_index"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("once")


#: vectors and queries that one task multiplies
VECTOR_BLOCK = 4096


def _unit(vector: str) -> Column:
    """The vector at length 1; null where it is missing or its length is 0."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def _best_of_blocks(k: int, places: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            ids = vectors["id"].to_numpy()
            for size, asked in queries.groupby(queries["u"].map(lambda u: -1 if u is None else len(u))):
                same = np.array([u is not None and len(u) == size for u in vectors["u"]])
                scores = np.zeros((len(asked), len(vectors)))
                if same.any():
                    scores[:, same] = np.stack(asked["u"].to_numpy()) @ np.stack(vectors["u"][same].to_numpy()).T
                scores = np.round(np.maximum(scores, 0.0), places)
                for query, row in zip(asked["id"].tolist(), scores):
                    row = np.where(ids == query, -1.0, row)
                    keep = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    keep = keep[np.lexsort((ids[keep], -row[keep]))][:k]
                    found += [(query, i, s) for i, s in zip(ids[keep].tolist(), row[keep].tolist()) if s >= 0]
        return pd.DataFrame(found, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    return run


def top_similar(vectors: DataFrame, queries: DataFrame, k: int, places: int = 6, block: int = VECTOR_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k most similar other vectors (id, vector) of each query (id, vector), by cosine of at least 0.

    Vectors that are missing, of length 0 or of another number of components have the cosine 0.  Lengths are
    taken once per vector; blocks meet blocks as matrix products, each gives k per query, and those are merged.
    Scores count at ``places`` decimals; of equal ones the smaller id comes first.
    """
    blocks = lambda df: max(1, -(-df.count() // block))
    flat = lambda df: df.select("id", _unit("vector").alias("u"))
    n, m = blocks(vectors), blocks(queries)
    deal = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = flat(vectors).withColumn("b", deal(n)).withColumn("q", every(m))
    right = flat(queries).withColumn("q", deal(m)).withColumn("b", every(n))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(_best_of_blocks(k, places), "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
