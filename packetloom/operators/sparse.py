"""Keyword retrieval: word and bigram TF-IDF with cosine ranking, for many queries at once.

The postings of an index and of a search come from ``postings.weighted``, which moves no posting. An index of asked terms alone, for
many small scopes, counts its terms by rows: documents are hashed by id once, term counts need no further shuffle and meet the
document frequencies through a salted join (a common word may sit in a third of all documents). Ranking keeps only the best
``k`` rows per query and task before anything is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.postings import Counted
from packetloom.operators.words import english_stop_words
from packetloom.runtime import broadcast_if_small, fits, materialize, salted_join

TOP_K = 6
MAX_QUERY_TERMS = 500_000
PARTITION_CHARS = 4_000_000  # some 600,000 words of text for one task


def terms(content: Column, stop_words: list[str]) -> Column:
    """Lower-cased words of two or more word characters without stop words, then adjacent pairs."""
    words = F.regexp_extract_all(F.lower(content), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(stop_words)) if stop_words else words


def _with_terms(docs: DataFrame, text_col: str, stop_words: list[str]) -> DataFrame:
    words = F.col("_words")
    shifted = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.transform(F.arrays_zip(words.alias("a"), shifted.alias("b")),
                        lambda p: F.concat_ws(" ", p["a"], p["b"]))
    pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return docs.withColumn("_words", terms(F.col(text_col), stop_words)).withColumn(
        "_terms", F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def text_partitions(docs: DataFrame, text_col: str, chars: int = PARTITION_CHARS) -> int:
    """Partitions for ``docs`` with about ``chars`` characters each, at least one per core."""
    total = docs.agg(F.sum(F.length(text_col).cast("bigint"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // chars))


def term_counts(docs: DataFrame, doc_id: str, text_col: str, stop_words: list[str], scope: list[str]) -> DataFrame:
    """(scope, document, term, tf); documents of one hash partition stay where they are.

    Tokens take many times the room of their text, and Spark knows only the text when it merges partitions; so their number is
    fixed by the characters, which bounds what one task counts at every size.
    """
    placed = docs.select(*scope, doc_id, text_col).repartition(text_partitions(docs, text_col), *scope, doc_id)
    return (
        _with_terms(placed, text_col, stop_words)
        # The outer form keeps Spark from testing for empty lists, and so cutting the tokens, below the exchange.
        .select(*scope, doc_id, F.explode_outer("_terms").alias("term"))
        .where("term is not null")
        .groupBy(*scope, doc_id, "term").agg(F.count(F.lit(1)).alias("tf"))
    )


def idf_table(counts: DataFrame, docs: DataFrame, scope: list[str]) -> DataFrame:
    """Smoothed idf per term: ln((1 + N) / (1 + df)) + 1."""
    df = counts.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    if scope:
        df = df.join(docs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n_docs")), scope)
    else:
        df = df.withColumn("n_docs", F.lit(docs.count()))
    return df.withColumn("idf", F.log((1.0 + F.col("n_docs")) / (1.0 + F.col("df"))) + 1.0).drop("n_docs")


def asked_terms(queries: DataFrame, query_id: str, text_col: str, stop_words: list[str] | None = None,
                scope: list[str] | None = None) -> DataFrame:
    """The different (scope, term) of the queries."""
    stops = english_stop_words() if stop_words is None else stop_words
    return term_counts(queries, query_id, text_col, stops, scope or []).select(*(scope or []), "term").distinct()


def build_index(docs: DataFrame, doc_id: str, text_col: str, stop_words: list[str] | None = None,
                scope: list[str] | None = None, hot_rows: int = 1_000_000,
                keep_tf: bool = False, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Posting table (scope, document, term, weight) with unit-length documents, and the idf table.

    With ``asked`` (scope, term) the postings are those of the terms that are asked for, with the same weights: every term still
    counts for its document's length, a sum combined before the shuffle, but only asked postings are weighted and moved.
    """
    scope = scope or []
    stops = english_stop_words() if stop_words is None else stop_words
    kept = ["tf"] if keep_tf else []
    if asked is None:
        postings = Counted(docs, doc_id, text_col, stops, scope, hot_rows).postings()
        idf = postings.groupBy(*scope, "term").agg(F.first("df").alias("df"), F.first("idf").alias("idf"))
        return postings.select(*scope, doc_id, "term", *kept, "weight"), idf
    # Written once: the document frequencies and the postings both come from it; so is the vocabulary, which several joins read.
    counts = materialize(term_counts(docs, doc_id, text_col, stops, scope), "term-counts")
    idf = materialize(idf_table(counts, docs, scope), "idf")
    raw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    # The term is the first key: sorting by it tells rows apart sooner than by their scope.
    all_raw = salted_join(counts, idf, ["term", *scope], "df", doc_id, hot_rows).select(*scope, doc_id, raw.alias("_raw"))
    lengths = all_raw.groupBy(*scope, doc_id).agg(F.sqrt(F.sum(F.col("_raw") * F.col("_raw"))).alias("_length"))
    known = materialize(idf.join(asked, [*scope, "term"], "left_semi").select(*scope, "term", "idf"), "asked-terms")
    found = counts.join(broadcast_if_small(known, MAX_QUERY_TERMS), [*scope, "term"]).select(*scope, doc_id, "term", *kept, raw.alias("_raw"))
    return found.join(lengths, [*scope, doc_id]).select(*scope, doc_id, "term", *kept, (F.col("_raw") / F.col("_length")).alias("weight")), idf


def search(docs: DataFrame, queries: DataFrame, doc_id: str, text_col: str, query_id: str, query_text: str, k: int = TOP_K,
           stop_words: list[str] | None = None, digits: int = 6, hot_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(best ``k`` documents per query, postings read per query) for queries that are asked once, without an index.

    The same ranking as :func:`build_index` and :func:`retrieve`, but scores are summed where a document's terms are, and only the best
    ``k`` rows per query and bundle of documents leave it.
    """
    stops = english_stop_words() if stop_words is None else stop_words
    counted = Counted(docs, doc_id, text_col, stops, [], hot_rows, queries, query_id, query_text)
    known = materialize(counted.asked().groupBy("term").agg(F.first("df").alias("df"), F.first("idf").alias("idf")), "asked-terms")
    vectors = materialize(query_vectors(queries, known, query_id, query_text, stops, kept=["df"]), "query-vectors")
    best = ranked(counted.best(vectors, k, digits), doc_id, query_id, k)
    return best, vectors.groupBy(query_id).agg(F.sum("df").alias("postings_read"))


def query_vectors(queries: DataFrame, idf: DataFrame, query_id: str, text_col: str,
                  stop_words: list[str] | None = None, scope: list[str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """Unit-length query vectors over the corpus vocabulary; unknown terms are ignored.

    The rows are counted before the vocabulary is joined, on the query texts alone; within
    ``MAX_QUERY_TERMS`` the result carries a broadcast hint.
    """
    scope = scope or []
    stops = english_stop_words() if stop_words is None else stop_words
    counts = term_counts(queries, query_id, text_col, stops, scope)
    small = fits(counts, MAX_QUERY_TERMS)
    counts = F.broadcast(counts) if small else counts
    raw = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    kept = kept or []
    weighted = counts.join(idf.select(*scope, "term", *{"idf", *kept}), [*scope, "term"]).select(
        *scope, query_id, "term", *kept, raw.alias("_raw"))
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(*scope, query_id)))
    vectors = weighted.select(*scope, query_id, "term", *kept, (F.col("_raw") / norm).alias("query_weight"))
    return F.broadcast(vectors) if small else vectors


def retrieve(postings: DataFrame, vectors: DataFrame, doc_id: str, query_id: str, k: int = TOP_K,
             scope: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Best ``k`` documents per query by cosine, only with a score above 0.

    With few query terms the vectors are broadcast (see ``query_vectors``): postings stay on their document's partition,
    scores are summed there, and every task hands on at most ``k`` rows per query. More query
    terms are joined through a shuffle on the term.
    """
    scope = scope or []
    scores = (
        postings.join(vectors, [*scope, "term"])
        .groupBy(*scope, doc_id, query_id)
        .agg(F.round(F.sum(F.col("weight") * F.col("query_weight")), digits).alias("score"))
        .where("score > 0")
    )
    return ranked(scores, doc_id, query_id, k, scope)


def ranked(scores: DataFrame, doc_id: str, query_id: str, k: int, scope: list[str] | None = None) -> DataFrame:
    """The ``k`` best rows of every query, equal scores in order of id."""
    w = Window.partitionBy(*(scope or []), query_id).orderBy(F.col("score").desc(), F.col(doc_id).asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
