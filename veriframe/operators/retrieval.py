"""R-01 to R-08, S-11, W-02, W-03, U-01, U-03: an index of postings and hybrid top-k search.

Weights of terms in documents do not depend on the query, so they are computed once into postings; a query joins its
terms to them and adds up. Nothing is densified. Statistics and peaks are over the whole corpus; filters come after.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veriframe.functions.logic import among
from veriframe.functions.text import STOP_WORDS, ngram_terms, terms, token_set

TOP_K, K1, B = 5, 1.5, 0.75
BLEND = (0.8, 0.2)
FEATURES = 20_000
#: Query sets of at most so many rows are broadcast; larger ones are joined by a shuffle.
FEW_QUERIES = 10_000


def frequencies(docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """(key, term, tf).

    Its readers in one plan share its shuffle; that terms are not null is said here, as each join would add it for itself
    and so make another shuffle of its own.
    """
    return docs.select(key, F.explode(words).alias("term")).where(F.col("term").isNotNull()).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _restricted(terms_: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows whose term a set of terms has; the set is that of a query set of a checked size, so it is broadcast."""
    return terms_ if only is None else terms_.join(F.broadcast(only), "term", "left_semi")


#: A term that each document has once, for the number of documents and their average length; no token is empty.
_EACH = ""


def _counted(docs: DataFrame, words: Column, key: str, only: DataFrame | None) -> DataFrame:
    """(key, len, term, tf), with a row of the term _EACH for each document: one pass over the texts."""
    each = docs.select(key, words.alias("t")).select(key, F.size("t").alias("len"), F.explode(F.concat("t", F.array(F.lit(_EACH)))).alias("term")).where(F.col("term").isNotNull())
    if only is not None:
        only = only.unionByName(only.sparkSession.createDataFrame([(_EACH,)], "term string")).distinct()
    return _restricted(each, only).groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _weighed(counts: DataFrame) -> DataFrame:
    """(term, df, idf, n_docs, avg_len) of (term, len) rows, one for each document and term; _EACH is among them."""
    # tf is asked for, so that the counts are the same shuffle for all their readers
    by_term = counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("len").alias("_lengths"))
    of_all = F.col("term") == F.lit(_EACH)
    whole = by_term.agg(F.coalesce(F.max(F.when(of_all, F.col("df"))), F.lit(0)).alias("n_docs"), F.max(F.when(of_all, F.col("_lengths") / F.col("df"))).alias("avg_len"))
    return by_term.drop("_lengths").crossJoin(F.broadcast(whole)).withColumn("idf", F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", stop: tuple[str, ...] = STOP_WORDS, only: DataFrame | None = None) -> DataFrame:
    """A-19: (term, df, idf, n_docs, avg_len); documents without terms count in n_docs and avg_len. only: terms wanted."""
    each = docs.select(terms(text, stop).alias("t")).select(F.size("t").alias("len"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(_EACH)))).alias("term")).withColumn("tf", F.lit(1))
    if only is not None:
        only = only.unionByName(only.sparkSession.createDataFrame([(_EACH,)], "term string")).distinct()
    # written out of the condition's reach, which would otherwise be applied before the count of documents
    return _weighed(_restricted(each, only)).where(F.when(F.col("term") != F.lit(_EACH), F.col("idf")).isNotNull())


def bm25_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, stop: tuple[str, ...] = STOP_WORDS, only: DataFrame | None = None) -> DataFrame:
    """R-03: (term, key, weight): idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_len)).

    With ``only`` the postings of those terms alone, by the same statistics: what one search needs, without the shuffle
    of all postings. Postings and statistics come from the same counts, which read each text once.
    """
    counts = _counted(docs, terms(text, stop), key, only)
    norm = k1 * (1 - b + b * F.when(F.col("avg_len") > 0, F.col("len") / F.col("avg_len")).otherwise(1.0))
    weight = F.when(F.col("term") != F.lit(_EACH), F.col("idf") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + norm))
    return counts.join(_weighed(counts), "term").select("term", key, weight.alias("weight")).where(F.col("weight").isNotNull())


def tfidf_vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", features: int = FEATURES, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, idf) of the ``features`` terms that are most frequent in the corpus (ties: the smaller term)."""
    tf = frequencies(docs, ngram_terms(text, stop), key)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    best = tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("cf"), "term").limit(features)
    return best.crossJoin(F.broadcast(n)).select("term", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def _unit(frequencies_: DataFrame, vocabulary: DataFrame, features: int, key: str) -> DataFrame:
    """(term, key, weight) of rows of length one. A vocabulary of at most FEATURES terms is broadcast (about a megabyte)."""
    raw = frequencies_.join(F.broadcast(vocabulary) if features <= FEATURES else vocabulary, "term").withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = raw.groupBy(F.col(key).alias("_n")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # null-safe, as a plain join would add a condition to one reader of the counts and so make a second shuffle
    return raw.join(norm, F.col(key).eqNullSafe(F.col("_n"))).select("term", key, (F.col("w") / F.col("norm")).alias("weight"))


def tfidf_postings(docs: DataFrame, key: str = "doc_id", text: str = "text", features: int = FEATURES, stop: tuple[str, ...] = STOP_WORDS, only: DataFrame | None = None) -> DataFrame:
    """R-05: (term, key, weight) of unit rows: (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) over the vocabulary.

    A row's length needs all its terms, so ``only`` is applied to the result.
    """
    out = _unit(frequencies(docs, ngram_terms(text, stop), key), tfidf_vocabulary(docs, key, text, features, stop), features, key)
    return _restricted(out, only)


def tfidf_query(queries: DataFrame, docs: DataFrame, query: str = "query_id", text: str = "query", key: str = "doc_id", doc_text: str = "text", features: int = FEATURES, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(query, term, weight): queries weighed like documents, by the documents' statistics."""
    return _unit(frequencies(queries, ngram_terms(text, stop), query), tfidf_vocabulary(docs, key, doc_text, features, stop), features, query).select(query, "term", "weight")


def bm25_query(queries: DataFrame, query: str = "query_id", text: str = "query", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """R-04: (query, term, weight 1) of distinct terms."""
    return queries.select(query, F.explode(F.array_distinct(terms(text, stop))).alias("term"), F.lit(1.0).alias("weight"))


def dot(postings: DataFrame, query_terms: DataFrame, query: str = "query_id", key: str = "doc_id", few: bool = False) -> DataFrame:
    """J-33: (query, key, score): products of weights of shared terms, added up before and after one shuffle."""
    q = query_terms.withColumnRenamed("weight", "qw")
    return postings.join(F.broadcast(q) if few else q, "term").groupBy(query, key).agg(F.sum(F.col("weight") * F.col("qw")).alias("score"))


def keyword_overlap(docs: DataFrame, queries: DataFrame, query: str = "query_id", query_text: str = "query", key: str = "doc_id", text: str = "text", few: bool = False) -> DataFrame:
    """R-07: (query, key, kw): share of the query's distinct tokens, stop words kept, that the document has; no row for 0."""
    q = queries.select(query, token_set(query_text).alias("t")).select(query, F.size("t").alias("n"), F.explode("t").alias("token"))
    d = docs.select(key, F.explode(token_set(text)).alias("token"))
    return d.join(F.broadcast(q) if few else q, "token").groupBy(query, key, "n").agg(F.count(F.lit(1)).alias("c")).select(query, key, (F.col("c") / F.col("n")).alias("kw"))


def top_k(scored: DataFrame, docs: DataFrame, queries: DataFrame, k: int | None = None, where: Column | None = None, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """O-03, W-03, N17: the k best documents of each query that ``where`` lets through, (query, key, score, rank).

    Documents without a score count as 0 and fill up a query's list in the order of their keys: the first 2k documents
    hold enough of them, as a query that needs any has fewer than k scored ones. Ties go to the smaller key; the rank is
    limited within each task before the shuffle. k of null or 0 is the default.
    """
    k = k or TOP_K
    allowed = docs if where is None else docs.where(where)
    own = scored.join(allowed.select(key), key, "left_semi") if where is not None else scored
    first = F.broadcast(allowed.select(key).orderBy(key).limit(2 * k))
    fill = queries.select(query).crossJoin(first).withColumn("score", F.lit(0.0))
    both = own.select(query, key, "score").unionByName(fill).groupBy(query, key).agg(F.max("score").alias("score"))
    # to nine places, so that equal documents tie whatever the order of their sums
    order = Window.partitionBy(query).orderBy(F.round("score", 9).desc(), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass
class Index:
    """An index of one backend: ``postings`` by term and the documents it was built over."""

    backend: str
    postings: DataFrame | None  # None: made for each search
    docs: DataFrame
    key: str = "doc_id"
    text: str = "text"
    section: str | None = None

    #: Backends by name; another may be added. Each: postings of documents, weighted terms of queries, all terms of
    #: queries, whether scores are in [0, 1].
    backends = {
        "bm25": (bm25_postings, lambda q, d, **k: bm25_query(q), lambda q: terms("query"), False),
        "tfidf": (tfidf_postings, lambda q, d, key, text: tfidf_query(q, d, key=key, doc_text=text), lambda q: ngram_terms("query"), True),
    }

    @classmethod
    def build(cls, docs: DataFrame, backend: str = "bm25", key: str = "doc_id", text: str = "text", section: str | None = None) -> Index:
        if backend not in cls.backends:
            raise ValueError(f"no backend {backend!r}; there are {sorted(cls.backends)}")
        return cls(backend, None, docs, key, text, section)

    def save(self, path: str) -> None:
        """S-11: postings and a description, under the backend's name."""
        spark = self.docs.sparkSession
        self.backends[self.backend][0](self.docs, self.key, self.text).write.mode("overwrite").parquet(f"{path}/{self.backend}/postings")
        spark.createDataFrame([(self.backend, self.docs.count())], "backend string, n_docs bigint").write.mode("overwrite").parquet(f"{path}/{self.backend}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, docs: DataFrame, backend: str = "bm25", **names: str) -> Index:
        """The saved index, or a new one if none is there, another backend wrote it, or the documents' number differs."""
        try:
            meta = spark.read.parquet(f"{path}/{backend}/meta").first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            meta = None
        if meta is None or meta["backend"] != backend or meta["n_docs"] != docs.count():
            built = cls.build(docs, backend, **names)
            built.save(path)
        return cls(backend, spark.read.parquet(f"{path}/{backend}/postings"), docs, **names)

    def scores(self, queries: DataFrame, query: str = "query_id", text: str = "query", hybrid: bool = True) -> DataFrame:
        """R-08: (query, key, score) of documents that share anything with the query.

        Unbounded scores are divided by the query's peak over all documents before they are blended with the overlap.
        """
        make, weigh, all_terms, bounded = self.backends[self.backend]
        few = queries.count() <= FEW_QUERIES
        q = queries.select(F.col(query).alias("query_id"), F.col(text).alias("query"))
        postings = self.postings
        if postings is None:
            only = q.select(F.explode(all_terms(q)).alias("term")).distinct() if few else None
            postings = make(self.docs, self.key, self.text, only=only)
        s = dot(postings, weigh(q, self.docs, key=self.key, text=self.text), "query_id", self.key, few)
        if hybrid:
            if not bounded:
                peak = F.max("score").over(Window.partitionBy("query_id"))
                s = s.withColumn("score", F.when(peak > 0, F.col("score") / peak).otherwise(F.col("score")))
            words = F.col(self.text) if self.section is None else F.concat_ws(" ", self.text, self.section)
            kw = keyword_overlap(self.docs.select(self.key, words.alias("_w")), q, key=self.key, text="_w", few=few)
            both = s.select("query_id", self.key, (F.col("score") * BLEND[0]).alias("score")).unionByName(kw.select("query_id", self.key, (F.col("kw") * BLEND[1]).alias("score")))
            s = both.groupBy("query_id", self.key).agg(F.sum("score").alias("score"))
        return s.withColumnRenamed("query_id", query) if query != "query_id" else s

    def search(self, queries: DataFrame, k: int | None = None, where: Column | None = None, query: str = "query_id", text: str = "query", hybrid: bool = True) -> DataFrame:
        return top_k(self.scores(queries, query, text, hybrid), self.docs, queries, k, where, query, self.key)


def keep(source: str | None = None, exclude_kinds: list[str | None] | None = None, source_col: str = "source", kind_col: str = "kind") -> Column:
    """P-05: the source, and a kind not listed; null is a kind that may be listed."""
    out = F.lit(True) if source is None else F.col(source_col).eqNullSafe(source)
    return out & ~among(F.col(kind_col), exclude_kinds) if exclude_kinds else out


def _unit_rows(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of length one as doubles; null, zero and non-finite vectors, and those of other dimensions, are zero."""
    out = np.zeros((len(column), dims))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == dims)
    if dims and len(good):
        x = column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        out[good] = np.divide(x, norm, out=np.zeros_like(x), where=np.isfinite(norm) & (norm > 0))
    return out


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """R-06: the k vectors with the largest cosine to each query vector, (query_id, key, score, rank).

    A stated query set against all rows, in blocks: FEW_QUERIES queries of a block are broadcast to all rows, which are
    multiplied in Arrow batches; each task gives its k best rows of each query. A vector that is null, zero or of other
    dimensions has the cosine 0. Ties to nine places go to the smaller key.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    number = max(1, -(-queries.count() // FEW_QUERIES))
    found = None
    for i in range(number):
        block = q if number == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == i)
        part = _cosine_block(vectors.select(F.col(key).alias(key), F.col(vector).alias(vector)), block, k, key, vector)
        found = part if found is None else found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key))).where(F.col("rank") <= k)


def _cosine_block(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    asked = queries.toArrow()
    dims = max(asked.column("_q").combine_chunks().value_lengths().fill_null(0).to_pylist(), default=0)
    shared = vectors.sparkSession.sparkContext.broadcast((asked.column("query_id").combine_chunks(), _unit_rows(asked.column("_q").combine_chunks(), dims)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units = shared.value
        best = np.full((0, len(names)), -np.inf)
        keys = np.zeros((0, len(names)), np.int64)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(ids), 1024):
                own = ids[i : i + 1024]
                score = np.concatenate([best, _unit_rows(b.column(1).slice(i, len(own)), dims) @ units.T])
                name = np.concatenate([keys, np.repeat(own[:, None], len(names), axis=1)])
                if len(score) > 8 * k:  # only rows that can be among the best; all that tie with the last
                    rounded = score.round(9)
                    some = np.flatnonzero((rounded >= -np.partition(-rounded, k - 1, axis=0)[k - 1]).any(1))
                    score, name = score[some], name[some]
                order = np.lexsort((name, -score.round(9)), axis=0)[:k]
                best, keys = np.take_along_axis(score, order, 0), np.take_along_axis(name, order, 0)
        if len(best):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.tile(np.arange(len(names)), len(best)))), pa.array(keys.ravel()), pa.array(best.ravel())], names=["query_id", key, "score"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.where(F.col(key).isNotNull()).mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {kind}, score double")
