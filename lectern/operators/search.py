"""BM25 search over overlapping token chunks, by an index that is stored once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.tables import discard, materialise

# The usual parameters of the Okapi form with floored negative idf.
K1, B, EPSILON = 1.5, 0.75, 0.25


def chunks(df: DataFrame, corpus: str, text: str, tokenizer: str = "auto", size: int = 300, overlap: int = 50, retokenize: bool = True) -> DataFrame:
    """(corpus, tokenizer, chunk_id, text, tokens): chunks of each text, numbered from 0. ``auto`` takes the tokenizer of
    the language detected in the whole text; chunks are joined by spaces and tokenized again."""
    how = X.tokenizer_of(X.detect_language(F.col(text))) if tokenizer == "auto" else F.lit(tokenizer)
    rows = df.select(F.col(corpus).alias("corpus"), F.col(text).alias("t"), how.alias("tokenizer"))
    rows = rows.select("corpus", "tokenizer", F.posexplode(X.token_chunks(X.tokens(F.col("t"), F.col("tokenizer")), size, overlap)).alias("chunk_id", "toks"))
    rows = rows.select("corpus", "tokenizer", "chunk_id", F.array_join("toks", " ").alias("text"), "toks")
    return rows.select("corpus", "tokenizer", "chunk_id", "text", (X.tokens(F.col("text"), F.col("tokenizer")) if retokenize else F.col("toks")).alias("tokens"))


def counted(tokens: Column) -> Column:
    """The distinct tokens with their number, as an array of (term, tf): runs of the sorted tokens."""

    def runs(v: Column) -> Column:
        n = F.size(v["s"])
        first = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & ((i == 0) | (F.get(v["s"], i) != F.get(v["s"], i - 1))))
        return X.let(lambda w: F.transform(w["at"], lambda i, k: F.struct(F.get(v["s"], i).alias("term"), (F.coalesce(F.get(w["at"], k + 1), n) - i).alias("tf"))), at=first)

    return X.let(runs, s=F.array_sort(tokens))


def _join(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Joined by some columns; ``other`` has one row if there are none."""
    return df.join(other, on) if on else df.crossJoin(F.broadcast(other))


class Bm25Index:
    """Chunks indexed by corpus; with ``pooled`` all chunks form one corpus. Building it tokenizes the texts once and
    writes three tables: chunks, postings in the order of their terms, and the terms with their weights. A search reads
    the postings of the asked terms. ``drop`` deletes the tables.

    ``chunks``: rows (corpus, tokenizer, chunk_id, text, tokens). A corpus without chunks simply has no rows."""

    def __init__(self, chunks: DataFrame, pooled: bool = False) -> None:
        self.scope = [] if pooled else ["corpus"]
        self.chunks = materialise(chunks.select("corpus", "tokenizer", "chunk_id", X.snippet(F.col("text")).alias("text"), F.size("tokens").alias("dl"), counted(F.col("tokens")).alias("terms")), "chunks")
        self.totals = materialise(self.chunks.groupBy(*self.scope).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avgdl")), "totals")
        postings = self.chunks.select("corpus", "tokenizer", "chunk_id", "dl", F.inline("terms"))
        # a range of terms and corpora a task: a term of every chunk is many tasks, and files know the terms they hold
        self.postings = materialise(postings.repartitionByRange("term", "corpus").sortWithinPartitions("term"), "postings")
        # a term counts once per chunk for df, however often it stands there
        df = self.postings.groupBy(*self.scope, "term").agg(F.count(F.lit(1)).alias("df"))
        raw = _join(df, self.totals.drop("avgdl"), self.scope).withColumn("raw", F.expr("ln(n_chunks - df + 0.5D) - ln(df + 0.5D)"))
        raw = materialise(raw.select(*self.scope, "term", "raw"), "raw")
        mean = raw.groupBy(*self.scope).agg((F.avg("raw") * EPSILON).alias("floor"))
        self.idf = materialise(_join(raw, mean, self.scope).select(*self.scope, "term", F.expr("if(raw < 0, floor, raw)").alias("idf")), "terms")
        discard(raw)

    def drop(self) -> None:
        discard(self.chunks, self.totals, self.postings, self.idf)

    def _scores(self, postings: DataFrame, asked: DataFrame, idf: DataFrame, on: list[str]) -> DataFrame:
        """(query_id, corpus, chunk_id, score) of the chunks that hold a term."""
        parts = _join(postings.join(asked, on).join(idf, [*self.scope, "term"]), self.totals, self.scope)
        parts = parts.withColumn("part", F.expr(f"times * idf * tf * ({K1}D + 1) / (tf + {K1}D * (1 - {B}D + {B}D * dl / avgdl))"))
        return parts.groupBy("query_id", "corpus", "chunk_id").agg(F.sum("part").alias("score"))

    def _best(self, scored: DataFrame, top_k: int) -> DataFrame:
        best = Window.partitionBy("query_id", *self.scope).orderBy(*self._order())
        top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
        return top.join(self.chunks.select("corpus", "chunk_id", "text"), ["corpus", "chunk_id"]).select("query_id", "rank", "corpus", "chunk_id", "score", "text")

    @staticmethod
    def _order() -> list[Column]:
        return [F.desc(F.round("score", 9)), F.asc("corpus"), F.asc("chunk_id")]

    def search(self, terms: list[str], top_k: int = 5) -> DataFrame:
        """(rank, corpus, chunk_id, score, text): the best chunks of each corpus for ready terms. A term that is given
        twice counts twice; chunks that hold no term score 0 and are returned as well; ties go to the lower chunk."""
        spark = self.chunks.sparkSession
        wanted = list(dict.fromkeys(terms))
        asked = spark.createDataFrame([(0, t, terms.count(t)) for t in wanted], "query_id int, term string, times int")
        scores = self._scores(self.postings.where(F.col("term").isin(wanted)), asked, self.idf.where(F.col("term").isin(wanted)), ["term"])
        every = self.chunks.select("corpus", "chunk_id").join(scores.drop("query_id"), ["corpus", "chunk_id"], "left").fillna(0.0, ["score"])
        every = every.withColumn("query_id", F.lit(0))
        if not self.scope:  # each task keeps its best, one task merges them
            every = every.orderBy(*self._order()).limit(top_k)
        return self._best(every, top_k).drop("query_id")

    def ask(self, queries: DataFrame, query_id: str, query: str, top_k: int = 5) -> DataFrame:
        """(query_id, rank, corpus, chunk_id, score, text): for each row of a table of queries the best chunks, of each
        corpus, that hold a term of it. A query is tokenized as the text it is held against was. Null and empty queries
        find nothing; repeated rows count once."""
        rows = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("q")).distinct()
        rows = rows.select("query_id", F.explode(F.array(*[F.struct(F.lit(n).alias("tokenizer"), f(F.col("q")).alias("t")) for n, f in X.TOKENIZERS.items()])).alias("x"))
        asked = rows.select("query_id", "x.tokenizer", F.explode("x.t").alias("term")).groupBy("query_id", "tokenizer", "term").agg(F.count(F.lit(1)).alias("times"))
        return self._best(self._scores(self.postings, asked, self.idf, ["tokenizer", "term"]), top_k).withColumnRenamed("query_id", query_id)
