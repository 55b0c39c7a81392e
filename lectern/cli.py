"""python -m lectern.cli FILE: passages of a text file for the queries that are typed in, until 'exit'."""

from __future__ import annotations

import sys


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from lectern.functions import text as X
    from lectern.operators.search import Bm25Index, chunks
    from lectern.sources.readers import read_texts

    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    texts = read_texts(spark, sys.argv[1])
    how = texts.select(X.tokenizer_of(X.detect_language(F.col("text")))).first()[0]
    index = Bm25Index(chunks(texts, "file", "text", how).cache())
    while (query := input("query> ").strip()).lower() != "exit":
        terms = spark.createDataFrame([(query,)], "q string").select(X.tokens(F.col("q"), how)).first()[0]
        for r in index.search(list(terms)).orderBy("rank").collect():
            print(f"[{r.chunk_id}] {r.score:.4f}\n{r.text}\n")


if __name__ == "__main__":
    main()
