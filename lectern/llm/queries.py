"""Queries of the problems of training text, with SQL where SQL can say the same."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import alignment, encode, leaks, lookalikes, pages, scans, sentences
from lectern.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    out = alignment.align(table(spark, root, "chapter_pairs"), "chapter_pair_id", "en", "zh")
    return out.select("chapter_pair_id", F.col("first_no").alias("en_no"), F.col("second_no").alias("zh_no")).distinct()


def _scans(spark: SparkSession, root: str) -> scans.Scans:
    rows = None
    for name, field in (("pairs_en", "target"), ("pairs_zh", "zh")):
        part = table(spark, root, name).select(F.lit(field).alias("field"), F.col("pair_id").alias("id"), "book", F.expr("origin = 'scan'").alias("scan"), F.col(field).alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    titles = table(spark, root, "front_matter").select("book", F.expr("explode(split(text, '\n'))").alias("title"))
    return scans.Scans(rows, titles)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _scans(spark, root).noise().withColumnRenamed("id", "pair_id")


def p2_text(spark: SparkSession, root: str) -> DataFrame:
    return _scans(spark, root).repaired().withColumnRenamed("id", "pair_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    out = lookalikes.same_texts(table(spark, root, "pairs_zh"), "pair_id", "zh")
    return out.withColumnsRenamed({"id_a": "pair_id_a", "id_b": "pair_id_b"})


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Each row's class of texts that read the same, with the different strings and the rows of the class."""
    return lookalikes.text_classes(table(spark, root, "pairs_zh"), "pair_id", "zh").drop("raw").distinct()


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    out = None
    for name, field in (("pairs_en", "target"), ("pairs_zh", "zh")):
        rows = table(spark, root, name).where("not origin <=> 'scan'").select("pair_id", field).distinct()
        part = sentences.split_sentences(rows, "pair_id", field).select(F.lit(field).alias("field"), "pair_id", "sent_no", "end_pos")
        out = part if out is None else out.unionByName(part)
    return out


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode.encode(table(spark, root, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks.find_leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Windows at distance 0, as the operator has verified them."""
    return _leaks(spark, root).where("distance = 0").select("doc_id", "item_id")


def p7_near(spark: SparkSession, root: str) -> DataFrame:
    """Windows within one edit."""
    return _leaks(spark, root)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return pages.label_pages(table(spark, root, "documents"), "doc_id", "text").where("nonprose > 0.5").select("doc_id")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_text": p2_text, "p3_found": p3_found, "p3_classes": p3_classes, "p4_found": p4_found, "p6_ids": p6_ids, "p7_found": p7_found, "p7_near": p7_near, "p8_found": p8_found}
SQL: dict[str, str] = {}
