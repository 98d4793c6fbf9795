"""The llm queries, by name; production parameters are the operators' defaults."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import main_content, markup, near_duplicates, neighbors, packing, repetition, shared_lines, split, tokens
from siltstone.session import stage
from siltstone.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cut = split.split_oversized(table(spark, d, "document_chunks"))
    return cut.where("chunk_id is not null and piece_no = 0 and n_pieces > 1").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "document_chunks"))


def p1_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each oversized chunk put together again without their overlaps, and whether all keep to the limit and begin with the overlap."""
    rows = split.split_oversized(table(spark, d, "document_chunks")).where("chunk_id is not null")
    piece = F.struct("piece_no", F.expr("substring(text, overlap_chars + 1)").alias("own"))
    back = (F.col("piece_no") == 0) | (F.col("overlap_tokens") == split.OVERLAP)
    whole = rows.groupBy("chunk_id").agg(F.sum(F.col("n_tokens") - F.col("overlap_tokens")).alias("n_tokens"), F.bool_and(F.col("n_tokens") <= split.LIMIT).alias("within_limit"), F.bool_and(back).alias("with_overlaps"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    return whole.select("chunk_id", "n_tokens", "within_limit", "with_overlaps", F.sha2(F.array_join("pieces.own", ""), 256).alias("text_sha256"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_lines.repeated_lines(table(spark, d, "extract_results")).select("extract_id", "line_no")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """The frequent lines, each told by where it first stands."""
    rows = table(spark, d, "extract_results")
    lines = stage(shared_lines.line_occurrences(rows), "lines")
    first = lines.groupBy("source_id", "line").agg(F.min(F.struct("extract_id", "line_no")).alias("first"))
    frequent = shared_lines.frequent_lines(rows, lines).join(first, ["source_id", "line"])
    return frequent.select("source_id", "first.extract_id", "first.line_no", "support", "documents")


def p2_sequences(spark: SparkSession, d: str) -> DataFrame:
    return shared_lines.frequent_sequences(table(spark, d, "extract_results")).withColumn("pattern", F.concat_ws(" ", F.col("pattern").cast("array<string>")))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return shared_lines.without_repeated_lines(table(spark, d, "extract_results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.similar_pairs(neighbors.most_similar(table(spark, d, "vector_points")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.document_pairs(*near_duplicates.similar_sets(table(spark, d, "extract_results")))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.document_groups(*near_duplicates.similar_sets(table(spark, d, "extract_results")))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents"))


def p9_short(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 512 tokens, which best fit alone fills less well than the search."""
    return packing.fill_containers(table(spark, d, "documents"), capacity=512)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_shares(spark, d).where(F.col("repeated_share") >= repetition.SHARE).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repeated_share(table(spark, d, "documents"))


def p10_perplexity(spark: SparkSession, d: str) -> DataFrame:
    rows = repetition.perplexities(table(spark, d, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("perplexity", "low", "high")})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("record_table", "record_id", F.explode("kinds").alias("kind")).distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d).select("record_table", "record_id", F.concat_ws(" ", "kinds").alias("kinds"), "clean_text")


def _p4(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, key, text in (("extract_results", "extract_id", "extracted_text"), ("document_chunks", "chunk_id", "text")):
        rows = table(spark, d, name).where(F.length(text) > 0).select(F.lit(name).alias("record_table"), F.col(key).cast("string").alias("record_id"), F.col(text).alias("text"))
        parts.append(markup.clean_markup(rows))
    return parts[0].unionByName(parts[1])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_units(spark, d).where("not own").select("record_table", "record_id", "unit_no")


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    texts = main_content.text_units(table(spark, d, "extract_results")).withColumn("record_table", F.lit("extract_results"))
    pages = main_content.page_units(table(spark, d, "fetch_results")).withColumn("record_table", F.lit("fetch_results"))
    return texts.unionByName(pages)


def p6_content(spark: SparkSession, d: str) -> DataFrame:
    texts = main_content.own_text(table(spark, d, "extract_results"), "text").withColumn("record_table", F.lit("extract_results"))
    return texts.unionByName(main_content.own_text(table(spark, d, "fetch_results"), "page").withColumn("record_table", F.lit("fetch_results")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rejoined, p2_found, p2_lines, p2_sequences, p2_clean, p4_found, p4_clean, p5_found, p6_found, p6_units, p6_content, p7_found, p7_groups, p8_ids, p9_containers, p9_short, p10_found, p10_shares, p10_perplexity)}
