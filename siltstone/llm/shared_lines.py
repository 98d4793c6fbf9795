"""Problem 2: lines repeated across the documents of one source.

Method: PrefixSpan over the sequences of line identifiers of each source, grown one item a level by DataFrame joins. Level 1
gives the frequent single lines; a longer sequence is frequent only if all its lines are, so deleting the occurrences of all
frequent sequences, single lines included, deletes exactly the occurrences of the frequent single lines.

Support is counted in distinct documents of a source. Keys are pre-aggregated before the shuffle ((source, line, document) is
made distinct map-side), so a line or a source with a third of all rows is spread over all tasks.

Defined results: rows without a source_id or a text have no lines; a text that holds only short or fenced lines has none;
rows that occur twice under their own extract_id each have their occurrences, but count as one document; rows without a
document_id have occurrences, but support nothing. Line ends of any kind count as blanks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import DIGITS, fenced
from siltstone.session import bound_batches, spread, stage

MIN_CHARS, MIN_DOCUMENTS, MIN_SHARE = 20, 4, 0.05


def line_form(line: str) -> str:
    """What lines that count as the same have in common."""
    return DIGITS.sub("0", " ".join(line.split()).lower())


def line_occurrences(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(source_id, extract_id, doc, line_no, line): each line long enough and outside fences; doc and line are 64-bit hashes."""
    bound_batches(df.sparkSession)
    rows = df.where(F.col("source_id").isNotNull() & (F.length("extracted_text") >= min_chars))
    rows = spread(rows.select("source_id", "extract_id", F.when(F.col("document_id").isNotNull(), F.xxhash64("document_id")).alias("doc"), "extracted_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nos, lines = [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                for n, line, inside in fenced(text.split("\n")):
                    if not inside and len(line) >= min_chars and len(line.strip()) >= min_chars:
                        at.append(i)
                        nos.append(n)
                        lines.append(xxhash.xxh3_64_intdigest(line_form(line).encode("utf-8", "surrogatepass")) - (1 << 63))
            index = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), batch.column(2).take(index), pa.array(nos, pa.int32()), pa.array(lines, pa.int64())],
                names=["source_id", "extract_id", "doc", "line_no", "line"],
            )

    return rows.mapInArrow(run, "source_id string, extract_id bigint, doc bigint, line_no int, line bigint")


def frequent_lines(df: DataFrame, occurrences: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """PrefixSpan's first level: (source_id, line, support, documents) of the lines that enough documents of their source hold."""
    documents = (
        df.where(F.col("source_id").isNotNull() & (F.length("extracted_text") > 0) & F.col("document_id").isNotNull())
        .select("source_id", F.xxhash64("document_id").alias("doc")).distinct().groupBy("source_id").agg(F.count("*").alias("documents"))
    )
    support = occurrences.where("doc is not null").select("source_id", "line", "doc").distinct().groupBy("source_id", "line").agg(F.count("*").alias("support"))
    support = support.where(F.col("support") >= min_documents)
    return support.join(documents, "source_id").where(F.col("support") / F.col("documents") >= F.lit(min_share)).select("source_id", "line", "support", "documents")


def repeated_lines(df: DataFrame, **thresholds: float) -> DataFrame:
    """(source_id, extract_id, line_no, line, support) of each occurrence of a frequent line."""
    occurrences = stage(line_occurrences(df), "lines")
    frequent = frequent_lines(df, occurrences, **thresholds)
    return occurrences.join(frequent.select("source_id", "line", "support"), ["source_id", "line"]).select("source_id", "extract_id", "line_no", "line", "support")


def frequent_sequences(df: DataFrame, max_length: int | None = None, closed: bool = True, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """PrefixSpan: (source_id, pattern array<bigint>, length, support) of the frequent line sequences, of up to max_length lines if that is given.

    Each level keeps, for each row and pattern, the earliest end of the pattern in the row's sequence (its projection) and
    appends every later item; patterns without enough distinct documents are dropped before the next level. Sequences hold
    frequent lines only, so they are as short as the shared part of a page.

    With `closed`, every frequent sequence is part of one in the result that stands in the same rows, and most that are not told apart by their rows are left out: if all rows of
    a pattern go on with the same item, the pattern itself is not in the result, and it is not grown by items that always come after that one. A footer of n lines
    that stand together costs n levels, not 2^n sequences.
    """
    occurrences = stage(line_occurrences(df), "lines")
    frequent = stage(frequent_lines(df, occurrences, min_documents, min_share), "frequent")
    need = F.greatest(F.lit(min_documents), F.ceil(F.col("documents") * F.lit(min_share) - F.lit(1e-9)))
    needs = frequent.groupBy("source_id").agg(F.first("documents").alias("documents")).select("source_id", need.alias("need"))
    rows = occurrences.where("doc is not null").join(frequent.select("source_id", "line"), ["source_id", "line"])
    rows = rows.groupBy("source_id", "doc", "extract_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("items"))
    level = stage(rows.select("source_id", "doc", "extract_id", "items", F.array().cast("array<bigint>").alias("pattern"), F.lit(0).alias("end")), "level0")
    known = found = None
    of, key = ["source_id", "pattern"], ["source_id", "pattern", "item"]
    for length in itertools.count(1):
        rest = level.withColumn("tail", F.slice("items", F.col("end") + 1, F.greatest(F.size("items") - F.col("end"), F.lit(0))))
        later = F.transform(F.array_distinct("tail"), lambda x: F.struct(x.alias("item"), F.array_position("tail", x).alias("at")))
        grown = rest.withColumn("x", F.explode(later)).select("*", "x.item", "x.at").drop("x")
        if closed:
            whole = level.groupBy(*of).agg(F.count("*").alias("rows"))
            per_item = grown.groupBy(*key).agg(F.count("*").alias("n"), F.sum("at").alias("places"))
            always = stage(per_item.join(whole, of).where("n = rows").groupBy(*of).agg(F.min_by("item", F.struct("places", "item")).alias("next")), f"always{length}")
            if known is not None:
                known = known.join(always, of, "left_anti")
            after = F.coalesce((F.col("item") != F.col("next")) & (F.array_position("tail", F.col("next")) < F.col("at")), F.lit(False))
            grown = grown.join(always, of, "left").withColumn("after", after)
            grown = grown.join(grown.groupBy(*key).agg(F.bool_and("after").alias("gone")).where("not gone").drop("gone"), key, "left_semi")
        if known is not None:
            found = known if found is None else found.unionByName(known)
        counted = grown.select(*key, "doc").distinct().groupBy(*key).agg(F.count("*").alias("support"))
        kept = stage(counted.join(needs, "source_id").where("support >= need").select(*key, "support"), f"patterns{length}")
        known = kept.select("source_id", F.concat("pattern", F.array("item")).alias("pattern"), F.lit(length).alias("length"), "support")
        if length == max_length or kept.isEmpty():
            return known if found is None else found.unionByName(known)
        end = (F.col("end") + F.col("at")).cast("int")
        step = grown.join(kept.select(*key), key, "left_semi")
        level = stage(step.select("source_id", "doc", "extract_id", "items", F.concat("pattern", F.array("item")).alias("pattern"), end.alias("end")), f"level{length}")


def without_repeated_lines(df: DataFrame, **thresholds: float) -> DataFrame:
    """(extract_id, extracted_text, n_removed) of every row of df, without the occurrences of its source's frequent sequences."""
    bound_batches(df.sparkSession)
    gone = repeated_lines(df, **thresholds).groupBy("extract_id").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    lines = F.split("extracted_text", "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    text = F.when(F.col("gone").isNull(), F.col("extracted_text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return df.select("extract_id", "extracted_text").join(gone, "extract_id", "left").select("extract_id", text.alias("extracted_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
