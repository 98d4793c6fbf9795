"""Retrieval: filtered vector top-k in blocks, threshold, total order, deduplication, context packing, citations and quality measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import text as T
from siltstone.functions.vectors import norm

BLOCK = 2048


def blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK, group: str | None = None) -> DataFrame:
    """(g, ids, vectors): the rows of each task in blocks, by `group` if one is given, vectors as the bytes of float64 at length 1. Vectors of length 0 and nulls are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for g, own in part.groupby("g", dropna=False):
                for at in range(0, len(own), size):
                    rows = own.iloc[at : at + size]
                    x = np.stack(rows["v"].to_numpy()).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    yield pd.DataFrame({"g": [g if group else ""], "ids": [rows["id"].to_numpy()], "vectors": [x.tobytes()]})

    name = F.col(group).cast("string") if group else F.lit("")
    usable = df.where(F.col(key).isNotNull() & (F.size(vector) > 0) & name.isNotNull()).select(name.alias("g"), F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where(norm(F.col("v")) > 0)
    return usable.mapInPandas(run, "g string, ids array<bigint>, vectors binary")


def search(queries: DataFrame, points: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", digits: int = 6, group: str | None = None) -> DataFrame:
    """(query_id, point_id, score, rank): the k points of greatest cosine for each query, ties by the smaller id. With `group`, only points of the query's own group.

    A stated query set against all points, block by block: a task multiplies one block of points with one block of queries and keeps the k best of each
    query, so what is shuffled is k rows per query and block, whatever the sizes.
    """
    mine = blocks(queries, key, vector, group=group).select("g", F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    pairs = blocks(points, key, vector, group=group).join(mine, "g") if group else blocks(points, key, vector).drop("g").crossJoin(mine.drop("g"))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, vectors, qids, qvectors in part[["ids", "vectors", "qids", "qvectors"]].itertuples(index=False):
                x, q = (np.frombuffer(v, np.float64).reshape(len(i), -1) for v, i in ((vectors, ids), (qvectors, qids)))
                if x.shape[1] != q.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and {q.shape[1]} numbers")
                ids, qids = np.asarray(ids), np.asarray(qids)
                sims = np.round(q @ x.T, digits)
                least = np.partition(sims, -k, axis=1)[:, -k] if k < sims.shape[1] else np.full(len(sims), -np.inf)
                row, col = np.nonzero(sims >= least[:, None])  # k of each query, and those that tie with its last
                order = np.lexsort((ids[col], -sims[row, col], row))
                row, col = row[order], col[order]
                first = np.searchsorted(row, np.arange(len(sims)))
                keep = np.arange(len(row)) - first[row] < k
                row, col = row[keep], col[keep]
                yield pd.DataFrame({"query_id": qids[row], "point_id": ids[col], "score": sims[row, col]})

    scored = pairs.mapInPandas(score, "query_id bigint, point_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_of(df: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    """The first row of each group of equal keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)


def with_defaults(hits: DataFrame) -> DataFrame:
    """hits with what absent fields of a point's payload count as: empty texts and lists, position 0, the point's id for its chunk's."""
    empty = {c: F.coalesce(F.col(c), F.lit("")) for c in ("source_id", "document_id", "canonical_url", "title", "breadcrumb", "text")}
    more = {"chunk_id": F.coalesce("chunk_id", "point_id"), "headings": F.coalesce("headings", F.array().cast("array<string>")), "chunk_index": F.coalesce("chunk_index", F.lit(0))}
    return hits.withColumns({c: v for c, v in {**empty, **more}.items() if c in hits.columns})


def without_redundant(hits: DataFrame, group: str, order: list[Column], least: int = T.REDUNDANT_CHARS) -> DataFrame:
    """hits(…, source_id, document_id, canonical_url, text) without later ones whose text, in compatible form and `least` characters or longer, a hit of the same page had before."""
    same = hits.withColumn("_form", T.compatible_form("text")).withColumn("_long", F.coalesce(F.length("_form") >= least, F.lit(False)))
    keys = [group, "source_id", "document_id", "canonical_url", F.when(F.col("_long"), F.sha2("_form", 256)), "_long"]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return same.withColumn("_n", n).where(~F.col("_long") | (F.col("_n") == 1)).drop("_form", "_long", "_n")


def pack_context(hits: Column, max_chunks: int, budget: int) -> Column:
    """struct(kept, truncated, total_tokens) of an ordered array of struct(chunk_id, tokens): a hit that would go over the budget is skipped, later ones may still fit."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.array().cast("array<string>").alias("truncated"), F.lit(0).cast("bigint").alias("total"))

    def step(state: Column, hit: Column) -> Column:
        tokens = F.coalesce(hit["tokens"].cast("bigint"), F.lit(0).cast("bigint"))
        fits = (F.size(state["kept"]) < max_chunks) & (state["total"] + tokens <= budget)
        ident = F.array(hit["chunk_id"])
        return F.struct(
            F.when(fits, F.concat(state["kept"], ident)).otherwise(state["kept"]).alias("kept"),
            F.when(fits, state["truncated"]).otherwise(F.concat(state["truncated"], ident)).alias("truncated"),
            (state["total"] + F.when(fits, tokens).otherwise(F.lit(0).cast("bigint"))).alias("total"),
        )

    return F.aggregate(hits, start, step)


def citations(answer: Column, known: Column) -> tuple[Column, Column]:
    """(cited, fabricated): the known addresses that an answer mentions, in order, and how many different others it mentions."""
    mentioned = F.array_distinct(F.transform(T.urls_in_text(answer), T.without_trailing_marks))
    return F.filter(mentioned, lambda u: F.array_contains(known, u)), F.size(F.filter(mentioned, lambda u: ~F.array_contains(known, u)))


def quality(ranked: DataFrame, relevant: Column, by: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Recall at each k and mean reciprocal rank of ranked(query_id, rank, <by>), per value of `by` and, where it is null, over all."""
    first = ranked.groupBy("query_id", by).agg(F.min(F.when(relevant, F.col("rank"))).alias("first"))
    measures = [F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}") for k in ks]
    return first.rollup(by).agg(*measures, F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("questions"))


def request_error(query: Column, top_k: Column, threshold: Column, max_chunks: Column, budget: Column) -> Column:
    """The first rule that a retrieval request breaks; null for a valid one."""
    return (
        F.when(query.isNull() | (F.trim(query) == ""), "blank_query").when(F.length(query) > T.MAX_QUERY, "long_query").when(top_k.isNull() | ~top_k.between(1, 100), "top_k")
        .when(threshold.isNull() | ~threshold.between(0.0, 1.0), "score_threshold").when(max_chunks.isNull() | ~max_chunks.between(1, 20), "max_chunks").when(budget.isNull() | ~budget.between(1, 8000), "token_budget")
    )
