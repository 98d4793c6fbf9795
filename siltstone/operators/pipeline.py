"""Whole pipelines: pages to points, and questions to answers. Models are parameters: column functions for embedding and answering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from siltstone.functions import http
from siltstone.functions import text as T
from siltstone.operators import chunking, html_extract, index, retrieval

DIM = 384


def hash_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """A deterministic stand-in for a model: a text's words hashed into `dim` signed buckets, at length 1. Batches go through one worker-wide state, as a model would."""

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for w in T.re.findall(r"\w+", (t or "").lower()):
                    h = xxhash.xxh3_64_intdigest(w)
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.Series(out)

    return embed


def pages_to_chunks(pages: DataFrame, sources: DataFrame, known: DataFrame) -> DataFrame:
    """Chunks of the pages whose extraction is new: pages(record_id, source_id, canonical_url, body), sources(source_id, display_name), known(document_id, indexed_sha256).

    Unchanged pages are dropped by an anti-join before they are cut.
    """
    good = html_extract.extract_pages(pages).where("reason = 'ok'").join(sources.select("source_id", "display_name"), "source_id")
    fresh = good.join(known.select("document_id", F.col("indexed_sha256").alias("extracted_sha256")), ["document_id", "extracted_sha256"], "left_anti")
    titled = fresh.withColumn("title", T.document_title(F.col("extracted_text"), T.page_title(F.col("raw_title"), F.col("display_name"))))
    return chunking.chunk_documents(titled.select("document_id", "source_id", "display_name", "canonical_url", "title", "extracted_text", "extracted_sha256"))


def refresh_index(points: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column], run_id: str, model: str, created_at) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(points after the run, per-document counts): new chunks are upserted, points of their documents that no chunk has any more are deactivated."""
    new = index.points_from_chunks(chunks, embed, run_id, model, created_at)
    touched = new.select("document_id").distinct()
    old = points.select(*new.columns)
    replaced = old.join(new.select("point_id"), "point_id", "left_anti").join(touched.withColumn("_touched", F.lit(True)), "document_id", "left")
    kept = replaced.withColumn("_was", F.col("is_active")).withColumn("is_active", F.col("is_active") & F.col("_touched").isNull())
    counts = kept.where("_was and not is_active").groupBy("document_id").agg(F.count("*").alias("deactivated")).join(new.groupBy("document_id").agg(F.count("*").alias("upserted")), "document_id", "full_outer").fillna(0)
    return kept.select(*new.columns).unionByName(new), counts


def answers(requests: DataFrame, hits: DataFrame, answer: Callable[[Column, Column], Column]) -> DataFrame:
    """One response per row of requests(request_id, query, top_k, score_threshold, max_chunks, token_budget) from hits(request_id, rank, score, chunk_id, source_id, document_id, canonical_url, title, breadcrumb, text).

    Invalid requests and empty contexts are answered without calling the model; errors are values. hits holds at least the 100 best of each request.
    """
    c = F.col
    error = retrieval.request_error(c("query"), c("top_k"), c("score_threshold"), c("max_chunks"), c("token_budget"))
    asked = requests.withColumn("error_type", error)
    order = [F.desc("score"), c("source_id"), c("document_id"), c("chunk_id")]
    fit = hits.join(asked.where("error_type is null").select("request_id", "top_k", "score_threshold"), "request_id").where("rank <= top_k and score >= score_threshold")
    once = retrieval.without_redundant(retrieval.first_of(fit, ["request_id", "chunk_id"], order), "request_id", order)
    fields = ["chunk_id", "canonical_url", "title", "source_id", "breadcrumb", "text"]
    ordered = once.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-c("score")).alias("far"), "source_id", "document_id", "chunk_id", "canonical_url", "title", "breadcrumb", "text", T.count_tokens(c("text")).alias("tokens")))).alias("hits"))
    both = asked.join(ordered, "request_id", "left").withColumn("hits", F.coalesce("hits", F.filter(F.array(F.lit(None).cast(ordered.schema["hits"].dataType.elementType)), lambda x: x.isNotNull())))
    packed = both.withColumn("kept", pack(c("hits"), c("max_chunks"), c("token_budget")))
    context = F.transform(F.filter("hits", lambda h: F.array_contains(c("kept.kept"), h["chunk_id"])), lambda h: F.struct(*(h[f].alias(f) for f in fields)))
    ready = packed.withColumn("context", context).withColumn("empty", F.size("context") == 0)
    text = F.when(c("error_type").isNull() & ~c("empty"), answer(T.user_prompt(c("query"), c("context")), c("context")))
    said = ready.withColumn("answer", text)
    cited, fabricated = retrieval.citations(F.coalesce("answer", F.lit("")), F.transform("context", lambda x: x["canonical_url"]))
    out = said.select("request_id", "error_type", c("empty").alias("context_was_empty"), "answer", cited.alias("citations"), fabricated.alias("n_fabricated"), c("kept.total").alias("context_tokens"), F.size("context").alias("n_chunks"), F.size("kept.truncated").alias("n_truncated"))
    return out.withColumn("response", F.to_json(F.struct(c("error_type").isNull().alias("ok"), "error_type", "answer", "citations", "context_tokens")))


def pack(hits: Column, max_chunks: Column, budget: Column) -> Column:
    """retrieval.pack_context with limits per row; invalid limits count as 1."""
    return retrieval.pack_context(F.transform(hits, lambda h: F.struct(h["chunk_id"].alias("chunk_id"), h["tokens"].alias("tokens"))), F.greatest(F.coalesce(max_chunks, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(budget, F.lit(1)), F.lit(1)))


def log_rows(results: DataFrame, fields: list[str]) -> DataFrame:
    """(log) one JSON text per result, of the named fields without those that may hold secrets."""
    return results.select(F.to_json(F.struct(*(f for f in fields if f.lower() not in http.SECRET_FIELDS))).alias("log"))
