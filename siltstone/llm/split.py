"""Problem 1: cut oversized texts at natural boundaries, with an overlap between consecutive pieces.

Method: recursive bisection. A text of more than `limit` tokens is cut at the strongest boundary near its midpoint; halves
that still exceed `limit - overlap` tokens are cut again; then every piece but the first is prefixed with the last `overlap`
tokens of the piece before it. Joined without their overlaps, the pieces of a text are the text.

Defined results: a null or empty text gives no piece; a text within the limit gives one piece; a text without any boundary
(one long run) is cut between tokens; a single token is never cut. Rows that occur twice give their pieces once; rows without
a chunk_id are kept, told apart by their text. The input's columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import TOKEN, fenced
from siltstone.session import bound_batches, spread

LIMIT, OVERLAP = 400, 50
SENTENCE_END, CLAUSE_END = frozenset(".!?。！？…"), frozenset(",;:、，；：)]}")
SCHEMA = "chunk_id string, piece_no int, n_pieces int, n_tokens int, overlap_tokens int, overlap_chars int, text string"


def fence_spans(text: str) -> list[tuple[int, int]]:
    """Character spans of the fences of a text."""
    if "```" not in text and "~~~" not in text:
        return []
    spans, at, was = [], 0, False
    for _, line, inside in fenced(text.split("\n")):
        if inside and was:
            spans[-1][1] = at + len(line)
        elif inside:
            spans.append([at, at + len(line)])
        was, at = inside, at + len(line) + 1
    return [(a, b) for a, b in spans]


def strengths(text: str, starts: list[int], ends: list[int]) -> list[int]:
    """How natural a cut before each token is: 0 inside a word run .. 7 before a heading."""
    spans = fence_spans(text)
    out, k = [0] * len(starts), 0
    for i in range(1, len(starts)):
        a, b = ends[i - 1], starts[i]
        before = text[a - 1]
        if a == b:
            out[i] = 3 if before in "。！？" else 1 if before in "、，；：" else 0
            continue
        newlines = text.count("\n", a, b)
        while k < len(spans) and spans[k][1] < b:
            k += 1
        if k < len(spans) and spans[k][0] < b:
            out[i] = 3 if newlines > 1 else 2 if newlines else 0
        elif newlines > 1:
            out[i] = 7 if text[b] == "#" else 6
        elif newlines:
            out[i] = 6 if text[b] == "#" else 5
        else:
            out[i] = 4 if before in SENTENCE_END else 2 if before in CLAUSE_END else 1
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(tokens, tokens of overlap, characters of overlap, text) of each piece of a text, in order."""
    starts, ends = [], []
    for m in TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    if n <= limit:
        return [(n, 0, 0, text)] if text else []
    strong, cap, cuts, todo = strengths(text, starts, ends), limit - overlap, [0], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= cap:
            cuts.append(hi)
            continue
        # not too near the ends: a piece holds at least the overlap that the next one repeats
        margin, middle = max(1, (hi - lo) // 4, min(overlap, (hi - lo - 1) // 2)), (lo + hi) / 2
        cut = max(range(lo + margin, hi - margin + 1), key=lambda i: (strong[i], -abs(i - middle)))
        todo += [(cut, hi), (lo, cut)]
    at = [0, *(starts[c] for c in cuts[1:-1]), len(text)]
    out = []
    for j, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        back = min(overlap, lo)
        begin = starts[lo - back] if back else at[j]
        out.append((hi - lo + back, back, at[j] - begin, text[begin : at[j + 1]]))
    return out


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = True) -> DataFrame:
    """The pieces of every text of df(chunk_id, primary_text, text) over the limit; with only_long false, of every text.

    Whatever token_count says, tokens are counted here. No token is longer than its characters, so texts of at most `limit`
    characters are set aside inside the scan stage, before any text reaches Python.
    """
    bound_batches(df.sparkSession)
    texts = df.select("chunk_id", F.coalesce("primary_text", "text").alias("whole"))
    texts = texts.withColumn("sum", F.xxhash64("whole"))
    texts = texts.where(F.length("whole") > limit) if only_long else texts.where(F.length("whole") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, whole, own in zip(*(c.to_pylist() for c in batch.columns)):
                cut = pieces(whole, limit, overlap)
                if len(cut) > 1 or not only_long:
                    rows += [(key, i, len(cut), *x, own) for i, x in enumerate(cut)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, (pa.string(), *[pa.int32()] * 5, pa.string(), pa.int64()))],
                names=["chunk_id", "piece_no", "n_pieces", "n_tokens", "overlap_tokens", "overlap_chars", "text", "sum"],
            )

    return spread(texts).mapInArrow(run, SCHEMA + ", sum bigint").dropDuplicates(["chunk_id", "piece_no", "sum"]).drop("sum")
