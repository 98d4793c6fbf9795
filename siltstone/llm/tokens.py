"""Problem 8: encode the whole corpus with a public byte-level BPE vocabulary.

Method: prefix-sharing trie traversal. The distinct words of a batch are put in byte order, which is the depth-first order of their trie; the path from
the root to the current node is a stack, so the state of a prefix that several words share is computed once. The state of a
prefix is the last token of its encoding. It is the only vocabulary token t such that t ends the prefix and the pair (last token of the
prefix without t, t) is one that the merges would not join differently; an encoding is read off by following last tokens back to the root.

Defined results: a null text and an empty text both give an empty list; strings of special tokens are ordinary text. One row comes out per row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import bound_batches, spread

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: How the vocabulary splits text into words (a fixed value); white space is Unicode's.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+""")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encodes words with a byte-level BPE vocabulary given as its JSON text."""

    KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 150_000, 400_000, 64

    def __init__(self, vocabulary: bytes) -> None:
        model, letters = json.loads(vocabulary)["model"], byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        self.ids = {raw(t): i for t, i in ids.items() if all(c in letters for c in t) and t != "<|endoftext|>"}
        self.length = {i: len(t) for t, i in self.ids.items()}
        self.prefixes = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> (rank of the merge, id)
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.length, -1)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            self.joined.setdefault((x, y), (rank, z))
            if z not in self.parts:
                self.parts[z], self.rank[z] = (x, y), rank
        self.valid: dict[tuple[int, int], bool] = {}
        self.words: dict[str, list[int]] = {}

    def stays(self, a: int, b: int) -> bool:
        """Whether the merges, run over the bytes of a and b together, give just a and b: undo the latest merge on either side of the border step
        by step, and see that no merge across the border would have come before the one undone."""
        known = self.valid.get((a, b))
        if known is not None:
            return known
        if len(self.valid) > self.KEPT_PAIRS:
            self.valid.clear()
        left, right, undone, ok = a, b, float("inf"), True
        while True:
            across = self.joined.get((left, right))
            if across is not None and across[0] < undone:
                ok = False
                break
            lr, rr = self.rank[left], self.rank[right]
            if lr < 0 and rr < 0:
                break
            if lr > rr:
                undone, left = lr, self.parts[left][1]
            else:
                # of equal merges the leftmost comes first, so one across the border may have the rank of the one undone
                undone, right = rr, self.parts[right][0]
                if self.joined.get((left, right), (None,))[0] == undone:
                    ok = False
                    break
        self.valid[(a, b)] = ok
        return ok

    def encode_sorted(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of each of the words, which are in byte order (the depth-first order of their trie)."""
        ids, prefixes, length, stays = self.ids, self.prefixes, self.length, self.stays
        last: list[int] = [-1]  # last token of each prefix on the path
        reach: list[int] = [0]  # longest end of the prefix that begins some token
        before = b""
        for word in words:
            common, most = 0, min(len(word), len(before))
            while common < most and word[common] == before[common]:
                common += 1
            del last[common + 1 :], reach[common + 1 :]
            for end in range(common + 1, len(word) + 1):
                n = reach[end - 1] + 1
                while word[end - n : end] not in prefixes:
                    n -= 1
                reach.append(n)
                while True:
                    t = ids.get(word[end - n : end])
                    if t is not None and (n == end or stays(last[end - n], t)):
                        break
                    n -= 1
                last.append(t)
            before, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= length[last[end]]
            out.reverse()
            yield out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = [SPLIT.findall(t) if t else [] for t in texts]
        if len(self.words) > self.KEPT_WORDS:
            self.words.clear()
        known = self.words
        new = sorted((w.encode("utf-8"), w) for w in {w for ws in split for w in ws if w not in known})
        once = {}
        for (_, w), x in zip(new, self.encode_sorted([b for b, _ in new])):
            (known if len(w) <= self.KEPT_LENGTH else once)[w] = x
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else once[w]
            out.append(ids)
        return out


_encoders: dict[bytes, TrieEncoder] = {}


def encoder(vocabulary: bytes) -> TrieEncoder:
    """One encoder per Python worker and vocabulary."""
    if vocabulary not in _encoders:
        _encoders.clear()
        _encoders[vocabulary] = TrieEncoder(vocabulary)
    return _encoders[vocabulary]


def encode_corpus(df: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, counts: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of df(doc_id, text); with counts, (doc_id, n_tokens) instead.

    The vocabulary (1.5 MB) is read once by the driver and broadcast, so executors need no copy of the file.
    """
    bound_batches(df.sparkSession)
    with open(f"{tokenizers}/{vocabulary}", "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids = own.encode(part.column(1).to_pylist())
                n = np.array([len(x) for x in ids], np.int32)
                if counts:
                    out = pa.array(n)
                else:
                    flat = np.fromiter((i for x in ids for i in x), np.int32, int(n.sum()))
                    out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["doc_id", "n_tokens" if counts else "ids"])

    rows = spread(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens int" if counts else "doc_id bigint, ids array<int>")
