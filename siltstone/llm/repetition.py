"""Problem 10: repetition inside a single document.

Method: n-gram perplexity under modified Kneser-Ney models, counted by Spark and stored as sorted arrays of sequence hashes.

* `perplexities`: the model of each language over the whole corpus, of order three; the perplexity of every document under it, and per
  language a lower and an upper band (quantiles of the log perplexity) outside which a document is rejected. Counts are taken over all documents and every sequence has its
  own probability. Up to 1 / CUT words every executor holds the whole model as sorted arrays (`scored_held`). Beyond that no process holds it (`scored_apart`): each part of the sequences asks
  the parts of the pairs of words for the lower order and answers the blocks of documents that its counts came from, all in sorted arrays. Both give the same results.
* `train`: a model to hold in one process, also with a cut: then it keeps the sequences, contexts and words whose share of all counts is that or more, the others get the probability of the
  lower order times the mass that their context leaves to it, so probabilities still add up to one. `perplexities` takes it only where nothing is left out.
* `repeated_share`: the share of the sequences of a document, by position, that have already stood earlier in its text, from its own sorted array of sequence hashes.
  `p10_found` takes its rows by this share, not by a model.

The bands of the corpus model cannot give the required result: a text may repeat itself and yet consist of rare words, and a text that
repeats nothing may consist of sequences that other documents hold (figures in the README). They are reported beside the share.

Defined results: null and empty texts and texts of fewer than n words have no sequences, share 0 and no perplexity, and are in no case list.
Languages are compared in lower case; a null language is 'und'. Rows with the same doc_id come out one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.words import DIGITS, WORD_CJK, WordHash, shingles
from siltstone.session import bound_batches, spread, stage

WORDS, SHARE, LOW, HIGH, CUT = 5, 0.3, 0.02, 0.98, 5e-7
#: Documents whose sequences are merged in one task, sequences that a task holds before it sends them, and documents.
MERGED, BUFFER, DOCUMENTS = 20_000, 1_500_000, 100_000
#: Share of a language's documents on either side of an estimated quantile among which the exact one is looked for: ten times the error of the estimate.
NEAR = 1e-3
PACKED = "part int, block bigint, lang int, n int, blob binary"
READ = f"{PACKED}, ids binary, doc_ids array<bigint>, names array<string>, words array<int>"
COUNTED = f"{PACKED}, total double, n1 bigint, n2 bigint, n3 bigint, n4 bigint, steps binary"


def word_hashes(text: str | None, known: WordHash) -> np.ndarray:
    """Hashes of a text's words: lower case, every run of digits alike, each Chinese or Japanese character a word."""
    return np.array([known[w] for w in WORD_CJK.findall(DIGITS.sub("0", text.lower()))], np.uint64) if text else np.zeros(0, np.uint64)


def repeated_share(df: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, lang, n_words, n_sequences, repeated_share) of every row of df(doc_id, lang, text)."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                h = word_hashes(text, known)
                s = np.sort(shingles(h, words))
                again = int((s[1:] == s[:-1]).sum())
                rows.append((len(h), len(s), again / len(s) if len(s) else 0.0))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64())))], names=["doc_id", "lang", "n_words", "n_sequences", "repeated_share"])

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), language().alias("lang"), "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, lang string, n_words int, n_sequences int, repeated_share double")


def language() -> Column:
    return F.coalesce(F.lower(F.trim("lang")), F.lit("und"))


def opened(text: str | None, lang: int, known: WordHash) -> np.ndarray:
    """The hashes of a text's words behind two start marks. Every hash holds the language, so models never mix. Empty for a text without words."""
    h = word_hashes(text, known)
    return np.concatenate([np.array([1, 1], np.uint64), h]) ^ np.uint64(lang & 0xFFFFFFFF) if len(h) else h


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 8-byte numbers, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.stack([c.view(np.uint64) for c in columns]).tobytes())


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint64).reshape(-1, n)


def dealing(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the order of some keys by part and key, where each part begins and ends in it)."""
    to = (key >> np.uint64(32)) % np.uint64(parts)
    order = np.lexsort((key, to))
    return order, np.searchsorted(to[order], np.arange(parts + 1).astype(np.uint64))


def dealt(lang: int, parts: int, key: np.ndarray, *columns: np.ndarray, block: int = 0) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(part, block, lang, n, blob): the rows of some columns by the part of their key, sorted by it."""
    order, ends = dealing(key, parts)
    for p in np.flatnonzero(np.diff(ends)):
        rows = order[ends[p] : ends[p + 1]]
        yield int(p), block, lang, len(rows), pack(*(c[rows] for c in columns))


def packed_rows(rows: pa.Table | pa.RecordBatch) -> Iterator[tuple[int, int, int, int, bytes]]:
    return zip(*(rows.column(c).to_pylist() for c in ("part", "block", "lang", "n", "blob")))


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema.types)], schema=schema)


PACKED_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("lang", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
READ_ARROW = pa.schema([*PACKED_ARROW, ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("names", pa.list_(pa.string())), ("words", pa.list_(pa.int32()))])
COUNTED_ARROW = pa.schema([*PACKED_ARROW, ("total", pa.float64()), *((f"n{i}", pa.int64()) for i in (1, 2, 3, 4)), ("steps", pa.binary())])
ENDS_ARROW = pa.schema([*PACKED_ARROW, ("words", pa.int64())])
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("nats", pa.float64())])
SCORED = "doc_id bigint, lang string, n_words bigint, nats double"


def merged(packed: DataFrame, asked: bool = False) -> DataFrame:
    """Per part and language one row: the sorted array of its sequences with their added counts, and how many are counted 1, 2, 3 and 4 times.

    packed holds (context, middle or first word, last word, count); a sequence is its context and its last word, and all sequences of a context lie in one part.
    With asked there is also a row for each row of packed, without counts: `steps` leads from each of its sequences to the next in the sorted array.
    """

    def merge(rows: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for _, block, lang, n, blob in packed_rows(rows):
            by.setdefault(lang, []).append((block, unpack(blob, n)))
        out, part = [], rows.column("part")[0].as_py()
        for lang, found in by.items():
            context, first, last, n = np.concatenate([x for _, x in found], axis=1)
            _, at, of = np.unique(follow(context, last), return_index=True, return_inverse=True)
            c = np.bincount(of, weights=n).astype(np.uint64)
            order = np.argsort(context[at], kind="stable")
            at, c = at[order], c[order]
            out.append((part, None, lang, len(at), pack(context[at], first[at], last[at], c), float(c.sum()), *(int((c == i).sum()) for i in (1, 2, 3, 4)), None))
            if asked:
                places = placed(order)[of]
                for (block, x), ids in zip(found, np.split(places, np.cumsum([x.shape[1] for _, x in found])[:-1])):
                    out.append((part, block, lang, x.shape[1], *[None] * 6, squeeze(np.diff(ids, prepend=np.uint32(0)))))
        return pa.Table.from_batches([batch_of(out, COUNTED_ARROW)])

    return packed.groupBy("part").applyInArrow(merge, COUNTED)


def placed(order: np.ndarray) -> np.ndarray:
    """The place of each row in an order."""
    out = np.empty(len(order), np.uint32)
    out[order] = np.arange(len(order), dtype=np.uint32)
    return out


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers of 4 bytes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)


def follow(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of each context followed by a word."""
    out = (context ^ (word * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(29))


def read_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """The three-word sequences of rows(doc_id, name, lang, text), by block: the documents of a language that a task reads before it sends them. A sequence costs an entry per
    block, not per document. For each part a row with the block's sequences and their counts, and one without part: its documents, and the place of each of their
    sequences among those of the block by part."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, docs = WordHash(), {}, 0, 0
        block = TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal block
            out = []
            for lang, found in held.items():
                block += 1
                doc_ids, names, hashes = zip(*found)
                ids, texts = None, [h for h in hashes if len(h)]
                if texts:
                    u, v, w = (np.concatenate([h[i : len(h) - 2 + i] for h in texts]) for i in (0, 1, 2))
                    uv = follow(u, v)
                    _, first, of, n = np.unique(follow(uv, w), return_index=True, return_inverse=True, return_counts=True)
                    out += [(*r, *[None] * 4) for r in dealt(lang, parts, uv[first], uv[first], v[first], w[first], n.astype(np.uint64), block=block)]
                    ids = squeeze(placed(dealing(uv[first], parts)[0])[of])
                out.append((None, block, lang, len(found), None, ids, doc_ids, names, [max(len(h) - 2, 0) for h in hashes]))
            held.clear()
            return batch_of(out, READ_ARROW)

        for batch in batches:
            for doc_id, name, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = opened(text, lang, known)
                held.setdefault(lang, []).append((doc_id, name, h))
                size, docs = size + len(h), docs + 1
            if size > BUFFER or docs > DOCUMENTS:
                yield flush()
                size = docs = 0
        yield flush()

    return rows.select("doc_id", "name", "lang", "text").mapInArrow(read, READ)


def counted_blocks(read: DataFrame) -> DataFrame:
    return merged(read.where("part is not null").select("part", "block", "lang", "n", "blob"), True)


def sequences(counted: DataFrame) -> DataFrame:
    """(part, lang, n, blob) of merged rows."""
    return counted.where("blob is not null").select("part", "lang", "n", "blob")


def two_word_counts(three: DataFrame, parts: int) -> DataFrame:
    """The two-word sequences, counted by the different words before them (continuations)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, n, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                _, v, w, _ = unpack(blob, n)
                _, first, c = np.unique(follow(v, w), return_index=True, return_counts=True)
                out += dealt(lang, parts, v[first], v[first], v[first], w[first], c.astype(np.uint64))
            yield batch_of(out, PACKED_ARROW)

    return merged(sequences(three).mapInArrow(count, PACKED))


def discounts(counted: DataFrame) -> tuple[dict[int, np.ndarray], float]:
    """The modified Kneser-Ney discounts of each language, from the numbers of sequences counted 1, 2, 3 and 4 times, and the sum of all counts."""
    out, total = {}, 0.0
    for lang, t, *n in counted.groupBy("lang").agg(F.sum("total"), *(F.sum(f"n{i}") for i in (1, 2, 3, 4))).collect():
        y = n[0] / max(n[0] + 2 * n[1], 1)
        total += t
        out[lang] = np.array([0.0, *(min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] and n[0] else 0.5 * i for i in (1, 2, 3))])
    return out, total


class Sorted:
    """Numbers by hash, in a sorted array."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float64)

    def get(self, keys: np.ndarray, missing: np.ndarray | float) -> np.ndarray:
        if not len(self.keys):
            return np.broadcast_to(missing, keys.shape)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


class Model:
    """The sorted arrays of the orders: probabilities of the kept sequences, and the mass that kept contexts leave to the lower order."""

    def __init__(self, one: Sorted, unknown: dict[int, float]) -> None:
        self.one, self.unknown, self.two, self.three = one, unknown, None, None

    def lower(self, v: np.ndarray, w: np.ndarray, lang: int) -> np.ndarray:
        """The probability of a word, given the one before if that order is there."""
        p = self.one.get(w, self.unknown[lang])
        if self.two is None:
            return p
        known, mass = self.two
        return known.get(follow(v, w), mass.get(v, 1.0) * p)

    def log_probabilities(self, texts: list[np.ndarray], lang: int) -> np.ndarray:
        """Of each word of texts opened by two start marks, one text after the other; equal sequences are looked up once."""
        u, v, w = (np.concatenate([h[i : len(h) - 2 + i] for h in texts]) for i in (0, 1, 2))
        uv = follow(u, v)
        g, first, of = np.unique(follow(uv, w), return_index=True, return_inverse=True)
        known, mass = self.three
        p = known.get(g, -1.0)
        rest = first[p < 0]
        p = np.array(p)
        p[p < 0] = mass.get(uv[rest], 1.0) * self.lower(v[rest], w[rest], lang)
        return np.log(p)[of]


def kept_arrays(counted: DataFrame, model: Model, least: float, cuts: dict[int, np.ndarray]) -> tuple[Sorted, Sorted]:
    """(probabilities of the kept sequences, masses of the kept contexts) of an order, interpolated with the order below, which the model holds."""
    sent = counted.sparkSession.sparkContext.broadcast((model, cuts))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cuts = sent.value
        for batch in batches:
            keys, values, kinds = [np.zeros(0, np.uint64)], [np.zeros(0)], [np.zeros(0, bool)]
            for lang, n, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                context, first, last, c = unpack(blob, n)
                names, at, of = np.unique(context, return_index=True, return_inverse=True)
                whole = np.bincount(of, weights=c)
                kept = c >= least
                own = np.maximum(c - cuts[lang][np.minimum(c, 3).astype(np.int64)], 0.0) * kept / whole[of]
                mass = 1 - np.bincount(of, weights=own)
                some = np.flatnonzero(kept)
                p = own[some] + mass[of[some]] * model.lower(first[some], last[some], lang)
                frequent = whole >= least
                keys += [follow(context[some], last[some]), names[frequent]]
                values += [p, mass[frequent]]
                kinds += [np.ones(len(some), bool), np.zeros(int(frequent.sum()), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(values)), pa.array(np.concatenate(kinds))], names=["key", "value", "is_sequence"])

    found = sequences(counted).mapInArrow(keep, "key bigint, value double, is_sequence boolean").toArrow()
    keys, values, kinds = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy(), found.column(2).to_numpy()
    return Sorted(keys[kinds], values[kinds]), Sorted(keys[~kinds], values[~kinds])


def parts_of(rows: DataFrame) -> int:
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / MERGED))


def train(rows: DataFrame, cut: float = CUT) -> Model:
    """The model of rows(lang, text). What comes to the driver is one row per language and the kept entries, at most 1 / cut sequences and contexts of an order."""
    parts = parts_of(rows)
    three = stage(counted_blocks(read_blocks(rows.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("").alias("name"), "lang", "text"), parts)), "three")
    return fitted(three, stage(two_word_counts(three, parts), "two"), cut)


def fitted(three: DataFrame, two: DataFrame, cut: float) -> Model:
    """The model of counted sequences, in this process."""

    def continued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, n, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                words, c = np.unique(unpack(blob, n)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), lang, np.int32)), pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "w", "n"])

    # order one, smoothed with the uniform distribution over the language's words and one unknown
    ones = stage(sequences(two).mapInArrow(continued, "lang int, w bigint, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n")), "one")
    whole = {lang: (float(total), words) for lang, total, words in ones.groupBy("lang").agg(F.sum("n"), F.count("*")).collect()}
    cuts2, total2 = discounts(two)
    cuts3, total3 = discounts(three)
    kept = ones.where(F.col("n") >= cut * total2).toArrow()
    langs, n = kept.column("lang").to_numpy(), kept.column("n").to_numpy()
    total, words = (np.array([whole[x][i] for x in langs.tolist()]) for i in (0, 1))
    model = Model(Sorted(kept.column("w").to_numpy().view(np.uint64), (n + 1 / (words + 1)) / (total + 1)), {lang: 1 / (words + 1) / (total + 1) for lang, (total, words) in whole.items()})
    model.two = kept_arrays(two, model, cut * total2, cuts2)
    model.three = kept_arrays(three, model, cut * total3, cuts3)
    return model


def scored_held(rows: DataFrame, three: DataFrame, two: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, nats) of rows(doc_id, name, lang, text) by the whole model, which every executor holds."""
    sent = rows.sparkSession.sparkContext.broadcast(fitted(three, two, 0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, WordHash()
        for batch in batches:
            ns, nats, by = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, np.nan), {}
            for i, (lang, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                h = opened(text, lang, known)
                if len(h):
                    by.setdefault(lang, []).append((i, h))
            for lang, texts in by.items():
                at, texts = zip(*texts)
                at, n = list(at), np.array([len(h) - 2 for h in texts])
                ns[at] = n
                nats[at] = -np.add.reduceat(model.log_probabilities(list(texts), lang), np.cumsum(n) - n) / n
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns), pa.array(nats, mask=ns == 0)], schema=SCORED_ARROW)

    return rows.select("doc_id", "name", "lang", "text").mapInArrow(score, SCORED)


def shares(context: np.ndarray, c: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own share, mass that the context leaves to the lower order) of the sequences of sorted contexts. The mass comes from numbers of sequences, so no order of adding shows in it."""
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    size = np.diff(begin, append=len(context))
    kind = np.minimum(c, 3).astype(np.int64)
    whole = np.add.reduceat(c.astype(np.float64), begin)
    left = sum(cuts[i] * np.add.reduceat((kind == i).astype(np.float64), begin) for i in (1, 2, 3))
    return np.maximum(c - cuts[kind], 0.0) / np.repeat(whole, size), np.repeat(left / whole, size)


def two_word_probabilities(two: DataFrame, cuts: dict[int, np.ndarray], parts: int) -> DataFrame:
    """(two words, probability) of all two-word sequences, packed by their part. The first order is smoothed with the uniform distribution over the language's words and one unknown."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, n, blob in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                context, first, last, c = unpack(blob, n)
                yield batch_of(list(dealt(lang, parts, last, last, follow(first, last), *shares(context, c, cuts[lang]))), PACKED_ARROW)

    def by_last(rows: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for part, _, lang, n, blob in packed_rows(rows):
            by.setdefault(lang, []).append(unpack(blob, n))
        out = []
        for lang, found in by.items():
            last, vw, share, mass = np.concatenate(found, axis=1)
            words, of, n = np.unique(last, return_inverse=True, return_counts=True)
            out.append((part, 0, lang, len(vw), pack(vw, share, mass, n[of]), len(words)))
        return pa.Table.from_batches([batch_of(out, ENDS_ARROW)])

    ends = stage(sequences(two).mapInArrow(own, PACKED).groupBy("part").applyInArrow(by_last, f"{PACKED}, words bigint"), "ends")
    whole = {lang: (float(total), words) for lang, total, words in ends.groupBy("lang").agg(F.sum("n"), F.sum("words")).collect()}

    def add_lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lang, n, blob in packed_rows(batch):
                vw, share, mass, c = unpack(blob, n)
                total, words = whole[lang]
                p = share.view(np.float64) + mass.view(np.float64) * ((c + 1 / (words + 1)) / (total + 1))
                yield batch_of(list(dealt(lang, parts, vw, vw, p)), PACKED_ARROW)

    return ends.select("part", "block", "lang", "n", "blob").mapInArrow(add_lower, PACKED)


def scored_apart(read: DataFrame, three: DataFrame, two: DataFrame, cuts3: dict[int, np.ndarray], parts: int) -> DataFrame:
    """(doc_id, lang, n_words, nats) of the documents of the blocks, by the whole model, which lies in parts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lang, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                _, first, last, _ = unpack(blob, n)
                vw = np.unique(follow(first, last))
                yield batch_of(list(dealt(lang, parts, vw, vw, block=part)), PACKED_ARROW)

    def answer(known: pa.Table, asked: pa.Table) -> pa.Table:
        by: dict[int, list[np.ndarray]] = {}
        for _, _, lang, n, blob in packed_rows(known):
            by.setdefault(lang, []).append(unpack(blob, n))
        tables, out = {}, []
        for lang, found in by.items():
            vw, p = np.concatenate(found, axis=1)
            order = np.argsort(vw)
            tables[lang] = vw[order], p[order]
        for part, asker, lang, n, blob in packed_rows(asked):
            vw, p = tables[lang]
            out.append((asker, part, lang, n, pack(p[np.searchsorted(vw, unpack(blob, n)[0])])))
        return pa.Table.from_batches([batch_of(out, PACKED_ARROW)])

    def respond(rows: pa.Table, answers: pa.Table) -> pa.Table:
        logs, out = {}, []
        lower = in_order((lang, part, n, blob) for _, part, lang, n, blob in packed_rows(answers))
        for _, _, lang, n, blob in packed_rows(rows.filter(pc.is_valid(rows.column("blob")))):
            context, first, last, c = unpack(blob, n)
            vw, of = np.unique(follow(first, last), return_inverse=True)
            own, mass = shares(context, c, cuts3[lang])
            logs[lang] = np.log(own + mass * lower[lang][placed(dealing(vw, parts)[0])][of])
        asked = rows.filter(pc.is_valid(rows.column("steps")))
        for (part, block, lang, n, _), steps in zip(packed_rows(asked), asked.column("steps").to_pylist()):
            out.append((part, block, lang, n, pack(logs[lang][np.cumsum(unsqueeze(steps), dtype=np.uint32)])))
        return pa.Table.from_batches([batch_of(out, PACKED_ARROW)])

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        logs = in_order((block, part, n, blob) for part, block, _, n, blob in packed_rows(answers))
        out = []
        for block, ids, doc_ids, names, words in zip(*(docs.column(c).to_pylist() for c in ("block", "ids", "doc_ids", "names", "words"))):
            n = np.array(words, np.int64)
            nats, some = np.full(len(n), np.nan), n > 0
            if ids is not None:
                nats[some] = -np.add.reduceat(logs[block][unsqueeze(ids)], np.cumsum(n[some]) - n[some]) / n[some]
            out.append(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(names, pa.string()), pa.array(n), pa.array(nats, mask=~some)], schema=SCORED_ARROW))
        return pa.Table.from_batches(out, SCORED_ARROW)

    asked = sequences(three).mapInArrow(ask, PACKED)
    two_known = two_word_probabilities(two, discounts(two)[0], parts)
    lower = two_known.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(answer, PACKED)
    own = three.select("part", "block", "lang", "n", "blob", "steps")
    found = own.groupBy("part").cogroup(lower.groupBy("part")).applyInArrow(respond, PACKED)
    docs = read.where("part is null").select("block", "ids", "doc_ids", "names", "words")
    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, SCORED)


def in_order(rows: Iterable[tuple[int, int, int, bytes]]) -> dict[int, np.ndarray]:
    """The packed numbers of rows (name, part, n, blob) by name, one part after the other."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {}
    for name, part, n, blob in rows:
        by.setdefault(name, []).append((part, unpack(blob, n)[0].view(np.float64)))
    return {name: np.concatenate([x for _, x in sorted(found, key=lambda f: f[0])]) for name, found in by.items()}


def bands(scored: DataFrame, low: float, high: float) -> DataFrame:
    """(lang, lo, hi): two quantiles of the nats of each language. An estimate leaves the few documents near them, among which the exact ones are counted out."""
    around = [min(max(q + d, 0.0), 1.0) for q in (low, high) for d in (-NEAR, NEAR)]
    edges = scored.groupBy("lang").agg(F.count("nats").alias("n"), F.percentile_approx("nats", around, 10000).alias("e"))
    sides = F.explode(F.array(*(
        F.struct(
            F.lit(i).alias("side"), F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.col("n") * q)).alias("rank"),
            F.col("e")[2 * i].alias("begin") if q > NEAR else F.lit(-math.inf).alias("begin"), F.col("e")[2 * i + 1].alias("end") if q < 1 - NEAR else F.lit(math.inf).alias("end"),
        ) for i, q in enumerate((low, high))
    )))
    near = scored.where("nats is not null").join(F.broadcast(edges.select("lang", sides.alias("s")).select("lang", "s.*")), "lang").where("nats <= end")
    counts = near.groupBy("lang", "side", "rank", F.when(F.col("nats") >= F.col("begin"), F.col("nats")).alias("nats")).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("lang", "side").orderBy(F.col("nats").asc_nulls_first())))
    found = upto.where("nats is not null and upto >= rank").groupBy("lang").agg(*(F.min(F.when(F.col("side") == i, F.col("nats"))).alias(x) for i, x in enumerate(("lo", "hi"))))
    return edges.select("lang").join(F.broadcast(found), "lang", "left")  # one row per language


def perplexities(df: DataFrame, low: float = LOW, high: float = HIGH, cut: float = CUT) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, low, high, rejected) of every row of df(doc_id, lang, text).

    low and high are the language's bands: the quantiles of the log perplexity of its documents. Up to 1 / cut words the model is held by every executor, beyond that it lies
    in parts; no sequence is left out of it.
    """
    bound_batches(df.sparkSession)
    rows = spread(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), language().alias("name"), F.hash(language()).alias("lang"), "text"))
    parts = parts_of(rows)
    read = stage(read_blocks(rows, parts), "read")
    three = stage(counted_blocks(read), "three")
    two = stage(two_word_counts(three, parts), "two")
    cuts3, total3 = discounts(three)
    whole = stage(scored_held(rows, three, two) if total3 * cut <= 1 else scored_apart(read, three, two, cuts3, parts), "scored")
    out = whole.join(F.broadcast(bands(whole, low, high)), "lang")  # one row per language
    return out.select("doc_id", "lang", "n_words", F.exp("nats").alias("perplexity"), F.exp("lo").alias("low"), F.exp("hi").alias("high"), F.coalesce((F.col("nats") < F.col("lo")) | (F.col("nats") > F.col("hi")), F.lit(False)).alias("rejected"))
