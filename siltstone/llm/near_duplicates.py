"""Problem 7: pages that share most of their text after small edits, insertions or reordering.

Method: size-banded tiles with hashed bitmap signatures. A page is the set of its word sequences ("shingles"). Pages with
equal sets are collapsed to one representative. Two sets of Jaccard similarity t or more share one of the first
|x| - ceil(t |x|) + 1 shingles of any common order, and their sizes differ at most by the factor t. So every set is posted, under each
shingle of that prefix, in the tile (shingle, band of its size), and as a visitor in the next band where its partners may reach into it. Tiles are shuffled
once: residents and visitors are one table, joined with itself.
Within a tile, sizes and prefix positions bound the overlap; then the bit counts of 512-bit signatures bound it from above; what is
left is decided by the exact intersection of the sorted arrays. No link between different sets is lost.

The order of the shingles is by rarity, so tiles stay small: a counting sketch over all pages tells how common a shingle is. It has a fixed
size (at most 2^25 one-byte logarithmic counters, 32 MB) and any sketch gives a valid order, so its collisions cost time, never
results. Shingles it has counted once stand in one page only and are not posted; from some 65,000 pages on the sketch fills, and in tens of millions of
pages it still tells common shingles from rare ones, but hardly any is dropped (figures in the README).

Defined results: of each document only the newest row counts (greatest extracted_at, then extract_id; null times are the oldest), and only
if it is ok. Null texts and texts of fewer than `words` words are in no pair and form a group of their own. Null document_ids are dropped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import WORD, WordHash, shingles
from siltstone.session import bound_batches, spread, stage

WORDS, SIMILARITY, BITS, MAX_SLOTS = 3, 0.7, 512, 1 << 25
CHUNK = 1 << 18
ROWS = "extract_id bigint, document_id string, at timestamp, ok boolean, size int, h1 bigint, h2 bigint, bits binary, shingles array<bigint>, places array<int>"


class ShingleSets:
    """The sorted distinct shingle hashes of texts."""

    def __init__(self, words: int) -> None:
        self.words, self.hash = words, WordHash()

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        h = self.hash
        return np.unique(shingles(np.array([h[w] for w in WORD.findall(text.lower())], np.uint64), self.words))


def count_sketch(df: DataFrame, words: int, slots: int) -> np.ndarray:
    """How common shingles are: per slot 0, 1 for one occurrence, else 1 + 8 log2 of the number of pages counted in it.

    Each task counts into its own array and sends it in compressed chunks, which are added up by chunk.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = ShingleSets(words), np.zeros(slots, np.uint16)
        for batch in batches:
            found = [sets(t) & np.uint64(slots - 1) for t in batch.column(0).to_pylist()]
            which, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            seen[which] = np.minimum(seen[which].astype(np.int64) + n, 65535)
        pack = zstandard.ZstdCompressor(level=1)
        for c in range(0, slots, CHUNK):
            if seen[c : c + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK], pa.int32()), pa.array([pack.compress(seen[c : c + CHUNK].tobytes())], pa.binary())], names=["chunk", "counts"])

    def add(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk, unpack = 0, None, zstandard.ZstdDecompressor()
        for t in tables:
            for c, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
                chunk, total = c, total + np.frombuffer(unpack.decompress(x), np.uint16).astype(np.int64)
        level = np.where(total > 0, 1 + np.rint(8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = spread(df.where("extracted_text is not null").select("extracted_text")).mapInArrow(count, "chunk int, counts binary").groupBy("chunk").applyInArrow(lambda t: pa.Table.from_batches(list(add(iter(t.to_batches())))), "chunk int, counts binary")
    out = np.zeros(slots, np.uint8)
    for c, x in parts.toLocalIterator():
        out[c * CHUNK : c * CHUNK + len(x)] = np.frombuffer(x, np.uint8)
    return out


def signed_pages(df: DataFrame, words: int, t: float, levels: Broadcast, slots: int) -> DataFrame:
    """Per row: size and 128-bit hash of its set, its bitmap signature, and the shingles and places of its prefix that others may share."""
    rows = df.where("document_id is not null").select("extract_id", "document_id", F.col("extracted_at").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"), "extracted_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, level = ShingleSets(words), np.frombuffer(zstandard.ZstdDecompressor().decompress(levels.value), np.uint8)
        for batch in batches:
            out: list[tuple] = []
            for text, ok in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist()):
                s = sets(text) if ok else np.zeros(0, np.uint64)
                n = len(s)
                if not n:
                    out.append((0, 0, 0, None, [], []))
                    continue
                digest = xxhash.xxh3_128(s.tobytes()).digest()
                bits = np.zeros(BITS, np.uint8)
                bits[(s >> np.uint64(40)) % np.uint64(BITS)] = 1
                common = level[s & np.uint64(slots - 1)]
                prefix = np.lexsort((s, common))[: n - math.ceil(t * n - 1e-9) + 1]
                places = np.flatnonzero(common[prefix] > 1)
                out.append((n, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), np.packbits(bits).tobytes(), s[prefix[places]].view(np.int64), places.astype(np.int32)))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(4)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=["extract_id", "document_id", "at", "ok", "size", "h1", "h2", "bits", "shingles", "places"])

    return spread(rows).mapInArrow(run, ROWS)


def similar_sets(df: DataFrame, words: int = WORDS, t: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(links, members) of df(extract_id, document_id, extracted_at, ok, extracted_text).

    links: (a, b, jaccard), a < b, the pairs of representatives with similarity t or more; members: (document_id, rep), the representative (an
    extract_id) of each document whose newest row is ok and has a set, null where it has none.
    """
    spark = df.sparkSession
    bound_batches(spark)
    slots = min(MAX_SLOTS, max(CHUNK, 1 << math.ceil(math.log2(max(1, 512 * df.count())))))
    # compressed: most counters are empty, and a broadcast lies on the disk of every executor
    levels = spark.sparkContext.broadcast(zstandard.ZstdCompressor(level=3).compress(count_sketch(df, words, slots).tobytes()))
    pages = stage(signed_pages(df, words, t, levels, slots), "pages")
    newest = pages.groupBy("document_id").agg(F.max(F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "extract_id", "ok", "size", "h1", "h2")).alias("r")).select("document_id", "r.*").where("ok")
    sets = newest.where("size > 0").groupBy("h1", "h2").agg(F.min("extract_id").alias("rep"))
    members = stage(newest.join(sets, ["h1", "h2"], "left").select("document_id", F.when(F.col("size") > 0, F.col("rep")).alias("rep")), "members")

    reps = members.where("rep is not null").select(F.col("rep").alias("extract_id")).distinct()
    own = pages.where("size(shingles) > 0").select("extract_id", "size", "shingles", "places").join(reps, "extract_id", "left_semi")
    wide = 4 * math.log(1 / t)  # a band is so wide that a set reaches at most into the next one, and most sets not even there

    def band(size: str, factor: float = 1.0):  # noqa: ANN202
        return F.floor(F.log(F.col(size) * F.lit(factor)) / F.lit(wide)).cast("int")

    # a row of a tile is three numbers: hash of shingle and band, page, and size, place and visit in one
    posted = own.select("extract_id", "size", F.explode(F.arrays_zip("shingles", "places")).alias("x")).select(F.col("extract_id").alias("id"), "size", F.col("x.shingles").alias("shingle"), F.col("x.places").alias("place"))
    packed = F.shiftleft(F.col("size").cast("bigint"), 32) + F.shiftleft(F.col("place").cast("bigint"), 1)
    next_band = band("size", (1 + 1e-9) / t)
    stay, visit = (F.struct(b.alias("band"), F.lit(v).alias("visit")) for b, v in ((band("size"), 0), (next_band, 1)))
    tiles = posted.withColumn("to", F.explode(F.when(next_band > band("size"), F.array(stay, visit)).otherwise(F.array(stay)))).select(F.xxhash64("shingle", "to.band").alias("tile"), "id", (packed + F.col("to.visit")).alias("w"))
    # unpacked inside the join's condition, so that the packed form is what is shuffled and hot tiles can be split at run time; every part of the condition
    # is on both sides, so that nothing is filtered before the shuffle and both sides read the same one
    (xn, xp), (yn, yp) = ((F.shiftright(f"{c}.w", 32), F.shiftright(F.col(f"{c}.w").bitwiseAND(0xFFFFFFFF), 1)) for c in "xy")
    xi, yi, xv, yv = F.col("x.id"), F.col("y.id"), F.col("x.w").bitwiseAND(1), F.col("y.w").bitwiseAND(1)
    meet = (xv + yv <= 1) & (xv >= yv)  # residents with residents, visitors with residents
    ordered = (xi != yi) & ((xv > yv) | (xn < yn) | ((xn == yn) & (xi < yi)))
    bounded = (xn <= yn) & (xn >= F.lit(t - 1e-9) * yn) & (F.least(xn - xp, yn - yp) >= F.lit(t / (1 + t)) * (xn + yn) - F.lit(1e-6))
    met = tiles.alias("x").join(tiles.alias("y"), (F.col("x.tile") == F.col("y.tile")) & meet & ordered & bounded)
    pairs = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    signs = pages.where("size > 0").select("extract_id", "size", "bits").dropDuplicates(["extract_id"])  # rows may occur twice
    both = pairs.join(signs.select(F.col("extract_id").alias("a"), F.col("size").alias("na"), F.col("bits").alias("ba")), "a").join(signs.select(F.col("extract_id").alias("b"), F.col("size").alias("nb"), F.col("bits").alias("bb")), "b")
    words8 = range(0, BITS // 8, 8)

    def lacking(p: str, q: str):  # noqa: ANN202
        """Bits of p that q lacks: no more than the shingles of p that q lacks."""
        word = lambda c, i: F.conv(F.hex(F.substring(c, i + 1, 8)), 16, -10).cast("bigint")
        return sum((F.bit_count(word(p, i).bitwiseAND(F.bitwise_not(word(q, i)))) for i in words8), F.lit(0))

    most = F.least(F.col("na") - lacking("ba", "bb"), F.col("nb") - lacking("bb", "ba"))
    close = stage(both.where(most >= F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)).select("a", "b"), "close")
    asked = close.select(F.explode(F.array("a", "b")).alias("extract_id")).distinct()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ShingleSets(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], names=["extract_id", "s"])

    exact = stage(df.select("extract_id", "extracted_text").join(asked, "extract_id", "left_semi").mapInArrow(arrays, "extract_id bigint, s binary").dropDuplicates(["extract_id"]), "exact")

    return intersected(close, exact).where(F.col("jaccard") >= t), members


def intersected(pairs: DataFrame, sets: DataFrame, block: int = 512) -> DataFrame:
    """(a, b, jaccard) of pairs(a, b) from sets(extract_id, s), the sorted arrays, by exact intersection.

    Pairs are gathered by neighbourhood (the least id that a is paired with), and a neighbourhood of more than `block` sets is cut into squares of about block by
    block sets. A set is sent once to each square that needs it, not once for each pair, and no task holds more than two blocks of sets at a time.
    """
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("place"))
    placed = pairs.join(near, "a")
    wide = placed.select("place", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("place").agg(F.ceil(F.count("*") / block).cast("int").alias("g"))
    side = lambda c: F.pmod(F.xxhash64(c), F.col("g")).cast("int")
    squares = placed.join(wide, "place").select("place", side("a").alias("i"), side("b").alias("j"), "a", "b")
    needed = squares.select("place", "i", "j", F.explode(F.array("a", "b")).alias("extract_id")).distinct().join(sets, "extract_id")

    def measure(asked: pa.Table, held: pa.Table) -> pa.Table:
        arrays = {k: np.frombuffer(v, np.uint64) for k, v in zip(held.column("extract_id").to_pylist(), held.column("s").to_pylist())}
        by: dict[int, list[int]] = {}
        for x, y in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist()):
            by.setdefault(x, []).append(y)
        left, right, js = [], [], []
        for x, others in by.items():
            own = arrays[x]
            sizes = np.array([len(arrays[y]) for y in others])
            whole = np.concatenate([arrays[y] for y in others])
            hit = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            left += [x] * len(others)
            right += others
            js.append(both / (len(own) + sizes - both))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "jaccard": pa.array(np.concatenate(js) if js else np.zeros(0), pa.float64())})

    needed = needed.select(F.col("place").alias("place_of"), F.col("i").alias("i_of"), F.col("j").alias("j_of"), "extract_id", "s")
    return squares.groupBy("place", "i", "j").cogroup(needed.groupBy("place_of", "i_of", "j_of")).applyInArrow(measure, "a bigint, b bigint, jaccard double")


def document_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(document_id_a, document_id_b), a < b: the links and the groups of equal sets as pairs of documents."""
    m = members.where("rep is not null")
    ma, mb = m.select(F.col("document_id").alias("p"), F.col("rep").alias("a")), m.select(F.col("document_id").alias("q"), F.col("rep").alias("b"))
    linked = links.join(ma, "a").join(mb, "b").select(F.least("p", "q").alias("document_id_a"), F.greatest("p", "q").alias("document_id_b"))
    many = m.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    some = m.join(many, "rep", "left_semi")
    same = some.alias("x").join(some.alias("y"), (F.col("x.rep") == F.col("y.rep")) & (F.col("x.document_id") < F.col("y.document_id")))
    return linked.unionByName(same.select(F.col("x.document_id").alias("document_id_a"), F.col("y.document_id").alias("document_id_b")))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, root): the smallest id that each linked id reaches, by alternating large and small stars until a round changes nothing; each round is written to the
    shared folder. An error if a given number of rounds does not settle it."""
    edges = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    for r in itertools.count() if rounds is None else range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = stage(small, f"edges{r}")
        now, then = (e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for e in (new, edges))
        edges = new
        if now == then:
            break
    else:
        raise ValueError(f"not settled after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def document_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(document_id, group_id, links): one row per document; group_id is a document_id of its group, links the number of documents similar to it."""
    links = stage(links, "links")
    sizes = members.where("rep is not null").groupBy("rep").agg(F.count("*").alias("n"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    linked = ends.join(sizes.select(F.col("rep").alias("o"), "n"), "o").groupBy("rep").agg(F.sum("n").alias("others"))
    roots = components(links).withColumnRenamed("id", "rep")
    whole = members.join(sizes, "rep", "left").join(linked, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    names = whole.where("root is not null").groupBy("root").agg(F.min("document_id").alias("group_id"))
    return whole.join(names, "root", "left").select("document_id", F.coalesce("group_id", "document_id").alias("group_id"), (F.coalesce("n", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("links"))
