"""Problem 5: the k most similar vectors of every vector.

Method: permutation index. Pivots are drawn from the vectors by hash. Each vector is represented by its `prefix` nearest pivots in order of
nearness. It is posted in the inverted files of its `posts` nearest pivots, and as a query it asks the files of its `asks` nearest ones. Inside a file
the members are always ranked by the footrule distance between the pivot orders (a pivot that an order lacks counts as the place after its last); the best
`rerank`, or the best eighth of a longer file, with all that tie with the last of them, are reranked by their exact cosine. Cosines are those of the vectors as
given, in float64; ties are broken where they arise, before any member is left out. A pair that meets in several files is ranked in the first of them.

Files of near pivots lie together, at most `TOGETHER` of them in a task, about `GROUP_BYTES` on average: a vector whose files lie in one group is sent there once.
A file of more than `FILE_ROWS` members is dealt to several tasks: each has a part of the members and all of the file's queries.

Every usable vector is indexed and every usable vector is a query. The number of pivots grows with the square root of the
number of vectors, up to `max_pivots` (32,768 pivots of 384 floats are 48 MB, the only thing sent to all executors; that is reached at 67 million vectors,
beyond which files grow and are dealt). From `flat` pivots on the nearest ones are found on two levels: among the pivots near the nearest coarse ones. As pivots are
drawn from the data, dense regions get more pivots and the files stay even. Vectors of one direction (equal in float64 when divided by
their largest number) are collapsed to one representative before they are posted, so a group of copies or multiples of any size costs one
posting; its members come back at the end.

Defined results: of each point_id only the row with the greatest created_at counts (a null created_at is the smallest), and only if
it is active and its vector has `dim` finite numbers that are not all zero. Similarities equal after rounding to 9 decimals are ties and the
smaller point_id wins. With k or fewer other points, all of them are returned.
Up to `SMALL` vectors lie in one file that is reranked whole, so small tables are exact. Null point_ids are dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from siltstone.session import stage

K, DIM, POSTS, ASKS, PREFIX, RERANK, MAX_PIVOTS, FLAT, SMALL = 10, 384, 4, 4, 32, 160, 1 << 15, 2048, 1024
TOGETHER, GROUP_BYTES, FILE_ROWS = 8, 64 << 20, 1 << 14
HELD = T.StructType([T.StructField("no", T.LongType()), T.StructField("pivots", T.BinaryType()), T.StructField("vector", T.BinaryType())])
POSTED = T.StructType([T.StructField("task", T.IntegerType()), *HELD.fields])
RANKED = "no bigint, near array<struct<sim: double, no: bigint>>"


def usable(vector: Column, dim: int) -> Column:
    """dim finite numbers that are not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def newest(df: DataFrame, dim: int, with_vector: bool) -> DataFrame:
    """(point_id, vector) of the usable points, or (point_id, same); same is equal for vectors of one direction.

    Without vectors only hashes of each are shuffled. Both forms choose the same row.
    """
    vector = F.col("vector")
    good = F.coalesce(F.col("is_active"), F.lit(False)) & usable(vector, dim)
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    direction = F.transform(F.arrays_zip(vector.alias("x"), F.array_repeat(largest, F.size(vector)).alias("m")), lambda s: F.try_divide(s["x"].cast("double"), s["m"]) + F.lit(0.0))
    hashes = [] if with_vector else [F.when(good, F.xxhash64(direction)).alias("d1"), F.when(good, F.hash(direction)).alias("d2")]
    row = F.struct(F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), good.alias("good"), F.xxhash64(vector).alias("h1"), F.hash(vector).alias("h2"), *hashes)
    rows = df.where("point_id is not null").select("point_id", row.alias("row"), *([F.when(good, vector).alias("vector")] if with_vector else []))
    best = rows.groupBy("point_id").agg(F.max("row").alias("row"), *([F.max_by("vector", "row").alias("vector")] if with_vector else [])).where("row.good")
    return best.select("point_id", *(["vector"] if with_vector else [F.struct("row.d1", "row.d2").alias("same")]))


def draw_pivots(df: DataFrame, dim: int, max_pivots: int) -> np.ndarray:
    """Unit pivots: about 4 * sqrt(rows), but no more than rows / 32, different usable vectors, those whose point_id has the smallest hashes."""
    n = df.count()
    want = min(max_pivots, max(8, math.ceil(min(4 * math.sqrt(n), n / 32))))
    rank = F.xxhash64("point_id", F.lit("pivot"))
    share = min(1.0, 3 * want / max(n, 1) + 1e-9)  # the draw sorts three times as many rows as it needs, whatever n is
    some = df.where(usable(F.col("vector"), dim) & (F.pmod(rank, F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))))
    rows = some.select("vector", rank.alias("rank")).orderBy("rank").limit(want).select("vector").toArrow()
    if not rows.num_rows:
        return np.zeros((0, dim), np.float32)
    found = np.unique(np.asarray(rows.column(0).combine_chunks().flatten(), np.float64).reshape(-1, dim), axis=0)
    return directions(found).astype(np.float32)


class NearPivots:
    """Finds the nearest pivots of unit vectors, in order; from `flat` pivots on by way of coarse ones."""

    CELLS = 16

    def __init__(self, pivots: np.ndarray, prefix: int, flat: int) -> None:
        self.pivots, self.prefix, self.cells = pivots, prefix, None
        if len(pivots) > max(flat, self.CELLS**2):
            self.coarse = pivots[:: max(1, len(pivots) // (2 * math.isqrt(len(pivots))))]
            home = np.concatenate([np.argmax(pivots[at : at + 4096] @ self.coarse.T, axis=1) for at in range(0, len(pivots), 4096)])
            self.cells = [np.flatnonzero(home == c) for c in range(len(self.coarse))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.cells is None:
            near = x @ self.pivots.T
        else:
            near = np.full((len(x), len(self.pivots)), -2, np.float32)
            some = np.argpartition(-(x @ self.coarse.T), self.CELLS, axis=1)[:, : self.CELLS]
            for c in np.unique(some):
                rows, cell = np.flatnonzero((some == c).any(axis=1)), self.cells[c]
                near[rows[:, None], cell] = x[rows] @ self.pivots[cell].T
        order = np.argpartition(-near, self.prefix - 1, axis=1)[:, : self.prefix] if self.prefix < len(self.pivots) else np.broadcast_to(np.arange(self.prefix), (len(x), self.prefix))
        return np.take_along_axis(order, np.argsort(-np.take_along_axis(near, order, 1), axis=1, kind="stable"), 1).astype(np.int32)


def groups_of_files(pivots: np.ndarray, together: int) -> np.ndarray:
    """The group of each pivot's file: a pivot and the nearest ones that have no group yet."""
    group, n = np.full(len(pivots), -1, np.int32), 0
    if together == 1:
        return np.arange(len(pivots), dtype=np.int32)
    for i in range(len(pivots)):
        if group[i] < 0:
            free = np.flatnonzero(group < 0)
            group[free[np.argsort(-(pivots[free] @ pivots[i]), kind="stable")[:together]]] = n
            group[i] = n
            n += 1
    return group


def directions(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in float64; very large numbers would overflow when squared."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_best(sims: np.ndarray, top: int) -> np.ndarray:
    """Positions of the `top` greatest of each row; the first of equal ones."""
    if top >= sims.shape[1]:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    last = np.partition(sims, sims.shape[1] - top, axis=1)[:, [-top]]
    above, equal = sims > last, sims == last
    kept = above | (equal & (np.cumsum(equal, axis=1) <= top - above.sum(axis=1, keepdims=True)))
    return np.nonzero(kept)[1].reshape(len(sims), top)


def file_ranks(members: tuple, queries: tuple, file: int, k: int, posts: int, asks: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, positions of its best members, cosines to 9 decimals) of a file; members, queries: (ids, vectors, pivot orders), ids ascending.

    Members that the query meets in the file of a nearer pivot are left to that file. Of members that tie the first ones are the best.
    """
    (mi, mv, mo), (qi, qv, qo) = members, queries
    mv, prefix, n = directions(mv), mo.shape[1], len(mi)
    used, local = np.unique(np.concatenate([mo, qo]), return_inverse=True)
    local = local.reshape(len(mo) + len(qo), -1)
    place = np.full((len(used), n), prefix, np.int16)  # the place of each pivot in each member's order
    place[local[:n], np.arange(n)[:, None]] = np.arange(prefix)
    ql, most = local[n:], max(rerank, n // 8)
    for at in range(0, len(qi), 256):
        block, here = directions(qv[at : at + 256]), qo[at : at + 256]
        foot, free = np.zeros((len(block), n), np.int16), mi[None] != qi[at : at + 256, None]
        before = np.ones(len(block), bool)
        for j in range(prefix):
            at_j = place[ql[at : at + 256, j]]
            foot += np.abs(at_j - j)
            before &= here[:, j] != file
            if j < asks and before.any():
                free[before] &= at_j[before] >= posts
        foot[~free] = np.iinfo(np.int16).max
        cut = np.partition(foot, most - 1, axis=1)[:, [most - 1]] if n > most else np.full((len(block), 1), np.iinfo(np.int16).max)
        near = free & (foot <= cut)
        if n <= 8 * most:
            sims = np.round(block @ mv.T, 9)
            sims[~near] = -2
            best = first_best(sims, min(k, n))
            for i, (b, s) in enumerate(zip(best, np.take_along_axis(sims, best, 1))):
                yield at + i, b[s > -2], s[s > -2]
            continue
        for i, v in enumerate(block):
            x, sims = np.flatnonzero(near[i]), []
            for a in range(0, len(x), most):
                sims.append(np.round(mv[x[a : a + most]] @ v, 9))
                if sum((s >= 1).sum() for s in sims) >= k:
                    break  # nothing that follows is nearer or comes first
            if sims:
                sims = np.concatenate(sims)
                best = first_best(sims[None], min(k, len(sims)))[0]
                yield at + i, x[best], sims[best]


def most_similar(
    df: DataFrame, k: int = K, dim: int = DIM, posts: int = POSTS, asks: int = ASKS, prefix: int = PREFIX, rerank: int = RERANK, max_pivots: int = MAX_PIVOTS, small: int = SMALL, file_rows: int = FILE_ROWS, flat: int = FLAT
) -> DataFrame:
    """(point_id, near array<struct<sim, point_id>>) of every usable point of df(point_id, created_at, is_active, vector): its k most similar others."""
    spark = df.sparkSession
    pivots = draw_pivots(df, dim, max_pivots)
    kind = np.float64 if df.schema["vector"].dataType.elementType.typeName() == "double" else np.float32
    members = stage(newest(df, dim, False), "members")
    # k + 1 of each group of vectors of one direction: one of a point's own group is the point itself
    groups = Window.partitionBy("same").orderBy("point_id")
    firsts = members.withColumn("n", F.row_number().over(groups)).where(F.col("n") <= k + 1).groupBy("same").agg(F.sort_array(F.collect_list("point_id")).alias("ids"))
    # numbered in the order of their first point_id: 8 bytes instead of an id in all that follows, and ties still break by id
    firsts = stage(firsts.withColumn("first", F.col("ids")[0]).sort("first").withColumn("no", F.monotonically_increasing_id()), "groups")
    if not len(pivots):
        none = F.array().cast("array<struct<sim: double, point_id: string>>")
        return members.where("false").select("point_id", none.alias("near"))
    count = firsts.count()
    if count <= small:  # one file holds all
        pivots, rerank, file_rows = pivots[:1], max(rerank, count), max(file_rows, count)
    prefix = min(prefix, len(pivots))
    posts, asks = min(posts, prefix), min(asks, posts, prefix)
    # the vectors lie by point_id after newest(), so this join moves only the ids of the representatives
    chosen = firsts.select(F.col("first").alias("point_id"), "no").hint("shuffle_hash")
    reps = newest(df, dim, True).join(chosen, "point_id").select("no", "vector")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = NearPivots(pivots, prefix, flat)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = np.asarray(part.column(1).flatten()).reshape(-1, dim)
                orders = nearest(directions(raw).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([o.tobytes() for o in orders], pa.binary()), pa.array([v.tobytes() for v in raw], pa.binary())], names=HELD.names)

    held = stage(reps.mapInArrow(order, HELD), "orders")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(pivots), np.int64)
        for batch in batches:
            found += np.bincount(unpacked(batch.column(0), np.int32, prefix)[:, :posts].ravel(), minlength=len(pivots))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found), pa.int32()), pa.array(found[found > 0])], names=["file", "n"])

    members_of = np.zeros(len(pivots), np.int64)  # one number per pivot
    for file, n in held.select("pivots").mapInArrow(sizes, "file int, n bigint").groupBy("file").agg(F.sum("n")).collect():
        members_of[file] = n
    # a vector is sent to about two or three groups; where files are long, fewer of them lie together
    width = 4 * dim + 4 * prefix
    group = groups_of_files(pivots, max(1, min(TOGETHER, round(GROUP_BYTES * len(pivots) / (2.5 * width * max(1, count))))))
    parts = np.maximum(1, -(-members_of // file_rows)).astype(np.int32)
    split = parts > 1
    first_task = np.where(split, group.max() + 1 + np.cumsum(np.where(split, parts, 0)) - parts, group).astype(np.int32)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = unpacked(batch.column(1), np.int32, prefix)[:, :posts]
            rows, to = np.repeat(np.arange(len(files)), posts), first_task[files].ravel()
            n = parts[files].ravel()  # a split file has several tasks, one after the other
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            both = np.unique(np.stack([np.repeat(rows, n), np.repeat(to, n) + step]), axis=1)
            index = pa.array(both[0])
            yield pa.RecordBatch.from_arrays([pa.array(both[1].astype(np.int32)), *(c.take(index) for c in batch.columns)], names=POSTED.names)

    def rank(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no")  # of members that tie, those with the smaller ids come first
        ids = rows.column("no").to_numpy()
        orders, vectors = unpacked(rows.column("pivots"), np.int32, prefix), unpacked(rows.column("vector"), kind, dim)
        here = rows.column("task")[0].as_py()
        of = np.flatnonzero(~split & (group == here)) if here <= group.max() else np.flatnonzero(split & (first_task <= here) & (here < first_task + parts))
        asked, sims, names = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
        for file in of:
            home = (orders[:, :posts] == file).any(axis=1)
            if split[file]:
                home &= ids % parts[file] == here - first_task[file]
            home, queries = np.flatnonzero(home), np.flatnonzero((orders[:, :asks] == file).any(axis=1))
            if not len(home):
                continue
            for q, best, cos in file_ranks((ids[home], vectors[home], orders[home]), (ids[queries], vectors[queries], orders[queries]), file, k, posts, asks, rerank):
                asked.append(np.full(len(best), ids[queries[q]]))
                sims.append(cos)
                names.append(ids[home[best]])
        asked, sims, names = (np.concatenate(x) for x in (asked, sims, names))
        best = np.lexsort((names, -sims, asked))
        asked, sims, names = asked[best], sims[best], names[best]
        kept = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        asked, first = np.unique(asked[kept], return_index=True)
        flat_near = pa.StructArray.from_arrays([pa.array(sims[kept]), pa.array(names[kept])], names=["sim", "no"])
        return pa.table({"no": pa.array(asked), "near": pa.ListArray.from_arrays(pa.array(np.append(first, kept.sum()).astype(np.int32)), flat_near)})

    # as many partitions as hold a group of files each, however many vectors there are
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(2.5 * width * count / (2 * GROUP_BYTES)))
    ranked = held.mapInArrow(post, POSTED).repartition(tasks, "task").groupBy("task").applyInArrow(rank, RANKED)

    best_first = F.array_sort(F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-F.round(x["sim"], 9)).alias("far"), x["no"].alias("no"))))
    tops = ranked.groupBy("no").agg(F.slice(best_first, 1, k + 1).alias("top"))
    others = tops.select("no", F.explode("top").alias("x")).select(F.col("no").alias("query"), "x.far", "x.no")
    others = others.join(firsts.select("no", "ids"), "no").select("query", "far", F.explode("ids").alias("point_id"))
    own = firsts.where(F.size("ids") > 1).select(F.col("no").alias("query"), F.lit(-1.0).alias("far"), F.explode("ids").alias("point_id"))
    merged = others.unionByName(own).groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "point_id"))), 1, k + 1).alias("top"))
    mine = members.join(firsts.select("same", F.col("no").alias("query")), "same").select("query", "point_id")
    near = F.slice(F.filter("top", lambda x: x["point_id"] != F.col("point_id")), 1, k)
    return mine.join(merged, "query").select("point_id", F.transform(near, lambda x: F.struct((-x["far"]).alias("sim"), x["point_id"].alias("point_id"))).alias("near"))


def unpacked(column: pa.Array | pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """The rows of a binary column as an array."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def similar_pairs(near: DataFrame) -> DataFrame:
    """(point_id_a, point_id_b), a < b: pairs of which either is among the most similar of the other, each once."""
    pairs = near.select("point_id", F.explode("near.point_id").alias("other"))
    return pairs.select(F.least("point_id", "other").alias("point_id_a"), F.greatest("point_id", "other").alias("point_id_b")).distinct()
