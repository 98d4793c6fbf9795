"""Problems 5, 7 and 9 against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import near_duplicates, neighbors, packing
from siltstone.llm.words import WORD

AT = dt.datetime(2026, 1, 1)
POINT = "point_id string, created_at timestamp, is_active boolean, vector array<float>"

# --- 5


def brute_neighbors(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(x @ x.T, 9)
    np.fill_diagonal(sims, -9)
    return {ids[i]: [ids[j] for j in np.argsort(-s, kind="stable")[:k]] for i, s in enumerate(sims)}


def test_small_sets_are_exact(spark):
    rng = np.random.default_rng(1)
    vectors = {f"p{i:03}": rng.normal(size=8).astype(np.float32).tolist() for i in range(60)}
    for i in range(20, 36):
        vectors[f"p{i:03}"] = vectors["p007"]  # more equal vectors than k
    rows = [(i, AT, True, v) for i, v in vectors.items()]
    rows += [("p000", AT - dt.timedelta(1), True, [1.0] * 8), ("p001", None, True, [1.0] * 8), ("off", AT, False, [1.0] * 8), ("off2", AT, None, [1.0] * 8), ("zero", AT, True, [0.0] * 8), ("nan", AT, True, [float("nan")] * 8), ("inf", AT, True, [float("inf")] + [1.0] * 7), ("short", AT, True, [1.0]), ("none", AT, True, None), ("part", AT, True, [None] + [1.0] * 7), (None, AT, True, [1.0] * 8), ("was", AT, True, [1.0] * 8), ("was", AT + dt.timedelta(1), False, [1.0] * 8)]
    df = spark.createDataFrame(rows + rows[:3], POINT).withColumn("row", F.lit(1)).withColumn("same", F.lit("x")).withColumn("no", F.lit(0))
    got = {r.point_id: [x.point_id for x in r.near] for r in neighbors.most_similar(df, k=5, dim=8, posts=99, asks=99, small=8, rerank=99).collect()}
    assert got == brute_neighbors(vectors, 5)
    pairs = neighbors.similar_pairs(neighbors.most_similar(df, k=5, dim=8, posts=99, asks=99, small=8, rerank=99)).collect()
    assert {(r.point_id_a, r.point_id_b) for r in pairs} == {tuple(sorted((a, b))) for a, bs in got.items() for b in bs}


@pytest.mark.parametrize("how", [{}, {"rerank": 60, "max_pivots": 40}, {"flat": 8, "max_pivots": 400, "rerank": 80}, {"file_rows": 50}])
def test_recall(spark, how):
    """As it is run; with files of five times the rerank budget and more; with pivots on two levels; with files that are dealt to several tasks."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    vectors = {f"p{i:05}": (centres[i % 60] + 0.4 * rng.normal(size=32)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame([(i, AT, True, v) for i, v in vectors.items()], POINT)
    got = {r.point_id: {x.point_id for x in r.near} for r in neighbors.most_similar(df, dim=32, **how).collect()}
    want = brute_neighbors(vectors, 10)
    assert all(len(x) == 10 for x in got.values())
    assert sum(len(got[i] & set(w)) for i, w in want.items()) >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("rerank", [1024, 40])
def test_multiples_and_ties(spark, rerank):
    """A third of all rows are multiples of one vector, exact ones and such that float32 rounds: the smaller ids win, whatever file they lie in."""
    rng = np.random.default_rng(5)
    vectors = {f"p{i:04}": rng.normal(size=16).astype(np.float32) for i in range(600)}
    multiples = [f"p{i:04}" for i in rng.permutation(600)[:200]]
    for n, i in enumerate(multiples):
        vectors[i] = (vectors["p0007"] * np.float32([0.25, 3, 0.1, 7.3][n % 4] + (n // 4 if n % 4 > 1 else 0))).astype(np.float32)
    vectors = {i: v.tolist() for i, v in vectors.items()}
    df = spark.createDataFrame([(i, AT, True, v) for i, v in vectors.items()], POINT)
    got = {r.point_id: [x.point_id for x in r.near] for r in neighbors.most_similar(df, dim=16, posts=99, asks=99, small=8, rerank=rerank, max_pivots=3).collect()}
    want = brute_neighbors(vectors, 10)
    assert {i: got[i] for i in multiples} == {i: want[i] for i in multiples}
    assert rerank < 600 or got == want  # fewer are ranked by their pivots, but all that tie are kept


def test_the_first_of_ties_win():
    assert neighbors.first_best(np.array([[0.5, 1, 0.5, 1, 0.5], [1, 1, 1, 1, 1.0]]), 3).tolist() == [[0, 1, 3], [0, 1, 2]]
    x = np.tile(np.eye(8, dtype=np.float32)[:1], (90, 1)) * np.linspace(1, 9, 90, dtype=np.float32)[:, None]
    rows = (np.arange(90), x, np.zeros((90, 2), np.int32) + [0, 1])
    for rerank in (20, 2):  # all tie in footrule, so all are reranked
        for q, best, cos in neighbors.file_ranks(rows, rows, 0, 12, 2, 2, rerank):
            assert sorted(best) == [i for i in range(13) if i != q][:12] and (cos == 1).all()


def test_files_rank_by_footrule():
    """Members whose orders are far from the query's are not reranked, and a pair is ranked in the file of the query's nearest shared pivot only."""
    x = np.eye(4, dtype=np.float32)
    members = (np.arange(4), x, np.array([[0, 1, 2], [0, 1, 2], [0, 2, 1], [3, 0, 4]], np.int32))
    query = (np.array([9]), x[3:], np.array([[0, 1, 2]], np.int32))
    near = lambda file, rerank, q=query, **kw: {int(i) for _, best, _ in neighbors.file_ranks(members, q, file, 9, 2, 2, rerank) for i in best}
    assert near(0, 9) == {0, 1, 2, 3} and near(0, 2) == {0, 1} and near(0, 1) == {0, 1} and near(0, 3) == {0, 1, 2}
    assert near(1, 9) == set()  # all that are posted under 1 are met under 0
    assert near(0, 9, (np.array([9]), x[3:], np.array([[1, 0, 2]], np.int32))) == {2, 3}


def test_near_pivots_on_two_levels():
    rng = np.random.default_rng(3)
    x = neighbors.directions(rng.normal(size=(3000, 16)) + 3 * np.eye(16)[rng.integers(0, 16, 3000)]).astype(np.float32)
    flat, two = neighbors.NearPivots(x[:1500], 8, 9999)(x), neighbors.NearPivots(x[:1500], 8, 10)(x)
    assert np.mean([len(np.intersect1d(a, b)) for a, b in zip(flat, two)]) > 7
    group = neighbors.groups_of_files(x[:100], 8)
    assert sorted(np.unique(group)) == list(range(group.max() + 1)) and np.bincount(group).max() <= 8


def test_small_sets_are_exact_as_they_are_run(spark):
    rng = np.random.default_rng(6)
    vectors = {f"p{i:03}": rng.normal(size=16).astype(np.float32).tolist() for i in range(200)}
    df = spark.createDataFrame([(i, AT, True, v) for i, v in vectors.items()], POINT)
    assert {r.point_id: [x.point_id for x in r.near] for r in neighbors.most_similar(df, dim=16).collect()} == brute_neighbors(vectors, 10)


def test_few_points(spark):
    df = spark.createDataFrame([("a", AT, True, [1.0, 0.0]), ("b", AT, True, [2.0, 0.0])], POINT)
    assert {r.point_id: [x.point_id for x in r.near] for r in neighbors.most_similar(df, dim=2).collect()} == {"a": ["b"], "b": ["a"]}
    assert neighbors.similar_pairs(neighbors.most_similar(df.where("point_id = 'a'"), dim=2)).count() == 0
    assert neighbors.similar_pairs(neighbors.most_similar(df.where("false"), dim=2)).count() == 0


# --- 7

EXTRACT = "extract_id bigint, document_id string, extracted_at timestamp, ok boolean, extracted_text string"


def grams(text, n=3):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_pairs(rows, t=0.7):
    newest = {}
    for e, d, at, ok, text in rows:
        if d is not None and (d not in newest or (at or dt.datetime.min, e) > newest[d][0]):
            newest[d] = ((at or dt.datetime.min, e), ok, text)
    sets = {d: grams(x) for d, (_, ok, x) in newest.items() if ok and grams(x)}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t:
                out.add((a, b))
    return out, newest


def edited_rows():
    rng = random.Random(3)
    words = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
    rows, e = [], 0
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(3, 160))]
        for copy in range(rng.randint(1, 6)):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 3, 8, 20])):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = [rng.choice(words)]
            if rng.random() < 0.2:
                half = len(own) // 2
                own = own[half:] + own[:half]
            e += 1
            rows.append((e, f"d{base:02}-{copy}", AT, True, " ".join(own)))
    rows += [(900, "d00-0", AT - dt.timedelta(1), True, "old text of this page"), (901, "d01-0", AT + dt.timedelta(1), False, "x y z"), (902, "n1", AT, True, None), (903, "n2", AT, True, ""), (904, "n3", AT, True, "two words"), (905, None, AT, True, "a b c"), (906, "n4", None, True, "a b c d"), (907, "n5", AT, None, "a b c d"), (908, "n6", AT, True, "A  b, C d!")]
    return rows + rows[:4]


def test_near_duplicates(spark):
    rows = edited_rows()
    want, newest = brute_pairs(rows)
    df = spark.createDataFrame(rows, EXTRACT).withColumn("rep", F.lit(1)).withColumn("size", F.lit("x"))
    links, members = near_duplicates.similar_sets(df)
    got = [(r.document_id_a, r.document_id_b) for r in near_duplicates.document_pairs(links, members).collect()]
    assert len(want) > 30 and sorted(got) == sorted(want)
    groups = near_duplicates.document_groups(links, members).collect()
    assert sorted(r.document_id for r in groups) == sorted(d for d, (_, ok, _) in newest.items() if ok)
    root = {d: d for d in newest}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in want:
        root[find(b)] = find(a)
    same = {(r.document_id, s.document_id) for r in groups for s in groups if r.group_id == s.group_id}
    assert same == {(r.document_id, s.document_id) for r in groups for s in groups if find(r.document_id) == find(s.document_id)}
    assert all(r.links == sum(r.document_id in p for p in want) for r in groups)


def test_intersections_in_squares(spark):
    rng = np.random.default_rng(4)
    sets = {i: np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for i in range(40)}
    pairs = [(i, j) for i in sets for j in sets if i < j and (i + j) % 3]
    held = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "extract_id bigint, s binary")
    got = near_duplicates.intersected(spark.createDataFrame(pairs, "a bigint, b bigint"), held, block=7).collect()
    assert sorted((r.a, r.b) for r in got) == pairs
    assert all(r.jaccard == pytest.approx(len(np.intersect1d(sets[r.a], sets[r.b])) / len(np.union1d(sets[r.a], sets[r.b]))) for r in got)


def test_components_that_do_not_settle(spark):
    with pytest.raises(ValueError):
        near_duplicates.components(spark.createDataFrame([(i, i + 1) for i in range(20)], "a bigint, b bigint"), rounds=1)


def test_a_large_group_of_copies(spark):
    rows = [(i, f"d{i:04}", AT, True, "the same text stands in all of these pages again") for i in range(300)] + [(1000 + i, f"e{i}", AT, True, f"the same text stands in all of these pages again {i}") for i in range(3)]
    links, members = near_duplicates.similar_sets(spark.createDataFrame(rows, EXTRACT))
    assert members.select("rep").distinct().count() == 4 and links.count() == 6
    groups = near_duplicates.document_groups(links, members)
    assert groups.select("group_id").distinct().count() == 1 and {r.links for r in groups.collect()} == {302}


def test_no_pages(spark):
    empty = spark.createDataFrame([], EXTRACT)
    links, members = near_duplicates.similar_sets(empty)
    assert near_duplicates.document_pairs(links, members).count() == 0
    assert near_duplicates.document_groups(links, members).count() == 0


# --- 9


@pytest.mark.parametrize("seed", range(8))
def test_packing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 40), rng.randint(1, 100), 100, 50]) for _ in range(rng.choice([0, 1, 5, 60, 400]))]
    bins = packing.pack(sizes, 100)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(0 < sum(b) <= 100 for b in bins)
    assert -(-sum(sizes) // 100) <= len(bins) <= len(packing.best_fit(sizes, 100))


def test_bin_completion_beats_best_fit():
    sizes = [60, 50, 50, 40, 40, 30, 30] * 3
    assert len(packing.pack([50, 46, 36, 34, 34], 100)) == 2 or len(packing.best_fit([50, 46, 36, 34, 34], 100)) == 3
    assert len(packing.pack(sizes, 100)) == 9 == sum(sizes) // 100


def test_groups_of_many_containers_are_searched():
    rng = random.Random(1)
    sizes = [max(1, int(rng.gauss(700, 250))) for _ in range(8192)]
    bins = packing.pack(sizes)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= 2048 for b in bins)
    assert len(bins) < len(packing.best_fit(sizes, 2048))  # a dive is longer than 2,000 nodes


def test_groups_that_stopped_short(spark):
    rows = [("0-0", 2048), ("0-1", 5), ("1-0", 1000), ("1-1", 1000), ("1-1", 48), ("2-0", 7)]
    assert [tuple(r) for r in packing.stopped_short(spark.createDataFrame(rows, "container_id string, n_tokens int")).collect()] == [(1, 2, 1)]


def test_containers(spark):
    texts = [None, "", "a", "word " * 5000, "word " * 100, "x y z " * 300, "word " * 2048] * 3
    df = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], "doc_id bigint, text string").withColumn("g", F.lit("x"))
    try:
        rows = packing.fill_containers(df, group=8).collect()
    except FileNotFoundError:
        pytest.skip("no public tokenizers here")
    used, docs = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        docs.setdefault(r.doc_id, []).append(r)
    assert all(used[r.container_id] == r.container_tokens <= 2048 for r in rows)
    assert set(docs) == {i for i, t in enumerate(texts) if t} and len(docs[4]) == 2
    long = sorted(docs[3], key=lambda r: r.piece_no)
    assert [r.start_token for r in long] == [2048 * i for i in range(len(long))] and all(r.n_tokens == 2048 for r in long[:-1])
    assert packing.fill_containers(df.where("false")).count() == 0
