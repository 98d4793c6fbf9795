"""Problem 9: fill fixed-capacity containers with whole texts.

Method: bin completion branch-and-bound. Containers are filled one at a time: each starts with the largest text left, and only
undominated completions are tried (a completion is dominated if a text left out could take the place of a smaller one in it). Branches
whose waste exceeds what the best known solution allows are pruned. Best-fit decreasing gives the first solution; the search stops as
soon as a solution reaches the lower bound ceil(total / capacity), or after `budget` nodes or `DIVES` for each container (one node fills one container),
with the best solution known; stopped_short() tells the groups where that is above the bound. A node has at most `COMPLETIONS` completions, looked for in
`STEPS` steps for each.

Texts are dealt to groups of about `group` texts by a hash of doc_id, each packed in its own task, so no task holds more than a bounded number
of sizes; a group leaves at most its last container partly filled beyond the optimum, which is under 0.1 % of the space.

Defined results: null and empty texts get no row. A text over the capacity fills containers of its own with its first tokens, and the rest is packed
like a text: piece_no and start_token tell its pieces. Rows with the same doc_id are packed one by one.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.tokens import encode_corpus
from siltstone.session import stage

CAPACITY, GROUP, BUDGET = 2048, 8192, 2000
DIVES, COMPLETIONS, STEPS = 8, 4, 50
SCHEMA = "doc_id bigint, piece_no int, start_token int, n_tokens int, container_id string, container_tokens int"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}
    free: list[int] = []  # sorted distinct free spaces
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(free, s)
        if at == len(free):
            bins.append([])
            b, left = len(bins) - 1, capacity
        else:
            left = free[at]
            b = room[left].pop()
            if not room[left]:
                del room[left], free[at]
        bins[b].append(s)
        left -= s
        if left:
            if left not in room:
                room[left] = []
                bisect.insort(free, left)
            room[left].append(b)
    return bins


def completions(kinds: list[int], left: Counter, room: int, slack: int, most: int) -> list[tuple[int, tuple[int, ...]]]:
    """Up to `most` undominated fillings (waste, sizes) of a space from the sizes left, the least waste and then the fewest texts first."""
    out: list[tuple[int, tuple[int, ...]]] = []
    steps = [0]

    def grow(at: int, space: int, chosen: tuple[int, ...]) -> bool:
        """Largest sizes first; true once enough were found."""
        steps[0] += 1
        if steps[0] > STEPS * most:
            return True
        fits = bisect.bisect_right(kinds, space, 0, at)
        taken = Counter(chosen)
        while fits and left[kinds[fits - 1]] <= taken[kinds[fits - 1]]:
            fits -= 1
        if not fits:
            if space <= slack and not dominated(space, chosen):
                out.append((space, chosen))
            return len(out) >= most or space == 0
        for i in range(fits - 1, -1, -1):
            k = kinds[i]
            if left[k] > taken[k]:
                if grow(i + 1, space - k, (*chosen, k)):
                    return True
                if space - k > slack and i == 0:
                    break
        return False

    def dominated(space: int, chosen: tuple[int, ...]) -> bool:
        """Whether a size left out could replace a smaller one within the space that would be wasted."""
        if not space:
            return False
        taken = Counter(chosen)
        for c in set(chosen):
            i = bisect.bisect_right(kinds, c + space) - 1
            while i >= 0 and kinds[i] > c:
                if left[kinds[i]] > taken[kinds[i]]:
                    return True
                i -= 1
        return False

    grow(len(kinds), room, ())
    return sorted(set(out), key=lambda x: (x[0], len(x[1])))


def pack(sizes: list[int], capacity: int = CAPACITY, budget: int = BUDGET) -> list[list[int]]:
    """Containers (lists of sizes) that hold the sizes, each 1..capacity."""
    best = best_fit(sizes, capacity)
    total, bound = sum(sizes), -(-sum(sizes) // capacity)
    nodes, most = 0, max(budget, DIVES * len(best))
    while len(best) > bound and nodes < most:
        # depth-first dive for a solution of len(best) - 1 containers; backtracking over alternative completions
        left = Counter(sizes)
        kinds = sorted(left)
        slack = (len(best) - 1) * capacity - total
        path: list[tuple[int, list, list, int]] = []  # first, what it may be completed with, what it is completed with, slack before

        def take(k: int) -> None:
            left[k] -= 1
            if not left[k]:
                del kinds[bisect.bisect_left(kinds, k)]

        def put(k: int) -> None:
            if not left[k]:
                bisect.insort(kinds, k)
            left[k] += 1

        found = None
        while nodes < most:
            nodes += 1
            if not kinds:
                found = [[first, *rest] for first, _, rest, _ in path]
                break
            first = kinds[-1]
            take(first)
            path.append((first, completions(kinds, left, capacity - first, slack, COMPLETIONS)[::-1], [], slack))
            while path:
                first, options, rest, before = path[-1]
                for k in rest:
                    put(k)
                rest.clear()
                if options:
                    waste, chosen = options.pop()
                    for k in chosen:
                        take(k)
                    rest.extend(chosen)
                    slack = before - waste
                    break
                put(first)
                path.pop()
            if not path:
                break
        if found is None:
            break
        best = found
    return best


def stopped_short(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(g, containers, bound) of the groups of fill_containers' rows that have more containers than the lower bound."""
    groups = filled.groupBy(F.split("container_id", "-")[0].cast("int").alias("g")).agg(F.countDistinct("container_id").alias("containers"), F.ceil(F.sum("n_tokens") / capacity).alias("bound"))
    return groups.where("containers > bound")


def fill_containers(df: DataFrame, capacity: int = CAPACITY, group: int = GROUP, budget: int = BUDGET, **tokenizer: str) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens, container_id, container_tokens) of every non-empty text of df(doc_id, text)."""
    sizes = stage(encode_corpus(df.where(F.length("text") > 0), counts=True, **tokenizer).where("n_tokens > 0"), "sizes")
    groups = max(1, round(sizes.count() / group))

    def run(rows: pa.Table) -> pa.Table:
        ids, ns, g = rows.column("doc_id").to_numpy(zero_copy_only=False), rows.column("n_tokens").to_numpy(), rows.column("g")[0].as_py()
        order = np.lexsort((ns, rows.column("key").to_numpy()))
        out, items, wait, boxes = [], [], {}, 0
        for i in order.tolist():
            n = int(ns[i])
            whole, rest = divmod(n, capacity)
            if not rest:
                whole, rest = whole - 1, capacity
            for piece in range(whole):
                out.append((i, piece, piece * capacity, capacity, boxes, capacity))
                boxes += 1
            items.append(rest)
            wait.setdefault(rest, []).append((i, whole, whole * capacity))
        for box in pack(items, capacity, budget):
            used = sum(box)
            for s in box:
                out.append((*wait[s].pop(), s, boxes, used))
            boxes += 1
        at, piece, start, n, box, used = zip(*out)
        doc = rows.column("doc_id").take(pa.array(at))
        return pa.table({"doc_id": doc, "piece_no": pa.array(piece, pa.int32()), "start_token": pa.array(start, pa.int32()), "n_tokens": pa.array(n, pa.int32()), "container_id": pa.array([f"{g}-{b}" for b in box]), "container_tokens": pa.array(used, pa.int32())})

    key = F.xxhash64("doc_id", "n_tokens")
    return sizes.select("doc_id", "n_tokens", key.alias("key"), F.pmod(key, F.lit(groups)).cast("int").alias("g")).groupBy("g").applyInArrow(run, SCHEMA)
