"""Filling containers of fixed capacity with documents of varying size.

Bin completion works on the histogram of sizes: containers with the same
content are found once, with the number of times they occur, so its work
depends on the capacity and not on the number of documents. Around the
largest size left it lists the undominated fillings of the rest of a
container, puts the fullest one in place as often as the counts allow, and
goes on with what remains. Other fillings are tried in turn, depth first; a
branch ends where the waste so far shows that it can't beat the best packing
known. The first packing known is best fit's. The documents are then handed to
the containers by their rank among the documents of their size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.llm import tokens
from argentum.session import cut

#: Fillings tried at a node, fillings listed before that and items in a listed filling, at first; nodes of a search.
WIDTH, LISTED, ITEMS, NODES = 4, 64, 6, 20_000
#: Times as many fillings that a repeated search lists at most.
WIDEST = 16
#: Items up to which fillings are compared for dominance; longer ones are kept.
COMPARED = 12
#: Items that one task ranks at a time, about.
RANKED = 200_000

#: A packing: (copies, {size: times}) of each kind of container.
Packing = list[tuple[int, dict[int, int]]]


def dominated(b: tuple[int, ...], a: tuple[int, ...]) -> bool:
    """Whether the items of filling b fit into the places that the items of filling a leave."""
    if b == a:
        return True
    if sum(b) > sum(a) or max(len(a), len(b)) > COMPARED:
        return False

    def place(i: int, room: list[int]) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, r in enumerate(room):
            if r >= b[i] and r not in tried:
                tried.add(r)
                room[k] -= b[i]
                if place(i + 1, room):
                    room[k] += b[i]
                    return True
                room[k] += b[i]
        return False

    return place(0, list(a))


def fillings(rest: int, counts: dict[int, int], scale: int = 1) -> tuple[list[tuple[int, ...]], bool]:
    """The fullest undominated fillings of rest, the fullest first, then those of the largest items; whether none is left out.

    A size that fits exactly dominates everything. After ITEMS items the rest
    is filled greedily, with as many items as fit. WIDTH, LISTED and ITEMS are
    taken scale times.
    """
    width, listed, most_items = WIDTH * scale, LISTED * scale, ITEMS * scale
    order = sorted(s for s in counts if counts[s] > 0 and s <= rest)
    if not order:
        return [()], True
    if order[-1] == rest:
        return [(rest,)], True
    found: list[tuple[int, ...]] = []
    whole = True

    def greedy(room: int, most: int, used: tuple[int, ...]) -> tuple[int, ...]:
        i, more = bisect_right(order, min(room, most)) - 1, []
        while i >= 0:
            times = min(counts[order[i]] - used.count(order[i]), room // order[i])
            more += [order[i]] * times
            room -= order[i] * times
            i = min(i - 1, bisect_right(order, room) - 1)
        return (*used, *more)

    def extend(room: int, most: int, used: tuple[int, ...]) -> None:
        nonlocal whole
        if len(used) >= most_items:
            found.append(greedy(room, most, used))
            whole = whole and len(found[-1]) == len(used)
            return
        i = bisect_right(order, min(room, most)) - 1
        while i >= 0 and used.count(order[i]) >= counts[order[i]]:
            i -= 1
        if i < 0:
            found.append(used)
            return
        branches = 0
        while i >= 0:
            size = order[i]
            if used.count(size) < counts[size]:
                if branches >= width or len(found) >= listed:
                    whole = False
                    return
                extend(room - size, size, (*used, size))
                branches += 1
                if found and sum(found[-1]) == rest:
                    whole = whole and i == 0
                    return
            i -= 1

    extend(rest, rest, ())
    found.sort(key=lambda f: (-sum(f), tuple(-s for s in f)))
    kept: list[tuple[int, ...]] = []
    for f in found:
        if any(dominated(f, k) for k in kept):
            continue
        if len(kept) == width:
            return kept, False
        kept.append(f)
    return kept, whole


def best_fit(counts: dict[int, int], capacity: int) -> Packing:
    """Best fit by decreasing size on the histogram: each container takes the largest size that still fits, again and again."""
    left = {s: n for s, n in counts.items() if n > 0}
    packing: Packing = []
    while left:
        order = sorted(left)
        room, content = capacity, {}
        while (i := bisect_right(order, room) - 1) >= 0:
            while i >= 0 and content.get(order[i], 0) >= left[order[i]]:
                i -= 1
            if i < 0:
                break
            content[order[i]] = content.get(order[i], 0) + 1
            room -= order[i]
        times = min(left[s] // k for s, k in content.items())
        packing.append((times, content))
        for s, k in content.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
    return packing


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES) -> tuple[Packing, str]:
    """The best packing that bin completion finds within a number of nodes, best fit's if it finds no better; how the search ended.

    counts: documents of each size from 1 to capacity. A packing that reaches
    the bound ceil(tokens / capacity) ends the search (`bound`); any packing
    holds all documents. A search that left out fillings is repeated with
    twice as many, until none is left out (`exhausted`; each filling is tried
    as often as the counts allow, so that fewer containers may still exist),
    WIDEST times as many are listed (`listed`) or the nodes are spent (`nodes`).
    """
    total = sum(s * n for s, n in counts.items())
    best = best_fit(counts, capacity)
    least, known = -(-total // capacity), sum(k for k, _ in best)
    left, path, used, spent = {s: n for s, n in counts.items() if n > 0}, [], 0, 0
    scale, whole = 1, True

    stack: list[tuple[Iterator[tuple[int, ...]], int, int]] = []

    def options() -> Iterator[tuple[int, ...]]:
        nonlocal whole
        top = max(left)
        left[top] -= 1
        found, all_of_them = fillings(capacity - top, left, scale)
        whole = whole and all_of_them
        left[top] += 1
        return iter([(top, *f) for f in found])

    def undo() -> None:
        nonlocal used
        times, content = path.pop()
        used -= times
        for s, k in content.items():
            left[s] = left.get(s, 0) + times * k

    if left and known > least:
        stack.append((options(), 0, 0))
    waste = 0
    while stack and known > least and spent < nodes:
        choices, depth, wasted = stack[-1]
        while len(path) > depth:
            undo()
        waste = wasted
        filling = next(choices, None)
        spent += 1
        if filling is None:
            stack.pop()
            if not stack and not whole and scale < WIDEST:
                scale, whole = 2 * scale, True
                stack.append((options(), 0, 0))
            continue
        content: dict[int, int] = {}
        for s in filling:
            content[s] = content.get(s, 0) + 1
        times = min(left[s] // k for s, k in content.items())
        waste += times * (capacity - sum(filling))
        if -(-(total + waste) // capacity) >= known:  # no packing below this node beats the best one
            continue
        path.append((times, content))
        used += times
        for s, k in content.items():
            left[s] -= times * k
            if not left[s]:
                del left[s]
        if not left:
            if used < known:
                best, known = [(t, dict(c)) for t, c in path], used
            undo()
            continue
        stack.append((options(), len(path), waste))
    return best, "bound" if known <= least else "nodes" if stack else "exhausted" if whole else "listed"


def items(documents: DataFrame, capacity: int, path: str = tokens.TOKENIZER) -> DataFrame:
    """doc_id, part, tokens: a document is one item, or parts of full capacity and a rest if it alone exceeds the capacity."""
    parts = F.when(F.col("tokens") > 0, F.sequence(F.lit(0), F.ceil(F.col("tokens") / capacity).cast("int") - 1)).otherwise(F.array(F.lit(0)))
    split = tokens.sizes(documents, path).withColumn("part", F.explode(parts))
    return split.select("doc_id", "part", F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("part") * capacity).alias("tokens"))


def fill(documents: DataFrame, capacity: int, path: str = tokens.TOKENIZER, nodes: int = NODES) -> DataFrame:
    """container, doc_id, part, tokens: every document, or every part of one that exceeds the capacity, with its container.

    Documents without tokens (null and empty texts) need no room; their
    container is null. Repeated rows are documents of their own; null ids are
    kept. An empty table gives no rows.
    """
    all_items = cut(items(documents, capacity, path), "items")
    histogram = all_items.filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["tokens"]: r["n"] for r in histogram.collect()}  # at most `capacity` rows
    packing, _ = pack(counts, capacity, nodes)

    # For each size the runs of ranks that one kind of container takes: first rank, first container, times.
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken = dict.fromkeys(counts, 0)
    container = 0
    for times, content in packing:
        for size, k in content.items():
            runs.setdefault(size, []).append((taken[size], container, k))
            taken[size] += times * k
        container += times
    table = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}

    # Ranks among the items of a size, in two steps, as one size may hold most items.
    buckets = max(1, sum(counts.values()) // RANKED)
    sized = all_items.filter("tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "part"), F.lit(buckets)))
    before = sized.groupBy("tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "part")) - 1).join(before, ["tokens", "bucket"]).select("doc_id", "part", "tokens", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            out = np.empty(len(size), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, start, times = table[int(s)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                out[at] = start[i] + (rank[at] - first[i]) // times[i]
            yield pa.RecordBatch.from_arrays([pa.array(out), batch.column(0), batch.column(1), batch.column(2)], names=["container", "doc_id", "part", "tokens"])

    placed = ranked.mapInArrow(place, "container bigint, doc_id bigint, part int, tokens bigint")
    none = all_items.filter("tokens = 0").select(F.lit(None).cast("bigint").alias("container"), "doc_id", "part", "tokens")
    return placed.unionByName(none)


def capacities(limits: DataFrame, purpose: str) -> list[tuple[str, int, int]]:
    """name, capacity and overlap of the few limits of a purpose, in order of their names."""
    rows = limits.filter(F.col("purpose") == purpose).select("limit_name", "capacity_tokens", "overlap_tokens").orderBy("limit_name").collect()
    return [(r[0], int(r[1]), int(r[2] or 0)) for r in rows if r[1] and r[1] > 0]


def fill_all(documents: DataFrame, limits: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """limit_name, container, doc_id, part, tokens for each `pack` capacity."""
    frames = [fill(documents, capacity, path).select(F.lit(name).alias("limit_name"), "*") for name, capacity, _ in capacities(limits, "pack")]
    if not frames:
        return documents.sparkSession.createDataFrame([], "limit_name string, container bigint, doc_id bigint, part int, tokens bigint")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def use(documents: DataFrame, limits: DataFrame, path: str = tokens.TOKENIZER) -> DataFrame:
    """limit_name, items, containers, tokens, least, full, ended for each `pack` capacity: how well the containers are used.

    least: ceil(tokens / capacity), which no packing is below; ended: how the
    search for a better packing ended (see pack).
    """
    rows = []
    for name, capacity, _ in capacities(limits, "pack"):
        histogram = items(documents, capacity, path).filter("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
        counts = {r["tokens"]: r["n"] for r in histogram.collect()}
        packing, ended = pack(counts, capacity)
        total, containers = sum(s * n for s, n in counts.items()), sum(k for k, _ in packing)
        rows.append((name, sum(counts.values()), containers, total, -(-total // capacity), total / (containers * capacity) if containers else None, ended))
    return documents.sparkSession.createDataFrame(rows, "limit_name string, items bigint, containers bigint, tokens bigint, least bigint, full double, ended string")
