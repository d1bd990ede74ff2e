"""Problem 1: filling containers of fixed capacity.

Linear grouping: large lengths are rounded up within groups of equal cardinality; the few sizes left
are packed by configurations found with column generation; actual items then take the places of their
group, and small items fill the room left, best fit first. All of this runs on the histogram of lengths
(at most ``capacity`` numbers, whatever the data); items learn their container from their rank among
items of their length, so no task sees more than its share of items.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.session import materialise

#: Lengths above capacity / LARGE_PART are large; groups of large lengths.
LARGE_PART = 16
GROUPS = 12
#: Rows of one rank bucket, about.
RANK_ROWS = 200_000


class _Bins:
    """Runs of consecutive containers by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, start: int, n: int) -> None:
        if n > 0:
            self.runs.setdefault(room, []).append((start, n))

    def take(self, room: int, n: int) -> tuple[int, int]:
        """(start, number) of up to n containers of that room."""
        start, have = self.runs[room].pop()
        if have > n:
            self.runs[room].append((start + n, have - n))
            have = n
        if not self.runs[room]:
            del self.runs[room]
        return start, have

    def open(self, n: int) -> int:
        self.next += n
        return self.next - n


def _configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) covering a demand of few sizes: a linear program by column generation, rounded
    down; what is left is filled greedily, largest first."""
    m, sized = len(sizes), np.array(sizes)
    columns = [np.eye(m)[i] * (capacity // s) for i, s in enumerate(sizes)]
    basis = list(range(m))
    x = np.zeros(m)
    for _ in range(40 * m):
        B = np.array([columns[j] for j in basis]).T
        x = np.linalg.solve(B, demand)
        price = np.linalg.solve(B.T, np.ones(m))
        # pricing: the pattern of most value within the capacity
        value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(min(sizes), capacity + 1):
            value[c], choice[c] = value[c - 1], -2  # -2: one unit unused
            fit = np.flatnonzero(sized <= c)
            gain = value[c - sized[fit]] + price[fit]
            j = int(np.argmax(gain))
            if gain[j] > value[c] + 1e-12:
                value[c], choice[c] = gain[j], fit[j]
        c = capacity
        if value[c] <= 1 + 1e-9:
            break
        pattern = np.zeros(m)
        while c > 0 and choice[c] != -1:
            if choice[c] == -2:
                c -= 1
                continue
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
        d = np.linalg.solve(B, pattern)
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        columns.append(pattern)
        basis[leave] = len(columns) - 1
    left, out = demand.astype(np.int64).copy(), []
    for j, t in zip(basis, x):
        p = columns[j].astype(np.int64)
        n = int(np.floor(t + 1e-9))
        if p.any():
            n = min(n, *(int(left[i] // p[i]) for i in range(m) if p[i]))
        if n > 0 and p.any():
            out.append((p, n))
            left -= p * n
    while left.any():
        p, room = np.zeros(m, np.int64), capacity
        for i in sorted(range(m), key=lambda i: -sizes[i]):
            p[i] = min(left[i], room // sizes[i])
            room -= p[i] * sizes[i]
        n = min(int(left[i] // p[i]) for i in range(m) if p[i])
        out.append((p, n))
        left -= p * n
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(places, containers): places are (length, from_rank, items, first_container, items_each).

    Items of ``length`` with ranks from_rank .. from_rank + items - 1 go, items_each at a time, into
    consecutive containers. Lengths are 1 .. capacity.
    """
    bins = _Bins(capacity)
    places: list[tuple[int, int, int, int, int]] = []
    rank = dict.fromkeys(histogram, 0)
    large = sorted((s for s, n in histogram.items() if n > 0 and s * LARGE_PART > capacity), reverse=True)
    total = sum(histogram[s] for s in large)
    if total:
        # equal-cardinality groups within each halving of the capacity, largest first, so that a few very
        # large items don't round up many; a group is a list of (length, items)
        groups: list[list[list[int]]] = []
        for scale in range(LARGE_PART.bit_length()):
            own = [s for s in large if capacity < s << (scale + 1) <= 2 * capacity]
            per, now, have = -(-sum(histogram[s] for s in own) // GROUPS), [], 0
            for s in own:
                n = histogram[s]
                while n:
                    k = min(n, per - have)
                    now.append([s, k])
                    have += k
                    n -= k
                    if have == per:
                        groups.append(now)
                        now, have = [], 0
            if now:
                groups.append(now)
        sizes = [g[0][0] for g in groups]
        demand = np.array([sum(k for _, k in g) for g in groups], float)
        merged: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):  # groups of one rounded size share it
            merged.setdefault(s, []).append(i)
        keys = list(merged)
        need = np.array([sum(demand[i] for i in merged[s]) for s in keys])
        queue = {s: [list(x) for i in merged[s] for x in groups[i]] for s in keys}
        for pattern, times in _configurations(keys, need, capacity):
            start = bins.open(times)
            runs = [(start, times, capacity)]
            for i, s in enumerate(keys):
                for _ in range(int(pattern[i])):
                    fresh = []
                    for at, n, room in runs:  # substitute actual items for this slot
                        while n:
                            length, have = queue[s][0]
                            k = min(have, n)
                            places.append((length, rank[length], k, at, 1))
                            rank[length] += k
                            fresh.append((at, k, room - length))
                            queue[s][0][1] -= k
                            if queue[s][0][1] == 0:
                                queue[s].pop(0)
                            at, n = at + k, n - k
                    runs = fresh
            for at, n, room in runs:
                bins.put(room, at, n)
    for s in sorted((s for s, n in histogram.items() if n > 0 and s * LARGE_PART <= capacity), reverse=True):
        n = histogram[s]
        rooms = [r for r in bins.runs if r >= s]
        heapq.heapify(rooms)
        while n and rooms:
            r = rooms[0]
            if r not in bins.runs:
                heapq.heappop(rooms)
                continue
            each = min(r // s, n)
            at, k = bins.take(r, n // each)
            places.append((s, rank[s], k * each, at, each))
            rank[s] += k * each
            n -= k * each
            bins.put(r - each * s, at, k)
        while n:
            each = min(capacity // s, n)
            k = n // each
            at = bins.open(k)
            places.append((s, rank[s], k * each, at, each))
            rank[s] += k * each
            n -= k * each
            bins.put(capacity - each * s, at, k)
    return places, bins.next


def _pieces(items: DataFrame, capacity: int) -> DataFrame:
    """Items over the capacity as full pieces and a rest; others as one piece."""
    over = F.greatest(F.ceil(F.col("length") / F.lit(float(capacity))), F.lit(1)).cast("int")
    long = items.withColumn("pieces", over).withColumn("piece", F.explode(F.sequence(F.lit(1), "pieces")))
    size = F.when(F.col("piece") < F.col("pieces"), F.lit(capacity)).otherwise(F.col("length") - (F.col("pieces") - 1) * capacity)
    return long.withColumn("size", size.cast("int")).drop("pieces")


def pack(items: DataFrame, item_id: str, length: str, capacity: int) -> DataFrame:
    """(id, piece, length, batch): the container of each item, or of each piece of one over the capacity.

    The sum of lengths in a container is at most the capacity. Null and negative lengths have no batch
    (one row, batch null, piece 1); length 0 takes no room and goes to batch 0. Equal lengths are ranked
    by id, and repeated ids are each packed. Batches are numbered from 0. Other columns aren't read. An
    empty table gives an empty result; a capacity below 1 is refused.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    src = items.select(F.col(item_id).alias("item"), F.col(length).cast("int").alias("length"))
    good = _pieces(src.filter("length > 0"), capacity)
    counts = good.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {int(r["size"]): int(r["n"]) for r in counts}
    places, _ = plan(histogram, capacity)
    spark = items.sparkSession
    buckets = max(1, sum(histogram.values()) // RANK_ROWS)
    good = good.withColumn("bucket", F.pmod(F.xxhash64("item", "piece"), F.lit(buckets)).cast("int"))
    within = Window.partitionBy("size", "bucket").orderBy("item", "piece")
    ranked = good.withColumn("r", F.row_number().over(within) - 1)
    if buckets > 1:  # ranks within a length that may hold any share of the items: buckets plus offsets
        per = good.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = per.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("size", "bucket", "offset")
        ranked = ranked.join(offsets, ["size", "bucket"]).withColumn("rank", F.col("r") + F.col("offset"))
    else:
        ranked = ranked.withColumn("rank", F.col("r").cast("long"))
    # the plan is broadcast: its rows are bounded by the capacity, not by the items
    rows = pd.DataFrame(places, columns=["size", "from_rank", "items", "start", "each"]).sort_values(["size", "from_rank"])
    nested = [(int(s), [int(v) for v in g["from_rank"]], [int(v) for v in g["start"]], [int(v) for v in g["each"]]) for s, g in rows.groupby("size")]
    table = spark.createDataFrame(nested, "size int, froms array<long>, starts array<long>, eachs array<int>")

    @F.pandas_udf("long")
    def place(rank: pd.Series, size: pd.Series, froms: pd.Series, starts: pd.Series, eachs: pd.Series) -> pd.Series:
        out = np.zeros(len(rank), np.int64)
        for s, at in size.groupby(size).groups.items():
            k = rank.index.get_indexer(at)
            f, st, e = (np.asarray(c.iloc[k[0]]) for c in (froms, starts, eachs))
            r = rank.to_numpy()[k]
            j = np.searchsorted(f, r, side="right") - 1
            out[k] = st[j] + (r - f[j]) // e[j]
        return pd.Series(out)

    placed = ranked.join(F.broadcast(table), "size").withColumn("batch", place("rank", "size", "froms", "starts", "eachs"))
    out = placed.select("item", "piece", F.col("size").alias("length"), "batch")
    rest = src.filter("length is null or length <= 0").select(
        "item", F.lit(1).alias("piece"), "length", F.when(F.col("length") == 0, F.lit(0).cast("long")).alias("batch")
    )
    return out.unionByName(rest).withColumnRenamed("item", item_id)


def packed_fields(items: DataFrame, item_id: str, capacities: dict[str, int]) -> DataFrame:
    """pack() for each field: (field, id, piece, length, batch)."""
    out = None
    for field, capacity in sorted(capacities.items()):
        one = pack(items, item_id, field, capacity).select(F.lit(field).alias("field"), item_id, "piece", "length", "batch")
        out = one if out is None else out.unionByName(one)
    return out


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(field, capacity, items, batches, least_batches, fill): least is the sum of lengths over capacity."""
    p = packed.filter("batch is not null").groupBy("field").agg(
        F.count(F.lit(1)).alias("items"), (F.max("batch") + 1).alias("batches"), F.sum("length").alias("total")
    )
    c = capacities.select(F.col("field_name").alias("field"), "capacity")
    return p.join(F.broadcast(c), "field").select(
        "field", "capacity", "items", "batches", F.ceil(F.col("total") / F.col("capacity").cast("double")).alias("least_batches"),
        (F.col("total") / (F.col("batches") * F.col("capacity"))).alias("fill"),
    )
