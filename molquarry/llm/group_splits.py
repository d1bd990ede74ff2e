"""Problem 6: splits that keep related records together.

Component swap search: components (all rows of one scaffold) start from a hashed assignment; whole
components are then moved or exchanged between splits by annealing, in parallel chains, to bring split
sizes and label means to their targets, and the best chain is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.smiles import Graphs, clean, parse, signed
from molquarry.operators.skew import attach_heads
from molquarry.session import materialise, spread

#: A component of more than rows / HEAVY_SHARE rows is heavy; there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 2_000
#: Light components are annealed in blocks of about this many.
BLOCK = 20_000
CHAINS = 8
LABEL_WEIGHT = 0.2


def components(rows: DataFrame, row_id: str = "row_id", text: str = "smiles", label: str = "expt") -> DataFrame:
    """(id, label, component, has_ring): the component of each row.

    With a ring: the scaffold, that is the rings of the largest part and the chains linking them, by
    elements, aromaticity and bonds. Without: the molecule itself. Null, empty and unreadable texts are
    components of their own row.
    """

    def keys(texts: list[str]) -> dict[str, tuple[int, bool]]:
        g = Graphs([parse(clean(t)) for t in texts])
        whole, atoms = g.hashes()[0], np.bincount(g.mol, minlength=g.count)
        g.ring_core()
        core, left = g.hashes()[0], np.bincount(g.mol, minlength=g.count)
        key = signed(np.where(left > 0, core, whole))
        return {t: (int(key[i]), bool(left[i])) for i, t in enumerate(texts) if atoms[i]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = keys([t for t in pdf["text"].unique() if isinstance(t, str) and t])
            found = [known.get(t) if isinstance(t, str) else None for t in pdf["text"]]
            tag = ["row" if f is None else "ring" if f[1] else "chain" for f in found]
            name = [str(i) if f is None else str(f[0]) for i, f in zip(pdf["id"], found)]
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "component": [f"{a}:{b}" for a, b in zip(tag, name)], "has_ring": [t == "ring" for t in tag]})

    kind = dict(rows.dtypes)[row_id]
    src = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    return spread(src).mapInPandas(run, f"id {kind}, label double, component string, has_ring boolean")


def anneal(n: np.ndarray, y: np.ndarray, at: np.ndarray, base_n: np.ndarray, base_y: np.ndarray, want: np.ndarray, mean: float, scale: float, seed: int, steps: int) -> tuple[np.ndarray, float]:
    """(assignment, cost) after moves and exchanges of whole components.

    ``n``, ``y``: rows and label sum of each component; ``at``: its split; ``base``: rows and label sums
    placed already; ``want``: target rows. Cost: summed relative size deviations plus LABEL_WEIGHT
    times the deviations of label means, in standard deviations.
    """
    rng = np.random.default_rng(seed)
    k, total = len(want), max(float(want.sum()), 1.0)
    rows = base_n + np.bincount(at, n, k)
    sums = base_y + np.bincount(at, y, k)

    def cost(r, s):
        size = np.abs(r - want).sum() / total
        means = np.abs(s / np.maximum(r, 1) - mean) * (r > 0)
        return size + LABEL_WEIGHT * float((means * want).sum()) / (total * scale)

    at, now = at.copy(), cost(rows, sums)
    best, best_at = now, at.copy()
    if len(n) == 0 or k < 2:
        return best_at, best
    heat, floor = max(now, 1e-3), 1e-6
    cool = (floor / heat) ** (1 / max(steps, 1))
    pick, other, to, coin = rng.integers(0, len(n), steps), rng.integers(0, len(n), steps), rng.integers(0, k, steps), rng.random((steps, 2))
    for i in range(steps):
        a, b = int(pick[i]), int(other[i])
        sa, sb = int(at[a]), int(at[b])
        swap = coin[i, 0] < 0.5 and sa != sb
        target = sb if swap else int(to[i])
        if target == sa:
            continue
        dn, dy = (n[a] - n[b], y[a] - y[b]) if swap else (n[a], y[a])
        r, s = rows.copy(), sums.copy()
        r[sa] -= dn
        r[target] += dn
        s[sa] -= dy
        s[target] += dy
        new = cost(r, s)
        if new <= now or coin[i, 1] < np.exp((now - new) / heat):
            at[a] = target
            if swap:
                at[b] = sa
            rows, sums, now = r, s, new
            if now < best:
                best, best_at = now, at.copy()
        heat *= cool
    return best_at, best


def assign(parts: DataFrame, targets: list[tuple[str, float]], seed: int = 7) -> DataFrame:
    """(component, n, first_id, split) for ``parts`` as from components().

    Heavy components (fewer than HEAVY_SHARE whatever the data) are annealed first, in CHAINS tasks of
    different seeds of which the cheapest is kept. Light ones are hashed over the room left and annealed
    in hashed blocks, each towards its share of that room; a block is never larger than its share of
    components, so no task sees them all. Shares are scaled to sum 1. Deterministic for a seed.
    """
    spark = parts.sparkSession
    names = [s for s, _ in targets]
    share = np.array([w for _, w in targets], float)
    share = share / share.sum()
    comp = materialise(
        parts.groupBy("component").agg(
            F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("y"), F.count("label").alias("ny")
        ),
        "split-components",
    )
    stats = parts.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("m"), F.stddev_pop("label").alias("s")).first()
    total, mean, scale = stats["n"], float(stats["m"] or 0.0), float(stats["s"] or 0.0) or 1.0
    # rows without a label count as rows of the mean label
    comp = comp.withColumn("y", F.col("y") + (F.col("n") - F.col("ny")) * F.lit(mean))
    heavy_rows = max(total // HEAVY_SHARE, 1)
    heavy, light = comp.filter(F.col("n") > heavy_rows), comp.filter(F.col("n") <= heavy_rows)
    want = share * total

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["n", "component"], ascending=[False, True]).reset_index(drop=True)
            number = int(pdf["chain"].iloc[0])
            n, y = pdf["n"].to_numpy(float), pdf["y"].to_numpy(float)
            rng = np.random.default_rng(seed + number)
            at, left = np.zeros(len(n), np.int64), want.copy()
            for i, size in enumerate(n):  # hashed start, but never into a split without room if another has it
                roomy = np.flatnonzero(left >= size)
                p = left[roomy] if len(roomy) else np.maximum(left, 0) + 1e-9
                j = rng.choice(roomy if len(roomy) else len(left), p=p / p.sum())
                at[i] = j
                left[j] -= size
            # light components fill what is open, so only excess counts: the rest is left as base
            slack = np.maximum(want - np.bincount(at, n, len(want)), 0)
            room = total - n.sum()
            base = slack * (room / slack.sum()) if slack.sum() else slack
            at, cost = anneal(n, y, at, base, base * mean, want, mean, scale, seed + number, steps=40_000)
            yield pd.DataFrame({"chain": number, "component": pdf["component"], "at": at, "n": n, "cost": cost})

    chains = spark.range(CHAINS).select(F.col("id").cast("int").alias("chain"))
    tried = materialise(
        heavy.crossJoin(F.broadcast(chains)).repartitionByRange(CHAINS, "chain").groupBy("chain").applyInPandas(lambda pdf: next(chain(iter([pdf]))), "chain int, component string, at long, n double, cost double"),
        "split-heavy",
    )
    cheapest = tried.groupBy("chain").agg(F.first("cost").alias("cost")).orderBy("cost", "chain").first()
    placed = tried.filter(F.col("chain") == (cheapest["chain"] if cheapest else -1)).select("component", "at")
    used = {r["at"]: r["n"] for r in tried.filter(F.col("chain") == (cheapest["chain"] if cheapest else -1)).groupBy("at").agg(F.sum("n").alias("n")).collect()}
    room = np.maximum(want - np.array([used.get(i, 0.0) for i in range(len(want))]), 0.0)
    light_rows = total - sum(used.values())
    room = room / room.sum() if room.sum() else share
    blocks = max(1, int(light.count()) // BLOCK)
    edges = np.cumsum(room)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component").reset_index(drop=True)
        n, y = pdf["n"].to_numpy(float), pdf["y"].to_numpy(float)
        at = np.minimum(np.searchsorted(edges, pdf["u"].to_numpy()), len(room) - 1)
        zero = np.zeros(len(room))
        at, _ = anneal(n, y, at, zero, zero, room * n.sum(), mean, scale, seed, steps=min(4 * len(n) + 2_000, 60_000))
        return pd.DataFrame({"component": pdf["component"], "at": at})

    hashed = light.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(blocks)))
    hashed = hashed.withColumn("u", F.pmod(F.xxhash64(F.lit(seed + 1), "component"), F.lit(1 << 30)) / float(1 << 30))
    moved = hashed.groupBy("b").applyInPandas(block, "component string, at long") if light_rows else placed.limit(0)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("at") + 1).cast("int"))
    where = placed.unionByName(moved).select("component", name.alias("split"))
    return comp.join(where, "component").select("component", "n", "first_id", "split")


class GroupedSplit:
    """Rows assigned to splits so that all rows of a component share one.

    ``rows``: (row_id, component, has_ring, n, first_id, split, label). Null labels count as the mean. A
    repeated row is in the same component. A component larger than its split's target leaves a
    deviation that report() states. An empty table gives an empty result.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, seed: int = 7):
        wanted = [(r["split"], float(r["target_share"])) for r in targets.orderBy(F.desc("target_share"), "split").collect()]
        self.targets = targets
        parts = materialise(components(rows), "split-rows")
        placed = materialise(assign(parts, wanted, seed), "split-assigned")
        self.rows = attach_heads(parts, placed, ["component"], "n").withColumnRenamed("id", "row_id")

    def sets(self) -> DataFrame:
        """(first_id, row_id): members of each scaffold but the smallest id."""
        return self.rows.filter(F.col("has_ring") & (F.col("row_id") != F.col("first_id"))).select("first_id", "row_id")

    def report(self) -> DataFrame:
        """(split, target_share, actual_share, rows, components, label_mean)."""
        got = self.rows.groupBy("split").agg(
            F.count(F.lit(1)).alias("rows"), F.sum((F.col("row_id") == F.col("first_id")).cast("long")).alias("components"), F.avg("label").alias("label_mean")
        )
        total = self.rows.agg(F.count(F.lit(1)).alias("total"))
        return self.targets.select("split", "target_share").join(got, "split", "left").crossJoin(F.broadcast(total)).select(
            "split", "target_share", (F.coalesce("rows", F.lit(0)) / F.expr("nullif(total, 0)")).alias("actual_share"),
            F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("components", F.lit(0)).alias("components"), "label_mean",
        )
