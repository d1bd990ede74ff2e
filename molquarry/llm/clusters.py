"""Problem 2: grouping records into similarity clusters.

An approximate nearest-neighbour graph by neighbour descent, then modularity-based communities, each
described by its size and by its members of highest internal weighted degree.

Records of equal vectors are one node. Nodes are ordered by MinHash several times over; each ordering
puts similar nodes side by side, and neighbour descent runs within windows of it. Nodes linked by at least
the must-link similarity are contracted to sets, which no step parts. On the graph of sets, with all links
of at least WEAK as weights, levels of local moving on modularity and contraction give the communities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.llm.vectors import Bits, packed
from molquarry.operators.skew import attach_heads
from molquarry.session import materialise, parallelism, spread

WIDTH = 2048
NEIGHBOURS = 10
ORDERINGS = 10
#: Rows of one window of neighbour descent.
WINDOW_ROWS = 4_096
ROUNDS = 3
#: Least similarity of a link; also the one from which records must not be parted.
LINK = 0.6
#: Least similarity of a link that counts for modularity; unrelated fingerprints of this width stay below.
WEAK = 0.3
#: Rows on either side that are compared where they agree in the first two MinHash values.
MATES = 96
TYPICAL = 5


def minhash_keys(bits: Bits, orderings: int, length: int = 4, seed: int = 17) -> list[list[bytes]]:
    """For each ordering, the key of each row: ``length`` MinHash values as bytes."""
    rng = np.random.default_rng(seed)
    n = len(bits)
    dense = np.unpackbits(bits.words.view(np.uint8).reshape(n, -1), axis=1).astype(bool)
    rows, cols = np.nonzero(dense)
    starts = np.searchsorted(rows, np.arange(n))
    out = []
    for _ in range(orderings):
        parts = []
        for _ in range(length):
            value = rng.permutation(dense.shape[1]).astype(np.uint16)
            parts.append(np.minimum.reduceat(value[cols], starts).astype(">u2") if n else np.zeros(0, ">u2"))
        joined = np.ascontiguousarray(np.stack(parts, 1))
        out.append([joined[i].tobytes() for i in range(n)])
    return out


def neighbour_descent(bits: Bits, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, similarities) of each row, best first, among the rows given.

    Starts from the rows beside it in the given order and random ones; each round joins a row with the
    neighbours of its neighbours and with rows that have it as one, and keeps the best k.
    """
    n = len(bits)
    k = min(k, max(n - 1, 0))
    if k == 0:
        return np.full((n, 0), -1, np.int64), np.zeros((n, 0), np.float32)
    rng = np.random.default_rng(seed)
    coarse = bits.coarse()
    near = np.full((n, k), -1, np.int64)
    sims = np.full((n, k), -2.0, np.float32)
    at = np.arange(n)
    side = np.concatenate([np.arange(1, k // 2 + 2), -np.arange(1, k // 2 + 2)])
    first = np.concatenate([at[:, None] + side[None], rng.integers(0, n, (n, 4))], 1)
    first = np.where((first < 0) | (first >= n), rng.integers(0, n, first.shape), first)
    near, sims, _ = _keep(coarse, at, near, sims, first)
    for _ in range(rounds):
        # reverse neighbours, at most k of each row, by hashed order
        src, dst = np.repeat(at, k), near.ravel()
        good = dst >= 0
        src, dst = src[good], dst[good]
        order = np.lexsort((rng.random(len(dst)), dst))
        src, dst = src[order], dst[order]
        slot = np.arange(len(dst)) - np.searchsorted(dst, dst, side="left")
        reverse = np.full((n, k), -1, np.int64)
        reverse[dst[slot < k], slot[slot < k]] = src[slot < k]
        pool = np.concatenate([near[:, : k // 2], reverse[:, : k // 2]], 1)
        # rows without any similar neighbour so far have nothing to descend by
        hopeful = np.flatnonzero(sims.max(1) > 0.3)
        if not len(hopeful):
            break
        wide = np.where(pool[hopeful][:, :, None] >= 0, pool[np.maximum(pool[hopeful], 0)], -1).reshape(len(hopeful), -1)
        near[hopeful], sims[hopeful], changed = _keep(coarse, hopeful, near[hopeful], sims[hopeful], wide)
        if changed < 0.01 * len(hopeful):
            break
    flat = near >= 0
    r, c = np.nonzero(flat)
    sims[r, c] = bits.sims(bits, r, near[r, c])
    return near, sims


def prefix_mates(bits: Bits, prefix: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, similarity) of rows up to MATES apart with equal prefixes, of at least ``least``."""
    coarse, n = bits.coarse(), len(bits)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    for d in range(1, min(MATES, n - 1) + 1):
        a = np.flatnonzero(prefix[:-d] == prefix[d:])
        if not len(a):
            break
        a = a[coarse.sims(coarse, a, a + d) >= 0.75 * least]  # folded vectors are near what they were
        s = bits.sims(bits, a, a + d)
        good = s >= least
        out.append((a[good], a[good] + d, s[good]))
    return tuple(np.concatenate(x) for x in zip(*out))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row reachable from each of n rows by links (a, b)."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _keep(bits: Bits, rows: np.ndarray, near: np.ndarray, sims: np.ndarray, cand: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Merge candidates into the best lists of ``rows``; also how many entries changed."""
    k = near.shape[1]
    cand = np.where(cand == rows[:, None], -1, cand)
    cand = np.sort(cand, axis=1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    known = (cand[:, :, None] == near[:, None, :]).any(2)
    cand = np.where(known, -1, cand)
    r, c = np.nonzero(cand >= 0)
    s = np.full(cand.shape, -2.0, np.float32)
    s[r, c] = bits.sims(bits, rows[r], cand[r, c])
    all_i, all_s = np.concatenate([near, cand], 1), np.concatenate([sims, s], 1)
    top = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
    changed = int((top >= k).sum())
    return np.take_along_axis(all_i, top, 1), np.take_along_axis(all_s, top, 1), changed


def _nodes(records: DataFrame, mol_id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): (id, node) of usable records; (node, vec, copies) of different vectors."""
    vectors = materialise(packed(records, mol_id, column, "bits", WIDTH), "cluster-vectors")
    nodes = vectors.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = materialise(nodes, "cluster-nodes")
    many = nodes.filter("copies > 1")
    hot = attach_heads(vectors, many, ["vec"], "copies").select("id", "node")
    alone = nodes.filter("copies = 1").select(F.col("node").alias("id"), "node")
    return alone.unionByName(hot), nodes


def _ordered(nodes: DataFrame, kind: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = minhash_keys(Bits.from_bytes(list(pdf["vec"])), ORDERINGS)
            for j, k in enumerate(keys):
                yield pd.DataFrame({"ordering": j, "key": k, "node": pdf["node"], "vec": pdf["vec"]})

    return nodes.select("node", "vec").mapInPandas(run, f"ordering int, key binary, node {kind}, vec binary")


class Clusters:
    """Sets of similar records and at most ``most`` clusters of them.

    ``sets``: (mol_id, set_id), the set of each record with a usable vector, named by its smallest
    member's id; ``links``: (a, b, sim) of nodes. Null and all-zero vectors, and such of another length,
    are in no set; in members() they form one cluster of their own, the last. Equal vectors are one node
    however many records share it. Empty tables give empty results.
    """

    def __init__(self, records: DataFrame, mol_id: str = "mol_id", column: str = "morgan2048_fp", link: float = LINK):
        kind = dict(records.dtypes)[mol_id]
        self.ids = records.select(F.col(mol_id).alias("mol_id"))
        rows, nodes = _nodes(records, mol_id, column)
        spark = records.sparkSession
        parts = max(parallelism(spark) * 2, nodes.rdd.getNumPartitions())
        ordered = _ordered(nodes, kind).withColumn("salt", F.xxhash64("node"))

        def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Windows of one ordering: links, and in the first ordering must-link sets of the window (tag 1)."""
            for pdf in batches:
                for ordering, own in pdf.groupby("ordering", sort=False):
                    for at in range(0, len(own), WINDOW_ROWS):
                        part = own.iloc[at : at + WINDOW_ROWS]
                        names, bits = part["node"].to_numpy(), Bits.from_bytes(list(part["vec"]))
                        near, sims = neighbour_descent(bits)
                        r, c = np.nonzero((near >= 0) & (sims >= WEAK))
                        must = sims[r, c] >= link - 1e-6
                        label = joined(len(part), r[must], near[r, c][must])
                        x, y, z = prefix_mates(bits, part["prefix"].to_numpy(), WEAK)
                        apart = label[x] != label[y]  # mates that neighbours join already say nothing new
                        x, y, z = x[apart], y[apart], z[apart]
                        a, b, w = np.concatenate([r, x]), np.concatenate([near[r, c], y]), np.concatenate([sims[r, c], z])
                        lo, hi = np.minimum(a, b), np.maximum(a, b)
                        _, once = np.unique(lo * len(part) + hi, return_index=True)
                        lo, hi, w = lo[once], hi[once], w[once]
                        swap = names[lo] > names[hi]
                        x, y = np.where(swap, names[hi], names[lo]), np.where(swap, names[lo], names[hi])
                        out = [pd.DataFrame({"a": x, "b": y, "sim": w.astype(float), "tag": 0})]
                        if ordering == 0:
                            must = w >= link - 1e-6
                            label = joined(len(part), lo[must], hi[must])
                            low = names.copy()
                            np.minimum.at(low, label, names)
                            out.append(pd.DataFrame({"a": names, "b": low[label], "sim": 0.0, "tag": 1}))
                        yield pd.concat(out)

        prefix = F.substring("key", 1, 4)  # two MinHash values
        ranged = ordered.repartitionByRange(parts, "ordering", "key", "salt").sortWithinPartitions("ordering", "key", "salt")
        ranged = ranged.select("ordering", "node", "vec", F.conv(F.hex(prefix), 16, 10).cast("long").alias("prefix"))
        found = materialise(ranged.mapInPandas(descend, f"a {kind}, b {kind}, sim double, tag int"), "cluster-graph")
        self.links = materialise(found.filter("tag = 0").groupBy("a", "b").agg(F.max("sim").alias("sim")), "cluster-links")
        window = found.filter("tag = 1").select(F.col("a").alias("node"), F.col("b").alias("community"))
        # contract: must-links between the sets of windows
        root = merge_connected(self._between(window, self.links.filter(F.col("sim") >= link - 1e-6)).select("x", "y"), kind)
        sets = window.join(root, window["community"] == root["x"], "left").select("node", F.coalesce("root", "community").alias("set_id"))
        sets = materialise(sets, "cluster-must")
        groups = self._communities(sets, kind)
        merged = sets.join(groups, sets["set_id"] == groups["x"], "left").select("node", "set_id", F.coalesce("group_id", "set_id").alias("group_id"))
        self.nodes = materialise(merged.join(nodes.select("node", "copies"), "node"), "cluster-sets")
        self.members_of_nodes, self.vectors = rows, nodes.select("node", "vec")
        # only nodes that share a set, or copies, need their rows looked up
        self.sets = self._sets(rows)

    @staticmethod
    def _between(label: DataFrame, links: DataFrame) -> DataFrame:
        """(x, y, w): links (a, b, sim) summed by the labels (node, label) of their ends, where these differ."""
        name = label.columns[1]
        la = label.select(F.col("node").alias("a"), F.col(name).alias("ca"))
        lb = label.select(F.col("node").alias("b"), F.col(name).alias("cb"))
        across = links.join(la, "a").join(lb, "b").filter("ca != cb")
        return materialise(across.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("sim").alias("w")), "cluster-contracted")

    def _communities(self, sets: DataFrame, kind: str) -> DataFrame:
        """(x, group_id): the community of each set that has weaker links to others.

        Levels of local moving over the whole contracted graph, each on the communities of the one before,
        until a level joins nothing more. Links within a set or community count for its degree.
        """
        links = self._between(sets, self.links)
        if links.isEmpty():
            return sets.sparkSession.createDataFrame([], f"x {kind}, group_id {kind}")
        ends = self.links.select(F.col("a").alias("node"), "sim").unionByName(self.links.select(F.col("b").alias("node"), "sim"))
        degree = materialise(ends.join(sets, "node").groupBy(F.col("set_id").alias("x")).agg(F.sum("sim").alias("k")), "cluster-degrees")
        total = degree.agg(F.sum("k")).first()[0]
        group = None
        while True:
            label = move_all(links, degree, total)
            changed = label.filter("x != c").limit(1).count() > 0
            if group is None:
                group = label.select("x", F.col("c").alias("group_id"))
            elif changed:
                up = label.select(F.col("x").alias("group_id"), F.col("c").alias("upper"))
                group = materialise(group.join(up, "group_id", "left").select("x", F.coalesce("upper", "group_id").alias("group_id")), "cluster-groups")
            if not changed:
                return group
            links = self._between(label.select(F.col("x").alias("node"), "c"), links.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("w").alias("sim")))
            degree = materialise(degree.join(label, "x", "left").groupBy(F.coalesce("c", "x").alias("x")).agg(F.sum("k").alias("k")), "cluster-degrees")

    def _sets(self, rows: DataFrame) -> DataFrame:
        return attach_heads(rows, self.nodes, ["node"], "copies").select(F.col("id").alias("mol_id"), "set_id", "group_id", "node")

    def found(self) -> DataFrame:
        """(first_id, mol_id): members of each set of at least three records but the smallest id."""
        sizes = self.nodes.groupBy("set_id").agg(F.sum("copies").alias("n"), F.min("node").alias("first_id")).filter("n >= 3")
        big = attach_heads(self.nodes.select("node", "set_id"), sizes, ["set_id"], "n").select("node", "first_id", "n")
        per_node = big.join(self.nodes.select("node", "copies"), "node")
        rows = attach_heads(self.members_of_nodes, per_node.select("node", "first_id", "copies"), ["node"], "copies")
        return rows.filter(F.col("id") != F.col("first_id")).select("first_id", F.col("id").alias("mol_id"))

    def _ranked(self) -> DataFrame:
        """Nodes with ``degree``, their internal weighted degree; copies weigh as links of similarity 1."""
        ends = self.links.select(F.col("a").alias("node"), "b", "sim").unionByName(self.links.select(F.col("b").alias("node"), F.col("a").alias("b"), "sim"))
        other = self.nodes.select(F.col("node").alias("b"), F.col("copies").alias("times"))
        degree = ends.join(other, "b").groupBy("node").agg(F.sum(F.col("sim") * F.col("times")).alias("d"))
        return self.nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("d", F.lit(0.0)) + F.col("copies") - 1).drop("d")

    def cluster_of_groups(self, most: int) -> DataFrame:
        """(group_id, cluster_id, n): every community of two or more records is a cluster of its own if ``most`` allows.

        Where there are too many communities, the largest get clusters (all but a tenth of ``most``), and
        each other one joins the cluster whose center is most similar to its own; centers are the members
        of highest degree. Single records join the most similar of a sample of themselves, one for each
        cluster left. The last cluster is kept for records without a usable vector.
        """
        if most < 3:
            raise ValueError("at least three clusters are needed")
        sizes = materialise(self.nodes.groupBy("group_id").agg(F.sum("copies").alias("n")), "cluster-sizes")
        several = sizes.filter("n > 1").count()
        own = several if several <= most - 2 else most - max(1, most // 10) - 1
        shared = most - own - 1
        top = sizes.filter("n > 1").orderBy(F.desc("n"), "group_id").limit(own)
        top = top.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.desc("n"), "group_id")))  # at most ``most`` rows
        top = materialise(top.select("group_id", "cluster_id", "n"), "cluster-own")
        alone = sizes.filter("n = 1")
        lead = alone.orderBy(F.xxhash64("group_id"), "group_id").limit(shared)  # at most ``most`` rows
        lead = lead.withColumn("cluster_id", F.lit(own) + F.row_number().over(Window.orderBy(F.xxhash64("group_id"), "group_id")))
        lead = materialise(lead.select("group_id", "cluster_id", "n"), "cluster-lead")
        rest = alone.join(F.broadcast(lead.select("group_id")), "group_id", "left_anti")
        out = top.unionByName(lead).unionByName(materialise(self._nearest(rest, lead), "cluster-single"))
        if several > own:
            beyond = sizes.filter("n > 1").join(F.broadcast(top.select("group_id")), "group_id", "left_anti")
            out = out.unionByName(materialise(self._nearest(beyond, top), "cluster-beyond"))
        return out

    def _nearest(self, groups: DataFrame, top: DataFrame) -> DataFrame:
        """(group_id, cluster_id, n): for each of ``groups``, the cluster of ``top`` with the most similar center."""
        best = F.min(F.struct((-F.col("degree")).alias("by"), F.col("node").alias("node")))
        heads = self._ranked().join(groups.select("group_id").unionByName(top.select("group_id")), "group_id", "left_semi")
        heads = heads.groupBy("group_id").agg(best.alias("x")).select("group_id", F.col("x.node").alias("node"))
        heads = materialise(heads.join(self.vectors, "node").select("group_id", "vec"), "cluster-centers")
        centers = heads.join(F.broadcast(top), "group_id").orderBy("cluster_id").select("cluster_id", "vec").toPandas()  # at most ``most`` rows
        sent = groups.sparkSession.sparkContext.broadcast((centers["cluster_id"].to_numpy(), list(centers["vec"])))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, vecs = sent.value
            of = Bits.from_bytes(vecs)
            for pdf in batches:
                ask = Bits.from_bytes(list(pdf["vec"]))
                near, high = np.zeros(len(ask), np.int64), np.full(len(ask), -1.0, np.float32)
                for at in range(0, len(of), 512):
                    s = ask.cross(of.take(np.arange(at, min(at + 512, len(of)))))
                    here = s.argmax(1)
                    value = s[np.arange(len(ask)), here]
                    near, high = np.where(value > high, at + here, near), np.maximum(high, value)
                yield pd.DataFrame({"group_id": pdf["group_id"], "cluster_id": names[near], "n": pdf["n"]})

        asked = spread(heads.join(groups, "group_id").select("group_id", "vec", "n"))
        return asked.mapInPandas(run, f"group_id {dict(groups.dtypes)['group_id']}, cluster_id int, n long")

    def sharing(self, most: int) -> int:
        """How many communities of two or more records don't have a cluster of their own."""
        per = self.cluster_of_groups(most).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("sets"), F.sum((F.col("n") > 1).cast("long")).alias("several"))
        return per.filter("sets > 1").agg(F.coalesce(F.sum("several"), F.lit(0))).first()[0]

    def members(self, most: int) -> DataFrame:
        """(mol_id, set_id, cluster_id): each record once; at most ``most`` clusters."""
        named = attach_heads(self.sets.select("mol_id", "set_id", "group_id"), self.cluster_of_groups(most), ["group_id"], "n").select("mol_id", "set_id", "cluster_id")
        none = self.ids.join(named.select("mol_id"), "mol_id", "left_anti")
        return named.unionByName(none.select("mol_id", F.lit(None).cast(dict(named.dtypes)["set_id"]).alias("set_id"), F.lit(most).alias("cluster_id")))

    def describe(self, most: int) -> DataFrame:
        """(cluster_id, records, sets, typical): typical are the ids of highest internal weighted degree.

        Copies weigh as links of similarity 1; ties go to the smaller id.
        """
        placed = attach_heads(self._ranked(), self.cluster_of_groups(most), ["group_id"], "n")
        placed = materialise(placed.select("cluster_id", "node", "copies", "set_id", "degree"), "cluster-placed")
        # the best few of each (cluster, salt), then of each cluster; no list holds more
        order = Window.partitionBy("cluster_id", F.pmod(F.xxhash64("node"), F.lit(64))).orderBy(F.desc("degree"), "node")
        few = placed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TYPICAL)
        best = F.struct((-F.col("degree")).alias("by"), F.col("node").alias("node"))
        typical = few.groupBy("cluster_id").agg(F.transform(F.slice(F.sort_array(F.collect_list(best)), 1, TYPICAL), lambda x: x["node"]).alias("typical"))
        size = placed.groupBy("cluster_id").agg(F.sum("copies").alias("records"), F.count_if(F.col("node") == F.col("set_id")).alias("sets"))
        return size.join(typical, "cluster_id").select("cluster_id", "records", "sets", "typical")


def move_all(links: DataFrame, degree: DataFrame, total: float, rounds: int = 8) -> DataFrame:
    """(x, c): the community of each end of ``links`` (x, y, w) by parallel local moving on modularity.

    ``degree``: (x, k), ``total``: the sum of all degrees. In each round the nodes of one hashed half move to
    the neighbouring community of most gain, w(u, C) - k(u) * k(C) / 2m; the halves alternate, so that two
    nodes don't swap for ever. A community is named by one of its members.
    """
    both = links.select("x", "y", "w").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "w"))
    both = materialise(both, "moving-links")
    label = materialise(both.select("x").distinct().join(degree, "x").withColumn("c", F.col("x")), "moving-labels")
    still = 0
    for r in range(rounds):
        mass = label.groupBy("c").agg(F.sum("k").alias("mass"))
        of = label.select(F.col("x").alias("y"), "c")
        reach = both.join(of, "y").groupBy("x", "c").agg(F.sum("w").alias("w"))
        own = label.select("x", "k", F.col("c").alias("mine"))
        reach = reach.unionByName(label.select("x", "c", F.lit(0.0).alias("w"))).groupBy("x", "c").agg(F.sum("w").alias("w"))
        scored = reach.join(mass, "c").join(own, "x")
        gain = F.col("w") - F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / F.lit(total)
        scored = scored.withColumn("gain", gain)
        best = scored.groupBy("x").agg(F.max(F.struct(F.round("gain", 9).alias("g"), (F.col("c") == F.col("mine")).alias("stay"), F.col("c").alias("c"))).alias("b"), F.first("k").alias("k"), F.first("mine").alias("mine"))
        turn = F.pmod(F.xxhash64("x"), F.lit(2)) == r % 2
        moved = materialise(best.select("x", "k", F.when(turn, F.col("b.c")).otherwise(F.col("mine")).alias("c"), "mine"), "moving-labels")
        still = still + 1 if moved.filter("c != mine").limit(1).count() == 0 else 0
        label = moved.select("x", "k", "c")
        if still == 2:
            break
    return label.select("x", "c")


def merge_connected(pairs: DataFrame, kind: str) -> DataFrame:
    """(x, root): the smallest id reachable from each end of ``pairs`` (x, y), by label passing with jumps."""
    both = materialise(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))), "merge-edges")
    label = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("root"))
    label = materialise(label, "merge-labels")
    while True:  # each round at least halves the way to a root
        seen = label.select(F.col("x").alias("y"), F.col("root").alias("r"))
        low = both.join(seen, "y").groupBy("x").agg(F.min("r").alias("low"))
        step = label.join(low, "x").select("x", F.least("root", "low").alias("root"))
        up = step.select(F.col("x").alias("root"), F.col("root").alias("upper"))
        jumped = materialise(step.join(up, "root", "left").select("x", F.coalesce("upper", "root").alias("new"), F.col("root")), "merge-labels")
        fresh = jumped.select("x", F.col("new").alias("root"))
        old = label.select("x", F.col("root").alias("was"))
        if fresh.join(old, "x").filter("root != was").limit(1).count() == 0:
            return fresh
        label = fresh
