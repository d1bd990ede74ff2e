"""Molecular graph operators in long form: edges (mol_id, edge_id, a, b), positions (mol_id, atom, x, y, z)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNREACHABLE = 510


def symmetrize(edges: DataFrame) -> DataFrame:
    """(mol_id, a, b) in both directions, each once."""
    return edges.select("mol_id", "a", "b").unionByName(edges.select("mol_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _whole(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(mol_id, atoms, ends): each molecule as one row; one shuffle by molecule."""
    bonds = edges.filter("a <> b").groupBy("mol_id").agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("ends"))
    return atoms.groupBy("mol_id").agg(F.sort_array(F.collect_set(F.col("atom").cast("long"))).alias("atoms")).join(bonds, "mol_id", "left").select("mol_id", "atoms", F.col("ends.a").alias("a"), F.col("ends.b").alias("b"))


class _Paths:
    """Shortest paths of a batch of molecules, all searched breadth first at once on flat arrays.

    A pair of atoms (i, j) of molecule m has the place base[m] + i * size[m] + j; ``hops`` is -1 where
    none leads there, ``via`` the smallest predecessor of j.
    """

    def __init__(self, pdf: pd.DataFrame):
        self.size = np.array([len(x) for x in pdf["atoms"]], np.int64)
        first = np.concatenate([[0], np.cumsum(self.size)])
        self.base = np.concatenate([[0], np.cumsum(self.size**2)])
        self.label = np.concatenate([np.asarray(x, np.int64) for x in pdf["atoms"]]) if len(pdf) else np.zeros(0, np.int64)
        mol = np.repeat(np.arange(len(pdf)), self.size)
        self.local = np.arange(len(self.label)) - first[mol]
        src, dst = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m, (a, b) in enumerate(zip(pdf["a"], pdf["b"])):
            if a is not None and len(a):
                own, a, b = self.label[first[m] : first[m + 1]], np.asarray(a, np.int64), np.asarray(b, np.int64)
                x, y = np.searchsorted(own, a), np.searchsorted(own, b)
                known = (x < len(own)) & (y < len(own))
                known[known] = (own[x[known]] == a[known]) & (own[y[known]] == b[known])
                src += [first[m] + x[known], first[m] + y[known]]
                dst += [first[m] + y[known], first[m] + x[known]]
        src, dst = np.concatenate(src), np.concatenate(dst)
        order = np.argsort(src, kind="stable")
        src, dst = src[order], dst[order]
        start = np.searchsorted(src, np.arange(len(self.label) + 1))
        self.hops, self.via = np.full(self.base[-1], -1, np.int64), np.full(self.base[-1], np.iinfo(np.int64).max)
        at = np.arange(len(self.label))
        pair = self.base[mol] + self.local * self.size[mol] + self.local
        self.hops[pair] = 0
        level = 0
        while len(pair):
            level += 1
            n = start[at + 1] - start[at]
            k = np.repeat(start[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            before, after = np.repeat(at, n), dst[k]
            reached = np.repeat(pair, n) - self.local[before] + self.local[after]
            fresh = self.hops[reached] < 0
            before, after, reached = before[fresh], after[fresh], reached[fresh]
            np.minimum.at(self.via, reached, self.label[before])
            pair, once = np.unique(reached, return_index=True)
            at = after[once]
            self.hops[pair] = level

    def frame(self) -> pd.DataFrame:
        mol = np.repeat(np.arange(len(self.size)), self.size**2)
        first = np.concatenate([[0], np.cumsum(self.size)])[mol]
        i, j = np.divmod(np.arange(len(mol)) - self.base[mol], self.size[mol])
        return pd.DataFrame({"mol": mol, "i": self.label[first + i], "j": self.label[first + j], "hops": self.hops, "via": self.via})


#: Molecules whose pairs are searched together.
_TOGETHER = 2_000


def _in_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), _TOGETHER):
            yield pdf.iloc[at : at + _TOGETHER].reset_index(drop=True)


def hop_distances(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(mol_id, i, j, hops, via): shortest paths of all atom pairs; ``via`` is the smallest predecessor of j.

    One shuffle by molecule, then breadth-first search over whole batches of molecules until no pair is
    new, however long the paths. Pairs not reached have hops = 510 and a null ``via``; i = j has 0. Bonds to
    atoms that aren't listed don't count. Rows with a null mol_id or atom aren't read.
    """
    kinds, atom = dict(atoms.dtypes), dict(edges.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_batches(batches):
            x = _Paths(pdf).frame()
            none = x["hops"] <= 0
            out = pd.DataFrame({"mol_id": pdf["mol_id"].to_numpy()[x["mol"]], "i": x["i"], "j": x["j"], "hops": x["hops"].where(x["hops"] >= 0, UNREACHABLE)})
            out["via"] = x["via"].where(~none, 0).astype("Int64").mask(none)
            yield out

    whole = _whole(atoms.filter("mol_id is not null and atom is not null"), edges)
    return whole.mapInPandas(run, f"mol_id {kinds['mol_id']}, i {kinds['atom']}, j {kinds['atom']}, hops int, via {atom}")


def capped(hops: DataFrame, up: int = 20) -> DataFrame:
    return hops.withColumn("hops", F.least("hops", F.lit(up)))


def path_edges(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(mol_id, i, j, step, a, b): the bonds along each shortest path, from its end back, step 0 first.

    Of paths of equal length the one through the smallest predecessors. Paths of any length come out whole.
    """
    kinds, atom = dict(atoms.dtypes), dict(edges.dtypes)["a"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_batches(batches):
            p = _Paths(pdf)
            x = p.frame()
            first = np.concatenate([[0], np.cumsum(p.size)])
            place = np.flatnonzero(x["hops"].to_numpy() > 0)
            mol, i, j = (x[c].to_numpy()[place] for c in ("mol", "i", "j"))
            row = (place - p.base[mol]) // p.size[mol]
            end, step = j.copy(), 0
            local_of = {(m, a): k for m in range(len(p.size)) for k, a in enumerate(p.label[first[m] : first[m + 1]].tolist())}
            at = place
            live = np.arange(len(place))
            while len(live):
                prior = p.via[at[live]]
                yield pd.DataFrame({"mol_id": pdf["mol_id"].to_numpy()[mol[live]], "i": i[live], "j": j[live], "step": step, "a": prior, "b": end[live]})
                back = np.array([local_of[m, a] for m, a in zip(mol[live].tolist(), prior.tolist())], np.int64)
                at[live] = p.base[mol[live]] + row[live] * p.size[mol[live]] + back
                end[live] = prior
                live = live[p.hops[at[live]] > 0]
                step += 1

    whole = _whole(atoms.filter("mol_id is not null and atom is not null"), edges)
    return whole.mapInPandas(run, f"mol_id {kinds['mol_id']}, i {kinds['atom']}, j {kinds['atom']}, step int, a {atom}, b {atom}")


def angle_triples(edges: DataFrame) -> DataFrame:
    """(mol_id, e1, e2, i, center, j): each pair of bonds that share an atom, e1 < e2; an equi join on the atom."""
    e = edges.filter("a <> b")
    ends = e.select("mol_id", "edge_id", F.col("a").alias("center"), F.col("b").alias("tip")).unionByName(e.select("mol_id", "edge_id", F.col("b").alias("center"), F.col("a").alias("tip")))
    x = ends.select("mol_id", "center", F.col("edge_id").alias("e1"), F.col("tip").alias("i"))
    y = ends.select("mol_id", "center", F.col("edge_id").alias("e2"), F.col("tip").alias("j"))
    return x.join(y, ["mol_id", "center"]).filter("e1 < e2").select("mol_id", "e1", "e2", "i", "center", "j")


def _gap(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")) for c in "xyz"))


def _named(positions: DataFrame, atom: str, prefix: str) -> DataFrame:
    return positions.select("mol_id", F.col("atom").alias(atom), *[F.col(c).alias(prefix + c) for c in "xyz"])


def pair_distances(positions: DataFrame) -> DataFrame:
    """(mol_id, i, j, d) of all atom pairs of a molecule."""
    return _named(positions, "i", "p").join(_named(positions, "j", "q"), "mol_id").select("mol_id", "i", "j", _gap("p", "q").alias("d"))


def bond_lengths(edges: DataFrame, positions: DataFrame) -> DataFrame:
    e = edges.select("mol_id", "edge_id", F.col("a").alias("i"), F.col("b").alias("j"))
    return e.join(_named(positions, "i", "p"), ["mol_id", "i"]).join(_named(positions, "j", "q"), ["mol_id", "j"]).select("mol_id", "edge_id", _gap("p", "q").alias("d"))


def midpoints(edges: DataFrame, positions: DataFrame) -> DataFrame:
    e = edges.select("mol_id", "edge_id", F.col("a").alias("i"), F.col("b").alias("j"))
    both = e.join(_named(positions, "i", "p"), ["mol_id", "i"]).join(_named(positions, "j", "q"), ["mol_id", "j"])
    return both.select("mol_id", "edge_id", *[((F.col("p" + c) + F.col("q" + c)) / 2).alias(c) for c in "xyz"])


def edge_distances(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """(mol_id, e1, e2, d) between bond midpoints of a molecule."""
    m = midpoints(edges, positions).withColumnRenamed("edge_id", "atom")
    return pair_distances(m).select("mol_id", F.col("i").alias("e1"), F.col("j").alias("e2"), "d")


def atom_bond_distances(edges: DataFrame, positions: DataFrame) -> DataFrame:
    m = midpoints(edges, positions).withColumnRenamed("edge_id", "atom")
    return _named(positions, "atom", "p").join(_named(m, "edge_id", "q"), "mol_id").select("mol_id", "atom", "edge_id", _gap("p", "q").alias("d"))


def bond_angles(triples: DataFrame, positions: DataFrame) -> DataFrame:
    """(mol_id, e1, e2, angle) in radians; vectors over their norm + 1e-5, 0 where one is a zero vector."""
    t = triples
    for atom, p in (("i", "p"), ("center", "c"), ("j", "q")):
        t = t.join(_named(positions, atom, p), ["mol_id", atom])
    u = [F.col("p" + c) - F.col("c" + c) for c in "xyz"]
    v = [F.col("q" + c) - F.col("c" + c) for c in "xyz"]
    nu, nv = F.sqrt(sum(x * x for x in u)), F.sqrt(sum(x * x for x in v))
    cos = sum(x * y for x, y in zip(u, v)) / ((nu + 1e-5) * (nv + 1e-5))
    angle = F.when((nu == 0) | (nv == 0), F.lit(0.0)).otherwise(F.acos(F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0))))
    return t.select("mol_id", "e1", "e2", angle.alias("angle"))


def bond_type_string(a: Column, b: Column, kind: Column) -> Column:
    """Symbols in order with -, =, # or ~=, else the kind in angle brackets."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    mark = F.when(kind == "SINGLE", "-").when(kind == "DOUBLE", "=").when(kind == "TRIPLE", "#").when(kind == "AROMATIC", "~=").otherwise(F.concat(F.lit(" <"), kind, F.lit("> ")))
    return F.concat(lo, mark, hi)


def drop_contained(matches: DataFrame) -> DataFrame:
    """``matches`` (mol_id, fg_id, match_no, atoms) without those whose atoms are a strict subset of another's.

    Candidates meet through a shared atom, so only overlapping matches of a molecule are compared.
    """
    m = matches.withColumn("atoms", F.array_sort(F.array_distinct("atoms")))
    ends = m.select("mol_id", "fg_id", "match_no", "atoms", F.element_at("atoms", 1).alias("atom"))
    cover = m.select("mol_id", F.col("atoms").alias("larger"), F.explode("atoms").alias("atom"))
    inside = (F.size(F.array_except("atoms", "larger")) == 0) & (F.size("atoms") < F.size("larger"))
    gone = ends.join(cover, ["mol_id", "atom"]).filter(inside).select("mol_id", "fg_id", "match_no").distinct()
    return m.join(gone, ["mol_id", "fg_id", "match_no"], "left_anti")


def dominant_groups(atoms: DataFrame, matches: DataFrame, groups: int) -> DataFrame:
    """(mol_id, atom, fg_id, fg_index): each atom's largest match, first by (fg_id, match_no); 0 where none."""
    long = matches.select("mol_id", "fg_id", "match_no", F.size("atoms").alias("n"), F.explode("atoms").alias("atom"))
    best = long.withColumn("r", F.row_number().over(Window.partitionBy("mol_id", "atom").orderBy(F.desc("n"), "fg_id", "match_no"))).filter("r = 1")
    got = best.select("mol_id", "atom", "fg_id", (F.lit(groups) * (F.col("match_no") + 1) + F.col("fg_id")).alias("fg_index"))
    return atoms.select("mol_id", "atom").join(got, ["mol_id", "atom"], "left").select("mol_id", "atom", F.coalesce("fg_id", F.lit(0)).alias("fg_id"), F.coalesce("fg_index", F.lit(0)).alias("fg_index"))


def bond_group_scores(edges: DataFrame, matches: DataFrame, dominant: DataFrame, most: int = 3) -> DataFrame:
    """(mol_id, edge_id, score, same): 0 no group, 1 one side, 2 + shared groups (capped).

    ``same`` is 0 if the dominant groups of both ends (``dominant`` as from dominant_groups()) have one index,
    as they also have where neither end is in a group, else 1.
    """
    ids = matches.select("mol_id", "fg_id", F.explode("atoms").alias("atom")).groupBy("mol_id", "atom").agg(F.collect_set("fg_id").alias("g"))
    of = dominant.select("mol_id", "atom", "fg_index").join(ids, ["mol_id", "atom"], "left")
    e = edges.select("mol_id", "edge_id", "a", "b")
    for end in ("a", "b"):
        e = e.join(of.select("mol_id", F.col("atom").alias(end), F.col("g").alias("g" + end), F.col("fg_index").alias("x" + end)), ["mol_id", end], "left")
    shared = F.size(F.array_intersect("ga", "gb"))
    score = F.when(F.col("ga").isNull() & F.col("gb").isNull(), 0).when(F.col("ga").isNull() | F.col("gb").isNull(), 1).otherwise(2 + F.least(shared, F.lit(most)))
    return e.select("mol_id", "edge_id", score.alias("score"), F.when(F.coalesce("xa", F.lit(0)) == F.coalesce("xb", F.lit(0)), 0).otherwise(1).alias("same"))


def ring_sizes(atom_rings: DataFrame) -> DataFrame:
    """(mol_id, atom, s3 .. s8, s9): rings of each size an atom is in; larger ones under 9."""
    size = F.when(F.col("size") > 8, 9).otherwise(F.col("size"))
    return atom_rings.withColumn("s", size).groupBy("mol_id", "atom").agg(*[F.count_if(F.col("s") == k).alias(f"s{k}") for k in range(3, 10)])
