"""Molecule records from SMILES: atoms, bonds, scaffold keys, neighbourhood fingerprints, shape descriptors.

These rest on the project's own reader. Scaffold keys and fingerprints are stable hashes, not the texts or
bits of any chemistry toolkit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from molquarry.functions.smiles import ELEMENTS, Graphs, clean, parse, signed
from molquarry.session import spread

FP_BITS, FP_RADIUS = 2048, 2


def _source(rows: DataFrame, row_id: str, text: str) -> tuple[DataFrame, str]:
    src = rows.filter(F.col(text).isNotNull()).select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    return spread(src), dict(rows.dtypes)[row_id]


def sizes(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, n_atoms, n_bonds) of each row whose text is a SMILES; hydrogens count only where written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mols = [parse(clean(t)) for t in pdf["text"]]
            ok = [m is not None for m in mols]
            yield pd.DataFrame({"id": pdf["id"][ok], "n_atoms": [len(m.element) for m in mols if m], "n_bonds": [len(m.bonds) for m in mols if m]})

    src, kind = _source(rows, row_id, text)
    return src.mapInPandas(run, f"id {kind}, n_atoms int, n_bonds int").withColumnRenamed("id", row_id)


def records(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """One nested record for each readable row: atoms (element, aromatic, degree, in_ring) and bonds (a, b, order, ring).

    Rows that aren't SMILES are dropped, as invalid molecules are. A molecule without bonds gets self loops.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["text"]):
                m = parse(clean(t))
                if m is None:
                    continue
                n = len(m.element)
                bonds = m.bonds or [(k, k, 0, False) for k in range(n)]
                degree, ring = np.zeros(n, int), np.zeros(n, bool)
                for a, b, _, r in m.bonds:
                    degree[[a, b]] += 1
                    ring[[a, b]] |= r
                out.append((i, [ELEMENTS[e - 1] if e else "*" for e in m.element], m.aromatic, degree.tolist(), ring.tolist(), [{"a": a, "b": b, "order": o, "ring": bool(r)} for a, b, o, r in bonds]))
            yield pd.DataFrame(out, columns=["id", "element", "aromatic", "degree", "in_ring", "bonds"])

    src, kind = _source(rows, row_id, text)
    schema = f"id {kind}, element array<string>, aromatic array<boolean>, degree array<int>, in_ring array<boolean>, bonds array<struct<a:int,b:int,`order`:int,ring:boolean>>"
    return src.mapInPandas(run, schema).withColumnRenamed("id", row_id)


def scaffolds(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, scaffold): a key of the ring core; invalid texts give invalid_{id}, ringless ones none_{id}."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            mols = [parse(clean(t)) for t in pdf["text"]]
            g = Graphs(mols)
            g.ring_core()
            key, left = signed(g.hashes()[0]), np.bincount(g.mol, minlength=g.count)
            name = [f"invalid_{i}" if m is None else f"{k}" if n else f"none_{i}" for i, m, k, n in zip(pdf["id"], mols, key, left)]
            yield pd.DataFrame({"id": pdf["id"], "scaffold": name})

    src, kind = _source(rows, row_id, text)
    return src.mapInPandas(run, f"id {kind}, scaffold string").withColumnRenamed("id", row_id)


def fingerprints(rows: DataFrame, row_id: str, text: str, bits: int = FP_BITS, radius: int = FP_RADIUS) -> DataFrame:
    """(row_id, on): positions set by the neighbourhoods of radius 0 .. ``radius`` of the largest part, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = Graphs([parse(clean(t)) for t in pdf["text"]])
            _, colours = g.hashes(radii=tuple(range(1, radius + 1)))
            layers = [(g.elem * 2 + g.arom).astype(np.uint64), *colours]
            pairs = np.unique(np.concatenate([np.stack([g.mol, (c % np.uint64(bits)).astype(np.int64)], 1) for c in layers]), axis=0) if len(g.mol) else np.zeros((0, 2), np.int64)
            ends = np.searchsorted(pairs[:, 0], np.arange(g.count + 1))
            yield pd.DataFrame({"id": pdf["id"], "on": [pairs[ends[i] : ends[i + 1], 1].astype(np.int32) for i in range(g.count)]})

    src, kind = _source(rows, row_id, text)
    return src.mapInPandas(run, f"id {kind}, `on` array<int>").withColumnRenamed("id", row_id)


def shape_descriptors(positions: DataFrame) -> DataFrame:
    """(mol_id, pmi1 .. pmi3, npr1, npr2, gyration, inertial_shape, eccentricity, asphericity, spherocity).

    From positions (mol_id, atom, x, y, z, mass): sums of moments in the JVM, then the eigenvalues of the
    3 x 3 inertia and gyration tensors for whole Arrow batches. Degenerate molecules give zeros.
    """
    w = {f"s{a}": F.sum(F.col("mass") * F.col(a)) for a in "xyz"} | {f"s{a}{b}": F.sum(F.col("mass") * F.col(a) * F.col(b)) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    s = positions.groupBy("mol_id").agg(F.sum("mass").alias("m"), *[v.alias(k) for k, v in w.items()])
    names = ("pmi1", "pmi2", "pmi3", "npr1", "npr2", "gyration", "inertial_shape", "eccentricity", "asphericity", "spherocity")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            m = np.maximum(p["m"].to_numpy(), 1e-12)
            c = np.stack([p[f"s{a}"].to_numpy() / m for a in "xyz"], 1)
            cov = np.zeros((len(p), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    cov[:, i, j] = p["s" + "".join(sorted(a + b))].to_numpy() - m * c[:, i] * c[:, j]
            trace = np.trace(cov, axis1=1, axis2=2)
            inertia = np.eye(3)[None] * trace[:, None, None] - cov
            e = np.maximum(np.linalg.eigvalsh(inertia), 0) if len(p) else np.zeros((0, 3))
            g = np.maximum(np.linalg.eigvalsh(cov / m[:, None, None]), 0) if len(p) else np.zeros((0, 3))
            div = lambda x, y: np.where(y > 1e-12, x / np.where(y > 1e-12, y, 1), 0.0)
            out = np.stack([
                e[:, 0], e[:, 1], e[:, 2], div(e[:, 0], e[:, 2]), div(e[:, 1], e[:, 2]), np.sqrt(g.sum(1)), div(e[:, 1], e[:, 0] * e[:, 2]),
                div(np.sqrt(np.maximum(e[:, 2] ** 2 - e[:, 0] ** 2, 0)), e[:, 2]), div(((g[:, 0] - g[:, 1]) ** 2 + (g[:, 0] - g[:, 2]) ** 2 + (g[:, 1] - g[:, 2]) ** 2) / 2, g.sum(1) ** 2), div(3 * g[:, 0], g.sum(1)),
            ], 1)
            yield pd.concat([p[["mol_id"]].reset_index(drop=True), pd.DataFrame(out, columns=list(names))], axis=1)

    kind = dict(positions.dtypes)["mol_id"]
    return s.mapInPandas(run, f"mol_id {kind}, " + ", ".join(f"{n} double" for n in names))
