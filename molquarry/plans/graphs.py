"""Registered queries over small graphs: each order is a molecule, its lines the atoms. Each with its SQL.

Atom k of an order is its k-th line; k is bonded to k div 2, and to k - 1 where k is a multiple of 3, so
that there are chains, branches and rings. Positions come from quantity, price and discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.functions import scalar
from molquarry.operators import graph as G
from molquarry.operators import molecules as M
from molquarry.session import table

GROUPS = 4


def atoms(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    x = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("atom"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"), "l_returnflag")
    return x.select(F.col("l_orderkey").alias("mol_id"), "atom", "x", "y", "z", "l_returnflag")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge ids 2 k for the bond to k div 2, 2 k + 1 for the ring bond."""
    a = atoms(spark, d).filter("atom > 1")
    tree = a.select("mol_id", (F.col("atom") * 2).alias("edge_id"), F.floor(F.col("atom") / 2).cast("int").alias("a"), F.col("atom").alias("b"))
    ring = a.filter("atom % 3 = 0").select("mol_id", (F.col("atom") * 2 + 1).alias("edge_id"), (F.col("atom") - 1).alias("a"), F.col("atom").alias("b"))
    return tree.unionByName(ring)


def matches(spark: SparkSession, d: str) -> DataFrame:
    """Functional-group matches: group g covers atoms g .. g + g mod 3 that exist, as match 0; group 1 also atoms 2 .. 4 as match 1."""
    n = atoms(spark, d).groupBy("mol_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    g = n.select("mol_id", "n", F.explode(F.sequence(F.lit(1), F.lit(GROUPS))).alias("fg_id"))
    own = g.filter("fg_id <= n").select("mol_id", "fg_id", F.lit(0).alias("match_no"), F.sequence("fg_id", F.least("n", F.col("fg_id") + F.col("fg_id") % 3)).alias("atoms"))
    more = n.filter("n >= 2").select("mol_id", F.lit(1).alias("fg_id"), F.lit(1).alias("match_no"), F.sequence(F.lit(2), F.least("n", F.lit(4))).alias("atoms"))
    return own.unionByName(more)


def edge_symmetrize(spark, d):
    return G.symmetrize(edges(spark, d)).groupBy("mol_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * 100 + F.col("b")).alias("code"))


def hop_distance(spark, d):
    return G.hop_distances(atoms(spark, d), edges(spark, d)).select("mol_id", "i", "j", "hops")


def spatial_pos(spark, d):
    """Hop counts capped at 2, by value."""
    return G.capped(G.hop_distances(atoms(spark, d), edges(spark, d)), 2).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))


def path_edges(spark, d):
    """Lengths of the paths put back together equal their hop counts: pairs by length."""
    p = G.path_edges(atoms(spark, d), edges(spark, d))
    return p.groupBy("mol_id", "i", "j").agg(F.count(F.lit(1)).alias("length")).groupBy("length").agg(F.count(F.lit(1)).alias("pairs"))


def angle_triples(spark, d):
    return G.angle_triples(edges(spark, d)).select("mol_id", "e1", "e2", "i", "center", "j")


def bond_angle(spark, d):
    a = G.bond_angles(G.angle_triples(edges(spark, d)), atoms(spark, d).select("mol_id", "atom", "x", "y", "z"))
    return a.select("mol_id", "e1", "e2", F.round("angle", 5).alias("angle"), scalar.bin_index(F.col("angle"), 0.0, 3.141592653589793, 20).alias("bin"))


def pair_distance(spark, d):
    p = G.pair_distances(atoms(spark, d).select("mol_id", "atom", "x", "y", "z"))
    return p.select("mol_id", "i", "j", F.round("d", 6).alias("d"), scalar.bin_index(F.col("d"), 0.0, 30.0, 30).alias("bin"))


def bond_length(spark, d):
    return G.bond_lengths(edges(spark, d), atoms(spark, d)).select("mol_id", "edge_id", F.round("d", 6).alias("d"))


def edge_midpoints(spark, d):
    return G.edge_distances(edges(spark, d), atoms(spark, d)).select("mol_id", "e1", "e2", F.round("d", 6).alias("d"))


def atom_bond_distance(spark, d):
    return G.atom_bond_distances(edges(spark, d), atoms(spark, d)).select("mol_id", "atom", "edge_id", F.round("d", 6).alias("d"))


def bond_types(spark, d):
    a = atoms(spark, d)
    sym = a.select("mol_id", F.col("atom").alias("a"), F.col("l_returnflag").alias("sa"))
    e = edges(spark, d).join(sym, ["mol_id", "a"]).join(sym.select("mol_id", F.col("a").alias("b"), F.col("sa").alias("sb")), ["mol_id", "b"])
    kind = F.element_at(F.array(*map(F.lit, ("SINGLE", "DOUBLE", "TRIPLE", "AROMATIC", "DATIVE"))), (F.col("edge_id") % 5 + 1).cast("int"))
    return e.select(G.bond_type_string(F.col("sa"), F.col("sb"), kind).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def group_subset_clean(spark, d):
    return G.drop_contained(matches(spark, d)).select("mol_id", "fg_id", "match_no", F.size("atoms").alias("size"))


def dominant_group(spark, d):
    return G.dominant_groups(atoms(spark, d), G.drop_contained(matches(spark, d)), GROUPS)


def bond_group_score(spark, d):
    m = matches(spark, d)
    return G.bond_group_scores(edges(spark, d), m, G.dominant_groups(atoms(spark, d), G.drop_contained(m), GROUPS))


def _chains(spark, d):
    """Graphs of 32 atoms of the parts: 1 .. 30 a chain, 31 and 32 bonded apart from it; (atoms, edges)."""
    p = table(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("mol_id"))
    a = p.select("mol_id", F.explode(F.sequence(F.lit(1), F.lit(32))).alias("atom"))
    return a, a.filter("atom not in (1, 31)").select("mol_id", F.col("atom").alias("edge_id"), (F.col("atom") - 1).alias("a"), F.col("atom").alias("b"))


def hop_distance_long(spark, d):
    """Hop counts in graphs of two parts with paths of up to 29 bonds."""
    return G.hop_distances(*_chains(spark, d)).select("mol_id", "i", "j", "hops", "via")


def path_edges_long(spark, d):
    """Every bond of every path of the same graphs."""
    return G.path_edges(*_chains(spark, d)).groupBy("mol_id", "i", "j").agg(F.count(F.lit(1)).alias("length"), F.sum(F.col("a") * 100 + F.col("b")).alias("code"), F.max("step").alias("last"))


def group_texts(spark, d):
    """Group ids to texts, unknown ones as None."""
    names = spark.createDataFrame([(1, "alcohol"), (2, "amine")], "fg_id int, text string")
    m = matches(spark, d).join(F.broadcast(names), "fg_id", "left")
    return m.groupBy(F.coalesce("text", F.lit("None")).alias("text")).agg(F.count(F.lit(1)).alias("n"))


def ring_size_histogram(spark, d):
    """Triangles (k div 2, k - 1, k with k - 1 and k bonded to the same atom or to each other's parents), sizes by rule: k mod 7 + 3."""
    a = atoms(spark, d)
    r = a.filter("atom % 3 = 0").select("mol_id", "atom", (F.col("atom") % 7 + 3).alias("size"))
    r = r.unionByName(r.select("mol_id", (F.col("atom") - 1).alias("atom"), "size"))
    return G.ring_sizes(r)


def molecule_atoms(spark, d):
    """Atoms of each molecule of data_collator by the SMILES reader, where the table states their number."""
    return M.sizes(table(spark, d, "data_collator"), "mol_id", "smiles").select("mol_id", "n_atoms", "n_bonds")


def molecule_records(spark, d):
    return M.records(table(spark, d, "freesolv"), "row_id", "smiles")


def scaffold_groups(spark, d):
    return M.scaffolds(table(spark, d, "freesolv"), "row_id", "smiles")


def morgan_bits(spark, d):
    return M.fingerprints(table(spark, d, "esol"), "row_id", "c0")


def shape_descriptors(spark, d):
    return M.shape_descriptors(atoms(spark, d).select("mol_id", "atom", "x", "y", "z", F.lit(12.0).alias("mass")))


def conformer_choice(spark, d):
    """Of each order's lines: the one of least energy (price), and the one nearest to the median."""
    x = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.col("l_extendedprice").alias("e"))
    m = x.groupBy("l_orderkey").agg(F.percentile("e", F.lit(0.5)).alias("p"))
    g = x.join(m, "l_orderkey").groupBy("l_orderkey").agg(F.min(F.struct("e", "id")).alias("a"), F.min(F.struct(F.round(F.abs(F.col("e") - F.col("p")), 4).alias("gap"), "id")).alias("b"))
    return g.select("l_orderkey", F.col("a.id.l_partkey").alias("least"), F.col("b.id.l_partkey").alias("middle"))


A = "ats AS (SELECT l_orderkey AS mol_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INTEGER) AS atom, l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_returnflag FROM lineitem)"
E_ = "ed AS (SELECT mol_id, atom * 2 AS edge_id, atom // 2 AS a, atom AS b FROM ats WHERE atom > 1 UNION ALL SELECT mol_id, atom * 2 + 1, atom - 1, atom FROM ats WHERE atom > 1 AND atom % 3 = 0)"
S = "sy AS (SELECT mol_id, a, b FROM ed UNION SELECT mol_id, b, a FROM ed)"
HOPS = "wk AS (SELECT mol_id, atom AS i, atom AS j, 0 AS hops FROM ats UNION SELECT wk.mol_id, i, b, hops + 1 FROM wk JOIN sy ON sy.mol_id = wk.mol_id AND sy.a = wk.j WHERE hops < 8), hp AS (SELECT mol_id, i, j, min(hops) AS hops FROM wk GROUP BY ALL)"
D3 = "sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)"
TR = "en AS (SELECT mol_id, edge_id, a AS center, b AS tip FROM ed UNION ALL SELECT mol_id, edge_id, b, a FROM ed), tr AS (SELECT p.mol_id, p.edge_id AS e1, q.edge_id AS e2, p.tip AS i, p.center, q.tip AS j FROM en p JOIN en q ON p.mol_id = q.mol_id AND p.center = q.center AND p.edge_id < q.edge_id)"
MID = "mi AS (SELECT ed.mol_id, edge_id, (p.x + q.x) / 2 AS x, (p.y + q.y) / 2 AS y, (p.z + q.z) / 2 AS z FROM ed JOIN ats p ON p.mol_id = ed.mol_id AND p.atom = a JOIN ats q ON q.mol_id = ed.mol_id AND q.atom = b)"
FG = f"nn AS (SELECT mol_id, count(*)::INTEGER AS n FROM ats GROUP BY 1), fg AS (SELECT mol_id, g::INTEGER AS fg_id, 0 AS match_no, range(g, least(n, g + g % 3) + 1) AS atoms FROM nn, range(1, {GROUPS} + 1) t(g) WHERE g <= n UNION ALL SELECT mol_id, 1, 1, range(2, least(n, 4) + 1) FROM nn WHERE n >= 2)"
FC = "fc AS (SELECT * FROM fg m WHERE NOT EXISTS (SELECT 1 FROM fg o WHERE o.mol_id = m.mol_id AND len(m.atoms) < len(o.atoms) AND list_has_all(o.atoms, m.atoms)))"
BIN = "CAST(least(greatest(floor({x} / {w}), 0), {m}) AS BIGINT)"

SQL = {
    "edge_symmetrize": f"WITH {A}, {E_}, {S} SELECT mol_id, count(*) AS n, CAST(sum(a * 100 + b) AS BIGINT) AS code FROM sy GROUP BY 1",
    "hop_distance": f"WITH RECURSIVE {A}, {E_}, {S}, {HOPS} SELECT p.mol_id, p.atom AS i, q.atom AS j, coalesce(hops, 510) AS hops FROM ats p JOIN ats q ON p.mol_id = q.mol_id LEFT JOIN hp ON hp.mol_id = p.mol_id AND hp.i = p.atom AND hp.j = q.atom",
    "spatial_pos": f"WITH RECURSIVE {A}, {E_}, {S}, {HOPS} SELECT least(hops, 2) AS hops, count(*) AS n FROM hp GROUP BY 1",
    "path_edges": f"WITH RECURSIVE {A}, {E_}, {S}, {HOPS} SELECT hops::BIGINT AS length, count(*) AS pairs FROM hp WHERE hops > 0 GROUP BY 1",
    "angle_triples": f"WITH {A}, {E_}, {TR} SELECT * FROM tr",
    "bond_angle": f"WITH {A}, {E_}, {TR}, an AS (SELECT tr.mol_id, e1, e2, p.x - c.x AS ux, p.y - c.y AS uy, p.z - c.z AS uz, q.x - c.x AS vx, q.y - c.y AS vy, q.z - c.z AS vz FROM tr JOIN ats p ON p.mol_id = tr.mol_id AND p.atom = i JOIN ats c ON c.mol_id = tr.mol_id AND c.atom = center JOIN ats q ON q.mol_id = tr.mol_id AND q.atom = j), n AS (SELECT *, sqrt(ux * ux + uy * uy + uz * uz) AS nu, sqrt(vx * vx + vy * vy + vz * vz) AS nv FROM an), g AS (SELECT mol_id, e1, e2, CASE WHEN nu = 0 OR nv = 0 THEN 0 ELSE acos(greatest(least((ux * vx + uy * vy + uz * vz) / ((nu + 1e-5) * (nv + 1e-5)), 1), -1)) END AS angle FROM n) SELECT mol_id, e1, e2, round(angle, 5) AS angle, {BIN.format(x='angle', w='(pi() / 20)', m=19)} AS bin FROM g",
    "pair_distance": f"WITH {A} SELECT p.mol_id, p.atom AS i, q.atom AS j, round({D3}, 6) AS d, {BIN.format(x=D3, w='1', m=29)} AS bin FROM ats p JOIN ats q ON p.mol_id = q.mol_id",
    "bond_length": f"WITH {A}, {E_} SELECT ed.mol_id, edge_id, round({D3}, 6) AS d FROM ed JOIN ats p ON p.mol_id = ed.mol_id AND p.atom = a JOIN ats q ON q.mol_id = ed.mol_id AND q.atom = b",
    "edge_midpoints": f"WITH {A}, {E_}, {MID} SELECT p.mol_id, p.edge_id AS e1, q.edge_id AS e2, round({D3}, 6) AS d FROM mi p JOIN mi q ON p.mol_id = q.mol_id",
    "atom_bond_distance": f"WITH {A}, {E_}, {MID} SELECT p.mol_id, p.atom, q.edge_id, round({D3}, 6) AS d FROM ats p JOIN mi q ON p.mol_id = q.mol_id",
    "bond_types": f"WITH {A}, {E_} SELECT least(p.l_returnflag, q.l_returnflag) || ['-', '=', '#', '~=', ' <DATIVE> '][edge_id % 5 + 1] || greatest(p.l_returnflag, q.l_returnflag) AS kind, count(*) AS n FROM ed JOIN ats p ON p.mol_id = ed.mol_id AND p.atom = a JOIN ats q ON q.mol_id = ed.mol_id AND q.atom = b GROUP BY 1",
    "group_subset_clean": f"WITH {A}, {FG}, {FC} SELECT mol_id, fg_id, match_no, len(atoms)::INTEGER AS size FROM fc",
    "dominant_group": f"WITH {A}, {FG}, {FC}, lo AS (SELECT mol_id, fg_id, match_no, len(atoms) AS n, unnest(atoms) AS atom FROM fc), b AS (SELECT *, row_number() OVER (PARTITION BY mol_id, atom ORDER BY n DESC, fg_id, match_no) AS r FROM lo) SELECT ats.mol_id, ats.atom, coalesce(fg_id, 0) AS fg_id, coalesce({GROUPS} * (match_no + 1) + fg_id, 0) AS fg_index FROM ats LEFT JOIN b ON b.mol_id = ats.mol_id AND b.atom = ats.atom AND r = 1",
    "bond_group_score": f"WITH {A}, {E_}, {FG}, {FC}, lo AS (SELECT mol_id, fg_id, match_no, len(atoms) AS n, unnest(atoms) AS atom FROM fc), dm AS (SELECT mol_id, atom, arg_min({GROUPS} * (match_no + 1) + fg_id, (-n, fg_id, match_no)) AS x FROM lo GROUP BY ALL), ids AS (SELECT mol_id, atom, list(DISTINCT fg_id) AS g FROM (SELECT mol_id, fg_id, unnest(atoms) AS atom FROM fg) GROUP BY ALL) SELECT ed.mol_id, edge_id, CASE WHEN p.g IS NULL AND q.g IS NULL THEN 0 WHEN p.g IS NULL OR q.g IS NULL THEN 1 ELSE 2 + least(len(list_intersect(p.g, q.g)), 3)::INTEGER END AS score, CASE WHEN coalesce(u.x, 0) = coalesce(v.x, 0) THEN 0 ELSE 1 END AS same FROM ed LEFT JOIN ids p ON p.mol_id = ed.mol_id AND p.atom = a LEFT JOIN ids q ON q.mol_id = ed.mol_id AND q.atom = b LEFT JOIN dm u ON u.mol_id = ed.mol_id AND u.atom = a LEFT JOIN dm v ON v.mol_id = ed.mol_id AND v.atom = b",
    "hop_distance_long": "SELECT p_partkey AS mol_id, i::INTEGER AS i, j::INTEGER AS j, CASE WHEN (i > 30) = (j > 30) THEN abs(i - j) ELSE 510 END::INTEGER AS hops, CASE WHEN (i > 30) = (j > 30) AND i <> j THEN CASE WHEN i < j THEN j - 1 ELSE j + 1 END END::INTEGER AS via FROM part, range(1, 33) t(i), range(1, 33) u(j) WHERE p_partkey % 10 = 0",
    "path_edges_long": "SELECT p_partkey AS mol_id, i::INTEGER AS i, j::INTEGER AS j, abs(i - j)::BIGINT AS length, (CASE WHEN i < j THEN (SELECT sum(k * 101 + 1) FROM range(1, 33) r(k) WHERE k >= i AND k < j) ELSE (SELECT sum(k * 101 + 100) FROM range(1, 33) r(k) WHERE k >= j AND k < i) END)::BIGINT AS code, (abs(i - j) - 1)::INTEGER AS last FROM part, range(1, 33) t(i), range(1, 33) u(j) WHERE p_partkey % 10 = 0 AND i <> j AND (i > 30) = (j > 30)",
    "group_texts": f"WITH {A}, {FG} SELECT CASE fg_id WHEN 1 THEN 'alcohol' WHEN 2 THEN 'amine' ELSE 'None' END AS text, count(*) AS n FROM fg GROUP BY 1",
    "ring_size_histogram": f"WITH {A}, r AS (SELECT mol_id, atom, atom % 7 + 3 AS s FROM ats WHERE atom % 3 = 0), u AS (SELECT * FROM r UNION ALL SELECT mol_id, atom - 1, s FROM r) SELECT mol_id, atom, " + ", ".join(f"count(*) FILTER (s = {k}) AS s{k}" for k in range(3, 9)) + ", count(*) FILTER (s > 8) AS s9 FROM u GROUP BY ALL",
    "conformer_choice": "WITH m AS (SELECT l_orderkey, quantile_cont(l_extendedprice, 0.5) AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, arg_min(l_partkey, (l_extendedprice, l_partkey, l_suppkey, l_linenumber)) AS least, arg_min(l_partkey, (round(abs(l_extendedprice - p), 4), l_partkey, l_suppkey, l_linenumber)) AS middle FROM lineitem JOIN m USING (l_orderkey) GROUP BY 1",
}
UNCHECKED = ("molecule_atoms", "molecule_records", "scaffold_groups", "morgan_bits", "shape_descriptors")
QUERIES = {n: globals()[n] for n in (*SQL, *UNCHECKED)}
