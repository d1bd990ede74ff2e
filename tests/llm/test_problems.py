"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from molquarry.functions.smiles import Graphs, canonical_text, clean, parse
from molquarry.llm import clusters, copies, group_splits, hnsw, mixing, neighbours, overlap, packing, queries, residue, tokens, vectors
from molquarry.session import table

DATA = "/root/testdata/sf0.001"


# 1 packing
def test_plan_is_feasible_and_tight():
    for seed in range(60):
        rng = random.Random(seed)
        cap = rng.choice([10, 64, 512])
        h: dict[int, int] = {}
        for _ in range(rng.choice([1, 20, 400])):
            x = rng.randint(1, cap) if rng.random() < 0.5 else rng.randint(1, max(1, cap // 8))
            h[x] = h.get(x, 0) + 1
        places, n = packing.plan(h, cap)
        load, seen = {}, {}
        for size, at, items, start, each in places:
            assert at == seen.get(size, 0)
            seen[size] = at + items
            for i in range(items):
                load[start + i // each] = load.get(start + i // each, 0) + size
        assert seen == h and max(load.values()) <= cap and len(load) == n
        assert n <= 1.5 * -(-sum(k * v for k, v in h.items()) // cap) + 1


def test_pack_edges(spark, monkeypatch):
    rows = [(i, 30, "x") for i in range(500)] + [(500, None, "x"), (501, 0, "x"), (502, -3, "x"), (503, 1200, "x"), (504, 512, "x"), (3, 30, "x")]
    df = spark.createDataFrame(rows, "mol_id long, atom_length int, batch string")
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    p = packing.pack(df, "mol_id", "atom_length", 512).cache()
    assert p.filter("mol_id = 503").agg(F.sum("length"), F.count("*")).first()[:] == (1200, 3)
    assert p.filter("batch is null").count() == 2 and p.filter("mol_id = 501").first()["batch"] == 0
    loads = p.filter("batch is not null").groupBy("batch").agg(F.sum("length").alias("n"))
    assert loads.agg(F.max("n")).first()[0] <= 512 and p.count() == len(rows) + 2
    assert loads.count() <= -(-(501 * 30 + 1712) // 512) + 2
    assert packing.pack(df.limit(0), "mol_id", "atom_length", 512).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "mol_id", "atom_length", 0)


# 2 clusters, 3 neighbours
def _fps(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for size in (60, 12, 5, 3, 2, *[1] * 40):
        base = set(rng.choice(2048, 60, replace=False).tolist())
        for _ in range(size):
            on = set(base)
            for b in rng.choice(sorted(base), 3, replace=False):
                on.discard(int(b))
            rows.append((i, [1 if k in on else 0 for k in range(2048)], "z"))
            i += 1
    rows += [(i, rows[0][1], "z"), (i + 1, [0] * 2048, "z"), (i + 2, None, "z"), (i + 3, [1] * 7, "z"), (i + 4, rows[70][1], "z")]
    return spark.createDataFrame(rows, "mol_id long, morgan2048_fp array<int>, node string"), rows


def _tanimoto(rows):
    x = {i: np.array(v, bool) for i, v, _ in rows if v is not None and len(v) == 2048 and any(v)}
    ids = sorted(x)
    m = np.array([x[i] for i in ids], float)
    both = m @ m.T
    return ids, both / (m.sum(1)[:, None] + m.sum(1)[None] - both)


def test_clusters(spark):
    df, rows = _fps(spark)
    c = clusters.Clusters(df)
    ids, s = _tanimoto(rows)
    want = set()
    for k in range(len(ids)):
        group = [ids[j] for j in np.flatnonzero(s[k] >= 0.6)]
        if len(group) >= 3 and ids[k] != min(group):
            want.add((min(group), ids[k]))
    assert set(map(tuple, c.found().collect())) == want
    m = c.members(20)
    assert m.count() == len(rows) and m.agg(F.max("cluster_id")).first()[0] <= 20
    d = c.describe(20).orderBy(F.desc("records")).first()
    assert d["records"] == 61 and len(d["typical"]) == 5
    assert clusters.Clusters(df.limit(0)).found().count() == 0


def test_sets_have_clusters_of_their_own(spark):
    rng = np.random.default_rng(2)
    bases = [rng.choice(2048, 60, replace=False) for _ in range(34)]
    bases[33] = np.concatenate([bases[0][:30], bases[33][:30]])  # a third of its bits are those of the largest set
    rows = []
    for k, base in enumerate(bases):
        for j in range(4 if k == 0 else 3 if k < 20 else 2 if k in (20, 33) else 1):
            rows.append((len(rows), [int(b in set(base.tolist()) - {base[-1 - j]}) for b in range(2048)]))
    df = spark.createDataFrame(rows, "mol_id long, morgan2048_fp array<int>")
    c = clusters.Clusters(df)
    assert c.sharing(24) == 0 and c.sharing(100) == 0
    alone = c.describe(24).filter("records > 1 and sets = 1")
    assert alone.count() == 22  # of 22 sets, at 24 clusters
    of = {r["mol_id"]: r["cluster_id"] for r in c.members(22).collect()}
    assert c.sharing(22) > 0 and of[len(rows) - 1] == of[len(rows) - 2] == of[0]  # joins the most similar center
    assert queries._most(spark, DATA) == 10_000


def test_moving_finds_two_cliques(spark):
    links = [(i, j, 1.0) for g in (range(6), range(6, 12)) for i in g for j in g if i < j] + [(5, 6, 1.0)]
    df = spark.createDataFrame(links, "x long, y long, w double")
    k = {i: sum(w for x, y, w in links if i in (x, y)) for i in range(12)}
    label = {r["x"]: r["c"] for r in clusters.move_all(df, spark.createDataFrame(list(k.items()), "x long, k double"), 2.0 * len(links)).collect()}
    assert len({label[i] for i in range(6)}) == 1 and len({label[i] for i in range(6, 12)}) == 1 and label[0] != label[11]


def test_communities_differ_from_components(spark):
    rng = np.random.default_rng(8)
    core_a, core_b, rest = range(40), range(40, 80), np.arange(80, 2048)
    on = [{*core_a, *rng.choice(rest, 20, replace=False).tolist()} for _ in range(7)] + [{*core_b, *rng.choice(rest, 20, replace=False).tolist()} for _ in range(7)]
    on[0] = {*core_a, *range(40, 72)}  # similar to all of them
    on += [on[3] ^ {100 + i} for i in range(2)]  # a must-link set with record 3
    df = spark.createDataFrame([(i, [int(b in x) for b in range(2048)]) for i, x in enumerate(on)], "mol_id long, morgan2048_fp array<int>")
    c = clusters.Clusters(df)
    group = {r["node"]: (r["set_id"], r["group_id"]) for r in c.nodes.collect()}
    assert group[3][0] == group[14][0] == group[15][0] == 3 and len({s for s, _ in group.values()}) == 14
    assert len({group[i][1] for i in (*range(7), 14, 15)}) == 1 and len({group[i][1] for i in range(7, 14)}) == 1
    assert group[1][1] != group[8][1]  # though links of record 0 connect them
    assert sorted(map(tuple, c.found().collect())) == [(3, 14), (3, 15)]


def test_neighbours_against_brute_force(spark):
    df, rows = _fps(spark, 3)
    n = neighbours.Neighbours(df, "mol_id", "morgan2048_fp", "bits", 2048)
    ids, s = _tanimoto(rows)
    np.fill_diagonal(s, -1)
    got: dict = {}
    for r in n.rows.collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"], r["similarity"]))
    hits = total = 0
    for k, i in enumerate(ids):
        true = sorted(-s[k])[:10]
        mine = sorted(got[i])
        assert [x[0] for x in mine] == list(range(1, 11)) and i not in [x[1] for x in mine]
        hits += sum(x[2] >= -true[-1] - 1e-9 for x in mine)
        total += 10
    assert hits >= 0.9 * total and set(got) == set(ids)
    assert got[0][0][1] == len(rows) - 5  # its copy comes first
    assert neighbours.Neighbours(df.limit(0), "mol_id", "morgan2048_fp", "bits", 2048).rows.count() == 0


def test_neighbours_of_unrelated_bits_are_exact(spark):
    rng = np.random.default_rng(11)
    x = (rng.random((6000, 2048)) < 0.03).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"mol_id": range(len(x)), "v": list(x)}), "mol_id long, v array<int>")
    rows = neighbours.Neighbours(df, "mol_id", "v", "bits", 2048).rows.filter("id < 300").collect()
    both = x[:300].astype(np.float32) @ x.T.astype(np.float32)
    s = both.astype(float) / (x[:300].sum(1)[:, None] + x.sum(1)[None] - both)
    s[np.arange(300), np.arange(300)] = -1
    got = {(r["id"], r["rank"]): (r["neighbour_id"], r["similarity"]) for r in rows}
    for k in range(300):
        want = sorted(range(len(x)), key=lambda j: (-s[k, j], j))[:10]
        assert [got[k, r][0] for r in range(1, 11)] == want
        assert np.allclose([got[k, r][1] for r in range(1, 11)], s[k, want])


def test_units_recall_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((800, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [1.0] * 5), (903, [float("nan")] + [1.0] * 63)]
    df = spark.createDataFrame(rows, "mol_id long, e array<float>")
    n = neighbours.Neighbours(df, "mol_id", "e", "units", 64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    true = np.argsort(-s, 1)[:, :10]
    got: dict = {}
    for r in n.rows.collect():
        got.setdefault(r["id"], set()).add(r["neighbour_id"])
    assert set(got) == set(range(800))
    assert np.mean([len(got[i] & set(true[i])) / 10 for i in range(800)]) >= 0.9


def test_graph_of_few_members():
    for n in (0, 1, 2, 13):
        data = vectors.Units(np.eye(16, dtype=np.float32)[:n])
        ids, _ = hnsw.Graph(data).query(data, 5)
        assert ids.shape == (n, 5) and all(ids[i, 0] == i for i in range(n))


# 4 copies
def test_copies(spark):
    texts = ["CCO.[Na+]", " [NA+].CCO", '"CCO.[Na+]";', "OCC.[Na+]", "", None, "  ", "C" * 100_000, "C" * 100_000 + " ", "CN", "cn", "CCO.[Na+]"]
    df = spark.createDataFrame([("t", i, t, "x") for i, t in enumerate(texts)] + [("u", 99, "CCO.[Na+]", "x")], "origin string, row_id long, smiles string, canon string")
    records, found = copies.collapse_formatting(df, "origin", "row_id", "smiles")
    assert set(map(tuple, found.collect())) == {(0, 1), (0, 2), (0, 11), (7, 8)}
    assert {r["copies"] for r in records.filter("first_id = 0").collect()} == {4}
    assert copies.collapse_formatting(df.limit(0), "origin", "row_id", "smiles")[1].count() == 0


def test_radix_splits_until_buckets_fit(spark):
    texts = ["C" * k for k in range(1, 40)] + ["CC"] * 30
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "scope string, id long, canon string")
    got = {r["canon"]: (r["copies"], r["first_id"]) for r in copies.collapse(df, capacity=3).collect()}
    assert got == {t: (texts.count(t), texts.index(t)) for t in set(texts)}


# 5 overlap, 6 splits
def test_overlap(spark):
    rows = [
        (1, "a", "CC(O)c1ccccc1", "s", "train"), (2, "a", "OC(C)c1ccccc1.[Na+]", None, "test"), (3, "b", "C[C@H](O)c1ccccc1", "s", "valid"), (4, "a", "CC(O)c1ccccn1", "s", "test"),
        (5, "a", None, "s", "test"), (6, "a", "", "s", "train"), (7, "a", "CC(O)c1ccccc1", "s", None), (8, "a", "CC(O)c1ccccc1", "s", "train"), (9, "a", "not one(", "s", "test"),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "row_id long, origin string, smiles string, source string, split string, key string")
    o = overlap.Overlap(df)
    assert set(map(tuple, o.pairs().collect())) == {(1, 2), (1, 3), (2, 8), (3, 8)}
    assert {r["row_id"]: r["exact"] for r in o.rows().collect()} == {2: 2, 3: 2}
    assert o.report().agg(F.sum("exact_rows")).first()[0] == 2
    assert overlap.Overlap(df.limit(0)).pairs().count() == 0


def test_one_changed_atom_is_near(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["C", "N", "O", "C(C)", "C(F)", "C(=O)", "c1ccccc1", "S"]) for _ in range(14)) for _ in range(80)]
    rows = [("t", i, t, "x", "train") for i, t in enumerate(texts)] + [("t", 1000 + i, t + "C", "x", "test") for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(rows, "origin string, row_id long, smiles string, source string, split string")
    o = overlap.Overlap(df)
    got = {r["row_id"]: (r["exact"], r["near"]) for r in o.rows().collect()}
    assert len(got) == 20 and all(e == 0 and n >= 1 for e, n in got.values())
    assert o.report().first()["near_rows"] == 20 and o.pairs().count() == 0


def test_cosine_join_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [sorted(rng.choice(400, 20, replace=False).tolist()) for _ in range(60)]
    sets = base + [sorted({*b[:-1], int(rng.integers(400))}) for b in base]
    df = spark.createDataFrame([(i, [int(x) for x in t]) for i, t in enumerate(sets)], "key long, terms array<long>")
    v = overlap.class_vectors(df, len(sets)).cache()
    got = {(r[0], r[1]): r[2] for r in overlap.cosine_join(v.filter("key < 60"), v.filter("key >= 60"), 0.8).collect()}
    vec = {r["key"]: {e["term"]: e["w"] for e in r["vec"]} for r in v.collect()}
    want = {}
    for a in range(60):
        for b in range(60, 120):
            s = sum(w * vec[b].get(t, 0) for t, w in vec[a].items())
            if s >= 0.8:
                want[a, b] = s
    assert set(got) == set(want) and len(want) >= 60 * 0.5 and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_grouped_splits(spark):
    rings = ["c1ccccc1", "C1CCNCC1", "c1ccsc1", "C1CC1"]
    rows = [(i, ("C" * (i % 4)) + rings[i % 4 if i % 3 else 0], float(i % 7), "q") for i in range(400)] + [(400, None, 1.0, "q"), (401, "", None, "q"), (402, "CCO", None, "q"), (403, "bad(", 2.0, "q")]
    df = spark.createDataFrame(rows, "row_id long, smiles string, expt double, component string")
    t = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1)], "split string, target_share double")
    g = group_splits.GroupedSplit(df, t)
    assert g.rows.count() == len(rows)
    assert g.rows.groupBy("component").agg(F.count_distinct("split").alias("k")).agg(F.max("k")).first()[0] == 1
    want = {}
    for i, s, _, _ in rows:
        m = parse(clean(s)) if s else None
        if m:
            x = Graphs([m])
            x.ring_core()
            if len(x.mol):
                want.setdefault(int(x.hashes()[0][0]), []).append(i)
    assert set(map(tuple, g.sets().collect())) == {(min(v), i) for v in want.values() for i in v if i != min(v)}
    assert g.report().count() == 3
    assert group_splits.GroupedSplit(df.limit(0), t).rows.count() == 0


def test_annealing_meets_shares():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 50, 300).astype(float)
    y = n * rng.normal(0, 1, 300)
    want = np.array([0.8, 0.1, 0.1]) * n.sum()
    at, cost = group_splits.anneal(n, y, rng.integers(0, 3, 300), np.zeros(3), np.zeros(3), want, float(y.sum() / n.sum()), 1.0, 1, 20_000)
    assert cost < 0.02 and np.abs(np.bincount(at, n, 3) - want).sum() < 0.01 * n.sum()


# 8 tokens
def test_tokens(spark):
    enc = tokens.encoding(tokens.vocabulary())
    long = ("word 12abc345 \n\t x" * 20_000) + "endoftext"
    texts = [None, "", " ", "<|endoftext|>", "naïve 分子 🧪", long, "a" * 5_000, "a" * 5_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    e = tokens.encode_documents(df).cache()
    got = {r["doc_id"]: r["ids"] for r in e.collect()}
    assert got[0] == [] and got[1] == [] and got[5] == enc.encode_ordinary(long) and got[6] == got[7]
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in tokens.decode_documents(e).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_cuts_are_safe():
    enc = tokens.encoding(tokens.vocabulary())
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice("ab1 2\n\t'sé分.,-  ll've") for _ in range(rng.randint(0, 80)))
        assert tokens.encode(enc, t, chunk=3) == enc.encode_ordinary(t)


# 9 mixing
def test_mix(spark):
    docs = [(i, "some words here " * (i % 5 + 1), "big" if i % 10 else "small", "z") for i in range(2000)] + [(3000, None, "big", "z"), (3001, "", "small", "z"), (3002, "text", None, "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, rate string")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, t)
    r = {x["source"]: x for x in m.report().collect()}
    assert abs(r["big"]["actual_share"] - 2 / 3) < 0.03 and abs(r["small"]["actual_share"] - 1 / 3) < 0.03 and r["absent"]["tokens_drawn"] == 0
    assert all(x["max_copies"] <= x["max_repeats"] for x in r.values())
    assert sorted(m.drawn.collect()) == sorted(mixing.Mix(df, t).drawn.collect())
    assert m.drawn.filter("doc_id >= 3000").count() == 0
    capped = mixing.Mix(df, t, total_tokens=1e9)
    assert {x["source"]: x["rate"] for x in capped.rates.collect()}["small"] == 3.0
    assert mixing.Mix(df.limit(0), t).drawn.count() == 0


# 10 residue
BAD = [
    "Home | Compounds | Splits | Help\n404 Not Found\nGo back to the start page.", "ACCESS DENIED. You do not have permission to view this data set.", "This page needs JavaScript to work.",
    "## Method\nSample text goes here. Click to add text.", "Ornare velit dolor cillum fugiat esse. Culpa ornare lectus minim nulla.", "Vebaneazole\n\nLorem ipsum dolor sit amet.",
    "We measured {{name}} at 20 °C and it was fine.", "Lot [insert date here]-7 arrived wet. All other values are sound.", "Compound: <TITLE>\nSMILES: CCO\nValue: -1.0", "Scaffold c1ccccc1: %N_ATOMS% molecules, mean 0.3.",
    "Traceback (most recent call last):\n  File \"render.py\", line 3, in show\n    row = table[key]\nKeyError: 'smiles'",
]
GOOD = [
    "An 'internal server error' on day 3 cost us 12 readings, which were measured again at 20 °C.", "In the card template, {{name}} stands for the compound name and is replaced on export, here by X.",
    "Page not found is what readers saw for glycol until the link to sheet 9 was mended.", "The structure O=[N+]([O-])CC(N)Cc1c[nH]c1 was read.", "We set ${OUT} to the run folder and kept 3 checkpoints of the graph branch.",
    "Samples were shaken for 5 h.\nHome | Compounds | Splits | Help", "Only a heading", "", "   ", None, "Old browsers show \"JavaScript is disabled in your browser.\", which is why it is drawn as plain text: CCO.",
    "Earlier dumps held filler text such as lorem ipsum; the 3 rows concerned were removed before this release.", "The ring viewer needs JavaScript, but the table of 3 values below can be read without it.",
]


def test_residue(spark, monkeypatch):
    rows = [(i, t, "x") for i, t in enumerate(BAD + GOOD)] + [(500, BAD[0], "x"), (501, "A sound sentence about bins. " * 5_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    want = {*range(len(BAD)), 500}
    assert {r[0] for r in residue.Residue(df).found.collect()} == want
    monkeypatch.setattr(residue, "MOST_BROADCAST", 0)
    assert {r[0] for r in residue.Residue(df).found.collect()} == want
    assert residue.Residue(df.limit(0)).found.count() == 0


# the registered queries
@pytest.mark.parametrize("name", list(queries.queries()))
def test_queries_run(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert len(df.schema) > 0 and df.count() > 0


def test_found_against_brute_force(spark):
    rows = [r for r in table(spark, DATA, "freesolv").select("row_id", "smiles").collect() if canonical_text(r["smiles"])]
    by: dict = {}
    for r in rows:
        by.setdefault(canonical_text(r["smiles"]), []).append(r["row_id"])
    want = {(min(v), i) for v in by.values() for i in v if i != min(v)}
    free = {r["row_id"] for r in rows}
    assert {tuple(r) for r in queries.p4_found(spark, DATA).collect() if r["copy_id"] in free} == want
