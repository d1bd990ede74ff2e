import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from molquarry.functions import scalar, vec
from molquarry.operators import batching, graph, metrics, splits
from molquarry.operators.skew import attach_heads
from molquarry.sources.readers import read_list, resolve_target, write_blocks
from molquarry.sources.versions import VersionStore
from molquarry.streaming import centers


def test_refusals(spark):
    with pytest.raises(ValueError):
        vec.similarity(F.lit(1), F.lit(1), "other")
    with pytest.raises(ValueError):
        resolve_target(["a"], None)
    assert resolve_target(["a", "y", "label"], "z") == "label"


def test_first_fit_differs_from_prefix(spark):
    sizes = [50, 31, 9, 6, 4]
    g = spark.createDataFrame([(f"g{i}", n, i) for i, n in enumerate(sizes)], "grp string, n long, first long")
    fit = {r["grp"]: r["split"] for r in splits.first_fit_split(g).collect()}
    a = b = 0
    for i, n in sorted(enumerate(sizes), key=lambda x: (-x[1], -x[0])):
        where = "train" if a + n <= 80 else "valid" if a + b + n <= 90 else "test"
        a, b = a + n * (where == "train"), b + n * (where == "valid")
        assert fit[f"g{i}"] == where
    pre = {r["grp"]: r["split"] for r in splits.prefix_split(g).collect()}
    assert pre["g1"] == "train" and fit["g1"] == "valid"


def test_early_stopping_is_no_running_max(spark):
    s = spark.createDataFrame(list(enumerate([0.5, 0.55, 0.58, 0.65])), "epoch long, score double")
    best = [r["best"] for r in splits.early_stopping(s, "epoch", "score", 2, 0.1).orderBy("epoch").collect()]
    assert best == [0.5, 0.5, 0.5, 0.65]


def test_metrics_edge_cases(spark):
    one = spark.createDataFrame([(1, 0.3, 0), (1, 0.6, 0)], "y int, s double, p int")
    assert metrics.roc_auc(one, "y", "s").first()["auc"] == 0.5
    r = metrics.confusion(one, "y", "p").first()
    assert (r["precision"], r["recall"], r["f1"], r["fn"]) == (0.0, 0.0, 0.0, 2)
    ones = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    assert metrics.confusion(ones, "y", "p").first()["tp"] == 0
    zero = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "y double, p double")
    assert metrics.regression(zero, "y", "p").first()["mape"] == -1
    assert metrics.correlation_p(None, 10) == 1.0
    assert math.isclose(metrics.correlation_p(0.5, 20), 0.0247, abs_tol=5e-4)


def test_scalars(spark):
    d = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (-9.0,), (99.0,), (5.0,)], "x double")
    assert [r[0] for r in d.select(scalar.clamp_nan(F.col("x"))).collect()] == [0.0, 10.0, None, -9.0, 99.0, 5.0]
    assert [r[0] for r in d.filter("x < 1000").select(scalar.bin_index(F.col("x"), 0.0, 10.0, 5)).collect()][:3] == [0, 4, 2]
    e = spark.createDataFrame([], "x double")
    assert e.agg(scalar.percentile_bar(F.col("x"), [0.0, 50.0]).alias("b")).first()["b"] == [0.0, 0.0]


def test_memory_bank_truncates_and_wraps(spark):
    b = spark.createDataFrame([(k, p) for k in range(4) for p in range(2)], "batch long, pos long")
    got = {r["slot"]: (r["batch"], r["pos"]) for r in centers.memory_bank(b, 5).collect()}
    ring, ptr = {}, 0
    for k in range(4):
        for p in range(2):
            if ptr + p < 5:
                ring[ptr + p] = (k, p)
        ptr = (ptr + 2) % 5
    assert got == ring


def test_kmeans_step(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.0]), (3, [0.0, 2.0])], "vec_id long, e array<double>")
    c = spark.createDataFrame([(0, [1.0, 0.0], 3.0), (1, [0.0, 1.0], 0.0), (2, [-9.0, -9.0], 5.0)], "center_id int, center array<double>, count double")
    got = {r["center_id"]: (r["center"], r["count"]) for r in centers.kmeans_step(v, c).collect()}
    assert np.allclose(got[0][0], [0.75 * 1 + 0.25 * 0.9, 0]) and math.isclose(got[0][1], 3 * 0.99 + 2)
    assert got[1][0] == [0.0, 2.0] and got[2][0] == [-9.0, -9.0]


def test_stream_equals_sequential(spark, tmp_path):
    rows = [(i, "image" if i % 2 else "odd", [float(i % 7) + 1, 1.0]) for i in range(60)]
    store = VersionStore(spark, f"file://{tmp_path}/v", most=3)
    lib = centers.CenterLibrary(store, k=2, trigger=10, least=5)
    df = spark.createDataFrame(rows, "vec_id long, modality string, e array<double>")
    for k in range(3):
        lib.update(df.filter((F.col("vec_id") >= 20 * k) & (F.col("vec_id") < 20 * k + 20)), k)
    again = store.load(spark).orderBy("kind", "modality", "id").collect()
    lib.update(df.filter("vec_id >= 40"), 2)  # a replayed batch
    assert store.load(spark).orderBy("kind", "modality", "id").collect() == again
    c = store.load(spark).filter("kind = 'center'")
    assert c.count() == 2 and c.agg(F.sum("count")).first()[0] > 10
    assert all(math.isclose(np.linalg.norm(r["e"]), 1, abs_tol=1e-9) for r in c.collect())
    assert store.verify(spark, "unknown") and store.load(spark, "unknown") is None


def test_hops_and_paths(spark):
    e = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (3, 0), (5, 6)])], "mol_id long, edge_id int, a int, b int")
    a = spark.createDataFrame([(1, k) for k in range(8)], "mol_id long, atom int")
    h = graph.hop_distances(a, e)
    d = {(r["i"], r["j"]): r["hops"] for r in h.collect()}
    assert d[0, 2] == 2 and d[1, 3] == 2 and d[0, 5] == 510 and d[7, 7] == 0 and d[5, 6] == 1
    p = graph.path_edges(a, e).filter("i = 1 and j = 3").orderBy("step").collect()
    assert len(p) == 2 and p[0]["b"] == 3 and p[1]["b"] == p[0]["a"]  # also by way of atom 0
    t = graph.angle_triples(e)
    assert t.count() == 4


def test_padding(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (9, [])], "id long, v array<double>")
    got = {r["id"]: (r["v"], r["mask"]) for r in batching.padded(batching.numbered_batches(d, "id", 5), "v", -1.0, 1.0).collect()}
    assert got[1] == ([4.0, 0.0], [1, 1, 0]) and got[9] == ([], [1])


def test_attach_heads_keeps_all(spark):
    rows = spark.createDataFrame([("a",)] * 50 + [("b",)] * 3 + [(None,), ("c",)], "k string")
    heads = spark.createDataFrame([("a", 50, 1), ("b", 3, 2)], "k string, n long, x int")
    assert attach_heads(rows, heads, ["k"], "n", hot_rows=10).count() == 53


def test_readers(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" CCO \nC\n")
    assert [r[0] for r in read_list(spark, str(tmp_path / "l.txt")).collect()] == ["CCO", "C"]
    with pytest.raises(ValueError):
        read_list(spark, "x.pkl")
    write_blocks(spark.range(25), str(tmp_path / "b"), "id", 10)
    assert spark.read.parquet(str(tmp_path / "b")).groupBy("block").count().count() == 3


def test_long_paths_parts_and_null_keys(spark):
    n = 45
    e = spark.createDataFrame([("m", k, k, k + 1) for k in range(n - 1)] + [("m", 99, 100, 101), (None, 1, 0, 1), ("m", 98, 3, 777)], "mol_id string, edge_id int, a int, b int")
    a = spark.createDataFrame([("m", k) for k in [*range(n), 100, 101]] + [("alone", 7), (None, 3), ("m", None)], "mol_id string, atom int")
    d = {(r["mol_id"], r["i"], r["j"]): (r["hops"], r["via"]) for r in graph.hop_distances(a, e).collect()}
    assert len(d) == 47 * 47 + 1 and d["alone", 7, 7] == (0, None)
    assert d["m", 0, 44] == (44, 43) and d["m", 44, 0] == (44, 1) and d["m", 0, 100] == (510, None) and d["m", 101, 100] == (1, 101)
    p = graph.path_edges(a, e).filter("i = 0 and j = 44").orderBy("step").collect()
    assert [(r["a"], r["b"]) for r in p] == [(k, k + 1) for k in range(43, -1, -1)]
    assert graph.hop_distances(a.limit(0), e).count() == 0


def test_same_group_flag_of_ungrouped_ends(spark):
    e = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 3), (1, 3, 3, 4)], "mol_id long, edge_id int, a int, b int")
    a = spark.createDataFrame([(1, k) for k in range(1, 5)], "mol_id long, atom int")
    m = spark.createDataFrame([(1, 2, 0, [1, 2])], "mol_id long, fg_id int, match_no int, atoms array<int>")
    got = {r["edge_id"]: (r["score"], r["same"]) for r in graph.bond_group_scores(e, m, graph.dominant_groups(a, m, 4)).collect()}
    assert got == {1: (3, 0), 2: (1, 1), 3: (0, 0)}


def test_running_sum_and_ranks(spark):
    import random

    from molquarry.operators import metrics, skew

    rng = random.Random(1)
    rows = [(i, rng.choice([None, 1.0, 2.5, 2.5, 7.0]), rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x double, n long")
    got = {r["i"]: r["before"] for r in skew.running_sum(df, [F.desc("n"), F.col("i")], F.col("n"), "before").collect()}
    total = 0
    for i, _, n in sorted(rows, key=lambda r: (-r[2], r[0])):
        assert got[i] == total
        total += n
    xs = [r[1] for r in rows if r[1] is not None]
    ranks = {r["i"]: r["r"] for r in metrics.average_ranks(df.filter("x is not null"), "x", "r").collect()}
    assert all(ranks[i] == sum(y < x for y in xs) + (xs.count(x) + 1) / 2 for i, x, _ in rows if x is not None)
