"""Registered queries over rules of training, batches and files that the other plans don't hold. Each with its SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.functions import scalar, vec
from molquarry.operators import batching, splits
from molquarry.operators import graph as G
from molquarry.operators import retrieval as R
from molquarry.plans import graphs, tables
from molquarry.plans.vectors import BASE, BATCH, BP, HITS, K, Q, T, TG, V, W, _v, _vc
from molquarry.session import shared_dir, table
from molquarry.sources import readers


def separation_bonus(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the pseudo pairs with the bonus for standing apart from in-batch negatives."""
    v, c = _vc(spark, d)
    n = R.batch_pairs(v, BATCH).select(vec.dot(F.col("a"), F.col("b")).alias("sim"))
    return R.with_separation(R.pseudo_pairs(v, c, K, T), n).select("vec_id", "center_modality", F.round("score", 4).alias("score"))


def hard_negative_k(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("int").alias("b"))
    return p.select("p_partkey", scalar.hard_k_by_share(F.col("b"), 10, 0.3).alias("by_share"), scalar.hard_k_by_quarter(F.col("b"), F.col("b") * 2).alias("by_quarter"))


def vocabulary_size(spark, d):
    v = ["view", "click", "purchase", "misc"]
    return table(spark, d, "events").agg(F.max(scalar.vocab_index(F.col("event_type"), v)).alias("largest")).select(F.lit(scalar.vocab_size(v)).alias("size"), (F.col("largest") < scalar.vocab_size(v)).alias("fits"))


def split_fallback(spark, d):
    """The prefix split where all splits have both classes, the stratified one where a split lacks one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 2).alias("mixed"), F.lit(0).alias("one"))
    out = None
    for label in ("mixed", "one"):
        got = splits.prefix_split_or_stratified(o, "o_orderkey", "o_custkey", label, 5).select(F.lit(label).alias("label"), F.col("id").alias("o_orderkey"), "split")
        out = got if out is None else out.unionByName(got)
    return out


def _monthly(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("score"))
    return o.select(F.unix_timestamp("m").alias("epoch"), "score")


def plateau_schedule(spark, d):
    return splits.plateau_rates(_monthly(spark, d), "epoch", "score", 0.001).select("epoch", F.round("rate", 9).alias("rate"))


def checkpoint_trigger(spark, d):
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 250).alias("b"), F.lit(1).alias("n"))
    return splits.checkpoint_marks(e, "b", "n", 1000)


def loss_over_keys(spark, d):
    """Mean of the losses of the keys that have pairs; 0 for a batch whose keys have none."""
    p = table(spark, d, "events").select(F.floor(F.col("event_id") / 1000).alias("batch"), "event_type", F.when(F.col("value") > 50, F.col("value")).alias("loss"))
    keys = p.groupBy("batch", "event_type").agg(F.avg("loss").alias("loss"))
    return keys.groupBy("batch").agg(F.round(F.coalesce(F.avg("loss"), F.lit(0.0)), 4).alias("loss"), F.count("loss").alias("keys"))


def weighted_cluster_mean(spark, d):
    v = _v(spark, d).select("label", "e", (F.col("vec_id") % 5).cast("double").alias("w"))
    m = R.weighted_means(v, "label", "w")
    return m.select("center_id", F.posexplode("center").alias("dim", "x")).select("center_id", "dim", F.round("x", 5).alias("x"))


def negatives_without_self(spark, d):
    """The three most similar others of each vector in its batch."""
    p = R.batch_pairs(_v(spark, d), BATCH).select("i", "j", F.round(vec.dot(F.col("a"), F.col("b")), 9).alias("s"))
    w = Window.partitionBy("i").orderBy(F.desc("s"), "j")
    return p.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("i", "rank", "j")


def angle_lists(spark, d):
    """Of each molecule the angles of its pairs of bonds in order, padded within batches of 64 with -5."""
    a = G.bond_angles(G.angle_triples(graphs.edges(spark, d)), graphs.atoms(spark, d))
    rows = a.groupBy("mol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("e1", "e2", "angle"))), lambda x: x["angle"]).alias("q"))
    p = batching.padded(batching.numbered_batches(rows, "mol_id", 64), "q", -5.0)
    return p.select("mol_id", F.size("q").alias("width"), F.size(F.filter("q", lambda x: x == -5.0)).alias("pads"), F.round(F.aggregate("q", F.lit(0.0), lambda s, x: s + F.when(x == -5.0, 0.0).otherwise(x)), 4).alias("total"))


def padded_indices(spark, d):
    """Bond ends of each molecule padded with zero rows to the longest of batches of 64."""
    e = graphs.edges(spark, d).groupBy("mol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "a", "b"))), lambda x: F.array(x["a"].cast("int"), x["b"].cast("int"))).alias("ends"))
    p = batching.padded_rows(batching.numbered_batches(e, "mol_id", 64), "ends", 2)
    return p.select("mol_id", F.posexplode("ends").alias("at", "x")).select("mol_id", "at", F.element_at("x", 1).alias("a"), F.element_at("x", 2).alias("b"))


def padded_distances(spark, d):
    """Square matrices of distances, padded with 0 to the longest of batches of 64."""
    p = G.pair_distances(graphs.atoms(spark, d)).groupBy("mol_id", "i").agg(F.array_sort(F.collect_list(F.struct("j", "d"))).alias("r"))
    m = p.groupBy("mol_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.transform("r", lambda x: x["d"]).alias("r")))), lambda x: x["r"]).alias("q"))
    s = batching.padded_square(batching.numbered_batches(m, "mol_id", 64), "q", 0.0)
    flat = F.flatten("q")
    return s.select("mol_id", F.size("q").alias("side"), F.size(flat).alias("cells"), F.round(F.aggregate(flat, F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def attribute_types(spark, d):
    """Columns of a batch kept and cast by name: whole numbers, floats, texts as they are."""
    t = batching.typed(table(spark, d, "data_collator"), {"atom_length", "edge_length"}, {"label_y"}, {"mol_id", "smiles"})
    return t.agg(F.sum("atom_length").alias("atoms"), F.sum("edge_length").alias("bonds"), F.count("smiles").alias("texts"), F.round(F.sum("label_y"), 2).alias("labels"), F.lit(",".join(sorted(t.columns))).alias("columns"))


def positional_labels(spark, d):
    """Labels joined to rows by their places in two lists of equal order."""
    a = table(spark, d, "freesolv").select("row_id", "smiles")
    b = table(spark, d, "freesolv").select(F.col("row_id").alias("k"), "expt")
    return readers.join_by_place(a, [F.col("row_id")], b, [F.col("k")]).select("row_id", "expt")


def block_merge(spark, d):
    """Blocks merged in order into one table, then deleted."""
    root = f"{shared_dir(spark)}/merge-{os.path.basename(tempfile.mktemp())}"
    readers.write_blocks(table(spark, d, "freesolv").select("row_id", "expt"), root + "/blocks", "row_id", 500)
    merged, left = readers.merge_blocks(spark, root + "/blocks", root + "/whole", "row_id")
    return merged.agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("expt"), 4).alias("total")).withColumn("blocks_left", F.lit(left))


def sorted_members(spark, d):
    """The row ids of each group in order, groups in order of size."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("m"))
    return o.select("o_custkey", F.posexplode("m").alias("at", "o_orderkey"))


def percentile_bar_full(spark, d):
    """All 101 points."""
    bar = table(spark, d, "freesolv").agg(scalar.percentile_bar(F.col("expt"), [float(i) for i in range(101)]).alias("bar"))
    return bar.select(F.posexplode("bar").alias("at", "value")).select("at", F.round("value", 6).alias("value"))


def json_round_trip(spark, d):
    path = f"{shared_dir(spark)}/json-{os.path.basename(tempfile.mktemp())}"
    readers.write_json(table(spark, d, "data_collator").select("mol_id", "text_name", F.slice("morgan2048_fp", 1, 8).alias("bits")), path)
    x = spark.read.schema("mol_id long, text_name string, bits array<int>").json(path)
    return x.select("mol_id", "text_name", F.aggregate("bits", F.lit(0), lambda s, b: s + b).alias("ones"))


def headerless_list(spark, d):
    path = f"{shared_dir(spark)}/list-{os.path.basename(tempfile.mktemp())}.txt"
    table(spark, d, "customer").select(F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("value")).write.text(path)
    return readers.read_list(spark, path)


def text_functions(spark, d):
    p = table(spark, d, "customer")
    return p.select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_name").alias("low"), F.trim(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("bare"), F.element_at(F.split("c_name", "#"), 1).alias("head"), F.regexp_replace("c_name", "[0-9]", "").alias("letters"), F.length("c_name").alias("size"))


MONTHS = "s AS (SELECT epoch(date_trunc('month', o_orderdate))::BIGINT AS epoch, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1)"
SQL = {
    "separation_bonus": f"WITH {BASE}, {HITS}, {W}, {TG}, {Q}, {BP}, m AS (SELECT (SELECT avg(sim) FROM q) AS p, (SELECT avg(s) FROM bp WHERE i <> j) AS n) SELECT vec_id, center_modality, round(0.7 * score + 0.3 / (1 + exp(-5 * (p - n))), 4) AS score FROM q, m",
    "hard_negative_k": "SELECT p_partkey, CASE WHEN b > 1 THEN greatest(1, least(10, b - 1, floor(b * 0.3::DOUBLE))) ELSE 0 END::INTEGER AS by_share, least(greatest(b // 4, 1), greatest(2 * b - 1, 1), 10)::INTEGER AS by_quarter FROM (SELECT p_partkey, p_size::INTEGER AS b FROM part)",
    "vocabulary_size": "SELECT 4::INTEGER AS size, true AS fits",
    "plateau_schedule": f"WITH RECURSIVE {MONTHS}, o AS (SELECT *, row_number() OVER (ORDER BY epoch) AS k FROM s), f AS (SELECT k, epoch, score AS best, 0 AS bad, 0.001::DOUBLE AS rate FROM o WHERE k = 1 UNION ALL SELECT o.k, o.epoch, CASE WHEN score < best * (1 - 1e-4::DOUBLE) THEN score ELSE best END, CASE WHEN score < best * (1 - 1e-4::DOUBLE) OR bad = 5 THEN 0 ELSE bad + 1 END, CASE WHEN score >= best * (1 - 1e-4::DOUBLE) AND bad = 5 THEN rate * 0.5::DOUBLE ELSE rate END FROM f JOIN o ON o.k = f.k + 1) SELECT epoch, round(rate, 9) AS rate FROM f",
    "checkpoint_trigger": "WITH b AS (SELECT event_id // 250 AS batch, count(*) AS n FROM events GROUP BY 1), t AS (SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS total FROM b) SELECT batch, total, total % 1000 = 0 AS checkpoint FROM t",
    "loss_over_keys": "WITH k AS (SELECT event_id // 1000 AS batch, event_type, avg(value) FILTER (value > 50) AS loss FROM events GROUP BY ALL) SELECT batch, round(coalesce(avg(loss), 0), 4) AS loss, count(loss) AS keys FROM k GROUP BY 1",
    "weighted_cluster_mean": f"WITH {V}, x AS (SELECT label AS center_id, vec_id % 5 AS w, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) SELECT center_id, dim, round(sum(w * x) / sum(w), 5) AS x FROM x GROUP BY ALL HAVING sum(w) > 0",
    "negatives_without_self": f"WITH {V}, {BP} SELECT i, rank, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(s, 9) DESC, j) AS rank FROM bp WHERE i <> j) WHERE rank <= 3",
    "angle_lists": graphs.SQL["bond_angle"].split(" SELECT mol_id, e1, e2, round(angle")[0] + ", l AS (SELECT mol_id, count(*) AS n, sum(angle) AS t FROM g GROUP BY 1), w AS (SELECT *, max(n) OVER (PARTITION BY mol_id // 64) AS width FROM l) SELECT mol_id, width::INTEGER AS width, (width - n)::INTEGER AS pads, round(t, 4) AS total FROM w",
    "padded_indices": f"WITH {graphs.A}, {graphs.E_}, r AS (SELECT mol_id, row_number() OVER (PARTITION BY mol_id ORDER BY edge_id) - 1 AS at, a, b, count(*) OVER (PARTITION BY mol_id) AS n FROM ed), w AS (SELECT mol_id, max(max(n)) OVER (PARTITION BY mol_id // 64) AS longest FROM r GROUP BY mol_id), p AS (SELECT mol_id, unnest(range(0, longest)) AS at FROM w) SELECT p.mol_id, p.at::INTEGER AS at, coalesce(r.a, 0)::INTEGER AS a, coalesce(r.b, 0)::INTEGER AS b FROM p LEFT JOIN r ON r.mol_id = p.mol_id AND r.at = p.at",
    "padded_distances": f"WITH {graphs.A}, t AS (SELECT p.mol_id, sum({graphs.D3}) AS total FROM ats p JOIN ats q ON p.mol_id = q.mol_id GROUP BY 1), n AS (SELECT mol_id, count(*) AS n FROM ats GROUP BY 1), w AS (SELECT mol_id, max(n) OVER (PARTITION BY mol_id // 64) AS side FROM n) SELECT mol_id, side::INTEGER AS side, (side * side)::INTEGER AS cells, round(total, 3) AS total FROM w JOIN t USING (mol_id)",
    "attribute_types": "SELECT sum(atom_length)::BIGINT AS atoms, sum(edge_length)::BIGINT AS bonds, count(smiles) AS texts, round(sum(label_y), 2) AS labels, 'atom_length,edge_length,label_y,mol_id,smiles' AS columns FROM data_collator",
    "positional_labels": "SELECT row_id, expt FROM freesolv",
    "block_merge": "SELECT count(*) AS rows, round(sum(expt), 4) AS total, 0::INTEGER AS blocks_left FROM freesolv",
    "sorted_members": "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS at, o_orderkey FROM orders",
    "percentile_bar_full": "SELECT (i - 1)::INTEGER AS at, round(b[i], 6) AS value FROM (SELECT quantile_cont(expt, [" + ", ".join(f"{i / 100}" for i in range(101)) + "]) AS b FROM freesolv), range(1, 102) t(i)",
    "json_round_trip": "SELECT mol_id, text_name, list_sum(morgan2048_fp[1:8])::INTEGER AS ones FROM data_collator",
    "headerless_list": "SELECT c_name AS value FROM customer",
    "text_functions": "SELECT c_custkey, upper(c_name) AS up, lower(c_name) AS low, c_name AS bare, split_part(c_name, '#', 1) AS head, regexp_replace(c_name, '[0-9]', '', 'g') AS letters, length(c_name)::INTEGER AS size FROM customer",
}
# where all rows are of one class there is one stratum
STRATIFIED = "SELECT 'one' AS label, o_orderkey, CASE WHEN r <= floor(total * 0.8) THEN 'train' WHEN r <= floor(total * 0.8) + floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey, 5)), o_orderkey) AS r, count(*) OVER () AS total FROM orders)"
SQL["split_fallback"] = tables.SQL["split_prefix"].rsplit(" SELECT * FROM sp", 1)[0] + f" SELECT 'mixed' AS label, o_orderkey, split FROM orders JOIN sp ON grp = CAST(o_custkey AS VARCHAR) UNION ALL {STRATIFIED}"
QUERIES = {n: globals()[n] for n in SQL}
