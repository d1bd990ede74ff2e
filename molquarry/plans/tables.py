"""Registered queries over tables: scalar functions, metrics, splits, sources, malformed rows. Each with its SQL."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.functions import scalar
from molquarry.operators import batching, malformed, metrics, splits
from molquarry.sources import readers
from molquarry.sources.versions import VersionStore, checksum, retained
from molquarry.session import shared_dir, table

# a regression table: prediction from quantity; a classification table: score from the price
REG = "SELECT l_extendedprice AS y, l_quantity * 2000.0::DOUBLE AS pred FROM lineitem"
CLF = "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_extendedprice / 100000.0::DOUBLE AS score, CASE WHEN l_extendedprice / 100000.0::DOUBLE > 0.5 THEN 1 ELSE 0 END AS pred FROM lineitem"


def _reg(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0).alias("pred"))


def _clf(spark, d):
    s = F.col("l_extendedprice") / 100000.0
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), s.alias("score"), (s > 0.5).cast("int").alias("pred"))


def class_hist(spark, d):
    return metrics.class_histogram(table(spark, d, "lineitem"), "l_returnflag").withColumn("percent", F.round("percent", 6))


def target_stats(spark, d):
    return table(spark, d, "freesolv").agg(F.round(F.avg("expt"), 6).alias("mean"), F.round(F.stddev_pop("expt"), 6).alias("std"), F.min("expt").alias("lo"), F.max("expt").alias("hi"))


def group_stats(spark, d):
    c = table(spark, d, "freesolv").groupBy("source")
    pos = F.col("expt") > -4
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(pos).alias("n_pos"), F.count_if(~pos).alias("n_neg"), F.round(F.count_if(pos) / F.count(F.lit(1)), 6).alias("pos_ratio"), F.round(F.avg("expt"), 6).alias("mean"), F.round(F.stddev_pop("expt"), 6).alias("std"))


def pos_weight(spark, d):
    return metrics.positive_weight(_clf(spark, d), "y").select(F.round("pos_weight", 6).alias("pos_weight"))


def clf_metrics(spark, d):
    return metrics.confusion(_clf(spark, d), "y", "pred").select("tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


def roc_auc(spark, d):
    return metrics.roc_auc(_clf(spark, d), "y", "score").select(F.round("auc", 6).alias("auc"))


def reg_metrics(spark, d):
    return metrics.regression(_reg(spark, d), "y", "pred").select(*[F.round(c, 2).alias(c) for c in ("mse", "rmse", "mae", "mean_error", "std_error", "max_error")], F.round("r2", 6).alias("r2"), F.round("mape", 4).alias("mape"))


def mape_guard(spark, d):
    x = table(spark, d, "freesolv").filter("expt is not null").select(F.col("expt").alias("y"), (F.col("expt") + 0.5).alias("pred"))
    return metrics.regression(x, "y", "pred").select(F.round("mape", 4).alias("mape"))


def correlations(spark, d):
    return metrics.correlations(_reg(spark, d), "y", "pred").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"), "n")


def correlation_p_values(spark, d):
    x = table(spark, d, "orders").select(F.col("o_totalprice").alias("a"), (F.col("o_custkey") % 97).cast("double").alias("b"))
    return metrics.correlations(x, "a", "b")


def bce_pos_weight(spark, d):
    x = _clf(spark, d).select("y", (F.col("score") * 4 - 2).alias("z"))
    return metrics.bce_with_logits(x, "y", "z", 3.0).select(F.round("bce", 6).alias("bce"))


def regression_losses(spark, d):
    x = _reg(spark, d).select((F.col("y") / 1000).alias("y"), (F.col("pred") / 1000).alias("pred"))
    return metrics.regression_losses(x, "y", "pred", 10.0).select(*[F.round(c, 4).alias(c) for c in ("mse", "mae", "huber")])


def loss_components(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"))


def task_total(spark, d):
    """main + w1 * contrastive + w2 * align with warm-up weights over 25 epochs, from generator_total's parts."""
    e = F.col("id").cast("double")
    main, con, align = 1.0 / (e + 1), 0.5 / (e + 2), 0.25 / (e + 3)
    total = main + scalar.warmup_weight(0.1, e, 10) * (con + 0.1 * align) + scalar.warmup_weight(0.05, e, 5) * align
    return spark.range(25).select(F.col("id").alias("epoch"), F.round(con + 0.1 * align, 9).alias("generator"), F.round(total, 9).alias("total"))


def masked_mean_pool(spark, d):
    """Mean quantity of the lines of each order that aren't returned, over max(count, 1)."""
    m = (F.col("l_returnflag") != "R").cast("double")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(m * F.col("l_quantity")) / F.greatest(F.sum(m), F.lit(1.0)), 6).alias("pooled"))


def impute(spark, d):
    return table(spark, d, "freesolv").select("row_id", scalar.impute(F.col("expt")).alias("expt"))


def nan_clamp(spark, d):
    x = F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf"))).when(F.col("l_linenumber") == 3, F.lit(None).cast("double")).otherwise(F.col("l_tax"))
    return table(spark, d, "lineitem").select(scalar.clamp_nan(x).alias("charge")).groupBy("charge").agg(F.count(F.lit(1)).alias("n"))


def vocab_encode(spark, d):
    v = ["view", "click", "purchase", "misc"]
    return table(spark, d, "events").select("event_id", scalar.vocab_index(F.col("event_type"), v).alias("code"))


def binning(spark, d):
    return table(spark, d, "lineitem").select(scalar.bin_index(F.col("l_quantity"), 5.0, 45.0, 20).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def percentile_bar(spark, d):
    pts = [0.0, 10.0, 25.0, 50.0, 75.0, 90.0, 100.0]
    bar = table(spark, d, "freesolv").groupBy("source").agg(scalar.percentile_bar(F.col("expt"), pts).alias("bar"))
    return bar.select("source", F.posexplode("bar").alias("at", "value")).select("source", "at", F.round("value", 6).alias("value"))


def standardize(spark, d):
    """Each split by its own mean and sample deviation (parity), and by those of train."""
    x = table(spark, d, "freesolv").filter("expt is not null and split is not null")
    s = x.groupBy("split").agg(F.avg("expt").alias("m"), F.stddev_samp("expt").alias("s"))
    t = s.filter("split = 'train'").select(F.col("m").alias("tm"), F.col("s").alias("ts"))
    z = x.join(F.broadcast(s), "split").crossJoin(F.broadcast(t))
    own = scalar.standardize(F.col("expt"), F.col("m"), F.col("s"))
    return z.select("row_id", F.round(own, 6).alias("own"), F.round(scalar.standardize(F.col("expt"), F.col("tm"), F.col("ts")), 6).alias("by_train"), F.round(own * (F.col("s") + 1e-8) + F.col("m"), 6).alias("back"))


def activations(spark, d):
    x = (F.col("l_quantity") - 25) / 10
    names = ("relu", "sigmoid", "silu", "gelu", "selu", "leakyrelu", "hardswish", "rrelu", "none")
    return table(spark, d, "lineitem").select(x.alias("x")).distinct().select(F.round("x", 6).alias("x"), *[F.round(scalar.activation(F.col("x"), n), 6).alias(n + "_") for n in names])


def recommended_k(spark, d):
    x = table(spark, d, "part").select((F.col("p_partkey") * 7).alias("rows"), (F.col("p_size") * 8).alias("batch"))
    return x.select("rows", "batch", scalar.recommended_k(F.col("rows"), F.col("batch")).alias("k"))


def lr_schedule(spark, d):
    e = F.col("id").cast("double")
    return spark.range(60).select(F.col("id").alias("epoch"), F.round(scalar.cosine_rate(0.001, e, 60), 9).alias("cosine"), F.round(scalar.step_rate(0.001, e), 9).alias("step"), F.round(scalar.warmup_weight(0.3, e, 10), 9).alias("warmup"))


def pad_batch(spark, d):
    """Quantities of each order, padded within batches of 64 orders with -1, then + 1."""
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("q"))
    p = batching.padded(batching.numbered_batches(o, "l_orderkey", 64), "q", -1.0, 1.0)
    return p.select("l_orderkey", F.size("q").alias("width"), F.aggregate("q", F.lit(0.0), lambda s, x: s + x).alias("total"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).alias("mask_ones"), F.size("mask").alias("mask_size"))


def max_lengths(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return batching.numbered_batches(o, "l_orderkey", 64).groupBy("batch_id").agg(F.max("n").alias("longest"))


def _groups(spark, d, key="o_custkey"):
    return splits.group_sizes(table(spark, d, "orders"), "o_orderkey", key)


def split_prefix(spark, d):
    return splits.prefix_split(_groups(spark, d)).select("grp", "n", "split")


def split_firstfit(spark, d):
    return splits.first_fit_split(_groups(spark, d)).select("grp", "n", "split")


def split_random_groups(spark, d):
    return splits.random_group_split(_groups(spark, d), 3).select("grp", "n", "split")


def random_split(spark, d):
    return splits.random_split(table(spark, d, "orders"), "o_orderkey", 5).select(F.col("id").alias("o_orderkey"), "split")


def stratified_split(spark, d):
    return splits.random_split(table(spark, d, "orders"), "o_orderkey", 5, "o_orderpriority").select(F.col("id").alias("o_orderkey"), "stratum", "split")


def split_report(spark, d):
    g = splits.prefix_split(_groups(spark, d))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("grp"), "o_totalprice")
    return splits.split_report(o.join(g.select("grp", "split"), "grp"), "o_totalprice").select("split", "rows", F.round("share", 6).alias("share"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "classes")


def split_overlap(spark, d):
    """Groups in more than one split: none."""
    g = splits.prefix_split(_groups(spark, d))
    return g.groupBy("grp").agg(F.count_distinct("split").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("overlapping"))


def _scores(spark, d):
    o = table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.avg("o_totalprice") / 100000, 6).alias("score"))
    return o.select(F.unix_timestamp("m").alias("epoch"), "score")


def early_stopping(spark, d):
    return splits.early_stopping(_scores(spark, d), "epoch", "score", 5, 0.02)


def best_epoch(spark, d):
    """The first epoch of the highest score."""
    return _scores(spark, d).orderBy(F.desc("score"), "epoch").limit(1)


def adaptive_temperature(spark, d):
    q = _scores(spark, d).select("epoch", (F.col("score") % 1.0).alias("q"))
    return splits.adaptive_temperature(q, "epoch", "q").select("step", F.round("temperature", 9).alias("temperature"))


def generation_stats(spark, d):
    """Running count of pairs and mean quality over the last 1000 of them."""
    e = table(spark, d, "events").select("event_id", "value")
    last = e.orderBy(F.desc("event_id")).limit(1000)
    return e.agg(F.count(F.lit(1)).alias("count")).crossJoin(last.agg(F.round(F.avg("value"), 6).alias("recent_quality")))


def stream_ingest_count(spark, d):
    """A file stream of events counted by type, run to its end; unknown types are counted in total only."""
    name = "ingest_" + os.path.basename(tempfile.mktemp())
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    where = tempfile.mkdtemp() if not spark.conf.get("spark.checkpoint.dir", None) else f"{shared_dir(spark)}/{name}"
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    agg = src.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    q = agg.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def window_counts(spark, d):
    """Events by hour and type with a watermark's semantics on a batch read (an extension, not parity)."""
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.unix_timestamp(F.col("w.start")).alias("start"), "event_type", "n", "total")


def version_metadata(spark, d):
    """Three versions of a table saved with retention 2: the kept ones, verified and re-read."""
    store = VersionStore(spark, f"{shared_dir(spark)}/versions-{os.path.basename(tempfile.mktemp())}", most=2)
    t = table(spark, d, "region")
    for i in range(3):
        store.save(t.filter(F.col("r_regionkey") >= i), tag=f"t{i}", version=f"v{i}")
    out = [(v["id"], v["tag"], store.load(spark, v["id"]).count(), store.verify(spark, v["id"]), store.metadata()["current_version"] == v["id"]) for v in store.metadata()["versions"]]
    return spark.createDataFrame(out, "id string, tag string, rows long, verified boolean, current boolean")


def version_retention(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"))
    return retained(x, 10).filter("keep").select("id")


def table_checksum(spark, d):
    """The checksum doesn't depend on the order of rows."""
    t = table(spark, d, "nation")
    return spark.createDataFrame([(checksum(t) == checksum(t.orderBy(F.desc("n_name")).repartition(3)), t.count())], "equal boolean, rows long")


def target_resolution(spark, d):
    t = table(spark, d, "embeddings")
    return t.select(F.col(readers.resolve_target(t.columns, "missing")).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def csv_round_trip(spark, d):
    """freesolv_raw's sound rows written with header and read again with a schema."""
    path = f"{shared_dir(spark)}/csv-{os.path.basename(tempfile.mktemp())}"
    readers.write_csv(table(spark, d, "customer"), path)
    return readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


def labelled_rows(spark, d):
    x = readers.labelled(table(spark, d, "freesolv").select("row_id", "smiles", "expt"), "row_id", ["expt", "row_id"])
    return x.select(F.col("smiles").alias("row_id"), F.element_at("labels", 1).alias("y0"), F.element_at("labels", 2).alias("y1"))


def cliff_filter(spark, d):
    x = table(spark, d, "freesolv").select("smiles", F.col("expt").alias("y"), (F.col("row_id") % 2).alias("cliff_mol"), "split")
    return readers.cliff_rows(x, "test")


def semi_filter(spark, d):
    done = table(spark, d, "esol").select(F.col("c0").alias("smiles"))
    return readers.keep_processed(table(spark, d, "freesolv").select("row_id", "smiles"), done, "smiles").select("row_id", "smiles")


def block_layout(spark, d):
    path = f"{shared_dir(spark)}/blocks-{os.path.basename(tempfile.mktemp())}"
    readers.write_blocks(table(spark, d, "freesolv").select("row_id", "expt"), path, "row_id", 500)
    return spark.read.parquet(path).groupBy(F.col("block").cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))


def limit_rows(spark, d):
    return table(spark, d, "freesolv").select("row_id", "expt").orderBy("row_id").limit(100)


def split_subset(spark, d):
    s = table(spark, d, "freesolv").select("row_id", "split")
    return readers.subset(table(spark, d, "freesolv").select("row_id", "expt"), s, "row_id", "valid")


def oversize_replacement(spark, d):
    return readers.replace_oversized(table(spark, d, "data_collator"), "mol_id", "atom_length")


def hashing(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.substring(F.md5("c_name"), 1, 8).alias("short"), F.sha2("c_name", 256).alias("checksum"))


def date_formats(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def p7_found(spark, d):
    return malformed.rejected(malformed.parse_lines(table(spark, d, "freesolv_raw")))


def p7_rows(spark, d):
    return malformed.loaded(malformed.parse_lines(table(spark, d, "freesolv_raw")))


def p7_edits(spark, d):
    return malformed.parse_lines(table(spark, d, "freesolv_raw")).filter("edits is not null").select("line_id", "reason", "edits")


def p7_report(spark, d):
    return malformed.report(malformed.parse_lines(table(spark, d, "freesolv_raw")))


RANKS = "(SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {r} FROM {t})"
G = "g AS (SELECT CAST(o_custkey AS VARCHAR) AS grp, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1), tot AS (SELECT sum(n) AS total FROM g)"
PREFIX = f"""{G}, b AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g), tr AS (SELECT coalesce(sum(n), 0) AS tn FROM b, tot WHERE before < floor(total * 0.8)),
 sp AS (SELECT grp, n, CASE WHEN before < floor(total * 0.8) THEN 'train' WHEN before - tn < floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split FROM b, tot, tr)"""
SCORES = "s AS (SELECT epoch(date_trunc('month', o_orderdate))::BIGINT AS epoch, round(avg(o_totalprice) / 100000, 6) AS score FROM orders GROUP BY 1)"
HSPLIT = "SELECT {cols}, CASE WHEN r <= floor(total * 0.8) THEN 'train' WHEN r <= floor(total * 0.8) + floor(total * 0.1) THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', o_orderkey, 5)), o_orderkey) AS r, count(*) OVER (PARTITION BY stratum) AS total FROM (SELECT o_orderkey, {s} AS stratum FROM orders))"
PAD = "o AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1), b AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey // 64) AS longest FROM o)"

SQL = {
    "class_hist": "SELECT l_returnflag AS label, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM lineitem GROUP BY 1",
    "target_stats": "SELECT round(avg(expt), 6) AS mean, round(stddev_pop(expt), 6) AS std, min(expt) AS lo, max(expt) AS hi FROM freesolv",
    "group_stats": "SELECT source, count(*) AS n, count(*) FILTER (expt > -4) AS n_pos, count(*) FILTER (NOT expt > -4) AS n_neg, round(count(*) FILTER (expt > -4) / count(*)::DOUBLE, 6) AS pos_ratio, round(avg(expt), 6) AS mean, round(stddev_pop(expt), 6) AS std FROM freesolv GROUP BY 1",
    "pos_weight": f"SELECT round(coalesce(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 1), 0)::DOUBLE, 1), 6) AS pos_weight FROM ({CLF})",
    "clf_metrics": f"SELECT tn, fp, fn, tp, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) AS n FROM ({CLF}))",
    "roc_auc": f"SELECT round((sum(CASE WHEN y = 1 THEN r END) - p * (p + 1) / 2.0::DOUBLE) / (p * q)::DOUBLE, 6) AS auc FROM (SELECT *, count(*) FILTER (y = 1) OVER () AS p, count(*) FILTER (y = 0) OVER () AS q FROM {RANKS.format(c='score', r='r', t=f'({CLF})')}) GROUP BY p, q",
    "reg_metrics": f"SELECT round(mse, 2) AS mse, round(sqrt(mse), 2) AS rmse, round(mae, 2) AS mae, round(me, 2) AS mean_error, round(sd, 2) AS std_error, round(mx, 2) AS max_error, round(1 - mse / v, 6) AS r2, round(CASE WHEN z THEN -1 ELSE ape * 100 END, 4) AS mape FROM (SELECT avg((pred - y) ** 2) AS mse, avg(abs(pred - y)) AS mae, avg(pred - y) AS me, stddev_pop(pred - y) AS sd, max(abs(pred - y)) AS mx, var_pop(y) AS v, bool_or(y = 0) AS z, avg(abs((pred - y) / nullif(y, 0))) AS ape FROM ({REG}))",
    "mape_guard": "SELECT round(CASE WHEN bool_or(expt = 0) THEN -1.0::DOUBLE ELSE avg(abs(0.5 / nullif(expt, 0))) * 100 END, 4) AS mape FROM freesolv WHERE expt IS NOT NULL",
    "correlations": f"SELECT round(corr(y, pred), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM {RANKS.format(c='y', r='rx', t=RANKS.format(c='pred', r='ry', t=f'({REG})'))}",
    "bce_pos_weight": f"SELECT round(avg((1 - y) * z + (1 + 2.0::DOUBLE * y) * (ln(1 + exp(-abs(z))) + greatest(-z, 0))), 6) AS bce FROM (SELECT y, score * 4 - 2 AS z FROM ({CLF}))",
    "regression_losses": f"SELECT round(avg(e * e), 4) AS mse, round(avg(e), 4) AS mae, round(avg(CASE WHEN e <= 10 THEN 0.5 * e * e ELSE 10 * (e - 5) END), 4) AS huber FROM (SELECT abs(pred / 1000 - y / 1000) AS e FROM ({REG}))",
    "loss_components": "SELECT event_type, round(coalesce(avg(value), 0), 6) AS mean FROM events GROUP BY 1",
    "task_total": "SELECT e AS epoch, round(c + 0.1 * a, 9) AS generator, round(m + (CASE WHEN e < 10 THEN 0.1::DOUBLE * e / 10 ELSE 0.1 END) * (c + 0.1 * a) + (CASE WHEN e < 5 THEN 0.05::DOUBLE * e / 5 ELSE 0.05 END) * a, 9) AS total FROM (SELECT e, 1.0::DOUBLE / (e + 1) AS m, 0.5::DOUBLE / (e + 2) AS c, 0.25::DOUBLE / (e + 3) AS a FROM range(25) t(e))",
    "masked_mean_pool": "SELECT l_orderkey, round(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) / greatest(count(*) FILTER (l_returnflag <> 'R'), 1), 6) AS pooled FROM lineitem GROUP BY 1",
    "impute": "SELECT row_id, coalesce(CASE WHEN isnan(expt) THEN NULL ELSE expt END, -1.0::DOUBLE) AS expt FROM freesolv",
    "nan_clamp": "SELECT CASE l_linenumber WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 10 WHEN 3 THEN NULL ELSE l_tax END AS charge, count(*) AS n FROM lineitem GROUP BY 1",
    "vocab_encode": "SELECT event_id, CASE event_type WHEN 'view' THEN 0::BIGINT WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS code FROM events",
    "binning": "SELECT CAST(least(greatest(floor((l_quantity - 5) / 2.0::DOUBLE), 0), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1",
    "percentile_bar": "SELECT source, generate_subscripts(b, 1) - 1 AS at, round(unnest(b), 6) AS value FROM (SELECT source, coalesce(quantile_cont(expt, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), [0.0::DOUBLE, 0, 0, 0, 0, 0, 0]) AS b FROM freesolv GROUP BY 1)",
    "standardize": "WITH s AS (SELECT split, avg(expt) AS m, stddev_samp(expt) AS s FROM freesolv WHERE expt IS NOT NULL AND split IS NOT NULL GROUP BY 1) SELECT row_id, round((expt - a.m) / (a.s + 1e-8), 6) AS own, round((expt - t.m) / (t.s + 1e-8), 6) AS by_train, round(expt, 6) AS back FROM freesolv f JOIN s a USING (split), s t WHERE t.split = 'train' AND expt IS NOT NULL",
    "activations": "SELECT round(x, 6) AS x, round(greatest(x, 0), 6) AS relu_, round(1 / (1 + exp(-x)), 6) AS sigmoid_, round(x / (1 + exp(-x)), 6) AS silu_, round(0.5 * x * (1 + tanh(0.7978845608028654 * (x + 0.044715 * x * x * x))), 6) AS gelu_, round(1.0507009873554805 * CASE WHEN x > 0 THEN x ELSE 1.6732632423543772 * (exp(x) - 1) END, 6) AS selu_, round(CASE WHEN x >= 0 THEN x ELSE x * 0.01 END, 6) AS leakyrelu_, round(x * least(greatest(x + 3, 0), 6) / 6, 6) AS hardswish_, round(CASE WHEN x >= 0 THEN x ELSE x * 11.0::DOUBLE / 48 END, 6) AS rrelu_, round(x, 6) AS none_ FROM (SELECT DISTINCT (l_quantity - 25) / 10 AS x FROM lineitem)",
    "recommended_k": "SELECT rows, batch, CASE WHEN rows < 1000 THEN CASE WHEN batch <= 32 THEN 4 WHEN batch <= 64 THEN 8 ELSE 16 END WHEN rows < 10000 THEN CASE WHEN batch <= 32 THEN 8 WHEN batch <= 64 THEN 16 WHEN batch <= 128 THEN 32 ELSE 64 END ELSE CASE WHEN batch <= 32 THEN 16 WHEN batch <= 64 THEN 32 WHEN batch <= 128 THEN 64 WHEN batch <= 256 THEN 128 ELSE least(256, batch // 4) END END AS k FROM (SELECT p_partkey * 7 AS rows, p_size * 8 AS batch FROM part)",
    "lr_schedule": "SELECT e AS epoch, round(0.001::DOUBLE * (1 + cos(pi() * e / 60)) / 2, 9) AS cosine, round(0.001::DOUBLE * 0.5 ** (e // 10), 9) AS step, round(CASE WHEN e < 10 THEN 0.3::DOUBLE * e / 10 ELSE 0.3 END, 9) AS warmup FROM range(60) t(e)",
    "pad_batch": f"WITH {PAD} SELECT l_orderkey, CAST(longest AS INTEGER) AS width, q + n AS total, CAST(n + 1 AS INTEGER) AS mask_ones, CAST(longest + 1 AS INTEGER) AS mask_size FROM b",
    "max_lengths": f"WITH {PAD} SELECT l_orderkey // 64 AS batch_id, max(n) AS longest FROM b GROUP BY 1",
    "split_prefix": f"WITH {PREFIX} SELECT * FROM sp",
    "split_firstfit": f"WITH RECURSIVE {G}, o AS (SELECT *, row_number() OVER (ORDER BY n DESC, first DESC) AS k FROM g), f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, '' AS split UNION ALL SELECT o.k, o.grp, o.n, CASE WHEN f.a + o.n <= total * 0.8::DOUBLE THEN f.a + o.n ELSE f.a END, CASE WHEN f.a + o.n <= total * 0.8::DOUBLE OR f.a + f.b + o.n > total * (0.8::DOUBLE + 0.1::DOUBLE) THEN f.b ELSE f.b + o.n END, CASE WHEN f.a + o.n <= total * 0.8::DOUBLE THEN 'train' WHEN f.a + f.b + o.n <= total * (0.8::DOUBLE + 0.1::DOUBLE) THEN 'valid' ELSE 'test' END FROM f JOIN o ON o.k = f.k + 1, tot) SELECT grp, n, split FROM f WHERE k > 0",
    "split_random_groups": f"WITH RECURSIVE {G}, o AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', grp, 3)), grp) AS k FROM g), f AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS grp, 0::BIGINT AS n, 0::BIGINT AS a, 0::BIGINT AS b, '' AS split UNION ALL SELECT o.k, o.grp, o.n, CASE WHEN f.a + o.n <= floor(total * 0.1) THEN f.a + o.n ELSE f.a END, CASE WHEN f.a + o.n <= floor(total * 0.1) OR f.b + o.n > floor(total * 0.1) THEN f.b ELSE f.b + o.n END, CASE WHEN f.a + o.n <= floor(total * 0.1) THEN 'valid' WHEN f.b + o.n <= floor(total * 0.1) THEN 'test' ELSE 'train' END FROM f JOIN o ON o.k = f.k + 1, tot) SELECT grp, n, split FROM f WHERE k > 0",
    "random_split": HSPLIT.format(cols="o_orderkey", s="''"),
    "stratified_split": HSPLIT.format(cols="o_orderkey, stratum", s="o_orderpriority"),
    "split_report": f"WITH {PREFIX} SELECT split, count(*) AS rows, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, count(DISTINCT o_totalprice) AS classes FROM orders JOIN sp ON grp = CAST(o_custkey AS VARCHAR) GROUP BY split",
    "split_overlap": f"WITH {PREFIX} SELECT count(*) AS overlapping FROM (SELECT grp FROM sp GROUP BY grp HAVING count(DISTINCT split) > 1)",
    "early_stopping": f"WITH RECURSIVE {SCORES}, o AS (SELECT *, row_number() OVER (ORDER BY epoch) AS k FROM s), f AS (SELECT k, epoch, score, score AS best, 0 AS counter, false AS stop FROM o WHERE k = 1 UNION ALL SELECT o.k, o.epoch, o.score, CASE WHEN o.score > f.best + 0.02::DOUBLE THEN o.score ELSE f.best END, CASE WHEN o.score > f.best + 0.02::DOUBLE THEN 0 ELSE f.counter + 1 END, f.stop OR (CASE WHEN o.score > f.best + 0.02::DOUBLE THEN 0 ELSE f.counter + 1 END) >= 5 FROM f JOIN o ON o.k = f.k + 1) SELECT epoch, score, best, counter, stop FROM f",
    "best_epoch": f"WITH {SCORES} SELECT * FROM s ORDER BY score DESC, epoch LIMIT 1",
    "adaptive_temperature": f"WITH RECURSIVE {SCORES}, o AS (SELECT epoch, score % 1.0::DOUBLE AS q, row_number() OVER (ORDER BY epoch) AS k FROM s), f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS step, 0.07::DOUBLE AS t UNION ALL SELECT o.k, o.epoch, least(greatest(CASE WHEN q < 0.5 THEN t * 0.99::DOUBLE WHEN q > 0.8 THEN t * 1.01::DOUBLE ELSE t END, 0.01), 1.0) FROM f JOIN o ON o.k = f.k + 1) SELECT step, round(t, 9) AS temperature FROM f WHERE k > 0",
    "generation_stats": "SELECT (SELECT count(*) FROM events) AS count, round(avg(value), 6) AS recent_quality FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000)",
    "stream_ingest_count": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "window_counts": "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "version_metadata": "SELECT 'v' || i AS id, 't' || i AS tag, (SELECT count(*) FROM region WHERE r_regionkey >= i) AS rows, true AS verified, i = 2 AS current FROM range(1, 3) t(i)",
    "version_retention": "SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
    "table_checksum": "SELECT true AS equal, count(*) AS rows FROM nation",
    "target_resolution": "SELECT label AS target, count(*) AS n FROM embeddings GROUP BY 1",
    "csv_round_trip": "SELECT * FROM customer",
    "labelled_rows": "SELECT row_id, coalesce(expt, -1.0::DOUBLE) AS y0, row_id::DOUBLE AS y1 FROM freesolv",
    "cliff_filter": "SELECT smiles, expt AS y, row_id % 2 AS cliff_mol FROM freesolv WHERE split = 'test'",
    "semi_filter": "SELECT row_id, smiles FROM freesolv WHERE smiles IN (SELECT c0 FROM esol WHERE c0 IS NOT NULL)",
    "block_layout": "SELECT row_id // 500 AS block, count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM freesolv GROUP BY 1",
    "limit_rows": "SELECT row_id, expt FROM freesolv ORDER BY row_id LIMIT 100",
    "split_subset": "SELECT row_id, expt FROM freesolv WHERE split = 'valid'",
    "oversize_replacement": "WITH s AS (SELECT mol_id AS safe, row_number() OVER (ORDER BY mol_id) - 1 AS slot FROM (SELECT mol_id FROM data_collator WHERE atom_length <= 120 ORDER BY mol_id LIMIT 100)), d AS (SELECT mol_id, coalesce(atom_length, 0) > 120 AS big, ('0x' || substr(md5(concat_ws(':', mol_id, 0)), 1, 8))::BIGINT % (SELECT count(*) FROM s) AS slot FROM data_collator) SELECT mol_id, CASE WHEN big THEN safe ELSE mol_id END AS used_id FROM d LEFT JOIN s USING (slot)",
    "hashing": "SELECT c_custkey, substr(md5(c_name), 1, 8) AS short, sha256(c_name) AS checksum FROM customer",
    "date_formats": "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders",
    "json_fields": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
UNCHECKED = ("correlation_p_values", "p7_found", "p7_rows", "p7_edits", "p7_report")
QUERIES = {n: globals()[n] for n in (*SQL, *UNCHECKED)}
