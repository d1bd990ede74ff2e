"""Group-wise and random splits, and folds over ordered scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from molquarry.operators.skew import running_sum


def group_sizes(rows: DataFrame, row_id: str, group: str) -> DataFrame:
    """(group, n, first): null groups are singletons of their row."""
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row_"), F.col(row_id)))
    return rows.select(F.col(row_id).alias("id"), key.alias("grp")).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def prefix_split(groups: DataFrame, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(grp, n, split): largest first; train while it holds fewer than int(train * N) rows, then valid, then test.

    In closed form: a group's split follows from the rows before it, a running sum over groups.
    """
    total = groups.agg(F.sum("n").alias("total"))
    g = running_sum(groups, [F.desc("n"), F.col("first")], F.col("n"), "before").crossJoin(F.broadcast(total))
    most_train, most_valid = F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(valid))
    g = g.withColumn("in_train", F.col("before") < most_train)
    size = g.agg(F.coalesce(F.sum(F.when(F.col("in_train"), F.col("n"))), F.lit(0)).alias("train_rows"))
    g = g.crossJoin(F.broadcast(size))
    split = F.when(F.col("in_train"), "train").when(F.col("before") - F.col("train_rows") < most_valid, "valid").otherwise("test")
    return g.select("grp", "n", "first", split.alias("split"))


def first_fit_split(groups: DataFrame, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(grp, n, split): by (size, first row) descending, into train if it fits, else valid, else test.

    Groups of one size stand together, and where one of them doesn't fit no later one of its size does. So
    the fold is over sizes (fewer than sqrt(2 * rows) of them), and a group's split follows from its place.
    """
    sizes = groups.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect()
    total = sum(r["n"] * r["c"] for r in sizes)
    cut_a, cut_b = total * train, total * (train + valid)
    a = b = place = 0
    runs: list[tuple[int, int, int]] = []
    for r in sizes:
        n, c = r["n"], r["c"]
        in_train = min(c, max(int((cut_a - a) // n), 0))
        a += n * in_train
        in_valid = min(c - in_train, max(int((cut_b - a - b) // n), 0))
        b += n * in_valid
        runs.append((n, place + in_train, place + in_train + in_valid))
        place += c
    ends = groups.sparkSession.createDataFrame(runs, "n long, train_end long, valid_end long")
    placed = running_sum(groups, [F.desc("n"), F.desc("first")], F.lit(1), "place").join(ends, "n")
    return placed.select("grp", "n", "first", F.when(F.col("place") < F.col("train_end"), "train").when(F.col("place") < F.col("valid_end"), "valid").otherwise("test").alias("split"))


def random_group_split(groups: DataFrame, seed: int, valid: float = 0.1, test: float = 0.1) -> DataFrame:
    """(grp, n, split): groups in hashed order fill valid up to floor(valid * N), then test, else train.

    Each decision needs all before it, so one task reads the sorted groups once, without holding them.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    cut_a, cut_b = int(total * valid), int(total * test)

    def run(batches):
        a = b = 0
        for pdf in batches:
            split = []
            for n in pdf["n"].tolist():
                where = "valid" if a + n <= cut_a else "test" if b + n <= cut_b else "train"
                a, b = a + n * (where == "valid"), b + n * (where == "test")
                split.append(where)
            yield pdf.assign(split=split)

    order = F.md5(F.concat_ws(":", "grp", F.lit(seed)))
    ordered = groups.select("grp", "n", "first", order.alias("h")).repartition(1).sortWithinPartitions("h", "grp").drop("h")
    return ordered.mapInPandas(run, f"grp string, n long, first {dict(groups.dtypes)['first']}, split string")


def prefix_split_or_stratified(rows: DataFrame, row_id: str, group: str, label: str, seed: int) -> DataFrame:
    """(id, split): the prefix split, or, where a split in use has one class only, the stratified random split."""
    groups = group_sizes(rows, row_id, group)
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row_"), F.col(row_id)))
    first = rows.select(F.col(row_id).alias("id"), key.alias("grp"), F.col(label).alias("label")).join(prefix_split(groups).select("grp", "split"), "grp")
    poor = first.groupBy("split").agg(F.count_distinct("label").alias("k")).filter("k < 2").limit(1).count()
    return random_split(rows, row_id, seed, label).select("id", "split") if poor else first.select("id", "split")


def random_split(rows: DataFrame, row_id: str, seed: int, stratum: str | None = None, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """(id, stratum, split) by hashed order, within each stratum if given, at exact sizes.

    The place of a row is counted in hash buckets: rows are ranked within a bucket of the hash's first
    digits and offset by the rows of earlier buckets, so that no task ranks all rows.
    """
    key = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    h = rows.select(F.col(row_id).alias("id"), key.alias("stratum"), F.md5(F.concat_ws(":", F.col(row_id), F.lit(seed))).alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    counts = h.groupBy("stratum", "bucket").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stratum").orderBy("bucket")
    counts = counts.withColumn("offset", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("stratum"))).drop("n")
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy("h", "id"))).join(counts, ["stratum", "bucket"])
    place = F.col("r") + F.col("offset")
    a, b = F.floor(F.col("total") * F.lit(train)), F.floor(F.col("total") * F.lit(train)) + F.floor(F.col("total") * F.lit(valid))
    return ranked.select("id", "stratum", F.when(place <= a, "train").when(place <= b, "valid").otherwise("test").alias("split"))


def split_report(rows: DataFrame, value: str) -> DataFrame:
    """(split, rows, share, mean, std, classes)."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count_distinct(value).alias("classes"))
    return per.crossJoin(F.broadcast(total)).select("split", "rows", (F.col("rows") / F.col("total")).alias("share"), "mean", "std", "classes")


def early_stopping(scores: DataFrame, order: str, score: str, patience: int, min_delta: float) -> DataFrame:
    """(epoch, score, best, counter, stop): best moves only by more than min_delta, so this is a fold."""
    arr = scores.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("epoch"), F.col(score).alias("score")))).alias("xs"))
    item = "struct<epoch:bigint,score:double,best:double,counter:int,stop:boolean>"
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("counter"), F.lit(False).alias("stop"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s, x):
        better = s["best"].isNull() | (x["score"] > s["best"] + F.lit(min_delta))
        best = F.when(better, x["score"]).otherwise(s["best"])
        counter = F.when(better, F.lit(0)).otherwise(s["counter"] + 1)
        stop = s["stop"] | (counter >= patience)
        row = F.struct(x["epoch"].cast("bigint").alias("epoch"), x["score"].cast("double").alias("score"), best.alias("best"), counter.alias("counter"), stop.alias("stop"))
        return F.struct(best.alias("best"), counter.alias("counter"), stop.alias("stop"), F.concat(s["out"], F.array(row)).alias("out"))

    return arr.select(F.explode(F.aggregate("xs", start, step)["out"]).alias("r")).select("r.*")


def plateau_rates(scores: DataFrame, order: str, score: str, rate: float, factor: float = 0.5, patience: int = 5, mode: str = "min", threshold: float = 1e-4) -> DataFrame:
    """(epoch, rate): multiplied by ``factor`` after more than ``patience`` epochs without a better score.

    Better is below best * (1 - threshold), or above best * (1 + threshold) with mode max. One row an epoch,
    so this is a fold over few rows.
    """
    sign = -1.0 if mode == "min" else 1.0
    arr = scores.agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("epoch"), F.col(score).cast("double").alias("score")))).alias("xs"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(rate).alias("rate"), F.array().cast("array<struct<epoch:bigint,rate:double>>").alias("out"))

    def step(s, x):
        better = s["best"].isNull() | (F.lit(sign) * x["score"] > F.lit(sign) * s["best"] * F.lit(1 + sign * threshold))
        bad = F.when(better, F.lit(0)).otherwise(s["bad"] + 1)
        drop = bad > patience
        now = F.when(drop, s["rate"] * factor).otherwise(s["rate"])
        return F.struct(F.when(better, x["score"]).otherwise(s["best"]).alias("best"), F.when(drop, F.lit(0)).otherwise(bad).alias("bad"), now.alias("rate"), F.concat(s["out"], F.array(F.struct(x["epoch"].alias("epoch"), now.alias("rate")))).alias("out"))

    return arr.select(F.explode(F.aggregate("xs", start, step)["out"]).alias("r")).select("r.*")


def checkpoint_marks(batches: DataFrame, order: str, size: str, every: int) -> DataFrame:
    """(batch, total, checkpoint): running totals of samples; a checkpoint where a total is a multiple of ``every``."""
    x = batches.groupBy(F.col(order).alias("batch")).agg(F.sum(size).alias("n"))
    x = running_sum(x, [F.col("batch")], F.col("n"), "before").withColumn("total", F.col("before") + F.col("n"))
    return x.select("batch", "total", ((F.col("total") > 0) & (F.col("total") % F.lit(max(1, every)) == 0)).alias("checkpoint"))


def adaptive_temperature(qualities: DataFrame, order: str, quality: str, start_at: float = 0.07) -> DataFrame:
    """(step, temperature): x .99 below quality .5, x 1.01 above .8, kept within [.01, 1]; a fold over batches."""
    arr = qualities.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(quality).alias("q")))).alias("xs"))
    item = "struct<step:bigint,temperature:double>"
    start = F.struct(F.lit(start_at).alias("t"), F.array().cast(f"array<{item}>").alias("out"))

    def step(s, x):
        t = F.when(x["q"] < 0.5, s["t"] * 0.99).when(x["q"] > 0.8, s["t"] * 1.01).otherwise(s["t"])
        t = F.least(F.greatest(t, F.lit(0.01)), F.lit(1.0))
        return F.struct(t.alias("t"), F.concat(s["out"], F.array(F.struct(x["k"].cast("bigint").alias("step"), t.alias("temperature")))).alias("out"))

    return arr.select(F.explode(F.aggregate("xs", start, step)["out"]).alias("r")).select("r.*")
