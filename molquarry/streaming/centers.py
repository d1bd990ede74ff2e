"""Incremental centers: a k-means step, momentum merge, memory bank, and a foreachBatch library."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.functions import vec
from molquarry.operators.retrieval import array_sums
from molquarry.session import materialise
from molquarry.sources.versions import VersionStore


def assign(vectors: DataFrame, centers: DataFrame) -> DataFrame:
    """(vec_id, center_id) by least squared L2 distance, ties to the smaller id; centers are few and broadcast."""
    if centers.count() > 100_000:
        raise ValueError("centers are too many for a k-means step; use retrieval.topk_centers")
    rows = centers.select("center_id", "center").orderBy("center_id").collect()
    import numpy as np
    import pandas as pd

    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows])))

    def run(batches):
        ids, c = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            x = np.stack(pdf["e"].to_numpy())
            d = (c * c).sum(1)[None] - 2 * x @ c.T
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "center_id": ids[d.argmin(1)], "e": list(pdf["e"])})

    return vectors.select("vec_id", "e").mapInPandas(run, "vec_id long, center_id int, e array<double>")


def kmeans_step(vectors: DataFrame, centers: DataFrame, decay: float = 0.99) -> DataFrame:
    """(center_id, center, count) after one batch: alpha = 1 / (1 + count); counts decay, then grow.

    ``centers`` has (center_id, center, count). A center without samples keeps its place. Sums are made
    by (center, dimension) before the shuffle, so a center that takes most samples is no hot task.
    """
    got = assign(vectors, centers)
    sums = array_sums(got.withColumn("n", F.lit(1)), "center_id", "n")
    means = sums.select("center_id", F.transform("e", lambda v: v / F.col("n")).alias("mean"), F.col("n").cast("long").alias("n"))
    x = centers.join(means, "center_id", "left")
    alpha = F.lit(1.0) / (1 + F.col("count"))
    moved = F.when(F.col("count") > 0, F.zip_with("center", "mean", lambda c, m: c * (1 - alpha) + m * alpha)).otherwise(F.col("mean"))
    return x.select("center_id", F.coalesce(moved, "center").alias("center"), (F.col("count") * decay + F.coalesce("n", F.lit(0))).alias("count"))


def momentum_merge(old: DataFrame, new: DataFrame, momentum: float = 0.99) -> DataFrame:
    """(center_id, center) = normalize(m * old + (1 - m) * new)."""
    n = new.select("center_id", F.col("center").alias("fresh"))
    return old.join(n, "center_id").select("center_id", vec.l2_normalize(F.zip_with("center", "fresh", lambda a, b: a * momentum + b * (1 - momentum))).alias("center"))


def ema(old: DataFrame, new: DataFrame, momentum: float) -> DataFrame:
    """Momentum encoder parameters: m * old + (1 - m) * new."""
    n = new.select("name", F.col("value").alias("fresh"))
    return old.join(n, "name").select("name", F.zip_with("value", "fresh", lambda a, b: a * momentum + b * (1 - momentum)).alias("value"))


def memory_bank(batches: DataFrame, capacity: int) -> DataFrame:
    """(slot, batch, pos): the ring after all batches (batch, pos), pos from 0.

    A batch is written from the pointer; what would pass the end is cut off, and the pointer moves on by
    the batch's size modulo the capacity. The last writer of a slot stays.
    """
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # one row for each batch
    starts = sizes.withColumn("ptr", F.pmod(F.coalesce(F.sum("n").over(before), F.lit(0)), F.lit(capacity))).select("batch", "ptr")
    placed = batches.join(F.broadcast(starts), "batch").withColumn("slot", F.col("ptr") + F.col("pos")).filter(F.col("slot") < capacity)
    return placed.groupBy("slot").agg(F.max(F.struct("batch", "pos")).alias("last")).select("slot", "last.batch", "last.pos")


def farthest_first(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(center_id, center, count 0): k-means++ starts; the next start is drawn in proportion to d squared.

    Each draw is the row of least -ln(u) / d^2 with u from a hash of (id, round, seed): exact sampling by
    weight, one aggregate for each start, no row sent to the driver but the chosen one.
    """
    first = vectors.orderBy(F.md5(F.concat_ws(":", "vec_id", F.lit(seed)))).select("e").first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], "center_id int, center array<double>, count double")
    starts = [list(first["e"])]
    for r in range(1, min(k, vectors.count())):
        d = F.least(*[F.aggregate(F.zip_with("e", F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in starts]) if len(starts) > 1 else F.aggregate(F.zip_with("e", F.array(*map(F.lit, starts[0])), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        u = (F.pmod(F.xxhash64("vec_id", F.lit(r), F.lit(seed)), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
        best = vectors.agg(F.min_by("e", -F.log(u) / F.greatest(d, F.lit(1e-300))).alias("e")).first()
        starts.append(list(best["e"]))
    return vectors.sparkSession.createDataFrame([(i, c, 0.0) for i, c in enumerate(starts)], "center_id int, center array<double>, count double")


class CenterLibrary:
    """A versioned center table fed by foreachBatch.

    Samples of known modalities wait in a buffer table until ``trigger`` of them are there (never fewer
    than ``least``), then one k-means step and a momentum merge make the next version. Versions are named
    by batch id, so a batch that is replayed writes the same version again. Snapshots hold centers, counts
    and buffer, so that a restart goes on where it stopped.
    """

    def __init__(self, store: VersionStore, k: int, modalities: tuple[str, ...] = ("image", "text", "audio"), trigger: int = 1000, least: int = 100, buffer: int = 10_000, momentum: float = 0.99):
        self.store, self.k, self.modalities = store, k, modalities
        self.trigger, self.least, self.buffer, self.momentum = trigger, least, buffer, momentum

    def _empty(self, spark) -> DataFrame:
        return spark.createDataFrame([], "kind string, modality string, id long, e array<double>, count double, seq long")

    def update(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch (vec_id, modality, e)."""
        spark = batch.sparkSession
        state = self.store.load(spark, before=f"batch-{batch_id:012d}")
        state = self._empty(spark) if state is None else state
        fresh = batch.filter(F.col("modality").isin(*self.modalities)).select(F.lit("sample").alias("kind"), "modality", F.col("vec_id").alias("id"), vec.l2_normalize(F.col("e")).alias("e"), F.lit(0.0).alias("count"), F.lit(batch_id).cast("long").alias("seq"))
        waiting = state.filter("kind = 'sample'").unionByName(fresh)
        newest = Window.partitionBy("modality").orderBy(F.desc("seq"), F.desc("id"))
        waiting = materialise(waiting.withColumn("r", F.row_number().over(newest)).filter(F.col("r") <= self.buffer).drop("r"), "buffer")
        n = {r["modality"]: r["n"] for r in waiting.groupBy("modality").agg(F.count(F.lit(1)).alias("n")).collect()}
        out = waiting.filter(~F.col("modality").isin([m for m, c in n.items() if c >= max(self.trigger, self.least)]))
        for m in self.modalities:
            old = state.filter((F.col("kind") == "center") & (F.col("modality") == m)).select(F.col("id").cast("int").alias("center_id"), F.col("e").alias("center"), "count")
            if n.get(m, 0) >= max(self.trigger, self.least):
                x = waiting.filter(F.col("modality") == m).select(F.col("id").alias("vec_id"), "e")
                if old.isEmpty():
                    new = farthest_first(x, self.k)  # a first fit only sets starts; nothing is counted
                else:
                    step = kmeans_step(x, old)
                    new = momentum_merge(old, step, self.momentum).join(step.select("center_id", "count"), "center_id")
            else:
                new = old
            out = out.unionByName(new.select(F.lit("center").alias("kind"), F.lit(m).alias("modality"), F.col("center_id").cast("long").alias("id"), F.col("center").alias("e"), "count", F.lit(batch_id).cast("long").alias("seq")))
        self.store.save(out, tag="", version=f"batch-{batch_id:012d}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
