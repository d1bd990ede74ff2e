"""Center retrieval, negatives and pseudo pairs over embedding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from molquarry.functions import vec

MODALITIES = ("image", "text", "audio")
#: Bytes of centers that one broadcast may hold; a larger library is searched block by block.
BROADCAST_BYTES = 256 << 20


def modal_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, modality, label, e): vectors in double, scaled to length 1; modality by id."""
    names = F.array(*map(F.lit, MODALITIES))
    e = vec.l2_normalize(vec.doubles(F.col(vec_col)))
    return embeddings.select(F.col(id_col).alias("vec_id"), F.element_at(names, (F.col(id_col) % 3 + 1).cast("int")).alias("modality"), F.col(label).alias("label"), e.alias("e"))


def center_means(vectors: DataFrame) -> DataFrame:
    """(modality, label, dim, value): elementwise mean of each group, dims from 0."""
    long = vectors.select("modality", "label", F.posexplode("e").alias("dim", "x"))
    return long.groupBy("modality", "label", "dim").agg(F.avg("x").alias("value"))


def centers(vectors: DataFrame) -> DataFrame:
    """(modality, center_id, center): means of each group scaled to length 1."""
    rows = center_means(vectors).groupBy("modality", F.col("label").alias("center_id")).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("d"))
    return rows.select("modality", "center_id", vec.l2_normalize(F.transform("d", lambda x: x["value"])).alias("center"))


def _blocks(library: DataFrame, dims: int) -> list[DataFrame]:
    n = library.count()
    k = max(1, -(-n * dims * 8 // BROADCAST_BYTES))
    return [library] if k == 1 else [library.filter(F.pmod(F.xxhash64("modality", "center_id"), F.lit(k)) == i) for i in range(k)]


def topk_centers(vectors: DataFrame, library: DataFrame, k: int, other_modality: bool = False) -> DataFrame:
    """(vec_id, modality, center_modality, center_id, rank, sim, distance): the k centers most similar.

    Within a vector's own modality, or with ``other_modality`` in each other one. k is clamped to
    1 .. number of centers; ties go to the smaller center_id; distance = 2 - 2 sim. The library is
    broadcast in blocks of bounded size and multiplied as a matrix with each Arrow batch, so vectors are
    never shuffled unless the library needs several blocks.
    """
    head = library.select(F.size("center").alias("d")).first()
    if head is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, modality string, center_modality string, center_id int, rank int, sim double, distance double")
    k = max(1, k)
    out = None
    blocks = _blocks(library, head["d"])
    for block in blocks:
        rows = block.select("modality", "center_id", "center").orderBy("modality", "center_id").collect()
        by = {}
        for r in rows:
            by.setdefault(r["modality"], ([], []))
            by[r["modality"]][0].append(r["center_id"])
            by[r["modality"]][1].append(r["center"])
        shared = vectors.sparkSession.sparkContext.broadcast({m: (np.array(i), np.array(c)) for m, (i, c) in by.items()})

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for own, part in pdf.groupby("modality", sort=False):
                    x = np.stack(part["e"].to_numpy())
                    for m, (ids, c) in shared.value.items():
                        if (m == own) == other_modality:
                            continue
                        s = x @ c.T
                        n = min(k, len(ids))
                        top = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :n]
                        sim = np.take_along_axis(s, top, 1)
                        yield pd.DataFrame({
                            "vec_id": np.repeat(part["vec_id"].to_numpy(), n), "modality": own, "center_modality": m, "center_id": ids[top].ravel(),
                            "rank": np.tile(np.arange(1, n + 1), len(part)), "sim": sim.ravel(), "distance": 2 - 2 * sim.ravel(),
                        })

        got = vectors.select("vec_id", "modality", "e").mapInPandas(run, "vec_id long, modality string, center_modality string, center_id int, rank int, sim double, distance double")
        out = got if out is None else out.unionByName(got)
    if len(blocks) > 1:
        w = Window.partitionBy("vec_id", "center_modality").orderBy(F.desc("sim"), "center_id")
        out = out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out


def softmax_weights(hits: DataFrame, temperature: float) -> DataFrame:
    """(..., weight): softmax over the neighbours of each source by -distance / (T + 1e-6)."""
    w = Window.partitionBy("vec_id", "center_modality")
    z = -F.col("distance") / F.lit(temperature + 1e-6)
    e = hits.withColumn("z", z).withColumn("x", F.exp(F.col("z") - F.max("z").over(w)))
    return e.withColumn("weight", F.col("x") / F.sum("x").over(w)).drop("z", "x")


def weighted_targets(weights: DataFrame, library: DataFrame) -> DataFrame:
    """(vec_id, modality, center_modality, target): weighted sum of gathered centers, scaled to length 1."""
    lib = library.select(F.col("modality").alias("center_modality"), "center_id", "center")
    got = weights.join(lib, ["center_modality", "center_id"])
    # the few neighbours of a vector as one array of weighted centers, added up in place
    near = got.groupBy("vec_id", "modality", "center_modality").agg(F.collect_list(F.transform("center", lambda x: x * F.col("weight"))).alias("ws"))
    total = F.aggregate(F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))), F.element_at("ws", 1), lambda s, w: F.zip_with(s, w, lambda a, b: a + b))
    return near.select("vec_id", "modality", "center_modality", vec.l2_normalize(total).alias("target"))


def hard_negatives(vectors: DataFrame, library: DataFrame, hard: int, random: int, seed: int = 0) -> DataFrame:
    """(vec_id, center_modality, center_id, kind): the ``hard`` most similar centers of the other modalities,
    and ``random`` of the remaining ones.

    The random ones are those that follow a hashed place (md5 of vec_id, center_modality and seed) in the
    circle of a modality's centers by id, so only hard + random centers a vector are looked at.
    """
    top = topk_centers(vectors, library, hard, other_modality=True).select("vec_id", "center_modality", "center_id")
    lib = library.select(F.col("modality").alias("center_modality"), "center_id")
    sizes = lib.groupBy("center_modality").agg(F.count(F.lit(1)).alias("size"))
    placed = lib.withColumn("place", F.row_number().over(Window.partitionBy("center_modality").orderBy("center_id")) - 1)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "vec_id", "center_modality", F.lit(seed))), 1, 8), 16, 10).cast("long")
    asked = vectors.select("vec_id", "modality").join(F.broadcast(sizes), F.col("modality") != F.col("center_modality"))
    asked = asked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.least(F.col("size"), F.lit(hard + random)) - 1)))
    asked = asked.withColumn("place", ((h + F.col("turn")) % F.col("size")).cast("int")).join(placed, ["center_modality", "place"])
    rest = asked.select("vec_id", "center_modality", "center_id", "turn").join(top, ["vec_id", "center_modality", "center_id"], "left_anti")
    some = rest.withColumn("r", F.row_number().over(Window.partitionBy("vec_id", "center_modality").orderBy("turn"))).filter(F.col("r") <= random)
    return top.withColumn("kind", F.lit("hard")).unionByName(some.select("vec_id", "center_modality", "center_id", F.lit("random").alias("kind")))


def batch_pairs(vectors: DataFrame, size: int, batch: str = "batch_id") -> DataFrame:
    """(batch_id, i, j, a, b) of all i <> j in batches of ``size`` consecutive ids: at most size - 1 each."""
    b = vectors.withColumn(batch, F.floor(F.col("vec_id") / F.lit(size)))
    left = b.select(batch, F.col("vec_id").alias("i"), F.col("e").alias("a"))
    right = b.select(batch, F.col("vec_id").alias("j"), F.col("e").alias("b"))
    return left.join(right, batch).filter("i <> j")


def quality(sim: F.Column) -> F.Column:
    """(s - .3) / .65 for .3 < s < .95, else 0."""
    return F.when((sim > 0.3) & (sim < 0.95), (sim - 0.3) / F.lit(0.65 + 1e-8)).otherwise(F.lit(0.0))


def with_separation(pairs: DataFrame, negatives: DataFrame) -> DataFrame:
    """``pairs`` (..., sim, score) with score = .7 * score + .3 * sigmoid(5 * (mean positive - mean negative similarity)).

    ``negatives`` has (sim); without any the scores stay.
    """
    means = pairs.agg(F.avg("sim").alias("__p")).crossJoin(negatives.agg(F.avg("sim").alias("__n")))
    bonus = 1 / (1 + F.exp(-5 * (F.col("__p") - F.col("__n"))))
    scored = F.when(F.col("__n").isNull(), F.col("score")).otherwise(0.7 * F.col("score") + 0.3 * bonus)
    return pairs.crossJoin(F.broadcast(means)).withColumn("score", scored).drop("__p", "__n")


def weighted_means(vectors: DataFrame, center: str, weight: str) -> DataFrame:
    """(center_id, center): sum of weight * vector over the sum of weights, where that is above 0."""
    sums = array_sums(vectors.select(F.col(center).alias("center_id"), F.transform("e", lambda x: x * F.col(weight)).alias("e"), F.col(weight).alias("w")), "center_id", "w")
    return sums.filter("w > 0").select("center_id", F.transform("e", lambda x: x / F.col("w")).alias("center"))


def array_sums(rows: DataFrame, key: str, weight: str) -> DataFrame:
    """(key, e, weight): elementwise sums of arrays ``e``, and of ``weight``, by key.

    Summed in each Arrow batch first; only these partial sums are parted by place for the shuffle.
    """
    import numpy as np
    import pandas as pd

    kind = dict(rows.dtypes)[key]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                codes, names = pd.factorize(pdf[key])
                x = np.stack(pdf["e"].to_numpy())
                total = np.zeros((len(names), x.shape[1]))
                np.add.at(total, codes, x)
                yield pd.DataFrame({key: names, "e": list(total), weight: np.bincount(codes, pdf[weight], len(names))})

    part = rows.select(key, "e", F.col(weight).cast("double").alias(weight)).filter(F.col(key).isNotNull()).mapInPandas(run, f"{key} {kind}, e array<double>, {weight} double")
    dims = part.select(key, weight, F.posexplode("e").alias("dim", "x")).groupBy(key, "dim").agg(F.sum("x").alias("x"), F.sum(weight).alias(weight))
    whole = dims.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("d"), F.max(weight).alias(weight))
    return whole.select(key, F.transform("d", lambda d: d["x"]).alias("e"), weight)


def pseudo_pairs(vectors: DataFrame, library: DataFrame, k: int, temperature: float) -> DataFrame:
    """(vec_id, modality, center_modality, sim, score) of positive pairs (source, weighted target)."""
    targets = weighted_targets(softmax_weights(topk_centers(vectors, library, k, other_modality=True), temperature), library)
    both = vectors.select("vec_id", "e").join(targets, "vec_id")
    s = vec.dot(F.col("e"), F.col("target"))
    return both.select("vec_id", "modality", "center_modality", s.alias("sim"), quality(s).alias("score"))


def info_nce(pairs: DataFrame, batch: str, row: str, logit: str, positive: str) -> DataFrame:
    """(batch, loss): mean over rows of logsumexp(logits) - positive logit; ``positive`` marks the diagonal."""
    w = Window.partitionBy(batch, row)
    x = pairs.withColumn("m", F.max(logit).over(w))
    per = x.groupBy(batch, row).agg((F.log(F.sum(F.exp(F.col(logit) - F.col("m")))) + F.first("m") - F.max(F.when(F.col(positive), F.col(logit)))).alias("l"))
    return per.groupBy(batch).agg(F.avg("l").alias("loss"))
