"""Registered queries over embeddings: retrieval, pairs, losses, incremental centers. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molquarry.functions import vec
from molquarry.operators import retrieval as R
from molquarry.streaming import centers as C
from molquarry.session import table

K, T = 5, 0.07
#: Least quality of a pair; the tables' vectors have few similar centers.
LEAST = 0.02

# SQL building blocks
V = """v AS (SELECT vec_id, label, ['image','text','audio'][vec_id % 3 + 1] AS modality, list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-8)) AS e
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings))"""
CM = """cm AS (SELECT modality, label, dim, avg(x) AS value FROM (SELECT modality, label, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM v) GROUP BY ALL)"""
C_ = """c AS (SELECT modality, center_id, list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-8)) AS center
  FROM (SELECT modality, label AS center_id, list(value ORDER BY dim) AS x FROM cm GROUP BY ALL))"""
HITS = f"""h AS (SELECT * FROM (SELECT vec_id, v.modality, c.modality AS center_modality, center_id, list_dot_product(e, center) AS sim,
  row_number() OVER (PARTITION BY vec_id, c.modality ORDER BY list_dot_product(e, center) DESC, center_id) AS rank FROM v JOIN c ON c.modality <> v.modality) WHERE rank <= {K})"""
W = f"""w AS (SELECT *, exp(z - max(z) OVER p) / sum(exp(z - mz)) OVER p AS weight FROM (SELECT *, max(z) OVER (PARTITION BY vec_id, center_modality) AS mz FROM (SELECT *, -(2 - 2 * sim) / ({T} + 1e-6) AS z FROM h))
  WINDOW p AS (PARTITION BY vec_id, center_modality))"""
TG = """t AS (SELECT vec_id, modality, center_modality, list_transform(x, lambda y: y / greatest(sqrt(list_dot_product(x, x)), 1e-8)) AS target FROM
  (SELECT vec_id, modality, center_modality, list(s ORDER BY dim) AS x FROM (SELECT vec_id, modality, center_modality, dim, sum(weight * u) AS s FROM
  (SELECT vec_id, w.modality, center_modality, weight, unnest(center) AS u, generate_subscripts(center, 1) AS dim FROM w JOIN c ON c.modality = w.center_modality AND c.center_id = w.center_id) GROUP BY ALL) GROUP BY ALL))"""
Q = """q AS (SELECT *, CASE WHEN sim > 0.3 AND sim < 0.95 THEN (sim - 0.3) / (0.65 + 1e-8) ELSE 0 END AS score FROM
  (SELECT t.vec_id, t.modality, t.center_modality, list_dot_product(e, target) AS sim FROM t JOIN v ON v.vec_id = t.vec_id))"""
BASE = ", ".join((V, CM, C_))
BATCH = 32
BP = f"bp AS (SELECT a.vec_id // {BATCH} AS batch_id, a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id // {BATCH} = b.vec_id // {BATCH})"


def _v(spark: SparkSession, d: str) -> DataFrame:
    return R.modal_vectors(table(spark, d, "embeddings"))


def _vc(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = _v(spark, d)
    return v, R.centers(v)


def topk_centers(spark, d):
    v, c = _vc(spark, d)
    return R.topk_centers(v, c, 10).select("vec_id", "modality", "center_id", "rank", F.round("distance", 6).alias("distance"))


def nearest_center(spark, d):
    v, c = _vc(spark, d)
    return R.topk_centers(v, c, 1).select("vec_id", "modality", "center_id", F.round("distance", 6).alias("distance"))


def center_means(spark, d):
    return R.center_means(_v(spark, d)).select("modality", "label", "dim", F.round("value", 6).alias("value"))


def gather_centers(spark, d):
    v, c = _vc(spark, d)
    hits = R.topk_centers(v, c, K, other_modality=True).select("vec_id", F.col("center_modality").alias("modality"), "center_id", "rank")
    return hits.join(F.broadcast(c), ["modality", "center_id"]).select("vec_id", "modality", "center_id", "rank", F.round(F.element_at("center", 1), 6).alias("first_dim"))


def softmax_weights(spark, d):
    v, c = _vc(spark, d)
    return R.softmax_weights(R.topk_centers(v, c, K, other_modality=True), T).select("vec_id", "center_modality", "center_id", "rank", F.round("weight", 6).alias("weight"))


def weighted_targets(spark, d):
    v, c = _vc(spark, d)
    t = R.weighted_targets(R.softmax_weights(R.topk_centers(v, c, K, other_modality=True), T), c)
    return t.select("vec_id", "center_modality", F.posexplode("target").alias("dim", "x")).select("vec_id", "center_modality", "dim", F.round("x", 5).alias("x"))


def pair_quality(spark, d):
    v, c = _vc(spark, d)
    return R.pseudo_pairs(v, c, K, T).select("vec_id", "modality", "center_modality", F.round("sim", 5).alias("sim"), F.round("score", 5).alias("score"))


def pair_filter(spark, d):
    v, c = _vc(spark, d)
    return R.pseudo_pairs(v, c, K, T).filter(f"score > {LEAST}").select("vec_id", "center_modality", F.round("score", 5).alias("score"))


def pair_stats(spark, d):
    v, c = _vc(spark, d)
    p = R.pseudo_pairs(v, c, K, T)
    return p.groupBy("center_modality").agg(F.count_if(F.col("score") > 0.7).alias("num_pairs"), F.round(F.avg("score"), 5).alias("avg_quality"), F.round(F.avg((F.col("score") > 0.7).cast("double")), 6).alias("kept_ratio"))


def hard_negatives(spark, d):
    v, c = _vc(spark, d)
    return R.hard_negatives(v, c, 3, 2)


def inbatch_negatives(spark, d):
    return R.batch_pairs(_v(spark, d), BATCH).select("batch_id", "i", "j")


def sim_metrics(spark, d):
    p = R.batch_pairs(_v(spark, d), BATCH)
    a, b = F.col("a"), F.col("b")
    return p.select("i", "j", F.round(vec.similarity(a, b, "cosine", 0.5), 6).alias("cosine"), F.round(vec.similarity(a, b, "euclidean", 0.5), 6).alias("euclidean"), F.round(vec.similarity(a, b, "dot", 0.5), 6).alias("dot"))


def _logits(spark, d, metric="cosine"):
    v = _v(spark, d).withColumn("batch_id", F.floor(F.col("vec_id") / F.lit(BATCH)))
    a, b = v.select("batch_id", F.col("vec_id").alias("i"), F.col("e").alias("a")), v.select("batch_id", F.col("vec_id").alias("j"), F.col("e").alias("b"))
    return a.join(b, "batch_id").select("batch_id", "i", "j", vec.dot(F.col("a"), F.col("b")).alias("s"))


def infonce_loss(spark, d):
    x = _logits(spark, d).withColumn("z", F.col("s") / T).withColumn("diag", F.col("i") == F.col("j"))
    return R.info_nce(x, "batch_id", "i", "z", "diag").select("batch_id", F.round("loss", 5).alias("loss"))


def infonce_pooled(spark, d):
    """Mean over positives of -log(e^pos / (sum e^pos + sum e^neg)), pairs of a batch that share the label being positive.

    Batches of odd number are given without their negatives: their loss is the negative mean similarity.
    """
    v = _v(spark, d).select(F.col("vec_id").alias("i"), "label")
    x = _logits(spark, d).filter("i <> j").join(v, "i").join(v.select(F.col("i").alias("j"), F.col("label").alias("other")), "j")
    pos = F.col("label") == F.col("other")
    x = x.filter(pos | (F.col("batch_id") % 2 == 0)).withColumn("z", F.col("s") / T)
    g = x.groupBy("batch_id").agg(F.avg(F.when(pos, F.col("z"))).alias("p"), F.sum(F.exp("z")).alias("t"), F.count_if(~pos).alias("neg"))
    return g.filter("p is not null").select("batch_id", F.round(F.when(F.col("neg") > 0, F.log("t") - F.col("p")).otherwise(-F.col("p")), 5).alias("loss"))


def ntxent_loss(spark, d):
    """As infonce_loss, with the vectors of the previous batch as further columns (the queue)."""
    x = _logits(spark, d).select("batch_id", "i", (F.col("s") / T).alias("z"), (F.col("i") == F.col("j")).alias("diag"))
    v = _v(spark, d).withColumn("batch_id", F.floor(F.col("vec_id") / F.lit(BATCH)))
    queue = v.select((F.col("batch_id") + 1).alias("batch_id"), F.col("e").alias("b"))
    more = v.select("batch_id", F.col("vec_id").alias("i"), F.col("e").alias("a")).join(queue, "batch_id").select("batch_id", "i", (vec.dot(F.col("a"), F.col("b")) / T).alias("z"), F.lit(False).alias("diag"))
    return R.info_nce(x.unionByName(more), "batch_id", "i", "z", "diag").select("batch_id", F.round("loss", 5).alias("loss"))


def ntxent_hard_weight(spark, d):
    """Factor 1 + .1 * sum of softmax over the k hardest negatives: 1.1 for every row that has one."""
    x = _logits(spark, d).filter("i <> j")
    w = Window.partitionBy("batch_id", "i")
    top = x.withColumn("r", F.row_number().over(w.orderBy(F.desc("s"), "j"))).filter("r <= 10").withColumn("e", F.exp(F.col("s") / T - F.max(F.col("s") / T).over(w)))
    soft = top.withColumn("p", F.col("e") / F.sum("e").over(w))
    return soft.groupBy("batch_id", "i").agg(F.round(1 + 0.1 * F.sum("p"), 6).alias("factor"))


def neg_mean_sim(spark, d):
    return _logits(spark, d).groupBy("batch_id").agg(F.round(-F.avg("s"), 6).alias("loss"))


def three_way_contrastive(spark, d):
    """Of each batch, the mean over the three modality pairs of the InfoNCE loss between triples (vec_id div 3)."""
    v = _v(spark, d).withColumn("t", F.floor(F.col("vec_id") / 3)).withColumn("batch_id", F.floor(F.col("t") / F.lit(BATCH)))
    out = None
    for key, (a, b) in {"12": ("image", "text"), "13": ("image", "audio"), "23": ("text", "audio")}.items():
        left = v.filter(F.col("modality") == a).select("batch_id", F.col("t").alias("i"), F.col("e").alias("a"))
        right = v.filter(F.col("modality") == b).select("batch_id", F.col("t").alias("j"), F.col("e").alias("b"))
        x = left.join(right, "batch_id").select("batch_id", "i", (vec.dot(F.col("a"), F.col("b")) / T).alias("z"), (F.col("i") == F.col("j")).alias("diag"))
        one = R.info_nce(x, "batch_id", "i", "z", "diag").select(F.lit(key).alias("pair_key"), "batch_id", "loss")
        out = one if out is None else out.unionByName(one)
    per = out.groupBy("batch_id").agg(F.sum("loss").alias("s"))
    return per.select("batch_id", F.round(F.col("s") / 3, 5).alias("loss"))


def alignment_loss(spark, d):
    v = _v(spark, d).withColumn("t", F.floor(F.col("vec_id") / 3))
    m = {k: v.filter(F.col("modality") == k).select("t", F.col("e").alias(k)) for k in R.MODALITIES}
    j = m["image"].join(m["text"], "t").join(m["audio"], "t")
    mse = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return j.agg(F.round((F.avg(mse("image", "text")) + F.avg(mse("image", "audio")) + F.avg(mse("text", "audio"))) / 3, 6).alias("align"))


def center_stats(spark, d):
    v = table(spark, d, "embeddings").select(F.element_at(F.array(*map(F.lit, R.MODALITIES)), (F.col("vec_id") % 3 + 1).cast("int")).alias("modality"), vec.norm(vec.doubles(F.col("embedding"))).alias("n"))
    return v.groupBy("modality").agg(F.count(F.lit(1)).alias("count"), F.round(F.avg("n"), 6).alias("norm_mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 6).alias("norm_std"))


def _counted(spark, d):
    v, c = _vc(spark, d)
    return v.filter("modality = 'text'"), c.filter("modality = 'text'").select(F.col("center_id").cast("int").alias("center_id"), "center", (F.col("center_id") * 3.0).alias("count"))


def kmeans_step(spark, d):
    v, c = _counted(spark, d)
    return C.kmeans_step(v, c).select("center_id", F.round("count", 4).alias("count"), F.posexplode("center").alias("dim", "x")).select("center_id", "count", "dim", F.round("x", 5).alias("x"))


def momentum_merge(spark, d):
    v, c = _counted(spark, d)
    return C.momentum_merge(c, C.kmeans_step(v, c), 0.9).select("center_id", F.posexplode("center").alias("dim", "x")).select("center_id", "dim", F.round("x", 5).alias("x"))


def memory_bank_state(spark, d):
    b = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 96).alias("batch"), (F.col("vec_id") % 96).alias("pos"))
    return C.memory_bank(b, 250)


def fusion_mean_concat(spark, d):
    v = _v(spark, d).withColumn("t", F.floor(F.col("vec_id") / 3))
    m = {k: v.filter(F.col("modality") == k).select("t", F.col("e").alias(k)) for k in R.MODALITIES}
    j = m["image"].join(m["text"], "t").join(m["audio"], "t")
    mean = F.transform(vec.add(vec.add(F.col("image"), F.col("text")), F.col("audio")), lambda x: x / 3)
    third = F.element_at(F.concat("image", "text", "audio"), 129)
    return j.select("t", F.round(F.element_at(mean, 1), 6).alias("mean_first"), F.size(F.concat("image", "text", "audio")).alias("concat_size"), F.round(third, 6).alias("audio_first"))


def fusion_attention(spark, d):
    """Softmax over given scores (the first component of each vector) of the three vectors; first fused component."""
    v = _v(spark, d).withColumn("t", F.floor(F.col("vec_id") / 3)).withColumn("score", F.element_at("e", 1))
    w = Window.partitionBy("t")
    x = v.withColumn("p", F.exp("score") / F.sum(F.exp("score")).over(w))
    return x.groupBy("t").agg(F.round(F.sum(F.col("p") * F.element_at("e", 2)), 6).alias("fused_second"))


TRIPLE = "v3 AS (SELECT *, vec_id // 3 AS t FROM v), j AS (SELECT a.t, a.e AS image, b.e AS text, c.e AS audio FROM v3 a JOIN v3 b ON a.t = b.t AND b.modality = 'text' JOIN v3 c ON a.t = c.t AND c.modality = 'audio' WHERE a.modality = 'image')"
NCE = "SELECT batch_id, round(avg(l), 5) AS loss FROM (SELECT batch_id, i, ln(sum(exp(z - m))) + any_value(m) - max(CASE WHEN diag THEN z END) AS l FROM (SELECT *, max(z) OVER (PARTITION BY batch_id, i) AS m FROM x) GROUP BY ALL) GROUP BY batch_id"
STEP = """a AS (SELECT vec_id, e, arg_min(center_id, struct_pack(d := list_dot_product(center, center) - 2 * list_dot_product(e, center), k := center_id)) AS center_id FROM (SELECT * FROM v WHERE modality = 'text') v, (SELECT * FROM c WHERE modality = 'text') c GROUP BY vec_id, e),
 m AS (SELECT center_id, dim, avg(x) AS mean, count(*) AS n FROM (SELECT center_id, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS dim FROM a) GROUP BY ALL),
 o AS (SELECT center_id, center_id * 3.0 AS count, unnest(center) AS x, generate_subscripts(center, 1) - 1 AS dim FROM c WHERE modality = 'text'),
 st AS (SELECT o.center_id, o.dim, o.x AS old, CAST(o.count * 0.99 + coalesce(n, 0) AS DOUBLE) AS count, CASE WHEN mean IS NULL THEN o.x WHEN o.count > 0 THEN o.x * (1 - 1.0::DOUBLE / (1 + o.count)) + mean / (1 + o.count)::DOUBLE ELSE mean END AS x
  FROM o LEFT JOIN m ON m.center_id = o.center_id AND m.dim = o.dim)"""

SQL = {
    "topk_centers": f"WITH {BASE} SELECT vec_id, modality, center_id, rank, round(2 - 2 * sim, 6) AS distance FROM (SELECT vec_id, v.modality, center_id, list_dot_product(e, center) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(e, center) DESC, center_id) AS rank FROM v JOIN c ON c.modality = v.modality) WHERE rank <= 10",
    "nearest_center": f"WITH {BASE} SELECT vec_id, modality, center_id, round(2 - 2 * sim, 6) AS distance FROM (SELECT vec_id, v.modality, center_id, list_dot_product(e, center) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(e, center) DESC, center_id) AS rank FROM v JOIN c ON c.modality = v.modality) WHERE rank = 1",
    "center_means": f"WITH {V}, {CM} SELECT modality, label, dim, round(value, 6) AS value FROM cm",
    "gather_centers": f"WITH {BASE}, {HITS} SELECT vec_id, c.modality, c.center_id, rank, round(center[1], 6) AS first_dim FROM h JOIN c ON c.modality = h.center_modality AND c.center_id = h.center_id",
    "softmax_weights": f"WITH {BASE}, {HITS}, {W} SELECT vec_id, center_modality, center_id, rank, round(weight, 6) AS weight FROM w",
    "weighted_targets": f"WITH {BASE}, {HITS}, {W}, {TG} SELECT vec_id, center_modality, generate_subscripts(target, 1) - 1 AS dim, round(unnest(target), 5) AS x FROM t",
    "pair_quality": f"WITH {BASE}, {HITS}, {W}, {TG}, {Q} SELECT vec_id, modality, center_modality, round(sim, 5) AS sim, round(score, 5) AS score FROM q",
    "pair_filter": f"WITH {BASE}, {HITS}, {W}, {TG}, {Q} SELECT vec_id, center_modality, round(score, 5) AS score FROM q WHERE score > {LEAST}",
    "pair_stats": f"WITH {BASE}, {HITS}, {W}, {TG}, {Q} SELECT center_modality, count(*) FILTER (score > 0.7) AS num_pairs, round(avg(score), 5) AS avg_quality, round(avg(CASE WHEN score > 0.7 THEN 1.0::DOUBLE ELSE 0 END), 6) AS kept_ratio FROM q GROUP BY 1",
    "hard_negatives": f"WITH {BASE}, r AS (SELECT vec_id, c.modality AS center_modality, center_id, row_number() OVER (PARTITION BY vec_id, c.modality ORDER BY list_dot_product(e, center) DESC, center_id) AS k, row_number() OVER (PARTITION BY vec_id, c.modality ORDER BY center_id) - 1 AS place, count(*) OVER (PARTITION BY vec_id, c.modality) AS size FROM v JOIN c ON c.modality <> v.modality), t AS (SELECT *, (place - ('0x' || substr(md5(concat_ws(':', vec_id, center_modality, 0)), 1, 8))::BIGINT % size + size) % size AS turn FROM r) SELECT vec_id, center_modality, center_id, 'hard' AS kind FROM r WHERE k <= 3 UNION ALL SELECT vec_id, center_modality, center_id, 'random' FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, center_modality ORDER BY turn) AS n FROM t WHERE k > 3) WHERE n <= 2",
    "inbatch_negatives": f"SELECT a.vec_id // {BATCH} AS batch_id, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id // {BATCH} = b.vec_id // {BATCH} AND a.vec_id <> b.vec_id",
    "sim_metrics": f"WITH {V} SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e, b.e) / 0.5, 6) AS cosine, round(-list_distance(a.e, b.e) / 0.5, 6) AS euclidean, round(list_dot_product(a.e, b.e) / 0.5, 6) AS dot FROM v a JOIN v b ON a.vec_id // {BATCH} = b.vec_id // {BATCH} AND a.vec_id <> b.vec_id",
    "infonce_loss": f"WITH {V}, {BP}, x AS (SELECT batch_id, i, s / {T} AS z, i = j AS diag FROM bp) {NCE}",
    "infonce_pooled": f"WITH {V}, {BP}, x AS (SELECT batch_id, s / {T} AS z, a.label = b.label AS pos FROM bp JOIN v a ON a.vec_id = i JOIN v b ON b.vec_id = j WHERE i <> j AND (a.label = b.label OR batch_id % 2 = 0)) SELECT batch_id, round(CASE WHEN count(*) FILTER (NOT pos) > 0 THEN ln(sum(exp(z))) ELSE 0 END - avg(z) FILTER (pos), 5) AS loss FROM x GROUP BY batch_id HAVING count(*) FILTER (pos) > 0",
    "ntxent_loss": f"WITH {V}, {BP}, x AS (SELECT batch_id, i, s / {T} AS z, i = j AS diag FROM bp UNION ALL SELECT a.vec_id // {BATCH}, a.vec_id, list_dot_product(a.e, b.e) / {T}, false FROM v a JOIN v b ON a.vec_id // {BATCH} = b.vec_id // {BATCH} + 1) {NCE}",
    "ntxent_hard_weight": f"WITH {V}, {BP}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS k FROM bp WHERE i <> j), t AS (SELECT *, exp(s / {T}) / sum(exp(s / {T})) OVER (PARTITION BY i) AS p FROM r WHERE k <= 10) SELECT batch_id, i, round(1 + 0.1 * sum(p), 6) AS factor FROM t GROUP BY ALL",
    "neg_mean_sim": f"WITH {V}, {BP} SELECT batch_id, round(-avg(s), 6) AS loss FROM bp GROUP BY 1",
    "three_way_contrastive": f"WITH {V}, v3 AS (SELECT *, vec_id // 3 AS t, vec_id // 3 // {BATCH} AS batch_id FROM v), p AS (SELECT CASE WHEN a.modality = 'image' AND b.modality = 'text' THEN '12' WHEN a.modality = 'image' THEN '13' ELSE '23' END AS pair_key, a.batch_id, a.t AS i, list_dot_product(a.e, b.e) / {T} AS z, a.t = b.t AS diag FROM v3 a JOIN v3 b ON a.batch_id = b.batch_id WHERE (a.modality, b.modality) IN (('image', 'text'), ('image', 'audio'), ('text', 'audio'))), l AS (SELECT pair_key, batch_id, avg(l) AS loss FROM (SELECT pair_key, batch_id, i, ln(sum(exp(z))) - max(CASE WHEN diag THEN z END) AS l FROM p GROUP BY ALL) GROUP BY ALL) SELECT batch_id, round(sum(loss) / 3, 5) AS loss FROM l GROUP BY 1",
    "alignment_loss": f"WITH {V}, {TRIPLE} SELECT round((avg(list_distance(image, text) ** 2 / 64) + avg(list_distance(image, audio) ** 2 / 64) + avg(list_distance(text, audio) ** 2 / 64)) / 3, 6) AS align FROM j",
    "center_stats": "SELECT ['image','text','audio'][vec_id % 3 + 1] AS modality, count(*) AS count, round(avg(n), 6) AS norm_mean, round(coalesce(stddev_samp(n), 0), 6) AS norm_std FROM (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings) GROUP BY 1",
    "kmeans_step": f"WITH {BASE}, {STEP} SELECT center_id, round(count, 4) AS count, dim, round(x, 5) AS x FROM st",
    "momentum_merge": f"WITH {BASE}, {STEP}, n AS (SELECT center_id, dim, 0.9 * old + 0.1 * x AS y FROM st) SELECT center_id, dim, round(y / sqrt(sum(y * y) OVER (PARTITION BY center_id)), 5) AS x FROM n",
    "memory_bank_state": "WITH b AS (SELECT vec_id // 96 AS batch, vec_id % 96 AS pos FROM embeddings), s AS (SELECT batch, coalesce(sum(count(*)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 250 AS ptr FROM b GROUP BY batch), p AS (SELECT CAST(ptr + pos AS BIGINT) AS slot, batch, pos FROM b JOIN s USING (batch) WHERE ptr + pos < 250) SELECT slot, max(batch) AS batch, arg_max(pos, batch) AS pos FROM p GROUP BY slot",
    "fusion_mean_concat": f"WITH {V}, {TRIPLE} SELECT t, round((image[1] + text[1] + audio[1]) / 3, 6) AS mean_first, len(image) + len(text) + len(audio) AS concat_size, round(audio[1], 6) AS audio_first FROM j",
    "fusion_attention": f"WITH {V} SELECT vec_id // 3 AS t, round(sum(exp(e[1]) * e[2]) / sum(exp(e[1])), 6) AS fused_second FROM v GROUP BY 1",
}
QUERIES = {n: globals()[n] for n in SQL}
