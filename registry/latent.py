"""Linear sparse encoder, decoder, penalties and the variational scores over the given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexidra.functions.numeric import report
from lexidra.operators import encoders, stats
from lexidra.operators.postings import topk_activation as activate
from lexidra.operators.ranking import batch_id
from lexidra.plans.latent import ACTIVE, LATENTS, LinearModel, encode_sparse
from lexidra.plans.latent import latent_search as search_latents
from lexidra.plans.variational import VariationalModel
from lexidra.plans.variational import variational_search as search_sampled
from registry import tables
from registry.sql import LABEL_QUERIES, VECTORS, score_sum, snap, topk
from registry.sql import report as sql_report

DIM = tables.VEC_DIM
HIDDEN = 32
OUT = 16
BATCH = 100
ALPHA = 1.0
LABELS = 10
SAMPLED_QUANTILE = 0.3


def _digest_weight(scale: float, *parts: Column | str) -> Column:
    """Reproducible model weight: the first byte of a digest, centred and scaled."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(2)), 16, 10).cast("bigint") - F.lit(128)).cast("double") / F.lit(scale)


def _grid(spark: SparkSession, outs: int, inps: int, tag: str, scale: float) -> DataFrame:
    cells = spark.range(outs * inps).select(
        F.floor(F.col("id") / F.lit(inps)).cast("bigint").alias("out"), F.pmod("id", F.lit(inps)).cast("bigint").alias("inp")
    )
    return cells.withColumn("w", _digest_weight(scale, tag, F.col("out"), F.col("inp")))


def _bias(spark: SparkSession, n: int, tag: str, scale: float) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("out"), _digest_weight(scale, tag, F.col("id")).alias("b"))


def model(spark: SparkSession) -> LinearModel:
    weights = _grid(spark, LATENTS, DIM, "w", 128.0).select(F.col("out").alias("latent"), F.col("inp").alias("dim"), "w")
    pre = _bias(spark, DIM, "p", 4096.0).withColumnRenamed("out", "dim")
    latent = _bias(spark, LATENTS, "l", 1024.0).withColumnRenamed("out", "latent")
    return LinearModel(weights, pre, latent)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark)
    rows = tables.vectors(spark, sf_dir).select("vec_id", F.col("vec").alias("z"))
    return encoders.linear_encode(rows, m.weights, m.pre_bias, m.latent_bias, vec_col="z")


def linear_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.components(_encoded(spark, sf_dir), "vec_id", "z")
    return rows.withColumn("value", report("value"))


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_sparse(tables.vectors(spark, sf_dir), model(spark))


def topk_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = activate(_encoded(spark, sf_dir), ACTIVE, "vec_id", "z")
    return rows.select("vec_id", "dim", "term", report("weight").alias("weight"))


def latent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "vec")
    run = search_latents(docs, tables.label_queries(spark, sf_dir), model(spark))
    return run.select("query_id", "doc_id", report("score").alias("score"))


def _decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model(spark)
    docs = tables.vectors(spark, sf_dir).select("vec_id")
    return encoders.linear_decode(_postings(spark, sf_dir), encoders.decoder_rows(m.weights), m.pre_bias, docs, DIM)


def linear_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.components(_decoded(spark, sf_dir), "vec_id").withColumn("value", report("value"))


def reconstruction_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.reconstruction_mse(tables.vectors(spark, sf_dir), _decoded(spark, sf_dir), ALPHA)
    return rows.select(report("mse").alias("mse"))


def sparsity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.sparsity_stats(_postings(spark, sf_dir), tables.vectors(spark, sf_dir))
    return rows.select(*[report(c).alias(c) for c in rows.columns])


def l1_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.l1_penalty(_postings(spark, sf_dir), ALPHA).select(F.round("l1", 3).alias("l1"))


def flops_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.flops_penalty(_postings(spark, sf_dir), tables.vectors(spark, sf_dir), ALPHA)
    return rows.select(report("flops").alias("flops"))


def _distortion(spark: SparkSession, sf_dir: str, size: int | None) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("vec_id", F.col("vec").alias("x"), F.col("vec").alias("z"))
    images = encoders.mlp_score(rows, _layers(spark)[:1], vec_col="z")
    batched = batch_id(images, "vec_id", size) if size else images.withColumn("batch_id", F.lit(0).cast("bigint"))
    out = stats.relative_distance_distortion(batched, ALPHA)
    return out.select("batch_id", report("distortion").alias("distortion"))


def relative_distance_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against their first-layer images, batch by batch."""
    return _distortion(spark, sf_dir, BATCH)


def distortion_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over one batch of all vectors."""
    return _distortion(spark, sf_dir, None)


def latent_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per label, in label order."""
    labels = tables.vectors(spark, sf_dir).select("vec_id", F.col("label").alias("batch"))
    fired = _postings(spark, sf_dir).select("vec_id", F.col("dim").alias("latent"), "weight").join(labels, "vec_id")
    n = labels.agg((F.max("batch") + 1).alias("n")).first()["n"]
    return stats.latent_staleness(fired, spark.range(LATENTS).withColumnRenamed("id", "latent"), n)


def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.layer_norm(tables.vectors(spark, sf_dir))
    long = rows.select("vec_id", "mu", "std", F.posexplode("vec").alias("dim", "value"))
    return long.select(
        "vec_id", F.col("dim").cast("bigint").alias("dim"), report("value").alias("value"), report("mu").alias("mu"), report("std").alias("std")
    )


def _layers(spark: SparkSession) -> list[tuple[DataFrame, DataFrame]]:
    return [
        (_grid(spark, HIDDEN, DIM, "m0", 128.0), _bias(spark, HIDDEN, "c0", 128.0)),
        (_grid(spark, OUT, HIDDEN, "m1", 128.0), _bias(spark, OUT, "c1", 128.0)),
    ]


def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.vectors(spark, sf_dir).select("vec_id", "vec")
    out = encoders.mlp_score(rows, _layers(spark), "lrelu", 0.1)
    return tables.components(out, "vec_id").withColumn("value", report("value"))


def variational_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole variational method: label means as centroids and as queries, the ten best vectors of each."""
    wide = DIM + LABELS
    nets = {
        tag: [
            (_grid(spark, HIDDEN, wide, f"{tag}0", 128.0), _bias(spark, HIDDEN, f"{tag}c", 128.0)),
            (_grid(spark, OUT, HIDDEN, f"{tag}1", 1024.0), _bias(spark, OUT, f"{tag}d", 128.0)),
        ]
        for tag in ("g", "v")
    }
    means = tables.label_queries(spark, sf_dir)
    chosen = VariationalModel(means.withColumnRenamed("query_id", "cluster"), nets["g"], nets["v"])
    docs = tables.vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "vec")
    run = search_sampled(docs, means, chosen, SAMPLED_QUANTILE, seed=7, k=10)
    return run.select("query_id", "doc_id", report("score").alias("score"), "rank")


def _gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component value, label mean and a positive variance per (vector, dimension)."""
    rows = tables.vectors(spark, sf_dir)
    means = tables.components(tables.label_queries(spark, sf_dir), "query_id", "vec", "mu").withColumnRenamed("query_id", "label")
    long = rows.select("vec_id", "label", F.posexplode("vec").alias("dim", "x")).withColumn("dim", F.col("dim").cast("bigint"))
    return long.join(means, ["label", "dim"]).select(
        "vec_id", "dim", "x", "mu", (F.lit(0.01) + F.col("mu") * F.col("mu")).alias("v")
    )


def diag_gaussian_logpdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.diag_gaussian_logpdf(_gaussians(spark, sf_dir))
    return rows.select("vec_id", report("logpdf").alias("logpdf"))


def gaussian_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoders.gaussian_sample(_gaussians(spark, sf_dir), seed=7)
    return rows.select("vec_id", "dim", report("z").alias("z"))


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per user, the users standing for epochs and their events for steps."""
    steps = tables.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("epoch"), F.col("value").alias("loss"), (F.col("value") * F.lit(0.5)).alias("dist_loss")
    )
    rows = stats.epoch_means(steps, ["loss", "dist_loss"])
    return rows.select("epoch", report("loss").alias("loss"), report("dist_loss").alias("dist_loss"))


QUERIES = {
    "linear_encode": linear_encode,
    "topk_activation": topk_activation,
    "latent_search": latent_search,
    "linear_decode": linear_decode,
    "reconstruction_mse": reconstruction_mse,
    "sparsity_stats": sparsity_stats,
    "l1_penalty": l1_penalty,
    "flops_penalty": flops_penalty,
    "relative_distance_distortion": relative_distance_distortion,
    "distortion_of_all": distortion_of_all,
    "latent_staleness": latent_staleness,
    "layer_norm": layer_norm,
    "mlp_score": mlp_score,
    "variational_search": variational_search,
    "diag_gaussian_logpdf": diag_gaussian_logpdf,
    "gaussian_sample": gaussian_sample,
    "epoch_means": epoch_means,
}


def _byte(text: str, scale: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 2) AS BIGINT) - 128)::DOUBLE / {scale}::DOUBLE"


def _grid_sql(outs: int, inps: int, tag: str, scale: str) -> str:
    return f"""(SELECT o.range AS out, i.range AS inp, {_byte(f"'{tag}:' || o.range || ':' || i.range", scale)} AS w
        FROM range({outs}) o, range({inps}) i)"""


def _bias_sql(n: int, tag: str, scale: str) -> str:
    return f"(SELECT range AS out, {_byte(f"'{tag}:' || range", scale)} AS b FROM range({n}))"


_MODEL = f"""w AS MATERIALIZED {_grid_sql(LATENTS, DIM, 'w', '128.0')}, pb AS {_bias_sql(DIM, 'p', '4096.0')},
    lb AS {_bias_sql(LATENTS, 'l', '1024.0')}"""


def _encode_sql(source: str, name: str, id_col: str) -> str:
    return f"""{name}e AS MATERIALIZED (SELECT s.{id_col}, w.out AS dim, sum((s.x - pb.b) * w.w) + any_value(lb.b) AS z
        FROM {source} s JOIN pb ON pb.out = s.dim JOIN w ON w.inp = s.dim JOIN lb ON lb.out = w.out GROUP BY s.{id_col}, w.out),
      {name}p AS MATERIALIZED (SELECT {id_col}, dim, z AS weight FROM (SELECT * FROM {name}e
        QUALIFY row_number() OVER (PARTITION BY {id_col} ORDER BY z DESC, dim) <= {ACTIVE}) WHERE z > 0)"""


_ENCODED = f"{LABEL_QUERIES}, {_MODEL}, {_encode_sql('x', 'x', 'vec_id')}"
_DECODED = f"""{_ENCODED}, dec AS MATERIALIZED (SELECT i.vec_id, pb.out AS dim, coalesce(s.y, 0.0) + pb.b AS y
    FROM (SELECT vec_id FROM embeddings) i CROSS JOIN pb LEFT JOIN
    (SELECT xp.vec_id, w.inp, sum(xp.weight * w.w) AS y FROM xp JOIN w ON w.out = xp.dim GROUP BY ALL) s
    ON s.vec_id = i.vec_id AND s.inp = pb.out)"""


def _layer_sql(source: str, grid: str, bias: str, name: str, act: str = "{}") -> str:
    value = act.format("y")
    return f"""{name} AS MATERIALIZED (SELECT vec_id, dim, {value} AS x FROM (SELECT s.vec_id, g.out AS dim,
        sum(s.x * g.w) + any_value(c.b) AS y FROM {source} s JOIN {grid} g ON g.inp = s.dim JOIN {bias} c ON c.out = g.out
        GROUP BY s.vec_id, g.out))"""


_G0, _C0 = _grid_sql(HIDDEN, DIM, "m0", "128.0"), _bias_sql(HIDDEN, "c0", "128.0")
_G1, _C1 = _grid_sql(OUT, HIDDEN, "m1", "128.0"), _bias_sql(OUT, "c1", "128.0")
_GAUSS = f"""{LABEL_QUERIES}, g AS MATERIALIZED (SELECT x.vec_id, x.dim, x.x, lq.x AS mu, 0.01::DOUBLE + lq.x * lq.x AS v
    FROM x JOIN lq ON lq.query_id = x.label AND lq.dim = x.dim)"""


def _uniform_sql(tag: str, row: str = "vec_id") -> str:
    return f"((('0x' || substr(md5('7:{tag}:' || {row} || ':' || dim), 1, 13))::BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE"


def _sampled_sql(source: str, name: str) -> str:
    """CTEs ending in ``{name}z(vec_id, dim, weight)``, the postings of ``source(vec_id, dim, x)``."""
    lrelu = "CASE WHEN {0} > 0 THEN {0} ELSE 0.1::DOUBLE * {0} END"
    wide, nets = DIM + LABELS, []
    for tag, head in (("g", "{}"), ("v", "exp({})")):
        first = _layer_sql(f"{name}u", _grid_sql(HIDDEN, wide, f"{tag}0", "128.0"), _bias_sql(HIDDEN, f"{tag}c", "128.0"), f"{name}{tag}0", lrelu)
        nets += [first, _layer_sql(f"{name}{tag}0", _grid_sql(OUT, HIDDEN, f"{tag}1", "1024.0"), _bias_sql(OUT, f"{tag}d", "128.0"), f"{name}{tag}", head)]
    noise = f"sqrt(-2.0::DOUBLE * ln({_uniform_sql('r')})) * cos(2.0::DOUBLE * pi() * {_uniform_sql('a')})"
    return f"""{name}n AS MATERIALIZED (SELECT s.vec_id, lq.query_id AS label FROM {source} s JOIN lq ON lq.dim = s.dim GROUP BY s.vec_id, lq.query_id
          QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY {snap('sum((lq.x - s.x) * (lq.x - s.x))')}, lq.query_id) = 1),
      {name}u AS MATERIALIZED (SELECT vec_id, dim, x FROM {source} UNION ALL SELECT vec_id, {DIM} + label, 1.0 FROM {name}n),
      {', '.join(nets)},
      {name}s AS MATERIALIZED (SELECT vec_id, dim, m.x + {noise} * sqrt(v.x) AS z FROM {name}g m JOIN {name}v v USING (vec_id, dim)),
      {name}q AS (SELECT vec_id, quantile_cont(z, {SAMPLED_QUANTILE}) AS lo, quantile_cont(z, {1 - SAMPLED_QUANTILE}) AS hi FROM {name}s GROUP BY vec_id),
      {name}z AS MATERIALIZED (SELECT vec_id, dim, z AS weight FROM {name}s JOIN {name}q USING (vec_id) WHERE (z <= lo OR z >= hi) AND z <> 0)"""


def _distortion_sql(batch: str) -> str:
    return f"""WITH {VECTORS}, {_layer_sql('x', _G0, _C0, 'h')},
        b AS (SELECT vec_id, {batch} AS batch_id FROM embeddings),
        gx AS (SELECT batch_id, a.vec_id AS i, c.vec_id AS j, sum(a.x * c.x) AS g FROM x a JOIN b USING (vec_id)
          JOIN (SELECT * FROM x JOIN b USING (vec_id)) c USING (batch_id, dim) GROUP BY ALL),
        gz AS (SELECT batch_id, a.vec_id AS i, c.vec_id AS j, sum(a.x * c.x) AS g FROM h a JOIN b USING (vec_id)
          JOIN (SELECT * FROM h JOIN b USING (vec_id)) c USING (batch_id, dim) GROUP BY ALL),
        rx AS (SELECT *, g / max(g) FILTER (i = j) OVER (PARTITION BY i) AS r FROM gx),
        rz AS (SELECT *, g / max(g) FILTER (i = j) OVER (PARTITION BY i) AS r FROM gz)
        SELECT batch_id, {sql_report('sqrt(sum((rx.r - rz.r) * (rx.r - rz.r))) / count(DISTINCT rx.i)')} AS distortion
        FROM rx JOIN rz USING (batch_id, i, j) GROUP BY batch_id"""


ORACLE = {
    "variational_search": f"""WITH {LABEL_QUERIES}, means AS (SELECT CAST(query_id AS BIGINT) AS vec_id, dim, x FROM lq),
        {_sampled_sql('x', 'doc_')}, {_sampled_sql('means', 'query_')},
        sc AS (SELECT j.vec_id AS query_id, i.vec_id AS doc_id, {score_sum('j.weight * i.weight')} AS score
          FROM query_z j JOIN doc_z i ON i.dim = j.dim GROUP BY ALL)
        SELECT query_id, doc_id, {sql_report('score')} AS score, rank FROM {topk('sc', 10)}""",
    "linear_encode": f"WITH {_ENCODED} SELECT vec_id, dim, {sql_report('z')} AS value FROM xe",
    "topk_activation": f"WITH {_ENCODED} SELECT vec_id, dim, 'term_' || dim AS term, {sql_report('weight')} AS weight FROM xp",
    "latent_search": f"""WITH {_ENCODED}, {_encode_sql('lq', 'q', 'query_id')},
        sc AS (SELECT CAST(qp.query_id AS BIGINT) AS query_id, xp.vec_id AS doc_id, {score_sum('(qp.weight * f) * xp.weight')} AS score
          FROM (SELECT *, CASE WHEN max(weight) OVER (PARTITION BY query_id) > 64
            THEN 64.0::DOUBLE / max(weight) OVER (PARTITION BY query_id) ELSE 1.0 END AS f FROM qp) qp
          JOIN xp ON xp.dim = qp.dim GROUP BY ALL)
        SELECT query_id, doc_id, {sql_report('score')} AS score FROM {topk('sc', 1000)}""",
    "linear_decode": f"WITH {_DECODED} SELECT vec_id, dim, {sql_report('y')} AS value FROM dec",
    "reconstruction_mse": f"""WITH {_DECODED} SELECT {sql_report('avg((x.x - dec.y) * (x.x - dec.y))')} AS mse
        FROM x JOIN dec ON dec.vec_id = x.vec_id AND dec.dim = x.dim""",
    "sparsity_stats": f"""WITH {_ENCODED}, n AS (SELECT count(*)::DOUBLE AS n FROM embeddings)
        SELECT {sql_report('count(*) FILTER (weight <> 0) / any_value(n)')} AS nonzero_per_row,
        {sql_report('count(*) FILTER (abs(weight) >= 1e-3) / any_value(n)')} AS above_threshold_per_row FROM xp, n""",
    "l1_penalty": f"WITH {_ENCODED} SELECT round(sum(abs(weight)), 3) AS l1 FROM xp",
    "flops_penalty": f"""WITH {_ENCODED}, n AS (SELECT count(*)::DOUBLE AS n FROM embeddings),
        m AS (SELECT dim, sum(abs(weight)) / any_value(n) AS m FROM xp, n GROUP BY dim)
        SELECT {sql_report('sum(m * m)')} AS flops FROM m""",
    "relative_distance_distortion": _distortion_sql(f"CAST(floor((row_number() OVER (ORDER BY vec_id) - 1) / {BATCH}) AS BIGINT)"),
    "distortion_of_all": _distortion_sql("CAST(0 AS BIGINT)"),
    "latent_staleness": f"""WITH {_ENCODED}, nb AS (SELECT max(label) + 1 AS n FROM embeddings),
        last AS (SELECT dim, max(label) AS last FROM xp JOIN embeddings USING (vec_id) GROUP BY dim)
        SELECT r.range AS latent, CAST(nb.n - coalesce(last.last, 0) AS BIGINT) AS staleness
        FROM range({LATENTS}) r CROSS JOIN nb LEFT JOIN last ON last.dim = r.range""",
    "layer_norm": f"""WITH {VECTORS}, s AS (SELECT vec_id, avg(x) AS mu, stddev_samp(x) AS std FROM x GROUP BY vec_id)
        SELECT vec_id, dim, {sql_report('(x - mu) / (std + 1e-5)')} AS value, {sql_report('mu')} AS mu, {sql_report('std')} AS std
        FROM x JOIN s USING (vec_id)""",
    "mlp_score": f"""WITH {VECTORS}, {_layer_sql('x', _G0, _C0, 'h0', 'CASE WHEN {0} > 0 THEN {0} ELSE 0.1::DOUBLE * {0} END')},
        {_layer_sql('h0', _G1, _C1, 'h1')} SELECT vec_id, dim, {sql_report('x')} AS value FROM h1""",
    "diag_gaussian_logpdf": f"""WITH {_GAUSS} SELECT vec_id,
        {sql_report('sum(-0.5::DOUBLE * (ln(2.0::DOUBLE * pi()) + ln(v) + (x - mu) * (x - mu) / v))')} AS logpdf FROM g GROUP BY vec_id""",
    "gaussian_sample": f"""WITH {_GAUSS} SELECT vec_id, dim, {sql_report(
        f'mu + sqrt(-2.0::DOUBLE * ln({_uniform_sql("r")})) * cos(2.0::DOUBLE * pi() * {_uniform_sql("a")}) * sqrt(v)')} AS z FROM g""",
    "epoch_means": f"""SELECT user_id AS epoch, {sql_report('avg(value)')} AS loss, {sql_report('avg(value * 0.5::DOUBLE)')} AS dist_loss
        FROM events GROUP BY user_id""",
}
