"""Encoders: token vectors, linear and multi-layer maps, layer norm, Gaussian sampling.

A neural encoder is plugged in as a Python function over Arrow batches
(``encode_tokens``, ``encode_tokens_with``, ``encode_texts``).  ``hash_token_vectors`` is the built-in stand-in:
plain column expressions whose values are multiples of 2**-10, so that every later sum is
exact and independent of partitioning.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidra.functions.blocks import matrix, vector_column
from lexidra.functions.vectors import array_sum, as_double, let
from lexidra.session import SHIP_BYTES, arrow_if_small

HASH_DIM = 16
# Weight of the token itself, of its direct neighbours and of the neighbours two places away.
CONTEXT_WEIGHTS = (4, 2, 1)
CONTEXT_SCALE = 1024.0
STATIC_SCALE = 128.0
LAYER_NORM_EPS = 1e-5
DECODE_STEP = 256
ENCODE_BATCH = 128
# Tokens of a padded batch, and rows among which documents of similar length are brought together.
ENCODE_TOKENS = 1 << 14
BUCKET_ROWS = 4096


# --- token and text vectors ---------------------------------------------------------------


def _digest_lanes(token: Column) -> Column:
    """The 16 bytes of ``md5(token)``, four to a bigint with 16 bits each: an array of four."""

    def spread(x: Column) -> Column:
        parts = [F.shiftleft(x.bitwiseAND(0xFF << 8 * i), 8 * i) for i in range(4)]
        return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])

    def quarter(digits: Column, j: int) -> Column:
        return F.conv(F.substr(digits, F.lit(1 + 8 * j), F.lit(8)), 16, 10).cast("bigint")

    return let(F.md5(token), lambda digits: F.transform(F.array(*[quarter(digits, j) for j in range(4)]), spread))


def _lane(packed: list[Column], i: int) -> Column:
    return F.shiftright(packed[i // 4], 16 * (3 - i % 4)).bitwiseAND(0xFFFF)


# Four lanes of 128: what a missing neighbour contributes, 0 after centring.
CENTRE_LANES = 0x0080_0080_0080_0080


def hash_token_vectors(tokenized: DataFrame) -> DataFrame:
    """Contextual token vectors ``(doc_id, dl, pos, token, vec)`` of ``(doc_id, tokens, dl)``.

    Each component mixes one digest byte of the token and of its neighbours up to two
    places away, so the same token has different vectors in different places.  Tokens are
    hashed once and their neighbours picked inside the document's own row: no window, no
    shuffle.  The weighted sums run on four components at a time, packed into one bigint.
    """
    hashed = tokenized.select(
        "doc_id", "dl", "tokens", F.transform("tokens", lambda t: _digest_lanes(t)).alias("lanes")
    )
    window = F.transform(
        F.col("tokens"),
        lambda token, i: F.struct(
            i.cast("bigint").alias("pos"),
            token.alias("token"),
            F.get(F.col("lanes"), i).alias("own"),
            F.get(F.col("lanes"), i - 1).alias("l1"),
            F.get(F.col("lanes"), i + 1).alias("r1"),
            F.get(F.col("lanes"), i - 2).alias("l2"),
            F.get(F.col("lanes"), i + 2).alias("r2"),
        ),
    )
    rows = hashed.select("doc_id", "dl", F.inline(window))
    own, one, two = CONTEXT_WEIGHTS

    def part(name: str, j: int) -> Column:
        return F.coalesce(F.get(F.col(name), F.lit(j)), F.lit(CENTRE_LANES))

    mixed = rows.select(
        "doc_id",
        "dl",
        "pos",
        "token",
        *[
            (
                F.lit(own) * part("own", j)
                + F.lit(one) * (part("l1", j) + part("r1", j))
                + F.lit(two) * (part("l2", j) + part("r2", j))
            ).alias(f"_m{j}")
            for j in range(4)
        ],
    )
    packed = [F.col(f"_m{j}") for j in range(4)]
    centre = F.lit(128 * (own + 2 * one + 2 * two))
    components = [(_lane(packed, i) - centre).cast("double") / F.lit(CONTEXT_SCALE) for i in range(HASH_DIM)]
    return mixed.select("doc_id", "dl", "pos", "token", F.array(*components).alias("vec"))


def hash_static_vectors(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """Context-free vectors ``(term, vec)``, the stand-in for an input embedding table."""
    hashed = terms.select(F.col(term_col).alias("term"), _digest_lanes(F.col(term_col)).alias("_l"))
    packed = [F.col("_l")[j] for j in range(4)]
    components = [(_lane(packed, i) - F.lit(128)).cast("double") / F.lit(STATIC_SCALE) for i in range(HASH_DIM)]
    return hashed.select("term", F.array(*components).alias("vec"))


def encode_tokens(
    tokenized: DataFrame, encoder: Callable[[list[list[str]]], list[np.ndarray]], batch_size: int = ENCODE_BATCH
) -> DataFrame:
    """Contextual vectors from a plugged-in encoder: ``(doc_id, dl, pos, token, vec)``.

    ``encoder`` receives the token lists of at most ``batch_size`` documents and returns one
    matrix per document with one row per token.
    """

    def encoded(batch: pd.DataFrame) -> pd.DataFrame:
        lists = [list(tokens) for tokens in batch["tokens"]]
        vectors = encoder(lists)
        sizes = np.array([len(tokens) for tokens in lists], dtype=np.int64)
        if [len(v) for v in vectors] != sizes.tolist():
            raise ValueError("the encoder must return one vector per token")
        return pd.DataFrame(
            {
                "doc_id": np.repeat(batch["doc_id"].to_numpy(), sizes),
                "dl": np.repeat(sizes, sizes),
                "pos": np.concatenate([np.arange(n) for n in sizes]) if len(sizes) else sizes,
                "token": [token for tokens in lists for token in tokens],
                "vec": [np.asarray(v, dtype=np.float64) for doc_vectors in vectors for v in doc_vectors],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), batch_size):
                yield encoded(whole.iloc[start : start + batch_size])

    id_type = tokenized.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, dl bigint, pos bigint, token string, vec array<double>"
    return tokenized.select("doc_id", "tokens").mapInPandas(run, schema)


_LOADED: dict[str, Callable] = {}


def _loaded(key: str, factory: Callable[[], Callable]) -> Callable:
    """The encoder that ``factory`` makes, made once in this worker process, whatever the number of its tasks."""
    if key not in _LOADED:
        _LOADED[key] = factory()
    return _LOADED[key]


def encode_tokens_with(
    tokenized: DataFrame,
    factory: Callable[[], Callable[[list[list[str]]], list[np.ndarray]]],
    batch_tokens: int = ENCODE_TOKENS,
    bucket_rows: int = BUCKET_ROWS,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``encode_tokens`` for an encoder that is costly to load and pads its batches.

    ``factory`` runs once per Python worker, and the encoder it returns serves all later tasks there.
    Documents are ordered by length among ``bucket_rows`` neighbours and cut where the longest one
    times their number would pass ``batch_tokens``, so little is spent on padding; a longer document is
    a batch of its own.  A document without tokens gives no row and is never passed on.  ``profile`` asks for executors with, say, a GPU.
    """
    key = uuid.uuid4().hex
    id_type = tokenized.schema["doc_id"].dataType

    def encoded(encoder: Callable, batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = batch.column("tokens")
        vectors = encoder(tokens.to_pylist())
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        if [len(v) for v in vectors] != sizes.tolist():
            raise ValueError("the encoder must return one vector per token")
        places = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.repeat(sizes, sizes)), pa.array(places), tokens.flatten(), vector_column(np.vstack(vectors))],
            names=["doc_id", "dl", "pos", "token", "vec"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(key, factory)
        for whole in batches:
            for start in range(0, whole.num_rows, bucket_rows):
                near = whole.slice(start, bucket_rows)
                sizes = pc.fill_null(pc.list_value_length(near.column("tokens")), 0).to_numpy(zero_copy_only=False)
                order = np.argsort(sizes, kind="stable")
                order = order[sizes[order] > 0]
                for rows in _cut_by_length(order, sizes, batch_tokens):
                    yield encoded(encoder, near.take(pa.array(rows)))

    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("dl", T.LongType()),
            T.StructField("pos", T.LongType()),
            T.StructField("token", T.StringType()),
            T.StructField("vec", T.ArrayType(T.DoubleType())),
        ]
    )
    return tokenized.select("doc_id", "tokens").mapInArrow(run, schema, profile=profile)


def _cut_by_length(order: np.ndarray, sizes: np.ndarray, batch_tokens: int) -> Iterator[np.ndarray]:
    """Cut rows in ascending order of length where the padded size of a batch would pass ``batch_tokens``."""
    start = 0
    for end in range(1, len(order) + 1):
        if end == len(order) or sizes[order[end]] * (end + 1 - start) > batch_tokens:
            yield order[start:end]
            start = end


def encode_texts(
    docs: DataFrame,
    encode_fun: Callable[[list[str]], np.ndarray],
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_size: int = ENCODE_BATCH,
) -> DataFrame:
    """``(id, vec)`` from a function that maps at most ``batch_size`` texts at a time to a matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), batch_size):
                batch = whole.iloc[start : start + batch_size]
                vectors = np.asarray(encode_fun(list(batch[text_col])), dtype=np.float64)
                yield pd.DataFrame({id_col: batch[id_col].to_numpy(), "vec": list(vectors)})

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {id_type}, vec array<double>")


# --- layer norm ---------------------------------------------------------------------------


def layer_norm(df: DataFrame, vec_col: str = "vec", eps: float = LAYER_NORM_EPS) -> DataFrame:
    """Replace the vector by its standardised form and add ``mu`` and ``std`` (ddof 1)."""
    vec = as_double(vec_col)

    def scaled(mu: Column, std: Column) -> Column:
        values = F.transform(vec, lambda x: (x - mu) / (std + F.lit(eps)))
        return F.struct(values.alias("vec"), mu.alias("mu"), std.alias("std"))

    def spread(mu: Column) -> Column:
        squares = F.transform(vec, lambda x: (x - mu) * (x - mu))
        return F.sqrt(F.try_divide(array_sum(squares), F.size(vec) - F.lit(1)))

    normal = let(array_sum(vec) / F.size(vec), lambda mu: let(spread(mu), lambda std: scaled(mu, std)))
    return (
        df.withColumn("_normal", normal)
        .withColumns({vec_col: F.col("_normal.vec"), "mu": F.col("_normal.mu"), "std": F.col("_normal.std")})
        .drop("_normal")
    )


# --- linear and multi-layer maps ----------------------------------------------------------


@dataclass(frozen=True)
class Layer:
    """``activation(weights . x + bias)`` with ``weights(out, inp, w)`` and ``bias(out, b)``."""

    weights: DataFrame
    bias: DataFrame | None = None
    activation: str = "none"
    slope: float = 0.1


def _activate(x: np.ndarray, kind: str, slope: float) -> np.ndarray:
    if kind == "none":
        return x
    if kind == "lrelu":
        return np.where(x > 0, x, slope * x)
    if kind == "xtanh":
        return np.tanh(x) + slope * x
    if kind == "sigmoid":
        return 1.0 / (1.0 + np.exp(-x))
    raise ValueError(f"unknown activation {kind!r}")


def _activate_column(x: Column, kind: str, slope: float) -> Column:
    if kind == "lrelu":
        return F.when(x > 0, x).otherwise(F.lit(slope) * x)
    if kind == "xtanh":
        return F.tanh(x) + F.lit(slope) * x
    if kind == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    return x


def _tidy(layer: Layer) -> tuple[DataFrame, DataFrame | None, int, int]:
    """Weights and biases with repeated rows added up, and the numbers of outputs and inputs.

    Outputs are numbered from 0 to the largest one that has a weight or a bias; what is not
    listed is zero.
    """
    weights = layer.weights.groupBy("out", "inp").agg(F.sum(F.col("w").cast("double")).alias("w"))
    bias = None if layer.bias is None else layer.bias.groupBy("out").agg(F.sum(F.col("b").cast("double")).alias("b"))
    outs, inps = layer.weights.agg(F.max("out"), F.max("inp")).first()
    if bias is not None:
        outs = max((x for x in (outs, layer.bias.agg(F.max("out")).first()[0]) if x is not None), default=None)
    return weights, bias, -1 if outs is None else int(outs), -1 if inps is None else int(inps)


def _dense(weights: DataFrame, bias: DataFrame | None, outs: int, inps: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The layer as matrix and bias when the matrix is small enough to ship."""
    if (outs + 1) * (inps + 2) * 8 > SHIP_BYTES:
        return None
    table = weights.select("out", "inp", "w").toArrow()
    matrix_of = np.zeros((outs + 1, inps + 1))
    matrix_of[table["out"].to_numpy(), table["inp"].to_numpy()] = table["w"].to_numpy()
    constant = np.zeros(outs + 1)
    if bias is not None:
        terms = bias.select("out", "b").toArrow()
        constant[terms["out"].to_numpy()] = terms["b"].to_numpy()
    return matrix_of, constant


def _apply_joined(
    df: DataFrame, weights: DataFrame, bias: DataFrame | None, outs: int, layer: Layer, id_col: str, vec_col: str
) -> DataFrame:
    """One layer as a relation: join on the input dimension, sum per output, restore the array."""
    long = df.select(id_col, F.posexplode(as_double(vec_col)).alias("inp", "x"))
    products = long.join(weights, "inp").select(id_col, "out", (F.col("x") * F.col("w")).alias("y"))
    # Every output of every row once more, so that those without a weight are there.
    places = F.sequence(F.lit(0).cast("long"), F.lit(outs).cast("long")) if outs >= 0 else F.array().cast("array<bigint>")
    nothing = df.select(id_col, F.explode(places).alias("out"), F.lit(0.0).alias("y"))
    sums = products.unionByName(nothing).groupBy(id_col, "out").agg(F.sum("y").alias("y"))
    if bias is not None:
        sums = sums.join(bias, "out", "left").withColumn("y", F.col("y") + F.coalesce("b", F.lit(0.0)))
    active = sums.withColumn("y", _activate_column(F.col("y"), layer.activation, layer.slope))
    ordered = F.array_sort(F.collect_list(F.struct("out", "y")))
    rebuilt = active.groupBy(id_col).agg(ordered.alias("pairs")).select(id_col, F.col("pairs.y").alias("_y"))
    joined = df.join(rebuilt, id_col, "left")
    return joined.withColumn(vec_col, F.coalesce("_y", F.array().cast("array<double>"))).drop("_y").select(df.columns)


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` with ``width`` columns: further ones have no weight, missing ones are zero."""
    if x.shape[1] >= width:
        return x[:, :width]
    return np.hstack([x, np.zeros((len(x), width - x.shape[1]))])


def apply_layers(df: DataFrame, layers: list[Layer], id_col: str = "vec_id", vec_col: str = "vec") -> DataFrame:
    """Replace ``vec_col`` by the output of the layers.

    A layer has the outputs 0 to its largest one; weights and biases that are not listed are
    zero, repeated ones add up, and inputs without a weight are ignored.  Layers whose matrix
    fits the shipping bound travel to the tasks and run there on fixed steps of rows; a larger
    one is joined, with the same meaning.
    """
    tidy = [_tidy(layer) for layer in layers]
    dense = [_dense(*t) for t in tidy]
    df = df.withColumn(vec_col, as_double(vec_col))
    if any(d is None for d in dense):
        for layer, (weights, bias, outs, _) in zip(layers, tidy, strict=True):
            df = _apply_joined(df, weights, bias, outs, layer, id_col, vec_col)
        return df
    shared = df.sparkSession.sparkContext.broadcast(
        [(w, b, layer.activation, layer.slope) for (w, b), layer in zip(dense, layers, strict=True)]
    )
    place = df.columns.index(vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, DECODE_STEP):
                batch = whole.slice(start, DECODE_STEP)
                x = matrix(batch.column(place))
                for weights, bias, kind, slope in shared.value:
                    x = _activate(_fitted(x, weights.shape[1]) @ weights.T + bias, kind, slope)
                columns = list(batch.columns)
                columns[place] = vector_column(x)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def packed_vector(terms: DataFrame, index: str, value: str) -> Column:
    """The model vector stored as ``(index, value)`` rows, as a scalar subquery of one array."""
    ordered = F.array_sort(F.collect_list(F.struct(index, value)))
    return terms.agg(ordered.alias("p")).select(F.col(f"p.{value}")).scalar()


def linear_encode(
    df: DataFrame,
    weights: DataFrame,
    pre_bias: DataFrame,
    latent_bias: DataFrame,
    latents: tuple[int, int] | None = None,
    id_col: str = "vec_id",
    vec_col: str = "vec",
) -> DataFrame:
    """Latents before activation: ``(x - pre_bias) . W^T + latent_bias`` in place of ``vec_col``.

    ``weights(latent, dim, w)``, ``pre_bias(dim, b)``, ``latent_bias(latent, b)``;
    ``latents=(lo, hi)`` computes only the latents ``lo <= latent < hi``.
    """
    w = weights.select(F.col("latent").alias("out"), F.col("dim").alias("inp"), "w")
    b = latent_bias.select(F.col("latent").alias("out"), "b")
    if latents is not None:
        lo, hi = latents
        w = w.where(F.col("out").between(lo, hi - 1)).withColumn("out", F.col("out") - lo)
        b = b.where(F.col("out").between(lo, hi - 1)).withColumn("out", F.col("out") - lo)
    shifted = df.withColumn("_pre", packed_vector(pre_bias, "dim", "b"))
    difference = F.zip_with(as_double(vec_col), "_pre", lambda a, b: a - b)
    centred = shifted.withColumn(vec_col, difference).drop("_pre")
    return apply_layers(centred, [Layer(w, b)], id_col, vec_col)


def decoder_rows(weights: DataFrame) -> DataFrame:
    """Tied decoder: ``(latent, vec)`` with the encoder row of every latent (model-sized)."""
    packed = F.array_sort(F.collect_list(F.struct("dim", "w")))
    return weights.groupBy("latent").agg(packed.alias("p")).select("latent", F.col("p.w").alias("vec"))


def linear_decode(
    latents: DataFrame,
    decoder: DataFrame,
    pre_bias: DataFrame,
    docs: DataFrame,
    dim: int,
    info: DataFrame | None = None,
    id_col: str = "vec_id",
) -> DataFrame:
    """``(id, vec)`` reconstructed from postings ``(id, dim, weight)``: ``z . D + pre_bias``.

    ``decoder(latent, vec)`` may be tied or not.  Only nonzero latents take part; repeated ones
    and repeated rows of the decoder add up, latents without a decoder row are ignored.  A
    document without latents yields the bias.  ``info(id, mu, std)`` undoes layer norm.  A decoder within
    the shipping bound is multiplied inside the tasks, a larger one is joined.
    """
    rows = latents.select(id_col, F.col("dim").alias("latent"), F.col("weight").cast("double").alias("weight"))
    # Hundreds of rows a document, which the optimizer takes for a few and would send through the driver.
    rows = docs.select(id_col).join(rows.hint("merge"), id_col, "left")
    model = decoder.select("latent", as_double("vec").alias("vec"))
    rows_held = (model.agg(F.max("latent")).first()[0] or 0) + 1
    small = rows_held * dim * 8 <= SHIP_BYTES
    table = arrow_if_small(model, 8 * dim + 8) if small else None
    decoded = _decode_joined(rows, model, id_col, dim) if table is None else _decode_shipped(rows, table, id_col, dim)
    shifted = decoded.withColumn("_pre", packed_vector(pre_bias, "dim", "b"))
    plain = shifted.select(id_col, F.zip_with("vec", "_pre", lambda a, b: a + b).alias("vec"))
    if info is None:
        return plain
    joined = plain.join(info.select(id_col, "mu", "std"), id_col)
    return joined.select(id_col, F.transform("vec", lambda x: x * F.col("std") + F.col("mu")).alias("vec"))


def _decode_shipped(rows: DataFrame, table: pa.Table, id_col: str, dim: int) -> DataFrame:
    """The active latents of a document meet in one row and are multiplied there."""
    latent = table["latent"].to_numpy()
    dense = np.zeros((int(latent.max()) + 1 if len(latent) else 0, dim))
    if len(latent):
        np.add.at(dense, latent, matrix(table["vec"]))
    shared = rows.sparkSession.sparkContext.broadcast(dense)
    active = F.when(F.col("latent").isNotNull(), F.struct("latent", "weight"))
    packed = rows.groupBy(id_col).agg(F.collect_list(active).alias("z"))
    packed = packed.select(id_col, F.col("z.latent").alias("latents"), F.col("z.weight").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DECODE_STEP):
                part = batch.slice(start, DECODE_STEP)
                z = np.zeros((part.num_rows, len(shared.value)))
                sizes = pc.list_value_length(part.column("latents")).to_numpy()
                row = np.repeat(np.arange(part.num_rows), sizes)
                place = part.column("latents").flatten().to_numpy().astype(np.int64)
                held = (place >= 0) & (place < len(shared.value))
                np.add.at(z, (row[held], place[held]), part.column("weights").flatten().to_numpy()[held])
                yield pa.RecordBatch.from_arrays([part.column(id_col), vector_column(z @ shared.value)], names=[id_col, "vec"])

    kind = rows.schema[id_col].dataType.simpleString()
    return packed.mapInArrow(run, f"{id_col} {kind}, vec array<double>")


def _decode_joined(rows: DataFrame, decoder: DataFrame, id_col: str, dim: int) -> DataFrame:
    """The same by a join on the latent and one sum per component."""
    sums = (
        rows.join(decoder, "latent")
        .select(id_col, "weight", F.posexplode("vec").alias("i", "x"))
        .groupBy(id_col, "i")
        .agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
    )
    packed = sums.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("p"))
    full = rows.select(id_col).distinct().join(packed, id_col, "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return full.select(id_col, F.coalesce(F.col("p.y"), zeros).alias("vec"))


def mlp_score(
    df: DataFrame,
    layers: list[tuple[DataFrame, DataFrame]],
    activation: str = "none",
    slope: float = 0.1,
    id_col: str = "vec_id",
    vec_col: str = "vec",
) -> DataFrame:
    """Multi-layer perceptron: activation after every layer but the last."""
    if activation not in ("none", "lrelu", "xtanh", "sigmoid"):
        raise ValueError(f"unknown activation {activation!r}")
    chain = [Layer(w, b, activation, slope) for w, b in layers[:-1]] + [Layer(*layers[-1])]
    return apply_layers(df, chain, id_col, vec_col)


def mlp_variance(
    df: DataFrame,
    layers: list[tuple[DataFrame, DataFrame]],
    activation: str = "none",
    slope: float = 0.1,
    id_col: str = "vec_id",
    vec_col: str = "vec",
) -> DataFrame:
    """The same for a net whose output is the logarithm of a variance: the variances."""
    scored = mlp_score(df, layers, activation, slope, id_col, vec_col)
    return scored.withColumn(vec_col, F.transform(vec_col, lambda x: F.exp(x)))


# --- sampling -----------------------------------------------------------------------------


def _uniform(*parts: Column) -> Column:
    """Number in (0, 1) from the digest of the parts: the same row always draws the same number."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def _noise(seed: int, row: Column, dim: Column) -> Column:
    """A standard normal number that is a function of seed, row and dimension."""
    u1, u2 = _uniform(F.lit(seed), F.lit("r"), row, dim), _uniform(F.lit(seed), F.lit("a"), row, dim)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * np.pi) * u2)


def sampled_vector(row: Column, mu: Column, variance: Column, seed: int = 0) -> Column:
    """``mu + eps * sqrt(variance)`` for arrays, inside the row; ``row`` names it for the noise."""
    pairs = F.zip_with(mu, variance, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    return F.transform(pairs, lambda p, i: p["m"] + _noise(seed, row, i.cast("bigint")) * F.sqrt(p["v"]))


def gaussian_sample(rows: DataFrame, seed: int = 0, id_col: str = "vec_id", dim_col: str = "dim") -> DataFrame:
    """Add ``z = mu + eps * sqrt(v)`` to ``(id, dim, mu, v)`` with standard normal ``eps``.

    The noise is a function of seed, id and dimension, so a recomputed task repeats its draw.
    """
    return rows.withColumn("z", F.col("mu") + _noise(seed, F.col(id_col), F.col(dim_col)) * F.sqrt("v"))
