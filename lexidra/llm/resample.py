"""Quality by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The target model is fitted on a bounded sample of the documents labelled good, the raw model on
all documents.  A document's weight is the ratio of its probabilities under both.  Adding Gumbel
noise to the log-weights and keeping the k largest samples k documents without replacement in
proportion to their weights, here sharpened by a temperature.  k is the share of good documents
among the labelled ones times all documents, or the number of documents that are at least as
likely under the target model as under the raw one if that is larger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidra.llm.tables import named, stored, utf8

BUCKETS = 10_000
# Labelled documents the target model is fitted on at most: those with the smallest hashes.
FIT_ROWS = 100_000
# Added to the counts of a bucket.
SMOOTHING = 20.0
# Documents are drawn in proportion to their weights to the power 1 / TEMPERATURE.
TEMPERATURE = 0.1
SEED = 11
PIECE_BYTES = 1 << 19
SLICE_BYTES = 1 << 20
# Log-weights and noise are multiples of this, so that sums do not depend on their order.
UNIT = 2.0**-20
BINS = 4096
BASE = 0x9E3779B97F4A7C15 | 1
#: The bigram of a word and itself.
AGAIN = 0


def _classes() -> np.ndarray:
    """Of every byte: 0 white space, 1 letter or digit, 2 other; bytes of longer characters are letters."""
    kinds = np.full(256, 2, dtype=np.uint8)
    kinds[list(b" \t\n\r\x0b\x0c\0")] = 0
    kinds[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    return kinds


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
    """Texts in slices of bounded size: the text numbers of the slice's pieces and its bytes.

    Long texts are cut behind white space; pieces are joined by a line feed.
    """
    numbers, parts, held = [], [], 0
    for number, text in enumerate(texts):
        start = 0
        while start < len(text):
            end = min(len(text), start + PIECE_BYTES)
            while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            numbers.append(number)
            parts.append(text[start:end])
            held += end - start + 1
            start = end
            if held >= SLICE_BYTES:
                yield numbers, parts
                numbers, parts, held = [], [], 0
    if numbers:
        yield numbers, parts


def ngrams(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text number, bucket)`` of all unigrams and bigrams, a slice of the texts at a time.

    A-Z are lower-cased; tokens are runs of letters and digits and runs of other characters that
    are no white space.  Every bigram of a token and itself has the bucket ``AGAIN``.
    """
    kinds, base = _classes(), np.uint64(BASE)
    inverse = np.uint64(pow(BASE, -1, 1 << 64))
    spread, last = np.uint64(0xD6E8FEB86659FD93), (-1, np.uint64(0))

    def bucket(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * spread
        x = (x ^ (x >> np.uint64(32))) * spread
        return (((x >> np.uint64(32)) * np.uint64(buckets - 1)) >> np.uint64(32)).astype(np.int64) + 1

    for numbers, parts in _pieces(texts):
        data = np.frombuffer(b"\n".join(parts).lower(), dtype=np.uint8)
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        offsets = np.cumsum(sizes) - sizes
        kind = kinds[data]
        starts = np.flatnonzero((kind != 0) & (np.concatenate([[0], kind[:-1]]) != kind))
        ends = np.flatnonzero((kind != 0) & (np.concatenate([kind[1:], [0]]) != kind)) + 1
        if not len(starts):
            continue
        # Hash of a token: its bytes as digits, read from the running sum over the slice.
        powers = np.full(len(data) + 1, base, dtype=np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        back = np.full(len(data) + 1, inverse, dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1])])
        token = (sums[ends] - sums[starts]) * back[starts]
        text = np.array(numbers, dtype=np.int64)[np.searchsorted(offsets, starts, side="right") - 1]
        before = np.concatenate([[last[1]], token[:-1]])
        follows = np.concatenate([[last[0]], text[:-1]]) == text
        pair = np.where(before == token, AGAIN, bucket(before * spread + token))
        yield np.concatenate([text, text[follows]]), np.concatenate([bucket(token), pair[follows]])
        last = (text[-1], token[-1])


def _counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all rows and of the rows with ``good``; one number for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            good = np.array(batch.column(1).to_pylist(), dtype=bool)
            for text, found in ngrams(utf8(batch.column(0)), buckets):
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[good[text]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (used, raw[used], target[used])], names=["bucket", "raw", "target"])

    partial = docs.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
    rows = partial.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-ratio of each bucket in multiples of ``UNIT``; all zero without a target.

    Raw counts are brought to the target's total first, so that smoothing weighs both alike and
    buckets with little evidence have a ratio near one.
    """
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    return np.round(np.log((target + SMOOTHING) / (expected + SMOOTHING)) / UNIT)


def _judged(labels: DataFrame) -> DataFrame:
    """One row for each labelled id; ``q`` is 1 if all its labels are good."""
    each = named(labels, "doc_id", "quality").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"))
    return each.where("q IS NOT NULL AND doc_id IS NOT NULL")


def good_share(labels: DataFrame) -> float:
    """Share of good documents among all labelled ones, 1 without labels."""
    n, good = _judged(labels).agg(F.count(F.lit(1)), F.count_if(F.col("q") == 1)).first()
    return good / n if n else 1.0


def good_ids(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` ids whose labels are all good: those with the smallest hashes."""
    return _judged(labels).where("q = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise at ``TEMPERATURE`` from the hash of ``key``, in multiples of ``UNIT``."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") + 0.5) / float(1 << 53)
    return F.round(-F.log(-F.log(uniform)) * (TEMPERATURE / UNIT)).cast("long")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a long column, by counting bins of a range that narrows each pass."""
    if k <= 0:
        return None
    low, high = values.agg(F.min(column), F.max(column)).first()
    while low < high:
        width = (high - low) // BINS + 1
        inside = values.where(F.col(column).between(low, high))
        bins = inside.groupBy(F.floor((F.col(column) - low) / width).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for b, n in sorted(((r["b"], r["n"]) for r in bins.collect()), reverse=True):
            if n >= k:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            k -= n
    return low


def weigh(docs: DataFrame, labels: DataFrame, carry: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``(row, n_grams, log_weight, key, kept)`` for every row of ``docs(doc_id, text, ...)``.

    ``row`` is a struct of the columns in ``carry``, so no name clashes.  A document with several
    labels is good if all are; null qualities and ids are ignored.  A null or empty text has no
    n-grams and the weight 1.  Equal keys at the cut are all kept; rows with one id share their
    noise.  Without a good label all weights are 1.  An empty table gives an empty one.
    """
    plain = docs.select(F.col("text"), F.col("doc_id").cast("long").alias("doc_id"))
    ids = F.broadcast(good_ids(labels).withColumn("good", F.lit(True)))
    raw, target = _counts(plain.join(ids, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good")), buckets)
    ratios = log_ratios(raw, target)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for text, found in ngrams(texts, buckets):
                sums += np.bincount(text, weights=ratios[found], minlength=len(texts))
                sizes += np.bincount(text, minlength=len(texts))
            columns = [*batch.columns[:2], pa.array(sizes), pa.array(sums.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_grams", "units"])

    own = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("n_grams", T.LongType()), T.StructField("units", T.LongType())])
    scored = stored(rows.mapInArrow(score, schema), "weights")
    keyed = scored.withColumn("key", F.col("units") + gumbel(F.col("doc_id")))
    n, likely = keyed.agg(F.count(F.lit(1)), F.count_if(F.col("units") >= 0)).first()
    cut = kth_largest(keyed, "key", max(likely, round(n * good_share(labels))))
    kept = F.lit(False) if cut is None else F.col("key") >= cut
    return keyed.select("row", "n_grams", (F.col("units") * UNIT).alias("log_weight"), (F.col("key") * UNIT).alias("key"), kept.alias("kept"))
