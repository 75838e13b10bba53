"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sources share all words by weight; no target exceeds ``REPEATS`` times its source.  Every source
is dealt into shards of bounded size, and the blocks of the mix go to the shards by the highest
quotients ``target / (2 n + 1)``.  The same seats follow from one divisor at which the rounded
shares add up to all blocks; it is found by trying many divisors in each pass over the shards.
A shard lays its documents out in a seeded order and takes its quota as whole rounds over all of
them and a run of blocks from a seeded place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexidra.llm.tables import stored, whole_row

WEIGHTS = (1, 2, 3)
REPEATS = 3
BLOCK = 64
LEAST_BLOCKS = 10_000
SHARD_WORDS = 1 << 18
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
PROBES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(*parts: Column | str, seed: int = SEED) -> Column:
    """A seeded order key: hexadecimal digits."""
    names = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *names))


def as_number(digits: Column) -> Column:
    """The first eight hexadecimal digits as a number."""
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, a row for each source.

    Weights repeat along the code-point order of the sources, null last.  Sources that reach
    their limit are the first ones when ordered by limit per weight.
    """
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("long")
    weighed = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * repeats)
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    shared = weighed.withColumn("rest", rest).withColumn("heavy", F.sum("weight").over(onward))
    # The first source that its share does not exceed; all from there on share the rest.
    free = F.col("rest") * F.col("weight") <= F.col("most") * F.col("heavy")
    shared = shared.withColumn("free", F.max(free).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = F.when(F.col("free"), F.struct("rest", "heavy"))
    shared = shared.withColumn("start", F.first(first, ignorenulls=True).over(everything.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())))
    share = F.col("start.rest") * F.col("weight") / F.col("start.heavy")
    target = F.when(F.col("free"), share).otherwise(F.col("most").cast("double"))
    return shared.select("source", "source_size", target.cast("double").alias("target"))


def sainte_lague(cells: DataFrame, seats: int, order: list[Column]) -> DataFrame:
    """``cells(votes, most, ...)`` with ``quota``: ``seats`` dealt out by the highest quotients.

    No cell gets more than ``most``; equal quotients go to the first cells in ``order``.
    """

    def dealt(divisor: Column | float) -> Column:
        return F.least(F.floor(F.col("votes") / divisor + 0.5).cast("long"), F.col("most"))

    peak = cells.agg(F.max("votes").alias("peak")).first()["peak"]
    if seats <= 0 or not peak:
        return cells.withColumn("quota", F.lit(0).cast("long"))
    low, high, at_high = peak * 2.0**-60, peak * 4.0, 0
    while True:
        ratio = (high / low) ** (1 / (PROBES + 1))
        steps = [low * ratio**i for i in range(1, PROBES + 1)] if ratio > 1 + 1e-12 else [low + (high - low) * i / (PROBES + 1) for i in range(1, PROBES + 1)]
        steps = sorted({d for d in steps if low < d < high})
        if not steps:
            break
        sums = cells.agg(*[F.sum(dealt(F.lit(d))).alias(f"s{i}") for i, d in enumerate(steps)]).first()
        exact = next((d for i, d in enumerate(steps) if sums[i] == seats), None)
        if exact is not None:
            return cells.withColumn("quota", dealt(F.lit(exact)))
        for i, d in enumerate(steps):
            if sums[i] > seats:
                low = max(low, d)
            elif d < high:
                high, at_high = d, sums[i]
                break
    # Between neighbouring numbers only equal quotients are left; the first of them get the seats.
    tied = cells.withColumn("quota", dealt(F.lit(high))).withColumn("more", dealt(F.lit(low)) - F.col("quota"))
    earlier = F.coalesce(F.sum("more").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.least(F.col("more"), F.lit(seats - at_high) - earlier), F.lit(0))
    return tied.withColumn("quota", F.col("quota") + extra).drop("more")


def mixed(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK) -> DataFrame:
    """What a mix takes of every row of ``rows(row_id, doc_id, source, size)``.

    Adds ``source_size, target, taken, rounds`` and the two runs of words ``[from1, to1)`` and
    ``[from2, to2)`` taken besides ``rounds`` times the whole document (the second where the run
    goes on at the start of its shard).  A block has ``block`` words, or fewer where all words
    would make under ``LEAST_BLOCKS`` blocks.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, repeats), "targets")
    total = targets.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    block = max(1, min(block, total // LEAST_BLOCKS))
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)).cast("long")
    both = rows.withColumnRenamed("source", "own").join(
        targets.withColumn("shards", shards), F.col("own").eqNullSafe(F.col("source")), "left"
    )
    keyed = both.withColumn("key", seeded("doc_id")).withColumn("shard", as_number(F.col("key")) % F.col("shards")).drop("own")
    cells = keyed.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size")
    )
    cells = cells.where("words > 0").withColumns(
        {
            "votes": F.col("target") * F.col("words") / F.col("source_size"),
            "most": F.ceil(F.col("words") * repeats / block).cast("long"),
        }
    )
    cells = stored(cells, "shards")
    order = [F.col("source").asc_nulls_last(), F.col("shard")]
    quotas = sainte_lague(cells, total // block, order)
    take = F.least(F.col("quota") * block, F.col("words") * repeats)
    blocks = F.ceil(F.col("words") / block).cast("long")
    plan = quotas.select(
        F.col("source").alias("its_source"),
        F.col("shard").alias("its_shard"),
        "words",
        F.floor(take / F.col("words")).cast("long").alias("rounds"),
        (take % F.col("words")).alias("run"),
        ((as_number(seeded("source", "shard")) % blocks) * block).alias("begin"),
    )
    same = F.col("source").eqNullSafe(F.col("its_source")) & (F.col("shard") == F.col("its_shard"))
    line = W.partitionBy("source", "shard").orderBy("key", "doc_id", "size", "row_id")
    placed = keyed.withColumn("at", F.sum("size").over(line) - F.col("size")).join(plan, same, "left")
    end = F.col("begin") + F.col("run")

    def within(low: Column, high: Column) -> tuple[Column, Column]:
        start = F.greatest(low - F.col("at"), F.lit(0))
        return start, F.greatest(F.least(high - F.col("at"), F.col("size")), start)

    first = within(F.col("begin"), F.least(end, F.col("words")))
    second = within(F.lit(0).cast("long"), end - F.col("words"))
    runs = {n: F.coalesce(c, F.lit(0)) for n, c in zip(("from1", "to1", "from2", "to2"), (*first, *second), strict=True)}
    whole = placed.withColumns(runs | {"rounds": F.coalesce("rounds", F.lit(0))})
    taken = F.col("rounds") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2") - F.col("from2")
    return whole.withColumn("taken", taken.cast("long"))


def sized_rows(docs: DataFrame, row_id: Column) -> DataFrame:
    return docs.select(
        row_id.alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source)``.

    Size is the number of words, 0 for a null or empty text; a null source is a source of its
    own; rows with a null id or repeated rows are mixed like any other.  Repeated rows come one
    after another, so reruns give the same rows.  Other columns are ignored; an empty table
    gives an empty one.
    """
    rows = stored(sized_rows(docs, F.xxhash64("text")), "sizes")
    return mixed(rows).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole documents, repeated as often as taken,
    and the parts of the few documents that a run begins or ends in, words joined by a space."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row_id"), whole_row(docs).alias("row")), "mix-rows")
    sized = sized_rows(rows.select("row_id", "row.doc_id", "row.source", "row.text"), F.col("row_id"))
    plan = mixed(stored(sized, "sizes")).where("taken > 0")
    runs = F.array(F.struct(F.col("from1").alias("a"), F.col("to1").alias("b")), F.struct(F.col("from2").alias("a"), F.col("to2").alias("b")))
    full = F.lit(0).cast("long").alias("a"), F.col("size").alias("b")
    takes = F.concat(F.transform(F.sequence(F.lit(1), F.col("rounds")), lambda _: F.struct(*full)), runs)
    takes = F.when(F.col("rounds") > 0, takes).otherwise(runs)
    parts = plan.select("row_id", "size", F.explode(F.filter(takes, lambda t: t["b"] > t["a"])).alias("t"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    cut = F.concat_ws(" ", F.slice(words, (F.col("t.a") + 1).cast("int"), (F.col("t.b") - F.col("t.a")).cast("int")))
    text = F.when((F.col("t.a") == 0) & (F.col("t.b") == F.col("size")), F.col("row.text")).otherwise(cut)
    columns = [F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    taken = parts.join(rows, "row_id").withColumn("text", text)
    return taken.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else e for c, e in zip(docs.columns, columns, strict=True)])
