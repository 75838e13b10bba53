"""Batch search over postings: all queries in one job."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexidra.functions.numeric import SCORE_SCALE, score_sum
from lexidra.operators.postings import MAX_QUERY_WEIGHT, check_query_weights, prepare_query_weights
from lexidra.operators.ranking import DEFAULT_TOP_K, rank_topk, with_ordinal
from lexidra.session import SHIP_BYTES, arrow_if_small, cut_lineage, stored

# Document ordinals listed in one row at most.
ORDINALS = 10_000
# Sums of (document, query) and products held at a time inside a task.
CELLS = 1 << 20
# Bytes that a term of a query and a hit of it are taken for.
TERM_BYTES = 64
HIT_BYTES = 24
# Totals beyond the 64-bit numbers they are added up in are refused.
LARGEST = 2.0**63


def score_matches(query_terms: DataFrame, postings: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score, matched, n_terms)`` over all common terms.

    The join key is the term.  Sizes are left to the optimizer: a query batch below the
    broadcast threshold is shipped to the postings scan, a larger one is shuffled, and
    adaptive execution splits the partitions of frequent terms.  The sums are combined
    on the map side before the shuffle on (query, document).
    """
    joined = postings.select("term", "doc_id", F.col("weight").alias("_dw")).join(
        query_terms.select("query_id", "term", F.col("weight").alias("_qw"), "n_terms"), "term"
    )
    return joined.groupBy("query_id", "doc_id").agg(
        score_sum(F.col("_qw") * F.col("_dw")).alias("score"),
        F.count("*").alias("matched"),
        F.max("n_terms").alias("n_terms"),
    )


@dataclass
class ShippedTerms:
    """The terms of a query batch: ``asked(term, term_no)``, the queries, and the query, weight and place of each term."""

    asked: DataFrame
    query_field: T.StructField
    queries: pa.Array
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    needed: np.ndarray | None


def shipped_terms(terms: DataFrame, k: int, max_bytes: int = SHIP_BYTES) -> ShippedTerms | None:
    """``terms(query_id, term, weight[, needed])`` when they, and ``k`` hits of each query, fit in ``max_bytes``, otherwise None.

    ``needed`` is how many terms of its query a document must match.
    """
    table = arrow_if_small(terms.where(F.col("term").isNotNull()), TERM_BYTES, max_bytes)
    if table is None or table["weight"].null_count:
        return None
    ids = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    names = table["term"].combine_chunks().dictionary_encode()
    if len(ids.dictionary) * k * HIT_BYTES > max_bytes:
        return None
    term = names.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    query = ids.indices.to_numpy()[order]
    needed = None
    if "needed" in table.column_names:
        needed = np.zeros(len(ids.dictionary), dtype=np.int64)
        needed[query] = table["needed"].to_numpy()[order]
    numbered = pa.table({"term": names.dictionary, "term_no": pa.array(np.arange(len(names.dictionary), dtype=np.int32))})
    asked = terms.sparkSession.createDataFrame(numbered, T.StructType([terms.schema["term"], T.StructField("term_no", T.IntegerType())]))
    starts = np.searchsorted(term[order], np.arange(len(names.dictionary) + 1))
    weight = table["weight"].to_numpy()[order]
    return ShippedTerms(F.broadcast(asked), terms.schema["query_id"], ids.dictionary, starts, query, weight, needed)


class _BestHits:
    """The ``k`` best hits of every query among those added; ties go to the smaller document."""

    def __init__(self, k: int, queries: int) -> None:
        self.k, self.floor, self.held, self.size = k, np.full(queries, -np.inf), [], 0
        self.room = 2 * k * queries + CELLS // 16

    def add(self, query: np.ndarray, score: np.ndarray, docs: pa.Array) -> None:
        self.held.append(pa.table({"query": query, "score": score, "doc_id": docs}))
        self.size += len(query)
        if self.size > self.room:
            self.cut()

    def cut(self) -> pa.Table:
        rows = pa.concat_tables(self.held)
        keys = [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))
        query = rows["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = rows["score"].to_numpy()[last]
        rows = rows.filter(pa.array(place < self.k)).combine_chunks()
        self.held, self.size = [rows], rows.num_rows
        return rows


def _points(values: np.ndarray) -> np.ndarray:
    """``fixed_point`` of an array, still as floating point."""
    points = np.nan_to_num(np.floor(values * SCORE_SCALE + 0.5), nan=0.0, posinf=LARGEST, neginf=-LARGEST)
    if np.abs(points).max(initial=0.0) >= LARGEST:
        raise OverflowError("a score is beyond 64-bit fixed point")
    return points


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of whole documents and where each document begins; the last one of a batch waits for its other rows."""
    held: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        codes = batch.column("doc_id").dictionary_encode(null_encoding="encode").indices.to_numpy()
        return np.flatnonzero(np.diff(codes, prepend=-1))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.concat_batches([*held, batch])
        starts = cut(rows)
        if starts[-1]:
            yield rows.slice(0, starts[-1]), starts[:-1]
        held = [rows.slice(starts[-1])]
    if held:
        yield held[0], np.zeros(1, dtype=np.int64)


def best_in_documents(postings: DataFrame, terms: ShippedTerms, k: int, least: np.ndarray | None = None) -> DataFrame:
    """The ``k`` best hits of every query within each partition: ``(query_id, doc_id, score)``.

    With ``least``, one number of 1e-9 points for each of ``terms.queries``, it is all hits that reach it instead,
    ``(query_id, doc_id, points)``.

    ``postings(doc_id, term_no, weight)`` has all rows of a document one after the other in one
    partition.  A document is then scored for all queries where it is, so no pair of query and
    document is shuffled or kept beyond the ``k`` best, whatever the number of documents.
    """
    shared = postings.sparkSession.sparkContext.broadcast((terms.queries, terms.starts, terms.query, terms.weight, terms.needed))
    id_type = postings.schema["doc_id"].dataType
    value = T.StructField("score", T.DoubleType()) if least is None else T.StructField("points", T.LongType())
    names = ["query_id", "doc_id", value.name]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, starts, query, weight, needed = shared.value
        n_queries, hits = len(queries), _BestHits(k, len(queries))
        for rows, begins in whole_documents(batches):
            term = rows.column("term_no").to_numpy()
            values = rows.column("weight").to_numpy(zero_copy_only=False)
            products = np.concatenate([[0], np.cumsum(starts[term + 1] - starts[term])])
            ends = np.append(begins[1:], len(term))
            cost = np.cumsum(np.maximum(products[ends] - products[begins], n_queries))
            at = 0
            while at < len(begins):
                upto = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + CELLS, side="right")))
                first, last = begins[at], ends[upto - 1]
                part = term[first:last]
                n = starts[part + 1] - starts[part]
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[part], n)
                points = _points(weight[entry] * np.repeat(values[first:last], n))
                doc = np.repeat(np.arange(upto - at), ends[at:upto] - begins[at:upto])
                cell = np.repeat(doc * n_queries, n) + query[entry]
                size = (upto - at) * n_queries
                matched = np.bincount(cell, minlength=size)
                total = np.zeros(size, dtype=np.int64)
                np.add.at(total, cell, points.astype(np.int64))
                if np.abs(points).sum() >= LARGEST and np.abs(np.bincount(cell, points, size)).max() >= LARGEST:
                    raise OverflowError("a score is beyond 64-bit fixed point")
                few = 1 if needed is None else np.tile(needed, upto - at)
                found = np.flatnonzero((matched > 0) & (matched >= few))
                if least is not None:
                    found = found[total[found] >= least[found % n_queries]]
                    ids = rows.column("doc_id").take(pa.array(begins[at + found // n_queries]))
                    yield pa.RecordBatch.from_arrays([queries.take(pa.array(found % n_queries)), ids, pa.array(total[found])], names=names)
                    at = upto
                    continue
                score = total[found].astype(np.float64) / SCORE_SCALE
                near = score >= hits.floor[found % n_queries]
                found, score = found[near], score[near]
                hits.add(found % n_queries, score, rows.column("doc_id").take(pa.array(begins[at + found // n_queries])))
                at = upto
        if hits.size:
            top = hits.cut()
            for batch in top.to_batches(max_chunksize=CELLS // 16):
                yield pa.RecordBatch.from_arrays(
                    [queries.take(batch.column("query")), batch.column("doc_id"), batch.column("score")], names=names
                )

    fields = [terms.query_field, T.StructField("doc_id", id_type), value]
    return postings.select("doc_id", "term_no", "weight").mapInArrow(best, T.StructType(fields))


def sparse_dot_search(
    query_terms: DataFrame,
    postings: DataFrame,
    k: int = DEFAULT_TOP_K,
    min_match_ratio: float = 0.0,
    weighted: bool = True,
    max_weight: float | None = MAX_QUERY_WEIGHT,
    ship_bytes: int = SHIP_BYTES,
    whole: bool = False,
) -> DataFrame:
    """Top ``k`` documents by sparse dot product: ``(query_id, doc_id, score, rank)``.

    Only documents that share a term with the query appear.  ``min_match_ratio`` above 0
    demands ``max(1, ceil(ratio * number of query terms))`` matching terms.

    A query batch of bounded size is shipped: the postings of its terms are brought together by
    document, and each document is scored for all queries in its task.  ``whole`` says that the
    postings of a document are neighbours in one partition already.  A larger batch is joined.
    """
    if max_weight is None:
        terms = check_query_weights(query_terms)
        if min_match_ratio > 0:
            counts = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
            terms = terms.join(counts, "query_id")
        else:
            terms = terms.withColumn("n_terms", F.lit(0).cast("bigint"))
    else:
        terms = prepare_query_weights(query_terms, weighted, max_weight)
    needed = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(float(min_match_ratio)) * F.col("n_terms")))
    # Terms may be the end of a long search of their own, and are read more than once.
    terms = cut_lineage(terms.select("query_id", "term", F.col("weight").cast("double").alias("weight"), "n_terms"))
    shipped = shipped_terms(terms.withColumn("needed", needed) if min_match_ratio > 0 else terms.drop("n_terms"), k, ship_bytes)
    if shipped is not None:
        placed = postings.join(shipped.asked, "term") if whole else by_document(postings, shipped)
        return rank_topk(best_in_documents(placed.withColumn("weight", F.col("weight").cast("double")), shipped, k), k)
    scored = score_matches(terms, postings)
    if min_match_ratio > 0:
        scored = scored.where(F.col("matched") >= needed)
    return rank_topk(scored.select("query_id", "doc_id", "score"), k)


def by_document(postings: DataFrame, terms: ShippedTerms) -> DataFrame:
    """The postings of the asked terms, those of a document in one partition and in a row: ``(doc_id, term_no, weight)``."""
    wanted = postings.select("term", "doc_id", F.col("weight").cast("double").alias("weight"))
    # The semi join passes below an aggregation that made the postings, the join with the numbers does not.
    wanted = wanted.join(terms.asked.select("term"), "term", "left_semi").join(terms.asked, "term")
    return wanted.select("doc_id", "term_no", "weight").repartition("doc_id").sortWithinPartitions("doc_id")


def unweighted_search(query_terms: DataFrame, postings: DataFrame, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Every distinct query term weighs 1: the document weights of the common terms are summed."""
    return sparse_dot_search(query_terms.select("query_id", "term").distinct(), postings, k, weighted=False)


def token_bag_search(
    query_tokens: DataFrame, postings: DataFrame, k: int = DEFAULT_TOP_K, whole: bool = False
) -> DataFrame:
    """Query = bag of plain tokens ``(query_id, token)``; repeated tokens count again."""
    terms = query_tokens.groupBy("query_id", F.col("token").alias("term")).agg(
        F.count("*").cast("double").alias("weight")
    )
    return sparse_dot_search(terms, postings, k, max_weight=None, whole=whole)


def weighted_sum_all_docs(
    query_terms: DataFrame,
    postings: DataFrame,
    docs: DataFrame,
    k: int = DEFAULT_TOP_K,
    clamp_negative: bool = False,
) -> DataFrame:
    """Top ``k`` of **all** documents, those without a common term scoring 0.

    ``docs`` holds ``doc_id`` (numeric, unique) and ``query_terms`` defines the queries.
    Scores of unmatched documents are never materialised: a query with fewer than ``k``
    positive hits is topped up with the zero-score documents of lowest id.  At most
    ``k + (number of its nonpositive hits)`` ordinals have to be looked up for that, and they
    are reached by an equality join on the document ordinal.  ``clamp_negative`` turns
    negative totals into 0 (the compiled-expression form).
    """
    terms = check_query_weights(query_terms.withColumn("weight", F.col("weight").cast("double")))
    scored = score_matches(terms.withColumn("n_terms", F.lit(0)), postings).select("query_id", "doc_id", "score")
    if clamp_negative:
        scored = scored.withColumn("score", F.greatest("score", F.lit(0.0)))
        scored = scored.where(F.col("score") > 0)
    scored = stored(scored, "scored")
    per_query = scored.groupBy("query_id").agg(
        F.count_if(F.col("score") > 0).alias("positive"), F.count("*").alias("matched")
    )
    short = (
        terms.select("query_id")
        .distinct()
        .join(per_query, "query_id", "left")
        .fillna(0)
        .where(F.col("positive") < k)
    )
    # The ordinals in chunks, so that no row holds a list as long as the corpus.
    wanted = F.col("matched") + F.lit(k - 1)
    chunks = short.withColumn("wanted", wanted).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("wanted") / F.lit(ORDINALS)).cast("bigint")))
    )
    first, last = F.col("chunk") * ORDINALS, F.least(F.col("chunk") * ORDINALS + F.lit(ORDINALS - 1), F.col("wanted"))
    short = chunks.select("query_id", F.explode(F.sequence(first, last)).alias("ordinal"))
    fill = (
        short.join(with_ordinal(docs.select("doc_id"), "doc_id"), "ordinal")
        .join(scored.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        .select("query_id", "doc_id", F.lit(0.0).alias("score"))
    )
    return rank_topk(scored.unionByName(fill), k)
