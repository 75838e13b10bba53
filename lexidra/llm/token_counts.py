"""Token counts of whole texts; huge ones by overlap resynchronisation.

A text longer than a chunk is cut into chunks that overlap.  Chunks are encoded apart from each
other, on any executor, and each reports how many tokens lie before the stable places inside
its two overlaps (see ``bpe``).  Two neighbours are spliced at the first stable place that both
report as a border between tokens.  Where an overlap holds none, the text is cut again with
longer chunks and wider overlaps, in the end as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexidra.llm.bpe import STABLE, encoder
from lexidra.llm.tables import named, slices, stored, strings

CHUNK = 32_768
OVERLAP = 512
WIDEN = 4


def chunk_starts(length: int, chunk: int, overlap: int) -> range:
    """Where the chunks of a text begin; chunk ``i`` reaches ``overlap`` characters into the next."""
    return range(0, max(1, -(-(length - overlap) // chunk)) * chunk, chunk)


def _cutter(chunk: int, overlap: int):
    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                starts = chunk_starts(len(text), chunk, overlap)
                for first in range(0, len(starts), 64):
                    some = range(first, min(first + 64, len(starts)))
                    pieces = [text[starts[i] : starts[i] + chunk + overlap] if i < len(starts) - 1 else text[starts[i] :] for i in some]
                    last = [i == len(starts) - 1 for i in some]
                    yield pa.RecordBatch.from_arrays([[key] * len(some), [*some], last, pieces], schema=schema)

    return run


def _zone(piece: str, begin: int, end: int, offset: int, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Stable places of ``piece[begin:end]`` that are token borders: offset in the text, tokens before."""
    places = [m.start() for m in STABLE.finditer(piece, max(begin, 1), end)]
    if not places:
        return [], []
    sizes = [len(piece[a:b].encode()) for a, b in zip([begin, *places[:-1]], places, strict=True)]
    at = len(piece[:begin].encode()) + np.cumsum(sizes)
    before = np.searchsorted(ends, at)
    border = (before < len(ends)) & (ends[np.minimum(before, len(ends) - 1)] == at)
    return [p + offset for p, ok in zip(places, border, strict=True) if ok], (before[border] + 1).tolist()


def _coder(path: str, chunk: int, overlap: int):
    lists = [(name, pa.list_(pa.int64())) for name in ("head", "head_tokens", "tail", "tail_tokens")]
    schema = pa.schema([("key", pa.string()), ("no", pa.int64()), ("last", pa.bool_()), ("tokens", pa.int64()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).id_ends
        for whole in batches:
            for batch in slices(whole, 64):
                out = []
                for key, no, last, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, ends = encode(piece)
                    head = _zone(piece, 0, overlap, no * chunk, ends) if no else ([], [])
                    tail = ([], []) if last else _zone(piece, chunk, len(piece), no * chunk, ends)
                    out.append((key, no, last, len(ids), *head, *tail))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def _spliced(texts: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """``(key, n_tokens)`` of the texts ``(key, text)``; rows of the same key hold the same text."""
    found: DataFrame | None = None
    while True:
        cut = texts.mapInArrow(_cutter(chunk, overlap), "key string, no long, last boolean, piece string")
        once = cut.groupBy("key", "no").agg(F.first("last").alias("last"), F.first("piece").alias("piece"))
        schema = "key string, no long, last boolean, tokens long, head array<long>, head_tokens array<long>, tail array<long>, tail_tokens array<long>"
        coded = stored(once.mapInArrow(_coder(path, chunk, overlap), schema), "token-chunks")
        left = coded.where(~F.col("last")).select("key", (F.col("no") + 1).alias("no"), "tail", "tail_tokens")
        right = coded.where("no > 0").select("key", "no", "head", "head_tokens")
        place = F.array_min(F.array_intersect("tail", "head"))
        before = F.element_at("tail_tokens", F.array_position("tail", place).cast("int"))
        after = F.element_at("head_tokens", F.array_position("head", place).cast("int"))
        seams = left.join(right, ["key", "no"]).select("key", (before - after).alias("tokens"), place.isNull().alias("open"))
        sums = (
            coded.where("last")
            .select("key", "tokens", F.lit(False).alias("open"))
            .unionByName(seams)
            .groupBy("key")
            .agg(F.sum("tokens").alias("n_tokens"), F.max("open").alias("open"))
        )
        sums = stored(sums, "token-sums")
        done = sums.where(~F.col("open")).select("key", "n_tokens")
        found = done if found is None else found.unionByName(done)
        left_over = sums.where("open").select("key")
        if left_over.isEmpty():
            return found
        texts = texts.join(left_over, "key", "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def token_counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row of ``docs(doc_id, text)``.

    ``path`` is the tokenizer file, readable on every executor.  A null text counts as empty, an
    empty text has no tokens; rows that repeat are counted each; null ids are kept; other
    columns are ignored; an empty table gives an empty one.  ``2 * overlap`` may not exceed
    ``chunk``.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("the overlap must be positive and at most half the chunk")
    rows = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    huge = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path).ids
        for batch in batches:
            texts = strings(batch.column(1))
            sizes = [len(t.encode()) for t in texts]
            tokens = [len(ids(t)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    short = rows.where(~huge).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(huge).withColumn("key", F.sha2("text", 256))
    counts = _spliced(long.select("key", "text"), path, chunk, overlap)
    sizes = long.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key")
    return short.unionByName(sizes.join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
