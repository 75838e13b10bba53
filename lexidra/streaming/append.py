"""Feed an index, or term statistics, from a stream of documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lexidra.operators.lexical import doc_tokens
from lexidra.sources.index_store import append_documents
from lexidra.sources.term_statistics import append_statistics


def _writer(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def append_stream(
    docs: DataFrame, to_postings: Callable[[DataFrame], DataFrame], root: str, checkpoint: str
) -> DataStreamWriter:
    """Writer that appends each micro-batch of ``docs`` to the index at ``root``.

    The checkpoint folder names the writer and the number of the micro-batch its epoch, so a
    batch that is replayed after a failure is written once.  A stream that starts anew in
    another folder is another writer; documents that the index holds already stop it.
    """
    writer = _writer(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        append_documents(to_postings(batch), batch, root, writer, number)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)


def statistics_stream(docs: DataFrame, root: str, checkpoint: str, text_col: str = "text") -> DataStreamWriter:
    """Writer that adds each micro-batch of ``docs(doc_id, text)`` to the term statistics at ``root``, named as in ``append_stream``."""
    writer = _writer(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        append_statistics(doc_tokens(batch, text_col=text_col), root, writer, number)

    return docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add)
