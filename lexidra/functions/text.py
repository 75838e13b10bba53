"""Text columns: assembling, tokenizing, term names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A token is a maximal run of Unicode letters and digits.
TOKEN_PATTERN = r"[\p{L}\p{N}]+"

# Every character that counts as white space in Unicode, control separators included.
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
OUTER_SPACE = f"^{_SPACE}+|{_SPACE}+$"


def assemble_text(title: Column | None, text: Column) -> Column:
    """``title + " " + text`` without surrounding white space; missing parts count as empty."""
    head = F.lit("") if title is None else F.coalesce(title, F.lit(""))
    joined = F.concat(head, F.lit(" "), F.coalesce(text, F.lit("")))
    return F.regexp_replace(joined, OUTER_SPACE, "")


def tokens_of(text: Column | str, max_length: int | None = None) -> Column:
    """Array of lower-cased tokens; ``max_length`` keeps the leading tokens only."""
    source = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.lower(source), F.lit(TOKEN_PATTERN), F.lit(0))
    return found if max_length is None else F.slice(found, 1, max_length)


def tokenize(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_length: int | None = None
) -> DataFrame:
    """One row per token: ``(id, pos, token)`` with ``pos`` counted from 0.

    Narrow: a document is exploded where it is read.
    """
    return docs.select(id_col, F.posexplode(tokens_of(text_col, max_length)).alias("pos", "token")).select(
        id_col, F.col("pos").cast("bigint").alias("pos"), "token"
    )


def term_name(index: Column | str) -> Column:
    """Name of the sparse dimension ``index``."""
    return F.concat(F.lit("term_"), (F.col(index) if isinstance(index, str) else index).cast("string"))
