"""CRC-32 of a decimal id, for SQL engines without that function."""

from __future__ import annotations


def crc32_sql(number: str) -> str:
    """DuckDB SQL: the unsigned CRC-32 of the decimal digits of ``number``; null where it is null."""
    digits = f"list_transform(range(1, length(({number})::VARCHAR) + 1), lambda i: ascii(substr(({number})::VARCHAR, i, 1))::BIGINT)"
    byte = "list_reduce(range(8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), xor(crc, digit))"
    return f"xor(list_reduce({digits}, lambda crc, digit: {byte}, 4294967295::BIGINT), 4294967295::BIGINT)"
