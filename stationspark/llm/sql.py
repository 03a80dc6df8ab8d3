"""Pieces of DuckDB SQL that several queries' SQL needs."""

from __future__ import annotations

#: One row with ``tab``, the 256 checksums of the single bytes, from the polynomial's rule.
CRC_TABLE = "SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))"


def crc32_sql(text: str) -> str:
    """The unsigned checksum of a text's UTF-8 bytes, where ``tab`` of CRC_TABLE is at hand."""
    byte = f"cast('0x' || hex(encode({text}))[2*i-1:2*i] AS bigint)"
    return f"xor(list_reduce(list_transform(range(1, octet_length(encode({text})) + 1), lambda i: {byte}), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295)"


def base32_sql(hexadecimal: str, digits: int = 40) -> str:
    """Upper-case base 32 of a number in lower-case hexadecimal of ``digits`` digits (a multiple of 5)."""
    digit = lambda at: f"(instr('0123456789abcdef', ({hexadecimal} || '0')[{at}]) - 1)"
    five = f"((({digit('5 * i // 4 + 1')} * 16 + {digit('5 * i // 4 + 2')}) >> (3 - 5 * i % 4)) & 31)"
    return f"array_to_string(list_transform(range({digits * 4 // 5}), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[{five} + 1]), '')"
