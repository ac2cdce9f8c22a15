"""DuckDB SQL pieces that several operators' oracles share."""

from __future__ import annotations

#: One step of CRC-32 by bit, applied eight times to every byte value.
_BIT = "CASE WHEN {v} % 2 = 1 THEN xor({v} // 2, 3988292384) ELSE {v} // 2 END"


def crc_table() -> str:
    """A CTE crc_table(t): the 256 entries of the CRC-32 table as one list."""
    step = "SELECT i, i AS v FROM (SELECT unnest(range(256)) AS i)"
    for _ in range(8):
        step = f"SELECT i, {_BIT.format(v='v')} AS v FROM ({step})"
    return f"crc_table AS (SELECT list(v::BIGINT ORDER BY i) AS t FROM ({step}))"


def crc32(text: str) -> str:
    """CRC-32 of a VARCHAR's UTF-8 bytes as an unsigned BIGINT; t of crc_table must be in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, o: xor(c // 256, t[xor(c, o) % 256 + 1])), 4294967295::BIGINT)"


def words(text: str) -> str:
    """Words of a text as a list."""
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
