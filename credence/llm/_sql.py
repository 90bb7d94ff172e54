"""DuckDB fragments that several statements share."""

from __future__ import annotations


def crc32_ctes(keys: str, out: str = "crcs") -> str:
    """Common table expressions (for WITH RECURSIVE) giving ``out(key, crc)`` of the distinct strings
    ``key`` of the table ``keys``. The check sum is linear: every byte adds its table entry advanced by
    its distance from the end, the start value is advanced by the length."""
    return f"""
bits(b, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT b, c FROM bits WHERE k = 8),
longest AS (SELECT coalesce(max(octet_length(encode(key))), 0) AS n FROM {keys}),
far(d, b, c) AS (
  SELECT 0, b, c FROM tab
  UNION ALL SELECT d + 1, far.b, xor(far.c >> 8, tab.c) FROM far JOIN tab ON tab.b = far.c & 255 WHERE d < (SELECT n FROM longest)),
starts(d, c) AS (
  SELECT 0, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT d + 1, xor(starts.c >> 8, tab.c) FROM starts JOIN tab ON tab.b = starts.c & 255 WHERE d < (SELECT n FROM longest)),
hexed AS (SELECT DISTINCT key, hex(encode(key)) AS h FROM {keys}),
key_bytes AS (SELECT key, h, CAST(length(h) / 2 AS BIGINT) AS size, unnest(range(CAST(length(h) / 2 AS BIGINT))) AS i FROM hexed),
folded AS (
  SELECT key, any_value(size) AS size, bit_xor(far.c) AS c
  FROM key_bytes JOIN far ON far.d = size - 1 - i AND far.b = CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) GROUP BY key),
{out} AS (SELECT key, xor(xor(folded.c, starts.c), 4294967295) AS crc FROM folded JOIN starts ON starts.d = size)"""
