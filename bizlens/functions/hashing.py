"""Seeded, engine-portable row hashes.

The hash is the first 15 hex digits of ``md5(key || '|' || seed)`` read as an
unsigned 60-bit integer (a null key hashes as the empty text), so a draw modulo
n reaches every index of any table and its bias is negligible.  It depends only on the key and the seed - never on
partitioning - so samples are identical on recompute (e.g. after a lost
executor) and equal to the DuckDB oracle, which computes
``('0x' || substr(md5(key || '|' || seed), 1, 15))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    """Unsigned 60-bit hash of ``key`` under ``seed`` as a bigint."""
    k = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(F.coalesce(k.cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def duck_hash(key_sql: str, seed: int | str) -> str:
    """The same hash as DuckDB SQL text (for oracles)."""
    return f"('0x' || substr(md5(coalesce(CAST({key_sql} AS VARCHAR), '') || '|{seed}'), 1, 15))::BIGINT"
