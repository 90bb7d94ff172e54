"""Aggregates joined back to their rows without a hot key in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def require_key(df: DataFrame, *cols: str) -> DataFrame:
    """``df``, failing at run time when one of the key columns is NULL: a NULL key would silently
    lose its row in a rank, a split or a join."""
    def checked(c: str) -> Column:
        message = F.lit(f"column {c} is the row key of this operator and must not be NULL")
        return F.coalesce(F.col(c), F.raise_error(message).cast(df.schema[c].dataType))

    return df.withColumns({c: checked(c) for c in cols})


def attach(
    rows: DataFrame,
    keys: list[str],
    spread: Column,
    partial: dict[str, Column],
    final: dict[str, Column],
    then: Callable[[DataFrame], DataFrame] | None = None,
    source: DataFrame | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` plus group aggregates of ``keys`` (non-null columns).

    Rows of a key are dealt over ``salts`` sub-keys by ``spread``. ``partial`` aggregates each
    (key, salt), ``final`` combines the salts of a key; the result is replicated only to the
    salts that exist, so the join is on (key, salt) and a key with a third of all rows is
    spread over ``salts`` tasks. ``then`` may transform the per-key table (it must keep the
    keys and ``__salts``). ``source`` is the table to aggregate when it is cheaper to read than
    ``rows`` (same keys, same ``spread`` columns).
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    src = (rows if source is None else source).withColumn("__salt", salt)
    table = (
        src.groupBy(*keys, "__salt").agg(*[c.alias(n) for n, c in partial.items()])
        .groupBy(*keys).agg(F.collect_list("__salt").alias("__salts"), *[c.alias(n) for n, c in final.items()])
    )
    if then is not None:
        table = then(table)
    table = table.withColumn("__salt", F.explode("__salts")).drop("__salts")
    return rows.withColumn("__salt", salt).join(table, [*keys, "__salt"]).drop("__salt")


def spread_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, salts: int = 16,
                  shuffled: bool = False) -> DataFrame:
    """Left join of ``rows`` to a table with one row per key, a hot key met by up to ``salts`` tasks.

    A lookup row is repeated only for the salts that its key has in ``rows``, so the repeated table has
    at most as many rows as ``rows``. The lookup is shuffled, never broadcast by its estimate: a file of
    a few MB may hold millions of keys. The repeated rows, whose size is known when they are joined, may be
    broadcast below the threshold; with ``shuffled`` (for keys that grow with ``rows``) they never pass the
    driver, whatever the threshold. (Rows of a stream meet the lookup unsalted.)"""
    if rows.isStreaming:
        return rows.join(lookup.hint("merge"), key, "left")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    met = salted.select(key, "__salt").distinct().join(lookup.hint("merge"), key)
    return salted.join(met.hint("merge") if shuffled else met, [key, "__salt"], "left").drop("__salt")
