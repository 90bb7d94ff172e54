"""Mixing sources to target weights (DataFrame functions only).

Words are summed per source. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share 100 % of all words by weight; a target stops at ``cap`` times its source's words and the
excess is shared among the others by weight until none is above (water filling, solved in closed
form from prefix sums over the sources ordered by cap / weight). A source's repetition rate is
target / words. Each document is emitted floor(rate) times, plus one hash-seeded Bernoulli copy whose
probability is the fraction: its draw is a hash of (seed number, id, md5 of the whole text), below the
fraction or not. No two documents share anything in their draws; no rows are ordered or numbered, and
texts never shuffle.

Independent draws miss the target of a small source: their standard deviation is sqrt(f * (1 - f) *
sum(size^2)), a fifth of the words of 50 documents. So ``SEEDS`` seed numbers are tried and a source
takes the one whose copies come nearest to its target (ties: the smallest number), as in rejective
sampling: all are summed in one pass over the sizes. The draws under two seed numbers are independent,
both come from one md5 (u + number * v modulo 2**48).

Defined cases
-------------
* null text: size 0, taken 0, hashed like an empty one. Null source: a source of its own, after all
  others ('' is first).
* a source without words: target 0, its documents are emitted 0 times.
* the same id (or a null id) on unlike texts: a draw each. Rows equal in id and text are the same
  document, they share their draw.
* empty table: empty result. Extra columns stay in ``mix``, also those named like its own results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.operators.skew import spread_lookup
from credence.llm._ranks import ordered_sums
from credence.llm._scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEEDS = 32
SPACE = 1 << 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hashes(seed: str, doc_id: Column, text: Column) -> Column:
    """(u, v): two 48-bit numbers of the document."""
    code = F.md5(F.concat_ws(":", F.lit(seed), doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")))))
    return F.struct(F.conv(F.substring(code, 1, 12), 16, 10).cast("long").alias("u"), F.conv(F.substring(code, 13, 12), 16, 10).cast("long").alias("v"))


def extra_copy(number: Column | int, rate: Column) -> Column:
    """1 where the document's draw under this seed number is below the rate's fraction, else 0."""
    at = F.pmod(F.col("__hash.u") + number * F.col("__hash.v"), F.lit(SPACE)).cast("double")
    return (at < (rate - F.floor(rate)) * F.lit(float(SPACE))).cast("long")


def _targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """One row per source: adds target. Columns in: __null, __source, source_size."""
    ranked = ordered_sums(sources, [F.col("__null"), F.col("__source")], {"__rank": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("__rank", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("__weight", weight).withColumn("__ratio", cap * F.col("source_size") / F.col("__weight"))
    order = [F.col("__ratio"), F.col("__null"), F.col("__source")]
    filled = ordered_sums(ranked, order, {"__cap_before": cap * F.col("source_size"), "__w_before": F.col("__weight")}, "filling")
    whole = filled.agg(F.sum("source_size").alias("__all"), F.sum("__weight").alias("__w_all"))
    level = filled.crossJoin(F.broadcast(whole)).agg(  # one row
        F.max((F.col("__all") - F.col("__cap_before")).cast("double") / (F.col("__w_all") - F.col("__w_before"))).alias("__level")
    )
    return filled.crossJoin(F.broadcast(level)).withColumn(
        "target", F.least(F.col("__level") * F.col("__weight"), (cap * F.col("source_size")).cast("double"))
    ).drop("__rank", "__weight", "__ratio", "__cap_before", "__w_before", "__level")


def source_key(source: Column) -> Column:
    """One non-null key per source; null and '' stay apart."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seeds: int = SEEDS) -> DataFrame:
    """One row per source: __key, source_size, target, __rate, __number (its seed number). ``sized`` is
    narrow and materialised: __src, __size, __key, __hash. Sums are combined before the shuffles."""
    sources = sized.groupBy(F.col("__src").isNull().alias("__null"), F.coalesce("__src", F.lit("")).alias("__source")).agg(
        F.sum("__size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = source_key(F.when(~F.col("__null"), F.col("__source")))
    per_source = materialize(_targets(sources, weights, cap).select(key.alias("__key"), "source_size", "target", rate.alias("__rate")), "rates")
    rows = spread_lookup(sized, per_source.select("__key", "__rate"), "__key", F.col("__hash.u"))
    taken = rows.groupBy("__key").agg(*[F.sum(F.col("__size") * (F.floor("__rate") + extra_copy(i, F.col("__rate")))).alias(f"__t{i}") for i in range(seeds)])
    off = F.array_sort(F.array(*[F.struct(F.abs(F.col(f"__t{i}") - F.col("target")).alias("off"), F.lit(i).alias("number")) for i in range(seeds)]))
    chosen = taken.join(per_source, "__key").withColumn("__number", off[0]["number"])
    return materialize(chosen.select("__key", "source_size", "target", "__rate", "__number"), "rates")


def with_copies(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` (with __key and __hash) plus source_size, target and copies. The rates are broadcast by
    the planner when their size allows, else met by salted keys, so that a hot source spreads."""
    joined = spread_lookup(rows, per_source, "__key", F.col("__hash.u"))
    return joined.withColumn("copies", (F.floor("__rate") + extra_copy(F.col("__number"), F.col("__rate"))).cast("long"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str, *more: Column) -> DataFrame:
    return materialize(docs.select(
        *more, F.col(source_col).cast("string").alias("__src"), word_count(F.col(text_col)).alias("__size"),
        source_key(F.col(source_col)).alias("__key"), _hashes(seed, F.col(id_col), F.col(text_col)).alias("__hash")), "sizes")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             seed: str = "mix", **options) -> DataFrame:
    """Per document: id, size, source_size, target, copies, taken. Texts are read once and never shuffle.
    Options: ``weights``, ``cap``, ``seeds``."""
    sized = _sized(docs, id_col, source_col, text_col, seed, F.col(id_col))
    out = with_copies(sized, rates(sized, **options))
    return out.select(id_col, F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("__size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        seed: str = "mix", **options) -> DataFrame:
    """The mixed rows of ``docs``: each row as often as the plan says, same columns. Every row finds its
    own number of copies; rows are not joined with a plan."""
    per_source = rates(_sized(docs, id_col, source_col, text_col, seed), **options).select("__key", "__rate", "__number")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), source_key(F.col(source_col)).alias("__key"),
        _hashes(seed, F.col(id_col), F.col(text_col)).alias("__hash"))
    out = with_copies(rows, per_source).filter("copies > 0")
    return out.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__doc.*")
