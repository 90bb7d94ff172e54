"""Synthetic fake generation: real x fake pairing, product facts, text generator, random
review info, duplicate inflation, combined (augmented) records and the augmented union.

Every draw is a pure function of ``(seed, step[, copy])`` via md5, so the job is
reproducible, survives task retries unchanged, and every piece is checkable in SQL.
Steps are rows of ``spark.range(n)``: nothing is looped over on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions import rules
from credence.functions.text import flatten_newlines, seeded_int, seeded_uniform, split_words
from credence.operators import dataset, retrieval, sampling
from credence.schemas import META_FIELDS, PRODUCT_META_FIELDS, SYNTH_META_FIELDS

# Word substitutions used to augment a generated fake review.
SYNONYMS = {
    "good": ["amazing", "excellent", "outstanding"],
    "bad": ["terrible", "horrible", "awful"],
    "love": ["adore", "enjoy", "like"],
    "hate": ["dislike", "loathe", "despise"],
}
# The word order is shuffled when a uniform draw exceeds this.
SHUFFLE_ABOVE = 0.7
# Random review info (ratings drawn from, feedback upper bound, titles).
RATINGS = [1, 5]
MAX_FEEDBACK = 5
TITLE_HIGH = "Amazing product!"
TITLE_LOW = "Terrible experience"
# Duplicate inflation every this many steps, with up to this many copies.
TROLL_EVERY = 1000
TROLL_MAX_COPIES = 10
TROLL_MAX_COMBINED = 50
# Generation attempts kept (the first valid of these is used; otherwise the step is skipped).
ATTEMPTS = 3


# ---------------------------------------------------------------------------------------
# Random review info
# ---------------------------------------------------------------------------------------
def random_review_info(seed: int, key: Column) -> Column:
    """struct(rating, is_recommended, total_feedback_count, total_pos_feedback_count,
    total_neg_feedback_count, helpfulness, review_title) drawn from ``(seed, key)``.
    Invariant: pos + neg = total."""
    rating = F.element_at(F.array(*[F.lit(r) for r in RATINGS]), (seeded_int(seed, key, len(RATINGS), "rating:") + 1).cast("int"))
    total = seeded_int(seed, key, MAX_FEEDBACK + 1, "total:").cast("int")
    pos = F.when(total == 0, F.lit(0)).otherwise(seeded_int(seed, key, total + 1, "pos:")).cast("int")
    return F.struct(
        rating.cast("int").alias("rating"),
        F.when(rating >= 4, 1).otherwise(0).cast("int").alias("is_recommended"),
        total.alias("total_feedback_count"),
        pos.alias("total_pos_feedback_count"),
        (total - pos).cast("int").alias("total_neg_feedback_count"),
        F.when(total == 0, F.lit(0.0)).otherwise(pos / total).alias("helpfulness"),
        F.when(rating == 5, F.lit(TITLE_HIGH)).otherwise(F.lit(TITLE_LOW)).alias("review_title"),
    )


# ---------------------------------------------------------------------------------------
# Text augmentation
# ---------------------------------------------------------------------------------------
def _synonym_map() -> Column:
    return F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def augment_text(text, seed: int, key: Column) -> Column:
    """Replace listed words (exact whitespace token, case-insensitive) by a drawn synonym,
    then shuffle the words when a draw exceeds 0.7; words are re-joined by one blank."""
    words = split_words(text)
    syn = _synonym_map()

    def draw(i: Column, salt: str, n: int) -> Column:
        k = F.concat(key.cast("string"), F.lit(":"), i.cast("string"))
        return seeded_int(seed, k, n, salt)

    subst = F.transform(words, lambda w, i: F.coalesce(
        F.element_at(F.element_at(syn, F.lower(w)), (draw(i, "syn:", 3) + 1).cast("int")), w))
    keyed = F.transform(subst, lambda w, i: F.struct(
        F.md5(F.concat(F.lit(f"{seed}:order:"), key.cast("string"), F.lit(":"), i.cast("string"))).alias("k"),
        w.alias("w")))
    shuffled = F.transform(F.array_sort(keyed), lambda x: x["w"])
    do_shuffle = seeded_uniform(seed, key, "shuffle:") > F.lit(SHUFFLE_ABOVE)
    return F.array_join(F.when(do_shuffle, shuffled).otherwise(subst), " ")


# ---------------------------------------------------------------------------------------
# Prompt and generators
# ---------------------------------------------------------------------------------------
# Fixed value: instruction text of the generation prompt (for a plugged-in text generator).
PROMPT_TEMPLATE = """You are helping generate synthetic low-quality or fake-looking product reviews for a machine learning dataset.

Here is a REAL user review for the product:
---
%s
---

Here is an EXAMPLE of a low-quality / fake-looking review style:
---
%s
---

Now write ONE NEW fake-looking review for the SAME product with the following details:
---
Product summary: %s by %s. 
Highlights: %s.
Rating: %s.
Price: %s USD.
Sale Price: %s USD.
Recommended: 0.0 or 1.0.
---
Requirements:
- Use exaggerated or promotional language.
- Use an extreme sentiment (either very positive or very negative).
- Keep it short to medium length (about 40–120 words).
- Do NOT mention that you are an AI or that this is synthetic or fake.
- Do NOT talk about writing reviews, datasets, or training.
- The text should sound like a normal user review on an e-commerce site.

Only text comments that meet the following format (without line breaks, written on one line) will be returned; all other content will not be returned:
Review title: ... | Review text: ... | Rating: ... | Recommended: ... | Product summary: ... by .... Highlights: ...."""


def build_prompt(real_text, fake_text, meta: Column) -> Column:
    """Generation prompt from the two review texts (newlines flattened) and product facts."""
    return F.format_string(
        PROMPT_TEMPLATE, flatten_newlines(F.coalesce(real_text, F.lit(""))),
        flatten_newlines(F.coalesce(fake_text, F.lit(""))), meta["product_name"], meta["brand_name"],
        meta["highlights"], meta["rating"], meta["price_usd"], meta["sale_price_usd"])


# Sentences of the default template generator (extreme sentiment).
TEMPLATE_POSITIVE = "Absolutely amazing! This %s is the best thing I have ever bought, it changed my life, buy it now!"
TEMPLATE_NEGATIVE = "Total scam! This %s is the worst thing I have ever bought, it ruined my skin, never buy it!"


def template_generator(df_cols: dict, attempt: int) -> Column:
    """Default deterministic generator: a one-line context in the required format, filled
    from product facts and the drawn rating. ``df_cols`` holds ``meta`` and ``info``."""
    meta, info = df_cols["meta"], df_cols["info"]
    name = F.coalesce(meta["product_name"], F.lit(dataset.PRODUCT_NAME_FALLBACK))
    text = F.when(info["rating"] == 5, F.format_string(TEMPLATE_POSITIVE, name)).otherwise(
        F.format_string(TEMPLATE_NEGATIVE, name))
    return F.concat(
        F.lit("Review title: "), info["review_title"], F.lit(" | Review text: "), text,
        F.lit(" | Rating: "), info["rating"].cast("string"), F.lit(" | Recommended: "),
        info["is_recommended"].cast("double").cast("string"), F.lit(" | Product summary: "), name, F.lit(" by "),
        F.coalesce(meta["brand_name"], F.lit("")), F.lit(". Highlights: "), F.coalesce(meta["highlights"], F.lit("")),
        F.lit("."))


template_generator.deterministic = True  # type: ignore[attr-defined]


def generate_with_retry(df: DataFrame, cols: dict, generator: Callable[[dict, int], Column], out_col: str,
                        attempts: int = ATTEMPTS) -> DataFrame:
    """``out_col`` = first non-empty, well-formed output of up to ``attempts`` generator
    calls, else NULL. A later attempt is only evaluated when the earlier ones failed.
    A generator marked ``deterministic`` returns the same text every time, so it is
    called once (repeating it cannot turn a rejected text into an accepted one). A
    generator marked ``retries_inside`` makes its attempts itself; its second argument is
    then their number."""
    if getattr(generator, "deterministic", False):
        attempts = 1
    if getattr(generator, "retries_inside", False):  # one call per row: a projection of its own
        made = df.withColumn(out_col, F.trim(generator(cols, attempts)))
        return made.withColumn(out_col, F.when((F.col(out_col) != "") & rules.format_valid(F.col(out_col)), F.col(out_col)))
    if attempts == 1:  # one projection: nothing to retry
        g = F.trim(generator(cols, 0))
        ok = g.isNotNull() & (g != "") & rules.format_valid(g)
        return df.select("*", F.when(ok, g).alias(out_col))
    out = df
    result = None
    for a in range(attempts):
        g = f"__g{a}"
        call = F.trim(generator(cols, a))
        out = out.withColumn(g, call if result is None else F.when(result.isNull(), call))
        ok = F.col(g).isNotNull() & (F.col(g) != "") & rules.format_valid(F.col(g))
        result = F.when(ok, F.col(g)) if result is None else F.coalesce(result, F.when(ok, F.col(g)))
        out = out.withColumn(out_col, result)
        result = F.col(out_col)
    return out.drop(*[f"__g{a}" for a in range(attempts)])


# ---------------------------------------------------------------------------------------
# Pairing
# ---------------------------------------------------------------------------------------
def pair_real_fake(records: DataFrame, n_samples: int | None = None, ratio: float = 1.0, seed: int = 0,
                   label_field: str = "pseudo_label", pos: str = "pos") -> DataFrame:
    """``n`` steps, each drawing one real and one fake record with replacement.

    Output: ``step`` + real record columns + ``fake_context``. Records are indexed by file
    order inside their class; indices are drawn from ``(seed, step)``."""
    sided = dataset.split_real_fake(records, label_field)
    reals = sided.where(F.col("side") == "real")
    fakes = sided.where(F.col("side") == "fake")
    counts = sided.groupBy("side").count().collect()  # two numbers
    n_real = next((r["count"] for r in counts if r["side"] == "real"), 0)
    n_fake = next((r["count"] for r in counts if r["side"] == "fake"), 0)
    if n_real == 0:
        raise ValueError("No real reviews found. Cannot generate synthetic data.")
    if n_fake == 0:
        raise ValueError("No fake reviews found. Cannot generate synthetic data.")
    n = int(ratio * n_real) if n_samples is None else int(n_samples)
    spark = records.sparkSession
    steps = spark.range(n).withColumnRenamed("id", "step")
    steps = steps.withColumn("__ri", seeded_int(seed, F.col("step"), n_real, "real:")).withColumn(
        "__fi", seeded_int(seed, F.col("step"), n_fake, "fake:"))
    ridx = sampling.pos_rank(reals.drop("side"), pos, None, "__ri").withColumn("__ri", F.col("__ri") - 1)
    fidx = sampling.pos_rank(fakes, pos, None, "__fi").select((F.col("__fi") - 1).alias("__fi"),
                                                              F.col("context").alias("fake_context"))
    return steps.join(ridx, "__ri", "inner").join(fidx, "__fi", "inner").drop("__ri", "__fi")


# ---------------------------------------------------------------------------------------
# Synthetic job
# ---------------------------------------------------------------------------------------
def _union_meta(meta: Column | None, fields: list[str]) -> Column:
    """Meta struct over the union key set; keys not in ``fields`` are NULL."""
    return F.struct(*[(meta[f] if (meta is not None and f in fields) else F.lit(None).cast("string")).alias(f)
                      for f in SYNTH_META_FIELDS])


def synth_fakes(records: DataFrame, collection: DataFrame, n_samples: int | None = None, ratio: float = 1.0,
                seed: int = 0, combine_ratio: int = 0, troll: bool = False,
                generator: Callable[[dict, int], Column] = template_generator, label_field: str = "pseudo_label",
                pos: str = "pos", **retrieval_kw) -> DataFrame:
    """Synthetic fake records.

    For each step: a real and a fake record are drawn, the real context retrieves its
    nearest product (k=1) whose metadata becomes the new ``meta``, the generator writes a
    context (first well-formed of 3 attempts, else the step is skipped), random review
    info lands top-level. With ``troll`` every 1000th step adds 0-10 copies keeping the
    real record's meta; with ``combine_ratio`` m every m-th step adds an augmented copy
    (and with ``troll`` 0-50 more on every 1000th step). ``kind`` says which. Every synthetic
    row has a position of its own, after those of ``records`` (from step, kind and copy)."""
    pairs = pair_real_fake(records, n_samples, ratio, seed, label_field, pos)
    q = retrieval.embed_texts(pairs, "context", "__qvec")
    top1 = retrieval.topk_similar(q, collection, k=1, vec_col="__qvec", out_col="__top", **retrieval_kw)
    step = F.col("step")
    # Product facts and the draws become struct columns in one projection, then are
    # referenced field by field.
    top1 = top1.select(*[c for c in top1.columns if c not in ("__qvec", "__top")],
                       F.element_at("__top", 1)["metadata"].alias("__pmeta"),
                       random_review_info(seed, step).alias("__info"))
    cols = {"meta": F.col("__pmeta"), "info": F.col("__info"), "real": F.col("context"),
            "fake": F.col("fake_context")}
    gen = generate_with_retry(top1, cols, generator, "__gen").where(F.col("__gen").isNotNull())

    base_cols = [c for c in records.columns if c not in ("context", "meta", "pseudo_label", "side", pos)]
    last = records.agg(F.max(pos)).first()[0] or 0

    # Every output variant of a step comes from ONE pass: an array of (kind, copy) per
    # generated row, exploded once. (A union of branches would recompute the pairing,
    # embedding and retrieval per branch: a filter cannot pass through a Python map.)
    def variant(kind: str, copy: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), copy.cast("int").alias("copy"))

    def copies(kind: str, max_copies: int, salt: str) -> Column:
        n = seeded_int(seed, step, max_copies + 1, salt).cast("int")
        many = F.transform(F.array_repeat(F.lit(0), n), lambda _x, i: variant(kind, i + 1))
        return F.when(step % TROLL_EVERY == 0, many).otherwise(F.array().cast("array<struct<kind:string,copy:int>>"))

    empty = F.array().cast("array<struct<kind:string,copy:int>>")
    parts = [F.array(variant("generated", F.lit(0)))]
    if troll:
        parts.append(copies("duplicate", TROLL_MAX_COPIES, "troll:"))
    if combine_ratio:
        on = step % combine_ratio == 0
        parts.append(F.when(on, F.array(variant("combined", F.lit(0)))).otherwise(empty))
        if troll:
            parts.append(F.when(on, copies("combined", TROLL_MAX_COMBINED, "troll_comb:")).otherwise(empty))
    rows = gen.select("*", F.explode(F.concat(*parts)).alias("__v"))
    kind, copy = F.col("__v.kind"), F.col("__v.copy")
    s_step = step.cast("string")

    def keyed(salt: str) -> Column:
        return F.concat(s_step, F.lit(f":{salt}:"), copy.cast("string"))

    info_key = (F.when(kind == "generated", s_step)
                .when(kind == "duplicate", keyed("dup"))
                .when(copy == 0, F.concat(s_step, F.lit(":comb")))
                .otherwise(keyed("combinfo")))
    aug_key = F.when(copy == 0, s_step).otherwise(keyed("comb"))
    rows = rows.withColumn("__ci", F.when(kind == "generated", F.col("__info")).otherwise(
        random_review_info(seed, info_key)))
    context = F.when(kind == "combined", augment_text(F.col("__gen"), seed, aug_key)).otherwise(F.col("__gen"))
    meta = F.when(kind == "generated", _union_meta(F.col("__pmeta"), PRODUCT_META_FIELDS)).otherwise(
        _union_meta(F.col("meta"), META_FIELDS))
    info = F.col("__ci")
    slot = copy + F.when(kind == "combined", TROLL_MAX_COPIES + 1).otherwise(0)
    own = F.lit(last + 1) + step * (TROLL_MAX_COPIES + TROLL_MAX_COMBINED + 2) + slot
    return rows.select(
        own.cast("long").alias(pos),
        *[F.col(c) for c in base_cols],
        context.alias("context"), meta.alias("meta"), F.lit("fake").alias("pseudo_label"),
        info["rating"].alias("rating"), info["is_recommended"].alias("is_recommended"),
        info["total_feedback_count"].alias("total_feedback_count"),
        info["total_pos_feedback_count"].alias("total_pos_feedback_count"),
        info["total_neg_feedback_count"].alias("total_neg_feedback_count"),
        info["helpfulness"].alias("helpfulness"), info["review_title"].alias("review_title"),
        step.alias("step"), kind.alias("kind"), copy.alias("copy"),
    )


def augment_union(records: DataFrame, synthetic: DataFrame, seed: int = 0) -> DataFrame:
    """Originals + synthetic records under one schema (meta widened to the union of keys,
    missing columns NULL), with a seeded ``shuffle_rank`` over a stable row key."""
    orig = records.withColumn("meta", _union_meta(F.col("meta"), META_FIELDS))
    orig = orig.withColumn("row_key", F.concat(F.lit("o:"), F.col("pos").cast("string")))
    syn = synthetic.withColumn("row_key", F.concat(F.lit("s:"), F.col("step").cast("string"), F.lit(":"),
                                                   F.col("kind"), F.lit(":"), F.col("copy").cast("string")))
    both = orig.unionByName(syn, allowMissingColumns=True)
    return sampling.hash_rank(both, seed, "row_key", out_col="shuffle_rank")


def batch_generator(fn=None, deterministic: bool = False, batch_size: int | None = None, load=None):
    """Plug a batch text generator (e.g. a local LLM client) into ``synth_fakes``:
    ``fn(prompts: list[str], attempt: int) -> list[str | None]``. Prompts are built with
    ``build_prompt`` from the real and fake texts and the product facts. One Arrow-batched,
    non-deterministic UDF makes all attempts: each later one gets only the prompts whose
    texts were missing or malformed, so a row costs one call when its first answer is valid.

    ``batch_size`` bounds the prompts of one call (None: those of the Arrow batch). ``load() -> fn``
    stands in for ``fn`` where the model is too large to ship: every task calls it once, before its
    first batch. An answer list of another length than the prompts fails the task."""
    from pyspark.sql.types import StringType

    if (fn is None) == (load is None):
        raise ValueError("give either fn or load")

    def generator(cols: dict, attempts: int) -> Column:
        tries = 1 if deterministic else attempts

        def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            call = load() if fn is None else fn
            for prompts in batches:
                yield pd.Series(_answers(call, list(prompts), tries, batch_size), dtype=object)

        udf = F.pandas_udf(StringType())(generate)
        return udf.asNondeterministic()(build_prompt(cols["real"], cols["fake"], cols["meta"]))

    generator.retries_inside = True  # type: ignore[attr-defined]
    return generator


def _answers(call, prompts: list, tries: int, batch_size: int | None) -> list:
    """The last answer to every prompt; a prompt is asked again while its answer is malformed."""
    out, left = [None] * len(prompts), list(range(len(prompts)))
    for attempt in range(tries):
        size = batch_size or max(1, len(left))
        for at in range(0, len(left), size):
            some = left[at : at + size]
            for i, text in zip(some, call([prompts[i] for i in some], attempt), strict=True):
                out[i] = text
        left = [i for i in left if not (out[i] and all(m in out[i] for m in rules.FORMAT_MARKERS))]
    return out
