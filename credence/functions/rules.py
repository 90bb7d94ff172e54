"""Credibility rules as Column expressions: fact checks, heuristic score, final label, parsers.

All of these are per-row and stateless, so they stay inside whole-stage codegen /
higher-order functions on the JVM and work unchanged on a streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence.functions.text import PY_WS, col_, py_strip, ratio_or_zero, safe_float, safe_int

# ---------------------------------------------------------------------------------------
# Fixed values (must equal the pipeline's definitions for identical labels)
# ---------------------------------------------------------------------------------------
# Capacity mention: number, optional single blank, unit. Units in match order.
CAPACITY_PATTERN = rf"([0-9]+(\.[0-9]+)?){PY_WS}?(ml|oz|g|lbs|kg|mL|fl{PY_WS}?oz|oz\.)"
# Unit -> millilitre factor; units not listed are compared unconverted.
UNIT_TO_ML = {"ml": 1.0, "M": 1.0, "oz": 29.5735, "g": 1.0, "lbs": 453.592, "kg": 1000.0}
# Capacity contradiction: differs by more than this share of the product size and this many ml.
CAPACITY_REL_TOL = 0.2
CAPACITY_ABS_TOL = 50.0
# Price mention (first number in the text) and the relative tolerance of the price check.
PRICE_PATTERN = rf"(?:spend|cost|paid|pay)?{PY_WS}*\$?([0-9]+(\.[0-9]{{1,2}})?){PY_WS}?(usd|dollar(s)?|\$)?"
PRICE_REL_TOL = 0.1
# In-store purchase phrases (contradict an online-only product).
STORE_PHRASES = [
    "bought in store", "purchased at store", "found in store", "seen in store", "available in store",
    "went to the store", "visited the store", "in-store purchase", "brick and mortar",
]
# Word boundary of a Python str regex: neighbours that are not letters, digits or underscore.
_NOT_WORD = r"[^\p{L}\p{N}_]"
STORE_PATTERN = rf"(?:^|{_NOT_WORD})(?:{'|'.join(STORE_PHRASES)})(?:{_NOT_WORD}|$)"
# Heuristic score: a review is fake when the score exceeds this; real needs this many characters.
FAKE_THRESHOLD = 2
MIN_REAL_CONTEXT_CHARS = 60
# Format check of a generated context: each marker must appear somewhere.
FORMAT_MARKERS = ["Review text: ", "Rating: ", "Product summary: ", "Highlights: "]
# Model-output parsers and their fallbacks.
LABEL_PATTERN = rf"label:{PY_WS}*(fake|real)"
REASON_PATTERN = rf"(?id)reason:{PY_WS}*(.*)"
LABEL_FALLBACK = "fake"
REASON_FALLBACK = "The reason for this label is unclear."
# Explainer reason templates per label.
REASON_FAKE = "The product information contradicts the review, or the review content is too vague or inconsistent."
REASON_REAL = "The review content matches the product features and provides meaningful detail."
# Verdict display text.
VERDICT_USEFUL = "Useful Review"
VERDICT_USELESS = "Useless Review"


# ---------------------------------------------------------------------------------------
# Capacities and prices
# ---------------------------------------------------------------------------------------
def _unit_factor(unit: Column) -> Column:
    m = F.create_map(*[x for k, v in UNIT_TO_ML.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, unit), F.lit(1.0))


def extract_capacity(text) -> Column:
    """All ``[amount, unit]`` capacity mentions in the lower-cased text, in order."""
    t = F.lower(col_(text))
    # one pass over the text; amount and unit are taken from the short mentions
    mentions = F.regexp_extract_all(t, F.lit(CAPACITY_PATTERN), 0)
    return F.transform(
        mentions,
        lambda m: F.struct(
            F.regexp_extract(m, CAPACITY_PATTERN, 1).try_cast("double").alias("amount"),
            F.regexp_extract(m, CAPACITY_PATTERN, 3).alias("unit")),
    )


def capacities_ml(text) -> Column:
    """Capacity mentions converted to millilitres (unknown units unconverted)."""
    return F.transform(extract_capacity(text), lambda c: c["amount"] * _unit_factor(c["unit"]))


def to_ml(amount, unit) -> Column:
    return col_(amount) * _unit_factor(col_(unit))


def extract_price(text) -> Column:
    """First number in the lower-cased text (the price pattern matches any number), or NULL."""
    t = F.lower(col_(text))
    return F.when(t.rlike(PRICE_PATTERN), safe_float(F.regexp_extract(t, PRICE_PATTERN, 1)))


def capacity_mismatch(review_ml: Column, product_size) -> Column:
    """Both sides mention capacities and every (review, product) pair differs too much."""
    prod_ml = capacities_ml(F.lower(F.coalesce(col_(product_size), F.lit(""))))
    all_far = F.forall(
        review_ml,
        lambda c: F.forall(
            prod_ml,
            lambda p: (F.abs(c - p) > p * CAPACITY_REL_TOL) & (F.abs(c - p) > CAPACITY_ABS_TOL),
        ),
    )
    return (F.size(review_ml) > 0) & (F.size(prod_ml) > 0) & F.coalesce(all_far, F.lit(False))


# ---------------------------------------------------------------------------------------
# Scope checks (text is the lower-cased context, highlights are taken as stored)
# ---------------------------------------------------------------------------------------
def _has(c: Column, word: str) -> Column:
    return F.coalesce(F.contains(c, F.lit(word)), F.lit(False))


def skin_type_mismatch(text_lc: Column, highlights: Column) -> Column:
    h = F.coalesce(highlights, F.lit(""))
    return (_has(text_lc, "oily") & _has(h, "dry")) | (_has(text_lc, "dry") & _has(h, "oily"))


def gender_mismatch(text_lc: Column, highlights: Column) -> Column:
    h = F.coalesce(highlights, F.lit(""))
    gendered = _has(h, "men") | _has(h, "women") | _has(h, "unisex") | _has(h, "gender-neutral") | _has(h, "genderless")
    return _has(text_lc, "men") & gendered & ~_has(h, "unisex") & ~_has(h, "genderless")


def online_only_mismatch(text_lc: Column, online_only: Column) -> Column:
    flag_on = online_only.isNotNull() & (online_only != F.lit(""))
    return flag_on & store_mention(text_lc)


def price_mismatch(review_price: Column, price: Column, value_price: Column, sale_price: Column) -> Column:
    """Optional check (off by default): every listed price differs by more than 10%."""
    prices = F.array(safe_float(price), safe_float(value_price), safe_float(sale_price))
    far = F.forall(
        prices,
        lambda p: p.isNotNull() & (p != 0) & (F.abs(review_price - p) > p * PRICE_REL_TOL),
    )
    return review_price.isNotNull() & (review_price != 0) & F.coalesce(far, F.lit(False))


def store_mention(text_lc: Column) -> Column:
    """In-store purchase phrase as a whole phrase. A plain substring test runs first, so
    the regex only scans texts that can match."""
    maybe = _has(text_lc, "store") | _has(text_lc, "brick and mortar")
    return maybe & F.coalesce(text_lc.rlike(STORE_PATTERN), F.lit(False))


def review_capacities(text_lc: Column) -> Column:
    """``capacities_ml`` of texts that contain a digit (others have none)."""
    digit = F.lit(False)
    for d in "0123456789":
        digit = digit | _has(text_lc, d)
    return F.when(digit, capacities_ml(text_lc)).otherwise(F.array().cast("array<double>"))


def review_features(context, with_price: bool = False) -> Column:
    """Review-side inputs of the fact check, computed once per review (not per product)."""
    t = F.lower(F.coalesce(col_(context), F.lit("")))
    fields = [
        _has(t, "oily").alias("oily"),
        _has(t, "dry").alias("dry"),
        _has(t, "men").alias("men"),
        store_mention(t).alias("store"),
        review_capacities(t).alias("ml"),
    ]
    if with_price:
        fields.append(extract_price(t).alias("price"))
    return F.struct(*fields)


def document_contradicts(feat: Column, doc: Column, with_price: bool = False) -> Column:
    """One retrieved product against the review features (only short product fields are scanned)."""
    meta = doc["metadata"]
    h = F.coalesce(meta["highlights"], F.lit(""))
    skin = (feat["oily"] & _has(h, "dry")) | (feat["dry"] & _has(h, "oily"))
    gendered = _has(h, "men") | _has(h, "women") | _has(h, "unisex") | _has(h, "gender-neutral") | _has(h, "genderless")
    gender = feat["men"] & gendered & ~_has(h, "unisex") & ~_has(h, "genderless")
    online = meta["online_only"].isNotNull() & (meta["online_only"] != F.lit("")) & feat["store"]
    checks = skin | gender | capacity_mismatch(feat["ml"], meta["size"]) | online
    if with_price:
        checks = checks | price_mismatch(feat["price"], meta["price_usd"], meta["value_price_usd"],
                                         meta["sale_price_usd"])
    return checks


def factual_label_from(feat: Column, retrieved, with_price: bool = False) -> Column:
    bad = F.exists(col_(retrieved), lambda d: F.coalesce(document_contradicts(feat, d, with_price), F.lit(False)))
    return F.when(F.coalesce(bad, F.lit(False)), F.lit("fake")).otherwise(F.lit("real"))


def factual_label(context, retrieved, with_price: bool = False) -> Column:
    """``fake`` when any retrieved product contradicts the review, else ``real``.
    On a DataFrame prefer ``with_factual_label`` (review features computed once)."""
    return factual_label_from(review_features(context, with_price), retrieved, with_price)


def with_factual_label(df, out_col: str = "fact_label", context: str = "context", retrieved: str = "retrieved",
                       with_price: bool = False):
    """Add ``out_col``; review features are a struct column first (two projections, each
    analysed once, instead of a chain of withColumn / drop)."""
    tmp = f"__rf_{out_col}"
    keep = [F.col(c) for c in df.columns if c != out_col]
    staged = df.select(*keep, review_features(F.col(context), with_price).alias(tmp))
    return staged.select(*keep, factual_label_from(F.col(tmp), F.col(retrieved), with_price).alias(out_col))


# ---------------------------------------------------------------------------------------
# Heuristic score and final label
# ---------------------------------------------------------------------------------------
def _parsed_rating(meta: Column, missing: str) -> tuple[Column, Column]:
    """(rating value, rating-present flag). ``missing='nan'`` carries a NULL rating as NaN."""
    raw = meta["rating"]
    r = safe_float(raw)
    if missing == "nan":
        present = raw.isNull() | r.isNotNull()
        r = F.when(raw.isNull(), F.lit(float("nan"))).otherwise(r)
    elif missing == "null":
        present = r.isNotNull()
    else:
        raise ValueError("missing must be 'nan' or 'null'")
    return r, present


def score_inputs(context, meta, missing: str = "nan", strict_int: bool = True) -> Column:
    """Parsed score inputs as one struct (computed once, then referenced by the rules)."""
    meta = col_(meta)
    text = py_strip(F.coalesce(col_(context), F.lit("")))
    rating, has_rating = _parsed_rating(meta, missing)
    tfc = safe_int(meta["total_feedback_count"])
    neg = safe_int(meta["total_neg_feedback_count"])
    return F.struct(
        F.length(text).alias("n"),
        rating.alias("rating"),
        has_rating.alias("has_rating"),
        safe_int(meta["is_recommended"], strict=strict_int).alias("is_rec"),
        safe_float(meta["helpfulness"]).alias("helpful"),
        tfc.alias("tfc"),
        F.when(tfc.isNotNull(), ratio_or_zero(neg, tfc)).otherwise(F.lit(0.0)).alias("neg_pct"),
    )


def score_from(si: Column) -> Column:
    """Heuristic fake score (double; +inf marks an unusable review) from ``score_inputs``."""
    n, rating, has_rating = si["n"], si["rating"], si["has_rating"]
    is_rec, helpful, tfc, neg_pct = si["is_rec"], si["helpful"], si["tfc"], si["neg_pct"]
    has_text = n > 0
    valid = rating.isNotNull() & ~F.isnan(rating)

    def pts(cond: Column, p: int = 1) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(p)).otherwise(F.lit(0))

    extreme = valid & rating.isin(1.0, 5.0)
    low_help = helpful.isNotNull() & ~F.isnan(helpful) & tfc.isNotNull() & (tfc >= 3) & (helpful < 0.3)
    tier = (
        F.when(tfc >= 25, neg_pct > 0.6)
        .when(tfc >= 10, neg_pct > 0.7)
        .when(tfc >= 5, neg_pct > 0.8)
        .otherwise(F.lit(False))
    )
    scored = (
        pts(extreme & (n < 20), 2)
        + pts(low_help)
        + pts(low_help & tier)
        + pts((tfc == 0) & extreme & (n < 40))
        + pts(valid & (rating <= 2) & ((is_rec == 1) | (neg_pct > 0.8)))
        + pts(valid & (rating >= 4) & ((is_rec == 0) | (neg_pct > 0.8)))
    ).cast("double")
    no_rating = F.when(n < 20, F.lit(float("inf"))).when(n < 50, F.lit(2.0)).otherwise(F.lit(1.0))
    return (
        F.when(has_rating & has_text, scored)
        .when(~has_rating & has_text, no_rating)
        .otherwise(F.lit(float("inf")))
    )


def fake_score(context, meta, missing: str = "nan", strict_int: bool = True) -> Column:
    """Heuristic fake score. On a DataFrame prefer ``with_fake_score`` (parses once)."""
    return score_from(score_inputs(context, meta, missing, strict_int))


def with_fake_score(df, out_col: str = "fake_score", context: str = "context", meta: str = "meta",
                    missing: str = "nan", strict_int: bool = True):
    """Add ``out_col``: the inputs are parsed into one struct column first, so the rule
    tree stays small enough for whole-stage codegen."""
    tmp = f"__si_{out_col}"
    keep = [F.col(c) for c in df.columns if c != out_col]
    staged = df.select(*keep, score_inputs(F.col(context), F.col(meta), missing, strict_int).alias(tmp))
    return staged.select(*keep, score_from(F.col(tmp)).alias(out_col))


def final_label(fact: Column, score: Column, context, meta, missing: str = "nan",
                threshold: float = FAKE_THRESHOLD) -> Column:
    ctx = F.coalesce(col_(context), F.lit(""))
    _, has_rating = _parsed_rating(col_(meta), missing)
    return (
        F.when(fact == F.lit("fake"), F.lit("fake"))
        .when(score > F.lit(float(threshold)), F.lit("fake"))
        .when((F.length(ctx) >= MIN_REAL_CONTEXT_CHARS) & has_rating, F.lit("real"))
        .otherwise(F.lit("fake"))
    )


# ---------------------------------------------------------------------------------------
# Generated-text checks, prompts and model-output parsers
# ---------------------------------------------------------------------------------------
def format_valid(context) -> Column:
    c = F.coalesce(col_(context), F.lit(""))
    out = F.lit(True)
    for m in FORMAT_MARKERS:
        out = out & F.contains(c, F.lit(m))
    return out


def parse_label(text) -> Column:
    """``label: fake|real`` (case-insensitive) with fallback ``fake``."""
    got = F.regexp_extract(F.lower(F.coalesce(col_(text), F.lit(""))), LABEL_PATTERN, 1)
    return F.when(got != "", got).otherwise(F.lit(LABEL_FALLBACK))


def parse_explanation(text) -> Column:
    """struct(label, reason): label capitalised (fallback lower-case ``fake``), reason to end of line."""
    t = F.coalesce(col_(text), F.lit(""))
    lab = F.regexp_extract(t, "(?i)" + LABEL_PATTERN, 1)
    reason = F.regexp_extract(t, REASON_PATTERN, 1)
    return F.struct(
        F.when(lab != "", F.initcap(lab)).otherwise(F.lit(LABEL_FALLBACK)).alias("label"),
        F.when(reason != "", reason).otherwise(F.lit(REASON_FALLBACK)).alias("reason"),
    )


def verdict_text(prediction) -> Column:
    return F.when(col_(prediction) == 1, F.lit(VERDICT_USEFUL)).otherwise(F.lit(VERDICT_USELESS))


def reason_for(label) -> Column:
    return F.when(col_(label) == "fake", F.lit(REASON_FAKE)).otherwise(F.lit(REASON_REAL))


def explainer_prompt(context) -> Column:
    return F.concat(F.lit("The review context: "), F.coalesce(col_(context), F.lit("")), F.lit("\nclassify:"))


def explainer_target(label, reason) -> Column:
    return F.concat(F.lit("label: "), col_(label), F.lit(". reason: "), col_(reason))


def argmax_array(arr) -> Column:
    """0-based index of the first maximum."""
    a = col_(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")
