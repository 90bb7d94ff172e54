"""Text builders and parsers for review contexts and product documents (Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.schemas import META_FIELDS, PRODUCT_META_FIELDS

# Labels of the review context parts, in output order, and their separator.
CTX_TITLE = "Review title: "
CTX_TEXT = "Review text: "
CTX_RATING = "Rating: "
CTX_RECOMMENDED = "Recommended: "
CTX_SUMMARY = "Product summary: "
CTX_SEP = " | "

# Labelled parts of the product document, in output order, and separator.
DOC_PARTS = [
    ("product_name", "Product Name: "),
    ("product_id", "Product ID: "),
    ("brand_name", "Brand: "),
    ("brand_id", "Brand ID: "),
    ("rating", "Rating: "),
    ("reviews", "Number of Reviews: "),
    ("size", "Size: "),
    ("price_usd", "Price: $"),
    ("value_price_usd", "Value Price: $"),
    ("sale_price_usd", "Sale Price: $"),
    ("online_only", "Online Only: "),
    ("highlights", "Highlights: "),
]
DOC_SEP = ". "

# Fixed value: how a missing value prints when formatted into text.
MISSING_TEXT = "nan"


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _printed(df: DataFrame, name: str) -> Column:
    """Value as formatted text: missing prints ``nan``, an absent column prints empty."""
    if not _has(df, name):
        return F.lit("")
    return F.coalesce(F.col(name), F.lit(MISSING_TEXT))


def _labelled_if_present(df: DataFrame, name: str, label: str) -> Column:
    if not _has(df, name):
        return F.lit(None).cast("string")
    return F.when(F.col(name).isNotNull(), F.concat(F.lit(label), F.col(name)))


def context_text(df: DataFrame, summary_col: str | None = "product_summary") -> Column:
    """Review context: title?, text, rating?, recommended?, product summary? joined by `` | ``."""
    parts = [
        _labelled_if_present(df, "review_title", CTX_TITLE),
        F.concat(F.lit(CTX_TEXT), _printed(df, "review_text")),
        _labelled_if_present(df, "rating", CTX_RATING),
        _labelled_if_present(df, "is_recommended", CTX_RECOMMENDED),
    ]
    if summary_col and _has(df, summary_col):
        parts.append(F.when(F.col(summary_col).isNotNull(), F.concat(F.lit(CTX_SUMMARY), F.col(summary_col))))
    return F.concat_ws(CTX_SEP, *parts)


def product_summary(df: DataFrame) -> Column:
    """``<name> by <brand>. Highlights: <highlights>.`` with missing values printed as ``nan``."""
    return F.concat(
        _printed(df, "product_name"), F.lit(" by "), _printed(df, "brand_name"),
        F.lit(". Highlights: "), _printed(df, "highlights"), F.lit("."),
    )


def product_document(df: DataFrame) -> Column:
    """Product description text. Expects missing values already filled with ``""``:
    every existing column emits its labelled part, absent columns are skipped."""
    parts = [F.concat(F.lit(label), F.coalesce(F.col(c), F.lit(""))) for c, label in DOC_PARTS if _has(df, c)]
    return F.concat_ws(DOC_SEP, *parts)


def product_id_default(id_col: str = "product_id", pos_col: str = "pos") -> Column:
    """``product_id or f"prod_{row_index}"``."""
    pid = F.col(id_col)
    return F.when(pid.isNotNull() & (pid != ""), pid).otherwise(F.concat(F.lit("prod_"), F.col(pos_col).cast("string")))


def product_metadata(df: DataFrame, id_col: Column | None = None) -> Column:
    """Metadata struct of the 12 product fields; value/sale price fall back to the list price."""

    def field(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if _has(df, name) else F.lit("")

    price = field("price_usd") if _has(df, "price_usd") else F.lit("0")
    values = {
        "product_id": id_col if id_col is not None else field("product_id"),
        "price_usd": price,
        "value_price_usd": F.when(field("value_price_usd") != "", field("value_price_usd")).otherwise(price),
        "sale_price_usd": F.when(field("sale_price_usd") != "", field("sale_price_usd")).otherwise(price),
        "reviews": field("reviews") if _has(df, "reviews") else F.lit("0"),
        # An absent flag column stores a falsy value (the online-only rule stays off).
        "online_only": field("online_only") if _has(df, "online_only") else F.lit(None).cast("string"),
    }
    return F.struct(*[(values[n] if n in values else field(n)).alias(n) for n in PRODUCT_META_FIELDS])


def review_meta(df: DataFrame) -> Column:
    return F.struct(*[(F.col(n) if _has(df, n) else F.lit(None).cast("string")).alias(n) for n in META_FIELDS])


def request_context(title: Column, text: Column, recommended: Column, rating: Column, name: Column,
                    brand: Column, highlights: Column) -> Column:
    """Form-style context: every part printed; recommended flag prints ``1.0``/``0.0``."""
    rec = F.when(F.coalesce(recommended, F.lit(False)), F.lit("1.0")).otherwise(F.lit("0.0"))
    nz = lambda c: F.coalesce(c, F.lit(MISSING_TEXT))
    return F.concat(
        F.lit(CTX_TITLE), F.coalesce(title, F.lit("")), F.lit(CTX_SEP),
        F.lit(CTX_TEXT), F.coalesce(text, F.lit("")), F.lit(CTX_SEP),
        F.lit(CTX_RATING), nz(rating), F.lit(CTX_SEP),
        F.lit(CTX_RECOMMENDED), rec, F.lit(CTX_SEP),
        F.lit(CTX_SUMMARY), nz(name), F.lit(" by "), nz(brand), F.lit(". Highlights: "), nz(highlights), F.lit("."),
    )


# Patterns that split a context back into its form fields.
_NEXT_PART = r"(?: \| Rating: | \| Recommended: | \| Product summary: |$)"
PARSE_TITLE = r"(?s)^Review title: (.*?) \| Review text: "
PARSE_TEXT = r"(?s)Review text: (.*?)" + _NEXT_PART
PARSE_NAME = r"(?s)Product summary: (.*) by .*?\. Highlights: "
PARSE_RECOMMENDED = r"Recommended: ([^ |]+)"


def parse_context(ctx: Column) -> Column:
    """Inverse of the context builder: struct(title, text, product_name, recommended).

    Absent title -> ``""``; absent Recommended -> ``"0.0"`` (the form default)."""
    return F.struct(
        F.regexp_extract(ctx, PARSE_TITLE, 1).alias("review_title"),
        F.regexp_extract(ctx, PARSE_TEXT, 1).alias("review_text"),
        F.regexp_extract(ctx, PARSE_NAME, 1).alias("product_name"),
        F.coalesce(F.nullif(F.regexp_extract(ctx, PARSE_RECOMMENDED, 1), F.lit("")), F.lit("0.0")).alias("recommended"),
    )


__all__ = [
    "context_text", "product_summary", "product_document", "product_id_default", "product_metadata",
    "review_meta", "request_context", "parse_context",
]
