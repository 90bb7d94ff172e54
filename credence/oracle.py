"""DuckDB SQL oracles: an independent SQL statement of every registered query.

Only fixed values (patterns, word lists, labels) are shared with the Spark code; the
logic is restated in SQL so that a mistake in either side shows up as a mismatch.
Tables ``part documents embeddings labels`` are the pre-registered parquet views.
"""

from __future__ import annotations

from credence.functions import rules
from credence.functions.text import FLOAT_PATTERN, INT_PATTERN, PY_WS
from credence.operators.retrieval import DEFAULT_DIM

# ---------------------------------------------------------------------------------------
# Adapter views (same derivation as credence.sources.testdata)
# ---------------------------------------------------------------------------------------
PRODUCTS = """
products AS (
  SELECT p_partkey AS pos,
         'P' || CAST(p_partkey AS VARCHAR) AS product_id,
         p_name AS product_name,
         replace(p_brand, 'Brand#', '') AS brand_id,
         p_brand AS brand_name,
         CAST(1 + p_partkey % 5 AS VARCHAR) AS rating,
         CAST(p_partkey % 100 AS VARCHAR) AS reviews,
         CASE p_partkey % 5 WHEN 0 THEN NULL
              WHEN 1 THEN '1.7 oz/ ' || CAST(p_size AS VARCHAR) || ' mL'
              WHEN 2 THEN CAST(p_size AS VARCHAR) || ' ml'
              WHEN 3 THEN CAST(p_size * 10 AS VARCHAR) || ' g'
              ELSE CAST(p_size AS VARCHAR) || ' oz' END AS size,
         CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) AS price_usd,
         CASE WHEN p_partkey % 3 = 0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) + 10 AS VARCHAR) END AS value_price_usd,
         CASE WHEN p_partkey % 4 = 0 THEN CAST(CAST(floor(p_retailprice) AS BIGINT) - 5 AS VARCHAR) END AS sale_price_usd,
         CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE '0' END AS online_only,
         CASE p_partkey % 6 WHEN 0 THEN NULL
              WHEN 1 THEN '[Good for: Dryness, Vegan]'
              WHEN 2 THEN '[best for dry skin]'
              WHEN 3 THEN '[best for oily skin]'
              WHEN 4 THEN '[Treatment for women]'
              ELSE '[unisex, Clean]' END AS highlights
  FROM part
)"""

REVIEWS = """
reviews AS (
  SELECT doc_id AS pos,
         CAST(doc_id AS VARCHAR) AS review_id,
         CASE WHEN doc_id % 11 = 0 THEN 'P-none' ELSE 'P' || CAST(doc_id AS VARCHAR) END AS product_id,
         'A' || CAST(doc_id % 50 AS VARCHAR) AS author_id,
         CASE WHEN doc_id % 13 <> 0 THEN CAST(1 + doc_id % 5 AS VARCHAR) END AS rating,
         CASE doc_id % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '0' WHEN 2 THEN '1' END AS is_recommended,
         CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '0.1' WHEN 2 THEN '0.25' WHEN 3 THEN '0.5' ELSE '0.9' END AS helpfulness,
         CAST(doc_id % 31 AS VARCHAR) AS total_feedback_count,
         CAST(CAST(floor((doc_id % 31) * (doc_id % 3) / 2.0) AS BIGINT) AS VARCHAR) AS total_neg_feedback_count,
         CAST(doc_id % 31 - CAST(floor((doc_id % 31) * (doc_id % 3) / 2.0) AS BIGINT) AS VARCHAR) AS total_pos_feedback_count,
         CASE WHEN doc_id % 3 <> 0 THEN 'Title ' || CAST(doc_id % 9 AS VARCHAR) END AS review_title,
         text || CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' my oily skin' WHEN 2 THEN ' so dry'
                     WHEN 3 THEN ' the 25 ml jar' WHEN 4 THEN ' a 200 ml tube and 1.7 fl oz'
                     WHEN 5 THEN ' bought in store' WHEN 6 THEN ' great for men' ELSE ' 5 great' END AS review_text
  FROM documents
)"""

SUMMARIES = """
summaries AS (
  SELECT product_id,
         arg_max(coalesce(product_name, 'nan') || ' by ' || coalesce(brand_name, 'nan') || '. Highlights: '
                 || coalesce(highlights, 'nan') || '.', pos) AS product_summary
  FROM products WHERE product_id IS NOT NULL GROUP BY product_id
)"""

RECORDS = """
records AS (
  SELECT r.pos,
         CASE WHEN r.review_id <> '' THEN r.review_id END AS review_id,
         r.product_id,
         concat_ws(' | ',
           CASE WHEN r.review_title IS NOT NULL THEN 'Review title: ' || r.review_title END,
           'Review text: ' || coalesce(r.review_text, 'nan'),
           CASE WHEN r.rating IS NOT NULL THEN 'Rating: ' || r.rating END,
           CASE WHEN r.is_recommended IS NOT NULL THEN 'Recommended: ' || r.is_recommended END,
           CASE WHEN s.product_summary IS NOT NULL THEN 'Product summary: ' || s.product_summary END) AS context,
         r.author_id AS m_author_id, r.rating AS m_rating, r.is_recommended AS m_is_recommended,
         r.helpfulness AS m_helpfulness, r.total_feedback_count AS m_tfc,
         r.total_neg_feedback_count AS m_neg, r.total_pos_feedback_count AS m_pos
  FROM reviews r LEFT JOIN summaries s ON r.product_id = s.product_id
)"""

FILLED = """
filled AS (
  SELECT pos, coalesce(product_id, '') AS product_id, coalesce(product_name, '') AS product_name,
         coalesce(brand_id, '') AS brand_id, coalesce(brand_name, '') AS brand_name,
         coalesce(rating, '') AS rating, coalesce(reviews, '') AS reviews, coalesce(size, '') AS size,
         coalesce(price_usd, '') AS price_usd, coalesce(value_price_usd, '') AS value_price_usd,
         coalesce(sale_price_usd, '') AS sale_price_usd, coalesce(online_only, '') AS online_only,
         coalesce(highlights, '') AS highlights
  FROM products
)"""

ENTRIES = """
entries AS (
  SELECT pos,
         CASE WHEN product_id <> '' THEN product_id ELSE 'prod_' || CAST(pos AS VARCHAR) END AS id,
         concat_ws('. ', 'Product Name: ' || product_name, 'Product ID: ' || product_id, 'Brand: ' || brand_name,
                   'Brand ID: ' || brand_id, 'Rating: ' || rating, 'Number of Reviews: ' || reviews,
                   'Size: ' || size, 'Price: $' || price_usd, 'Value Price: $' || value_price_usd,
                   'Sale Price: $' || sale_price_usd, 'Online Only: ' || online_only,
                   'Highlights: ' || highlights) AS document,
         product_name AS m_product_name, brand_id AS m_brand_id, brand_name AS m_brand_name,
         rating AS m_rating, reviews AS m_reviews, size AS m_size, price_usd AS m_price_usd,
         CASE WHEN value_price_usd <> '' THEN value_price_usd ELSE price_usd END AS m_value_price_usd,
         CASE WHEN sale_price_usd <> '' THEN sale_price_usd ELSE price_usd END AS m_sale_price_usd,
         online_only AS m_online_only, highlights AS m_highlights
  FROM filled
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


# ---------------------------------------------------------------------------------------
# Scalar fragments
# ---------------------------------------------------------------------------------------
def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def safe_float(x: str) -> str:
    s = strip(x)
    return (f"(CASE WHEN regexp_matches({s}, '^[+-]?(?i:nan)$') THEN CAST('nan' AS DOUBLE) "
            f"WHEN regexp_matches({s}, '^\\+?(?i:inf|infinity)$') THEN CAST('inf' AS DOUBLE) "
            f"WHEN regexp_matches({s}, '^-(?i:inf|infinity)$') THEN CAST('-inf' AS DOUBLE) "
            f"WHEN regexp_matches({s}, '{FLOAT_PATTERN}') THEN TRY_CAST(replace({s}, '_', '') AS DOUBLE) END)")


def safe_int(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN regexp_matches({s}, '{INT_PATTERN}') THEN TRY_CAST(replace({s}, '_', '') AS BIGINT) END)"


def token_buckets(x: str, dim: int = DEFAULT_DIM) -> str:
    """Hashed bag of words, step 1: FNV-1a (32 bit) bucket of every [a-z0-9]+ token of lower(x)."""
    from credence.operators.retrieval import FNV_OFFSET, FNV_PRIME, TOKEN_PATTERN

    toks = f"list_filter(string_split_regex(lower(coalesce({x}, '')), '{TOKEN_PATTERN}'), lambda t: t <> '')"
    fnv = (f"list_reduce(list_prepend(CAST({FNV_OFFSET} AS BIGINT), list_transform(string_split(t, ''), "
           f"lambda ch: CAST(ord(ch) AS BIGINT))), lambda h, ch: (xor(h, ch) * {FNV_PRIME}) % 4294967296)")
    return f"list_transform({toks}, lambda t: {fnv} % {dim})"


def bucket_counts(b: str, dim: int = DEFAULT_DIM) -> str:
    """Step 2: tokens per bucket (then normalised())."""
    return f"list_transform(range({dim}), lambda i: len(list_filter({b}, lambda x: x = i)))"


def normalised(counts: str) -> str:
    nrm = f"sqrt(list_sum(list_transform({counts}, lambda v: CAST(v AS DOUBLE) * v)))"
    return f"list_transform({counts}, lambda w: CAST(CASE WHEN {nrm} > 0 THEN w / {nrm} ELSE 0.0 END AS FLOAT))"


def ml_list(text_lc: str) -> str:
    p = rules.CAPACITY_PATTERN
    amounts = f"regexp_extract_all({text_lc}, '{p}', 1)"
    units = f"regexp_extract_all({text_lc}, '{p}', 3)"
    factor = "CASE z[2] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.UNIT_TO_ML.items()) + " ELSE 1.0 END"
    return f"list_transform(list_zip({amounts}, {units}), lambda z: TRY_CAST(z[1] AS DOUBLE) * ({factor}))"


def contains(h: str, w: str) -> str:
    return f"coalesce(contains({h}, '{w}'), false)"


def fact_pair(t: str, rc: str, hl: str, size: str, online: str) -> str:
    """Does one retrieved product contradict the review? (t = lower-cased context)."""
    skin = (f"(({contains(t, 'oily')} AND {contains(hl, 'dry')}) OR "
            f"({contains(t, 'dry')} AND {contains(hl, 'oily')}))")
    gendered = " OR ".join(contains(hl, w) for w in ["men", "women", "unisex", "gender-neutral", "genderless"])
    gender = (f"({contains(t, 'men')} AND ({gendered}) AND NOT {contains(hl, 'unisex')} "
              f"AND NOT {contains(hl, 'genderless')})")
    pc = ml_list(f"lower({size})")
    cap = (f"(len({rc}) > 0 AND len({pc}) > 0 AND coalesce(list_bool_and(list_transform({rc}, lambda c: "
           f"list_bool_and(list_transform({pc}, lambda p: abs(c - p) > p * {rules.CAPACITY_REL_TOL} "
           f"AND abs(c - p) > {rules.CAPACITY_ABS_TOL})))), false))")
    online_chk = (f"({online} IS NOT NULL AND {online} <> '' AND "
                  f"coalesce(regexp_matches({t}, '{rules.STORE_PATTERN}'), false))")
    return f"({skin} OR {gender} OR {cap} OR {online_chk})"


def fake_score(ctx: str, rating: str, is_rec: str, helpful: str, tfc: str, neg: str, missing: str = "nan") -> str:
    """Heuristic score over raw meta strings (NULL rating carried as NaN when missing='nan')."""
    text = strip(f"coalesce({ctx}, '')")
    n = f"length({text})"
    r = safe_float(rating)
    if missing == "nan":
        r = f"(CASE WHEN {rating} IS NULL THEN CAST('nan' AS DOUBLE) ELSE {r} END)"
        has_r = f"({rating} IS NULL OR {safe_float(rating)} IS NOT NULL)"
    else:
        has_r = f"({r} IS NOT NULL)"
    valid = f"({r} IS NOT NULL AND NOT isnan({r}))"
    rec = safe_int(is_rec)
    hf = safe_float(helpful)
    t = safe_int(tfc)
    ng = safe_int(neg)
    pct = f"(CASE WHEN {t} > 0 THEN coalesce(CAST({ng} AS DOUBLE) / {t}, 0.0) ELSE 0.0 END)"
    extreme = f"({valid} AND {r} IN (1.0, 5.0))"
    low = f"({hf} IS NOT NULL AND NOT isnan({hf}) AND {t} IS NOT NULL AND {t} >= 3 AND {hf} < 0.3)"
    tier = (f"(CASE WHEN {t} >= 25 THEN {pct} > 0.6 WHEN {t} >= 10 THEN {pct} > 0.7 "
            f"WHEN {t} >= 5 THEN {pct} > 0.8 ELSE false END)")

    def pts(c: str, p: int = 1) -> str:
        return f"(CASE WHEN coalesce({c}, false) THEN {p} ELSE 0 END)"

    scored = " + ".join([
        pts(f"{extreme} AND {n} < 20", 2),
        pts(low),
        pts(f"{low} AND {tier}"),
        pts(f"{t} = 0 AND {extreme} AND {n} < 40"),
        pts(f"{valid} AND {r} <= 2 AND ({rec} = 1 OR {pct} > 0.8)"),
        pts(f"{valid} AND {r} >= 4 AND ({rec} = 0 OR {pct} > 0.8)"),
    ])
    no_r = f"(CASE WHEN {n} < 20 THEN CAST('inf' AS DOUBLE) WHEN {n} < 50 THEN 2.0 ELSE 1.0 END)"
    return (f"(CASE WHEN {has_r} AND {n} > 0 THEN CAST({scored} AS DOUBLE) "
            f"WHEN NOT {has_r} AND {n} > 0 THEN {no_r} ELSE CAST('inf' AS DOUBLE) END)")


def has_rating(rating: str, missing: str = "nan") -> str:
    if missing == "nan":
        return f"({rating} IS NULL OR {safe_float(rating)} IS NOT NULL)"
    return f"({safe_float(rating)} IS NOT NULL)"


# ---------------------------------------------------------------------------------------
# Retrieval chain
# ---------------------------------------------------------------------------------------
def retrieval_ctes(k: int = 3, dim: int = DEFAULT_DIM) -> list[str]:
    return [
        PRODUCTS, REVIEWS, SUMMARIES, RECORDS, FILLED, ENTRIES,
        f"""
qbuckets AS (SELECT pos, {token_buckets('context', dim)} AS b FROM records)""",
        f"""
qcounts AS (SELECT pos, {bucket_counts('b', dim)} AS c FROM qbuckets)""",
        f"""
qvec AS (SELECT pos, {normalised('c')} AS vec FROM qcounts)""",
        f"""
pbuckets AS (SELECT id, {token_buckets('document', dim)} AS b FROM entries)""",
        f"""
pcounts AS (SELECT id, {bucket_counts('b', dim)} AS c FROM pbuckets)""",
        f"""
pvec AS (SELECT id, {normalised('c')} AS vec FROM pcounts)""",
        f"""
pairs AS (
  SELECT q.pos, p.id,
         round(pow(array_distance(CAST(q.vec AS DOUBLE[{dim}]), CAST(p.vec AS DOUBLE[{dim}])), 2), 6) AS dist
  FROM qvec q, pvec p
)""",
        f"""
topk AS (
  SELECT pos, id, dist, row_number() OVER (PARTITION BY pos ORDER BY dist, id) AS rank
  FROM pairs QUALIFY rank <= {k}
)""",
    ]


def label_ctes(k: int = 3, missing: str = "nan") -> list[str]:
    fact = fact_pair("t", "rc", "e.m_highlights", "e.m_size", "e.m_online_only")
    return retrieval_ctes(k) + [
        f"""
facts AS (
  SELECT r.pos, bool_or({fact}) AS bad
  FROM (SELECT pos, lower(context) AS t, {ml_list('lower(context)')} AS rc FROM records) r
  JOIN topk k ON k.pos = r.pos JOIN entries e ON e.id = k.id
  GROUP BY r.pos
)""",
        f"""
labelled AS (
  SELECT r.pos, r.review_id, r.context,
         CASE WHEN coalesce(f.bad, false) THEN 'fake' ELSE 'real' END AS fact_label,
         {fake_score('r.context', 'r.m_rating', 'r.m_is_recommended', 'r.m_helpfulness', 'r.m_tfc', 'r.m_neg', missing)}
           AS fake_score,
         {has_rating('r.m_rating', missing)} AS has_rating
  FROM records r LEFT JOIN facts f ON f.pos = r.pos
)""",
        f"""
final AS (
  SELECT *, CASE WHEN fact_label = 'fake' THEN 'fake'
                 WHEN fake_score > {float(rules.FAKE_THRESHOLD)} THEN 'fake'
                 WHEN length(coalesce(context, '')) >= {rules.MIN_REAL_CONTEXT_CHARS} AND has_rating THEN 'real'
                 ELSE 'fake' END AS pseudo_label
  FROM labelled
)""",
    ]


# ---------------------------------------------------------------------------------------
# Registered oracles
# ---------------------------------------------------------------------------------------
def sql_label_reviews() -> str:
    return with_(*label_ctes()) + "\nSELECT review_id, pseudo_label, fact_label, fake_score FROM final"


def sql_topk_similar_products() -> str:
    return with_(*retrieval_ctes()) + """
SELECT r.review_id, CAST(k.rank AS INTEGER) AS rank, k.id AS product_id, k.dist FROM topk k JOIN records r ON r.pos = k.pos"""


def sql_build_context() -> str:
    return with_(PRODUCTS, REVIEWS, SUMMARIES, RECORDS) + "\nSELECT review_id, product_id, context FROM records"


def sql_product_document() -> str:
    return with_(PRODUCTS, FILLED, ENTRIES) + """
SELECT id, document, m_product_name, m_size, m_price_usd, m_value_price_usd, m_sale_price_usd, m_online_only,
       m_highlights FROM entries"""


def sql_label_counts() -> str:
    return with_(*label_ctes()) + """
SELECT CAST(count_if(pseudo_label <> 'fake') AS BIGINT) AS real_count,
       CAST(count_if(pseudo_label = 'fake') AS BIGINT) AS fake_count, count(*) AS total_count FROM final"""


ORACLES = {
    "label_reviews": sql_label_reviews,
    "topk_similar_products": sql_topk_similar_products,
    "build_context": sql_build_context,
    "product_document": sql_product_document,
    "label_counts": sql_label_counts,
}


# ---------------------------------------------------------------------------------------
# Label / sampling / metric bases
# ---------------------------------------------------------------------------------------
SEED = 7

QLABELS = """
qlabels AS (
  SELECT l.doc_id AS pos, CAST(l.doc_id AS VARCHAR) AS review_id, d.text AS context,
         CASE WHEN l.quality = 1 THEN 'real' ELSE 'fake' END AS pseudo_label,
         CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label,
         CASE WHEN l.toxic = 0 THEN 1 ELSE 0 END AS prediction
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id
)"""

NOISY = """
noisy AS (
  SELECT pos, review_id, context, label, prediction,
         CASE WHEN pos % 9 = 0 THEN NULL WHEN pos % 9 = 1 THEN 'unknown' ELSE pseudo_label END AS pseudo_label,
         CASE pos % 5 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN '1' ELSE 'real' END AS tag
  FROM qlabels
)"""


def hkey(col: str, seed: int = SEED) -> str:
    return f"md5('{seed}:' || CAST({col} AS VARCHAR))"


def unit_draw(col: str, salt: str, seed: int = SEED) -> str:
    return f"(CAST(CAST(('0x' || substr(md5('{seed}:{salt}' || CAST({col} AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def sql_shuffle_rows() -> str:
    return with_(QLABELS) + f"\nSELECT review_id, row_number() OVER (ORDER BY {hkey('pos')}) AS shuffle_rank FROM qlabels"


def sql_sample_exact_n() -> str:
    return with_(QLABELS) + f"""
SELECT review_id, pseudo_label, sample_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY pseudo_label ORDER BY {hkey('pos')}) AS sample_rank FROM qlabels)
WHERE sample_rank <= 50"""


def _balanced(ratio: float, split: bool, test_ratio: float = 0.2) -> str:
    sel = "review_id, pseudo_label, " + ("split" if split else "sample_rank")
    return with_(QLABELS) + f""",
cnt AS (SELECT count_if(pseudo_label = 'real') AS r, count_if(pseudo_label = 'fake') AS f FROM qlabels),
params AS (
  SELECT r, f, r < f * {ratio} AS short,
         CASE WHEN r < f * {ratio} THEN least(r, f) ELSE greatest(CAST(floor(f * {ratio}) AS BIGINT), 1) END AS m_real,
         CASE WHEN r < f * {ratio} THEN least(r, f) ELSE f END AS m_fake
  FROM cnt),
ranked AS (
  SELECT q.*, p.short, p.m_real, p.m_fake,
         row_number() OVER (PARTITION BY q.pseudo_label ORDER BY {hkey('q.pos')}) AS hrank,
         row_number() OVER (PARTITION BY q.pseudo_label ORDER BY q.pos) AS prank
  FROM qlabels q, params p WHERE q.pseudo_label IN ('real', 'fake')),
picked AS (
  SELECT *, CASE WHEN pseudo_label = 'real' OR short THEN hrank ELSE prank END AS sample_rank,
         CASE WHEN pseudo_label = 'real' THEN m_real ELSE m_fake END AS m
  FROM ranked),
kept AS (SELECT * FROM picked WHERE sample_rank <= m)
SELECT {sel} FROM (
  SELECT *, CASE WHEN sample_rank > m - greatest(CAST(floor(m * {test_ratio}) AS BIGINT), 1)
                 THEN 'test' ELSE 'train' END AS split FROM kept)"""


def sql_balanced_dataset() -> str:
    return _balanced(1.0, False)


def sql_balanced_dataset_short() -> str:
    return _balanced(10.0, False)


def sql_stratified_split() -> str:
    return _balanced(1.0, True, 0.2)


def sql_random_split() -> str:
    return with_(QLABELS) + f"""
SELECT review_id, CASE WHEN {unit_draw('pos', 'split:')} < 0.1 THEN 'test' ELSE 'train' END AS split FROM qlabels"""


def sql_pick_examples() -> str:
    return with_(QLABELS) + f"""
SELECT CAST(pos AS VARCHAR) AS review_id, pseudo_label, context FROM (
  SELECT *, row_number() OVER (PARTITION BY pseudo_label ORDER BY {hkey('pos')}) AS rk FROM qlabels)
WHERE (pseudo_label = 'real' AND rk <= 2) OR (pseudo_label = 'fake' AND rk <= 2)"""


def sql_filter_by_label() -> str:
    return with_(QLABELS) + "\nSELECT review_id, pseudo_label FROM qlabels WHERE pseudo_label = 'real'"


PER_CLASS = """
conf AS (SELECT label, prediction, count(*) AS n FROM qlabels GROUP BY label, prediction),
classes AS (SELECT label AS cls FROM conf UNION SELECT prediction FROM conf),
pc AS (
  SELECT c.cls,
         coalesce((SELECT sum(n) FROM conf WHERE label = c.cls), 0) AS support,
         coalesce((SELECT sum(n) FROM conf WHERE label = c.cls AND prediction = c.cls), 0) AS tp,
         coalesce((SELECT sum(n) FROM conf WHERE prediction = c.cls), 0) AS predicted
  FROM classes c),
pcm AS (
  SELECT cls, support, tp, predicted,
         CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
         CASE WHEN 2 * tp + (predicted - tp) + (support - tp) > 0
              THEN 2 * tp / (2 * tp + (predicted - tp) + (support - tp)) ELSE 0.0 END AS f1
  FROM pc)"""


def sql_metrics_summary() -> str:
    return with_(QLABELS, PER_CLASS) + """
SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
       CAST(sum(support) AS BIGINT) AS n FROM pcm"""


REPORT = """
SELECT CAST(cls AS VARCHAR) AS class, round(precision, 4) AS precision, round(recall, 4) AS recall,
       round(f1, 4) AS f1, CAST(support AS BIGINT) AS support FROM pcm
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM pcm
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
                 CAST(sum(support) AS BIGINT) FROM pcm
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
                 round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
                 CAST(sum(support) AS BIGINT) FROM pcm"""


def sql_classification_report() -> str:
    return with_(QLABELS, PER_CLASS) + REPORT


def sql_running_accuracy() -> str:
    return with_(QLABELS) + """
SELECT review_id, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) OVER w / count(*) OVER w AS running_accuracy
FROM qlabels WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def sql_running_label_counts() -> str:
    return with_(QLABELS) + """
SELECT review_id, CAST(sum(CASE WHEN pseudo_label = 'fake' THEN 0 ELSE 1 END) OVER w AS BIGINT) AS real_count,
       CAST(sum(CASE WHEN pseudo_label = 'fake' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fake_count,
       count(*) OVER w AS total_count
FROM qlabels WINDOW w AS (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def sql_distinct_labels() -> str:
    return with_(QLABELS, NOISY) + """
SELECT count(DISTINCT CASE WHEN pseudo_label = 'fake' THEN 0 ELSE 1 END) AS num_labels
FROM noisy WHERE pseudo_label IN ('fake', 'real')"""


def sql_argmax_array() -> str:
    return "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS argmax FROM embeddings"


def sql_verdict_text() -> str:
    return with_(QLABELS) + f"""
SELECT review_id, CASE WHEN prediction = 1 THEN '{rules.VERDICT_USEFUL}' ELSE '{rules.VERDICT_USELESS}' END AS verdict
FROM qlabels"""


def sql_flag_duplicates() -> str:
    return with_(REVIEWS) + """
SELECT review_id, pos <> min(pos) OVER (PARTITION BY coalesce(review_text, '')) AS is_duplicate,
       CASE WHEN pos <> min(pos) OVER (PARTITION BY coalesce(review_text, '')) THEN 'fake' ELSE 'real' END
         AS pseudo_label
FROM reviews"""


def sql_split_real_fake() -> str:
    return with_(QLABELS, NOISY) + """
SELECT review_id, CASE WHEN v IN ('real', '0') THEN 'real' WHEN v IN ('fake', '1') THEN 'fake' END AS side FROM (
  SELECT review_id,
         CASE WHEN tag IS NOT NULL AND tag <> '' THEN tag
              WHEN pseudo_label IS NOT NULL AND pseudo_label <> '' THEN pseudo_label
              ELSE CAST(label AS VARCHAR) END AS v
  FROM noisy)"""


def sql_encode_labels_strict() -> str:
    return with_(QLABELS, NOISY) + """
SELECT review_id, CAST(CASE WHEN pseudo_label = 'fake' THEN 0 ELSE 1 END AS INTEGER) AS label
FROM noisy WHERE pseudo_label IN ('fake', 'real')"""


def sql_encode_labels_lenient() -> str:
    return with_(QLABELS, NOISY) + """
SELECT review_id, CAST(CASE WHEN pseudo_label = 'fake' THEN 0 ELSE 1 END AS INTEGER) AS label FROM noisy"""


EXPLAIN = f"""
ex AS (
  SELECT review_id, context, pseudo_label AS label,
         CASE WHEN pseudo_label = 'fake' THEN '{rules.REASON_FAKE}' ELSE '{rules.REASON_REAL}' END AS reason
  FROM noisy WHERE pseudo_label IN ('fake', 'real')),
ex2 AS (
  SELECT *, 'The review context: ' || coalesce(context, '') || chr(10) || 'classify:' AS input_text,
         'label: ' || label || '. reason: ' || reason AS target_text
  FROM ex)"""


def sql_explain_examples() -> str:
    return with_(QLABELS, NOISY, EXPLAIN) + "\nSELECT review_id, label, reason, input_text, target_text FROM ex2"


def _parse_label(x: str) -> str:
    got = f"regexp_extract(lower(coalesce({x}, '')), '{rules.LABEL_PATTERN}', 1)"
    return f"CASE WHEN {got} <> '' THEN {got} ELSE '{rules.LABEL_FALLBACK}' END"


def sql_parse_label() -> str:
    return with_(QLABELS, NOISY, EXPLAIN) + f"""
SELECT review_id, {_parse_label('target_text')} AS from_target, {_parse_label('context')} AS from_context FROM ex2"""


def _parse_expl(x: str, prefix: str) -> str:
    lab = f"regexp_extract(coalesce({x}, ''), '(?i){rules.LABEL_PATTERN}', 1)"
    # Python's '.' stops only at a newline: RE2 with (?s) off behaves the same.
    reason = f"regexp_extract(coalesce({x}, ''), '(?i)reason:{PY_WS}*([^\\n]*)', 1)"
    return (f"CASE WHEN {lab} <> '' THEN upper(substr({lab}, 1, 1)) || lower(substr({lab}, 2)) "
            f"ELSE '{rules.LABEL_FALLBACK}' END AS {prefix}_label, "
            f"CASE WHEN {reason} <> '' THEN {reason} ELSE '{rules.REASON_FALLBACK}' END AS {prefix}_reason")


def sql_parse_explanation() -> str:
    return with_(QLABELS, NOISY, EXPLAIN) + f"""
SELECT review_id, {_parse_expl('target_text', 't')}, {_parse_expl('context', 'c')} FROM ex2"""


# ---------------------------------------------------------------------------------------
# Products and contexts
# ---------------------------------------------------------------------------------------
def sql_product_summary() -> str:
    return with_(PRODUCTS, SUMMARIES) + "\nSELECT product_id, product_summary FROM summaries"


def sql_product_metadata() -> str:
    return with_(PRODUCTS, FILLED, ENTRIES) + """
SELECT id, id AS product_id, m_product_name AS product_name, m_brand_id AS brand_id, m_brand_name AS brand_name,
       m_rating AS rating, m_reviews AS reviews, m_size AS size, m_price_usd AS price_usd,
       m_value_price_usd AS value_price_usd, m_sale_price_usd AS sale_price_usd, m_online_only AS online_only,
       m_highlights AS highlights FROM entries"""


def sql_product_id_default() -> str:
    return with_(PRODUCTS) + """
SELECT pos, CASE WHEN pos % 7 <> 0 AND product_id IS NOT NULL AND product_id <> '' THEN product_id
                 ELSE 'prod_' || CAST(pos AS VARCHAR) END AS id FROM products"""


def sql_review_record() -> str:
    return with_(PRODUCTS, REVIEWS, SUMMARIES, RECORDS) + """
SELECT review_id, product_id, CAST(NULL AS VARCHAR) AS pseudo_label, m_author_id AS author_id, m_rating AS rating,
       m_is_recommended AS is_recommended, m_helpfulness AS helpfulness, m_tfc AS total_feedback_count,
       m_neg AS total_neg_feedback_count, m_pos AS total_pos_feedback_count FROM records"""


def sql_join_product_summary() -> str:
    return with_(PRODUCTS, REVIEWS, SUMMARIES) + """
SELECT r.review_id, s.product_summary FROM reviews r LEFT JOIN summaries s ON s.product_id = r.product_id"""


def sql_reviews_with_known_product() -> str:
    return with_(PRODUCTS, REVIEWS) + """
SELECT review_id FROM reviews r WHERE EXISTS (SELECT 1 FROM products p WHERE p.product_id = r.product_id)"""


def sql_parse_context() -> str:
    from credence.functions import context as c
    rec = f"regexp_extract(context, '{c.PARSE_RECOMMENDED}', 1)"
    return with_(PRODUCTS, REVIEWS, SUMMARIES, RECORDS) + f"""
SELECT review_id, regexp_extract(context, '{c.PARSE_TITLE}', 1) AS review_title,
       regexp_extract(context, '{c.PARSE_TEXT}', 1) AS review_text,
       regexp_extract(context, '{c.PARSE_NAME}', 1) AS product_name,
       CASE WHEN {rec} <> '' THEN {rec} ELSE '0.0' END AS recommended
FROM records"""


def sql_sort_products() -> str:
    return with_(PRODUCTS) + """
SELECT *, row_number() OVER (ORDER BY product_name ASC NULLS LAST, product_id) AS name_rank FROM products"""


def sql_build_request_context() -> str:
    return with_(PRODUCTS, REVIEWS) + """,
firsts0 AS (SELECT product_name, arg_min({'r': rating, 'b': brand_name, 'h': highlights}, pos) AS f
            FROM products WHERE product_name IS NOT NULL GROUP BY product_name),
firsts AS (SELECT product_name, f.r AS p_rating, f.b AS p_brand, f.h AS p_highlights FROM firsts0),
req AS (SELECT r.review_id, r.review_title, r.review_text, p.product_name AS req_product_name,
               r.is_recommended IN ('1', '1.0') AS recommended
        FROM reviews r LEFT JOIN products p ON p.product_id = r.product_id)
SELECT q.review_id,
       'Review title: ' || coalesce(q.review_title, '') || ' | Review text: ' || coalesce(q.review_text, '')
       || ' | Rating: ' || coalesce(f.p_rating, 'nan') || ' | Recommended: '
       || CASE WHEN coalesce(q.recommended, false) THEN '1.0' ELSE '0.0' END
       || ' | Product summary: ' || coalesce(q.req_product_name, 'nan') || ' by ' || coalesce(f.p_brand, 'nan')
       || '. Highlights: ' || coalesce(f.p_highlights, 'nan') || '.' AS context
FROM req q JOIN firsts f ON f.product_name = q.req_product_name"""


def sql_retrieval_rank() -> str:
    return with_(*retrieval_ctes()) + """
SELECT r.review_id, 'Rank ' || CAST(k.rank AS VARCHAR) AS rank_label, k.id AS product_id, e.document,
       substr(e.document, 1, 400) AS preview
FROM topk k JOIN records r ON r.pos = k.pos JOIN entries e ON e.id = k.id"""


# ---------------------------------------------------------------------------------------
# Scalar rules
# ---------------------------------------------------------------------------------------
CTX_BASE = (PRODUCTS, REVIEWS, SUMMARIES, RECORDS)


def sql_safe_casts() -> str:
    loose = (f"coalesce({safe_int('m_is_recommended')}, CASE WHEN NOT isnan({safe_float('m_is_recommended')}) "
             f"AND abs({safe_float('m_is_recommended')}) < 9.2e18 THEN CAST(trunc({safe_float('m_is_recommended')}) "
             f"AS BIGINT) END)")
    return with_(*CTX_BASE) + f"""
SELECT review_id, {safe_float('m_rating')} AS rating_f, {safe_int('m_is_recommended')} AS recommended_i,
       {loose} AS recommended_loose, {safe_float('m_helpfulness')} AS helpfulness_f,
       {safe_int('m_tfc')} AS feedback_i FROM records"""


def sql_text_norm() -> str:
    words = f"CASE WHEN {strip('context')} = '' THEN 0 ELSE len(string_split_regex({strip('context')}, '{PY_WS}+')) END"
    flat = strip("replace(context, chr(10), ' ')")
    return with_(*CTX_BASE) + f"""
SELECT review_id, CAST(length({strip('context')}) AS INTEGER) AS stripped_len, lower(context) AS lower_ctx,
       CAST(length({flat}) AS INTEGER) AS flat_len, CAST({words} AS INTEGER) AS n_words FROM records"""


def sql_extract_capacity() -> str:
    p = rules.CAPACITY_PATTERN
    factor = "CASE unit " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rules.UNIT_TO_ML.items()) + " ELSE 1.0 END"
    return with_(*CTX_BASE) + f""",
caps AS (SELECT review_id, regexp_extract_all(lower(context), '{p}', 1) AS a,
                regexp_extract_all(lower(context), '{p}', 3) AS u FROM records),
flat AS (SELECT review_id, i - 1 AS i, TRY_CAST(a[i] AS DOUBLE) AS amount, u[i] AS unit
         FROM caps, range(1, len(a) + 1) t(i))
SELECT review_id, CAST(i AS INTEGER) AS i, amount, unit, amount * ({factor}) AS ml FROM flat"""


def sql_extract_price() -> str:
    t = "lower(context)"
    return with_(*CTX_BASE) + f"""
SELECT review_id, CASE WHEN regexp_matches({t}, '{rules.PRICE_PATTERN}')
                       THEN {safe_float(f"regexp_extract({t}, '{rules.PRICE_PATTERN}', 1)")} END AS price
FROM records"""


OWN = """
own AS (
  SELECT r.review_id, lower(r.context) AS t, r.context, e.m_highlights, e.m_size, e.m_online_only, e.m_price_usd,
         e.m_value_price_usd, e.m_sale_price_usd, e.id AS own_id,
         r.m_rating, r.m_is_recommended, r.m_helpfulness, r.m_tfc, r.m_neg
  FROM records r LEFT JOIN entries e ON e.id = r.product_id)"""


def _own_sql(select: str) -> str:
    return with_(*CTX_BASE, FILLED, ENTRIES, OWN) + "\n" + select


def sql_capacity_mismatch() -> str:
    pc = ml_list("lower(m_size)")
    rc = ml_list("t")
    cap = (f"(len({rc}) > 0 AND len({pc}) > 0 AND coalesce(list_bool_and(list_transform({rc}, lambda c: "
           f"list_bool_and(list_transform({pc}, lambda p: abs(c - p) > p * {rules.CAPACITY_REL_TOL} "
           f"AND abs(c - p) > {rules.CAPACITY_ABS_TOL})))), false))")
    return _own_sql(f"SELECT review_id, coalesce({cap}, false) AS flag FROM own")


def sql_skin_type_mismatch() -> str:
    hl = "coalesce(m_highlights, '')"
    return _own_sql(f"""SELECT review_id, (({contains('t', 'oily')} AND {contains(hl, 'dry')}) OR
       ({contains('t', 'dry')} AND {contains(hl, 'oily')})) AS flag FROM own""")


def sql_gender_mismatch() -> str:
    hl = "coalesce(m_highlights, '')"
    gendered = " OR ".join(contains(hl, w) for w in ["men", "women", "unisex", "gender-neutral", "genderless"])
    return _own_sql(f"""SELECT review_id, ({contains('t', 'men')} AND ({gendered}) AND NOT {contains(hl, 'unisex')}
       AND NOT {contains(hl, 'genderless')}) AS flag FROM own""")


def sql_online_only_mismatch() -> str:
    return _own_sql(f"""SELECT review_id, (m_online_only IS NOT NULL AND m_online_only <> '' AND
       coalesce(regexp_matches(t, '{rules.STORE_PATTERN}'), false)) AS flag FROM own""")


def sql_price_mismatch() -> str:
    price = (f"(CASE WHEN regexp_matches(t, '{rules.PRICE_PATTERN}') "
             f"THEN {safe_float(f'regexp_extract(t, {chr(39)}{rules.PRICE_PATTERN}{chr(39)}, 1)')} END)")
    far = " AND ".join(
        f"({safe_float(p)} IS NOT NULL AND {safe_float(p)} <> 0 AND abs({price} - {safe_float(p)}) > "
        f"{safe_float(p)} * {rules.PRICE_REL_TOL})"
        for p in ["m_price_usd", "m_value_price_usd", "m_sale_price_usd"])
    return _own_sql(f"SELECT review_id, coalesce({price} IS NOT NULL AND {price} <> 0 AND {far}, false) AS flag FROM own")


def sql_factual_label() -> str:
    fact = fact_pair("t", ml_list("t"), "coalesce(m_highlights, '')", "coalesce(m_size, '')", "m_online_only")
    return _own_sql(f"""SELECT review_id, CASE WHEN own_id IS NOT NULL AND coalesce({fact}, false) THEN 'fake'
       ELSE 'real' END AS fact_label FROM own""")


def _strict_loose_score(missing: str, loose: bool) -> str:
    if not loose:
        return fake_score("context", "m_rating", "m_is_recommended", "m_helpfulness", "m_tfc", "m_neg", missing)
    # Loose ints: '1.0' counts as 1 for the recommended flag.
    rec = (f"(CASE WHEN {safe_int('m_is_recommended')} IS NOT NULL THEN CAST({safe_int('m_is_recommended')} "
           f"AS VARCHAR) WHEN NOT isnan({safe_float('m_is_recommended')}) AND abs({safe_float('m_is_recommended')})"
           f" < 9.2e18 THEN CAST(CAST(trunc({safe_float('m_is_recommended')}) AS BIGINT) AS VARCHAR) END)")
    return fake_score("context", "m_rating", rec, "m_helpfulness", "m_tfc", "m_neg", missing)


def sql_fake_score() -> str:
    return with_(*CTX_BASE) + f"""
SELECT review_id, {_strict_loose_score('nan', False)} AS score_nan, {_strict_loose_score('null', False)} AS score_null,
       {_strict_loose_score('nan', True)} AS score_loose FROM records"""


def sql_final_label() -> str:
    fact = fact_pair("t", ml_list("t"), "coalesce(m_highlights, '')", "coalesce(m_size, '')", "m_online_only")

    def lab(missing: str) -> str:
        s = fake_score("context", "m_rating", "m_is_recommended", "m_helpfulness", "m_tfc", "m_neg", missing)
        return (f"CASE WHEN fact = 'fake' THEN 'fake' WHEN {s} > {float(rules.FAKE_THRESHOLD)} THEN 'fake' "
                f"WHEN length(coalesce(context, '')) >= {rules.MIN_REAL_CONTEXT_CHARS} AND "
                f"{has_rating('m_rating', missing)} THEN 'real' ELSE 'fake' END")

    return _own_sql(f"""SELECT review_id, {lab('nan')} AS label_nan, {lab('null')} AS label_null FROM (
  SELECT *, CASE WHEN own_id IS NOT NULL AND coalesce({fact}, false) THEN 'fake' ELSE 'real' END AS fact FROM own)""")


def sql_format_valid() -> str:
    cond = " AND ".join(f"contains(coalesce(context, ''), '{m}')" for m in rules.FORMAT_MARKERS)
    return with_(*CTX_BASE) + f"\nSELECT review_id, ({cond}) AS valid FROM records"


def sql_row_count() -> str:
    return with_(*CTX_BASE) + "\nSELECT count(*) AS n FROM records"


def sql_embed_texts() -> str:
    return with_(*CTX_BASE) + f""",
qb AS (SELECT review_id, {token_buckets('context')} AS b FROM records),
qc AS (SELECT review_id, {bucket_counts('b')} AS c FROM qb),
qv AS (SELECT review_id, {normalised('c')} AS vec FROM qc)
SELECT review_id, CAST(i - 1 AS INTEGER) AS i, CAST(vec[i] AS DOUBLE) AS v FROM qv, range(1, {DEFAULT_DIM} + 1) t(i)"""


ORACLES.update({name[len("sql_"):]: fn for name, fn in list(globals().items())
                if name.startswith("sql_") and callable(fn)})


# ---------------------------------------------------------------------------------------
# Augmentation
# ---------------------------------------------------------------------------------------
def seeded_int_sql(key: str, n: str, salt: str, seed: int = SEED) -> str:
    return f"(CAST(('0x' || substr(md5('{seed}:{salt}' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) % ({n}))"


def sql_pair_real_fake() -> str:
    return with_(QLABELS) + f""",
reals AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ri FROM qlabels WHERE pseudo_label = 'real'),
fakes AS (SELECT context AS fake_context, row_number() OVER (ORDER BY pos) - 1 AS fi FROM qlabels
          WHERE pseudo_label = 'fake'),
cnt AS (SELECT (SELECT count(*) FROM reals) AS nr, (SELECT count(*) FROM fakes) AS nf),
steps AS (SELECT s.range AS step FROM range(100000000) s, cnt WHERE s.range < cnt.nr),
drawn AS (SELECT step, {seeded_int_sql('step', 'nr', 'real:')} AS ri, {seeded_int_sql('step', 'nf', 'fake:')} AS fi
          FROM steps, cnt)
SELECT d.step, r.review_id, f.fake_context FROM drawn d JOIN reals r ON r.ri = d.ri JOIN fakes f ON f.fi = d.fi"""


def info_sql(key: str) -> str:
    from credence.operators import augment as a

    rating = f"(CASE {seeded_int_sql(key, '2', 'rating:')} WHEN 0 THEN {a.RATINGS[0]} ELSE {a.RATINGS[1]} END)"
    total = seeded_int_sql(key, str(a.MAX_FEEDBACK + 1), "total:")
    pos = f"(CASE WHEN {total} = 0 THEN 0 ELSE {seeded_int_sql(key, f'{total} + 1', 'pos:')} END)"
    return (f"CAST({rating} AS INTEGER) AS rating, CAST(CASE WHEN {rating} >= 4 THEN 1 ELSE 0 END AS INTEGER) "
            f"AS is_recommended, CAST({total} AS INTEGER) AS total_feedback_count, CAST({pos} AS INTEGER) AS "
            f"total_pos_feedback_count, CAST({total} - {pos} AS INTEGER) AS total_neg_feedback_count, "
            f"CASE WHEN {total} = 0 THEN 0.0 ELSE CAST({pos} AS DOUBLE) / {total} END AS helpfulness, "
            f"CASE WHEN {rating} = 5 THEN '{a.TITLE_HIGH}' ELSE '{a.TITLE_LOW}' END AS review_title")


def sql_random_review_info() -> str:
    return f"SELECT doc_id, {info_sql('doc_id')} FROM documents"


def augment_sql(text: str, key: str, seed: int = SEED) -> str:
    from credence.operators import augment as a

    s = strip(text)
    words = f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, '{PY_WS}+') END)"
    syn = "CASE lower(w) " + " ".join(
        f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in a.SYNONYMS.items()) + " END"

    def draw(i: str, salt: str, n: int) -> str:
        return (f"(CAST(('0x' || substr(md5('{seed}:{salt}' || CAST({key} AS VARCHAR) || ':' || CAST({i} AS VARCHAR)),"
                f" 1, 8)) AS BIGINT) % {n})")

    subst = f"list_transform({words}, lambda w, i: coalesce(({syn})[1 + {draw('i - 1', 'syn:', 3)}], w))"
    keyed = (f"list_transform({subst}, lambda w, i: {{'k': md5('{seed}:order:' || CAST({key} AS VARCHAR) || ':' "
             f"|| CAST(i - 1 AS VARCHAR)), 'w': w}})")
    shuffled = f"list_transform(list_sort({keyed}), lambda x: x.w)"
    u = (f"(CAST(CAST(('0x' || substr(md5('{seed}:shuffle:' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE)"
         f" / 4294967296.0)")
    return f"array_to_string(CASE WHEN {u} > {a.SHUFFLE_ABOVE} THEN {shuffled} ELSE {subst} END, ' ')"


def sql_augment_text() -> str:
    return with_(QLABELS) + f"\nSELECT review_id, {augment_sql('context', 'review_id')} AS augmented FROM qlabels"


def sql_inflate_duplicates() -> str:
    from credence.operators import augment as a

    n = seeded_int_sql("doc_id", str(a.TROLL_MAX_COPIES + 1), "troll:")
    return f"""SELECT d.doc_id AS step, CAST(c.range + 1 AS INTEGER) AS copy
FROM documents d, range(100) c WHERE d.doc_id % {a.TROLL_EVERY} = 0 AND c.range < {n}"""


def _prompt_cte() -> str:
    """prompts(review_id, prompt) of every review with a known product."""
    from credence.operators import augment as a

    parts = a.PROMPT_TEMPLATE.split("%s")
    vals = [strip("replace(coalesce(o.context, ''), chr(10), ' ')"),
            strip("replace(coalesce(e.document, ''), chr(10), ' ')"),
            "e.m_product_name", "e.m_brand_name", "e.m_highlights", "e.m_rating", "e.m_price_usd", "e.m_sale_price_usd"]

    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    expr = lit(parts[0])
    for v, p in zip(vals, parts[1:]):
        expr += f" || coalesce({v}, 'null') || {lit(p)}"
    return f"""
prompts AS (SELECT o.review_id, {expr} AS prompt FROM records o JOIN entries e ON e.id = o.product_id)"""


def sql_build_prompt() -> str:
    return with_(*CTX_BASE, FILLED, ENTRIES, _prompt_cte()) + "\nSELECT review_id, prompt FROM prompts"


def sql_field_fallback() -> str:
    from credence.operators import dataset as ds

    return with_(*CTX_BASE, FILLED, ENTRIES) + f""",
rec AS (
  SELECT r.review_id,
         CASE r.pos % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Top ' || CAST(r.pos AS VARCHAR) END AS top_name,
         CASE WHEN r.pos % 4 = 0 THEN '' ELSE e.m_product_name END AS meta_name, r.m_rating
  FROM records r JOIN entries e ON e.id = r.product_id)
SELECT review_id,
       coalesce(nullif(top_name, ''), nullif(meta_name, '')) AS name_or_null,
       coalesce(nullif(top_name, ''), nullif(meta_name, ''), '{ds.PRODUCT_NAME_FALLBACK}') AS product_name,
       coalesce(nullif(m_rating, ''), 'n/a') AS rating
FROM rec"""


def sql_product_name_fallback() -> str:
    return f"SELECT review_id, product_name FROM ({sql_field_fallback()})"


ORACLES.update({name[len("sql_"):]: fn for name, fn in list(globals().items())
                if name.startswith("sql_") and callable(fn)})


# ---------------------------------------------------------------------------------------
# Explanations, sources and sinks
# ---------------------------------------------------------------------------------------
def sql_explain_reviews() -> str:
    hl = "coalesce(m_highlights, '')"
    rc = ml_list("t")
    pc = ml_list("lower(coalesce(m_size, ''))")
    cap = (f"(len({rc}) > 0 AND len({pc}) > 0 AND coalesce(list_bool_and(list_transform({rc}, lambda c: "
           f"list_bool_and(list_transform({pc}, lambda p: abs(c - p) > p * {rules.CAPACITY_REL_TOL} "
           f"AND abs(c - p) > {rules.CAPACITY_ABS_TOL})))), false))")
    gendered = " OR ".join(contains(hl, w) for w in ["men", "women", "unisex", "gender-neutral", "genderless"])
    score = fake_score("context", "m_rating", "m_is_recommended", "m_helpfulness", "m_tfc", "m_neg", "nan")
    return _own_sql(f"""SELECT review_id, label AS pseudo_label, reason,
       'label: ' || label || '. reason: ' || reason AS explanation,
       concat_ws(',', CASE WHEN skin_type THEN 'skin_type' END, CASE WHEN gender THEN 'gender' END,
                 CASE WHEN capacity THEN 'capacity' END, CASE WHEN online_only THEN 'online_only' END,
                 CASE WHEN heuristic_score THEN 'heuristic_score' END,
                 CASE WHEN too_short THEN 'too_short_or_unrated' END) AS rules_fired,
       label AS parsed_label
FROM (
  SELECT *, CASE WHEN label = 'fake' THEN '{rules.REASON_FAKE}' ELSE '{rules.REASON_REAL}' END AS reason FROM (
    SELECT *, CASE WHEN (own_id IS NOT NULL AND (skin_type OR gender OR capacity OR online_only)) OR heuristic_score
                        OR too_short THEN 'fake' ELSE 'real' END AS label
    FROM (
      SELECT review_id, own_id,
             (({contains('t', 'oily')} AND {contains(hl, 'dry')}) OR ({contains('t', 'dry')} AND {contains(hl, 'oily')}))
               AS skin_type,
             ({contains('t', 'men')} AND ({gendered}) AND NOT {contains(hl, 'unisex')}
               AND NOT {contains(hl, 'genderless')}) AS gender,
             coalesce({cap}, false) AS capacity,
             coalesce(m_online_only IS NOT NULL AND m_online_only <> '' AND
                      regexp_matches(t, '{rules.STORE_PATTERN}'), false) AS online_only,
             {score} > {float(rules.FAKE_THRESHOLD)} AS heuristic_score,
             NOT (length(coalesce(context, '')) >= {rules.MIN_REAL_CONTEXT_CHARS} AND {has_rating('m_rating')})
               AS too_short
      FROM own)))""")


def sql_scan_reviews_csv() -> str:
    return with_(REVIEWS) + """
SELECT review_id, product_id, rating, is_recommended, helpfulness, review_title, review_text FROM reviews"""


def sql_scan_products_csv() -> str:
    return with_(PRODUCTS) + "\nSELECT product_id, product_name, size, value_price_usd, online_only, highlights FROM products"


def sql_roundtrip_jsonl() -> str:
    return sql_review_record().replace("SELECT review_id, product_id, CAST(NULL AS VARCHAR) AS pseudo_label,",
                                       "SELECT review_id, product_id, context, CAST(NULL AS VARCHAR) AS pseudo_label,")


def sql_scan_jsonl() -> str:
    return with_(*CTX_BASE) + "\nSELECT review_id, context FROM records"


def sql_limit_prefix() -> str:
    return with_(*CTX_BASE) + "\nSELECT review_id, context FROM records ORDER BY pos LIMIT 100"


def sql_json_roundtrip() -> str:
    return with_(*CTX_BASE) + """
SELECT review_id, CAST(to_json({'author_id': m_author_id, 'rating': m_rating, 'is_recommended': m_is_recommended,
       'helpfulness': m_helpfulness, 'total_feedback_count': m_tfc, 'total_neg_feedback_count': m_neg,
       'total_pos_feedback_count': m_pos}) AS VARCHAR) AS meta_json, true AS same FROM records"""


def sql_upsert_products() -> str:
    return with_(PRODUCTS, FILLED, ENTRIES) + "\nSELECT id, document, CAST(64 AS INTEGER) AS dim FROM entries"


def sql_duplicate_split_files() -> str:
    return with_(REVIEWS) + """,
flagged AS (
  SELECT review_id, pos <> min(pos) OVER (PARTITION BY coalesce(review_text, '')) AS dup FROM reviews)
SELECT review_id, CASE WHEN dup THEN 'fake' ELSE 'real' END AS pseudo_label, 'cleaned' AS file FROM flagged
UNION ALL SELECT review_id, 'fake', 'duplicates' FROM flagged WHERE dup"""


def sql_model_roundtrip() -> str:
    return with_(QLABELS) + "\nSELECT review_id, true AS same FROM qlabels"


def token_ctes(texts: str) -> list[str]:
    """Weights of the training part, and each text's score; ``texts``: a select of key and text."""
    words = "unnest(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+'))"
    return [
        f"""
train AS (SELECT label AS y, context AS text FROM examples WHERE {unit_draw('pos', 'split:')} >= 0.2)""",
        f"""
seen AS (
  SELECT token, sum(y) AS n1, sum(1 - y) AS n0 FROM (SELECT {words.format('text')} AS token, y FROM train) GROUP BY token)""",
        """
weights AS (
  SELECT token, ln(((n1 + 1) / ((SELECT sum(n1) FROM seen) + (SELECT count(*) FROM seen)))
                   / ((n0 + 1) / ((SELECT sum(n0) FROM seen) + (SELECT count(*) FROM seen)))) AS weight FROM seen
  UNION ALL SELECT '', (SELECT ln((count(*) FILTER (y = 1) + 1) / (count(*) FILTER (y = 0) + 1)) FROM train))""",
        f"""
texts AS ({texts})""",
        f"""
scored AS (
  SELECT texts.key, coalesce(any_value(s), 0) + (SELECT weight FROM weights WHERE token = '') AS score
  FROM texts LEFT JOIN (
    SELECT key, sum(coalesce(weight, 0)) AS s
    FROM (SELECT key, {words.format('text')} AS token FROM texts) t LEFT JOIN weights USING (token) GROUP BY key) USING (key)
  GROUP BY texts.key)""",
    ]


def sql_token_model() -> str:
    return with_(QLABELS.replace("qlabels AS", "examples AS"), *token_ctes("SELECT 1 AS key, '' AS text")) + "\nSELECT token, weight FROM weights"


def sql_evaluate_token_model() -> str:
    held = f"SELECT pos AS key, context AS text FROM examples WHERE {unit_draw('pos', 'split:')} < 0.2"
    return with_(QLABELS.replace("qlabels AS", "examples AS"), *token_ctes(held), """
qlabels AS (
  SELECT label, CASE WHEN score >= 0 THEN 1 ELSE 0 END AS prediction FROM scored JOIN examples ON pos = key)""", PER_CLASS) + REPORT


def sql_predict_token_model() -> str:
    requests, shown = sql_build_request_context().rsplit("\nSELECT ", 1)
    held = "SELECT review_id AS key, context AS text FROM requests"
    ctes = ",".join([QLABELS.replace("qlabels AS", "examples AS"), f"\nrequests AS (SELECT {shown})", *token_ctes(held)])
    return requests + "," + ctes + f"""
SELECT key AS review_id, round(score, 4) AS score, CAST(CASE WHEN score >= 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
       CASE WHEN score >= 0 THEN '{rules.VERDICT_USEFUL}' ELSE '{rules.VERDICT_USELESS}' END AS verdict FROM scored"""


ORACLES.update({name[len("sql_"):]: fn for name, fn in list(globals().items())
                if name.startswith("sql_") and callable(fn)})


def sql_stream_label_reviews() -> str:
    return sql_label_reviews()


def sql_stream_flag_duplicates() -> str:
    return sql_flag_duplicates()


ORACLES.update({"stream_label_reviews": sql_stream_label_reviews,
                "stream_flag_duplicates": sql_stream_flag_duplicates})


# ---------------------------------------------------------------------------------------
# Synthetic job (deterministic: template generator + md5 draws)
# ---------------------------------------------------------------------------------------
def _synth_ctes(ratio: float = 1.0) -> list[str]:
    from credence.operators import augment as a

    name = "coalesce(g.m_product_name, 'a skincare product')"
    text = (f"CASE WHEN g.rating = 5 THEN replace('{a.TEMPLATE_POSITIVE}', '%s', {name}) "
            f"ELSE replace('{a.TEMPLATE_NEGATIVE}', '%s', {name}) END")
    return [
        QLABELS, PRODUCTS, FILLED, ENTRIES,
        f"""
pbuckets AS (SELECT id, {token_buckets('document')} AS b FROM entries)""",
        f"""
pcounts AS (SELECT id, {bucket_counts('b')} AS c FROM pbuckets)""",
        f"""
pvec AS (SELECT id, {normalised('c')} AS vec FROM pcounts)""",
        """
reals AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS ri FROM qlabels WHERE pseudo_label = 'real')""",
        """
fakes AS (SELECT context AS fake_context, row_number() OVER (ORDER BY pos) - 1 AS fi FROM qlabels
          WHERE pseudo_label = 'fake')""",
        """
cnt AS (SELECT (SELECT count(*) FROM reals) AS nr, (SELECT count(*) FROM fakes) AS nf)""",
        f"""
steps AS (SELECT s.range AS step FROM range(100000000) s, cnt WHERE s.range < CAST(floor({ratio} * cnt.nr) AS BIGINT))""",
        f"""
pairs AS (
  SELECT d.step, r.review_id, r.context, f.fake_context FROM (
    SELECT step, {seeded_int_sql('step', 'nr', 'real:')} AS ri, {seeded_int_sql('step', 'nf', 'fake:')} AS fi
    FROM steps, cnt) d JOIN reals r ON r.ri = d.ri JOIN fakes f ON f.fi = d.fi)""",
        f"""
qb AS (SELECT step, {token_buckets('context')} AS b FROM pairs)""",
        f"""
qc AS (SELECT step, {bucket_counts('b')} AS c FROM qb)""",
        f"""
qv AS (SELECT step, {normalised('c')} AS vec FROM qc)""",
        f"""
top1 AS (
  SELECT step, id FROM (
    SELECT q.step, p.id, row_number() OVER (PARTITION BY q.step ORDER BY
             round(pow(array_distance(CAST(q.vec AS DOUBLE[{DEFAULT_DIM}]), CAST(p.vec AS DOUBLE[{DEFAULT_DIM}])), 2), 6),
             p.id) AS rk
    FROM qv q, pvec p) WHERE rk = 1)""",
        f"""
info AS (SELECT step, {info_sql('step')} FROM steps)""",
        f"""
gen AS (
  SELECT p.step, p.review_id, e.m_product_name, g2.*
  FROM pairs p JOIN top1 t ON t.step = p.step JOIN entries e ON e.id = t.id JOIN (
    SELECT g.step AS gstep,
           'Review title: ' || g.review_title || ' | Review text: ' || {text} || ' | Rating: ' || CAST(g.rating AS VARCHAR)
           || ' | Recommended: ' || CAST(CAST(g.is_recommended AS DOUBLE) AS VARCHAR) || ' | Product summary: '
           || {name} || ' by ' || coalesce(g.m_brand_name, '') || '. Highlights: ' || coalesce(g.m_highlights, '')
           || '.' AS gen_text
    FROM (SELECT i.*, e.m_product_name, e.m_brand_name, e.m_highlights
          FROM info i JOIN top1 t ON t.step = i.step JOIN entries e ON e.id = t.id) g) g2 ON g2.gstep = p.step)""",
    ]


def sql_synth_fakes() -> str:
    from credence.operators import augment as a

    dup_n = seeded_int_sql("step", str(a.TROLL_MAX_COPIES + 1), "troll:")
    comb_n = seeded_int_sql("step", str(a.TROLL_MAX_COMBINED + 1), "troll_comb:")
    every = a.TROLL_EVERY
    return with_(*_synth_ctes(1.0)) + f""",
var AS (
  SELECT step, 'generated' AS kind, 0 AS copy FROM gen
  UNION ALL SELECT step, 'duplicate', c.range + 1 FROM gen, range(100) c
    WHERE step % {every} = 0 AND c.range < {dup_n}
  UNION ALL SELECT step, 'combined', 0 FROM gen WHERE step % 2 = 0
  UNION ALL SELECT step, 'combined', c.range + 1 FROM gen, range(100) c
    WHERE step % {every} = 0 AND step % 2 = 0 AND c.range < {comb_n}),
keyed AS (
  SELECT v.step, v.kind, v.copy, g.review_id, g.gen_text, g.m_product_name,
         CASE WHEN v.kind = 'generated' THEN CAST(v.step AS VARCHAR)
              WHEN v.kind = 'duplicate' THEN CAST(v.step AS VARCHAR) || ':dup:' || CAST(v.copy AS VARCHAR)
              WHEN v.copy = 0 THEN CAST(v.step AS VARCHAR) || ':comb'
              ELSE CAST(v.step AS VARCHAR) || ':combinfo:' || CAST(v.copy AS VARCHAR) END AS ikey,
         CASE WHEN v.copy = 0 THEN CAST(v.step AS VARCHAR)
              ELSE CAST(v.step AS VARCHAR) || ':comb:' || CAST(v.copy AS VARCHAR) END AS akey
  FROM var v JOIN gen g ON g.step = v.step)
SELECT (SELECT max(pos) FROM qlabels) + 1 + step * 62 + copy + CASE WHEN kind = 'combined' THEN 11 ELSE 0 END AS pos,
       step, kind, CAST(copy AS INTEGER) AS copy, review_id,
       CASE WHEN kind = 'combined' THEN {augment_sql('gen_text', 'akey')} ELSE gen_text END AS context,
       'fake' AS pseudo_label, {info_sql('ikey')},
       CASE WHEN kind = 'generated' THEN m_product_name END AS meta_product_name
FROM keyed"""


def sql_augment_union() -> str:
    return with_(*_synth_ctes(0.5)) + f""",
rows_all AS (
  SELECT 'o:' || CAST(pos AS VARCHAR) AS row_key, pseudo_label FROM qlabels
  UNION ALL SELECT 's:' || CAST(step AS VARCHAR) || ':generated:0', 'fake' FROM gen)
SELECT row_key, pseudo_label, row_number() OVER (ORDER BY {hkey('row_key')}) AS shuffle_rank FROM rows_all"""


def sql_evaluate_explainer() -> str:
    report = sql_classification_report()
    tail = report[report.index("SELECT CAST(cls"):]
    return with_(f"""
explained AS ({sql_explain_reviews()})""", """
qlabels AS (SELECT CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS label, CASE WHEN e.parsed_label = 'fake' THEN 0 ELSE 1 END AS prediction
            FROM explained e JOIN labels l ON CAST(l.doc_id AS VARCHAR) = e.review_id)""", PER_CLASS) + tail


ORACLES.update({"synth_fakes": sql_synth_fakes, "augment_union": sql_augment_union,
                "evaluate_explainer": sql_evaluate_explainer})


def sql_distinct_texts() -> str:
    return with_(REVIEWS) + """
SELECT review_id FROM reviews QUALIFY pos = min(pos) OVER (PARTITION BY coalesce(review_text, ''))"""


ORACLES.update({"distinct_texts": sql_distinct_texts})


# ---------------------------------------------------------------------------------------
# Plug-in models
# ---------------------------------------------------------------------------------------
def sql_generate_plugin() -> str:
    from credence.operators.augment import ATTEMPTS
    from credence.plans import catalog as c

    def answer(i: int) -> str:
        code = f"md5('{i}:' || prompt)"
        before, after = c.STUB_ANSWER.replace("{attempt}", str(i)).split("{text}")
        return (f"CASE WHEN NOT contains('{c.STUB_SILENT}{c.STUB_MALFORMED}', substr({code}, 1, 1)) "
                f"THEN '{before}' || substr({code}, 1, 8) || '{after}' END")

    return with_(*CTX_BASE, FILLED, ENTRIES, _prompt_cte()) + f"""
SELECT review_id, coalesce({', '.join(answer(i) for i in range(ATTEMPTS))}) AS generated FROM prompts"""


def sql_retrieve_plugin() -> str:
    from credence.plans import catalog as c

    def shape(text: str) -> str:
        return (f"length({text}) AS c0, length({text}) - length(replace({text}, 'e', '')) AS c1, "
                f"length({text}) - length(replace({text}, ' ', '')) AS c2, "
                f"length({text}) - length(regexp_replace({text}, '[0-9]', '', 'g')) AS c3")

    dist = " + ".join(f"pow(CAST(q.c{i} - p.c{i} AS DOUBLE), 2)" for i in range(c.STUB_DIM))
    return with_(*CTX_BASE, FILLED, ENTRIES) + f""",
q AS (SELECT pos, review_id, {shape("coalesce(context, '')")} FROM records),
p AS (SELECT id, {shape('document')} FROM entries),
ranked AS (
  SELECT q.review_id, p.id AS product_id, {dist} AS dist,
         row_number() OVER (PARTITION BY q.pos ORDER BY {dist}, p.id) AS rank
  FROM q, p QUALIFY rank <= {c.K})
SELECT review_id, CAST(rank AS INTEGER) AS rank, product_id, dist FROM ranked"""


ORACLES.update({"generate_plugin": sql_generate_plugin, "retrieve_plugin": sql_retrieve_plugin})
