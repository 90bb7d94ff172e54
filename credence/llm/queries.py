"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import dialogue, exact_dedup, licenses, mixing, ngram_join, packing, quality, spelling, substring_dedup, token_counts, token_files, toxicity, vector_dedup
from credence.llm._scratch import folder
from credence.llm._sql import crc32_ctes


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_counts(_read(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("kept_sha256", F.sha2("kept_text", 256)).drop("kept_text")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(_read(spark, sf_dir, "documents"))


def _tokenizer() -> str:
    """Path of the public vocabulary file that the queries use (installed on every machine)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the rendered document "source:lang:text" per field, the text's first line apart."""
    docs = _read(spark, sf_dir, "documents")
    source, lang, text = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang", "text"))
    head = F.when(F.instr(text, "\n") > 0, F.instr(text, "\n") - 1).otherwise(F.char_length(text))
    lang_at = F.char_length(source) + 1
    text_at = lang_at + F.char_length(lang) + 1

    def section(name, start, length):
        return F.struct(F.lit(name).alias("name"), start.cast("int").alias("start"), (start + length).cast("int").alias("end"))

    rendered = docs.select(
        "doc_id",
        F.concat(source, F.lit(":"), lang, F.lit(":"), text).alias("text"),
        F.array(
            section("source", F.lit(0), F.char_length(source)),
            section("lang", lang_at, F.char_length(lang)),
            section("first_line", text_at, head),
            section("body", text_at + head, F.char_length(text) - head),
        ).alias("sections"),
    )
    return token_counts.section_tokens(rendered, _tokenizer())


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), _tokenizer())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "token-files")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), path, _tokenizer())
    return token_files.read_token_files(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_read(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(_read(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the ids held out by their hash are never learned from."""
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"), learn=~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by a hash of conversation and turn, then repaired."""
    rows = _read(spark, sf_dir, "conversations")
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    h = F.crc32(key) % 20
    text = F.coalesce("text", blank)
    damaged = rows.select(
        "conv_id", "turn", (h != 0).alias("present"),
        F.when(h == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(h == 1, F.lit("")).when(h == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy"),
    )
    return dialogue.digests(dialogue.repair(damaged, present=F.col("present")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter runs, some of them with a character left out by a hash of document and run."""
    occurrences = spelling.runs(_read(spark, sf_dir, "documents"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
    word = F.when(h % 31 == 0, spelling.without(F.col("word"), h % F.char_length("word"))).otherwise(F.col("word"))
    return spelling.variant_forms(spelling.count_words(occurrences.select(word.alias("word"))))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


_EXTRA = f"CASE WHEN CAST((u + number * v) % {mixing.SPACE} AS DOUBLE) < (rate - floor(rate)) * {mixing.SPACE}.0::DOUBLE THEN 1 ELSE 0 END"

OP9_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws(':', 'mix', doc_id, md5(coalesce(text, '')))) AS code
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
          WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END) AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM sources
  WINDOW o AS (ORDER BY 3 * source_size / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(max(level) OVER () * w, CAST(3 * source_size AS DOUBLE)) AS target FROM levels),
rated AS (
  SELECT doc_id, s.source, size, source_size, target,
         CAST('0x' || substr(code, 1, 12) AS BIGINT) AS u, CAST('0x' || substr(code, 13, 12) AS BIGINT) AS v,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
tried AS (
  SELECT source, number, any_value(target) AS target, sum(size * (floor(rate) + {_EXTRA})) AS taken
  FROM rated, range({mixing.SEEDS}) n(number) GROUP BY source, number),
chosen AS (
  SELECT source, number FROM tried
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken - target), number) = 1),
copied AS (
  SELECT doc_id, size, source_size, target, CAST(floor(rate) AS BIGINT) + {_EXTRA} AS copies
  FROM rated r JOIN chosen c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM copied
"""

def _op6_sql() -> str:
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {at}, '{word}', {str(key).lower()})" for t, label, base, at, word, key in licenses.postings())
    return f"""
WITH postings(template, label, base, position, word, mandatory) AS (VALUES {values}),
files AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
places AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS pos FROM files),
licence AS (SELECT * FROM places WHERE word IN (SELECT word FROM postings)),
df AS (SELECT word, count(DISTINCT r) AS df FROM licence GROUP BY word),
weighed AS (
  SELECT p.*, ln(((SELECT count(*) FROM files) + 1.0::DOUBLE) / (coalesce(df, 0) + 1)) + 1e-6::DOUBLE AS idf
  FROM postings p LEFT JOIN df USING (word)),
indexed AS (
  SELECT *, sum(idf) OVER (PARTITION BY template) AS total,
         sum(CAST(mandatory AS INT)) OVER (PARTITION BY template) AS n_key,
         row_number() OVER (PARTITION BY template ORDER BY mandatory DESC, round(idf, 9) DESC, position) = 1 AS anchor
  FROM weighed),
aligned AS (
  SELECT r, template, label, base, pos - position AS start,
         least(1.0::DOUBLE, round(sum(idf) / max(total), 6)) AS share
  FROM licence JOIN indexed USING (word) GROUP BY ALL
  HAVING bool_or(anchor) AND sum(CAST(mandatory AS INT)) = max(n_key) AND round(sum(idf) / max(total), 6) >= {licenses.MIN_SHARE}),
found AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
         array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
         array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS score
  FROM aligned GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM files LEFT JOIN found USING (r)
"""


def _op12_sql() -> str:
    """Costs to finish, least edits and repaired lines for each state, row by row from the end."""

    def way(cost: str, edit: str, after: str, line: str = "") -> str:
        lines = f"list_prepend({line}, {after}.lines)" if line else f"{after}.lines"
        return f"{{'cost': CAST({cost} + {after}.cost AS BIGINT), 'audit': '{edit}' || {after}.audit, 'lines': {lines}}}"

    given = {"z": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}
    kept = {"z": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    plain, closed = [], []
    for q, (to, role) in given.items():
        ways = [way("2", "D", f"p.{q}"), f"CASE WHEN NOT must_go THEN {way('1 + extra', 'R', f'p.{to}', repr(role + ':') + ' || text')} END"]
        ways += [f"CASE WHEN NOT must_go AND kind = '{k}' THEN {way('extra', 'K', f'p.{k}', chr(39).join(['role || ', ':', ' || text']))} END" for k in kept[q]]
        plain.append(f"list_min([{', '.join(ways)}]) AS {q}")
        then = given[to][0]
        once, twice = way("5", "I", f"h.{to}", repr(role + ":")), f"{{'cost': 10 + h.{then}.cost, 'audit': 'II' || h.{then}.audit, 'lines': list_concat(['{role}:', '{given[to][1]}:'], h.{then}.lines)}}"
        closed.append(f"list_min([h.{q}, {once}, {twice}]) AS {q}")
    end = {"z": (0, "", "[]"), "s": (10, "II", "['user:', 'assistant:']"), "u": (5, "I", "['assistant:']"), "a": (0, "", "[]")}
    ends = ", ".join(f"{{'cost': CAST({c} AS BIGINT), 'audit': '{e}', 'lines': CAST({rows} AS VARCHAR[])}} AS {q}" for q, (c, e, rows) in end.items())
    return f"""
WITH RECURSIVE keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
{crc32_ctes("keyed")},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS h FROM keyed JOIN crcs USING (key)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hit WHERE h <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i,
         substr(role, 1, 1) AS kind, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tail
  FROM damaged),
judged AS (
  SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY i) || kind AS pair,
         CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM ordered),
steps AS (
  SELECT *, fault IN ('blank', 'duplicate') AS must_go, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM judged),
found AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
plans AS (
  SELECT conv_id, n + 1 AS i, {ends} FROM found
  UNION ALL
  SELECT h.conv_id, h.i, {", ".join(closed)}
  FROM (SELECT r.conv_id, r.i, {", ".join(plain)}
        FROM plans p JOIN steps r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i - 1) h)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(plans.z.cost, 0) AS cost,
       coalesce(plans.z.audit, '') AS audit, sha256(coalesce(array_to_string(plans.z.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
LEFT JOIN found ON found.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN plans ON plans.conv_id IS NOT DISTINCT FROM ids.conv_id AND plans.i = 1
"""


OP13_SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS times
  FROM found WHERE length(run) >= 7 GROUP BY ALL),
{crc32_ctes("counted")},
damaged AS (
  SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, times
  FROM counted JOIN crcs USING (key)),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM words),
complete AS (SELECT substr(word, i + 1) || '$' || substr(word, 1, i) AS prefix, word, n FROM places),
skipping AS (
  SELECT substr(word, i + 2) || '$' || substr(word, 1, i) AS prefix, word, n, substr(word, i + 1, 1) <> substr(word, i + 2, 1) AS apart
  FROM places WHERE i < length(word)),
links AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skipping a JOIN skipping b ON a.prefix = b.prefix AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM complete a JOIN skipping b ON a.prefix = b.prefix AND b.apart
  UNION ALL SELECT b.word, a.word, a.n FROM complete a JOIN skipping b ON a.prefix = b.prefix AND b.apart),
ranked AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY other_n DESC, encode(other)) AS place FROM links),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
         CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON ranked.word = words.word AND place = 1),
walked(word, spot) AS (
  SELECT word, word FROM formed
  UNION ALL SELECT walked.word, form FROM walked JOIN formed ON formed.word = walked.spot WHERE form IS NOT NULL)
SELECT word, form, spot AS root, n, n_near, form_n
FROM formed JOIN walked USING (word) WHERE spot IN (SELECT word FROM formed WHERE form IS NULL)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_harmonic_packing": op5_harmonic_packing,
    "op6_license_scan": op6_license_scan,
    "op7_quality_cotraining": op7_quality_cotraining,
    "op8_token_files": op8_token_files,
    "op9_mix_sources": op9_mix_sources,
    "op10_ngram_join": op10_ngram_join,
    "op11_toxicity": op11_toxicity,
    "op12_dialogue_repair": op12_dialogue_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op6_license_scan": _op6_sql(),
    "op9_mix_sources": OP9_SQL,
    "op12_dialogue_repair": _op12_sql(),
    "op13_spelling_variants": OP13_SQL,
}
