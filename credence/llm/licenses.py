"""License scan over a positional rare-token index (DataFrame functions only).

Templates are word sequences with a mandatory key phrase. The index holds a posting (word, template,
position) for every template word and, from document frequencies over the whole table, the anchor of
every template: the word of its key phrase with the highest IDF. Looked up in a file are only those
rarest words, in two steps:

1. the places of anchor words in the file give candidates (template, start) by relative position;
   no other word of the file is looked up;
2. for a candidate, the template's other postings are intersected with the file's words at their
   relative positions alone (start + position). It counts when every word of the key phrase stands
   there and the IDF-weighted share of matched template words reaches ``MIN_SHARE``.

Work follows the anchors' places: a file full of common licence words and without an anchor costs one
pass over its words. Texts are read once: words are kept only for files that hold all words of some
key phrase, which is necessary for any match. After the document frequencies nothing shuffles; the
broadcast index is one row for the whole fixed template list.

Defined cases
-------------
* null text: no words (n_words 0, n_base 0, empty labels, score 0).
* a null id and repeated ids: each row is scanned alone, no rows are joined by id.
* overlapping places all count; a word that stands at several template positions has several postings.
* positions before the first or after the last word of a file match nothing.
* empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence.llm._scratch import materialize
from credence.llm.exact_dedup import ascii_lower

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MIN_SHARE = 0.5

#: Base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Words of public licence notices, their mandatory key phrases and labels.
NOTICES = [
    ("released under the mit license", "mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge", "mit-text"),
    ("licensed under the apache license version 2 0", "apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 2", "general public license version 2", "gpl-2.0"),
    ("this work is licensed under the gnu general public license version 3", "general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lesser general public license", "lgpl"),
    ("licensed under cc by 4 0", "cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc by nc 4 0", "cc-by-nc-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license", "mpl-2.0"),
]


def postings() -> list[tuple[int, str, bool, int, str, bool]]:
    """(template, label, base, position, word, mandatory) of every template word."""
    rows = []
    for t, (text, phrase, label, base) in enumerate([(p, p, x, True) for p, x in BASE] + [(n, p, x, False) for n, p, x in NOTICES]):
        ws, key = text.split(), phrase.split()
        at = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
        rows += [(t, label, base, i, w, at <= i < at + len(key)) for i, w in enumerate(ws)]
    return rows


def index(spark: SparkSession, df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Postings with idf, the template's total idf and key words, and which posting is its anchor."""
    base = spark.createDataFrame(postings(), "template int, label string, base boolean, position int, word string, mandatory boolean")
    base = base.join(df, "word", "left").crossJoin(n_docs)  # n_docs: one row
    base = base.withColumn("idf", F.log((F.col("n_docs") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1e-6)
    whole = Window.partitionBy("template")
    rarest = Window.partitionBy("template").orderBy(F.desc("mandatory"), F.desc(F.round("idf", 9)), "position")
    return base.withColumns({
        "total": F.sum("idf").over(whole),
        "n_key": F.sum(F.col("mandatory").cast("int")).over(whole),
        "anchor": F.row_number().over(rarest) == 1,
    }).drop("df", "n_docs")


def lookup_tables(idx: DataFrame) -> DataFrame:
    """The index as one row: __anchors (anchor word -> its postings) and __templates (template -> label,
    key size, total IDF and postings by position). Both are as large as the fixed template list."""
    posting = F.struct("position", "word", "idf", "mandatory")
    templates = idx.groupBy("template").agg(
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("n_key").alias("n_key"), F.first("total").alias("total"),
        F.sort_array(F.collect_list(posting)).alias("postings"))
    templates = templates.agg(F.map_from_entries(F.collect_list(F.struct(
        "template", F.struct("label", "base", "n_key", "total", "postings")))).alias("__templates"))
    anchors = idx.filter("anchor").groupBy("word").agg(F.collect_list(F.struct("template", "position")).alias("at"))
    anchors = anchors.agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("__anchors"))
    return anchors.crossJoin(templates)  # one row each


def candidates(words: str = "__words", anchors: str = "__anchors") -> Column:
    """Array of (template, start), one for each place of an anchor word: the first lookup."""
    placed = F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))
    placed = F.filter(placed, lambda p: F.map_contains_key(F.col(anchors), p["word"]))
    return F.flatten(F.transform(placed, lambda p: F.transform(
        F.element_at(anchors, p["word"]), lambda a: F.struct(a["template"].alias("template"), (p["pos"] - a["position"]).alias("start")))))


def matches(rows: DataFrame, min_share: float) -> DataFrame:
    """Adds __found, an array of (label, base, start, share): the candidates whose key phrase is whole."""
    def probe(c: Column) -> Column:
        t = F.element_at("__templates", c["template"])
        met = F.filter(t["postings"], lambda p: F.get("__words", c["start"] + p["position"]) == p["word"])
        sums = F.aggregate(
            met, F.struct(F.lit(0).alias("key"), F.lit(0.0).alias("idf")),
            lambda acc, p: F.struct((acc["key"] + p["mandatory"].cast("int")).alias("key"), (acc["idf"] + p["idf"]).alias("idf")),
            lambda acc: F.struct((acc["key"] == t["n_key"]).alias("whole"), F.least(F.lit(1.0), F.round(acc["idf"] / t["total"], 6)).alias("share")))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), c["start"].alias("start"), sums.alias("met"))

    probed = F.filter(F.transform("__candidates", probe), lambda m: m["met"]["whole"] & (m["met"]["share"] >= min_share))
    found = F.transform(probed, lambda m: F.struct(
        m["label"].alias("label"), m["base"].alias("base"), m["start"].alias("start"), m["met"]["share"].alias("share")))
    return rows.withColumn("__candidates", candidates()).withColumn("__found", found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = MIN_SHARE) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    all_postings = postings()
    vocabulary = sorted({p[4] for p in all_postings})
    keys = sorted({tuple(p[4] for p in all_postings if p[0] == t and p[5]) for t in {p[0] for p in all_postings}})
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col), found.alias("__words"))
    rows = rows.withColumn("__licence", F.array_intersect("__words", F.array(*[F.lit(w) for w in vocabulary])))
    any_key = F.lit(False)
    for key in keys:
        ws = sorted(set(key))
        any_key = any_key | (F.size(F.array_intersect("__licence", F.array(*[F.lit(w) for w in ws]))) == len(ws))
    rows = materialize(
        rows.select(id_col, F.size("__words").cast("long").alias("n_words"), "__licence", F.when(any_key, F.col("__words")).alias("__words")),
        "licence-words",
    )
    df = rows.select(F.explode("__licence").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idx = materialize(index(spark, df, rows.agg(F.count(F.lit(1)).alias("n_docs"))), "licence-index")  # one row per template word
    hits = matches(rows.crossJoin(F.broadcast(lookup_tables(idx))), min_share)  # one row of tables

    def of_base(of: str) -> Column:
        return F.transform(F.filter("__found", lambda m: m["base"]), lambda m: m[of])

    def joined(labels: Column) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))

    return hits.select(
        id_col, "n_words", F.coalesce(F.size(of_base("label")), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(of_base("start")).cast("long").alias("first_word"), F.array_max(of_base("start")).cast("long").alias("last_word"),
        joined(of_base("label")).alias("base_labels"), joined(F.transform("__found", lambda m: m["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("__found", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
