"""Plain Python versions of what the operators must return, and shared fixtures."""

import collections
import re
import string

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="session")
def small_docs():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def ascii_lower(text):
    return (text or "").translate(_LOWER)


def smallest_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, k):
    w = WORD.findall(ascii_lower(text))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def jaccard_components(docs, k, percent):
    """docs: {id: text} -> ({id: set size}, {id: component})."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    holders = collections.defaultdict(list)
    links = []
    for d in sorted(sets):
        common = collections.Counter(o for s in sets[d] for o in holders[s])
        links += [(d, o) for o, n in common.items() if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n)]
        for s in sets[d]:
            holders[s].append(d)
    return {d: len(s) for d, s in sets.items()}, smallest_reachable(sets, links)


def without_repeats(docs, window):
    """docs: {id: text} -> {id: (words, kept words)}."""
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), [x for i, x in enumerate(w) if i not in gone])
    return out
