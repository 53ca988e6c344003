"""The n-gram Jaccard join against brute force."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from demandscope.llm import ngram_jaccard as nj
from demandscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_id int, values string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "k", 3) for i, t in rows], SCHEMA)


def shingles(text):
    own = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    own = [w for w in own if w]
    return frozenset(zip(*(own[i:] for i in range(5)), strict=False)) if len(own) >= 5 else frozenset([tuple(own)] if own else [])


def brute(rows, threshold=0.8):
    """{doc: (class, links)} by comparing all pairs of sets that share a shingle."""
    sets = {}
    for i, t in rows:
        sets.setdefault(shingles(t), []).append(i)
    parent = {s: s for s in sets}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    links = dict.fromkeys(sets, 0)
    by = {}
    for s in sets:
        for x in s:
            by.setdefault(x, []).append(s)
    for a, b in {tuple(sorted((id(a), id(b)))): (a, b) for group in by.values() for a, b in combinations(group, 2)}.values():
        both = len(a & b)
        if both >= threshold * (len(a) + len(b) - both) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[find(a)] = find(b)
    least = {}
    for s, ids in sets.items():
        least[find(s)] = min([*ids, least.get(find(s), ids[0])])
    return {i: (least[find(s)], links[s]) for s, ids in sets.items() for i in ids}


def got(df):
    return {r.doc_id: (r.class_id, r.n_links) for r in df.collect()}


@pytest.mark.parametrize("chunk", [4, 256])
def test_near_copies(spark, chunk):
    r = random.Random(5)
    rows = []
    for base in range(6):
        text = [f"w{r.randrange(400)}" for _ in range(r.choice([8, 60, 200]))]
        for _ in range(25):
            copy = list(text)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = f"v{r.randrange(9)}"
            rows.append((len(rows) + base, " ".join(copy)))
    rows += [(900, "a b"), (901, "a  b"), (902, "b a"), (903, ""), (904, None), (905, "x" * 9000), (906, "long word " * 9000)]
    assert got(nj.near_classes(frame(spark, rows).repartition(3), chunk=chunk)) == brute(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op7_ngram_jaccard"](spark, sf)) == brute(rows)


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(5, text), (3, text), (3, text), (None, text), (None, "other words that nobody else has here"), (7, "")]
    out = nj.near_classes(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links, r.kept) for r in out), key=repr) == sorted(
        [(5, 3, 0, False), (3, 3, 0, True), (3, 3, 0, True), (None, 3, 0, False), (None, None, 0, True), (7, 7, 0, True)], key=repr)
    assert nj.near_classes(frame(spark, rows).limit(0)).count() == 0


def test_pruning_rarely_drops_a_pair_at_the_threshold():
    least = nj.least_matches(0.8, nj.TOLERANCE)
    rng = np.random.default_rng(3)
    equal = np.cumsum(rng.random((200_000, nj.VALUES)) < 0.8, axis=1)[:, nj.STEP - 1::nj.STEP]
    assert (equal < np.array(least)[nj.STEP::nj.STEP]).any(axis=1).mean() < 1e-4
    far = np.cumsum(rng.random((20_000, nj.VALUES)) < 0.3, axis=1)[:, nj.STEP - 1::nj.STEP]
    assert (far < np.array(least)[nj.STEP::nj.STEP]).any(axis=1).mean() > 0.99


def test_overlaps():
    rng = np.random.default_rng(1)
    a, b = ([np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (0, 5, 40)] for _ in range(2))
    assert nj.overlaps(a, b).tolist() == [[len(set(x) & set(y)) for y in b] for x in a]


def test_min_hash_estimates_similarity():
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(30, 300))]
    values = nj.min_hashes(*nj.shingle_sets(pa.array(texts)))
    j = len(shingles(texts[0]) & shingles(texts[1])) / len(shingles(texts[0]) | shingles(texts[1]))
    assert abs((values[0] == values[1]).mean() - j) < 0.12
