"""Line dedup against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from demandscope.llm import line_dedup as ld
from demandscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line_id int, line_no string, row_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "k", 3) for i, t in rows], SCHEMA)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def near(a, b):
    """Edit distance within the allowed edits, by the cells near the diagonal."""
    if len(a) > len(b):
        a, b = b, a
    k = ld.edits_allowed(len(a))
    if k == 0 or len(b) - len(a) > k:
        return False
    row = {j: j for j in range(k + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = i if j == 0 else min(row.get(j, 9) + 1, new.get(j - 1, 9) + 1, row.get(j - 1, 9) + (x != b[j - 1]))
        if min(new.values()) > k:
            return False
        row = new
    return row[len(b)] <= k


def brute(rows):
    """doc_id: (lines, dropped, near, links)."""
    first, order = {}, []
    for i, t in sorted(rows):
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(ld.BLANK):
                first.setdefault(line, (i, no))
                order.append((i, no, line))
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(first, 0)
    for a, b in combinations(first, 2):
        if abs(len(a) - len(b)) <= 2 and near(a, b):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for line, place in first.items():
        least[find(line)] = min(least.get(find(line), (place, line)), (place, line))
    out = {i: [0, [], 0, 0] for i, _ in rows}
    for i, no, line in order:
        place, text = least[find(line)]
        out[i][0] += 1
        out[i][3] += links[line]
        if (i, no) != place:
            out[i][1].append(no)
            out[i][2] += text != line
    return {i: (n, ",".join(map(str, d)), c, k) for i, (n, d, c, k) in out.items()}


def got(df):
    rows = df.collect()
    assert all(r.n_dropped == len([x for x in r.dropped.split(",") if x]) for r in rows)
    return {r.doc_id: (r.n_lines, r.dropped, r.n_near, r.n_links) for r in rows}


def edited(r, line, times):
    for _ in range(times):
        at = r.randrange(len(line))
        line = r.choice([line[:at] + line[at + 1:], line[:at] + r.choice("xyzé") + line[at:], line[:at] + r.choice("xyz語") + line[at + 1:]])
    return line


@given(st.text(alphabet="abé\0", min_size=20, max_size=90), st.integers(0, 4), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_distance_and_keys(a, times, r):
    b = edited(r, a, times)
    shorter, longer = sorted((a, b), key=len)
    if len(longer) - len(shorter) <= 2 and len(shorter) >= 3:
        want = edit_distance(a, b)
        assert [bool(ld.within([(shorter, longer)], np.array([k]))[0]) for k in (0, 1, 2)] == [want <= k for k in (0, 1, 2)]
    if len(shorter) >= 20 and near(a, b):
        keys = ld.lookup_keys([a, b])
        assert set(keys[0]) & set(keys[1]) - {0}


@pytest.mark.parametrize("chunk", [3, 256])
def test_near_lines(spark, chunk):
    r = random.Random(4)
    bases = ["".join(r.choice("abcdefgh é") for _ in range(n)) for n in (12, 19, 20, 21, 58, 59, 60, 61, 62, 130)]
    rows = []
    for i in range(60):
        lines = [edited(r, r.choice(bases), r.choice([0, 0, 1, 2, 3])) for _ in range(r.randrange(5))]
        rows.append((i, "\n".join([*lines, " ", "unique line of document number " + "abcdefgh"[i % 8] * (i + 1)])))
    rows += [(100, None), (101, ""), (102, " \n\t\n"), (103, "y" * 30_000), (104, "y" * 30_001), (105, "short"), (106, "shorts")]
    assert got(ld.line_dedup(frame(spark, rows).repartition(3), chunk)) == brute(rows)


def test_odd_rows(spark):
    line = "a line that is long enough"
    rows = [(3, line), (1, line + "s"), (1, line + "s"), (None, line), (None, None)]
    out = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.n_near, r.n_links) for r in ld.line_dedup(frame(spark, rows)).collect()), key=repr)
    assert out == sorted([(3, 1, 1, 1, 1), (1, 1, 0, 0, 1), (1, 1, 1, 0, 1), (None, 1, 1, 1, 1), (None, 0, 0, 0, 0)], key=repr)
    assert ld.line_dedup(frame(spark, rows).limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lines = {x for _, t in rows for x in t.split("\n")}
    assert max(map(len, lines)) < 20_000
    assert got(QUERIES["op2_line_dedup"](spark, sf)) == brute(rows)
