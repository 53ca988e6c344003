"""Licence scan and mixing: odd rows, and brute force."""

import re
from collections import defaultdict

import pytest

from demandscope.llm import license_scan as ls
from demandscope.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, row_id int, slot long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, "k", 3, 2) for i, t, s in rows], SCHEMA)


def pairs(text):
    own = re.sub(r"[\W_]+", " ", text.lower()).split()
    return set(zip(own, own[1:], strict=False))


def brute(text):
    """(unit, place, licence, dice) of the matching units."""
    text = text or ""
    paragraphs = re.split(r"\n(?:[^\S\n]*\n)+", text)
    units = [("line", i, x) for i, x in enumerate(text.split("\n"))]
    units += [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x.strip()]
    units += [("text", 0, text)] * (len(paragraphs) > 1)
    out = []
    for unit, place, x in units:
        own = pairs(x)
        scored = [(2 * len(own & pairs(t)) / (len(own) + len(pairs(t))), -i, name) for i, (name, t) in enumerate(ls.TEMPLATES) if own]
        best = max(scored, default=(0, 0, ""))
        if best[0] >= ls.THRESHOLD:
            out.append((unit, place, best[2], round(best[0], 9)))
    return sorted(out)


MIT = next(t for _, t in ls.TEMPLATES if t.startswith("Permission is hereby granted, free"))
TEXTS = [
    None, "", " \n\n ", "Released under the MIT License.", "code\nReleased   under the, MIT license\nmore", "the licence is MIT",
    MIT, MIT.replace(", ", ",\n"), "Title\n\n" + MIT.replace(", ", ",\n") + "\n\nend", MIT.replace("without restriction", "with some limits"),
    " ".join(MIT.split()[:30]), "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-SA 4.0.", "x " * 50_000,
    "This work is licensed under the GNU General Public License, version 3.\n" * 3, "Licensed\n\nunder CC BY 4.0."]


def test_scan(spark):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)]
    got = defaultdict(list)
    for r in ls.scan(frame(spark, rows).repartition(3)).collect():
        got[r.doc_id].append((r.unit, r.place, r.license, round(r.dice, 9)))
    assert {i: sorted(x) for i, x in got.items()} == {i: brute(t) for i, t, _ in rows if brute(t)}


def test_scan_rows(spark):
    rows = [(1, TEXTS[3], "s"), (1, TEXTS[3], "s"), (None, TEXTS[11], None), (2, None, "s")]
    got = sorted(((r.doc_id, r.n_hits, r.licenses, r.hits) for r in ls.license_scan(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([
        (1, 1, "MIT", "line:0:MIT"), (1, 1, "MIT", "line:0:MIT"), (2, 0, "", ""),
        (None, 3, "CC-BY-NC-4.0,CC-BY-SA-4.0", "line:0:CC-BY-NC-4.0,line:1:CC-BY-SA-4.0,paragraph:0:CC-BY-NC-4.0")], key=repr)
    assert ls.license_scan(frame(spark, rows).limit(0)).count() == 0
    assert ls.scan(frame(spark, rows), templates=[]).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_gate_words_touch_enough_pairs(threshold):
    own = [ls.pairs_of(t) for _, t in ls.TEMPLATES]
    gate = set(ls.gate_words(own, threshold))
    for p in own:
        untouched = sum(not gate & set(x.split()) for x in p)
        assert 2 * untouched / (len(p) + max(untouched, ls.bounds(len(p), threshold)[0])) < threshold


def test_mix_of_odd_rows(spark):
    rows = [(1, "abc", None), (1, "abc", None), (1, "ab", ""), (None, "x" * 10, "b"), (2, None, "b"), (3, "", "c"), (4, "y" * 25, "b"), (5, "z", "b")]
    got = mixing.mix(frame(spark, rows), block_chars=10).collect()
    assert sorted((r.source, r.chars) for r in got) == sorted((s or "", len(t or "")) for _, t, s in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r.begin, r.chars))
        at = 0
        for r in own:
            assert r.begin == at and r.block == at // 10 and r.release <= r.slot < r.deadline
            at += r.chars
    assert [r.doc_id for r in by["b"]] == [None, 2, 4, 5]
    out = mixing.mixed(frame(spark, rows), block_chars=10)
    assert out.columns == frame(spark, rows).columns
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, frame(spark, rows).collect()), key=repr)
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0 and mixing.mixed(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("n", "weight"), [(1, lambda i: 4), (13, lambda i: i * 7 + 3), (400, lambda i: 1 + i % 3)])
def test_schedule_is_earliest_deadline_first(spark, n, weight):
    """Also of hundreds of sources, whose period is as long as there are sources at least."""
    weights = [(f"s{i:04}", weight(i)) for i in range(n)]
    period = sum(w for _, w in weights)
    done, slots = [0] * n, {s: [] for s, _ in weights}
    for slot in range(period):
        _, i = min((-(-(done[i] + 1) * period // w), i) for i, (_, w) in enumerate(weights) if done[i] * period // w <= slot)
        slots[weights[i][0]].append(slot)
        done[i] += 1
    got = mixing.schedule(spark.createDataFrame(weights, "source string, weight long")).collect()
    assert {r.source: r.slots for r in got} == slots
