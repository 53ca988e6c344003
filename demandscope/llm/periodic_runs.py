"""Periodic runs of words, found by string synchronising sets at dyadic scales.

At scale t (a power of two) a position is chosen if, among the windows of t words that begin in the t + 1 places from it on,
its own window or the last one has the least hash. The choice depends on the next 2t words only, so places with equal
contexts of 2t words are chosen together. A run of smallest period q with t <= q < 2t and at least 4q words has a chosen
place s among its first t, and s + q is chosen too, as the next place with the context of s: if a nearer one had it, the run
would have a smaller period. So neighbours with equal contexts, at a distance from t to 2t - 1, propose all periods of
that scale, and comparing words around a pair gives the run.

Windows of period t / 4 or less are left out of the choice, because in them every place would be a candidate. They are
known exactly: each lies in a run of a smaller scale. Periods 1 to 3 are found by comparing neighbours directly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandscope.llm.common import id_and_text, ship
from demandscope.llm.words import combine, mix, raw_bytes, slices

SHORTEST = 6  # words in a run
REPEATS = 4  # periods in a run
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)

Planter = Callable[[object, list[bytes]], list[bytes]]


def _shift(values: np.ndarray, by: int, fill: object) -> np.ndarray:
    """values[i + by], and ``fill`` beyond the end."""
    out = np.full(values.size, fill, values.dtype)
    if by < values.size:
        out[:values.size - by] = values[by:]
    return out


def _matches(ids: np.ndarray, x: int, y: int, most: int) -> int:
    """How many words from ``x`` on equal those from ``y`` on, at most ``most``."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        other = np.flatnonzero(ids[x + done:x + done + step] != ids[y + done:y + done + step])
        if other.size:
            return done + int(other[0])
        done, step = done + step, step * 2
    return done


def _matches_back(ids: np.ndarray, x: int, y: int, most: int) -> int:
    """How many words before ``x`` equal those before ``y``, at most ``most``."""
    done, step = 0, 64
    while done < most:
        step = min(step, most - done)
        other = np.flatnonzero(ids[x - done - step:x - done] != ids[y - done - step:y - done])
        if other.size:
            return done + step - 1 - int(other[-1])
        done, step = done + step, step * 2
    return done


def _small_periods(ids: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of stretches of period 1, 2 or 3 with at least four periods."""
    out = []
    for q in (1, 2, 3):
        if ids.size <= q:
            break
        same = (ids[:-q] == ids[q:]) & (low[:-q] == low[q:])
        edge = np.diff(np.concatenate(([0], same.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - start + q >= REPEATS * q
        for a, b in zip(start[long].tolist(), (end[long] + q).tolist(), strict=True):
            if q == 1 or bool((ids[a:a + q] != ids[a]).any()):  # else its smallest period is 1
                out.append((a, b - a, q))
    return out


def _scale(ids: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray, wide: np.ndarray, t: int,
           known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The runs of period t to 2t - 1. ``names`` and ``wide`` are fingerprints of t and of 2t words."""
    n = ids.size
    place = np.arange(n)
    step = np.zeros(n + 1, np.int32)
    for start, length, period in known:
        if REPEATS * period <= t <= length:
            step[start] += 1
            step[start + length - t + 1] -= 1
    hashes = mix(names ^ np.uint64(t))
    hashes[(np.cumsum(step[:n]) > 0) | (place + t > high)] = _NEVER
    least, reach = hashes, 1
    while reach < t:
        least, reach = np.minimum(least, _shift(least, reach, _NEVER)), reach * 2
    last = _shift(hashes, t, _NEVER)
    least = np.minimum(least, last)
    chosen = np.flatnonzero((place + 2 * t <= high) & (least != _NEVER) & ((hashes == least) | (last == least)))
    by_context = chosen[np.argsort(wide[chosen], kind="stable")]
    a, b = by_context[:-1], by_context[1:]
    pair = (wide[a] == wide[b]) & (low[a] == low[b]) & (b - a >= t) & (b - a < 2 * t)
    a, period = a[pair], (b - a)[pair]
    order = np.lexsort((a, period))
    out, seen = [], (0, 0)  # the period and the end of the stretch looked at last
    for s, q in zip(a[order].tolist(), period[order].tolist(), strict=True):
        if q == seen[0] and s + q < seen[1]:
            continue
        start = s - _matches_back(ids, s, s + q, s - int(low[s]))
        end = s + q + _matches(ids, s, s + q, int(high[s]) - s - q)
        seen = (q, end)
        if end - start >= REPEATS * q:
            out.append((start, end - start, q))
    return out


def find_runs(ids: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each run of each sequence, by start and period.

    ``ids`` holds the sequences one after the other, ``sizes`` their lengths. A run is as long as its smallest period
    allows, has at least four periods and six words. Contexts are compared by 64-bit fingerprints, words of runs exactly.
    """
    numbers = np.arange(sizes.size)
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    known: list[tuple[int, int, int]] = []  # the runs so far, in places of ``ids``
    names, t, first = mix(ids.astype(np.uint64)), 1, True
    while sizes.size:
        ends = np.cumsum(sizes)
        low, high = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        if first:
            fresh = _small_periods(ids, low)
        wide = combine(names, _shift(names, t, np.uint64(0)))
        if t >= 4:
            fresh = _scale(ids, low, high, names, wide, t, known)
        if t >= 4 or first:
            owner = np.searchsorted(ends, [run[0] for run in fresh], side="right")
            for k, (start, length, period) in zip(owner.tolist(), fresh, strict=True):
                found[numbers[k]].append((start - int(ends[k] - sizes[k]), length, period))
            known += fresh
        names, t, first = wide, 2 * t, False
        stay = sizes >= REPEATS * t
        if not stay.all():  # the others are too short for a period of the next scale
            keep = np.repeat(stay, sizes)
            moved = np.cumsum(keep) - 1
            known = [(int(moved[run[0]]), *run[1:]) for run in known if keep[run[0]]]
            ids, names, sizes, numbers = ids[keep], names[keep], sizes[stay], numbers[stay]
    return [sorted(run for run in own if run[1] >= SHORTEST) for own in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:n]) == 0


def periodic_runs(docs: DataFrame, plant: Planter | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, period), collapsed (binary).

    Words are separated by spaces and 0x09-0x0D. ``collapsed`` has each run cut to its first period, words joined by
    one space. ``plant`` may change the words of a document first. Null and empty texts have no runs and an empty
    collapsed text; ids may be null or repeat. No rows give no rows; other columns are not read. A text is worked on in
    one task, in memory in proportion to its words.
    """
    ship(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                data, offsets = raw_bytes(part.column(1))
                names: dict[bytes, int] = {}
                texts, ids = [], []
                for i, doc_id in enumerate(part.column(0).to_pylist()):
                    found = data[offsets[i]:offsets[i + 1]].tobytes().split()
                    texts.append(plant(doc_id, found) if plant else found)
                    ids.append(np.fromiter((names.setdefault(w, len(names)) for w in texts[-1]), np.int64, len(texts[-1])))
                sizes = np.array([len(x) for x in ids], np.int64)
                runs = find_runs(np.concatenate(ids) if ids else np.zeros(0, np.int64), sizes)
                left = [b" ".join(own if not here else [own[i] for i in np.flatnonzero(kept_words(len(own), here))])
                        for own, here in zip(texts, runs, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes),
                     pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs],
                              pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))),
                     pa.array(left, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])

    span = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
    return rows.mapInArrow(run, T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(span)), T.StructField("collapsed", T.BinaryType())]))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of the rows of ``periodic_runs``."""
    line: Callable[[Column], Column] = lambda r: F.concat(
        r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(ranked)
    return found.select("doc_id", "runs", "collapsed", top.alias("top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"),
        (-F.col("top.short")).alias("length"), F.col("top.period").alias("period"),
        F.floor(-F.col("top.short") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
