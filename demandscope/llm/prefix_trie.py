"""Prefix trie of conversations that share heads, from fingerprints that compose.

A stretch of n turns has the fingerprint (n, sum of v_i * B**i), v_i being the turn's digest modulo a prime. These form a
monoid: (n, x) * (m, y) = (n + m, x + B**n * y), and prefixes can be taken off again. A rebuilt conversation is the head of
its base and its own suffix, so the fingerprint of each of its prefixes is the product of two stored ones; no rebuilt text
or sequence is ever made. Texts do not leave the task that reads them: their digests and lengths do.

Equal fingerprints of one depth are a node. Each row of a node holds the reference of its last turn, the turn's SHA-256;
if two in one node differ, the bases collide and the job is run with others. By induction over the depth all prefixes
of a node are then equal.

The smallest member of a node owns it, and a conversation owns a suffix of its path: from the depth e on that is the
deepest it shares with a smaller one. All figures of subtrees become sums over members, without walking the trie: turns
up to e are the saved ones, and a leaf counts once on the path of its owner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandscope.llm.common import ship
from demandscope.session import stage

# The four largest primes below 2**31, so that products of residues fit a long.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
LANES = [f"x{i}" for i in range(len(PRIMES))]
REFERENCE = [f"ref{i}" for i in range(4)]
NODE = ["depth", "f0", "f1"]
FAMILY = 100  # conversations with one base
LONGEST_HEAD = 5
BLOCK = 10_000  # depths of a long conversation that meet their header under one key
SALTS = 64
TIE = 64  # characters of a text that order turns of equal number, before its digest does


def bases(attempt: int) -> list[int]:
    """One base for each prime; other attempts have others."""
    return [int.from_bytes(hashlib.sha256(f"{attempt}/{p}".encode()).digest()[:8], "big") % (p - 1000) + 500 for p in PRIMES]


def numbered(turns: DataFrame, base: list[int]) -> DataFrame:
    """part, conv_id, k, lanes, chars, len, references: turns in order, summed up inside each range of the data.

    Rows with ``edge`` hold the totals of the first and the last conversation of a range.
    """
    schema = "part long, edge boolean, conv_id long, k long, " + ", ".join(
        f"{x} long" for x in [*LANES, "chars", "len", *REFERENCE])
    names = [x.split()[0] for x in schema.split(", ")]
    lanes = range(len(PRIMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        powers = [np.ones(1, np.int64) for _ in lanes]
        first, last = None, None  # (conv_id, k, lanes, chars) at the end of the conversation

        def rows(edge, conv, k, sums, chars, length, reference):
            n = len(conv)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in (
                np.full(n, part), np.full(n, edge), conv, k, *sums, chars, length, *reference)], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            digest = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u8").reshape(n, 4).astype(np.uint64)
            begins = np.concatenate(([True], conv[1:] != conv[:-1]))
            where = np.flatnonzero(begins)
            segment = np.cumsum(begins) - 1
            goes_on = last is not None and last[0] == conv[0]
            carry = np.zeros((len(PRIMES) + 2, where.size), np.int64)  # k, lanes, chars
            if goes_on:
                carry[:, 0] = (last[1], *last[2], last[3])
            elif last is not None and first is None:
                first = last
            k = np.arange(n) - where[segment] + 1 + carry[0][segment]
            total = lambda x: np.cumsum(x) - (np.cumsum(x) - x)[where][segment]
            sums = []
            for i in lanes:
                while powers[i].size <= int(k.max()):
                    size = powers[i].size
                    step = powers[i][-1] * base[i] % PRIMES[i]
                    powers[i] = np.concatenate((powers[i], powers[i] * step % PRIMES[i]))[:2 * size]
                value = (digest[:, i] % np.uint64(PRIMES[i])).astype(np.int64) * powers[i][k] % PRIMES[i]
                sums.append((total(value) + carry[1 + i][segment]) % PRIMES[i])
            chars = total(length) + carry[-1][segment]
            yield rows(False, conv, k, sums, chars, length, digest.T.view(np.int64))
            if where.size > 1 and first is None:
                at = where[1] - 1
                first = (conv[at], k[at], [s[at] for s in sums], chars[at])
            last = (conv[-1], k[-1], [s[-1] for s in sums], chars[-1])
        ends = [x for x in (first, last) if x is not None]
        if ends:
            zero = np.zeros(len(ends), np.int64)
            yield rows(True, *(np.array(x) for x in zip(*((e[0], e[1]) for e in ends), strict=True)),
                       np.array([e[2] for e in ends]).T, np.array([e[3] for e in ends]), zero, [zero] * 4)

    role, text = (F.coalesce(turns[x], F.lit("")) for x in ("role", "text"))
    slim = turns.where(turns["conv_id"].isNotNull()).select(
        turns["conv_id"].cast("long").alias("conv_id"), F.length(text).cast("long").alias("len"),
        F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)).alias("digest"),
        turns["turn"].alias("turn"), role.alias("role"), F.substring(text, 1, TIE).alias("opening"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "opening", "digest"]
    return slim.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "len", "digest").mapInArrow(run, schema)


def carried(edges: list, base: list[int]) -> list[tuple]:
    """(part, conv_id, turns, B**turns, lanes, chars before it) where a range goes on with the conversation of the one before."""
    out, running = [], None
    parts: dict[int, list] = {}
    for e in edges:
        parts.setdefault(e["part"], []).append(e)
    for part in sorted(parts):
        for e in sorted(parts[part], key=lambda e: e["conv_id"]):
            own = [e[x] for x in LANES]
            if running and running[0] == e["conv_id"]:
                _, n, lanes, chars = running
                steps = [pow(b, n, p) for b, p in zip(base, PRIMES, strict=True)]
                out.append((part, e["conv_id"], n, *steps, *lanes, chars))
                running = (e["conv_id"], n + e["k"], [(x + s * y) % p for x, s, y, p in zip(
                    lanes, steps, own, PRIMES, strict=True)], chars + e["chars"])
            else:
                running = (e["conv_id"], e["k"], own, e["chars"])
    return out


def prefixes(turns: DataFrame, base: list[int]) -> DataFrame:
    """conv_id, pos, lanes, chars, len, references: the fingerprint of each prefix of each stored conversation."""
    local = stage(numbered(turns, base), "trie-turns")
    edges = local.where("edge").select("part", "conv_id", "k", *LANES, "chars").collect()  # two rows per range at most
    schema = "part long, conv_id long, n0 long, " + ", ".join(
        f"{a}{i} long" for a in ("s", "y") for i in range(len(PRIMES))) + ", chars0 long"
    before = turns.sparkSession.createDataFrame(carried(edges, base), schema)
    joined = local.where(~F.col("edge")).join(before, ["part", "conv_id"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    lanes = [((zero(f"y{i}") + F.coalesce(f"s{i}", F.lit(1)) * F.col(x)) % p).alias(x)
             for i, (x, p) in enumerate(zip(LANES, PRIMES, strict=True))]
    return joined.select("conv_id", (F.col("k") + zero("n0")).alias("pos"), *lanes,
                         (F.col("chars") + zero("chars0")).alias("chars"), "len", *REFERENCE)


def rebuilt(stored: DataFrame, base: list[int], head_of: Column, family: int) -> DataFrame:
    """conv_id, depth, f0, f1, chars, len, references, last: one row per prefix of each rebuilt conversation.

    The head of ``head_of`` turns comes from the base, the rest from the conversation itself; nothing but stored
    fingerprints is combined. A long conversation meets its header in blocks of depths.
    """
    fields = ["pos", *LANES, "chars", "len", *REFERENCE]
    none = F.struct(*(F.lit(0).cast("long").alias(x) for x in fields))
    at_head = F.max(F.when(F.col("pos") == head_of, F.struct(*fields)))
    convs = stored.groupBy("conv_id").agg(F.max("pos").alias("n"), at_head.alias("at")).select(
        "*", head_of.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base_id"))
    heads = stored.where((F.col("conv_id") % family == 0) & (F.col("pos") <= LONGEST_HEAD)).groupBy(
        F.col("conv_id").alias("base_id")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    headed = convs.join(heads, "base_id", "left").withColumn(
        "head", F.slice(F.coalesce("turns", F.array().cast(heads.schema["turns"].dataType)), F.lit(1), F.col("h")))
    header = stage(headed.select(
        "conv_id", "n", "h", "head", F.size("head").alias("taken"), F.coalesce("at", none).alias("at"),
        F.coalesce(F.try_element_at("head", F.lit(-1)), none).alias("end"),
        (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "trie-headers")

    def packed(lanes: list[Column]) -> list[Column]:
        return [(F.shiftleft(lanes[i], 31) + lanes[i + 1]).alias(f"f{i // 2}") for i in (0, 2)]

    last = (F.col("depth") == F.col("total")).alias("last")
    zero = F.lit(0).cast("long")
    root = header.select("conv_id", zero.alias("depth"), "total", *packed([zero] * 4), zero.alias("chars"), zero.alias("len"),
                         *(zero.alias(x) for x in REFERENCE))
    given = header.select("conv_id", "total", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "total", *packed([F.col(f"t.{x}") for x in LANES]), "t.chars", "t.len",
        *(f"t.{x}" for x in REFERENCE))
    met = stored.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(
        header.withColumn("block", F.explode(F.sequence(zero, F.floor(F.col("n") / BLOCK)))).select(
            "conv_id", "block", "h", "taken", "at", "end", "total"), ["conv_id", "block"]).where(F.col("pos") > F.col("h"))
    moved = []  # turns of a base that is too short come nearer to the start
    for i, (x, p) in enumerate(zip(LANES, PRIMES, strict=True)):
        back = F.element_at(F.array(*(F.lit(pow(base[i], -k, p)) for k in range(LONGEST_HEAD + 1))), F.col("h") - F.col("taken") + 1)
        moved.append((F.col(f"end.{x}") + back * ((F.col(x) - F.col(f"at.{x}") + p) % p)) % p)
    own = met.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "total", *packed(moved),
                     (F.col("end.chars") + F.col("chars") - F.col("at.chars")).alias("chars"), "len", *REFERENCE)
    return root.unionByName(given).unionByName(own).select(
        "conv_id", *NODE, "chars", "len", *REFERENCE, last)


def ends_digest(rows: DataFrame, name: str = "ends_sha256") -> DataFrame:
    """NODE and the SHA-256 of each node's conv_ids, ascending and joined by commas.

    Ranges of (node, conv_id) are first joined into pieces of text; a node's pieces then pass through the digest one by
    one, so a node that ends a large part of all conversations is never held in memory.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids = batch.column(3).to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if keys[i] != keys[i - 1]), len(ids)] if ids else [0]
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([keys[a][i] for a, _ in spans], pa.int64()) for i in range(3)),
                 pa.array([ids[a] for a, _ in spans], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())], names=[*NODE, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if key != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield table(done)
        if node:
            yield table([(*node, state.hexdigest())])

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*NODE, name])

    key = "depth long, f0 long, f1 long, "
    ranges = rows.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = ranges.mapInArrow(pieces, key + "first long, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").select(*NODE, "ids").mapInArrow(
        digests, key + f"{name} string")


def trie_nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of staged ``rows`` (see ``rebuilt``), and the nodes whose references differ.

    A node that many conversations share meets its rows under several keys.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    kept = [f(x).alias(f"{name}_{x}") for x in REFERENCE for name, f in (("low", F.min), ("high", F.max))]
    shares = stage(salted.groupBy(*NODE, "salt").agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("ends"), *kept), "trie-shares")
    whole = shares.groupBy(*NODE).agg(
        F.min("owner").alias("owner"), F.sum("n").alias("n"), F.sum("ends").alias("ends"),
        *(f(f"{name}_{x}").alias(f"{name}_{x}") for x in REFERENCE for name, f in (("low", F.min), ("high", F.max))))
    mixed = whole.where(" OR ".join(f"low_{x} <> high_{x}" for x in REFERENCE))
    owners = shares.select(*NODE, "salt").join(whole.select(*NODE, "owner", "n", "ends"), NODE)
    told = salted.join(owners, [*NODE, "salt"])
    shared = F.when(F.col("owner") != F.col("conv_id"), F.struct("depth", "chars", "owner"))
    leaf = F.col("last") & (F.col("owner") == F.col("conv_id")) & (F.col("ends") == F.col("n"))
    paths = stage(told.groupBy("conv_id").agg(F.max(shared).alias("s"), F.max(leaf).alias("leaf"), F.max("depth").alias("total")).select(
        "conv_id", F.coalesce("s.depth", F.lit(-1)).alias("e"), F.coalesce("s.chars", F.lit(0)).alias("e_chars"),
        F.col("s.owner").alias("e_owner"), "leaf", "total"), "trie-paths")
    each = paths.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / BLOCK)))).drop("total")
    met = rows.withColumn("block", F.floor(F.col("depth") / BLOCK)).join(each, ["conv_id", "block"])
    depth, e = F.col("depth"), F.col("e")
    parent = F.when((depth > 0) & (depth > e), F.when(depth == e + 1, F.col("e_owner")).otherwise(F.col("conv_id")))
    saved = F.when(depth <= e, F.col("e_chars") - F.col("chars") + F.col("len")).otherwise(0)
    nodes = met.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"),
        F.sum((~F.col("last") & (depth >= e)).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(saved).cast("long").alias("saved_tokens"))
    return nodes, mixed


def conversation_trie(turns: DataFrame, head_of: Column | None = None, family: int = FAMILY) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``head_of`` says, from ``conv_id``, how many turns (5 at most) come from the conversation conv_id - conv_id % family;
    without it conversations are taken as they are. Turns are ordered by turn, null first; those of equal number by
    role, the first 64 characters of the text and its digest. Null role or text is empty. Rows without conv_id belong to
    no conversation and are left out. Repeated rows are turns of their own. No conversations give no nodes, not even a
    root. Other columns are not read.
    """
    ship(turns.sparkSession)
    head_of = F.lit(0) if head_of is None else head_of
    attempt = 0
    while True:
        base = bases(attempt)
        rows = stage(rebuilt(prefixes(turns, base), base, head_of, family), "trie-rows")
        nodes, mixed = trie_nodes(rows)
        if mixed.isEmpty():
            break
        attempt += 1  # two different prefixes have one fingerprint
    ends = ends_digest(rows.where("last"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", empty).alias("ends_sha256"))
