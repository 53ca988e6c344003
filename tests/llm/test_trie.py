"""The prefix trie of rebuilt conversations against brute force over whole sequences."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from demandscope.llm import prefix_trie
from demandscope.llm.prefix_trie import conversation_trie
from demandscope.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn long, role string, text string, depth int, n int, owner string, part string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role.encode(), text[:64].encode(), digest, (role, text)))
    return {c: [t[-1] for t in sorted(v)] for c, v in own.items()}


def brute(rows, head=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = turns_of(rows)
    whole = {c: tuple(own.get(c - c % 100, [])[:head(c)] + own[c][head(c):]) for c in own}
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[:len(key)] == key]
        children = {k for k in below if len(k) == len(key) + 1}
        leaves = [k for k in below if not any(len(m) == len(k) + 1 and m[:len(k)] == k for m in below)]
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(key))
        out.append((convs[0], len(key), members[key[:-1]][0] if key else None, len(convs), len(children), len(leaves),
                    sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n):
    rng = random.Random(seed)
    say = ["hello", "", None, "ça va?", "x" * 70 + "a", "x" * 70 + "b", "bye"]
    rows = []
    for _ in range(n):
        c = rng.choice([0, 1, 2, 3, 50, 99, 100, 101, 150, 205, 206, 299, None])
        rows.append((c, rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "bot", None]), rng.choice(say)))
    return rows + rows[:n // 5]


def write(spark, rows, path):
    spark.createDataFrame([(*r, 9, 9, "o", "p") for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")


def got(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=repr)


@pytest.mark.parametrize(("seed", "n"), [(1, 40), (2, 90), (3, 12)])
def test_query_equals_brute_force_and_sql(spark, tmp_path, seed, n):
    rows = made(seed, n)
    write(spark, rows, tmp_path)
    df = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"] * 7 + ["string"]
    assert got(df) == brute(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(SQL["op13_prefix_trie"]).select(*COLUMNS).fetchall(), key=repr) == brute(rows)


def test_conversation_over_many_ranges(spark, tmp_path, monkeypatch):
    """One conversation holds most rows, so ranges go on with it, and it meets its header in several blocks."""
    rows = [(7, i, "user", f"t{i % 50}") for i in range(400)] + [(c, i, "user", "t0" if i == 0 else f"{c % 3}") for c in range(8, 40) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr(prefix_trie, "BLOCK", 64)
    try:
        df = spark.createDataFrame([(*r, 9, 9, "o", "p") for r in rows], SCHEMA).repartition(5)
        edges = prefix_trie.numbered(df, prefix_trie.bases(0)).where("edge").collect()
        assert sum(e.conv_id == 7 for e in edges) > 2
        assert got(conversation_trie(df)) == brute(rows, lambda c: 0)
        write(spark, rows, tmp_path)
        assert got(QUERIES["op13_prefix_trie"](spark, str(tmp_path))) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_colliding_bases_are_replaced(spark, monkeypatch):
    """With bases of 1 the order of turns would not count; the references tell, and the next bases are taken."""
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "b"), (2, 1, "u", "a")]
    asked, true = [], prefix_trie.bases
    monkeypatch.setattr(prefix_trie, "bases", lambda k: asked.append(k) or (true(k) if k else [1] * 4))
    df = spark.createDataFrame([(*r, 9, 9, "o", "p") for r in rows], SCHEMA)
    assert got(conversation_trie(df)) == brute(rows, lambda c: 0) and asked == [0, 1]


def test_no_rows(spark, tmp_path):
    write(spark, [], tmp_path)
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path)).collect() == []
    write(spark, [(None, 1, "a", "b")], tmp_path / "x")
    assert QUERIES["op13_prefix_trie"](spark, str(tmp_path / "x")).collect() == []
