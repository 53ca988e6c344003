"""The corpus pipeline against a brute-force version of each stage, and odd documents through all of it."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_near import brute as near_brute

import __spark_entry__ as driver
import corpus_pipeline as cp
from demandscope.llm import mixing
from demandscope.llm.quality_rules import quality_rules
from demandscope.llm.tokenize import WordEncoder, resolve

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_filters(spark, stages):
    docs, good, single, apart, mixed, _ = stages
    assert all(x.columns == docs.columns for x in stages[:5])
    verdict = {r.doc_id: r.kept for r in quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert rows(good) == {i: r for i, r in rows(docs).items() if verdict[i]}
    last = {r.text: i for i, r in sorted(rows(good).items())}
    assert set(rows(single)) == set(last.values())
    classes = near_brute([(i, r.text) for i, r in rows(single).items()])
    assert set(rows(apart)) == {c for c, _ in classes.values()}
    assert rows(mixed) == rows(apart)


def test_mix_order_is_kept_by_the_files(spark, stages):
    place = {r.doc_id: (r.slot, r.begin) for r in mixing.mix(stages[3]).collect()}
    read = stages[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    order = [place[r.doc_id] for r in read]
    assert order == sorted(order)
    pieces = stages[5].orderBy("sequence_id", "offset").collect()
    assert list(dict.fromkeys(r.doc_id for r in pieces)) == [r.doc_id for r in read]


def test_packed_ids(stages):
    encoder = WordEncoder(resolve("byte_bpe_50k.json"))
    texts = {i: r.text for i, r in rows(stages[4]).items()}
    by_doc = defaultdict(list)
    for r in stages[5].collect():
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == texts.keys()
    for i, pieces in by_doc.items():
        ids = encoder.tokenizer.encode(texts[i], add_special_tokens=False).ids + [0]
        assert all(r.doc_tokens == len(ids) for r in pieces) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes())


def test_odd_documents(spark, tmp_path):
    clean = [r for r in spark.read.parquet(f"{SF}/documents.parquet").limit(30).collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, slot double"
    odd = [(r.doc_id, r.text, None, r.source if r.doc_id % 3 else None, None, "x", 1, None) for r in clean]
    odd += odd[:3] + [(None, clean[0].text, "en", "s", 5, None, None, 0.5), (None, None, None, None, None, None, None, None),
                      (501, "", "en", "s", 0, "k", 2, 0.1), (502, "z" * 100_000, "en", "s", 1, "k", 2, 0.1)]
    (tmp_path / "t").mkdir()
    frame = spark.createDataFrame(odd, schema)
    for name, docs in (("odd", frame), ("none", frame.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / name / "labels.parquet"))
    ids = {r.doc_id for r in cp.run(spark, str(tmp_path / "odd")).collect()}
    assert ids and ids <= {r.doc_id for r in clean}
    assert cp.run(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [5, 3, 2, 1], [97, 2, 1], [7] * 13])
def test_pfair_deviation_is_below_one_block(spark, weights):
    table = spark.createDataFrame([(f"s{i:02}", w) for i, w in enumerate(weights)], "source string, weight long")
    plan = {r.source: r for r in mixing.schedule(table).collect()}
    period = sum(weights)
    slots = sorted((s, name) for name, r in plan.items() for s in r.slots)
    assert [s for s, _ in slots] == list(range(period))
    done = dict.fromkeys(plan, 0)
    for at, name in slots:
        done[name] += 1
        assert all(abs(n - (at + 1) * plan[s].weight / period) < 1 for s, n in done.items())


def test_mix_of_streams(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix(docs, spark.createDataFrame([("src1", 3), ("src2", 5)], "source string, weight long"), 4000).collect()
    begin = defaultdict(int)
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.begin == begin[r.source] and r.block == r.begin // 4000 and r.release <= r.slot < r.deadline
        begin[r.source] += r.chars
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})


def test_pipeline_is_registered():
    assert driver.queries()["pipeline"] is cp.run and len(cp.STAGES) == 5
