"""PII spans and disclosing terms against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandscope.llm import pii
from demandscope.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id int, email string, terms int"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
WORD = re.compile(r"[^\W_]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "k", 3) for i, t in rows], SCHEMA)


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = {}
    for kind, pattern in BASE.items():
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            own.append((m.start(), m.end()))
        out[kind] = own
    return out


def brute(rows, near=pii.NEAR, support=pii.SUPPORT, threshold=pii.THRESHOLD):
    together, single, words, contexts = Counter(), Counter(), Counter(), []
    for _, text in rows:
        text = text or ""
        spans = base(text)
        all_spans = [s for own in spans.values() for s in own]
        found = [(w.start(), w.end(), w[0].lower()) for w in WORD.finditer(text)]
        words.update({w for _, _, w in found})
        own = []
        for kind, places in spans.items():
            for a, b in places:
                for s, e, w in found:
                    if (max(0, a - near) <= s and e <= a or b <= s and e <= b + near) and not any(x < e and s < y for x, y in all_spans):
                        own.append((kind, text[a:b], w, s, e))
        together.update({x[:3] for x in own})
        single.update({x[:2] for x in own})
        contexts.append(own)
    out = []
    for (i, text), own in zip(rows, contexts, strict=True):
        spans = base(text or "")
        listed = [f"{kind}:{a}:{b}" for kind in BASE for a, b in spans[kind]]
        terms = set()
        for kind, value, w, s, e in own:
            n, m = together[kind, value, w], single[kind, value]
            if n >= support and m < len(rows) and math.log(n * len(rows) / (words[w] * m)) / math.log(len(rows) / m) >= threshold:
                terms.add((s, e))
        out.append((i, *(len(spans[k]) for k in BASE), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    ",".join(listed + [f"term:{s}:{e}" for s, e in sorted(terms)])))
    return sorted(out, key=repr)


def got(df):
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


ODD = [
    "a@b.cd_ef@g.hi a@b@c.de x@y. .@a.b a.b@c.d.e-f+g@h.ij@k.l", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.0003.255 1.2.3", "1..2.3.4.5.6",
    "4111 1111 1111 1111 4111-1111-1111-1111-4111 4111111111111111", "5  4111111111111111 4 -4111111111111111x",
    "+1 (555) 123-4567 +12345678 +1234567 +1 234 567 890 123 4567 ++1-2", "+1.2.3.4 +49 (30) 1234 5678)", "9" * 3000, "1 2 " * 4000,
    "a" * 50_000, "a.b@" + "c." * 5000 + "d", "語 é x@y.zz 語語 1.1.1.1é", "5500 0000 0000 0004 12", "", None, "1.2.3.4", "@ + . @."]


def test_base_spans(spark):
    rows = list(enumerate(ODD)) + [(None, "x@y.zz"), (3, "x@y.zz"), (3, "x@y.zz")]
    assert got(pii.pii_spans(frame(spark, rows).repartition(3))) == brute(rows)
    assert pii.pii_spans(frame(spark, rows).limit(0)).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"please write to Marlow at m.low@example.com about case {i} today") for i in range(5)]
    rows += [(10 + i, f"please write to us about case {i} today, Annabel, or a.bel@example.com") for i in range(4)]
    rows += [(20 + i, f"please write about something else today number {i}") for i in range(60)]
    rows += [(90, "Annabel was here alone")]
    out = got(pii.pii_spans(frame(spark, rows)))
    assert out == brute(rows)
    by = {r[0]: r[-1] for r in out}
    assert "term:16:22" in by[0] and by[20] == "" and by[90] == ""  # Marlow tells all of the address, others nothing
    texts = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows)).collect()}
    assert texts[0] == "please write to   [EMAIL] about case 0 today"
    assert texts[10] == "please write to  about case 0 today, [TERM],  [EMAIL]" and texts[90] == rows[-1][1]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert got(QUERIES["op6_pii"](spark, f"/root/testdata/{sf}")) == brute(rows)


def test_luhn(spark):
    numbers = ["4111111111111111", "4111111111111112", "0", "79927398713", "79927398710"]
    rows = spark.createDataFrame([(n,) for n in numbers], "n string").select(pii.luhn(F.col("n")).alias("ok")).collect()
    assert [r.ok for r in rows] == [luhn(n) for n in numbers]


def test_terms_are_counted_and_marked_in_whole_texts(spark):
    far = "and so on " * 20
    rows = [(i, f"Marlow write about case {i} {far} m.low@example.com") for i in range(5)]
    rows += [(20 + i, f"please write about something else today number {i} and so on about case") for i in range(60)]
    rows += [(90, "today MARLOW wrote, marlows did not"), (91, None)]
    by = {r[0]: r[-1] for r in got(pii.pii_spans(frame(spark, rows).repartition(3), near=None))}
    assert len(by) == len(rows) and by[0].endswith(",term:0:6") and by[90] == "term:6:12" and by[20] == by[91] == ""
    assert by[0].count("term") == 1
    texts = {r.doc_id: r.text for r in pii.sanitised(frame(spark, rows), near=None).collect()}
    assert texts[90] == "today [TERM] wrote, marlows did not" and texts[20] == rows[5][1] and "Marlow" not in texts[0]


def brute_whole(rows, support=pii.SUPPORT, threshold=pii.THRESHOLD):
    """Entities and terms of whole texts, counted over different texts; terms marked in every text."""
    def words(text):
        spans = [s for own in base(text).values() for s in own]
        return [(w.start(), w.end(), w[0].lower()) for w in WORD.finditer(text) if not any(w.start() < b and a < w.end() for a, b in spans)]

    texts = {text or "" for _, text in rows}
    together, single, n_term = Counter(), Counter(), Counter()
    for text in texts:
        own = {w for *_, w in words(text)}
        entities = {(kind, text[a:b]) for kind, places in base(text).items() for a, b in places}
        n_term.update(own)
        single.update(entities)
        together.update((e, w) for e in entities for w in own)
    n = len(texts)
    telling = {w for (e, w), both in together.items() if both >= support and single[e] < n
               and math.log(both * n / (n_term[w] * single[e])) / math.log(n / single[e]) >= threshold}
    out = []
    for i, text in rows:
        spans = base(text or "")
        listed = [f"{kind}:{a}:{b}" for kind in BASE for a, b in spans[kind]]
        out.append((i, *(len(spans[k]) for k in BASE), hashlib.sha256(",".join(listed).encode()).hexdigest(),
                    ",".join(listed + [f"term:{a}:{b}" for a, b, w in words(text or "") if w in telling])))
    return sorted(out, key=repr), telling


def test_whole_text_method_equals_brute_force(spark):
    rng = random.Random(3)
    names = ["Marlow", "Annabel", "Ödön", "x1", "日本"]
    rows = []
    for i in range(240):
        k = rng.randrange(12)
        body = rng.choices(["case", "today", "we", "write", "İt", "and", f"n{i % 40}", "a@b.c", "1.2.3.4", "low"], k=rng.randint(3, 25))
        if k < 5 and rng.random() < 0.9:
            body.insert(rng.randrange(len(body)), f"{names[k]}@mail.example.com")
            body.insert(rng.randrange(len(body)), names[k].upper() if i % 2 else names[k])
        rows.append((i, " ".join(body)))
    rows += [(900 + i, "Copy of one text about Quentin q.tin@mail.example.com") for i in range(30)]  # one text, so no support
    rows += [(1000, None), (1001, ""), (None, "MARLOW"), (1002, "marlow@mail.example.com+1 234 567 8901,marlow"), *rows[:20]]
    expected, telling = brute_whole(rows)
    assert {"marlow", "annabel"} <= telling and "quentin" not in telling
    assert got(pii.pii_spans(frame(spark, rows).repartition(3), near=None)) == expected


def test_text_with_many_entities(spark):
    """The work on one text grows with its length, not with its square."""
    text = " ".join(f"u{i}@m.example.com and word{i}" for i in range(8000))
    rows = [(1, text), (2, "+1 234 567 8901 " * 4000)]
    start = time.time()
    result = {r.doc_id: r for r in pii.pii_spans(frame(spark, rows), near=None).collect()}
    assert (result[1].n_email, result[2].n_phone) == (8000, 4000) and time.time() - start < 60
    assert result[1].spans == ",".join(f"email:{a}:{b}" for a, b in base(text)["email"])
    assert pii.sanitised(frame(spark, rows[:1]), near=None).first().text == " ".join(f"[EMAIL] and word{i}" for i in range(8000))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force_of_whole_texts(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    assert got(QUERIES["op6_pii"](spark, f"/root/testdata/{sf}")) == brute_whole(rows)[0]
