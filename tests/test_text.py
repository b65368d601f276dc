"""Text jobs against plain Python."""

import random
import re
from collections import Counter
from decimal import Decimal, localcontext

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions.text import distinctive, distinctive_value, numbers, url_path, words
from marketlens.operators import textscan

STOP = set(config.STOP_WORDS)


def plain_distinctive(written):
    value = Decimal(written.replace(",", ""))
    if value != value.to_integral_value():
        return f"{value:.2f}" if abs(value) >= 100 else None
    return str(int(value)) if abs(value) >= 1000 else None


def plain_numbers(text):
    pattern = r"(?<![\w.])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(?![\w])"
    return [m.group(1) for m in re.finditer(pattern, text, re.ASCII)]


SAMPLES = [
    "GMV was 1,234.56 and 4,757,319.70 or $4757319.7, not 12.5kg",
    "counts 999 1000 1,000 10,00 1,2345 0123456 100.005 100.015 99.999 v1000 1000v 1000_a 3.14.1592",
    "ip 152.143.123.131 card 4785380592391139 call +1 (743) 555-3824",
    "",
    "1000.00 is 1000; 100.10 is 100.1; -2500 keeps digits; 2500.",
    "12345678901234567890123 é1000 1000é",
]


def test_numbers_of_any_length(spark):
    written = [
        "1" * 40 + ".005", "9" * 40 + ".995", "9" * 39 + ".996", "100.015", "100.025", "100.0250001", "199.995", "99.999",
        "0" * 30 + "123.4", "1,234.5650", "123456789012345678901234567890.12500000000000000000000000001", "-2500.255", "-0", "1000.000",
    ]
    frame = spark.createDataFrame([(n,) for n in written], "n string")
    got = {r["n"]: r["d"] for r in frame.select("n", distinctive(F.col("n")).alias("d")).collect()}
    with localcontext(prec=100):
        assert got == {n: plain_distinctive(n) for n in written}
    values = spark.createDataFrame([(1e33,), (1e300,), (-1234.5,), (None,)], "v double")
    assert [r["d"] for r in values.select(distinctive_value(F.col("v")).alias("d")).collect()] == ["1" + "0" * 33, None, "-1234.50", None]


def test_numbers_and_canonical_form(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", numbers(F.col("text")).alias("n")).collect()}
    for i, text in enumerate(SAMPLES[:5]):
        assert got[i] == plain_numbers(text), text
    assert got[5] == ["12345678901234567890123"]  # letters beyond ASCII are word characters too
    seen = sorted({n for ns in got.values() for n in ns})
    frame = spark.createDataFrame([(n,) for n in seen], "n string")
    canon = {r["n"]: r["d"] for r in frame.select("n", distinctive(F.col("n")).alias("d")).collect()}
    assert canon == {n: plain_distinctive(n) for n in seen}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789,. ax", max_size=24), min_size=1, max_size=40))
def test_numbers_on_random_texts(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: r["n"] for r in df.select("id", numbers(F.col("text")).alias("n")).collect()}
    assert got == {i: plain_numbers(t) for i, t in enumerate(texts)}


def test_leak_findings(spark):
    docs = spark.createDataFrame([(1, "we made 1,234.56 here"), (2, "1234.56 and 5000"), (3, "nothing")], "doc_id int, text string")
    metrics = spark.createDataFrame([("x", 1234.56, 7), ("y", 5000.0, 12)], "k string, v double, c int")
    gold = textscan.gold_numbers([metrics])
    assert sorted(r[0] for r in gold.collect()) == ["1234.56", "5000"]
    found = sorted(tuple(r) for r in textscan.leak_findings(docs, "doc_id", "text", gold).collect())
    assert found == [(1, "1234.56"), (2, "1234.56"), (2, "5000")]


def test_paths(spark):
    urls = {
        "https://a.example.com/evals/bank.yaml?x=1": ["matches evals/*"],
        "https://a.example.com/x/evals/y/": ["matches */evals/*"],
        "http://a.example.com/docs/my_ground_truth.md": ["matches *ground_truth*"],
        "http://a.example.com/a/b/measures.py#top": ["matches *measures.py"],
        "http://a.example.com/a/CLAUDE.md": ["auto-loaded by some agents"],
        "http://a.example.com/.github/workflows/AGENTS.md": ["auto-loaded by some agents", "agent configuration directory"],
        "http://a.example.com/.github": [],
        "http://a.example.com": [],
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    found = {}
    for r in textscan.path_pattern_scan(pages).collect():
        found.setdefault(r["page_id"], []).append(r["detail"])
    assert {i: sorted(v) for i, v in found.items()} == {i: sorted(v) for i, v in enumerate(urls.values()) if v}
    paths = [r[0] for r in pages.orderBy("page_id").select(url_path(F.col("url"))).collect()]
    assert paths[0] == "evals/bank.yaml" and paths[1] == "x/evals/y" and paths[7] == ""


def test_word_overlap_by_brute_force(spark):
    docs = [(1, "Alpha beta GAMMA the and delta"), (2, "zzz yyy"), (3, "alpha"), (4, None), (5, "beta gamma beta gamma")]
    items = [(10, "alpha beta"), (11, "gamma"), (12, "the of"), (13, "delta alpha gamma"), (14, "omega psi"), (15, "beta gamma")]

    def toks(text):
        return {w for w in re.findall(r"[a-z0-9]+", (text or "").lower()) if w not in STOP and len(w) > 2}

    want = {}
    for d, text in docs:
        score = lambda i, t=text: len(toks(t) & toks(i[1])) / (len(toks(t) | toks(i[1])) or 1)
        ranked = sorted(items, key=lambda i: (-score(i), i[0]))[:3]
        want[d] = [(i[0], round(score(i), 6)) for i in ranked]
    got = {}
    frame = textscan.word_overlap_topk(
        spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    )
    for r in frame.orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append((r["item_id"], r["overlap"]))
    assert got == want
    assert spark.range(1).select(words(F.lit("The 3D x-ray of IT"))).first()[0] == ["ray"]


def test_word_overlap_of_repeated_rows_and_null_ids(spark):
    """Each row has a ranking of its own; a word in every text and a very common document change nothing."""
    rng = random.Random(4)
    pool = ["hotword", *(f"word{i}" for i in range(30))]
    text = lambda n: "hotword " + " ".join(rng.choice(pool) for _ in range(n))
    same = text(9)
    docs = [(1, same)] * 40 + [(None, same), (None, text(4)), (2, text(40)), (2, "nothing shared"), (3, None)] + [(i, text(6)) for i in range(4, 60)]
    items = [(10, "hotword word1 word2"), (10, "hotword word1 word2"), (10, "word3 word4 word5"), (None, "word6 hotword"), (11, None), *((i, text(5)) for i in range(12, 30))]
    toks = lambda t: {w for w in re.findall(r"[a-z0-9]+", (t or "").lower()) if w not in STOP and len(w) > 2}
    want = Counter()
    for d, t in docs:
        def key(i, t=t):
            shared = len(toks(t) & toks(i[1]))
            return -(shared / (len(toks(t) | toks(i[1])) or 1)), i[0] is None, i[0] or 0, -shared
        best = sorted(items, key=key)[:4]
        want.update((d, rank + 1, i[0], -key(i)[3], round(-key(i)[0], 6)) for rank, i in enumerate(best))
    frame = textscan.word_overlap_topk(
        spark.createDataFrame(docs, "doc_id int, text string").repartition(5), spark.createDataFrame(items, "item_id int, text string").repartition(3), k=4)
    assert Counter(map(tuple, frame.collect())) == want
    none = textscan.word_overlap_topk(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([], "item_id int, text string"))
    assert none.collect() == []
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
