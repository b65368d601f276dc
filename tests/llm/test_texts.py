"""Decontamination, near copies and secrets against plain Python."""

import itertools
import random

import brute
import pytest

from marketlens.llm import decontamination, entry, ngram_join, secret_scan
from marketlens.llm.common import scratch

BENCH = "item_id bigint, text string"


def rows(spark, folder, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{table}.parquet").select(*columns).collect()]


def passage(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "É1", "zeta", "eta", "x9"]) for _ in range(n))


def test_op1_on_the_tables(spark, small):
    want = brute.contamination(rows(spark, small, "documents", "doc_id", "text"), rows(spark, small, "benchmark", "item_id", "text"))
    got = {r["doc_id"]: r for r in entry.op1_benchmark_decontamination(spark, small).collect()}
    assert got.keys() == want.keys()
    for doc, (n, hit, items) in want.items():
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(items), hit > 0)
        assert r["items_sha256"] == brute.sha256(",".join(items))


@pytest.mark.parametrize(("broadcast_windows", "broadcast_megabytes"), [(1000, 1), (0, 1), (1000, 0)])
def test_op1_edge_cases(spark, documents, broadcast_windows, broadcast_megabytes):
    rng = random.Random(1)
    a, b = passage(rng, 14), passage(rng, 12)
    bench = [(1, a), (2, a + " more"), (10, "Short one"), (3, None), (4, "..."), (None, b), (3, a)]
    docs = [(1, a.upper() + "!"), (2, f"x {a}, {a}"), (3, None), (4, ""), (5, "short, ONE; short one"), (6, b), (7, "y " * 30000 + b), (6, b), (None, a), (8, "clean text here")]
    want = brute.contamination(docs, bench)
    out = decontamination.scan(
        documents(docs), spark.createDataFrame(bench, BENCH), broadcast_windows=broadcast_windows, broadcast_megabytes=broadcast_megabytes).collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"]) == want[r["doc_id"]], r["doc_id"]


def test_op1_unspaced_words_are_broadcast_by_their_bytes(spark, documents):
    long = " ".join("語" * 50_000 + str(i) for i in range(12))
    docs, bench = documents([(1, long), (2, "語 1 2")]), spark.createDataFrame([(7, long)], BENCH)
    asked = lambda df: "strategy=broadcast" in df._jdf.queryExecution().optimizedPlan().toString()
    found = decontamination.scan(docs, bench, broadcast_megabytes=1)
    assert asked(decontamination.scan(docs, bench)) and not asked(found)
    assert sorted((r["n_words"], r["n_hit"], r["items"]) for r in found.collect()) == [(3, 0, []), (12, 12, ["7"])]


def test_op1_a_common_passage_lists_its_items_once(spark, documents):
    common = passage(random.Random(5), 10)
    bench = spark.createDataFrame([(i, common) for i in range(300)], BENCH)
    found = decontamination.scan(documents([(1, ". ".join([common] * 2000))]), bench).first()
    assert (found["n_words"], found["n_hit"], len(found["hits"])) == (20_000, 20_000, 2_000)
    assert found["items"] == sorted(str(i) for i in range(300))


def test_op1_empty_tables(spark, documents):
    none = spark.createDataFrame([], BENCH)
    assert decontamination.scan(documents([]), none).collect() == []
    assert [r["n_hit"] for r in decontamination.scan(documents([(1, "a b")]), none).collect()] == [0]


def test_decontaminate_removes_documents_or_spans(spark, documents):
    rng = random.Random(2)
    a = passage(rng, 11)
    bench = spark.createDataFrame([(1, a)], BENCH)
    docs = documents([(1, f"Before - {a}. After"), (2, "clean"), (3, None), (4, a)], "hits row words n_hit doc")
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {2, 3}
    cut = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert [cut[i]["text"] for i in (1, 2, 3, 4)] == ["Before - . After", "clean", None, ""]
    assert cut[1]["hits"] == "hits"
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, bench, remove="letters")


def test_op2_on_the_tables(spark, small):
    want = brute.near_copies(rows(spark, small, "documents", "doc_id", "text"))
    got = {r["doc_id"]: tuple(r)[1:] for r in entry.op2_ngram_jaccard_join(spark, small).collect()}
    assert got == want


def test_op2_large_groups_in_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 7)
    rng = random.Random(3)
    base = passage(rng, 120).split()
    docs = []
    for i in range(60):  # near copies of growing length, links between neighbours only
        w = list(base) + [f"w{k}" for k in range(i)]
        docs.append((i, " ".join(w)))
    docs += [(100 + i, " ".join(base)) for i in range(20)]
    got = {r["doc_id"]: (r["n_links"], r["class_id"], r["group_id"], r["kept"]) for r in ngram_join.join(documents(docs)).collect()}
    assert got == brute.near_copies(docs)


def test_op2_edge_cases(spark, documents):
    docs = [(5, "One two"), (4, "one, TWO!"), (3, None), (2, ""), (1, "..."), (7, "one two three"), (None, "one two"), (4, "one, TWO!"), (9, "long " * 40000), (8, "long " * 50)]
    out = ngram_join.join(documents(docs, "row a n bands")).collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append((r["n_links"], r["class_id"], r["group_id"], r["kept"]))
    assert got[1] == [(0, 1, 1, True)] and got[2] == [(0, 2, 2, True)] and got[3] == [(0, 3, 3, True)]
    assert got[5] == [(3, 4, 4, False)] and got[None] == [(3, 4, 4, False)]
    assert sorted(got[4]) == [(3, 4, 4, False), (3, 4, 4, True)]  # one of two equal rows stays
    assert got[7] == [(0, 7, 7, True)] and got[9] == [(1, 8, 8, False)] and got[8] == [(1, 8, 8, True)]
    kept = ngram_join.deduplicate(documents(docs, "row a n bands"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "7", "8"]
    assert kept.columns[-4:] == ["row", "a", "n", "bands"]
    assert ngram_join.join(documents([])).collect() == []


def boilerplate(seed, n, of=20, take=10, size=30):
    """Texts of shared passages in any order: each hangs together with all others, though few are alike."""
    rng = random.Random(seed)
    passages = [passage(rng, size) for _ in range(of)]
    return [(i, " ".join(rng.sample(passages, take))) for i in range(n)]


@pytest.mark.parametrize("block", [40, 1000])
def test_op2_loose_components_by_bands(spark, documents, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    docs = boilerplate(6, 200, of=12)
    rng = random.Random(7)
    for i in range(60):  # near copies of some, of some of these again, and an equal set
        words = rng.choice(docs)[1].split()
        words[rng.randrange(len(words))] = f"changed{i}"
        docs.append((300 + i, " ".join(words)))
    docs += [(500, docs[0][1]), (None, docs[250][1])]
    plain = [(i if i is not None else 10_000, t) for i, t in docs]  # a null id is the last
    want = brute.near_copies(plain)
    got = {r["doc_id"]: tuple(r)[1:] for r in ngram_join.join(documents(docs)).drop("row").collect()}
    assert got.pop(None)[0] == want.pop(10_000)[0]
    assert got == want


def test_op2_compares_what_the_bands_propose(spark, documents, monkeypatch):
    seen = {}
    meetings, blocks = ngram_join._meetings, ngram_join._block_pairs
    monkeypatch.setattr(ngram_join, "_meetings", lambda heads: seen.setdefault("meetings", meetings(heads)))
    monkeypatch.setattr(ngram_join, "_block_pairs", lambda parts, threshold: seen.setdefault("pairs", blocks(parts, threshold)))
    assert ngram_join.join(documents(boilerplate(8, 2000))).count() == 2000
    met = {}
    for r in seen["meetings"].collect():
        met.setdefault(r["h"], []).append(r["cid"])
    proposed = {(min(a, b), max(a, b)) for group in met.values() for a, b in itertools.combinations(group, 2)}
    compared = {}
    for r in seen["pairs"].collect():
        compared.setdefault((r["pair"], r["own"]), [0, 0])[r["side"]] += 1
    n = sum(a * b + (a * (a - 1) // 2 if own else 0) for (_, own), (a, b) in compared.items())
    assert proposed and n <= 2 * len(proposed)
    assert 20 * n < 2000 * 1999 // 2  # what the component as a whole would take


def test_op2_fetches_a_set_once_per_class(spark, documents, monkeypatch):
    real = ngram_join._compare

    def strict(threshold):
        compare = real(threshold)

        def run(batches):
            seen = set()

            def watched():
                for batch in batches:
                    for row in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "cid")), strict=True):
                        if row in seen:
                            raise ValueError("a set came twice")
                        seen.add(row)
                    yield batch

            yield from compare(watched())

        return run

    monkeypatch.setattr(ngram_join, "_compare", strict)
    rng = random.Random(5)
    text = passage(rng, 60)
    docs = [(7, text)] * 9 + [(None, text)] * 9 + [(8, text + " more")] * 9 + [(None, text + " and more")] * 9
    got = sorted(tuple(r)[1:] for r in ngram_join.join(documents(docs)).select("row", "doc_id", "n_links", "group_id", "kept").collect() if r["doc_id"] == 8)
    assert got == [(8, 35, 7, False)] * 9


def test_deduplicate_when_files_are_dealt_out_anew(spark, documents):
    rng = random.Random(4)
    texts = [passage(rng, 30) for _ in range(20)]
    folder = scratch(spark, "test-dealt")
    documents([(i, texts[i % 20]) for i in range(40)]).repartition(8).write.parquet(folder)
    docs = spark.read.parquet(folder)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "8")
        kept = ngram_join.deduplicate(docs)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")  # as if executors had gone meanwhile
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.files.minPartitionNum", before) if before else spark.conf.unset("spark.sql.files.minPartitionNum")


def test_bands_reach_the_recall():
    n, r = ngram_join.bands(0.8, 0.999, 160)
    assert 1 - (1 - 0.8**r) ** n >= 0.999 and n * r <= 160


def test_op5_on_the_tables(spark, small):
    docs = dict(rows(spark, small, "documents", "doc_id", "text"))
    got = entry.op5_secret_scans(spark, small).collect()
    assert len(got) == len(docs)
    for r in got:
        check_secrets(r, docs[r["doc_id"]])


def check_secrets(r, text):
    base = brute.base_secrets(text)
    assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == q for _, k, _ in base) for q in range(3)]
    listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
    assert r["base_sha256"] == brute.sha256(listed)
    assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


HEX, AK = "0123456789abcdef" * 2, "AKIA" + "Q7" * 9
LOOSE, WEAK_ID = "aB3" * 12, "Z9" * 10


def test_op5_base_spans(spark, documents):
    texts = [
        None, "", "secret=token = abcdef", "PASSWORD: 'hunter22' passwd=\"abc\"", f"é漢🙂 api_key = {HEX}", f"{AK}{AK} x {AK}",
        "token=token=abcdefgh", "apikey:abcdef. token : \"aaa-bbb=\"", "AKIA" * 9, f"x{HEX}g{HEX[:23]}", "secret=" + "a" * 50000, "token=abcdef " * 3000,
        "ſecret=abcdefgh", "paſſword=abcdefgh",
    ]
    out = secret_scan.report(documents([(i, t) for i, t in enumerate(texts)], "base key linked doc")).collect()
    assert len(out) == len(texts)
    for r in out:
        check_secrets(r, texts[r["doc_id"]])
    assert secret_scan.report(documents([])).collect() == []


def test_op5_weak_parts_need_their_complement(spark, documents):
    far = " word" * 100
    docs = [
        (1, f"id {WEAK_ID} alone"), (2, f"loose {LOOSE} alone"), (3, f"id {WEAK_ID} key {LOOSE}"), (4, f"id {WEAK_ID} {far} {LOOSE}"),
        (5, f"https://api.example.com {AK} password=hunter22"), (6, f"https://api.example.com {far} {AK} password=hunter22"), (7, f"{AK} {LOOSE}"),
        (8, f"id {WEAK_ID} key {LOOSE}"), (8, f"id {WEAK_ID} key {LOOSE}"), (9, f"password={LOOSE} {WEAK_ID}"),
    ]
    kinds = {r["doc_id"]: [s.split(":")[0] for s in r["spans"].split(",") if s] for r in secret_scan.report(documents(docs)).collect()}
    assert kinds == {
        1: [], 2: [], 3: ["id", "secret"], 4: [], 5: ["endpoint", "access", "assign"], 6: ["access", "assign"], 7: ["access", "secret"],
        8: ["id", "secret"], 9: ["assign", "id"],
    }


def test_op5_secrets_are_judged_on_the_whole_run(spark, documents):
    padded = "A" * 150 + LOOSE
    docs = [(1, f"id {WEAK_ID} key {padded}=="), (2, f"id {WEAK_ID} key {'A' * 150}"), (3, f"id {WEAK_ID} key {'A' * 150}b, {LOOSE}")]
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(documents(docs)).collect()}
    assert spans == {1: f"id:3:23,secret:28:{28 + len(padded) + 2}", 2: "", 3: f"id:3:23,secret:181:{181 + len(LOOSE)}"}


def test_redaction(spark, documents):
    docs = documents([(1, f"a token={HEX} b"), (2, "clean"), (3, None), (4, f"{AK}"), (5, f"id {WEAK_ID} key {LOOSE} end")], "doc base linked key")
    out = secret_scan.redact(docs)
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs.columns
    assert text == {1: "a [SECRET] b", 2: "clean", 3: None, 4: "[SECRET]", 5: "id [SECRET] key [SECRET] end"}
