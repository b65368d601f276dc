"""The stages in order against plain Python, and their contract."""

from collections import defaultdict

import brute

import corpus_pipeline
from marketlens.llm import language_id, ngram_join, packing, secret_scan


def test_pipeline_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(c.isalpha() for c in t)]
    copies = brute.near_copies(docs)
    docs = [(i, t) for i, t in docs if copies[i][3]]
    hits = brute.contamination(docs, bench)
    docs = [(i, t) for i, t in docs if not hits[i][1]]
    masked = {}
    for i, t in docs:
        spans, out, at = brute.base_secrets(t), "", 0
        for a, _, b in spans:
            if a >= at:
                out += t[at:a] + ("" if out.endswith(secret_scan.MASK) and a == at else secret_scan.MASK)
            at = max(at, b)
        masked[i] = out + t[at:]
    from test_models import check_packing

    rows = corpus_pipeline.run(spark, small).collect()
    check_packing(rows, masked, 2048)
    by = defaultdict(int)
    for r in rows:
        by[r["doc_id"]] += 1
    assert by.keys() == masked.keys()


def test_stages_keep_the_columns_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_survive_nulls_and_empty_tables(spark, documents, small):
    rows = [(1, None), (2, ""), (3, "12 34"), (4, "some words of a text"), (4, "some words of a text"), (None, "other words of another text"), (5, "e" * 200_000)]
    for table in (documents(rows), documents([])):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, small).collect()


def test_language_stage_without_any_language(spark, documents, small):
    rows = [(1, None, None), (2, "", None), (3, "12 34", None), (4, "some words", None), (5, "漢字", None), (None, "other words", None)]
    kept = corpus_pipeline.identify_language(spark, documents(rows), small)
    assert {r["doc_id"] for r in kept.collect()} == {4, 5, None}


def test_language_stage_drops_what_the_model_does_not_know(spark, documents, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    foreign = {1001: "漢字文章的內容與其他語言不同" * 20, 1002: "Это обычный русский текст о погоде и о книгах. " * 5, 1003: "��ÿþ þÿþ ÿÿþ" * 9}
    more = documents([(i, t, None) for i, t in foreign.items()])
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), small).collect()}
    assert kept == {r["doc_id"] for r in docs.filter("text rlike '\\\\p{L}'").collect()}


def test_white_space_in_millions_passes(spark, documents, small):
    texts = {1: "word" + " " * 2_000_000 + "end of it", 2: "\n" * 2_000_000 + "one", 3: "some other words here"}
    docs = documents(list(texts.items()))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert {r["doc_id"] for r in docs.collect()} == {1, 2, 3}


def test_python_gets_small_batches(spark, documents, small, monkeypatch, tmp_path):
    folder = str(tmp_path)

    def noting(make, name):
        def made(*args):
            run = make(*args)

            def noted(batches):
                def seen():
                    for batch in batches:
                        with open(f"{folder}/{name}", "a") as out:
                            out.write(f"{batch.nbytes}\n")
                        yield batch

                yield from run(seen())

            return noted

        return made

    steps = [(language_id, "_predicted"), (ngram_join, "_signatures"), (ngram_join, "_sets"), (ngram_join, "_compare"), (packing, "_tokenised")]
    for module, name in steps:
        monkeypatch.setattr(module, name, noting(getattr(module, name), name))
    body = lambda i: " ".join(f"word{i}x{j}" for j in range(350))
    table = documents([(2 * i + k, body(i) + " more" * k) for i in range(1500) for k in range(2)])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    kept = corpus_pipeline.drop_near_copies(spark, corpus_pipeline.identify_language(spark, table, small), small)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == set(range(0, 3000, 2))
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, table, small).collect()} == set(range(3000))
    for _, name in steps:
        sizes = [int(n) for n in (tmp_path / name).read_text().split()]
        assert max(sizes) < 3 << 20 and sum(sizes) > 6 << 20, name
    assert spark.conf.get(key, None) == before
