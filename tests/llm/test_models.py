"""Tokens and packing against the tokenizers library; the learned models by held-out accuracy."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketlens.llm import bpe, entry, language_id, packing, quality, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def awkward_texts():
    rng = random.Random(1)
    signs = [*"aaabbb  \n\t'sSt12.,;é  漢字🙂ß", "́", "\x1c", "\x85", "<|endoftext|>", "<|endof", "'ll", "   ", "\u0558", "\u088f", "aaaa", "====", "​"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*out, "", " ", "a" * 3000, "=-" * 2000, " " * 500, "x" * 50000, "\n" * 99, "".join(rng.choice("abcdefghij") for _ in range(8000))]


def test_counts_and_ids_equal_the_library():
    texts = awkward_texts()
    want = [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]
    assert [sum(v) for v in bpe.count_units(PATH).values(texts)] == [len(w) for w in want]
    encode = bpe.encoder(PATH)
    assert [encode(t).tolist() for t in texts] == want


def test_ids_agree_on_every_code_point():
    encode, points = bpe.encoder(PATH), [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{chr(c)}1 {chr(c)}\n" for c in points[i : i + 2048]) for i in range(0, len(points), 2048)]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids


def test_units_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_UNITS", 50)
    units = bpe.Units((), lambda new: [len(u) for u in new], {})
    for _ in range(3):
        texts = awkward_texts()[:200]
        assert [sum(v) for v in units.values(texts)] == [len(t) for t in texts]


def test_op7(spark, documents, small):
    texts = [None, *awkward_texts()[-300:], "a b", "a b"]
    got = token_counts.count(documents([(i, t) for i, t in enumerate(texts)], "id n_tokens"), PATH, limit=20).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        n = len(LIBRARY.encode(t, add_special_tokens=False).ids)
        assert tuple(r) == (r["doc_id"], len(t.encode()), n, n > 20)
    assert len(got) == len(texts) and token_counts.count(documents([]), PATH).collect() == []
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in entry.op7_token_counts(spark, small).collect():
        assert r["n_tokens"] == len(LIBRARY.encode(docs[r["doc_id"]], add_special_tokens=False).ids)


def check_packing(rows, texts, limit):
    pieces, sequences, bad = defaultdict(list), defaultdict(list), []
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        own, at = sorted(pieces[doc], key=lambda r: r["piece"]), 0
        for k, r in enumerate(own):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            if (r["piece"], r["start"], r["ids_crc32"]) != (k, at, zlib.crc32(part)) or (k and r["length"] != limit) or r["length"] < 1:
                bad.append(r)
            at += r["length"]
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            if r["offset"] != at:
                bad.append(r)
            at += r["length"]
        assert at <= limit
    assert not bad
    return len(sequences)


def test_op10(spark, documents, small):
    texts = dict(enumerate([None, "", "word " * 9, "w" * 99, *awkward_texts()[:300], "one two three " * 40]))
    rows = packing.pack(documents(list(texts.items()), "id piece task"), PATH, limit=32).collect()
    n = check_packing(rows, texts, 32)
    counts = Counter(r["length"] for r in rows)
    assert n <= packing.lower_bound(counts, 32) + 1
    assert packing.pack(documents([]), PATH).collect() == []
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = entry.op10_best_fit_packing(spark, small).collect()
    assert check_packing(rows, docs, 2048) == packing.lower_bound(Counter(r["length"] for r in rows), 2048)


def test_op10_repeated_rows(spark, documents):
    rows = packing.pack(documents([(1, "a b c")] * 5 + [(None, "x")]), PATH, limit=8).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def smallest(lengths, limit):
    """The fewest bins, by trying everything."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + lengths[i] <= limit}.values():
            place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(60):
        limit = rng.choice([10, 20, 50])
        lengths = sorted((rng.randint(1, limit) for _ in range(rng.randint(1, 11))), reverse=True)
        plan = packing.bin_completion(dict(Counter(lengths)), limit)
        assert Counter(x for t, p in plan for x, c in p for _ in range(t * c)) == Counter(lengths)
        assert all(sum(x * c for x, c in p) <= limit for _, p in plan)
        assert sum(t for t, _ in plan) == smallest(lengths, limit)


def test_bin_completion_tries_fillings_of_lower_sums():
    plan = packing.bin_completion(dict.fromkeys([57, 53, 37, 36, 34, 32, 29, 13], 1), 100)
    assert sum(t for t, _ in plan) == 3
    plan = packing.bin_completion({57: 2, 53: 2, 37: 2, 36: 2, 34: 2, 32: 2, 29: 2, 13: 2}, 100)
    assert sum(t for t, _ in plan) == packing.lower_bound({57: 2, 53: 2, 37: 2, 36: 2, 34: 2, 32: 2, 29: 2, 13: 2}, 100) == 6


def test_bin_completion_beats_best_fit():
    counts = {8: 100, 5: 100, 4: 200, 3: 100}  # best fit joins 5 + 5 and 4 + 4 + 4 first
    plan = packing.bin_completion(counts, 16)
    found, greedy = (sum(t for t, _ in p) for p in (plan, packing.best_fit(counts, 16)))
    assert packing.lower_bound(counts, 16) <= found <= greedy
    assert packing.bin_completion({}, 10) == []


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_op8_held_out_accuracy(spark, larger):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{larger}/documents.parquet").collect()}
    got = entry.op8_language_id(spark, larger).collect()
    assert len(got) == len(truth) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98


def test_op8_edge_cases(spark, documents):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(20))
    docs = [(i, make("abcdef"), "aa") for i in range(40)] + [(100 + i, make("uvwxyz漢字"), "zz") for i in range(40)]
    docs += [(200, None, "aa"), (201, "", "aa"), (202, "12 !?", "aa"), (203, make("abc"), None), (204, "a", "aa"), (None, make("uvw"), "zz"), (205, make("abcdef") * 4000, "aa"), (203, make("abc"), None)]
    table = documents(docs, "kept score lang_pred")
    model = language_id.learn(table)
    got = language_id.predict(table, model, keep=("doc_id", "score")).select("kept.doc_id", "lang_pred", "score").collect()
    assert len(got) == len(docs)
    pred = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [pred[i] for i in (200, 201, 202, 203, None, 205)] == ["und", "und", "und", "aa", "zz", "aa"]
    assert all(pred[i] == lang for i, _, lang in docs[:80])
    nothing = language_id.learn(table.filter("lang = 'none'"))
    assert nothing is None
    assert {(r["lang_pred"], r["score"]) for r in language_id.predict(table, nothing, keep=("doc_id",)).collect()} == {("und", 0.0)}
    assert language_id.predict(table.limit(0), model, keep=("doc_id",)).collect() == []


def test_op8_learns_from_copies_and_long_texts(spark, documents):
    docs = [(i, f"plain text {i}", "aa") for i in range(30)] + [(i, "the same text", "bb") for i in range(3000)]
    docs += [(i, f"another text {i}", "bb") for i in range(12)] + [(i, f"{i} of a longer text than the others, " * 2, "cc") for i in range(14)]
    docs += [(1, "few words", "dd"), (2, "a text of more letters than that " * 2, "dd"), (3, "a text of more letters than that, and " * 9, "dd")]
    texts, languages = language_id.training_sample(documents(docs), per_language=10, longest=25)
    assert Counter(languages) == {"aa": 10, "bb": 10, "cc": 10, "dd": 3}
    assert len(set(texts)) == len(texts)


def test_op9_held_out_accuracy(spark, larger):
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    got = entry.op9_quality_classifier(spark, larger).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.93


def test_op9_edge_cases(spark, documents):
    good = [(i, f"A plain sentence, number {i}, about nothing. " * (i % 5 + 1)) for i in range(60)]
    bad = [(100 + i, f"BUY!! NOW!! ### {i} | | |" * (i % 5 + 1)) for i in range(60)]
    docs = good + bad + [(300, None), (301, ""), (302, "x" * 2_000_000), (None, "hm"), (1, good[1][1])]
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(1, 1, 0), (7, None, 0), (8, 5, 0), (None, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.classify(documents(docs, "id stats score"), frame).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    score = {r["doc_id"]: r["score"] for r in got}
    assert min(score[i] for i, _ in good) > max(score[i] for i, _ in bad)
    assert {r["score"] for r in quality.classify(documents(docs), frame.limit(0)).collect()} == {0.5}
    assert quality.classify(documents([]), frame).collect() == []


def test_statistics_by_hand():
    text = "Ab ab, AB!\ncd #1|é"
    s = dict(zip(quality.STATISTICS, quality.statistics(pa.array([text, None, ""]))[0].tolist(), strict=True))
    n = len(text.encode())
    assert s["upper"] == pytest.approx(3 / n) and s["loud"] == pytest.approx(1 / n) and s["sign"] == pytest.approx(1 / n)
    assert s["different_words"] == pytest.approx(4 / 6) and s["word_repeats"] == pytest.approx(2 / 6) and s["commonest_word"] == pytest.approx(3 / 6)
    assert not quality.statistics(pa.array([text, None, ""]))[1:].any()


SPACES = (" ", "\t", "\n", " ", " \n")


def test_long_runs_of_white_space_equal_the_library():
    encode, units = bpe.encoder(PATH), bpe.count_units(PATH)
    forms = ("{}", "x{}y", "{}end", "\n{}<|endoftext|>", "a b{}", "x{}y{}\tz ")
    least = bpe.LONGEST_SPACE
    texts = [form.format(*[space * n] * 2) for space in SPACES for form in forms for n in (least // len(space) - 1, least // len(space), least + 7)]
    texts += ["".join(f"w{i}" + " " * (least + i % 3) for i in range(5)), "x" + " \t\n　" * least + "y" * least]
    for text, want in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == want.ids
        assert sum(units.values([text])[0]) == len(want.ids)


def test_op7_and_op10_with_millions_of_white_space(spark, documents):
    texts = {i: form.format(space * (2_000_000 // len(space))) for i, (space, form) in enumerate([*zip(SPACES, ("{}", "x{}y", "{}end", "a{}", "x {}\ty"), strict=True)])}
    table = documents(list(texts.items()))
    rows = packing.pack(table, PATH).collect()
    want = {i: LIBRARY.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    for i, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        whole = np.array([*ids, 0], "<u4")
        assert [r["ids_crc32"] for r in own] == [zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes()) for r in own]
        assert sum(r["length"] for r in own) == len(whole)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count(table, PATH).collect()} == {i: len(ids) for i, ids in want.items()}


def test_op9_statistics_do_not_depend_on_the_batch(spark, documents):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "bb", "Cc!", "x"]) for _ in range(rng.randint(0, 6))) for _ in range(40_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    got = {}
    for out in quality._measured(iter([batch])):
        got.update(zip(out.column("id").to_pylist(), out.column("stats").to_pylist(), strict=True))
    single = {t: quality.statistics(pa.array([t]))[0].tolist() for t in set(texts)}
    assert all(got[i] == single[t] for i, t in enumerate(texts))
    with pytest.raises(ValueError, match="at most"):
        quality.statistics(pa.array(texts))


def grown(x, y, trees, depth):
    """Boosted trees one row and one cut at a time: scores of the rows."""
    n, width = len(x), len(x[0])
    mean = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    total = [float(np.log(mean / (1 - mean)))] * n
    cuts = [sorted({sorted(r[f] for r in x)[int(q * (n - 1))] for q in (np.arange(1, quality.BINS) / quality.BINS)}) for f in range(width)]
    for _ in range(trees):
        p = [1 / (1 + np.exp(-t)) for t in total]
        grad, hess = [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]
        nodes = [list(range(n))]
        for _ in range(depth):
            below = []
            for rows in nodes:
                g, h, best = sum(grad[i] for i in rows), sum(hess[i] for i in rows), (1e-9, None, None)
                for f in range(width):
                    for cut in cuts[f]:
                        left = [i for i in rows if x[i][f] <= cut]
                        gl, hl = sum(grad[i] for i in left), sum(hess[i] for i in left)
                        if min(hl, h - hl) < quality.LEAST * 0.05:
                            continue
                        gain = gl**2 / (hl + quality.PENALTY) + (g - gl) ** 2 / (h - hl + quality.PENALTY) - g**2 / (h + quality.PENALTY)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, cut)
                _, f, cut = best
                below += [[i for i in rows if f is None or x[i][f] <= cut], [i for i in rows if f is not None and x[i][f] > cut]]
            nodes = below
        for rows in nodes:
            leaf = -quality.RATE * sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + quality.PENALTY)
            for i in rows:
                total[i] += leaf
    return [1 / (1 + np.exp(-t)) for t in total]


def test_op9_trees_equal_plain_boosting():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=60) * 0.3 > 0.3).astype(float)
    got = quality.fit(x, y, trees=6, depth=2).score(x)
    assert np.allclose(got, grown(x.tolist(), y.tolist(), 6, 2), atol=1e-9)


def test_op8_model_equals_plain_ridge_regression():
    rng = random.Random(11)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(2, 8)))
    texts = [make("abcde") for _ in range(14)] + [make("cdefg") for _ in range(14)] + [make("efghé漢") for _ in range(12)]
    langs = ["aa"] * 14 + ["bb"] * 14 + ["cc"] * 12
    marks, ridge, names = 9, 1e-2, ["aa", "bb", "cc"]

    def grams(text):  # what is no letter is one sign; fewer than 190 letters, so each has a number of its own
        t = "".join(c if c.isalpha() else " " for c in text.lower())
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    order = sorted(range(len(texts)), key=lambda i: (sum(langs[j] == langs[i] for j in range(i)), i))[:marks]
    vocabulary = set().union(*(grams(texts[i]) for i in order))

    def kernel(a, b):
        a, b = grams(a) & vocabulary, grams(b) & vocabulary
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    k = np.array([[kernel(t, texts[i]) for i in order] for t in texts])
    values, vectors = np.linalg.eigh(k[order])
    half = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    y, weight = np.eye(3)[[names.index(x) for x in langs]], np.array([1 / langs.count(x) for x in langs])
    phi = k @ half
    a, b = phi - phi.mean(0), y - y.mean(0)
    w = np.linalg.inv(a.T @ (a * weight[:, None]) + ridge * np.eye(a.shape[1])) @ a.T @ (b * weight[:, None])
    tests = [*texts, make("abcd"), make("gh"), "漢 é", "zzz"]
    want = (np.array([[kernel(t, texts[i]) for i in order] for t in tests]) @ half - phi.mean(0)) @ w + y.mean(0)
    best, score, known, _ = language_id.fit(texts, langs, landmarks=marks, ridge=ridge).scorer()(tests)
    assert (best == want.argmax(1)).all() and np.allclose(score, np.clip(want.max(1), 0, 1), atol=1e-4) and known.all()


def test_op8_ties_between_languages():
    texts = ["same text"] * 2
    best, score, _, _ = language_id.fit(texts, ["zz", "aa"]).scorer()(["same text", "other"])
    assert best.tolist() == [0, 0] and np.allclose(score, 0.5)  # the first name of equals


@pytest.mark.parametrize(("low", "high", "n", "most"), [(500, 1000, 4000, 1530), (300, 1100, 50_000, 17_480)])
def test_packing_of_many_lengths_beats_best_fit(low, high, n, most):
    random.seed(0)
    counts = Counter(random.randint(low, high) for _ in range(n))
    plan = packing.bin_completion(counts, 2048, nodes=300)
    used = Counter()
    for times, pattern in plan:
        assert sum(x * c for x, c in pattern) <= 2048
        used.update({x: times * c for x, c in pattern})
    assert used == counts
    assert sum(t for t, _ in plan) <= most < sum(t for t, _ in packing.best_fit(counts, 2048))


def test_small_side_packs_every_piece_once():
    rng = random.Random(12)
    for _ in range(200):
        limit = rng.choice([10, 31, 100])
        counts = Counter(rng.randint(1, limit) for _ in range(rng.randint(1, 40)))
        plan = packing.small_side(counts, limit, rng.randint(0, limit))
        used = Counter()
        for times, pattern in plan:
            assert sum(x * c for x, c in pattern) <= limit
            used.update({x: times * c for x, c in pattern})
        assert used == counts
