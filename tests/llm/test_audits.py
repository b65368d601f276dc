"""Licences, vector codes and source divergence against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from compare import differences, duck

from marketlens.llm import divergence, license_scan, sql, vector_codes

VECTOR = "vec_id bigint, embedding array<double>, label int, code int, id int, vector string"


def licences(text):
    """(n_words, n_base, first, last, base labels, labels, score) by looking at every word."""
    w, slack = brute.words(text), license_scan.SLACK
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    holders = Counter(x for _, sentence, _ in license_scan.TEMPLATES for x in set(sentence.split()))
    stands = lambda phrase, at: at >= 0 and w[at : at + len(phrase)] == phrase
    for label, sentence, keys in license_scan.TEMPLATES:
        t = sentence.split()
        keys = [(next(i for i in range(len(t)) if t[i : i + len(k.split())] == k.split()), k.split()) for k in keys]
        _, spot, rare = min((holders[x], at + i, x) for at, k in keys for i, x in enumerate(k))
        for p in (i for i, x in enumerate(w) if x == rare):
            o = p - spot
            if not all(any(stands(k, o + at + d) for d in range(-slack, slack + 1)) for at, k in keys):
                continue
            share = sum(t[i] in w[max(0, o + i - slack) : max(0, o + i + slack + 1)] for i in range(len(t))) / len(t)
            if share >= license_scan.SHARE:
                labels.add(label)
                score = max(score, share)
    at = [i for i, _ in places]
    join = lambda x: ",".join(sorted(x))
    return len(w), len(places), min(at, default=None), max(at, default=None), join({x for _, x in places}), join(labels), score


def licensed_texts():
    rng = random.Random(3)
    noise = lambda n: " ".join(rng.choice(["the", "license", "software", "of", "words", "public", "Free", "general"]) for _ in range(n))
    texts = [None, "", "   ", "CC-BY 4.0; cc by", "GNU General\n# Public License", "MIT  License mit license", "mit", "Apache-License"]
    for _, sentence, _ in license_scan.TEMPLATES:
        words = sentence.split()
        texts += [sentence, " * ".join(words).upper(), f"{noise(50)} {sentence}, {noise(20)} {sentence}"]
        for _ in range(6):  # words left out, put in or changed
            bent = [x for x in words if rng.random() > 0.08]
            bent = [y for x in bent for y in ([x, "more"] if rng.random() < 0.08 else [x])]
            texts.append(f"{noise(rng.randint(0, 4))} {' '.join(bent)} {noise(3)}")
        texts += [" ".join(words[len(words) // 2 :]), " ".join(words[: len(words) // 2]), " ".join(words[3:])]
    return [*texts, noise(200_000) + " " + license_scan.TEMPLATES[0][1], "MIT License", "x" * 1_000_000]


def test_op11_against_plain_python(spark, documents):
    texts = licensed_texts()
    got = license_scan.scan(documents([(i, t) for i, t in enumerate(texts)], "id labels score")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == licences(texts[r["doc_id"]]), texts[r["doc_id"]][:300]
    found = {label for r in got for label in r["labels"].split(",")}
    assert {label for label, _, _ in license_scan.TEMPLATES} <= found


def test_op11_small_batches_nulls_and_empty(spark, documents):
    docs = documents([(None, "mit license")] * 3 + [(1, "mit"), (2, "license")])
    got = license_scan.scan(docs.repartition(1)).collect()
    assert sorted((str(r["doc_id"]), r["n_base"]) for r in got) == [("1", 0), ("2", 0), ("None", 1), ("None", 1), ("None", 1)]
    assert license_scan.scan(documents([])).collect() == []


def table(spark, name, df, folder, monkeypatch):
    """A DuckDB connection in which a table is the given one."""
    con = duck(folder)
    con.register("given", df.toArrow())
    con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM given")
    return con


def test_op11_sql_on_awkward_texts(spark, documents, small, monkeypatch):
    df = documents([(i, t) for i, t in enumerate(licensed_texts()) if not t or len(t) < 100_000])
    assert differences(license_scan.scan(df), table(spark, "documents", df, small, monkeypatch), sql.LICENSES) == []


def codes(rows, parts=16, entries=64, rounds=2):
    """{place: (code, error, label_error, digest)} in whole numbers, by comparing with every entry."""
    whole = lambda x: math.floor(x * 256) if abs(x) < 2**53 else int(x) * 256
    kept = [(i, [whole(x) for x in v], label, at) for at, (i, v, label) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, errors = {}, defaultdict(int)
    for length in {len(v) for _, v, _, _ in kept}:
        own = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0], rows[r[3]][1]))
        size, longer = divmod(length, parts)
        cuts = [k * size + min(k, longer) for k in range(parts + 1)]
        books = [[r[1][cuts[k] : cuts[k + 1]] for r in own[:entries]] for k in range(parts)]

        def assign(v):
            found = []
            for k in range(parts):
                x = v[cuts[k] : cuts[k + 1]]
                found.append(min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[k])))
            return found

        for _ in range(rounds):
            members = defaultdict(list)
            for _, v, _, _ in own:
                for k, (_, e) in enumerate(assign(v)):
                    members[k, e].append(v[cuts[k] : cuts[k + 1]])
            for (k, e), xs in members.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        digest = brute.sha256(",".join(str(x) for book in books for c in book for x in c))
        for _, v, label, at in own:
            found = assign(v)
            error = sum(d for d, _ in found)
            errors[label] += error
            out[at] = ("".join(f"{e:02x}" for _, e in found), error, label, digest)
    top = 2**63 - 1
    return {at: (code, min(error, top), errors[label] if errors[label] <= top else top, digest) for at, (code, error, label, digest) in out.items()}


def compressed(spark, rows):
    df = spark.createDataFrame([(i, v, label, 1, 2, "clash") for i, v, label in rows], VECTOR).repartition(3)
    return Counter(tuple(r) for r in vector_codes.compress(df).collect())


@pytest.mark.parametrize("length", [32, 16, 19, 5])
def test_op12_against_plain_python(spark, length):
    rng = random.Random(length)
    vector = lambda: [float(np.float32(rng.gauss(0, 0.05))) if rng.random() < 0.9 else rng.choice([0.0, 0.25, -0.25]) for _ in range(length)]
    rows = [(i, vector(), rng.choice([0, 1, None])) for i in rng.sample(range(1000), 220)]
    rows += [rows[0]] * 3 + [(None, vector(), 1), (-5, [0.0] * length, 1), (2000, [0.0] * length, 1), (3, None, 1), (4, [float("nan")] * length, 1)]
    rows += [(5, [None] * length, 1), (6, [float("inf")] * length, 2), (7, [-1 / 256] * length, 0), (8, [-1e-300] * length, 0)]
    want = codes(rows)
    assert compressed(spark, rows) == Counter((rows[at][0], *found) for at, found in want.items())


def test_op12_few_rows_several_lengths_and_any_size(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.75] * 16, 1), (2, [0.25] * 16, None), (3, [], None), (4, [], 7), (5, [1.0, 2.0], 1)]
    want = codes(rows)
    assert compressed(spark, rows) == Counter((rows[at][0], *found) for at, found in want.items())
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e30, -3e38, 12345.678, 7e15, 0.1]) * rng.random() for _ in range(16)], i % 2) for i in range(90)]
    rows += [(100 + i, [1.0 * i] * 16, 5) for i in range(9)]
    want = codes(rows)
    assert compressed(spark, rows) == Counter((rows[at][0], *found) for at, found in want.items())
    assert compressed(spark, []) == compressed(spark, [(1, None, 1)]) == Counter()


def test_op12_search_equals_all_distances():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 200):
        parts, entries = rng.integers(-spread, spread + 1, (3000, 4)), rng.integers(-spread, spread + 1, (64, 4))
        far = ((parts[:, None] - entries[None]) ** 2).sum(2)
        index, best = vector_codes.nearest(parts, entries)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


def audited(rows):
    """{(lang, source, part, item): (value, rank)}"""
    least, out = divergence.LEAST_DOCUMENTS, {}
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", Counter(term.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))) for lang, source, text in rows]
    for lang in {d[0] for d in docs}:
        held = Counter(t for a, _, words in docs if a == lang for t in words)
        kept = {t for t, n in held.items() if n >= least}
        counts = defaultdict(Counter)
        for a, source, words in docs:
            if a == lang:
                counts[source].update({t: n for t, n in words.items() if t in kept})
        whole = sum(counts.values(), Counter())
        rate = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for source, own in counts.items():
            pairs = [(other, sum(f(rate(own, t), rate(c, t)) for t in kept)) for other, c in counts.items() if other != source]
            terms = [(t, f(rate(own, t), rate(whole, t))) for t in kept if own[t] and rate(own, t) > rate(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out[lang, source, part, item] = (value, rank + 1)
    return out


def divergent(spark, rows):
    full = [(i, t, lang, source, 1, "clash") for i, (lang, source, t) in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, term int, kept string").repartition(4)
    got = divergence.audit(df).collect()
    out = {(r["lang"], r["source"], r["part"], r["item"]): (r["value"], r["rank"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def sources():
    rng = random.Random(9)
    words = ["alpha", "Beta", "gamma9delta", "É", "漢字", "z", "don't", "aa_bb", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for _ in range(400):
        lang, source = rng.choice(["en", "en", "fr", None, "xx"]), rng.choice(["a", "a", "b", "É", None, "c"])
        pick = words[: rng.randint(2, len(words))]
        rows.append((lang, source, " ".join(rng.choice(pick) for _ in range(rng.randint(0, 40)))))
    rows += [("en", "only copies", "alpha beta " * 50)] * 12 + [("en", "silent", None), ("en", "silent", "12 34"), ("de", "lone", "few words"), ("it", "a", "rare"), ("it", "b", None), ("fr", "a", "alpha " * 20_000)]
    return rows


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_op13_against_plain_python(spark, monkeypatch, sources, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    assert divergent(spark, sources) == audited(sources)


def test_op13_counts_in_parts_and_empty(spark, sources):
    assert divergent(spark, []) == {}
    assert divergent(spark, [(None, None, None)]) == {}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([x or "" for x in col]) if k < 2 else pa.array([(x or "").encode() for x in col], pa.binary()) for k, col in enumerate(zip(*sources, strict=True))], names=["lang", "source", "text"])
    totals = []
    for held in (10, 1 << 30):
        old, divergence.HELD_TERMS = divergence.HELD_TERMS, held
        try:
            rows = Counter()
            for b in divergence._counted(iter([batch])):
                for r in b.to_pylist():
                    rows[r["lang"], r["source"], r["term"]] += r["n"] + 1j * r["docs"]
            totals.append(rows)
        finally:
            divergence.HELD_TERMS = old
    assert totals[0] == totals[1] and sum(totals[0].values()).real == sum(len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, _, t in sources)


def test_op13_rates_are_exact():
    rng = random.Random(4)
    counts = [0, 1, 10**15, *(rng.randrange(10**15) for _ in range(500))]
    for c in counts:
        total = c + 2 + rng.randrange(10**15)
        assert divergence._rate(np.array([c]), np.array([total]))[0] == 1 + 10**9 * (c + 2) // total


def test_digest_of_codes_on_the_tables(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = codes(rows)
    got = vector_codes.compress(spark.read.parquet(f"{small}/embeddings.parquet")).collect()
    assert Counter(map(tuple, got)) == Counter((rows[at][0], *found) for at, found in want.items())
    assert all(len(r["codebooks_sha256"]) == len(hashlib.sha256().hexdigest()) for r in got)
