"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts is the cosine of their blended spectra: which n-grams of one to three letters
occur, however often. A text's letters are numbered by frequency among the landmarks
(rarer ones share numbers by their script), anything between them is one boundary sign. Landmarks are
texts of the training sample; the kernel against them is one matrix product, the Nyström features follow
from their own kernel matrix, and one ridge regression per language is solved on them.
A prediction is linear in the presence of n-grams, so the landmarks' matrix and the coefficients are
multiplied once, and a batch of texts is scored by one product of its presence matrix.

Learning takes a bounded sample, ``PER_LANGUAGE`` different texts of 1 to ``LONGEST`` letters of each language
(the number of languages is taken to be small), chosen by a hash; a language with fewer such texts fills up
with its shortest longer ones, in whole. Every text is predicted in whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with nothing
to learn from every text is; rows without a language are not learned from; a null id is
neither held out nor learned from; repeated rows get the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import broadcast_if_small, ship, small_batches, stored

PER_LANGUAGE, LONGEST, LANDMARKS, RIDGE = 300, 20_000, 240, 1e-2
BATCH_TEXTS, BATCH_LETTERS = 64, 1 << 19
BROADCAST_TEXTS = 500_000
FOLDS, HELD_OUT = 5, 0
OWN, SHARED = 190, 64  # numbers of frequent letters, numbers that rarer ones share; 1 is the boundary
UNKNOWN = "und"
FAMILIAR = 0.25


@cache
def _letters() -> np.ndarray:
    """For every code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.array([len(t) for t in low], np.int64)


def _numbering(frequent: np.ndarray) -> np.ndarray:
    """Number of each code point: 1 between letters, then the frequent letters, then shared numbers by block."""
    points = np.arange(0x110000, dtype=np.uint64)
    shared = (OWN + 2 + (points >> np.uint64(7)) * np.uint64(0x9E3779B1) % np.uint64(SHARED)).astype(np.uint8)
    out = np.where(_letters(), shared, np.uint8(1))
    out[frequent] = np.arange(2, 2 + len(frequent), dtype=np.uint8)
    return out


def _grams(codes: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, n-gram number) of all 1-, 2- and 3-grams; the length is part of the number."""
    text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    wide = codes.astype(np.int32)
    yield text, wide
    two = wide[:-1] << 8 | wide[1:]
    same = text[:-1] == text[1:]
    yield text[:-1][same], two[same]
    three = two[:-1] << 8 | wide[2:]
    same = text[:-2] == text[2:]
    yield text[:-2][same], three[same]


class Model:
    """Languages, numbering of letters, vocabulary of n-grams and one weight per n-gram and language."""

    def __init__(self, languages: list[str], frequent: np.ndarray, vocabulary: np.ndarray, weights: np.ndarray):
        self.languages, self.frequent, self.vocabulary, self.weights = languages, frequent, vocabulary, weights

    def scorer(self):
        numbers = _numbering(self.frequent)
        index = np.zeros(1 << 24, np.int32 if len(self.vocabulary) > 65_000 else np.uint16)
        index[self.vocabulary] = np.arange(1, len(self.vocabulary) + 1)

        def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The best language, its score, whether there is a letter, and the share of n-grams that the model knows."""
            points, lengths = _points(texts)
            codes = numbers[points]
            presence = np.zeros((len(texts), len(self.vocabulary) + 1), np.float32)
            familiar, grams = np.zeros(len(texts)), np.zeros(len(texts))
            for text, gram in _grams(codes, lengths):
                at = index[gram]
                presence[text, at] = 1
                familiar += np.bincount(text, at > 0, len(texts))
                grams += np.bincount(text, minlength=len(texts))
            presence = presence[:, 1:]
            norm = np.sqrt(np.maximum(presence.sum(1), 1))
            values = presence @ self.weights[:-1] / norm[:, None] + self.weights[-1]
            known = np.bincount(np.repeat(np.arange(len(texts)), lengths), weights=codes > 1, minlength=len(texts)) > 0
            return values.argmax(1), np.clip(values.max(1), 0, 1), known, familiar / np.maximum(grams, 1)

        return score


#: Tells texts with a letter from texts without one, and nothing else.
UNLEARNED = Model([""], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros((1, 1), np.float32))


def fit(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """The model of labelled texts; None without any."""
    names = sorted(set(languages))
    if not names:
        return None
    points, lengths = _points(texts)
    letters = points[_letters()[points]]
    seen, often = np.unique(letters, return_counts=True)
    frequent = seen[np.lexsort((seen, -often))[:OWN]]
    codes = np.split(_numbering(frequent)[points], np.cumsum(lengths)[:-1])
    own = [np.unique(np.concatenate([g for _, g in _grams(c, np.array([len(c)]))])) for c in codes]
    y = np.array([names.index(x) for x in languages])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    marks = np.lexsort((np.arange(len(y)), turn))[:landmarks]  # in turn from each language
    vocabulary = np.unique(np.concatenate([own[i] for i in marks]))

    def unit(rows: list[int]) -> np.ndarray:
        out = np.zeros((len(rows), len(vocabulary)), np.float32)
        for row, i in enumerate(rows):
            out[row, np.flatnonzero(np.isin(vocabulary, own[i], assume_unique=True))] = 1
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    basis = unit(list(marks))
    kernel = np.vstack([unit(range(i, min(i + 100, len(y)))) @ basis.T for i in range(0, len(y), 100)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[marks])
    use = values > 1e-6 * max(values.max(), 1e-12)
    half = vectors[:, use] / np.sqrt(values[use])
    features = kernel @ half
    targets = np.eye(len(names))[y]
    centre, mean = features.mean(0), targets.mean(0)
    a = features - centre
    share = np.sqrt(1 / np.bincount(y, minlength=len(names))[y])[:, None]  # languages count alike
    solved = np.linalg.solve((a * share).T @ (a * share) + ridge * np.eye(a.shape[1]), (a * share).T @ ((targets - mean) * share))
    dual = half @ solved
    weights = np.vstack([basis.T @ dual, mean - centre @ solved]).astype(np.float32)
    return Model(names, frequent, vocabulary, weights)


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> tuple[list[str], list[str]]:
    """Different texts and their languages, at most so many of each language, by a hash of the text."""
    known = docs.filter(F.col("lang").isNotNull() & (F.char_length("text") >= 1))
    texts = known.select("lang", F.xxhash64("text").alias("hash"), F.char_length("text").alias("letters")).distinct()
    short = F.col("letters") <= longest
    found = texts.groupBy("lang").agg(F.count_if(short).alias("n"), F.count_if(~short).alias("longer")).collect()
    counts = {r["lang"]: r["n"] for r in found if r["n"]}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_language / n))).otherwise(share)
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    some = known.filter((F.char_length("text") <= longest) & (spread < share * (1 << 30)))
    rows = some.select("lang", "text", spread.alias("at")).distinct().limit(2 * per_language * max(len(counts), 1)).collect()
    wanting = [r["lang"] for r in found if r["n"] < per_language and r["longer"]]
    if wanting:
        order = Window.partitionBy("lang").orderBy("letters", "hash")
        more = texts.filter(~short & F.col("lang").isin(wanting)).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_language).collect()
        need = {r["lang"]: per_language - r["n"] for r in found}
        picked = [r["hash"] for r in more if r["nth"] <= need[r["lang"]]]
        longer = known.filter((F.char_length("text") > longest) & F.col("lang").isin(wanting) & F.xxhash64("text").isin(picked))
        rows += longer.select("lang", "text", spread.alias("at")).distinct().collect()
    taken: dict[str, list[tuple]] = {}
    for r in sorted(rows, key=lambda r: (len(r["text"]) > longest, r["at"], r["text"], r["lang"])):
        if len(own := taken.setdefault(r["lang"], [])) < per_language:
            own.append((r["text"], r["lang"]))
    flat = [x for lang in sorted(taken) for x in taken[lang]]
    return [t for t, _ in flat], [lang for _, lang in flat]


def _predicted(model: Model | None, inside: int | None):
    """``inside`` is the place of the text among the columns kept, if it is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model else None
        for batch in batches:
            column = batch.column("text") if inside is None else batch.column("kept").field(inside)
            texts = ["" if t is None else t for t in column.to_pylist()]
            names, values, shares, at = [], [], [], 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and stop - at < BATCH_TEXTS and (size + len(texts[stop]) < BATCH_LETTERS or stop == at):
                    size += len(texts[stop])
                    stop += 1
                if score:
                    best, value, known, share = score(texts[at:stop])
                    shares.append(share)
                    names += [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    values.append(np.where(known, value, 0))
                else:
                    names += [UNKNOWN] * (stop - at)
                    values.append(np.zeros(stop - at))
                    shares.append(np.zeros(stop - at))
                at = stop
            numbers = [pa.array(np.concatenate(x or [np.zeros(0)]).astype(np.float64)) for x in (values, shares)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(names, pa.string()), *numbers], names=["kept", "lang_pred", "score", "familiar"])

    return run


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds)) == fold, F.lit(False))


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """A model of all rows that are not held out."""
    rows = docs.filter(F.col(doc_id).isNotNull() & ~held_out(doc_id, FOLDS, HELD_OUT))
    return fit(*training_sample(rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"))))


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """(kept, lang_pred, score, familiar): the columns ``keep`` as one, and the prediction from the text alone.

    ``familiar`` is the share of the text's n-grams that the model has learned from.
    """
    ship(docs.sparkSession)
    inside = keep.index(text) if text in keep else None
    given = docs.select(F.struct(*keep).alias("kept"), *([F.col(text).alias("text")] if inside is None else []))
    kind = given.schema["kept"].dataType.simpleString()
    return given.mapInArrow(_predicted(model, inside), f"kept {kind}, lang_pred string, score double, familiar double")


def drop_unknown(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents without those in none of the languages learned.

    These are texts that are null or have no letter (``und``), and texts of whose n-grams the model knows a share below
    ``FAMILIAR``: another script, or garbled characters. A short or repetitive text in a learned language is familiar
    all the same. Where there was nothing to learn from, only texts without a letter go.
    A language follows from the text alone: texts go to Python once and only their hashes come back;
    the different texts found ``und`` are matched by hash.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"), F.char_length(body).alias("n"))
    boxed = docs.select(key.alias("key"), F.struct(*docs.columns).alias("doc"), F.col(text).alias("text"))
    found = predict(boxed, model or UNLEARNED, keep=("key",))
    strange = F.col("familiar") < FAMILIAR if model else F.lit(False)
    found = found.filter((F.col("lang_pred") == UNKNOWN) | strange).select("kept.key").distinct()
    with small_batches(docs.sparkSession):
        found = stored(found.withColumnRenamed("key", "unknown"), "unknown-languages")
    found = broadcast_if_small(found, BROADCAST_TEXTS)
    return boxed.join(found, F.col("key") == F.col("unknown"), "left_anti").select("doc.*")
