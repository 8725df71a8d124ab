"""Language identification with blended-spectrum string kernels.

Two texts are compared by the character n-grams that are present in both, for
several lengths, each length normalised by the numbers of n-grams present:
``k(x, y) = mean over n of |P_n(x) & P_n(y)| / sqrt(|P_n(x)| |P_n(y)|)``.  The
kernel matrix is approximated from landmark texts (Nystroem), and one-versus-rest
kernel ridge regression is fitted on a bounded sample; scoring is a batched
product of presence matrices with the landmarks and then with the coefficients.
N-grams are those of UTF-8 bytes of the whole lower-cased text, hashed to a fixed
number of slots for each length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actaflow.llm.store import checkpoint

#: n-gram length -> log2 of its slots.
SPECTRUM = {2: 11, 3: 13, 4: 13}
SLOTS = sum(1 << b for b in SPECTRUM.values())
#: Bounds of the sample that the classifier is fitted on: texts a language, texts in all,
#: landmarks a language, landmarks in all.  With more languages each has fewer.
TRAIN_PER_LANG, TRAIN_TEXTS, LANDMARKS_PER_LANG, LANDMARKS = 800, 25_600, 16, 1024
#: Languages whose one-versus-rest columns are solved at once.
LANG_BLOCK = 64
RIDGE = 1e-2
UNKNOWN = "und"
#: A text of this many letters whose kernel with every landmark is below belongs to no known
#: language: those of unknown ones come to 0.04 to 0.08, those of known ones, however short,
#: to 0.14 and more.
UNCLAIMED, CLAIM_LETTERS = 0.09, 8
_BATCH = 128
#: ASCII controls, digits and punctuation count as a space.
_BLANKED = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def slots_of(text: str) -> list[np.ndarray]:
    """Hashed n-grams of the whole text, one array for each length."""
    b = np.frombuffer((" " + text.lower() + " ").encode("utf-8").translate(_BLANKED), np.uint8).astype(np.uint32)
    out, code = [], b
    for n in range(2, max(SPECTRUM) + 1):
        code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        if n in SPECTRUM:
            h = code ^ (code >> np.uint32(15))
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - SPECTRUM[n]))
    return out


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    m = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(m, texts):
        at = 0
        for n, slots in zip(SPECTRUM, slots_of(text)):
            row[at + slots] = 1
            at += 1 << SPECTRUM[n]
    return m


def normalise(m: np.ndarray) -> np.ndarray:
    at = 0
    for bits in SPECTRUM.values():
        block = m[:, at : at + (1 << bits)]
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1) * len(SPECTRUM))
        at += 1 << bits
    return m


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # packed presence bits
    coefficients: np.ndarray  # landmarks + 1 by languages

    def scorer(self):
        basis = normalise(np.unpackbits(self.landmarks, axis=1, count=SLOTS).astype(np.float32)).T.copy()

        def score(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Scores by language, and the largest kernel with a landmark."""
            k = normalise(m) @ basis
            return k @ self.coefficients[:-1] + self.coefficients[-1], k.max(axis=1)

        return score


def fit(langs: list[str], bits: np.ndarray) -> Model:
    """Kernel ridge regression on rows of packed presence bits, ordered by language."""
    names = sorted(set(langs))
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[x] for x in langs])
    each = max(1, min(LANDMARKS_PER_LANG, LANDMARKS // len(names)))
    nth = np.arange(len(y)) - np.searchsorted(y, y)  # rows of a language stand together
    chosen = np.flatnonzero(nth < each)
    if len(chosen) > LANDMARKS:  # more languages than landmarks: any of them, not the first of the alphabet
        chosen = np.sort(np.random.default_rng(LANDMARKS).permutation(chosen)[:LANDMARKS])
    dense = lambda rows: normalise(np.unpackbits(rows, axis=1, count=SLOTS).astype(np.float32))
    basis = dense(bits[chosen])
    values, vectors = np.linalg.eigh((basis @ basis.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    half = vectors[:, keep] / np.sqrt(values[keep])
    gram, n = 0.0, len(y)
    right = np.zeros((int(keep.sum()) + 1, len(names)))
    for i in range(0, n, 256):
        part = y[i : i + 256]
        phi = np.hstack([(dense(bits[i : i + 256]) @ basis.T).astype(np.float64) @ half, np.ones((len(part), 1))])
        gram = gram + phi.T @ phi
        # a target is 1 in its own column and -1 in all others
        right -= phi.sum(axis=0)[:, None]
        for k in np.unique(part):
            right[:, k] += 2 * phi[part == k].sum(axis=0)
    blocks = [right[:, k : k + LANG_BLOCK] for k in range(0, len(names), LANG_BLOCK)]
    w = np.hstack([np.linalg.solve(gram + RIDGE * np.eye(gram.shape[0]), b) for b in blocks])
    return Model(names, bits[chosen], np.vstack([half @ w[:-1], w[-1:]]).astype(np.float32))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = TRAIN_PER_LANG, texts: int = TRAIN_TEXTS) -> Model | None:
    """Fit on at most ``per_lang`` texts of each language and ``texts`` in all, those of
    the smallest hashes, among rows with a language and a letter that are not held out;
    None if there are none.  Any number of languages is learned, each from its share of
    the sample; should there be more than ``texts`` of them, those with the most rows."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & has_letter(F.col("text")))
    counts = checkpoint(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")))
    n_langs = counts.count()
    if not n_langs:
        return None
    per_lang = max(1, min(per_lang, texts // n_langs))
    learned = counts.orderBy(F.desc("n_rows"), "lang").limit(texts)
    million = 1_000_000
    rate = F.least(F.lit(million), F.floor(F.lit(4 * per_lang * million) / F.col("n_rows")) + 40)
    h = F.xxhash64("doc_id", "text", F.lit(11))
    near = known.join(learned, "lang").filter(F.pmod(h, F.lit(million)) < rate).select("lang", h.alias("h"), "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                part = batch.slice(i, _BATCH)
                bits = np.packbits(presence(part.column(2).to_pylist()).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "h", "bits"])

    order = Window.partitionBy("lang").orderBy("h", "bits")
    rows = near.mapInArrow(features, "lang string, h long, bits binary").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang).orderBy("lang", "n").collect()
    if not rows:
        return None
    return fit([r["lang"] for r in rows], np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1))


def classify(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, lang_pred, score, nearest: one row for each input row.

    A null text or one without a letter is ``und`` with score 0, as is every text if
    there is no model; ``nearest`` is its largest kernel with a landmark.  Only the text is looked at."""
    at = "text" if "text" in keep else "_text"  # a text that is kept is sent once
    found = docs.select("doc_id", *keep, *([] if at == "text" else [F.col("text").alias(at)]), has_letter(F.col("text")).alias("_lettered"))
    if model is None:
        return found.select("doc_id", *keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("nearest"))
    schema = found.select("doc_id", *keep).schema.add("lang_pred", "string").add("score", "double").add("nearest", "double")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for i in range(0, batch.num_rows, _BATCH):
                part = batch.slice(i, _BATCH)
                table = dict(zip(part.schema.names, part.columns))
                lettered = np.array(table["_lettered"].to_pylist(), bool)
                texts = [t.as_py() for t, ok in zip(table[at], lettered) if ok]
                pred, sure, nearest = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows), np.zeros(part.num_rows)
                if texts:
                    s, nearest[lettered] = score(presence(texts))
                    pred[lettered] = np.array(model.langs, object)[s.argmax(axis=1)]
                    sure[lettered] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
                names = ["doc_id", *keep]
                yield pa.RecordBatch.from_arrays([*(table[n] for n in names), pa.array(pred, pa.string()), pa.array(sure, pa.float64()), pa.array(nearest, pa.float64())], names=[*names, "lang_pred", "score", "nearest"])

    return found.mapInArrow(judge, schema)


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a language of its lang column, with all their
    columns; lang is the predicted one.

    Texts without a letter go, and texts like no landmark of any language; a text of
    fewer than CLAIM_LETTERS letters tells too little and stays.  If no row has a lang,
    nothing can be learned and every row stays as it is.
    """
    model = train(docs)
    if model is None:
        return docs
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = classify(docs, model, keep=others)
    letters = F.char_length(F.regexp_replace("text", r"\P{L}+", ""))
    claimed = F.when(F.col("nearest") >= UNCLAIMED, F.lit(True)).otherwise(letters < CLAIM_LETTERS)
    lang = F.col("lang_pred").cast(docs.schema["lang"].dataType).alias("lang")
    return found.filter((F.col("lang_pred") != UNKNOWN) & claimed).select(*(lang if c == "lang" else c for c in docs.columns))


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    A row with a null doc_id is judged like any other, but never learned from
    and never held out; repeated rows are judged each on its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return classify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
