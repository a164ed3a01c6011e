"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language has several centroids, found by
spherical k-means over a bounded sample of labelled texts; a text gets the language of the centroid with the greatest
cosine, and is rejected where even that one is further away than nearly all of the centroid's own texts of its length.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, bounded, free_name, give_back, text_blocks
from .pretokens import MARK
from .words import mix

#: Hashed n-gram features.
FEATURES = 1 << 13
#: Labelled texts that the classifier is fitted on, at most: of each language, and of all together. More languages than
#: TEXTS are refused.
SAMPLE, TEXTS = 400, 4000
CENTROIDS = 4
#: A text takes as much room as so many characters, whatever its length.
PER_TEXT = 4096
#: A text is rejected when its best cosine is below this share of what the centroid's own texts of its length reach.
REJECT = 0.3
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """2 for letters, 1 for the marks that stand on them, else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)), np.uint8, 0x110000)


def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts (texts x FEATURES) and the number of letters. Anything but letters and marks is one space."""
    lower = [t.lower().replace(MARK, " ") for t in texts]
    cp = np.frombuffer(MARK.join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    border = cp == ord(MARK)
    kind = _letters()[cp]
    letter = kind > 0
    doc = np.cumsum(border) - border
    n_letters = np.bincount(doc[kind == 2], minlength=len(texts))
    keep = letter | border
    keep[1:] |= letter[:-1]  # the first of what stands between letters
    code = np.where(letter, cp, 32).astype(np.uint64)[keep]
    owner = doc[keep].astype(np.int64)
    out = np.zeros(len(texts) * FEATURES, np.float32)
    rolled = np.zeros(len(code), np.uint64)
    for n in range(1, 4):
        rolled = rolled[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
        same = owner[: len(rolled)] == owner[n - 1 :] if n > 1 else slice(None)
        feature = (mix(rolled[same]) % np.uint64(FEATURES)).astype(np.int64)
        out += np.bincount(owner[: len(rolled)][same] * FEATURES + feature, minlength=len(out)).astype(np.float32)
    return out.reshape(len(texts), FEATURES), n_letters[: len(texts)]


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(found) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm == 0, 1, norm)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each
    owner: np.ndarray  # the language of each centroid
    #: A text with this many letters reaches expected[i] with its own centroid; interpolated in between.
    letters: np.ndarray
    expected: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        found, letters = counts(texts)
        cosine = vectors(found, self.idf) @ self.centroids.T if len(self.centroids) else np.zeros((len(texts), 1), np.float32)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        blank = (letters == 0) | (len(self.centroids) == 0)
        score[blank] = 0
        floor = REJECT * np.interp(np.log1p(letters), self.letters, self.expected)
        names = [UNKNOWN if b else self.languages[self.owner[i]] for b, i in zip(blank, best)]
        return names, score, blank | (score < floor)


def _cluster(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the point nearest the mean, then from the furthest each time."""
    mean = points.mean(axis=0)
    chosen = [int((points @ mean).argmax())]
    while len(chosen) < min(k, len(points)):
        nearest = (points @ points[chosen].T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        chosen.append(int(nearest.argmin()))
    centres = points[chosen]
    for _ in range(rounds):
        owner = (points @ centres.T).argmax(axis=1)
        sums = np.stack([points[owner == i].sum(axis=0) if (owner == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit(found: np.ndarray, letters: np.ndarray, labels: list[str]) -> Model:
    languages = sorted(set(labels))
    label = np.array([languages.index(x) for x in labels], np.int64)
    idf = (np.log((1 + len(label)) / (1 + (found > 0).sum(axis=0))) + 1).astype(np.float32)
    points = vectors(found, idf)
    centres, owner = [], []
    for i in range(len(languages)):
        got = _cluster(points[label == i], CENTROIDS)
        centres.append(got)
        owner += [i] * len(got)
    if not languages:
        return Model([], idf, np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(1), np.zeros(1))
    centroids, owner = np.concatenate(centres).astype(np.float32), np.array(owner)
    cosine = np.where(owner[None, :] == label[:, None], points @ centroids.T, -1).max(axis=1)
    size = np.log1p(letters)
    edges = np.unique(np.quantile(size, np.linspace(0, 1, 9)))
    where = np.clip(np.searchsorted(edges, size, "right") - 1, 0, max(0, len(edges) - 2))
    bins = np.unique(where)
    at = np.array([size[where == b].mean() for b in bins])
    expected = np.array([np.quantile(cosine[where == b], 0.05) for b in bins])
    # a text with hardly any letters resembles nothing; do not ask it to
    return Model(languages, idf, centroids, owner, np.concatenate(([0.0], at)), np.concatenate(([0.0], expected)))


def held_out(docs: DataFrame) -> DataFrame:
    """crc32 of doc_id as text modulo 5 is 0; a null doc_id is not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return docs.withColumn("held_out", F.coalesce(crc == 0, F.lit(False)))


def sample_of(docs: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> DataFrame:
    """doc_id, lang of the documents that are learnt from: of each language those with the smallest hashes of their ids.

    Only documents with doc_id, lang and a letter in their text that are not held out are taken. Each language gives
    `sample` of them at most, or as many fewer as leave all languages their share of `texts`; none is left out, and
    more languages than `texts` raise ValueError. Languages are counted first, and of a large one only the rows with
    small hashes are ranked, some twice as many as are wanted, so no task gets more of it than that.
    """
    known = held_out(docs.select("doc_id", "lang", "text")).filter(r"not held_out and lang is not null and doc_id is not null and text rlike '\\p{L}'").select("doc_id", "lang")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(texts + 1).collect()
    if len(sizes) > texts:
        raise ValueError(f"more than {texts} languages")
    each = min(sample, texts // max(1, len(sizes)))
    limits = docs.sparkSession.createDataFrame([(r.lang, min(1.0, (2.0 * each + 100) / max(r.n, 1))) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)
    small = known.join(F.broadcast(limits), "lang").filter(place < F.col("share")).select("doc_id", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), "doc_id"))
    return small.withColumn("rank", rank).filter(F.col("rank") <= each).groupBy("doc_id").agg(F.min("lang").alias("lang"))


def train(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on a bounded sample of each language, see sample_of; of rows that repeat a doc_id no more than its share is used."""
    ids = spark.createDataFrame(sample_of(docs, sample).collect(), "doc_id bigint, lang string")  # TEXTS rows at most, sent to all executors
    texts = docs.select("doc_id", F.col("lang").alias("told"), "text").filter(r"text rlike '\\p{L}'").join(F.broadcast(ids), "doc_id").filter("told = lang")

    def features(batches):
        for batch, texts in text_blocks(batches, 1 << 19, PER_TEXT):
            found, letters = counts(texts)
            sparse = [np.flatnonzero(row) for row in found]
            langs = batch.column(batch.schema.get_field_index("lang"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            data = [pa.array([i.astype("<i4").tobytes() + row[i].astype("<f4").tobytes() for i, row in zip(sparse, found)], pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, langs, *data, pa.array(letters, pa.int64())], ["doc_id", "lang", "found", "letters"])

    bounded(spark)
    rows = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # of repeated doc_ids the smallest text
    rows = rows.mapInArrow(features, "doc_id bigint, lang string, found binary, letters bigint").collect()
    rows = sorted((r for r in rows if r.letters), key=lambda r: (r.lang, r.doc_id))
    found = np.zeros((len(rows), FEATURES), np.float32)
    for row, r in zip(found, rows):
        half = len(r.found) // 2
        row[np.frombuffer(r.found[:half], "<i4")] = np.frombuffer(r.found[half:], "<f4")
    return fit(found, np.array([r.letters for r in rows], np.int64), [r.lang for r in rows])


def predictor(spark: SparkSession, docs: DataFrame, model: Model | None = None):
    """A function from the text column to a struct of lang_pred, score and rejected."""
    taken = spark.sparkContext.broadcast(model or train(spark, docs))
    bounded(spark)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = [x or "" for x in column.to_pylist()]
            parts = [taken.value.predict(texts[a:b]) for a, b in blocks(texts, 1 << 19, PER_TEXT)]
            arrays = [pa.array([x for p in parts for x in p[i]], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.StructArray.from_arrays(arrays, ["lang_pred", "score", "rejected"])
            give_back()

    return predict


def identify(spark: SparkSession, docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of docs, but for those of the same names, with lang_pred, score and rejected.

    Predictions come from the text alone, whole and of any length. A null text, or one without a letter, is `und` with
    score 0 and rejected; so is everything where no document could be learnt from. Of equally near centroids the first
    counts, in order of languages. Repeated rows give repeated results; an empty table none.
    """
    name, new = free_name(docs, "_found"), ("lang_pred", "score", "rejected")
    found = docs.withColumn(name, predictor(spark, docs, model)("text"))
    return found.select(*(c for c in docs.columns if c.lower() not in new), f"{name}.*")


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns as they are, those named like a result's too."""
    name = free_name(docs, "_found")
    return docs.withColumn(name, predictor(spark, docs)("text")).filter(f"not {name}.rejected").drop(name)
