"""Language of texts, in two steps: the family first, then the languages inside it.

Texts are counts of two and three consecutive bytes of lower-cased letters, hashed, under a square
root, of length one. One linear support vector machine per family tells it from the others; for every
two languages of a family one more tells them apart, and the language most of these name wins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField
from pyspark.sql.window import Window

from fileledger.llm import flat
from fileledger.llm.linear import sigmoid, support_vector, with_intercept
from fileledger.llm.rows import add_columns, table

#: Most documents per language to learn from: a bound on what the fitting task holds.
SAMPLE = 1000
_WIDTH = 2048
_GRAMS = (2, 3)
_TEXTS_AT_ONCE = 256
UNKNOWN = "und"

#: Families of languages, by their ISO 639-1 codes. Others are families of their own.
FAMILIES = {
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "germanic": ("af", "da", "de", "en", "is", "lb", "nb", "nl", "nn", "no", "sv"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "uralic": ("et", "fi", "hu"),
    "semitic": ("am", "ar", "he", "mt"),
}
_FAMILY_OF = {language: family for family, languages in FAMILIES.items() for language in languages}

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x41:0x5B] = _LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def features(texts: Sequence[bytes]) -> np.ndarray:
    """One row of `_WIDTH` numbers per text."""
    out = np.zeros((len(texts), _WIDTH), np.float32)
    block = 1 << 20
    for low in range(0, len(texts), _TEXTS_AT_ONCE):
        part = texts[low : low + _TEXTS_AT_ONCE]
        letters = _LETTERS[np.frombuffer(b"".join(b" " + x + b" " for x in part), np.uint8)]
        text = np.repeat(np.arange(len(part)), [len(x) + 2 for x in part])
        # One space for any stretch that is not letters.
        keep = np.append(True, (letters[1:] != 0x20) | (letters[:-1] != 0x20) | (text[1:] != text[:-1]))
        letters, text = letters[keep].astype(np.uint64), text[keep]
        counts = np.zeros(len(part) * _WIDTH)
        for size in _GRAMS:
            for at in range(0, len(letters) - size + 1, block):
                stop = min(at + block, len(letters) - size + 1)
                with np.errstate(over="ignore"):
                    gram = np.full(stop - at, size << 32, np.uint64)
                    for k in range(size):
                        gram += letters[at + k : stop + k] << np.uint64(8 * k)
                cell = (flat.mix(gram) >> np.uint64(40)).astype(np.int64) % _WIDTH
                first, last = text[at:stop], text[at + size - 1 : stop + size - 1]
                inside = first == last
                counts += np.bincount(first[inside] * _WIDTH + cell[inside], minlength=len(counts))
        out[low : low + len(part)] = np.sqrt(counts.reshape(len(part), _WIDTH))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Model:
    """Languages, their families, and the weights of the machines."""

    def __init__(self, languages: list[str], families: list[str], one: np.ndarray, pairs: dict[tuple[int, int], np.ndarray]):
        self.languages, self.families, self.one, self.pairs = languages, families, one, pairs
        self.of_family = {f: [k for k, x in enumerate(languages) if family_of(x) == f] for f in families}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each text's language, and a score from 0 to 1."""
        x = with_intercept(x)
        margins = x @ self.one.T
        family = margins.argmax(axis=1)
        score = sigmoid(2 * margins.max(axis=1)) if len(self.families) > 1 else np.ones(len(x))
        found = np.zeros(len(x), np.int64)
        for k, name in enumerate(self.families):
            own = np.flatnonzero(family == k)
            members = self.of_family[name]
            votes, sums = np.zeros((len(own), len(self.languages))), np.zeros((len(own), len(self.languages)))
            for a, b in combinations(members, 2):
                margin = x[own] @ self.pairs[a, b]
                votes[np.arange(len(own)), np.where(margin > 0, a, b)] += 1
                sums[:, a] += sigmoid(2 * margin)
                sums[:, b] += sigmoid(-2 * margin)
            # Most votes; among equals the larger margins.
            best = np.asarray(members)[(votes[:, members] + sums[:, members] / len(self.languages)).argmax(axis=1)]
            found[own] = best
            if len(members) > 1:
                score[own] *= sums[np.arange(len(own)), best] / (len(members) - 1)
        return found, score


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def fit(x: np.ndarray, languages: Sequence[str]) -> Model:
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], np.int64)
    families = sorted({family_of(x) for x in names})
    of = np.array([families.index(family_of(x)) for x in names], np.int64)[label]
    one = [support_vector(x, np.where(of == k, 1, -1)) if len(families) > 1 else np.zeros(x.shape[1] + 1) for k in range(len(families))]
    pairs = {}
    for a, b in combinations(range(len(names)), 2):
        if family_of(names[a]) == family_of(names[b]):
            own = (label == a) | (label == b)
            pairs[a, b] = support_vector(x[own], np.where(label[own] == a, 1, -1))
    return Model(names, families, np.array(one, np.float32), pairs)


def learn(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model | None:
    """Fit a model on at most `sample` rows of each language, those with the smallest hashes of ids.

    The ids are chosen first, and only their texts read. One task fits the model; it holds `sample`
    feature rows of 8 KB per language. None if there is nothing to learn from.
    """
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = labelled.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    chosen = (
        rows.select("doc_id", "lang")
        .withColumn("place", F.row_number().over(by_hash))
        .filter(F.col("place") <= sample)
        .select("doc_id", "lang")
        .distinct()
    )

    def describe(batch: pa.RecordBatch) -> list[pa.Array]:
        found = features(batch.column("text").cast(pa.binary()).to_pylist())
        return [pa.array([x.tobytes() for x in found], pa.binary())]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_batches = [batch for batch in batches if batch.num_rows]
        if not own_batches:
            return
        all_ = pa.Table.from_batches(own_batches)
        # In one order, whatever order the rows come in.
        order = np.lexsort((all_.column("x").to_numpy(), all_.column("lang").to_numpy()))
        x = np.frombuffer(b"".join(all_.column("x").to_pylist()), np.float32).reshape(-1, _WIDTH)[order]
        model = fit(x, np.array(all_.column("lang").to_pylist())[order].tolist())
        yield pa.RecordBatch.from_pydict(
            {
                "names": [json.dumps([model.languages, model.families, [list(k) for k in model.pairs]])],
                "weights": [model.one.tobytes() + b"".join(w.astype(np.float32).tobytes() for w in model.pairs.values())],
            }
        )

    described = add_columns(
        rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi"), [StructField("x", BinaryType())], describe, keep=["lang"]
    )
    found = described.repartition(1).mapInArrow(fitted, "names string, weights binary").collect()
    if not found:
        return None
    languages, families, pairs = json.loads(found[0]["names"])
    weights = np.frombuffer(found[0]["weights"], np.float32).reshape(-1, _WIDTH + 1)
    own = {tuple(k): w for k, w in zip(pairs, weights[len(families) :], strict=True)}
    return Model(languages, families, weights[: len(families)], own)


def identify(
    documents: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add `lang_pred` and `score` (0 to 1) by the text alone.

    A text that is null or has no letter is `und` with score 0; so is all if there is no model. Whole
    texts are used. Other columns stay, and those called like the new ones are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(text).cast(pa.binary()).fill_null(b"").to_pylist()
        own = shared.value
        names, scores = [], []
        for low in range(0, len(texts), _TEXTS_AT_ONCE):
            part = texts[low : low + _TEXTS_AT_ONCE]
            if own is None:
                names += [UNKNOWN] * len(part)
                scores += [0.0] * len(part)
                continue
            found, score = own.predict(features(part))
            names += [own.languages[k] for k in found]
            scores += score.tolist()
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    keep = documents.columns if keep is None else keep
    kept = [c for c in keep if c not in ("lang_pred", "score", "__letter")]
    with_letter = documents.withColumn("__letter", has_letter(F.col(text)))
    found = add_columns(with_letter, fields, compute, text, keep=[*kept, "__letter"])
    return found.withColumns(
        {
            "lang_pred": F.when(F.col("__letter"), F.col("lang_pred")).otherwise(UNKNOWN),
            "score": F.when(F.col("__letter"), F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).otherwise(0.0),
        }
    ).drop("__letter")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a model learnt from those not held out."""
    documents = table(spark, sf_dir, "documents")
    model = learn(documents.filter(~held_out()))
    found = identify(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
