"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; the model of a category sees, besides the text, the
probabilities of the categories before it. While it learns, these come from models that have not seen
the document (five folds), so it meets them as unsure as they will be later.

Features are what a text holds at all: lower-cased words of letters, their first four and five bytes,
and runs of signs, hashed. Each model takes the ones that tell its category best.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField

from fileledger.llm import flat
from fileledger.llm.linear import logistic, sigmoid
from fileledger.llm.rows import add_columns, table

#: Most labelled documents to learn from: a bound on what the fitting task holds.
SAMPLE = 16_000
FOLDS = 5
_BITS = 20
_FEATURES = 400
_LEAST_TEXTS = 5
_PART = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SIGN = flat.WORD_BYTES & ~_LETTER
_SIGN[0x30:0x3A] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and feature for each thing met in texts given behind each other, with repeats."""
    data = _LOWER[data]
    starts, ends, first = flat.spans(data, offsets, _LETTER)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found = [(text, flat.span_hashes(data, starts, ends))]
    for size in (4, 5):
        long = ends - starts >= size
        found.append((text[long], flat.mix(flat.span_hashes(data, starts[long], starts[long] + size) + np.uint64(size))))
    starts, ends, first = flat.spans(data, offsets, _SIGN)
    found.append((np.repeat(np.arange(len(offsets) - 1), np.diff(first)), flat.span_hashes(data, starts, ends)))
    of, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return of, (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.sort(text << _BITS | feature)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both >> _BITS, both & ((1 << _BITS) - 1)


def _parts(size: int) -> Iterator[slice]:
    """A long array a piece at a time, as numpy widens the numbers it counts."""
    return (slice(low, low + _PART) for low in range(0, size, _PART))


class Link:
    """One model of the chain: features, their weights, those of the earlier probabilities, intercept."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray) -> None:
        self.chosen, self.weights = chosen, weights

    def margins(self, text: np.ndarray, feature: np.ndarray, texts: int, earlier: np.ndarray) -> np.ndarray:
        """`text` and `feature` without repeats; `earlier` has a column per category before."""
        size, sums = len(self.chosen), np.zeros(texts)
        for part in _parts(len(text)):
            at = np.searchsorted(self.chosen, feature[part])
            known = np.append(self.chosen, -1)[at] == feature[part]
            sums += np.bincount(text[part][known], weights=self.weights[at[known]], minlength=texts)
        return sums + earlier @ self.weights[size:-1] + self.weights[-1]


def _fit_link(text, feature, rows: np.ndarray, target: np.ndarray, earlier: np.ndarray) -> Link:
    """A model for the given rows; the features are chosen by them as well."""
    is_row = np.zeros(len(target), bool)
    is_row[rows] = True
    yes, no = max(1, int(target[rows].sum())), max(1, int((1 - target[rows]).sum()))
    with_yes, all_ = np.zeros(1 << _BITS), np.zeros(1 << _BITS)
    for part in _parts(len(text)):
        own = is_row[text[part]]
        with_yes += np.bincount(feature[part][own], weights=target[text[part][own]], minlength=1 << _BITS)
        all_ += np.bincount(feature[part][own], minlength=1 << _BITS)
    share = all_ / (yes + no)
    apart = np.abs(with_yes / yes - (all_ - with_yes) / no)
    score = np.where(all_ >= _LEAST_TEXTS, apart / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / yes + 1 / no)), 0)
    chosen = np.sort(np.argsort(-score, kind="stable")[:_FEATURES])
    chosen = chosen[score[chosen] > 0]
    place = np.cumsum(is_row) - 1
    x = np.zeros((len(rows), len(chosen) + earlier.shape[1]), np.float32)
    for part in _parts(len(text)):
        at = np.searchsorted(chosen, feature[part])
        known = (np.append(chosen, -1)[at] == feature[part]) & is_row[text[part]]
        x[place[text[part][known]], at[known]] = 1
    x[:, len(chosen) :] = earlier[np.flatnonzero(is_row)]
    return Link(chosen, logistic(x, target[np.flatnonzero(is_row)]))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_chain(text: np.ndarray, feature: np.ndarray, targets: np.ndarray, folds: np.ndarray) -> list[Link]:
    """The links of the chain; `targets` has a column of 0 and 1 per category, in its order."""
    texts, links = len(targets), []
    earlier = np.zeros((texts, 0), np.float32)
    for k in range(targets.shape[1]):
        target = targets[:, k].astype(float)
        links.append(_fit_link(text, feature, np.arange(texts), target, earlier))
        if k + 1 < targets.shape[1]:
            unseen = np.zeros(texts)
            for fold in range(FOLDS):
                out = folds == fold
                if out.any() and not out.all():
                    link = _fit_link(text, feature, np.flatnonzero(~out), target, earlier)
                    unseen[out] = sigmoid(link.margins(text, feature, texts, earlier))[out]
            earlier = np.hstack([earlier, _logit(unseen)[:, None]])
    return links


def predict_chain(links: Sequence[Link], text: np.ndarray, feature: np.ndarray, texts: int) -> np.ndarray:
    """Probabilities, a column per category."""
    chosen = np.unique(np.concatenate([x.chosen for x in links])) if links else np.empty(0, np.int64)
    known = np.zeros(1 << _BITS, bool)
    known[chosen] = True
    known = known[feature]
    text, feature = _distinct(text[known], feature[known])
    earlier = np.zeros((texts, 0))
    out = np.zeros((texts, len(links)))
    for k, link in enumerate(links):
        out[:, k] = sigmoid(link.margins(text, feature, texts, earlier))
        earlier = np.hstack([earlier, _logit(out[:, k : k + 1])])
    return out


def learn(
    documents: DataFrame,
    labels: DataFrame,
    categories: Mapping[str, Column],
    sample: int = SAMPLE,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[Link]:
    """Fit a chain for `categories`, conditions on a row of labels, in their order.

    At most `sample` labelled documents are learnt from, those with the smallest hashes of ids; their
    ids are chosen first and broadcast. One task fits the chain. Labels with a null condition or
    without a document are left out; without any label the chain knows no features.
    """
    marked = labels.select(F.col(doc_id).alias("doc_id"), *[c.cast("int").alias(f"c{k}") for k, c in enumerate(categories.values())])
    names = [f"c{k}" for k in range(len(categories))]
    whole = marked.dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in names])
    chosen = whole.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def describe(batch: pa.RecordBatch) -> list[pa.Array]:
        of, found = _distinct(*features(*flat.flat(batch.column("text"))))
        cuts = np.searchsorted(of, np.arange(batch.num_rows + 1))
        return [pa.array([found[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())]

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_batches = [batch for batch in batches if batch.num_rows]
        if not own_batches:
            return
        all_ = pa.Table.from_batches(own_batches)
        ids, raw = all_.column("doc_id").to_numpy(), all_.column("x").to_pylist()
        order = np.lexsort((np.array([len(x) for x in raw]), ids))  # in one order, however the rows come
        own = [np.frombuffer(raw[k], np.int32) for k in order]
        of = np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own])
        targets = np.stack([all_.column(c).to_numpy()[order] for c in names], axis=1)
        folds = (flat.mix(ids[order].astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
        for link in fit_chain(of, np.concatenate(own), targets, folds):
            yield pa.RecordBatch.from_pydict({"chosen": [link.chosen.astype(np.int64).tobytes()], "weights": [link.weights.tobytes()]})

    described = add_columns(rows, [StructField("x", BinaryType())], describe, keep=["doc_id", *names])
    found = described.repartition(1).mapInArrow(fitted, "chosen binary, weights binary").collect()
    return [Link(np.frombuffer(x["chosen"], np.int64), np.frombuffer(x["weights"], np.float64)) for x in found]


def classify(
    documents: DataFrame,
    links: Sequence[Link],
    categories: Sequence[str],
    text: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add a probability `p_<category>` for each category of the chain, from the whole text.

    Null and empty texts get what the chain says of a text without features; without a model all
    probabilities are 0. Rows stay where they are; other columns stay, those called like the new ones
    are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(list(links))

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        data, offsets = flat.flat(batch.column(text))
        if not shared.value:
            return [pa.array(np.zeros(batch.num_rows))] * len(categories)
        found = predict_chain(shared.value, *features(data, offsets), batch.num_rows)
        return [pa.array(found[:, k]) for k in range(len(categories))]

    return add_columns(documents, [StructField(f"p_{c}", DoubleType()) for c in categories], compute, text, keep)


#: What the given labels can teach: text of poor quality, and toxic text.
CATEGORIES = ("poor", "toxic")


def chain_of(spark: SparkSession, sf_dir: str) -> list[Link]:
    """The chain learnt from the tables of a folder."""
    conditions = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), conditions)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of the categories for every document, and whether it is toxic."""
    found = classify(table(spark, sf_dir, "documents"), chain_of(spark, sf_dir), CATEGORIES, keep=["doc_id"])
    return found.withColumn("toxic", F.col("p_toxic") >= 0.5)
