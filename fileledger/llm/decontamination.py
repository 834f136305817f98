"""Passages of a benchmark in documents, found by one Aho-Corasick automaton over the items' words."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField

from fileledger.llm import flat
from fileledger.llm.rows import add_columns, table

#: Items with more text than this are dealt into several automata, each in its own broadcast.
ITEM_BYTES = 1 << 20

_LETTERS = bytes(range(0x61, 0x7B))
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or b in _LETTERS or 0x30 <= b <= 0x39 else 0x20
    for b in range(256)
)
_WORD_BYTES = np.array([b != 0x20 for b in _NORMAL])


def normal_words(text: bytes) -> list[bytes]:
    """Lower-cased words of digits, letters A to Z and everything beyond ASCII."""
    return text.translate(_NORMAL).split()


def item_windows(text: bytes, size: int) -> list[bytes]:
    """Each `size` consecutive words of an item, or all of them if there are fewer."""
    words = normal_words(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[str | None, bytes], ...], size: int):
    """The automaton of all windows; a window's value is its word count and its items."""
    import ahocorasick

    owners: dict[bytes, set[str | None]] = {}
    for item, text in items:
        for window in item_windows(text, size):
            owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for window, of in owners.items():
        # Bytes as characters of the same number, so any bytes at all can be looked for.
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, of))
    automaton.make_automaton()
    return automaton


def _scan(text: bytes, automaton) -> tuple[int, np.ndarray, set[str]]:
    """Words of a text, borders of the runs of hit words, and the items that occur."""
    words = normal_words(text)
    none = np.empty(0, np.int64)
    if automaton is None or not words:
        return len(words), none, set()
    line = " " + b" ".join(words).decode("latin-1") + " "
    ends, sizes, items = [], [], set()
    for end, (size, of) in automaton.iter(line):
        ends.append(end)
        sizes.append(size)
        items |= of
    if not ends:
        return len(words), none, items
    spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
    last = np.searchsorted(spaces, ends)  # words up to the end
    return len(words), _runs(last - np.array(sizes), last), items


def _runs(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Borders of the union of half-open ranges, start and end in turn."""
    if not len(starts):
        return np.empty(0, np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return np.stack([starts[heads], reach[np.append(heads[1:], len(starts)) - 1]], axis=1).ravel()


_SO_FAR = [StructField("_runs", ArrayType(LongType())), StructField("_items", ArrayType(StringType()))]
_RESULT = [
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("hits", ArrayType(LongType())),
    StructField("item_ids", ArrayType(StringType())),
    StructField("contaminated", BooleanType()),
]


def _search(
    documents: DataFrame,
    items: Sequence[tuple[str | None, bytes]],
    size: int,
    text: str,
    keep: Sequence[str],
    last: bool,
) -> DataFrame:
    """Join the hits of these items to those found before; the last search gives the result."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(items))
    first = "_runs" not in documents.columns

    def compute(batch: pa.RecordBatch) -> list[pa.Array]:
        automaton = _automaton(shared.value, size)
        texts = batch.column(text).cast(pa.binary()).fill_null(b"").to_pylist()
        scanned = [_scan(raw, automaton) for raw in texts]
        runs = [own for _, own, _ in scanned]
        ids = [{x for x in of if x is not None} for _, _, of in scanned]
        if not first:
            before = [np.array(x, np.int64) for x in batch.column("_runs").to_pylist()]
            both = [np.concatenate(x).reshape(-1, 2) for x in zip(runs, before, strict=True)]
            runs = [_runs(x[:, 0], x[:, 1]) for x in both]
            ids = [x.union(y) for x, y in zip(ids, batch.column("_items").to_pylist(), strict=True)]
        if not last:
            return [pa.array(runs, pa.list_(pa.int64())), pa.array(map(list, ids), pa.list_(pa.string()))]
        hit = np.array([int((x[1::2] - x[0::2]).sum()) for x in runs], np.int64)
        places = [_offsets(raw, x) for raw, x in zip(texts, runs, strict=True)]
        return [
            pa.array([count for count, _, _ in scanned], pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array(places, pa.list_(pa.int64())),
            pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
            pa.array(hit > 0),
        ]

    uses = [] if first else ["_runs", "_items"]
    return add_columns(documents, _RESULT if last else _SO_FAR, compute, text, keep, uses=uses)


def _offsets(raw: bytes, runs: np.ndarray) -> np.ndarray:
    """Runs of words as offsets, in code points, of the text as it was given."""
    if not len(runs):
        return runs
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = flat.spans(data, np.array([0, len(data)]), _WORD_BYTES)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    places = np.empty_like(runs)
    places[0::2], places[1::2] = points[starts[runs[0::2]]], points[ends[runs[1::2] - 1]]
    return places


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    item_bytes: int = ITEM_BYTES,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add where `size` consecutive words of a benchmark item occur, whatever else a row holds.

    An item with fewer words is looked for as a whole. `n_words` counts a text's words, `n_hit` those
    inside any occurrence, `hits` has the hit stretches as offsets in code points of the given text
    (start and end in turn), `item_ids` the items that occur, sorted as strings, and `contaminated`
    tells whether there is a hit. Each text is scanned once where it lies, without a shuffle.

    Null and empty texts and items have no words. An item without id marks words but is not listed;
    repeated items are listed once. The items' size is checked: up to `item_bytes` of text they make
    one automaton; more are dealt by hash into as many parts as needed, of which the scans follow each
    other in one pass over the rows, each with its own broadcast.
    """
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")
    ).filter("text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // item_bytes))
    kept = documents.columns if keep is None else [*keep]
    kept = [c for c in kept if c not in {field.name for field in _RESULT}]
    found = documents.select(*dict.fromkeys([*kept, text]))
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()  # about item_bytes
        last = part == parts - 1
        own = [(x["item"], bytes(x["text"])) for x in own]
        found = _search(found, own, size, text, kept if last else [*found.columns], last)
    return found


def op4_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and which of them lie in passages of the benchmark."""
    found = contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: The same in SQL.
SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
  SELECT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM wanted),
windows AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes)
), found AS (SELECT doc_id, i, size, item_id FROM windows JOIN wanted USING (size, key)),
hit AS (
  SELECT doc_id, count(DISTINCT i) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS i FROM found) GROUP BY doc_id
), own AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
