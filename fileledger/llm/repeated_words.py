"""Word windows that an earlier document holds too, found behind a count-min sketch.

Three looks at the texts. The first adds up count-min sketches of window hashes: each task sends, for
every row of counters, which counters its windows touch once and which more often, and a merge per
slice of counters tells which have two or more. Such counts are never too low, so a window with a
counter below two occurs once. The second look sends only the other windows, by 96-bit hash, each with
the smallest document that holds it in the task, to where equal windows meet and the smallest document
of all is known. The third joins the windows to go to their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField

from fileledger.llm import flat
from fileledger.llm.rows import add_columns, table
from fileledger.llm.sketch import MOST_BITS, ROWS, Sketch, maybe_repeated, repeated_cells

WINDOW = 13
#: Windows a task keeps before it sends them on.
_HELD = 1 << 21
#: Windows of the corpus for each range of hashes; those of a range that may be repeated meet in memory.
RANGE_WINDOWS = 1 << 21
_LAST_ID = 2**63 - 1


def windows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of a batch's texts: two hashes of each window, and the number of its row."""
    row = 0
    for group in flat.row_groups(batch):
        data, offsets = flat.flat(group.column("text"))
        starts, ends, first = flat.spans(data, offsets, flat.WORD_BYTES)
        one, two, at = _window_hashes(data, starts, ends, first, size)
        yield one, two, row + np.searchsorted(first, at, side="right") - 1
        row += group.num_rows


def _window_hashes(data, starts, ends, first, size):
    """Both hashes of the windows that lie in one text, and each one's first word."""
    words = flat.span_hashes(data, starts, ends)
    count = max(0, len(words) - size + 1)
    inside = np.ones(count, bool)
    for border in first[1:-1]:  # windows over a border
        inside[max(0, border - size + 1) : border] = False
    at = np.flatnonzero(inside)
    return flat.window_hashes(words, size, 7)[at], flat.window_hashes(words, size, 11)[at], at


_SENT = "part bigint, one binary, two binary, docs binary"
_FOUND = "doc_id bigint, hash bigint, hashes binary"


def _distinct(one: np.ndarray, two: np.ndarray, doc: np.ndarray):
    """Entries in the order of window and document, where each window begins, and which entries are
    not of its smallest document."""
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    heads = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    later = doc > np.repeat(doc[heads], np.diff(np.append(heads, len(doc))))
    return one, two, doc, heads, later


def _joined(held: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """The arrays of all entries behind each other; the list is empty then."""
    columns = list(zip(*held, strict=True))
    held.clear()
    out = []
    while columns:
        out.append(np.concatenate(columns.pop(0)))
    return out


def _held_windows(
    batches: Iterator[pa.RecordBatch], size: int, sketch: Sketch
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows that may be repeated, some millions at a time, as `_distinct` gives them."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for one, two, row in windows(batch, size):
            at = maybe_repeated(one, sketch)
            if len(at):
                held.append((one[at], (two[at] >> np.uint64(32)).astype(np.uint32), ids[row[at]]))
                waiting += len(at)
            if waiting > _HELD:
                yield _distinct(*_joined(held))
                waiting = 0
    if held:
        yield _distinct(*_joined(held))


def _marks(documents: DataFrame, size: int, sketch: Sketch, ranges: int) -> DataFrame:
    """Windows that an earlier document holds too: rows (doc_id, hash, hashes), with one or several.

    Windows meet in `ranges` ranges of hashes, of which a task of the shuffle takes several, one at a time.
    """

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is not of a task's smallest document of a window: a row for each document."""
        for one, _, doc, _, later in _held_windows(batches, size, sketch):
            if later.any():
                order = np.lexsort((one[later], doc[later]))
                doc, one = doc[later][order], one[later][order]
                new = np.append(True, (doc[1:] != doc[:-1]) | (one[1:] != one[:-1]))
                doc, one = doc[new], one[new]
                cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
                lists = [one[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield _found(doc[cuts[:-1]], None, lists)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, two, doc, heads, _ in _held_windows(batches, size, sketch):
            one, two, doc = one[heads], two[heads], doc[heads]
            part = ((one >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
            full, cuts = flat.runs(part)
            pieces = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            # Small numbers have zeros in their upper bytes, so these go together.
            docs = [doc[x].view(np.uint8).reshape(-1, 8).T.tobytes() for x in pieces]
            lists = [[one[x].tobytes() for x in pieces], [two[x].tobytes() for x in pieces], docs]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int64()), *(pa.array(x, pa.binary()) for x in lists)],
                names=[x.split()[0] for x in _SENT.split(", ")],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            one, _, doc, _, later = _distinct(*_joined(held))
            later[1:] &= (one[1:] != one[:-1]) | (doc[1:] != doc[:-1])
            return _found(doc[later], one[later].view(np.int64), None)

        for batch in batches:
            for part, one, two, docs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now and held:
                    yield out()
                now = part
                ids = np.ascontiguousarray(np.frombuffer(docs, np.uint8).reshape(8, -1).T).view(np.int64)[:, 0]
                held.append((np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint32), ids))
        if held:
            yield out()

    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = documents.mapInArrow(send, _SENT).repartition(parts, "part").sortWithinPartitions("part")
    return documents.mapInArrow(known, _FOUND).unionByName(met.mapInArrow(meet, _FOUND))


def _found(doc: np.ndarray, hashes: np.ndarray | None, lists: list[bytes] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(doc, pa.int64()),
            pa.nulls(len(doc), pa.int64()) if hashes is None else pa.array(hashes, pa.int64()),
            pa.nulls(len(doc), pa.binary()) if lists is None else pa.array(lists, pa.binary()),
        ],
        names=["doc_id", "hash", "hashes"],
    )


def without_repeats(
    documents: DataFrame,
    size: int = WINDOW,
    rows: int = ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    most_bits: int = MOST_BITS,
    range_windows: int = RANGE_WINDOWS,
) -> DataFrame:
    """One row (doc_id, n_words, n_removed, kept) per document, without the words of repeated windows.

    A word is removed if a window of `size` words over it occurs, anywhere, in a document with a
    smaller id; windows are judged on the texts as given. `kept` has the other words, one space
    between them. Null and empty texts have no words. Rows with equal ids don't remove each other's
    words; a null id counts as 2^63 - 1, the largest there is. Other columns are not read.

    Of a window held by many documents each task sends the smallest only, so no window is hot. The
    sketch's size is fixed by `rows` and `most_bits`; for fewer windows it is smaller.
    """
    spark = documents.sparkSession
    source = documents.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_LAST_ID)).alias("doc_id"),
        F.col(text).alias("text"),
        F.col(doc_id).cast("bigint").alias("_id"),
    )
    # About as many windows as words, and a word to six bytes.
    n_bytes = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = repeated_cells(
        source, lambda batch: (one for one, _, _ in windows(batch, size)), n_bytes // 6, rows, most_bits
    )
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // 6 // range_windows)
    marks = _marks(source.select("doc_id", "text"), size, sketch, ranges)
    marks = marks.groupBy("doc_id").agg(F.collect_list("hash").alias("_some"), F.collect_list("hashes").alias("_more"))

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, removed, kept = [], [], []
        texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
        some, more = batch.column("_some"), batch.column("_more")
        for k, raw in enumerate(texts):
            words = raw.split()
            counts.append(len(words))
            if some[k].is_valid:  # both lists are there
                known = np.frombuffer(b"".join(more[k].as_py()), np.uint64)
                known = np.concatenate([some[k].values.to_numpy().view(np.uint64), known])
                data = np.frombuffer(raw, np.uint8)
                starts, ends, first = flat.spans(data, np.array([0, len(data)]), flat.WORD_BYTES)
                one, _, _ = _window_hashes(data, starts, ends, first, size)
                go = flat.covered(np.isin(one, known), size, len(words))
                words = [words[i] for i in np.flatnonzero(~go)]
            removed.append(counts[-1] - len(words))
            kept.append(b" ".join(words))
        return [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", BinaryType())]
    found = add_columns(source.join(marks, "doc_id", "left"), fields, cut, keep=["_id"], uses=["_some", "_more"])
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op2_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words every document loses to earlier ones, and a digest of those it keeps."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The same in SQL.
SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS key
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (SELECT key, min(doc_id) AS first FROM windows GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM windows JOIN firsts USING (key) WHERE doc_id > first
), kept AS (
  SELECT e.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
    coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS kept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) e
  LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM words d LEFT JOIN kept k USING (doc_id)
"""
