"""Token ids of documents as flat binary files, and reading them back through memory maps.

A folder holds three files per part: `.bin`, the ids as little-endian unsigned integers, of 16 bits
where the vocabulary allows and else of 32; `.idx`, one more 64-bit offset than documents, counted in
ids from the part's first; `.doc`, the documents' ids as 64-bit integers, a null as the lowest one.
Parts follow each other in ascending document id. A table with one row per part, the manifest, has
the number of ids before each part.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fileledger.llm import flat
from fileledger.llm.pieces import clean_texts
from fileledger.llm.rows import table
from fileledger.llm.shared_files import new_folder, open_folder, write_file
from fileledger.llm.words import WordIds
from fileledger.session import cut_lineage

_NO_ID = -(2**63)


class Encoder:
    """Ids of texts by a tokenizer that never joins letters across white space."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.words = WordIds(self._encode_bytes)

    def _encode_bytes(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = text.tobytes(), np.cumsum(lengths).tolist()
        words = [raw[a:b].decode() for a, b in zip([0, *ends], ends)]
        found = [x.ids for x in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.array([i for x in found for i in x], np.int32), sizes

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text's begin."""
        texts = clean_texts(column)
        offsets = np.append(0, np.cumsum([len(x) for x in texts], dtype=np.int64))
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = flat.spans(data, offsets, flat.WORD_BYTES)
        ids, counts = self.words.of(data, starts, ends)
        return ids, np.append(0, np.cumsum(counts))[first]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(
    documents: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_bits: int = 32,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Write the ids of all texts, each followed by `end_id`, and return the manifest.

    The texts are shuffled once, by ranges of (document id, text hash), so repeated ids spread as far
    as their texts differ. A task writes its part under a name of its own and renames it when whole,
    so a task run twice leaves the same files. A null or empty text is the end id alone. Other
    columns are not read. An empty table has no parts.
    """
    dtype = np.dtype(f"<u{id_bits // 8}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = f"part-{context.partitionId():06d}", context.taskAttemptId()
        encode, out, docs, sizes, system, path = encoder(tokenizer).encode, None, [], [], None, None
        for whole in batches:
            for batch in flat.row_groups(whole, "text"):
                if out is None:
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/.{part}.bin.{attempt}")
                ids, starts = encode(batch.column("text"))
                if len(ids) and int(ids.max()) >= 1 << id_bits:
                    raise ValueError(f"an id takes more than {id_bits} bits")
                out.write(np.insert(ids, starts[1:], end_id).astype(dtype).tobytes())
                docs.append(batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy())
                sizes.append(np.diff(starts) + 1)
        if out is None:
            return
        out.close()
        offsets = np.append(0, np.cumsum(np.concatenate(sizes))).astype("<u8")
        ids_of = np.concatenate(docs).astype("<i8")
        system.move(f"{path}/.{part}.bin.{attempt}", f"{path}/{part}.bin")
        write_file(folder, f"{part}.idx", attempt, offsets.tobytes())
        write_file(folder, f"{part}.doc", attempt, ids_of.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(ids_of)], "n_ids": [int(offsets[-1])]})

    place = [F.col("doc_id"), F.xxhash64("text")]
    parts = (
        documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(*place)
        .sortWithinPartitions(*place, "text")
        .mapInArrow(write, "part string, n_docs bigint, n_ids bigint")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return cut_lineage(parts).select(  # one row per task
        "*",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
        F.lit(folder).alias("folder"),
        F.lit(id_bits).alias("id_bits"),
    )


def _mapped(system: pyarrow.fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(system, pyarrow.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read(), dtype)


def read_token_files(manifest: DataFrame, docs_a_batch: int = 4096) -> DataFrame:
    """Per document of the files: its id, ids of all documents before it, ids of its own, their CRC-32.

    The checksum is of the ids as little-endian unsigned 32-bit integers, whatever the files hold.
    Each part is mapped by one task; only the pages looked at are in memory.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = open_folder(row["folder"])
                path = f"{path}/{row['part']}"
                ids = _mapped(system, f"{path}.bin", f"<u{row['id_bits'] // 8}")
                offsets = _mapped(system, f"{path}.idx", "<u8").astype(np.int64)
                docs = _mapped(system, f"{path}.doc", "<i8")
                for at in range(0, len(docs), docs_a_batch):
                    own = offsets[at : at + docs_a_batch + 1]
                    sums = [
                        zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1], own[1:], strict=True)
                    ]
                    of = np.array(docs[at : at + docs_a_batch], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(of, pa.int64(), mask=of == _NO_ID),
                            pa.array(own[:-1] + row["base"], pa.int64()),
                            pa.array(np.diff(own), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    # As many tasks as parts, said outright: the rows are few and small, the files are not.
    return manifest.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(read, schema)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, as read back from the files.

    The vocabulary has 49,408 ids, so the files hold 16-bit integers.
    """
    import public_tokenizers

    folder = new_folder(spark, "token-ids")
    manifest = write_token_files(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1, id_bits=16
    )
    return read_token_files(manifest)
