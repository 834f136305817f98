"""A corpus from raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and returns
documents with the columns of the table, the last one the encoded documents. Between stages `run`
writes what a stage returns to the shared folder and reads it again, so a lost executor costs a part
of a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileledger.llm import decontamination, pieces, repeated_bytes, simhash, toxicity
from fileledger.llm.rows import table
from fileledger.llm.shared_files import new_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain of classifiers does not call toxic; it learns from these documents and
    the labels."""
    conditions = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    links = toxicity.learn(docs, table(spark, sf_dir, "labels"), conditions)
    found = toxicity.classify(docs, links, list(conditions))
    return found.filter("p_toxic < 0.5").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Copies are near if the SimHash fingerprints of their three-word shingles differ in at most three
    bits; copies of copies are in the group, and texts without words are alike. Rows without id stay.
    Of rows alike in id and text one stays, the smallest by its other columns.
    """
    groups = simhash.near_groups(simhash.fingerprints(docs, keep=["doc_id"]))
    gone = groups.filter("component_id < doc_id").select("doc_id").distinct()
    kept = docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kept = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("__row")).select("doc_id", "text", "__row.*")
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what an earlier one says in the same 50 bytes or more.

    Only whole characters go. A null text stays null; a text may become empty.
    """
    found = repeated_bytes.without_repeats(docs, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    changed = found.withColumn("text", text)
    return changed.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("not contaminated").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids and the text that these decode to."""
    import public_tokenizers

    found = pieces.piece_ids(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])
    return found.withColumn("n_tokens", F.size("piece_ids").cast("bigint"))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("benchmark decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: SQL has no learnt classifier and no XXH64.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        folder = new_folder(spark, f"stage-{place}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
