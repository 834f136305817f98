"""The registered queries: against SQL, and the pipeline stage by stage against brute force."""

from __future__ import annotations

import os
import re
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from fileledger.llm.registry import LLM_ORACLE, LLM_QUERIES
from fileledger.llm.rows import table

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    named = [name for name in queries() if re.match(r"op\d+_", name)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in named) == list(range(1, 14))
    assert "pipeline" in queries() and LLM_ORACLE.keys() <= LLM_QUERIES.keys()
    assert LLM_ORACLE.items() <= oracle_sql().items()


@pytest.mark.parametrize("name", sorted(LLM_ORACLE))
def test_query_matches_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS FROM '{SF_DIR}/{file}'")
    found = LLM_QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    relation = connection.sql(LLM_ORACLE[name])
    assert sorted(relation.columns) == columns
    want = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in found.select(*columns).collect()]
    assert len(got) > 0 and sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_stages(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "sentencepiece",
    ]
    given = table(spark, SF_DIR, "documents")
    item = table(spark, SF_DIR, "benchmark").first().text
    extra = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, item, "en", "s", len(item)), (None, "nobody's own text", "en", "s", 17)]
    copy = given.filter("doc_id = 3").withColumn("doc_id", F.lit(950).cast("bigint"))
    docs = given.unionByName(spark.createDataFrame(extra, given.schema)).unionByName(copy).unionByName(copy)
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, SF_DIR)
        if k < 4:
            assert found.columns == given.columns
        found.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in docs.collect()})
        assert docs.count() == len(kept[-1]) + (k == 0)  # from the second on one row of each document
    assert {None, 902} <= kept[0].keys()
    toxic = {r.doc_id for r in table(spark, SF_DIR, "labels").filter("toxic = 1").collect()}
    assert len(toxic - kept[0].keys()) >= 0.8 * len(toxic)
    assert 950 not in kept[1] and (3 in kept[1] or 3 not in kept[0])
    assert kept[2].keys() == kept[1].keys()
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept[2].values())
    assert 902 not in kept[3] and None in kept[3]
    assert kept[4].keys() == kept[3].keys()
    assert all(r.n_tokens == len(r.piece_ids) and r.decoded == (kept[3][i].text or "") for i, r in kept[4].items())


def test_rest_of_the_library_works_without_this_subpackage(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('fileledger.llm', 'corpus_pipeline') or name.startswith('fileledger.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert e.queries().keys() == e.oracle_sql().keys()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True)
