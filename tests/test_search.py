"""Search by postings gives the rows of the plain search, and opens the candidates only."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from fileledger.functions import metadata
from fileledger.operators import reports, search
from fileledger.schema import INVENTORY
from fileledger.sources.tables import in_inventory_layout
from test_functions import DOCUMENTS, KEYWORDS


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    texts = [json.dumps(d, ensure_ascii=k % 2 == 0) for k, d in enumerate(DOCUMENTS * 2)]
    texts += [None, "not json", "{}", json.dumps({"a": "filler " * 50 + "contrato"}), json.dumps({"a": "filler"})]
    rows = [(k, f"/f/{k}", "n", 1, t) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "file_id bigint, path string, name string, size bigint, metadata string")
    files = in_inventory_layout(frame).sortWithinPartitions("file_id")
    files.write.parquet(str(folder / "files"))
    inventory = spark.read.schema(INVENTORY).parquet(str(folder / "files"))
    search.write_postings(inventory.filter("file_id < 9"), str(folder / "postings"))
    search.write_postings(inventory.filter("file_id >= 9"), str(folder / "postings"), mode="append")
    return inventory, spark.read.parquet(str(folder / "postings"))


@pytest.mark.parametrize("named", [1000, 0])
def test_same_rows_as_the_plain_search(stored, named):
    inventory, postings = stored
    for keyword in KEYWORDS:
        want = [r.file_id for r in reports.search_metadata(inventory, keyword).collect()]
        got = [r.file_id for r in search.search_with_postings(inventory, postings, keyword, named).collect()]
        assert got == want, keyword


def test_pieces_between_wildcards():
    assert metadata.literal_pieces("con%no_vo") == ["con", "no", "vo"]
    assert metadata.literal_pieces("100\\%_\\_done\\\\") == ["100%", "_done\\"]
    assert metadata.literal_pieces("%__%") == [] and metadata.literal_pieces("") == []
    assert metadata.literal_pieces("yes\\") == ["yes%"]
    assert search.needed_trigrams("a%bcde_fg") == [0x626364, 0x636465] and search.needed_trigrams("a_b%cd") == []
    assert search.needed_trigrams("é") == [] and search.needed_trigrams("的") == [0xE79A84]


def test_trigrams_are_those_of_string_values(stored):
    inventory, postings = stored
    found = {}
    for r in postings.collect():
        found.setdefault(r.file_id, set()).add(r.trigram)

    def values(x):
        if isinstance(x, str):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from values(y)

    for k, document in enumerate(DOCUMENTS * 2):
        raw = [v.encode() for v in values(document)]
        assert found.get(k, set()) == {int.from_bytes(v[i : i + 3]) for v in raw for i in range(len(v) - 2)}


def test_only_candidates_are_opened(stored):
    inventory, postings = stored
    few = search.candidates(postings, "filler contrato")
    assert [r.file_id for r in few.collect()] == [len(DOCUMENTS) * 2 + 3]
    assert search.candidates(postings, "co_tr") is None and search.candidates(postings, "zzzz").count() == 0
    plan = search.search_with_postings(inventory, postings, "filler contrato")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(file_id,27)]" in plan  # pushed to the scan
    plan = search.search_with_postings(inventory, postings, "contrato", named=0)._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan
    of_keyword = postings.filter(F.col("trigram").isin(1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(trigram" in of_keyword
