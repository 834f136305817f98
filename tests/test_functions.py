"""Column expressions against Python's own behaviour on small frames."""

from __future__ import annotations

import json
import mimetypes
import pathlib
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fileledger.functions import attrs, metadata, names, sizes, text, times

NAMES = [
    ".bashrc", "a.tar.gz", "a.", "b.txt~", "x~", "A.TXT", ".a.b", "..a", "a..b", "no ext", "x.tgz",
    "x.svgz", "Y.TGZ", "archive.Z", "a.gz", "page.html.gz", "new\nline.txt", "été.PDF", "a.b.c.json",
    "x.tgz.gz", ".gz", "..gz", "movie.MP4",
]


def column(spark, values, expression, kind="string"):
    """Values of an expression over a column `v`, in the order given."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = frame.select("i", expression(F.col("v")).alias("r")).collect()
    return [row.r for row in sorted(rows, key=lambda row: row.i)]


def test_base_name(spark):
    paths = ["/a/b.txt", "C:\\d\\e.txt", "plain", "/with space/x y"]
    assert column(spark, paths, names.base_name) == ["b.txt", "e.txt", "plain", "x y"]


def test_suffix_like_pathlib(spark):
    expected = [pathlib.PurePosixPath(n).suffix.lower() for n in NAMES]
    assert column(spark, NAMES, names.suffix) == expected


def test_mime_like_python(spark):
    known = mimetypes.MimeTypes()
    expected = {n: known.guess_type(n)[0] or "application/octet-stream" for n in NAMES}
    frame = spark.createDataFrame([(n,) for n in NAMES], "name string")
    assert {r.name: r.mime for r in names.with_mime(frame).collect()} == expected


def test_mime_table_stays_small():
    assert len(names.mime_pairs()) < 200


@pytest.mark.parametrize(
    "ext, extractor",
    [
        (".pdf", "pdf"), (".docx", "docx"), (".xlsx", "xlsx"), (".pptx", "pptx"), (".txt", "text"),
        (".csv", "text"), (".json", "text"), (".jpg", "image"), (".jpeg", "image"),
        (".png", "image"), (".tiff", "image"), (".bmp", "image"), (".mp3", "audio"),
        (".flac", "audio"), (".wav", "audio"), (".ogg", "audio"), (".mp4", "video"),
        (".avi", "video"), (".mkv", "video"), (".mov", "video"), (".xyz", None), ("", None),
    ],
)
def test_extractor(spark, ext, extractor):
    assert column(spark, [ext], names.extractor_for) == [extractor]


def test_attribute_names(spark):
    bits = [0, 1, 2, 4, 32, 39, 16, 33, None]
    assert column(spark, bits, attrs.attribute_names, "int") == [
        "normal", "readonly", "hidden", "system", "archive", "readonly,hidden,system,archive",
        "normal", "readonly,archive", "normal",
    ]


def test_owner(spark):
    assert column(spark, ["D\\me", None], attrs.owner_or_unknown) == ["D\\me", "unknown"]


SIZES = {
    "0": 0, "1B": 1, "1.5KB": 1536, "100MB": 104857600, "2gb": 2147483648,
    " 3 TB ": 3298534883328, "77": 77, "0.3B": 0, "1e3kb": 1024000, ".5MB": 524288, "-2KB": -2048,
}
NOT_SIZES = ["", "KB", "1.5", "12 XB", "ten MB", "1..2MB", "MB12"]


def test_size_text(spark):
    texts = list(SIZES) + NOT_SIZES + [None]
    got = column(spark, texts, sizes.size_in_bytes)
    assert got == list(SIZES.values()) + [None] * (len(NOT_SIZES) + 1)
    assert {t: sizes.parse_size(t) for t in SIZES} == SIZES
    for wrong in NOT_SIZES:
        with pytest.raises(ValueError):
            sizes.parse_size(wrong)


def test_megabytes_round_like_python(spark):
    values = [0, 1, 104988672, 105119744, 5242, 52428, 1048576, 10**12, 104857600 + 131072]
    assert column(spark, values, sizes.megabytes, "bigint") == [round(v / 1048576, 2) for v in values]


def test_size_priority(spark):
    values = [0, 1023, 1024, 1048575, 1048576, 10485759, 10485760, 10**15]
    assert column(spark, values, sizes.size_priority, "bigint") == [100, 100, 50, 50, 10, 10, 1, 1]


EPOCHS = [0.0, 1577836800.0, 1700000000.123456, 1700000000.9999996, 1.0078125, 1234567890.0000005, -1.5]


def test_from_epoch_like_python(spark):
    expected = [datetime.fromtimestamp(e, timezone.utc).replace(tzinfo=None) for e in EPOCHS]
    assert column(spark, EPOCHS + [None], times.from_epoch, "double") == expected + [None]


def test_from_epoch_takes_the_zone_given(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, [1700000000.5], lambda c: times.from_epoch(c, "Asia/Tokyo"), "double")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2023, 11, 15, 7, 13, 20, 500000)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Australia/Lord_Howe"])
def test_whole_days_like_python(spark, zone):
    now = datetime(2024, 3, 11, 12, 0, 0, 1)
    moments = [
        now, now - timedelta(days=1), now - timedelta(days=1, microseconds=-1),
        now - timedelta(days=366, hours=23), now + timedelta(hours=1), now + timedelta(days=2),
        datetime(2024, 3, 10, 2, 30), None,
    ]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = column(spark, moments, lambda c: times.whole_days(c, times.ntz(now)), "timestamp_ntz")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(now - m).days if m else None for m in moments]


def test_iso_text_like_python(spark):
    moments = [datetime(2024, 1, 31, 8), datetime(2024, 1, 31, 8, 0, 0, 120), datetime(1999, 12, 31, 23, 59, 59, 500000), None]
    got = column(spark, moments, times.iso_text, "timestamp_ntz")
    assert got == [m.isoformat() if m else None for m in moments]


TEXTS = [
    "", "\n", "a\r\nb\rc\n", "line1\nline2\nline3\n", "\u00a0\u2003\u3000", " \t\x1c\x1f\x85", "x",
    "\r", "\r\r\n\n", "no newline", "é\U0001f600\r\n", "\u200b", "\ufeff",
]


def _stats(value: str) -> tuple:
    value = value.replace("\r\n", "\n").replace("\r", "\n")
    return len(value.split("\n")), len(value), len(value.strip()) == 0


def test_text_stats_like_python(spark):
    got = column(spark, TEXTS, text.text_stats)
    assert [tuple(row) for row in got] == [_stats(t) for t in TEXTS]


def test_text_stats_of_null(spark):
    row = column(spark, [None], text.text_stats)[0]
    assert tuple(row) == (None, None, None)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \r\n\u00a0é\x1d", max_size=12), min_size=30, max_size=60))
def test_text_stats_on_any_text(spark, values):
    got = column(spark, values, text.text_stats)
    assert [tuple(row) for row in got] == [_stats(t) for t in values]


def test_bad_bytes_are_left_out(spark):
    raw = [b"ok", b"a\xffb", b"\xc3", "é\ufffd".encode(), b"\xe2\x82x", b"", None, b"\xed\xa0\x80y"]
    got = column(spark, [bytearray(r) if r is not None else None for r in raw], text.decode_lossy, "binary")
    assert got == [r.decode("utf-8", "ignore") if r is not None else None for r in raw]


GATED = [
    (10, ".txt"), (11, ".txt"), (5, ".jpeg"), (5, ".xyz"), (5, ""), (5, ".PDF"), (11, ".xyz"), (0, ".zip"), (5, None),
]


def test_skip_reasons_in_order(spark):
    frame = spark.createDataFrame(GATED, "size bigint, ext string")
    reason = metadata.skip_reason(F.col("size"), F.col("ext"), ["txt", "pdf", "zip"], size_cap=10)
    got = [r.d for r in frame.select(metadata.skip_document(reason).alias("d")).collect()]
    assert [json.loads(d) if d else None for d in got] == [
        None,
        {"skipped": "file too large"},
        {"skipped": "extension .jpeg not in analysis list"},
        {"skipped": "extension .xyz not in analysis list"},
        {"skipped": "extension  not in analysis list"},
        None,
        {"skipped": "file too large"},
        {"skipped": "no analyzer for .zip"},
        {"skipped": "extension  not in analysis list"},
    ]


def test_parse_types():
    assert metadata.parse_types(" pdf, docx ,txt") == ["pdf", "docx", "txt"]


DOCUMENTS = [
    {"titulo": "Contrato anual", "n": 12},
    {"contrato": "x"},
    {"a": {"b": ["x", {"c": "o contrato novo"}]}},
    {"a": 'say "contrato": yes'},
    {"a": "back\\slash", "k": "100% _done_"},
    {"a": "tab\there", "u": "ação \U0001f600"},
    ["contrato"],
    "contrato",
    {"quoted\": \"contrato": 1},
    {"n": 1234, "t": True, "z": None},
    {"a": "", "b": "CONTRATO"},
    {"a": "line\nbreak"},
]
KEYWORDS = [
    "contrato", "Contrato", "12", "true", "k", "x", '"contrato"', "a_ual", "con%novo", "\\\\slash", "100\\%",
    "\\_done", "ação", "_done_", "", "%", "tab\there", "line_break", "😀", "o\\", "yes\\", "a.ual", "[", "titulo", "%a%o%a", "c_n%_o", "o%\\\\", "a%t%n%z", "ao%%l", "novo%\\",
]


def _strings(value):
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for item in value:
            yield from _strings(item)
    elif isinstance(value, dict):
        for item in value.values():
            yield from _strings(item)


def _like(value: str, pattern: str) -> bool:
    """LIKE by definition, character by character."""
    if not pattern:
        return not value
    head, rest = pattern[0], pattern[1:]
    if head == "%":
        return any(_like(value[i:], rest) for i in range(len(value) + 1))
    if head == "\\" and rest:
        head, rest = rest[0], rest[1:]
        return value[:1] == head and _like(value[1:], rest)
    return bool(value) and (head == "_" or value[0] == head) and _like(value[1:], rest)


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("keyword", KEYWORDS)
def test_search_by_definition(spark, keyword, ascii_only):
    texts = [json.dumps(d, ensure_ascii=ascii_only) for d in DOCUMENTS]
    got = column(spark, texts, lambda c: metadata.has_value_like(c, keyword))
    expected = [any(_like(s, f"%{keyword}%") for s in _strings(d)) for d in DOCUMENTS]
    assert got == expected


def test_search_survives_long_strings(spark):
    long = json.dumps({"a": "x" * 2_000_000 + '"\\' * 20_000 + "needle"})
    assert column(spark, [long, None], lambda c: metadata.has_value_like(c, "needle")) == [True, None]


def test_search_time_grows_with_the_text_only(spark):
    """Tried in every way, these wildcards would take longer than anyone can wait."""
    text_of_one_letter = json.dumps({"a": "a" * 300_000})
    found = column(
        spark, [text_of_one_letter], lambda c: metadata.has_value_like(c, "a%a_a%a%a%a%a%b")
    )
    assert found == [False]
