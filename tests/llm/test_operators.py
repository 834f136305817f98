"""The operators against brute force, on hand-made texts with all the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from fileledger.llm import (
    decontamination,
    flat,
    language,
    pieces,
    repeated_bytes,
    repeated_words,
    simhash,
    token_files,
    toxicity,
    weighted_sampling,
)
from fileledger.llm.components import components
from fileledger.llm.run_index import RunIndex
from fileledger.llm.shared_files import new_folder
from fileledger.llm.sketch import maybe_in_filter, maybe_repeated, repeated_cells, repeated_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SHARED = "this passage of some words is long enough to be found wherever it is put by anyone at all "


def make_texts() -> list[tuple[int | None, str | None]]:
    """Random texts, copies, shared passages, empty, null, odd and long ones, and repeated rows."""
    pick = random.Random(3)
    words = ["al", "be", "ça", "do", "Él", "fu", "gö", "he", "日本", "x1", "😀", "don't", "the", "of"]

    def text(size: int) -> str:
        return "".join(pick.choice(words) + pick.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(size))

    rows: list[tuple[int | None, str | None]] = []
    for i in range(60):
        body = text(pick.randrange(0, 80))
        if i % 3 == 0:
            cut = pick.randrange(len(body) + 1)
            body = body[:cut] + SHARED[pick.randrange(8) :] + body[cut:]
        rows.append((i, body))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 5)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "▁▁ a▁b"), (204, "\x00\x01 \x1f"), (205, "é İ ſ")]
    rows += [(206, "ab" * 2000), (207, "ab" * 1500 + SHARED), (208, " " * 300 + "q"), (209, text(6000))]
    rows += [(210, rows[3][1]), (210, rows[3][1]), (210, rows[6][1]), (None, rows[9][1]), (None, None)]
    return rows


TEXTS = make_texts()


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text: str | None) -> bytes:
    return (text or "").encode()


def order(rows) -> list:
    return sorted(map(tuple, rows), key=repr)


# Pieces


def test_pieces_are_those_of_the_library(spark, documents, nothing):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    clash = documents.withColumn("decoded", F.lit(1)).withColumn("extra", F.array(F.lit(1)))
    got = pieces.piece_ids(clash, path)
    assert got.columns == [*SCHEMA.replace(",", "").split()[::2], "extra", "piece_ids", "decoded"]
    for row in got.collect():
        assert row.piece_ids == library.encode(row.text or "")
        assert row.decoded == library.decode(row.piece_ids)
    assert pieces.piece_ids(nothing, path).count() == 0


def test_word_memory_is_bounded(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    from fileledger.llm import words

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(words, "MOST_WORDS", 10)
    own = pieces.Vocabulary(path)
    for _, text in TEXTS:
        ids, starts = own.encode([raw(text)])
        assert ids.tolist() == library.encode(text or "") and starts.tolist() == [0, len(ids)]


def _long_words(size: int) -> list[str]:
    rng = np.random.default_rng(size)
    letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), size)
    parts = rng.choice(["the", "th", "in", "ing", "tion", "er", "he", "\u00e9", "\u4e2d", "7", "Q"], size // 3)
    made = ["".join(letters), "".join(parts), "the" * (size // 3), "a" * size, "-" * size, " " * size]
    return [*made, f"{made[0]} {made[1]}  short {made[2]}x", made[1] + " " * 200 + made[0]]


@pytest.mark.parametrize("size", [130, 400, 3000])
def test_long_words_are_those_of_the_library(size):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    own = pieces.Vocabulary(path)
    texts = _long_words(size)
    ids, starts = own.encode([x.encode() for x in texts])
    for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
        assert ids[a:b].tolist() == library.encode(text)


def test_work_on_long_words_grows_with_their_length(monkeypatch):
    own = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    seen = []
    look = own.merge_of
    monkeypatch.setattr(own, "merge_of", lambda left, right: seen.append(len(left)) or look(left, right))

    def work(text: str) -> tuple[int, int]:
        seen.clear()
        own.encode([text.encode()])
        return sum(seen), len(seen)

    for short, long in zip(_long_words(6000), _long_words(12000), strict=True):
        pairs, rounds = work(short)
        more_pairs, more_rounds = work(long)
        assert more_pairs <= 2.3 * pairs and more_rounds <= 2.3 * rounds


# Token files


@pytest.mark.parametrize("bits", [16, 32])
def test_token_files(spark, documents, nothing, bits):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(documents, new_folder(spark, "t"), path, 1, bits)
    got = token_files.read_token_files(manifest, docs_a_batch=3).collect()
    assert len(got) == len(TEXTS)
    got.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)]).tolist()[:-1]
    want = []
    for i, text in TEXTS:
        own = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, len(own), zlib.crc32(own.tobytes())))
    assert order((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == order(want)
    empty = token_files.write_token_files(nothing, new_folder(spark, "t"), path, 1, bits)
    assert token_files.read_token_files(empty).count() == 0


# Decontamination


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_contamination(spark, documents, nothing, item_bytes):
    items = [(1, SHARED), (2, "Al BE"), (10, None), (11, ""), (12, "ça, do! él? fu gö he"), (None, "x1 x1"), (1, SHARED), (3, "xyzzy " * 12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(documents, benchmark, item_bytes=item_bytes)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def lower(text):
        return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")

    windows: dict[tuple, set] = {}
    for item, text in items:
        own = word.findall(lower(text))
        for k in range(max(1, len(own) - 9)) if own else ():
            windows.setdefault(tuple(own[k : k + 10]), set()).add(item)
    for row in got.collect():
        own = list(word.finditer(lower(row.text)))
        hit, of = set(), set()
        for window, owners in windows.items():
            for k in range(len(own) - len(window) + 1):
                if tuple(m[0] for m in own[k : k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    of |= owners
        assert (row.n_words, row.n_hit, row.contaminated) == (len(own), len(hit), bool(hit))
        assert row.item_ids == sorted(str(x) for x in of if x is not None)
        inside = {k for a, b in zip(row.hits[::2], row.hits[1::2]) for k in range(a, b)}
        assert all((m.start() in inside) == (k in hit) for k, m in enumerate(own))
    assert decontamination.contamination(nothing, benchmark).count() == 0
    clean = decontamination.contamination(documents, benchmark.limit(0))
    assert clean.filter("contaminated").isEmpty() and clean.count() == len(TEXTS)


# Repeated words and bytes


def removed(texts, cut, size):
    """For each text, which of its parts are covered by windows that a smaller id holds too."""
    first: dict = {}
    last = float("inf")
    for i, text in texts:
        own = cut(text)
        for k in range(len(own) - size + 1):
            key = own[k : k + size]
            key = key if isinstance(key, bytes) else tuple(key)
            first[key] = min(first.get(key, last), last if i is None else i)
    for i, text in texts:
        own, gone = cut(text), set()
        for k in range(len(own) - size + 1):
            key = own[k : k + size]
            key = key if isinstance(key, bytes) else tuple(key)
            if first[key] < (last if i is None else i):
                gone.update(range(k, k + size))
        yield i, own, gone


def test_repeated_words(documents, nothing, monkeypatch):
    want = []
    for i, own, gone in removed(TEXTS, lambda t: raw(t).split(), 13):
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone).decode()
        want.append((i, len(own), len(gone), kept))
    for bits, windows in ((29, repeated_words.RANGE_WINDOWS), (16, 50)):
        got = repeated_words.without_repeats(documents, most_bits=bits, range_windows=windows)
        assert order(got.select("doc_id", "n_words", "n_removed", "kept").collect()) == order(want)
    assert sum(w[2] for w in want) > 300
    assert repeated_words.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("bucket_bytes", [repeated_bytes.BUCKET_BYTES, 200])
def test_repeated_bytes(documents, nothing, bucket_bytes):
    want = []
    for i, own, gone in removed(TEXTS, raw, 50):
        spans = sum(k - 1 not in gone for k in gone)
        kept = bytes(b for k, b in enumerate(own) if k not in gone)
        want.append((i, len(own), len(gone), spans, kept))
    got = repeated_bytes.without_repeats(documents.withColumn("kept", F.lit(1)), bucket_bytes=bucket_bytes)
    rows = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert order((*r[:4], bytes(r[4])) for r in rows) == order(want)
    assert sum(w[2] for w in want) > 3000
    assert repeated_bytes.without_repeats(nothing).count() == 0


def test_many_documents_without_id_or_with_the_largest(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    last = 2**63 - 1
    rows = [(3, passage), *((None, f"n{k} {passage} m{k}") for k in range(40)), (last, passage), (last, f"{passage} more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    words = repeated_words.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept").collect()
    want = [(3, 30, 0, passage), *((None, 32, 30, f"n{k} m{k}") for k in range(40)), (last, 30, 30, ""), (last, 31, 30, "more")]
    assert order(words) == order(want)
    found = repeated_bytes.without_repeats(docs).select("doc_id", "kept").collect()
    kept = [(3, passage), *((None, f"n{k}  m{k}") for k in range(40)), (last, ""), (last, " more")]
    assert order((r[0], bytes(r[1])) for r in found) == order((i, x.encode()) for i, x in kept)


def test_known_segments_are_dealt_apart(spark):
    """One passage in every document: no task of the shuffle gets a large part of the rows."""
    passage = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(k, passage) for k in range(2000)], "doc_id bigint, text string").coalesce(1)
    doc = np.arange(1, 2000)
    spread = repeated_bytes.known_buckets(np.full(len(doc), 77, np.uint64), doc)
    assert (spread < 0).all() and len(np.unique(spread)) > 1900
    got = repeated_bytes.without_repeats(docs)
    assert got.filter("n_removed = n_bytes").count() == 1999


def held_segments(texts: list[bytes]) -> repeated_bytes._Held:
    """The segments of texts, the number of a text being its document."""
    offsets = np.cumsum([0, *map(len, texts)])
    found = repeated_bytes.segments(np.frombuffer(b"".join(texts), np.uint8), offsets)
    wide, key = repeated_bytes._wide(found.data, found.start), (found.key >> np.uint64(32)).astype(np.uint32)
    return repeated_bytes._Held(key, found.one, found.two, found.text, found.end - found.start, wide)


def test_only_segments_that_share_a_key_are_indexed():
    pick = np.random.default_rng(5)
    passage, other = (pick.integers(97, 123, 300, dtype=np.uint8).tobytes() for _ in range(2))
    # Equal segments need no index, and neither do those that are alone with their key.
    first, doc, _, size = repeated_bytes._firsts([held_segments([passage, other]), held_segments([passage, passage])])
    assert not list(repeated_bytes._with_others(first, 1 << 17))
    assert (first.doc[first.doc > 0] == 1).all() and (doc == 1).all() and (size >= 50).all()
    # One byte of a copy differs: what lies over it is indexed with what it was, a key at a time if asked for.
    changed = passage[:150] + b"." + passage[151:]
    first, *_ = repeated_bytes._firsts([held_segments([passage, changed])])
    parts = list(repeated_bytes._with_others(first, 1))
    at = np.concatenate(parts)
    assert 2 <= len(at) < len(first.key) / 2
    assert all(len(np.unique(first.key[x])) == 1 and len(x) > 1 for x in parts)
    assert len(list(repeated_bytes._with_others(first, 1 << 17))) == 1
    # Of the strings over the changed byte none is marked, of the others all.
    marked = {}
    for batch in repeated_bytes._repeated_strings(first.taken(at)):
        assert set(batch.column("doc_id").to_pylist()) == {1}
        marked |= dict(zip(batch.column("segment").to_pylist(), batch.column("strings").to_pylist()))
    found = repeated_bytes.segments(np.frombuffer(changed, np.uint8), np.array([0, 300]))
    known = set(held_segments([passage]).one.view(np.int64).tolist())
    for start, end, one in zip(found.start, found.end, found.one.view(np.int64).tolist()):
        for k in range(end - start - 49):
            assert one in known or bool(marked.get(one, 0) >> k & 1) == (not start + k <= 150 < start + k + 50)


def test_buckets_are_few_in_large_inputs():
    """Every flush of a task has a row for each bucket, so rows grow with the product of both."""
    assert repeated_bytes.bucket_count(1 << 27) == 256
    assert repeated_bytes.bucket_count(1 << 30) == 512
    assert repeated_bytes.bucket_count(10 << 30) == 2560


def test_filter_holds_repeated_hashes_only(spark):
    """Hashes that come once take no room, however many there are for the bits of the filter."""
    rows = spark.range(200_000, numPartitions=4)
    twice = rows.union(spark.range(3000, numPartitions=1))

    def hashes(batch):
        yield flat.mix(batch.column("id").to_numpy().astype(np.uint64) + np.uint64(1))

    found = repeated_filter(twice, hashes, 203_000, most_bits=16)
    assert found.filter_bits == 16
    of = flat.mix(np.arange(200_000).astype(np.uint64) + np.uint64(1))
    at = maybe_in_filter(of, found)
    assert set(range(3000)) <= set(at.tolist())
    assert len(at) < 30_000
    full = repeated_cells(twice, hashes, 203_000, most_bits=16)
    assert len(maybe_repeated(of, full)) > 150_000


def test_text_over_several_blocks_and_broken_characters():
    """What is to go lies over borders of blocks and of texts; characters stay whole, broken ones as they are."""
    pick = np.random.default_rng(6)
    long = pick.integers(97, 123, 200_000, dtype=np.uint8).tobytes()
    found = [x for x, _ in repeated_bytes._of_batch(pa.RecordBatch.from_pydict({"text": [long]}))]
    assert len(found) > 2
    segment, size = (np.concatenate(x) for x in zip(*((x.one.view(np.int64), x.end - x.start) for x in found)))
    data, text = np.frombuffer(long, np.uint8), np.zeros(len(segment), np.int64)
    gone = repeated_bytes._gone(data, np.array([0, len(data)]), text, segment, repeated_bytes._all_strings(size))
    assert gone.all()
    texts = ["äöü".encode(), b"", "äöü".encode()[1:], b"abc"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    gone = np.ones(len(data), bool)
    gone[[0, 7, 11]] = False
    whole = repeated_bytes._whole_characters(data, offsets, gone)
    assert whole.tolist() == [False] * 2 + [True] * 4 + [True, False] + [True] * 3 + [False, True, True]


def test_only_whole_characters_go(documents):
    got = repeated_bytes.without_repeats(documents, whole_characters=True).collect()
    assert all(bytes(r.kept).decode() is not None for r in got)


def test_long_texts_are_cut_into_blocks(documents, monkeypatch):
    data = np.frombuffer(raw(TEXTS[-6][1]) * 3, np.uint8)
    whole = repeated_bytes.segments(data, np.array([0, len(data)]))
    monkeypatch.setattr(repeated_bytes, "_BLOCK", 1000)
    starts = []
    for part, offsets, _, at in repeated_bytes.blocks(data, np.array([0, len(data)])):
        found = repeated_bytes.segments(part, offsets)
        starts += [at + k for a, b in zip(found.start, found.end) for k in range(a, b - 49)]
    assert sorted(starts) == list(range(len(data) - 49))
    assert sorted(k for a, b in zip(whole.start, whole.end) for k in range(a, b - 49)) == sorted(starts)


def test_matching_statistics():
    pick = np.random.default_rng(0)
    for trial in range(25):
        base = pick.integers(0, 4 if trial % 2 else 256, 200, dtype=np.uint8)
        cuts = [(a, a + pick.integers(1, 76)) for a in pick.integers(0, 120, pick.integers(1, 12))]
        strings = [base[a:b].copy() for a, b in cuts]
        for x in strings[::2]:
            x[pick.integers(0, len(x))] = pick.integers(0, 4)
        index = RunIndex(np.concatenate(strings), np.array([len(x) for x in strings]))
        rows, places = index.blocks(30)
        asked = [base[a : a + pick.integers(1, 90)].copy() for a in pick.integers(0, 120, 10)] + strings
        length, row, place = index.matching_statistics(np.concatenate(asked), np.array([len(x) for x in asked]))
        held = [x.tobytes() for x in strings]
        k = 0
        for pattern in map(bytes, asked):
            for i in range(len(pattern)):
                want = 0
                while i + want < len(pattern) and any(pattern[i : i + want + 1] in s for s in held):
                    want += 1
                assert length[k] == want
                if want:
                    found = (index.symbols[place[k] : place[k] + want] - 1).astype(np.uint8).tobytes()
                    assert found == pattern[i : i + want]
                if want >= 30:
                    own = [s + j for s, x in zip(index.starts, held) for j in range(len(x)) if x[j : j + 30] == pattern[i : i + 30]]
                    assert places[np.searchsorted(rows, row[k], side="right") - 1] == min(own)
                k += 1


# SimHash


def brute_groups(values: np.ndarray, bits: int) -> list[int]:
    group = list(range(len(values)))

    def find(a):
        while group[a] != a:
            a = group[a]
        return a

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= bits) + k + 1:
            a, b = find(k), find(int(j))
            group[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_near_values(spark, bucket):
    pick = np.random.default_rng(1)
    values = []
    for base in pick.integers(0, 2**63, 12, dtype=np.uint64):
        value = int(base) << 1 & (2**64 - 1)
        for _ in range(pick.integers(1, 25)):
            for _ in range(pick.integers(1, 5)):
                value ^= 1 << int(pick.integers(0, 64))
            values.append(value)
    values = np.unique(np.array(values, np.uint64))
    frame = spark.createDataFrame([(k, int(v)) for k, v in enumerate(values.view(np.int64))], "id bigint, value bigint")
    found = {r.node: r.root for r in components(simhash.near_values(frame, bucket=bucket)).collect()}
    assert [found.get(k, k) for k in range(len(values))] == brute_groups(values, 3)


def test_components_of_a_chain_and_odd_links(spark):
    links = [(i, i + 1) for i in range(90)] + [(500, 500), (None, 3), (200, 201), (201, 200), (200, 201)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(91)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_fingerprints_and_groups(documents, nothing):
    from xxhash import xxh64_intdigest

    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    marked = simhash.fingerprints(documents, keep=["doc_id", "text"])
    rows = simhash.near_groups(marked).collect()
    assert len(rows) == len(TEXTS)
    values = np.array([brute(r.text) for r in rows], np.uint64)
    assert values.view(np.int64).tolist() == [r.fingerprint for r in rows]
    named = [k for k, r in enumerate(rows) if r.doc_id is not None]
    groups = brute_groups(values[named], 3)
    # Rows of one id are one document.
    least: dict[int, int] = {}
    for k, g in zip(named, groups):
        least[g] = min(least.get(g, 10**9), rows[k].doc_id)
    for k, g in zip(named, groups):
        assert rows[k].component_id == least[g] or rows[k].doc_id == 210
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert simhash.near_groups(simhash.fingerprints(nothing, keep=["doc_id"])).count() == 0
    # The stage of the pipeline keeps the documents that name their group, and rows without id.
    kept = corpus_pipeline.without_near_copies(documents.sparkSession, documents, "").collect()
    first = {rows[k].doc_id for k in named if rows[k].component_id == rows[k].doc_id}
    gone = {rows[k].doc_id for k in named} - first
    assert not gone & {r.doc_id for r in kept}
    assert first - {210} <= {r.doc_id for r in kept}
    assert sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in TEXTS)
    assert all(sum(r.doc_id == i for r in kept) == 1 for i in first - {210})
    assert corpus_pipeline.without_near_copies(documents.sparkSession, nothing, "").count() == 0


# Consistent weighted sampling


def test_neighbours(documents, nothing, spark):
    got = weighted_sampling.neighbour_likeness(documents).collect()
    assert len(got) == len(TEXTS)
    texts = sorted(((i, t or "") for i, t in TEXTS if i is not None and i != 210), key=lambda r: r[0])
    by_id = {r.doc_id: r for r in got}
    for (i, own), (j, following) in zip(texts, texts[1:]):
        if 210 in range(i, j):
            continue
        half = len(own) // 2
        changed = own[: len(own) - half] + following[:half]
        row = by_id[i]
        assert (row.n_chars, row.edited_sha256) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        found = weighted_sampling.signatures([raw(own), raw(changed), raw(following)])
        assert row.fingerprint == found[0].astype(">u2").tobytes().hex()
        assert row.near_edited == (found[0] == found[1]).mean() and row.near_next == (found[0] == found[2]).mean()
    assert weighted_sampling.neighbour_likeness(nothing).count() == 0
    alone = weighted_sampling.neighbour_likeness(documents.filter("doc_id = 5")).collect()
    assert [r.near_next for r in alone] == [1.0]


def test_likeness_estimates_generalised_jaccard():
    pick = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    for _ in range(8):
        one = [pick.choice(words) for _ in range(150)]
        other = one[: pick.randrange(20, 150)] + [pick.choice(words) for _ in range(60)]
        pair = weighted_sampling.signatures([" ".join(one).encode(), " ".join(other).encode()], samples=2048)
        both = sum(min(one.count(w), other.count(w)) for w in words)
        any_ = sum(max(one.count(w), other.count(w)) for w in words)
        assert abs((pair[0] == pair[1]).mean() - both / any_) < 0.05


def test_fingerprints_of_equal_and_empty_texts(spark, documents):
    rows = weighted_sampling.weighted_fingerprints(documents.withColumn("fingerprint", F.lit(0))).collect()
    by_text: dict = {}
    for row in rows:
        assert by_text.setdefault(row.text or "", row.fingerprint) == row.fingerprint
    assert by_text[""] == by_text[" \n\t "] == "f" * 256
    assert sum(v == "f" * 256 for v in by_text.values()) == 2


# Language and toxicity


def test_language(spark, documents, nothing):
    pick = random.Random(1)
    stems = {"en": "thing with the ough ing", "de": "schaft und der keit ung", "fr": "eau que des ment oux", "es": "ción los ando mente illa"}
    rows = []
    for i in range(400):
        lang = pick.choice(list(stems))
        rows.append((i, " ".join(pick.choice(stems[lang].split()) + pick.choice("aeio") for _ in range(30)), lang, "s", 0))
    made = spark.createDataFrame(rows, SCHEMA)
    model = language.learn(made.filter("doc_id < 300"), sample=60)
    found = language.identify(made.filter("doc_id >= 300").withColumn("score", F.lit("x")), model).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 98
    assert all(0 <= r.score <= 1 for r in found)
    odd = language.identify(documents, model).collect()
    assert len(odd) == len(TEXTS)
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert language.learn(nothing) is None
    assert {r.lang_pred for r in language.identify(documents, None).collect()} == {"und"}
    one = language.learn(made.filter("lang = 'en'"))
    assert {r.lang_pred for r in language.identify(made, one).collect()} == {"en"}


def test_toxicity(spark, documents, nothing):
    pick = random.Random(2)
    plain, bad = [f"word{c}" for c in "abcdefghijklmnop"], ["vile", "scum!", "VILE"]
    rows, labels = [], []
    for i in range(600):
        poor, toxic = i % 4 == 0, i % 5 == 0
        words = [pick.choice(plain) for _ in range(40)] + ([pick.choice(bad)] * 2 if toxic else []) + (["###"] * 3 if poor else [])
        pick.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not poor), int(toxic)))
    made = spark.createDataFrame(rows, SCHEMA)
    labels += [(3, None, 1), (None, 1, 1), (9999, 1, 1), (1, 1, 0)]
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    conditions = {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.learn(made.filter("doc_id < 400"), marks, conditions, sample=350)
    found = toxicity.classify(made.filter("doc_id >= 400"), chain, list(conditions)).collect()
    assert all((r.p_toxic >= 0.5) == (r.doc_id % 5 == 0) and (r.p_poor >= 0.5) == (r.doc_id % 4 == 0) for r in found)
    # The later link has a weight for the earlier probability.
    assert len(chain[1].weights) == len(chain[1].chosen) + 2
    odd = toxicity.classify(documents.withColumn("p_toxic", F.lit("x")), chain, list(conditions)).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.p_toxic < 0.5 for r in odd if not r.text)
    unlearnt = toxicity.learn(made, marks.limit(0), conditions)
    assert {r.p_toxic for r in toxicity.classify(documents, unlearnt, list(conditions)).collect()} == {0.0}
    assert toxicity.classify(nothing, chain, list(conditions)).count() == 0
