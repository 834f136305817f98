"""Links between two tokenizers' tokens against a row-by-row reckoning; bitmaps against sets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import public_tokenizers
from fileledger.llm import alignment
from fileledger.llm.rows import table

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
KIND = "doc_id bigint, text string, pair string, chunk int"


def tokens(text: str):
    """(id, bytes) of both tokenizers' tokens."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    if not hasattr(tokens, "kit"):
        a = Tokenizer.from_file(A)
        a.encode_special_tokens = True
        tokens.kit = a, sentencepiece.SentencePieceProcessor(model_file=B), {}
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        tokens.kit[2].update({chr(b): b for b in letters})
        tokens.kit[2].update({chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(letters)))})
    a, b, back = tokens.kit
    one = a.encode(" " + text, add_special_tokens=False)
    first = [(i, bytes(back[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return first, second


def brute(texts: list[str | None]):
    out, links = [], []
    for text in texts:
        row, own = [0, 0, 0, 0, ""], []
        a, b = tokens(text or "")
        want = (" " + (text or "")).encode()
        if text and b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
            spans = []
            for side in (a, b):
                at, found = 0, []
                for i, x in side:
                    found.append((at, at + len(x), i))
                    at += len(x)
                spans.append(found)
            own = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
            ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
            groups, low = [], 0
            for end in ends:
                groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < end) for side in spans))
                low = end
            row = [len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()]
        out.append(row)
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most: dict[int, int] = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    return [
        (*row[:4], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), row[4])
        for row, own in zip(out, links)
    ], counts, links


def make_texts():
    pick = random.Random(8)
    words = ["the", "Tokens", "naïve", "日本語", "😀", "don't", "xyzzyq", "12345", "\n", "\t", "  ", "<|endoftext|>", "</s>", "é́", "的"]
    texts = [" ".join(pick.choices(words, k=pick.randrange(1, 40))) for _ in range(60)]
    texts += [None, "", " ", "a", "▁ x", " lead", "trail ", "\x00", "a b", "ﬁ", "x" * 500, "the " * 700, "the the"]
    return texts + texts[:20]


@pytest.mark.parametrize("chunk, postings", [(alignment.CHUNK, alignment.POSTINGS), (1 << 5, 40)])
def test_alignment(spark, monkeypatch, chunk, postings):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "_BITMAP_BYTES", chunk // 8)
    monkeypatch.setattr(alignment, "POSTINGS", postings)
    monkeypatch.setattr(alignment, "_GROUP_BYTES", 300)
    texts = make_texts()
    want, counts, links = brute(texts)
    rows = [(k, t, "x", 3) for k, t in enumerate(texts)]
    # Null and repeated ids: each row is a document, and copies of a text count.
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    kit = alignment.Tokenizers(A, B)
    if chunk != alignment.CHUNK:
        monkeypatch.setattr(alignment, "tokenizers", lambda *_: kit)
    found = {r.doc_id: tuple(r)[1:] for r in alignment.cross_alignment(frame, A, B).collect()}
    assert found == dict(enumerate(want))
    merged = alignment.merged_bitmaps(alignment.aligned(frame, A, B).filter("pair is not null"))
    got = {(r.a, r.b): (r.links, r.documents) for r in alignment.pair_counts(merged).collect()}
    held = Counter(x for own in links for x in set(own))
    assert got == {x: (n, held[x]) for x, n in counts.items()}


def test_null_and_repeated_ids_and_no_rows(spark):
    texts = ["one two", "one two", "three", None]
    want, _, _ = brute(texts)
    ids = [None, None, 7, 7]
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in zip(ids, texts)], KIND)
    found = sorted(map(tuple, alignment.cross_alignment(frame, A, B).collect()), key=repr)
    assert found == sorted([(i, *w) for i, w in zip(ids, want)], key=repr)
    assert alignment.cross_alignment(frame.limit(0), A, B).count() == 0


def test_bitmaps():
    pick = np.random.default_rng(2)
    sets = {run: np.unique(pick.integers(0, alignment.CHUNK, size)) for run, size in enumerate([1, 3, 511, 512, 520, 5000, 8192])}
    keys = np.concatenate([run << 16 | places for run, places in sets.items()])
    runs, arrays = alignment.packed(keys)
    seen = 0
    for array in arrays:
        places, counts = alignment.unpacked(array)
        at = 0
        for count in counts.tolist():
            assert places[at : at + count].tolist() == sets[int(runs[seen])].tolist()
            at, seen = at + count, seen + 1
    assert seen == len(sets)


def test_encoding_by_ranks_is_the_library(spark):
    kit = alignment.Tokenizers(A, B)
    assert kit._plain is not None
    texts = [kit.a.joined(np.array([i])).tobytes().decode(errors="ignore") for i in range(len(kit.a.lengths))]
    texts += [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    texts += [x or "" for x in make_texts()] + ["ÀÿŁ ſ ǅ ɏ 5½ \u00a0 \u0085 x\u2028y", "don't I'LL we're 12a b3 !?  \n\n x"]
    want = [x.ids for x in kit._a.encode_batch_fast([f" {x}" for x in texts], add_special_tokens=False)]
    assert kit.encode(texts)[0] == want
    plain = [k for k, x in enumerate(texts) if not alignment._NEWER.search(x)]
    assert len(plain) > 40_000 and [kit._plain(f" {texts[k]}") for k in plain] == [want[k] for k in plain]


def test_long_text(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=400_000))
    found = alignment.cross_alignment(spark.createDataFrame([(1, text, "", 0)], KIND), A, B).first()
    a, b = tokens(text)
    assert (found.n_a, found.n_b) == (len(a), len(b)) and found.count_sum >= found.n_links


def test_query(spark):
    found = alignment.op11_alignment(spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    given = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    short = sorted(given, key=lambda i: len(given[i] or ""))[:120]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == len(given)
    want, _, _ = brute([given[i] for i in short])
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) for r in map(rows.get, short)] == [(*w[:4], w[6]) for w in want]
