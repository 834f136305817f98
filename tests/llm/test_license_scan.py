"""License scans against a word-by-word reckoning."""

from __future__ import annotations

import random
import re

import pytest

from fileledger.llm import license_scan
from fileledger.llm.license_scan import PHRASES, TEMPLATES

KIND = "doc_id bigint, text string, label string, words int, row string"
WORD = re.compile(license_scan._WORD)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text: str | None, phrases=PHRASES, templates=TEMPLATES, threshold=0.8):
    words = words_of(text)
    base, places = set(), []
    for phrase, label in phrases.items():
        parts = phrase.split()
        found = [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
        places += found
        base |= {label} if found else set()
    labels, score = set(base), 1.0 if places else 0.0
    for label, texts in templates.items():
        for template in texts:
            own = words_of(template)
            if not own:
                continue
            stride = 8
            while stride < len(own):
                stride *= 2
            for low in range(0, max(1, len(words) - stride), stride):
                shared = len(set(own) & set(words[low : low + 2 * stride]))
                if shared >= threshold * len(set(own)) - 1e-9:
                    labels.add(label)
                    score = score if places else max(score, shared / len(set(own)))
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score


def make_texts() -> list[str | None]:
    pick = random.Random(12)
    common = sorted({w for texts in TEMPLATES.values() for t in texts for w in words_of(t)})
    filler = ["the", "of", "and", "Über", "naïve", "mit", "license", "LICENSE", "cc", "by", "GNU", "general", "日本", "x1", "K", "İ"]

    def line(size: int) -> str:
        return "".join(pick.choice(filler) + pick.choice([" ", "\n", ", ", "-", "\t", "·"]) for _ in range(size))

    texts: list[str | None] = [None, "", " \n", "MIT License", "mit-license mit license", "MIT  LICENSE" * 3, "cc by cc by CC-BY", "mit licenses", "summit license"]
    texts += ["the Apache\nLicense gnu GENERAL public license", "mit ſ license", "MIT LİCENSE", "gnu general public", "ccby", "a" * 5000]
    for every in TEMPLATES.values():
        for template in every:
            texts.append(template)
            for share in (0.95, 0.85, 0.75, 0.5):
                kept = [w for w in template.split() if pick.random() < share]
                texts.append(line(pick.randrange(40)) + " ".join(kept) + " " + line(pick.randrange(300)))
            shuffled = template.split()
            pick.shuffle(shuffled)
            texts.append(line(7) + " ".join(shuffled))
    texts += [" ".join(pick.choices(common + filler, k=pick.randrange(1, 400))) for _ in range(60)]
    texts.append(line(30_000) + TEMPLATES["bsd"][0] + line(10) + "mit license")
    return texts + texts[:9]


def test_scan_by_definition(spark):
    texts = make_texts()
    rows = [(None if k % 11 == 5 else k % 97, t, "mine", 3, "r") for k, t in enumerate(texts)]
    found = license_scan.license_scan(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(r[0], *brute(r[1])) for r in rows], key=repr)
    assert len({r.labels for r in found}) > 12


@pytest.mark.parametrize("threshold", [0.3, 0.6, 1.0])
def test_other_templates_and_thresholds(spark, threshold):
    pick = random.Random(int(threshold * 10))
    letters = "abcdefghij"
    templates = {"one": ("a",), "two": ("a b c", "c d e f g h i j a b c d"), "three": ("j i h g f e d c b",), "none": ("...",)}
    phrases = {"a b": "ab", "j": "j"}
    texts = [" ".join(pick.choices(letters, k=pick.randrange(0, 60))) for _ in range(150)]
    frame = spark.createDataFrame([(k, t, "", 0, "") for k, t in enumerate(texts)], KIND)
    found = {r.doc_id: tuple(r)[1:] for r in license_scan.license_scan(frame, phrases, templates, threshold).collect()}
    assert found == {k: brute(t, phrases, templates, threshold) for k, t in enumerate(texts)}


def test_no_rows_no_templates_too_many_words(spark):
    frame = spark.createDataFrame([(1, "the mit license", "", 0, "")], KIND)
    assert license_scan.license_scan(frame.limit(0)).count() == 0
    assert tuple(license_scan.license_scan(frame, templates={}).first()) == (1, 3, 1, 1, 1, "mit", "mit", 1.0)
    with pytest.raises(ValueError, match="templates of more than"):
        license_scan.license_scan(frame, templates={"x": [" ".join(f"w{k}" for k in range(30_000))]})
    with pytest.raises(ValueError, match="threshold"):
        license_scan.license_scan(frame, threshold=0.0)


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "the mit license", "", 0, "")], KIND)
    plan = license_scan.license_scan(frame)._jdf.queryExecution().toString()
    assert not re.search("Python|MapInArrow|Pandas|BroadcastNestedLoop|Cartesian", plan)


def test_filters_leave_few_candidates(spark):
    """Blocks without a rare template word never meet a template."""
    texts = ["to the of or for and this is in with " * 40 for _ in range(50)] + [TEMPLATES["bsd"][0]]
    frame = spark.createDataFrame([(k, t, "", 0, "") for k, t in enumerate(texts)], KIND)
    known = license_scan._templates(TEMPLATES, 0.8)
    given = frame.select("doc_id", license_scan.words_of("text").alias("words"))
    order = license_scan._in_order(given, sorted({w for t in known for w in t.words}))
    rank = {w: k for k, w in enumerate(order)}
    assert order.index("redistribution") < order.index("the") and order[-1] in texts[0]
    blocks = given.select(*[license_scan._blocks(s, [t for t in known if t.stride == s], rank).alias(f"s{s}") for s in sorted({t.stride for t in known})])
    assert sum(len(blocks_) for row in blocks.limit(50).collect() for blocks_ in row) == 0
