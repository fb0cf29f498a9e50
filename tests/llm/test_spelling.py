"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from configlens.llm import queries, spelling
from configlens.llm.common import Workspace


def brute_counts(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            yield from (word[:i] + c + word[i + 1 :] for c in letters)


def brute_variants(counts):
    letters, out = sorted(set("".join(counts))), {}
    for word, n in counts.items():
        near = {w for w in edits(word, letters) if w in counts and w != word}
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 5 * n else None
        out[word] = (form, n, len(near), counts[form] if form else None)
    rows = {}
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows[word] = (form, root, n, n_near, form_n)
    return rows


def as_dict(frame):
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


def test_op11_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = brute_variants(brute_counts(docs))
    assert as_dict(queries.op11_spelling_variants(spark, sf_dir)) == expected
    assert sum(x[2] > 0 for x in expected.values()) > 100


@pytest.mark.parametrize("block", [2, 5, 48])
def test_skewed_blocks_are_subdivided(spark, block):
    rng = random.Random(block)
    words = {"abcdef" + "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 5))) for _ in range(300)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) + "stuvwx" for _ in range(200)} | {"aaaaaa" + "a" * k for k in range(9)} | {"q" * 3000, "q" * 3001}
    counts = {w: rng.choice([5, 6, 30, 200, 1200]) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert as_dict(spelling.variants(frame, block=block)) == brute_variants({w: n for w, n in counts.items() if len(w) < 100}) | {
        "q" * 3000: _long(counts, 3000, 3001), "q" * 3001: _long(counts, 3001, 3000)
    }
    sizes = spelling.blocks(frame, Workspace(spark, "blocks"), block).groupBy("head", "tail", "size", "low", "high").count()
    assert sizes.where(f"count > {block} AND high - low > 1").isEmpty()


def _long(counts, own, other):
    n, m = counts["q" * own], counts["q" * other]
    has = m >= 5 * n
    return ("q" * other if has else None, "q" * (other if has else own), n, 1, m if has else None)


def test_chains_of_forms(spark):
    counts = {"abcdef" + "g" * k: 5 ** (k + 1) for k in range(9)}
    found = as_dict(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint")))
    assert {x[1] for x in found.values()} == {"abcdef" + "g" * 8}


def test_nulls_ties_repeats_and_clashing_columns(spark):
    text = "Mirror mirror MIRROR mirrór " * 3 + "mirror9mirrors×"
    rows = [(1, text, "w", 1), (1, text, "w", 1), (None, text, "w", 2), (4, None, None, None), (5, "", "", 0), (6, "!!! \n", "", 0), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, word string, n bigint")
    assert as_dict(spelling.spelling_variants(docs)) == brute_variants(brute_counts([r[:2] for r in rows]))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    tied = spark.createDataFrame([("worded", 5), ("worden", 50), ("wordem", 50), (None, 9)], "word string, n bigint")
    assert as_dict(spelling.variants(tied))["worded"] == ("wordem", "wordem", 5, 2, 50)


def test_tasks_hand_on_bounded_tables(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {tuple(r) for r in spelling.word_counts(docs).collect()}
    monkeypatch.setattr(spelling, "HELD", 50)
    assert {tuple(r) for r in spelling.word_counts(docs).collect()} == whole
