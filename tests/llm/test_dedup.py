"""Near and substring deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from configlens.llm import near_dedup, queries, substring_dedup
from configlens.llm.common import Words
from configlens.llm.components import components
from configlens.llm.common import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(docs):
    """doc_id: (set size, smallest reachable id), all pairs compared."""
    sets = {d: shingles(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def brute_kept(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        words = WORD.findall(docs[d] or "")
        gone = np.zeros(len(words), dtype=bool)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = True
            seen.add(window)
        out[d] = (len(words), int(gone.sum()), hashlib.sha256(" ".join(w for w, g in zip(words, gone, strict=True) if not g).encode()).hexdigest())
    return out


def corpus(seed, n=120):
    """Copies, chains of edits, shared passages, short and odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    fresh = lambda k: [rng.choice(words) for _ in range(k)]
    passage, docs = fresh(60), {}
    for i in range(n):
        kind = i % 8
        earlier = docs[rng.randrange(i)].split() if i else []
        if kind == 0 or not earlier:
            text = fresh(rng.randint(1, 200))
        elif kind == 1:
            text = earlier
        elif kind in (2, 3, 4):
            text = list(earlier)
            for _ in range(max(1, len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 5:
            text = fresh(20) + passage + fresh(15)
        elif kind == 6:
            text = fresh(3) * rng.randint(1, 30)
        else:
            text = earlier[: max(1, len(earlier) * 9 // 10)]
        docs[i] = " ".join(text)
    return docs


ODD = {1000: None, 1001: "", 1002: " \n\t", 1003: "A b", 1004: "a B", 1005: "A\x0bb", 1006: "x " * 30000, 1007: "é É " * 9, 1008: "é É " * 9}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed) | ODD
    rows = spark.createDataFrame([(d, t, 1, "c") for d, t in docs.items()], "doc_id bigint, text string, class int, component_id string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == brute_components(docs)


def test_op6_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    expected = brute_components(docs)
    for r in queries.op6_near_dedup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_rows_without_or_with_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    rows = spark.createDataFrame([(None, a), (5, a), (None, b), (7, a), (7, a), (7, "other words that are here alone")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 5, False), (5, 5, True), (None, None, True), (7, 5, False), (7, 5, False), (7, 7, True)], key=str)
    assert near_dedup.near_duplicates(rows.limit(0)).count() == 0


def test_keys_of_bands_are_made_and_moved_once(spark, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), near_dedup.bands

    def counted(classes):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        return real(classes).mapInArrow(run, "key bigint, class bigint")

    monkeypatch.setattr(near_dedup, "bands", counted)
    docs = corpus(5)
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(rows).collect()}
    assert got == brute_components(docs)
    classes = {frozenset(s) for s in map(shingles, docs.values()) if len(s) > 2}
    assert made.value == len(classes) * near_dedup.REGISTERS // near_dedup.BAND


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.3, 0.6, 0.75, 0.9):
        for n in (200, 2000):
            both, a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (int(n * share), (n - int(n * share)) // 2, (n - int(n * share)) // 2))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            size = lambda v: np.array([float(len(v))])
            guess, _ = near_dedup.estimate(near_dedup.registers(x)[None], near_dedup.registers(y)[None], size(x), size(y))
            errors.append(abs(guess[0] - len(both) / (len(both) + len(a) + len(b))))
    assert max(errors) < 0.12 and np.mean(errors) < 0.04


def test_components_of_a_chain_and_a_star(spark):
    work = Workspace(spark, "test")
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2)], "a bigint, b bigint")
    got = {r["class"]: r.component for r in components(edges, work, "chain").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components(edges.limit(0), work, "none").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_equal_brute_force(spark, seed):
    docs = corpus(seed) | ODD
    rows = spark.createDataFrame([(d, t, 3, "c", d) for d, t in docs.items()], "doc_id bigint, text string, first int, spans string, id bigint").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(substring_dedup.dedup_substrings(rows)).collect()}
    assert got == brute_kept(docs)


def test_substrings_of_another_corpus(spark):
    docs = corpus(4)
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(substring_dedup.dedup_substrings(rows)).collect()}
    assert got == brute_kept(docs)


@pytest.mark.parametrize("group", [1, 7, 60])
def test_suffix_groups_stay_within_their_bound(spark, monkeypatch, group):
    """One passage in a third of all documents, one endless repeat: no group is larger, and results are the same."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rng = random.Random(9)
    fresh = lambda k: [f"w{rng.randrange(500)}" for _ in range(k)]
    passage = fresh(31)
    docs = {i: " ".join(fresh(25) + (passage if i % 3 == 0 else []) + fresh(rng.randrange(30))) for i in range(90)} | {500: "again and " * 400, 501: "x again and " * 30}
    rows = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    sizes, real = [], substring_dedup.tree_repeats

    def counted(rows):
        sizes.extend(r["count"] for r in rows.groupBy("prefix", "depth").count().collect())
        return real(rows)

    monkeypatch.setattr(substring_dedup, "tree_repeats", counted)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.digests(substring_dedup.dedup_substrings(rows)).collect()}
    assert got == brute_kept(docs) and max(sizes, default=0) <= group


def test_deep_leaves_are_those_of_equal_suffixes():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, (300, 6)).astype("<u4")
    group = np.sort(rng.integers(0, 4, 300))
    leaf, node = substring_dedup.deep_leaves(group, words)
    keys = [(group[i], *words[i]) for i in range(300)]
    assert sorted(leaf) == [i for i in range(300) if keys.count(keys[i]) > 1]
    assert len({(n, keys[i]) for i, n in zip(leaf, node, strict=True)}) == len(set(node)) == len({keys[i] for i in leaf})


def test_links_survive_a_sure_pair_that_is_none(spark, monkeypatch):
    """Every pair that may be a link counts as sure, so wrong pairs lead; full sets refuse them and no link is lost."""
    monkeypatch.setattr(near_dedup, "one_hub", lambda met: met.selectExpr("class AS a", "hub AS b").limit(0))
    docs = corpus(7)
    rows, real = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), near_dedup.across
    calls = []

    def leading(named, classes, work, by_lead=True):
        calls.append(by_lead)
        found = real(named, classes, work, by_lead)
        if by_lead:  # of each component one pair, and that a wrong one
            lone = classes.selectExpr("min(class) AS a", "max(class) AS b")
            return lone.selectExpr("a", "b", "true AS lead")
        return found

    monkeypatch.setattr(near_dedup, "across", leading)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(rows).collect()}
    assert calls == [True, False] and got == brute_components(docs)


def test_op7_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op7_substring_dedup(spark, sf_dir).collect()}
    assert got == brute_kept(docs)


def test_substrings_with_odd_ids(spark):
    long = " ".join(f"v{i}" for i in range(25))
    rows = spark.createDataFrame([(None, long), (2, long), (3, "a " * 25), (3, long), (4, long)], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(rows).collect())
    assert [got[0], *got[3:]] == [("2", 25, 0), ("4", 25, 25), ("None", 25, 25)]
    assert {got[1][2], got[2][2]} == {24, 25}
    assert substring_dedup.dedup_substrings(rows.limit(0)).count() == 0


def test_words_are_those_of_the_pattern():
    texts = [b"", b" \x0b\x0c", "A\x1cb é\x85x\xa0y  z".encode(), b"x" * 300, b"x" * 301]
    words = Words(texts)
    joined = b"\n".join(texts) + b"\n"
    for k, text in enumerate(texts):
        a, b = words.starts[k], words.starts[k + 1]
        assert [joined[i:j] for i, j in zip(words.begin[a:b], words.end[a:b], strict=True)] == re.findall(rb"[^\x20\x09-\x0D]+", text)
    assert words.hashes[-1] != words.hashes[-2]
