"""Vector searches against brute force, and the pipeline's stages."""

import glob
import os
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

import corpus_pipeline
from configlens.llm import ann_search, queries, topk_search
from configlens.llm.common import Workspace


def vectors(seed=0, n=600, dim=24, norms=False):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim))
    x = centre[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.6
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * rng.uniform(0.2, 2.0, (n, 1)) if norms else x
    x[n // 3 : n // 2] = x[n // 3]  # many equal ones
    return x.astype(np.float32)


def table(spark, x):
    odd = [(9001, None), (9002, [0.0] * x.shape[1]), (9003, [None] + [1.0] * (x.shape[1] - 1)), (9004, [float("nan")] * x.shape[1]), (9005, [float("inf")] * x.shape[1]), (9006, [1.0]), (None, [1.0] * x.shape[1])]
    return spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + [(i, v, "o") for i, v in odd], "vec_id bigint, embedding array<float>, score string").repartition(3)


def best(score, ids, own, k):
    order = np.lexsort((ids, -score))
    return [int(ids[j]) for j in order if ids[j] != own][:k]


@pytest.mark.parametrize("norms", [False, True])
def test_neighbours(spark, norms):
    x = vectors(norms=norms)
    rows = ann_search.nearest(table(spark, x), F.col("vec_id") % 20 == 0).collect()
    ids, found = np.arange(len(x)), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for q, got in found.items():
        exact = x.astype(float) @ x[q].astype(float)
        assert [r["rank"] for r in got] == list(range(1, len(got) + 1)) and all(r.vec_id != q for r in got)
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        hits += len({r.vec_id for r in got} & set(best(np.round(exact, 12), ids, q, 20)))
    assert hits >= 0.9 * 20 * len(found)


def test_recall_of_op3(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in queries.op3_ann_search(spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    found = [len(got[q] & set(best(x @ x[i], ids, q, 20))) / 20 for i, q in enumerate(ids) if q % 20 == 0]
    assert np.mean(found) >= 0.9


def test_two_axes_and_salted_buckets(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "BLOCK", 32)
    monkeypatch.setattr(ann_search, "OCCUPANCY", 1)
    monkeypatch.setattr(ann_search, "ASKED", 3)
    monkeypatch.setattr(ann_search, "QUERIES", 4)
    monkeypatch.setattr(ann_search, "KEPT", 50)
    x = vectors(2)
    got = {}
    for r in ann_search.nearest(table(spark, x), F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = sum(len(set(got[q]) & set(best(np.round(x.astype(float) @ x[q].astype(float), 12), np.arange(len(x)), q, 5))) for q in got)
    assert len(got) == 12 and hits >= 0.9 * 5 * len(got)


def spread(norms, n=2000, dim=64):
    """Random directions with norms within a factor of 4, or of 1 but for one of 5 or 100."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x * (rng.uniform(0.5, 2.0, (n, 1)) if norms == "uneven" else 1.0)
    x[77] *= norms if norms != "uneven" else 1
    return x.astype(np.float32)


def recall(spark, x, every=20, k=20):
    got = {}
    for r in ann_search.nearest(table(spark, x), F.col("vec_id") % every == 0, k=k).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x, ids, asked = x.astype(float), np.arange(len(x)), range(0, len(x), every)
    assert all(len(got[q]) == k for q in asked)
    return np.mean([len(set(got[q]) & set(best(np.round(x @ x[q], 12), ids, q, k))) / k for q in asked])


@pytest.mark.parametrize("norms", ["uneven", 5.0, 100.0])
def test_recall_with_uneven_norms(spark, norms):
    assert recall(spark, spread(norms)) >= 0.95


def test_recall_of_hashed_norm_ranges(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "OCCUPANCY", 0.05)  # ranges of some tens of vectors are hashed by two axes, smaller ones searched whole
    assert recall(spark, vectors(5, norms=True), k=5) >= 0.9


def found(axes, x, neighbours):
    """Share of pairs of rows that meet in a bucket, by the production settings."""
    hashing = ann_search.Hashing(x.shape[1], axes, *ann_search.SETTINGS[axes])
    keys, probed = hashing.keys(neighbours), hashing.probed(x)
    return np.mean([any(np.isin(keys[i, t], probed[i, t]) for t in range(hashing.tables)) for i in range(len(x))])


@pytest.mark.parametrize(("axes", "similarity"), [(1, 0.36), (2, 0.45), (3, 0.6)])
def test_recall_of_settings(axes, similarity):
    """Each setting on pairs no nearer than the 20th neighbours where it applies.

    The median similarity of 20th neighbours is 0.29, 0.36 and 0.41 in 2000, 10256 and
    51282 vectors of the tables; two axes apply from 579,000 vectors on, three from 74 million.
    """
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(2, 60, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    assert found(axes, x, similarity * x + (1 - similarity**2) ** 0.5 * y) >= 0.9


def test_a_frequent_vector_hands_on_no_more_rows(spark):
    """A third of all vectors equal: their queries ask once, and each gets the smallest other ids."""
    x = vectors(6)
    x[::3] = x[0]
    rows = ann_search.nearest(table(spark, x), F.col("vec_id") % 20 == 0, k=5).collect()
    same = [i for i in range(600) if (x[i] == x[0]).all()]
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (q for q in got if q in same):
        assert [i for _, i in sorted(got[q])] == [i for i in same if i != q][:5]


def test_queries_with_few_candidates_get_all_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann_search, "SETTINGS", {1: (1, 1)})
    x = spread(1.0, n=400)
    assert recall(spark, x) == 1.0  # a single bucket of one table never holds 20


def test_memory_of_probing_is_bounded():
    """512 queries of two axes, of which each meets 128 * 128 axes in a table: 67 MB an array if all do so at once."""
    hashing = ann_search.Hashing(64, 2, *ann_search.SETTINGS[2])
    x = np.random.default_rng(9).normal(size=(512, 64))
    tracemalloc.start()
    try:
        probed = hashing.probed(x)
        assert tracemalloc.get_traced_memory()[1] < probed.nbytes + (150 << 20)
    finally:
        tracemalloc.stop()
    assert np.array_equal(probed[300:310], hashing.probed(x[300:310]))


@pytest.mark.parametrize("axes", [1, 2])
def test_probes_of_queries_are_not_rows(spark, monkeypatch, axes):
    """What is shuffled grows with vectors, queries and neighbours, not with the probes of a query, 100 and 3584."""
    if axes == 2:
        monkeypatch.setattr(ann_search, "OCCUPANCY", 0.05)
    x, before = vectors(7), stages(spark)
    assert ann_search.nearest(table(spark, x), F.col("vec_id") % 20 == 0, k=5).count() == 150
    assert sum(rows for stage, rows in stages(spark).items() if stage not in before) < 20 * len(x)


def stages(spark):
    """Rows that each stage has written for a shuffle."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty()
    found = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return {(x := found.apply(i)).stageId(): x.shuffleWriteRecords() for i in range(found.size())}


def test_groups_of_queries_and_rounds_change_nothing(spark, monkeypatch):
    """Queries are broadcast in groups of bounded size, and tasks of a round hand on only what is as near as the rounds before reach."""
    x = vectors(8)
    rows = table(spark, x)
    whole = sorted(map(tuple, ann_search.nearest(rows, F.col("vec_id") % 20 == 0).collect()))
    sizes, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sizes.append(len(value[0])) or real(self, value))
    monkeypatch.setattr(ann_search, "HELD_BYTES", 12 * (24 * 4 + 100 + 8))
    monkeypatch.setattr(ann_search, "FIRST", 100)
    monkeypatch.setattr(ann_search, "GROWTH", 3)
    assert sorted(map(tuple, ann_search.nearest(rows, F.col("vec_id") % 20 == 0).collect())) == whole
    assert len(sizes) >= 3 * 2 and max(sizes) <= 24  # 22 classes ask


def test_vectors_as_bytes_sort_like_their_components():
    x = np.array([[-2.5, 3.0], [-1.0, 0.0], [-1.0, 0.5], [-0.0, -1.0], [0.0, 2.0], [1e-30, 5.0], [7.0, -4.0]])
    for kind in (np.float32, np.float64):
        column = ann_search.packed(x, kind)
        assert column.to_pylist() == sorted(column.to_pylist())
        assert np.array_equal(ann_search.unpacked(column, kind, 2), x.astype(kind).astype(float))
    assert ann_search.packed(np.array([[-0.0]]), np.float32) == ann_search.packed(np.array([[0.0]]), np.float32)


@pytest.mark.parametrize("group_bytes", [1 << 25, 1500])
def test_top_k_is_exact(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(topk_search, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(topk_search, "BLOCK", 100)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    monkeypatch.setattr(topk_search, "HELD", 1)
    x = vectors(1)
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    rows = topk_search.top_k(table(spark, x), F.col("vec_id") % 50 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    zero = [9002] * (9002 % 50 == 0)
    ids, scores = np.append(np.arange(len(x)), 9002), lambda q: np.append(v @ v[q], 0)
    assert set(got) == {*range(0, 600, 50), *zero}
    for q, found in got.items():
        wanted = best(scores(q), ids, q, 5)
        assert [i for i, _ in found] == wanted and all(s == scores(q)[list(ids).index(i)] for i, s in found)


def test_top_k_groups_are_even(spark, monkeypatch):
    """Ids that are all multiples of 50 are dealt evenly into groups of bounded size."""
    sizes, real = [], topk_search._group_top

    def counted(work, data, asked, *rest):
        sizes.append(asked.count())
        return real(work, data, asked, *rest)

    monkeypatch.setattr(topk_search, "_group_top", counted)
    monkeypatch.setattr(topk_search, "GROUP_BYTES", 400 * (4 + 4) * 8 // 8)
    rows = spark.range(20_000).selectExpr("id AS vec_id", "array(id % 7 / 8D, id % 11 / 8D, id % 13 / 8D, 0.5D) AS embedding")
    assert topk_search.top_k(rows, F.col("vec_id") % 50 == 0, k=1).count() == 400
    assert len(sizes) == 8 and sum(sizes) == 400 and max(sizes) <= 2 * 400 / 8


def test_scores_beyond_64_bits_are_refused(spark):
    rows = spark.createDataFrame([(0, [1e12, -3.0]), (1, [2e12, 5.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(OverflowError):
        topk_search.top_k(rows, F.col("vec_id") == 0)


def test_a_stray_longer_vector_changes_nothing(spark):
    x = vectors(3, n=60)
    rows = table(spark, x)
    longer = spark.createDataFrame([(7777, [1.0] * 30, "o")], rows.schema)
    for search in (topk_search.top_k, ann_search.nearest):
        a, b = (sorted(map(tuple, search(t, F.col("vec_id") % 20 == 0).collect())) for t in (rows, rows.union(longer)))
        assert a == b and a


def test_few_vectors_and_large_values(spark):
    rows = spark.createDataFrame([(0, [1e12, -3.0]), (1, [2e12, 5.0]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in topk_search.top_k(rows.where("vec_id < 1"), F.col("vec_id") == 0).collect()]
    assert got == []
    small = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 1.0]), (2, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk_search.top_k(small, F.col("vec_id") == 0).collect())
    assert got == [(1, 1, 65536), (2, 2, 0)]
    for search in (topk_search.top_k, ann_search.nearest):
        assert search(rows.limit(0), F.col("vec_id") == 0).count() == 0


def test_queries_equal_their_sql(spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    for name, sql in queries.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, sf_dir).toPandas(), con.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns), name
        rows = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
        assert rows(ours) == rows(theirs), name


def test_pipeline_stages(spark, sf_dir):
    from tests.llm.test_dedup import brute_components, brute_kept
    from tests.llm.test_token_operators import check_packing

    work, docs = Workspace(spark, "stages"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = work.write(stage(spark, docs, sf_dir), str(k))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        kept.append((docs, after))
        docs = after
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    for before, after in kept[:3]:
        a, b = texts(before), texts(after)
        assert b.items() <= a.items()
    a, b = texts(kept[2][0]), texts(kept[2][1])
    assert set(b) == {d for d, (_, c) in brute_components(a).items() if c == d}
    a, b = texts(kept[3][0]), {r.doc_id: r for r in kept[3][1].collect()}
    import hashlib

    assert {d: hashlib.sha256(r.text.encode()).hexdigest() for d, r in b.items()} == {d: x[2] for d, x in brute_kept(a).items()}
    assert all(r.n_chars == len(r.text) for r in b.values())
    check_packing(kept[4][1].collect(), texts(kept[4][0]), 2048)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    a, b = texts(kept[1][0]), texts(kept[1][1])
    good = [d for d in a if labels.get(d) == 1]
    assert sum(d in b for d in good) >= 0.95 * len(good) and len(b) < len(a)


def test_pipeline_keeps_documents_of_two_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    texts = {}
    for r in docs.where("lang IS NOT NULL AND n_chars > 400").orderBy("doc_id").collect():
        texts.setdefault(r.lang, []).append(r.text.split()[:60])
    langs = sorted(texts)
    pairs = [" ".join(x + y) for i, a in enumerate(langs) for b in langs[i + 1 :] for x, y in zip(texts[a][:20], texts[b][:20])]
    mixed = spark.createDataFrame([(10**6 + i, t, None, "mixed", len(t)) for i, t in enumerate([*pairs, "\u0e01\u0e02\u0e03 \u0e04\u0e05" * 30, "12 34"])], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.union(mixed), "").where("doc_id >= 1000000").collect()}
    assert len(pairs) > 50 and kept == {10**6 + i for i in range(len(pairs))}


def test_pipeline_on_odd_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "hello world of the", None, None, None), (99_999, None, "en", "s", 0), (99_998, "", None, "s", 0), (99_997, "the of and " * 40_000, None, "s", 1)], docs.schema)
    docs.union(odd).union(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_of_several_vectors_of_a_query_the_smallest_is_asked_with(spark):
    rows = [(1, [0.5, 0.0]), (1, [0.25, 1.0]), (1, [0.25, 0.5]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "vec_id bigint, embedding array<double>").repartition(3)
        found = topk_search.top_k(table, F.col("vec_id") == 1).collect()
        assert sorted((r.rank, r.vec_id, r.score) for r in found) == [(1, 3, 128 * 256), (2, 2, 64 * 256)]
