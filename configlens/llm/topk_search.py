"""Exact top-k search (8) by distributed histogram selection.

All scores are counted in a histogram per query; the bin that holds the k-th
score is split into the next histogram until it is one score wide. Then rows
above the k-th score, and the smallest ids that tie with it, are filtered. Every
pass scores blocks of vectors against blocks of queries and adds up counts of
filled bins, so nothing depends on how scores or ties are spread. Queries are
dealt into even groups of a fixed size, each broadcast in its turn.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann_search import common_length, matrix, usable
from .common import Workspace

NEIGHBOURS, SCALE = 5, 256
#: Rows of a block of vectors and of queries, bins of a histogram, bytes of query blocks that are broadcast at once.
BLOCK, QUERIES, BINS, GROUP_BYTES = 4096, 512, 512, 32 << 20
#: Query blocks whose counts a task holds before it hands them on; shares of a block's counts that are added up apart, then together.
HELD, SHARES = 32, 16


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; as doubles where these are exact, else as 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        return np.rint(queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    return queries @ data.T


def _packed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("vec_id").to_numpy())
                rows.append(matrix(batch.column("vec")))
            while sum(map(len, ids)) >= size:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
                yield _block(all_ids[:size], all_rows[:size])
                ids, rows = [all_ids[size:]], [all_rows[size:]]
        if sum(map(len, ids)):
            yield _block(np.concatenate(ids), np.concatenate(rows))

    return run


def _block(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    values = np.floor(SCALE * rows).astype(np.int64)
    return pa.record_batch([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["ids", "data"])


def _ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k highest scores of each row that is_query (on vec_id) picks.

    Components x count as floor(256 * x), scores are their integer inner
    products, ties go to smaller vec_ids, and rows with the query's id are no
    candidates of it. Vectors that are null, hold null or non-finite components
    or have another length than most take no part, nor do rows without id;
    repeated rows are candidates each, and of several vectors of a query's id the
    smallest, component by component, is asked with. With fewer candidates than k all are
    returned; an empty table gives no rows. Vectors so long that scores may not
    fit 64 bits raise an OverflowError.
    """
    spark = vectors.sparkSession
    work = Workspace(spark, "topk")
    rows = usable(vectors, id_column, vector_column).where(F.size("vec") > 0)
    dim = common_length(rows)
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if not dim:
        return empty
    rows = rows.where(F.size("vec") == dim).select(F.col("vec_id").cast("bigint"), "vec")
    asked = work.write(rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")), "asked")
    count = asked.count()
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), F.lit(2.0)))
    facts = rows.agg(F.max(square).alias("square"), F.count("*").alias("n")).first()
    if not count or facts.n < 2:
        return empty
    if facts.square >= 2**62:
        raise OverflowError(f"scores of vectors as long as these ({math.sqrt(facts.square):.3g} in units of 1 / {SCALE}) may not fit 64 bits")
    reach = math.sqrt(facts.square) + 1.0
    data = work.write(rows.mapInArrow(_packed(BLOCK), "ids binary, data binary"), "data")
    groups = max(1, math.ceil(count * (dim + 4) * 8 / GROUP_BYTES))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    found = [_group_top(work, data, asked.where(group == g), f"{g}", dim, reach, k) for g in range(groups)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _group_top(work: Workspace, data: DataFrame, asked: DataFrame, name: str, dim: int, reach: float, k: int) -> DataFrame:
    """The k highest scores of one group of queries, of rows that can be broadcast."""

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with a first range that holds every possible score: sum-of-products bound of the norms."""
        for block in _packed(QUERIES)(batches):
            values = _ints(block.column("data")[0].as_py()).reshape(-1, dim)
            bound = np.floor(np.linalg.norm(values.astype(np.float64), axis=1) * reach).astype(np.int64) + 1
            width = -(-(2 * bound + 1) // BINS)
            state = np.stack([-bound, width, np.full(len(bound), k, dtype=np.int64)])
            number = int(_ints(block.column("ids")[0].as_py())[0])  # ids are distinct across blocks, so each names its block
            yield pa.record_batch([pa.array([number]), *block.columns, pa.array([state.tobytes()], pa.binary())], ["block", "query_ids", "queries", "state"])

    block_schema = "block bigint, query_ids binary, queries binary, state binary"
    queries = work.write(asked.coalesce(4).mapInArrow(begun, block_schema), f"queries{name}_0")

    def met(queries: DataFrame) -> DataFrame:
        """Every block of vectors with every block of the group's queries."""
        return data.join(F.broadcast(queries)).select("ids", "data", "block", "query_ids", "queries", "state")

    def scored(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        get = lambda c: _ints(batch.column(c)[i].as_py())
        ids, query_ids = get("ids"), get("query_ids")
        scores = products(get("queries").reshape(-1, dim), get("data").reshape(-1, dim))
        return ids, query_ids, scores, query_ids[:, None] != ids[None, :], get("state").reshape(3, -1)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                _, query_ids, scores, others, (low, width, _) = scored(batch, i)
                number = batch.column("block")[i].as_py()
                place = (scores - low[:, None]) // width[:, None]
                counted = others & (place >= 0)
                # What lies above the range is counted in one more bin.
                flat = (np.arange(len(query_ids))[:, None] * (BINS + 1) + np.minimum(place, BINS))[counted]
                counts = np.bincount(flat, minlength=len(query_ids) * (BINS + 1))
                held[number] = held[number] + counts if number in held else counts
                if len(held) > HELD:
                    yield _counts(held)
                    held = {}
        yield _counts(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, bins, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "bins", "counts")), strict=True):
                at, n = np.frombuffer(bins, dtype=np.int32), _ints(counts)
                if number not in held:
                    held[number] = np.zeros(QUERIES * (BINS + 1), dtype=np.int64)
                held[number][at] += n
        yield _counts(held)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for state, filled, counts in zip(*(batch.column(c).to_pylist() for c in ("state", "bins", "counts")), strict=True):
                low, width, need = _ints(state).reshape(3, -1)
                bins = np.zeros((len(low), BINS + 1), dtype=np.int64)
                if filled:
                    bins.ravel()[np.frombuffer(filled, dtype=np.int32)] = _ints(counts)
                from_top = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or above
                reached = from_top >= need[:, None]
                bin_ = np.where(reached.any(axis=1), BINS - np.argmax(reached[:, ::-1], axis=1), 0)
                states.append(np.stack([low + bin_ * width, np.maximum(1, -(-width // BINS)), need]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("block", "query_ids", "queries")), pa.array(states, pa.binary())], names=["block", "query_ids", "queries", "state"])

    widest = -(-(2 * int(reach * reach) + 3) // BINS)
    step = 0
    schema = "block bigint, bins binary, counts binary"
    while True:
        counts = met(queries).mapInArrow(histogram, schema).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
        counts = counts.repartition("block", "share").select("block", "bins", "counts").mapInArrow(add, schema).repartition("block").mapInArrow(add, schema)
        step += 1
        queries = work.write(queries.join(counts, "block", "left").mapInArrow(refine, block_schema), f"queries{name}_{step}")
        work.drop(f"queries{name}_{step - 1}")
        if widest <= 1:
            break
        widest = -(-widest // BINS)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, query_ids, scores, others, (low, _, _) = scored(batch, i)
                above = others & (scores > low[:, None])
                q, d = np.nonzero(above)
                order = np.argsort(ids, kind="stable")
                ties = (others & (scores == low[:, None]))[:, order]
                ties &= np.cumsum(ties, axis=1) <= k  # the smallest ids of this block that tie
                tq, td = np.nonzero(ties)
                q, d = np.concatenate([q, tq]), np.concatenate([d, order[td]])
                yield pa.record_batch([pa.array(query_ids[q]), pa.array(ids[d]), pa.array(scores[q, d])], ["query_id", "vec_id", "score"])

    found = met(queries).mapInArrow(chosen, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return work.write(found, f"found{name}")


def _counts(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    """The filled bins of the counts of query blocks."""
    filled = {number: np.flatnonzero(counts).astype(np.int32) for number, counts in held.items()}
    bins, counts = ([x.tobytes() for x in of] for of in (filled.values(), (held[n][at].astype(np.int64) for n, at in filled.items())))
    return pa.record_batch([pa.array(list(held), pa.int64()), pa.array(bins, pa.binary()), pa.array(counts, pa.binary())], ["block", "bins", "counts"])
