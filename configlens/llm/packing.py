"""Best-fit packing (5).

Documents become pieces of at most `capacity` tokens; pieces shorter than that
are packed by patterns. A pattern is a multiset of a few lengths that fits into
one sequence. Only the histogram of lengths (capacity - 1 numbers, whatever the
input) reaches the driver: it enumerates patterns, fits how often each is used
by non-negative least squares, rounds down, and packs what is left over by best
fit, again on counts. Every piece then finds its place from its number among
the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import Workspace, slices, texts_of

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END_ID = 2048, 0
_LOADED: dict[str, tiktoken.Encoding] = {}


def tokenizer(path: str) -> tiktoken.Encoding:
    """The encoder of a tokenizer file whose ids are in order of its merges, read once in each Python worker."""
    if path not in _LOADED:
        vocabulary = bpe.load(path)
        ranks = {piece: i for i, piece in enumerate(vocabulary.pieces) if i not in vocabulary.added.values()}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=bpe.PRETOKEN, mergeable_ranks=ranks, special_tokens=vocabulary.added)
    return _LOADED[path]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each document's pieces.

    A document of more than `capacity` tokens (its ids, then END_ID) is cut into
    pieces of exactly that, but for the first, which takes the rest. A null text
    is empty and has END_ID only; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path or public_tokenizers.path(bpe.DEFAULT_FILE)).encode
        for batch in slices(batches, "text", 2 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                ids = np.array([*encode(text, allowed_special="all"), END_ID], dtype="<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def non_negative_least_squares(columns: list[tuple[int, ...]], target: np.ndarray, weight: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 of patterns (tuples of lengths) under which the weighted squares of what is missing of target, by length, are least.

    Accelerated projected gradient steps; the pattern matrix is kept as index lists.
    """
    index = np.array([i for c in columns for i in c], dtype=np.int64)
    owner = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
    size = len(target)
    apply = lambda x: weight * np.bincount(index, weights=x[owner], minlength=size)
    back = lambda r: np.bincount(owner, weights=(weight * r)[index], minlength=len(columns))
    goal = weight * target
    probe = np.ones(len(columns))
    for _ in range(20):  # the largest eigenvalue bounds the step
        probe = back(apply(probe))
        probe /= np.linalg.norm(probe) or 1.0
    step = 1.0 / max(1e-9, 1.05 * float(probe @ back(apply(probe))))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(apply(y) - goal))
        t, old_t = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old_t - 1) / t * (new - x)
        x = new
    return x


#: Triples, and patterns of four, that are tried for each length.
PER_LENGTH = 6


def enumerate_patterns(histogram: np.ndarray, capacity: int, per_length: int = PER_LENGTH) -> list[tuple[int, ...]]:
    """Patterns of two, three or four present lengths that fill a sequence, or nearly where nothing fits better.

    For each length as the longest there are the best partner, `per_length`
    triples and as many patterns of four, spread evenly over what fills the rest,
    so their number is linear in the capacity.
    """
    here = np.asarray(histogram) > 0
    here[0] = False
    present = np.flatnonzero(here)
    if not len(present):
        return []
    found = set()

    def best_below(room: int) -> int:
        k = int(np.searchsorted(present, room, side="right")) - 1
        return int(present[k]) if k >= 0 else 0

    def add(*pattern: int) -> None:
        if all(pattern):
            found.add(tuple(sorted(pattern, reverse=True)))

    def pairs(room: int, most: int) -> list[tuple[int, int]]:
        """Up to `most` pairs that fill room, evenly spread; if none does so, one that nearly does."""
        if room < 2:
            return []
        first = np.flatnonzero(here[1 : room // 2 + 1] & here[room - 1 : room - room // 2 - 1 : -1]) + 1 if room <= capacity else np.zeros(0)
        if not len(first):
            b = best_below(room // 2)
            return [(b, best_below(room - b))]
        return [(int(b), room - int(b)) for b in first[np.unique(np.linspace(0, len(first) - 1, most).astype(int))]]

    for a in map(int, present[::-1]):
        room = capacity - a
        add(a, best_below(room))
        for b, c in pairs(room, per_length):
            add(a, b, c)
        for part in range(1, per_length + 1):
            b = best_below(max(1, room * part // (2 * per_length)))
            for c, d in pairs(room - b, 1) if b else []:
                add(a, b, c, d)
    return sorted(found)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: sequences that are alike are filled together as one group."""
    groups: dict[tuple[int, ...], int] = {}
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        by_room[room][pattern] = by_room[room].get(pattern, 0) + n
        rooms[room] = True

    for length in range(capacity, 0, -1):
        n = int(left[length]) if length < len(left) else 0
        while n:
            open_rooms = np.flatnonzero(rooms[length:])
            if not len(open_rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put((length,) * each, capacity - length * each, full)
                if rest:
                    put((length,) * rest, capacity - length * rest, 1)
                break
            room = length + int(open_rooms[0])
            pattern, have = by_room[room].popitem()
            each = min(room // length, n)
            take = min(have, n // each)
            if have > take:
                by_room[room][pattern] = have - take
            rooms[room] = bool(by_room[room])
            put(pattern + (length,) * each, room - length * each, take)
            n -= take * each
    for at in by_room.values():
        for pattern, n in at.items():
            groups[pattern] = groups.get(pattern, 0) + n
    return sorted(groups.items())


#: Powers of the length by which a missing piece counts in the fit: long pieces that are left over cost more room than short ones.
WEIGHTS = (0.5, 1.0)
#: How often repeats are fitted to what rounding has left, at most; the share of a sequence that a pattern may leave empty.
REFITS, WASTE = 5, 1 / 512
#: Fitted repeats of less than this are taken for none; all others are rounded up, as far as pieces are there. A pattern
#: wastes next to nothing, so one more of it does no harm, and where lengths are rare the fit spreads over many patterns.
LEAST_REPEAT = 0.05


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; together they hold exactly histogram[length] pieces of each length.

    Repeats are fitted and rounded, again and again on what is left, and the last
    residual is packed by best fit. Of the plans for several weights of the fit
    that of fewest sequences is taken; best fit alone only where it needs fewer.
    """
    plans = []
    for power in WEIGHTS:
        used, left = fitted_patterns(histogram, capacity, power)
        for pattern, n in best_fit(left, capacity):
            used[pattern] = used.get(pattern, 0) + n
        plans.append(sorted(used.items()))
    plans.append(best_fit(histogram.astype(np.int64).copy(), capacity))
    return min(plans, key=lambda used: sum(n for _, n in used))


def fitted_patterns(histogram: np.ndarray, capacity: int, power: float) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Patterns with their fitted and rounded repeats, and the histogram of pieces that they leave over."""
    left = histogram.astype(np.int64).copy()
    used: dict[tuple[int, ...], int] = defaultdict(int)
    weight = (np.arange(len(left)) / capacity) ** power
    for _ in range(REFITS):
        patterns = [p for p in enumerate_patterns(left, capacity) if sum(p) >= capacity * (1 - WASTE)]
        if not patterns:
            break
        repeats = non_negative_least_squares(patterns, left.astype(float), weight)
        before = int(left.sum())
        # Those of the largest repeats first: rounding changes them least, and they find their pieces still there.
        for k in sorted(np.flatnonzero(repeats >= LEAST_REPEAT).tolist(), key=lambda k: (-repeats[k], patterns[k])):
            at, need = np.unique(patterns[k], return_counts=True)
            n = min(int(np.ceil(repeats[k])), int((left[at] // need).min()))
            if n > 0:
                used[patterns[k]] += n
                left[at] -= n * need
        if int(left.sum()) > 0.9 * before:
            break
    return used, left


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of pieces_of() with sequence_id and offset; within a sequence they lie gapless from 0.

    An empty table gives no rows. Lengths tie freely: pieces of one length are
    interchangeable. Pieces are numbered within their length from the counts per
    partition, so a frequent length isn't gathered anywhere.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    pieces = work.write(pieces_of(docs, capacity, path).withColumn("part", F.spark_partition_id()), "pieces")
    counts = pieces.where(F.col("length") < capacity).groupBy("length").count().toPandas()  # capacity - 1 rows at most
    histogram = np.zeros(capacity, dtype=np.int64)
    histogram[counts["length"].to_numpy(dtype=np.int64)] = counts["count"].to_numpy(dtype=np.int64)
    starts, places = places_of(plan(histogram, capacity), capacity)
    sequences = int(starts[-1])
    known = spark.sparkContext.broadcast(places)

    # Row numbers: within a file partition a running count, before it the counts of the partitions before.
    sizes = pieces.groupBy("part", "length").count()
    before = sizes.selectExpr("part", "length", "sum(count) OVER (PARTITION BY length ORDER BY part) - count AS before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        table = known.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            part = batch.column("part").to_numpy()
            number = batch.column("before").to_numpy().copy()
            order = np.lexsort((part, length))
            keys = np.stack([part[order], length[order]])
            first = np.flatnonzero(np.any(np.diff(keys, axis=1, prepend=-1), axis=0)) if len(order) else []
            for a, b in zip(first, [*first[1:], len(order)], strict=True):
                key = (int(keys[0, a]), int(keys[1, a]))
                at = seen.get(key, 0)
                number[order[a:b]] += at + np.arange(b - a)
                seen[key] = at + b - a
            sequence, offset = np.empty(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for n in np.unique(length):
                rows = length == n
                if n == capacity:
                    sequence[rows] = sequences + number[rows]
                else:
                    begin, base, place = table[int(n)]
                    slot = np.searchsorted(begin, number[rows], side="right") - 1
                    sequence[rows] = base[slot] + (number[rows] - begin[slot])
                    offset[rows] = place[slot]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    placed = pieces.join(before, ["part", "length"]).repartition("part", "length")
    return placed.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def places_of(used: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, dict]:
    """Where the i-th piece of each length goes: for each length, sorted first numbers with their sequence and offset."""
    starts = np.concatenate([[0], np.cumsum([n for _, n in used])]).astype(np.int64)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    for (pattern, n), base in zip(used, starts, strict=False):
        offset = 0
        for length in pattern:
            slots[length].append((taken[length], int(base), offset))
            taken[length] += n
            offset += length
    return starts, {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}
