"""MinHash near-dedup (6) with HyperMinHash registers.

A document's distinct five-word shingles are hashed once; the top bits choose a
register, which keeps the smallest rest as a count of leading zeros and a few
mantissa bits. Bands of registers bring candidates together, the estimated
Jaccard similarity, corrected for chance collisions of compressed registers,
drops hopeless ones, and full shingle sets confirm the rest.

Rows with equal sets form a class and only classes are compared. Inside a band's
bucket classes don't all meet each other: each class first meets the one hub it
shares most buckets with, which joins most of a group of copies into one
component. Then only pairs across the components of a bucket are left; blocks of
a bucket compare short sketches of these, hand on one pair for components that
surely belong together and every pair that may be a link, and full sets confirm.
Should full sets not confirm one of the sure pairs, which no one has seen yet, the
buckets that still hold several components hand on all pairs that may be links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, Workspace, broadcast_if_small, bytes_of, mix64, slices, sorted_groups, window_hashes
from .components import components

#: Words of a shingle; links have 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 5, 75
#: Registers, mantissa bits of a register, registers of a band.
#: 64 bands of 6 miss a pair of similarity 0.75 with probability (1 - 0.75 ** 6) ** 64 = 4e-6.
REGISTERS, MANTISSA_BITS, BAND = 384, 10, 6
#: Bits of what is left of a hash below its register's first value.
REST_BITS = 64 - (REGISTERS.bit_length() - 1)
#: Candidates whose estimate lies this many standard deviations below the threshold are dropped.
DEVIATIONS = 4.5
#: Rounds in which each class meets one hub, before all components of a bucket are compared; classes of a bucket that are compared at once.
HUB_ROUNDS, BLOCK = 1, 1024
#: Shingles by which a pair of small sketches has to exceed the threshold to count as linked before it is confirmed: two
#: sets of 256 share a 32-bit value by chance with a probability of 1.5e-5.
MARGIN = 1
#: Sets of at most SMALL shingles are sketched by 32 bits of each shingle, those of more than LARGE by their registers; in a
#: plausible pair both sets are in the one or in the other.
SMALL, LARGE = 256, 192


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles; with fewer words, of the whole sequence."""
    n = len(words)
    if n < SHINGLE:
        return mix64(window_hashes(words, n) + np.uint64(n)) if n else np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(words, SHINGLE))


def class_id(shingles: np.ndarray) -> int:
    """A signed 64-bit number of the whole set."""
    with np.errstate(over="ignore"):
        total = mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix64(np.array([total], dtype=np.uint64)).view(np.int64)[0])


_EDGES = np.array([-(-(i << 64) // REGISTERS) for i in range(REGISTERS)], dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The set's 16-bit registers: 0 if empty, else 1 + leading zeros and mantissa of the smallest value."""
    # Sorted hashes lie in order of their register, the smallest value first.
    first = np.searchsorted(shingles, np.append(_EDGES, np.uint64(2**64 - 1)))
    found = first[:-1] < first[1:]
    value = (shingles[first[:-1][found]] - _EDGES[found]).astype(np.float64)
    mantissa, exponent = np.frexp(value + 1.0)
    zeros = np.maximum(0, REST_BITS - exponent)
    out = np.zeros(REGISTERS, dtype="<u2")
    out[found] = 1 + (zeros << MANTISSA_BITS) + ((2 * mantissa - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    return out


def densified(rows: np.ndarray) -> np.ndarray:
    """Registers as 32-bit values without empty ones: an empty register borrows from the first filled one of a fixed sequence.

    Two sets then agree in any register with about the probability of their
    similarity, however few shingles they have; else bands of small sets would
    hold one register or none, and all texts with one frequent line would meet.
    """
    out = np.where(rows > 0, rows.astype(np.uint32) | (np.arange(REGISTERS, dtype=np.uint32) << np.uint32(16)), np.uint32(0))
    filled = out.copy()
    row, at = np.nonzero(out == 0)
    for lenders in _LENDERS:
        if not len(row):
            break
        lent = filled[row, lenders[at]]
        found = lent > 0
        out[row[found], at[found]] = lent[found]
        row, at = row[~found], at[~found]
    return out


#: For each register all registers in the order in which it borrows from them.
_LENDERS = np.argsort(np.random.default_rng(6).random((REGISTERS, REGISTERS)), axis=0)


def sketches(rows: np.ndarray) -> np.ndarray:
    """One byte of each register of each row, 0 only for empty ones; bytes match by chance more often, so estimates only rise."""
    return np.where(rows > 0, 1 + rows % 255, 0).astype(np.uint8)


def small_sketch(shingles: np.ndarray) -> bytes | None:
    """Four bytes of each shingle of a small set; equal bytes of different shingles only raise what pairs seem to share."""
    return (shingles & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() if len(shingles) <= SMALL else None


#: What rows of small sketches are filled up with.
_PAD = np.uint32(0xFFFFFFFF)


def shared_small(rows: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many entries pairs of padded small sketches of n entries share."""
    both = np.sort(np.concatenate([rows[p], rows[q]], axis=1), axis=1)
    pads = 2 * rows.shape[1] - n[p] - n[q]
    return (both[:, 1:] == both[:, :-1]).sum(axis=1) - np.maximum(0, pads - 1).astype(np.int64)


def chance_match(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two unrelated sets of n and m shingles is equal by chance."""
    level = 2.0 ** -np.arange(REST_BITS)
    within = lambda size: np.exp(-size[:, None] / REGISTERS * level / 2) - np.exp(-size[:, None] / REGISTERS * level)
    return (within(n) * within(m)).sum(axis=1) / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of pairs of register rows, and the number of registers used."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    chance = chance_match(n, m)
    return (equal / np.maximum(1, used) - chance) / (1 - chance), used


def plausible(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, sign: float = 1.0) -> np.ndarray:
    """Whether pairs may reach the threshold, by their sizes and within DEVIATIONS by their registers; with sign -1, whether they must."""
    guess, used = estimate(a, b, n, m)
    t = PERCENT / 100
    near = guess >= t - sign * DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(1, used))
    return near & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (null without words), registers and small sketch of each row."""
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words = Words(bytes_of(batch.column("text")), fold=True)
            size, of, kept, small = [], [], [], []
            for a, b in zip(words.starts, words.starts[1:], strict=False):
                shingles = shingle_set(words.hashes[a:b])
                size.append(len(shingles))
                of.append(class_id(shingles) if len(shingles) else None)
                kept.append(registers(shingles).tobytes() if len(shingles) else None)
                small.append(small_sketch(shingles) if len(shingles) else None)
            columns = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(of, pa.int64()), pa.array(kept, pa.binary()), pa.array(small, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "n_shingles", "class", "registers", "small"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, class bigint, registers binary, small binary")


def bands(classes: DataFrame) -> DataFrame:
    """key and class for each band of each class; sets of one or two shingles have no others similar enough and have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(REGISTERS // BAND, dtype=np.uint64) << np.uint64(56)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = np.frombuffer(b"".join(part.column("registers").to_pylist()), dtype="<u2").reshape(part.num_rows, -1)
                values = densified(rows).reshape(part.num_rows, -1, BAND).astype(np.uint64)
                key = np.broadcast_to(number, values.shape[:2])
                for i in range(BAND):
                    key = mix64(key ^ values[:, :, i])
                of = np.repeat(np.arange(part.num_rows), key.shape[1])
                yield pa.record_batch([pa.array(key.ravel().view(np.int64)), part.column("class").take(pa.array(of))], ["key", "class"])

    return classes.where("n_shingles > 2").select("class", "registers").mapInArrow(run, "key bigint, class bigint")


def one_hub(met: DataFrame) -> DataFrame:
    """Of pairs (class, hub), once per shared bucket, each class with the hub it shares most with, as (a, b), a < b."""
    counted = met.groupBy("class", "hub").count()
    best = counted.groupBy("class").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    return best.select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()


def across(named: DataFrame, classes: DataFrame, work: Workspace, by_lead: bool = True) -> DataFrame:
    """Plausible pairs (a, b, lead) of different components in one bucket, of named (key, class, component).

    With by_lead, a pair that surely links two components leads: other pairs of
    these two aren't handed on, so they are lost if it turns out to be no link.

    Sizes differ by less than a third in a plausible pair, so a bucket is divided
    by size, where each class is in its own and the next division; divisions of
    more than BLOCK classes are cut into blocks that meet pairwise.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), dtype="<u2").reshape(batch.num_rows, -1)
            large = batch.column("n_shingles").to_numpy() > LARGE
            short = [x.tobytes() if use else None for x, use in zip(sketches(rows), large, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(short, pa.binary()), batch.column("small")], names=["class", "sketch", "small"])

    division = F.floor(F.log(F.col("n_shingles")) / np.log(100 / PERCENT)).cast("int")
    rows = named.join(classes.select("class", "n_shingles"), "class").withColumn("own", division)
    rows = work.write(rows.withColumn("division", F.explode(F.array("own", F.col("own") + 1))), "divided")
    sizes = rows.groupBy("key", "division").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    sizes = sizes.select("key", "division", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    mine = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    rows = work.write(rows.join(sizes, ["key", "division"]).withColumn("mine", mine), "mixed")
    named = broadcast_if_small(work.write(rows.select("class").distinct(), "across"))
    short = classes.select("class", "n_shingles", "registers", "small").join(named, "class", "left_semi").mapInArrow(sketch, "class bigint, sketch binary, small binary")
    cells = rows.join(short, "class").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = cells.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    cell = ["key", "division", "low", "high"]
    dealt = cells.select(*cell, "mine", "own", "class", "component", "n_shingles", "sketch", "small").repartition(*cell).sortWithinPartitions(*cell, "class")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Pairs()
        for group in sorted_groups(batches, cell):
            get = lambda c: group.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            component, ids, n, mine, own = get("component"), get("class"), get("n_shingles").astype(float), get("mine"), get("own")
            if len(np.unique(component)) < 2:
                continue
            low, high, division = (group.column(c)[0].as_py() for c in ("low", "high", "division"))
            label = np.unique(component, return_inverse=True)[1]
            short = np.frombuffer(b"".join(x or bytes(REGISTERS) for x in group.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
            width = int(min(SMALL, n.max()))
            small = np.full((len(ids), width), _PAD, dtype=np.uint32)
            for row, x in enumerate(group.column("small").to_pylist()):
                if x is not None:
                    small[row, : len(x) // 4] = np.frombuffer(x, dtype="<u4")
            for a in range(0, len(ids), 64):  # pairs of 64 classes with all of the cell at a time
                i, j = np.nonzero((label[a : a + 64, None] != label[None, :]) & (ids[a : a + 64, None] < ids[None, :]))
                i += a
                # A pair meets once: in the blocks' own cell, and in the division of its larger set or the one both are in.
                once = ((mine[i] != mine[j]) | (low == high)) & (np.maximum(own[i], own[j]) == division)
                once &= 100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])
                i, j = i[once], j[once]
                for b in range(0, len(i), 1 << 13):
                    p, q = i[b : b + (1 << 13)], j[b : b + (1 << 13)]
                    by_set = np.maximum(n[p], n[q]) <= SMALL
                    good, sure = np.zeros(len(p), dtype=bool), np.zeros(len(p), dtype=bool)
                    if by_set.any():
                        x, y = p[by_set], q[by_set]
                        shared = shared_small(small, x, y, n)
                        linked = lambda k: 100 * k >= PERCENT * (n[x] + n[y] - k)  # noqa: B023, E731
                        good[by_set], sure[by_set] = linked(shared), linked(shared - MARGIN)
                    if not by_set.all():
                        x, y = p[~by_set], q[~by_set]
                        good[~by_set] = plausible(short[x], short[y], n[x], n[y])
                        sure[~by_set] = plausible(short[x], short[y], n[x], n[y], -1.0)
                    # Of pairs that surely link two components one is enough, and later blocks take these as one.
                    lead, label = joined(label, p, q, sure & by_lead)
                    unsure = good & (label[p] != label[q])
                    met.add(ids[p[lead]], ids[q[lead]], True)
                    met.add(ids[p[unsure]], ids[q[unsure]], False)
                    if met.rows > 1_000_000:
                        yield met.handed_on()
        yield met.handed_on()

    return dealt.mapInArrow(meet, "a bigint, b bigint, lead boolean").groupBy("a", "b").agg(F.max("lead").alias("lead"))


def joined(label: np.ndarray, p: np.ndarray, q: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of sure pairs that join labels, one for each joined label, and the labels after that."""
    at = np.flatnonzero(sure)
    ends = np.sort(np.stack([label[p[at]], label[q[at]]], axis=1), axis=1)
    ends, first = np.unique(ends, axis=0, return_index=True)
    root = list(range(int(label.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    lead = []
    for (x, y), k in zip(ends.tolist(), first.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            lead.append(at[k])
    return np.array(lead, dtype=np.int64), np.array([find(x) for x in range(len(root))])[label] if lead else label


class Pairs:
    """Pairs that a task has met since it last handed them on, each once."""

    def __init__(self):
        self.rows, self.parts = 0, []

    def add(self, a: np.ndarray, b: np.ndarray, lead: bool) -> None:
        self.parts.append(np.stack([a, b, np.full(len(a), int(lead))], axis=1))
        self.rows += len(a)

    def handed_on(self) -> pa.RecordBatch:
        found = np.unique(np.concatenate([*self.parts, np.zeros((0, 3), dtype=np.int64)]), axis=0)
        self.rows, self.parts = 0, []
        return pa.record_batch([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), pa.array(found[:, 2] == 1)], ["a", "b", "lead"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class and hashes of the sets of wanted (doc_id, class), made again from the texts.

    A doc_id may stand for several texts, so only sets of the wanted class stay, one each.
    """
    rows = docs.select("doc_id", "text").join(wanted, docs["doc_id"].eqNullSafe(wanted["doc_id"])).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words = Words(bytes_of(batch.column("text")), fold=True)
            of, sets = [], []
            for a, b, wanted_class in zip(words.starts, words.starts[1:], batch.column("class").to_pylist(), strict=False):
                shingles = shingle_set(words.hashes[a:b])
                if len(shingles) and class_id(shingles) == wanted_class:
                    of.append(wanted_class)
                    sets.append(shingles.tobytes())
            yield pa.record_batch([pa.array(of, pa.int64()), pa.array(sets, pa.binary())], ["class", "hashes"])

    return rows.mapInArrow(run, "class bigint, hashes binary").dropDuplicates(["class"])


def likely(pairs: DataFrame, classes: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of classes that their sizes, and then their registers, leave possible.

    Registers, the bulk of a class, are shuffled of those classes only that have a pair of fitting sizes.
    """
    size = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"registers_{x}").to_pylist()), dtype="<u2").reshape(-1, REGISTERS) for x in "ab")
                n, m = (batch.column(f"n_{x}").to_numpy().astype(float) for x in "ab")
                yield batch.select(["a", "b"]).filter(pa.array(plausible(a, b, n, m)))

    near = (100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    pairs = work.write(pairs.select("a", "b").join(size("a"), "a").join(size("b"), "b").where(near), f"sized{name}")
    asked = broadcast_if_small(work.write(ends(pairs), f"ends{name}"))
    of = classes.select("class", "registers").join(asked, "class", "left_semi")
    side = lambda x: of.select(F.col("class").alias(x), F.col("registers").alias(f"registers_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def ends(pairs: DataFrame) -> DataFrame:
    """The classes of pairs, each once."""
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("class").alias(x), F.col("hashes").alias(f"hashes_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("hashes_a").to_pylist(), batch.column("hashes_b").to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.sort(np.concatenate([a, b]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= PERCENT * (len(a) + len(b) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    component_id is the smallest doc_id that links reach, kept whether it is the
    row's own. Rows without text or words are linked with nothing. Rows that
    share a doc_id are judged by their own texts; a null doc_id takes part in
    links but is no component_id, and stays kept only if no row it reaches has an
    id. Texts are whole at any length; an empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near")
    of_rows = work.write(signatures(docs), "rows")
    # Equal sets are one class: partial aggregation meets copies before the shuffle.
    classes = work.write(of_rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"), F.min("small").alias("small")), "classes")
    # Keys move once: the members of a bucket are those beside which another class stands in the order of the classes.
    of_key = Window.partitionBy("key").orderBy("class")
    keys = bands(classes).withColumn("low", F.first("class").over(of_key)).withColumn("next", F.lead("class").over(of_key))
    members = work.write(keys.where("class <> low OR next IS NOT NULL").select("key", "class", "low"), "members0")

    def linked(met: DataFrame, name: str) -> DataFrame:
        """The links among the pairs met."""
        pairs = work.write(likely(met, classes, work, name), f"pairs{name}")
        work.drop(f"sized{name}")
        asked = broadcast_if_small(work.write(ends(pairs), f"asked{name}"))
        wanted = work.write(classes.select("class", "doc_id").join(asked, "class", "left_semi"), f"wanted{name}")
        found = work.write(confirmed(pairs, full_sets(docs, broadcast_if_small(wanted))), f"edges{name}")
        work.drop(f"pairs{name}")
        work.drop(f"wanted{name}")
        return found

    def still_mixed(members: DataFrame, labels: DataFrame, k: int) -> DataFrame:
        """key, class, component and a hub of members of buckets that hold several components."""
        named = members.join(labels, "class", "left").select("key", "class", F.coalesce("component", "class").alias("component"))
        by = F.xxhash64("class", F.lit(k))
        mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.max_by(F.struct("class", "component"), by).alias("hub")).where("x < y")
        return work.write(named.join(work.write(mixed.select("key", "hub"), f"mixed{k}"), "key"), f"members{k}")

    edges = linked(work.write(one_hub(members.select("class", F.col("low").alias("hub")).where("class <> hub")), "met0"), "0")
    labels = components(edges, work, "labels0")
    for k in range(1, HUB_ROUNDS + 3):
        # Only buckets that still hold several components, and only pairs across them.
        named = still_mixed(members, labels, k)
        work.drop(f"members{k - 1}")
        members = named.select("key", "class")
        if k < HUB_ROUNDS:
            met = one_hub(named.where("component <> hub.component").select("class", F.col("hub.class").alias("hub")))
        else:
            met = across(named.select("key", "class", "component"), classes, work, by_lead=k == HUB_ROUNDS)
        met = work.write(met, f"met{k}")
        found = linked(met, str(k))
        if not found.isEmpty():
            edges = edges.union(found)
            labels = components(edges, work, f"labels{k}")
        if k == HUB_ROUNDS and met.where("lead").join(found, ["a", "b"], "left_anti").isEmpty() or k > HUB_ROUNDS:
            break
    for name in ("divided", "mixed", f"members{k}", *(f"met{i}" for i in range(k + 1))):
        work.drop(name)

    named = classes.select("class", "doc_id").join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = work.write(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    of_class = named.join(smallest, "component").select("class", "component_id")
    out = of_rows.select("doc_id", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
