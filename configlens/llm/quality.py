"""Quality classifier (9).

Word vectors come from random indexing: each word has a sparse random index
vector, and its context vector is the sum of its neighbours' index vectors over
the whole corpus. Words are counted first: those that occur LEAST times or more
anywhere have a vector of their own, so the vocabulary grows with the corpus; the
contexts of all rarer words add up to the one vector of rare words. A document is
the mean of its words' vectors; a two-layer network scores it, and a temperature
fitted on rows that the network hasn't seen calibrates the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, broadcast_if_small, bytes_of, fresh, hash_runs, learnable, mix64, slices

#: Dimensions of word vectors; occurrences from which a word has a vector of its own; the word that stands for all rarer ones.
SIZE, LEAST, RARE = 48, 20, 0
#: Words whose sums a task holds before it hands them on; the most frequent words, whose vectors are broadcast; bytes of text pooled at once.
HELD, FREQUENT, TEXT = 150_000, 500_000, 1 << 19
#: Vectors' entries are rounded to multiples of 1 / SCALE and summed as whole numbers, so that no order of tasks changes a sum.
SCALE = 1 << 14
#: Neighbours on each side, and non-zero entries of an index vector.
WINDOW, NON_ZERO = 2, 2
#: Labelled documents that the network is fitted on at most; those with the smallest hashed ids.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 30, 256, 3e-3, 7
THRESHOLD = 0.3

#: Kinds of bytes: 0 white space, 1 letters (all beyond ASCII too), 2 digits, 3 the rest.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[list(b" \t\n\x0b\x0c\r")] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_VALUE = np.arange(256, dtype=np.uint8)
_VALUE[48:58] = 48


class Tokens:
    """Runs of letters, digits or other signs of a batch of texts as 64-bit hashes; digits are all alike."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        kind = _KIND[data]
        change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
        end = np.append(change[1:], len(data)) if len(change) else change
        inside = kind[change] > 0
        begin, end = change[inside], end[inside]
        hashes = hash_runs(_VALUE[data], begin, end)
        self.words = hashes.view(np.int64)
        offset = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))])
        self.starts = np.searchsorted(begin, offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.starts))


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each word's index vector, the same in every process."""
    mixed = mix64(words.view(np.uint64)[:, None] * np.uint64(NON_ZERO) + np.arange(1, NON_ZERO + 1, dtype=np.uint64))
    return (mixed % np.uint64(SIZE)).astype(np.int64), np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


SUMS = "word bigint, n bigint, sums binary"


def _rows(words: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(words, pa.int64()), pa.array(n.astype(np.int64)), _packed(sums)], ["word", "n", "sums"])


def _packed(values: np.ndarray) -> pa.Array:
    width = values.shape[1] * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(np.arange(0, (len(values) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.Array) -> np.ndarray:
    """Rows of SIZE numbers as doubles; their width tells their type: one byte, two, four, or a double."""
    out = np.empty((len(column), SIZE))
    width = pc.binary_length(column).to_numpy(zero_copy_only=False) // SIZE
    for kind in (np.int8, np.int16, np.int32, np.float64):
        chosen = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(chosen):
            out[chosen] = np.frombuffer(b"".join(column.take(pa.array(chosen)).to_pylist()), dtype=kind).reshape(-1, SIZE)
    return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of (word, n, sums), of equal words one."""
    words, n, sums = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(words, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))[: len(words)]
    return words[first], np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (a 64-bit hash) and n, how often it occurs in all texts; tasks add up a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in slices(batches, "text", 2 << 20):
            words, n = np.unique(Tokens(bytes_of(batch.column("text"))).words, return_counts=True)
            held.append((words, n))
            count += len(words)
            if count > 4 * HELD:
                words, n = _counted(held)
                held, count = [(words, n)], len(words)
                if count > 2 * HELD:
                    yield pa.record_batch([pa.array(words), pa.array(n)], ["word", "n"])
                    held, count = [], 0
        if held:
            yield pa.record_batch([*map(pa.array, _counted(held))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    words, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, np.bincount(place, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)


def context_table(docs: DataFrame, vocabulary: Broadcast | None = None, least: int = LEAST, vectors: bool = False) -> DataFrame:
    """Each word of the vocabulary and RARE, how often it occurs, and its context sums (doubles) or vector (16-bit integers), over all texts.

    The vocabulary is a sorted array of the words that occur `least` times or
    more. Without it all words are added up, and the rarer ones put together after
    that, with the same result. Tasks add up what they meet, of the vocabulary or
    else a bounded number of words at a time; what they hand on is added up by
    word, of which a task holds one batch.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words of some texts (with a vocabulary, their places in it after that of RARE), how often they occur, and their sums."""
        for batch in slices(batches, "text", 1 << 20):
            tokens = Tokens(bytes_of(batch.column("text")))
            if not len(tokens.words):
                continue
            words, place = np.unique(tokens.words, return_inverse=True)
            dims, signs = index_vectors(words)
            row, names = np.arange(len(words)), words  # row of the sums of each word; rare words share the first
            if vocabulary is not None:
                own = _contained(words, vocabulary.value)
                row = np.where(own, np.cumsum(own), 0)
                names = np.append(0, 1 + np.searchsorted(vocabulary.value, words[own]))
            to = row[place] * SIZE
            at, weight = [], []
            for gap in range(1, WINDOW + 1):
                together = tokens.text[:-gap] == tokens.text[gap:]
                left, right = place[:-gap][together], place[gap:][together]
                to_left, to_right = to[:-gap][together], to[gap:][together]
                for j in range(NON_ZERO):
                    at += [to_left + dims[right, j], to_right + dims[left, j]]
                    weight += [signs[right, j], signs[left, j]]
            sums = np.bincount(np.concatenate(at), weights=np.concatenate(weight), minlength=len(names) * SIZE).reshape(-1, SIZE)
            yield names, np.bincount(row[place], minlength=len(names)), sums.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is not None:  # of bounded size: a task adds up all it meets and hands each word on once
            n, sums = np.zeros(len(vocabulary.value) + 1, dtype=np.int64), np.zeros((len(vocabulary.value) + 1, SIZE), dtype=np.int32)
            for at, more, part in contexts(batches):
                n[at] += more
                sums[at] += part
            met = np.flatnonzero(n)
            for a in range(0, len(met), 50_000):
                at = met[a : a + 50_000]
                yield from _handed((np.append(RARE, vocabulary.value)[at], n[at], sums[at]))
            return
        held, count = [], 0
        for part in contexts(batches):
            held.append(part)
            count += len(part[0])
            if count > HELD:
                held = [_merged(held)]
                count = len(held[0][0])
                if count > HELD // 2:
                    yield from _handed(held.pop())
                    count = 0
        if held:
            yield from _handed(_merged(held))

    def added(fold: bool, last: bool):
        """Rows of equal words, which come together, as one: those of rarer words as RARE if fold, as vectors if last."""

        def made(words: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            if fold:
                words, n, sums = _merged([(np.where(n < least, RARE, words), n, sums)])
            return _rows(words, n, word_vectors(sums) if last and vectors else sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            open_row = None  # the word that the next batch may go on with
            for batch in batches:
                for at in range(0, batch.num_rows, 10_000):
                    part = batch.slice(at, 10_000)
                    rows = part.column("word").to_numpy(), part.column("n").to_numpy(), _unpacked(part.column("sums"))
                    words, n, sums = _merged([open_row, rows] if open_row else [rows])
                    open_row = words[-1:], n[-1:], sums[-1:]
                    if len(words) > 1:
                        yield made(words[:-1], n[:-1], sums[:-1])
            if open_row:
                yield made(*open_row)

        return run

    rows = docs.select("text").mapInArrow(run, SUMS)
    for fold, last in [(False, True)] if vocabulary is not None else [(True, False), (False, True)]:
        rows = rows.repartition("word").sortWithinPartitions("word").mapInArrow(added(fold, last), SUMS)
    return rows


def _contained(words: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Which words are among names, a sorted array."""
    at = np.minimum(np.searchsorted(names, words), max(0, len(names) - 1))
    return names[at] == words if len(names) else np.zeros(len(words), dtype=bool)


def _handed(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Batches of rows; small sums take one byte each, others four."""
    words, n, sums = rows
    small = (np.abs(sums) <= 127).all(axis=1)
    for chosen, kind in ((small, np.int8), (~small, np.int32)):
        at = np.flatnonzero(chosen)
        for a in range(0, len(at), 10_000):
            part = at[a : a + 10_000]
            yield _rows(words[part], n[part], sums[part].astype(kind))


def context_sums(docs: DataFrame, vocabulary: Broadcast | None = None, least: int = LEAST) -> np.ndarray:
    """The rows [word, n, *sums] of context_table(), by word; for small tables."""
    rows = context_table(docs, vocabulary, least).orderBy("word").toArrow().combine_chunks()
    return np.array([(w, n, *np.frombuffer(s)) for w, n, s in zip(*(rows[c].to_pylist() for c in ("word", "n", "sums")), strict=True)], dtype=object)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Context vectors with damped counts, each of length 1 (0 for words without neighbours), in units of 1 / SCALE."""
    damped = np.sign(sums) * np.log1p(np.abs(sums))
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    return np.rint(damped / np.where(norm > 0, norm, 1.0) * SCALE).astype(np.int16)


@dataclass
class Vectors:
    """Vectors of the vocabulary and of RARE as a table, whether that holds more than is broadcast, and what is: words in order, their vectors, that of RARE."""

    table: DataFrame
    more: bool
    frequent: Broadcast


def learned_vectors(docs: DataFrame, least: int = LEAST, frequent: int | None = None) -> Vectors:
    """Vectors of the words of docs; those of the `frequent` most frequent ones are broadcast, a number that doesn't grow."""
    frequent = FREQUENT if frequent is None else frequent
    spark = docs.sparkSession
    work = Workspace(spark, "vectors")
    counts = work.write(word_counts(docs).where(F.col("n") >= least), "vocabulary")
    few = counts.limit(frequent + 1).count() <= frequent
    vocabulary = spark.sparkContext.broadcast(np.sort(counts.select("word").toArrow()["word"].to_numpy())) if few else None
    table = work.write(context_table(docs, vocabulary, least, vectors=True), "table")
    top = (table if few else table.orderBy(F.col("word") != RARE, F.desc("n"), "word").limit(frequent)).toArrow().combine_chunks()
    words = top["word"].to_numpy()
    vectors = np.frombuffer(b"".join(top["sums"].to_pylist()), dtype=np.int16).reshape(-1, SIZE)
    rare = vectors[words == RARE][0] if (words == RARE).any() else np.zeros(SIZE, dtype=np.int16)
    order = np.argsort(words)
    return Vectors(table, not few, spark.sparkContext.broadcast((words[order], vectors[order], rare)))


def _pooled_here(texts: list[bytes], known: tuple) -> tuple[np.ndarray, np.ndarray, Tokens, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text and the sums of their broadcast vectors; the tokens, distinct words, each token's word and whether it is broadcast."""
    names, values, rare = known
    tokens = Tokens(texts)
    words, place = np.unique(tokens.words, return_inverse=True)
    own = _contained(words, names)
    local = np.empty((len(words), SIZE))
    local[own], local[~own] = values[np.searchsorted(names, words[own])], rare
    sizes, sums = np.diff(tokens.starts), np.zeros((len(texts), SIZE))
    if len(place):
        sums[sizes > 0] = np.add.reduceat(local[place], tokens.starts[:-1][sizes > 0], axis=0)
    return sizes, sums, tokens, words, place, own


def pooled(docs: DataFrame, vectors: Vectors) -> DataFrame:
    """key and mean of each distinct text: the mean of its words' vectors, zeros for a text without words.

    Broadcast vectors are looked up where the text is. If the table holds more,
    other words count as rare there, and rows of those that have a vector, which
    no key is full of, bring the difference by a join.
    """
    known = vectors.frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # copies of a text are left out where a task meets them; others change no mean
        for batch in slices(batches, "text", TEXT):
            new = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    new.append(i)
            if len(seen) > 200_000:
                seen.clear()
            if not new:
                continue
            batch = batch.take(pa.array(new))
            sizes, sums, tokens, words, place, own = _pooled_here(bytes_of(batch.column("text")), known.value)
            keys = batch.column("key")
            yield pa.record_batch([keys, pa.nulls(len(new), pa.int64()), pa.array(sizes.astype(np.int64)), _packed(sums)], ["key", "word", "n", "sums"])
            if more:
                tail = np.flatnonzero(~own[place])
                pair, n = np.unique(tokens.text[tail] * np.int64(len(words)) + place[tail], return_counts=True)
                if len(pair):
                    yield pa.record_batch([keys.take(pa.array(pair // len(words))), pa.array(words[pair % len(words)]), pa.array(n.astype(np.int64)), pa.nulls(len(pair), pa.binary())], ["key", "word", "n", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = known.value[2].astype(np.float64)
        last = None  # the text that the next batch may go on with
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                # Rows of a text itself hold sums over its words and its size, rows of its other words a vector and a count.
                whole = part.column("whole").to_numpy(zero_copy_only=False)
                n, sums = part.column("n").to_numpy(), _unpacked(part.column("sums"))
                sums[~whole] = (sums[~whole] - rare) * n[~whole, None]
                rows = np.array(part.column("key").to_pylist(), dtype=object), np.where(whole, n, 0), sums
                keys, n, sums = _merged([last, rows] if last else [rows])
                last = keys[-1:], n[-1:], sums[-1:]
                yield means(keys[:-1], n[:-1], sums[:-1])
        if last:
            yield means(*last)

    def means(keys: np.ndarray, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.binary()), _packed(mean_of(sums, n))], ["key", "mean"])

    more, schema = vectors.more, "key binary, word bigint, n bigint, sums binary"
    parts = docs.select(text_key().alias("key"), "text").mapInArrow(run, schema)
    if more:
        parts = Workspace(docs.sparkSession, "pooled").write(parts, "parts")
    both = parts.where("word IS NULL").select("key", "n", "sums", F.lit(True).alias("whole"))
    if more:
        tail = parts.where("word IS NOT NULL").select("key", "word", "n").join(vectors.table.select("word", "sums"), "word")
        both = both.union(tail.select("key", "n", "sums", F.lit(False).alias("whole")))
    return both.repartition("key").sortWithinPartitions("key").mapInArrow(add, "key binary, mean binary")


def mean_of(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    return sums / SCALE / np.maximum(1, n)[:, None]


def text_key():
    """What equal texts have in common; null counts as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


@dataclass
class Network:
    """Standardisation, two layers and the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias)
        return hidden @ self.second + self.second_bias

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Network:
    """A network fitted with Adam on 85 % of the rows and calibrated on the others; without rows it always says 0.5."""
    rng = np.random.default_rng(seed)
    size = x.shape[1]
    net = Network(np.zeros(size), np.ones(size), rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if not len(x):
        return net
    order = rng.permutation(len(x))
    cut = max(1, int(0.85 * len(x)))
    fit, held = order[:cut], order[cut:]
    net.mean, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    net.second = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    share = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
    net.second_bias = float(np.log(share / (1 - share)))
    params = [net.first, net.first_bias, net.second, np.array([net.second_bias])]
    moment, spread = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    z, step = (x - net.mean) / net.scale, 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
            hidden = np.tanh(z[rows] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -500, 500))) - y[rows]) / len(rows)
            inner = error[:, None] * params[2] * (1 - hidden**2)
            grads = [z[rows].T @ inner + 1e-5 * params[0], inner.sum(axis=0), hidden.T @ error + 1e-5 * params[2], error.sum(keepdims=True)]
            step += 1
            for p, g, m, v in zip(params, grads, moment, spread, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.second_bias = float(params[3][0])
    if len(held):
        net.temperature = fit_temperature(net.logits(x[held]), y[held])
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of a grid under which held-out labels are likeliest."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8.0), 60))
    loss = [np.logaddexp(0, np.where(y > 0.5, -1, 1) * logits / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass
class Model:
    """Word vectors and the network over them."""

    vectors: Vectors
    network: Network


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED, least: int = LEAST, frequent: int | None = None) -> Model:
    """Word vectors from all texts, and the network from labels of learnable documents.

    The network sees a bounded sample, the `most` labelled rows with the smallest
    hashed ids. Null labels are left out; a document with several labels counts
    with each; other labels than 0 count as 1.
    """
    vectors = learned_vectors(docs, least, frequent)
    chosen = labels.where(learnable() & F.col(label).isNotNull()).select("doc_id", F.when(F.col(label) == 0, 0.0).otherwise(1.0).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    sample = Workspace(docs.sparkSession, "sample").write(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), "texts")
    means = pooled(sample, vectors)  # of distinct texts
    rows = sample.select("doc_id", "label", text_key().alias("key")).join(means, "key").select("doc_id", "label", "mean").toPandas()  # `most` small rows
    rows = rows.sort_values(["doc_id", "label", "mean"])  # so that the order of tasks changes nothing
    x = np.array([np.frombuffer(m, dtype=np.float64) for m in rows["mean"]]).reshape(-1, SIZE)
    return Model(vectors, train(x, rows["label"].to_numpy(dtype=float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, a probability, and quality_pred, 1 if that is THRESHOLD or more.

    The names get underscores before them where docs has such columns. Null and
    empty texts are scored as texts without words, repeated rows one by one; an
    empty table stays empty. Where all vectors are broadcast, rows are scored where
    they are; else scores are found per distinct text and joined.
    """
    name, predicted, key = fresh(docs, "quality_score"), fresh(docs, "quality_pred"), fresh(docs, "text_key")
    network = docs.sparkSession.sparkContext.broadcast(model.network)
    known = model.vectors.frequent

    def columns(means: np.ndarray) -> list[pa.Array]:
        p = network.value.probabilities(means)
        return [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", TEXT):
            sizes, sums, *_ = _pooled_here(bytes_of(batch.column("text")), known.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns(mean_of(sums, sizes))], names=[*batch.schema.names, name, predicted])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("key"), *columns(_unpacked(batch.column("mean")))], names=[key, name, predicted])

    if not model.vectors.more:
        return docs.mapInArrow(here, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))
    scores = pooled(docs, model.vectors).mapInArrow(joined, f"`{key}` binary, `{name}` double, `{predicted}` int")
    scores = broadcast_if_small(Workspace(docs.sparkSession, "scores").write(scores, "scores"))
    return docs.withColumn(key, text_key()).join(scores, key).select(*(F.col(f"`{c}`") for c in docs.columns), name, predicted)
