"""Spelling variant grouping (11).

Words whose spelling differs by one code point are found without comparing all
pairs: an edit leaves the half of a word before it or the half after it intact,
so two near words share a block of the forward dictionary (words sorted, equal
beginnings together) or of the reversed one (words sorted from their ends). Both
are range-partitioned and scanned block by block. A block of more than BLOCK words
is subdivided before: the part in which the edit may be is halved again, and half
of it is shared as well. With one place left, a block holds no more words than
there are letters. Pairs in a block are verified, and each pair counts in the one
block whose part holds its first difference.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, bytes_of, slices

#: Runs of letters, once A-Z are lower-cased (a fixed value).
RUN = "[a-zÀ-ÿ]+"
#: One run in so many loses a code point, so that the table holds variants to find.
EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs so many times as often as its variant, or more.
RATIO = 5
#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 48
#: Distinct words that a task adds up at a time, and characters of them.
HELD, HELD_CHARS = 400_000, 32 << 20


def thinned(word: str, prefix_crc: int, every: int = EVERY) -> str:
    """The word without one code point if `every` divides the CRC-32 that goes on from prefix_crc with it."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % every:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, every: int = EVERY, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: how often the runs of all whole texts come to each word of at least so many code points and occurrences.

    A null text has no runs; a null doc_id counts as an empty one where runs are
    thinned; every row counts, repeated ones too. A task adds up a bounded number of words at a
    time, and what tasks hand on is added up by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(RUN).findall
        held: dict[str, int] = {}
        size = 0
        for batch in slices(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), bytes_of(batch.column("text")), strict=True):
                prefix_crc = zlib.crc32(f"{doc_id}:".encode())
                own: dict[str, int] = {}
                for word in runs(text.lower().decode("utf-8", "replace")):  # bytes.lower() changes A-Z alone
                    if len(word) >= least_length:
                        own[word] = own.get(word, 0) + 1
                for word, n in own.items():
                    word = thinned(word, prefix_crc, every)
                    if len(word) >= least_length:
                        before = held.get(word)
                        held[word] = n + (before or 0)
                        if before is None:
                            size += len(word)
            if len(held) > HELD or size > HELD_CHARS:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    def rows(held: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if held:
            yield from pa.table({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())}).to_batches(20_000)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


_KEY = ["head", "tail", "size", "low", "high"]
_BLOCK_ROWS = [*_KEY, "word", "n"]


def _keyed(rows: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows of word, n and size with the block whose words may differ at places low to high - 1: what they share before and, from the end, after."""
    after = F.greatest(F.lit(0), F.col("size") - high)
    head, tail = F.substring("word", F.lit(1), low), F.substring(F.reverse("word"), F.lit(1), after)
    return rows.select(head.alias("head"), tail.alias("tail"), "size", low.alias("low"), high.alias("high"), "word", "n")


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of each row's block; size is the length of the shorter word of the pairs that the block is for."""
    low, high = F.col("low"), F.col("high")
    middle = F.floor((low + high) / 2).cast("int")
    return _keyed(rows, low, middle).unionByName(_keyed(rows, middle, high))


def blocks(words: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """Rows of words in blocks of at most `block` words each, or of one place.

    Each word stands in blocks for pairs with words of its length or longer ones,
    and in blocks for pairs with shorter ones. Blocks are counted before any row
    is moved, so no task gathers a large one.
    """
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("size"))
    rows = _halves(both.select("word", "n", "size", F.lit(0).alias("low"), (F.col("size") + 1).alias("high")))
    found, depth = None, 0
    while True:
        rows = work.write(rows, f"blocks{depth}")
        large = rows.where(F.col("high") - F.col("low") > 1).groupBy(*_KEY).count().where(F.col("count") > block)
        large = work.write(large.select(*_KEY), f"large{depth}")
        if large.isEmpty():
            return found.unionByName(rows) if found else rows
        sides = broadcast_if_small(large)
        small = rows.join(sides, _KEY, "left_anti").select(*_BLOCK_ROWS)
        found = found.unionByName(small) if found else small
        rows, depth = _halves(rows.join(sides, _KEY, "left_semi").select(*_BLOCK_ROWS)), depth + 1


def first_difference(a: str, b: str, low: int) -> int:
    """The first place from low on at which a and b differ; the length of the shorter one if there is none."""
    end = min(len(a), len(b))
    while low < end and a[low] == b[low]:
        low += 1
    return low


def compare(size: int, low: int, high: int, words: list[tuple[str, int]]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Pairs of (word, n) of one block that differ by one code point whose first place is the block's."""
    short = [x for x in words if len(x[0]) == size]
    for i, x in enumerate(short):
        a = x[0]
        for y in short[i + 1 :]:
            b = y[0]
            at = first_difference(a, b, low)
            if at < high and at < size and a[at + 1 :] == b[at + 1 :]:
                yield x, y
    for y in (x for x in words if len(x[0]) > size):
        b = y[0]
        for x in short:
            at = first_difference(x[0], b, low)
            if at < high and x[0][at:] == b[at + 1 :]:
                yield x, y


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads a dictionary in its order, compares the words of each block, and hands on what each word has found, added up."""
    found: dict[str, list] = {}

    def meet(x: tuple[str, int], y: tuple[str, int]) -> None:
        best = found.get(x[0])
        if best is None:
            found[x[0]] = [1, -y[1], y[0]]
        else:
            best[0] += 1
            if (-y[1], y[0]) < (best[1], best[2]):
                best[1:] = -y[1], y[0]

    def rows() -> pa.RecordBatch:
        n, less, near = (pa.array(map(itemgetter(k), found.values()), kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))
        return pa.record_batch([pa.array(found.keys(), pa.string()), n, less, near], ["word", "n_near", "less", "near"])

    key, words = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in _BLOCK_ROWS]
        for *now, word, n in zip(*columns, strict=True):
            if now != key:
                if len(words) > 1:
                    for x, y in compare(*key[2:], words):
                        meet(x, y)
                        meet(y, x)
                key, words = now, []
            words.append((word, n))
        if len(found) > 20_000:
            yield rows()
            found.clear()
    if len(words) > 1:
        for x, y in compare(*key[2:], words):
            meet(x, y)
            meet(y, x)
    if found:
        yield rows()


def near_words(words: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """word, n_near and best (less, near) of each word that has a near one; best is the near word of largest n, -less."""
    rows = blocks(words, work, block)
    # A block whose words share more before the edit than after it is one of the forward dictionary, else of the reversed one.
    forward = F.length("head") >= F.length("tail")

    def scanned(part: DataFrame, *order: str) -> DataFrame:
        order = (*order, "size", "low", "high")
        return part.repartitionByRange(*order).sortWithinPartitions(*order, "word").mapInArrow(_scan, "word string, n_near bigint, less bigint, near string")

    found = scanned(rows.where(forward), "head", "tail").unionByName(scanned(rows.where(~forward), "tail", "head"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))


def roots(forms: DataFrame, work: Workspace) -> DataFrame:
    """word and root of rows of word and form: the end of each word's chain of forms.

    Forms occur RATIO times as often as their variants, so chains are short and
    don't close; each round doubles how far a word has come along its chain.
    """
    reached, depth = work.write(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        ahead = broadcast_if_small(reached.select(F.col("word").alias("root"), F.col("root").alias("ahead")))
        if reached.join(ahead, "root", "left_semi").isEmpty():
            return reached
        depth += 1
        reached = work.write(reached.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), f"roots{depth}")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n and root of rows of distinct words and their n.

    Two words are near if one inserted, deleted or replaced code point makes one
    the other. A word's form is its near word of largest n, the first in
    code-point order if several have it, if that n is at least ratio times the
    word's; null else. The root is the last of the chain of forms, the word itself
    if it has none. Null words are left out, other columns too; an empty table
    gives an empty one.
    """
    work = Workspace(words.sparkSession, "spelling")
    words = work.write(words.select("word", "n").where("word IS NOT NULL"), "words")
    near = work.write(near_words(words, work, block), "near")
    has = -F.col("best.less") >= ratio * F.col("n")
    all_words = words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n")
    )
    all_words = work.write(all_words, "forms")
    ends = roots(all_words.where("form IS NOT NULL"), work)
    return all_words.join(broadcast_if_small(ends), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of all whole texts of docs with their forms; see word_counts() and variants()."""
    return variants(word_counts(docs))
