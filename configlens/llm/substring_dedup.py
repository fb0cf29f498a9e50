"""Substring dedup (7) by prefix-partitioned suffix trees.

A window is a suffix cut at WINDOW words. In the suffix tree of the corpus all
windows of equal words hang below one internal node of that depth, and all its
leaves but the first are repeats. The tree is never held as a whole:

1. Suffixes that can't lie below such a node are left out. Each window is filed
   under its anchor, the ANCHOR consecutive words in it with the smallest hash,
   which equal windows have at equal places. Neighbouring windows mostly share
   one, so a block of windows makes one row. An anchor that occurs once heads a
   subtree of single leaves.
2. Blocks of equal words below an anchor are one leaf, with its first place and
   a count, so that copies never meet in a task. Where an anchor has a single
   leaf, all of its places but the first are repeats.
3. The windows of all other leaves are the suffixes that are dealt: by a prefix
   of DEPTHS[0] words, and by longer ones below prefixes that more than GROUP
   suffixes share, so that each group fits into memory. A task builds the tree of
   each group from the top: it splits nodes by their suffixes' next words, drops
   nodes of one leaf, and what is left at depth WINDOW are the deep internal
   nodes. A prefix of WINDOW words that is still shared by more than GROUP
   suffixes is such a node by itself, whose first leaf an aggregation finds.

Runs of repeated windows make up the maximal repeats, whose words are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, Words, Workspace, broadcast_if_small, bytes_of, mix64, slices, window_hashes

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 20, 6
#: Words of the prefixes that suffixes are dealt by, the next one where a group is too large; the last is WINDOW. Suffixes of a group.
DEPTHS, GROUP = (8, 12, 16, 20), 100_000
#: Suffixes whose trees a task builds at once, at least.
AT_ONCE = 50_000


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (BASE, inverse))


class Spans:
    """Hashes of any run of words, in constant time each."""

    def __init__(self, words: np.ndarray):
        self.forth, back = _powers(1 << max(10, int(len(words)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * back[: len(words)], dtype=np.uint64)])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[end] - self.sums[begin]) * self.forth[begin] + (end - begin).astype(np.uint64))


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a word array: where its anchor starts, and all anchor hashes; the leftmost of equal ones."""
    grams = window_hashes(words, ANCHOR)
    places = WINDOW - ANCHOR + 1
    value, at, width = grams, np.arange(len(grams)), 1

    def wider(by: int) -> None:
        nonlocal value, at
        later = value[by:] < value[:-by]
        value, at = np.where(later, value[by:], value[:-by]), np.where(later, at[by:], at[:-by])

    while 2 * width <= places:
        wider(width)
        width *= 2
    if places > width:
        wider(places - width)
    return at, grams


def blocks_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, text, first window and windows of each block of a batch's texts."""
    hashes = words.hashes
    empty = np.zeros(0, dtype=np.int64)
    if len(hashes) < WINDOW:
        return empty, empty, empty, empty, empty
    at, grams = anchors(hashes)
    text = np.repeat(np.arange(len(words.starts) - 1), np.diff(words.starts))
    whole = text[: len(at)] == text[WINDOW - 1 :][: len(at)]  # windows within one text
    start = np.flatnonzero(whole)
    if not len(start):
        return empty, empty, empty, empty, empty
    new = (np.diff(at[start], prepend=-1) != 0) | (np.diff(text[start], prepend=-1) != 0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    begin = start[first]
    content = Spans(hashes)(begin, begin + size - 1 + WINDOW) + (at[begin] - begin).astype(np.uint64)
    of = text[begin]
    return grams[at[begin]].view(np.int64), mix64(content).view(np.int64), of, begin - words.starts[of], size


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a tag: rows are told apart by their texts if doc_ids repeat, else tag is 0 everywhere."""
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    return docs.withColumn("tag", F.xxhash64("text") if repeated else F.lit(0).cast("bigint"))


def blocks(docs: DataFrame) -> DataFrame:
    """anchor, content, doc_id, tag, first (window) and n (windows) of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            anchor, content, of, first, size = blocks_of(Words(bytes_of(batch.column("text"))))
            rows = pa.array(of, pa.int64())
            columns = [pa.array(anchor), pa.array(content), batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array(first, pa.int32()), pa.array(size, pa.int32())]
            yield pa.record_batch(columns, ["anchor", "content", "doc_id", "tag", "first", "n"])

    return docs.mapInArrow(run, f"anchor bigint, content bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, tag bigint, first int, n int")


def suffixes(carriers: DataFrame) -> DataFrame:
    """doc_id, tag, first, a hash of each prefix of DEPTHS, and the words after the first of them, of the windows that carriers (doc_id, tag, text, spans) name."""
    names = [f"prefix{d}" for d in DEPTHS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            words = Words(bytes_of(batch.column("text")))
            span = Spans(words.hashes)
            spans = batch.column("spans")
            of = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            flat = spans.flatten()
            first, size = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("first", "n"))
            row, start = np.repeat(of, size), np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            for at in range(0, len(row), 20_000):
                part = slice(at, at + 20_000)
                begin = words.starts[row[part]] + start[part]
                prefixes = [pa.array(span(begin, begin + d).view(np.int64)) for d in DEPTHS]
                rest = words.hashes[begin[:, None] + np.arange(DEPTHS[0], WINDOW)].astype("<u4")  # the low half of a hash; the last prefix has all of it
                places = pa.array(row[part], pa.int64())
                columns = [batch.column("doc_id").take(places), batch.column("tag").take(places), pa.array(start[part], pa.int32()), pa.array([x.tobytes() for x in rest], pa.binary()), *prefixes]
                yield pa.record_batch(columns, ["doc_id", "tag", "first", "rest", *names])

    schema = f"doc_id {carriers.schema['doc_id'].dataType.simpleString()}, tag bigint, first int, rest binary, "
    return carriers.mapInArrow(run, schema + ", ".join(f"{n} bigint" for n in names))


def dealt(rows: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame | None]:
    """rows with the prefix that each is dealt by and how deep it is; of prefixes of WINDOW words those that too many share, or None."""
    out = rows.withColumn("prefix", F.col(f"prefix{DEPTHS[0]}")).withColumn("depth", F.lit(DEPTHS[0]))
    for d in DEPTHS:
        full = work.write(out.where(F.col("depth") == d).groupBy("prefix").count().where(F.col("count") > GROUP).select(F.col("prefix").alias("full")), f"full{d}")
        if full.isEmpty():
            return out, None
        if d == WINDOW:
            return out, full
        deeper = DEPTHS[DEPTHS.index(d) + 1]
        out = out.join(broadcast_if_small(full), (F.col("depth") == d) & (F.col("prefix") == F.col("full")), "left")
        out = out.withColumn("prefix", F.when(F.col("full").isNull(), F.col("prefix")).otherwise(F.col(f"prefix{deeper}")))
        out = out.withColumn("depth", F.when(F.col("full").isNull(), F.col("depth")).otherwise(F.lit(deeper))).drop("full")


def deep_leaves(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves below internal nodes of full depth, and the node of each, of suffixes with the group each is in.

    The tree is built from the top: nodes are split by the next word, and nodes of
    one leaf go, so little is left to sort after a few words.
    """
    leaf = np.arange(len(group))
    node = group - group.min(initial=0)
    for d in range(words.shape[1] + 1):
        several = np.bincount(node)[node] > 1
        leaf, node = leaf[several], node[several]
        if d == words.shape[1] or not len(leaf):
            break
        word = words[leaf, d]
        order = np.lexsort((word, node))
        leaf, node, word = leaf[order], node[order], word[order]
        node = np.cumsum(np.append(True, (np.diff(node) != 0) | (np.diff(word.astype(np.int64)) != 0))[: len(leaf)]) - 1
    return leaf, node


def tree_repeats(rows: DataFrame) -> DataFrame:
    """doc_id, tag, first and n (1) of the suffixes below deep internal nodes but for each node's first.

    Groups come one after another; a task holds one, or several small ones.
    """
    names = ["doc_id", "tag", "first", "rest", "prefix", "depth", f"prefix{WINDOW}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < AT_ONCE:
                continue
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            prefix = table.column("prefix").to_numpy()
            cut = int(np.searchsorted(prefix, prefix[-1]))  # the last group may go on
            if cut:
                yield later(table.slice(0, cut))
            held = [table.slice(cut)]
            count = AT_ONCE // 2 if cut == 0 else table.num_rows - cut
        if held:
            yield later(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def later(table: pa.RecordBatch) -> pa.RecordBatch:
        get = lambda c: table.column(c).to_numpy()
        words = np.frombuffer(b"".join(table.column("rest").to_pylist()), dtype="<u4").reshape(table.num_rows, -1)
        group = np.cumsum((np.diff(get("prefix"), prepend=0) != 0) | (np.diff(get("depth"), prepend=0) != 0))
        # The hash of all words is one more word, so that nodes don't rest on half hashes.
        whole = get(f"prefix{WINDOW}").view(np.uint64)
        words = np.concatenate([words, whole[:, None].astype("<u4"), (whole >> np.uint64(32))[:, None].astype("<u4")], axis=1)
        leaf, node = deep_leaves(group, words)
        place = _ordered(table.column("doc_id"), get("tag"), get("first"))[leaf]
        if len(leaf):
            least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, node, place)
            leaf = leaf[place > least[node]]
        out = table.take(pa.array(leaf, pa.int64()))
        return pa.record_batch([*(out.column(c) for c in ("doc_id", "tag", "first")), pa.array(np.ones(len(leaf), dtype=np.int32))], ["doc_id", "tag", "first", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select(names).repartition("prefix").sortWithinPartitions("prefix", "depth").mapInArrow(run, f"doc_id {kind}, tag bigint, first int, n int")


def _ordered(ids: pa.Array, tag: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each suffix's number in page order: by id, null last, then by start. Rows that share id and start share a number."""
    order = pc.sort_indices(pa.table([ids, pa.array(first)], ["id", "first"]), sort_keys=[("id", "ascending"), ("first", "ascending")], null_placement="at_end")
    id_order, first_order = ids.take(order), first[order.to_numpy()]
    if not len(first_order):
        return np.zeros(0, dtype=np.int64)
    known = pc.is_valid(id_order).to_numpy(zero_copy_only=False)
    same = pc.fill_null(pc.equal(id_order[1:], id_order[:-1]), False).to_numpy(zero_copy_only=False) | (~known[1:] & ~known[:-1])
    number = np.cumsum(np.append(True, ~(same & (np.diff(first_order) == 0)))) - 1
    out = np.empty(len(number), dtype=np.int64)
    out[order.to_numpy()] = number
    return out


#: Documents are ordered by id, null after all others, then windows by their start.
_PLACE = "struct(doc_id IS NULL AS last, doc_id, first, tag, n)"


def _later(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """doc_id, tag, first and n of the rows that come after the first of their anchor and content."""
    place = F.col("place")
    same_id = F.col("doc_id").eqNullSafe(place["doc_id"])
    after_id = (F.col("doc_id").isNull() & ~place["last"]) | (F.col("doc_id") > place["doc_id"])
    later = F.coalesce(after_id, F.lit(False)) | (same_id & (F.col("first") > place["first"]))
    return rows.join(firsts, ["anchor", "content"]).where(later).select("doc_id", "tag", "first", "n")


def _firsts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("anchor", "content").agg(F.min(F.expr(_PLACE)).alias("place"), F.count("*").alias("count"))


def _by_document(rows: DataFrame, *fields: str) -> DataFrame:
    """One row per document with its spans; named so that nothing clashes in the join with the texts."""
    return rows.groupBy(F.col("doc_id").alias("id"), F.col("tag").alias("of")).agg(F.collect_list(F.struct(*fields)).alias("spans"))


def repeats(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, tag, first and n: n windows from the first-th on of the document start earlier elsewhere too."""
    found = blocks(docs)
    # Aggregates are written before they are joined: a join right on top of one can't split a frequent key.
    often = work.write(found.groupBy("anchor").count().where("count > 1").select("anchor"), "often")
    shared = work.write(found.join(often, "anchor"), "shared")
    firsts = work.write(_firsts(shared), "firsts")
    whole = work.write(_later(shared, firsts.where("count > 1")), "whole")
    work.drop("shared")
    mixed = work.write(firsts.groupBy("anchor").count().where("count > 1").select("anchor"), "mixed")
    leaves = work.write(firsts.join(mixed, "anchor").select("place.doc_id", "place.tag", "place.first", "place.n"), "leaves")
    work.drop("firsts")
    # Leaves meet their texts once, by a shuffle at every size; what comes of it is read twice, to count prefixes and to deal suffixes.
    wanted = _by_document(leaves, "first", "n")
    named = docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["tag"] == wanted["of"])
    carriers = work.write(docs.join(wanted, named).select("doc_id", "tag", "text", "spans"), "carriers")
    work.drop("leaves")
    rows, full = dealt(suffixes(carriers), work)
    if full is not None:
        alone = (F.col("depth") == WINDOW) & (F.col("prefix") == F.col("full"))
        nodes = work.write(rows.join(broadcast_if_small(full), alone, "left_semi").select(F.lit(0).alias("anchor"), F.col("prefix").alias("content"), "doc_id", "tag", "first", F.lit(1).alias("n")), "nodes")
        of_nodes = work.write(_later(nodes, work.write(_firsts(nodes), "node_firsts")), "of_nodes")
        whole = whole.unionByName(of_nodes)
        rows = rows.join(broadcast_if_small(full), alone, "left_anti")
    apart = work.write(tree_repeats(rows), "apart")
    work.drop("carriers")
    return whole.unionByName(apart)


def removed_words(n: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of n words lie in one of the windows first .. first + size - 1."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + size - 1 + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept and rest of each row.

    kept is the kept words joined by one space, rest a struct of docs' other
    columns. A word is removed if a window of WINDOW words over it starts earlier
    too: in a document of smaller doc_id (null last), or earlier in the same one.
    Windows are judged on the input. A null text has no words; rows that share a
    doc_id are judged by their own texts and none of them is earlier at the same
    start. Texts are whole at any length; an empty table gives no rows.
    """
    work = Workspace(docs.sparkSession, "substring")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("_")).alias("rest"))
    rows = _keyed(docs)
    found = _by_document(repeats(rows.select("doc_id", "text", "tag"), work), "first", "n")
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["tag"] == found["of"]), "left").select("doc_id", "text", "rest", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            count, removed, kept = [], [], []
            for text, spans in zip(bytes_of(batch.column("text")), batch.column("spans"), strict=True):
                words = text.split()
                gone = 0
                if spans.is_valid:
                    flat = spans.values
                    mask = removed_words(len(words), flat.field("first").to_numpy(), flat.field("n").to_numpy())
                    gone = int(mask.sum())
                    words = [words[i] for i in np.flatnonzero(~mask)]
                kept.append(b" ".join(words))
                count.append(len(words) + gone)
                removed.append(gone)
            columns = [batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), batch.column("rest")]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept", "rest"])

    return joined.mapInArrow(run, T.StructType().add("doc_id", rows.schema["doc_id"].dataType).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("rest", rows.schema["rest"].dataType))


def digests(deduped: DataFrame) -> DataFrame:
    """The rows of dedup_substrings() with kept_sha256 instead of the words."""
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
