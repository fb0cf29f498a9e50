"""Language identification (1).

Words are scored per language by the character trigrams they hold; a word's
script narrows the languages it may be in; Viterbi decoding with a penalty for
each switch then labels spans, so that a text of several languages is split into
runs. All arithmetic is over arrays of a batch of texts; long texts are decoded
in segments whose L x L transfer scores are combined, which changes no result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_small, fresh, learnable, mix64, slices, texts_of

#: First and last code points of scripts; letters elsewhere are of script 0. Fixed values of the Unicode standard.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x531, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
UNDETERMINED = "und"
BUCKET_BITS = 16
#: Log-likelihood that a change of language costs; words in a segment of a long text.
SWITCH, SEGMENT = 8.0, 128
#: Trigrams overlap and depend on each other; dividing their log-likelihood by this keeps posteriors from being all 0 or 1.
TEMPER = 8.0
#: Documents of each language that the model is fitted on at most; those with the smallest hashed ids.
MOST_DOCS = 3000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: lower case, whether it is in a word, and 1 + the script of a letter (0: no letter)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    word, script = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x32000):
        x = chr(c)
        if x.isalpha():
            word[c], script[c] = True, 1
            low = x.lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(x)[0] == "M":
            word[c] = True
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] *= np.uint8(k + 2)
    return lower, word, script


class TextWords:
    """The words of a batch of texts: their places, scripts and trigram buckets."""

    def __init__(self, texts: list[str]):
        lower, word, script = _tables()
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
        inside = word[codes]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.begin, self.end = edge[0::2], edge[1::2]
        low = np.where(inside, lower[codes], np.uint32(0)).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = mix64(low * np.uint64(3) + np.roll(low, 1) * np.uint64(0x9E3779B97F4A7C15) + np.roll(low, -1) * np.uint64(0xC2B2AE3D27D4EB4F))
        self.buckets = (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[inside]
        self.letter_starts = np.concatenate([[0], np.cumsum(self.end - self.begin)]).astype(np.int64)
        letters = script[codes]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        self.offset = np.concatenate([[0], ends])
        self.starts = np.searchsorted(self.begin, self.offset)
        self.script = np.maximum.reduceat(letters, np.minimum(self.begin, len(letters) - 1)) if len(self.begin) else np.zeros(0, dtype=np.uint8)
        is_letter = np.concatenate([[0], np.cumsum(letters > 0)])
        self.letters = is_letter[self.end] - is_letter[self.begin]

    def sums(self, per_letter: np.ndarray) -> np.ndarray:
        """The sum over each word of a row per letter."""
        return np.add.reduceat(per_letter, self.letter_starts[:-1], axis=0) if len(self.begin) else per_letter[:0]


@dataclass
class Model:
    """Languages, log-probabilities [bucket, language], languages allowed by script and the languages' shares."""

    languages: list[str]
    scores: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, most_docs: int = MOST_DOCS) -> Model:
    """The model of the languages in docs.lang, from learnable rows with text and lang.

    It is fitted on a bounded sample, the most_docs documents of each language
    with the smallest hashed ids; every language with a learnable row takes part.
    Without any such row the model has no language.
    """
    spark = docs.sparkSession
    rows = docs.where(learnable() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    # Hashes are counted in 4096 parts of their range, so that a frequent language is never ranked as a whole.
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).withColumn("part", F.shiftright("hash", 52))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = hashed.groupBy("lang", "part").count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).where(F.col("before") < most_docs)
    work = Workspace(spark, "languages")
    parts = broadcast_if_small(work.write(parts.select("lang", "part", "before"), "parts"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("lang", "part").orderBy("hash", "doc_id"))
    sample = hashed.join(parts, ["lang", "part"]).withColumn("place", place).where(F.col("place") <= most_docs)
    sample = work.write(sample.select("doc_id").distinct(), "sample")  # most_docs ids per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in slices(batches, "text", 1 << 20):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            texts = texts_of(batch.column("text"))
            for lang in dict.fromkeys(langs):
                words = TextWords([t for t, x in zip(texts, langs, strict=True) if x == lang])
                counts, scripts = found.setdefault(lang, (np.zeros(1 << BUCKET_BITS), np.zeros(len(SCRIPTS) + 2)))
                counts += np.bincount(words.buckets, minlength=len(counts))
                scripts += np.bincount(words.script, weights=words.letters, minlength=len(scripts))
        for lang, (counts, scripts) in found.items():
            for kind, values in (("bucket", counts), ("script", scripts)):
                at = np.flatnonzero(values)
                yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(values[at].astype(np.int64))], ["lang", "kind", "at", "n"])

    counted = rows.join(broadcast_if_small(sample), "doc_id").select("lang", "text").mapInArrow(run, "lang string, kind string, at int, n bigint")
    found = counted.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas()  # 2^16 rows per language at most
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(share)
    place = {x: i for i, x in enumerate(languages)}
    counts, scripts = np.zeros((1 << BUCKET_BITS, len(languages))), np.zeros((len(SCRIPTS) + 2, len(languages)))
    for kind, target in (("bucket", counts), ("script", scripts)):
        some = found[found["kind"] == kind]
        target[some["at"].to_numpy(dtype=np.int64), some["lang"].map(place).to_numpy(dtype=np.int64)] = some["n"].to_numpy()
    total = counts.sum(axis=0)
    scores = np.log((counts + 0.1) / (total + 0.1 * len(counts)))
    allowed = (scripts / np.maximum(1, scripts.sum(axis=0)) >= 0.01) if languages else scripts > 0
    prior = np.array([share[x] for x in languages], dtype=float)
    return Model(languages, scores.astype(np.float32), allowed, prior / max(1.0, prior.sum()))


def word_scores(words: TextWords, model: Model) -> np.ndarray:
    """Log-likelihoods [word, language]; languages that a word's script rules out get much less.

    Words of a script that no language uses are no evidence: 0 for all.
    """
    scores = words.sums(model.scores[words.buckets]).astype(np.float64)
    allowed = model.allowed[words.script]
    scores[~allowed] = -1e4
    scores[~allowed.any(axis=1)] = 0.0
    return scores


def viterbi(scores: np.ndarray, starts: np.ndarray, switch: float = SWITCH, segment: int = SEGMENT) -> np.ndarray:
    """The best language of each word; words of text d are starts[d]:starts[d + 1].

    A path's score is the sum of its words' scores less `switch` for each change.
    Ties keep the language, or go to the first one. Texts are cut into segments:
    first each segment's best score from every language to every language, then
    what enters each segment, then back pointers, then the paths.
    """
    n, k = scores.shape
    sizes = np.diff(starts)
    if not n:
        return np.zeros(0, dtype=np.int64)
    per_text = -(-sizes // segment)
    text = np.repeat(np.arange(len(sizes)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    begin = starts[:-1][text] + number * segment
    length = np.minimum(segment, starts[1:][text] - begin)
    order = np.argsort(-length, kind="stable")
    begin, length, number, text = begin[order], length[order], number[order], text[order]
    active = np.searchsorted(-length, -np.arange(segment), side="left")  # segments longer than t
    same = np.eye(k, dtype=bool)

    def step(v: np.ndarray, t: int, m: int) -> np.ndarray:
        return np.maximum(v, v.max(axis=-1, keepdims=True) - switch) + (scores[begin[:m] + t] if v.ndim == 2 else scores[begin[:m] + t][:, None, :])

    # What each segment makes of a language that enters it (only where a text has several segments).
    entering = np.zeros((len(begin), k))
    several = np.flatnonzero(per_text[text] > 1)
    if len(several):
        transfer = np.full((len(begin), k, k), -switch)
        transfer[:, same] = 0.0
        for t in range(segment):
            m = int(active[t])
            if m:
                # The first step takes the entering language itself; later ones may switch.
                transfer[:m] = transfer[:m] + scores[begin[:m] + t][:, None, :] if t == 0 else step(transfer[:m], t, m)
        chain = np.lexsort((text, number))
        bounds = np.searchsorted(number[chain], np.arange(int(number.max()) + 2))
        carried = np.zeros((len(sizes), k))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            at = chain[a:b]
            entering[at] = carried[text[at]]
            carried[text[at]] = (carried[text[at]][:, :, None] + transfer[at]).max(axis=1)
            carried[text[at]] -= carried[text[at]].max(axis=1, keepdims=True)
    # Back pointers within all segments at once.
    back = np.zeros((segment, len(begin), k), dtype=np.int8 if k < 127 else np.int16)
    v = entering.copy()
    own = np.arange(k)
    for t in range(segment):
        m = int(active[t])
        if not m:
            break
        best = v[:m].argmax(axis=1)
        top = v[:m].max(axis=1)
        stays = v[:m] >= top[:, None] - switch
        back[t, :m] = np.where(stays, own, best[:, None])
        v[:m] = np.where(stays, v[:m], top[:, None] - switch) + scores[begin[:m] + t]
    # Paths for every language that a segment may end in, then the chain of ends.
    path = np.zeros((segment, len(begin), k), dtype=back.dtype)
    current = np.broadcast_to(own, (len(begin), k)).astype(np.int64).copy()
    for t in range(segment - 1, -1, -1):
        m = int(active[t])
        if m:
            path[t, :m] = current[:m]
            current[:m] = np.take_along_axis(back[t, :m].astype(np.int64), current[:m], axis=1)
    ends = np.zeros(len(begin), dtype=np.int64)
    wanted = np.full(len(sizes), -1)
    chain = np.lexsort((text, -number))
    bounds = np.searchsorted(-number[chain], -np.arange(int(number.max()), -2, -1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        at = chain[a:b]
        ends[at] = np.where(wanted[text[at]] >= 0, wanted[text[at]], v[at].argmax(axis=1))
        wanted[text[at]] = current[at, ends[at]]
    out = np.empty(n, dtype=np.int64)
    for t in range(segment):
        m = int(active[t])
        if m:
            out[begin[:m] + t] = path[t, np.arange(m), ends[:m]]
    return out


def label(texts: list[str], model: Model) -> tuple[TextWords, np.ndarray, list[str], np.ndarray]:
    """Words, their languages' numbers, and each text's language and score.

    A text's language has the most letters under the path; its score is that
    share of letters times the tempered posterior of the language over the text.
    """
    words = TextWords(texts)
    count, k = len(texts), len(model.languages)
    if not k:
        return words, np.zeros(len(words.begin), dtype=np.int64), [UNDETERMINED] * count, np.zeros(count)
    scores = word_scores(words, model)
    path = viterbi(scores, words.starts)
    doc = np.repeat(np.arange(count), np.diff(words.starts))
    letters = np.bincount(doc * k + path, weights=words.letters, minlength=count * k).reshape(count, k)
    evidence = np.stack([np.bincount(doc, weights=scores[:, i], minlength=count) for i in range(k)], axis=1)
    evidence = evidence / TEMPER + np.log(model.prior + 1e-9)
    evidence = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    evidence /= evidence.sum(axis=1, keepdims=True)
    total = letters.sum(axis=1)
    # Ties in letters go to the likelier language.
    best = np.lexsort((np.broadcast_to(np.arange(k), (count, k)), -evidence, -letters), axis=1)[:, 0] if k > 1 else np.zeros(count, dtype=np.int64)
    rows = np.arange(count)
    score = np.where(total > 0, letters[rows, best] / np.maximum(1, total) * evidence[rows, best], 0.0)
    names = [model.languages[b] if n else UNDETERMINED for b, n in zip(best, total, strict=True)]
    return words, path, names, np.clip(score, 0.0, 1.0)


def explained(words: TextWords, model: Model, count: int) -> np.ndarray:
    """The share of each text's letters in words of a script that some language is written in."""
    doc = np.repeat(np.arange(count), np.diff(words.starts))
    known = model.allowed[words.script].any(axis=1)
    total = np.bincount(doc, weights=words.letters, minlength=count)
    return np.bincount(doc, weights=words.letters * known, minlength=count) / np.maximum(1, total)


def identify(docs: DataFrame, model: Model, share: bool = False) -> DataFrame:
    """docs with lang_pred and lang_score (with underscores before them where docs has such columns).

    lang_pred is a learned language or `und` where the text is null or has no
    letter; empty and very long texts, ties and repeated rows are labelled one by
    one, an empty table stays empty. Only the text is read for it. With `share`
    a last column lang_explained tells the share of letters that explained() gives.
    """
    name, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    more = [fresh(docs, "lang_explained")] * share
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            words, _, names, scores = label(texts_of(batch.column("text")), known.value)
            shares = [pa.array(explained(words, known.value, batch.num_rows)) for _ in more]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores), *shares], names=[*batch.schema.names, name, score, *more])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, ", ".join([f"{schema}, `{name}` string, `{score}` double", *(f"`{c}` double" for c in more)]))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, begin, end (characters of the text) and lang of each run of words of one language, in order per text."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = known.value.languages
        for batch in slices(batches, "text", 1 << 20):
            words, path, _, _ = label(texts_of(batch.column("text")), known.value)
            if not names:
                continue
            doc = np.repeat(np.arange(batch.num_rows), np.diff(words.starts))
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
            last = np.append(first[1:], len(doc)) - 1 if len(first) else first
            base = words.offset[doc[first]]
            columns = [batch.column("doc_id").take(pa.array(doc[first])), pa.array(words.begin[first] - base), pa.array(words.end[last] - base), pa.array([names[p] for p in path[first]], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "begin", "end", "lang"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, begin bigint, end bigint, lang string")
