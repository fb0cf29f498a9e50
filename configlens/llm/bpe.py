"""BPE encoding and decoding (10).

Encoding splits a text into pretokens and merges each one's byte symbols: the
symbols form a doubly linked list, a priority queue holds the ranks of adjacent
pairs, and entries whose symbols have changed meanwhile are skipped as stale.
Decoding joins the vocabulary's byte strings. The vocabulary is a tokenizer file
whose path is a parameter; it is read by each Python worker.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

DEFAULT_FILE = "byte_bpe_50k.json"
#: Pretokens of byte-level BPE, as the tokenizer file's ByteLevel step splits them (a fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same with the letters, numbers and spaces up to U+017F spelt out, which the faster re module can match.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PRETOKEN_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pretokens that a worker remembers, and the longest one worth remembering; they only save time.
REMEMBERED, REMEMBERED_CHARS = 250_000, 40


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class BytePairEncoding:
    """Encoder and decoder of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in symbols.items()}
        self.byte_ids = [vocab[symbols[b]] for b in range(256)]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made_by: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((vocab[left], vocab[right]), rank)
            self.made_by.append(vocab[left + right])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if token not in self.added}
        pieces |= {i: content.encode() for content, i in self.added.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.pretokens_any = regex.compile(PRETOKEN).findall
        self.pretokens_latin = re.compile(PRETOKEN_LATIN).findall
        self.beyond_latin = re.compile("[^\x00-\u017f]").search
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pretoken."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        rank_of, made_by = self.ranks.get, self.made_by
        # Rank of each symbol with its successor; a queue entry is stale if its rank is no longer the one here.
        current = list(map(rank_of, zip(ids, ids[1:], strict=False)))
        bits = n.bit_length()
        queue = [(rank << bits) | i for i, rank in enumerate(current) if rank is not None]
        if not queue:
            return tuple(ids)
        current.append(None)
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        push, pop, mask = heapq.heappush, heapq.heappop, (1 << bits) - 1
        while queue:
            entry = pop(queue)
            i, rank = entry & mask, entry >> bits
            if current[i] != rank:
                continue
            j = after[i]
            ids[i] = made = made_by[rank]
            ids[j], current[j] = -1, None
            k = after[i] = after[j]
            current[i] = None
            if k < n:
                before[k] = i
                found = rank_of((made, ids[k]))
                if found is not None:
                    current[i] = found
                    push(queue, (found << bits) | i)
            h = before[i]
            if h >= 0:
                current[h] = found = rank_of((ids[h], made))
                if found is not None:
                    push(queue, (found << bits) | h)
        return tuple([x for x in ids if x >= 0])

    def _words(self, text: str) -> list[tuple[int, ...]]:
        known, out = self.known, []
        for word in (self.pretokens_any if self.beyond_latin(text) else self.pretokens_latin)(text):
            found = known.get(word)
            if found is None:
                found = self.merge(word.encode())
                if len(word) <= REMEMBERED_CHARS:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = found
            out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text; added tokens' strings get the added tokens' ids."""
        if not self.split_added or not any(x in text for x in self.added):
            return list(chain.from_iterable(self._words(text)))
        out: list[int] = []
        for part in self.split_added(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(chain.from_iterable(self._words(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, BytePairEncoding] = {}


def load(path: str | None = None) -> BytePairEncoding:
    """The encoder of a tokenizer file, read once in each Python worker."""
    path = path or public_tokenizers.path(DEFAULT_FILE)
    if path not in _LOADED:
        _LOADED[path] = BytePairEncoding(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and ids array<int> of every row's whole text, in no order.

    A null text counts as empty and gets no ids, a null doc_id stays null,
    repeated rows are each encoded, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, "text", 2 << 20):
            ids = [bpe.encode(t) for t in texts_of(batch.column("text"))]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of every whole text's ids and of the text decoded from them.

    doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded_sha256. It encodes and decodes in one pass, so ids never leave the
    worker. Nulls, empty texts and repeated rows are as in encode().
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        written = [str(i) for i in range(len(bpe.pieces))]
        for batch in slices(batches, "text", 2 << 20):
            counts, of_ids, of_text = [], [], []
            for text in texts_of(batch.column("text")):
                ids = bpe.encode(text)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(written.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]
            yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
