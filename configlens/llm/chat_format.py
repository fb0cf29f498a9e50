"""Chat formatting (2): whole conversations with offset-aligned loss masks.

A conversation is rendered as one string, encoded once with offsets, and its
sorted turn spans are intersected with the token spans by binary search. Control
strings inside texts and roles are escaped reversibly, so no text can open or
close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import AddedToken, Tokenizer

START, END = "<|im_start|>", "<|im_end|>"
TOKENIZER_FILE = "byte_bpe_50k.json"
LEARNED_ROLE = "assistant"

_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """text with backslashes doubled and each "<|" split by one, so that it holds no control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    """What escape() or escape_role() was given."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    """Like escape(), and without line feeds, which end the role."""
    return escape(role).replace("\n", "\\n")


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, list[str]]:
    """The rendered conversation, its texts' first and past-the-end places in it, in order, and their roles."""
    parts, begin, end, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        begin.append(at + len(head))
        end.append(begin[-1] + len(body))
        at = end[-1] + len(END) + 1
        parts += head, body, END, "\n"
    return "".join(parts), np.array(begin, dtype=np.int64), np.array(end, dtype=np.int64), [r for r, _ in turns]


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@cache
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file with the control strings as added tokens; read once in each Python worker."""
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = False
    made.add_tokens([AddedToken(x, special=True, normalized=False) for x in (START, END)])
    return made


def encode(formatted: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a rendered conversation and the first and past-the-end character of each token.

    Tokens of one character have the same span; together they cover the string.
    """
    made = tokenizer(path).encode(formatted, add_special_tokens=False)
    spans = np.array(made.offsets, dtype=np.int64).reshape(-1, 2)
    return np.array(made.ids, dtype=np.int64), spans[:, 0], spans[:, 1]


def loss_mask(token_begin: np.ndarray, token_end: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the tokens that overlap a learned span, and the index of that span.

    Spans are sorted and disjoint: the first span that ends after the token
    begins is found by binary search, and overlaps or none does.
    """
    if not len(begin):
        return np.zeros(len(token_begin), dtype=bool), np.zeros(len(token_begin), dtype=np.int64)
    span = np.minimum(np.searchsorted(end, token_begin, side="right"), len(end) - 1)
    mask = (np.maximum(token_begin, begin[span]) < np.minimum(token_end, end[span])) & (token_begin < token_end)
    return mask, span


def masked_text(formatted: str, token_begin: np.ndarray, token_end: np.ndarray, mask: np.ndarray, span: np.ndarray, begin: np.ndarray, end: np.ndarray) -> str:
    """All text under the mask, unescaped, in order.

    A token that straddles a span's edge is cut there; tokens that share a
    character count it once. Texts are unescaped one by one.
    """
    out: list[str] = []
    at, pieces, current = 0, [], -1
    for a, b, s in zip(np.maximum(token_begin[mask], begin[span[mask]]), np.minimum(token_end[mask], end[span[mask]]), span[mask], strict=True):
        if s != current:
            out.append(unescape("".join(pieces)))
            pieces, current = [], s
        a = max(a, at)
        if b > a:
            pieces.append(formatted[a:b])
            at = b
    return "".join(out) + unescape("".join(pieces))


FORMATTED = "conv_id {kind}, formatted string, ids array<int>, loss_mask array<boolean>, token_begin array<int>, token_end array<int>, span_begin array<int>, span_end array<int>"


def format_chats(turns: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: its string, its ids and their loss mask, token spans and learned text spans.

    Rows are ordered by turn, then role and text, nulls first; a null role or
    text counts as empty, rows with a null conv_id are one conversation, repeated
    rows are repeated turns and an empty table gives no rows. Turns arrive sorted
    and a task holds one conversation at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or public_tokenizers.path(TOKENIZER_FILE)
        for some in _some(_conversations(batches)):
            rows = []
            for conv_id, turns in some:
                formatted, begin, end, roles = render(turns)
                learned = np.array([r == LEARNED_ROLE for r in roles], dtype=bool)
                begin, end = begin[learned], end[learned]
                filled = begin < end  # an empty text has no characters to be masked
                ids, a, b = encode(formatted, file)
                mask, _ = loss_mask(a, b, begin[filled], end[filled])
                rows.append((conv_id, formatted, ids, mask, a, b, begin[filled], end[filled]))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    names = ["conv_id", "formatted", "ids", "loss_mask", "token_begin", "token_end", "span_begin", "span_end"]
    ints = pa.list_(pa.int32())
    schema = [to_arrow_type(turns.schema["conv_id"].dataType), pa.string(), ints, pa.list_(pa.bool_()), ints, ints, ints, ints]
    return _sorted(turns).mapInArrow(run, FORMATTED.format(kind=kind))


def _sorted(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select("conv_id", "turn", text("role"), text("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    current, turns = None, []
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if turns and conv_id != current:
                yield current, turns
                turns = []
            current = conv_id
            turns.append((role, text))
    if turns:
        yield current, turns


def _some(rows: Iterator, most: int = 64, chars: int = 1 << 20) -> Iterator[list]:
    some, size = [], 0
    for conv_id, turns in rows:
        some.append((conv_id, turns))
        size += sum(len(t) for _, t in turns)
        if len(some) >= most or size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def read_back(formatted: DataFrame) -> DataFrame:
    """What the output of format_chats() says, read from it alone.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per
    turn), loss_chars, loss_sha256 (of all text under the mask) and
    formatted_chars.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns_sha, chars, loss_sha, size = [], [], [], [], []
            get = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            for i in range(batch.num_rows):
                text = batch.column("formatted")[i].as_py()
                turns = parse(text)
                begin, end = get("span_begin", i).astype(np.int64), get("span_end", i).astype(np.int64)
                a, b, mask = get("token_begin", i).astype(np.int64), get("token_end", i).astype(np.int64), get("loss_mask", i).astype(bool)
                _, span = loss_mask(a, b, begin, end)
                loss = masked_text(text, a, b, mask, span, begin, end)
                n.append(len(turns))
                turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
                chars.append(len(loss))
                loss_sha.append(hashlib.sha256(loss.encode()).hexdigest())
                size.append(len(text))
            counts = pa.int64()
            yield pa.record_batch([batch.column("conv_id"), pa.array(n, counts), pa.array(turns_sha, pa.string()), pa.array(chars, counts), pa.array(loss_sha, pa.string()), pa.array(size, counts)], names)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
