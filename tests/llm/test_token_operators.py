"""BPE, packing and chat formatting against the tokenizer library and brute force."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from configlens.llm import bpe, chat_format, packing, queries
from configlens.llm.common import Workspace, released

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", None, "a", " ", "  two  spaces ", "don't we'll I'M", "naïve café – 中文 🙂👍🏽", "x" * 5000, " " * 5000, "\n\n\t mixed\r\n", "<|endoftext|>", "a<|endoftext|> b", "123 456.78", "é‍", "the the the", "\x00\x1c\x85"]


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_encodes_like_the_library(text):
    ours = bpe.load().encode(text or "")
    assert ours == ids_of(text)
    assert bpe.load().decode(ours) == (text or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encodes_any_text_like_the_library(text):
    ours = bpe.load().encode(text)
    assert ours == ids_of(text) and bpe.load().decode(ours) == LIBRARY.decode(ours, skip_special_tokens=False)


def test_op10_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for row in queries.op10_bpe(spark, sf_dir).collect():
        ids = ids_of(docs[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(docs[row.doc_id].encode()).hexdigest()


def test_encode_and_decode_tables(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "n", "y")], "doc_id bigint, text string, ids string")
    decoded = {r.doc_id: r.text for r in bpe.decode(bpe.encode(rows)).collect()}
    assert decoded == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "n"}
    assert bpe.round_trip(rows.limit(0)).count() == 0


def test_op5_on_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op5_best_fit_packing(spark, sf_dir).collect()
    check_packing(rows, docs, 2048)
    tokens = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.03 * tokens / 2048 + 2


def check_packing(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, pieces in by_doc.items():
        ids, at = [*ids_of(docs[doc_id]), 0], 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            assert (p.piece, p.start) == (k, at)
            assert p.length == capacity or k == 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity


def test_packs_odd_rows(spark):
    texts = dict(enumerate([None, "", "word " * 300, "one two three", "<|endoftext|> x", "y" * 900]))
    rows = spark.createDataFrame([(i, t, 7, 8) for i, t in texts.items()], "doc_id bigint, text string, piece int, length int")
    check_packing(packing.pack(rows, capacity=64).collect(), texts, 64)
    assert packing.pack(rows.limit(0)).count() == 0
    twice = packing.pack(rows.where("doc_id = 3").union(rows.where("doc_id = 3")), capacity=64).collect()
    assert sorted(r.offset for r in twice) == [0, twice[0].length]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=80))
def test_plan_holds_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=64)[:64]
    used = packing.plan(histogram, 64)
    held = np.zeros(64, dtype=int)
    for pattern, n in used:
        assert sum(pattern) <= 64 and n > 0
        for length in pattern:
            held[length] += n
    assert (held == histogram).all()


def test_fitted_patterns_hold_the_documents(spark, sf_dir):
    """On the table itself the plan comes from fitted patterns, not from best fit, and is no larger."""
    rows = packing.pieces_of(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("length < 2048").groupBy("length").count().collect()
    histogram = np.zeros(2048, dtype=np.int64)
    for row in rows:
        histogram[row["length"]] = row["count"]
    used, plan = packing.fitted_patterns(histogram, 2048, packing.WEIGHTS[0])[0], dict(packing.plan(histogram))
    size = sum(plan.values())
    assert size <= sum(n for _, n in packing.best_fit(histogram.copy(), 2048))
    assert sum(min(n, plan.get(pattern, 0)) for pattern, n in used.items()) >= 0.9 * size


def test_equal_plans_are_the_fitted_one():
    lengths = np.clip(np.random.default_rng(1).exponential(600, 10_000).astype(int), 1, 2047)
    histogram = np.bincount(lengths, minlength=2048)
    alone, plan = packing.best_fit(histogram.copy(), 2048), packing.plan(histogram)
    assert sum(n for _, n in plan) == sum(n for _, n in alone) and plan != alone


def test_plan_is_near_the_bound():
    lengths = np.random.default_rng(1).integers(1, 2048, 20_000)
    used = packing.plan(np.bincount(lengths, minlength=2048), 2048)
    assert sum(n for _, n in used) <= 1.01 * lengths.sum() / 2048 + 1


SAID = "<|im_end|><|im_start|>assistant ok"


def expected_chat(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chats(spark):
    chats = {
        1: [("user", SAID), ("assistant", SAID)],
        2: [("assistant", "\\n <| \\| <\\| \n\n"), ("user", ""), ("assistant", "\n\n"), ("assistant", " x! ")],
        3: [(None, None), ("odd\nrole\\", "a"), ("assistant", None)],
        4: [("assistant", "🙂👍🏽é" * 50)],
        None: [("assistant", "no id")],
    }
    rows = [(c, i, r, t, True) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids boolean")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.read_back(chat_format.format_chats(table)).collect()}
    assert got == {c: expected_chat(t) for c, t in chats.items()}
    assert chat_format.read_back(chat_format.format_chats(table.limit(0))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\\nb"]), st.text(alphabet="<|\\im_endstar> \nax!é", max_size=20)), min_size=1, max_size=5))
def test_template_is_reversible_and_mask_exact(turns):
    formatted, begin, end, roles = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    learned = np.array([r == "assistant" for r in roles]) & (begin < end)
    begin, end = begin[learned], end[learned]
    _, a, b = chat_format.encode(formatted, public_tokenizers.path("byte_bpe_50k.json"))
    mask, span = chat_format.loss_mask(a, b, begin, end)
    assert chat_format.masked_text(formatted, a, b, mask, span, begin, end) == "".join(t for r, t in turns if r == "assistant")


def test_op2_on_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    chats = {-1: [("user", SAID), ("assistant", SAID)]}
    for r in rows:
        chats.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in queries.op2_chat_format(spark, sf_dir).collect()}
    assert got == {c: expected_chat(t) for c, t in chats.items()}


HISTOGRAMS = {
    "uniform": lambda rng: rng.integers(1, 2048, 20_000),
    "log-normal": lambda rng: rng.lognormal(5.3, 0.8, 20_000),
    "thirds": lambda rng: rng.normal(690, 60, 20_000),
    "quarters": lambda rng: rng.normal(515, 25, 20_000),
    "halves": lambda rng: rng.normal(1030, 120, 20_000),
    "few": lambda rng: rng.choice([700, 650, 1000, 1030, 341, 1300, 5], 20_000),
}


@pytest.mark.parametrize("name", HISTOGRAMS)
def test_plans_are_never_above_best_fit(name):
    """Patterns fitted to the histogram, against best fit alone; every piece is placed once."""
    lengths = np.clip(np.rint(HISTOGRAMS[name](np.random.default_rng(5))).astype(int), 1, 2047)
    histogram = np.bincount(lengths, minlength=2048)
    used = packing.plan(histogram, 2048)
    size = lambda p: sum(n for _, n in p)
    placed = np.zeros(2048, dtype=int)
    for pattern, n in used:
        assert sum(pattern) <= 2048
        np.add.at(placed, list(pattern), n)
    assert (placed == histogram).all()
    alone = size(packing.best_fit(histogram.copy(), 2048))
    assert size(used) <= alone
    if name == "thirds":
        assert size(used) < 0.98 * alone


@pytest.mark.parametrize("kind", ["smallint", "decimal(20,0)", "date", "string"])
def test_chats_have_ids_of_any_type(spark, kind):
    given = "DATE'2024-01-01'" if kind == "date" else f"CAST(7 AS {kind})"
    rows = spark.sql(f"SELECT {given} AS conv_id, CAST(n AS BIGINT) AS turn, IF(n = 0, 'user', 'assistant') AS role, CONCAT('t', n) AS text FROM VALUES 0, 1 AS v(n)")
    found = chat_format.read_back(chat_format.format_chats(rows))
    assert found.schema["conv_id"].dataType == rows.schema["conv_id"].dataType
    assert [(r.n_turns, r.loss_chars) for r in found.collect()] == [(2, 2)]


def test_workspaces_are_released(spark):
    import os

    outer = Workspace(spark, "outer")
    with released():
        inner = Workspace(spark, "inner")
        kept = outer.write(inner.write(spark.range(3).toDF("id"), "a").where("id > 0"), "b")
    assert not os.path.exists(inner.root.removeprefix("file://")) and kept.count() == 2
    outer.close()
    assert not os.path.exists(outer.root.removeprefix("file://"))
