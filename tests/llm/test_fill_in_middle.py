"""Fill-in-middle against SQL, a plain version and exact round trips."""

import hashlib
import os

import duckdb
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from configlens.llm import fill_in_middle as fim
from configlens.llm import queries


def test_op13_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{os.path.join(sf_dir, 'documents.parquet')}')")
    columns = "doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256"
    theirs = con.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL['op13_fill_in_middle']}) ORDER BY doc_id").fetchall()
    ours = [tuple(r) for r in queries.op13_fill_in_middle(spark, sf_dir).select(*columns.split(", ")).orderBy("doc_id").collect()]
    assert ours == theirs
    assert len({r[2] for r in ours}) == 3


def plain(doc_id, text):
    """The contract word by word, over code points."""
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k * 8 : k * 8 + 8], 16) for k in range(4))
    n = len(text)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, "<S>" + s + "<P>" + p + "<M>" + m) if h4 % 100 < 20 else (n, "psm", a, b - a, "<P>" + p + "<S>" + s + "<M>" + m)


ODD = ["", "a", "ab", "é", "🙂👍🏽", "é\r\n", "<P>", "x<S>y", "<M", "<<P", "S><", "<P<S<M" * 5, "\x00\n  ", "long " * 50_000]


def test_odd_texts_as_a_table(spark):
    rows = [(i, t, "form") for i, t in enumerate(ODD)] + [(3, "again", None), (3, "again", None), (None, "no id", None), (7, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    made = fim.fill_in_middle(docs)
    found = sorted(tuple(r) for r in made.select(*(made[c].cast("string") for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"))).na.fill("").collect())
    expected = []
    for doc_id, text, _ in rows:
        doc_id = "" if doc_id is None else str(doc_id)
        expected.append((doc_id, *("" if x is None else str(x) for x in plain(doc_id, text or ""))))
    assert found == sorted(expected)
    back = fim.digests(made).collect()
    assert sorted(r.restored_sha256 for r in back) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSMab\n", max_size=30), st.integers(0, 10_000))
def test_every_output_restores(text, doc_id):
    form, prefix, middle, output = fim.transform(text, fim.unit_ends(regex.compile(fim.CODE_POINT), text), fim.chances("1", str(doc_id)))
    assert (len(text), form, prefix, middle, output) == plain(doc_id, text)
    assert fim.restore(form, output) == text


def test_other_units(spark):
    words = regex.compile(r"\S+\s*")
    assert list(fim.unit_ends(words, "one two\nthree ")) == [4, 8, 14]
    assert list(fim.unit_ends(words, "  ")) == [2]
    assert list(fim.unit_ends(regex.compile("b"), "abcb?")) == [2, 5]
    docs = spark.createDataFrame([(i, "one two three four") for i in range(60)], "id bigint, body string")
    made = fim.fill_in_middle(docs, unit=r"\S+\s*", transformed=100, suffix_first=50, id_column="id", text_column="body").collect()
    assert {r.n for r in made} == {4} and {r.form for r in made} == {"psm", "spm"}
    assert {r.prefix_chars for r in made} <= {0, 4, 8, 14, 18}
    assert all(fim.restore(r.form, r.output) == "one two three four" for r in made)
