"""Fill-in-middle transformation (13).

An Arrow-batched pandas UDF cuts each text into units (code points unless another
pattern is given): finditer of the regex library collects the end offsets of all
units in a compact array, so that two look-ups say where prefix and middle end.
Digests of the seed and the row's id choose the two places and the form. The
output can be turned back into exactly the text, which restored() does.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before prefix, suffix and middle (fixed values).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit; (?s) lets the dot match line breaks too.
CODE_POINT = r"(?s)."
#: Per cent of texts that are transformed, and of these the share whose suffix comes first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
_MADE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string"


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """End offsets of all units of a text; the last unit reaches to its end."""
    ends = array("I" if len(text) < 1 << 32 else "Q", map(regex.Match.end, pattern.finditer(text)))
    if text and (not ends or ends[-1] < len(text)):
        if ends:
            ends[-1] = len(text)
        else:
            ends.append(len(text))
    return ends


def chances(seed: str, doc_id: str) -> list[int]:
    """Four unsigned integers from the SHA-256 of `seed:doc_id`."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, ends: array, drawn: list[int], transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST) -> tuple[str, int | None, int | None, str]:
    """Form (plain, psm or spm), code points of prefix and middle, and output of one text."""
    if not text or drawn[2] % 100 >= transformed or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", None, None, text
    n = len(ends)
    low, high = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
    start, end = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if drawn[3] % 100 < suffix_first:
        return "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(form: str, output: str) -> str:
    """The text of an output. No part holds a mark and none can arise where a part meets one, so the first mark found is the one set."""
    if form == "plain":
        return output
    second = output.index(PREFIX if form == "spm" else SUFFIX, len(PREFIX))
    third = output.index(MIDDLE, second + len(PREFIX))
    first, then, middle = output[len(PREFIX) : second], output[second + len(PREFIX) : third], output[third + len(MIDDLE) :]
    return then + middle + first if form == "spm" else first + middle + then


def fill_in_middle(docs: DataFrame, unit: str = CODE_POINT, seed: str = "1", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output and output_sha256 of every row's whole text.

    A null text counts as empty and is plain, as is a text that holds a mark
    itself; prefix_chars and middle_chars are null then. Rows of one doc_id draw
    alike, a null doc_id draws as an empty one and stays null. What no unit
    covers belongs to the unit before, or else to the only one. Other columns
    are left out, whatever their names; an empty table stays empty.
    """

    @F.pandas_udf(_MADE)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for ids, texts in batches:
            rows = []
            for doc_id, text in zip(ids, texts, strict=True):
                ends = unit_ends(pattern, text)
                form, prefix, middle, output = transform(text, ends, chances(seed, doc_id), transformed, suffix_first)
                rows.append((len(ends), form, prefix, middle, output, hashlib.sha256(output.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    own, text = F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), made(own, text).alias("made")).select("doc_id", "made.*")


def restored(form: Column, output: Column) -> Column:
    """Struct of the text that an output was made of and its SHA-256 in lowercase hex."""

    @F.pandas_udf("text string, sha256 string")
    def back(forms: pd.Series, outputs: pd.Series) -> pd.DataFrame:
        texts = [restore(form, output) for form, output in zip(forms, outputs, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [hashlib.sha256(text.encode()).hexdigest() for text in texts]}, dtype=object)

    return back(form, output)


def digests(made: DataFrame) -> DataFrame:
    """Rows of fill_in_middle() with the digest of the restored text in place of the output."""
    back = made.withColumn("back", restored(F.col("form"), F.col("output")))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.sha256").alias("restored_sha256"))
