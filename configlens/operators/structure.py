"""Where a JSON text that was cut by its sample size is still whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _BACKSLASH = 34, 92


def inside_strings(data: np.ndarray) -> np.ndarray:
    """Whether each byte is in a JSON string, its quotes included; a string that isn't closed reaches to the end."""
    inside, begin = np.zeros(len(data), dtype=bool), -1
    for at in np.flatnonzero(data == _QUOTE).tolist():
        if begin < 0:
            begin = at
            continue
        before = at
        while before - 1 > begin and data[before - 1] == _BACKSLASH:
            before -= 1
        if (at - before) % 2 == 0:
            inside[begin : at + 1] = True
            begin = -1
    if begin >= 0:
        inside[begin:] = True
    return inside


def depth(data: np.ndarray, counts: np.ndarray, opening: str, closing: str) -> np.ndarray:
    """How many brackets of a kind are open after each byte; one that closes nothing doesn't count."""
    steps = np.where(counts, (data == ord(opening)).astype(np.int64) - (data == ord(closing)), 0)
    total = np.cumsum(steps)
    return total - np.minimum(0, np.minimum.accumulate(total)) if len(total) else total


def balanced_part(text: str) -> str:
    """The text up to the last place outside of strings at which all brackets are closed, without white space around."""
    content = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(content, dtype=np.uint8)
    outside = ~inside_strings(data)
    closed = outside & (depth(data, outside, "{", "}") == 0) & (depth(data, outside, "[", "]") == 0)
    places = np.flatnonzero(closed)
    return content[: places[-1] + 1 if len(places) else 0].decode("utf-8", "surrogatepass").strip()


@F.pandas_udf(T.StringType())
def cut_at_balance(texts: pd.Series) -> pd.Series:
    """balanced_part() of each text; null for null. A text whose last bracket is open from the start comes out empty."""
    return texts.map(balanced_part, na_action="ignore")
