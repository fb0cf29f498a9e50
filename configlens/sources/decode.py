"""Whether samples are text, and which text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that count as printable, the share of them that makes a text, and of zero bytes in every other place that makes UTF-16.
_PRINTABLE = np.isin(np.arange(256), [*range(0x20, 0x7F), 0x09, 0x0A, 0x0D])
PRINTABLE_SHARE, ZERO_SHARE = 0.9, 0.6
#: Marks at a text's beginning; encodings are tried in this order after that of the mark.
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
_ENCODINGS = ("utf-8", "utf-16-le", "utf-16-be", "latin-1")


def is_text(sample: bytes) -> bool:
    """Whether a sample is text: empty, with a byte order mark, mostly printable, or so in every other byte with zeros between."""
    if not sample or sample.startswith(tuple(m for m, _ in _MARKS)):
        return True
    data = np.frombuffer(sample, dtype=np.uint8)
    if _PRINTABLE[data].mean() >= PRINTABLE_SHARE:
        return True
    if (data == 0).sum() < len(data) // 4:
        return False
    even, odd = data[::2], data[1::2]
    return any(len(x) and _PRINTABLE[x].mean() >= PRINTABLE_SHARE and (y == 0).sum() / max(1, len(y)) >= ZERO_SHARE for x, y in ((even, odd), (odd, even)))


def _decode_one(sample: bytes | None) -> tuple[str | None, str | None]:
    if sample is None or not is_text(sample):
        return None, None
    for encoding in dict.fromkeys([*(e for m, e in _MARKS if sample.startswith(m)), *_ENCODINGS]):
        try:
            return sample.decode(encoding).lstrip("\ufeff"), encoding
        except UnicodeDecodeError as e:
            if encoding == "utf-8" and e.start >= len(sample) - 3 and e.reason == "unexpected end of data" and e.start:  # cut by the sample size
                return sample[: e.start].decode("utf-8").lstrip("\ufeff"), encoding
    return None, None


@F.pandas_udf(T.StructType().add("text", "string").add("encoding", "string"))
def decode(samples: pd.Series) -> pd.DataFrame:
    """Text and encoding of samples; both null where a sample isn't text."""
    return pd.DataFrame([_decode_one(bytes(s) if s is not None else None) for s in samples], columns=["text", "encoding"])


def with_text(files: DataFrame) -> DataFrame:
    """files (sample) with text and encoding."""
    return files.withColumn("_decoded", decode("sample")).select("*", "_decoded.text", "_decoded.encoding").drop("_decoded")
