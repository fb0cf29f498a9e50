"""Packages of collected files: manifests, size limits, sealed contents."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from glob import glob

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAGIC = re.compile(r"[*?\[]")


def glob_base(pattern: str) -> str:
    """The folder above a glob's first component with a wildcard: where listing has to begin."""
    parts = pattern.split("/")
    fixed = next((i for i, p in enumerate(parts) if _MAGIC.search(p)), len(parts) - 1)
    return "/".join(parts[:fixed]) or ("/" if pattern.startswith("/") else ".")


def expand_sources(sources: Sequence[str], baseline: str | None = None, base_dir: str = ".") -> list[str]:
    """Files of literal paths and globs, each once, the baseline's first; a source without any is an error."""
    out: dict[str, None] = {}
    for source in ([baseline] if baseline else []) + [s for s in sources if s != baseline]:
        found = [p for p in sorted({*glob(os.path.join(base_dir, source), recursive=True), *glob(source, recursive=True)}) if os.path.isfile(p)]
        if not found:
            raise FileNotFoundError(source)
        out |= dict.fromkeys(map(os.path.abspath, found))
    return list(out)


def safe_name(name: Column) -> Column:
    """A name for a folder or file: letters, digits, `.`, `_` and `-`, others as `-`."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}._-]+", "-"), "^-+|-+$", ""), F.lit("")), F.lit("item"))


def manifest(files: DataFrame, package: str, limit: int | None = None) -> DataFrame:
    """source, destination, size, sha256 and running_size of files (host_id, relative_path, content), in path order.

    With a limit, a package that grows beyond it is an error of the query.
    """
    rows = files.select(
        F.col("relative_path").alias("source"),
        F.concat_ws("/", F.lit(package), safe_name(F.col("host_id")), "relative_path").alias("destination"),
        F.octet_length("content").cast("bigint").alias("size"),
        F.sha2("content", 256).alias("sha256"),
    )
    total = rows.agg(F.sum("size").alias("total_size"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    if limit is not None:
        rows = rows.where(F.when(F.col("total_size") > limit, F.raise_error(F.concat(F.lit("package is larger than "), F.lit(limit)))).otherwise(F.lit(True)))
    return rows.orderBy(F.split("source", "/"))


def outside(files: DataFrame, collected: DataFrame) -> DataFrame:
    """files (path) that lie in none of the collected folders (folder)."""
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))
    inside = files.select("path", F.explode(above).alias("folder")).join(collected.select(F.regexp_replace("folder", "(?<=.)/+$", "").alias("folder")), "folder", "left_semi")
    return files.join(inside.select("path").distinct(), "path", "left_anti")


def copy_files(files: DataFrame, folder: str) -> DataFrame:
    """source, destination, size and sha256 of files (source, destination, content) after they were written below a folder that all executors share."""
    schema = "source string, destination string, size bigint, sha256 string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for source, destination, content in zip(frame["source"], frame["destination"], frame["content"], strict=True):
                path, data = os.path.join(folder, destination), bytes(content)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as file:
                    file.write(data)
                os.replace(part, path)  # a task that is tried again leaves whole files
                rows.append((source, destination, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["source", "destination", "size", "sha256"])

    return files.select("source", "destination", "content").mapInPandas(run, schema)


def load_keys(text: str) -> tuple[bytes, bytes]:
    """AES and HMAC key of a keyset in JSON: aes_key and hmac_key, each with a value in base64 or hex (encoding)."""
    keyset = json.loads(text)
    if not isinstance(keyset, dict):
        raise ValueError("a keyset is a JSON object")
    keys = []
    for names in (("aes_key", "aes"), ("hmac_key", "hmac", "mac_key")):
        entry = next((keyset[n] for n in names if isinstance(keyset.get(n), dict)), None)
        if entry is None:
            raise ValueError(f"the keyset has no {names[0]}")
        value, encoding = str(entry.get("value") or entry.get("data") or "").strip(), str(entry.get("encoding", "base64")).lower()
        try:
            keys.append({"base64": lambda v: base64.b64decode(v, validate=True), "hex": bytes.fromhex}[encoding](value))
        except (KeyError, ValueError) as e:
            raise ValueError(f"{names[0]} can't be read as {encoding}") from e
    check_keys(*keys)
    return keys[0], keys[1]


def _mac(key: bytes):
    @F.pandas_udf(T.BinaryType())
    def mac(contents: pd.Series) -> pd.Series:
        return contents.map(lambda c: None if c is None else hmac.new(key, bytes(c), hashlib.sha256).digest())

    return mac


def check_keys(aes_key: bytes, mac_key: bytes) -> None:
    """Keys of a keyset: 32 bytes to encrypt, at least 32 to authenticate."""
    if len(aes_key) != 32 or len(mac_key) < 32:
        raise ValueError("an AES key has 32 bytes, an HMAC key at least 32")


def seal(files: DataFrame, aes_key: bytes, mac_key: bytes, content: str = "content") -> DataFrame:
    """files with content encrypted by AES-256-CBC (IV first) and mac, HMAC-SHA256 over that."""
    check_keys(aes_key, mac_key)
    sealed = files.withColumn(content, F.aes_encrypt(F.col(content), F.lit(aes_key), F.lit("CBC"), F.lit("PKCS")))
    return sealed.withColumn("mac", _mac(mac_key)(F.col(content)))


def unseal(files: DataFrame, aes_key: bytes, mac_key: bytes, content: str = "content") -> DataFrame:
    """The files of seal() again; a content that doesn't fit its mac is null."""
    check_keys(aes_key, mac_key)
    fits = _mac(mac_key)(F.col(content)) == F.col("mac")
    opened = files.withColumn("_fits", fits).withColumn(content, F.when(F.col("_fits"), F.aes_decrypt(F.col(content), F.lit(aes_key), F.lit("CBC"), F.lit("PKCS"))))
    return opened.drop("mac", "_fits")
