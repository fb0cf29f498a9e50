"""Column expressions on text: lines, slugs, globs, digests, redaction and masking.

All of them stay inside the JVM. Patterns are Java's; letters and digits are
Unicode's where a function says so.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ends a line, and what a line must not keep at its end.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LINE_TAIL = r"(?U)[\s\x1c-\x1f]+\z"


def lines(text: Column) -> Column:
    """The lines of a text: every Unicode line break ends one, a break at the end adds none, an empty text has none."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_count(text: Column) -> Column:
    """Number of lines(text), 0 for null."""
    return F.coalesce(F.size(lines(text)), F.lit(0)).cast("bigint")


def strip(text: Column) -> Column:
    """Text without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def normalise_text(text: Column) -> Column:
    """Text in canonical form: no byte order mark, line feeds only, no white space at line ends."""
    plain = F.regexp_replace(F.regexp_replace(text, "﻿", ""), "\r\n|[\r\x85  ]", "\n")
    return F.array_join(F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, LINE_TAIL, "")), "\n")


def slug(value: Column) -> Column:
    """Lower case, with everything but letters, digits, `_`, `/` and `-` turned into `-`."""
    return F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{N}_/\-]", "-")


def normalise_path(path: Column) -> Column:
    """A POSIX path without empty and `.` parts; `..` stays."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"(^|/)(\./)+", "$1"), r"(?<=.)/\.?$", "")


def normalise_tags(tags: Column) -> Column:
    """Sorted distinct tags without surrounding blanks or empty ones."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda x: F.trim(x)), lambda x: x != "")))


def _glob_body(glob: str, any_run: str, any_one: str) -> str:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(any_run)
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append(any_one)
        elif close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_anywhere(glob: str) -> str:
    """The pattern of a glob whose `*` crosses slashes and that spans the whole path."""
    return f"(?s)\\A{_glob_body(glob, '.*', '.')}\\z"


def glob_from_right(glob: str) -> str:
    """The pattern of a glob of path components: `*` stays within one, relative globs match the last components."""
    head = r"\A" if glob.startswith("/") else "(?:^|/)"
    return f"(?s){head}{_glob_body(glob, '[^/]*', '[^/]')}\\z"


def glob_from_root(glob: str) -> str:
    """The pattern of a glob below a root: `*` stays within a component, `**` spans any number of them."""
    parts = [p for p in glob.split("/") if p]
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += "(?:[^/]+/)*" + ("[^/]+" if last else "")
        else:
            out += _glob_body(part, "[^/]*", "[^/]") + ("" if last else "/")
    return f"(?s)\\A{out}\\z"


def digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 as lowercase hex; null for null or empty."""
    return F.when(text != "", F.sha2(text.cast("binary"), 256))


def redact(text: Column, tokens: Sequence[str], placeholder: str = "[REDACTED]") -> tuple[Column, dict[str, Column]]:
    """The text with each token replaced, longest first, and the number of replacements of each.

    Counts are taken on the text that earlier tokens have left.
    """
    counts: dict[str, Column] = {}
    for token in sorted(dict.fromkeys(t for t in tokens if t), key=lambda t: (-len(t), t)):
        left = F.replace(text, F.lit(token), F.lit(""))
        counts[token] = F.coalesce(((F.length(text) - F.length(left)) / len(token)).cast("bigint"), F.lit(0).cast("bigint"))
        text = F.replace(text, F.lit(token), F.lit(placeholder))
    return text, counts


def redact_json(texts: Column, tokens: Sequence[str], placeholder: str = "[REDACTED]") -> Column:
    """JSON text whose strings, at any depth, are redacted; keys, numbers and other values stay. Text that isn't JSON is redacted as a whole.

    Strings are told from keys by the colon that follows these, so the text is
    never parsed into a tree of unknown depth.
    """
    string = r'"(?:[^"\\]|\\.)*+"(?:\s*:)?'
    # Strings and what stands between them, in turns.
    strings = F.transform(F.regexp_extract_all(texts, F.lit(string), F.lit(0)), lambda x: F.when(x.endswith(":"), x).otherwise(redact(x, tokens, placeholder)[0]))
    between = F.split(texts, string, -1)
    woven = F.flatten(F.transform(F.arrays_zip(between.alias("a"), strings.alias("b")), lambda p: F.array(p["a"], F.coalesce(p["b"], F.lit("")))))
    return F.when(texts.rlike(r"\A\s*[\[{\"]"), F.array_join(woven, "")).otherwise(redact(texts, tokens, placeholder)[0])


def json_text(value: Column) -> Column:
    """value as JSON text: null, plain integers and booleans, or a string in ASCII with escapes, as hashes of it expect."""
    quoted = F.to_json(F.struct(value.cast("string").alias("v")))
    body = F.substring(quoted, 6, 1 << 30)
    body = F.regexp_replace(body, r"\}$", "")
    # Characters beyond ASCII become UTF-16 escapes; a text without any skips that.
    units = F.transform(F.split(body, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")))
    return F.when(value.isNull(), F.lit("null")).when(body.rlike(r"^[\x00-\x7f]*$"), body).otherwise(F.array_join(units, ""))


def mask_hash(value: Column, salt: str, is_text: bool = True) -> Column:
    """`sha256:` and the digest of the salt followed by the value's JSON text."""
    text = json_text(value) if is_text else F.coalesce(value.cast("string"), F.lit("null"))
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(salt), text).cast("binary"), 256))
