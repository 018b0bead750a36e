"""Canonical text, canonical JSON and the hashes built on them.

Hashes are SHA-256 of canonical JSON: keys sorted, no blanks, strings brought to
NFKC with runs of white space made one space. Strings of ASCII take a path of
built-in functions; only others, and whole records, go to Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space after NFKC, for Java: its \s knows ASCII only.
_JAVA_SPACE = r"[\s\x0B\x1C-\x1F\x85\u1680\u2028\u2029]+"
#: How JSON writes the controls that aren't white space.
_CONTROLS = {"\b": "\\b"} | {chr(c): f"\\u{c:04x}" for c in (*range(8), *range(14, 28))}


def plain_text(value: str) -> str:
    """NFKC, runs of white space as one space, none at the ends; case stays."""
    return " ".join(unicodedata.normalize("NFKC", value).split())


def plain_value(value: Any) -> Any:
    """``plain_text`` of every string in a value; keys stay as they are."""
    if isinstance(value, str):
        return plain_text(value)
    if isinstance(value, (list, tuple)):
        return [plain_value(v) for v in value]
    if isinstance(value, dict):
        return {str(k): plain_value(v) for k, v in value.items()}
    return value


_dumps = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode


def hash_of(value: Any, *, literal: bool = False) -> str:
    """Hash of a Python value; ``literal`` leaves strings as they are."""
    return hashlib.sha256(_dumps(value if literal else plain_value(value)).encode()).hexdigest()


@F.arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else plain_text(t) for t in texts.to_pylist()], pa.string())


def normalize_text(text: Column) -> Column:
    """``plain_text`` of a column."""
    ascii_only = F.length(text) == F.octet_length(text)
    collapsed = F.trim(F.regexp_replace(text, _JAVA_SPACE, " "))
    return F.when(ascii_only | text.isNull(), collapsed).otherwise(_nfkc(F.when(~ascii_only, text)))


def collapse_space(text: Column) -> Column:
    """``normalize_text`` for texts that are in NFKC already; no Python."""
    return F.trim(F.regexp_replace(text, _JAVA_SPACE, " "))


def quoted(text: Column) -> Column:
    """A normalised string as JSON: quotes, backslashes and controls escaped."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = out
    for c, short in _CONTROLS.items():
        escaped = F.replace(escaped, F.lit(c), F.lit(short))
    out = F.when(F.rlike(out, F.lit(r"[\x00-\x1F]")), escaped).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def hash_text(normalised: Column) -> Column:
    """The hash of a string that is normalised already."""
    return F.sha2(quoted(normalised), 256)


def directed_edit_hash(original: Column, edited: Column) -> Column:
    """Of two normalised strings; the direction matters."""
    return F.sha2(F.concat(F.lit('{"edited":'), quoted(edited), F.lit(',"original":'), quoted(original), F.lit("}")), 256)


def record_id(dataset: Column, record_hash: Column, revision: Column, source_index: Column, split: Column, view: Column) -> Column:
    """The hash of a record's six identity fields."""
    text = lambda name, c: F.concat(F.lit(f'"{name}":'), quoted(c))
    parts = [text("dataset", dataset), text("record_hash", record_hash), text("revision", revision), F.concat(F.lit('"source_index":'), source_index.cast("string")), text("split", split), text("view", view)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def group_id(ids: Column) -> Column:
    """The hash of a group: its members' ids, sorted."""
    return F.sha2(F.concat(F.lit('["'), F.array_join(F.sort_array(ids), '","'), F.lit('"]')), 256)


def stable_rank(seed: int | Column, namespace: str | Column, identifier: Column) -> Column:
    """Hexadecimal SHA-256 of seed, namespace and identifier, NUL between; compared as strings."""
    a, b = (x if isinstance(x, Column) else F.lit(str(x)) for x in (seed, namespace))
    return F.sha2(F.concat_ws("\x00", a.cast("string"), b, identifier.cast("string")), 256)


def fold_tie(seed: int, component: Column, fold: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), component, fold.cast("string")), 256)


def is_odd(rank: Column, digits: int) -> Column:
    """Whether the number in the first ``digits`` hexadecimal digits is odd."""
    return F.substring(rank, digits, 1).isin(*"13579bdf")


def hash_number(rank: Column) -> Column:
    """The first 8 hexadecimal digits as a number."""
    return F.conv(F.substring(rank, 1, 8), 16, 10).cast("long")


@F.arrow_udf(StringType())
def record_hash(raw: pa.Array) -> pa.Array:
    """The hash of whole records given as JSON; key order doesn't count."""
    return pa.array([None if r is None else hash_of(json.loads(r)) for r in raw.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def literal_record_hash(raw: pa.Array) -> pa.Array:
    """As ``record_hash``, with strings as they are."""
    return pa.array([None if r is None else hash_of(json.loads(r), literal=True) for r in raw.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def hash_json(raw: pa.Array) -> pa.Array:
    """The hash of any JSON value."""
    return pa.array([None if r is None else hash_of(json.loads(r)) for r in raw.to_pylist()], pa.string())
