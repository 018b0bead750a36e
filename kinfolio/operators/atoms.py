"""Typed atoms: the exact pieces that records can share."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import hash_of, plain_value

#: The fields of the built-in views.
RESPONSES = ("response", "response1", "response2", "original_response", "edited_response", "good_edited_response", "bad_edited_response")
FEEDBACK = ("feedback", "feedback1", "feedback2")
EDITED = ("edited_response", "good_edited_response", "bad_edited_response")
ATOM_FIELDS = ("atom_type", "value_hash", "field", "linkable")
ATOM = "struct<atom_type:string,value_hash:string,field:string,linkable:boolean>"


@dataclass(frozen=True)
class Mapping:
    """Which fields of a record make which atoms; ``prompt`` stands in for a missing context if named."""

    context: str | None = "context"
    context_else: str | None = "prompt"
    responses: Sequence[str] = RESPONSES
    feedback: Sequence[str] = FEEDBACK
    principle: str | None = "principle"
    edits: Sequence[tuple[str, str]] = field(default_factory=lambda: tuple(("original_response", e) for e in EDITED))


def _full(value: Any) -> bool:
    return isinstance(value, str) and bool(value)


def atoms_of(row: dict[str, Any], m: Mapping) -> list[tuple[str, str, str, bool]]:
    """(atom_type, value_hash, field, linkable) of a record, distinct and sorted.

    Records, contexts and edits link. Responses, feedback and principles repeat
    for other reasons and are only reported. Strings are normalised once for all atoms that hold them."""
    plain = plain_value(row)

    def found() -> Iterator[tuple[str, Any, str, bool]]:
        yield "record", plain, "__record__", True
        name = m.context if m.context in row or not m.context_else else m.context_else
        if name and row.get(name) not in (None, "", []):
            yield "context", plain[name], name, True
        for name in m.responses:
            if _full(plain.get(name)):
                yield "response", plain[name], name, False
        for name in m.feedback:
            value = plain.get(name)
            strings = [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
            for i, v in enumerate(strings):
                if v:
                    yield "feedback", v, f"{name}[{i}]", False
        if m.principle and _full(plain.get(m.principle)):
            yield "principle", plain[m.principle], m.principle, False
        for original, edited in m.edits:
            if _full(plain.get(original)) and _full(plain.get(edited)):
                yield "edit_link", {"original": plain[original], "edited": plain[edited]}, f"{original}->{edited}", True

    return sorted({(kind, hash_of(value, literal=True), name, linkable) for kind, value, name, linkable in found()})


def with_atoms(records: DataFrame, mapping: Mapping, raw: str = "raw_json") -> DataFrame:
    """Adds atoms, an array, to records that hold their JSON in ``raw``."""

    @F.arrow_udf(f"array<{ATOM}>")
    def extract(rows: pa.Array) -> pa.Array:
        found = [atoms_of(json.loads(r), mapping) for r in rows.to_pylist()]
        columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * 4
        fields = [pa.array(c, pa.bool_() if n == "linkable" else pa.string()) for n, c in zip(ATOM_FIELDS, columns, strict=True)]
        return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), pa.StructArray.from_arrays(fields, ATOM_FIELDS))

    return records.withColumn("atoms", extract(F.col(raw)))


def exploded(records: DataFrame, *keep: str) -> DataFrame:
    """A row an atom, with the columns ``keep`` of its record."""
    return records.select(*keep, F.inline("atoms"))


def occurrences(atoms: DataFrame, atom_type: str, value_hash: str) -> DataFrame:
    """The rows of one key; none if it doesn't occur."""
    return atoms.where((F.col("atom_type") == atom_type) & (F.col("value_hash") == value_hash))
