"""Document fingerprints: a Merkle tree over sections, paragraphs and their parts."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Code points of a leaf at most; a longer sentence is cut into such pieces.
LEAF = 64
#: A section ends after a paragraph whose digest is 0 modulo this, so that an edit moves few borders.
SECTION = 4
_LEAVES = re.compile(rf"(?s)[^.!?\n]{{0,{LEAF - 1}}}(?:[.!?]+[ \t]*\n*|\n+|[^.!?\n]|$)")


def _hash(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def fingerprint(text: str) -> str:
    """The tree of ``text``: its root, a colon, then its sections, joined by
    ``|``. A section is its paragraphs, joined by ``/``; a paragraph is the
    short hashes of its leaves, 8 hexadecimal digits each.

    Leaves are sentences, cut after at most LEAF code points; a paragraph ends
    where a line ends. Every node is hashed from the whole hashes of its
    children, so the roots of two texts are equal only if the texts are. The
    empty text has a root and nothing else."""
    sections, section, paragraph, tops, section_hashes = [], [], [], [], []
    shorts: list[str] = []

    def end_paragraph() -> None:
        whole = _hash(b"p" + b"".join(paragraph))
        section.append("".join(shorts))
        section_hashes.append(whole)
        paragraph.clear()
        shorts.clear()
        if whole[0] % SECTION == 0:
            end_section()

    def end_section() -> None:
        tops.append(_hash(b"s" + b"".join(section_hashes)))
        sections.append("/".join(section))
        section.clear()
        section_hashes.clear()

    for leaf in _LEAVES.findall(text):
        if leaf:
            h = _hash(leaf.encode("utf-8", "surrogatepass"))
            paragraph.append(h)
            shorts.append(h[:4].hex())
            if leaf[-1] == "\n":
                end_paragraph()
    if paragraph:
        end_paragraph()
    if section:
        end_section()
    return f"{_hash(b'r' + b''.join(tops)).hex()}:{'|'.join(sections)}"


def _leaves(print_: str) -> list[str]:
    tree = print_.partition(":")[2].replace("|", "").replace("/", "")
    return [tree[i : i + 8] for i in range(0, len(tree), 8)]


def likeness(a: str, b: str) -> float:
    """From two fingerprints alone: 1 if their roots are equal; else the leaves
    that both have, twice, among all leaves, and always below 1."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = _leaves(a), _leaves(b)
    if not x or not y:
        return 0.0
    both = sum((Counter(x) & Counter(y)).values())
    return min(2 * both / (len(x) + len(y)), 1 - 1 / (len(x) + len(y) + 1))


def edits(a: str, b: str) -> list[tuple[int, int]]:
    """The (section, paragraph) places of ``b`` whose branches ``a`` doesn't have,
    found downwards from the root: equal sections aren't looked into."""
    if a[:32] == b[:32]:
        return []
    had_sections = set(a.partition(":")[2].split("|"))
    had = {p for s in had_sections for p in s.split("/")}
    return [(i, j) for i, s in enumerate(b.partition(":")[2].split("|")) if s not in had_sections for j, p in enumerate(s.split("/")) if p not in had]


def fingerprints(documents: DataFrame) -> DataFrame:
    """Adds fingerprint. Null texts count as empty; rows that repeat get the same.
    Any column of that name gives way; an empty table gives an empty result."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "") for t in texts.to_pylist()], pa.string())

    return documents.withColumn("fingerprint", of(F.col("text")))


def with_neighbour(documents: DataFrame, parts: int) -> tuple[DataFrame, str]:
    """doc_id and text dealt out so that each document meets the next one in
    descending doc_id (null ids come last, equal ids by text), after the last
    the first. Parts are ranges of ids between exact members of the table, so
    the first document of each range is known before any text moves: it goes to
    the range above as well. Each text moves once, but for one a range.

    Returns rows sorted within (part, extra), and the order as SQL; extra rows
    are those that only follow. One row is extra and its own neighbour alone."""
    d = documents.select(documents["doc_id"].alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text"))
    cuts = d.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] + [1.0], 10_000).alias("p"), F.max("doc_id").alias("top")).first()
    heads = np.array(sorted({*(cuts["p"] or ())} | ({cuts["top"]} - {None})), np.int64)

    @F.arrow_udf("array<int>")
    def parts_of(ids: pa.Array) -> pa.Array:
        x = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        own = np.searchsorted(heads, x)  # part i holds ids above heads[i - 1], up to heads[i]
        head = (own < len(heads)) & (heads[np.minimum(own, len(heads) - 1)] == x) if len(heads) else np.zeros(len(x), bool)
        above = np.where(own + 1 < len(heads), own + 1, 0)
        flat = np.column_stack((own, above))[np.column_stack((np.ones(len(x), bool), head))]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(1 + head))).astype(np.int32)), pa.array(flat.astype(np.int32)))

    d = d.select("doc_id", "text", F.posexplode(parts_of(F.col("doc_id"))).alias("extra", "part"))
    return d.repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text"), "part, extra, doc_id DESC NULLS LAST, text"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = first = None  # (doc_id, part, extra, text, fingerprint) of the row above, and of its part's first row
    rows: list[tuple] = []

    def done(row: tuple, following: tuple) -> None:
        text, n = row[3], len(row[3])
        edited = text[: n - n // 3] + following[3][: n // 3]
        own, changed = row[4], fingerprint(edited)
        rows.append((row[0], n, hashlib.sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, following[4])))

    def out() -> pa.RecordBatch:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))
        rows.clear()
        return batch

    for batch in batches:
        for doc_id, text, extra, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            row = (doc_id, part, extra, text, fingerprint(text))
            if before and before[1] == part:
                if not before[2]:
                    done(before, row)
            else:
                if before and not before[2]:
                    done(before, first)
                first = row
            before = row
            if len(rows) >= 2000:
                yield out()
    if before and not before[2]:
        done(before, first)
    if rows:
        yield out()


def edited_likeness(documents: DataFrame) -> DataFrame:
    """Each document against an edited text and against the next document.

    The edited text is the document with its last floor(n_chars / 3) code points
    replaced by the first as many (or all) of the next document, in descending
    doc_id, after the last the first. Null texts count as empty. Rows that
    repeat an id follow each other by text; null ids come last. One document
    alone is its own next. An empty table gives an empty result.
    """
    parts = max(2, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2)
    rows, _ = with_neighbour(documents, parts)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "extra", "part").mapInArrow(_edit, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


QUERIES, ORACLES = {"op5_fingerprints": query}, {}
