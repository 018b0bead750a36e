"""Files of several views and splits as one format: ``spark.read.format("multiview")``.

Options: ``path``, a manifest as in ``ManifestAdapter`` (what ``load`` is given), or ``manifest``, its JSON; ``dataset_dir``, which
stands in for the manifest's folder. Paths can name any store that Arrow reads. Each file is a partition, read in batches and never held; lines
are numbered as they are read. Filters on view, split and path choose files before any is opened (``register`` turns this on).
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from .adapters import ManifestAdapter, open_stream, records_of

COLUMNS = "dataset string, revision string, view string, split string, path string, source_index int, raw_json string"
_ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in COLUMNS.split(", ")])
#: Lines and characters of a batch, whichever is reached first.
BATCH_LINES, BATCH_CHARS = 4096, 1 << 24


@dataclass
class FileOfView(InputPartition):
    """One source file."""

    dataset: str
    revision: str
    view: str
    split: str
    path: str


class MultiViewReader(DataSourceReader):
    def __init__(self, files: Sequence[FileOfView]) -> None:
        self.files = list(files)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else ""
            if name in ("view", "split", "path"):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = [x for x in self.files if getattr(x, name) in wanted]
            else:
                yield f

    def partitions(self) -> Sequence[FileOfView]:
        return self.files

    def read(self, partition: FileOfView | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        head = (partition.dataset, partition.revision, partition.view, partition.split, partition.path)

        def batch(lines: list[str], first: int) -> pa.RecordBatch:
            n = len(lines)
            columns = [pa.array([v] * n, pa.string()) for v in head]
            return pa.record_batch([*columns, pa.array(range(first, first + n), pa.int32()), pa.array(lines, pa.string())], schema=_ARROW)

        lines, chars, first = [], 0, 0
        with open_stream(partition.path, "gzip" if partition.path.endswith(".gz") else None) as raw:
            for line in io.TextIOWrapper(raw, encoding="utf-8"):  # ends of lines of any system
                if not line.strip():
                    continue
                lines.append(line.rstrip("\n"))
                chars += len(line)
                if len(lines) == BATCH_LINES or chars >= BATCH_CHARS:
                    yield batch(lines, first)
                    lines, chars, first = [], 0, first + len(lines)
        if lines:
            yield batch(lines, first)


class MultiViewSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "multiview"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> MultiViewReader:
        where, text = self.options.get("path", ""), self.options.get("manifest")
        if text is None:
            with open_stream(where, None) as f:
                text = f.read().decode()
        spec, root = json.loads(text), self.options.get("dataset_dir") or posixpath.dirname(where)
        full = lambda p: p if ":/" in p else posixpath.join(root, p)
        return MultiViewReader([FileOfView(str(spec["dataset"]), str(spec["revision"]), str(s["view"]), str(s["split"]), full(str(s["path"]))) for s in spec["sources"]])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MultiViewSource)


class FormatAdapter(ManifestAdapter):
    """``ManifestAdapter`` with its files read through the format."""

    def __init__(self, manifest: str, dataset_dir: str | None = None) -> None:
        super().__init__(manifest, dataset_dir)
        self._manifest, self._dir = str(manifest), dataset_dir

    def records(self, spark: SparkSession, source) -> DataFrame:
        register(spark)
        read = spark.read.format("multiview")
        d = (read.option("dataset_dir", str(self._dir)) if self._dir else read).load(self._manifest)
        return records_of(d.where(F.col("path") == str(source.path)).select("raw_json", "source_index"), source)
