"""The whole audit of a dataset, as a call or from the command line:

    python -m kinfolio.audit scan --manifest M.json --output DIR
    python -m kinfolio.audit scan --layout DIR --dataset NAME --revision REV --output DIR
"""

from __future__ import annotations

import argparse
import platform
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import exposure, graph
from .operators.atoms import exploded
from .plans.lineage import cut
from .sources.adapters import DatasetAdapter, LayoutAdapter, ManifestAdapter, all_records, file_sha256
from .sources.sinks import refuse_existing, write_csv, write_json


def tables(records: DataFrame, *, folds: int = 20, seed: int = 20260725) -> dict[str, DataFrame]:
    """All result tables of records: two exposure summaries, component summary and
    histogram, assignments of records to components and folds, and the queue."""
    atoms = cut(exploded(records, "record_id", "view", "split", "source_index"), "audit-atoms")
    slim = records.select("record_id", "record_hash", "view", "split", "source_index")
    labels = graph.components(atoms)
    ids = graph.hashed_ids(labels, labels.select("record_id", F.col("record_id").alias("record_hash_id")))
    labels = cut(labels.join(ids, "label"), "audit-labels")
    fold = graph.component_folds(labels, slim, folds=folds, seed=seed)
    assigned = slim.join(labels, "record_id").join(fold, "component_id")
    graph.assert_whole(assigned)
    return {
        "exposure_by_source_view": exposure.by_source_view(atoms).orderBy("evaluation_view", "source_view", "atom_type"),
        "exposure_same_any_view": exposure.same_and_any_view(atoms).orderBy("evaluation_view", "atom_type"),
        "component_summary": graph.component_summary(labels, slim, atoms),
        "component_sizes": graph.size_histogram(labels, slim),
        "component_assignments": assigned.select("record_id", "record_hash", "view", F.col("split").alias("original_split"), "source_index", "component_id", "component_fold"),
        "cross_view_inspection_queue": exposure.inspection_queue(atoms).orderBy("atom_type", "validation_view", "value_hash", "validation_source_index", "validation_field"),
    }


def scan(spark: SparkSession, adapter: DatasetAdapter, output: str | Path, *, folds: int = 20, seed: int = 20260725) -> Path:
    """Writes the tables of ``adapter``'s records to ``output``, which must not
    exist, and a manifest of inputs and outputs. The queue is written only if it
    has rows."""
    out = refuse_existing(output)
    out.mkdir(parents=True)
    records = cut(all_records(spark, adapter), "audit-records")
    t = tables(records, folds=folds, seed=seed)
    for name in ("exposure_by_source_view", "exposure_same_any_view", "component_assignments", "cross_view_inspection_queue"):
        if name != "cross_view_inspection_queue" or not t[name].isEmpty():
            write_csv(t[name], str(out / name), one_file=name.startswith("exposure"))
    summary = t["component_summary"].first().asDict() | {"component_size_histogram": {r["size"]: r["components"] for r in t["component_sizes"].collect()}}
    write_json(out / "component_summary.json", summary)
    files = [{"view": s.view, "split": s.split, "path": str(s.path.resolve()), "bytes": s.path.stat().st_size, "sha256": file_sha256(s.path)} for s in adapter.sources()]
    outputs = [{"name": str(p.relative_to(out)), "bytes": p.stat().st_size, "sha256": file_sha256(p)} for p in sorted(out.rglob("*")) if p.is_file() and not p.name.startswith((".", "_"))]
    write_json(out / "manifest.json", {"dataset": adapter.dataset, "revision": adapter.revision, "seed": seed, "folds": folds, "python": sys.version, "platform": platform.platform(), "source_files": files, "records": records.count(), "outputs": outputs})
    return out


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kinfolio")
    s = parser.add_subparsers(dest="command", required=True).add_parser("scan")
    s.add_argument("--manifest", type=Path)
    s.add_argument("--layout", type=Path)
    s.add_argument("--dataset-dir", type=Path)
    s.add_argument("--dataset", default="dataset")
    s.add_argument("--revision", default="unknown")
    s.add_argument("--output", type=Path, required=True)
    s.add_argument("--folds", type=int, default=20)
    s.add_argument("--seed", type=int, default=20260725)
    a = parser.parse_args(argv)
    if bool(a.manifest) == bool(a.layout):
        parser.error("one of --manifest and --layout is needed")
    adapter = ManifestAdapter(a.manifest, a.dataset_dir) if a.manifest else LayoutAdapter(a.layout, a.dataset, a.revision)
    scan(SparkSession.builder.getOrCreate(), adapter, a.output, folds=a.folds, seed=a.seed)
    return 0


if __name__ == "__main__":
    sys.exit(main())
