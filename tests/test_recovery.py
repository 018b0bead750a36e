"""Donors, training files, pairs made again, folds and hot keys, on small tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from kinfolio.operators import exposure, graph, recovery, splits
from kinfolio.plans import joins, lineage
from kinfolio.sources.adapters import json_lines


def test_exact_donors(spark):
    targets = spark.createDataFrame([(1, "c", "x"), (2, "c", "y"), (3, "e", "x")], "target_id long, context string, preferred string")
    pool = spark.createDataFrame([(10, "c", "x", "z"), (11, "c", "q", "y"), (12, "e", "x", "x")], "donor_id long, context string, response1 string, response2 string")
    assert {tuple(r) for r in recovery.exact_donors(targets, pool).collect()} == {(1, 10), (2, 11), (3, 12)}
    for more, said in ([(13, "c", "x", "y")], "match exactly: 2"), ([], "match exactly: 0"):
        rows = spark.createDataFrame([*[tuple(r) for r in pool.collect() if more or r[0] != 10], *more], pool.schema)
        with pytest.raises(Exception, match=said):
            recovery.exact_donors(targets, rows).collect()
    with pytest.raises(Exception, match="several targets"):
        recovery.exact_donors(targets.union(spark.createDataFrame([(4, "c", "z")], targets.schema)), pool).collect()


def test_donor_positions(spark):
    donors = spark.createDataFrame([(1, 10), (2, 11)], "target_id long, donor_id long")
    files = spark.createDataFrame([(1, 10, 4), (1, 11, 0), (2, 10, 3), (2, 11, 7), (2, 9, 1)], "seed int, id long, position long")
    assert {tuple(r) for r in recovery.donor_positions(donors, files).collect()} == {(1, 1, 4), (1, 2, 0), (2, 1, 3), (2, 2, 7)}
    for bad in (files.where("not (seed = 2 and id = 11)"), files.union(spark.createDataFrame([(1, 10, 9)], files.schema))):
        with pytest.raises(Exception, match="so many places"):
            recovery.donor_positions(donors, bad).collect()


def test_train_files(spark):
    slotted = spark.createDataFrame([(i, "boundary" if i % 3 == 0 else "base", 100 + i) for i in range(10)], "position long, kind string, id long")
    numbers = lambda a, n: spark.createDataFrame([(a + i, i) for i in range(n)], "id long, n long")
    f = recovery.train_files(slotted, numbers(500, 4), numbers(700, 4))
    rows = sorted(tuple(r) for r in f.collect())
    assert [r[2] for r in rows] == [500, 101, 102, 501, 104, 105, 502, 107, 108, 503] and [r[3] for r in rows if r[1] == "boundary"] == [700, 701, 702, 703]
    naive, safe = (f.select("position", "kind", F.col(c).alias("id")) for c in ("naive_id", "safe_id"))
    assert sorted(r["position"] for r in recovery.row_differences(naive, safe).collect()) == [0, 3, 6, 9]
    assert recovery.row_differences(naive, naive).count() == 0 and recovery.row_differences(naive, naive.where("position < 9")).count() == 1
    again = sorted(tuple(r) for r in recovery.rebuilt(naive, numbers(900, 6)).collect())
    assert [r[2] for r in again] == [500, 900, 901, 501, 902, 903, 502, 904, 905, 503]
    for call in (lambda: recovery.train_files(slotted, numbers(500, 3), numbers(700, 4)), lambda: recovery.rebuilt(naive, numbers(900, 5))):
        with pytest.raises(Exception, match="boundary slot|too few"):
            call().collect()


def test_recovered_pairs(spark):
    schema = "record_hash string, context string, original_response string, edited_response string, good_edited_response string, bad_edited_response string, feedback array<string>, domain string, language string"
    rows = spark.createDataFrame([("a1", "c", "o", "e", "g", "b", ["f"], None, "en"), ("b2", "c", "o2", "e2", "g2", "b2", ["f", "h"], "d", None)], schema)
    for view, make in (("edit", recovery.edit_training_pairs), ("edit_quality", recovery.edit_quality_pairs)):
        pairs = make(rows)
        got = {r["pair_id"]: r for r in recovery.recovered(pairs, rows, view).collect()}
        assert got["a1"]["feedback"] == ["f"] and got["b2"]["original_response"] == "o2" and got["a1"]["construct_fields"] == list(recovery.CONSTRUCT_FIELDS) and got["a1"]["domain"] == "unknown"
        for r in got.values():
            better = r["response2"] if r["overall_preference"] > 0 else r["response1"]
            assert better == {"edit": {"a1": "e", "b2": "e2"}, "edit_quality": {"a1": "g", "b2": "g2"}}[view][r["pair_id"]]
        for bad, said in ((rows.where("record_hash = 'a1'"), "no source"), (rows.withColumn("feedback", F.array(F.lit(" "))), "construct field"), (rows.withColumn("context", F.lit("other")), "what its source makes")):
            with pytest.raises(Exception, match=said):
                recovery.recovered(pairs, bad, view).collect()
    assert {r["pair_id"]: r["feedback"] for r in recovery.enriched_quality_pairs(rows).collect()} == {"a1": ["f"], "b2": ["f", "h"]}


def test_folds_against_the_rule(spark):
    labels, records = [], []
    n = 0
    for c in range(60):
        for k in range(1 + (c * 7) % 5):
            labels.append((n, f"c{c:02}"))
            records.append((n, f"v{(c + k) % 3}"))
            n += 1
    got = {r["component_id"]: r["component_fold"] for r in graph.component_folds(spark.createDataFrame(labels, "record_id long, component_id string"), spark.createDataFrame(records, "record_id long, view string"), folds=4, seed=3).collect()}
    view, members, want = dict(records), {}, {}
    for r, c in labels:
        members.setdefault(c, []).append(view[r])
    goal = {v: max(sum(x == v for x in view.values()) / 4, 1.0) for v in set(view.values())}
    folds = [[] for _ in range(4)]
    for c in sorted(members, key=lambda c: (-len(members[c]), c)):
        def place(f, c=c):
            after = folds[f] + members[c]
            cost = ((len(after) - n / 4) / (n / 4)) ** 2 + sum(((after.count(v) - goal[v]) / goal[v]) ** 2 for v in set(members[c]))
            return round(cost, 9), hashlib.sha256(f"3:{c}:{f}".encode()).hexdigest(), f
        want[c] = min(map(place, range(4)))[2]
        folds[want[c]] += members[c]
    assert got == want
    with pytest.raises(ValueError, match="folds"):
        graph.component_folds(spark.createDataFrame([], "record_id long, component_id string"), spark.createDataFrame([], "record_id long, view string"), folds=1)


def test_exposure_of_hot_keys(spark, monkeypatch):
    rows = []
    for r in range(120):
        split, values = ("train" if r < 90 else "validation"), [f"own{r % 40}", f"rare{r % 7}"]
        values += ["hot"] if r % 3 == 0 else []
        values += ["warm"] if r % 4 == 0 else []
        rows += [(r, f"v{r % 2}", split, "feedback", v, f"f{i}", False) for i, v in enumerate(values)]
    atoms = spark.createDataFrame(rows, "record_id long, view string, split string, atom_type string, value_hash string, field string, linkable boolean")
    want = {}
    for r, view, split, _, v, *_ in rows:
        if split == "validation":
            for q, source, other, _, w, *_ in rows:
                if other == "train" and v == w:
                    want.setdefault((r, source), [set(), set()])[0].add(v)
                    want[r, source][1].add(q)
    for hot in (1000, 12, 0):
        monkeypatch.setattr(exposure, "HOT", hot)
        got = {(r["record_id"], r["source_view"]): (r["matching_atoms"], r["matching_training_records"]) for r in exposure.matches(atoms).collect()}
        assert got == {k: (len(a), len(b)) for k, (a, b) in want.items()}, hot


def test_joins_keep_columns(spark, monkeypatch):
    big = spark.createDataFrame([(1, 2, 3), (None, 5, 6)], "k long, k_ long, salt long")
    small = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    for most in (100, 0):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = joins.join_counted(big, small, ["k"], F.col("k_"))
        assert got.columns == ["k", "k_", "salt", "v"] and {tuple(r) for r in got.collect()} == {(1, 2, 3, "a"), (None, 5, 6, "b")}


def test_cut_tables_can_be_cleared(spark):
    df = lineage.cut(spark.range(5), "test")
    assert df.count() == 5 and lineage.clear(spark) and not lineage.clear(spark)


def test_blank_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n\t\n \t \n{"a": 2}\n　\n')
    assert sorted(r["source_index"] for r in json_lines(spark, path).collect()) == [0, 1]


def test_nearest_pairs(spark):
    """Against going through the targets one by one."""
    rank = lambda ns, i: hashlib.sha256(f"7\0{ns}\0{i}".encode()).hexdigest()
    x = {i: ((i * 37) % 11 / 3.0, (i * 53) % 7 / 2.0) for i in range(60)}
    rows = spark.createDataFrame([(i, "s" if i % 2 else "t", list(v)) for i, v in x.items()], "id long, stratum string, features array<double>")
    quota = spark.createDataFrame([("s", 4), ("t", 3)], "stratum string, quota long")
    got = {(r["stratum"], r["target_id"]): {r["validation_id"], r["test_id"]} for r in splits.nearest_pairs(rows.where("id < 20"), rows.where("id >= 20"), quota, seed=7).collect()}
    want = {}
    for s, n in (("s", 4), ("t", 3)):
        free = [i for i in range(20, 60) if (i % 2 == 1) == (s == "s")]
        for target in sorted((i for i in range(20) if (i % 2 == 1) == (s == "s")), key=lambda i: rank(f"target:{s}", i))[:n]:
            near = sorted(free, key=lambda i: ((x[i][0] - x[target][0]) ** 2 + (x[i][1] - x[target][1]) ** 2, rank("clean_nearest_tie", i)))[:2]
            want[s, target] = set(near)
            free = [i for i in free if i not in near]
    assert got == want
