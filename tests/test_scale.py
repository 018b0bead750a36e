"""What queries read, how they deal rows out, and that tasks stay small."""

import re

from pyspark.sql import functions as F

from kinfolio import registry
from kinfolio.operators import exposure, learners, resample
from kinfolio.plans import tables as t

SF = "/root/testdata/sf0.001"


def test_texts_are_read_once(spark):
    """Exposure and components come from atoms that were made once, not again for each branch of the plan."""
    for name in ("exposure_same_any_view", "wilson", "exposure_rows", "exposure_by_source_view", "focal_exposure", "exposure_tensor", "union_events"):
        assert not [f for f in registry.QUERIES[name](spark, SF).inputFiles() if "documents" in f], name
    # contexts need no other atom
    plan = registry.QUERIES["context_crossings"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "feedback" not in plan


def test_presence_is_that_of_the_tensor(spark):
    a = t.kept_atoms(spark, SF)
    whole, presence = exposure.exposure_rows(a).select(*exposure.CELL, "exposed"), exposure.exposed_cells(a)
    assert presence.count() == whole.count() and not presence.exceptAll(whole).count()
    contexts = a.where("atom_type = 'context'").select("record_id", "view", "split", "value_hash")
    assert contexts.count() and not contexts.exceptAll(t.contexts(spark, SF)).count() and not t.contexts(spark, SF).exceptAll(contexts).count()


def test_terms_are_dealt_out_by_their_number(spark, monkeypatch):
    """Twice the text makes twice the tasks, not larger ones; the values stay."""
    pairs = spark.range(60).selectExpr("id AS pair_id", "concat('some words here ', id) AS response1", "concat('other words there ', id % 7) AS response2")
    counts = learners.term_counts(pairs, learners.word_terms)
    v = learners.vocabulary(counts.groupBy("term").agg({"*": "count", "n": "sum"}).toDF("term", "df", "total"), 120, least_documents=2, most_features=100)
    want = sorted(map(tuple, learners.differences(counts, v).selectExpr("pair_id", "term", "round(value, 9)").collect()))
    monkeypatch.setattr(learners, "TASK_CHARACTERS", 100)
    monkeypatch.setattr(learners, "TASK_TERMS", 20)
    small, large = (learners.term_counts(pairs.where(f"pair_id < {n}"), learners.word_terms) for n in (30, 60))
    assert 8 < small.rdd.getNumPartitions() < large.rdd.getNumPartitions()
    again = learners.differences(large, v)
    assert again.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, again.selectExpr("pair_id", "term", "round(value, 9)").collect())) == want


def test_characters_are_cut_once(spark):
    """Runs of characters are the same as by substrings, and a long text takes no longer for a character than a short one."""
    texts = ["", "ab", "Abc", "a  b\tc", "žluťoučký kůň", "x\U0001f600yz\U0001f601w", "ab" * 150_000]
    d = spark.createDataFrame(list(enumerate(texts)), "pair_id int, text string")
    runs = learners.char_terms(d["text"])
    assert "substring" not in str(runs)
    for r in d.select("pair_id", F.size(runs).alias("n"), F.slice(runs, 1, 40).alias("first")).collect():
        t = re.sub(r"\s+", " ", texts[r["pair_id"]].lower())
        want = [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
        assert r["n"] == len(want) and r["first"] == want[:40]
    # terms are made by pair where they are used, and don't move
    pairs = spark.range(20).selectExpr("id AS pair_id", "concat('some words ', id) AS response1", "concat('other words ', id % 7) AS response2")
    counts = learners.term_counts(pairs, learners.char_terms)
    v = learners.vocabulary(counts.groupBy("term").agg({"*": "count", "n": "sum"}).toDF("term", "df", "total"), 40, least_documents=2, most_features=100).cache()
    dealt, moved = (learners.differences(counts, v, dealt=x) for x in (True, False))
    values = [sorted(map(tuple, x.selectExpr("pair_id", "term", "round(value, 9)").collect())) for x in (dealt, moved)]
    assert values[0] == values[1] and len(values[0])
    by = [x._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") for x in (dealt, moved)]
    assert by == [1, 2]


def test_draws_are_dealt_out_by_their_number(spark, monkeypatch):
    """Twice the items make twice the tasks, not larger ones; an item's rows come as often as it is drawn."""
    slots = spark.createDataFrame([(r, s, 1 + (r + s) % 2) for r in range(4) for s in range(2)], "replicate int, slot int, seed int")
    values = spark.range(40).selectExpr("id AS item", "explode(array(1, 2)) AS seed", "id * 10 AS v")
    monkeypatch.setattr(resample, "TASK_DRAWS", 32)
    tasks = []
    for n in (20, 40):
        items = spark.range(n).selectExpr("id AS item", "id AS i")
        number = F.col("k") * 7 + F.col("replicate") * 3 + F.col("slot")
        out = resample.drawn_rows(values, items, n, "item", slots, number, 8, ("seed",))
        tasks.append(out.rdd.getNumPartitions())
        got = sorted((r["replicate"], r["slot"], r["v"]) for r in out.collect())
        assert got == sorted((r, s, (k * 7 + r * 3 + s) % n * 10) for r in range(4) for s in range(2) for k in range(n))
    assert tasks == [5, 10]
