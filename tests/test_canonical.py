"""Hashes against golden values, and columns against plain Python."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinfolio.functions import canonical as c
from kinfolio.operators.atoms import Mapping, atoms_of

GOLDEN = [
    ("A", "798640599597df7a"), ("Ａ", "798640599597df7a"), ("A   B\nC", "805f93adc94f1d67"), ("a\u0085b\u001cc", "96a94bb31ce6dfc6"), ('q"\\\t\u001b', "51e5d7739ed24ef4"),
    ({"b": 2, "a": "x"}, "768ca668c0f84dd3"), ({"a": None}, "d091f9c83c091f79"), ({}, "44136fa355b3678a"), ([{"role": "user", "content": "Q"}], "dae4f1f46f0e9687"),
    ({"edited": "b", "original": "a"}, "9c55f66ed08ccfed"), (1e16, "a144838520595009"), (1.0, "d0ff5974b6aa52cf"), (True, "b5bea41b6c623f7c"),
]


def test_golden_hashes(spark):
    for value, prefix in GOLDEN:
        assert c.hash_of(value).startswith(prefix), value
    strings = [(v, p) for v, p in GOLDEN if isinstance(v, str)]
    df = spark.createDataFrame(strings, "v string, p string").withColumn("h", c.hash_text(c.normalize_text(F.col("v"))))
    assert all(r["h"].startswith(r["p"]) for r in df.collect())
    df = spark.createDataFrame([(json.dumps(v), p) for v, p in GOLDEN], "v string, p string").withColumn("h", c.hash_json(F.col("v")))
    assert all(r["h"].startswith(r["p"]) for r in df.collect())


def test_white_space_width_and_key_order():
    assert c.plain_text("A   B\nC") == "A B C"
    assert c.hash_of("Ａ") == c.hash_of("A")
    assert c.hash_of({"b": 2, "a": "x"}) == c.hash_of({"a": "x", "b": 2})
    assert c.hash_of(" a", literal=True) != c.hash_of("a", literal=True)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=30))
def test_columns_agree_with_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c.normalize_text(F.col("t")).alias("n"), c.hash_text(c.normalize_text(F.col("t"))).alias("h"))
    for r in df.collect():
        assert r["n"] == c.plain_text(r["t"])
        assert r["h"] == c.hash_of(r["t"])


def test_ranks_ids_and_edits(spark):
    one = spark.range(1).select(
        c.stable_rank(7, "ns", F.lit("id")).alias("rank"), c.stable_rank(0, "pair_orientation", F.lit("p1")).alias("p1"), c.stable_rank(0, "pair_orientation", F.lit("p2")).alias("p2"),
        c.record_id(F.lit("d"), F.lit(c.hash_of("x")), F.lit("r"), F.lit(0), F.lit("train"), F.lit("v")).alias("id"),
        c.directed_edit_hash(F.lit("a"), F.lit("b")).alias("ab"), c.directed_edit_hash(F.lit("b"), F.lit("a")).alias("ba"),
    ).first()
    assert one["rank"].startswith("e6b235b48505a9ac")
    assert one["p1"].startswith("8d82f9ef9e8882ed") and one["p2"].startswith("61b8559f794d81a1")
    assert one["id"] == c.hash_of({"dataset": "d", "revision": "r", "view": "v", "split": "train", "source_index": 0, "record_hash": c.hash_of("x")})
    assert one["ab"].startswith("9c55f66ed08ccfed") and one["ab"] != one["ba"]


def test_atoms_connect_fields_and_principles_only_report():
    a = {(k, h): (f, link) for k, h, f, link in atoms_of({"context": [{"role": "user", "content": "Q"}], "response1": "Same  answer"}, Mapping())}
    b = {(k, h): (f, link) for k, h, f, link in atoms_of({"prompt": "P", "edited_response": "Same answer", "original_response": "o", "principle": "be kind", "feedback": ["x", 3, " ", "y"]}, Mapping())}
    assert ("response", c.hash_of("Same answer")) in a.keys() & b.keys()
    assert b["principle", c.hash_of("be kind")] == ("principle", False)
    assert b["context", c.hash_of("P")] == ("prompt", True)
    assert b["feedback", c.hash_of("y")][0] == "feedback[2]"
    assert any(k == "edit_link" and link for (k, _), (_, link) in b.items())
    assert not any(k == "context" for k, *_ in atoms_of({"context": None, "prompt": "P"}, Mapping()))


def test_strings_are_normalised_once(monkeypatch):
    """However many atoms hold a string."""
    seen, plain = [], c.plain_text
    monkeypatch.setattr(c, "plain_text", lambda s: seen.append(s) or plain(s))
    m = Mapping(context="first", context_else=None, responses=("text",), feedback=("lines",), principle=None, edits=(("first", "last"),))
    row = {"first": "a  b", "last": "z", "lines": ["a  b", " ", "z"], "text": "a  b z"}
    got = {(k, f): h for k, h, f, _ in atoms_of(row, m)}
    assert sorted(seen) == sorted(["a  b", "z", "a  b", " ", "z", "a  b z"])
    monkeypatch.undo()
    assert got == {
        ("record", "__record__"): c.hash_of(row), ("context", "first"): c.hash_of("a b"), ("response", "text"): c.hash_of("a b z"),
        ("feedback", "lines[0]"): c.hash_of("a b"), ("feedback", "lines[2]"): c.hash_of("z"), ("edit_link", "first->last"): c.hash_of({"original": "a b", "edited": "z"}),
    }
