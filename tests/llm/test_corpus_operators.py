"""Importance resampling, suffix dedup and fill-in-the-middle against brute force on small tables."""

import hashlib
import math
import re
import tracemalloc
import zlib
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfolio.llm import infilling, resampling, suffixes

SCHEMA = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# --- importance resampling


def brute_resample(docs, target, buckets, runs, least, percent, seed):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    def of(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[j : j + n]).encode()) % buckets for n in range(1, runs + 1) for j in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for _, x in docs:
        np.add.at(s, of(x), 1)
    for _, x in target:
        np.add.at(t, of(x), 1)
    gain = [math.floor(1000 * math.log((b + 1) * float(s.sum() + buckets) / ((a + 1) * float(t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for i, x in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = of(x)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(open_[: len(open_) * percent // 100])}
    return sorted(str((*r, ranks.get(id(r)))) for r in rows)


def texts_of(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choice(list(letters), rng.integers(1, 4))) for _ in range(rng.integers(0, 40))) for _ in range(n)]


@pytest.mark.parametrize(("buckets", "runs", "least", "percent"), [(10_000, 1, 20, 10), (7, 3, 0, 50), (50, 2, 5, 100), (50, 1, 1000, 50)])
def test_resampling(spark, buckets, runs, least, percent, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [*enumerate(texts_of(rng, 90)), (200, None), (201, ""), (202, " ,.! "), (203, "x" * 5000 + " y"), (None, "a b c"), (204, "Ünï 漢字, É a1 B2\x00c"), (205, "a " * 4000), (206, "A " * 4000)]
    target = list(enumerate(texts_of(rng, 9, "abc")))
    want = brute_resample(docs, target, buckets, runs, least, percent, 2024)
    monkeypatch.setattr(resampling, "SEARCHED", 300)
    d = frame(spark, docs).withColumn("score", F.lit("clash")).withColumn("place", F.lit(1)).repartition(3)
    got = resampling.resample(d, frame(spark, target), buckets=buckets, runs=runs, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_resampling_of_empty_tables(spark):
    d = frame(spark, [(1, "a b"), (2, None)])
    assert resampling.resample(frame(spark, []), d).count() == 0
    assert {r["rank"] for r in resampling.resample(d, frame(spark, []), least_words=1, percent=100).collect()} == {1, None}


def test_ranks_among_ties(spark):
    """Many rows of few scores, narrow and wide ranges."""
    rng = np.random.default_rng(4)
    for low, high, bins in ((0, 3, 4096), (-10**12, 10**12, 16), (-5, 50, 3)):
        rows = [(int(i), int(s)) for i, s in enumerate(rng.integers(low, high, 300))] + [(7, 1), (None, 1), (None, 1)]
        d = spark.createDataFrame(rows, "doc_id long, score long").repartition(4)
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        for k in (0, 1, 57, 303, 1000):
            got = sorted((r["rank"], str(r["doc_id"]), r["score"]) for r in resampling.ranked(d, k, bins=bins).collect())
            assert got == [(n + 1, str(i), s) for n, (i, s) in enumerate(order[:k])]


# --- suffix dedup


def test_suffix_array(monkeypatch):
    """Order and common prefixes of all suffixes, with steps and queues so small that all goes to disk."""
    rng = np.random.default_rng(1)
    for trial in range(150):
        k = int(rng.integers(1, 5))
        texts = [bytes(rng.integers(97, 97 + k, int(rng.integers(0, 30))).tolist()) for _ in range(int(rng.integers(1, 8)))]
        if trial % 3 == 0:
            texts += [texts[0], b"ab" * int(rng.integers(1, 20)), b"a" * 25, bytes([0, 255, 0, 255, 0])]
        monkeypatch.setattr(suffixes, "STEP", int(rng.choice([3, 1 << 15])))
        most = int(rng.choice([3, 7, 50]))
        place, at = {}, 1
        for t in texts:
            place |= {at + i: t[i:] for i in range(len(t))}
            at += len(t) + 1
        got = list(suffixes.suffixes(texts, most, held=int(rng.choice([4, 1 << 20]))))
        order = [int(p) for a, _ in got for p in a]
        common = [int(c) for _, x in got for c in x]
        assert sorted(order) == sorted(place)
        for i in range(1, len(order)):
            a, b = place[order[i - 1]], place[order[i]]
            assert a >= b
            assert common[i] == next((j for j in range(min(len(a), len(b), most)) if a[j] != b[j]), min(len(a), len(b), most))


def brute_bytes(rows, w):
    first, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - w + 1):
                key = b[k : k + w]
                first[key] = min(i, first.get(key, i))
    for i, t in rows:
        b = (t or "").encode()
        gone = set() if i is None else {k + j for k in range(len(b) - w + 1) if first[b[k : k + w]] < i for j in range(w)}
        runs = sum(1 for k in gone if k - 1 not in gone)
        out.append((str(i), t, len(b), len(gone), runs, bytes(x for k, x in enumerate(b) if k not in gone)))
    return sorted(out, key=str)


def test_suffix_dedup(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdéf"), 5))
    base = " ".join(word() for _ in range(60))
    passage = "This passage stands in many documents; it has more than fifty bytes, with an é and a 漢."
    rows = [(3, base), (9, base), (4, None), (5, ""), (6, "short"), (None, base), (None, None), (9, base), (9, passage + " another text of one id " + base[:70]), (10, "x" * 400), (11, "x" * 90), (12, "ab" * 300)]
    rows += [(20 + i, f"{word()} {passage}{word()} " + base[i * 9 : i * 9 + 49 + i]) for i in range(12)]
    rows += [(50 + i, "".join(c if rng.random() > 0.01 else "#" for c in base)) for i in range(6)]
    rows += [(80, "y" * 30 + base[:50] + base[:50]), (81, base[100:150]), (82, base[100:149] + "!"), (83, base[10:60] + base[60:110]), (84, "é" * 60), (85, "a" + "é" * 60)]
    want = brute_bytes(rows, 50)
    share = suffixes.SHARE
    for piece, shard, often, samples in ((1 << 20, 1 << 22, share, 64), (120, 300, share, 64), (200, 1, 0.02, 1)):
        monkeypatch.setattr(suffixes, "PIECE", piece)
        monkeypatch.setattr(suffixes, "SHARD", shard)
        monkeypatch.setattr(suffixes, "SHARE", often)
        monkeypatch.setattr(suffixes, "SAMPLED", samples)
        monkeypatch.setattr(suffixes, "TIMES", 2)
        d = frame(spark, rows).withColumn("tag", F.lit(0)).withColumn("kept", F.lit("clash")).repartition(3)
        got = suffixes.remove_repeated_bytes(d).collect()
        assert sorted(((str(r["doc_id"]), r["text"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in got), key=str) == want
        for r in got:
            assert sum(s["b"] - s["a"] for s in r["removed"]) == r["n_removed"]
    assert suffixes.remove_repeated_bytes(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="can be sorted"):
        suffixes.remove_repeated_bytes(frame(spark, rows), window=8)


def test_copies_move_no_bytes(spark):
    """What stands inside exact copies is settled by anchors and digests; only runs at their edges are sent along."""
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh"), 4000))
    rows = [(i, base) for i in range(1, 5)] + [(9, "other" + base[1000:3000])]
    d = reduce(lambda a, b: a.union(b), (frame(spark, [r]) for r in rows))  # a task each, so none is told from its piece alone
    moved = d.select("doc_id", suffixes._packed("text").alias("packed"), suffixes._tag(F.col("text")).alias("tag"))
    met = d.mapInArrow(partial(suffixes._first_level, window=50), "key long, doc_id long, at long").repartition(1).sortWithinPartitions("key").mapInArrow(suffixes._judged, "key long, doc_id long, at long")
    n = {r["at"]: r["count"] for r in met.groupBy("at").count().collect()}
    assert n[suffixes.SAME] > 20 * n[0] > 0
    runs = {r["doc_id"]: sum(x["n"] for x in r["runs"]) for r in suffixes.repeated_runs(d, moved).collect()}
    assert runs == {2: 3951, 3: 3951, 4: 3951, 9: 1951}


def test_texts_move_once(spark):
    """Both joins read the texts that one exchange wrote."""
    out = suffixes.remove_repeated_bytes(frame(spark, [(i, "some words that are said " * 4 + str(i % 7)) for i in range(40)]).repartition(2)).select("doc_id", "kept")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange [doc_id" in plan and "ArrowEvalPython" in plan


def test_settled_windows_are_runs():
    """Windows of frequent anchors go one by one; those that a document of the piece settles come as runs."""
    rng = np.random.default_rng(4)
    passage = "".join(rng.choice(list("ghijkl"), 300))
    texts = ["".join(rng.choice(list("abcdef"), 80)) + passage for _ in range(20)]
    anchors = np.unique(suffixes._anchors(np.frombuffer(passage.encode(), np.uint8), 50))
    wanted = pa.array([anchors.view(np.int64).tolist()] * 20, pa.list_(pa.int64()))
    batch = pa.record_batch([pa.array(range(20), pa.int64()), pa.array(texts), wanted, pa.array([0] * 20, pa.int32())], names=["doc_id", "text", "anchors", "tag"])
    out = pa.Table.from_batches(suffixes._second_level(iter([batch]), 50, anchors)).to_pylist()
    settled = [r for r in out if r["text"] is None and r["doc_id"]]
    assert len(settled) == 19 and all(r["n"] >= 251 for r in settled)


def test_first_level_rows_are_packed():
    """Rows come out of their blobs as they went in; a blob holds one range of keys, and takes less than its rows."""
    rng = np.random.default_rng(3)
    n = 20_000
    rows = [np.sort(rng.integers(0, 1 << suffixes.BITS, n)), rng.integers(10**6, 10**6 + 300, n), rng.integers(0, 1 << 48, n)]
    rows[1][:2], rows[2][5:50], rows[2][60:99] = (-(1 << 63), (1 << 63) - 1), suffixes.SEVERAL, suffixes.PASSED
    batches = [pa.record_batch([pa.array(c[a : a + 7000]) for c in rows], names=["key", "doc_id", "at"]) for a in range(0, n, 7000)]
    dealt = list(suffixes._dealt(iter(batches), 16))
    got = pa.Table.from_batches(suffixes._undealt(iter(dealt)))
    assert sorted(zip(*(c.to_pylist() for c in got.columns), strict=True)) == sorted(zip(*(c.tolist() for c in rows), strict=True))
    assert sum(b.column(1).nbytes for b in dealt) < 24 * n / 1.8
    for b in dealt:
        for i, to in enumerate(b.column(0).to_pylist()):
            part = next(suffixes._undealt(iter([b.slice(i, 1)])))
            key, at = part.column(0).to_numpy(), part.column(2).to_numpy()
            assert (key[at > suffixes.PASSED] >> (suffixes.BITS - 4) == to).all()
    assert not list(suffixes._dealt(iter([]), 16))


def first_level(n, seed=6):
    """Rows of the first level of some texts, of which half are copies."""
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("abcdefgh"), 2000)) for _ in range(n)] * 2
    batches = [pa.record_batch([pa.array(range(a, a + n // 2), pa.int64()), pa.array(texts[a : a + n // 2])], names=["doc_id", "text"]) for a in range(0, 2 * n, n // 2)]
    return batches, list(suffixes._first_level(iter(batches), 50))


def test_first_level_is_dealt_out_evenly():
    """Anchors that are tried have small hashes; ranges of keys get about as many rows all the same."""
    _, rows = first_level(40)
    lows = suffixes._lows(32, 50)
    n = np.zeros(32, int)
    for b in suffixes._dealt(iter(rows), 32, lows):
        np.add.at(n, b.column(0).to_numpy(), [suffixes.zstandard.frame_content_size(x.as_py()) // 24 for x in b.column(1)])
    assert n.sum() == sum(b.num_rows for b in rows)
    assert n.max() < 1.5 * n.mean()


def test_first_level_is_sorted_a_part_at_a_time(monkeypatch):
    """Ranges of keys, and parts of them, give what one sort of all rows gives; no more than a few parts are unpacked at once."""
    _, rows = first_level(20)
    rows.append(suffixes._rows(np.array([5, 1 << 39, 5]), np.array([1, 2, 3]), np.array([suffixes.PASSED] * 3)))
    table = pa.Table.from_batches(rows).sort_by("key")
    want = sorted(str(r) for b in suffixes._judged(iter(table.to_batches())) for r in b.to_pylist())
    monkeypatch.setattr(suffixes, "PACKED", 500)
    dealt = pa.Table.from_batches(suffixes._dealt(iter(rows), 8, suffixes._lows(8, 50))).sort_by("to")
    for most in (1 << 19, 100, 7):
        monkeypatch.setattr(suffixes, "SORTED", most)
        got = list(suffixes._met(iter(dealt.to_batches(max_chunksize=5))))
        assert sorted(str(r) for b in got for r in b.to_pylist()) == want
        assert max(b.num_rows for b in got) <= (table.num_rows if most > 1000 else 1000)
    assert not list(suffixes._met(iter([])))


def test_anchors_of_all_windows(spark):
    """Equal windows share their anchor, whatever their length, and find each other."""
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh"), 700))
    rows = [(1, base), (2, "xyz" + base[100:500]), (3, base[300:420] + "zyx"), (4, base[:15])]
    for window in (16, 17, 40, 50, 51, 255):
        a, b = (suffixes._anchors(np.frombuffer(t.encode(), np.uint8), window) for t in (base[100:500], rows[1][1]))
        assert (a == b[3:]).all() and len(a) == 401 - window
        assert sorted((str(r["doc_id"]), r["text"], r["n_bytes"], r["n_removed"], len(r["removed"]), bytes(r["kept"])) for r in suffixes.remove_repeated_bytes(frame(spark, rows), window=window).collect()) == brute_bytes(rows, window)


def test_memory_of_a_piece():
    """Hashes of a piece's places are made a segment at a time."""
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefgh"), 1 << 19)) for _ in range(4)]
    batch = pa.record_batch([pa.array(range(4), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    try:
        list(suffixes._first_level(iter([batch]), 50))
        assert tracemalloc.get_traced_memory()[1] < 52 * suffixes.PIECE
    finally:
        tracemalloc.stop()


def test_frequent_anchors(spark, monkeypatch):
    """Anchors that a share of documents hold are told; others aren't."""
    monkeypatch.setattr(suffixes, "SAMPLED", 1)
    rng = np.random.default_rng(5)
    passage = "".join(rng.choice(list("ghijkl"), 70))
    d = frame(spark, [(i, "".join(rng.choice(list("abcdef"), 80)) + passage) for i in range(60)])
    found = suffixes._frequent(d, 50)
    own = np.unique(suffixes._anchors(np.frombuffer(passage.encode(), np.uint8), 50))
    assert np.isin(own, found).all() and len(found) < 3 * len(own) + 4
    assert len(suffixes._frequent(frame(spark, []), 50)) == 0


# --- fill in the middle


def brute_infill(i, t, seed=1):
    t = t or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    u, v = sorted((a % (len(tokens) + 1), b % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:u]), "".join(tokens[u:v]), "".join(tokens[v:])
    if not t or "<P>" in t or "<S>" in t or "<M>" in t or c % 100 >= 90:
        return len(tokens), "plain", None, None, t
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return len(tokens), "spm" if d % 100 < 20 else "psm", len(p), len(m), out


@pytest.mark.parametrize("chunk", [1 << 16, 64, 5])
def test_infilling(spark, chunk, monkeypatch):
    """Texts of one chunk and of many give the same."""
    monkeypatch.setattr(infilling, "CHUNK", chunk)
    monkeypatch.setattr(infilling, "SEARCHED", 100)
    rng = np.random.default_rng(6)
    alphabet = list("abZ é漢😀\n<PS>M1.") + ["word", "longerword"]
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "null id word."), (None, None), (3, "again"), (3, "again"), (202, "<P>x"), (203, "a" * 3000), (204, "<" * 500), (205, "é" * 700), (206, "😀a" * 400)]
    d = frame(spark, rows).withColumn("form", F.lit("clash")).withColumn("h1", F.lit(1)).withColumn("place", F.lit(2)).repartition(3)
    got = infilling.transform(d).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
    found = sorted(((str(r["doc_id"]), r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["h1"]) for r in got.collect()), key=str)
    assert found == sorted(((str(i), t, *brute_infill(i, t), 1) for i, t in rows), key=str)
    assert got.where("back <> coalesce(text, '')").count() == 0
    assert infilling.transform(frame(spark, [])).count() == 0


def test_transitions_compose():
    """The effect of two chunks is that of the first, then of the second, wherever the text is cut."""
    data = np.frombuffer("Ab c1é漢x\n\nyZ".encode(), np.uint8)
    whole = infilling.transition(data)
    for k in range(len(data) + 1):
        a, b = infilling.transition(data[:k]), infilling.transition(data[k:])
        for s in (0, 1):
            assert b[0][a[0][s]] == whole[0][s] and a[1][s] + b[1][a[0][s]] == whole[1][s]
        assert a[2] + b[2] == whole[2]
    assert infilling.transition(data[:0]) == ([0, 1], [0, 0], 0)
    assert whole[1][0] == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", "Ab c1é漢x\n\nyZ"))
