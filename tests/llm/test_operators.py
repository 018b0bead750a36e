"""Each operator against brute force on small tables with nulls, empty and long
texts, ties, repeated rows and columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfolio.llm import common, jaccard, licenses, lines, merkle, mixing, neighbours, packing, pii, substrings, toxicity
from kinfolio.llm.common import least_of, rolled, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def mess(spark):
    """Copies, near copies, shared passages, short, null, empty, blank and long texts."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefg"), 4))
    base = [word() for _ in range(300)]
    passage = " ".join(base[:60])
    rows = [(3, " ".join(base)), (9, " ".join(base)), (4, None), (5, ""), (6, " \n\t "), (7, "Two words"), (8, "two words"), (None, " ".join(base)), (None, None)]
    rows += [(20 + i, " ".join(w if rng.random() > 0.004 * i else word() for w in base)) for i in range(8)]
    rows += [(40 + i, "\n".join([" ".join(word() for _ in range(30)), passage, " ".join(word() for _ in range(9))])) for i in range(5)]
    rows += [(60, "x " * 5000), (61, "\n".join(["Line one", "Line two", "", "Line three"])), (62, "\n".join(["Line zero", "Line one ", "Line two", "end"])), (7, "Two words")]
    return rows


def test_kernels():
    x = np.arange(80, dtype=np.uint64) ** 3
    for k in (1, 2, 3, 7, 13, 32):
        y = np.concatenate((x[5 : 5 + k], x[20 : 20 + k], x[5 : 5 + k]))
        r = rolled(y, k)
        assert len(r) == 2 * k + 1 and r[0] == r[2 * k] and (k == 0 or r[0] != r[k])
        assert (least_of(x[::-1].copy(), k) == [min(x[::-1][i : i + k]) for i in range(80 - k + 1)]).all()


def test_word_hashes(mess, monkeypatch):
    texts = [t for _, t in mess] + ["naïve\u00a0x y", "a" * 500 + " b", "A b"]
    h, offsets = word_hashes(pa.array(texts, pa.string()))
    found = [WORD.findall(t or "") for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in found]
    of = {}
    assert all(of.setdefault(w, x) == x for w, x in zip((w for ws in found for w in ws), h.tolist(), strict=True)) and len(set(of.values())) == len(of)
    for n in (64, 7):  # segments that end in texts and in words
        monkeypatch.setattr(common, "SEGMENT", n)
        assert (word_hashes(pa.array(texts, pa.large_string()).slice(2))[0] == h[offsets[2] :]).all()
    assert word_hashes(pa.array(["x A", "X a"]), fold=True)[0].reshape(2, 2)[0].tolist() == word_hashes(pa.array(["X a"]), fold=True)[0].tolist()
    assert len(word_hashes(pa.array([], pa.string()))[0]) == 0


def test_words_of_doubled_complements(spark):
    """Words by which every polynomial modulo 2^64 fails have hashes of their own."""
    x, y = "a", "b"
    while len(x) < 2048:
        x, y = x + y, y + x
    h = word_hashes(pa.array([x, y, x + y, y + x]))[0].tolist()
    assert len(set(h)) == 4
    rest = " ".join(f"w{i}" for i in range(12))
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(documents(spark, [(1, f"{rest} {x}"), (2, f"{rest} {y}"), (3, f"{rest} {x}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    few = " ".join(f"v{i}" for i in range(8))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar(documents(spark, [(1, f"{few} {x} {few[::-1]}"), (2, f"{few} {y} {few[::-1]}"), (3, f"{few} {x} {few[::-1]}")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_mixing(spark, mess):
    rows = [(i, t, s) for (i, t), s in zip(mess, [*"aab", None, *"abcd"] * 10, strict=False)]
    d = documents(spark, rows).withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(d).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], []).append(r)
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 2 * r["size"]
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1] * 3, strict=False))
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:  # rounds: clamp, share out again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = 2.0 * sizes[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for s, x in by.items():
        assert x[0]["target"] == pytest.approx(target[s]) and x[0]["source_size"] == sizes[s]
    assert sum(r["taken"] for r in got) == pytest.approx(sum(target.values()), rel=0.02)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(d).collect()))
    mixed = mixing.mixed_documents(documents(spark, rows))
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_sources(documents(spark, [])).count() == 0


def test_mixing_repeated_ids(spark):
    fifteen = " ".join(["w"] * 10)
    for rows in (
        [(None, fifteen, "s")] * 100, [(7, fifteen, "s")] * 60 + [(i, fifteen, "s") for i in range(40)], [(None, " ".join(["v"] * (i % 9 + 1)), "s") for i in range(90)], [(None, "a", "s")] * 100,
        [(1, fifteen, "s"), (1, fifteen, "t"), (1, None, "t"), (None, "b c", None)],
    ):
        d = documents(spark, rows).withColumn("salt", F.lit(1)).repartition(3)
        got = mixing.mix_sources(d).collect()
        assert len(got) == len(rows)
        for source in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == source]
            assert sum(r["taken"] for r in own) == int(own[0]["target"])
        assert all(r["taken"] <= 2 * r["size"] for r in got)


def brute_lines(rows, w=2):
    at, out = [], {}
    for i, t in rows:
        x = [s for s in (y.strip(" \t\r\x0b\x0c") for y in (t or "").split("\n")) if s]
        at += [(i, k, tuple(x[k : k + w])) for k in range(len(x) - w + 1)]
        out[i] = [x, set()]
    seen = set()
    for i, k, run in sorted(at):
        if run in seen:
            out[i][1].update(range(k, k + w))
        seen.add(run)
    return {i: (len(x), len(g), [s for k, s in enumerate(x) if k not in g]) for i, (x, g) in out.items()}


def test_line_dedup(spark, mess):
    rows = [r for r in dict(mess).items() if r[0] is not None] + [(70, "a\nb\na\nb\na"), (71, "q\n\nLine one\nLine two\nw")]
    d = documents(spark, [*rows, (70, "a\nb\na\nb\na"), (None, "a\nb")]).withColumn("runs", F.lit(1))
    got = {r["doc_id"]: r for r in lines.dedup_lines(d).collect()}
    want = brute_lines([(-1, "a\nb"), *rows])
    for i, r in got.items():
        n, gone, kept = want[-1 if i is None else i]
        assert (r["n_lines"], r["n_removed"]) == (n, gone), i
        assert [s for s in (y.strip() for y in (r["kept_text"] or "").split("\n")) if s] == kept
    assert got[4]["kept_text"] is None and got[62]["text"] == dict(rows)[62]
    kept = {r["doc_id"] for r in lines.stage(documents(spark, rows)).collect()}
    assert {4, 5, 6} <= kept
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def test_line_runs(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice(list("abcde" if i % 3 else "abcdefghijklmnopqrstuvwxyz"), rng.integers(0, 14)))) for i in range(120)]
    d = documents(spark, rows).withColumn("least", F.lit(1)).repartition(3)
    for w in (1, 2, 3, 4):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], [s for s in r["kept_text"].split("\n") if s]) for r in lines.dedup_lines(d, window=w).collect()}
        assert got == brute_lines(rows, w), w
        by_id = {i: t.split("\n") for i, t in rows}
        for r in lines.repeated_runs(d, window=w).collect():
            a, b = (by_id[r[i]][r[s] : r[s] + r["length"]] for i, s in (("doc_id", "start"), ("first_doc_id", "first_start")))
            assert a == b and len(a) == r["length"] >= w and (r["first_doc_id"], r["first_start"]) < (r["doc_id"], r["start"])


def test_line_stage_drops_single_lines(spark, mess):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [r for r in dict(mess).items() if r[0] is not None] + [(70, f"a\n{long}\nb"), (71, f"c\n\n{long} \nd"), (72, long), (73, "a\nb"), (74, "e\ne"), (75, "one line alone")]
    got = {r["doc_id"]: r["text"] for r in lines.stage(documents(spark, rows)).collect()}
    want = {i: x for i, x in brute_lines(rows, 1).items() if x[1] == 0 or x[1] < x[0]}
    assert got.keys() == want.keys() and not {72, 73} & got.keys()
    assert got[71] == "c\n\nd" and got[74] == "e" and got[75] == "one line alone"
    for i, t in got.items():
        assert [s for s in (y.strip() for y in (t or "").split("\n")) if s] == want[i][2]


def test_substrings(spark, mess, monkeypatch):
    rows = [r for r in mess if r[0] is not None]
    first, out = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    for chunk in (1 << 20, 400):  # one chunk, and many
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        got = substrings.remove_repeats(documents(spark, mess).withColumn("words", F.lit(0)).repartition(3)).collect()
        assert len(got) == len(mess)
        for r in got:
            if r["doc_id"] is not None:
                assert (r["n_words"], r["n_removed"], r["kept_text"]) == out[r["doc_id"]], r["doc_id"]
            else:
                assert r["n_removed"] == 0
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_substrings_of_repeated_ids(spark):
    p, q = " ".join(f"p{i}" for i in range(13)), " ".join(f"q{i}" for i in range(13))
    rows = [(1, p), (5, f"{p} tail"), (5, f"{q} other"), (5, f"{q} again")]
    got = sorted((r["doc_id"], r["text"], r["kept_text"]) for r in substrings.remove_repeats(documents(spark, rows).withColumn("kept", F.lit(0))).collect())
    assert got == sorted([(1, p, p), (5, f"{p} tail", "tail"), (5, f"{q} other", f"{q} other"), (5, f"{q} again", f"{q} again")])


def brute_components(rows, k, percent):
    sets, ids = {}, [i for i, _ in rows]
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_jaccard_join(spark, mess, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [r for r in mess if r[0] is not None]
    base = [f"w{i}" for i in range(60)]
    group = [(100 + i, " ".join(w if rng.random() > 0.02 else f"y{rng.integers(1000)}" for w in base)) for i in range(60)]
    rows += group
    want = brute_components(rows, 4, 85)
    for small, hot, pivots, block, chunk in ((8, 10, 4, 1024, 1 << 18), (2, 10, 1, 8, 500), (3, 0, 1, 8, 500)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "HOT", hot)
        monkeypatch.setattr(jaccard, "PARTNERS", 3 if small == 2 else 128)
        monkeypatch.setattr(jaccard, "PIVOTS", pivots)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "CHUNK", chunk)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar(documents(spark, rows).repartition(3)).collect()}
        assert got == want
    kept = {r["doc_id"] for r in jaccard.stage(documents(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in brute_components(rows, 5, 80).items() if i == c}
    assert jaccard.similar(documents(spark, [])).count() == 0


def test_jaccard_stage_repeated_ids(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, t), (1, t), (2, t), (None, t), (None, u), (None, u), (3, None), (3, None), (None, ""), (5, u + " x"), (5, "alone here"), (2, "another text")]
    d = documents(spark, rows).withColumn("row", F.lit(7)).repartition(3)
    got = jaccard.stage(d)
    assert got.columns == d.columns
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
    assert left == sorted(map(lambda r: (str(r[0]), str(r[1])), [(1, t), (3, None), (3, None), (None, ""), (5, u + " x"), (5, "alone here"), (2, "another text")]))
    only_null = jaccard.stage(documents(spark, [(None, t), (None, t)]))
    assert only_null.count() == 1 and jaccard.stage(documents(spark, [])).count() == 0


def test_jaccard_buckets():
    rng = np.random.default_rng(9)
    token, name = np.sort(rng.integers(0, 60, 700)) * 7, rng.integers(0, 40, 700)
    order = np.lexsort((name, token))
    token, name = token[order], name[order]
    size = 20 + name % 3
    of = {}
    for t, n in zip(token.tolist(), name.tolist(), strict=True):
        of.setdefault(t, set()).add(n)
    for step in (1, 2, 5, 64, 700):
        batches = [pa.record_batch([pa.array(token[i : i + step]), pa.array(name[i : i + step]), pa.array(size[i : i + step], pa.int32()), pa.array(np.zeros(len(token[i : i + step])), pa.int32()), pa.array(token[i : i + step] == 14)], names=["token", "name", "size", "pos", "hot"]) for i in range(0, 700, step)]
        pairs, rows = set(), []
        for b in jaccard._buckets(iter(batches), 85):
            for r in b.to_pylist():
                if r["b"] is None:
                    rows.append((r["token"], r["a"]))
                else:
                    pairs.add((r["a"], r["b"]))
        large = {t for t, ns in of.items() if len(ns) > jaccard.SMALL or t == 14}
        assert sorted(rows) == sorted((t, n) for t in large for n in of[t])
        assert pairs == {(a, b) for t, ns in of.items() if t not in large for a in ns for b in ns if a < b}


def test_parity_bitmaps():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 40, 64, 65, 500, 900)]
    sets.append(np.concatenate((sets[-1][:-30], sets[1][:12])))
    token, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    bits = jaccard._parity(token, row, np.array([len(x) for x in sets])).to_pylist()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = len(np.setxor1d(x, y))
            assert jaccard._apart(bits[i], bits[j]) <= apart and (i != j or apart == 0)
    assert jaccard._apart(bits[5], bits[6]) > 20 and jaccard._apart(bits[4], bits[5]) > 100


def test_fingerprints(spark, mess):
    d = documents(spark, mess).withColumn("part", F.lit("clash"))
    got = merkle.edited_likeness(d).collect()
    order = sorted(((i, t or "") for i, t in mess), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t)
        want.setdefault(i, set()).add((n, hashlib.sha256((t[: n - n // 3] + nxt[: n // 3]).encode()).hexdigest(), merkle.fingerprint(t)))
    assert len(got) == len(mess)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) in want[r["doc_id"]]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert r["n_chars"] < 200 or r["doc_id"] is None or r["near_edited"] > 0.3
    a, b = "One. Two.\nThree. Four.\nFive.", "One. Two.\nThree. Changed.\nFive."
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.likeness(x, x) == 1 and 0 < merkle.likeness(x, y) < 1 and len(merkle.edits(x, y)) == 1 and merkle.edits(x, x) == []
    assert merkle.fingerprint("") != merkle.fingerprint(" ") and merkle.edited_likeness(documents(spark, [])).count() == 0
    assert merkle.fingerprints(documents(spark, [(1, None)])).first()["fingerprint"] == merkle.fingerprint("")


def test_packing(spark, mess):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    rows = [*mess, (80, "a   b\n\n  c <|endoftext|> d " * 30), (81, "naïve – 漢字 😀 " * 400)]
    got = packing.pack(documents(spark, rows).repartition(2)).collect()
    pieces = {}
    for r in got:
        pieces.setdefault(r["sequence_id"], []).append(r)
    length = {}
    for s, p in pieces.items():
        p.sort(key=lambda r: r["offset"])
        at = 0
        for r in p:
            assert r["offset"] == at and len(r["ids"]) == 4 * r["length"] and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        length[s] = at
    ids = sorted((str(i), tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    whole, keep = [], {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        keep.setdefault((r["doc_id"], r["sequence_id"] >> 33), []).append(r)
    for (i, _), p in keep.items():
        run = b""
        for r in p:
            if r["start"] == 0 and run:
                whole.append((str(i), run))
                run = b""
            assert r["start"] == len(run) // 4
            run += r["ids"]
        whole.append((str(i), run))
    assert sorted((i, tuple(np.frombuffer(b, np.uint32).tolist())) for i, b in whole) == ids
    total = sum(length.values())
    assert sum(1024 - n for n in length.values() if n not in (128, 256, 512)) < 0.1 * total + 2 * 1024
    assert packing.pack(documents(spark, [])).count() == 0
    p = packing.Packer(8)  # against all ways to cut
    ends = [3, 5, 6, 9, 11, 14, 16, 20]
    pen = [4, 0, 4, 0, 4, 4, 0, 0]
    p.add(ends, pen)
    best = {0: 0}
    for e, c in zip(ends, pen, strict=True):
        best[e] = min(best[s] + 8 - (e - s) + c for s in best if s < e and e - s <= 8)
    assert p.cost[-1] == best[20]
    cuts = p.final(end=True)
    assert cuts[-1] == 20 and all(b - a <= 8 for a, b in zip([0, *cuts], cuts, strict=False))


def test_packing_encodes_words_once(monkeypatch):
    """What is encoded grows with the different words of a batch, not with its text."""
    load, given = packing.Encoder.__init__, []

    def counted(self, path):
        load(self, path)
        plain = self.plain
        self.plain = lambda t: given.append(len(t)) or plain(t)

    monkeypatch.setattr(packing.Encoder, "__init__", counted)
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda c: c), "partitionId": staticmethod(lambda: 0)}))
    texts = [f"Text {i % 7} of  some\n\n" + "  words, over and over.\n" * 40 for i in range(200)]
    batch = pa.record_batch({"doc_id": pa.array(range(200), pa.int64()), "text": pa.array(texts)})
    out = list(packing._pack(iter([batch]), "byte_bpe_50k.json", 1024, 0, pa.int64(), 500_000))
    assert sum(sum(b.column("length").to_pylist()) for b in out) > 200 * 40 and sum(given) < 0.1 * sum(map(len, texts))


def test_packing_of_odd_words():
    """Words encoded together have the ids that each text has alone, wherever white space of any kind stands."""
    encode = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(6)
    parts = ["a", "the", " ", " ", "  ", "\n", "\r\n", "\t", ".", "'s", "12", "é", "漢字", "\xa0", "\u2003", "\u3000", "\x1c", "\x85", "\0", "\u200b", "<|endoftext|>", "😀", "½", " cd. "]
    for _ in range(300):
        some = rnd.sample(parts, rnd.randint(2, len(parts)))
        texts = ["".join(rnd.choices(some, k=rnd.randint(0, 30))) for _ in range(rnd.randint(1, 12))]
        want = [[*encode(t), 70_000] for t in texts]
        ids, n = encode.many(texts, 70_000)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert packing._cuts(ids, n, encode.sentence_end)[0][-1] == len(ids)


def test_packing_of_blanks(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_500_000 + "b", "x\n" * 40_000, "\n" * 30_000 + "c. d"]
    encode = packing.Encoder(packing.tokenizer_path("byte_bpe_50k.json"))
    assert [encode(t) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    d = spark.createDataFrame([(1, texts[0]), (None, "x. y")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    assert {r["doc_id"] for r in packing.pack(d).collect()} == {1, None}


PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(t):
    ok = [lambda x: True, lambda x: all(int(p) <= 255 for p in x.split(".")), lambda x: 13 <= len(re.sub("[^0-9]", "", x)) <= 19 and pii.luhn(re.sub("[^0-9]", "", x)), lambda x: 9 <= len(re.findall("[0-9]", x)) <= 15]
    return [(k, m.start(), m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, t) if ok[k](m.group())]


def test_personal_data(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab@.+-1 254(0)"), 60)) for _ in range(400)] + ["a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "+49 (172) 345-6789 x", "1" * 5000, "a" * 20000, "@@..@"]
    for t in texts:
        assert [s[:3] for s in pii.spans(t) if s[3]] == plain(t), t
    for t, kind, part in [
        ("mail john at mail5 dot example dot com now", 0, "john at mail5 dot example dot com"), ("see bob(at)site[dot]org.", 0, "bob(at)site[dot]org"), ("jоhn@exаmple.com", 0, "jоhn@exаmple.com"),
        ("call plus four nine one seven two three four five six seven eight", 3, "plus four nine one seven two three four five six seven eight"),
        ("at one two seven dot zero dot zero dot one", 1, "one two seven dot zero dot zero dot one"), ("ｕｓｅｒ＠ｅｘ．ｃｏｍ", 0, "ｕｓｅｒ＠ｅｘ．ｃｏｍ"), ("x １９２.１６８.０.１ y", 1, "１９２.１６８.０.１"),
    ]:
        assert [(k, t[s:e]) for k, s, e, p in pii.spans(t) if not p] == [(kind, part)], t
    for t in ("look at this. at that dot", "the one and the two", "un deux", "Éa à la (attention) de"):
        assert pii.spans(t) == []
    d = pii.find(documents(spark, [(1, None), (2, ""), (None, "a@b.cd"), (3, "a@b.cd"), (3, "a@b.cd")]).withColumn("pii", F.lit(1)))
    got = d.select("doc_id", pii.digest(F.col("pii")).alias("s")).collect()
    assert sorted((str(r["doc_id"]), r["s"]) for r in got) == [("1", ""), ("2", ""), ("3", "email:0:6"), ("3", "email:0:6"), ("None", "email:0:6")]
    assert pii.redact(documents(spark, [(1, "to a@b.cd, bye")])).first()["text"] == "to [email], bye"


def test_addresses_in_words():
    for t in (
        "max at beispiel punkt de", "ana arroba correo punto es", "jean chez exemple point fr", "bob at sub.example dot com", "max punkt muster at beispiel punkt de",
        "a punkt b punkt c at mail punkt firma punkt de", "jean point dupont [chez] exemple point fr", "ana (arroba) correo punto com punto es", "ⅰnfo@example.com", "MAX AT BEISPIEL PUNKT DE",
    ):
        for text in (t, f"Mail: {t}, danke", f"un point, {t}; punto"):
            found = [(k, text[s:e]) for k, s, e, p in pii.spans(text) if not p]
            assert pii.disguised(text) and found == [(0, t)], (text, found)
    for t, kind, part in [("call +٤٩ ١٧٢ ٣٤٥٦٧٨٩ now", 3, "+٤٩ ١٧٢ ٣٤٥٦٧٨٩"), ("host १९२.१६८.०.१", 1, "१९२.१६८.०.१")]:
        assert [(k, t[s:e]) for k, s, e, p in pii.spans(t) if not p] == [(kind, part)], t
    for t in ("à ce point de vue, chez nous", "at this point we meet at noon", "un punto arroba", "meet at example.com at one point", "der Punkt de", "a point b point c point " * 2000, "x at y at z " * 2000):
        assert pii.spans(t) == [] and pii.normalised(t)[0] == t
    t = "jean chez exemple point fr, et à ce point de vue ce point important"
    assert pii.normalised(t)[0] == "jean@exemple.fr, et à ce point de vue ce point important"


def test_disguise_on_one_side(spark):
    texts = ["аlice@example.com", "jоhn.doe@example.com", "user@mail.exаmple.com", "bob dot smith@example.com"]
    for t in texts:
        found = pii.spans(f"to {t}, bye")
        assert (0, 3, 3 + len(t), False) in found and [s[:3] for s in found if s[3]] == plain(f"to {t}, bye")
    d = documents(spark, [(i, f"to {t}, bye") for i, t in enumerate(texts)])
    assert {r["text"] for r in pii.redact(d).collect()} == {"to [email], bye"}


def test_spelled_digits_among_digits():
    for t, kind in [
        ("plus one 415 five 5 5 two 6 7 one", 3), ("+1 415 five five five 2671", 3), ("192.168.one.one", 1), ("192 dot 168 dot zero dot one", 1),
        ("4111 1111 1111 one one one one", 2), ("plus one four one five 5552671", 3),
    ]:
        for text in (f"call {t} now", f"({t})", f"x:{t}."):
            at = text.index(t)
            assert pii.disguised(text) and (kind, at, at + len(t), False) in pii.spans(text), text
    assert pii.spans("one of two, 12 or five 5 at 10.0.0 dot") == []
    assert pii.spans("host 10.0.0.4 five times") == [(1, 5, 13, True)]


def test_disguised_is_never_wrongly_false():
    rng = np.random.default_rng(11)
    parts = ["a", "user", " ", "\t", "\n", "@", ".", "(", ")", "[", "]", "at", "AT", "dot", "DOT", "one", "Two", "plus", "5", "22", "-", ",", "о", "ｅ", "K", "ſ", "punkt", "arroba", "example", "com", "\u00ad"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts, rng.integers(2, 12)))
        assert pii.disguised(t) or pii.normalised(t)[0] == t, t
    for t in ("user\t@\texample.com", "call one 22 33 44 two 55 66 77 three 88 99 11 four"):
        assert pii.disguised(t)


def test_single_spelled_digits_pass_by():
    for t in ("un homme et une femme, deux enfants. " * 50, "uno de los dos", "plus un mot, one by one. Two, three: go", "3 sur quatre"):
        assert not pii.disguised(t) and pii.normalised(t)[0] == t and pii.spans(t) == []
    for t in ("fünf@example.com", "plus one@example.com", "bob@one point two", "x one.two three@ex.com", "fİve one two three four five six seven eight, 4111 1"):
        assert pii.disguised(t) and pii.normalised(t)[0] != t, t
    t = "Un jour, +33 1 23 45 67 huit neuf; un autre"
    assert [(k, t[s:e]) for k, s, e, p in pii.spans(t) if not p] == [(3, "+33 1 23 45 67 huit neuf")]


def test_addresses_with_zeros():
    for t in ("0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 300 + "4", "000.0.0.0", "1.2.3.0256", "0001.0255.3.00000"):
        assert [s[:3] for s in pii.spans(t) if s[3] and s[0] == 1] == [x for x in plain_ip(t)], t


def plain_ip(t):
    return [(1, m.start(), m.end()) for m in re.finditer(PLAIN[1], t) if all(int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def test_toxicity_learns_from_bounded_texts(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    rows = [(held[0], f"vile text {k}") for k in range(3000)] + [(i, "vile one" if n % 2 else "kind one") for n, i in enumerate(held[1:])] + [(held[1], "k" * 9000)]
    lab = spark.createDataFrame([(i, int(n % 2 or i == held[0])) for n, i in enumerate(held)], "doc_id long, toxic int")
    sizes = []
    learn = toxicity.learn
    try:
        toxicity.learn = lambda f, s, d, y, **k: sizes.append((len(d), len(f))) or learn(f, s, d, y, **k)
        toxicity.train(documents(spark, rows), lab, learn_chars=64_000)
    finally:
        toxicity.learn = learn
    assert sizes[0][0] <= len(held) and sizes[0][1] < 64_000


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, labels = [], []
    for i in range(600):
        s = [" ".join(word() for _ in range(8)) for _ in range(6)]
        bad = i % 4 == 0
        if bad:
            s[2] += " vilest"
        rows.append((i, ". ".join(s)))
        labels.append((i, None, int(bad)))
    rows += [(None, "vilest"), (1000, None), (1001, ""), (1002, "x. " * 3000)]
    d = documents(spark, rows).withColumn("toxicity", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, None, 1), (3, None, None), (0, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.train(d, lab)).collect()
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [(r["toxicity"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held]
    assert len(got) == len(rows) and np.mean(right) > 0.97
    assert all(r["offending"] == [2] for r in held if r["toxicity"] >= 0.9)
    assert all(0 <= r["toxicity"] <= 1 for r in got)
    only = toxicity.train(d, lab.where("toxic = 0"))
    assert {round(r["toxicity"], 3) for r in toxicity.score(d, only).collect()} == {0.0}
    assert {r["doc_id"] for r in toxicity.stage(documents(spark, rows), lab).collect()} >= {1000, 1001, 1002, 1, 2, 3}
    assert toxicity.score(documents(spark, []), only).count() == 0


def test_toxicity_by_loops(spark, monkeypatch):
    """Scores, offending sentences and some rounds of learning, by loops over dictionaries."""
    monkeypatch.setattr(toxicity, "CHUNK", 16)  # documents are scored a few at a time
    rng = np.random.default_rng(8)
    vocabulary = ["vile", "vilest", "kind", "Kindly", "über", "a", "badly", "bad", "naïvely", "x"]
    texts = [". ".join(" ".join(rng.choice(vocabulary, rng.integers(0, 5))) for _ in range(rng.integers(1, 5))) + str(rng.choice(["", "!", "?\n"])) for _ in range(40)] + ["", "...", "vile " * 500]
    lists = [[set(s) for s in r["w"]] for r in documents(spark, list(enumerate(texts))).orderBy("doc_id").select(toxicity.word_ids(F.col("text")).alias("w")).collect()]
    hashed = lambda seed, w: spark.range(1).select(F.hash(F.lit(seed), F.lit(w))).first()[0]
    known = {(n, w): hashed(n, w) for n, w in {(0, v.lower()) for v in [*vocabulary, ""]} | {(n, v.lower()[:n]) for v in vocabulary for n in toxicity.STARTS if len(v) > n}}
    for t, sets in zip(texts, lists, strict=True):
        said = [re.split(r"[\W\d_]+", s) for s in re.split(r"[.!?\n]+", t.lower())]
        assert sets == [{known[0, w] for w in s} | {known[n, w[:n]] for w in s for n in toxicity.STARTS if len(w) > n} for s in said], t
    toxic = np.array([any(known[0, "vile"] in s or known[0, "bad"] in s for s in sets) != (i % 9 == 0) for i, sets in enumerate(lists)])

    counts = Counter(f for sets in lists for f in set().union(*sets))
    w, bias = {f: 0.0 for f, n in counts.items() if n >= toxicity.LEAST_DOCS}, -3.0
    m, v, mb, vb = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), 0.0, 0.0
    chance = lambda s: 1 / (1 + math.exp(-(bias + sum(w.get(f, 0.0) for f in s))))
    for t in range(1, 31):
        g, gb = dict.fromkeys(w, 0.0), 0.0
        for sets, y in zip(lists, toxic, strict=True):
            clean = math.prod(1 - chance(s) for s in sets)
            for s in sets:
                pull = chance(s) * (-clean / (1 - clean) if y else 1.0) / len(lists)  # of the log loss of 1 - clean
                gb += pull
                for f in s & w.keys():
                    g[f] += pull
        for f in w:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            rate = 0.1 / (math.sqrt(v[f] / (1 - 0.99**t)) + 1e-5)
            moved = w[f] - rate * m[f] / (1 - 0.9**t)
            w[f] = math.copysign(max(abs(moved) - rate * 3e-4, 0), moved)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        bias -= 0.1 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    flat = [np.array(sorted(s), np.int32) for sets in lists for s in sets]
    starts = np.cumsum([0] + [len(f) for f in flat])[:-1]
    docs = np.cumsum([0] + [len(sets) for sets in lists])[:-1]
    model = toxicity.learn(np.concatenate(flat), starts, docs, toxic, rounds=30)
    kept = {f: x for f, x in w.items() if x}
    assert dict(zip(model.features.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(kept, rel=1e-6, abs=1e-9) and model.bias == pytest.approx(bias)

    got = toxicity.score(documents(spark, list(enumerate(texts))), model).orderBy("doc_id").collect()
    for r, sets in zip(got, lists, strict=True):
        assert r["toxicity"] == pytest.approx(1 - math.prod(1 - chance(s) for s in sets)), r
        assert r["offending"] == [i for i, s in enumerate(sets) if chance(s) >= 0.5]
    assert any(r["offending"] for r in got) and not all(r["offending"] for r in got)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(901, None), (902, [0.0] * 8), (903, [float("nan")] + [1.0] * 7), (904, [None] + [1.0] * 7), (905, [1.0] * 3), (5, x[5].tolist()), (None, x[7].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(e, e.where("vec_id % 100 = 0"), budget=2500).collect()
    ids = np.arange(900)
    hit = 0
    for q in range(0, 900, 100):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((ids, d))[:10]
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(r["score"] == d[r["vec_id"]] for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        hit += len({r["vec_id"] for r in own} & set(best.tolist()))
    assert hit >= 0.9 * 90
    few = e.where("vec_id < 4")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 3
    assert neighbours.nearest(e.where("vec_id > 900 and vec_id < 905"), e).count() == 0


def test_neighbours_that_share_ids(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(-3, 4, (260, 4)) + 0.5
    rows = [(int(i), v.tolist()) for i, v in zip(rng.integers(0, 60, 260), x, strict=True)] + [(7, [0.5] * 4)] * 15 + [(8, [0.5] * 4)] * 2 + [(20, [9.5] * 4)] * 3
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(e, e.where("vec_id % 20 = 0 or vec_id = 7")).collect())
    want = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 20 == 0 or i == 7}:
        near = sorted((float(np.sqrt(((np.array(u) - v) ** 2).sum())), i) for i, u in rows if i != q)[:10]
        want += [(q, n, i, d) for n, (d, i) in enumerate(near, 1)]
    assert got == sorted(want)
    few = spark.createDataFrame([(100, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [9.0, 0.0])], e.schema)
    assert sorted(tuple(r) for r in neighbours.nearest(few, few.where("vec_id = 100")).collect()) == [(100, 1, 1, 1.0), (100, 2, 1, 2.0), (100, 3, 2, 8.0)]


def test_neighbours_of_mixed_lengths(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 20)  # leaves are dealt out
    rng = np.random.default_rng(7)
    vectors = {i: rng.normal(size=6 if i % 3 else 9) for i in range(300)} | {300: rng.normal(size=4)}
    e = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").withColumn("width", F.lit("clash"))
    got = neighbours.nearest(e, e.where("vec_id % 10 = 0"), sample=60).collect()
    for q in range(0, 301, 10):
        near = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in near]


def test_neighbours_budget_grows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 32))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(e, e.where("vec_id % 100 = 0"), budget=800, sample=500).collect()  # as far below the rows as the default is on 250,000
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(d)[:10].tolist()))
    assert hit >= 0.9 * 600


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit/terms"].split()
    cut_ = " ".join([*mit[:30], "EDITED", *mit[31:]])
    rows = [(1, f"word word\n{cut_} more"), (2, "Released under the MIT License."), (3, "xx released UNDER the, mit### license yy"), (4, " ".join(mit[:40])), (5, None), (6, ""), (2, "Released under the MIT License."), (None, "All rights reserved."), (7, "y " * 5000)]
    split = [(1, " ".join([*mit[:45], *(f"page{i}" for i in range(18)), *mit[45:]])), (2, " ".join([*mit[:45], *(f"other{i}" for i in range(60)), *mit[45:]]))]
    assert [(r["doc_id"], r["license"], r["n_words"]) for r in licenses.scan(documents(spark, split)).collect()] == [(1, "mit/terms", len(re.findall(r"[^\W_]+", " ".join(mit))) + 18)]  # "and/or" is two words
    got = licenses.scan(documents(spark, rows).withColumn("words", F.lit(1))).collect()
    assert {(r["doc_id"], r["license"], r["start"]) for r in got} == {(1, "mit/terms", 2), (2, "mit/notice", 0), (3, "mit/notice", 1), (None, "reserved/notice", 0)}
    assert len(got) == 4 and next(r for r in got if r["doc_id"] == 1)["containment"] >= 0.8
    assert licenses.scan(documents(spark, [])).count() == 0 and licenses.scan(documents(spark, rows), {}).count() == 0
