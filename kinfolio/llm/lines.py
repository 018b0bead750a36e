"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import join_heavy
from .common import fresh, only, table

#: Lines in a window: any repeated run of so many lines is found.
WINDOW = 2
BLANKS = " \t\r\x0b\x0c"


def filled_lines(text: Column) -> Column:
    """The lines of a text that hold more than blanks, without blanks at their ends."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")


def _selected(d: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash and, of the column ``hashes``, pos: each line that is the least
    of some window (the first of equal ones), low and high: the first and last start of
    such windows, fingerprint: its hash, left and right: up to window - 1 lines on either
    side, the nearest first. Each array is a column, so lambdas look it up and don't make it again."""
    least = lambda i: i + F.array_position(F.slice("hashes", i + 1, window), F.array_min(F.slice("hashes", i + 1, window))).cast("int") - 1
    d = d.withColumn("least", F.transform(F.sequence(F.lit(0), F.size("hashes") - window), least))
    opens = lambda j: (j == 0) | (F.get("least", j) != F.get("least", j - 1))
    d = d.withColumn("opens", F.filter(F.sequence(F.lit(0), F.size("least") - 1), opens))
    side, pos = window - 1, lambda k: F.get("least", F.get("opens", k))
    chosen = F.transform(
        F.sequence(F.lit(0), F.size("opens") - 1),
        lambda k: F.struct(
            pos(k).alias("pos"), F.get("opens", k).alias("low"), (F.coalesce(F.get("opens", k + 1), F.size("least")) - 1).alias("high"), F.get("hashes", pos(k)).alias("fingerprint"),
            F.reverse(F.slice("hashes", F.greatest(pos(k) - side, F.lit(0)) + 1, F.least(F.lit(side), pos(k)))).alias("left"), F.slice("hashes", pos(k) + 2, side).alias("right"),
        ),
    )
    return d.select("doc_id", "text_hash", F.inline(chosen))


def _same(x: str, y: str) -> Column:
    """How many lines two arrays share from their beginnings on."""
    differs = F.array_position(F.zip_with(x, y, lambda u, v: F.coalesce(u == v, F.lit(False))), F.lit(False)).cast("int")
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(x), F.size(y)))


def repeated_runs(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """Runs of ``window`` or more filled lines that stand earlier already.

    The order of lines is (doc_id, hash of the text, line).

    1. Winnowing: of every ``window`` neighbouring lines the one with the least hash
       is selected, so any run of so many lines has a selected one at the same place in
       each of its copies. Selected positions are joined on the line's hash with the earliest
       such position, never with each other.
    2. Either match is extended both ways by comparing lines, window - 1 on each side;
       what goes on beyond that is found from the next selected line, on the same diagonal.
    3. An exact check of the rest: windows whose selected line stands earlier among other
       lines only are compared among themselves, by the hash of the whole window.
    4. Matches that meet on one diagonal are chained into runs.

    A line that a third of all documents hold makes one row a position and is summed
    before it is shuffled; what is known of it is sent to its rows, which are dealt out.

    Returns doc_id, text_hash (of the text), start and length of the run in
    filled lines, first_doc_id and first_start (where it stood before).
    """
    d = only(documents).select("doc_id", F.xxhash64("text").alias("text_hash"), filled_lines(F.col("text")).alias("lines"))
    d = d.where(F.size("lines") >= window).select("doc_id", "text_hash", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"))
    chosen = _selected(d, window)
    place = F.struct("doc_id", "text_hash", "pos", "left", "right")
    firsts = chosen.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    met = join_heavy(chosen, firsts, ["fingerprint"], F.struct("doc_id", "pos")).drop("n").where(F.struct("doc_id", "text_hash", "pos") > F.struct("first.doc_id", "first.text_hash", "first.pos"))
    met = met.withColumn("a", F.col("pos") - _same("left", "first.left")).withColumn("b", F.col("pos") + _same("right", "first.right") + 1)
    shift = F.col("pos") - F.col("first.pos")
    seeds = met.where(F.col("b") - F.col("a") >= window).select("doc_id", "text_hash", F.col("a").alias("start"), F.col("b").alias("end"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_text_hash"), shift.alias("diagonal"))
    if window > 1:
        open_ = F.filter(F.sequence("low", "high"), lambda i: (i < F.col("a")) | (i + window > F.col("b")))
        rest = met.select("doc_id", "text_hash", "fingerprint", (F.col("pos") - F.size("left")).alias("from"), F.concat(F.reverse("left"), F.array("fingerprint"), "right").alias("around"), F.explode(open_).alias("pos"))
        rest = rest.withColumn("around", F.xxhash64(F.slice("around", F.col("pos") - F.col("from") + 1, window)))
        place = F.struct("doc_id", "text_hash", "pos")
        firsts = rest.groupBy("fingerprint", "around").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
        more = join_heavy(rest, firsts, ["fingerprint", "around"], F.struct("doc_id", "pos")).drop("n").where(place > F.col("first"))
        more = more.select("doc_id", "text_hash", F.col("pos").alias("start"), (F.col("pos") + window).alias("end"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.text_hash").alias("first_text_hash"), shift.alias("diagonal"))
        seeds = seeds.unionByName(more)
    along = Window.partitionBy("doc_id", "text_hash", "first_doc_id", "first_text_hash", "diagonal").orderBy("start", "end")
    seeds = seeds.repartition("doc_id", "text_hash").dropDuplicates(["doc_id", "text_hash", "start", "end"])
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    seeds = seeds.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(along))
    runs = seeds.groupBy("doc_id", "text_hash", "first_doc_id", "first_text_hash", "diagonal", "run").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    return runs.select("doc_id", "text_hash", "start", "length", "first_doc_id", (F.col("start") - F.col("diagonal")).alias("first_start"))


def dedup_lines(documents: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """``documents`` without the lines of later repeated runs.

    Adds n_lines (filled lines), n_removed, and kept_text: the text as it was
    without the removed lines; lines of blanks stay, and so does the text of a
    document that loses nothing. A line goes if a run of ``window`` lines over
    it stands earlier, in a smaller doc_id (null first; equal ids by the hash of
    their texts) or before in its document. Runs shorter than ``window`` stay.

    Null texts have no lines and a null kept_text. Rows that repeat both id and
    text are one document and keep the same lines. An empty table gives an empty
    result. Other columns stay; those named like the new ones give way.
    """
    documents = documents.drop("n_lines", "n_removed", "kept_text")
    th, runs_c, id_c, hash_c, lines_c, marks_c = (fresh(documents, c) for c in ("text_hash", "runs", "run_id", "run_hash", "all_lines", "marks"))
    runs = repeated_runs(documents, window=window).select("doc_id", "text_hash", "start", (F.col("start") + F.col("length")).alias("end"))
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    opens = F.col("start") > F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))  # runs along several diagonals can meet
    runs = runs.withColumn("opens", F.coalesce(opens, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(by_doc))
    runs = runs.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = runs.groupBy(F.col("doc_id").alias(id_c), F.col("text_hash").alias(hash_c)).agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")))).alias(runs_c))
    out = documents.withColumn(th, F.xxhash64("text"))
    out = out.join(runs, out["doc_id"].eqNullSafe(runs[id_c]) & (out[th] == runs[hash_c]), "left").drop(id_c, hash_c)
    out = out.withColumn("n_lines", F.size(filled_lines(F.col("text"))).cast("long"))
    out = out.withColumn("n_removed", F.coalesce(F.aggregate(runs_c, F.lit(0), lambda a, x: a + x["end"] - x["start"]), F.lit(0)).cast("long"))
    # where the filled lines stand among all lines, then the stretches between the runs
    lines = F.split(F.col("text"), "\n")
    marks = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x, F.lit(BLANKS)) != "", i).otherwise(-1)), lambda i: i >= 0)
    out = out.withColumn(lines_c, F.when(F.col(runs_c).isNotNull(), lines)).withColumn(marks_c, F.when(F.col(runs_c).isNotNull(), marks))
    r = F.col(runs_c)
    stretches = F.transform(
        F.sequence(F.lit(0), F.size(r)),
        lambda k: F.struct(
            F.when(k == 0, F.lit(0)).otherwise(F.get(marks_c, F.get(r, k - 1)["end"] - 1) + 1).alias("a"),
            F.when(k == F.size(r), F.size(lines_c)).otherwise(F.get(marks_c, F.get(r, k)["start"])).alias("b"),
        ),
    )
    kept = F.array_join(F.flatten(F.transform(stretches, lambda s: F.slice(lines_c, s["a"] + 1, s["b"] - s["a"]))), "\n")
    return out.withColumn("kept_text", F.when(r.isNull(), F.col("text")).otherwise(kept)).drop(th, runs_c, lines_c, marks_c)


def stage(documents: DataFrame, *, window: int = 1) -> DataFrame:
    """Documents with their kept text, without those of which no filled line is
    left though some were there; columns as they were, n_chars counted anew. By
    default every line that stands earlier goes, with or without equal neighbours."""
    d = dedup_lines(documents, window=window).where("n_removed = 0 or n_removed < n_lines").withColumn("text", F.col("kept_text"))
    if "n_chars" in documents.columns:
        d = d.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return d.select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_join(filled_lines(F.col("kept_text")), "\n")
    return dedup_lines(only(table(spark, sf_dir, "documents"))).select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, line FROM (
    SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, trim(unnest(x), ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
  WHERE line <> ''),
w AS (SELECT doc_id, n, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS pair FROM l),
f AS (SELECT doc_id, n, row_number() OVER (PARTITION BY pair ORDER BY doc_id, n) AS nth FROM w WHERE pair IS NOT NULL),
g AS (SELECT DISTINCT doc_id, n + o AS n FROM f, (VALUES (0), (1)) v(o) WHERE nth > 1),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.n) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE g.n IS NULL), '') AS kept
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.n = g.n GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
QUERIES, ORACLES = {"op2_line_dedup": query}, {"op2_line_dedup": SQL}
