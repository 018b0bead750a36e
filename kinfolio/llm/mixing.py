"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.joins import join_counted
from ..plans.lineage import cut
from .common import fresh, table, words

#: Bits of the seeded order that are cut into bins at each level; so many levels before
#: single places count, and before single texts do among rows that share one place.
BITS, LEVELS = 12, {"place": 2, "tie": 1}
#: Parts in which rows that share place and text are numbered.
PARTS = 64


def source_targets(sizes: DataFrame, *, share: float = 1.5, epochs: float = 2.0, weights: tuple = (5, 2, 1)) -> DataFrame:
    """The target of each source, from (source, source_size).

    Sources, by code point and null last, weigh ``weights`` in turn. They share
    ``share`` times all sizes; none gets more than ``epochs`` times its size, and
    the excess is shared out again by weight. The result is min(cap, level *
    weight): with sources ordered by cap / weight, all before some point stand at
    their cap and the rest at one level, so the level is found by prefix sums
    rather than by rounds. Sources of size 0 get 0. The prefix sums run in one task over
    a row a source; sources are a dimension, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    all_rows = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = all_rows.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = (
        sizes.withColumn("weight", pick)
        .withColumn("cap", F.lit(epochs) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("try", F.col("left") / F.col("open"))
    )
    level = F.coalesce(F.min(F.when(F.col("try") <= F.col("ratio"), F.struct("ratio", "source", "try"))).over(whole)["try"], F.max("ratio").over(whole))
    return s.withColumn("level", level).select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(documents: DataFrame, *, share: float = 1.5, epochs: float = 2.0, weights: tuple = (5, 2, 1), seed: int = 11) -> DataFrame:
    """How often each document enters the mix.

    Adds size (words), source_size, target, repeats (whole repetitions), part
    (words of one further, fractional repetition) and taken (all words taken).
    Every document is repeated floor(target / source_size) times. The words that
    are still missing come from one more repetition of the first documents in a
    seeded order; the last of these gives only its first ``part`` words, so that
    a source's taken words add up to its target, rounded down.

    The seeded order is the leading 60 bits of SHA-256 of the id, then a hash of the
    text; rows that share both are numbered. The place where a source's words run
    out is found in levels of 2 ** BITS bins, each summed before it is
    shuffled, then among the ids of one bin; documents that share that id are cut
    by their text in the same way. So no source meets in one task however large it
    is, and however many rows share an id.

    Null or empty texts have size 0 and are taken 0 times. A null source is a
    source. A null doc_id is an id. Rows that repeat an id are documents of
    their own. An empty table gives an empty result. Columns of ``documents`` are
    kept, except those of the same names as the new ones.
    """
    new = ("size", "source_size", "target", "repeats", "part", "taken")
    documents = documents.drop(*new)
    place, tie = fresh(documents, "place"), fresh(documents, "tie")
    name = F.concat(F.lit(f"mix:{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    sized = documents.withColumn("size", F.size(words(F.col("text"))).cast("long")).withColumn(place, F.conv(F.substring(F.sha2(name, 256), 1, 15), 16, 10).cast("long"))
    sized = sized.withColumn(tie, F.shiftrightunsigned(F.xxhash64("text"), 4))
    slim = cut(sized.select("source", "size", F.col(place).alias("place"), F.col(tie).alias("tie")), "mix-sizes")

    targets = source_targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), share=share, epochs=epochs, weights=weights)
    targets = targets.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = cut(targets.withColumn("missing", F.floor(F.col("target") - F.col("repeats") * F.col("source_size")).cast("long")), "mix-targets")

    # step by step, the bin of each source in which its missing words run out; a source that needs none has none
    last, rows = targets.where("missing > 0").select("source", F.lit(0).cast("long").alias("bin"), F.col("missing").alias("rest")), slim
    up = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    n = targets.count()
    for by, levels in LEVELS.items():
        for level in [*range(1, levels + 1), None]:
            bin_ = F.shiftright(by, 60 - BITS * level) if level else F.col(by)
            bins = rows.groupBy("source", bin_.alias("bin")).agg(F.sum("size").alias("words"))
            run = join_counted(bins, last.select("source", "rest"), ["source"], F.col("bin"), rows=n).withColumn("upto", F.sum("words").over(up))
            run = run.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
            last = cut(run.select("source", "bin", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest")), "mix-bins")
            rows = join_counted(rows, last.select("source", F.col("bin").alias("last_bin")), ["source"], F.col("tie"), rows=n).where(bin_ == F.col("last_bin")).drop("last_bin")
        if by == "place":
            last_place = last.select("source", F.col("bin").alias("last_place"))
    last = last.join(last_place.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "last_place", F.col("bin").alias("last_tie"), "rest")
    plan = targets.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "missing")
    plan = cut(plan.withColumns({c: F.coalesce(c, F.lit(0 if c == "rest" else -1)) for c in ("last_place", "last_tie", "rest")}), "mix-plan")

    temp = {c: fresh(documents, c) for c in ("last_place", "last_tie", "rest", "nth", "part_of")}
    out = join_counted(sized, plan.withColumnsRenamed({c: temp[c] for c in ("last_place", "last_tie", "rest")}), ["source"], F.col(place), rows=n)
    at = F.col(place) == F.col(temp["last_place"])
    is_last = at & (F.col(tie) == F.col(temp["last_tie"]))
    before = (F.col(place) < F.col(temp["last_place"])) | (at & (F.col(tie) < F.col(temp["last_tie"])))
    others = out.where(~is_last | (F.col("size") == 0)).withColumn("part", F.lit(0).cast("long")).withColumn("repeats", F.when(F.col("size") > 0, F.col("repeats") + before.cast("long")).otherwise(F.lit(0).cast("long")))
    # rows of one source that share place and text: so many whole ones, one in part, none of the others
    last = cut(out.where(is_last & (F.col("size") > 0)).withColumn(temp["part_of"], F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "mix-last")
    own = F.col(temp["part_of"])
    counts = last.groupBy(F.col("source").alias("s"), own.alias("p")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("earlier", F.sum("n").over(Window.partitionBy("s").orderBy("p")) - F.col("n")).withColumnRenamed("n", "own_n")
    nth = F.row_number().over(Window.partitionBy("source", temp["part_of"]).orderBy(F.lit(0)))
    keys = {c: fresh(last, c) for c in ("s", "p", "own_n", "earlier")}
    last = last.withColumn(temp["nth"], nth)
    last = last.join(counts.withColumnsRenamed(keys), last["source"].eqNullSafe(F.col(keys["s"])) & (last[temp["part_of"]] == F.col(keys["p"])))
    left = F.col(temp["rest"]) - (F.col(keys["earlier"]) + F.col(temp["nth"]) - 1) * F.col("size")
    last = last.withColumn("part", F.when(left >= F.col("size"), F.lit(0)).otherwise(F.greatest(left, F.lit(0))).cast("long")).withColumn("repeats", F.col("repeats") + (left >= F.col("size")).cast("long"))
    both = others.unionByName(last.drop(*keys.values(), temp["nth"], temp["part_of"]))
    return both.withColumn("taken", F.col("repeats") * F.col("size") + F.col("part")).drop(place, tie, *(temp[c] for c in ("last_place", "last_tie", "rest")))


def mixed_documents(documents: DataFrame, **how) -> DataFrame:
    """The mix itself, with the columns of ``documents``: each row as often as it
    is repeated, and the leading words of the documents that are taken in part."""
    m, columns = mix_sources(documents, **how), documents.columns
    whole = m.where("repeats > 0").withColumn(fresh(m, "copy"), F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select(*columns)
    part = m.where("part > 0").withColumn("text", F.array_join(F.slice(words(F.col("text")), 1, F.col("part").cast("int")), " "))
    if "n_chars" in columns:
        part = part.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return whole.unionByName(part.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return mix_sources(d.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('mix:11:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio,
        (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS try
      FROM w WINDOW p AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce((SELECT try FROM o WHERE try <= ratio ORDER BY ratio, source LIMIT 1), (SELECT max(ratio) FROM o)) AS level),
t AS (SELECT source, source_size, least(cap, level * weight) AS target,
        CASE WHEN source_size > 0 THEN floor(least(cap, level * weight) / source_size)::BIGINT ELSE 0 END AS whole FROM o, l),
r AS (SELECT d.*, source_size, target, whole, floor(target - whole * source_size)::BIGINT AS missing,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, missing - before)))::BIGINT AS taken FROM r
"""
QUERIES, ORACLES = {"op3_mix_sources": query}, {"op3_mix_sources": SQL}
