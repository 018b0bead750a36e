"""Exact donors, their places in training files, and pairs made again from their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import orient
from .splits import numbered

#: The fields from which an edit is judged.
CONSTRUCT_FIELDS = ("context", "original_response", "feedback", "candidate_edit")


def donor_candidates(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """target_id, donors (how many pool rows share the target's context and hold its
    preferred text as a response) and donor_id, null unless there is exactly one.

    ``targets`` has target_id, context and preferred, ``pool`` donor_id, context,
    response1 and response2, all as hashes or normalised. The pool is summed by context and
    response before it meets targets, so a context of any size makes a row a target."""
    held = pool.select("donor_id", "context", F.explode(F.array_distinct(F.array("response1", "response2"))).alias("preferred"))
    held = held.groupBy("context", "preferred").agg(F.min("donor_id").alias("low"), F.max("donor_id").alias("high"), F.count_distinct("donor_id").alias("n"))
    found = targets.select("target_id", "context", "preferred").join(held, ["context", "preferred"], "left")
    return found.select("target_id", F.coalesce("n", F.lit(0)).alias("donors"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("donor_id"))


def exact_donors(targets: DataFrame, pool: DataFrame) -> DataFrame:
    """target_id and donor_id. Raises where a target hasn't exactly one donor, or a
    donor has several targets."""
    c = donor_candidates(targets, pool)
    wrong = F.concat(F.lit("target "), F.col("target_id").cast("string"), F.lit(": donors that match exactly: "), F.col("donors").cast("string"))
    c = c.select("target_id", F.coalesce("donor_id", F.raise_error(wrong).cast(c.schema["donor_id"].dataType)).alias("donor_id"))
    shared = F.concat(F.lit("donor "), F.col("donor_id").cast("string"), F.lit(" stands for several targets"))
    one = c.groupBy("donor_id").agg(F.min("target_id").alias("target_id"), F.count("*").alias("n"))
    return one.select(F.when(F.col("n") > 1, F.raise_error(shared).cast(c.schema["target_id"].dataType)).otherwise(F.col("target_id")).alias("target_id"), "donor_id")


def donor_positions(donors: DataFrame, files: DataFrame) -> DataFrame:
    """seed, target_id and position of its donor in the training file of each seed.
    ``files`` has seed, id and position. Raises where a file lacks a donor or holds it twice."""
    seeds = files.select("seed").distinct()  # a few
    held = donors.crossJoin(F.broadcast(seeds)).join(files.select("seed", F.col("id").alias("donor_id"), "position"), ["seed", "donor_id"], "left")
    g = held.groupBy("seed", "target_id", "donor_id").agg(F.min("position").alias("position"), F.count("position").alias("n"))
    wrong = F.concat(F.lit("seed "), F.col("seed").cast("string"), F.lit(": donor "), F.col("donor_id").cast("string"), F.lit(" stands at so many places: "), F.col("n").cast("string"))
    return g.select("seed", "target_id", F.when(F.col("n") == 1, F.col("position")).otherwise(F.raise_error(wrong).cast("long")).alias("position"))


def train_files(slotted: DataFrame, donors: DataFrame, fillers: DataFrame) -> DataFrame:
    """position, kind, naive_id and safe_id: two files that differ in boundary slots
    alone. ``slotted`` has position, kind and id; the nth boundary slot takes the nth of
    ``donors`` (id, n) in one file and the nth of ``fillers`` in the other."""
    total = slotted.agg(F.count("*").alias("total"))
    b = slotted.where("kind = 'boundary'").crossJoin(F.broadcast(total))
    b = numbered(b.select("position", "total"), F.col("position"), "n", part=F.floor(F.col("position") * 256 / F.col("total")))
    taken = b.join(donors.select("n", F.col("id").alias("naive_id")), "n", "left").join(fillers.select("n", F.col("id").alias("safe_id")), "n", "left")
    out = slotted.join(taken.select("position", "naive_id", "safe_id"), "position", "left")
    of = lambda c: F.when(F.col("kind") == "boundary", F.coalesce(c, F.raise_error(F.concat(F.lit("nothing for the boundary slot at "), F.col("position").cast("string"))).cast(slotted.schema["id"].dataType))).otherwise(F.col("id"))
    return out.select("position", "kind", of("naive_id").alias("naive_id"), of("safe_id").alias("safe_id"))


def rebuilt(file: DataFrame, base: DataFrame) -> DataFrame:
    """A file of (position, kind, id) whose boundary slots stay and whose base slots are
    filled anew, in order of position, from ``base`` (id, n); raises if that is too short."""
    total = file.agg(F.count("*").alias("total"))
    slots = numbered(file.where("kind = 'base'").select("position").crossJoin(F.broadcast(total)), F.col("position"), "n", part=F.floor(F.col("position") * 256 / F.col("total")))
    new = slots.join(base.select("n", F.col("id").alias("new_id")), "n", "left").select("position", F.coalesce("new_id", F.raise_error(F.lit("too few base rows")).cast(file.schema["id"].dataType)).alias("new_id"))
    return file.join(new, "position", "left").select("position", "kind", F.coalesce("new_id", "id").alias("id"))


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """position, left_id and right_id where two aligned files (position, id) differ;
    a place that only one of them has differs too."""
    both = left.select("position", F.col("id").alias("left_id")).join(right.select("position", F.col("id").alias("right_id")), "position", "full")
    return both.where(~F.col("left_id").eqNullSafe(F.col("right_id")))


def training_pair(source_id: Column, context: Column, better: Column, worse: Column, view: str, domain: Column, language: Column) -> Column:
    """A preference pair of a source record, sides dealt by its hash."""
    p = orient(source_id, better, worse)
    return F.struct(
        source_id.alias("pair_id"), F.lit(view).alias("source_view"), context.alias("context"), p["response1"].alias("response1"), p["response2"].alias("response2"), p["overall_preference"].alias("overall_preference"),
        F.coalesce(domain, F.lit("unknown")).alias("domain"), F.coalesce(language, F.lit("unknown")).alias("language"),
    )


def edit_training_pairs(rows: DataFrame) -> DataFrame:
    """The edited response is preferred to the original one; ``rows`` has record_hash and the fields of the edit view."""
    return rows.select(F.inline(F.array(training_pair(F.col("record_hash"), F.col("context"), F.col("edited_response"), F.col("original_response"), "edit", F.col("domain"), F.col("language")))))


def edit_quality_pairs(rows: DataFrame) -> DataFrame:
    """The good edit is preferred to the bad one."""
    return rows.select(F.inline(F.array(training_pair(F.col("record_hash"), F.col("context"), F.col("good_edited_response"), F.col("bad_edited_response"), "edit_quality", F.col("domain"), F.col("language")))))


def _augmented(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns, "original_response", "feedback", F.array(*map(F.lit, CONSTRUCT_FIELDS)).alias("construct_fields"))


def enriched_quality_pairs(rows: DataFrame) -> DataFrame:
    """Quality pairs with the original response, the feedback and the names of the construct's fields."""
    pairs = edit_quality_pairs(rows).withColumnRenamed("pair_id", "record_hash")
    both = pairs.join(rows.select("record_hash", "original_response", "feedback").dropDuplicates(["record_hash"]), "record_hash").withColumnRenamed("record_hash", "pair_id")
    return _augmented(both, *edit_quality_pairs(rows).columns)


def recovered(pairs: DataFrame, sources: DataFrame, view: str) -> DataFrame:
    """Stored ``pairs`` with the construct's fields of their source records, which are
    found by record hash. Raises where a pair has no source, where a field of the source is
    empty, or where the pair made from the source again isn't the stored one."""
    made = (edit_training_pairs if view == "edit" else edit_quality_pairs)(sources)
    columns = made.columns
    full = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    sound = full("context") & full("original_response") & F.coalesce((F.size("feedback") > 0) & F.forall("feedback", full), F.lit(False))
    src = sources.select(F.col("record_hash").alias("pair_id"), "original_response", "feedback", sound.alias("sound")).dropDuplicates(["pair_id"])
    again = made.dropDuplicates(["pair_id"]).select("pair_id", F.struct(*columns[1:]).alias("again"))
    both = pairs.join(src, "pair_id", "left").join(again, "pair_id", "left")
    say = lambda what: F.raise_error(F.concat(F.lit("pair "), F.col("pair_id"), F.lit(what)))
    checked = F.when(F.col("again").isNull(), say(" has no source")).when(~F.col("sound"), say(" lacks a construct field")).when(~F.col("again").eqNullSafe(F.struct(*columns[1:])), say(" isn't what its source makes")).otherwise(F.col("source_view"))
    return _augmented(both.withColumn("source_view", checked.cast("string")), *columns)
