"""The driver's tables as records, atoms, pairs and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import collapse_space, directed_edit_hash, hash_number, hash_text, is_odd, quoted, record_id, stable_rank
from .lineage import cut

ATOM_COLUMNS = ("record_id", "view", "split", "source_index", "atom_type", "value_hash", "field", "linkable")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: four views by source number, splits by hash."""
    d = read(spark, sf_dir, "documents")
    v = F.concat(F.lit("v"), (F.substring("source", 4, 9).cast("int") % 4).cast("string"))
    s = F.when(F.substring(stable_rank(7, "split", F.col("doc_id")), 1, 1).isin("0", "1", "2"), "validation").otherwise("train")
    lines = F.split("text", "\n")
    return d.select(
        F.col("doc_id").alias("record_id"), v.alias("view"), s.alias("split"), F.col("doc_id").cast("int").alias("source_index"), F.col("lang").alias("domain"), "source", "text", lines.alias("lines"),
        collapse_space(F.get(lines, F.lit(0))).alias("first"), collapse_space(F.element_at(lines, -1)).alias("last"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("record_id", "view", "split", "source_index", "domain")


def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id with the hash of the whole record and the id made of it."""
    d = _documents(spark, sf_dir)
    whole = F.concat(F.lit('{"lang":'), quoted(F.col("domain")), F.lit(',"source":'), quoted(F.col("source")), F.lit(',"text":'), quoted(collapse_space(F.col("text"))), F.lit("}"))
    d = d.withColumn("record_hash", F.sha2(whole, 256))
    return d.select("record_id", "view", "split", "record_hash", record_id(F.lit("documents"), F.col("record_hash"), F.lit("r1"), F.col("source_index"), F.col("split"), F.col("view")).alias("record_hash_id"))


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct atoms of documents. The first line is the context and the last one
    closes it; both link, and so does the edit from first to last. The whole text
    is a response and every line is feedback; these are reported only. Texts are in
    NFKC in these tables, so no Python runs."""
    d = _documents(spark, sf_dir)
    one = lambda kind, h, field, link: F.struct(F.lit(kind).alias("atom_type"), h.alias("value_hash"), F.lit(field).alias("field"), F.lit(link).alias("linkable"))

    def of(lines):
        """Atoms of collapsed lines; the text collapsed as a whole is those that aren't empty, one blank between."""
        first, last = F.get(lines, F.lit(0)), F.element_at(lines, -1)
        singles = F.array(
            F.when(first != "", one("context", hash_text(first), "context", True)),
            F.when(last != "", one("closing", hash_text(last), "closing", True)),
            F.when((first != "") & (last != ""), one("edit_link", directed_edit_hash(first, last), "first->last", True)),
        )
        response = F.transform(F.array(F.array_join(F.filter(lines, lambda x: x != ""), " ")), lambda w: F.when(w != "", one("response", hash_text(w), "response", False)))
        line = lambda x, i: F.struct(F.lit("feedback").alias("atom_type"), hash_text(x).alias("value_hash"), F.format_string("feedback[%d]", i).alias("field"), F.lit(False).alias("linkable"))
        return F.array_compact(F.concat(singles, response, F.transform(lines, lambda x, i: F.when(x != "", line(x, i)))))

    # in arrays of one, so that lines and the whole are made once and not for each atom
    found = d.select("record_id", "view", "split", "source_index", F.explode(F.flatten(F.transform(F.array(F.transform("lines", collapse_space)), of))).alias("atom"))
    return found.select("record_id", "view", "split", "source_index", "atom.*")


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, view, split and context: the context atoms alone, so that no other atom is made."""
    return _documents(spark, sf_dir).where("first <> ''").select("record_id", "view", "split", hash_text(F.col("first")).alias("context"))


def kept_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``atoms``, made once, for what reads them several times."""
    return cut(atoms(spark, sf_dir), "atoms")


MODELS, SEEDS, BOUNDARIES, FRACTIONS = ("char", "word"), (1, 2, 3), ("naive", "safe"), (0.2, 0.4, 0.6, 0.8, 1.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up predictions for validation records, the same in any engine: margins
    are hashes. Naive target margins rise where the record's ancestor has arrived,
    so effects aren't all noise. Seeds 2 and 3 of ``char`` agree."""
    r = records(spark, sf_dir).where("split = 'validation'").select(F.col("record_id").alias("pair_id"), "domain")
    name = lambda *c: F.concat_ws(":", *c)
    r = r.withColumn("evaluation_set", F.element_at(F.array(*map(F.lit, ("clean", "target", "untouched"))), (hash_number(stable_rank(7, "set", F.col("pair_id"))) % 3 + 1).cast("int")))
    r = r.withColumn("position", hash_number(stable_rank(7, "position", F.col("pair_id"))) / F.lit(4294967296.0))
    arr = lambda v: F.array(*map(F.lit, v))
    for c, values in (("model", MODELS), ("seed", SEEDS), ("boundary", BOUNDARIES), ("fraction", FRACTIONS)):
        r = r.withColumn(c, F.explode(arr(values)))
    stream = F.when((F.col("model") == "char") & (F.col("seed") == 3), 2).otherwise(F.col("seed")).cast("string")
    cell = name(F.col("model"), stream, F.col("boundary"), (F.col("fraction") * 10).cast("int").cast("string"), F.col("pair_id").cast("string"))
    noise = hash_number(stable_rank(7, "margin", cell)) / F.lit(4294967296.0) - 0.4
    seen = (F.col("boundary") == "naive") & (F.col("evaluation_set") == "target") & (F.col("position") < F.col("fraction"))
    margin = noise + F.when(seen, 0.2).otherwise(0.0)
    label = is_odd(stable_rank(7, "label", F.col("pair_id")), 8).cast("int")
    return r.withColumn("margin", margin).withColumn("label", label).withColumn("correct", (F.col("margin") > 0).cast("int")).select("model", "seed", "boundary", "fraction", "evaluation_set", "pair_id", "domain", "position", "label", "margin", "correct")
