"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.canonical import is_odd, literal_record_hash, record_hash, stable_rank
from .functions.numbers import correctness, event_bin, logistic, prefix_size, signed_margin, wilson
from .functions.text import context_text, head_tail, length_bin, orient, role_sections
from .operators import effects, event_study, exposure, graph, learners, recovery, reports, resample, serialize, splits
from .operators.atoms import Mapping, exploded, with_atoms
from .plans import tables as t
from .plans.lineage import cut, fresh
from .sources import adapters, multiview
from .streaming import components as streamed

QUERIES: dict = {}
ORACLES: dict = {}

_WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
_Q = r"""'"' || replace(replace({}, '\', '\\'), '"', '\"') || '"'"""


def _rank(seed: int, namespace: str, identifier: str) -> str:
    return f"sha256('{seed}' || chr(0) || {namespace} || chr(0) || ({identifier})::VARCHAR)"


def _number(rank: str) -> str:
    return f"('0x' || substr({rank}, 1, 8))::BIGINT"


_RECORDS = rf"""
rec AS (SELECT doc_id AS record_id, 'v' || (substr(source, 4)::INT % 4) AS view,
  CASE WHEN substr({_rank(7, "'split'", "doc_id")}, 1, 1) IN ('0', '1', '2') THEN 'validation' ELSE 'train' END AS split,
  doc_id::INT AS source_index, lang AS domain, source, text, string_split(text, chr(10)) AS ls FROM documents)"""
_ATOMS = rf"""{_RECORDS},
fl AS (SELECT *, {_WS.format("ls[1]")} AS f, {_WS.format("ls[-1]")} AS l, {_WS.format("text")} AS w FROM rec),
an AS (
  SELECT record_id, view, split, source_index, 'context' AS atom_type, {_Q.format("f")} AS j, 'context' AS field, true AS linkable FROM fl WHERE f <> ''
  UNION ALL SELECT record_id, view, split, source_index, 'closing', {_Q.format("l")}, 'closing', true FROM fl WHERE l <> ''
  UNION ALL SELECT record_id, view, split, source_index, 'response', {_Q.format("w")}, 'response', false FROM fl WHERE w <> ''
  UNION ALL SELECT record_id, view, split, source_index, 'edit_link', '{{"edited":' || {_Q.format("l")} || ',"original":' || {_Q.format("f")} || '}}', 'first->last', true FROM fl WHERE f <> '' AND l <> ''
  UNION ALL SELECT record_id, view, split, source_index, 'feedback', {_Q.format("x")}, 'feedback[' || i || ']', false
    FROM (SELECT record_id, view, split, source_index, unnest(range(0, len(ls))) AS i, {_WS.format("unnest(ls)")} AS x FROM rec) WHERE x <> ''),
atoms AS (SELECT record_id, view, split, source_index, atom_type, sha256(j) AS value_hash, field, linkable FROM an)"""
_MATCH = rf"""{_ATOMS},
tr AS (SELECT DISTINCT atom_type, value_hash, view AS source_view, record_id AS source_id FROM atoms WHERE split = 'train'),
ev AS (SELECT DISTINCT record_id, view AS evaluation_view, atom_type, value_hash, field, linkable FROM atoms WHERE split = 'validation'),
mt AS (SELECT record_id, evaluation_view, e.atom_type, source_view, count(DISTINCT (e.value_hash, field, linkable)) AS a, count(DISTINCT source_id) AS r
  FROM ev e JOIN tr t ON e.atom_type = t.atom_type AND e.value_hash = t.value_hash GROUP BY ALL),
grid AS (SELECT DISTINCT r.record_id, r.view AS evaluation_view, y.atom_type, v.view AS source_view FROM rec r, (SELECT DISTINCT atom_type FROM atoms) y, (SELECT DISTINCT view FROM atoms) v WHERE r.split = 'validation'),
cells AS (SELECT g.*, coalesce(r, 0) > 0 AS exposed, coalesce(a, 0)::BIGINT AS matching_atoms, coalesce(r, 0)::BIGINT AS matching_training_records
  FROM grid g LEFT JOIN mt USING (record_id, evaluation_view, atom_type, source_view))"""
_LINK = rf"""{_ATOMS},
ky AS (SELECT atom_type, value_hash FROM atoms GROUP BY ALL HAVING bool_or(linkable) AND min(record_id) < max(record_id)),
mb AS (SELECT DISTINCT atom_type, value_hash, record_id FROM atoms JOIN ky USING (atom_type, value_hash)),
eg AS MATERIALIZED (SELECT DISTINCT record_id AS a, min(record_id) OVER (PARTITION BY atom_type, value_hash) AS b FROM mb),
e2 AS MATERIALIZED (SELECT a, b FROM eg WHERE a <> b UNION SELECT b, a FROM eg WHERE a <> b),
reach AS (SELECT DISTINCT a AS node, a AS r FROM e2 UNION SELECT reach.node, e2.b FROM reach JOIN e2 ON e2.a = reach.r),
lab AS MATERIALIZED (SELECT rec.record_id, coalesce(min(r), rec.record_id) AS label FROM rec LEFT JOIN reach ON node = rec.record_id GROUP BY rec.record_id)"""
_PRED = rf"""{_RECORDS},
pb AS (SELECT record_id AS pair_id, domain, ['clean', 'target', 'untouched'][({_number(_rank(7, "'set'", "record_id"))} % 3 + 1)::INT] AS evaluation_set,
  {_number(_rank(7, "'position'", "record_id"))} / 4294967296.0::DOUBLE AS position, substr({_rank(7, "'label'", "record_id")}, 8, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS odd FROM rec WHERE split = 'validation'),
pc AS (SELECT * FROM pb, (VALUES ('char'), ('word')) m(model), (VALUES (1), (2), (3)) s(seed), (VALUES ('naive'), ('safe')) b(boundary), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) f(fraction)),
pd AS (SELECT *, model || ':' || CASE WHEN model = 'char' AND seed = 3 THEN 2 ELSE seed END || ':' || boundary || ':' || (fraction * 10)::INT || ':' || pair_id AS cell FROM pc),
pred AS MATERIALIZED (SELECT model, seed, boundary, fraction, evaluation_set, pair_id, domain, position, odd::INT AS label,
  {_number(_rank(7, "'margin'", "cell"))} / 4294967296.0::DOUBLE - 0.4::DOUBLE + CASE WHEN boundary = 'naive' AND evaluation_set = 'target' AND position < fraction THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS margin FROM pd),
p AS (SELECT *, (margin > 0)::INT AS correct FROM pred),
dl AS MATERIALIZED (SELECT model, seed, fraction, evaluation_set, pair_id, any_value(position) AS position,
  (max(correct) FILTER (WHERE boundary = 'naive') - max(correct) FILTER (WHERE boundary = 'safe'))::DOUBLE AS delta FROM p GROUP BY ALL)"""


def _round(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Averages are compared after rounding: engines add up in different orders."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d)
    place = p.select("pair_id", "position").distinct()
    return effects.paired(p).join(place, "pair_id")


# --- atoms, hashes, exposure


@_query("atoms", f"WITH {_ATOMS} SELECT record_id, view, split, atom_type, value_hash, field, linkable FROM atoms")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.atoms(spark, d).drop("source_index")


_WHOLE = rf"""hs AS (SELECT *, sha256('{{"lang":' || {_Q.format("domain")} || ',"source":' || {_Q.format("source")} || ',"text":' || {_Q.format(_WS.format("text"))} || '}}') AS record_hash FROM rec),
hi AS (SELECT *, sha256('{{"dataset":"documents","record_hash":"' || record_hash || '","revision":"r1","source_index":' || source_index || ',"split":"' || split || '","view":"' || view || '"}}') AS record_hash_id FROM hs)"""


@_query("record_hashes", f"WITH {_RECORDS}, {_WHOLE} SELECT record_id, view, split, record_hash, record_hash_id FROM hi")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.record_hashes(spark, d)


@_query("atom_occurrences", f"WITH {_ATOMS} SELECT atom_type, value_hash, count(*) AS occurrences, count(DISTINCT record_id) AS records FROM atoms GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.atoms(spark, d).groupBy("atom_type", "value_hash").agg(F.count("*").alias("occurrences"), F.count_distinct("record_id").alias("records"))


@_query("exposure_rows", f"WITH {_MATCH} SELECT * FROM cells")
def _(spark: SparkSession, d: str) -> DataFrame:
    return exposure.exposure_rows(t.kept_atoms(spark, d))


_N = "(SELECT view AS evaluation_view, count(*) AS validation_rows FROM rec WHERE split = 'validation' GROUP BY ALL)"


@_query("exposure_by_source_view", f"""WITH {_MATCH} SELECT evaluation_view, source_view, atom_type, any_value(validation_rows) AS validation_rows, count(*) FILTER (WHERE exposed) AS exposed_rows,
  count(*) FILTER (WHERE exposed) / any_value(validation_rows) AS exposure_rate, sum(matching_atoms)::BIGINT AS matching_atoms, sum(matching_training_records)::BIGINT AS matching_training_records
  FROM cells JOIN {_N} USING (evaluation_view) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return exposure.by_source_view(t.kept_atoms(spark, d))


@_query("exposure_same_any_view", f"""WITH {_MATCH}, pr AS (SELECT evaluation_view, atom_type, record_id, bool_or(exposed) AS y, bool_or(exposed AND source_view = evaluation_view) AS s FROM cells GROUP BY ALL)
  SELECT evaluation_view, atom_type, any_value(validation_rows) AS validation_rows, count(*) FILTER (WHERE s) AS same_view_exposed_rows, count(*) FILTER (WHERE s) / any_value(validation_rows) AS same_view_exposure_rate,
  count(*) FILTER (WHERE y) AS any_view_exposed_rows, count(*) FILTER (WHERE y) / any_value(validation_rows) AS any_view_exposure_rate, count(*) FILTER (WHERE y AND NOT s) AS cross_view_only_rows,
  count(*) FILTER (WHERE y AND NOT s) / any_value(validation_rows) AS cross_view_only_rate FROM pr JOIN {_N} USING (evaluation_view) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return exposure.same_and_any_view(t.kept_atoms(spark, d))


@_query("cross_view_queue", f"""WITH {_ATOMS}, q AS (SELECT DISTINCT e.atom_type, e.value_hash, e.view AS validation_view, e.source_index AS validation_source_index, e.field AS validation_field, t.view AS tv, t.source_index AS ti, t.field AS tf
  FROM atoms e JOIN atoms t ON e.atom_type = t.atom_type AND e.value_hash = t.value_hash AND e.split = 'validation' AND t.split = 'train' AND e.view <> t.view),
  o AS (SELECT *, row_number() OVER (PARTITION BY atom_type, value_hash, validation_view, validation_source_index, validation_field ORDER BY tv, ti, tf) AS n FROM q)
  SELECT atom_type, value_hash, validation_view, validation_source_index, validation_field, string_agg(DISTINCT tv, '|' ORDER BY tv) AS source_views, max(tv) FILTER (WHERE n = 1) AS example_train_view,
  max(ti) FILTER (WHERE n = 1) AS example_train_source_index, max(tf) FILTER (WHERE n = 1) AS example_train_field FROM o GROUP BY 1, 2, 3, 4, 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return exposure.inspection_queue(t.kept_atoms(spark, d))


@_query("wilson", f"""WITH {_MATCH}, pr AS (SELECT evaluation_view, atom_type, record_id, bool_or(exposed) AS y FROM cells GROUP BY ALL), k AS (SELECT evaluation_view, atom_type, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE y))::DOUBLE AS k FROM pr GROUP BY ALL)
  SELECT evaluation_view, atom_type, round((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n), 9) AS low,
  round((k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4 * n * n))) / (1 + 3.841458820694124 / n), 9) AS high FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = exposure.same_and_any_view(t.kept_atoms(spark, d))
    low, high = wilson(F.col("any_view_exposed_rows"), F.col("validation_rows"))
    return _round(e.select("evaluation_view", "atom_type", low.alias("low"), high.alias("high")), "low", "high")


# --- components


@_query("component_labels", f"WITH RECURSIVE {_LINK} SELECT record_id, label FROM lab")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(t.kept_atoms(spark, d))


@_query("streamed_components", f"WITH RECURSIVE {_LINK} SELECT record_id, label FROM lab")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same labels from edges that arrive in three batches."""
    a = t.kept_atoms(spark, d)
    edges = graph.linking_keys(a).select(F.col("record_id").alias("a"), F.col("low").alias("b"))
    folder = fresh(spark, "streamed")
    edges.repartition(max(3, spark.sparkContext.defaultParallelism)).write.parquet(f"{folder}/edges")
    files = len(spark.read.parquet(f"{folder}/edges").inputFiles())
    arriving = spark.readStream.schema(edges.schema).option("maxFilesPerTrigger", math.ceil(files / 3)).parquet(f"{folder}/edges")
    q = streamed.follow(arriving, folder, availableNow=True)
    q.awaitTermination()
    found = streamed.labels(spark, folder, q.lastProgress["batchId"] + 1)
    return t.records(spark, d).join(found, F.col("record_id") == F.col("node"), "left").select("record_id", F.coalesce("component", "record_id").alias("label"))


_SIZES = "cs AS (SELECT label, count(*) AS size, bool_or(split = 'train') AND bool_or(split = 'validation') AS x, count(DISTINCT view) AS v FROM lab JOIN rec USING (record_id) GROUP BY label)"


@_query("component_summary", f"""WITH RECURSIVE {_LINK}, {_SIZES} SELECT sum(size)::BIGINT AS records, count(*) AS components, max(size) AS largest_component_records, count(*) FILTER (WHERE x) AS cross_split_components,
  coalesce(sum(size) FILTER (WHERE x), 0)::BIGINT AS records_in_cross_split_components, count(*) FILTER (WHERE v >= 2) AS multi_view_components, coalesce(sum(size) FILTER (WHERE v >= 2), 0)::BIGINT AS records_in_multi_view_components,
  (SELECT count(*) FROM (SELECT DISTINCT atom_type, value_hash FROM atoms)) AS atoms FROM cs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = t.kept_atoms(spark, d)
    return graph.component_summary(graph.components(a), t.records(spark, d), a)


@_query("component_sizes", f"WITH RECURSIVE {_LINK}, {_SIZES} SELECT size::VARCHAR AS size, count(*) AS components FROM cs GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.size_histogram(graph.components(t.kept_atoms(spark, d)), t.records(spark, d))


@_query("component_ids_hashed", f"""WITH RECURSIVE {_LINK}, {_WHOLE} SELECT label, sha256('["' || string_agg(record_hash_id, '","' ORDER BY record_hash_id) || '"]') AS component_id FROM lab JOIN hi USING (record_id) GROUP BY label""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.hashed_ids(graph.components(t.kept_atoms(spark, d)), t.record_hashes(spark, d))


@_query("union_events", f"WITH {_ATOMS}, ky AS (SELECT atom_type, value_hash, count(DISTINCT record_id) AS n FROM atoms GROUP BY ALL HAVING bool_or(linkable)) SELECT sum(n - 1)::BIGINT AS union_events FROM ky WHERE n > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.union_events(t.kept_atoms(spark, d))


def _policy(types: str) -> str:
    link = _LINK.replace("bool_or(linkable)", f"atom_type IN ({types})")
    return f"(WITH RECURSIVE {link} SELECT count(DISTINCT label) FROM lab)"


@_query("component_policies", f"""SELECT 'context' AS policy, {_policy("'context'")} AS components UNION ALL SELECT 'primary', {_policy("'context', 'closing', 'edit_link'")} UNION ALL SELECT 'response', {_policy("'context', 'closing', 'edit_link', 'response'")}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, out = t.kept_atoms(spark, d), None
    for name, types in (("context", ["context"]), ("primary", ["context", "closing", "edit_link"]), ("response", ["context", "closing", "edit_link", "response"])):
        one = graph.components(a, types=types).agg(F.lit(name).alias("policy"), F.count_distinct("label").alias("components"))
        out = one if out is None else out.union(one)
    return out


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    labels, hashes = graph.components(t.kept_atoms(spark, d)), t.record_hashes(spark, d)
    labels = labels.join(graph.hashed_ids(labels, hashes), "label")
    folds = graph.component_folds(labels, t.records(spark, d))
    return labels.join(folds, "component_id").join(hashes, "record_id").select("record_id", "record_hash_id", "record_hash", "view", F.col("split").alias("original_split"), "component_id", "component_fold")


_FOLDS = f"""WITH RECURSIVE {_LINK}, {_WHOLE},
ci AS MATERIALIZED (SELECT label, sha256('["' || string_agg(record_hash_id, '","' ORDER BY record_hash_id) || '"]') AS component_id FROM lab JOIN hi USING (record_id) GROUP BY label),
vw AS MATERIALIZED (SELECT view, count(*) AS n FROM rec GROUP BY view),
sh AS MATERIALIZED (SELECT list(greatest(n / 20::DOUBLE, 1.0::DOUBLE) ORDER BY view) AS share, sum(n)::DOUBLE / 20::DOUBLE AS even, count(*)::INT AS views FROM vw),
cv AS (SELECT component_id, vw.view, count(rec.record_id) AS n FROM ci JOIN lab USING (label) CROSS JOIN vw LEFT JOIN rec ON rec.record_id = lab.record_id AND rec.view = vw.view GROUP BY ALL),
cw AS (SELECT component_id, sum(n)::BIGINT AS size, list(n::DOUBLE ORDER BY view) AS own FROM cv GROUP BY component_id),
co AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY size DESC, component_id) AS i FROM cw),
st AS (
  SELECT 0::BIGINT AS i, '' AS component_id, -1 AS fold, list_transform(range(0, 20), lambda f: 0.0::DOUBLE) AS filled, list_transform(range(0, 20), lambda f: list_transform(range(0, views), lambda v: 0.0::DOUBLE)) AS held FROM sh
  UNION ALL
  SELECT i, component_id, fold, list_transform(filled, lambda x, f: x + CASE WHEN f = fold + 1 THEN size ELSE 0 END), list_transform(held, lambda h, f: CASE WHEN f = fold + 1 THEN list_transform(h, lambda x, v: x + own[v]) ELSE h END)
  FROM (SELECT co.i, co.component_id, co.size, co.own, filled, held, list_min(list_transform(range(0, 20), lambda f: struct_pack(
      cost := ((filled[f + 1] + size - even) / even) * ((filled[f + 1] + size - even) / even) + list_sum(list_transform(range(1, views + 1), lambda v: CASE WHEN own[v] > 0 THEN ((held[f + 1][v] + own[v] - share[v]) / share[v]) * ((held[f + 1][v] + own[v] - share[v]) / share[v]) ELSE 0 END)),
      tie := sha256('20260725:' || co.component_id || ':' || f), fold := f))).fold::INT AS fold
    FROM st JOIN co ON co.i = st.i + 1 CROSS JOIN sh))
SELECT lab.record_id, record_hash_id, record_hash, rec.view, rec.split AS original_split, component_id, fold AS component_fold FROM st JOIN ci USING (component_id) JOIN lab USING (label) JOIN hi ON hi.record_id = lab.record_id JOIN rec ON rec.record_id = lab.record_id"""


@_query("component_folds", _FOLDS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d)


# --- ranks, splits, matching


@_query("dedup_records", f"WITH {_RECORDS}, {_WHOLE} SELECT DISTINCT view || ':' || sha256({_WS.format('text')}) AS content FROM hi")
def _(spark: SparkSession, d: str) -> DataFrame:
    from .functions.canonical import collapse_space

    r = t.read(spark, d, "documents").select("doc_id", "text").join(t.records(spark, d).withColumnRenamed("record_id", "doc_id"), "doc_id")
    return splits.dedup_by_hash(r.select(F.concat_ws(":", "view", F.sha2(collapse_space(F.col("text")), 256)).alias("content")), "content")


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    return t.contexts(spark, d)


@_query("one_per_context", f"WITH {_ATOMS}, c AS (SELECT record_id, value_hash AS context, row_number() OVER (PARTITION BY value_hash ORDER BY {_rank(7, repr('one'), 'record_id')}, record_id) AS n FROM atoms WHERE atom_type = 'context') SELECT context, record_id FROM c WHERE n = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splits.best_per(_contexts(spark, d).select("context", "record_id"), ["context"], F.struct(stable_rank(7, "one", F.col("record_id")), F.col("record_id")))


@_query("top_n_by_hash", f"WITH {_RECORDS} SELECT record_id, view FROM rec ORDER BY {_rank(7, repr('top'), 'record_id')} LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splits.top_by_hash(t.records(spark, d).select("record_id", "view"), stable_rank(7, "top", F.col("record_id")), 100)


@_query("hash_coin", f"WITH {_RECORDS} SELECT record_id, substr({_rank(0, repr('pair_orientation'), 'record_id')}, 16, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS reversed FROM rec")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.records(spark, d).select("record_id", is_odd(stable_rank(0, "pair_orientation", F.col("record_id")), 16).alias("reversed"))


@_query("oriented_pairs", f"""WITH {_ATOMS.replace("rec AS", "rec AS MATERIALIZED")}, o AS (SELECT *, substr({_rank(0, repr('pair_orientation'), 'record_id')}, 16, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS odd FROM fl)
  SELECT record_id, CASE WHEN odd THEN f ELSE l END AS response1, CASE WHEN odd THEN l ELSE f END AS response2, CASE WHEN odd THEN 1 ELSE -1 END AS overall_preference FROM o""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = t._documents(spark, d).select("record_id", orient(F.col("record_id"), F.col("last"), F.col("first")).alias("p"))
    return r.select("record_id", "p.response1", "p.response2", "p.overall_preference")


@_query("directed_edit_join", f"""WITH {_ATOMS}, x AS (SELECT v.record_id AS target_id, a.record_id AS donor_id FROM atoms v JOIN atoms a ON v.atom_type = 'edit_link' AND a.atom_type = 'edit_link' AND v.value_hash = a.value_hash AND v.split = 'validation' AND a.split = 'train'),
  y AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY {_rank(7, "'donor_for:' || target_id", "donor_id")}, donor_id) AS n FROM x),
  z AS (SELECT target_id, donor_id, row_number() OVER (PARTITION BY donor_id ORDER BY {_rank(7, repr('target'), 'target_id')}, target_id) AS m FROM y WHERE n = 1) SELECT target_id, donor_id FROM z WHERE m = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = t.atoms(spark, d).where("atom_type = 'edit_link'")
    return splits.donors(a.where("split = 'validation'").select(F.col("record_id").alias("target_id"), "value_hash"), a.where("split = 'train'").select(F.col("record_id").alias("donor_id"), "value_hash"), "value_hash", seed=7)


@_query("strict_clean_anti_join", f"WITH {_ATOMS} SELECT record_id FROM atoms v WHERE atom_type = 'context' AND split = 'validation' AND NOT EXISTS (SELECT 1 FROM atoms x WHERE x.split = 'train' AND x.atom_type = 'context' AND x.value_hash = v.value_hash)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _contexts(spark, d)
    return splits.strict_clean(c.where("split = 'validation'").select("record_id", "context"), (c.where("split = 'train'"), "context")).select("record_id")


_STRATA = f"""st AS (SELECT record_id, split, domain || '|' || CASE WHEN length(text) <= 1000 THEN 'le1000' WHEN length(text) <= 3000 THEN 'le3000' WHEN length(text) <= 8000 THEN 'le8000' ELSE 'gt8000' END AS stratum, text FROM rec),
cap AS (SELECT stratum, least(count(*) FILTER (WHERE split = 'validation'), floor(count(*) FILTER (WHERE split = 'train') / 2))::BIGINT AS capacity FROM st GROUP BY stratum)"""


def _strata(spark: SparkSession, d: str) -> DataFrame:
    r = t._documents(spark, d)
    half = F.array(F.log1p(F.length("first").cast("double")), F.log1p(F.length("text").cast("double")))
    return r.select("record_id", F.col("record_id").alias("id"), "split", F.concat_ws("|", "domain", length_bin(F.length("text"))).alias("stratum"), half.alias("features"))


def _capacities(spark: SparkSession, d: str) -> DataFrame:
    s = _strata(spark, d)
    return splits.capacities(s.where("split = 'validation'"), s.where("split = 'train'"))


@_query("stratum_capacities", f"WITH {_RECORDS}, {_STRATA} SELECT * FROM cap")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _capacities(spark, d)


@_query("stratum_quotas", f"""WITH {_RECORDS}, {_STRATA}, q AS (SELECT *, 20 * capacity / sum(capacity) OVER ()::DOUBLE AS raw FROM cap WHERE capacity > 0),
  o AS (SELECT *, row_number() OVER (ORDER BY raw - floor(raw) DESC, capacity DESC, stratum) AS n, 20 - sum(floor(raw)) OVER () AS rest FROM q)
  SELECT stratum, capacity, least(capacity, floor(raw)::BIGINT + (n <= rest)::BIGINT)::BIGINT AS quota FROM o""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splits.quotas(_capacities(spark, d), 20)


@_query("nearest_clean_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _strata(spark, d)
    return splits.nearest_pairs(s.where("split = 'validation'").select("id", "stratum", "features"), s.where("split = 'train'").select("id", "stratum", "features"), splits.quotas(_capacities(spark, d), 20), seed=7)


_SLOTS = f"""sl AS (SELECT record_id AS id, CASE WHEN split = 'train' THEN 'base' ELSE 'boundary' END AS kind FROM rec),
so AS (SELECT id, kind, row_number() OVER (ORDER BY {_rank(7, "'slot:' || kind", "id")}) - 1 AS position, count(*) OVER () AS n FROM sl)"""


def _slots(spark: SparkSession, d: str) -> DataFrame:
    r = t.records(spark, d).withColumnRenamed("record_id", "id")
    return splits.slots(r.where("split = 'train'"), r.where("split = 'validation'"), seed=7)


@_query("train_slots", f"WITH {_RECORDS}, {_SLOTS} SELECT id, kind, position FROM so")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _slots(spark, d)


@_query("boundary_counts", f"WITH {_RECORDS}, {_SLOTS} SELECT (least(5, floor(position * 5 / n) + 1) * 20)::INT AS percent, count(*) AS boundary_rows FROM so WHERE kind = 'boundary' GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splits.boundary_counts(_slots(spark, d), t.records(spark, d).count())


@_query("context_crossings", f"""WITH {_ATOMS}, s AS (SELECT DISTINCT split || ':' || view AS s, value_hash FROM atoms WHERE atom_type = 'context') SELECT a.s AS left_set, b.s AS right_set, count(*) AS shared FROM s a JOIN s b ON a.value_hash = b.value_hash AND a.s < b.s GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return splits.crossings(_contexts(spark, d).select(F.concat_ws(":", "split", "view").alias("set_name"), F.col("context").alias("value")))


@_query("total_variation", f"""WITH {_RECORDS}, {_STRATA}, n AS (SELECT stratum, count(*) FILTER (WHERE split = 'train') AS l, count(*) FILTER (WHERE split <> 'train') AS r FROM st GROUP BY ALL)
  SELECT round(sum(abs(l / (SELECT sum(l) FROM n)::DOUBLE - r / (SELECT sum(r) FROM n)::DOUBLE)) / 2, 9) AS total_variation FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _strata(spark, d)
    return _round(splits.total_variation(s.where("split = 'train'"), s.where("split <> 'train'"), "stratum"), "total_variation")


@_query("smd", f"""WITH {_RECORDS}, v AS (SELECT ln(1 + length(text)::DOUBLE) AS x, split = 'train' AS l FROM rec) SELECT round((avg(x) FILTER (WHERE l) - avg(x) FILTER (WHERE NOT l)) / sqrt((var_samp(x) FILTER (WHERE l) + var_samp(x) FILTER (WHERE NOT l)) / 2), 9) AS smd FROM v""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = t._documents(spark, d).select("split", F.log1p(F.length("text").cast("double")).alias("x"))
    return _round(splits.standardized_mean_difference(r, "x", F.col("split") == "train"), "smd")


@_query("prefix_sizes", f"WITH {_RECORDS}, n AS (SELECT count(*) AS n FROM rec) SELECT f AS fraction, round_even(n * f, 0)::INT AS rows FROM n, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) v(f)")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = t.records(spark, d).count()
    return spark.createDataFrame([(f,) for f in t.FRACTIONS], "fraction double").select("fraction", prefix_size(n, F.col("fraction")).alias("rows"))


# --- effects


@_query("predictions", f"WITH {_PRED} SELECT model, seed, boundary, fraction, evaluation_set, pair_id, domain, position, label, margin, correct FROM p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return t.predictions(spark, d)


@_query("accuracy_cells", f"""WITH {_PRED} SELECT model, seed, boundary, fraction, evaluation_set, count(*) AS n, round(avg(correct), 9) AS accuracy, round(avg(margin), 9) AS margin_mean, round(stddev_samp(margin), 9) AS margin_std, round(avg((margin > 0)::INT), 9) AS positive_margin_rate FROM p GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.accuracy_cells(t.predictions(spark, d)), "accuracy", "margin_mean", "margin_std", "positive_margin_rate")


@_query("metric_block", f"""WITH {_PRED} SELECT model, seed, boundary, fraction, evaluation_set, count(*) AS n, sum(correct)::BIGINT AS k, round(median(margin), 9) AS margin_median, count(DISTINCT round_even(margin, 4)) AS distinct_margins, stddev_samp(margin) >= 0.05 AND count(DISTINCT round_even(margin, 4)) >= 10 AS noncollapsed FROM p GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.collapse_block(t.predictions(spark, d)).select("model", "seed", "boundary", "fraction", "evaluation_set", "n", "k", "margin_median", "distinct_margins", "noncollapsed"), "margin_median")


@_query("auroc", f"""WITH {_PRED}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY model, seed, boundary, fraction, evaluation_set, margin) - 1) / 2.0::DOUBLE AS rk FROM p WINDOW w AS (PARTITION BY model, seed, boundary, fraction, evaluation_set ORDER BY margin))
  SELECT model, seed, boundary, fraction, evaluation_set, CASE WHEN sum(label) * (count(*) - sum(label)) > 0 THEN round((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label)))::DOUBLE, 9) END AS auroc FROM r GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.auroc(t.predictions(spark, d), ["model", "seed", "boundary", "fraction", "evaluation_set"]), "auroc")


@_query("paired_gap", f"WITH {_PRED} SELECT model, seed, fraction, evaluation_set, round(avg(delta), 9) AS gap, count(*) AS pairs FROM dl GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.paired_gaps(t.predictions(spark, d)), "gap")


_DS = f"{_PRED}, ds AS (SELECT model, seed, fraction, avg(delta) FILTER (WHERE evaluation_set = 'target') - avg(delta) FILTER (WHERE evaluation_set = 'clean') AS did FROM dl GROUP BY ALL)"


@_query("did_by_seed", f"WITH {_DS} SELECT model, seed, fraction, round(did, 9) AS did FROM ds")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.did_by_seed(effects.paired(t.predictions(spark, d))), "did")


@_query("did", f"WITH {_DS} SELECT model, fraction, round(avg(did), 9) AS did FROM ds GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.did(effects.paired(t.predictions(spark, d))), "did")


@_query("seed_representatives", f"WITH {_PRED}, g AS (SELECT model, seed, md5(string_agg(correct::VARCHAR, '' ORDER BY boundary, fraction, evaluation_set, pair_id)) AS h FROM p GROUP BY ALL) SELECT model, min(seed) AS representative, count(*) AS seeds FROM g GROUP BY model, h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return effects.seed_representatives(t.predictions(spark, d))


@_query("interaction", f"WITH {_DS} SELECT fraction, round(avg(did) FILTER (WHERE model = 'word') - avg(did) FILTER (WHERE model = 'char'), 9) AS interaction FROM ds GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.interactions(effects.paired(t.predictions(spark, d)), "word", "char"), "interaction")


@_query("selection_regret", f"""WITH {_PRED}, ac AS (SELECT model, seed, fraction, evaluation_set AS s, avg(correct) AS a FROM p WHERE boundary = 'naive' GROUP BY ALL), pk AS (SELECT *, row_number() OVER (PARTITION BY model, seed, s ORDER BY a DESC, fraction) AS n FROM ac)
  SELECT x.model, round(avg(u.a - v.a), 9) AS regret FROM pk x JOIN pk y ON x.model = y.model AND x.seed = y.seed AND x.s = 'target' AND y.s = 'clean' AND x.n = 1 AND y.n = 1 JOIN ac u ON u.model = x.model AND u.seed = x.seed AND u.fraction = x.fraction AND u.s = 'untouched'
  JOIN ac v ON v.model = y.model AND v.seed = y.seed AND v.fraction = y.fraction AND v.s = 'untouched' GROUP BY x.model""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.selection_regret(t.predictions(spark, d)), "regret")


@_query("arrival_contrast", f"""WITH {_PRED}, c AS (SELECT model, fraction, seed, avg(delta) FILTER (WHERE position < fraction) - avg(delta) FILTER (WHERE position >= fraction) AS c FROM dl WHERE evaluation_set = 'target' AND fraction < 1 GROUP BY ALL) SELECT model, fraction, round(avg(c), 9) AS contrast FROM c GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.arrival_contrast(_deltas(spark, d)), "contrast")


@_query("arrival_counts", f"WITH {_PRED} SELECT f AS fraction, count(*) FILTER (WHERE position < f) AS arrived, count(*) AS items FROM (SELECT DISTINCT pair_id, position FROM p WHERE evaluation_set = 'target'), (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE)) v(f) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d).where("evaluation_set = 'target'").select("pair_id", "position").distinct()
    return effects.arrival_counts(p, t.FRACTIONS[:4])


@_query("placebo_positions", f"""WITH {_PRED}, i AS (SELECT DISTINCT pair_id, evaluation_set, position FROM p), c AS (SELECT pair_id, row_number() OVER (ORDER BY {_rank(7, repr('placebo'), 'pair_id')}) AS n FROM i WHERE evaluation_set = 'clean'), g AS (SELECT position, row_number() OVER (ORDER BY {_rank(7, repr('placebo'), 'pair_id')}) AS n FROM i WHERE evaluation_set = 'target')
  SELECT pair_id, position FROM c JOIN g USING (n)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d).select("pair_id", "evaluation_set", "position").distinct()
    rank = stable_rank(7, "placebo", F.col("pair_id"))
    c, g = (splits.numbered(p.where(F.col("evaluation_set") == s), rank, "n") for s in ("clean", "target"))
    return c.select("pair_id", "n").join(g.select("position", "n"), "n").select("pair_id", "position")


@_query("event_bins", f"""WITH {_PRED}, e AS (SELECT model, delta, greatest(-0.799999::DOUBLE, least(0.799999::DOUBLE, fraction - position)) AS v FROM dl WHERE evaluation_set = 'target')
  SELECT model, (v >= -0.4::DOUBLE)::INT + (v >= -0.1::DOUBLE)::INT + (v >= 0.1::DOUBLE)::INT + (v >= 0.4::DOUBLE)::INT AS bin, round(avg(delta), 9) AS effect, count(*) AS n FROM e GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _deltas(spark, d).where("evaluation_set = 'target'")
    return _round(effects.event_effects(e, event_bin(F.col("fraction") - F.col("position")), ["model"]), "effect")


@_query("mcnemar_counts", f"""WITH {_PRED}, w AS (SELECT model, evaluation_set, seed, fraction, pair_id, max(correct) FILTER (WHERE boundary = 'naive') AS a, max(correct) FILTER (WHERE boundary = 'safe') AS b FROM p GROUP BY ALL)
  SELECT model, evaluation_set, count(*) FILTER (WHERE a = 1 AND b = 1) AS "both", count(*) FILTER (WHERE a = 1 AND b = 0) AS naive_only, count(*) FILTER (WHERE a = 0 AND b = 1) AS safe_only, count(*) FILTER (WHERE a = 0 AND b = 0) AS neither FROM w GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return effects.discordance(t.predictions(spark, d), ["model", "evaluation_set"])


@_query("trajectory_auc", f"""WITH {_DS}, m AS (SELECT model, fraction, avg(did) AS did FROM ds GROUP BY ALL), l AS (SELECT *, (fraction - lag(fraction) OVER w) * (did + lag(did) OVER w) / 2 AS area FROM m WINDOW w AS (PARTITION BY model ORDER BY fraction))
  SELECT model, round(sum(area), 9) AS auc, round(sum(area) / (max(fraction) - min(fraction)), 9) AS mean_height, min(fraction) FILTER (WHERE did >= 0.05) AS first_at_5_points FROM l GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(effects.trajectories(effects.did(effects.paired(t.predictions(spark, d)))), "auc", "mean_height")


@_query("model_rankings", f"""WITH {_PRED}, c AS (SELECT model, seed, boundary, fraction, evaluation_set, avg(correct) AS a FROM p GROUP BY ALL), m AS (SELECT boundary, fraction, evaluation_set, model, round(avg(a), 9) AS accuracy FROM c GROUP BY ALL)
  SELECT *, rank() OVER (PARTITION BY boundary, fraction, evaluation_set ORDER BY accuracy DESC)::INT AS rank FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return effects.model_rankings(effects.accuracy_cells(t.predictions(spark, d)))


@_query("did_pivot", f"WITH {_PRED} SELECT model, fraction, {', '.join(f"round(avg(correct) FILTER (WHERE evaluation_set = '{s}' AND boundary = '{b}'), 9) AS {s}_{b}" for s in ('target', 'clean') for b in ('naive', 'safe'))} FROM p GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{s}_{b}" for s in ("target", "clean") for b in ("naive", "safe")]
    cells = t.predictions(spark, d).groupBy("model", "fraction", "evaluation_set", "boundary").agg(F.avg("correct").alias("a"))
    return _round(effects.wide(cells, ["model", "fraction"], ["evaluation_set", "boundary"], "a", names), *names)


# --- resampling, natively

_B = 200


def _boot(which: str, seed: int, ns: str, source: str, order: str, b: int = _B) -> str:
    h = _rank(seed, f"'{ns}'", "r || ':' || slot")
    return f"""{which}i AS MATERIALIZED (SELECT {order} AS item, row_number() OVER (ORDER BY {order}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {order} FROM {source})),
{which}t AS MATERIALIZED (SELECT r, item, count(*) AS times FROM (SELECT r, {_number(h)} % n AS i FROM (SELECT i AS slot, n FROM {which}i), range({b}) v(r)) JOIN {which}i USING (i) GROUP BY ALL)"""


_DID_BOOT = f"""{_PRED}, {_boot('g', 1, 'boot:target', "dl WHERE evaluation_set = 'target'", 'pair_id')}, {_boot('c', 1, 'boot:clean', "dl WHERE evaluation_set = 'clean'", 'pair_id')}, {_boot('s', 1, 'boot:seed', 'dl', 'seed')},
gm AS (SELECT r, model, seed, fraction, sum(delta * times) / sum(times) AS m FROM dl JOIN gt ON item = pair_id WHERE evaluation_set = 'target' GROUP BY ALL),
cm AS (SELECT r, model, seed, fraction, sum(delta * times) / sum(times) AS m FROM dl JOIN ct ON item = pair_id WHERE evaluation_set = 'clean' GROUP BY ALL),
bt AS (SELECT gm.r AS replicate, gm.model, gm.fraction, sum((gm.m - cm.m) * times) / sum(times) AS did FROM gm JOIN cm USING (r, model, seed, fraction) JOIN st ON st.r = gm.r AND st.item = gm.seed GROUP BY ALL)"""


@_query("bootstrap_did_native", f"WITH {_DID_BOOT} SELECT replicate::INT AS replicate, model, fraction, round(did, 9) AS did FROM bt")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.did_bootstrap(effects.paired(t.predictions(spark, d)), _B), "did")


@_query("bootstrap_intervals", f"WITH {_DID_BOOT} SELECT model, fraction, round(quantile_cont(did, 0.025), 9) AS low, round(quantile_cont(did, 0.975), 9) AS high FROM bt GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.intervals(resample.did_bootstrap(effects.paired(t.predictions(spark, d)), _B), ["model", "fraction"], "did"), "low", "high")


@_query("sign_randomization_native", f"""WITH {_PRED}, m AS (SELECT model, fraction, evaluation_set AS s, pair_id, avg(delta) AS delta FROM dl WHERE evaluation_set IN ('target', 'clean') GROUP BY ALL),
  x AS (SELECT *, CASE WHEN substr({_rank(3, repr('sign'), "r || ':' || s || ':' || pair_id")}, 1, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN -delta ELSE delta END AS v FROM m, range({_B}) t(r)),
  w AS (SELECT model, fraction, r, avg(v) FILTER (WHERE s = 'target') - avg(v) FILTER (WHERE s = 'clean') AS draw FROM x GROUP BY ALL), o AS (SELECT model, fraction, avg(delta) FILTER (WHERE s = 'target') - avg(delta) FILTER (WHERE s = 'clean') AS observed FROM m GROUP BY ALL)
  SELECT model, fraction, round(observed, 9) AS observed, (count(*) FILTER (WHERE abs(draw) >= abs(observed) - 1e-12) + 1) / (count(*) + 1) AS p FROM w JOIN o USING (model, fraction) GROUP BY model, fraction, observed""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.sign_randomization(effects.paired(t.predictions(spark, d)), _B), "observed")


@_query("permutation_arrival_native", f"""WITH {_PRED}, it AS (SELECT DISTINCT pair_id, position FROM dl WHERE evaluation_set = 'target' AND fraction < 1), rr AS (SELECT r, pair_id, position, row_number() OVER (PARTITION BY r ORDER BY {_rank(4, repr('perm'), "r || ':' || pair_id")}, pair_id) AS a, row_number() OVER (PARTITION BY r ORDER BY position, pair_id) AS b FROM it, range({_B}) t(r)),
  de AS (SELECT x.r, x.pair_id, y.position AS p FROM rr x JOIN rr y ON x.r = y.r AND x.a = y.b UNION ALL SELECT -1, pair_id, position FROM it),
  cc AS (SELECT r, model, seed, fraction, avg(delta) FILTER (WHERE p < fraction) - avg(delta) FILTER (WHERE p >= fraction) AS c FROM dl JOIN de USING (pair_id) WHERE evaluation_set = 'target' AND fraction < 1 GROUP BY ALL), mm AS (SELECT r, model, avg(c) AS c FROM cc GROUP BY ALL)
  SELECT mm.model, round(o.c, 9) AS observed, (count(*) FILTER (WHERE abs(mm.c) >= abs(o.c) - 1e-12) + 1) / (count(*) + 1) AS p FROM mm JOIN mm o ON o.model = mm.model AND o.r = -1 WHERE mm.r >= 0 GROUP BY mm.model, o.c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.position_permutation(_deltas(spark, d), _B), "observed")


_CAND = f"""{_PRED}, cd AS (SELECT pair_id, model || seed AS candidate, avg(correct) AS correct FROM p WHERE boundary = 'naive' AND fraction = 1 AND evaluation_set = 'untouched' GROUP BY ALL)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d).where("boundary = 'naive' and fraction = 1 and evaluation_set = 'untouched'")
    return p.groupBy("pair_id", F.concat("model", F.col("seed").cast("string")).alias("candidate")).agg(F.avg("correct").alias("correct"))


@_query("winner_probabilities", f"""WITH {_CAND}, {_boot('w', 5, 'boot:winner', 'cd', 'pair_id')}, m AS (SELECT r, candidate, round_even(sum(correct * times) / sum(times), 12) AS m FROM cd JOIN wt ON item = pair_id GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY m DESC, candidate) AS n FROM m)
  SELECT candidate, count(*) / {_B} AS probability FROM k WHERE n = 1 GROUP BY candidate""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resample.winner_probabilities(_candidates(spark, d), _B)


@_query("winner_regions", f"""WITH {_PRED}, ln AS MATERIALIZED (SELECT model || seed AS candidate, avg(correct) FILTER (WHERE boundary = 'safe' AND evaluation_set = 'target') AS clean, avg(correct) FILTER (WHERE boundary = 'naive' AND evaluation_set = 'target') AS exposed FROM p WHERE fraction = 1 GROUP BY ALL),
  xx AS (SELECT DISTINCT x FROM (SELECT (a.clean - b.clean) / nullif((b.exposed - b.clean) - (a.exposed - a.clean), 0) AS x FROM ln a JOIN ln b ON a.candidate < b.candidate) WHERE x > 0 AND x < 1 UNION SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE])),
  ct AS (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM xx), wn AS (SELECT x, y, candidate, row_number() OVER (PARTITION BY x, y ORDER BY clean + (x + y) / 2 * (exposed - clean) DESC, candidate) AS n FROM ct, ln WHERE y IS NOT NULL),
  gr AS (SELECT x, y, candidate, sum(o) OVER (ORDER BY x) AS g FROM (SELECT *, CASE WHEN candidate = lag(candidate) OVER (ORDER BY x) THEN 0 ELSE 1 END AS o FROM wn WHERE n = 1))
  SELECT candidate, round(min(x), 9) AS "left", round(max(y), 9) AS "right" FROM gr GROUP BY g, candidate""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d).where("fraction = 1")
    of = lambda b: F.avg(F.when((F.col("boundary") == b) & (F.col("evaluation_set") == "target"), F.col("correct")))
    return _round(effects.winner_regions(p.groupBy(F.concat("model", F.col("seed").cast("string")).alias("candidate")).agg(of("safe").alias("clean"), of("naive").alias("exposed"))), "left", "right")


# --- the extractor and the hashes of whole JSON records


def _as_json(spark: SparkSession, d: str) -> DataFrame:
    return t._documents(spark, d).select("record_id", F.to_json(F.struct("first", "last", "lines", "text")).alias("raw_json"), F.to_json(F.struct(F.col("domain").alias("lang"), "source", "text")).alias("whole"))


@_query("extracted_atoms", rf"""WITH {_ATOMS}, lq AS (SELECT *, list_transform(ls, lambda x: {_Q.format(_WS.format("x"))}) AS qs FROM fl)
  SELECT record_id, 'record' AS atom_type, sha256('{{"first":' || {_Q.format("f")} || ',"last":' || {_Q.format("l")} || ',"lines":[' || array_to_string(qs, ',') || '],"text":' || {_Q.format("w")} || '}}') AS value_hash, '__record__' AS field, true AS linkable FROM lq
  UNION ALL SELECT record_id, 'context', sha256({_Q.format("f")}), 'first', true FROM fl WHERE f <> '' UNION ALL SELECT record_id, 'response', sha256({_Q.format("w")}), 'text', false FROM fl WHERE w <> ''
  UNION ALL SELECT record_id, 'feedback', value_hash, replace(field, 'feedback', 'lines'), false FROM atoms WHERE atom_type = 'feedback' UNION ALL SELECT record_id, 'edit_link', value_hash, field, true FROM atoms WHERE atom_type = 'edit_link'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = Mapping(context="first", context_else=None, responses=("text",), feedback=("lines",), principle=None, edits=(("first", "last"),))
    return exploded(with_atoms(_as_json(spark, d), m), "record_id")


@_query("json_record_hashes", f"""WITH {_RECORDS}, {_WHOLE} SELECT record_id, record_hash, sha256('{{"lang":' || to_json(domain)::VARCHAR || ',"source":' || to_json(source)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}}') AS literal_hash FROM hs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _as_json(spark, d).select("record_id", record_hash(F.col("whole")).alias("record_hash"), literal_record_hash(F.col("whole")).alias("literal_hash"))


# --- donors, training files, pairs made again


_DONORS = rf"""{_ATOMS.replace("fl AS", "fl AS MATERIALIZED")},
tg AS (SELECT record_id AS target_id, f, l FROM fl WHERE split = 'validation' AND f <> '' AND l <> ''),
pl AS (SELECT DISTINCT record_id AS donor_id, f, unnest([f, l]) AS r FROM fl WHERE split = 'train' AND f <> '' AND l <> ''),
dn AS MATERIALIZED (SELECT target_id, count(DISTINCT donor_id) AS donors, CASE WHEN count(DISTINCT donor_id) = 1 THEN min(donor_id) END AS donor_id FROM tg LEFT JOIN pl ON pl.f = tg.f AND pl.r = tg.l GROUP BY target_id)"""


def _donor_candidates(spark: SparkSession, d: str) -> DataFrame:
    r = t._documents(spark, d).where("first <> '' and last <> ''")
    targets = r.where("split = 'validation'").select(F.col("record_id").alias("target_id"), F.col("first").alias("context"), F.col("last").alias("preferred"))
    pool = r.where("split = 'train'").select(F.col("record_id").alias("donor_id"), F.col("first").alias("context"), F.col("first").alias("response1"), F.col("last").alias("response2"))
    return recovery.donor_candidates(targets, pool)


@_query("exact_donor_candidates", f"WITH {_DONORS} SELECT target_id, donors, donor_id FROM dn")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _donor_candidates(spark, d)


@_query("donor_positions", f"""WITH {_DONORS}, od AS (SELECT min(target_id) AS target_id, donor_id FROM dn WHERE donors = 1 GROUP BY donor_id HAVING count(*) = 1),
  fi AS (SELECT seed, record_id AS donor_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || chr(0) || 'file' || chr(0) || record_id)) - 1 AS position FROM rec, (VALUES (1), (2), (3)) s(seed) WHERE split = 'train')
  SELECT seed, target_id, position FROM od JOIN fi USING (donor_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    donors = _donor_candidates(spark, d).where("donors = 1").groupBy("donor_id").agg(F.min("target_id").alias("target_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    train = t.records(spark, d).where("split = 'train'").select(F.col("record_id").alias("id"))
    files = [splits.numbered(train, stable_rank(seed, "file", F.col("id")), "position").withColumn("seed", F.lit(seed)) for seed in (1, 2, 3)]
    return recovery.donor_positions(donors, files[0].unionByName(files[1]).unionByName(files[2]))


_FILES = f"""{_RECORDS}, {_SLOTS}, bs AS (SELECT position, row_number() OVER (ORDER BY position) AS n FROM so WHERE kind = 'boundary'),
xd AS (SELECT record_id AS d, row_number() OVER (ORDER BY {_rank(7, repr('donor'), 'record_id')}) AS n FROM rec WHERE split <> 'train'), xf AS (SELECT record_id AS f, row_number() OVER (ORDER BY {_rank(7, repr('filler'), 'record_id')}) AS n FROM rec WHERE split <> 'train'),
fs AS (SELECT so.position, kind, coalesce(d, id) AS naive_id, coalesce(f, id) AS safe_id FROM so LEFT JOIN bs ON bs.position = so.position LEFT JOIN xd ON xd.n = bs.n LEFT JOIN xf ON xf.n = bs.n)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    other = t.records(spark, d).where("split <> 'train'").select(F.col("record_id").alias("id"))
    return recovery.train_files(_slots(spark, d), *(splits.numbered(other, stable_rank(7, n, F.col("id")), "n") for n in ("donor", "filler")))


@_query("train_files", f"WITH {_FILES} SELECT position, kind, naive_id, safe_id FROM fs")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d)


@_query("train_file_differences", f"WITH {_FILES} SELECT position, naive_id AS left_id, safe_id AS right_id FROM fs WHERE naive_id <> safe_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return recovery.row_differences(f.select("position", F.col("naive_id").alias("id")), f.select("position", F.col("safe_id").alias("id")))


@_query("rebuilt_train_file", f"""WITH {_FILES}, nb AS (SELECT record_id AS id, row_number() OVER (ORDER BY {_rank(8, repr('base'), 'record_id')}) AS n FROM rec WHERE split = 'train'), ob AS (SELECT position, row_number() OVER (ORDER BY position) AS n FROM so WHERE kind = 'base')
  SELECT fs.position, kind, coalesce(nb.id, naive_id) AS id FROM fs LEFT JOIN ob ON ob.position = fs.position LEFT JOIN nb ON nb.n = ob.n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = t.records(spark, d).where("split = 'train'").select(F.col("record_id").alias("id"))
    return recovery.rebuilt(_files(spark, d).select("position", "kind", F.col("naive_id").alias("id")), splits.numbered(base, stable_rank(8, "base", F.col("id")), "n"))


_PAIRED = f"""{_ATOMS.replace("fl AS", "fl AS MATERIALIZED")}, {_WHOLE},
ep AS (SELECT record_hash AS pair_id, f AS context, l AS better, f AS worse, domain, 'unknown' AS language, f AS original_response, [l] AS feedback, substr({_rank(0, repr('pair_orientation'), 'record_hash')}, 16, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') AS odd
  FROM (SELECT DISTINCT record_hash, f, l, domain FROM (SELECT DISTINCT ON (record_hash) record_hash, hs.record_id, fl.f, fl.l, hs.domain FROM hs JOIN fl USING (record_id) WHERE fl.f <> '' AND fl.l <> '' ORDER BY record_hash, hs.record_id))),
pr AS (SELECT pair_id, context, CASE WHEN odd THEN worse ELSE better END AS response1, CASE WHEN odd THEN better ELSE worse END AS response2, CASE WHEN odd THEN 1 ELSE -1 END AS overall_preference, domain, language, original_response, feedback FROM ep)"""
_PAIR_COLUMNS = "pair_id, '{}' AS source_view, context, response1, response2, overall_preference, domain, language"
_CONSTRUCT = "original_response, array_to_string(feedback, '|') AS feedback, 'context|original_response|feedback|candidate_edit' AS construct_fields"


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records of the edit views: the last line edits the first one. One record a hash."""
    r = t._documents(spark, d).where("first <> '' and last <> ''").join(t.record_hashes(spark, d).select("record_id", "record_hash"), "record_id")
    r = splits.best_per(r.select("record_hash", "record_id", "first", "last", "domain"), ["record_hash"], F.col("record_id"))
    return r.select(
        "record_hash", F.col("first").alias("context"), F.col("first").alias("original_response"), F.col("last").alias("edited_response"), F.col("last").alias("good_edited_response"), F.col("first").alias("bad_edited_response"),
        F.array("last").alias("feedback"), "domain", F.lit(None).cast("string").alias("language"),
    )


def _flat(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({c: F.array_join(c, "|") for c in ("feedback", "construct_fields")})


@_query("edit_training_pairs", f"WITH {_PAIRED} SELECT {_PAIR_COLUMNS.format('edit')} FROM pr")
def _(spark: SparkSession, d: str) -> DataFrame:
    return recovery.edit_training_pairs(_sources(spark, d))


@_query("enriched_quality_pairs", f"WITH {_PAIRED} SELECT {_PAIR_COLUMNS.format('edit_quality')}, {_CONSTRUCT} FROM pr")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _flat(recovery.enriched_quality_pairs(_sources(spark, d)))


@_query("recovered_pairs", f"WITH {_PAIRED} SELECT {_PAIR_COLUMNS.format('edit')}, {_CONSTRUCT} FROM pr")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _sources(spark, d)
    return _flat(recovery.recovered(recovery.edit_training_pairs(s), s, "edit"))


_MIX = f"""{_LINK}, cx AS (SELECT record_id AS id, value_hash AS context, label AS component, split, view FROM atoms JOIN lab USING (record_id) WHERE atom_type = 'context'),
ms AS (SELECT * FROM cx WHERE split = 'train' AND view = 'v3'), mr AS (SELECT *, row_number() OVER (PARTITION BY component, context ORDER BY {_rank(7, repr('within_component'), 'id')}, id) AS n FROM cx x WHERE split = 'train' AND view <> 'v3'
  AND NOT EXISTS (SELECT 1 FROM cx e WHERE e.split = 'validation' AND e.view = 'v0' AND e.component = x.component) AND NOT EXISTS (SELECT 1 FROM cx e WHERE e.split = 'validation' AND e.context = x.context)),
md AS MATERIALIZED (SELECT id, component, context FROM mr WHERE n = 1 AND component NOT IN (SELECT component FROM ms) ORDER BY {_rank(7, repr('development'), 'id')} LIMIT 5),
mb AS (SELECT id, component, context FROM mr WHERE n = 1 AND component NOT IN (SELECT component FROM md) ORDER BY {_rank(7, repr('training'), 'id')} LIMIT 10), mk AS (SELECT id, component, context FROM ms ORDER BY {_rank(7, repr('retained'), 'id')} LIMIT 10)"""
_MIX = _MIX.replace("mb AS (SELECT id", "mt AS (SELECT id")


@_query("disjoint_mixture", f"WITH RECURSIVE {_MIX} SELECT 'development' AS part, * FROM md UNION ALL SELECT 'base', * FROM mt UNION ALL SELECT 'retained', * FROM mk")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = _contexts(spark, d).join(cut(graph.components(t.kept_atoms(spark, d)), "labels"), "record_id").select(F.col("record_id").alias("id"), F.col("label").alias("component"), "context", "split", "view")
    train, held = c.where("split = 'train'"), c.where("split = 'validation'")
    parts = splits.disjoint_mixture(train.where("view <> 'v3'"), train.where("view = 'v3'"), excluded=held.where("view = 'v0'"), contexts=held, development=5, base=10, retained=10, seed=7)
    named = [p.select(F.lit(name).alias("part"), "id", "component", "context") for name, p in zip(("development", "base", "retained"), parts, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- candidates, policies and arrivals, resampled


_CANDIDATES = f"""{_PRED}, cv AS MATERIALIZED (SELECT pair_id, evaluation_set, model || seed AS candidate, avg(correct) AS correct FROM p WHERE boundary = 'naive' AND fraction = 1 GROUP BY ALL),
cs AS (SELECT candidate, round(avg(correct) FILTER (WHERE evaluation_set = 'target'), 12) AS exposed_accuracy, round(avg(correct) FILTER (WHERE evaluation_set = 'clean'), 12) AS clean_accuracy FROM cv GROUP BY candidate),
cr AS (SELECT *, row_number() OVER (ORDER BY exposed_accuracy DESC, candidate)::INT AS exposed_rank, row_number() OVER (ORDER BY clean_accuracy DESC, candidate)::INT AS clean_rank FROM cs)"""
_CANDIDATE_BOOT = f"""{_CANDIDATES}, {_boot('g', 6, 'boot:exposed', "cv WHERE evaluation_set = 'target'", 'pair_id')}, {_boot('c', 6, 'boot:clean', "cv WHERE evaluation_set = 'clean'", 'pair_id')},
ge AS (SELECT r, candidate, round_even(sum(correct * times) / sum(times), 12) AS exposed FROM cv JOIN gt ON item = pair_id WHERE evaluation_set = 'target' GROUP BY ALL), ce AS (SELECT r, candidate, round_even(sum(correct * times) / sum(times), 12) AS clean FROM cv JOIN ct ON item = pair_id WHERE evaluation_set = 'clean' GROUP BY ALL),
cm AS MATERIALIZED (SELECT r, candidate, exposed, clean FROM ge JOIN ce USING (r, candidate))"""


def _candidate_values(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d).where("boundary = 'naive' and fraction = 1")
    return p.groupBy("pair_id", "evaluation_set", F.concat("model", F.col("seed").cast("string")).alias("candidate")).agg(F.avg("correct").alias("correct"))


@_query("candidate_summary", f"WITH {_CANDIDATES} SELECT * FROM cr")
def _(spark: SparkSession, d: str) -> DataFrame:
    return effects.candidate_summary(_candidate_values(spark, d))


@_query("endpoint_stability", f"""WITH {_CANDIDATE_BOOT}, w AS (SELECT 'exposed' AS criterion, r, candidate, row_number() OVER (PARTITION BY r ORDER BY exposed DESC, candidate) AS n FROM cm UNION ALL SELECT 'clean', r, candidate, row_number() OVER (PARTITION BY r ORDER BY clean DESC, candidate) FROM cm)
  SELECT criterion, candidate, (count(*) FILTER (WHERE n = 1)) / {_B} AS winner_probability, any_value(CASE WHEN criterion = 'exposed' THEN exposed_rank ELSE clean_rank END) = 1 AS observed_winner FROM w JOIN cr USING (candidate) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = _candidate_values(spark, d)
    return resample.endpoint_stability(resample.candidate_means(v, _B), effects.candidate_summary(v), _B)


@_query("weighted_winners", f"""WITH {_CANDIDATE_BOOT}, x AS (SELECT r, i / 100::DOUBLE AS exposed_weight, candidate, round_even(i / 100::DOUBLE * exposed + (1 - i / 100::DOUBLE) * clean, 10) AS v FROM cm, range(101) s(i)), w AS (SELECT *, row_number() OVER (PARTITION BY r, exposed_weight ORDER BY v DESC, candidate) AS n FROM x)
  SELECT exposed_weight, candidate, count(*) / {_B} AS winner_probability FROM w WHERE n = 1 GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resample.weighted_winners(resample.candidate_means(_candidate_values(spark, d), _B), _B)


def _set_means(which: str, name: str) -> str:
    return f"{name}m AS MATERIALIZED (SELECT r, model, seed, fraction, round_even(sum(correct * times) / sum(times), 12) AS m FROM p JOIN {name}t ON item = pair_id WHERE boundary = 'naive' AND evaluation_set = '{which}' GROUP BY ALL)"


_POLICY = f"""{_PRED}, {', '.join(f'{_boot(n, 7, ns, f"p WHERE boundary = {b!r} AND evaluation_set = {w!r}", "pair_id")}, {_set_means(w, n)}' for n, ns, w, b in (('g', 'boot:target', 'target', 'naive'), ('c', 'boot:clean', 'clean', 'naive'), ('u', 'boot:downstream', 'untouched', 'naive')))},
{_boot('s', 7, 'boot:seed', "p WHERE boundary = 'naive'", 'seed')},
pg AS (SELECT r, model, seed, fraction FROM (SELECT *, row_number() OVER (PARTITION BY r, model, seed ORDER BY m DESC, fraction) AS n FROM gm) WHERE n = 1), pc AS (SELECT r, model, seed, fraction FROM (SELECT *, row_number() OVER (PARTITION BY r, model, seed ORDER BY m DESC, fraction) AS n FROM cm) WHERE n = 1)"""
_POLICY = _POLICY.replace("pc AS (SELECT r,", "pk AS (SELECT r,")


@_query("policy_bootstrap_native", f"""WITH {_POLICY}, v AS (SELECT pg.r, pg.model, pg.seed, times, a.m AS t, b.m AS c, f.m AS z FROM pg JOIN pk USING (r, model, seed) JOIN um a ON a.r = pg.r AND a.model = pg.model AND a.seed = pg.seed AND a.fraction = pg.fraction
  JOIN um b ON b.r = pg.r AND b.model = pg.model AND b.seed = pg.seed AND b.fraction = pk.fraction JOIN um f ON f.r = pg.r AND f.model = pg.model AND f.seed = pg.seed AND f.fraction = 1 JOIN st ON st.r = pg.r AND st.item = pg.seed)
  SELECT r::INT AS replicate, model, round(sum((t - c) * times) / sum(times), 9) AS target_minus_clean, round(sum((t - z) * times) / sum(times), 9) AS target_minus_final, round(sum((c - z) * times) / sum(times), 9) AS clean_minus_final FROM v GROUP BY r, model""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.policy_bootstrap(t.predictions(spark, d), _B), "target_minus_clean", "target_minus_final", "clean_minus_final")


def _arm(which: str, name: str) -> str:
    return f"""{name}m AS (SELECT r, model, seed, fraction, sum(delta * times) FILTER (WHERE position < fraction) / sum(times) FILTER (WHERE position < fraction) - sum(delta * times) FILTER (WHERE position >= fraction) / sum(times) FILTER (WHERE position >= fraction) AS c
  FROM dl JOIN {name}t ON item = pair_id WHERE evaluation_set = '{which}' AND fraction < 1 GROUP BY ALL)"""


@_query("arrival_bootstrap_native", f"""WITH {_PRED}, {_boot('g', 8, 'boot:target', "dl WHERE evaluation_set = 'target' AND fraction < 1", 'pair_id')}, {_boot('c', 8, 'boot:placebo', "dl WHERE evaluation_set = 'clean' AND fraction < 1", 'pair_id')}, {_boot('s', 8, 'boot:seed', 'dl', 'seed')}, {_arm('target', 'g')}, {_arm('clean', 'c')}
  SELECT gm.r::INT AS replicate, gm.model, gm.fraction, round(sum(gm.c * times) / sum(times), 9) AS target, round(sum(cm.c * times) / sum(times), 9) AS placebo, round(sum(gm.c * times) / sum(times) - sum(cm.c * times) / sum(times), 9) AS difference
  FROM gm JOIN cm USING (r, model, seed, fraction) JOIN st ON st.r = gm.r AND st.item = gm.seed GROUP BY gm.r, gm.model, gm.fraction""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.arrival_bootstrap(_deltas(spark, d), _B), "target", "placebo", "difference")


@_query("effect_bootstrap_native", f"""WITH {_PRED}, {_boot('g', 2, 'boot:effect', "dl WHERE evaluation_set = 'target'", 'pair_id')}, {_boot('s', 2, 'boot:seed', "dl WHERE evaluation_set = 'target'", 'seed')}, gm AS (SELECT r, model, seed, fraction, sum(delta * times) / sum(times) AS m FROM dl JOIN gt ON item = pair_id WHERE evaluation_set = 'target' GROUP BY ALL)
  SELECT gm.r::INT AS replicate, model, fraction, round(sum(m * times) / sum(times), 9) AS effect FROM gm JOIN st ON st.r = gm.r AND st.item = gm.seed GROUP BY gm.r, model, fraction""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(resample.effect_bootstrap(effects.paired(t.predictions(spark, d)).where("evaluation_set = 'target'"), _B), "effect")


# --- learners and report tables


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Edits as pairs, oriented by a hash; positions are those of a shuffled training file."""
    r = t._documents(spark, d).where("first <> '' and last <> ''").select("record_id", "split", orient(F.col("record_id"), F.col("last"), F.col("first")).alias("p"))
    return r.select(F.col("record_id").alias("pair_id"), "split", "p.response1", "p.response2", (F.col("p.overall_preference") > 0).cast("int").alias("label"))


def _learned(spark: SparkSession, d: str, model: str) -> DataFrame:
    pairs = _pairs(spark, d)
    terms, c, most = learners.MODELS[model]
    return learners.fit_predict(pairs.where("split = 'train'"), pairs.where("split = 'validation'"), terms, c=c, iterations=1500, least_documents=3, most_features=most)


_TFIDF = rf"""{_ATOMS.replace("rec AS", "rec AS MATERIALIZED")}, pr AS (SELECT record_id AS pair_id, split, CASE WHEN substr({_rank(0, repr('pair_orientation'), 'record_id')}, 16, 1) IN ('1', '3', '5', '7', '9', 'b', 'd', 'f') THEN [f, l] ELSE [l, f] END AS rs FROM fl WHERE f <> '' AND l <> ''),
sd AS (SELECT pair_id, split, s AS side, list_filter(string_split_regex(lower(rs[CASE s WHEN -1 THEN 1 ELSE 2 END]), '[^\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 1) AS w FROM pr, (VALUES (-1), (1)) v(s)),
tm AS (SELECT pair_id, split, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM sd),
tc AS MATERIALIZED (SELECT pair_id, split, side, term, count(*) AS n FROM tm GROUP BY ALL),
vc AS (SELECT term, ln((1 + (SELECT 2 * count(*) FROM pr WHERE split = 'train'))::DOUBLE / (1 + count(*))::DOUBLE) + 1 AS idf FROM tc WHERE split = 'train' GROUP BY term HAVING count(*) >= 3 ORDER BY sum(n) DESC, term LIMIT 120000),
tw AS (SELECT pair_id, split, side, term, (1 + ln(n::DOUBLE)) * idf AS w FROM tc JOIN vc USING (term)),
tn AS (SELECT *, side * w / sqrt(sum(w * w) OVER (PARTITION BY pair_id, side)) AS v FROM tw)"""


@_query("tfidf_differences", f"WITH {_TFIDF} SELECT pair_id, split, term, round(sum(v), 9) + 0 AS value FROM tn GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    terms, _, most = learners.MODELS["word"]
    counts = cut(learners.term_counts(pairs, terms).join(pairs.select("pair_id", "split"), "pair_id"), "terms")
    train = counts.where("split = 'train'").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("total"))
    v = learners.vocabulary(train, 2 * pairs.where("split = 'train'").count(), least_documents=3, most_features=most)
    rows = learners.differences(counts.drop("split"), cut(v, "vocabulary")).join(pairs.select("pair_id", "split"), "pair_id")
    return rows.select("pair_id", "split", "term", (F.round("value", 9) + 0.0).alias("value"))


@_query("learner_grid")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The word model at every prefix of two training tables (one without the edits of context atoms that validation holds)."""
    pairs = _pairs(spark, d)
    rank = stable_rank(7, "file", F.col("pair_id"))
    train = cut(splits.numbered(pairs.where("split = 'train'"), rank, "position"), "train")
    held = _contexts(spark, d)
    clean = splits.strict_clean(_contexts(spark, d).where("split = 'train'").select(F.col("record_id").alias("pair_id"), "context"), (held.where("split = 'validation'"), "context"))
    safe = cut(splits.numbered(train.join(clean.select("pair_id"), "pair_id").drop("position"), rank, "position"), "train")
    return learners.grid({"naive": train, "safe": safe}, {"validation": pairs.where("split = 'validation'")}, fractions=t.FRACTIONS, models={"word": learners.MODELS["word"]}, iterations=1500)


@_query("sparse_learner")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d, "word")


@_query("sparse_learner_char")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _learned(spark, d, "char")


_ANY = ORACLES["exposure_same_any_view"]


@_query("focal_exposure", f"SELECT atom_type, scope, rows, exposed_rows, exposed_rows / rows AS estimate FROM (SELECT atom_type, validation_rows AS rows, unnest(['same_view', 'any_view']) AS scope, unnest([same_view_exposed_rows, any_view_exposed_rows]) AS exposed_rows FROM ({_ANY}) WHERE evaluation_view = 'v0')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.focal_exposure(exposure.same_and_any_view(t.kept_atoms(spark, d)), "v0")


@_query("exposure_tensor", f"SELECT evaluation_view, atom_type, same_view_exposure_rate * 100 AS same_percent, any_view_exposure_rate * 100 AS any_percent, cross_view_only_rate * 100 AS cross_only_percent FROM ({_ANY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return reports.exposure_tensor(exposure.same_and_any_view(t.kept_atoms(spark, d)))


@_query("final_effects", f"WITH {_PRED} SELECT model, seed, evaluation_set, round(100 * avg(delta), 9) AS effect_points FROM dl WHERE fraction = 1 GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.final_effects(effects.paired_gaps(t.predictions(spark, d))), "effect_points")


@_query("item_effects", f"""WITH {_PRED}, w AS (SELECT model, seed, fraction, evaluation_set, pair_id, any_value(position) AS position, max(correct) FILTER (WHERE boundary = 'naive') - max(correct) FILTER (WHERE boundary = 'safe') AS c,
  max(CASE WHEN label = 1 THEN margin ELSE -margin END) FILTER (WHERE boundary = 'naive') - max(CASE WHEN label = 1 THEN margin ELSE -margin END) FILTER (WHERE boundary = 'safe') AS m FROM p WHERE evaluation_set = 'target' GROUP BY ALL)
  SELECT model, seed, fraction, pair_id, position, position < fraction AS ancestor_seen, c::DOUBLE AS naive_minus_safe_correct, round(m, 9) AS naive_minus_safe_signed_margin FROM w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _round(reports.item_effects(t.predictions(spark, d).where("evaluation_set = 'target'")), "naive_minus_safe_signed_margin")


# --- clusters, nested draws, event study


@_query("focal_exposure_intervals", f"""WITH {_MATCH}, fx AS (SELECT record_id, atom_type, bool_or(exposed AND source_view = evaluation_view) AS s, bool_or(exposed) AS y FROM cells WHERE evaluation_view = 'v0' GROUP BY ALL),
  fc AS (SELECT fx.*, coalesce(c.value_hash, 'record:' || fx.record_id) AS cluster FROM fx LEFT JOIN (SELECT DISTINCT record_id, value_hash FROM atoms WHERE atom_type = 'context') c ON c.record_id = fx.record_id),
  fs AS MATERIALIZED (SELECT atom_type, scope, cluster, sum(hit) AS hits, count(*) AS n FROM (SELECT atom_type, cluster, unnest(['same_view', 'any_view']) AS scope, unnest([s::INT, y::INT]) AS hit FROM fc) GROUP BY ALL),
  {_boot('k', 10, 'boot:cluster', 'fs', 'cluster')}, fr AS (SELECT atom_type, scope, r, sum(hits * times) / sum(fs.n * times) AS ratio FROM fs JOIN kt ON item = cluster GROUP BY ALL),
  fi AS (SELECT atom_type, scope, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM fr GROUP BY ALL)
  SELECT atom_type, scope, sum(n)::BIGINT AS rows, sum(hits)::BIGINT AS exposed_rows, round(sum(hits) / sum(n), 9) AS estimate, any_value(low) AS low, any_value(high) AS high FROM fs JOIN fi USING (atom_type, scope) GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    clusters = _contexts(spark, d).select("record_id", F.col("context").alias("cluster"))
    return _round(reports.focal_intervals(exposure.exposed_cells(t.kept_atoms(spark, d)), clusters, "v0", _B), "estimate", "low", "high")


def _level(which: str, n: str, sl: str, seed: int, ns: str, item: str, source: str) -> str:
    """Items of each drawn seed, and how often they are drawn."""
    h = _rank(seed, f"'{ns}'", "r || ':' || slot || ':' || k")
    return f"""{n}i AS MATERIALIZED (SELECT {item} AS item, row_number() OVER (ORDER BY {item}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {item} FROM {source})),
{n}t AS MATERIALIZED (SELECT r, slot, seed, item, count(*) AS times FROM (SELECT r, slot, seed, {_number(h)} % n AS i FROM (SELECT i AS k, n FROM {n}i), {sl}) JOIN {n}i USING (i) GROUP BY ALL)"""


def _drawn_seeds(name: str, seed: int, ns: str, source: str) -> str:
    h = _rank(seed, f"'{ns}'", "r || ':' || slot")
    return f"""{name}s AS (SELECT seed, row_number() OVER (ORDER BY seed) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT seed FROM {source})),
{name} AS MATERIALIZED (SELECT r, slot, seed FROM (SELECT r, slot, {_number(h)} % n AS i FROM (SELECT i AS slot, n FROM {name}s), range({_B}) v(r)) JOIN {name}s USING (i))"""


_NESTED_SETS = (("target", "tt"), ("clean", "cc"), ("untouched", "uu"))


@_query("nested_bootstrap_native", f"""WITH {_PRED}, w AS MATERIALIZED (SELECT model, seed, evaluation_set, pair_id, max(correct) FILTER (WHERE boundary = 'naive')::DOUBLE AS a, max(correct) FILTER (WHERE boundary = 'safe')::DOUBLE AS b FROM p WHERE fraction = 1 GROUP BY ALL), {_drawn_seeds('sl', 9, 'nested:seed', 'w')},
  {', '.join(f"{_level(s, n, 'sl', 9, 'nested:' + s, 'pair_id', f'w WHERE evaluation_set = {s!r}')}, {n}m AS (SELECT r, model, avg(a) AS a, avg(b) AS b FROM (SELECT r, slot, model, sum(a * times) / sum(times) AS a, sum(b * times) / sum(times) AS b FROM w JOIN {n}t ON {n}t.seed = w.seed AND item = pair_id WHERE evaluation_set = {s!r} GROUP BY ALL) GROUP BY ALL)" for s, n in _NESTED_SETS)}
  SELECT x.r::INT AS replicate, x.model, {', '.join(f"round({q}.a, 9) AS {s}_naive, round({q}.b, 9) AS {s}_safe" for (s, _), q in zip(_NESTED_SETS, 'xyz', strict=True))}, round(x.a - x.b - (y.a - y.b), 9) + 0 AS did, round(z.a - z.b, 9) + 0 AS untouched_gap FROM ttm x JOIN ccm y ON x.r = y.r AND x.model = y.model JOIN uum z ON x.r = z.r AND x.model = z.model""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = effects.paired(t.predictions(spark, d).where("fraction = 1"))
    out = _round(resample.nested_bootstrap_native(pairs, _B), *(f"{s}_{b}" for s, _ in _NESTED_SETS for b in ("naive", "safe")), "did", "untouched_gap")
    return out.withColumns({c: F.col(c) + 0.0 for c in ("did", "untouched_gap")})


_EVENT = f"""{_PRED}, tp AS (SELECT seed, pair_id, row_number() OVER (PARTITION BY seed ORDER BY position, pair_id) - 1 AS item, position FROM (SELECT DISTINCT seed, pair_id, position FROM dl WHERE evaluation_set = 'target')),
cp AS (SELECT seed, pair_id, row_number() OVER (PARTITION BY seed ORDER BY sha256(seed || chr(0) || 'clean_placebo_arrival' || chr(0) || pair_id)) - 1 AS item FROM (SELECT DISTINCT seed, pair_id FROM dl WHERE evaluation_set = 'clean')),
er AS MATERIALIZED (SELECT tp.seed, item, (x.fraction * 5)::INT - 1 AS checkpoint, x.delta - y.delta AS outcome, greatest(-0.799999::DOUBLE, least(0.799999::DOUBLE, x.fraction - tp.position)) AS v
  FROM tp JOIN cp USING (seed, item) JOIN dl x ON x.model = 'word' AND x.seed = tp.seed AND x.pair_id = tp.pair_id JOIN dl y ON y.model = 'word' AND y.seed = tp.seed AND y.pair_id = cp.pair_id AND y.fraction = x.fraction WHERE x.fraction < 1),
eb AS MATERIALIZED (SELECT seed, item, checkpoint, outcome, (v >= -0.4::DOUBLE)::INT + (v >= -0.2::DOUBLE)::INT + (v >= 0::DOUBLE)::INT + (v >= 0.2::DOUBLE)::INT + (v >= 0.4::DOUBLE)::INT AS bin FROM er),
{_drawn_seeds('sl', 11, 'event:seed', 'eb')}, {_level('event', 'ev', 'sl', 11, 'event:item', 'item', 'eb')},
ce AS MATERIALIZED (SELECT r, slot, bin, checkpoint, sum(times)::DOUBLE AS n, sum(times * outcome) AS y FROM evt JOIN eb ON eb.seed = evt.seed AND eb.item = evt.item GROUP BY ALL
  UNION ALL SELECT -1, i, bin, checkpoint, count(*)::DOUBLE, sum(outcome) FROM eb JOIN sls USING (seed) GROUP BY ALL),
xs AS (SELECT r, n, y, list_concat([1.0::DOUBLE], list_transform(range(1, 6), lambda b: (bin = b)::INT::DOUBLE), list_transform(range(1, 3), lambda s: (slot = s)::INT::DOUBLE), list_transform(range(1, 4), lambda c: (checkpoint = c)::INT::DOUBLE)) AS x FROM ce),
me AS (SELECT r, i, list(v ORDER BY j) AS row FROM (SELECT r, i, j, sum(CASE WHEN j = 12 THEN y * x[i] ELSE n * x[i] * x[least(j, 11)] END) AS v FROM xs, range(1, 12) a(i), range(1, 13) b(j) GROUP BY ALL) GROUP BY r, i),
sw AS (SELECT r, 0 AS k, list(row ORDER BY i) AS m FROM me GROUP BY r
  UNION ALL SELECT r, k + 1, CASE WHEN abs(m[k + 1][k + 1]) < 1e-9 THEN list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda z: 0::DOUBLE) ELSE row END)
    ELSE list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda z: z / m[k + 1][k + 1]) ELSE list_transform(row, lambda z, j: z - row[k + 1] * (m[k + 1][j] / m[k + 1][k + 1])) END) END FROM sw WHERE k < 11),
be AS (SELECT r, list_transform(m, lambda row: row[12]) AS b FROM sw WHERE k = 11),
es AS MATERIALIZED (SELECT r, bin, 100 * (b[1] + CASE WHEN bin > 0 THEN b[bin + 1] ELSE 0 END + (b[7] + b[8]) / 3 + (b[9] + b[10] + b[11]) / 4) AS estimate FROM be, range(6) q(bin) WHERE EXISTS (SELECT 1 FROM ce WHERE ce.r = be.r AND ce.bin = q.bin))"""


@_query("event_ols_bootstrap", f"""WITH RECURSIVE {_EVENT} SELECT q.bin::INT AS bin, any_value(round(o.estimate, 6)) AS estimate, round(quantile_cont(s.estimate, 0.025), 6) AS low, round(quantile_cont(s.estimate, 0.975), 6) AS high, (SELECT count(*) FROM eb WHERE eb.bin = q.bin) AS observations
  FROM range(6) q(bin) LEFT JOIN es o ON o.bin = q.bin AND o.r = -1 LEFT JOIN es s ON s.bin = q.bin AND s.r >= 0 GROUP BY q.bin""")
def _(spark: SparkSession, d: str) -> DataFrame:
    deltas = _deltas(spark, d).where("model = 'word'")
    target, clean = (deltas.where(F.col("evaluation_set") == s) for s in ("target", "clean"))
    rows = cut(event_study.event_rows(target, clean.drop("position"), t.FRACTIONS[:4], strict=False), "events")
    return _round(event_study.event_study(rows, _B, checkpoints=4), "estimate", "low", "high", digits=6)


# --- files of several views


_FILE_ROWS = 10_000


@_query("multiview_scan", f"""WITH {_RECORDS} SELECT view, split, (record_id // {_FILE_ROWS})::BIGINT AS part, record_id, row_number() OVER (PARTITION BY view, split, record_id // {_FILE_ROWS} ORDER BY record_id) - 1 AS source_index,
  sha256(text) AS text_sha256 FROM rec WHERE split = 'validation' AND view IN ('v0', 'v2')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents as .gz files of JSON lines by view, split and range of ids, read back through the format: files of other views and splits stay shut."""
    folder = fresh(spark, "views")
    r = t._documents(spark, d).select("view", "split", F.floor(F.col("record_id") / _FILE_ROWS).alias("part"), "record_id", F.to_json(F.struct("record_id", "text")).alias("value"))
    r = r.repartition("view", "split", "part").sortWithinPartitions("view", "split", "part", "record_id").drop("record_id")
    r.write.partitionBy("view", "split", "part").text(folder, compression="gzip")
    files = [(f, dict(x.split("=") for x in f.split("/") if "=" in x)) for f in spark.read.text(folder).inputFiles()]
    manifest = {"dataset": "documents", "revision": "r1", "sources": [{"view": k["view"], "split": k["split"], "path": f} for f, k in files]}
    multiview.register(spark)
    lines = spark.read.format("multiview").option("manifest", json.dumps(manifest)).load().where("split = 'validation' AND view IN ('v0', 'v2')")
    row = F.from_json("raw_json", "record_id long, text string")
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long").alias("part")
    return lines.select("view", "split", part, row["record_id"].alias("record_id"), F.col("source_index").cast("long").alias("source_index"), F.sha2(row["text"], 256).alias("text_sha256"))


# --- rendering, truncation, closed forms, serialised pairs, cells worked out again


_VOCABULARY = "byte_bpe_50k.json"


@_query("serialized_pairs")
def _(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    s = _sources(spark, d)
    pairs = s.select(F.col("record_hash").alias("pair_id"), "context", F.col("original_response").alias("original"), "feedback", F.col("edited_response").alias("candidate"))
    return serialize.serialized(pairs, public_tokenizers.path(_VOCABULARY)).withColumn("tokens", F.array_join("tokens", " "))


@_query("rendered_conversations", r"""SELECT conv_id, string_agg('[' || upper(trim(coalesce(role, 'user'))) || ']' || chr(10) || trim(coalesce(text, '')), chr(10) ORDER BY turn) || chr(10) || '[ASSISTANT RESPONSE]' || chr(10) || 'ok' AS sections,
  string_agg('[ROLE ' || upper(coalesce(role, 'unknown')) || '] ' || coalesce(text, ''), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = t.read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))  # the turns of one conversation
    return c.select("conv_id", role_sections(F.col("m"), F.lit("ok")).alias("sections"), context_text(F.col("m")).alias("context"))


@_query("truncated_words", f"""WITH {_RECORDS}, w AS (SELECT record_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM rec)
  SELECT record_id, array_to_string(CASE WHEN len(w) <= 64 THEN w ELSE list_concat(w[1:31], ['[...]', '[...]'], w[len(w) - 30:]) END, ' ') AS words, len(w)::BIGINT AS n FROM w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = t._documents(spark, d).select("record_id", F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "").alias("w"))
    return r.select("record_id", F.array_join(head_tail(F.col("w"), 64, ["[...]", "[...]"]), " ").alias("words"), F.size("w").cast("long").alias("n"))


@_query("probabilities", f"""WITH {_PRED}, s AS (SELECT *, CASE WHEN label = 1 THEN margin ELSE -margin END AS signed FROM p)
  SELECT model, seed, boundary, fraction, evaluation_set, round(avg(1 / (1 + exp(-least(40, greatest(-40, 100 * margin))))), 9) AS probability, round(avg(CASE WHEN round(signed, 2) > 0 THEN 1.0::DOUBLE WHEN round(signed, 2) < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END), 9) AS competence FROM s GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d)
    right = correctness(F.round(signed_margin(F.col("label"), F.col("margin")), 2))
    return _round(p.groupBy("model", "seed", "boundary", "fraction", "evaluation_set").agg(F.avg(logistic(100 * F.col("margin"))).alias("probability"), F.avg(right).alias("competence")), "probability", "competence")


_EXTERNAL = f"""{_ATOMS}, xc AS (SELECT value_hash, min(record_id) AS a, max(record_id) AS b FROM atoms WHERE atom_type = 'context' GROUP BY value_hash HAVING min(record_id) < max(record_id))"""


@_query("external_pairs", f"""WITH {_EXTERNAL} SELECT value_hash AS pair_id, x.f AS context, x.l AS response1, y.l AS response2, CASE WHEN (a + b) % 2 = 1 THEN 1 ELSE -1 END AS overall_preference FROM xc JOIN fl x ON x.record_id = a JOIN fl y ON y.record_id = b""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pairs = _contexts(spark, d).groupBy("context").agg(F.min("record_id").alias("index1"), F.max("record_id").alias("index2")).where("index1 < index2")
    contract = pairs.select(F.col("context").alias("pair_id"), "index1", "index2", ((F.col("index1") + F.col("index2")) % 2).alias("label"))
    return adapters.external_pairs(contract, t._documents(spark, d).select(F.col("record_id").alias("row_index"), F.col("first").alias("prompt"), F.col("last").alias("response")))


@_query("recomputed_cells", f"""WITH {_PRED}, a AS (SELECT model, seed, boundary, fraction, evaluation_set, count(*)::DOUBLE AS n, round(avg(correct), 3) AS accuracy FROM p WHERE evaluation_set <> 'untouched' GROUP BY ALL),
  b AS (SELECT model, seed, boundary, fraction, evaluation_set, count(*)::DOUBLE AS n, avg(correct) AS accuracy FROM p WHERE fraction > 0.2 GROUP BY ALL),
  x AS (SELECT model, seed, boundary, fraction, evaluation_set, unnest(['n', 'accuracy']) AS value, unnest([n, accuracy]) AS v FROM a), y AS (SELECT model, seed, boundary, fraction, evaluation_set, unnest(['n', 'accuracy']) AS value, unnest([n, accuracy]) AS v FROM b)
  SELECT model, seed, boundary, fraction, evaluation_set, value, round(x.v, 9) AS published, round(y.v, 9) AS recomputed, CASE WHEN y.v IS NULL THEN 'missing' WHEN x.v IS NULL THEN 'extra' WHEN abs(x.v - y.v) <= 1e-12 THEN 'same' ELSE 'differs' END AS status FROM x FULL JOIN y USING (model, seed, boundary, fraction, evaluation_set, value)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Cells rounded to three places, of two sets, against cells worked out again from the predictions past the first checkpoint."""
    cells = effects.accuracy_cells(t.predictions(spark, d))
    published = cells.where("evaluation_set <> 'untouched'").withColumn("accuracy", F.round("accuracy", 3))
    keys = ["model", "seed", "boundary", "fraction", "evaluation_set"]
    return _round(serialize.recomputed(published, cells.where("fraction > 0.2"), keys, ["n", "accuracy"]), "published", "recomputed")
