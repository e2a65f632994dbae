"""Walks over the graph and its evidence for questions: seeds, evidence paths, previews and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import records as C
from quillmark.functions import text as T
from quillmark.functions.facts import canonical_identifier
from quillmark.operators.graph import small_join

# Scores of exact seeds, and how much a time window changes a fact's score.
TITLE, ALIAS, RELATION = 0.85, 0.80, 0.80
BOTH_SIDES, EXACT, TOKEN, INSIDE, OUTSIDE = 0.05, 0.85, 0.05, 1.1, 0.8


def active_refs(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks that are active with the path and version of their file."""
    return chunks.where("status = 'active'").join(files, "file_id")


def evidence_path(evidences: DataFrame, contributes: DataFrame) -> DataFrame:
    """(relation, point_id) over relation <- unit <- chunk, each once."""
    return evidences.join(contributes, "unit_id").select("relation", "point_id").distinct()


def mentions(mentioned: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, point_id, count, hub) of the chunks that mention an entity; hub is the number of edges into the chunk,
    counted before the join."""
    hub = edges.groupBy("point_id").agg(F.count("*").alias("hub"))
    return mentioned.join(hub, "point_id", "left").fillna(0, ["hub"])


def fact_subjects(has_fact: DataFrame, entities: DataFrame) -> DataFrame:
    """(fact_id, subjects): the titles of the entities that have a fact, in order."""
    rows = has_fact.join(entities, "key")
    return rows.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("title")), ", ").alias("subjects"))


def lexical_seeds(questions: DataFrame, entities: DataFrame, relations: DataFrame, per_token: int = 5) -> DataFrame:
    """(question_id, kind, key, score): entities whose title, alias or external id is a token of the question, and
    relations with such an end; the first of each token by key. The best score of a key counts. The first of a token are
    the same for every question, so they are chosen before the questions meet them in an equi-join."""
    tokens = questions.select("question_id", F.explode(F.array_distinct(F.transform(C.symbols("question"), canonical_identifier))).alias("token"))
    named = entities.select("key", F.explode(F.array(F.struct(F.lit(TITLE).alias("score"), F.col("title").alias("name")), *(F.struct(F.lit(ALIAS).alias("score"), F.col(c).alias("name")) for c in ("alias", "external")))).alias("n"))
    named = named.where("n.name is not null").select(F.lit("entity").alias("kind"), "key", canonical_identifier("n.name").alias("token"), "n.score")
    ends = relations.select("relation", F.explode(F.array_distinct(F.array(canonical_identifier("source_title"), canonical_identifier("target_title")))).alias("token"))
    ends = ends.select(F.lit("relation").alias("kind"), F.col("relation").alias("key"), "token", F.lit(RELATION).alias("score"))
    owners = small_join(named.unionByName(ends), tokens.select("token").distinct(), ["token"], "left_semi", 64)
    owners = owners.groupBy("token", "kind", "key").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("token", "kind").orderBy(F.desc("score"), "key"))
    first = owners.withColumn("_place", place).where(F.col("_place") <= per_token)
    return tokens.join(first, "token").groupBy("question_id", "kind", "key").agg(F.max("score").alias("score"))


def fact_seeds(questions: DataFrame, facts: DataFrame, lanes: DataFrame, limit: int) -> DataFrame:
    """(question_id, fact_id, score, place) of facts: the best score of the dense ``lanes`` (question_id, fact_id, lane,
    score), a little more if property and value both hit; exact names of a property or symbol in the question; a bonus
    for each token that the fact shares; times the time window's factor. Facts of equal content collapse to the best.
    ``questions`` has a window struct, null for none.

    Questions of equal symbols and window have the same exact hits, and so have contents that hold the same names and
    tokens of the questions and the same year, so classes of the one meet classes of the other. A class of contents
    gives its first ``limit`` facts by id; a content's exact and dense facts collapse at the end."""
    content = ["subject", "property", "symbol", "value", "axis"]
    asked = questions.select("question_id", "question", "window", F.array_sort(C.symbols("question")).alias("_words"))
    asked = asked.withColumn("_class", F.to_json(F.struct("_words", "window")))
    named = F.filter(F.array_distinct(F.array(F.lower("property"), F.lower("symbol"))), lambda x: F.coalesce(x != "", F.lit(False)))
    holds = C.symbols(F.concat_ws(" ", "subject", "property", "symbol", "value"))
    exact = lambda names: F.least(F.lit(1.0), F.lit(EXACT) + 0.1 * (names.cast("long") - 1))
    year = F.when(F.col("axis").isNull(), "").when(F.col("axis").rlike(r"^\d{4}"), F.substring("axis", 1, 4))  # a missing one is in no window
    factor = lambda y: F.when(F.col("window").isNull() | y.isNull(), 1.0).when(y.between(F.col("window.from"), F.col("window.to")), INSIDE).otherwise(OUTSIDE)
    total = lambda base, shared, y: F.round((base + TOKEN * shared) * factor(y), 6)

    # Contents by what the questions can see of them.
    words = asked.select(F.explode("_words").alias("_token")).distinct()
    once = facts.groupBy(*content).agg(F.min("fact_id").alias("fact_id")).select("fact_id", named.alias("_names"), holds.alias("_holds"), year.alias("_year"))
    seen = small_join(once.select("fact_id", F.explode(F.array_union("_names", "_holds")).alias("_token")), words, ["_token"], "left_semi", 64)
    seen = seen.groupBy("fact_id").agg(F.collect_list("_token").alias("_seen"))
    sorts = once.join(seen, "fact_id").select("fact_id", F.array_sort(F.array_intersect("_names", "_seen")).alias("_names"), F.array_sort(F.array_intersect("_holds", "_seen")).alias("_holds"), "_year").where("size(_names) > 0")
    sort = ["_names", "_holds", "_year"]
    place = F.row_number().over(Window.partitionBy(*sort).orderBy("fact_id"))
    sorts = sorts.withColumn("_k", place).where(F.col("_k") <= limit).groupBy(*sort).agg(F.array_sort(F.collect_list("fact_id")).alias("_ids"))
    # Each pair of classes meets at the first name that both have.
    kinds = asked.groupBy("_class").agg(F.first("_words").alias("_words"), F.first("window").alias("window"))
    pairs = kinds.select("*", F.explode("_words").alias("_name")).join(sorts.select("*", F.explode("_names").alias("_name")), "_name")
    both = F.array_intersect("_names", "_words")
    pairs = pairs.where(F.get(both, F.lit(0)) == F.col("_name")).withColumn("score", total(exact(F.size(both)), F.size(F.array_intersect("_words", "_holds")), F.col("_year")))
    best = F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("score"), F.get("_ids", F.lit(0))))
    firsts = pairs.select("_class", "score", "_ids").withColumn("_k", best).where(F.col("_k") <= limit).select("_class", "score", F.explode("_ids").alias("fact_id"))
    best = F.row_number().over(Window.partitionBy("_class").orderBy(F.desc("score"), "fact_id"))
    firsts = firsts.withColumn("_k", best).where(F.col("_k") <= limit).drop("_k")
    hits = asked.select("question_id", "_class").join(firsts, "_class").select("question_id", "fact_id", "score").join(facts.select("fact_id", *content), "fact_id")

    dense = lanes.groupBy("question_id", "fact_id").agg(F.max("score").alias("dense"), F.count_distinct(F.when(F.col("lane").isin("property", "value"), F.col("lane"))).alias("sides"))
    dense = dense.select("question_id", "fact_id", F.least(F.lit(1.0), F.col("dense") + F.when(F.col("sides") == 2, BOTH_SIDES).otherwise(0.0)).alias("_dense"))
    near = dense.join(facts, "fact_id").join(asked.select("question_id", "_words", "window"), "question_id")
    names = F.size(F.array_intersect(named, F.col("_words")))
    base = F.greatest("_dense", F.when(names > 0, exact(names)))
    near = near.select("question_id", "fact_id", total(base, F.size(F.array_intersect("_words", holds)), year).alias("score"), *content)
    rows = hits.select(*near.columns).unionByName(near)
    collapsed = Window.partitionBy("question_id", *content).orderBy(F.desc("score"), "fact_id")
    rows = rows.withColumn("_k", F.row_number().over(collapsed)).where("_k = 1")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "fact_id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= limit).select("question_id", "fact_id", "score", "place")


def page_seeds(questions: DataFrame, pages: DataFrame, dense: DataFrame, limit: int = 6) -> DataFrame:
    """(question_id, page_id, score): dense hits with a tenth of their lexical overlap, the first of each question."""
    rows = dense.join(pages, "page_id").join(questions, "question_id")
    rows = rows.withColumn("score", F.round(F.col("score") + 0.1 * C.lexical_overlap("question", "text"), 6))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "page_id"))
    return rows.withColumn("_k", place).where(F.col("_k") <= limit).select("question_id", "page_id", "score")


def named_entities(questions: DataFrame, entities: DataFrame, most: int = 6) -> DataFrame:
    """(question_id, name, key, ambiguous) of entities that a question names: spans of whole words, at most ``most`` of
    them, equal a title or alias without case and spaces. A span inside a longer found one doesn't count; names of
    several entities keep all, marked ambiguous."""
    words = questions.select("question_id", F.regexp_extract_all(F.lower("question"), F.lit(r"([\p{L}\p{N}_]+)"), 1).alias("w"))
    spans = words.select("question_id", "w", F.posexplode("w").alias("at", "_")).withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("at")))))
    spans = spans.select("question_id", "at", (F.col("at") + F.col("n")).alias("end"), F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), "").alias("name"))
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    names = entities.select("key", F.explode(F.array("title", "alias")).alias("name")).where("name is not null").select("key", bare("name").alias("name")).where("length(name) >= 2").distinct()
    hits = spans.join(names.select("name").distinct(), "name")
    outer = hits.select("question_id", F.col("at").alias("_at"), F.col("end").alias("_end"))
    inside = hits.join(outer, "question_id").where("_at <= at and end <= _end and _end - _at > end - at").select("question_id", "at", "end").distinct()
    kept = hits.join(inside, ["question_id", "at", "end"], "left_anti").select("question_id", "name").distinct()
    return kept.join(names, "name").select("question_id", "name", "key", (F.count("*").over(Window.partitionBy("question_id", "name")) > 1).alias("ambiguous"))


def resolved(wanted: DataFrame, entities: DataFrame, limit: int = 10) -> DataFrame:
    """(wanted, key, place, ambiguous): entities by title, alias or external id without case and spaces (of
    'scheme:id' the id alone will do), by rank; boilerplate never."""
    flat = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    own = entities.where("not boilerplate").select("key", "rank", F.explode(F.array_distinct(F.array(flat(F.col("title")), flat(F.col("alias")), flat(F.col("external")), flat(F.regexp_extract("external", r":([^:]+)$", 1))))).alias("name"))
    hits = wanted.withColumn("name", flat(F.col("wanted"))).where("name <> ''").join(own, "name").select("wanted", "key", "rank").distinct()
    w = Window.partitionBy("wanted")
    rows = hits.withColumn("place", F.row_number().over(w.orderBy(F.desc("rank"), "key")).cast("long")).withColumn("ambiguous", F.count("*").over(w) > 1)
    return rows.where(F.col("place") <= limit).select("wanted", "key", "place", "ambiguous")


def located_facts(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(fact_id, point_id, located): of the chunks that a fact came from, one whose text holds its value, else the first.
    Facts of one unit and value have the same chunk, so each unit's different values meet its texts."""
    values = facts.select("unit_id", "value").distinct()
    rows = values.join(chunks, "unit_id").withColumn("located", F.contains("text", F.col("value")))
    best = F.min(F.struct((~F.col("located")).alias("_not"), "chunk_index", "point_id")).alias("_best")
    found = rows.groupBy("unit_id", "value").agg(best, F.max("located").alias("located")).select(F.col("unit_id").alias("_unit"), F.col("value").alias("_value"), "_best", "located")
    rows = facts.select("fact_id", "unit_id", "value").join(found, (F.col("unit_id") == F.col("_unit")) & F.col("value").eqNullSafe(F.col("_value")))
    return rows.groupBy("fact_id").agg(F.min("_best")["point_id"].alias("point_id"), F.max("located").alias("located"))


def preview(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """The edges between the first ``limit`` nodes by degree and frequency that aren't boilerplate."""
    degree = edges.select(F.explode(F.array("source", "target")).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))
    chosen = nodes.where("not boilerplate").join(degree, "key", "left").fillna(0, ["degree"]).orderBy(F.desc("degree"), F.desc("frequency"), "key").limit(limit).select("key")
    return edges.join(chosen.withColumnRenamed("key", "source"), "source", "left_semi").join(chosen.withColumnRenamed("key", "target"), "target", "left_semi")


def neighbourhoods(subjects: DataFrame, edges: DataFrame, per_entity: int = 8, limit: int = 4) -> DataFrame:
    """(question_id, key, other, weight, place): for the first subjects of each question, named ones before seeds, the
    strongest relation to each far end. ``subjects`` has question_id, key, named, score, ambiguous; an ambiguous name
    has no neighbours. ``edges`` are the relations that may be walked."""
    at = Window.partitionBy("question_id").orderBy(F.desc("named"), F.desc("score"), "key")
    chosen = subjects.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= limit).where("not ambiguous")
    both = edges.select(F.col("source").alias("key"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("key"), F.col("source").alias("other"), "weight"))
    far = chosen.join(both, "key").groupBy("question_id", "key", "other").agg(F.max("weight").alias("weight"))
    place = F.row_number().over(Window.partitionBy("question_id", "key").orderBy(F.desc("weight"), "other"))
    return far.withColumn("place", place.cast("long")).where(F.col("place") <= per_entity)


def predicate_kinds(edges: DataFrame) -> DataFrame:
    """(key, direction, predicate, n): relations of each entity by type and direction."""
    out = edges.select(F.col("source").alias("key"), F.lit("out").alias("direction"), "predicate")
    rows = out.unionByName(edges.select(F.col("target").alias("key"), F.lit("in").alias("direction"), "predicate"))
    return rows.groupBy("key", "direction", "predicate").agg(F.count("*").alias("n"))


def property_summary(facts: DataFrame, most: int = 50) -> DataFrame:
    return facts.groupBy("concept", "concept_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept_key", "concept").limit(most)


def parts_index(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(whole, part) of relations of composition that may be walked; parts are instances, neither classes nor
    references, and nothing is a part of itself."""
    able = relations.where("traversable").select(C.composition(F.col("predicate"), F.col("source"), F.col("target")).alias("c")).where("c is not null").select("c.*")
    return able.where("whole <> part").join(entities.where("kind <> 'class' and not reference").select(F.col("key").alias("part")), "part").select("whole", "part").distinct()


def currency(relations: DataFrame, units: DataFrame) -> DataFrame:
    """Relations with the first and last date of their units' documents; null without a dated one."""
    dates = relations.select("relation", F.explode("unit_ids").alias("unit_id")).join(units.where("doc_date <> ''"), "unit_id")
    found = dates.groupBy("relation").agg(F.min("doc_date").alias("observed_first"), F.max("doc_date").alias("observed_last"))
    return relations.drop("unit_ids").join(found, "relation", "left")


def undecided(relations: DataFrame, single: list[str]) -> DataFrame:
    """(source, predicate, targets): single-valued predicates with several targets, for review; none is chosen."""
    rows = relations.where(F.col("traversable") & F.col("predicate").isin(*single))
    return rows.groupBy("source", "predicate").agg(F.count_distinct("target").alias("targets")).where("targets > 1")


def admitted(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) after admission: names that are only values leave, unless a relation of theirs may not be
    walked, and become attributes 'predicate = value' of the other end; references are marked. ``exact`` entities, which
    rules found, stay as they are."""
    guarded = relations.where("not traversable").select(F.explode(F.array("source", "target")).alias("key")).distinct()
    values = entities.where(~F.col("exact") & C.value_name("title")).join(guarded, "key", "left_anti").select("key", "title")
    side = lambda own, other: relations.join(values.select(F.col("key").alias(own), "title"), own).select(F.col(other).alias("key"), F.concat("predicate", F.lit(" = "), "title").alias("attribute"))
    attributes = side("target", "source").unionByName(side("source", "target")).groupBy("key").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))
    kept = entities.join(values.select("key"), "key", "left_anti").join(attributes, "key", "left")
    kept = kept.withColumn("reference", ~F.col("exact") & ~C.value_name("title") & C.reference_name("title"))
    left = relations.join(values.select(F.col("key").alias("source")), "source", "left_anti").join(values.select(F.col("key").alias("target")), "target", "left_anti")
    return kept, left


def type_health(entities: DataFrame, ratio: float = 0.5, minimum: int = 5) -> DataFrame:
    """Share of values, references and boilerplate among each type's names before admission, and whether it is high."""
    value, reference = C.value_name("title"), C.reference_name("title")
    n = F.count("*")
    sums = entities.groupBy("type").agg(n.alias("names"), F.count_if(value).alias("values"), F.count_if(~value & reference).alias("references"), F.count_if(~value & F.col("boilerplate")).alias("boilerplate"))
    noise = F.round((F.col("values") + F.col("references") + F.col("boilerplate")) / F.col("names"), 3)
    return sums.withColumn("noise", noise).withColumn("demoted", (F.col("names") >= minimum) & (F.col("noise") >= ratio) & (F.col("names") - F.col("values") - F.col("references") > 0))


def linked_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(fact_id, key, scope): the one entity that a fact's subject names, among those of its document first and among
    all else; null where none or several do. ``entities`` has key, name and doc_id."""
    subject = F.lower(F.trim(F.col("subject")))
    one = lambda rows, by: rows.groupBy(*by).agg(F.count_distinct("key").alias("n"), F.min("key").alias("k"))
    names = entities.select("key", "doc_id", F.lower(F.trim("name")).alias("_name"))
    own = one(names, ["_name", "doc_id"]).select("_name", "doc_id", F.col("n").alias("own_n"), F.col("k").alias("own"))
    everywhere = one(names, ["_name"]).select("_name", F.col("n").alias("all_n"), F.col("k").alias("any"))
    rows = facts.withColumn("_name", subject).join(own, ["_name", "doc_id"], "left").join(everywhere, "_name", "left")
    key = F.when(F.col("own_n") == 1, F.col("own")).when(F.col("own_n").isNull() & (F.col("all_n") == 1), F.col("any"))
    scope = F.when(F.col("own_n") == 1, "document").when(F.col("own_n") > 1, "ambiguous").when(F.col("all_n") == 1, "library").when(F.col("all_n") > 1, "ambiguous").otherwise("unresolved")
    return rows.select("fact_id", key.alias("key"), scope.alias("scope"))


def source_points(rows: DataFrame, limit: int = 16) -> DataFrame:
    """(owner, point_id): one point of each document of an owner, of many documents evenly by their paths."""
    per = rows.groupBy("owner", "rel_path").agg(F.min("point_id").alias("point_id"))
    w = Window.partitionBy("owner")
    ranked = per.withColumn("_i", F.row_number().over(w.orderBy("rel_path")) - 1).withColumn("_n", F.count("*").over(w))
    at = F.ceil(F.col("_i") * limit / F.col("_n"))
    return ranked.where((F.col("_n") <= limit) | (F.floor(at * F.col("_n") / limit) == F.col("_i")) & (at < limit)).select("owner", "point_id")


def vector_neighbours(vectors: DataFrame, pairs: DataFrame, threshold: float = 0.9, most: int = 3) -> DataFrame:
    """(a, b, cosine) for candidate pairs of one type: those at the threshold, the nearest few of each. ``pairs`` are
    blocks' members, such as sliding windows or cells, so vectors don't meet all others."""
    from quillmark.operators.recall import cosine

    rows = pairs.join(vectors.select(F.col("key").alias("a"), F.col("vector").alias("va"), "type"), "a").join(vectors.select(F.col("key").alias("b"), F.col("vector").alias("vb"), "type"), ["b", "type"])
    rows = rows.select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    return rows.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def bucketed(candidates: DataFrame, subjects: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """Candidates with the subject of their question that they hold, the longest first; null where the question names
    fewer than ``least`` or more than ``most`` subjects, or the text holds none. Subjects inside others don't count."""
    inner = subjects.join(subjects.select("question_id", F.col("subject").alias("_long")), "question_id").where("subject <> _long and contains(lower(_long), lower(subject))").select("question_id", "subject").distinct()
    own = subjects.join(inner, ["question_id", "subject"], "left_anti").groupBy("question_id").agg(F.array_sort(F.collect_set("subject"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).otherwise(1))).alias("keys"))
    own = own.where(F.size("keys").between(least, most))
    rows = candidates.join(own, "question_id", "left")
    return rows.withColumn("bucket", F.get(F.filter("keys", lambda k: F.contains(F.lower("text"), F.lower(k))), F.lit(0))).drop("keys")


def dual_rank(lanes: DataFrame, k: int = 60) -> DataFrame:
    """(question_id, point_id, score): each lane ranked by itself, then (k + 1) / (k + rank) times the margin that the
    lane gives a point, the best lane of a point counting. ``lanes`` has lane, score and margin."""
    rank = F.row_number().over(Window.partitionBy("question_id", "lane").orderBy(F.desc("score"), "point_id"))
    rows = lanes.withColumn("_s", F.round((k + 1) / (k + rank) * F.col("margin"), 9))
    return rows.groupBy("question_id", "point_id").agg(F.max("_s").alias("score"))


def budgeted_records(records: DataFrame, budget: int) -> DataFrame:
    """(question_id, kind, n, admitted): whole records in turn over the kinds, each admitted if it still fits what is
    left of the budget; those that don't are passed over. ``records`` has kind, kind_order, n (the place in its kind)
    and text; a question's records are a short list."""
    listed = F.array_sort(F.collect_list(F.struct("n", "kind_order", "kind", T.approx_tokens("text").alias("cost"))))
    rows = records.groupBy("question_id").agg(listed.alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))
    fits = lambda s, x: s["used"] + x["cost"] <= budget
    step = lambda s, x: F.struct(F.when(fits(s, x), s["used"] + x["cost"]).otherwise(s["used"]).alias("used"), F.concat(s["flags"], F.array(fits(s, x))).alias("flags"))
    rows = rows.withColumn("f", F.aggregate("r", start, step)["flags"])
    return rows.select("question_id", F.explode(F.arrays_zip("r", "f")).alias("z")).select("question_id", "z.r.kind", "z.r.n", F.col("z.f").alias("admitted"))


def redundancy(picked: DataFrame) -> DataFrame:
    """(question_id, redundancy): mean Jaccard similarity over the pairs of a question's chosen texts, four digits.
    Pairs of one id are none; a pair without a token says nothing. Texts of equal tokens collapse into classes before
    any pair is formed, and classes meet in blocks."""
    rows = picked.select("question_id", "point_id", F.array_sort(F.array_distinct(T.tokens("text"))).alias("t")).where("question_id is not null and point_id is not null and t is not null")
    again = rows.groupBy("question_id", "point_id").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1")
    again = again.select("question_id", "point_id", F.explode("ts").alias("t"))
    alike = jaccard_sums(rows, ["question_id"])
    own = jaccard_sums(again, ["question_id", "point_id"]).select("question_id", (-F.col("total")).alias("total"), (-F.col("pairs")).alias("pairs"))
    sums = alike.unionByName(own).groupBy("question_id").agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))
    return sums.where("pairs > 0").select("question_id", F.round(F.col("total") / F.col("pairs"), 4).alias("redundancy"))


def jaccard_sums(rows: DataFrame, by: list[str], block: int = 2_048, width: int = 4_096) -> DataFrame:
    """(by, total, pairs): the sum of the Jaccard similarity over all pairs of a group's token sets ``t``, and their
    number. Equal sets are counted, not compared; a group's different sets are cut into blocks by their hash, each pair of
    blocks is a task, and inside it shared tokens are counted by products of ``width`` columns at a time."""
    sets = rows.groupBy(*by, "t").agg(F.count("*").alias("n"))
    parts = sets.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    cut = sets.join(parts, by).withColumn("_b", F.pmod(F.hash("t"), F.col("_parts")))
    # Block b is the left side of the pairs (b, j >= b) and the right side of the pairs (i <= b, b).
    left = cut.select(*by, "t", "n", F.lit(True).alias("_left"), F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_parts") - 1)).alias("_j"))
    right = cut.where("_b > 0").select(*by, "t", "n", F.lit(False).alias("_left"), F.explode(F.sequence(F.lit(0), F.col("_b") - 1)).alias("_i"), F.col("_b").alias("_j"))

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        same = key[-2].as_py() == key[-1].as_py()
        side = group.column("_left").combine_chunks().to_numpy(zero_copy_only=False)
        counts = group.column("n").to_numpy().astype(float)
        lists = group.column("t").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        coded = pc.dictionary_encode(lists.flatten()).indices.to_numpy().astype(np.int64)
        at = np.repeat(np.arange(len(size)), size)
        a, b = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
        total = pairs = 0.0
        if len(a) and len(b):
            terms = int(coded.max()) + 1 if len(coded) else 0
            ha = np.bincount(coded[side[at]], minlength=terms)
            hb = ha if same else np.bincount(coded[~side[at]], minlength=terms)
            # Only tokens that both sides hold are shared by a pair.
            both = np.flatnonzero((ha > 0) & (hb > 0) & ((ha > 1) if same else True))
            new = np.full(terms, -1)
            new[both] = np.arange(len(both))
            term, place = new[coded], np.full(len(size), -1)
            place[a] = np.arange(len(a))
            if not same:
                place[b] = np.arange(len(b))
            shared = np.zeros((len(a), len(b)))
            for low in range(0, len(both), width):
                wide = min(width, len(both) - low)
                here = (term >= low) & (term < low + wide)
                x = np.zeros((len(a), wide), np.float32)
                on = here & side[at]
                x[place[at[on]], term[on] - low] = 1
                y = x
                if not same:
                    y, on = np.zeros((len(b), wide), np.float32), here & ~side[at]
                    y[place[at[on]], term[on] - low] = 1
                shared += x @ y.T
            if same:
                np.fill_diagonal(shared, size[a])
            union = size[a][:, None] + size[b][None, :] - shared
            alike = np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)
            told = (union > 0).astype(float)
            total, pairs = counts[a] @ alike @ counts[b], counts[a] @ told @ counts[b]
            if same:  # each pair came twice and each set met itself
                own = counts[a][size[a] > 0].sum()
                total, pairs = (total - own) / 2, (pairs - own) / 2
        return pa.table([*(pa.array([k.as_py()], group.schema.field(name).type) for k, name in zip(key, by, strict=False)), pa.array([float(total)]), pa.array([int(round(pairs))], pa.int64())], names=[*by, "total", "pairs"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    found = left.unionByName(right).groupBy(*by, "_i", "_j").applyInArrow(compare, f"{kinds}, total double, pairs long")
    return found.groupBy(*by).agg(F.sum("total").alias("total"), F.sum("pairs").alias("pairs"))


def ranking_stats(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """The greatest rank, the number of chunks with a mention, and all mentions, as one row."""
    return entities.agg(F.max("rank").alias("max_rank")).crossJoin(F.broadcast(mentions.agg(F.count_distinct("point_id").alias("chunks"), F.sum("count").alias("mentions"))))


def relation_cosines(relations: DataFrame, vectors: DataFrame, question: list[float]) -> DataFrame:
    """(relation, cosine) of the relations that have a vector."""
    from quillmark.operators.recall import cosine

    q = F.array(*(F.lit(float(x)) for x in question))
    return relations.join(vectors, "relation").select("relation", F.round(cosine(F.col("vector"), q), 6).alias("cosine"))


def excluded(files: DataFrame, status: DataFrame, allowed: Column) -> DataFrame:
    """Paths whose document's status is outside the scope; documents without a status are in it."""
    return files.join(status, "doc_id").where(~allowed).select("rel_path")


def looked_up(wanted: DataFrame, points: DataFrame) -> DataFrame:
    """Payloads of the wanted ids that are active; ids may come without anything else."""
    return points.where("active").join(wanted.select("point_id").distinct(), "point_id", "left_semi")


def catalogue(chunks: DataFrame, entities: DataFrame, samples: int = 3) -> DataFrame:
    """(kb_id, chunks, docs, sample, has_graph) of each library, with the first paths as a sample."""
    per = chunks.groupBy("kb_id", "doc_id", "rel_path").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kb_id").orderBy("rel_path"))
    rows = per.withColumn("_k", place).groupBy("kb_id").agg(F.sum("n").alias("chunks"), F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("_k") <= samples, F.col("rel_path")))), "|").alias("sample"))
    graph = entities.groupBy("kb_id").agg(F.count("*").alias("_e"))
    return rows.join(graph, "kb_id", "left").withColumn("has_graph", F.coalesce(F.col("_e") > 0, F.lit(False)) & (F.col("docs") > 0)).drop("_e")
