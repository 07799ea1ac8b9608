"""Concepts by their names and synonyms, exactly or by a part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import label_is_active, label_is_standard, label_rank, normalise_label
from ..sources.tables import VocabularyTables

MATCH = ["term_id", "input_label", "matched_label", "concept_id", "match_kind", "is_standard", "is_active"]
GRAM = 3


def _labels(tables: VocabularyTables, synonyms: bool) -> DataFrame:
    flags = [label_is_standard(F.col("standard_concept")).alias("is_standard"), label_is_active(F.col("invalid_reason")).alias("is_active")]
    concepts = tables.concept.select("concept_id", F.col("concept_name").alias("matched_label"), *flags)
    if not synonyms:
        return concepts.withColumn("match_kind", F.lit("DIRECT")).where("matched_label IS NOT NULL")
    names = tables.concept_synonym.select("concept_id", F.col("concept_synonym_name").alias("matched_label"))
    return names.join(concepts.drop("matched_label"), "concept_id").withColumn("match_kind", F.lit("SYNONYM"))


def _terms(terms: DataFrame) -> DataFrame:
    return terms.select("term_id", normalise_label(F.col("text")).alias("input_label")).where("input_label <> ''")


def _fuzzy(labels: DataFrame, terms: DataFrame, escape: bool) -> DataFrame:
    """Labels that contain a term, found by the term's rarest n-gram instead of comparing all with all.

    Unless escaped, % and _ in a term are wildcards; the n-gram then comes from its longest plain stretch. A term of nothing
    but wildcards meets every label by an empty n-gram of its own.
    """
    low = F.lower("matched_label")
    plain = F.expr("filter(split(input_label, '[%_]'), x -> x <> '')") if not escape else F.array("input_label")
    longest = F.coalesce(F.array_max(F.transform(plain, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))["t"], F.lit(""))
    def grams(text, size):
        return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))

    sized = terms.withColumn("_plain", longest).withColumn("_size", F.least(F.length("_plain"), F.lit(GRAM)))
    own = sized.withColumn("gram", F.explode(F.when(F.col("_size") == 0, F.array(F.lit(""))).when(F.col("_size") == 1, F.array(F.substring("_plain", 1, 1))).when(F.col("_size") == 2, F.array("_plain")).otherwise(grams(F.col("_plain"), GRAM))))
    every = F.concat(F.array(F.lit("")), *[F.coalesce(grams(low, n), F.array()) for n in range(1, GRAM + 1)])
    wanted = own.select("gram").distinct()
    index = labels.withColumn("gram", F.explode(F.array_distinct(every))).join(wanted, "gram", "left_semi")
    spread = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram no label has can't match: the inner join with the counts would hide it, so it counts as zero
    rarest = own.join(spread, "gram", "left").groupBy("term_id", "input_label").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram"))["gram"].alias("gram"))
    # Spark takes the exploded index for as small as the names, and would send some 70 rows a name through the driver
    near = index.hint("merge").join(rarest, "gram").drop("gram")
    if escape:
        return near.where(low.contains(F.col("input_label")))
    return near.where(F.expr("lower(matched_label) LIKE concat('%', input_label, '%')"))


def _lookup(tables: VocabularyTables, terms: DataFrame, fuzzy: bool, escape: bool, synonyms: bool) -> DataFrame:
    labels, asked = _labels(tables, synonyms), _terms(terms)
    if fuzzy:
        return _fuzzy(labels, asked, escape).select(*MATCH)
    return labels.join(asked, F.lower("matched_label") == F.col("input_label")).select(*MATCH)


def label_lookup(tables: VocabularyTables, terms: DataFrame, *, fuzzy: bool = False, escape: bool = False) -> DataFrame:
    """MATCH columns for ``terms`` (term_id, text) met by concept names: equal but for letter case, or containing the term if ``fuzzy``.

    The term is trimmed, lowered and its white space collapsed; names are only lowered. Blank or null terms match nothing.
    """
    return _lookup(tables, terms, fuzzy, escape, synonyms=False)


def synonym_lookup(tables: VocabularyTables, terms: DataFrame, *, fuzzy: bool = False, escape: bool = False) -> DataFrame:
    """The same over synonyms of known concepts."""
    return _lookup(tables, terms, fuzzy, escape, synonyms=True)


def concept_ids_by_label(tables: VocabularyTables, terms: DataFrame) -> DataFrame:
    """(term_id, concept_id) by lowered name alone: white space is taken as it is."""
    low = terms.select("term_id", F.lower("text").alias("_low"))
    return tables.concept.join(low, F.lower("concept_name") == F.col("_low")).select("term_id", "concept_id")


def ranked_labels(matches: DataFrame) -> DataFrame:
    """``matches`` plus rank_no within each term: standard, active, direct first; ties by concept_id and label."""
    from pyspark.sql import Window

    order = Window.partitionBy("term_id").orderBy(label_rank(F.col("is_standard"), F.col("is_active"), F.col("match_kind")), "concept_id", "matched_label")
    return matches.withColumn("rank_no", F.row_number().over(order))
