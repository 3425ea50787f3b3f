"""Verdicts from probabilities, relation metadata, and what refinement may change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: classes in their order, the verdict of each but the first, and the margin of a direction.
CLASSES = ("same", "related", "sibling", "unrelated")
VERDICT = {"related": "RELATE", "sibling": "SIBLING", "unrelated": "DISTINCT"}
VERDICT_CLASS = {"MERGE": "same", "RELATE": "related", "SIBLING": "sibling", "DISTINCT": "unrelated", "DEFER": "defer"}
DIRECTION_MARGIN = 0.3
SIBLING_STRUCTURE = 0.5


def p(name: str) -> Column:
    return F.col(f"p_{name}")


def guard(placeholder: Column, generic: Column) -> Column:
    """Pairs that never merge by themselves: placeholder titles, generic artists."""
    return (F.coalesce(placeholder, F.lit(0.0)) > 0) | (F.coalesce(generic, F.lit(0.0)) > 0)


def best_other(classes: tuple[str, ...] = CLASSES) -> Column:
    """The strongest class but ``same``; the first of equals."""
    rest = [c for c in classes if c != "same"]
    top = F.greatest(*[p(c) for c in rest])
    out = F.lit(rest[-1])
    for c in reversed(rest[:-1]):
        out = F.when(p(c) == top, F.lit(c)).otherwise(out)
    return out


def verdict(threshold: Column, guarded: Column, structure: Column | None = None, classes: tuple[str, ...] = CLASSES) -> Column:
    """MERGE from the type's threshold on (none: 1.0) unless guarded; DEFER while ``same`` leads; else the strongest other class."""
    top = F.greatest(*[p(c) for c in classes if c != "same"])
    best = best_other(classes)
    relate = F.lit("RELATE") if structure is None else F.when(F.coalesce(structure, F.lit(0.0)) > SIBLING_STRUCTURE, F.lit("SIBLING")).otherwise(F.lit("RELATE"))
    other = F.when(best == "related", relate).when(best == "sibling", F.lit("SIBLING")).otherwise(F.lit("DISTINCT"))
    merged = F.when(guarded, F.lit("DEFER")).otherwise(F.lit("MERGE"))
    return F.when(p("same") >= F.coalesce(threshold, F.lit(1.0)), merged).when(p("same") > top, F.lit("DEFER")).otherwise(other)


def with_verdicts(scored: DataFrame, thresholds: DataFrame, structure: str | None = None) -> DataFrame:
    """Joins the few thresholds (type, threshold) and adds ``verdict``; pairs of two types are DISTINCT unscored."""
    rows = scored.join(F.broadcast(thresholds), "type", "left")  # one row for each entry type
    out = verdict(F.col("threshold"), F.col("guard"), F.col(structure) if structure else None)
    if "cross_type" in scored.columns:
        out = F.when(F.col("cross_type"), F.lit("DISTINCT")).otherwise(out)
    return rows.withColumn("verdict", out).drop("threshold")


def to_runtime(verdict: Column) -> Column:
    """Siblings get no edge of their own."""
    return F.when(verdict == "SIBLING", F.lit("DISTINCT")).otherwise(verdict)


def sibling_verdict(verdict: Column, shared: Column) -> Column:
    """RELATE becomes DISTINCT where both entries derive from one original."""
    return F.when(shared & (verdict == "RELATE"), F.lit("DISTINCT")).otherwise(verdict)


def veto_siblings(rows: DataFrame, derived_from: DataFrame) -> DataFrame:
    """RELATE becomes DISTINCT where both entries derive from one original (entry, original)."""
    edges = derived_from.select("entry", "original").distinct()
    left = rows.filter("verdict = 'RELATE'").select("entry_a", "entry_b").distinct()
    shared = left.join(edges.select(F.col("entry").alias("entry_a"), "original"), "entry_a").join(edges.select(F.col("entry").alias("entry_b"), "original"), ["entry_b", "original"])
    shared = shared.select("entry_a", "entry_b").distinct().withColumn("veto", F.lit(True))
    out = rows.join(shared, ["entry_a", "entry_b"], "left")
    return out.withColumn("verdict", sibling_verdict(F.col("verdict"), F.col("veto"))).drop("veto")


def strongest_kind(kinds: tuple[str, ...]) -> Column:
    """The kind of highest probability (columns p_kind_*); the first of equals."""
    top = F.greatest(*[F.col(f"p_kind_{k}") for k in kinds])
    out = F.lit(kinds[-1])
    for k in reversed(kinds[:-1]):
        out = F.when(F.col(f"p_kind_{k}") == top, F.lit(k)).otherwise(out)
    return out


def relation_metadata(kind: Column, p_a_derived: Column) -> Column:
    """struct(transformation, derived_side): no transformation for "other", no side within the margin."""
    side = F.when(p_a_derived - 0.5 > DIRECTION_MARGIN, F.lit("a")).when(0.5 - p_a_derived > DIRECTION_MARGIN, F.lit("b"))
    return F.struct(F.when(kind != "other", kind).alias("transformation"), side.alias("derived_side"))


def refined(rows: DataFrame, answers: DataFrame, derived_from: DataFrame | None = None) -> DataFrame:
    """The judge's verdicts (entry_a, entry_b, judged) on deferred pairs; others and failed ones keep theirs."""
    out = rows.join(answers.select("entry_a", "entry_b", "judged"), ["entry_a", "entry_b"], "left")
    judged = F.when(F.col("verdict") == "DEFER", F.col("judged"))
    out = out.withColumn("was", F.col("verdict")).withColumn("verdict", F.coalesce(judged, "verdict")).drop("judged")
    if derived_from is not None:
        fresh = veto_siblings(out.filter("was = 'DEFER'"), derived_from)
        out = out.filter("was <> 'DEFER'").unionByName(fresh)
    return out.drop("was")


def without_matcher(pairs: DataFrame) -> DataFrame:
    """No model at hand: every pair is DISTINCT."""
    return pairs.withColumn("verdict", F.lit("DISTINCT"))
