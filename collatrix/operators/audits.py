"""Row selections for audits: which examples to look at, and which retrievals went wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatrix.functions.scalar import finite
from collatrix.operators.ingest import best_per_group, top_per_group
from collatrix.operators.ranking import in_order


def role_examples(rows: DataFrame, group: str, parent: str, role: str, key: str, roles: Sequence[str], per_group: int = 3) -> DataFrame:
    """The first examples of each group by role, one per parent, then by parent; roles that are not listed come last."""
    names = F.array(*[F.lit(r) for r in roles])
    place = F.array_position(names, F.col(role)).cast("int")
    ordered = rows.withColumn("role_order", F.when(place > 0, place - 1).otherwise(F.lit(9)))
    distinct = best_per_group(ordered, [group, parent], ["role_order", key])
    return top_per_group(distinct, [group], ["role_order", parent], per_group, "nth")


def contributing(items: DataFrame, added: DataFrame, photo: str, group: str) -> DataFrame:
    """The items of each photo that belong to groups it added (photo, group); all of its items where it added none of theirs."""
    marked = items.join(added.select(photo, group).distinct().withColumn("is_added", F.lit(True)), [photo, group], "left")
    any_added = marked.groupBy(photo).agg(F.coalesce(F.bool_or("is_added"), F.lit(False)).alias("has_added"))
    return marked.join(any_added, photo).where("is_added OR NOT has_added").drop("is_added", "has_added")


def audit_rows(found: DataFrame, arm: str, wanted: str, sources: DataFrame, keys: Sequence[str], expected: int | None = None) -> DataFrame:
    """The rows of one arm with their sources; another number of rows than ``expected`` is refused."""
    own = found.where(F.col(arm) == wanted)
    if expected is not None and own.count() != expected:
        raise ValueError(f"arm {wanted} does not have {expected} rows")
    return own.join(sources, list(keys))


def recovered(first: DataFrame, top: DataFrame, query: str) -> DataFrame:
    """The rows of ``top`` for queries whose target can be seen but is not first, by ``first`` (query, is_visible, is_correct)."""
    return top.join(first.where("is_visible AND NOT is_correct").select(query).distinct(), query, "left_semi")


def family_order(families: DataFrame, family: str, parents: str, similarity: str, ranking: DataFrame | None = None) -> DataFrame:
    """Families in review order: most parents first, then the most similar (missing ones last), then by name.

    With ``ranking`` (family, position, priority), only families of priority 1, in its order.
    """
    if ranking is not None:
        chosen = ranking.where("priority = 1").select(family, F.col("position").alias("_p"))
        return in_order(families.join(chosen, family), ["_p", family], rank="position").drop("_p")
    return in_order(families, [F.desc(parents), F.desc(finite(F.col(similarity))), F.asc(family)], rank="position")
