"""References to records that do not exist: direct orphans and, by a fixpoint, what hangs on them.

A reference is a row (table, key, owner, ref, at): the record `key` of `table`, which makes up part of
the entity `owner` (null if nothing can refer to it), names the entity `ref` at the time `at`.
Direct orphans come from one aggregated state per entity. Then the cascade treats references to
orphaned entities as inherited orphans: level by level, semi-joins walk down the foreign-key
graph over distinct (owner, ref) pairs until no new entity is reached.

A hot key is no hot task: the state side is one row per entity, the reference side is aggregated
per (ref, owner) before each cascade join, and Spark's skew join may split what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut


@dataclass
class Orphans:
    """found: every orphan reference with its reason and level, as the fixpoint has them; reason is late, deleted or missing at level 0, inherited beyond."""

    found: DataFrame
    levels: int

    @property
    def direct(self) -> DataFrame:
        return self.found.filter("level = 0")

    @property
    def inherited(self) -> DataFrame:
        return self.found.filter("level > 0")


def entity_state(live: DataFrame, always: DataFrame, removed: DataFrame) -> DataFrame:
    """One row per entity id: first_at (earliest time in live), known (in always), gone (in removed).

    live has (id, at), always and removed have (id). Null ids are dropped; an empty table adds nothing.
    """
    parts = (
        live.select(F.col("id").cast("long"), F.col("at").alias("first_at"), F.lit(True).alias("live"), F.lit(False).alias("known"), F.lit(False).alias("gone"))
        .unionByName(always.select(F.col("id").cast("long"), F.lit(None).cast("timestamp_ntz").alias("first_at"), F.lit(False).alias("live"), F.lit(True).alias("known"), F.lit(False).alias("gone")))
        .unionByName(removed.select(F.col("id").cast("long"), F.lit(None).cast("timestamp_ntz").alias("first_at"), F.lit(False).alias("live"), F.lit(False).alias("known"), F.lit(True).alias("gone")))
    )
    return parts.filter("id is not null").groupBy("id").agg(F.min("first_at").alias("first_at"), F.max("live").alias("live"), F.max("known").alias("known"), F.max("gone").alias("gone"))


def with_reason(refs: DataFrame, state: DataFrame) -> DataFrame:
    """refs with `reason`: late, deleted, missing, or null where the reference holds.

    late: the id is live, but first seen after the reference. A reference or an entity without a time is never late.
    """
    s = state.select(F.col("id").alias("ref"), "first_at", "live", "known", "gone")
    live, known, gone = (F.coalesce(F.col(c), F.lit(False)) for c in ("live", "known", "gone"))
    reason = (
        F.when(live & (F.col("first_at") > F.col("at")), "late")
        .when(live | known, None)
        .when(gone, "deleted")
        .otherwise("missing")
    )
    return refs.join(s, "ref", "left").withColumn("reason", reason).drop("first_at", "live", "known", "gone")


def orphan_references(refs: DataFrame, state: DataFrame, max_levels: int | None = None) -> Orphans:
    """Fixpoint over refs (ref_table, ref_key, owner, ref, at); null refs are no references.

    Entities that are missing or deleted start the cascade at level 0. An entity whose record refers
    to one of them is orphaned at level 1, and so on; cycles end because an entity keeps its first
    level. Every reference to an entity the fixpoint reached comes out with that entity's level; a reference ahead
    of its entity's time is late, at level 0, whatever became of the entity. An empty table gives no rows.
    """
    judged = cut(with_reason(refs.filter("ref is not null"), state))
    pairs = cut(judged.filter("owner is not null and owner <> ref").select("owner", "ref").distinct())
    reached = cut(judged.filter("reason in ('missing', 'deleted')").select(F.col("ref").alias("id"), F.col("reason").alias("why")).distinct().withColumn("level", F.lit(0)))
    frontier, level = reached, 0
    while max_levels is None or level < max_levels:
        level += 1
        nxt = pairs.join(frontier.select(F.col("id").alias("ref")), "ref", "left_semi").select(F.col("owner").alias("id")).distinct()
        frontier = cut(nxt.join(reached.select("id"), "id", "left_anti").withColumns({"why": F.lit("inherited"), "level": F.lit(level)}))
        if frontier.isEmpty():
            break
        reached = cut(reached.unionByName(frontier)) if level % 4 == 0 else reached.unionByName(frontier)
    late = F.coalesce(F.col("reason") == "late", F.lit(False))
    hit = judged.filter(~late).drop("reason").join(reached.select(F.col("id").alias("ref"), F.col("why").alias("reason"), "level"), "ref")
    return Orphans(hit.unionByName(judged.filter(late).withColumn("level", F.lit(0))), level)
