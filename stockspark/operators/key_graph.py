"""Deletes through a graph of foreign keys (Q-03).

Every row to delete is a transaction of its own, a root.  What it deletes
through CASCADE keys is deleted too, level by level until nothing new is
found; rows that refer to any of it by a SET NULL key lose the reference; one
reference by a RESTRICT key blocks the root, and nothing happens for that root
alone.  Levels are joins of a table with the rows found last, as (root, id)
pairs, so the work follows the rows reached.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockspark.operators.ledger import _checkpoint

ROOT = ("root_table", "root_id")


@dataclass(frozen=True)
class Key:
    """``child.column`` refers to ``parent``'s id; ``action``: CASCADE, SET NULL or RESTRICT."""
    child: str
    column: str
    parent: str
    action: str


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def closure(tables: dict[str, DataFrame], keys: list[Key], roots: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Per table the rows that each root deletes: root_table, root_id, id.

    ``tables``: name to frame with a unique ``id``; ``roots``: name to a frame
    of ids.  Keys may form cycles and refer to their own table; a row is found
    once a root.
    """
    reached = {t: ids.select(F.lit(t).alias("root_table"), F.col("id").alias("root_id"), "id").distinct()
               for t, ids in roots.items()}
    found = dict(reached)
    cascades = [k for k in keys if k.action == "CASCADE"]
    while reached:
        level: dict[str, list[DataFrame]] = {}
        for k in cascades:
            if k.parent in reached:
                up = reached[k.parent].select(*ROOT, F.col("id").alias("_up"))
                child = tables[k.child].select("id", F.col(k.column).alias("_up")).where("_up IS NOT NULL")
                level.setdefault(k.child, []).append(child.join(up, "_up").select(*ROOT, "id"))
        reached = {}
        for t, frames in level.items():
            new = _union(frames).distinct()
            if t in found:
                new = new.join(found[t], [*ROOT, "id"], "left_anti")
            new = _checkpoint(new)
            if not new.isEmpty():
                reached[t] = new
                found[t] = found[t].unionByName(new) if t in found else new
    return found


def referring(tables: dict[str, DataFrame], keys: list[Key], deleted: dict[str, DataFrame], action: str) -> DataFrame | None:
    """References of one action to deleted rows: root_table, root_id, child, column, id.

    For SET NULL, rows that the root deletes itself have nothing left to null.
    """
    out = []
    for k in keys:
        if k.action != action or k.parent not in deleted:
            continue
        up = deleted[k.parent].select(*ROOT, F.col("id").alias("_up"))
        hit = (tables[k.child].select("id", F.col(k.column).alias("_up")).where("_up IS NOT NULL").join(up, "_up")
               .select(*ROOT, "id"))
        if action == "SET NULL" and k.child in deleted:
            hit = hit.join(deleted[k.child], [*ROOT, "id"], "left_anti")
        out.append(hit.select(*ROOT, F.lit(k.child).alias("child"), F.lit(k.column).alias("column"), "id"))
    return _union(out) if out else None


def delete_through(tables: dict[str, DataFrame], keys: list[Key], roots: dict[str, DataFrame]) -> DataFrame:
    """Per root and table.column: root_table, root_id, blocked, effect, target, n.

    ``effect``: CASCADE (rows deleted, the root included), SET NULL, or RESTRICT (references that block it).  A
    blocked root has its RESTRICT rows only.
    """
    deleted = closure(tables, keys, roots)
    rows = _union([d.groupBy(*ROOT).agg(F.count("*").alias("n")).withColumn("target", F.lit(t))
                   .withColumn("effect", F.lit("CASCADE")) for t, d in deleted.items()])
    for action in ("SET NULL", "RESTRICT"):
        hit = referring(tables, keys, deleted, action)
        if hit is not None:
            rows = rows.unionByName(
                hit.groupBy(*ROOT, F.concat_ws(".", "child", "column").alias("target"))
                .agg(F.count("*").alias("n")).withColumn("effect", F.lit(action)))
    blocked = rows.where("effect = 'RESTRICT'").select(*ROOT).distinct().withColumn("blocked", F.lit(True))
    rows = rows.join(blocked, list(ROOT), "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return rows.where("NOT blocked OR effect = 'RESTRICT'").select(*ROOT, "blocked", "effect", "target", "n")
