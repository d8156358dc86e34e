"""A durable cursor over a ring of items: each turn takes the next few, also after a restart.

The cursor's place is a tiny versioned table: one manifest file per turn, which can be made only once. A turn is taken by
making the next version, and only then is its work done. So of two workers that want the same turn one gets it, and a
run that is lost after it took its turn is not repeated: the next one goes on behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlode.operators.bucketed import BucketTable, Conflict


class Cursor:
    """A cursor stored at `path`, a folder that all workers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = BucketTable(spark, path, [])

    def place(self) -> tuple[int, int]:
        """Number of the last turn (-1 before the first), and the place where the next one begins."""
        last = self.table.manifest()
        return (last["version"], last["next"]) if last else (-1, 0)

    def take(self, many: int, ring: int, seen: tuple[int, int] | None = None) -> tuple[int, int]:
        """Takes the next turn of `many` places on a ring of `ring`: its number and where it begins. Conflict, if another worker has
        taken the turn since `seen` (by default, the place now). A ring that has shrunk begins anew."""
        turn, start = self.place() if seen is None else seen
        start = start if start < ring else 0
        self.table._swap({"version": turn + 1, "next": (start + many) % ring if ring else 0})
        return turn + 1, start

    def expire(self, keep: int = 2) -> None:
        """Forgets all but the last turns."""
        files = self.table._files()
        for v in self.table.versions()[:-keep]:
            files.delete(self.table._path("manifest", f"{v}.json"), False)


def next_batch(cursor: Cursor, items: DataFrame, order: list[str], many: int, attempts: int = 5) -> DataFrame:
    """The next `many` items of the ring that `order` makes, with `turn` and `place` (from 0 within the turn), once each.

    A turn that another worker gets first is tried again. Items are few (cities, sources); their ranks come from one sort."""
    ring = items.count()
    for _ in range(attempts):
        try:
            turn, start = cursor.take(many, ring)
            break
        except Conflict:
            continue
    else:
        raise Conflict(f"no turn in {attempts} attempts")
    at = F.pmod(F.row_number().over(Window.orderBy(*order)) - 1 - start, F.lit(max(ring, 1)))
    return items.withColumn("place", at.cast("long")).filter(F.col("place") < many).withColumn("turn", F.lit(turn).cast("long"))
