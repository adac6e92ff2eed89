"""Three-way merge of manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def three_way(head: DataFrame, source: DataFrame, base: DataFrame, key: str = "name", entry: str = "entry", by: list[str] | None = None) -> DataFrame:
    """key, entry, origin (both, source, head, conflict) of two sides (key, entry) and their common base.

    An entry that only one side changed is taken from it; where both did, or one side deleted it, the
    head's is kept, or else the source's. So only what both sides deleted goes. Entries are compared whole, or by
    the fields ``by`` of a struct.
    """
    side = lambda df, name: df.select(F.col(key), F.col(entry).alias(name))
    rows = side(head, "h").join(side(source, "s"), key, "full").join(side(base, "b"), key, "left")
    h, s, b = F.col("h"), F.col("s"), F.col("b")

    def same(x: Column, y: Column) -> Column:
        if not by:
            return x.eqNullSafe(y)
        fields = lambda z: F.when(z.isNotNull(), F.struct(*(z[f] for f in by)))
        return fields(x).eqNullSafe(fields(y))

    origin = F.when(same(h, s), "both").when(same(h, b) & s.isNotNull(), "source").when(same(s, b) & h.isNotNull(), "head").otherwise("conflict")
    chosen = F.when(origin == "source", s).when(origin.isin("both", "head"), h).otherwise(F.coalesce(h, s))
    return rows.select(key, chosen.alias(entry), origin.alias("origin"))


def merge_status(head: Column, source: Column, ancestor: Column) -> Column:
    """Already-up-to-date, Fast-forward or Merged."""
    return F.when(ancestor.eqNullSafe(source), "Already-up-to-date").when(ancestor.eqNullSafe(head), "Fast-forward").otherwise("Merged")
