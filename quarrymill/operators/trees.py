"""Trees inside documents, of any depth, as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Levels that one job unfolds; published documents seldom have more.
LEVELS = 4


def unfold(roots: DataFrame, keys: list[str], child: Callable[[Column, Column], Column]) -> DataFrame:
    """A row per node of the trees below ``roots``, without the column ``branches``.

    ``roots`` has the ``keys``, the fields of a node and ``branches``, an
    array<variant> of the nodes below (null or empty: none). ``child`` makes the
    same fields and branches, as a struct, of a node and its index there; it may
    use the fields of the node above by their names.

    In each step a node becomes itself, then without branches, and its children,
    so a job reads its input once; only nodes with branches go into the next
    job, until there are none: no depth is assumed.
    """
    fields = [c for c in roots.columns if c not in (*keys, "branches")]
    empty = F.array().cast("array<variant>")
    own = F.struct(*fields, F.lit(None).cast("array<variant>").alias("branches"))
    rows, done = roots, []
    while True:
        for _ in range(LEVELS):
            kids = F.transform(F.coalesce("branches", empty), child)
            rows = rows.select(*keys, F.explode(F.concat(F.array(own), kids)).alias("node")).select(*keys, "node.*")
        rows = written(rows, "nodes")
        open_ = F.size(F.coalesce("branches", empty)) > 0
        done.append(rows.drop("branches"))
        rows = rows.where(open_)
        if rows.isEmpty():
            break
        # A node with branches is a row of its own already: only what lies below it goes on.
        rows = rows.select(*keys, F.explode(F.transform("branches", child)).alias("node")).select(*keys, "node.*")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
