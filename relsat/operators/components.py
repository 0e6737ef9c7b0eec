"""Connected components over an edge DataFrame, label = smallest id of the component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relsat.operators.staging import staged


def _jump(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every node points at a root (a node that is its own parent)."""
    while True:
        up = parents.selectExpr("v as up_v", "p as up_p")
        nxt = staged(parents.join(up, parents.p == up.up_v, "left").selectExpr("v", "coalesce(up_p, p) as p", "coalesce(up_p, p) <> p as moved"), "jump")
        moved = not nxt.where("moved").isEmpty()
        parents = nxt.select("v", "p")
        if not moved:
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes of ``edges`` with their component: columns ``id``, ``root`` (the smallest id).

    Each round hooks every node to its smallest neighbour, compresses the forest by pointer
    jumping and contracts the edges; the number of rounds is logarithmic. Every step is a
    partial aggregate or an equi join, so a hub is split by AQE, and each round's tables are
    written to the shared folder. Nulls and self loops are ignored (a node that has only a
    self loop is not returned); an empty input gives an empty result.
    """
    e = edges.selectExpr(f"least({a}, {b}) as x", f"greatest({a}, {b}) as y").where("x <> y").distinct()
    e = staged(e, "edges")
    result = None
    while not e.isEmpty():
        both = e.selectExpr("x as v", "y as u").union(e.selectExpr("y as v", "x as u"))
        parents = both.groupBy("v").agg(F.min("u").alias("u")).selectExpr("v", "least(v, u) as p")
        parents = _jump(staged(parents, "parents"))
        px, py = parents.selectExpr("v as x", "p as px"), parents.selectExpr("v as y", "p as py")
        e = staged(e.join(px, "x").join(py, "y").where("px <> py").selectExpr("least(px, py) as x", "greatest(px, py) as y").distinct(), "edges")
        if result is None:
            result = parents.selectExpr("v as id", "p as root")
        else:
            up = parents.selectExpr("v as up_v", "p as up_p")
            result = staged(result.join(up, result.root == up.up_v, "left").selectExpr("id", "coalesce(up_p, root) as root"), "labels")
    if result is None:
        return e.selectExpr("x as id", "y as root")
    return result
