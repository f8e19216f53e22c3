"""Parent and child facets: which there are, the value tree, drill-down counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .counts import as_json, counted, top_counts, within
from .index import FacetIndex


def shape(index: FacetIndex) -> dict[str, list[str]]:
    """hierarchical, regular and root facet names."""
    parents = {f.name: f.parent for f in index.facets}
    used = {p for p in parents.values() if p}
    tree = [n for n, p in parents.items() if p or n in used]
    return {"hierarchical": tree, "regular": [n for n in parents if n not in tree], "roots": [n for n in tree if not parents[n]]}


def levels(index: FacetIndex, most: int = 10) -> list[dict]:
    """facet_name, facet_type, parent, is_root, is_hierarchical, depth; cycles end at the depth cap."""
    parents = {f.name: f.parent for f in index.facets}
    found = shape(index)
    out = []
    for f in index.facets:
        depth, at = 0, f.parent
        while at and depth < most:
            depth, at = depth + 1, parents.get(at)
        out.append({"facet_name": f.name, "facet_type": f.kind, "parent": f.parent, "is_root": f.name in found["roots"], "is_hierarchical": f.name in found["hierarchical"], "depth": depth})
    return out


def chain(index: FacetIndex, root: str) -> list[str]:
    """The root facet and, level by level, the first child of each."""
    out = [root]
    while child := next((f.name for f in index.facets if f.parent == out[-1] and f.name not in out), None):
        out.append(child)
    return out


def edges(index: FacetIndex) -> DataFrame:
    """parent_facet, parent_value, child_facet, child_value, cardinality: values that documents have together."""
    out = None
    for f in index.facets:
        if f.parent:
            p = index.of(f.parent).select("doc_id", F.col("facet_value").alias("parent_value"))
            c = index.of(f.name).select("doc_id", F.col("facet_value").alias("child_value"))
            rows = p.join(c, "doc_id").groupBy("parent_value", "child_value").agg(F.count("*").alias("cardinality"))
            rows = rows.select(F.lit(f.parent).alias("parent_facet"), "parent_value", F.lit(f.name).alias("child_facet"), "child_value", "cardinality")
            out = rows if out is None else out.unionByName(rows)
    return out


def edges_changed(edges_before: DataFrame, before: FacetIndex, after: FacetIndex, touched: DataFrame) -> DataFrame:
    """``edges`` of the index after a change, from those before it and the documents touched (doc_id): only those documents' rows are paired, before and after."""
    part = lambda index: FacetIndex(index.rows.join(touched.select("doc_id").distinct(), "doc_id", "left_semi").select(*index.rows.columns), index.facets, index.key)
    signed = edges(part(after)).unionByName(edges(part(before)).withColumn("cardinality", -F.col("cardinality"))).unionByName(edges_before)
    return signed.groupBy("parent_facet", "parent_value", "child_facet", "child_value").agg(F.sum("cardinality").alias("cardinality")).where("cardinality > 0")


def closure(index: FacetIndex) -> DataFrame:
    """ancestor_facet, ancestor_value, facet, value, cardinality for every pair of levels (the chains are a handful of facets, so the loop is over definitions, not data)."""
    parents = {f.name: f.parent for f in index.facets}
    out = None
    for f in index.facets:
        up = parents[f.name]
        while up:
            a = index.of(up).select("doc_id", F.col("facet_value").alias("ancestor_value"))
            c = index.of(f.name).select("doc_id", F.col("facet_value").alias("value"))
            rows = a.join(c, "doc_id").groupBy("ancestor_value", "value").agg(F.count("*").alias("cardinality")).select(F.lit(up).alias("ancestor_facet"), "ancestor_value", F.lit(f.name).alias("facet"), "value", "cardinality")
            out = rows if out is None else out.unionByName(rows)
            up = parents.get(up)
    return out


def _wide(index: FacetIndex, names: list[str], docs: DataFrame | None) -> DataFrame:
    """doc_id and v0, v1, ..: the values that a document has along a chain of facets, brought together in one pass."""
    rows = within(index, docs, names)
    wide = rows.groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("facet_name") == name, F.col("facet_value"))).alias(f"v{i}") for i, name in enumerate(names)])
    for i in range(len(names)):
        wide = wide.withColumn(f"v{i}", F.explode(f"v{i}") if i == 0 else F.explode_outer(f"v{i}"))
    return wide


def nested(index: FacetIndex, root: str, docs: DataFrame | None = None, n: int = 5) -> DataFrame:
    """One row: values, an array of {value, count, children} with the n most frequent values at every level."""
    names = chain(index, root)
    wide = _wide(index, names, docs)
    below = None
    for i in reversed(range(len(names))):
        keys = [f"v{j}" for j in range(i + 1)]
        level = wide.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.countDistinct("doc_id").alias("count"))
        order = Window.partitionBy(*keys[:-1]).orderBy(F.desc("count"), keys[-1]) if i else Window.orderBy(F.desc("count"), keys[-1])
        level = level.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
        fields = [F.col(keys[-1]).alias("value"), F.col("count")]
        if below is not None:
            level = level.join(below, keys, "left")
            fields.append(F.col("values").alias("children"))
        kept = F.collect_list(F.struct("r", F.struct(*fields).alias("node")))
        below = (level.groupBy(*keys[:-1]) if i else level).agg(F.transform(F.sort_array(kept), lambda x: x["node"]).alias("values"))
    return below


def paths(index: FacetIndex, root: str, docs: DataFrame | None = None, n: int = 0) -> DataFrame:
    """level, path (values joined by ' > '), value, cardinality for every level under root; with n only the n most frequent root values.

    All levels come from one pass: the chain's values are brought together for each document and rolled up.
    """
    names = chain(index, root)
    wide = _wide(index, names, docs)
    out = None
    for i in range(len(names)):
        keys = [f"v{j}" for j in range(i + 1)]
        level = wide.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.countDistinct("doc_id").alias("cardinality"))
        level = level.select(F.lit(i).alias("level"), F.concat_ws(" > ", *keys).alias("path"), F.col(keys[-1]).alias("value"), "cardinality", F.col("v0").alias("root_value"))
        out = level if out is None else out.unionByName(level)
    if n:
        top = counted(within(index, docs, [root])).withColumn("r", F.row_number().over(Window.orderBy(F.desc("cardinality"), "facet_value"))).where(F.col("r") <= n)
        out = out.join(top.select(F.col("facet_value").alias("root_value")), "root_value", "left_semi")
    return out.select("level", "path", "value", "cardinality")


def facets(index: FacetIndex, n: int = 5, docs: DataFrame | None = None) -> dict:
    """Both parts of the drill-down: ``hierarchies`` (root facet -> paths) and ``regular`` (top counts), as DataFrames."""
    found = shape(index)
    return {"hierarchies": {root: paths(index, root, docs, n) for root in found["roots"]}, "regular": top_counts(index, docs, n, found["regular"]) if found["regular"] else None}


def facets_json(index: FacetIndex, n: int = 5, docs: DataFrame | None = None) -> DataFrame:
    """One row: facets, a JSON object with ``hierarchies`` (a list of {facet, values}, values nested) and ``regular`` (a list of facets with their top counts)."""
    found = shape(index)
    one = None
    for i, root in enumerate(found["roots"]):
        tree = nested(index, root, docs, n).select(F.to_json(F.struct(F.lit(root).alias("facet"), F.col("values"))).alias(f"h{i}"))
        one = tree if one is None else one.crossJoin(tree)  # single rows
    regular = as_json(top_counts(index, docs, n, found["regular"])).select(F.coalesce("facets", F.lit("[]")).alias("regular")) if found["regular"] else None
    one = regular if one is None else one if regular is None else one.crossJoin(regular)
    trees = F.concat_ws(",", *[f"h{i}" for i in range(len(found["roots"]))]) if found["roots"] else F.lit("")
    return one.select(F.concat(F.lit('{"hierarchies":['), trees, F.lit('],"regular":'), F.col("regular") if regular is not None else F.lit("[]"), F.lit("}")).alias("facets"))
