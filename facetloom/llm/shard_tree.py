"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a leaf has a weight and an inner node the sum of its leaves'. A key descends from the root: at each
node every child draws -ln(u) / weight, u being a hash of key and child, and the least draw wins. A child's draw depends on nothing but the
key, its own name and its own weight, so when weights change keys move only into or out of subtrees whose weights change.

All of it is one expression of built-in functions: a narrow pass over the key column, without shuffle or Python.

Defined cases: a null key is a key of its own. Equal draws go to the child whose name sorts first. A weight of 0 takes no keys; a tree without
any weight gives null places. Repeated rows go to one place. Only the key column is read; ``place`` keeps all columns and adds three, named by
``names``; a column of one of those names that is there already (names are compared as the session does) is an error, not overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: region -> rack -> shard -> weight
TREE = {
    "east": {"e1": {"e1a": 4.0, "e1b": 4.0, "e1c": 2.0}, "e2": {"e2a": 4.0, "e2b": 6.0}},
    "north": {"n1": {"n1a": 3.0, "n1b": 3.0}, "n2": {"n2a": 8.0}, "n3": {"n3a": 1.0, "n3b": 1.0, "n3c": 2.0}},
    "west": {"w1": {"w1a": 5.0, "w1b": 5.0, "w1c": 5.0}, "w2": {"w2a": 2.5, "w2b": 2.5}},
}
LEVELS = ("region", "rack", "shard")


def weight(node: dict | float) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def _quoted(name: str) -> str:
    return "'" + name.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _choice(children: dict, path: str, key: str) -> str:
    """The name of the child with the least draw."""
    live = {name: w for name, child in sorted(children.items()) if (w := weight(child)) > 0}
    if not live:
        return "CAST(NULL AS string)"
    draw = lambda name, w: f"-ln((CAST(conv(substr(md5(concat({key}, {_quoted('|' + path + name)})), 1, 13), 16, 10) AS double) + 0.5D) / 4503599627370496D) / {w!r}D"
    return f"array_min(array({', '.join(f'struct({draw(n, w)} AS d, {_quoted(n)} AS n)' for n, w in live.items())})).n"


def place(df: DataFrame, key: str, tree: dict = TREE, names: tuple[str, str, str] = LEVELS) -> DataFrame:
    """df with region, rack and shard of each row's key."""
    same = (lambda x: x) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    if clash := {same(c) for c in df.columns} & {same(n) for n in names}:
        raise ValueError(f"there are columns {', '.join(sorted(clash))} already; give other names")
    value = f"coalesce(CAST(`{key.replace('`', '``')}` AS string), 'null')"

    def cases(level: str, options: dict[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN {level} = {_quoted(k)} THEN {v}" for k, v in options.items()) + " END" if options else "CAST(NULL AS string)"

    region, rack, shard = (f"`{n}`" for n in names)
    racks = cases(region, {r: _choice(racks, f"{r}/", value) for r, racks in tree.items()})
    inner = {f"{r}/{k}": _choice(shards, f"{r}/{k}/", value) for r, racks in tree.items() for k, shards in racks.items()}
    for name, choice in zip(names, (_choice(tree, "", value), racks, cases(f"concat({region}, '/', {rack})", inner)), strict=True):
        df = df.withColumn(name, F.expr(choice))
    return df


def leaves(tree: dict = TREE) -> list[tuple[str, str, str, float, float, float]]:
    """region, rack, shard and the weights of each."""
    return [(r, k, s, weight(racks), weight(shards), float(w)) for r, racks in tree.items() for k, shards in racks.items() for s, w in shards.items()]


def sql(table: str = "documents", key: str = "doc_id", tree: dict = TREE) -> str:
    """The same placement as a query of grouped minima over the tree as a table."""
    rows = ", ".join(f"('{r}', '{k}', '{s}', {a!r}, {b!r}, {c!r})" for r, k, s, a, b, c in leaves(tree))
    draw = lambda path, w: f"-ln((CAST('0x' || substr(md5(key || '|' || {path}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {w}"
    return f"""
WITH tree(region, rack, shard, w1, w2, w3) AS (VALUES {rows}),
docs AS (SELECT {key}, coalesce(CAST({key} AS VARCHAR), 'null') AS key FROM {table}),
regions AS (SELECT DISTINCT region, w1 FROM tree), racks AS (SELECT DISTINCT region, rack, w2 FROM tree),
a AS (SELECT {key}, key, arg_min(region, {draw('region', 'w1')}) AS region FROM docs, regions GROUP BY ALL),
b AS (SELECT {key}, key, region, arg_min(rack, {draw("region || '/' || rack", 'w2')}) AS rack FROM a JOIN racks USING (region) GROUP BY ALL)
SELECT {key}, region, rack, arg_min(shard, {draw("region || '/' || rack || '/' || shard", 'w3')}) AS shard FROM b JOIN tree USING (region, rack) GROUP BY ALL"""
