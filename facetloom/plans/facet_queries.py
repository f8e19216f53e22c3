"""Queries of the facet operators over whole tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import vector
from ..operators import counts, defs, deltas, filters, hierarchy, introspect
from ..operators.index import FacetIndex, chunk_bits, read_index
from ..sources import tables
from ..sources.catalog import Catalog
from ..sources.folders import work_dir
from ..streaming.merge import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STORED: dict[tuple[str, str, str], str] = {}


def stored_at(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The folder of a stored index, written once for a session and set of tables: queries ask indexes, they don't build them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = work_dir(spark)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored(spark: SparkSession, sf_dir: str, index: FacetIndex, name: str) -> FacetIndex:
    path = stored_at(spark, sf_dir, name, index.write)
    return read_index(spark, path, index.facets, index.key, index.table)


PRICES = [1000, 50_000, 100_000, 200_000, 400_000]


def orders_index(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> FacetIndex:
    """An index over df as it is; without one the stored index of orders."""
    built = FacetIndex.build(table(spark, sf_dir, "orders") if df is None else df, "o_orderkey", [defs.plain("o_orderstatus", "status"), defs.plain("o_orderpriority", "priority"), defs.bucket("o_totalprice", PRICES, "price"), defs.datetrunc("o_orderdate", "year", "year")], "orders")
    return stored(spark, sf_dir, built, "orders") if df is None else built


_BUCKET = " + ".join(f"(o_totalprice >= {p})::INT" for p in PRICES)
#: The same index in SQL.
ORDERS = f"""idx AS (
  SELECT 1::INT AS facet_id, 'status' AS facet_name, o_orderstatus AS facet_value, o_orderkey AS doc_id FROM orders WHERE o_orderstatus IS NOT NULL
  UNION ALL SELECT 2::INT, 'priority', o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority IS NOT NULL
  UNION ALL SELECT 3::INT, 'price', ({_BUCKET})::VARCHAR, o_orderkey FROM orders WHERE o_totalprice IS NOT NULL
  UNION ALL SELECT 4::INT, 'year', strftime(date_trunc('year', o_orderdate), '%Y-%m-%d 00:00:00'), o_orderkey FROM orders WHERE o_orderdate IS NOT NULL)"""
_COUNT = "SELECT facet_name, facet_value, count(*)::BIGINT AS cardinality, facet_id FROM idx"


def parts_index(spark: SparkSession, sf_dir: str) -> FacetIndex:
    tier = lambda: F.when(F.col("p_retailprice") < 1000, "budget").when(F.col("p_retailprice") < 1500, "middle").otherwise("premium")
    words = lambda: F.array(F.element_at(F.split("p_name", " "), 1), F.col("p_brand"))
    built = FacetIndex.build(
        table(spark, sf_dir, "part"), "p_partkey", [defs.plain("p_brand", "brand"), defs.array(F.split("p_type", " "), "tags"), defs.rating("p_size", "size"), defs.function(tier, "tier"), defs.function_array(words, "keywords"), defs.boolean(F.col("p_size") > 25, "large")], "part"
    )
    return stored(spark, sf_dir, built, "part")


PARTS = """idx AS (
  SELECT 1::INT AS facet_id, 'brand' AS facet_name, p_brand AS facet_value, p_partkey AS doc_id FROM part WHERE p_brand IS NOT NULL
  UNION ALL SELECT DISTINCT 2::INT, 'tags', unnest(string_split(p_type, ' ')), p_partkey FROM part
  UNION ALL SELECT 3::INT, 'size', p_size::VARCHAR, p_partkey FROM part WHERE p_size IS NOT NULL
  UNION ALL SELECT 4::INT, 'tier', CASE WHEN p_retailprice < 1000 THEN 'budget' WHEN p_retailprice < 1500 THEN 'middle' ELSE 'premium' END, p_partkey FROM part
  UNION ALL SELECT DISTINCT 5::INT, 'keywords', unnest([string_split(p_name, ' ')[1], p_brand]), p_partkey FROM part
  UNION ALL SELECT 6::INT, 'large', CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END, p_partkey FROM part)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    where = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(where), customer["c_nationkey"] == where["n_nationkey"])  # 25 nations, whatever the scale


def customers_index(spark: SparkSession, sf_dir: str) -> FacetIndex:
    built = FacetIndex.build(places(spark, sf_dir), "c_custkey", [defs.plain("r_name", "region"), defs.plain("n_name", "nation", parent="region"), defs.plain("c_mktsegment", "segment", parent="nation")], "customer")
    return stored(spark, sf_dir, built, "customer")


PLACES = "SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"WITH {ORDERS}, c AS ({_COUNT} GROUP BY ALL) SELECT * EXCLUDE r FROM (SELECT *, rank() OVER (PARTITION BY facet_id ORDER BY cardinality DESC) AS r FROM c) WHERE r <= 5")
def facet_top_values(spark, sf_dir):
    return counts.top_values(orders_index(spark, sf_dir), 5)


@query("SELECT 'month' AS facet_name, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d 00:00:00') AS facet_value, count(*)::BIGINT AS cardinality, 1::INT AS facet_id FROM orders WHERE o_orderdate IS NOT NULL GROUP BY ALL")
def facet_datetrunc(spark, sf_dir):
    index = FacetIndex.build(table(spark, sf_dir, "orders"), "o_orderkey", [defs.datetrunc("o_orderdate", "month", "month")])
    return counts.drill_down(index)


@query(f"WITH {ORDERS} {_COUNT} WHERE facet_name = 'price' GROUP BY ALL")
def facet_bucket(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return counts.counted(index.of("price"))


@query(f"WITH {PARTS} {_COUNT} GROUP BY ALL")
def facet_kinds(spark, sf_dir):
    """Plain, array, rating, function, function-array and boolean facets in one index."""
    return counts.drill_down(parts_index(spark, sf_dir))


@query("SELECT 'nation' AS facet_name, n_name AS facet_value, count(*)::BIGINT AS cardinality, 1::INT AS facet_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def facet_joined(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    dim = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")
    return counts.drill_down(FacetIndex.build(orders, "o_orderkey", [defs.joined(dim, "o_orderkey", "n_name", "nation")]))


@query("SELECT 1::INT AS facet_id, count_if(toxic = 1)::BIGINT AS true_count, count_if(toxic IS DISTINCT FROM 1)::BIGINT AS false_count, count(*)::BIGINT AS total_count FROM labels")
def facet_boolean_counts(spark, sf_dir):
    return counts.boolean_counts(FacetIndex.build(table(spark, sf_dir, "labels"), "doc_id", [defs.boolean(F.col("toxic") == 1, "toxic")]), "toxic")


@query(f"WITH {PARTS}, f AS (SELECT doc_id FROM idx WHERE facet_name = 'brand' AND facet_value IN ('Brand#11', 'Brand#12')) SELECT 6::INT AS facet_id, count_if(facet_value = 'true')::BIGINT AS true_count, count_if(facet_value = 'false')::BIGINT AS false_count, count(*)::BIGINT AS total_count FROM idx SEMI JOIN f USING (doc_id) WHERE facet_name = 'large'")
def facet_boolean_filtered(spark, sf_dir):
    index = parts_index(spark, sf_dir)
    return counts.boolean_counts(index, "large", filters.documents(index, {"brand": ["Brand#11", "Brand#12"]}))


_TWO = "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'"


@query(_TWO)
def filter_documents(spark, sf_dir):
    return filters.documents(orders_index(spark, sf_dir), {"status": ["F", "O"], "priority": "1-URGENT"})


@query(_TWO)
def filter_comma_list(spark, sf_dir):
    return filters.documents(orders_index(spark, sf_dir), '{"status": "F,O", "priority": "1-URGENT"}', comma_or=True)


@query(f"WITH {PARTS} SELECT a.doc_id FROM idx a JOIN idx b USING (doc_id) WHERE a.facet_id = 2 AND a.facet_value = (SELECT min(facet_value) FROM idx WHERE facet_id = 2) AND b.facet_id = 6 AND b.facet_value = 'true'")
def filter_every_value(spark, sf_dir):
    index = parts_index(spark, sf_dir)
    first = index.of("tags").agg(F.min("facet_value")).first()[0]
    return filters.documents(index, [{"facet_name": "tags", "value": first}, {"facet_name": "large", "value": True}], match_all=True)


@query(f"SELECT doc_id FROM ({_TWO}) ORDER BY doc_id LIMIT 25 OFFSET 10")
def filter_page(spark, sf_dir):
    return filters.page(filters.documents(orders_index(spark, sf_dir), {"status": ["F", "O"], "priority": "1-URGENT"}), 25, 10)


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderstatus = 'P'")
def documents_with_value(spark, sf_dir):
    return filters.with_value(orders_index(spark, sf_dir), "status", "P")


@query(f"WITH {ORDERS}, f AS ({_TWO}) {_COUNT} SEMI JOIN f USING (doc_id) WHERE facet_name = 'year' GROUP BY ALL ORDER BY cardinality DESC, facet_value LIMIT 10")
def counts_of_one_facet(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return counts.facet_counts(index, "year", filters.documents(index, {"status": ["F", "O"], "priority": "1-URGENT"}), 10)


@query(f"WITH {ORDERS}, f AS ({_TWO}), c AS ({_COUNT} SEMI JOIN f USING (doc_id) GROUP BY ALL) SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY facet_id ORDER BY cardinality DESC, facet_value) AS r FROM c) WHERE r <= 3")
def counts_top_filtered(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return counts.top_counts(index, filters.documents(index, {"status": ["F", "O"], "priority": "1-URGENT"}), 3)


@query(f"WITH {ORDERS}, f AS ({_TWO}) {_COUNT} SEMI JOIN f USING (doc_id) WHERE facet_id IN (3, 4) GROUP BY ALL")
def counts_drill_down(spark, sf_dir):
    return counts.drill_down(orders_index(spark, sf_dir), {"status": ["F", "O"], "priority": "1-URGENT"})


@query(f"WITH {PARTS} SELECT facet_id, facet_name, facet_value, count(*)::BIGINT AS cardinality FROM idx GROUP BY ALL")
def cardinality_stats(spark, sf_dir):
    return parts_index(spark, sf_dir).cardinality()


@query(f"WITH {ORDERS} SELECT facet_id, facet_value, count(*)::BIGINT AS cardinality, count(DISTINCT (doc_id - 1) // 32768 + 1)::BIGINT AS chunks FROM idx WHERE doc_id > 0 GROUP BY ALL")
def packed_cardinality(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    index.rows = index.rows.where("doc_id > 0")
    return index.packed().groupBy("facet_id", "facet_value").agg(F.sum("cardinality").alias("cardinality"), F.count("*").alias("chunks"))


def _sets(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return filters.with_value(index, "status", "F"), filters.with_value(index, "priority", "2-HIGH")


_F, _H = "o_orderstatus IS NOT DISTINCT FROM 'F'", "o_orderpriority IS NOT DISTINCT FROM '2-HIGH'"


@query(f"SELECT 'and' AS op, count_if({_F} AND {_H})::BIGINT AS n FROM orders UNION ALL SELECT 'or', count_if({_F} OR {_H})::BIGINT FROM orders UNION ALL SELECT 'andnot', count_if({_F} AND NOT {_H})::BIGINT FROM orders UNION ALL SELECT 'xor', count_if(({_F}) <> ({_H}))::BIGINT FROM orders")
def set_algebra(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    out = None
    for name, f in (("and", filters.both), ("or", filters.either), ("andnot", filters.without), ("xor", filters.one_of)):
        rows = f(a, b).agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"SELECT o_orderkey AS doc_id FROM orders WHERE {_F} AND {_H} AND o_orderkey > 0")
def packed_and(spark, sf_dir):
    return filters.unpack(filters.packed_all([filters.pack(s.where("doc_id > 0")) for s in _sets(spark, sf_dir)]))


@query(f"SELECT o_orderkey AS doc_id FROM orders WHERE ({_F} OR {_H}) AND o_orderkey > 0")
def packed_or(spark, sf_dir):
    return filters.unpack(filters.packed_any([filters.pack(s.where("doc_id > 0")) for s in _sets(spark, sf_dir)]))


@query(f"WITH c AS ({PLACES}) SELECT 'region' AS parent_facet, r_name AS parent_value, 'nation' AS child_facet, n_name AS child_value, count(*)::BIGINT AS cardinality FROM c GROUP BY ALL UNION ALL SELECT 'nation', n_name, 'segment', c_mktsegment, count(*)::BIGINT FROM c GROUP BY ALL")
def hierarchy_edges(spark, sf_dir):
    return hierarchy.edges(customers_index(spark, sf_dir))


@query(f"WITH c AS ({PLACES}) SELECT 'region' AS ancestor_facet, r_name AS ancestor_value, 'nation' AS facet, n_name AS value, count(*)::BIGINT AS cardinality FROM c GROUP BY ALL UNION ALL SELECT 'nation', n_name, 'segment', c_mktsegment, count(*)::BIGINT FROM c GROUP BY ALL UNION ALL SELECT 'region', r_name, 'segment', c_mktsegment, count(*)::BIGINT FROM c GROUP BY ALL")
def hierarchy_closure(spark, sf_dir):
    return hierarchy.closure(customers_index(spark, sf_dir))


@query(f"WITH c AS ({PLACES}) SELECT 0::INT AS level, r_name AS path, r_name AS value, count(*)::BIGINT AS cardinality FROM c GROUP BY ALL UNION ALL SELECT 1::INT, r_name || ' > ' || n_name, n_name, count(*)::BIGINT FROM c GROUP BY ALL UNION ALL SELECT 2::INT, r_name || ' > ' || n_name || ' > ' || c_mktsegment, c_mktsegment, count(*)::BIGINT FROM c GROUP BY ALL")
def hierarchy_paths(spark, sf_dir):
    return hierarchy.paths(customers_index(spark, sf_dir), "region")


@query(f"WITH c AS ({PLACES}), f AS (SELECT * FROM c WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), top AS (SELECT r_name FROM f GROUP BY r_name ORDER BY count(*) DESC, r_name LIMIT 3), g AS (SELECT * FROM f SEMI JOIN top USING (r_name)) SELECT 0::INT AS level, r_name AS path, r_name AS value, count(*)::BIGINT AS cardinality FROM g GROUP BY ALL UNION ALL SELECT 1::INT, r_name || ' > ' || n_name, n_name, count(*)::BIGINT FROM g GROUP BY ALL UNION ALL SELECT 2::INT, r_name || ' > ' || n_name || ' > ' || c_mktsegment, c_mktsegment, count(*)::BIGINT FROM g GROUP BY ALL")
def hierarchy_filtered(spark, sf_dir):
    index = customers_index(spark, sf_dir)
    return hierarchy.paths(index, "region", filters.documents(index, {"segment": ["BUILDING", "MACHINERY"]}), 3)


@query("SELECT * FROM (VALUES ('region', NULL, true, 0::INT), ('nation', 'region', false, 1::INT), ('segment', 'nation', false, 2::INT)) t(facet_name, parent, is_root, depth)")
def hierarchy_levels(spark, sf_dir):
    rows = [(r["facet_name"], r["parent"], r["is_root"], r["depth"]) for r in hierarchy.levels(customers_index(spark, sf_dir))]
    return spark.createDataFrame(rows, "facet_name string, parent string, is_root boolean, depth int")


def _changes(spark, sf_dir):
    """Deterministic changes of orders: of keys 0 mod 10 inserts, of others 0 mod 7 deletes, of the rest 0 mod 5 updates."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    op = F.when(key % 10 == 0, "insert").when(key % 7 == 0, "delete").when(key % 5 == 0, "update")
    row = F.struct(*orders.columns)
    changed = F.struct(*[F.lit("1-URGENT").alias(c) if c == "o_orderpriority" else F.col(c) for c in orders.columns])
    out = orders.withColumn("op", op).where(F.col("op").isNotNull())
    return orders.where(key % 10 != 0), out.select("op", F.when(F.col("op") != "insert", row).alias("old"), F.when(F.col("op") == "update", changed).when(F.col("op") == "insert", row).alias("new"))


_AFTER = f"""orders AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 10 <> 0 AND o_orderkey % 5 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
  FROM base WHERE o_orderkey % 10 = 0 OR o_orderkey % 7 <> 0)"""


@query(f"WITH base AS (SELECT * FROM main.orders), {_AFTER}, {ORDERS} SELECT facet_id, facet_name, facet_value, doc_id FROM idx")
def delta_merge(spark, sf_dir):
    base, changes = _changes(spark, sf_dir)
    index = orders_index(spark, sf_dir, base)
    return deltas.apply(index, deltas.net(deltas.of_changes(changes, index.key, index.facets))).rows


@query(ORACLES["delta_merge"])
def delta_merge_blocks(spark, sf_dir):
    """The same changes merged into a store, of which only the touched blocks are written anew."""
    base, changes = _changes(spark, sf_dir)
    index, store = orders_index(spark, sf_dir, base), Store(spark, work_dir(spark))
    store.write(index.rows)
    store.merge(deltas.net(deltas.of_changes(changes, index.key, index.facets)))
    return store.read()


@query(f"""WITH base AS (SELECT * FROM main.orders), {_AFTER}, {ORDERS} SELECT a.facet_name AS parent_facet, a.facet_value AS parent_value, b.facet_name AS child_facet, b.facet_value AS child_value, count(*)::BIGINT AS cardinality
FROM idx a JOIN idx b USING (doc_id) WHERE a.facet_id = 1 AND b.facet_id = 2 GROUP BY ALL""")
def hierarchy_edges_changed(spark, sf_dir):
    """Edges kept current from the documents that a merge touches."""
    base, changes = _changes(spark, sf_dir)
    index = FacetIndex.build(base, "o_orderkey", [defs.plain("o_orderstatus", "status"), defs.plain("o_orderpriority", "priority", parent="status")])
    net = deltas.net(deltas.of_changes(changes, index.key, index.facets))
    return hierarchy.edges_changed(hierarchy.edges(index), index, deltas.apply(index, net), net.select("doc_id"))


@query(f"""WITH idx0 AS (WITH {ORDERS} SELECT * FROM idx WHERE doc_id % 10 <> 0), base AS (SELECT * FROM main.orders), idx1 AS (WITH {_AFTER}, {ORDERS} SELECT * FROM idx),
d AS (SELECT *, 1 AS delta FROM idx1 UNION ALL SELECT *, -1 FROM idx0)
SELECT facet_id, facet_name, facet_value, doc_id, sum(delta)::INT AS delta FROM d GROUP BY ALL HAVING sum(delta) <> 0""")
def delta_net(spark, sf_dir):
    _, changes = _changes(spark, sf_dir)
    index = orders_index(spark, sf_dir)
    return deltas.net(deltas.of_changes(changes, index.key, index.facets))


@query("""SELECT * FROM (VALUES ('a', 0::BIGINT, 'nothing to merge', 'ok'), ('b', 500::BIGINT, 'merge when convenient', 'info'), ('c', 5000::BIGINT, 'merge soon', 'info'), ('d', 50000::BIGINT, 'merge now', 'warning'), ('e', 500000::BIGINT, 'merge at once', 'critical')) t("table", delta_count, recommendation, alert_level)""")
def delta_status(spark, sf_dir):
    return deltas.status(spark.createDataFrame([("a", 0), ("b", 500), ("c", 5000), ("d", 50000), ("e", 500000)], "table string, delta_count long"))


_NEAR = """q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), near AS (SELECT vec_id, label FROM embeddings, q
  ORDER BY list_sum(list_transform(range(1, len(v) + 1), lambda i: (embedding[i]::DOUBLE - v[i]::DOUBLE) * (embedding[i]::DOUBLE - v[i]::DOUBLE))), vec_id LIMIT 1000)"""


def _embeddings(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    query_vector = vector(df.where("vec_id = 0").select("embedding").first()[0])
    return df, FacetIndex.build(df, "vec_id", [defs.plain("label")], "embeddings"), query_vector


@query(f"WITH {_NEAR} SELECT 'label' AS facet_name, label::VARCHAR AS facet_value, count(*)::BIGINT AS cardinality, 1::INT AS facet_id FROM near WHERE label IS NOT NULL GROUP BY ALL ORDER BY cardinality DESC, facet_value LIMIT 10")
def counts_near_vector(spark, sf_dir):
    """Facet counts over the 1000 documents nearest to a vector (the operator's own number)."""
    df, index, v = _embeddings(spark, sf_dir)
    return counts.counts_near(index, "label", counts.nearest(df, "vec_id", "embedding", v, 1000))


@query(f"WITH {_NEAR} SELECT vec_id AS doc_id FROM near WHERE label IN (1, 2)")
def filter_near_vector(spark, sf_dir):
    df, index, v = _embeddings(spark, sf_dir)
    return filters.both(counts.nearest(df, "vec_id", "embedding", v, 1000).select("doc_id"), filters.documents(index, {"label": ["1", "2"]}))


@query("""SELECT * FROM (VALUES (1::INT, 'brand', 'plain', false, 'dropdown'), (2::INT, 'tags', 'array', true, 'multiselect'), (3::INT, 'size', 'rating', false, 'rating'), (4::INT, 'tier', 'function', false, 'dropdown'), (5::INT, 'keywords', 'function_array', true, 'multiselect'), (6::INT, 'large', 'boolean', false, 'checkbox')) t(facet_id, facet_name, facet_type, is_multi, ui_component)""")
def facets_for_ui(spark, sf_dir):
    index = parts_index(spark, sf_dir)
    shown = F.create_map(*[F.lit(x) for r in introspect.for_ui(index) for x in (r["facet_name"], r["ui_component"])])
    return introspect.facet_list(index, spark).select("facet_name", "facet_id", "facet_type", "is_multi", shown[F.col("facet_name")].alias("ui_component"))


@query(f"WITH {ORDERS} SELECT facet_id, facet_name, facet_value, doc_id FROM idx WHERE facet_id <> 2 UNION ALL SELECT 5::INT, 'customer', o_custkey::VARCHAR, o_orderkey FROM orders WHERE o_custkey IS NOT NULL")
def add_and_drop_facets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    index, _ = orders_index(spark, sf_dir).add([defs.plain("o_custkey", "customer")], orders).drop(["priority", "unknown"])
    return index.rows


@query(f"WITH {ORDERS} SELECT facet_id, facet_name, facet_value, doc_id FROM idx")
def facet_index_build(spark, sf_dir):
    """The index as it is built, not read."""
    return orders_index(spark, sf_dir, table(spark, sf_dir, "orders")).rows


@query(f"WITH {ORDERS} SELECT facet_id, facet_name, facet_value, doc_id FROM idx")
def refresh_facets(spark, sf_dir):
    """A stored index of two of three documents' years ago, refreshed facet by facet from today's table."""
    orders = table(spark, sf_dir, "orders")
    index = stored(spark, sf_dir, orders_index(spark, sf_dir, orders.where("year(o_orderdate) < 1996")), "orders before 1996")
    for names in (["status", "priority"], ["price"], ["year"]):
        index = index.refresh(orders, names)
    return index.rows


@query("SELECT column_name AS facet_name, count(*)::BIGINT AS cardinality FROM (UNPIVOT (SELECT c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer) ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY ALL")
def facets_from_columns(spark, sf_dir):
    """Facets inferred from the schema, set up in one call."""
    customer = table(spark, sf_dir, "customer")
    customer = customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    index, _ = tables.set_up(customer, "c_custkey")
    return index.rows.groupBy("facet_name").agg(F.count("*").alias("cardinality"))


@query(f"WITH {PARTS} SELECT doc_id FROM idx WHERE facet_id = 6 AND facet_value = 'true'")
def documents_with_flag(spark, sf_dir):
    return filters.with_value(parts_index(spark, sf_dir), "large", True)


@query(f"WITH {ORDERS} SELECT facet_name, count(*)::BIGINT AS n, count_if(facet_value = '1-URGENT')::BIGINT AS urgent FROM idx WHERE facet_name IN ('status', 'priority') GROUP BY ALL")
def cardinality_lookup(spark, sf_dir):
    index = orders_index(spark, sf_dir)
    return spark.createDataFrame([(n, index.cardinality_of(n), index.cardinality_of(n, "1-URGENT")) for n in ("status", "priority")], "facet_name string, n long, urgent long")


@query("SELECT count(*)::BIGINT AS n, (CASE WHEN count(*) < 100000 THEN 16 WHEN count(*) < 1000000 THEN 18 WHEN count(*) < 10000000 THEN 20 ELSE 22 END)::INT AS bits FROM lineitem")
def chunk_width(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(n, chunk_bits(n))], "n long, bits int")


@query(f"SELECT (count_if(o_orderkey = 1 AND {_F}) > 0) AS has_one, (count_if(NOT coalesce({_F}, false)) = 0) AS all_f, true AS same FROM orders")
def set_predicates(spark, sf_dir):
    """Membership and equality of sets."""
    index = orders_index(spark, sf_dir)
    f, everything = filters.with_value(index, "status", "F"), table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("doc_id"))
    return spark.createDataFrame([(filters.contains(f, 1), filters.equal(f, everything), filters.equal(f, filters.both(f, everything)))], "has_one boolean, all_f boolean, same boolean")


@query(f"WITH {ORDERS}, c AS ({_COUNT} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY facet_id ORDER BY cardinality DESC, facet_value) AS r FROM c), g AS (SELECT facet_id, facet_name, list({{'value': facet_value, 'count': cardinality}} ORDER BY r) AS values FROM r WHERE r <= 3 GROUP BY ALL) SELECT to_json(list({{'facet_id': facet_id, 'facet_name': facet_name, 'values': values}} ORDER BY facet_id))::VARCHAR AS facets FROM g")
def counts_as_json(spark, sf_dir):
    return counts.as_json(counts.top_counts(orders_index(spark, sf_dir), None, 3))


_LEVEL = "row_number() OVER (PARTITION BY {0} ORDER BY {1} DESC, {2}) AS r"


@query(f"""WITH c AS ({PLACES}), l2 AS (SELECT r_name, n_name, c_mktsegment, count(*)::BIGINT AS n FROM c GROUP BY ALL), k2 AS (SELECT *, {_LEVEL.format("r_name, n_name", "n", "c_mktsegment")} FROM l2),
g2 AS (SELECT r_name, n_name, list({{'value': c_mktsegment, 'count': n}} ORDER BY r) AS children FROM k2 WHERE r <= 3 GROUP BY ALL),
l1 AS (SELECT r_name, n_name, count(*)::BIGINT AS n FROM c GROUP BY ALL), k1 AS (SELECT *, {_LEVEL.format("r_name", "n", "n_name")} FROM l1),
g1 AS (SELECT r_name, list({{'value': n_name, 'count': n, 'children': children}} ORDER BY r) AS children FROM k1 JOIN g2 USING (r_name, n_name) WHERE r <= 3 GROUP BY ALL),
l0 AS (SELECT r_name, count(*)::BIGINT AS n FROM c GROUP BY ALL), k0 AS (SELECT *, row_number() OVER (ORDER BY n DESC, r_name) AS r FROM l0)
SELECT '{{"hierarchies":[' || to_json({{'facet': 'region', 'values': list({{'value': r_name, 'count': n, 'children': children}} ORDER BY r)}}) || '],"regular":[]}}' AS facets FROM k0 JOIN g1 USING (r_name) WHERE r <= 3""")
def hierarchy_json(spark, sf_dir):
    """The three most frequent values at every level, nested."""
    return hierarchy.facets_json(customers_index(spark, sf_dir), 3)


@query("""SELECT * FROM (VALUES ('orders', 'status', 'plain', 'o_orderstatus', 'dropdown'), ('orders', 'priority', 'plain', 'o_orderpriority', 'dropdown'), ('orders', 'price', 'bucket', 'o_totalprice', 'range'), ('orders', 'year', 'datetrunc', 'o_orderdate', 'datepicker')) t("table", facet_name, facet_type, base_column, ui_component)""")
def catalog_reopened(spark, sf_dir):
    """What a stored table is made of, as another session would read it."""
    path = work_dir(spark)
    Catalog(spark, path).save("orders", orders_index(spark, sf_dir, table(spark, sf_dir, "orders")))
    index, _ = Catalog(spark, path).open("orders")
    told, kinds = introspect.describe(index), introspect.facet_types(index)
    ui = {r["facet_name"]: r["ui_component"] for r in introspect.introspect(index)["facets"]}
    return spark.createDataFrame([(told["table"], n, kinds[n], index.facet(n).column, ui[n]) for n in introspect.facet_names(index)], "table string, facet_name string, facet_type string, base_column string, ui_component string")


@query(f"WITH {ORDERS} {_COUNT} GROUP BY ALL")
def catalog_counts(spark, sf_dir):
    """Counts over a table opened from the catalogue."""
    path = work_dir(spark)
    Catalog(spark, path).save("orders", orders_index(spark, sf_dir, table(spark, sf_dir, "orders")))
    return counts.drill_down(Catalog(spark, path).open("orders")[0])


@query(f"WITH base AS (SELECT * FROM main.orders), {_AFTER}, {ORDERS} {_COUNT} WHERE facet_id = 2 GROUP BY ALL")
def maintained_counts(spark, sf_dir):
    """Counts that merge what is pending first."""
    base, changes = _changes(spark, sf_dir)
    kept = deltas.Maintained(orders_index(spark, sf_dir, base))
    kept.change(changes)
    return counts.counted(kept.current().of("priority"))


@query(f"WITH base AS (SELECT * FROM main.orders), {_AFTER}, {ORDERS}, old AS (WITH orders AS (SELECT * FROM main.orders WHERE o_orderkey % 10 <> 0), {ORDERS} SELECT * FROM idx), d AS ((SELECT * FROM idx EXCEPT SELECT * FROM old) UNION ALL (SELECT * FROM old EXCEPT SELECT * FROM idx)) SELECT 'orders' AS \"table\", count(*)::BIGINT AS rows_merged, 'success' AS status, count(*)::BIGINT AS delta_count, false AS merged_early FROM d")
def maintained_history(spark, sf_dir):
    """The history of a merge, after a threshold that wasn't reached."""
    base, changes = _changes(spark, sf_dir)
    kept = deltas.Maintained(orders_index(spark, sf_dir, base))
    kept.change(changes)
    early = kept.merge_if(10**9)["merged"]
    done = deltas.merge_all([kept])[0]
    return spark.createDataFrame([(done["table"], done["rows_merged"], kept.history[0]["status"], kept.history[0]["delta_count"], early)], "table string, rows_merged long, status string, delta_count long, merged_early boolean")
