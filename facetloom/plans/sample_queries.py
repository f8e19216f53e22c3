"""The kinds of plain query that the sample corpus asks, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .facet_queries import query, table


@query("SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 ORDER BY c_acctbal DESC, c_name LIMIT 20")
def sample_filter_sort(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select("c_name", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_name").limit(20)


@query("SELECT DISTINCT unnest(string_split(p_type, ' ')) AS word FROM part")
def sample_distinct_words(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("word")).distinct()


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def sample_group_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%' AND p_name LIKE '% %'")
def sample_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%A%") & F.col("p_name").contains(" ")).select("p_partkey", "p_name")


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def sample_case_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("class")).agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal BETWEEN 0 AND 5000 GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, n_name LIMIT 5")
def sample_join_having(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").where(F.col("c_acctbal").between(0, 5000))
    joined = customer.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "n_name").limit(5)


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def sample_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))


@query("SELECT (year(o_orderdate) // 2 * 2)::INT AS span, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY ALL")
def sample_spans(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy((F.floor(F.year("o_orderdate") / 2) * 2).cast("int").alias("span")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT yr, o_orderkey, o_totalprice FROM (SELECT year(o_orderdate)::INT AS yr, o_orderkey, o_totalprice, rank() OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC) AS r FROM orders) WHERE r = 1")
def sample_rank_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("yr"), "o_orderkey", "o_totalprice")
    return rows.withColumn("r", F.rank().over(Window.partitionBy("yr").orderBy(F.desc("o_totalprice")))).where("r = 1").drop("r")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority)::BIGINT AS kinds FROM orders GROUP BY ALL HAVING count(DISTINCT o_orderpriority) >= 4")
def sample_count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("kinds")).where("kinds >= 4")


@query("SELECT DISTINCT a.o_custkey FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def sample_both_roles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda s: orders.where(F.col("o_orderstatus") == s).select("o_custkey")
    return of("F").join(of("P"), "o_custkey", "left_semi").distinct()
