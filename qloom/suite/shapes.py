"""Q1–Q35: the statement shapes of the corpora, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from qloom.operators.containment import containment_join
from qloom.plans import lookup_join, ranks_of_values
from qloom.suite.registry import query, table


def col(name):
    return F.col(name)


@query(
    "q1_multiway_join",
    """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS spent
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderstatus = 'F' GROUP BY n_name""",
)
def multiway_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return (
        orders.join(table(spark, sf_dir, "customer"), col("o_custkey") == col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), col("c_nationkey") == col("n_nationkey"))
        .join(table(spark, sf_dir, "region").filter("r_name = 'ASIA'"), col("n_regionkey") == col("r_regionkey"))
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    )


@query(
    "q2_two_key_join",
    """SELECT count(*) AS matches, count(DISTINCT a.l_orderkey) AS orders FROM lineitem a
JOIN (SELECT l_orderkey, max(l_linenumber) AS last FROM lineitem GROUP BY l_orderkey) b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.last""",
)
def two_key_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    last = items.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return items.join(last, ["l_orderkey", "l_linenumber"]).agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("l_orderkey").alias("orders")
    )


@query(
    "q3_left_join",
    """SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN
(SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY c_custkey""",
)
def left_join(spark, sf_dir):
    # Orders are counted per customer before they meet the customer table.
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        table(spark, sf_dir, "customer")
        .join(big, col("c_custkey") == col("o_custkey"), "left")
        .select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))
    )


@query(
    "q4_self_join",
    """SELECT a.l_orderkey, a.l_linenumber FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_quantity > b.l_quantity AND a.l_returnflag = 'R' AND b.l_returnflag = 'A'""",
)
def self_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    a = items.filter("l_returnflag = 'R'").withColumn("next", col("l_linenumber") + 1).alias("a")
    b = items.filter("l_returnflag = 'A'").alias("b")
    same = (col("a.l_orderkey") == col("b.l_orderkey")) & (col("a.next") == col("b.l_linenumber"))
    return a.join(b, same & (col("a.l_quantity") > col("b.l_quantity"))).select("a.l_orderkey", "a.l_linenumber")


@query(
    "q5_containment_join",
    """WITH p AS (SELECT DISTINCT lang AS pattern FROM documents UNION SELECT DISTINCT '/' || lang || '/' FROM documents
  UNION SELECT DISTINCT source FROM documents)
SELECT pattern, count(*) AS pages FROM pages JOIN p ON url LIKE '%' || pattern || '%' GROUP BY pattern""",
)
def containment(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    patterns = found.select(F.explode(F.array("lang", F.concat(F.lit("/"), "lang", F.lit("/")), "source")).alias("pattern"))
    patterns = patterns.distinct()
    matches = containment_join(table(spark, sf_dir, "pages").select("page_id", "url"), patterns, "page_id", "url", "pattern")
    return matches.groupBy("pattern").agg(F.count(F.lit(1)).alias("pages"))


@query(
    "q6_two_exists",
    """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""",
)
def two_exists(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    mine = col("c_custkey") == col("o_custkey")
    return customers.join(orders.filter("o_orderpriority = '1-URGENT'"), mine, "left_semi").join(
        orders.filter("o_totalprice > 450000"), mine, "left_semi"
    )


@query(
    "q7_in_grouped_subquery",
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN
(SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 14)""",
)
def in_grouped_subquery(spark, sf_dir):
    busy = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 14")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(busy, col("c_custkey") == col("o_custkey"), "left_semi")


@query(
    "q8_not_in_list",
    """SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') GROUP BY o_orderstatus""",
)
def not_in_list(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter(~col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q9_row_with_maximum",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice = (SELECT max(l_extendedprice) FROM lineitem)",
)
def row_with_maximum(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return items.filter(col("l_extendedprice") == items.agg(F.max("l_extendedprice")).scalar())


@query(
    "q10_below_average",
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < (SELECT avg(s_acctbal) FROM supplier)",
)
def below_average(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return suppliers.filter(col("s_acctbal") < suppliers.agg(F.avg("s_acctbal")).scalar())


@query(
    "q11_relational_division",
    """SELECT o_custkey FROM orders GROUP BY o_custkey
HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""",
)
def relational_division(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    every = orders.agg(F.count_distinct("o_orderpriority")).scalar()
    held = orders.distinct().groupBy("o_custkey").agg(F.count("o_orderpriority").alias("n"))
    return held.filter(col("n") == every).select("o_custkey")


@query(
    "q12_ratio_of_ctes",
    """WITH f AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O')
SELECT f.n AS finished, o.n AS opened, round(f.n / o.n, 6) AS ratio FROM f, o""",
)
def ratio_of_ctes(spark, sf_dir):
    both = table(spark, sf_dir, "orders").agg(
        F.count_if(col("o_orderstatus") == "F").alias("finished"), F.count_if(col("o_orderstatus") == "O").alias("opened")
    )
    return both.withColumn("ratio", F.round(F.try_divide("finished", "opened"), 6))


@query(
    "q13_count_of_derived",
    """SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n""",
)
def count_of_derived(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.groupBy("n").agg(F.count(F.lit(1)).alias("customers"))


@query(
    "q14_stacked_measures",
    """SELECT round(avg(CASE WHEN kind = 'c' THEN v END), 6) AS customer_avg, round(avg(CASE WHEN kind = 's' THEN v END), 6) AS supplier_avg
FROM (SELECT 'c' AS kind, c_acctbal AS v FROM customer UNION ALL SELECT 's', s_acctbal FROM supplier)""",
)
def stacked_measures(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), col("c_acctbal").alias("v"))
    stacked = customers.unionByName(
        table(spark, sf_dir, "supplier").select(F.lit("s").alias("kind"), col("s_acctbal").alias("v"))
    )

    def mean(kind, name):
        return F.round(F.avg(F.when(col("kind") == kind, col("v"))), 6).alias(name)

    return stacked.agg(mean("c", "customer_avg"), mean("s", "supplier_avg"))


@query(
    "q15_union_distinct",
    "SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier",
)
def union_distinct(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(col("c_nationkey").alias("nationkey"))
    return customers.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(
    "q15_intersect",
    """SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT
SELECT o_custkey FROM orders WHERE o_totalprice > 480000""",
)
def intersect(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")

    # Both sides are made distinct with partial aggregation before they meet.
    def keys(condition):
        return orders.filter(condition).select(col("o_custkey").alias("custkey")).distinct()

    return keys("o_orderstatus = 'P'").intersect(keys("o_totalprice > 480000"))


@query(
    "q16_conditional_share",
    """SELECT l_returnflag, round(100.0 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS share
FROM lineitem GROUP BY l_returnflag""",
)
def conditional_share(spark, sf_dir):
    high = F.when(col("l_discount") > 0.05, 1.0).otherwise(0.0).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(100 * F.avg(high), 6).alias("share"))


@query(
    "q17_filtered_aggregate",
    """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS big,
round(100.0 * count(*) FILTER (WHERE o_totalprice > 250000) / count(*), 6) AS share FROM orders GROUP BY o_orderstatus""",
)
def filtered_aggregate(spark, sf_dir):
    big = col("o_totalprice") > 250000
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(
        F.count_if(big).alias("big"), F.round(100 * F.avg(big.cast("double")), 6).alias("share")
    )


@query(
    "q18_conditional_sum",
    """SELECT o_custkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS finished,
round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey""",
)
def conditional_sum(spark, sf_dir):
    finished = F.when(col("o_orderstatus") == "F", col("o_totalprice")).otherwise(0.0)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.round(F.sum(finished), 2).alias("finished"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "q19_distinct_over_join",
    """SELECT c_mktsegment, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 45 GROUP BY c_mktsegment""",
)
def distinct_over_join(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = items.join(orders, col("l_orderkey") == col("o_orderkey")).join(customers, col("o_custkey") == col("c_custkey"))
    # Distinct pairs first: a segment with a third of all rows is counted in parts.
    pairs = joined.select("c_mktsegment", "l_partkey").distinct()
    return pairs.groupBy("c_mktsegment").agg(F.count("l_partkey").alias("parts"))


@query(
    "q20_range_per_group",
    "SELECT p_brand, round(max(p_retailprice) - min(p_retailprice), 2) AS spread FROM part GROUP BY p_brand",
)
def range_per_group(spark, sf_dir):
    spread = F.max("p_retailprice") - F.min("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(spread, 2).alias("spread"))


@query(
    "q21_guarded_ratio",
    """SELECT l_suppkey, round(sum(l_extendedprice) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0), 4) AS ratio
FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5""",
)
def guarded_ratio(spark, sf_dir):
    returned = F.sum(F.when(col("l_returnflag") == "R", col("l_quantity")).otherwise(0.0))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.round(F.try_divide(F.sum("l_extendedprice"), returned), 4).alias("ratio"), F.count(F.lit(1)).alias("n"))
        .filter("n > 5")
        .drop("n")
    )


@query(
    "q22_multi_key_grouping",
    """SELECT c_mktsegment, o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders
JOIN customer ON o_custkey = c_custkey GROUP BY ALL ORDER BY total DESC""",
)
def multi_key_grouping(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, col("o_custkey") == col("c_custkey"))
        .groupBy("c_mktsegment", "o_orderstatus", "o_orderpriority")
        .agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
        .orderBy(F.desc("total"))
    )


@query(
    "q23_top_group",
    """SELECT substring(CAST(o_orderdate AS VARCHAR), 1, 7) AS month, round(sum(o_totalprice), 2) AS total FROM orders
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 1""",
)
def top_group(spark, sf_dir):
    month = F.substring(col("o_orderdate").cast("string"), 1, 7).alias("month")
    totals = table(spark, sf_dir, "orders").groupBy(month).agg(F.sum("o_totalprice").alias("t"))
    return totals.orderBy(F.desc("t"), "month").limit(1).select("month", F.round("t", 2).alias("total"))


@query(
    "q24_top_by_ratio",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 6) AS unit FROM lineitem
ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber LIMIT 3""",
)
def top_by_ratio(spark, sf_dir):
    unit = F.try_divide("l_extendedprice", "l_quantity")
    rows = table(spark, sf_dir, "lineitem").withColumn("u", unit)
    first = rows.orderBy(F.desc("u"), "l_orderkey", "l_linenumber").limit(3)
    return first.select("l_orderkey", "l_linenumber", F.round("u", 6).alias("unit"))


@query(
    "q25_top_nulls_last",
    """SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
ORDER BY v DESC NULLS LAST, event_id LIMIT 20""",
)
def top_nulls_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(col("event_id") % 3 != 0, col("value")).alias("v"))
    return rows.orderBy(F.desc_nulls_last("v"), "event_id").limit(20)


@query(
    "q26_rank",
    "SELECT o_orderkey, o_totalprice, rank() OVER (ORDER BY o_totalprice DESC) AS rank FROM orders",
)
def rank(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return lookup_join(orders, ranks_of_values(orders, "o_totalprice"), ["o_totalprice"])


@query(
    "q27_distinct_null_test",
    """SELECT DISTINCT o_orderpriority, clerk IS NULL AS missing FROM
(SELECT o_orderpriority, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS clerk FROM orders) WHERE o_orderpriority IS NOT NULL""",
)
def distinct_null_test(spark, sf_dir):
    clerk = F.when(col("o_orderkey") % 5 != 0, col("o_custkey"))
    rows = table(spark, sf_dir, "orders").filter(col("o_orderpriority").isNotNull())
    return rows.select("o_orderpriority", clerk.isNull().alias("missing")).distinct()


@query(
    "q28_predicates",
    """SELECT p_partkey, p_name FROM part WHERE (p_name LIKE 'small%' OR p_type IN ('ECONOMY', 'PROMO')) AND p_name NOT LIKE '%ring'
AND p_size BETWEEN 10 AND 30""",
)
def predicates(spark, sf_dir):
    name, kind = col("p_name"), col("p_type")
    wanted = (name.like("small%") | kind.isin("ECONOMY", "PROMO")) & ~name.like("%ring") & col("p_size").between(10, 30)
    return table(spark, sf_dir, "part").filter(wanted).select("p_partkey", "p_name")


@query(
    "q29_year_month_totals",
    """SELECT CAST(date_part('year', o_orderdate) AS INTEGER) AS year, CAST(date_part('month', o_orderdate) AS INTEGER) AS month,
round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2 ORDER BY 1, 2""",
)
def year_month_totals(spark, sf_dir):
    keys = [F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")]
    totals = table(spark, sf_dir, "orders").groupBy(*keys).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals.orderBy("year", "month")


@query("q30_date_as_text", "SELECT strftime(l_shipdate, '%Y') AS year, count(*) AS items FROM lineitem GROUP BY 1")
def date_as_text(spark, sf_dir):
    year = F.date_format("l_shipdate", "yyyy").alias("year")
    return table(spark, sf_dir, "lineitem").groupBy(year).agg(F.count(F.lit(1)).alias("items"))


@query(
    "q31_age_in_years",
    """SELECT o_orderkey, CAST(date_part('year', age(TIMESTAMP '2024-02-29', o_orderdate)) AS BIGINT) AS age FROM orders
WHERE o_orderdate <= TIMESTAMP '2024-02-29'""",
)
def age_in_years(spark, sf_dir):
    today = F.lit("2024-02-29").cast("date")
    rows = table(spark, sf_dir, "orders").filter(col("o_orderdate") <= today)
    return rows.select("o_orderkey", F.floor(F.months_between(today, "o_orderdate") / 12).cast("bigint").alias("age"))


@query(
    "q32_date_range",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-31'""",
)
def date_range(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    low, high = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1996-03-31"))
    return rows.filter((col("o_orderdate") >= low) & (col("o_orderdate") <= high))


@query(
    "q33_growth_rate",
    """WITH t AS (SELECT c_mktsegment, sum(CASE WHEN year(o_orderdate) = 1996 THEN o_totalprice ELSE 0 END) AS a,
  sum(CASE WHEN year(o_orderdate) = 1997 THEN o_totalprice ELSE 0 END) AS b
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT c_mktsegment, round(100 * (b - a) / nullif(a, 0), 4) AS growth, round(abs(b - a), 2) AS change FROM t""",
)
def growth_rate(spark, sf_dir):
    def in_year(y):
        return F.sum(F.when(F.year("o_orderdate") == y, col("o_totalprice")).otherwise(0.0))

    orders = table(spark, sf_dir, "orders").filter(F.year("o_orderdate").isin(1996, 1997))
    # Totals per customer come first, so orders are shuffled once and reduced on the way.
    spent = orders.groupBy("o_custkey").agg(in_year(1996).alias("a"), in_year(1997).alias("b"))
    totals = (
        table(spark, sf_dir, "customer")
        .join(spent, col("c_custkey") == col("o_custkey"), "left")
        .groupBy("c_mktsegment")
        .agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("b"))
    )
    change = col("b") - col("a")
    return totals.select(
        "c_mktsegment", F.round(F.try_divide(100 * change, "a"), 4).alias("growth"), F.round(F.abs(change), 2).alias("change")
    )


@query(
    "q34_average_group_size",
    """WITH t AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, n, round(avg(n) OVER (), 6) AS average FROM t""",
)
def average_group_size(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("average", F.round(sizes.agg(F.avg("n")).scalar(), 6))


@query(
    "q35_monthly_series",
    """SELECT m, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT date_trunc('month', ts) AS m, value FROM events
WHERE event_type <> 'error') GROUP BY m""",
)
def monthly_series(spark, sf_dir):
    series = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    month = F.date_trunc("month", "ts").cast("timestamp_ntz").alias("m")
    return series.groupBy(month).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))
