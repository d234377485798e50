"""The registered queries: each applies an operator to a whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.paths import path_segment_after
from docframe.operators.items import Items
from docframe.operators.root import Root
from docframe.operators.root import query as root
from docframe.sources import read

from .catalog import query

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax"


def table(spark, sf_dir: str, name: str, order: list[str] | None = None) -> Items:
    return read(spark, f"{sf_dir}/{name}.parquet").array_root(order)


def nested(spark, sf_dir: str) -> Root:
    """A document: ``customers``, an array with names, accounts and a nation each, in order of their keys."""
    c, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    both = c.join(n, c.c_nationkey == n.n_nationkey)
    item = F.struct("c_custkey", "c_name", F.struct("c_acctbal", "c_mktsegment").alias("account"), F.struct("n_name", "n_regionkey").alias("nation"), F.split("c_name", "#").alias("tags"))
    return root(both.agg(F.array_sort(F.collect_list(item)).alias("customers")))


def sections(spark, sf_dir: str) -> Root:
    """A document: ``regions``, an object with a group of nations for each region's name."""
    r, n = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation"))
    group = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    by = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_regionkey", "r_name").agg(group.alias("nations"))
    entry = F.struct("r_name", F.struct("nations").alias("value"))
    entries = by.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", entry.alias("e")))).alias("x"))
    return root(entries.select(F.map_from_entries(F.transform("x", lambda e: e["e"])).alias("regions")))


# the flagship: conditions and an aggregate in one pass


@query("SELECT coalesce(sum(l_extendedprice * l_discount), 0) AS revenue, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24")
def sum_of_products(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "lineitem").where("l_discount").gte(0.05).where("l_discount").lte(0.07).where("l_quantity").lt(24)
    return q.aggregate().sum_of_products("l_extendedprice", "l_discount", alias="revenue").count(alias="n").df()


# scans and groups


@query("SELECT c_custkey, c_name, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def array_items(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").pick({"c_custkey": "c_custkey", "c_name": "c_name", "c_acctbal": "account.c_acctbal", "n_name": "nation.n_name"}).unordered()


@query("SELECT * FROM region")
def array_root(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region", ["r_regionkey"]).all()


@query("SELECT min(c_custkey) AS first, max_by(n_name, -c_custkey) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def root_pick(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).pick({"first": "customers[0].c_custkey", "nation": "customers[0].nation.n_name"}).all()


@query("SELECT r_name AS key, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def groups_entries(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).object_groups("regions").entries().unordered().select("key", F.size("value.nations").cast("long").alias("n"))


@query("SELECT r_name AS key FROM region WHERE r_name IN ('ASIA', 'EUROPE')")
def groups_include(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).object_groups("regions").include(["ASIA", "EUROPE"]).entries().unordered().select("key")


@query("SELECT count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA') GROUP BY r_name")
def groups_exclude_values(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).object_groups("regions").exclude(["ASIA"]).values().unordered().select(F.size("value.nations").cast("long").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'")
def groups_arrays(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).object_groups("regions").exclude(["AFRICA"]).arrays("nations").unordered()


@query("SELECT 'regions.' || r_name || '.nations[' || (row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1) || ']' AS path FROM nation JOIN region ON n_regionkey = r_regionkey QUALIFY n_name LIKE '%I%'")
def groups_path(spark, sf_dir) -> DataFrame:
    return sections(spark, sf_dir).object_groups("regions").arrays("nations").where("n_name").case_sensitive().contains("I").path().unordered()


# conditions


@query("SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def where_equals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment").equals(" Building ").pick("c_custkey").unordered()


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def where_equals_case(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment").case_sensitive().eq("BUILDING").pick("c_custkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def where_ne(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus").ne("f").pick("o_orderkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE NOT o_orderpriority ILIKE '%urgent%'")
def where_not_contains(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where_not("o_orderpriority").contains("urgent").pick("o_orderkey").unordered()


@query("SELECT p_partkey FROM part WHERE p_type ILIKE '%steel%'")
def where_contains(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type").contains("Steel").pick("p_partkey").unordered()


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_type), 'promo')")
def where_starts_with(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_type").starts_with("promo").pick("p_partkey").unordered()


@query("SELECT p_partkey FROM part WHERE ends_with(p_brand, '3')")
def where_ends_with(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_brand").ends_with("3").pick("p_partkey").unordered()


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#[12][0-9]?$')")
def where_matches(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_brand").matches(re.compile(r"^brand#[12][0-9]?$", re.I)).pick("p_partkey").unordered()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000")
def where_range(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_totalprice").greater_than(100000).where_not("o_totalprice").greater_than(200000).pick("o_orderkey", "o_totalprice").unordered()


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def where_in(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").where_in("n_regionkey", [1, 3]).pick("n_nationkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def where_all(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").where_all({"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}).pick("o_orderkey").unordered()


@query("SELECT event_id FROM events WHERE (event_type = 'click' AND value >= 10) OR (event_type NOT IN ('click', 'view') AND NOT (value < 50)) OR user_id % 7 = 3")
def where_sift(spark, sf_dir) -> DataFrame:
    either = {"$or": [{"event_type": "click", "value": {"$gte": 10}}, {"event_type": {"$nin": ["click", "view"]}, "value": {"$not": {"$lt": 50}}}, {"user_id": {"$mod": [7, 3]}}]}
    return table(spark, sf_dir, "events").where_sift(either).pick("event_id").unordered()


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 AND n_regionkey <> 2")
def where_nested(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").where_sift({"account.c_acctbal": {"$gt": 5000}, "nation.n_regionkey": {"$ne": 2}, "tags": {"$size": 2, "$exists": True}}).pick("c_custkey").unordered()


@query("SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#%7'")
def where_elements(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").where("tags").starts_with("customer").where("tags.1").ends_with("7").pick("c_custkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 150000) AND o_orderpriority ILIKE '1-%'")
def filter_expression(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus == 'F' or o_totalprice > 150000 and o_orderpriority startsWith '1-'").pick("o_orderkey").unordered()


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE floor(l_discount * 10 + 0.5) / 10 = 0.1 AND l_returnflag <> 'R'")
def filter_decimals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_discount == 0.1 and l_returnflag != 'R'", decimals=1).pick("l_orderkey", "l_linenumber", "l_discount").unordered()


@query("SELECT p_partkey FROM part WHERE p_size >= 20 AND p_brand ILIKE '%#1%' AND NOT starts_with(lower(p_type), 'small')")
def filter_if_present(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "part").filter_if_present("").where_if_present("p_name", None).greater_than_or_equal_if_present("p_size", 20).less_than_if_present("p_size", None)
    return q.contains_if_present("p_brand", "#1").not_starts_with_if_present("p_type", "small").ends_with_if_present("p_type", None).pick("p_partkey").unordered()


# aggregates


@query("SELECT sum(c_acctbal) AS sum, sum(c_acctbal) / count(*) AS average, min(c_acctbal) AS min, max(c_acctbal) AS max, count(*) AS count FROM customer WHERE c_mktsegment = 'MACHINERY'")
def aggregates(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_mktsegment").eq("machinery").aggregate().sum("c_acctbal").average("c_acctbal").min("c_acctbal").max("c_acctbal").count().df()


@query("SELECT 0.0::DOUBLE AS sum, min((json_extract_string(props, '$.k'))::DOUBLE) AS min, max((json_extract_string(props, '$.k'))::DOUBLE) AS max FROM events")
def aggregates_of_texts(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "events").map(lambda e: {"k": F.get_json_object(e["props"], "$.k")})
    return q.aggregate().sum("k").min("k").max("k").df()


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS found, NOT EXISTS (SELECT 1 FROM orders WHERE NOT o_totalprice > 0) AS every, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n")
def exists_every_count(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "orders")
    found = (q.where("o_totalprice").gt(400000).exists(), q.where("o_totalprice").gt(0).every(), q.where("o_orderstatus").eq("P").count())
    return spark.createDataFrame([found], "found boolean, every boolean, n bigint")


@query("SELECT l_returnflag AS key, sum(l_quantity) AS quantity, sum(l_extendedprice) / count(*) AS price, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def group_by_aggregate(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").group_by("l_returnflag").aggregate(quantity=("sum", "l_quantity"), price=("average", "l_extendedprice"), n=("count", ""))


@query("SELECT n_regionkey::VARCHAR AS key, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def group_by_items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation", ["n_nationkey"]).group_by("n_regionkey").all().select("key", F.transform("items", lambda i: i["n_name"]).alias("names"))


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def distinct_first(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events", ["event_id"]).distinct("user_id").pick("user_id", "event_id").unordered()


@query("SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, l_linestatus AS n FROM lineitem) GROUP BY ALL")
def distinct_items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").map(lambda i: {"l_shipmode": i["l_returnflag"], "n": i["l_linestatus"]}).distinct().unordered()


@query("SELECT n_name, min(c_custkey) AS c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def distinct_deep(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").distinct("n_name").pick({"n_name": "nation.n_name", "c_custkey": "c_custkey"}).unordered()


# order and selection


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_take(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).sort("o_totalprice", "desc").take(25).pick("o_orderkey", "o_totalprice").unordered()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 100")
def sort_drop(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).sort("o_totalprice").drop(100).pick("o_orderkey").unordered()


@query("SELECT min(o_orderkey) AS first, max(o_orderkey) AS last, (SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 7 LIMIT 1) AS nth, 1::BIGINT AS one FROM orders")
def first_last_nth_one(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "orders", ["o_orderkey"])
    values = [q.first()["o_orderkey"], q.last()["o_orderkey"], q.nth(7)["o_orderkey"], q.where("o_orderkey").eq(q.first()["o_orderkey"]).one()["o_orderkey"]]
    return spark.createDataFrame([(*values[:3], 1 if values[3] == values[0] else 0)], "first bigint, last bigint, nth bigint, one bigint")


@query("SELECT count(*) AS n FROM region WHERE r_regionkey >= 0 LIMIT 1")
def random_any(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "region", ["r_regionkey"])
    seen = {q.random(seed=s)["r_regionkey"] for s in range(3)} | {q.any()["r_regionkey"]}
    return spark.createDataFrame([(q.count() if seen <= {r["r_regionkey"] for r in q.to_list()} else 0,)], "n bigint")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)")
def take_while(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).take_while(lambda o: o["o_totalprice"] <= 300000).pick("o_orderkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE o_orderkey >= (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 300000)")
def drop_while(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).drop_while(lambda o: o["o_totalprice"] <= 300000).pick("o_orderkey").unordered()


@query("SELECT 'yes' AS side, count(*) AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'no', count(*) FROM orders WHERE o_orderstatus <> 'F'")
def partition(spark, sf_dir) -> DataFrame:
    yes, no = table(spark, sf_dir, "orders").partition(lambda o: o["o_orderstatus"] == "F")
    return yes.aggregate().count(alias="n").df().withColumn("side", F.lit("yes")).unionByName(no.aggregate().count(alias="n").df().withColumn("side", F.lit("no")))


# projections, values, positions


@query("SELECT p_name AS value FROM part WHERE p_size = 10")
def pluck(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_size").eq(10).pluck("p_name").unordered()


@query("SELECT c_custkey, c_acctbal AS \"account.c_acctbal\" FROM customer")
def pick(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").pick("c_custkey", "account.c_acctbal").unordered()


@query("SELECT n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey")
def find_all(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").find_all("n_name").unordered()


@query("SELECT c_acctbal AS value FROM customer")
def find_all_path(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").find_all("account.c_acctbal").unordered()


@query("SELECT o_custkey::VARCHAR AS value FROM orders")
def values_string(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").pluck("o_custkey").string().unordered()


@query("SELECT json_extract_string(props, '$.k')::DOUBLE AS value FROM events")
def values_number(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").map(lambda e: {"k": F.get_json_object(e["props"], "$.k")}).pluck("k").number().unordered()


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders QUALIFY o_totalprice > 200000")
def index(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).where("o_totalprice").gt(200000).index().unordered()


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS index, c_custkey FROM customer QUALIFY c_acctbal < 0")
def all_with_index(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").where("account.c_acctbal").lt(0).all_with_index().unordered().select("index", "c_custkey")


@query("SELECT 'customers[' || (row_number() OVER (ORDER BY c_custkey) - 1) || ']' AS path FROM customer QUALIFY c_acctbal > 9000")
def path(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").where("account.c_acctbal").gt(9000).path().unordered()


@query("SELECT r_name AS segment FROM nation JOIN region ON n_regionkey = r_regionkey")
def path_segment(spark, sf_dir) -> DataFrame:
    paths = sections(spark, sf_dir).object_groups("regions").arrays("nations").path().unordered()
    return paths.select(path_segment_after(F.col("path"), "regions").alias("segment"))


# transforms


@query("SELECT l_extendedprice * (1 - l_discount) AS net, l_orderkey FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000")
def map_then_where(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").map(lambda i: {"net": i["l_extendedprice"] * (1 - i["l_discount"]), "l_orderkey": i["l_orderkey"]}).where("net").gt(50000).unordered()


@query("SELECT s_suppkey * 2 + s_nationkey AS value FROM supplier")
def map_python(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").map(lambda s: int(s["s_suppkey"]) * 2 + int(s["s_nationkey"]), "bigint").unordered()


@query("SELECT l_quantity * l_tax AS value FROM lineitem")
def map2(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").map2("l_quantity", "l_tax", lambda a, b: a * b).unordered()


@query("SELECT l_quantity * (1 + l_tax) - l_discount AS value FROM lineitem")
def mapn(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").mapn(["l_quantity", "l_tax", "l_discount"], lambda q, t, d: q * (1 + t) - d).unordered()


@query("SELECT unnest(string_split(p_name, ' ')) AS value FROM part")
def flat_map(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").flat_map(lambda p: F.split(p["p_name"], " ")).unordered()


@query("SELECT coalesce(sum(c_custkey), 0)::BIGINT + 5 AS total, max(c_acctbal) AS most, sum(c_custkey * c_nationkey)::BIGINT AS products FROM customer")
def folds(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "customer", ["c_custkey"])
    total = q.reduce(lambda a, c: a + c["c_custkey"], 5)
    most = q.fold(lambda a, c: a.max(c["c_acctbal"]), -1e9)
    products = q.reduce2("c_custkey", "c_nationkey", lambda a, x, y: a + x * y, 0)
    return spark.createDataFrame([(total, most, products)], "total bigint, most double, products bigint")


@query("WITH RECURSIVE f(k, h) AS (SELECT 0, 7::BIGINT UNION ALL SELECT k + 1, (h * 31 + (SELECT n_regionkey FROM nation WHERE n_nationkey = k)) % 1000003 FROM f WHERE k < 25) SELECT h FROM f WHERE k = 25")
def fold_python(spark, sf_dir) -> DataFrame:
    h = table(spark, sf_dir, "nation", ["n_nationkey"]).fold(lambda a, n: (a * 31 + n["n_regionkey"]) % 1000003, 7)
    return spark.createDataFrame([(h,)], "h bigint")


@query("SELECT coalesce(sum(c_custkey) OVER (ORDER BY c_custkey), 0)::BIGINT AS value FROM customer UNION ALL SELECT 0")
def scan_sum(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer", ["c_custkey"]).scan(lambda a, c: a + c["c_custkey"], 0).unordered()


@query("SELECT greatest(max(o_totalprice) OVER (ORDER BY o_orderkey), 1000.0) AS value FROM orders UNION ALL SELECT 1000.0")
def scan_max(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).scan(lambda a, o: a.max(o["o_totalprice"]), 1000.0).unordered()


@query("SELECT a.n_name AS name, b.r_name AS other FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) a JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS k FROM region) b USING (k)")
def zip_queries(spark, sf_dir) -> DataFrame:
    other = table(spark, sf_dir, "region", ["r_regionkey"]).pluck("r_name")
    return table(spark, sf_dir, "nation", ["n_nationkey"]).zip(other).unordered().select(F.col("item.n_name").alias("name"), "other")


@query("SELECT n_nationkey * k * 10 AS value FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey DESC) AS k FROM nation) WHERE k <= 4")
def zip_with(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation", ["n_nationkey"]).sort("n_nationkey", "desc").zip_with([10, 20, 30, 40], lambda n, x: n["n_nationkey"] * x).unordered()


# what the queries above leave out


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END IS NULL AS none, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END, -1) AS user FROM events")
def map_python_nulls(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "events").map(lambda e: {"event_id": e["event_id"], "u": F.when(e["event_id"] % 3 != 0, e["user_id"])})
    return q.map(lambda r: {"event_id": r["event_id"], "none": r["u"] is None, "user": -1 if r["u"] is None else r["u"]}, "event_id bigint, none boolean, user bigint").unordered()


@query("SELECT event_id AS value FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT NULL FROM events WHERE event_id % 3 = 0")
def flat_map_python_nulls(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "events").map(lambda e: {"u": F.when(e["event_id"] % 3 != 0, e["event_id"])})
    return q.flat_map(lambda r: [r["u"]], "bigint").unordered()


@query("SELECT count(*) FILTER (n_regionkey <> 2) OVER (ORDER BY n_nationkey) AS value FROM nation UNION ALL SELECT 0")
def scan_python_nulls(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "nation", ["n_nationkey"]).map(lambda n: {"r": F.when(n["n_regionkey"] != 2, n["n_regionkey"])})
    return q.scan(lambda a, n: a if n["r"] is None else a + 1, 0, "bigint").unordered()


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND regexp_matches(p_brand, '^Brand#[1-3]') AND NOT (p_size = 5 OR p_retailprice < 950)")
def where_sift_logic(spark, sf_dir) -> DataFrame:
    both = {"$and": [{"p_size": {"$in": [1, 5, 9]}}, {"p_brand": {"$regex": "^Brand#[1-3]"}}], "$nor": [{"p_size": 5}, {"p_retailprice": {"$lt": 950}}]}
    return table(spark, sf_dir, "part").where_sift(both).pick("p_partkey").unordered()


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def where_sift_arrays(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "customer").map(lambda c: {"c_custkey": c["c_custkey"], "tags": F.array(F.lit("a"), F.when(c["c_custkey"] % 5 == 0, F.lit("five")).otherwise(F.lit("no"))), "n": F.array(c["c_custkey"] % 5)})
    return q.where_sift({"tags": {"$all": ["a", "five"]}, "n": {"$elemMatch": {"$lt": 1}}, "c_custkey": {"$type": "number"}}).pick("c_custkey").unordered()


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < 3")
def where_sift_function(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").where_sift({"$where": lambda n: n["n_nationkey"] % 2 == 0, "n_regionkey": {"$lt": 3}}).pick("n_nationkey").unordered()


@query("SELECT r_regionkey FROM region WHERE NOT lower(r_name) = 'asia'")
def where_not_equals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "region").where("r_name").not_().equals("asia").pick("r_regionkey").unordered()


@query("SELECT n_nationkey FROM nation WHERE contains(lower(n_name), 'an')")
def where_contains_name(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").where("n_name").contains("AN").pick("n_nationkey").unordered()


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice > 50000 AND o_totalprice < 250000 AND o_totalprice <= 249000 AND NOT o_orderpriority ILIKE '%low%' AND o_orderpriority ILIKE '%-%'")
def where_if_present(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "orders").where_not_if_present("o_orderstatus", "o").greater_than_if_present("o_totalprice", 50000).less_than_if_present("o_totalprice", 250000).less_than_or_equal_if_present("o_totalprice", 249000)
    return q.not_contains_if_present("o_orderpriority", "low").filter_if_present("o_orderpriority contains '-'").pick("o_orderkey").unordered()


@query("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#2') AND NOT ends_with(p_brand, '1') AND ends_with(p_brand, '3')")
def where_affixes_if_present(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "part").starts_with_if_present("p_brand", "brand#2").not_ends_with_if_present("p_brand", "1").ends_with_if_present("p_brand", "3")
    return q.where_if_present("p_brand", "Brand#23").pick("p_partkey").unordered()


@query("SELECT n_regionkey, min(c_custkey) AS c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def distinct_path(spark, sf_dir) -> DataFrame:
    return nested(spark, sf_dir).array("customers").distinct("nation.n_regionkey").pick({"n_regionkey": "nation.n_regionkey", "c_custkey": "c_custkey"}).unordered()


@query("SELECT (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 1) AS first, (SELECT n_name FROM nation ORDER BY n_nationkey DESC LIMIT 1) AS last, (SELECT n_name FROM nation ORDER BY n_nationkey OFFSET 3 LIMIT 1) AS nth, count(*) AS n, max(CASE WHEN n_nationkey = 7 THEN n_name END) AS one, true AS among FROM nation")
def values_endings(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "nation", ["n_nationkey"])
    v = q.pluck("n_name")
    found = (v.first(), v.last(), v.nth(3), v.count(), q.where("n_nationkey").eq(7).pluck("n_name").one(), v.random(seed=1) in v.to_list())
    return spark.createDataFrame([found], "first string, last string, nth string, n bigint, one string, among boolean")


@query("SELECT min(k) AS first, max(k) AS last, count(*) AS n, 'customers[' || min(k) || ']' AS path, 'customers[' || max(k) || ']' AS last_path FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS k, c_acctbal FROM customer) WHERE c_acctbal < 0")
def index_and_path_endings(spark, sf_dir) -> DataFrame:
    q = nested(spark, sf_dir).array("customers").where("account.c_acctbal").lt(0)
    found = (q.index().first(), q.index().last(), q.index().count(), q.path().first(), q.path().last())
    return spark.createDataFrame([found], "first bigint, last bigint, n bigint, path string, last_path string")


@query("SELECT count(*) AS entries, count(*) AS drawn, true AS paths FROM region")
def random_entries(spark, sf_dir) -> DataFrame:
    g = sections(spark, sf_dir).object_groups("regions")
    keys = {r["key"] for r in g.entries().to_list()}
    drawn = {g.random_entry(seed=s)[0] for s in range(40)}
    value = g.random_value(seed=1)
    item, path = g.arrays("nations").random_with_path(seed=2)
    true = "nations" in value and path.split(".")[1] in keys and path.endswith("]") and "n_name" in item
    return spark.createDataFrame([(len(keys), len(drawn & keys), true)], "entries bigint, drawn bigint, paths boolean")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM orders WHERE o_totalprice > 480000)")
def take_while_many(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders", ["o_orderkey"]).take_while(lambda o: o["o_totalprice"] <= 480000).pick("o_orderkey").unordered()
