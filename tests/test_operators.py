"""Steps and endings of queries on small documents, quirks included."""

import re

import pytest
from pyspark.sql import functions as F

import docframe as D
from docframe.errors import PathError, QueryError
from docframe.operators import base

ITEMS = [{"id": 1, "type": "Premium", "price": 100, "name": "Item A"}, {"id": 2, "type": "Basic", "price": 50, "name": "Item B"}, {"id": 3, "type": "Premium", "price": 150, "name": "Item C"}, {"id": 4, "type": "Standard", "price": 75, "name": "Item D"}]


@pytest.fixture(scope="module")
def items(spark):
    return D.from_json(spark, {"items": ITEMS}).array("items")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, missing fields, mixed texts."""
    rows = [{"n": 1, "s": "12", "f": -2.5, "t": "É"}, {"n": None, "s": "", "f": 2.5, "t": "x\n"}, {"s": "abc", "t": "a.b"}, {"n": 4, "s": "0x10", "f": 2.46}, {"n": 4, "s": " 5 ", "t": "  É "}, {"n": 7, "s": None, "t": "5d"}]
    return D.from_json(spark, {"rows": [{"k": i, **r} for i, r in enumerate(rows)]}).array("rows")


def ids(q):
    return q.pluck("id").to_list()


def ks(q):
    return q.pluck("k").to_list()


# conditions


def test_equality_is_blind_to_case_in_the_builder_only(items):
    assert ids(items.where("type").equals(" premium ")) == [1, 3]
    assert ids(items.where("type").caseSensitive().equals("premium")) == []
    assert ids(items.where("type").equals("Premium ", ignore_case=False)) == []  # no trimming then
    assert ids(items.filter("type == 'premium'")) == []
    assert ids(items.where_in("type", ["premium"])) == []
    assert ids(items.where_all({"type": "Premium", "price": 150})) == [3]
    assert ids(items.where("price").eq(50)) == [2]


def test_text_conditions_and_negation(items):
    assert ids(items.where("name").contains("item")) == [1, 2, 3, 4]
    assert ids(items.where("name").no_trim().ends_with(" a")) == [1]
    assert ids(items.where("type").startsWith("PRE")) == [1, 3]
    assert ids(items.where_not("type").starts_with("pre")) == [2, 4]
    assert ids(items.where("type").not_().not_().equals("Premium")) == [2, 4]
    assert ids(items.where_not("type").ne("Premium")) == [2, 4]
    assert ids(items.where("type").matches(re.compile("^prem", re.I))) == [1, 3]
    assert ids(items.whereNot("type").matches("^Prem")) == [2, 4]
    assert ids(getattr(items.where("type"), "not")().equals("Basic")) == [1, 3, 4]


def test_order_conditions_and_their_negation_leave_nulls_out(odd):
    assert ks(odd.where("n").gt(3)) == [3, 4, 5]
    assert ks(odd.where_not("n").gt(3)) == [0]
    assert ks(odd.where("n").lte(1)) == [0]
    assert ks(odd.where("n").gte("1")) == []  # another type
    assert ks(odd.where("t").gt("a")) == [0, 1, 2]


def test_negations_match_null_and_missing(odd):
    assert ks(odd.where("n").ne(4)) == [0, 1, 2, 5]
    assert ks(odd.where_not("t").contains("é")) == [1, 2, 3, 5]
    assert ks(odd.where("nothing").eq(None)) == [0, 1, 2, 3, 4, 5]
    assert ks(odd.where("nothing").ne("x")) == [0, 1, 2, 3, 4, 5]
    assert ks(odd.where("n").eq(None)) == [1, 2]


def test_needles_are_no_patterns(odd):
    assert ks(odd.where("t").contains(".")) == [2]
    assert ks(odd.where("t").equals("a.b")) == [2]
    assert ks(odd.where("t").equals("x")) == []
    assert ks(odd.where("t").matches("^x$")) == []  # an end anchor is the very end
    assert ks(odd.where("t").equals("é")) == [0]  # what is looked for is trimmed, the data isn't


def test_optional_conditions(items):
    assert items.where_if_present("type", None).count() == 4
    assert items.where_if_present("type", "").count() == 0
    assert items.filter_if_present("").filterIfPresent(None).count() == 4
    q = items.greater_than_if_present("price", 60).lessThanOrEqualIfPresent("price", 100).contains_if_present("name", None)
    assert ids(q) == [1, 4]
    assert ids(items.not_ends_with_if_present("name", "d").where_not_if_present("type", "basic").not_contains_if_present("name", "c").ends_with_if_present("name", "a")) == [1]
    assert ids(items.starts_with_if_present("type", "st").greater_than_or_equal_if_present("price", 75).less_than_if_present("price", 76).not_starts_with_if_present("type", "x")) == [4]


def test_expressions_fold_from_left_to_right(items):
    assert ids(items.filter("id == 2 or type == 'Premium' and price > 120")) == [3]
    assert ids(items.filter("type == 'Premium' and price > 120 or id == 2")) == [2, 3]
    assert ids(items.filter('name contains "m b"')) == [2]
    assert ids(items.filter("name contains 'a' AND price >= 1e2")) == [1]
    assert ids(items.filter("name startsWith 'item' and name endsWith 'D' and price < 0x64")) == [4]
    assert ids(items.filter("name contains ITEM", case_sensitive=True)) == []
    assert items.filter("missing == null").count() == 4
    assert items.filter("price not undefined").count() == 4
    assert ids(items.filter("price not 50")) == [1, 3, 4]
    assert ids(items.filter("price != 50 and type !== 'Premium'")) == [4]


def test_words_in_quotes_are_text(spark):
    q = D.from_json(spark, {"x": [{"s": "rock and roll"}, {"s": "rock"}]}).array("x")
    assert q.filter("s == 'rock and roll'").count() == 1
    assert q.filter("s == 'rock and roll' or s == 'rock'").count() == 2


@pytest.mark.parametrize("text", ["", "  ", "price>=1", "price >=", "a == 1 and ", " and a == 1", "no-field == 1"])
def test_expressions_that_fail_at_once(items, text):
    with pytest.raises(D.ExpressionError):
        items.filter(text)


def test_decimals_round_halves_up(odd):
    assert ks(odd.filter("f == -2", decimals=0)) == [0]
    assert ks(odd.filter("f == 3", decimals=0)) == [1]
    assert ks(odd.filter("f == 2.5", decimals=1)) == [1, 3]
    assert ks(odd.filter("f != 2.5", decimals=1)) == [0, 2, 4, 5]


def test_query_dictionaries(odd, spark):
    sift = lambda q: ks(odd.where_sift(q))
    assert sift({"n": 4, "s": "0x10"}) == [3]
    assert sift({"$or": [{"n": {"$in": [1, 7]}}, {"s": re.compile("^a")}]}) == [0, 2, 5]
    assert sift({"$nor": [{"n": 4}, {"n": None}]}) == [0, 5]
    assert sift({"n": {"$exists": False}}) == [1, 2]
    assert sift({"n": {"$not": {"$gt": 3}}}) == [0, 1, 2]
    assert sift({"s": {"$regex": "ABC", "$options": "i"}}) == [2]
    assert sift({"n": {"$mod": [3, 1]}}) == [0, 3, 4, 5]
    assert sift({"s": {"$type": "string", "$nin": ["12", ""]}}) == [2, 3, 4]
    assert sift({"n": {"$where": lambda c: c * 2 == 8}}) == [3, 4]
    with pytest.raises(D.ExpressionError):
        odd.where_sift({"$where": "this.n == 4"})
    with pytest.raises(D.ExpressionError):
        odd.where_sift({"n": {"$near": 4}})
    q = D.from_json(spark, {"x": [{"i": 1, "t": ["a", "b"], "o": [{"p": 1, "q": 5}, {"p": 2, "q": 6}]}, {"i": 2, "t": [], "o": [{"p": 1, "q": 6}]}, {"i": 3, "t": ["b"]}]}).array("x")
    found = lambda s: q.where_sift(s).pluck("i").to_list()
    assert found({"t": "b"}) == [1, 3] and found({"t": {"$ne": "b"}}) == [2]
    assert found({"t": {"$all": ["a", "b"]}}) == [1] and found({"t": {"$size": 0}}) == [2]
    assert found({"o": {"$elemMatch": {"p": 1, "q": 6}}}) == [2] and found({"o.p": 1, "o.q": 6}) == [1, 2]
    assert found({"o.1.q": 6}) == [1] and found({"t.0": "b"}) == [3]


# aggregates


def test_aggregates(items, odd):
    assert (items.sum("price"), items.average("price"), items.min("price"), items.max("price"), items.count()) == (375, 93.75, 50, 150, 4)
    assert items.sum_of_products("price", "id") == 950
    assert items.aggregate().sum("price").sum("id").count().all() == {"sum": 10, "count": 4}
    assert items.aggregate().all() == {}
    assert (odd.sum("n"), odd.sum("s"), odd.average("n")) == (16, 0, 16 / 6)
    assert (odd.min("s"), odd.max("s")) == (0, 16)
    none = items.where("id").gt(9)
    assert (none.sum("price"), none.average("price"), none.min("price"), none.exists(), none.count()) == (0, 0, None, False, 0)
    assert (items.every(), none.every(), items.where("id").gt(0).every(), none.where("id").gt(0).exists()) == (True, False, True, False)
    with pytest.raises(D.QueryError):
        items.sum_of_products()
    with pytest.raises(Exception, match="Invalid number at path"):
        odd.sum_of_products("s")


def test_groups(items, odd):
    found = items.group_by("type").to_dict()
    assert list(found) == ["Premium", "Basic", "Standard"] and [i["id"] for i in found["Premium"]] == [1, 3]
    assert list(items.sort("price", "desc").group_by("type").to_dict()) == ["Premium", "Standard", "Basic"]
    assert {r["key"]: r["count"] for r in odd.group_by("n").count().collect()} == {"1": 1, "null": 2, "4": 2, "7": 1}
    assert {r["key"]: r["p"] for r in items.group_by("type").aggregate(p=("average", "price")).collect()} == {"Premium": 125, "Basic": 50, "Standard": 75}


def test_distinct(items, spark):
    assert ids(items.distinct("type")) == [1, 2, 4]
    assert ids(items.sort("price", "desc").distinct("type")) == [3, 4, 2]
    q = D.from_json(spark, {"x": [{"a": {"b": 1}}, {"a": {"b": 1}}, {"a": {"b": None}}, {"a": {"b": 2}}]}).array("x")
    assert q.distinct("a.b").pluck("a.b").to_list() == [1, None, 2] and q.distinct("b").count() == 3 and q.distinct().count() == 3
    assert D.from_json(spark, [3, 1, 3, 2, 1]).array_root().distinct().to_list() == [3, 1, 2]
    with pytest.raises(D.PathError):
        q.distinct("zz")
    with pytest.raises(D.QueryError):
        D.from_json(spark, {"x": [{"id": 1, "u": {"id": 2}}]}).array("x").distinct("id")


# order and selection


def test_sorting_and_selection(items, odd):
    assert ids(items.sort("price").sort("price", "desc").where("id").ne(1)) == [3, 4, 2]
    assert ks(odd.sort("n")) == [0, 3, 4, 5, 1, 2] and ks(odd.sort("n", "desc")) == [5, 3, 4, 0, 1, 2]
    assert ids(items.sort("")) == [1, 2, 3, 4]
    assert (items.first()["id"], items.any()["id"], items.last()["id"], items.nth(2)["id"], items.where("id").eq(2).one()["id"]) == (1, 1, 4, 3, 2)
    assert odd.sort("n").last()["k"] == 2 and items.random(seed=1)["id"] in {1, 2, 3, 4}
    assert [ids(items.take(n)) for n in (0, 2, 9, -1)] == [[], [1, 2], [1, 2, 3, 4], []]
    assert [ids(items.drop(n)) for n in (0, 3, 9, -1)] == [[1, 2, 3, 4], [4], [], [1, 2, 3, 4]]
    assert ks(odd.sort("n", "desc").drop(3)) == [0, 1, 2] and ks(odd.sort("n").drop(5)) == [2]
    assert ids(items.take_while(lambda i: i["price"] >= 100)) == [1] and ids(items.drop_while(lambda i: i["price"] >= 100)) == [2, 3, 4]
    assert ids(items.take_while(lambda i: i["price"] > 0)) == [1, 2, 3, 4] and ids(items.drop_while(lambda i: i["price"] > 0)) == []
    yes, no = odd.partition(lambda i: i["n"] > 3)
    assert (ks(yes), ks(no)) == ([3, 4, 5], [0, 1, 2])
    assert ids(items.sort("price", "desc").take(3).where("id").ne(1)) == [3, 4]


def test_endings_that_fail(items):
    none = items.where("id").gt(9)
    for call, text in [(none.first, "No matches found for first()."), (none.last, "No matches found for last()."), (none.random, "No matches found for random()."), (none.one, "Expected exactly 1 match, found 0."), (items.one, "Expected exactly 1 match, found 4."), (lambda: items.nth(4), "Index 4 out of bounds. Found 4 matches."), (none.path().first, "No matching items found"), (items.index().one, "Expected exactly one matching item, but found 4"), (none.pluck("id").first, "No values found for first()"), (lambda: items.pluck("id").nth(7), "Index 7 out of bounds. Found 4 values."), (none.random_with_path, "No matches found for randomWithPath()."), (lambda: items.where_in("id", []), 'whereIn("id") requires a non-empty array of values.')]:
        with pytest.raises(D.QueryError, match=re.escape(text)):
            call()
    with pytest.raises(D.QueryError, match="mine"):
        items.one("mine")


# projections, values, positions


def test_projections_and_values(items, odd, spark):
    assert items.pick("id", {"label": "name"}).first() == {"id": 1, "label": "Item A"}
    assert items.pick(["id", "price"]).last() == {"id": 4, "price": 75}
    assert items.pluck("price").string().to_list() == ["100", "50", "150", "75"]
    assert odd.pluck("n").string().to_list() == ["1", "", "", "4", "4", "7"] and odd.pluck("f").string().first() == "-2.5"
    assert odd.where_in("k", [0, 1, 3, 4]).pluck("s").number().to_list() == [12, 0, 16, 5]
    for k in (2, 5):
        with pytest.raises(Exception, match="Cannot convert"):
            odd.where("k").eq(k).pluck("s").number().to_list()
    assert items.where("id").eq(3).pluck("id").one() == 3
    with pytest.raises(D.QueryError):
        D.from_json(spark, {"x": [{"a": {"b": 1}}]}).array("x").pluck("a").string()
    with pytest.raises(D.PathError, match='property "nope" not found'):
        items.pluck("nope")


def test_deep_search(spark):
    q = D.from_json(spark, {"x": [{"id": 1, "user": {"id": 100, "name": "n", "tags": [{"id": 7}, {"id": 8}]}}]}).array("x")
    assert q.find_all("id").to_list() == [1, 100, 7, 8] and q.find_all("user.id").to_list() == [100] and q.find_all("zz").count() == 0
    q = D.from_json(spark, {"x": [{"orders": [{"customer": {"name": "A"}}], "metadata": {"customer": {"name": "B"}}}]}).array("x")
    assert q.find_all("customer.name").to_list() == ["B", "A"] or q.find_all("customer.name").to_list() == ["A", "B"]


def test_positions_and_paths(items, spark):
    q = items.where("type").eq("premium").sort("price", "desc")
    assert q.index().to_list() == [2, 0] and q.path().to_list() == ["items[2]", "items[0]"] and q.path().nth(1) == "items[0]"
    assert [(r["index"], r["id"]) for r in q.all_with_index().to_list()] == [(2, 3), (0, 1)]
    item, path = q.random_with_path(seed=5)
    assert path == f"items[{item['id'] - 1}]"
    assert D.from_json(spark, [5, 6]).array_root().path().to_list() == ["[0]", "[1]"]
    assert items.drop(1).index().to_list() == [0, 1, 2]
    assert D.get_path_segment_after("sections.active.items[10]", "sections") == "active" and D.get_path_segment_after("sections.active.items[10]", "sections.active") == "items"
    for prefix in ("notfound", "items", ""):
        with pytest.raises(D.QueryError):
            D.get_path_segment_after("sections.active.items[10]", prefix)
    df = spark.createDataFrame([("a.b[1].c",), ("x.b",)], "p string")
    assert [r[0] for r in df.select(D.path_segment_after(F.col("p"), "b")).collect()] == ["c", None]


# groups


def test_object_groups(spark):
    root = D.from_json(spark, {"sections": {"active": {"items": [{"t": "a"}, {"t": "b"}]}, "old": {"items": [{"t": "b", "z": 1}]}, "none": {"items": []}}, "n": 5})
    g = root.object_groups("sections")
    assert [r["key"] for r in g.entries().to_list()] == ["active", "old", "none"]
    assert [r["key"] for r in g.include(["old"]).include(["none", "active"]).exclude(["none"]).entries().to_list()] == ["active"]
    assert g.include([]).entries().count() == 0 and g.exclude([]).values().count() == 3
    q = g.arrays("items").where("t").eq("b")
    assert q.path().to_list() == ["sections.active.items[1]", "sections.old.items[0]"] and q.index().to_list() == [1, 2]
    assert g.flat_array("items").count() == 3 and g.include(["old"]).random_entry()[0] == "old"
    assert g.include(["none"]).random_value() == {"items": []}
    with pytest.raises(D.QueryError, match="No group entries"):
        g.include(["zz"]).random_entry()
    with pytest.raises(D.QueryError, match="Expected object"):
        root.object_groups("n")
    with pytest.raises(D.QueryError, match='Expected array at path "n", but found number'):
        root.array("n")
    with pytest.raises(D.QueryError, match="Expected array"):
        D.from_json(spark, {"s": {"a": {"items": 3}}}).object_groups("s").arrays("items")
    assert root.pick("n", {"first": "sections.active.items[0].t"}).first() == {"n": 5, "first": "a"}
    assert root.raw().count() == 1


def test_paths_fail_on_nulls_and_bounds(spark):
    q = D.from_json(spark, {"x": [{"a": {"b": [1]}}, {"a": None}]}).array("x")
    with pytest.raises(Exception, match="null/undefined"):
        q.pluck("a.b").to_list()
    with pytest.raises(Exception, match="out of bounds"):
        q.take(1).pluck("a.b[3]").to_list()
    assert q.take(1).pluck("a.b[0]").to_list() == [1]
    with pytest.raises(D.PathError, match="is not an array"):
        q.pluck("a[0]")


# transforms


def test_transforms(items, spark):
    assert items.map(lambda i: i["price"] * 2).to_list() == [200, 100, 300, 150]
    assert items.map(lambda i: {"p": i["price"]}).where("p").gt(60).pluck("p").to_list() == [100, 150, 75]
    assert items.map(lambda r: {"a": r["name"].lower(), "b": r["id"] + 1}, "a string, b bigint").to_list()[0] == {"a": "item a", "b": 2}
    assert items.map_with_index(lambda i, n: i["id"] * 10 + n).to_list() == [10, 21, 32, 43]
    assert items.map2("id", "price", lambda a, b: a * b).to_list() == [100, 100, 450, 300]
    assert items.mapn(["id", "price", "id"], lambda a, b, c: a + b + c).to_list() == [102, 54, 156, 83]
    tags = D.from_json(spark, {"items": [{"id": 1, "tags": ["a", "b"]}, {"id": 2, "tags": ["c"]}, {"id": 3, "tags": []}, {"id": 4, "tags": ["d", "e", "f"]}]}).array("items")
    assert tags.flat_map(lambda i: i["tags"]).to_list() == list("abcdef")
    assert items.take(1).flat_map(lambda i: i["name"]).to_list() == list("Item A")
    assert tags.flat_map(lambda r: [f"{r['id']}{t}" for t in r["tags"]], "string").to_list() == ["1a", "1b", "2c", "4d", "4e", "4f"]
    with pytest.raises(D.QueryError):
        items.flat_map(lambda i: i["price"])


def test_folds_and_scans(items):
    add = lambda a, i: a + i["price"]
    assert items.reduce(add, 0) == 375 and items.fold(add, 10) == 385 and items.where("id").gt(9).reduce(add, 3) == 3
    assert items.reduce2("price", "id", lambda a, p, i: a + p * i, 0) == 950 and items.foldn(["price", "id"], lambda a, p, i: (a + p) * i, 0) == ((100 + 50) * 2 + 150) * 3 * 4 + 75 * 4
    assert items.reduce(lambda a, i: a.max(i["price"]) if hasattr(a, "max") else max(a, i["price"]), 0) == 150
    assert items.reduce(lambda a, i: f"{a}{i['type'][0]}", "") == "PBPS"
    assert items.sort("price").reduce(lambda a, i: a * 2 + i["id"], 0) == ((2 * 2 + 4) * 2 + 1) * 2 + 3
    assert items.scan(add, 0).to_list() == [0, 100, 150, 300, 375] and items.where("id").gt(9).scan(add, 0).to_list() == [0]
    assert items.scan(lambda a, i: a * 2 + i["id"], 1).to_list() == [1, 3, 8, 19, 42]
    assert items.scan(lambda a, i: a - i["id"], 10).where("").lt(8).to_list() == [7, 4, 0]


def test_zip(items, spark):
    assert [(r["item"]["id"], r["other"]) for r in items.zip(["a", "b", "c", "d"]).to_list()] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert items.zip(["a", "b"]).count() == 2 and items.zip([]).count() == 0
    assert items.zip_with([2, 3, 1, 4], lambda i, o: i["price"] * o).to_list() == [200, 150, 150, 300]
    assert items.zip_with([2], lambda i, o: i["price"] * o).to_list() == [200]
    assert items.sort("price").zip(items.pluck("id")).map(lambda p: p["item.id"] * 10 + p["other"]).to_list() == [21, 42, 13, 34]


def test_ranges_number_rows_as_one_task_would(spark, monkeypatch):
    monkeypatch.setattr(base, "RANGE_ROWS", 40)
    from docframe.operators import folds

    monkeypatch.setattr(folds, "RANGE_ROWS", 40)
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 501).alias("v"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("s")).repartition(5)
    q = D.query(df).array_root(["id"])
    rows = [r.asDict() for r in df.orderBy("id").collect()]
    want = [r["id"] for r in sorted(rows, key=lambda r: (r["s"] is None, -(r["s"] or 0), r["id"]))]
    assert q.sort("s", "desc").map_with_index(lambda i, n: {"n": n, "id": i["id"]}).sort("n").pluck("id").to_list() == want
    total, sums = 0, [0]
    for r in rows:
        total += r["v"]
        sums.append(total)
    assert q.scan(lambda a, i: a + i["v"], 0).to_list() == sums


def test_variants_keep_types_apart(spark):
    q = D.from_json(spark, {"x": [{"a": 1}, {"a": "1"}, {"a": None}, {"b": {"c": "z"}}, {"a": 2.5}, {"a": True}]}, "variant").array("x")
    assert [q.where("a").eq(v).count() for v in (1, "1", None, True)] == [1, 1, 2, 1]
    assert (q.where("a").gt(1).count(), q.sum("a"), q.max("a"), q.where("b.c").contains("Z").count()) == (1, 3.5, 2.5, 1)
    assert {r["key"]: r["count"] for r in q.group_by("a").count().collect()} == {"1": 2, "null": 2, "2.5": 1, "true": 1}
    assert q.where("a").ne(1).index().to_list() == [1, 2, 3, 4, 5]


def test_queries_are_immutable_and_pushed_down(spark):
    q = D.read(spark, "/root/testdata/sf0.001/lineitem.parquet").array_root()
    some = q.where("l_quantity").gt(40)
    assert q.count() == 6000 and some.count() < 6000
    plan = some.where("l_returnflag").case_sensitive().eq("R").pick("l_orderkey").unordered()._jdf.queryExecution().toString()
    assert "l_quantity,40.0)" in plan and "EqualTo(l_returnfl" in plan  # long names are cut in plans
    scan = plan[plan.rindex("ReadSchema") :]
    assert "l_tax" not in scan


def test_files_and_streams(spark, tmp_path):
    D.write(D.from_json(spark, ITEMS).array_root().unordered(), str(tmp_path / "t"), partition_by=["type"])
    assert sorted(D.read(spark, str(tmp_path / "t")).array_root().pluck("id").to_list()) == [1, 2, 3, 4]
    (tmp_path / "d.json").write_text('{"items": [{"id": 5}]}')
    assert D.read_json(spark, str(tmp_path / "d.json")).array("items").pluck("id").to_list() == [5]
    from docframe.streaming import start, windowed

    s = D.read_stream(spark, str(tmp_path / "t"), "id bigint, name string, price bigint, type string").array_root()
    run = start(s.where("price").gt(60).pick("id", "price"), str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"), once=True)
    run.awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4]
    for step in (s.all, lambda: s.drop(1), lambda: s.distinct("id"), s.index):
        with pytest.raises(D.QueryError, match="stream"):
            step()
    events = D.read(spark, "/root/testdata/sf0.001/events.parquet").array_root()
    by = windowed(events.where("value").gt(10), "ts", "1 day", by=["event_type"], n=F.count(F.lit(1)))
    assert by.agg(F.sum("n")).first()[0] == events.where("value").gt(10).count()


def test_places_deep_in_a_table_are_found_by_ranges(spark, monkeypatch):
    from docframe.operators import base, items

    rows = [(i // 50, i) for i in range(400)]  # 8 keys of 50 rows
    q = D.query(spark.createDataFrame(rows, "k int, v int").repartition(3)).array_root(["k", "v"])
    for module in (base, items):
        monkeypatch.setattr(module, "FEW", 20)
    monkeypatch.setattr(base, "RANGE_ROWS", 60)
    assert [q.nth(n)["v"] for n in (0, 20, 21, 199, 399)] == [0, 20, 21, 199, 399]
    assert [r["v"] for r in q.drop(250).to_list()] == list(range(250, 400)) and q.drop(400).to_list() == []
    with pytest.raises(QueryError):
        q.nth(400)
    deep = q.drop(250).unordered()._jdf.queryExecution().toString()
    assert "TakeOrdered" not in deep
    tied = D.query(spark.createDataFrame([(1, i) for i in range(200)], "k int, v int")).array_root(["k"])  # one key in all rows
    assert len(tied.drop(150).to_list()) == 50 and sorted(r["index"] for r in tied.all_with_index().to_list()) == list(range(200))


def test_a_mistake_in_a_fold_is_not_hidden(spark):
    q = D.query(spark.createDataFrame([(1,), (2,)], "v int")).array_root(["v"])
    with pytest.raises(NameError):
        q.fold(lambda a, r: a + undefined_name, 0)  # noqa: F821
    with pytest.raises(PathError):
        q.fold(lambda a, r: a + r["w"], 0)
    assert q.fold(lambda a, r: max(a, r["v"]), 0) == 2


def test_python_functions_get_none_for_null(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, "x")], "i int, v int, s string")
    q = D.query(df).array_root(["i"])
    assert [r for r in q.map(lambda r: repr((r["v"], r["s"])), "string").to_list()] == ["(None, None)", "(5, 'x')"]
    assert q.flat_map(lambda r: [r["v"]] * r["i"], "int").to_list() == [None, 5, 5]
    assert q.scan(lambda a, r: a + (100 if r["v"] is None else r["v"]), 0, "bigint").to_list() == [0, 100, 105]
    assert q.fold(lambda a, r: a if r["v"] is None else a + r["v"], 0, plain=True) == 5
