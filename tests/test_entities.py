"""Entity queries on small and random tables."""

import random

import pytest

from apilens.operators import entities

USERS = [(1, "Nilay", "nilay@post.example", "admin", "active"),
         (2, "Tom", "tom@post.example", "user", "active"),
         (3, "Camila", "camila@post.example", "user", "inactive")]
ORDERS = [(1, 1, 12.5, "completed"), (2, 1, 3.25, "pending"), (3, 2, 40.0, "completed")]
PRODUCTS = [(1, "Lamp", 88.0, 10), (2, "Moss", 3.25, 50), (3, "Kettle", 40.0, 25)]
CUSTOMERS = [(1, "Eve Hill", 61.5, "pending"), (2, "Kim Frost", 18.75, "completed"),
             (3, "Tom Stone", 7.0, "processing")]


@pytest.fixture
def users(spark):
    return spark.createDataFrame(USERS, "id bigint, name string, email string, role string, status string")


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ORDERS, "id bigint, user_id bigint, total double, status string")


@pytest.fixture
def products(spark):
    return spark.createDataFrame(PRODUCTS, "id bigint, name string, price double, stock int")


@pytest.fixture
def customers(spark):
    return spark.createDataFrame(CUSTOMERS, "id bigint, customer string, total double, status string")


def test_list(users):
    assert [r["count"] for r in entities.list_with_count(users).collect()] == [3, 3, 3]


def test_orders_of_users(spark, users, orders):
    ids = spark.createDataFrame([(1,), (3,), (9,), (1,)], "user_id bigint")
    got = sorted(
        (r.user_id, r.status_code, r["count"], r.order_id)
        for r in entities.orders_of_users(users, orders, ids).collect()
    )
    assert got == [(1, 200, 2, 1), (1, 200, 2, 2), (3, 200, 0, None), (9, 404, None, None)]


def test_search(users, products):
    rows = entities.search("IL", users, products).collect()
    assert sorted((r.kind, r.name, r.total_results) for r in rows) == [
        ("user", "Camila", 2), ("user", "Nilay", 2),
    ]
    assert entities.search("moss", users, products).count() == 1
    with pytest.raises(ValueError):
        entities.search("", users, products)


def test_sales_report(customers):
    assert tuple(entities.sales_report(customers).first()) == (18.75, 1, 3)
    assert tuple(entities.sales_report(customers.filter("false")).first()) == (0.0, 0, 0)


def test_user_details(users, customers):
    got = {r.order_id: r.user_name for r in entities.order_user_details(customers, users).collect()}
    assert got == {1: None, 2: None, 3: "Tom"}


def test_user_details_equals_trying_every_user(spark):
    rng = random.Random(3)

    def text(size):
        return "".join(rng.choices("abAB é", k=rng.randint(0, size)))

    users = [(i, text(8), text(6)) for i in range(60)]
    orders = [(i, text(6)) for i in range(200)]
    got = entities.order_user_details(
        spark.createDataFrame(orders, "id bigint, customer string"),
        spark.createDataFrame(users, "id bigint, name string, email string"),
    ).collect()

    def first(customer):
        words = customer.split()
        if not words:
            return None
        word = words[0].lower()
        return min((i for i, n, e in users if word in n.lower() or word in e.lower()), default=None)

    assert len(got) == 200
    assert {r.order_id: r.user_id for r in got} == {i: first(c) for i, c in orders}


def test_numbered(spark):
    keys = random.Random(5).sample(range(-5000, 5000), 700)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r.k: r.number for r in entities.numbered(df, "k").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys), 1)}


def test_insert(spark, users):
    fresh = spark.createDataFrame(
        [(30, "Zoe", "z@x", None, "new"), (10, "Yan", "y@x", "admin", None), (20, None, "n@x", None, None)],
        "arrival bigint, name string, email string, role string, status string",
    )
    table, refused = entities.insert_rows(
        users, fresh, "arrival", ("name", "email"), {"role": "user", "status": "active"}
    )
    assert sorted(map(tuple, table.filter("id > 3").collect())) == [
        (4, "Yan", "y@x", "admin", "active"), (5, "Zoe", "z@x", "user", "new"),
    ]
    assert [r.arrival for r in refused.collect()] == [20]
    empty, _ = entities.insert_rows(users.filter("false"), fresh, "arrival", ("name",), {})
    assert sorted(r.id for r in empty.collect()) == [1, 2]


def test_numbered_with_sparse_keys(spark):
    keys = [n * 1_000_003 for n in range(-1000, 1000)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(5)
    got = {r.k: r.number for r in entities.numbered(df, "k").collect()}
    assert got == {k: n + 1 for n, k in enumerate(keys)}


def test_update_and_delete(spark, users):
    changes = spark.createDataFrame(
        [(1, "Nilay Updated", "nilay.updated@post.example", "x"), (9, "Nobody", None, None)],
        "id bigint, fullName string, email string, extra string",
    )
    rows = {r.id: r for r in entities.update_rows(users, changes, {"fullName": "name"}).collect()}
    assert (rows[1].name, rows[1].email, rows[1].role) == (
        "Nilay Updated", "nilay.updated@post.example", "admin",
    )
    assert rows[2].name == "Tom" and len(rows) == 3 and "extra" not in rows[1].asDict()
    twice = spark.createDataFrame(
        [(1, 1, "First", None), (1, 3, "Third", None), (1, 2, "Second", "new@x"), (8, 1, "Nobody", None)],
        "id bigint, at int, name string, email string",
    )
    patched = entities.update_rows(users, twice, order="at")
    rows = {r.id: r for r in patched.collect()}
    assert len(rows) == 3 and (rows[1].name, rows[1].email) == ("Third", "new@x")
    assert [tuple(r) for r in entities.unknown_changes(users, twice).collect()] == [(8, 404)]
    left, gone = entities.delete_rows(users, spark.createDataFrame([(3,), (9,)], "id bigint"))
    assert sorted(r.id for r in left.collect()) == [1, 2]
    assert [r.name for r in gone.collect()] == ["Camila"]


def test_product_info(products):
    rows = entities.order_product_info(7, products).collect()
    assert {r.order_id for r in rows} == {7} and len(rows) == 3


def test_users_are_dealt_before_they_become_parts(spark):
    """A table in one file is read by one task; its users are spread before each becomes a hundred rows."""
    users = spark.createDataFrame([(i, f"Name{i}", f"n{i}@example.com") for i in range(50)], "id long, name string, email string").coalesce(1)
    orders = spark.createDataFrame([(1, "Name7 x"), (2, None)], "id long, customer string")
    details = entities.order_user_details(orders, users)
    plan = details._jdf.queryExecution().optimizedPlan().toString()
    parts = [line for line in plan.splitlines() if "Generate explode" in line or "Repartition" in line]
    assert "Generate" in parts[0] and "Repartition" in parts[1]
    assert {r.order_id: r.user_id for r in details.collect()} == {1: 7, 2: None}
