"""Registered models as callers with different permissions see and change them."""

import pytest
from granary.functions.models import Model, Models, permission_codes

SCHEMA = "id int, owner string, size int, secret string"
ROWS = [(1, "a", 5, "x"), (2, "b", 50, "y"), (3, None, 500, "z"), (4, "a", 5000, "w")]


@pytest.fixture
def models(spark, tmp_path):
    path = str(tmp_path / "items")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(path)
    out = Models()
    needs = {"list": ("items:read", "admin"), "create": ("admin",), "update": ("items:write", "admin"), "delete": None}
    out.register("items", Model(spark.read.parquet(path), "id", ("secret",), ("size",), needs, {"items:own": "owner = 'a'", "items:large": "size > 100", "admin": "true"}))
    out.register("open_items", Model(spark.read.parquet(path), "id"))
    return out


def ids(df):
    return sorted(r.id for r in df.collect())


def test_callers_see_what_their_permissions_show(models):
    assert ids(models.listed("items", {"items:read", "items:own"})) == [1, 4]
    assert ids(models.listed("items", {"items:read", "items:own", "items:large"})) == [1, 3, 4]
    assert ids(models.listed("items", {"items:read"})) == [] and ids(models.listed("items", {"admin"})) == [1, 2, 3, 4]
    assert models.listed("items", {"admin"}).columns == ["id", "owner", "size"]
    assert ids(models.got("items", {"items:own"}, 4)) == [4] and ids(models.got("items", {"items:own"}, 2)) == []
    with pytest.raises(PermissionError):
        models.listed("items", {"items:own"})


def test_the_predicate_goes_to_the_scan(models):
    rows = models.listed("items", {"items:read", "items:own"}).filter("size > 1000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(owner,a)" in pushed and "GreaterThan(size,1000)" in pushed and "secret" not in plan.split("ReadSchema")[1]


def test_views_of_two_callers(spark, models):
    own, all_, nobody = models.views(spark, {"items:read", "items:own"}), models.views(spark, {"admin"}), models.views(spark, set())
    assert own.sql("SELECT count(*) AS n FROM items WHERE size > 10").first().n == 1
    assert all_.sql("SELECT count(*) AS n FROM items WHERE size > 10").first().n == 3
    assert nobody.sql("SELECT count(*) AS n FROM open_items").first().n == 4
    with pytest.raises(Exception, match="(?i)not.found"):
        nobody.sql("SELECT * FROM items").collect()
    with pytest.raises(Exception, match="(?i)not.found"):
        spark.sql("SELECT * FROM open_items").collect()


def test_changes(spark, models):
    new = spark.createDataFrame([(9, "c"), (1, "q"), (9, "c"), (None, "n")], "id int, owner string")
    assert sorted((r.id, r.owner) for r in models.created("items", {"admin"}, new).collect() if r.id > 3) == [(4, "a"), (9, "c")]
    changes = spark.createDataFrame([(1, "q"), (2, "q"), (4, None)], "id int, owner string")
    got = {r.id: (r.owner, r.size, r.secret) for r in models.updated("items", {"items:write", "items:own"}, changes).collect()}
    assert got == {1: ("q", 5, "x"), 2: ("b", 50, "y"), 3: (None, 500, "z"), 4: (None, 5000, "w")}
    assert ids(models.deleted("open_items", set(), spark.createDataFrame([(1,), (7,)], "id int"))) == [2, 3, 4]
    for wrong in ("id int, size int", "id int, secret int", "id int, other int", "owner int, size int"):
        with pytest.raises(ValueError, match="can't be written"):
            models.updated("items", {"admin"}, spark.createDataFrame([(1, 1)], wrong))
    for action in (lambda: models.created("items", {"items:write"}, new), lambda: models.deleted("items", {"admin"}, new)):
        with pytest.raises(PermissionError):
            action()


def test_registration(spark, models):
    with pytest.raises(ValueError, match="already"):
        models.register("items", models.get("items"))
    with pytest.raises(ValueError, match="unknown"):
        models.register("other", Model(spark.range(1), "key"))
    with pytest.raises(ValueError, match="no model"):
        models.get("other")
    roles, grants = spark.createDataFrame([("r",)], "role_id string"), spark.createDataFrame([("r", 1), ("r", 2), ("x", 3)], "role_id string, permission_id int")
    permissions = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", True)], "permission_id int, code string, enabled boolean")
    assert permission_codes(roles, grants, permissions) == {"a"}
