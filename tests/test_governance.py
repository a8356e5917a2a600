import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import governance as G


def tags(spark, data):
    return spark.createDataFrame(data, "resource string, key string, value string")


def expressions(spark, data):
    return spark.createDataFrame(data, "grant_id string, key string, values array<string>")


def test_expression_is_and_of_ors(spark, rows):
    t = tags(spark, [("r1", "k", "a"), ("r1", "l", "x"), ("r2", "k", "b"), ("r2", "l", "y"), ("r3", "k", "a")])
    e = expressions(spark, [("g", "k", ["a", "b"]), ("g", "l", ["x"]), ("h", "k", ["a"]), ("n", "k", ["a"]), ("n", "m", ["z"])])
    assert rows(G.match_tags(e, t)) == [("g", "r1"), ("h", "r1"), ("h", "r3")]


def test_match_against_brute_force(spark):
    rng = random.Random(3)
    keys = {"brand": 4, "size": 3, "type": 2}
    resources = {}
    for i in range(400):
        # A third of all resources carry the same value.
        resources[f"r{i}"] = {k: "0" if i % 3 == 0 else str(rng.randrange(n)) for k, n in keys.items() if rng.random() < 0.9}
    grants = {}
    for i in range(40):
        chosen = rng.sample(sorted(keys), rng.randint(1, 3))
        grants[f"g{i}"] = {k: sorted({str(rng.randrange(keys[k])) for _ in range(rng.randint(1, 2))}) for k in chosen}
    t = tags(spark, [(r, k, v) for r, kv in resources.items() for k, v in kv.items()])
    e = expressions(spark, [(g, k, vs) for g, kv in grants.items() for k, vs in kv.items()])
    expected = {
        (g, r)
        for (g, want), (r, have) in product(grants.items(), resources.items())
        if all(have.get(k) in vs for k, vs in want.items())
    }
    got = [tuple(r) for r in G.match_tags(e, t).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_own_tag_wins(spark, rows):
    tables = spark.createDataFrame([("t1", "d"), ("t2", "d"), ("t3", "e")], "resource string, database string")
    own = tags(spark, [("t1", "k", "own"), ("t3", "k", "own")])
    database = spark.createDataFrame([("d", "k", "db"), ("d", "l", "db")], "database string, key string, value string")
    assert rows(G.inherit_tags(tables, own, database)) == [
        ("t1", "k", "own"),
        ("t1", "l", "db"),
        ("t2", "k", "db"),
        ("t2", "l", "db"),
        ("t3", "k", "own"),
    ]


def test_principals(spark, rows):
    df = spark.createDataFrame([("arn:aws:iam::123456789012:role/x",), ("team",), ("nobody",)], "principal string")
    groups = spark.createDataFrame([("team", "g-1")], "name string, group_id string")
    assert rows(G.resolve_principals(df, groups), "principal", "principal_arn") == [
        ("arn:aws:iam::123456789012:role/x", "arn:aws:iam::123456789012:role/x"),
        ("nobody", None),
        ("team", "arn:aws:identitystore:::group/g-1"),
    ]


def test_definitions_and_undefined(spark, rows):
    definitions = spark.createDataFrame(
        [("k", ["a", "b"], None), ("l", ["x"], ["prod"]), ("m", ["y"], ["dev", "test"])],
        "key string, values array<string>, environments array<string>",
    )
    active = G.tag_definitions(definitions, "test")
    assert rows(active) == [("k", "a"), ("k", "b"), ("m", "y")]
    used = tags(spark, [("r", "k", "a"), ("r", "l", "x"), ("s", "l", "x"), ("s", "k", "c")])
    assert rows(G.undefined_tags(used, active)) == [("k", "c"), ("l", "x")]


def test_scope_and_all(spark, rows):
    df = spark.createDataFrame(
        [("p", "DATABASE", "SELECT"), ("p", "DATABASE", "ALL"), ("p", "TABLE", "ALL"), ("p", "TABLE", "CREATE_TABLE")],
        "principal string, resource_type string, permission string",
    )
    assert rows(G.invalid_scope(df), "resource_type", "permission") == [
        ("DATABASE", "ALL"),
        ("DATABASE", "SELECT"),
        ("TABLE", "CREATE_TABLE"),
    ]
    expanded = rows(G.expand_all(df.where("resource_type = 'TABLE' AND permission = 'ALL'")), "permission")
    assert [p for (p,) in expanded] == ["ALTER", "DELETE", "DESCRIBE", "DROP", "INSERT", "SELECT"]


def test_roles_inherit_downwards(spark):
    held = {}
    for role, privilege in G.inherited_privileges(spark).collect():
        held.setdefault(role, set()).add(privilege)
    assert held["role_reader"] == {"USAGE", "SELECT"}
    assert held["role_writer"] == {"USAGE", "SELECT", "INSERT", "UPDATE"}
    assert held["role_admin"] >= held["role_editor"] >= held["role_writer"]
    assert held["role_admin"] - held["role_editor"] == {"CREATE", "ALTER", "DROP"}


def test_checks_and_duplicates(spark, rows):
    schema = "principal string, resource string, permission string, mechanism string"
    named = spark.createDataFrame([("a", "t", "SELECT", "named"), ("b", "t", "INSERT", "named")], schema)
    tagged = spark.createDataFrame([("a", "t", "SELECT", "tag"), ("a", "t", "SELECT", "tag")], schema)
    effective = G.effective_permissions(named, tagged)
    assert rows(G.duplicate_grants(effective), "principal", "permission") == [("a", "SELECT")]
    pairs = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "u")], "principal string, resource string")
    assert rows(G.positive_check(effective, pairs)) == [("a", "t", "PASS"), ("b", "t", "FAIL"), ("c", "u", "FAIL")]
    assert rows(G.negative_check(effective, pairs)) == [
        ("a", "t", "PASS", ""),
        ("b", "t", "FAIL", "over-permissioned"),
        ("c", "u", "PASS", ""),
    ]


def test_namespaces(spark, rows):
    df = spark.createDataFrame(
        [("n", ["s1", "gone"], None, ["db"])],
        "namespace string, read_schemas array<string>, write_schemas array<string>, write_databases array<string>",
    )
    schemas = spark.createDataFrame([("s1",), ("db",)], "name string")
    databases = spark.createDataFrame([("db",)], "name string")
    assert rows(G.namespace_privileges(df, schemas, databases)) == [
        ("n", "database", "db", "CREATE"),
        ("n", "own", "n", "CREATE"),
        ("n", "own", "n", "USAGE"),
        ("n", "read", "gone", "ERROR: does not exist"),
        ("n", "read", "s1", "SELECT"),
        ("n", "read", "s1", "USAGE"),
    ]
    assert G.credential_databases(df, "base").first()["databases"] == ["base", "db"]


def test_prefix_needs_the_slash(spark, rows):
    df = spark.createDataFrame([(1, "ns/a"), (2, "ns2/a"), (3, "ns"), (4, None)], "id int, p string")
    assert rows(G.outside_prefix(df, "id", F.col("p"), F.lit("ns")), "id") == [(2,), (3,), (4,)]


def test_vocabulary(spark):
    words = {tuple(r) for r in G.vocabulary(spark, {"Owner": ["a"]}).collect()}
    assert ("PII", "True") in words and ("Owner", "a") in words
    assert len({k for k, _ in words}) == 8


@pytest.mark.parametrize("part", ["groups", "roles"])
def test_named_grants_without_one_side(spark, part):
    side = "array<struct<name:string,grants:array<string>>>"
    row = {"groups": None, "roles": None, part: [("p", ["SELECT", "ALTER"])]}
    df = spark.createDataFrame([("TABLE", "t", row["groups"], row["roles"])], f"resource_type string, resource string, groups {side}, roles {side}")
    assert {r["permission"] for r in G.expand_named(df).collect()} == {"SELECT", "ALTER"}


def test_repeated_keys_are_merged_and_asked_pairs_agree(spark, rows):
    e = spark.createDataFrame([("g", "k", ["a"]), ("g", "k", ["b"]), ("h", "k", ["b", "a"]), ("i", "z", ["a"])], "grant_id string, key string, values array<string>")
    t = spark.createDataFrame([("r1", "k", "a"), ("r2", "k", "b"), ("r3", "k", "c")], "resource string, key string, value string")
    pairs = [("g", "r1"), ("g", "r2"), ("h", "r1"), ("h", "r2")]
    assert rows(G.match_tags(e, t)) == pairs
    classes = G.expression_classes(e)
    assert rows(classes, "grant_id", "expression") == [("g", "k=a|b"), ("h", "k=a|b"), ("i", "z=a")]
    assert rows(G.match_expressions(classes, t)) == [("k=a|b", "r1"), ("k=a|b", "r2")]
    asked = spark.createDataFrame([(g, r) for g in "ghix" for r in ("r1", "r2", "r3", "r9")], "grant_id string, resource string")
    assert rows(G.match_asked(asked, e, t), "grant_id", "resource") == pairs


def test_resources_are_not_broadcast(spark):
    """A small file may hold very many resources; their tags as maps filled the driver."""
    expressions = spark.range(20).select(F.col("id").alias("grant_id"), F.lit("k").alias("key"), F.array(F.lit("v")).alias("values"))
    tags = spark.range(30).select(F.col("id").alias("resource"), F.lit("k").alias("key"), F.lit("v").alias("value"))
    asked = spark.range(20).select(F.col("id").alias("grant_id"), (F.col("id") + 15).alias("resource"))
    found = G.match_asked(asked, expressions, tags)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 15
    found = G.match_expressions(G.expression_classes(expressions), tags)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and found.count() == 30
