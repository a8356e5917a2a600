import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import names as N
from tidewatch.functions import predicates as P
from tidewatch.operators import constraints as K
from tidewatch.operators import registrations
from tidewatch.operators.closure import transitive_closure
from tidewatch.operators.grouping import children_counts, children_per_parent
from tidewatch.operators.logs import term_counts
from tidewatch.operators.ordering import first_per_key, running_total, smallest_per_group, with_position
from tidewatch.operators.percentile import approximate_percentiles, exact_percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in group 0, many equal values, a NULL group and NULL values."""
    rng = random.Random(5)
    data = []
    for i in range(6000):
        group = 0 if i % 3 == 0 else rng.choice([1, 2, 3, None])
        value = None if i % 50 == 0 else float(rng.choice([rng.randint(0, 20), rng.randint(0, 10**6)]))
        data.append((i, group, value))
    return data, spark.createDataFrame(data, "id int, g int, v double").repartition(6)


def interpolated(values, fraction):
    values = sorted(values)
    rank = fraction * (len(values) - 1)
    low = int(rank)
    high = min(low + 1, len(values) - 1) if rank > low else low
    return values[low] + (values[high] - values[low]) * (rank - low)


def test_percentiles(skewed):
    data, df = skewed
    groups = defaultdict(list)
    for _, g, v in data:
        if v is not None:
            groups[g].append(v)
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = exact_percentiles(df, ["g"], "v", wanted).collect()
    assert {r["g"] for r in got} == set(groups)
    for row in got:
        for name, fraction in wanted.items():
            assert row[name] == pytest.approx(interpolated(groups[row["g"]], fraction), abs=1e-6)


def test_approximate_percentiles_are_close(spark):
    df = spark.range(10001).selectExpr("0 AS g", "CAST(id AS DOUBLE) AS v")
    got = approximate_percentiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}).first()
    assert abs(got["p50"] - 5000) <= 2 and abs(got["p99"] - 9900) <= 2


def test_percentile_of_one_value(spark):
    df = spark.createDataFrame([(1, 4.0)] * 5, "g int, v double")
    assert exact_percentiles(df, ["g"], "v", {"p": 0.37}).first()["p"] == 4.0


def test_percentiles_of_any_sign_and_size(spark):
    values = [-1e300, -5.0, -5.0, -1e-300, 0.0, 0.0, 1e-300, 2.0, 2.001, 3e200, float("inf")]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), (None, 1.0)], "g string, v double")
    for i in range(len(values)):
        got = {r["g"]: r["p"] for r in exact_percentiles(df, ["g"], "v", {"p": i / (len(values) - 1)}).collect()}
        assert got == {"a": pytest.approx(values[i]), None: 1.0}


def test_positions(skewed):
    data, df = skewed
    got = {r["id"]: r["position"] for r in with_position(df, ["g", "id"], start=0).collect()}
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_running_total(skewed):
    data, df = skewed
    got = {r["id"]: r["upto"] for r in running_total(df, ["g"], [F.desc("id")], "id", "upto").collect()}
    totals, expected = defaultdict(int), {}
    for i, g, _ in sorted(data, reverse=True, key=lambda r: r[0]):
        totals[g] += i
        expected[i] = totals[g]
    assert got == expected


def test_first_and_last_per_key(skewed):
    data, df = skewed
    for descending in (False, True):
        got = {r["g"]: r["id"] for r in first_per_key(df, ["g"], ["id"], descending).collect()}
        pick = max if descending else min
        assert got == {g: pick(i for i, h, _ in data if h == g) for g in {r[1] for r in data}}


def test_first_per_key_with_nulls(spark, rows):
    df = spark.createDataFrame([(1, None, "b"), (1, 2, None), (2, 1, None)], "k int, o int, v string")
    assert rows(first_per_key(df, ["k"], ["o"])) == [(1, None, "b"), (2, 1, None)]


def test_smallest_per_group(skewed):
    data, df = skewed
    got = {r["g"]: r["id"] for r in smallest_per_group(df, ["g"], "id", 3).collect()}
    assert got == {g: sorted(i for i, h, _ in data if h == g)[:3] for g in {r[1] for r in data}}


def test_children_come_whole(skewed):
    data, df = skewed
    got = defaultdict(list)
    for row in children_per_parent(df, ["g"], "id").collect():
        got[row["g"]].append(row["id"])
    assert {g: sorted(c) for g, c in got.items()} == {
        g: sorted(i for i, h, _ in data if h == g) for g in {r[1] for r in data}
    }


def test_null_parents_and_copies(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "d")], "p int, c string")
    pairs = children_per_parent(df, ["p"], "c")
    assert rows(pairs) == rows(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1), (None, "d", 2)], "p int, c string, n long"))
    assert rows(children_counts(pairs, ["p"])) == [(1, 3, 2), (2, 1, 1), (None, 2, 1)]
    assert {r["p"] for r in children_per_parent(df, ["p"], "c", having=2).collect()} == {1, None}
    assert children_per_parent(df, ["p"], "c", having=4).count() == 0


def test_closure_with_cycle_and_hub(spark, rows):
    edges = [(0, i) for i in range(1, 30)] + [(1, 40), (40, 41), (41, 1), (41, 41), (0, 1)]
    df = spark.createDataFrame(edges, "parent int, child int")
    reach = {(a, b) for a, b in edges}
    while True:
        longer = reach | {(a, d) for a, b in reach for c, d in edges if b == c}
        if longer == reach:
            break
        reach = longer
    got = rows(transitive_closure(df, "parent", "child"))
    assert {(a, b) for a, b, _ in got} == reach and len(got) == len(reach)
    assert (0, 41, 3) in got and (0, 40, 2) in got


def test_closure_of_nothing(spark):
    assert transitive_closure(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_required_fields(spark, rows):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, None, None)], "id int, a string, b string")
    assert rows(K.required(df, "id", ["a", "b"])) == [("required", "1", "a"), ("required", "3", "a, b")]


def test_rules_and_nulls(spark, rows):
    df = spark.createDataFrame([(1, "a", 5), (2, None, None), (3, "z", 9)], "id int, s string, n int")
    assert rows(K.one_of(df, "id", "s", ["a"]), "key", "detail") == [("2", "NULL"), ("3", "z")]
    assert rows(K.matches(df, "id", "s", "^a$"), "key") == [("3",)]
    assert rows(K.in_range(df, F.col("id"), "n", -1, 5), "key", "detail") == [("3", "9")]
    assert rows(K.implies(df, "id", F.col("s") == "z", F.col("n") < 9, F.lit("d")), "key") == [("3",)]
    assert rows(K.implies(df, "id", F.col("s").isNull(), F.col("n") < 9, F.lit("d")), "key") == [("2",)]
    assert rows(K.equals_path_part(df, "id", F.col("s"), F.lit("a")), "key") == [("2",), ("3",)]


def test_orphans_and_null_references(spark, rows):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, parent int")
    parent = spark.createDataFrame([(10,), (10,), (None,)], "pid int")
    assert rows(K.references(child, "id", "parent", parent, "pid"), "key", "detail") == [("2", "NULL"), ("3", "99")]


def test_slugs_collide(spark, rows):
    df = spark.createDataFrame([("a-b", "c", "f1"), ("a", "b-c", "f2"), ("a", "d", "f3")], "x string, y string, f string")
    keyed = df.withColumn("slug", N.slug(F.col("x"), F.col("y")))
    assert rows(K.unique(keyed, ["slug"], "f"), "key", "detail") == [("a-b-c", "a-b-c (in f1)"), ("a-b-c", "a-b-c (in f2)")]


def test_retired_rows_may_repeat_a_key(spark):
    df = spark.createDataFrame([(1, "f1", False), (1, "f2", True)], "k int, f string, retired boolean")
    assert K.unique(df, ["k"], "f").count() == 2
    assert K.unique(df, ["k"], "f", active=P.is_active(F.col("retired"))).count() == 0


def test_uniqueness_of_nothing(spark):
    df = spark.createDataFrame([], "k int")
    assert tuple(K.is_unique(df, ["k"]).first()) == (0, 0, True)


def test_retirement_in_two_phases(spark, rows):
    before = spark.createDataFrame([(1, True), (2, False), (3, None), (4, None)], "id int, retired boolean")
    after = spark.createDataFrame([(4,)], "id int")
    assert rows(K.retired_before_removal(before, after, "id", "retired"), "key") == [("2",), ("3",)]


def test_unknown_kinds_and_lists(spark, rows):
    df = spark.createDataFrame([("A", "f1"), ("X", "f2"), ("X", "f3"), (None, "f4")], "kind string, f string")
    assert rows(K.known_kinds(df, "kind", "f", ["A"]), "key", "detail") == [("NULL", "f4"), ("X", "f2"), ("X", "f3")]
    lists = spark.createDataFrame([(1, ["a", "b"], ["b"]), (2, ["a"], None), (3, [], ["c"])], "id int, l array<string>, r array<string>")
    assert rows(K.disjoint(lists, "id", "l", "r"), "key", "detail") == [("1", "b")]


def test_fan_out_warns(spark, rows):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2, "p int")
    assert rows(K.fan_out(df, "p", 2)) == [("fan_out", "1", "warning: 3 children")]


def test_owned_children(spark, rows):
    parents = spark.createDataFrame(
        [("own", True, None), ("owned", False, None), ("idle", False, None), ("old", True, True), ("both", True, False)],
        "app string, has_own boolean, retired boolean",
    )
    children = spark.createDataFrame(
        [(a, f"{a}-e{i}") for a in ("own", "owned", "idle", "old", "both") for i in (1, 2)], "app string, event string"
    )
    owned = spark.createDataFrame([("owned",), ("both",), ("both",)], "app string")
    excluded = F.col("event").endswith("e2")
    active = registrations.active_children(parents, children, owned, "app", "has_own", "retired", excluded)
    assert rows(active, "event") == [("both-e1",), ("own-e1",), ("owned-e1",)]
    assert rows(registrations.needing_own_role(parents, owned, "app", "has_own", "retired"), "app") == [("own",)]


def test_system_rows(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "confluent")], "name string, variant string")
    got = rows(registrations.system_rows(df, "name", "variant"), "topic", "retention_ms")
    assert len(got) == 7 and ("b-confluent-license", -1) in got and ("a-connect-status", 86_400_000) in got


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, "Access DENIED", {"a": "x"}, ["dev"], None), (2, None, None, None, True), (3, "", {"a": "x", "b": "y"}, [], False)],
        "id int, t string, d map<string,string>, e array<string>, r boolean",
    )
    got = df.select(
        P.contains_any(F.col("t")),
        P.contains_term(F.col("t"), "DENIED"),
        P.has_exact_dims(F.col("d"), ["a"], a="x"),
        P.any_dim_contains(F.col("d"), "y"),
        P.in_environment(F.col("e"), "test"),
        P.is_active(F.col("r")),
        P.not_listed(F.lit("dev"), F.col("e")),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, True, True, False, False, True, False),
        (False, False, False, False, True, False, True),
        (False, False, False, True, False, True, True),
    ]


def test_ratio_never_divides_by_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (8, 4)], "f int, s int")
    assert [r[0] for r in df.select(P.guarded_ratio(F.col("f"), F.col("s"), 0)).collect()] == [0.0, 0.5, 8 / 12]
    assert [r[0] for r in df.select(P.guarded_ratio(F.col("f"), F.col("s"), 10)).collect()] == [0.0, 0.0, 8 / 12]


def test_terms_are_case_sensitive(spark, rows):
    df = spark.createDataFrame([("ERROR here",), ("error here",), (None,), ("AccessDenied ERROR",)], "t string")
    assert rows(term_counts(df, "t", ("ERROR", "AccessDenied"))) == [("AccessDenied", 1), ("ERROR", 2)]


@pytest.mark.parametrize(
    ("text", "ok"), [("10.0.0.0/8", True), ("10.0.0.256/8", False), ("10.0.0.0/33", False), ("10.0.0/8", False), ("x", False)]
)
def test_cidr(spark, text, ok):
    assert spark.range(1).select(N.is_cidr(F.lit(text))).first()[0] is ok


def test_text_helpers(spark):
    row = spark.range(1).select(
        N.without_suffix(F.lit("a.yaml.yaml"), ".yaml"),
        N.without_suffix(F.lit("axyaml"), ".yaml"),
        N.without_prefix(F.lit("s3://b/k"), "s3://"),
        N.common_name(F.lit("O=x,CN=me.example,C=y")),
        N.common_name(F.lit("O=x")),
        N.first_segment_after(F.lit("/usr/dags/team/a.py"), "/dags/"),
        N.first_segment_after(F.lit("/usr/x"), "/dags/"),
        N.stable_part(F.lit("abc"), F.lit(1)),
    ).first()
    assert tuple(row) == ("a.yaml", "axyaml", "b/k", "me.example", None, "team", None, 0)


@pytest.mark.parametrize(
    ("text", "ok"),
    [('{"a":1}', True), ("1", True), ("[1]", True), ('{"a":1}}', False), ("1,2", False), ('1,"b":2', False), ("", False), (None, False), ("{", False)],
)
def test_is_json(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(P.is_json(F.col("t"))).first()[0] is ok


def test_percentiles_of_values_close_together(spark):
    # All values lie in one range of half a percent, which is cut into pieces.
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, NULL, 'g') AS g", "20.0 + pmod(id * 7919, 20000) / 400000 AS v")
    fractions = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p999": 0.999, "p100": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", fractions).collect()}
    for g in (None, "g"):
        values = sorted(r["v"] for r in df.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        for name, fraction in fractions.items():
            rank = fraction * (len(values) - 1)
            low = int(rank)
            high = min(low + 1, len(values) - 1)
            assert abs(got[g][name] - (values[low] + (values[high] - values[low]) * (rank - low))) < 1e-9
