"""Access analysis: grants expanded, matched to resources and made effective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.names import is_role_arn
from tidewatch.functions.predicates import in_environment
from tidewatch.operators.closure import transitive_closure
from tidewatch.session import literal_rows

# Permissions that a resource type allows.
SCOPE_PERMISSIONS = {
    "DATABASE": ("CREATE_TABLE", "ALTER", "DROP", "DESCRIBE"),
    "TABLE": ("SELECT", "INSERT", "DELETE", "DESCRIBE", "ALTER", "DROP"),
}
ALL = "ALL"

# Classification tags that hold everywhere. Tags whose values
# differ between deployments (organisation, source system) are given by the caller.
TAG_VOCABULARY = {
    "Domain": ("Network", "Customer", "Asset", "Operations", "Finance", "Reference"),
    "Layer": ("Landing", "Raw", "Conformed", "Modelled"),
    "Sensitivity": ("Public", "Internal", "Restricted", "HighlyRestricted", "PersonalInformation"),
    "PII": ("True", "False"),
    "DataSubjectType": ("Customer", "Employee", "ThirdParty", "NotApplicable"),
    "RetentionClass": ("Transient", "MediumTerm", "LongTerm", "Regulatory", "Indefinite"),
    "Environment": ("Dev", "Test", "UAT", "Prod"),
}

# Who is granted into whom, and what each role itself may do.
ROLE_EDGES = (
    ("role_reader", "role_writer"),
    ("role_writer", "role_editor"),
    ("role_editor", "role_admin"),
)
ROLE_PRIVILEGES = {
    "role_reader": ("USAGE", "SELECT"),
    "role_writer": ("SELECT", "INSERT", "UPDATE"),
    "role_editor": ("DELETE", "TRUNCATE"),
    "role_admin": ("CREATE", "ALTER", "DROP"),
}

# What a namespace receives on its own, read and write schemas.
NAMESPACE_PRIVILEGES = {
    "own": ("USAGE", "CREATE"),
    "read": ("USAGE", "SELECT"),
    "write": ("USAGE", "CREATE", "SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE"),
    "database": ("CREATE",),
}


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def expand_named(grants: DataFrame) -> DataFrame:
    """One row per principal and permission.

    ``grants`` has ``resource_type, resource, groups, roles``, the latter two
    arrays of ``struct<name, grants array>``.
    """
    sides = [
        grants.select("resource_type", "resource", F.lit(kind).alias("principal_kind"), F.explode(column).alias("_g"))
        for kind, column in (("group", "groups"), ("role", "roles"))
    ]
    both = sides[0].unionByName(sides[1])
    return both.select(
        "resource_type",
        "resource",
        "principal_kind",
        F.col("_g.name").alias("principal"),
        F.explode("_g.grants").alias("permission"),
    )


def resolve_principals(df: DataFrame, groups: DataFrame, principal: str = "principal") -> DataFrame:
    """Role identifiers stay; group names become group identifiers.

    ``groups`` has ``name, group_id``, one row per name. An unknown name is
    left NULL in ``principal_arn``.
    """
    looked_up = df.join(groups.select(F.col("name").alias(principal), "group_id"), principal, "left")
    arn = F.when(is_role_arn(F.col(principal)), F.col(principal)).otherwise(
        F.concat(F.lit("arn:aws:identitystore:::group/"), F.col("group_id"))
    )
    return looked_up.withColumn("principal_arn", arn).drop("group_id")


def expand_tag_grants(grants: DataFrame) -> DataFrame:
    """One row per grant, resource type and permission, for the parts a grant has.

    ``grants`` has ``grant_id, principal, database_grants, table_grants`` (arrays,
    NULL where the part is absent).
    """
    parts = [
        grants.where(F.col(column).isNotNull()).select(
            "grant_id", "principal", F.lit(kind).alias("resource_type"), F.explode(column).alias("permission")
        )
        for kind, column in (("DATABASE", "database_grants"), ("TABLE", "table_grants"))
    ]
    return parts[0].unionByName(parts[1])


def tag_definitions(definitions: DataFrame, environment: str) -> DataFrame:
    """Active ``key, value`` rows of ``key, values, environments``."""
    return definitions.where(in_environment(F.col("environments"), environment)).select(
        "key", F.explode("values").alias("value")
    )


def undefined_tags(used: DataFrame, defined: DataFrame) -> DataFrame:
    """Used ``(key, value)`` pairs that no definition has."""
    return used.select("key", "value").distinct().join(defined, ["key", "value"], "left_anti")


def vocabulary(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    tags = {**TAG_VOCABULARY, **(extra or {})}
    return literal_rows(spark, [(k, v) for k, values in tags.items() for v in values], "key string, value string")


def inherit_tags(tables: DataFrame, own: DataFrame, from_database: DataFrame) -> DataFrame:
    """Effective ``resource, key, value``: a table's own tag, else its database's.

    ``tables`` has ``resource, database``; ``own`` has ``resource, key, value``;
    ``from_database`` has ``database, key, value``, one value per key.
    """
    inherited = tables.join(from_database, "database").select("resource", "key", "value", F.lit(1).alias("_rank"))
    both = own.select("resource", "key", "value", F.lit(0).alias("_rank")).unionByName(inherited)
    return both.groupBy("resource", "key").agg(F.min_by("value", F.struct("_rank", "value")).alias("value"))


def expression_classes(expressions: DataFrame) -> DataFrame:
    """``grant_id, expression, wanted``: each grant with the name and content of its expression.

    ``expressions`` has ``grant_id, key, values``; values of a repeated key are
    merged. Grants that ask for the same tags share the name, which spells the
    keys and values in order.
    """
    options = expressions.select("grant_id", "key", F.explode("values").alias("value"))
    per_key = options.groupBy("grant_id", "key").agg(F.sort_array(F.collect_set("value")).alias("values"))
    entries = per_key.groupBy("grant_id").agg(F.sort_array(F.collect_list(F.struct("key", "values"))).alias("_e"))
    spelt = F.transform("_e", lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["values"], "|")))
    return entries.select("grant_id", F.array_join(spelt, ";").alias("expression"), F.map_from_entries("_e").alias("wanted"))


def _carried(tags: DataFrame) -> DataFrame:
    """``resource, carried``: a resource's handful of tags as one map."""
    per_key = tags.groupBy("resource", "key").agg(F.collect_set("value").alias("_values"))
    return per_key.groupBy("resource").agg(F.map_from_entries(F.collect_list(F.struct("key", "_values"))).alias("carried"))


def _satisfied() -> Column:
    """Every wanted key is carried with one of the wanted values."""
    return F.forall(
        F.map_entries("wanted"),
        lambda e: F.coalesce(F.arrays_overlap(F.try_element_at(F.col("carried"), e["key"]), e["value"]), F.lit(False)),
    )


def match_expressions(classes: DataFrame, tags: DataFrame) -> DataFrame:
    """``expression, resource`` pairs that fit, for each distinct expression once.

    ``classes`` comes from ``expression_classes``; ``tags`` has ``resource, key,
    value``. An expression is joined on its rarest key only, and its other keys
    are tested on the joined row, so a tag value that a third of all resources
    carry does not multiply into pairs unless it is asked for alone. Tables of
    few bytes on disk hold many resources, whose tags as maps no driver can
    broadcast, so the join is a sorted one.
    """
    wanted = classes.groupBy("expression").agg(F.first("wanted").alias("wanted"))
    frequency = tags.groupBy("key", "value").agg(F.count(F.lit(1)).alias("_f"))
    options = wanted.select("expression", F.explode("wanted").alias("key", "values")).select(
        "expression", "key", F.explode("values").alias("value")
    )
    cost = (
        options.join(frequency.hint("merge"), ["key", "value"], "left")
        .groupBy("expression", "key")
        .agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("_cost"))
    )
    anchor = cost.groupBy("expression").agg(F.min_by("key", F.struct("_cost", "key")).alias("key"))
    anchored = wanted.join(anchor, "expression").select(
        "expression", "wanted", "key", F.explode(F.element_at("wanted", F.col("key"))).alias("value")
    )
    located = _carried(tags).select("resource", "carried", F.explode("carried").alias("key", "_values")).select(
        "resource", "carried", "key", F.explode("_values").alias("value")
    )
    return anchored.join(located.hint("merge"), ["key", "value"]).where(_satisfied()).select("expression", "resource").distinct()


def match_tags(expressions: DataFrame, tags: DataFrame) -> DataFrame:
    """Pairs ``grant_id, resource`` whose tags satisfy the whole expression.

    Keys are ANDed, values ORed. The result has a row for every pair; where
    that is too much, keep ``match_expressions`` and ``expression_classes``
    apart, or ask for single pairs with ``match_asked``.
    """
    classes = expression_classes(expressions)
    return match_expressions(classes, tags).join(classes.select("grant_id", "expression"), "expression").select("grant_id", "resource")


def match_asked(asked: DataFrame, expressions: DataFrame, tags: DataFrame) -> DataFrame:
    """The asked ``grant_id, resource`` pairs that fit: one look-up on each side, no other pairs.

    Grants and resources grow with the input, so neither is broadcast.
    """
    classes = expression_classes(expressions).select("grant_id", "wanted").hint("merge")
    carried = _carried(tags).hint("merge")
    return asked.join(classes, "grant_id").join(carried, "resource").where(_satisfied()).select("grant_id", "resource")


def expand_all(grants: DataFrame) -> DataFrame:
    """Replace ``ALL`` by every permission of the row's resource type."""
    table = F.when(F.col("resource_type") == "DATABASE", _words(SCOPE_PERMISSIONS["DATABASE"])).otherwise(
        _words(SCOPE_PERMISSIONS["TABLE"])
    )
    permissions = F.when(F.col("permission") == ALL, table).otherwise(F.array("permission"))
    kept = [c for c in grants.columns if c != "permission"]
    return grants.select(*kept, F.explode(permissions).alias("permission"))


def invalid_scope(grants: DataFrame) -> DataFrame:
    """Grants whose permission the resource type does not allow; ``ALL`` is for tables."""
    allowed = F.when(F.col("resource_type") == "DATABASE", _words(SCOPE_PERMISSIONS["DATABASE"])).otherwise(
        _words((*SCOPE_PERMISSIONS["TABLE"], ALL))
    )
    return grants.where(~F.array_contains(allowed, F.col("permission")))


def effective_permissions(*sources: DataFrame) -> DataFrame:
    """Grants of several mechanisms merged: one row per right, with its mechanisms.

    Each source has ``principal, resource, permission, mechanism``. There are
    only as many mechanisms as sources, so the list per right is short.
    """
    rows = sources[0]
    for source in sources[1:]:
        rows = rows.unionByName(source)
    return rows.groupBy("principal", "resource", "permission").agg(
        F.sort_array(F.collect_set("mechanism")).alias("mechanisms")
    )


def duplicate_grants(effective: DataFrame) -> DataFrame:
    """Rights that reach a principal by more than one mechanism."""
    return effective.where(F.size("mechanisms") > 1)


def inherited_privileges(spark, edges=ROLE_EDGES, privileges=None) -> DataFrame:
    """Each role's own and inherited privileges: ``role, privilege``."""
    table = literal_rows(spark, list(edges), "parent string, child string")
    own = literal_rows(
        spark,
        [(r, p) for r, ps in (privileges or ROLE_PRIVILEGES).items() for p in ps],
        "role string, privilege string",
    )
    reached = transitive_closure(table, "parent", "child")
    handed_down = reached.join(own, reached["parent"] == own["role"]).select(F.col("child").alias("role"), "privilege")
    return own.unionByName(handed_down).distinct()


def namespace_privileges(namespaces: DataFrame, schemas: DataFrame, databases: DataFrame) -> DataFrame:
    """Privilege rows of each namespace; a missing object gives an error row.

    ``namespaces`` has ``namespace, read_schemas, write_schemas,
    write_databases`` (arrays). ``schemas`` and ``databases`` have ``name``.
    """
    asked = [
        namespaces.select("namespace", F.lit(scope).alias("scope"), F.explode(column).alias("object"))
        for scope, column in (("read", "read_schemas"), ("write", "write_schemas"), ("database", "write_databases"))
    ]
    own = namespaces.select("namespace", F.lit("own").alias("scope"), F.col("namespace").alias("object"))
    existing = schemas.select(F.lit("schema").alias("kind"), F.col("name").alias("object")).unionByName(
        databases.select(F.lit("database").alias("kind"), F.col("name").alias("object"))
    )
    requested = asked[0].unionByName(asked[1]).unionByName(asked[2])
    kinds = F.when(F.col("scope") == "database", "database").otherwise("schema")
    checked = requested.withColumn("kind", kinds).join(
        existing.distinct().withColumn("_found", F.lit(True)), ["kind", "object"], "left"
    )
    # A namespace's own schema is created on demand, so it always exists.
    rows = checked.select("namespace", "scope", "object", F.coalesce("_found", F.lit(False)).alias("found")).unionByName(
        own.withColumn("found", F.lit(True))
    )
    privileges = F.create_map(
        *[part for scope, words in NAMESPACE_PRIVILEGES.items() for part in (F.lit(scope), _words(words))]
    )
    granted = F.when(F.col("found"), F.element_at(privileges, F.col("scope"))).otherwise(
        F.array(F.lit("ERROR: does not exist"))
    )
    return rows.select("namespace", "scope", "object", F.explode(granted).alias("privilege"))


def credential_databases(namespaces: DataFrame, base_database: str) -> DataFrame:
    """The base database and the writable ones, sorted and without repeats, per namespace."""
    every = F.concat(F.array(F.lit(base_database)), F.coalesce("write_databases", F.array().cast("array<string>")))
    return namespaces.select("namespace", F.sort_array(F.array_distinct(every)).alias("databases"))


def outside_prefix(df: DataFrame, key: str, path: Column, namespace: Column) -> DataFrame:
    """Paths that do not lie below ``<namespace>/``; a sibling sharing the prefix is outside."""
    inside = F.startswith(path, F.concat(namespace, F.lit("/")))
    return df.where(~F.coalesce(inside, F.lit(False))).select(
        F.col(key), path.alias("path"), namespace.alias("namespace")
    )


def positive_check(effective: DataFrame, expected: DataFrame, permission: str = "SELECT") -> DataFrame:
    """Each expected ``principal, resource`` must hold the permission."""
    held = effective.where(F.col("permission") == permission).select("principal", "resource").distinct()
    joined = expected.join(held.withColumn("_held", F.lit(True)), ["principal", "resource"], "left")
    return joined.select(
        "principal", "resource", F.when(F.col("_held"), "PASS").otherwise("FAIL").alias("outcome")
    )


def negative_check(effective: DataFrame, forbidden: DataFrame, permission: str = "INSERT") -> DataFrame:
    """Each forbidden ``principal, resource`` must not hold the permission."""
    held = effective.where(F.col("permission") == permission).select("principal", "resource").distinct()
    joined = forbidden.join(held.withColumn("_held", F.lit(True)), ["principal", "resource"], "left")
    return joined.select(
        "principal",
        "resource",
        F.when(F.col("_held"), "FAIL").otherwise("PASS").alias("outcome"),
        F.when(F.col("_held"), F.lit("over-permissioned")).otherwise(F.lit("")).alias("detail"),
    )
