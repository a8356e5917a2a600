"""Access analysis over grants derived from suppliers, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import governance as G
from tidewatch.queries.joins import part_tags, tag_expressions
from tidewatch.queries.registry import query, table


def _grants(*pairs):
    """An array of ``struct<name, grants>`` from (name column, permissions)."""
    return F.array(
        *[
            F.struct(name.alias("name"), F.array(*[F.lit(p) for p in permissions]).alias("grants"))
            for name, permissions in pairs
        ]
    )


def named_grants(spark, sf):
    """Each part is a table with a reading group per brand and a writing role per type."""
    reader = F.concat(F.lit("readers-"), F.col("p_brand"))
    role = F.concat(F.lit("arn:aws:iam::100000000000:role/"), F.lower("p_type"))
    return table(spark, sf, "part").select(
        F.when(F.col("p_size") > 45, "DATABASE").otherwise("TABLE").alias("resource_type"),
        F.col("p_partkey").alias("resource"),
        _grants((reader, ["SELECT", "DESCRIBE"])).alias("groups"),
        F.when(F.col("p_size") > 10, _grants((role, ["ALL"]))).alias("roles"),
    )


NAMED_SQL = """
  SELECT CASE WHEN p_size > 45 THEN 'DATABASE' ELSE 'TABLE' END AS resource_type, p_partkey AS resource, 'group' AS principal_kind,
         'readers-' || p_brand AS principal, unnest(['SELECT', 'DESCRIBE']) AS permission FROM part
  UNION ALL
  SELECT CASE WHEN p_size > 45 THEN 'DATABASE' ELSE 'TABLE' END, p_partkey, 'role', 'arn:aws:iam::100000000000:role/' || lower(p_type), 'ALL'
  FROM part WHERE p_size > 10
"""


@query("k01_named_grants", NAMED_SQL)
def expand_named(spark, sf):
    return G.expand_named(named_grants(spark, sf))


@query(
    "k02_principals",
    f"""
    SELECT principal, resource, permission, CASE WHEN starts_with(principal, 'arn:') THEN principal
           WHEN principal <> 'readers-Brand#3' THEN 'arn:aws:identitystore:::group/' || md5(principal) END AS principal_arn
    FROM ({NAMED_SQL})
    """,
)
def principals(spark, sf):
    name = F.concat(F.lit("readers-"), F.col("p_brand"))
    groups = table(spark, sf, "part").where("p_brand <> 'Brand#3'").select(name.alias("name")).distinct()
    resolved = G.resolve_principals(G.expand_named(named_grants(spark, sf)), groups.withColumn("group_id", F.md5("name")))
    return resolved.select("principal", "resource", "permission", "principal_arn")


@query(
    "k03_tag_grants",
    """
    SELECT s_suppkey AS grant_id, s_name AS principal, 'DATABASE' AS resource_type, unnest(['DESCRIBE', 'ALTER']) AS permission
    FROM supplier WHERE s_acctbal > 2000
    UNION ALL SELECT s_suppkey, s_name, 'TABLE', unnest(['SELECT']) FROM supplier WHERE s_acctbal <= 6000
    """,
)
def tag_grants(spark, sf):
    grants = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("grant_id"),
        F.col("s_name").alias("principal"),
        F.when(F.col("s_acctbal") > 2000, F.array(F.lit("DESCRIBE"), F.lit("ALTER"))).alias("database_grants"),
        F.when(F.col("s_acctbal") <= 6000, F.array(F.lit("SELECT"))).alias("table_grants"),
    )
    return G.expand_tag_grants(grants)


def brand_definitions(spark, sf):
    """Every brand is a tag; its values are its types, some brands only in production."""
    environments = F.when(F.col("key").isin("Brand#5", "Brand#6"), F.array(F.lit("prod"))).when(
        F.col("key") == "Brand#7", F.array(F.lit("dev"), F.lit("test"))
    )
    used = table(spark, sf, "part").where("p_size > 3").select(F.col("p_brand").alias("key"), "p_type")
    return used.groupBy("key").agg(F.collect_set("p_type").alias("values")).withColumn("environments", environments)


@query(
    "k04_tag_definitions",
    "SELECT DISTINCT p_brand AS key, p_type AS value FROM part WHERE p_size > 3 AND p_brand NOT IN ('Brand#5', 'Brand#6')",
)
def tag_definitions(spark, sf):
    return G.tag_definitions(brand_definitions(spark, sf), "test")


@query(
    "k05_undefined_tags",
    """
    SELECT DISTINCT p_brand AS key, p_type AS value FROM part
    EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 3 AND p_brand NOT IN ('Brand#5', 'Brand#6')
    """,
)
def undefined_tags(spark, sf):
    used = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("value"))
    return G.undefined_tags(used, G.tag_definitions(brand_definitions(spark, sf), "test"))


def effective(spark, sf):
    """Rights on the asked pairs, by tag grants, named grants and inherited roles.

    Suppliers hold their tag expression's parts, are named on the parts they
    deliver in bulk, and have a role on the parts of one size. Asked are the
    parts that a supplier delivers, so the rows grow with the lines.
    """
    lines = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("principal"), F.col("l_partkey").alias("resource"), "l_quantity"
    )
    asked = lines.groupBy("principal", "resource").agg(F.max("l_quantity").alias("most"))
    wanted = asked.select(F.col("principal").alias("grant_id"), "resource")
    by_tag = G.match_asked(wanted, tag_expressions(spark, sf), part_tags(spark, sf)).select(
        F.col("grant_id").alias("principal"), "resource", F.lit("SELECT").alias("permission"), F.lit("lf_tag").alias("mechanism")
    )
    named = (
        asked.where("most >= 30")
        .select("principal", "resource", F.explode(F.array(F.lit("SELECT"), F.lit("INSERT"))).alias("permission"))
        .withColumn("mechanism", F.lit("named"))
    )
    role = F.when(F.col("s_acctbal") > 5000, "role_admin").when(F.col("s_acctbal") > 2000, "role_editor")
    roles = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("principal"), (F.col("s_nationkey") + 25).alias("p_size"), role.alias("role")
    )
    sized = table(spark, sf, "part").select(F.col("p_partkey").alias("resource"), "p_size")
    # Suppliers and parts grow with the input; the privileges of the roles are a fixed handful.
    held = asked.join(roles.where("role IS NOT NULL").hint("merge"), "principal").join(sized.hint("merge"), ["resource", "p_size"])
    by_role = held.join(F.broadcast(G.inherited_privileges(spark)), "role").select(
        "principal", "resource", F.col("privilege").alias("permission"), F.lit("role").alias("mechanism")
    )
    return G.effective_permissions(by_tag, named, by_role)


EFFECTIVE_SQL = """
  WITH a AS (SELECT l_suppkey AS principal, l_partkey AS resource, max(l_quantity) AS most FROM lineitem GROUP BY ALL),
  f AS (SELECT * FROM a JOIN supplier ON s_suppkey = principal JOIN part ON p_partkey = resource),
  g AS (
    SELECT principal, resource, 'SELECT' AS permission, 'lf_tag' AS mechanism FROM f
    WHERE p_brand = 'Brand#' || (s_suppkey % 25 + 1) AND p_size IN (s_nationkey + 1, s_nationkey + 20)
    UNION
    SELECT principal, resource, unnest(['SELECT', 'INSERT']), 'named' FROM a WHERE most >= 30
    UNION
    SELECT principal, resource, unnest(CASE WHEN s_acctbal > 5000
             THEN ['USAGE', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE', 'CREATE', 'ALTER', 'DROP']
             ELSE ['USAGE', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE'] END), 'role'
    FROM f WHERE p_size = s_nationkey + 25 AND s_acctbal > 2000),
  e AS (SELECT principal, resource, permission, string_agg(mechanism, ',' ORDER BY mechanism) AS mechanisms, count(*) AS n FROM g GROUP BY ALL)
"""


@query("k06_effective_permissions", EFFECTIVE_SQL + "SELECT principal, resource, permission, mechanisms FROM e")
def effective_permissions(spark, sf):
    return effective(spark, sf).withColumn("mechanisms", F.array_join("mechanisms", ","))


@query("k07_duplicate_grants", EFFECTIVE_SQL + "SELECT principal, resource, permission, mechanisms FROM e WHERE n > 1")
def duplicate_grants(spark, sf):
    return G.duplicate_grants(effective(spark, sf)).withColumn("mechanisms", F.array_join("mechanisms", ","))


@query(
    "k08_expand_all",
    f"""
    SELECT principal, resource, resource_type, unnest(CASE WHEN permission <> 'ALL' THEN [permission]
             WHEN resource_type = 'DATABASE' THEN ['CREATE_TABLE', 'ALTER', 'DROP', 'DESCRIBE']
             ELSE ['SELECT', 'INSERT', 'DELETE', 'DESCRIBE', 'ALTER', 'DROP'] END) AS permission FROM ({NAMED_SQL})
    """,
)
def expand_all(spark, sf):
    return G.expand_all(G.expand_named(named_grants(spark, sf))).select("principal", "resource", "resource_type", "permission")


@query(
    "k08_invalid_scope",
    f"SELECT principal, resource, permission FROM ({NAMED_SQL}) WHERE resource_type = 'DATABASE' AND permission IN ('SELECT', 'ALL')",
)
def invalid_scope(spark, sf):
    return G.invalid_scope(G.expand_named(named_grants(spark, sf))).select("principal", "resource", "permission")


@query(
    "k09_role_privileges",
    """
    WITH RECURSIVE edges AS (SELECT * FROM (VALUES ('role_reader', 'role_writer'), ('role_writer', 'role_editor'), ('role_editor', 'role_admin')) v(parent, child)),
    own AS (SELECT role, unnest(p) AS privilege FROM (VALUES ('role_reader', ['USAGE', 'SELECT']), ('role_writer', ['SELECT', 'INSERT', 'UPDATE']),
            ('role_editor', ['DELETE', 'TRUNCATE']), ('role_admin', ['CREATE', 'ALTER', 'DROP'])) v(role, p)),
    held(role, privilege) AS (SELECT role, privilege FROM own UNION SELECT child, privilege FROM held JOIN edges ON role = parent)
    SELECT c_custkey, 'db_' || c_nationkey AS database, privilege FROM customer JOIN held ON role = CASE
      WHEN c_acctbal < 0 THEN 'role_reader' WHEN c_acctbal < 3000 THEN 'role_writer' WHEN c_acctbal < 6000 THEN 'role_editor' ELSE 'role_admin' END
    """,
)
def role_privileges(spark, sf):
    balance = F.col("c_acctbal")
    role = F.when(balance < 0, "role_reader").when(balance < 3000, "role_writer").when(balance < 6000, "role_editor")
    holders = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("db_"), F.col("c_nationkey").cast("string")).alias("database"),
        role.otherwise("role_admin").alias("role"),
    )
    return holders.join(G.inherited_privileges(spark), "role").select("c_custkey", "database", "privilege")


@query(
    "k10_namespace_privileges",
    """
    WITH asked AS (
      SELECT c_name AS namespace, 'own' AS scope, c_name AS object, true AS found FROM customer
      UNION ALL SELECT c_name, 'read', 'NATION_' || c_nationkey, c_nationkey < 25 FROM customer
      UNION ALL SELECT c_name, 'read', 'NATION_' || (c_nationkey + 1), c_nationkey + 1 < 25 FROM customer
      UNION ALL SELECT c_name, 'write', 'NATION_' || (c_nationkey + 2), c_nationkey + 2 < 25 FROM customer WHERE c_acctbal > 5000
      UNION ALL SELECT c_name, 'database', 'db_' || c_mktsegment, c_mktsegment <> 'FURNITURE' FROM customer),
    p AS (SELECT * FROM (VALUES ('own', ['USAGE', 'CREATE']), ('read', ['USAGE', 'SELECT']), ('database', ['CREATE']),
          ('write', ['USAGE', 'CREATE', 'SELECT', 'INSERT', 'UPDATE', 'DELETE', 'TRUNCATE'])) v(scope, words))
    SELECT namespace, scope, object, unnest(CASE WHEN found THEN words ELSE ['ERROR: does not exist'] END) AS privilege
    FROM asked JOIN p USING (scope)
    """,
)
def namespace_privileges(spark, sf):
    customer = table(spark, sf, "customer")
    nation = [F.concat(F.lit("NATION_"), (F.col("c_nationkey") + i).cast("string")) for i in range(3)]
    namespaces = customer.select(
        F.col("c_name").alias("namespace"),
        F.array(nation[0], nation[1]).alias("read_schemas"),
        F.when(F.col("c_acctbal") > 5000, F.array(nation[2])).alias("write_schemas"),
        F.array(F.concat(F.lit("db_"), F.col("c_mktsegment"))).alias("write_databases"),
    )
    schemas = table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    databases = customer.where("c_mktsegment <> 'FURNITURE'").select(F.concat(F.lit("db_"), F.col("c_mktsegment")).alias("name"))
    return G.namespace_privileges(namespaces, schemas, databases.distinct())


@query(
    "k11_prefix_scope",
    """
    SELECT page_id, substr(url, strpos(url, '://') + 3) AS path, 'blog' AS namespace FROM pages
    WHERE NOT starts_with(substr(url, strpos(url, '://') + 3), 'blog/')
    """,
)
def prefix_scope(spark, sf):
    # Hosts such as blog.x share the prefix of the namespace but lie outside it.
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return G.outside_prefix(table(spark, sf, "pages"), "page_id", path, F.lit("blog"))


@query(
    "k12_tag_vocabulary",
    """
    SELECT 'Domain' AS key, source AS value, count(*) AS n FROM documents GROUP BY source
    UNION ALL SELECT 'PII', CASE WHEN contains(text, '@') THEN 'true' ELSE 'no' END, count(*) FROM documents GROUP BY ALL
    """,
)
def tag_vocabulary(spark, sf):
    # Documents are tagged by language, source and personal data; only known languages were defined.
    tags = F.array(
        F.struct(F.lit("Language").alias("key"), F.col("lang").alias("value")),
        F.struct(F.lit("Domain").alias("key"), F.col("source").alias("value")),
        F.struct(F.lit("PII").alias("key"), F.when(F.contains("text", F.lit("@")), "true").otherwise("no").alias("value")),
        F.struct(F.lit("Layer").alias("key"), F.lit("Raw").alias("value")),
    )
    used = table(spark, sf, "documents").select(F.inline(tags)).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return used.join(G.vocabulary(spark, {"Language": ["en", "fr", "de", "es"]}), ["key", "value"], "left_anti")
