"""Access audit and lineage: resources, groups and models derived from table keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import principals as PR
from ..operators import audit as A
from ..operators import graph as GR
from ..session import scratch_path
from .registry import Tables, query, with_sql

DOMAIN = "@example.com"


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def policies(t: Tables):
    k = F.col("c_custkey")
    project, dataset = F.col("c_nationkey"), k % 40
    data = _cat("//bigquery.googleapis.com/projects/p", project, "/datasets/d", dataset)
    asset = (
        F.when(k % 5 == 0, "cloudresourcemanager.googleapis.com/Folder")
        .when(k % 5 == 1, "cloudresourcemanager.googleapis.com/Project")
        .when(k % 5 == 2, "bigquery.googleapis.com/Dataset")
        .when(k % 5 == 3, "bigquery.googleapis.com/Table")
        .otherwise("storage.googleapis.com/Bucket")
    )
    resource = (
        F.when(k % 5 == 0, _cat("//cloudresourcemanager.googleapis.com/folders/", k))
        .when(k % 5 == 1, _cat("//cloudresourcemanager.googleapis.com/projects/p", project))
        .when(k % 5 == 2, data)
        .when(k % 5 == 3, F.concat(data, _cat("/tables/t", k)))
        .otherwise(_cat("//storage.googleapis.com/b", k))
    )
    viewers = F.array(
        _cat("user:u", k, DOMAIN), _cat("group:g", F.floor(k / 15).cast("long") + 1, DOMAIN), _cat("serviceAccount:s", k, "@p.iam.gserviceaccount.com")
    )
    owners = F.array(F.when(k % 2 == 0, "allUsers").otherwise("legacyOwner"))
    bindings = F.array(
        F.struct(F.lit("roles/viewer").alias("role"), viewers.alias("members")),
        F.struct(F.lit("roles/owner").alias("role"), owners.alias("members")),
    )
    return t.customer.select(asset.alias("asset_type"), resource.alias("resource"), bindings.alias("bindings"))


IAM = (
    "iam",
    f"""SELECT CASE WHEN k % 5 = 0 THEN '' ELSE 'p' || n END AS project_id,
  CASE WHEN k % 5 IN (2, 3) THEN 'd' || k % 40 ELSE '' END AS dataset_id,
  CASE WHEN k % 5 = 0 THEN CAST(k AS VARCHAR) WHEN k % 5 = 3 THEN 't' || k END AS resource_id,
  ['FOLDER', 'PROJECT', 'DATASET', 'TABLE'][k % 5 + 1] AS resource_type, role, member, member_type, 'IAM_POLICY' AS source,
  CAST(NULL AS VARCHAR) AS inherited_from_group
FROM (SELECT c_custkey AS k, c_nationkey AS n, m.role AS role, m.member AS member, m.member_type AS member_type FROM customer,
  LATERAL (SELECT unnest([
    struct_pack(role := 'roles/viewer', member := 'user:u' || c_custkey || '{DOMAIN}', member_type := 'user'),
    struct_pack(role := 'roles/viewer', member := 'group:g' || (c_custkey // 15 + 1) || '{DOMAIN}', member_type := 'group'),
    struct_pack(role := 'roles/viewer', member := 'serviceAccount:s' || c_custkey || '@p.iam.gserviceaccount.com', member_type := 'serviceAccount'),
    struct_pack(role := 'roles/owner', member := CASE WHEN c_custkey % 2 = 0 THEN 'allUsers' ELSE 'legacyOwner' END,
      member_type := CASE WHEN c_custkey % 2 = 0 THEN 'specialGroup' ELSE 'unknown' END)]) AS m))
WHERE k % 5 <> 4""",
)


def acl(t: Tables):
    s = F.col("s_suppkey")
    kinds = ["userByEmail", "groupByEmail", "specialGroup", "domain", "view", "dataset", "routine", "iamMember", None]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (s % 9).cast("int"))
    entity = F.when(s % 9 == 7, _cat("user:m", s, DOMAIN)).otherwise(_cat("e", s % 70))
    return t.supplier.select(
        _cat("p", F.col("s_nationkey")).alias("project"),
        _cat("d", s % 40).alias("dataset"),
        F.when(s % 4 != 0, "READER").alias("role"),
        kind.alias("entity_type"),
        entity.alias("entity_id"),
    )


ACL = (
    "acl",
    f"""SELECT 'p' || s_nationkey AS project_id, 'd' || s_suppkey % 40 AS dataset_id, CAST(NULL AS VARCHAR) AS resource_id,
  'DATASET' AS resource_type, CASE WHEN s_suppkey % 4 <> 0 THEN 'READER' ELSE 'NONE' END AS role,
  CASE s_suppkey % 9 WHEN 0 THEN 'user:e' || s_suppkey % 70 WHEN 1 THEN 'group:e' || s_suppkey % 70
    WHEN 7 THEN 'user:m' || s_suppkey || '{DOMAIN}'
    ELSE ['', '', 'specialGroup', 'domain', 'view', 'dataset', 'routine', '', 'unknown'][s_suppkey % 9 + 1] || ':e' || s_suppkey % 70 END AS member,
  ['user', 'group', 'specialGroup', 'domain', 'authorizedView', 'authorizedDataset', 'authorizedRoutine', 'user', 'unknown']
    [s_suppkey % 9 + 1] AS member_type, 'DATASET_ACL' AS source, CAST(NULL AS VARCHAR) AS inherited_from_group
FROM supplier""",
)


def memberships(t: Tables):
    """People of customers, groups nested as a tree, with siblings holding each other."""
    s = F.col("s_suppkey") + 1
    k = F.col("c_custkey")
    people = t.customer.select(
        _cat("g", F.floor(k / 15).cast("long") + 1, DOMAIN).alias("group_email"),
        F.when(k % 9 == 0, _cat("s", k, "@p.iam.gserviceaccount.com")).otherwise(_cat("u", k, DOMAIN)).alias("member_email"),
        F.lit(False).alias("is_group"),
    )
    tree = t.supplier.filter(s > 1).select(
        _cat("g", F.floor(s / 2).cast("long"), DOMAIN).alias("group_email"), _cat("g", s, DOMAIN).alias("member_email"), F.lit(True).alias("is_group")
    )
    siblings = t.supplier.filter(s > 1).select(
        _cat("g", s, DOMAIN).alias("group_email"), _cat("g", s.bitwiseXOR(F.lit(1)), DOMAIN).alias("member_email"), F.lit(True).alias("is_group")
    )
    return people.unionByName(tree).unionByName(siblings)


def closure_sql(body: str, *more: tuple[str, str]) -> str:
    parts = ",\n".join(f"{n} AS ({s})" for n, s in more)
    return f"""WITH RECURSIVE people AS (SELECT c_custkey // 15 + 1 AS g, CASE WHEN c_custkey % 9 = 0
    THEN 's' || c_custkey || '@p.iam.gserviceaccount.com' ELSE 'u' || c_custkey || '{DOMAIN}' END AS member_email FROM customer),
nested AS (SELECT (s_suppkey + 1) // 2 AS g, s_suppkey + 1 AS sub FROM supplier WHERE s_suppkey > 0
  UNION SELECT s_suppkey + 1, xor(s_suppkey + 1, 1) FROM supplier WHERE s_suppkey > 0),
reach AS (SELECT g, sub FROM nested UNION SELECT r.g, n.sub FROM reach r JOIN nested n ON r.sub = n.g),
closure AS (SELECT 'g' || g || '{DOMAIN}' AS group_email, member_email FROM people
  UNION SELECT 'g' || r.g || '{DOMAIN}', member_email FROM reach r JOIN people p ON r.sub = p.g){',' if parts else ''}
{parts}
{body}"""


@query("iam_flatten", with_sql(IAM, body="SELECT * FROM iam"))
def _(t):
    return A.iam_flatten(policies(t))


@query("acl_flatten", with_sql(ACL, body="SELECT * FROM acl"))
def _(t):
    return A.acl_flatten(acl(t))


def scan(t: Tables):
    return A.scan_union(A.iam_flatten(policies(t)), A.acl_flatten(acl(t)))


@query("scan_union", with_sql(IAM, ACL, body="SELECT source, resource_type, member_type, COUNT(*) AS n FROM (SELECT * FROM iam UNION ALL SELECT * FROM acl) GROUP BY ALL"))
def _(t):
    return scan(t).groupBy("source", "resource_type", "member_type").agg(F.count("*").alias("n"))


@query(
    "scan_stats",
    with_sql(
        IAM,
        ACL,
        ("u", "SELECT * FROM iam UNION ALL SELECT * FROM acl"),
        body="""SELECT COUNT(DISTINCT NULLIF(project_id, '')) AS projects, COUNT(DISTINCT (project_id, dataset_id)) AS datasets,
  COUNT(DISTINCT CASE WHEN resource_id <> '' THEN (project_id, dataset_id, resource_id) END) AS resources,
  COUNT(*) AS entries FROM u""",
    ),
)
def _(t):
    return A.scan_stats(scan(t))


@query("group_closure", closure_sql("SELECT * FROM closure"))
def _(t):
    return GR.group_closure(memberships(t))


EXPANDED = f"""SELECT * FROM iam UNION ALL
SELECT project_id, dataset_id, resource_id, resource_type, role,
  CASE WHEN member_email LIKE '%.iam.gserviceaccount.com' THEN 'serviceAccount' ELSE 'user' END || ':' || member_email,
  CASE WHEN member_email LIKE '%.iam.gserviceaccount.com' THEN 'serviceAccount' ELSE 'user' END, source, group_email
FROM iam JOIN closure ON member_type = 'group' AND member = 'group:' || group_email"""


@query(
    "group_expand",
    closure_sql(
        "SELECT role, member_type, inherited_from_group, COUNT(*) AS n, COUNT(DISTINCT member) AS members FROM e GROUP BY ALL",
        IAM,
        ("e", EXPANDED),
    ),
)
def _(t):
    entries = A.iam_flatten(policies(t))
    expanded = A.group_expand(entries, GR.group_closure(memberships(t)))
    return expanded.groupBy("role", "member_type", "inherited_from_group").agg(
        F.count("*").alias("n"), F.count_distinct("member").alias("members")
    )


@query(
    "permission_export",
    with_sql(
        ACL,
        body="""SELECT 'csv' AS kind, member_type, COUNT(*) AS n, 'org1' AS scan_organization FROM acl GROUP BY ALL
UNION ALL SELECT 'json', member_type, COUNT(*), 'org1' FROM acl GROUP BY ALL""",
    ),
)
def _(t):
    entries = A.with_scan(A.acl_flatten(acl(t)), organization="org1")
    out = None
    for kind in ("csv", "json"):
        path = scratch_path(t.spark, f"entries-{kind}")
        A.export(entries, path, kind)
        reader = t.spark.read.schema(entries.schema)
        back = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
        rows = back.groupBy(F.lit(kind).alias("kind"), "member_type", "scan_organization").agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "fn_member_type",
    f"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'user' WHEN 1 THEN 'specialGroup' WHEN 2 THEN 'unknown' ELSE 'domain' END
  AS member_type FROM customer""",
)
def _(t):
    k = F.col("c_custkey")
    member = (
        F.when(k % 4 == 0, _cat("user:a", k, ":x")).when(k % 4 == 1, "allAuthenticatedUsers").when(k % 4 == 2, F.col("c_name"))
    ).otherwise(_cat("domain:", k))
    return t.customer.select("c_custkey", PR.member_type(member).alias("member_type"))


@query(
    "fn_resource_parse",
    """SELECT c_custkey AS k, CASE WHEN c_custkey % 5 IN (1, 2, 3) THEN 'p' || c_nationkey END AS project,
  CASE WHEN c_custkey % 5 IN (2, 3) THEN 'd' || c_custkey % 40 END AS dataset,
  CASE WHEN c_custkey % 5 = 3 THEN 't' || c_custkey END AS table_id,
  CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) END AS folder FROM customer""",
)
def _(t):
    rows = policies(t).select("resource", F.get("bindings", F.lit(0))["members"].alias("m"))
    return rows.select(
        F.regexp_extract(F.get("m", F.lit(0)), "user:u([0-9]+)", 1).cast("long").alias("k"),
        PR.path_part("resource", "projects").alias("project"),
        PR.path_part("resource", "datasets").alias("dataset"),
        PR.path_part("resource", "tables").alias("table_id"),
        PR.path_part("resource", "folders").alias("folder"),
    )


@query(
    "fn_classify_member",
    """SELECT CASE WHEN c_custkey % 9 = 0 THEN 'serviceAccount' ELSE 'user' END AS kind, COUNT(*) AS n FROM customer GROUP BY ALL""",
)
def _(t):
    people = memberships(t).filter("NOT is_group")
    return people.groupBy(PR.classify_email("member_email").alias("kind")).agg(F.count("*").alias("n"))


# --- lineage -----------------------------------------------------------------------------
# Model k feeds the models it is read by: part k is upstream of k div 2 and k div 3, and every
# seventh step leads back, which makes diamonds and cycles.


def edges(t: Tables):
    k = F.col("p_partkey")
    up = t.part.filter(k > 1)

    def step(by):
        return up.select(F.floor(k / by).cast("long").alias("node"), k.alias("upstream"))

    back = up.select(k.alias("node"), F.floor(k / 7).cast("long").alias("upstream"))
    return step(2).unionByName(step(3)).unionByName(back).filter("node > 0 AND upstream > 0").distinct()


def projects(t: Tables):
    k = F.col("p_partkey")
    return t.part.select(k.alias("node"), F.when(k % 3 == 0, "other").otherwise("home").alias("project"))


EDGES = (
    "edges",
    """SELECT p_partkey // 2 AS node, p_partkey AS upstream FROM part WHERE p_partkey > 1
UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 2
UNION SELECT p_partkey, p_partkey // 7 FROM part WHERE p_partkey > 6""",
)
LEVELS = """walk AS (SELECT 1::BIGINT AS node, 0 AS level
  UNION SELECT upstream, level + 1 FROM walk JOIN edges USING (node) WHERE level < 24),
levels AS (SELECT node, MIN(level) AS level FROM walk GROUP BY node)"""


def levels_sql(body: str) -> str:
    return f"WITH RECURSIVE edges AS ({EDGES[1]}), {LEVELS} {body}"


@query("lineage_levels", levels_sql("SELECT * FROM levels"))
def _(t):
    return GR.lineage_levels(edges(t), 1)


STARTS = [1, 2, 3, 10, 11, 500]


@query(
    "lineage_many",
    f"""WITH RECURSIVE edges AS ({EDGES[1]}),
walk AS (SELECT s AS start, s AS node, 0 AS level FROM (SELECT unnest({STARTS})::BIGINT AS s)
  UNION SELECT start, upstream, level + 1 FROM walk JOIN edges USING (node) WHERE level < 24)
SELECT start, level, COUNT(*) AS nodes FROM (SELECT start, node, MIN(level) AS level FROM walk GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    return GR.lineage_of_many(edges(t), STARTS).groupBy("start", "level").agg(F.count("*").alias("nodes"))


@query(
    "lineage_roots",
    levels_sql("SELECT node, level, CASE WHEN node % 10 = 0 THEN 'seed' ELSE 'source' END AS type FROM levels WHERE node % 10 IN (0, 1)"),
)
def _(t):
    k = F.col("p_partkey")
    kind = F.when(k % 10 == 0, "seed").when(k % 10 == 1, "source").otherwise("model")
    nodes = t.part.select(k.alias("id"), kind.alias("type"))
    return GR.lineage_roots(GR.lineage_levels(edges(t), 1), nodes)


@query(
    "lineage_summary",
    levels_sql(
        """SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE node % 3 <> 0) AS home,
  COUNT(*) FILTER (WHERE node % 3 = 0) AS "foreign", MAX(level) + 1 AS levels, CAST(SUM(u) AS BIGINT) AS upstream_links
FROM levels LEFT JOIN (SELECT node, COUNT(*) AS u FROM edges GROUP BY node) USING (node)"""
    ),
)
def _(t):
    e = edges(t)
    return GR.lineage_summary(GR.lineage_levels(e, 1), projects(t), e, "home")


FOREIGN = "CASE WHEN e.upstream % 3 = 0 THEN 1 ELSE 0 END"
LIMITED = f"""WITH RECURSIVE edges AS ({EDGES[1]}),
walk(node, level, away) USING KEY (node) AS (SELECT 1::BIGINT, 0, 0
  UNION SELECT e.upstream, MAX(w.level) + 1, MIN(w.away + {FOREIGN}) FROM walk w JOIN edges e ON w.node = e.node
  WHERE e.upstream NOT IN (SELECT node FROM recurring.walk) AND w.away + {FOREIGN} <= 2 GROUP BY e.upstream)
SELECT node, level, away AS levels_since_foreign FROM walk"""


@query("lineage_foreign_limit", LIMITED)
def _(t):
    return GR.limited_lineage(edges(t), projects(t), 1, "home", 2)


def manifests(t: Tables):
    """Two manifests over the parts; the second repeats some ids and reads models as sources."""
    k = F.col("p_partkey")

    def nodes(number, prefix, kind, name, rows=t.part):
        return rows.select(
            F.lit(number).alias("manifest"), _cat(prefix, k).alias("id"), name.alias("name"), F.lit(kind).alias("type"),
            F.lit("db").alias("database"), F.lit("s").alias("schema"),
        )

    first = nodes(1, "m", "model", _cat("part", k))
    again = nodes(2, "m", "model", _cat("part", k), t.part.filter(k % 4 == 0))
    sources = nodes(2, "src", "source", F.when(k % 2 == 0, _cat("part", k)).otherwise(_cat("raw", k)))
    links1 = t.part.filter(k > 1).select(F.lit(1).alias("manifest"), _cat("m", k).alias("node"), _cat("m", F.floor(k / 2).cast("long")).alias("upstream"))
    links2 = t.part.filter(k % 4 == 0).select(F.lit(2).alias("manifest"), _cat("m", k).alias("node"), _cat("src", k + 1).alias("upstream"))
    links3 = t.part.filter(k % 4 == 0).select(F.lit(2).alias("manifest"), _cat("m", k).alias("node"), _cat("src", F.floor(k / 2).cast("long")).alias("upstream"))
    return first.unionByName(again).unionByName(sources), links1.unionByName(links2).unionByName(links3)


@query(
    "lineage_merge",
    """WITH kept AS (SELECT 'm' || p_partkey AS id FROM part UNION ALL SELECT 'src' || p_partkey FROM part WHERE p_partkey % 2 = 1),
links AS (
  SELECT 'm' || p_partkey AS node, 'm' || p_partkey // 2 AS upstream FROM part WHERE p_partkey > 1 AND p_partkey % 4 <> 0
  UNION SELECT 'm' || p_partkey, 'src' || (p_partkey + 1) FROM part WHERE p_partkey % 4 = 0
  UNION SELECT 'm' || p_partkey, CASE WHEN (p_partkey // 2) % 2 = 0 THEN 'm' ELSE 'src' END || p_partkey // 2 FROM part WHERE p_partkey % 4 = 0)
SELECT id AS node, upstream FROM kept LEFT JOIN links ON id = node""",
)
def _(t):
    nodes, links = GR.merge_manifests(*manifests(t))
    return nodes.select(F.col("id").alias("node")).join(links, "node", "left").select("node", "upstream")


# --- text scoring ------------------------------------------------------------------------

EXTRA = [("SELECT a FROM t WHERE x = 1 ", 2), ("CASE WHEN a THEN b END ", 3), (" JOIN u ON a ", 4), ("ROW_NUMBER() OVER (ORDER BY a) ", 5), ("SUM(a) ", 6), ("PIVOT ", 7)]


def _regex_sql(regex: str) -> str:
    return f"len(regexp_extract_all(body, '{regex}'))"


@query(
    "fn_sql_pattern_score",
    "WITH b AS (SELECT doc_id, text || ' ' || "
    + " || ".join(f"repeat('{s}', CAST(doc_id % {m} AS INTEGER))" for s, m in EXTRA)
    + " AS body FROM documents), s AS (SELECT doc_id, "
    + " + ".join(f"{_regex_sql(r)} * {w}" for _, r, w in PR.SQL_PATTERNS)
    + " AS score FROM b) SELECT doc_id, score, CASE WHEN score <= 10 THEN 'LOW' WHEN score <= 25 THEN 'MEDIUM' ELSE 'HIGH' END AS level FROM s",
)
def _(t):
    body = F.concat("text", F.lit(" "), *[F.repeat(F.lit(s), (F.col("doc_id") % m).cast("int")) for s, m in EXTRA])
    scored = t.documents.select("doc_id", PR.pattern_score(body).alias("score"))
    return scored.withColumn("level", PR.complexity(F.col("score")))
