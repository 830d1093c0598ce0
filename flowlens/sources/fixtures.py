"""Fixture views over the driver tables (FIXTURES.md): flow log, registered APIs, catalog, result sets.

The reference ships no inputs; these views give rows in the schemas the engine reads. The oracle
inlines the same SQL as CTEs in DuckDB. In Spark the three-way fan-out of observation points and of
verbs is written with ``explode`` (same rows, no nested-loop join in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import written_once

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Shared body of the flow view; {fanout} is the dialect-specific three-way fan-out of b.
_FLOWS_HEAD = """
WITH e AS (
  SELECT event_id, ts, event_type, user_id,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, user_id % 12 AS svc
  FROM events),
b AS (
  SELECT *, 8080 + svc % 3 AS server_port, 1 + svc % 4 AS agent_id,
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'signup' THEN 'POST'
         WHEN 'purchase' THEN 'PUT' ELSE 'DELETE' END AS request_type,
    CASE WHEN k % 10 IN (0, 9)
           OR (svc < 8 AND (svc * (k % 10) + svc + k % 10) % 7 < 4)
           OR (svc = 8 AND k % 10 <> 1)
           OR (svc > 9 AND k % 10 < 8)
              THEN CASE k % 4 WHEN 0 THEN '/healthz' WHEN 1 THEN '/' WHEN 2 THEN '/metrics' ELSE '/Robots.TXT' END
         WHEN k % 10 = 1 THEN concat('/orders/', CAST(k AS STRING))
         WHEN k % 10 = 2 THEN concat('/orders/', CAST(k AS STRING), '/items/', CAST(user_id AS STRING))
         WHEN k % 10 = 3 THEN concat('/v1/users/', lpad(CAST(user_id AS STRING), 24, 'a'))
         WHEN k % 10 = 4 THEN concat('/v2.0/catalog/SKU-', lpad(CAST(k AS STRING), 5, '0'))
         WHEN k % 10 = 5 THEN '/reports/daily'
         WHEN k % 10 = 6 THEN concat('/files/', md5(CAST(k AS STRING)))
         WHEN k % 10 = 7 THEN concat('/api/items/', CAST(k AS STRING))
         ELSE concat('/carts/item', lpad(CAST(k AS STRING), 6, '0')) END AS endpoint,
    CASE WHEN svc < 8 THEN concat('svc', CAST(svc AS STRING), '.shop.example.com:8080')
         WHEN svc = 8 THEN 'localhost:8081' WHEN svc = 9 THEN '169.254.169.254' ELSE '' END AS request_domain
  FROM e),
"""

_FLOWS_FANOUT_DUCK = """o AS (
  SELECT b.*, p.point
  FROM b CROSS JOIN (SELECT 's-p' AS point UNION ALL SELECT 's' UNION ALL SELECT 'c-p') p
  WHERE p.point = 's-p' OR (p.point = 's' AND event_id % 4 <> 0) OR (p.point = 'c-p' AND event_id % 3 = 0))
"""

_FLOWS_FANOUT_SPARK = """o AS (
  SELECT b.*, p.point
  FROM b LATERAL VIEW explode(array('s-p', 's', 'c-p')) p AS point
  WHERE p.point = 's-p' OR (p.point = 's' AND event_id % 4 <> 0) OR (p.point = 'c-p' AND event_id % 3 = 0))
"""

_FLOWS_TAIL = """SELECT event_id * 3 + CASE point WHEN 's-p' THEN 0 WHEN 's' THEN 1 ELSE 2 END AS flow_id,
  point AS observation_point, ts AS start_time, request_type, endpoint,
  CASE WHEN endpoint LIKE '/files/%' THEN concat(endpoint, '?v=(', CAST(k AS STRING), ')') ELSE endpoint END AS request_resource,
  request_domain, CASE WHEN k % 50 = 49 THEN 'DNS' ELSE 'HTTP' END AS l7_protocol_str,
  svc % 5 = 0 AS is_tls, '1.1' AS version,
  CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS response_code, 100 * k AS response_duration,
  server_port, agent_id, 6 AS protocol, CASE WHEN k % 25 = 24 THEN 100 ELSE 255 END AS direction_score,
  CASE WHEN point = 's-p' AND svc IN (0, 1) THEN concat('ksvc', CAST(svc AS STRING)) ELSE '' END AS pod_service_1,
  CASE WHEN point = 's-p' AND svc < 3 THEN 'shop' ELSE '' END AS pod_ns_1,
  CASE WHEN point = 's-p' AND svc = 2 THEN 'kwl2' ELSE '' END AS pod_group_1,
  CASE WHEN point = 's-p' AND svc < 4 THEN concat('pod-', CAST(svc AS STRING)) ELSE '' END AS pod_1,
  '' AS pod_cluster_1, '' AS pod_node_1,
  CASE WHEN point = 's-p' AND svc > 3 THEN concat('vm-', CAST(svc AS STRING)) ELSE '' END AS chost_1,
  'server' AS process_kname_1,
  CASE WHEN svc = 10 THEN '127.0.0.1' ELSE concat('10.0.0.', CAST(svc AS STRING)) END AS ip4_1,
  concat('10.1.0.', CAST(user_id % 200 AS STRING)) AS ip4_0,
  event_type = 'signup' AS is_internet_0,
  CASE WHEN point = 'c-p' AND svc % 2 = 0 THEN 'web' ELSE '' END AS pod_service_0,
  CASE WHEN point = 'c-p' AND svc % 2 = 1 THEN 'curl' ELSE '' END AS process_kname_0,
  '' AS pod_0, '' AS pod_ns_0, '' AS pod_cluster_0, '' AS chost_0
FROM o"""

FLOWS_SQL_DUCK = _FLOWS_HEAD + _FLOWS_FANOUT_DUCK + _FLOWS_TAIL
# In Spark the body b is written once, as each filter on a column made of ``k`` would look for the number in ``props`` again.
FLOW_BODY_SQL_SPARK = _FLOWS_HEAD.rstrip().removesuffix(",") + "\nSELECT * FROM b"
FLOWS_SQL_SPARK = "WITH b AS (SELECT * FROM flow_body),\n" + _FLOWS_FANOUT_SPARK + _FLOWS_TAIL

MANAGED_SRC_SQL_DUCK = """
WITH t AS (
  SELECT * FROM (VALUES (0, '/orders/{orderId}'), (1, '/orders/{orderId}/items/{itemId}'), (2, '/v1/users/{uid}'),
    (3, '/v2.0/catalog/{sku}'), (4, '/reports/daily'), (5, '/files/{f}'), (6, '/api/items/{id}')) AS x(tid, target))
SELECT concat('api-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS reg_api_id, n_name AS api_name, '1.0.0' AS api_version,
  concat('/', lower(n_name)) AS context, CASE WHEN n_nationkey % 11 = 10 THEN 'WS' ELSE 'HTTP' END AS api_type,
  'PUBLISHED' AS lifecycle_status,
  concat('http://svc', CAST(n_nationkey % 8 AS STRING), '.shop.example.com:8080',
         CASE WHEN n_nationkey % 5 = 4 THEN '/base/' ELSE '' END) AS endpoint_url,
  concat('2024-01-', lpad(CAST(1 + n_nationkey AS STRING), 2, '0'), 'T10:30:00.000+0530') AS last_updated,
  v.verb, t.target
FROM nation JOIN t ON t.tid = n_nationkey % 7 OR t.tid = (n_nationkey + 2) % 7
CROSS JOIN (SELECT 'get' AS verb UNION ALL SELECT 'POST' UNION ALL SELECT 'OPTIONS') v
"""

# Same rows; the two target ids of a nation and the three verbs are exploded, then an equi join.
MANAGED_SRC_SQL_SPARK = """
WITH t AS (
  SELECT * FROM (VALUES (0, '/orders/{orderId}'), (1, '/orders/{orderId}/items/{itemId}'), (2, '/v1/users/{uid}'),
    (3, '/v2.0/catalog/{sku}'), (4, '/reports/daily'), (5, '/files/{f}'), (6, '/api/items/{id}')) AS x(tid, target)),
n AS (
  SELECT n_nationkey, n_name, tid
  FROM nation LATERAL VIEW explode(array(n_nationkey % 7, (n_nationkey + 2) % 7)) q AS tid)
SELECT concat('api-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS reg_api_id, n_name AS api_name, '1.0.0' AS api_version,
  concat('/', lower(n_name)) AS context, CASE WHEN n_nationkey % 11 = 10 THEN 'WS' ELSE 'HTTP' END AS api_type,
  'PUBLISHED' AS lifecycle_status,
  concat('http://svc', CAST(n_nationkey % 8 AS STRING), '.shop.example.com:8080',
         CASE WHEN n_nationkey % 5 = 4 THEN '/base/' ELSE '' END) AS endpoint_url,
  concat('2024-01-', lpad(CAST(1 + n_nationkey AS STRING), 2, '0'), 'T10:30:00.000+0530') AS last_updated,
  verb, t.target
FROM n JOIN t ON t.tid = n.tid
LATERAL VIEW explode(array('get', 'POST', 'OPTIONS')) v AS verb
"""

CATALOG_SRC_SQL = """
SELECT concat('cat-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS id,
  concat('svc', CAST(n_nationkey % 12 AS STRING), '.shop.example.com') AS name, '2024.01.30' AS version,
  CASE n_nationkey % 4 WHEN 0 THEN '[OWN:host-a] [SHADOW] found' WHEN 1 THEN '[OWN:host-b] [DRIFT] found'
       WHEN 2 THEN 'entered by hand' ELSE ' [OWN:host-a] marker not at start' END AS description
FROM nation
"""

RESULT_SRC_SQL = """
SELECT event_id, concat('{"columns":["request_type","hits"],"values":[["', event_type, '",',
  regexp_extract(props, '([0-9]+)', 1), '],["x"]]}') AS body
FROM events
"""

# Registered APIs that grow with the scale factor: one per row of `part`, with every shape of endpoint config, time
# format, lifecycle state and context that the sync has to read. Same SQL in both engines.
WIDE_SRC_SQL = """
SELECT concat('p-', CAST(p_partkey AS STRING)) AS id, concat('part api ', CAST(p_partkey AS STRING)) AS name, '1.0' AS version,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN concat('ctx', CAST(p_partkey AS STRING))
       ELSE concat('/ctx', CAST(p_partkey AS STRING), '/') END AS context,
  CASE p_partkey % 9 WHEN 8 THEN 'CREATED' ELSE 'PUBLISHED' END AS status,
  CASE p_partkey % 11 WHEN 10 THEN 'WS' ELSE 'HTTP' END AS type,
  CASE p_partkey % 8
    WHEN 0 THEN concat('{"endpoint_type":"http","production_endpoints":{"url":"http://svc', CAST(p_partkey % 12 AS STRING), '.shop.example.com:8080/base/"}}')
    WHEN 1 THEN concat('{"endpoint_type":"address","production_endpoints":{"url":"https://h', CAST(p_partkey AS STRING), '.example.com"}}')
    WHEN 2 THEN concat('{"production_endpoints":[{"url":"http://a', CAST(p_partkey AS STRING), '.example.com/x%20y"},{"url":"http://no"}]}')
    WHEN 3 THEN 'not json'
    WHEN 4 THEN '{"endpoint_type":"http","production_endpoints":{"url":"http://[2001:db8::1]:9443/v1/"}}'
    WHEN 5 THEN '{"endpoint_type":"http","production_endpoints":{"url":"http://h.example.com:bad/"}}'
    WHEN 6 THEN '{"endpoint_type":"http","production_endpoints":{"url":"http://h.example.com/a%zz"}}'
    ELSE '{}' END AS endpoint_config,
  CASE p_partkey % 7
    WHEN 0 THEN '2024-01-05T10:30:00.250+0530' WHEN 1 THEN '2024-01-05T10:30:00.250Z' WHEN 2 THEN '2024-01-05T10:30:00-0200'
    WHEN 3 THEN '2024-01-05T10:30:00.5+01:00' WHEN 4 THEN '2024-01-05T10:30:00+0000' WHEN 5 THEN '2024-01-05 10:30:00'
    ELSE 'yesterday' END AS updated,
  p_partkey % 13 = 5 AS repeats, p_partkey % 20 AS family
FROM part
"""

# Typed cells of result sets: booleans and times in every form, and wrong ones.
TYPED_SRC_SQL = """
SELECT event_id, concat('{"columns":["ok","t"],"values":[[',
  CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE '"yes"' END, ',',
  CASE event_id % 6 WHEN 0 THEN '"2024-01-02 03:04:05"' WHEN 1 THEN CAST(1704067200 + event_id AS STRING)
       WHEN 2 THEN '"2024-01-02T03:04:05Z"' WHEN 3 THEN '"2024-01-02T03:04:05+05:30"' WHEN 4 THEN '"bad"' ELSE 'null' END,
  ']]}') AS body
FROM events
"""

# Catalog whose entries bear the names that drift groups would get, half of them in the version of the push.
CATALOG_EDGE_SQL = """
SELECT concat('edge-', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS id, concat(n_name, '-Drift') AS name,
  CASE n_nationkey % 2 WHEN 0 THEN '2024.01.30' ELSE '2023.12.01' END AS version, 'entered by hand' AS description
FROM nation
"""

# Flows with what the plain log lacks: paths that differ only in what an operation id drops, and blank URLs.
TWIN_SQL = """
SELECT * REPLACE (CASE WHEN (flow_id // 3) % 2 = 1 THEN replace(endpoint, '/carts/', '/carts-') ELSE endpoint END AS endpoint,
  CASE WHEN (flow_id // 3) % 5 = 0 THEN '' WHEN (flow_id // 3) % 2 = 1 THEN replace(request_resource, '/carts/', '/carts-')
       ELSE request_resource END AS request_resource)
FROM flows"""

# Flows with what the plain log lacks: host names wider than their column.
EDGE_DOMAIN_WIDTH = 300

# State slices (FIXTURES.md): earlier half of the event range is the previous state, the rest the batch.
STATE_SPLIT = "2024-01-15 00:00:00"
AS_OF = "2024-01-31 00:00:00"
TRACKED_CATALOG_IDS = ("cat-000", "cat-006")
HOST_UNDER_TEST = "host-a"
OWNER_TAG = "OWN"


def register_tables(spark: SparkSession, sf_dir: str, names=("events", "nation")) -> None:
    """Temp views over the driver's parquet tables (read lazily; pruning reaches the scan)."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(events: DataFrame) -> DataFrame:
        events.createOrReplaceTempView("events")
        return spark.sql(FLOW_BODY_SQL_SPARK)
    written_once(spark, f"{sf_dir}/events.parquet", "flow_body", body).createOrReplaceTempView("flow_body")
    return spark.sql(FLOWS_SQL_SPARK)


def managed_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("nation",))
    return spark.sql(MANAGED_SRC_SQL_SPARK)


def catalog_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("nation",))
    return spark.sql(CATALOG_SRC_SQL)


def wide_details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in input: WIDE_SRC_SQL as one detail document (JSON text) per API, written once."""
    return written_once(spark, f"{sf_dir}/part.parquet", "wide_details", lambda part: _wide_details(spark, part))


def _wide_details(spark: SparkSession, part: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F
    part.createOrReplaceTempView("part")
    src = spark.sql(WIDE_SRC_SQL)
    op = lambda verb, target: F.struct(F.lit(target).alias("target"), F.lit(verb).alias("verb"))
    plain = F.array(op("get", "/orders/{orderId}"), op("POST", "//orders"), op("head", "/orders"), op("", "/x"))
    doc = F.struct("id", "name", "version", "context", F.col("status").alias("lifeCycleStatus"), "type",
                   F.lit("admin").alias("provider"),
                   F.when(F.col("repeats"), F.concat(plain, F.array(op("GET", "/orders/{orderId}")))).otherwise(plain)
                   .alias("operations"), F.col("endpoint_config").alias("endpointConfig"),
                   F.col("updated").alias("lastUpdatedTime"), F.col("updated").alias("createdTime"))
    return src.select(F.to_json(doc).alias("json"))


def edge_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow log with host names on agent 3 that are wider than their column."""
    from pyspark.sql import functions as F
    wide = F.when(F.col("agent_id") == 3, F.lit("d" * EDGE_DOMAIN_WIDTH)).otherwise(F.col("request_domain"))
    return flows(spark, sf_dir).withColumn("request_domain", wide)


def twin_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow log with cart paths of odd events in a twin form, and without URLs in every fifth event."""
    from pyspark.sql import functions as F
    event = F.floor(F.col("flow_id") / 3)
    twin = lambda c: F.when(event % 2 == 1, F.replace(c, F.lit("/carts/"), F.lit("/carts-"))).otherwise(F.col(c))
    return flows(spark, sf_dir).withColumns({"endpoint": twin("endpoint"), "request_resource": F.when(event % 5 == 0, F.lit(""))
                                             .otherwise(twin("request_resource"))})


def catalog_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("nation",))
    return spark.sql(CATALOG_EDGE_SQL)


def typed_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("events",))
    return spark.sql(TYPED_SRC_SQL)


def result_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_tables(spark, sf_dir, ("events",))
    return spark.sql(RESULT_SRC_SQL)
