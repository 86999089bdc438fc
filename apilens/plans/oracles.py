"""The registered queries as plain SQL over the test tables, for comparison."""

from __future__ import annotations

_UUID = (
    "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), "
    "substr(h, 21, 12))"
)

# Requests and messages of the capture view.
_R = f"""
r AS (
  SELECT event_id, ts, concat('node-', event_id % 3) AS node,
    CASE event_id % 7 WHEN 0 THEN 'lo' WHEN 1 THEN 'eth0' WHEN 2 THEN 'veth1' WHEN 3 THEN 'cni0'
      ELSE 'wlan0' END AS iface,
    concat('10.244.', user_id % 4, '.', user_id % 250) AS source_ip,
    CAST(1024 + user_id % 60000 AS INTEGER) AS source_port,
    dip AS destination_ip,
    CASE event_id % 8 WHEN 0 THEN 443 WHEN 1 THEN 22 WHEN 2 THEN 8080 WHEN 3 THEN 9000 ELSE 80 END
      AS destination_port,
    CASE user_id % 6 WHEN 0 THEN 'example-api' WHEN 1 THEN 'order-service:80'
      WHEN 2 THEN 'order-service.default.svc.cluster.local'
      WHEN 3 THEN concat('svc-', user_id, '.prod') WHEN 4 THEN dip END AS host_header,
    CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'error' THEN 'DELETE'
      ELSE 'GET' END AS method,
    CASE WHEN event_id % 20 = 0 THEN '/healthz' WHEN event_id % 20 = 1 THEN '/status?full=1'
      WHEN event_type = 'view' THEN concat('/api/v1/users/', user_id)
      WHEN event_type = 'click' THEN concat('/api/v1/users/', user_id, '/orders/', event_id % 100,
        '?k=', event_id % 10)
      WHEN event_type = 'signup' THEN '/api/v1/users'
      WHEN event_type = 'purchase' THEN concat('/api/v2/orders/', {_UUID})
      ELSE concat('/api/v1/products/', user_id % 40) END AS endpoint,
    CASE WHEN event_type IN ('signup', 'purchase') THEN props ELSE '' END AS request_body,
    CASE event_type WHEN 'signup' THEN 201 WHEN 'error' THEN 404 ELSE 200 END AS status_code,
    event_id % 10 <> 9 AS has_response, event_id % 97 = 5 AS lost
  FROM (SELECT *, md5(CAST(user_id AS VARCHAR)) AS h, concat('10.96.0.', 1 + event_id % 4) AS dip
        FROM events))"""

_M = (
    _R
    + """,
m AS (
  SELECT node, event_id, 'request' AS type, event_id * 2 AS position, ts,
    source_ip, source_port, destination_ip, destination_port, method, endpoint,
    coalesce(host_header, destination_ip) AS host, host_header,
    CAST(NULL AS INTEGER) AS status_code, CAST(NULL AS VARCHAR) AS status_text,
    concat('{', CASE WHEN host_header IS NOT NULL THEN concat('"Host":"', host_header, '",') ELSE '' END,
      '"Content-Type":"application/json","Content-Length":"', strlen(request_body), '"}') AS headers,
    request_body AS body
  FROM r WHERE NOT lost
  UNION ALL
  SELECT node, event_id, 'response', event_id * 2 + 1, ts + INTERVAL 5 MILLISECONDS,
    destination_ip, destination_port, source_ip, source_port, NULL, NULL, NULL, NULL,
    status_code,
    CASE status_code WHEN 201 THEN 'CREATED' WHEN 404 THEN 'NOT FOUND' ELSE 'OK' END,
    concat('{"Content-Type":"application/json","Content-Length":"',
      strlen(concat('{"event": ', event_id, ', "note": "é"}')), '"}'),
    concat('{"event": ', event_id, ', "note": "é"}')
  FROM r WHERE has_response)"""
)

_LABEL = "string_split(string_split(host, ':')[1], '.')[1]"
_NUMERIC = (
    "(regexp_full_match({0}, '0+([1-3][0-7]{{10}}|[0-7]{{0,10}})|0[xX]0*[0-9a-fA-F]{{1,8}}') OR "
    "(regexp_full_match({0}, '[1-9][0-9]{{0,9}}') AND TRY_CAST({0} AS BIGINT) <= 4294967295))"
).format(_LABEL)

_DIRECTORY = """,
pods AS (
  SELECT concat('10.96.', s_suppkey // 200, '.', 1 + s_suppkey % 200) AS ip,
    CASE s_suppkey % 4 WHEN 0 THEN concat('gw-', s_suppkey) WHEN 1 THEN concat('node-', s_suppkey)
      END AS label
  FROM supplier),
svcs AS (
  SELECT concat('10.96.', s_suppkey // 200, '.', 1 + s_suppkey % 200) AS ip,
    concat('kube-', s_suppkey) AS name
  FROM supplier WHERE s_suppkey % 4 IN (0, 2)),
directory AS (
  SELECT coalesce(p.ip, s.ip) AS ip, coalesce(p.label, s.name) AS ip_service
  FROM pods p FULL JOIN svcs s ON p.ip = s.ip)"""

# Messages with a service (a), then with the request of every response (c).
_A = (
    _M
    + _DIRECTORY
    + f""",
a AS (
  SELECT m.*, CASE WHEN host IS NULL OR host = '' OR {_NUMERIC}
      THEN coalesce(ip_service, 'unknown') ELSE {_LABEL} END AS service
  FROM m LEFT JOIN directory d ON d.ip = m.destination_ip)"""
)

_C = (
    _A
    + """,
q AS (
  SELECT *, CASE WHEN type = 'request' THEN {'method': method, 'endpoint': endpoint, 'host': host,
      'service': service, 'ts': ts} END AS req,
    concat(node, '|', CASE WHEN type = 'request'
      THEN concat(source_ip, ':', source_port, '-', destination_ip, ':', destination_port)
      ELSE concat(destination_ip, ':', destination_port, '-', source_ip, ':', source_port) END) AS conn
  FROM a),
v AS (
  SELECT *, last_value(req IGNORE NULLS) OVER (PARTITION BY conn ORDER BY ts, type, event_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l
  FROM q),
w AS (
  SELECT * REPLACE (CASE WHEN epoch_us(ts) - epoch_us(l.ts) <= 600000000 THEN l END AS l) FROM v),
c AS (
  SELECT * EXCLUDE (method, endpoint, host, service, headers, body),
    CASE WHEN type = 'request' THEN method ELSE coalesce(l.method, 'UNKNOWN') END AS method,
    CASE WHEN type = 'request' THEN endpoint ELSE coalesce(l.endpoint, '/') END AS endpoint,
    CASE WHEN type = 'request' THEN host ELSE coalesce(l.host, destination_ip) END AS host,
    CASE WHEN type = 'request' THEN service ELSE coalesce(l.service, service) END AS service,
    sha256(concat_ws('|', node, concat(source_ip, ':', source_port, '-', destination_ip, ':',
      destination_port), epoch_us(ts), event_id, 0)) AS id,
    CASE WHEN type = 'request' THEN headers END AS request_headers,
    CASE WHEN type = 'request' THEN body END AS request_body,
    CASE WHEN type = 'response' THEN headers END AS response_headers,
    CASE WHEN type = 'response' THEN body END AS response_body
  FROM w)"""
)

_REQ = _C + ", req AS (SELECT * FROM c WHERE type = 'request')"

_NAMES = "'/health', '/healthz', '/ready', '/readiness', '/live', '/liveness', '/ping', '/status'"
_IS_HEALTH = (
    f"(lower(endpoint) IN ({_NAMES}) OR regexp_matches(endpoint, "
    "'^/(health|healthz|ready|readiness|live|liveness|ping|status)[/?]'))"
)


def _template(path: str) -> str:
    """Path template, segment by segment."""
    return (
        f"array_to_string(list_transform(string_split(string_split({path}, '?')[1], '/'), "
        "lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') OR regexp_full_match(s, "
        "'[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') "
        "THEN '{id}' ELSE s END), '/')"
    )


_MAPPINGS = """,
base AS (
  SELECT CASE c_custkey WHEN 0 THEN 'example-api' WHEN 1 THEN 'order-service'
      ELSE concat('svc-', c_custkey) END AS service,
    concat('app-', c_custkey) AS appId,
    CASE WHEN c_custkey % 7 = 3 THEN '' ELSE concat('inst-', c_custkey) END AS instanceId
  FROM customer WHERE c_custkey % 5 <> 4),
saved AS (
  SELECT CASE s_suppkey WHEN 0 THEN 'order-service' ELSE concat('svc-', s_suppkey * 3) END AS service,
    concat('app-s', s_suppkey) AS appId,
    CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE concat('inst-s', s_suppkey) END AS instanceId
  FROM supplier WHERE s_suppkey % 4 IN (0, 1)),
mappings AS (
  SELECT *, CASE WHEN service IN (SELECT service FROM base) THEN 'replaced' ELSE 'added' END AS origin
  FROM saved
  UNION ALL
  SELECT *, 'base' FROM base WHERE service NOT IN (SELECT service FROM saved)),
usable AS (SELECT service, appId, instanceId FROM mappings WHERE appId <> '' AND instanceId <> '')"""

_LISTING = """,
listing AS (
  SELECT appId, instanceId, gp, ep, lower(me) AS method,
    CASE WHEN starts_with(pa, '/') THEN pa ELSE concat('/', pa) END AS path,
    nullif(CASE WHEN ep = 0 AND gp = 0 AND k % 3 = 1 THEN '' ELSE concat(pre, k) END, '') AS endpoint_id
  FROM (SELECT appId, instanceId, CAST(regexp_extract(appId, '[0-9]+') AS INTEGER) AS k FROM usable)
  CROSS JOIN (VALUES (0, 0, 'GET', '/api/v1/users/{id}', 'e1-'),
    (0, 1, 'get', 'api/v1/users/{uid}/orders/{oid}', 'e2-'), (1, 0, 'POST', '/api/v1/users', 'e3-'),
    (1, 1, 'PUT', '/api/v2/orders/:oid', 'e4-'), (1, 2, 'DELETE', '/api/v1/products/7', 'e5-'),
    (1, 3, 'POST', '/api/v1/users', 'e6-'), (1, 4, '', '/x', 'e7-'),
    (1, 5, 'GET', '/healthz', 'e8-')) v(gp, ep, me, pa, pre)),
templates AS (
  SELECT appId, instanceId, method, path, arg_max(endpoint_id, gp * 100 + ep) AS endpoint_id
  FROM listing WHERE method <> '' GROUP BY ALL)"""

# Mapped requests (mr), matched (mt), decided (ac).
_MAPPED = (
    _REQ
    + _MAPPINGS
    + """,
mr AS (
  SELECT req.*, u.appId, u.instanceId FROM req JOIN usable u ON u.service = req.service
  WHERE req.service <> 'unknown')"""
)
_MATCHED = (
    _MAPPED
    + _LISTING
    + """,
paths AS (
  SELECT DISTINCT appId, instanceId, lower(method) AS lm, string_split(endpoint, '?')[1] AS match_path
  FROM mr),
fits AS (
  SELECT p.*, t.path AS matched_path, t.endpoint_id,
    row_number() OVER (PARTITION BY p.appId, p.instanceId, p.lm, p.match_path ORDER BY
      length(regexp_replace(t.path, '[^{:@]', '', 'g')), t.path) AS rank
  FROM paths p JOIN templates t ON t.appId = p.appId AND t.instanceId = p.instanceId
    AND t.method = p.lm
    AND regexp_full_match(p.match_path,
      regexp_replace(t.path, '\\{[^/]*\\}|:[^/]*|@[^/]*', '[^/]*', 'g'))),
mt AS (
  SELECT mr.*, string_split(mr.endpoint, '?')[1] AS match_path, f.matched_path, f.endpoint_id
  FROM mr LEFT JOIN fits f ON f.rank = 1 AND f.appId = mr.appId AND f.instanceId = mr.instanceId
    AND f.lm = lower(mr.method) AND f.match_path = string_split(mr.endpoint, '?')[1])"""
)
_ACTIONS = (
    _MATCHED
    + f""",
ac AS (
  SELECT *, CASE WHEN matched_path IS NULL THEN 'ADD' WHEN endpoint_id IS NULL THEN 'FAIL'
      WHEN {_template('matched_path')} <> matched_path THEN 'ADD' ELSE 'COMMIT' END AS action,
    CASE WHEN matched_path IS NULL THEN {_template('endpoint')}
      WHEN endpoint_id IS NULL THEN NULL ELSE {_template('matched_path')} END AS template
  FROM mt)"""
)

_USERS = """
users AS (
  SELECT c_custkey AS id, c_name AS name, concat('user', c_custkey, '@example.com') AS email,
    lower(c_mktsegment) AS role, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status
  FROM customer)"""
_ORDERS = """
ord AS (
  SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS total,
    CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'completed' ELSE 'processing' END AS status,
    CASE o_orderkey % 10 WHEN 0 THEN concat('User', o_custkey, '@ex Corp') WHEN 1 THEN ''
      WHEN 2 THEN 'Nobody Else'
      ELSE concat(substr(concat('Customer#', lpad(CAST(o_custkey AS VARCHAR), 9, '0')), 1, 17), ' Ltd')
      END AS customer
  FROM orders)"""


def _with(ctes: str, query: str) -> str:
    return f"WITH {ctes.lstrip(', ')} {query}"


_TS = "epoch_us(ts) AS ts_us"
_ENDS = "source_ip, source_port, destination_ip, destination_port"

_ONBOARD = (
    _REQ
    + _MAPPINGS
    + """,
seen AS (
  SELECT service, count(*) AS requests, arg_min(id, (ts, id)) AS first_id
  FROM req WHERE service <> 'unknown' GROUP BY 1),
unmapped AS (SELECT * FROM seen WHERE service NOT IN (SELECT service FROM usable)),
apps AS (
  SELECT c_custkey AS listing, 0 AS ap, concat('a-', c_custkey) AS application_id,
    concat('svc-', c_custkey) AS application_name,
    CASE WHEN c_custkey % 4 <> 1 THEN concat('i-', c_custkey, '-0') END AS instance_id FROM customer
  UNION ALL
  SELECT c_custkey, 1, concat('b-', c_custkey), concat('svc-', c_custkey // 3 * 3),
    concat('j-', c_custkey) FROM customer
  UNION ALL
  SELECT c_custkey, 2, concat('c-', c_custkey), concat('Svc-', c_custkey), NULL FROM customer),
chosen AS (
  SELECT * FROM apps QUALIFY row_number() OVER (PARTITION BY application_name ORDER BY listing, ap) = 1),
plan AS (
  SELECT u.service, CASE WHEN application_id IS NULL THEN 'CREATE_APP'
      WHEN instance_id IS NULL THEN 'CREATE_INSTANCE' ELSE 'REUSE' END AS action,
    application_id, instance_id
  FROM unmapped u LEFT JOIN chosen ON application_name = service)"""
)

_KEPT = f"endpoint <> '' AND NOT {_IS_HEALTH}"
_PROJECTED = (
    "SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, status_code, status_text, "
    "service, method, endpoint, concat('http://', host, endpoint) AS full_url, type, "
    "coalesce(request_headers, response_headers) AS headers, "
    "nullif(request_body, '') AS request_body, nullif(response_body, '') AS response_body FROM c"
)
_RECORDS = (
    "SELECT id, type, epoch_us(ts) AS ts_us, node, service, method, endpoint, "
    "concat('http://', host, endpoint) AS full_url, host, 'HTTP' AS protocol, status_code, "
    f"status_text, {_ENDS}, request_headers, request_body, response_headers, response_body, "
    "'HTTP/1.1' AS version FROM c"
)
_SUMMARY = (
    "SELECT 'type' AS summary, type AS value, count(*) AS records FROM c GROUP BY 2 UNION ALL "
    "SELECT 'method', upper(method), count(*) FROM c WHERE type = 'request' GROUP BY 2 UNION ALL "
    "SELECT 'status', CAST(status_code AS VARCHAR), count(*) FROM c WHERE type = 'response' GROUP BY 2"
)
_PARSED = (
    f"SELECT node, {_ENDS}, epoch_us(ts) + event_id % 3 AS ts_us, type, method, endpoint, "
    "host, status_code, status_text, headers, body FROM m"
)
_FROM_SEGMENTS = (
    f"SELECT type, epoch_us(ts) + event_id % 3 AS ts_us, node, service, method, endpoint, host, "
    f"status_code, {_ENDS}, request_body, response_body FROM c WHERE "
    "destination_port IN (80, 8080, 8000, 3000, 5000, 8443, 9000) OR "
    "source_port IN (80, 8080, 8000, 3000, 5000, 8443, 9000)"
)
_CATALOG_AFTER = """,
flat AS (
  SELECT appId, instanceId, method, path, endpoint_id FROM (
    SELECT *, row_number() OVER (PARTITION BY appId, instanceId, method, path ORDER BY gp DESC, ep DESC) AS rn
    FROM listing WHERE method <> '' AND endpoint_id IS NOT NULL) WHERE rn = 1),
touched AS (
  SELECT appId, instanceId, lower(method) AS method, template AS path,
    arg_max(nullif(trim(request_body), ''), (ts, id)) FILTER (trim(request_body) <> '') AS body
  FROM ac WHERE action <> 'FAIL' GROUP BY ALL),
after AS (
  SELECT coalesce(f.appId, t.appId) AS appId, coalesce(f.instanceId, t.instanceId) AS instanceId,
    coalesce(f.endpoint_id, to_base64(encode(concat(upper(t.method), ':', t.path)))) AS endpoint_id,
    coalesce(f.method, t.method) AS method, coalesce(f.path, t.path) AS path,
    t.body AS body_example,
    CASE WHEN f.path IS NULL THEN 'added' WHEN t.path IS NULL THEN 'kept' ELSE 'updated' END AS status
  FROM flat f FULL JOIN touched t ON f.appId = t.appId AND f.instanceId = t.instanceId
    AND f.method = t.method AND f.path = t.path)"""

# The catalog stream: three equal stretches of time; saved mappings count from the second one on. Services without a
# usable mapping are planned once; a template that was added is matched from the next stretch on.
_APPS = _ONBOARD[_ONBOARD.index("apps AS (") : _ONBOARD.index("plan AS (")]
_PLAN_OF = (
    "SELECT u.service, CASE WHEN application_id IS NULL THEN 'CREATE_APP' WHEN instance_id IS NULL THEN "
    "'CREATE_INSTANCE' ELSE 'REUSE' END AS action, application_id, instance_id, first_id "
    "FROM {} u LEFT JOIN chosen ON application_name = service"
)
_STREAM_MAPPED = (
    _REQ
    + _MAPPINGS
    + ", "
    + _APPS
    + f"""
span AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // 3 + 1 AS width FROM req),
rb AS (SELECT req.*, (epoch_us(ts) - lo) // width AS batch FROM req, span WHERE service <> 'unknown'),
u0 AS (SELECT service, appId, instanceId FROM base WHERE appId <> '' AND instanceId <> ''),
f0 AS (SELECT service, arg_min(id, (ts, id)) AS first_id FROM rb
  WHERE batch = 0 AND service NOT IN (SELECT service FROM u0) GROUP BY 1),
p0 AS ({_PLAN_OF.format('f0')}),
su AS (SELECT * FROM saved WHERE appId <> '' AND instanceId <> ''),
m1 AS (
  SELECT * FROM su
  UNION ALL SELECT service, application_id, instance_id FROM p0 WHERE action = 'REUSE' AND service NOT IN (SELECT service FROM su)
  UNION ALL SELECT * FROM u0 WHERE service NOT IN (SELECT service FROM su)),
f1 AS (SELECT service, arg_min(id, (ts, id)) AS first_id FROM rb
  WHERE batch > 0 AND service NOT IN (SELECT service FROM m1) AND service NOT IN (SELECT service FROM p0) GROUP BY 1),
p1 AS ({_PLAN_OF.format('f1')}),
used AS (
  SELECT 0 AS late, * FROM u0
  UNION ALL SELECT 0, service, application_id, instance_id FROM p0 WHERE action = 'REUSE'
  UNION ALL SELECT 1, * FROM m1
  UNION ALL SELECT 1, service, application_id, instance_id FROM p1 WHERE action = 'REUSE'),
mr AS (
  SELECT rb.*, u.appId, u.instanceId FROM rb JOIN used u
    ON u.service = rb.service AND u.late = (rb.batch > 0)::INTEGER)"""
)
_STREAM_ACTIONS = (
    _STREAM_MAPPED
    + _ACTIONS[len(_MAPPED) :]
    + """,
born AS (
  SELECT appId, instanceId, lower(method) AS lm, template, min(batch) AS born FROM ac WHERE action = 'ADD' GROUP BY ALL),
later AS (
  SELECT ac.* REPLACE (
    CASE WHEN born < batch THEN 'COMMIT' ELSE action END AS action,
    CASE WHEN born < batch THEN ac.template ELSE matched_path END AS matched_path,
    CASE WHEN born < batch THEN to_base64(encode(concat(upper(method), ':', ac.template))) ELSE endpoint_id END AS endpoint_id)
  FROM ac LEFT JOIN born b ON ac.action = 'ADD' AND ac.matched_path IS NULL AND b.appId = ac.appId
    AND b.instanceId = ac.instanceId AND b.lm = lower(ac.method) AND b.template = ac.template)"""
)

_REQUEST_HEADERS = "request_headers"
_MATCH_DOC = (
    "concat('{\"requests\":[{\"method\":\"', method, '\",\"url\":\"', endpoint, "
    "'\",\"requestHeaders\":', request_headers, CASE WHEN request_body <> '' THEN "
    "concat(',\"requestBody\":\"', replace(request_body, '\"', '\\\"'), '\"') ELSE '' END, '}]}')"
)
_PATH_PAIRS = (
    "CASE matched_path "
    "WHEN '/api/v1/users/{id}' THEN concat('\"id\":\"', string_split(match_path, '/')[5], '\"') "
    "WHEN '/api/v1/users/{uid}/orders/{oid}' THEN concat('\"uid\":\"', string_split(match_path, '/')[5], "
    "'\",\"oid\":\"', string_split(match_path, '/')[7], '\"') "
    "WHEN '/api/v2/orders/:oid' THEN concat('\"oid\":\"', string_split(match_path, '/')[5], '\"') "
    "ELSE '' END"
)
_QUERY_PAIRS = (
    "CASE WHEN contains(endpoint, '?') THEN concat('\"', string_split(string_split(endpoint, '?')[2], '=')[1], "
    "'\":\"', string_split(string_split(endpoint, '?')[2], '=')[2], '\"') ELSE '' END"
)
_COMMIT_DOC = (
    "concat('{\"applyRequestBodies\":true,\"endpoints\":[{\"endpointId\":\"', endpoint_id, "
    f"'\",\"include\":true,\"pathParams\":{{', {_PATH_PAIRS}, '}},\"queryParams\":{{', {_QUERY_PAIRS}, "
    "'},\"headers\":', request_headers, CASE WHEN request_body <> '' THEN "
    "concat(',\"requestBodyExample\":{\"contentType\":\"application/json\",\"content\":\"', "
    "replace(request_body, '\"', '\\\"'), '\"}') ELSE '' END, '}]}')"
)

_WORDS = _USERS + "," + _ORDERS + """,
words AS (SELECT DISTINCT lower(string_split(customer, ' ')[1]) AS word FROM ord WHERE customer <> ''),
hit AS (
  SELECT word, min(id) AS user_id FROM words JOIN users
    ON contains(lower(name), word) OR contains(lower(email), word) GROUP BY 1)"""

_NEW_USERS = _USERS + """,
fresh AS (
  SELECT s_suppkey AS arrival, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name,
    CASE WHEN s_suppkey % 7 <> 0 THEN concat('new', s_suppkey, '@example.com') END AS email,
    CASE WHEN s_suppkey % 2 = 0 THEN 'admin' END AS role, CAST(NULL AS VARCHAR) AS status
  FROM supplier)"""


# Messages as text (x); ``e`` ends a line.
_TEXT = (
    _M
    + """,
x AS (
  SELECT *, concat(head, e, CASE WHEN host_header IS NOT NULL THEN concat('Host: ', host_header, e) ELSE '' END,
      'Content-Type: application/json', e, 'Content-Length: ', strlen(body), e, e, body) AS text
  FROM (SELECT *, concat(chr(13), chr(10)) AS e, CASE WHEN type = 'request'
      THEN concat(method, ' ', endpoint, ' HTTP/1.1')
      ELSE concat('HTTP/1.1 ', status_code, ' ', status_text) END AS head FROM m))"""
)


# Rendered messages cut into segments by bytes, some seen twice.
_PIECES = (
    _TEXT
    + """, t AS (
  SELECT *, hex(encode(text)) AS h, event_id % 3 + 1 AS k FROM x),
s AS (SELECT *, CAST(ceil(octet_length(encode(text)) / k) AS BIGINT) AS size, unnest(range(k)) AS piece FROM t),
d AS (SELECT *, unnest(CASE WHEN event_id % 4 = 0 THEN [0, 3] ELSE [0] END) AS late FROM s)"""
)


def _search(text: str) -> str:
    hits = f""", hits AS (
  SELECT 'user' AS kind, id, name FROM users
  WHERE contains(lower(name), '{text}') OR contains(lower(email), '{text}')
  UNION ALL SELECT 'product', p_partkey, p_name FROM part WHERE contains(lower(p_name), '{text}'))"""
    return _with(
        _USERS + hits, "SELECT kind, id, name, (SELECT count(*) FROM hits) AS total_results FROM hits"
    )


def oracle_sql() -> dict[str, str]:
    inventory = (
        "SELECT service, method, " + _template("endpoint") + " AS template, count(*) AS hits, "
        "count(DISTINCT endpoint) AS raw_paths, epoch_us(min(ts)) AS first_seen_us, "
        f"epoch_us(max(ts)) AS last_seen_us FROM req WHERE {_KEPT} GROUP BY 1, 2, 3"
    )
    params = """
      SELECT appId, instanceId, endpoint_id, kind, name, arg_max(value, (ts, id, value)) AS value,
        count(*) AS times_seen FROM (
        SELECT *, 'query' AS kind, string_split(string_split(endpoint, '?')[2], '=')[1] AS name,
          string_split(string_split(endpoint, '?')[2], '=')[2] AS value
        FROM ac WHERE action = 'COMMIT' AND contains(endpoint, '?')
        UNION ALL
        SELECT *, 'path', p.name, p.value FROM (
          SELECT *, unnest(CASE matched_path
            WHEN '/api/v1/users/{id}' THEN [{'name': 'id', 'value': string_split(match_path, '/')[5]}]
            WHEN '/api/v1/users/{uid}/orders/{oid}' THEN [
              {'name': 'uid', 'value': string_split(match_path, '/')[5]},
              {'name': 'oid', 'value': string_split(match_path, '/')[7]}]
            WHEN '/api/v2/orders/:oid' THEN [{'name': 'oid', 'value': string_split(match_path, '/')[5]}]
            ELSE [] END) AS p FROM ac WHERE action = 'COMMIT')
        UNION ALL
        SELECT *, 'header', h.name, h.value FROM (
          SELECT *, unnest([{'name': 'Host', 'value': host_header},
            {'name': 'Content-Type', 'value': 'application/json'},
            {'name': 'Content-Length', 'value': CAST(strlen(request_body) AS VARCHAR)}]) AS h
          FROM ac WHERE action = 'COMMIT') WHERE h.value IS NOT NULL)
      GROUP BY 1, 2, 3, 4, 5"""
    # The three branches of the union must have the same columns.
    params = (
        params.replace("SELECT *, 'query'", "SELECT appId, instanceId, endpoint_id, ts, id, 'query'")
        .replace("SELECT *, 'path'", "SELECT appId, instanceId, endpoint_id, ts, id, 'path'")
        .replace("SELECT *, 'header'", "SELECT appId, instanceId, endpoint_id, ts, id, 'header'")
    )
    pages = (
        "SELECT page_id, " + _template("path") + " AS template FROM (SELECT page_id, "
        "CASE WHEN starts_with(p, '/') THEN p ELSE concat('/', p) END AS path FROM (SELECT page_id, "
        "regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages))"
    )
    return {
        "endpoint_inventory": _with(_REQ, inventory),
        "path_template_of_requests": _with(
            _R, f"SELECT event_id, endpoint, {_template('endpoint')} AS template FROM r"
        ),
        "page_path_template": pages,
        "endpoint_ids": _with(
            _R,
            "SELECT event_id, to_base64(encode(concat(method, ':', endpoint))) AS endpoint_id, "
            "concat(lower(method), ':', endpoint) AS catalog_key FROM r",
        ),
        "query_params_of_requests": _with(
            _R,
            "SELECT event_id, string_split(string_split(endpoint, '?')[2], '=')[1] AS name, "
            "string_split(string_split(endpoint, '?')[2], '=')[2] AS value FROM r "
            "WHERE contains(endpoint, '?')",
        ),
        "http_port_filter": _with(
            _R,
            "SELECT event_id, source_port, destination_port FROM r WHERE destination_port IN "
            "(80, 8080, 8000, 3000, 5000, 8443, 9000) OR source_port IN "
            "(80, 8080, 8000, 3000, 5000, 8443, 9000)",
        ),
        "packet_port_filter": _with(
            _R,
            "SELECT event_id, source_port, destination_port FROM r WHERE destination_port IN "
            "(80, 443, 8080, 8000, 3000, 5000, 8443, 9000) OR source_port IN "
            "(80, 443, 8080, 8000, 3000, 5000, 8443, 9000)",
        ),
        "raw_socket_port_filter": _with(
            _R,
            "SELECT event_id, source_port, destination_port FROM r WHERE destination_port IN "
            "(80, 8080, 8000, 3000, 5000) OR source_port IN (80, 8080, 8000, 3000, 5000)",
        ),
        "cluster_traffic": _with(
            _M,
            "SELECT position, (starts_with(source_ip, '10.244.') OR starts_with(source_ip, '10.96.') "
            "OR starts_with(destination_ip, '10.244.') OR starts_with(destination_ip, '10.96.')) "
            "AS cluster FROM m",
        ),
        "inter_service": _with(
            _R,
            "SELECT event_id, host_header AS host FROM r WHERE host_header <> destination_ip AND "
            "contains(host_header, '.') AND (contains(host_header, 'svc.cluster.local') OR "
            "length(host_header) - length(replace(host_header, '.', '')) >= 2)",
        ),
        "interface_selection": _with(
            _R
            + """, seen AS (
  SELECT event_id, CASE WHEN event_id % 3 = 2 AND iface <> 'lo' THEN 'wlan0' ELSE iface END AS iface, node
  FROM r),
has AS (SELECT node, bool_or(regexp_full_match(iface, '(veth|docker|br|cni|flannel).*|eth0')) AS p
  FROM seen WHERE iface <> 'lo' GROUP BY 1)""",
            "SELECT event_id, seen.node, iface FROM seen JOIN has ON has.node = seen.node WHERE "
            "iface <> 'lo' AND (NOT p OR regexp_full_match(iface, '(veth|docker|br|cni|flannel).*|eth0'))",
        ),
        "drop_health_checks": _with(
            _R, f"SELECT event_id, method, endpoint FROM r WHERE {_KEPT}"
        ),
        "service_attribution": _with(
            _A, "SELECT position, type, host, destination_ip, service FROM a"
        ),
        "correlate_responses": _with(
            _C,
            f"SELECT position, type, method, endpoint, host, service, status_code FROM c",
        ),
        "http_records": _with(_C, _RECORDS),
        "mapped_requests": _with(
            _MAPPED, "SELECT id, service, appId, instanceId FROM mr"
        ),
        "configured_services": _with(
            _REQ + _MAPPINGS,
            "SELECT DISTINCT service FROM req WHERE service IN (SELECT service FROM usable)",
        ),
        "unmapped_services": _with(_ONBOARD, "SELECT service, requests, first_id FROM unmapped"),
        "service_coverage": _with(
            _REQ + _MAPPINGS,
            "SELECT r.service, r.requests, u.appId IS NOT NULL AS mapped, u.appId AS app_id, "
            "u.instanceId AS instance_id FROM (SELECT service, count(*) AS requests FROM req GROUP BY 1) r "
            "LEFT JOIN usable u ON u.service = r.service",
        ),
        "overlay_mappings": _with(
            _MAPPINGS, "SELECT service, appId, instanceId, origin FROM mappings"
        ),
        "merge_mappings": _with(
            _MAPPINGS,
            "SELECT service, appId, instanceId FROM base UNION ALL SELECT service, appId, instanceId "
            "FROM saved WHERE service NOT IN (SELECT service FROM base)",
        ),
        "mapping_counts": _with(
            _MAPPINGS,
            "SELECT count(*) AS configured, count(*) FILTER (origin = 'added') AS added, "
            "count(*) FILTER (origin = 'replaced') AS replaced, "
            "count(*) FILTER (appId <> '' AND instanceId <> '') AS usable FROM mappings",
        ),
        "summary_by_type": _with(_M, "SELECT type, count(*) AS records FROM m GROUP BY 1"),
        "summary_by_method": _with(
            _M, "SELECT upper(method) AS method, count(*) AS records FROM m WHERE type = 'request' GROUP BY 1"
        ),
        "summary_by_status": _with(
            _M, "SELECT status_code, count(*) AS records FROM m WHERE type = 'response' GROUP BY 1"
        ),
        "summary_onepass": _with(_C, _SUMMARY),
        "unique_endpoints": _with(
            _M, "SELECT DISTINCT endpoint, method FROM m WHERE type = 'request'"
        ),
        "unique_endpoint_count": _with(
            _M, "SELECT count(*) AS unique_endpoints FROM (SELECT DISTINCT endpoint, method FROM m WHERE type = 'request')"
        ),
        "sample_endpoints_before": _with(
            _M,
            "SELECT DISTINCT endpoint, method FROM m WHERE type = 'request' ORDER BY 1, 2 LIMIT 3",
        ),
        "sample_endpoints_after": _with(
            _M,
            f"SELECT DISTINCT endpoint, method FROM m WHERE type = 'request' AND {_KEPT} "
            "ORDER BY 1, 2 LIMIT 5",
        ),
        "extract_projection": _with(_C, f"{_PROJECTED} WHERE {_KEPT}"),
        "extract_metadata": _with(
            _C,
            f"SELECT count(*) FILTER ({_KEPT}) AS total_endpoints, count(*) AS total_in_file, "
            f"count(*) FILTER (NOT ({_KEPT})) AS dropped_health_checks, "
            f"arg_min(node, position) FILTER ({_KEPT}) AS node, true AS filtered_health_checks, "
            "false AS new_only FROM c",
        ),
        "extract_metadata_new": _with(
            _C,
            f"SELECT count(*) FILTER ({_KEPT} AND position > half) AS total_endpoints, count(*) AS total_in_file, "
            f"count(*) FILTER (NOT ({_KEPT})) AS dropped_health_checks, "
            f"arg_min(node, position) FILTER ({_KEPT} AND position > half) AS node, true AS filtered_health_checks, "
            "true AS new_only FROM c, (SELECT max(position) // 2 AS half FROM c)",
        ),
        "incremental_extract": _with(
            _C,
            f"{_PROJECTED} WHERE {_KEPT} AND position > (SELECT max(position) // 2 FROM c)",
        ),
        "incremental_captures": _with(
            _C,
            f"{_PROJECTED} WHERE {_KEPT} AND position > (SELECT max(position) // 2 FROM c)",
        ),
        "unknown_changes": (
            "SELECT DISTINCT o_orderkey AS id, 404 AS status_code FROM orders "
            "WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)"
        ),
        "extract_position": _with(
            _M, "SELECT max(position) AS last_count, count(*) AS records FROM m"
        ),
        "catalog_flatten": _with(
            _MAPPINGS + _LISTING,
            "SELECT appId, instanceId, method, path, endpoint_id, concat(method, ':', path) AS catalog_key "
            "FROM listing WHERE method <> '' AND endpoint_id IS NOT NULL QUALIFY row_number() OVER "
            "(PARTITION BY appId, instanceId, method, path ORDER BY gp DESC, ep DESC) = 1",
        ),
        "catalog_match": _with(
            _MATCHED,
            "SELECT id, appId, instanceId, method, match_path, matched_path, endpoint_id FROM mt",
        ),
        "match_counts": _with(
            _MATCHED,
            "SELECT appId, instanceId, count(*) FILTER (matched_path IS NOT NULL) AS matched_requests, "
            "count(*) FILTER (matched_path IS NULL) AS unmatched_requests FROM mt GROUP BY 1, 2",
        ),
        "catalog_actions": _with(
            _ACTIONS, "SELECT id, action, template, endpoint_id FROM ac"
        ),
        "action_counts": _with(
            _ACTIONS, "SELECT action, count(*) AS requests FROM ac GROUP BY 1"
        ),
        "catalog_upsert": _with(_ACTIONS + _CATALOG_AFTER, "SELECT * FROM after"),
        "catalog_applied": _with(_ACTIONS + _CATALOG_AFTER, "SELECT * FROM after"),
        "endpoint_parameters": _with(_ACTIONS, params),
        "parameters_upsert": _with(_ACTIONS, params),
        "path_params_of_requests": _with(
            _ACTIONS,
            "SELECT id, p.name AS name, p.value AS value FROM (SELECT id, unnest(CASE matched_path "
            "WHEN '/api/v1/users/{id}' THEN [{'name': 'id', 'value': string_split(match_path, '/')[5]}] "
            "WHEN '/api/v1/users/{uid}/orders/{oid}' THEN [{'name': 'uid', 'value': "
            "string_split(match_path, '/')[5]}, {'name': 'oid', 'value': string_split(match_path, '/')[7]}] "
            "WHEN '/api/v2/orders/:oid' THEN [{'name': 'oid', 'value': string_split(match_path, '/')[5]}] "
            "ELSE [] END) AS p FROM ac)",
        ),
        "payload_match": _with(_MAPPED, f"SELECT id, {_MATCH_DOC} AS document FROM mr"),
        "payload_add": _with(
            _ACTIONS,
            "SELECT id, concat('[{\"method\":\"', lower(method), '\",\"endpoint\":\"', template, "
            "'\",\"payload\":\"', replace(request_body, '\"', '\\\"'), '\"}]') AS document "
            "FROM ac WHERE action = 'ADD'",
        ),
        "payload_commit": _with(
            _ACTIONS, f"SELECT id, {_COMMIT_DOC} AS document FROM ac WHERE action = 'COMMIT'"
        ),
        "payload_update": _with(
            _ACTIONS,
            "SELECT id, concat('{\"eventType\":\"UPDATE\",\"eventData\":{', concat_ws(',', "
            "CASE WHEN contains(endpoint, '?') THEN concat('\"queryParams\":[{\"name\":\"', "
            "string_split(string_split(endpoint, '?')[2], '=')[1], '\",\"value\":\"', "
            "string_split(string_split(endpoint, '?')[2], '=')[2], '\"}]') END, "
            "CASE WHEN request_body <> '' THEN concat('\"requestBody\":{\"contentType\":\"JSON\",\"content\":\"', "
            "replace(request_body, '\"', '\\\"'), '\"}') END), '}}') AS document "
            "FROM ac WHERE action = 'COMMIT'",
        ),
        "onboarding_plan": _with(_ONBOARD, "SELECT * FROM plan"),
        "onboarded_mappings": _with(
            _ONBOARD,
            "SELECT service, application_id AS appId, instance_id AS instanceId FROM plan "
            "WHERE action = 'REUSE'",
        ),
        "instance_requests": _with(
            _ONBOARD,
            "SELECT service, concat('{\"instanceRequestItems\":[{\"hostUrl\":\"/\",\"instanceName\":\"', "
            "service, '_instance\"}]}') AS document FROM plan WHERE action <> 'REUSE'",
        ),
        "empty_specs": _with(
            _ONBOARD,
            "SELECT service, concat('{\"openapi\":\"3.0.0\",\"info\":{\"title\":\"', service, "
            "'\",\"version\":\"1.0.0\",\"description\":\"Auto-onboarded service: ', service, "
            "'\"},\"servers\":[{\"url\":\"/\",\"description\":\"Default server\"}],\"paths\":{}}') "
            "AS document FROM plan WHERE action = 'CREATE_APP'",
        ),
        "parse_messages": _with(_M, _PARSED.replace(" + event_id % 3", "")),
        "decode_packets": _with(
            _PIECES,
            "SELECT epoch_us(ts) + piece + late AS ts_us, node, CASE WHEN late = 0 THEN 'eth0' ELSE 'veth1' "
            "END AS iface, source_ip AS src_ip, source_port AS src_port, destination_ip AS dst_ip, "
            "destination_port AS dst_port, (event_id * 100000 + piece * size) % 4294967296 AS seq, "
            "substr(h, 2 * piece * size + 1, 2 * size) AS payload FROM d WHERE event_id % 50 <> 3",
        ),
        "non_empty_segments": _with(
            _PIECES,
            "SELECT epoch_us(ts) + piece + late AS ts_us, node, CASE WHEN late = 0 THEN 'eth0' ELSE 'veth1' "
            "END AS iface, source_ip AS src_ip, event_id * 100000 + piece * size AS seq, "
            "substr(h, 2 * piece * size + 1, 2 * size) AS payload FROM d WHERE event_id % 5 <> 0",
        ),
        "dedup_segments": _with(
            _M,
            "SELECT event_id * 2 + (type = 'response')::INTEGER AS position, count(*) AS segments FROM (SELECT *, "
            "unnest(range(event_id % 3 + 1)) AS piece FROM m) GROUP BY 1",
        ),
        "message_completeness": _with(
            _TEXT,
            "SELECT type, event_id AS seq, CASE WHEN event_id % 5 > 1 OR "
            "(event_id % 5 = 0 AND body <> '') THEN strlen(text) END AS needed, "
            "event_id % 5 > 1 AS complete FROM x",
        ),
        "malformed_messages": _with(
            _M,
            "SELECT type AS was, event_id FROM m WHERE event_id % 11 = 0 OR "
            "(event_id % 11 = 1 AND type = 'response')",
        ),
        "refused_messages": _with(
            _M,
            "SELECT type AS was, event_id, CASE WHEN event_id % 11 = 0 AND type = 'request' THEN 'start line' "
            "WHEN event_id % 11 = 0 THEN 'status code' WHEN event_id % 11 = 2 THEN 'incomplete' "
            "WHEN type = 'request' THEN 'short body' ELSE 'incomplete' END AS reason FROM m "
            "WHERE event_id % 11 IN (0, 2) OR (event_id % 11 = 1 AND ends_with(body, '}'))",
        ),
        "clean_bodies": (
            "SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS characters FROM (SELECT doc_id, regexp_replace(text, "
            "'^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM documents)"
        ),
        "captures_of_nodes": _with(_C, _RECORDS),
        "committed_captures": _with(_C, f"{_PROJECTED} WHERE {_KEPT} AND epoch_us(ts) % 2 = 1"),
        "rejected_bytes": _with(
            _R,
            "SELECT node, source_ip AS src_ip, destination_ip AS dst_ip, "
            "concat('~', event_id, '~') AS bytes FROM r WHERE NOT lost AND event_id % 3 = 0 "
            "UNION ALL SELECT node, '', '', CAST(sum((NOT lost)::INT + has_response::INT) AS VARCHAR) "
            "FROM r GROUP BY node",
        ),
        "body_previews": (
            "SELECT page_id, substr(html, 1, 200) AS preview, length(html) AS characters FROM pages"
        ),
        "service_configs": (
            "SELECT c_custkey % 8 <> 7 AND c_custkey % 3 <> 0 AS has_api_key, "
            "c_custkey % 8 <> 7 AND c_custkey % 2 = 0 AS auto_onboard, count(*) AS documents, "
            "CAST(sum(CASE WHEN c_custkey % 8 <> 7 THEN 2 ELSE 0 END) AS BIGINT) AS mappings "
            "FROM customer GROUP BY 1, 2"
        ),
        "config_mappings": (
            "SELECT concat('svc-', c_custkey) AS service, concat('app-', c_custkey) AS appId, "
            "concat('inst-', c_custkey) AS instanceId FROM customer WHERE c_custkey % 8 <> 7 UNION ALL "
            "SELECT concat('alias-', c_custkey), concat('app-', c_custkey), NULL FROM customer "
            "WHERE c_custkey % 8 <> 7"
        ),
        "mappings_roundtrip": _with(_MAPPINGS, "SELECT service, appId, instanceId FROM mappings"),
        "extract_report": _with(
            _C,
            f"SELECT *, count(*) OVER () AS total_endpoints FROM ({_PROJECTED} WHERE {_KEPT})",
        ),
        "reassemble": _with(_M, _PARSED),
        "messages_from_segments": _with(_C, _FROM_SEGMENTS),
        "long_bodies": (
            "WITH e AS (SELECT event_id, event_id // 10000 AS hour, CAST(8000 + event_id % 2 AS INTEGER) AS src_port, "
            "concat(event_id, ':', props, ';') AS piece, 1704067200000000 + (event_id // 10000) * 7200000000 "
            "+ (event_id % 10000) * 360000 AS us FROM events), "
            "g AS (SELECT hour, src_port, string_agg(piece, '' ORDER BY event_id) AS body, max(us) AS last "
            "FROM e GROUP BY ALL), "
            "d AS (SELECT hour, src_port, 'message' AS kind, last AS ts_us, concat('HTTP/1.1 200 OK', chr(13), chr(10), "
            "'Content-Length: ', octet_length(encode(body)), chr(13), chr(10), chr(13), chr(10), body) AS data FROM g "
            "UNION ALL SELECT hour, src_port, 'message', last + 1000, concat('HTTP/1.1 204 No Content', chr(13), chr(10), "
            "'Content-Length: 0', chr(13), chr(10), chr(13), chr(10)) FROM g "
            "UNION ALL SELECT hour, src_port, 'open', last + 1000, 'HTTP/1.1 20' FROM g) "
            "SELECT concat('10.96.1.', hour) AS src_ip, src_port, kind, ts_us, "
            "CAST(octet_length(encode(data)) AS BIGINT) AS bytes, md5(data) AS digest FROM d"
        ),
        "capture_roundtrip": _with(_C, _RECORDS),
        "log_line_roundtrip": _with(_C, _RECORDS),
        "stream_reassemble": _with(_C, _FROM_SEGMENTS),
        "stream_assemble_batches": _with(_C, _FROM_SEGMENTS),
        "stream_leftovers": (
            "WITH u AS (SELECT user_id, count(*) AS events, sum(event_id)::BIGINT AS total FROM events GROUP BY 1), "
            "d AS (SELECT user_id, user_id % 60 AS second, 'open' AS kind, concat('POST /half HTTP/1.1', chr(13), chr(10), "
            "'Content-Length: 1000', chr(13), chr(10), chr(13), chr(10), events, ';') AS data FROM u "
            "UNION ALL SELECT user_id, 700 + user_id % 60, 'reject', concat('~', total, '~') FROM u WHERE user_id % 3 > 0) "
            "SELECT p.name AS plan, concat('10.244.9.', user_id) AS src_ip, "
            "CASE WHEN user_id % 2 = 0 THEN 4000 END::INTEGER AS src_port, "
            "1704067200000000 + second * 1000000 AS ts_us, kind, data FROM d, (VALUES ('batches'), ('keyed')) AS p(name)"
        ),
        "stream_incremental_extract": _with(_C, f"{_PROJECTED} WHERE {_KEPT}"),
        "stream_catalog": _with(
            _STREAM_ACTIONS + _CATALOG_AFTER,
            "SELECT coalesce(f.appId, t.appId) AS appId, coalesce(f.instanceId, t.instanceId) AS instanceId, "
            "CASE WHEN f.path IS NULL THEN to_base64(encode(concat(upper(t.method), ':', t.path))) "
            "ELSE f.endpoint_id END AS endpoint_id, coalesce(f.method, t.method) AS method, "
            "coalesce(f.path, t.path) AS path, t.body AS body_example FROM templates f FULL JOIN touched t "
            "ON f.appId = t.appId AND f.instanceId = t.instanceId AND f.method = t.method AND f.path = t.path",
        ),
        "stream_parameters": _with(
            _STREAM_ACTIONS,
            params.replace("FROM ac ", "FROM later ").replace(
                "ELSE [] END",
                "WHEN '/api/v1/users/{id}/orders/{id}' THEN [{'name': 'id', 'value': string_split(match_path, '/')[5]}, "
                "{'name': 'id', 'value': string_split(match_path, '/')[7]}] "
                "WHEN '/api/v1/products/{id}' THEN [{'name': 'id', 'value': string_split(match_path, '/')[5]}] "
                "WHEN '/api/v2/orders/{id}' THEN [{'name': 'id', 'value': string_split(match_path, '/')[5]}] ELSE [] END",
            ),
        ),
        "stream_onboarding": _with(_STREAM_MAPPED, "SELECT * FROM p0 UNION ALL SELECT * FROM p1"),
        "first_requests": _with(_REQ, "SELECT DISTINCT service, 'request' AS type FROM req"),
        "list_with_count": _with(
            _USERS, "SELECT *, (SELECT count(*) FROM users) AS count FROM users"
        ),
        "orders_of_users": _with(
            _USERS + "," + _ORDERS + ", ids AS (SELECT DISTINCT user_id * 11 AS user_id FROM events)",
            "SELECT i.user_id, CASE WHEN u.id IS NULL THEN 404 ELSE 200 END AS status_code, "
            "CASE WHEN u.id IS NOT NULL THEN count(o.id) OVER (PARTITION BY i.user_id) END AS count, "
            "o.id AS order_id, o.total, o.status AS order_status FROM ids i "
            "LEFT JOIN users u ON u.id = i.user_id LEFT JOIN ord o ON o.user_id = u.id",
        ),
        "unknown_users": _with(
            _USERS,
            "SELECT DISTINCT user_id * 11 AS user_id FROM events WHERE user_id * 11 NOT IN "
            "(SELECT id FROM users)",
        ),
        "search": _search("ring"),
        "search_users": _search("r11"),
        "sales_report": _with(
            _ORDERS,
            "SELECT CAST(sum(CASE WHEN status = 'completed' THEN CAST(total AS DECIMAL(28, 2)) END) AS DOUBLE) "
            "AS total_sales, count(*) FILTER (status = 'pending') AS pending_orders, "
            "count(*) AS total_orders FROM ord",
        ),
        "order_user_details": _with(
            _WORDS,
            "SELECT o.id AS order_id, o.customer AS customer_name, h.user_id, u.name AS user_name "
            "FROM ord o LEFT JOIN hit h ON o.customer <> '' AND h.word = lower(string_split(o.customer, ' ')[1]) "
            "LEFT JOIN users u ON u.id = h.user_id",
        ),
        "order_product_info": (
            "SELECT CAST(1 AS BIGINT) AS order_id, p_partkey AS id, p_name AS name, "
            "p_retailprice AS price, p_size AS stock FROM part"
        ),
        "insert_rows": _with(
            _NEW_USERS,
            "SELECT * FROM users UNION ALL SELECT (SELECT max(id) FROM users) + "
            "row_number() OVER (ORDER BY arrival), name, email, coalesce(role, 'user'), "
            "coalesce(status, 'active') FROM fresh WHERE name IS NOT NULL AND email IS NOT NULL",
        ),
        "insert_refused": _with(
            _NEW_USERS,
            "SELECT arrival, name, email, role, status FROM fresh WHERE name IS NULL OR email IS NULL",
        ),
        "update_rows": _with(
            _USERS,
            "SELECT id, CASE WHEN id % 10 = 1 THEN concat(name, ' Jr') ELSE name END AS name, email, "
            "CASE WHEN id % 20 = 1 THEN 'member' ELSE role END AS role, status FROM users",
        ),
        "patch_rows": _with(
            _USERS,
            "SELECT id, name, email, role, coalesce(s.status, users.status) AS status FROM users LEFT JOIN "
            "(SELECT o_custkey, concat('after-', max(o_orderkey) FILTER (o_orderkey % 3 > 0)) AS status, "
            "count(*) FILTER (o_orderkey % 3 > 0) AS n FROM orders GROUP BY 1) s ON s.o_custkey = id AND n > 0",
        ),
        "delete_rows": _with(_USERS, "SELECT * FROM users WHERE id % 4 <> 0"),
        "deleted_rows": _with(_USERS, "SELECT * FROM users WHERE id % 4 = 0"),
    }
