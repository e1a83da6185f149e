"""Queries of the audit chains and cases and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.operators import audit, cases, listing
from tally.plans.tpch import frame
from tally.storage import written
from tally.streaming.case_status import replay_stream

#: Events as audit entries. The payload is written here as text in the canonical form.
EVENTS = """
SELECT event_id, ts, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, concat('user-', CAST(user_id AS STRING)) AS actor_id,
  CASE event_type WHEN 'signup' THEN 'admin.user.created' WHEN 'view' THEN 'auth.login.success' WHEN 'click' THEN 'data.run.created'
    WHEN 'error' THEN 'auth.login.failure' ELSE 'case.event_appended' END AS kind
FROM events"""

CASE_EVENTS = """
SELECT event_id AS id, ts AS at, concat('case-', CAST(user_id AS STRING)) AS case_id, concat('user-', CAST(event_id % 5 AS STRING)) AS actor_id,
  CASE event_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'approver' ELSE 'admin' END AS role,
  CASE WHEN event_id % 8 = 1 THEN concat('user-', CAST(event_id % 7 AS STRING)) END AS assignee_id,
  CASE event_id % 8 WHEN 0 THEN 'comment' WHEN 1 THEN 'assignment' WHEN 2 THEN 'approval_requested' WHEN 3 THEN 'approved'
    WHEN 4 THEN 'rejected' WHEN 5 THEN 'manual_match_proposed' WHEN 6 THEN 'write_off_proposed' ELSE 'approval_requested' END AS kind
FROM events"""


def entries(spark, sf_dir) -> DataFrame:
    e = frame(spark, sf_dir, EVENTS)
    payload = audit.canonical_payload(F.col("kind"), F.lit(None).cast("string").alias("ip"), F.col("actor_id").alias("user_id"))
    return e.select("tenant_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("at"), "actor_id", "kind", payload.alias("payload"), F.col("event_id").alias("order"))


def chain(spark, sf_dir) -> DataFrame:
    """The chained log as a table: what reads it several times does not chain it again."""
    return written(audit.append(entries(spark, sf_dir)), "chain")


def _entry_hashes(spark, sf_dir):
    e = entries(spark, sf_dir).withColumn("seq", F.col("order") + 1).withColumn("prev_hash", F.lit(audit.GENESIS))
    return e.select("tenant_id", "seq", F.lower(F.hex(audit.entry_hash())).alias("hash"))


def _chain(spark, sf_dir):
    return chain(spark, sf_dir).select("tenant_id", "seq", F.lower(F.hex("hash")).alias("hash"))


def _tampered(spark, sf_dir):
    """One tenant's payload changed at seq 5, one tenant's seq 7 gone, one tenant's link at seq 9 replaced."""
    log = chain(spark, sf_dir)
    hit = lambda t, s: (F.col("tenant_id") == t) & (F.col("seq") == s)
    log = log.where(~hit("tenant-2", 7))
    log = log.withColumn("payload", F.when(hit("tenant-1", 5), "{}").otherwise(F.col("payload")))
    return log.withColumn("prev_hash", F.when(hit("tenant-3", 9), F.lit(audit.GENESIS)).otherwise(F.col("prev_hash")))


ANCHORED_AT = ("2024-02-01T00:00:00.000000Z", "2024-02-02T00:00:00.000000Z")


def _cut(log: DataFrame) -> DataFrame:
    """The log without the last entry of one tenant."""
    top = audit.heads_of(log).select("tenant_id", "head_seq")
    return log.join(top, "tenant_id").where((F.col("tenant_id") != "tenant-1") | (F.col("seq") < F.col("head_seq"))).drop("head_seq")


def _anchored(spark, sf_dir):
    log = chain(spark, sf_dir)
    return audit.check_anchor(_cut(log), audit.anchor(log, None, ANCHORED_AT[0]))


def _whole(spark, sf_dir):
    """Anchored logs of which one has lost its last entry: its chain holds, the anchor does not."""
    log = chain(spark, sf_dir)
    return audit.verify_whole(_cut(log), written(audit.anchor(log, None, ANCHORED_AT[0]), "anchors"))


def _arrivals(spark, sf_dir):
    """Entries as they arrive: of one tenant seq 20 comes once more behind 25, of one 13 comes before 12, of one the first 6 are lost."""
    log = chain(spark, sf_dir).withColumn("arrival", F.col("seq") * 10)
    hit = lambda t, s: (F.col("tenant_id") == t) & (F.col("seq") == s)
    again = log.where(hit("tenant-0", 20)).withColumn("arrival", F.lit(255).cast("bigint"))
    log = log.where(~((F.col("tenant_id") == "tenant-2") & (F.col("seq") <= 6)))
    return audit.verify(log.withColumn("arrival", F.when(hit("tenant-1", 13), F.lit(115)).otherwise(F.col("arrival"))).unionByName(again), arrival="arrival")


def _ranges(spark, sf_dir):
    """A range of each tenant: with the hash that comes before it, with a later edit, with another tenant's hash, with an edit inside and no hash."""
    log = chain(spark, sf_dir)
    bounds = spark.createDataFrame([("tenant-0", 10, 40, "tenant-0"), ("tenant-1", None, 30, None), ("tenant-2", 10, None, "tenant-0"), ("tenant-3", 5, 40, None)], "tenant_id string, from_seq bigint, to_seq bigint, prev_of string")
    before = log.select(F.col("tenant_id").alias("prev_of"), (F.col("seq") + 1).alias("from_seq"), F.col("hash").alias("expected_prev"))
    ranges = bounds.join(before, ["prev_of", "from_seq"], "left")
    edited = log.withColumn("payload", F.when(((F.col("tenant_id") == "tenant-1") & (F.col("seq") == 31)) | ((F.col("tenant_id") == "tenant-3") & (F.col("seq") == 17)), "{}").otherwise(F.col("payload")))
    return audit.verify_ranges(edited, ranges)


def _two_anchors(spark, sf_dir):
    """(anchors, log with the entries of both): the second anchor comes behind the entries of the first."""
    log = chain(spark, sf_dir)
    first, told = (written(x, "anchor") for x in audit.anchor_now(log, None, ANCHORED_AT[0]))
    log = log.unionByName(told)
    second, more = (written(x, "anchor") for x in audit.anchor_now(log, first, ANCHORED_AT[1]))
    return first.unionByName(second), log.unionByName(more)


def _anchors(spark, sf_dir):
    anchors, _ = _two_anchors(spark, sf_dir)
    wrong = audit.verify_anchors(anchors).select("anchor_seq", "reason")
    # Newest first, 200 at most, whatever the caller asks for.
    page = listing.page(anchors, limit=500, most=200, key="anchor_seq")
    return page.join(wrong, "anchor_seq", "left").select("anchor_seq", "at", F.to_json("tenant_heads").alias("heads"), F.lower(F.hex("prev_hash")).alias("prev_hash"), F.lower(F.hex("hash")).alias("hash"), "reason")


def _anchor_entries(spark, sf_dir):
    anchors, log = _two_anchors(spark, sf_dir)
    state = audit.verify_whole(log, anchors).select("tenant_id", "status")
    told = log.where("kind = 'system.anchor.created'").select("tenant_id", "seq", "payload", F.lower(F.hex("hash")).alias("hash"))
    return told.join(state, "tenant_id")


def _page(spark, sf_dir):
    log = frame(spark, sf_dir, EVENTS).withColumn("seq", F.col("event_id"))
    return listing.page(audit.filter_log(log, "tenant-1", ("auth.login.failure", "data.run.created")), before=500, limit=20).select("seq", "kind", "actor_id", "next_cursor")


def _cases(spark, sf_dir):
    return cases.replay(cases.numbered(frame(spark, sf_dir, CASE_EVENTS)))


def _case_append(spark, sf_dir):
    """Events of three stretches of time appended one after another, with the second stretch coming twice and overlapping the third."""
    events = frame(spark, sf_dir, CASE_EVENTS)
    # Both kinds of timestamps can be subtracted and divided in SQL; as text the bounds keep the kind of ``at``.
    ends = events.agg(F.min("at").alias("low"), F.max("at").alias("high"))
    bounds = ends.selectExpr("CAST(low + (high - low) / 3 AS STRING) AS one", "CAST(low + (high - low) / 3 * 2 AS STRING) AS two").first()
    one, two = (F.lit(b).cast(events.schema["at"].dataType) for b in bounds)
    second = (F.col("at") >= one) & (F.col("at") < two)
    log = written(cases.numbered(events.where(F.col("at") < one)), "case-log")
    for part in (second, second, F.col("at") >= one):
        log = written(log.unionByName(cases.append(log, events.where(part))), "case-log")
    return log.select("case_id", "id", "seq", "kind")


def _case_stream(spark, sf_dir):
    """Every event in one of three batches by its id, so that many come early, and one in ten of them once more in the next batch."""
    log = cases.numbered(frame(spark, sf_dir, CASE_EVENTS)).withColumn("turn", F.col("id"))
    again = log.where("id % 10 = 0").withColumn("turn", F.col("id") + 1)
    status = replay_stream(log.unionByName(again), 3, "turn")
    return status.select("case_id", "status", "assignee_id", "requester_id", "applied", "refused", "first_refused", "reason", "last_seq", "waiting")


def _lockouts(spark, sf_dir):
    e = frame(spark, sf_dir, "SELECT user_id, ts AS at, event_id AS id, event_type = 'purchase' AS ok FROM events")
    return cases.failure_runs(e)


QUERIES = {
    "audit_entry_hash": _entry_hashes,
    "audit_chain": _chain,
    "audit_verify": lambda s, d: audit.verify(chain(s, d)),
    "audit_tampered": lambda s, d: audit.verify(_tampered(s, d)),
    "audit_anchor_check": _anchored,
    "audit_whole": _whole,
    "audit_arrivals": _arrivals,
    "audit_ranges": _ranges,
    "audit_anchors": _anchors,
    "audit_anchor_entries": _anchor_entries,
    "audit_page": _page,
    "control_evidence": lambda s, d: audit.control_evidence(frame(s, d, EVENTS)),
    "control_frameworks": lambda s, d: audit.frameworks(frame(s, d, EVENTS)).select("framework", F.array_join("controls", ",").alias("controls"), "events"),
    "case_replay": _cases,
    "case_append": _case_append,
    "case_stream": _case_stream,
    "login_lockout": _lockouts,
}

_ENTRY = f"""SELECT event_id, tenant_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "at", actor_id, kind,
  concat('{{"data":{{"ip":null,"user_id":"', actor_id, '"}},"kind":"', replace(kind, '.', '_'), '"}}') AS payload FROM ({EVENTS}) e"""
_SIZED = lambda c: f"unhex(printf('%08x', strlen({c}))) || encode({c})"
_BYTES = " || ".join(_SIZED(c) for c in ("tenant_id", '"at"', "actor_id", "kind", "payload"))
_ZERO = "unhex(repeat('00', 32))"
_COUNTS = f"SELECT tenant_id, count(*) AS n FROM ({EVENTS}) e GROUP BY tenant_id"

_CHAIN = f"""e AS (SELECT tenant_id, "at", actor_id, kind, payload, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS seq FROM ({_ENTRY}) x),
c AS (
  SELECT tenant_id, CAST(0 AS BIGINT) AS seq, {_ZERO} AS hash FROM e GROUP BY tenant_id
  UNION ALL
  SELECT e.tenant_id, e.seq, unhex(sha256(c.hash || unhex(printf('%016x', e.seq)) || {_BYTES.replace('strlen(tenant_id)', 'strlen(e.tenant_id)').replace('encode(tenant_id)', 'encode(e.tenant_id)')})) FROM c JOIN e ON e.tenant_id = c.tenant_id AND e.seq = c.seq + 1
),
log AS (SELECT e.*, p.hash AS prev_hash, c.hash FROM e JOIN c ON c.tenant_id = e.tenant_id AND c.seq = e.seq JOIN c p ON p.tenant_id = e.tenant_id AND p.seq = e.seq - 1)"""


def _verify_sql(rows: str, expected: str = "NULL", more: str = "") -> str:
    """Every hash of ``rows`` computed anew and every row compared with the one that came before it."""
    return f"""
WITH RECURSIVE {more}{_CHAIN},
r AS (SELECT *, lag(seq) OVER w AS ps, lag(hash) OVER w AS ph, row_number() OVER w AS n, unhex(sha256(prev_hash || unhex(printf('%016x', seq)) || {_BYTES})) AS own
  FROM ({rows}) t WINDOW w AS (PARTITION BY tenant_id ORDER BY arrival)),
f AS (SELECT tenant_id, seq, arrival, CASE WHEN n = 1 AND prev_hash <> CASE WHEN seq = 1 THEN {_ZERO} ELSE {expected} END THEN 'wrong_genesis'
    WHEN seq < ps + 1 THEN 'reordered' WHEN seq > ps + 1 THEN 'missing' WHEN prev_hash <> ph THEN 'wrong_prev' WHEN own <> hash THEN 'tampered' END AS reason FROM r)
SELECT tenant_id, CASE WHEN count(reason) = 0 THEN 'valid' ELSE 'invalid' END AS status, count(*) AS checked,
  arg_min(seq, arrival) FILTER (reason IS NOT NULL) AS bad_seq, arg_min(reason, arrival) FILTER (reason IS NOT NULL) AS reason FROM f GROUP BY tenant_id"""


_CHECK = f"""WITH RECURSIVE {_CHAIN},
cut AS (SELECT * FROM log WHERE tenant_id <> 'tenant-1' OR seq < (SELECT max(seq) FROM log WHERE tenant_id = 'tenant-1')),
heads AS (SELECT tenant_id, max(seq) AS anchored_seq, arg_max(hash, seq) AS hash FROM log GROUP BY tenant_id)
SELECT * FROM (SELECT h.tenant_id, anchored_seq, CASE WHEN c.hash IS NULL THEN 'missing' WHEN c.hash <> h.hash THEN 'tampered' END AS reason
  FROM heads h LEFT JOIN cut c ON c.tenant_id = h.tenant_id AND c.seq = h.anchored_seq) x WHERE reason IS NOT NULL"""


def _anchor_sql(k: int) -> str:
    """The heads, the anchor and the entries of the k-th anchor, behind those of the one before."""
    payload = f"""concat('{{"data":{{"anchor_seq":{k},"tenant_count":', CAST((SELECT count(*) FROM h{k}) AS VARCHAR), '}},"kind":"system_anchor_created"}}')"""
    heads = "SELECT tenant_id, max(seq) AS seq, arg_max(hash, seq) AS hash FROM log GROUP BY tenant_id" if k == 1 else f"SELECT tenant_id, seq, hash FROM t{k - 1}"
    before = _ZERO if k == 1 else f"(SELECT hash FROM a{k - 1})"
    return f"""h{k} AS ({heads}),
j{k} AS (SELECT concat('{{', string_agg(concat('"', tenant_id, '":{{"hash":"', lower(hex(hash)), '","seq":', CAST(seq AS VARCHAR), '}}'), ',' ORDER BY tenant_id), '}}') AS heads FROM h{k}),
a{k} AS (SELECT CAST({k} AS BIGINT) AS anchor_seq, '{ANCHORED_AT[k - 1]}' AS "at", heads, {before} AS prev_hash,
  unhex(sha256({before} || unhex(printf('%016x', {k})) || encode('{ANCHORED_AT[k - 1]}') || encode(heads))) AS hash FROM j{k}),
t{k} AS (SELECT tenant_id, seq, payload, unhex(sha256(prev || unhex(printf('%016x', seq)) || {_BYTES})) AS hash
  FROM (SELECT tenant_id, seq + 1 AS seq, hash AS prev, '{ANCHORED_AT[k - 1]}' AS "at", 'system' AS actor_id, 'system.anchor.created' AS kind, {payload} AS payload FROM h{k}) s)"""


_ANCHORS = f"WITH RECURSIVE {_CHAIN}, {_anchor_sql(1)}, {_anchor_sql(2)}, anchors AS (SELECT * FROM a1 UNION ALL SELECT * FROM a2)"

ORACLES = {
    "audit_entry_hash": f"SELECT tenant_id, event_id + 1 AS seq, sha256({_ZERO} || unhex(printf('%016x', event_id + 1)) || {_BYTES}) AS hash FROM ({_ENTRY}) x",
    "audit_chain": f"""
WITH RECURSIVE e AS (SELECT tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY event_id) AS seq, {_BYTES} AS body FROM ({_ENTRY}) x),
c AS (
  SELECT tenant_id, CAST(0 AS BIGINT) AS seq, repeat('00', 32) AS hash FROM e GROUP BY tenant_id
  UNION ALL
  SELECT e.tenant_id, e.seq, sha256(unhex(c.hash) || unhex(printf('%016x', e.seq)) || e.body) FROM c JOIN e ON e.tenant_id = c.tenant_id AND e.seq = c.seq + 1
)
SELECT tenant_id, seq, hash FROM c WHERE seq > 0""",
    "audit_verify": _verify_sql("SELECT *, seq AS arrival FROM log"),
    "audit_tampered": _verify_sql(f"""SELECT tenant_id, seq, seq AS arrival, "at", actor_id, kind, CASE WHEN tenant_id = 'tenant-1' AND seq = 5 THEN '{{}}' ELSE payload END AS payload,
  CASE WHEN tenant_id = 'tenant-3' AND seq = 9 THEN {_ZERO} ELSE prev_hash END AS prev_hash, hash FROM log WHERE NOT (tenant_id = 'tenant-2' AND seq = 7)"""),
    "audit_arrivals": _verify_sql("""SELECT * EXCLUDE (arrival), CASE WHEN tenant_id = 'tenant-1' AND seq = 13 THEN 115 ELSE arrival END AS arrival
FROM (SELECT *, seq * 10 AS arrival FROM log WHERE NOT (tenant_id = 'tenant-2' AND seq <= 6) UNION ALL SELECT *, 255 FROM log WHERE tenant_id = 'tenant-0' AND seq = 20) s"""),
    "audit_ranges": _verify_sql(
        """SELECT l.* EXCLUDE (payload), l.seq AS arrival, CASE WHEN l.tenant_id = 'tenant-1' AND l.seq = 31 OR l.tenant_id = 'tenant-3' AND l.seq = 17 THEN '{}' ELSE l.payload END AS payload
FROM log l JOIN bounds b ON b.tenant_id = l.tenant_id AND (b.lo IS NULL OR l.seq >= b.lo) AND (b.hi IS NULL OR l.seq <= b.hi)""",
        "(SELECT p.hash FROM log p JOIN bounds b ON p.tenant_id = b.prev_of AND p.seq = b.lo - 1 WHERE b.tenant_id = r.tenant_id)",
        "bounds AS (SELECT * FROM (VALUES ('tenant-0', 10, 40, 'tenant-0'), ('tenant-1', NULL, 30, NULL), ('tenant-2', 10, NULL, 'tenant-0'), ('tenant-3', 5, 40, NULL)) v(tenant_id, lo, hi, prev_of)), ",
    ),
    "audit_whole": f"""SELECT v.tenant_id, CASE WHEN v.status = 'valid' AND a.reason IS NOT NULL THEN 'invalid' ELSE v.status END AS status, checked,
  CASE WHEN v.status = 'valid' THEN anchored_seq ELSE bad_seq END AS bad_seq, CASE WHEN v.status = 'valid' THEN a.reason ELSE v.reason END AS reason
FROM ({_verify_sql("SELECT *, seq AS arrival FROM log WHERE tenant_id <> 'tenant-1' OR seq < (SELECT max(seq) FROM log WHERE tenant_id = 'tenant-1')")}) v LEFT JOIN ({_CHECK}) a ON a.tenant_id = v.tenant_id""",
    "audit_anchor_check": _CHECK,
    "audit_anchors": f"""{_ANCHORS} SELECT anchor_seq, "at", heads, lower(hex(prev_hash)) AS prev_hash, lower(hex(hash)) AS hash, CAST(NULL AS VARCHAR) AS reason FROM anchors""",
    "audit_anchor_entries": f"""{_ANCHORS} SELECT tenant_id, seq, payload, lower(hex(hash)) AS hash, 'valid' AS status FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) t""",
    "audit_page": f"""
WITH p AS (SELECT event_id AS seq, kind, actor_id FROM ({EVENTS}) e WHERE tenant_id = 'tenant-1' AND kind IN ('auth.login.failure', 'data.run.created') AND event_id < 500 ORDER BY event_id DESC LIMIT 21),
k AS (SELECT * FROM p ORDER BY seq DESC LIMIT 20)
SELECT seq, kind, actor_id, CASE WHEN (SELECT count(*) FROM p) > 20 THEN (SELECT min(seq) FROM k) END AS next_cursor FROM k""",
    "control_evidence": "SELECT framework, control, CAST(sum(n) AS BIGINT) AS events FROM (VALUES "
    + ", ".join(f"('{f}', '{c}', '{k}')" for f, c, kinds in audit.CONTROLS for k in kinds)
    + f") v(framework, control, kind) JOIN LATERAL (SELECT count(*) AS n FROM ({EVENTS}) e WHERE e.kind = v.kind) t ON true GROUP BY ALL",
    "case_replay": f"""
WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY "at", id) AS seq FROM ({CASE_EVENTS}) x),
s AS (
  SELECT case_id, CAST(0 AS BIGINT) AS seq, 'open' AS status, CAST(NULL AS VARCHAR) AS assignee_id, CAST(NULL AS VARCHAR) AS requester_id,
    0 AS applied, 0 AS refused, CAST(NULL AS INT) AS first_refused, CAST(NULL AS VARCHAR) AS reason FROM e GROUP BY case_id
  UNION ALL
  SELECT case_id, seq,
    CASE WHEN p IS NOT NULL THEN status WHEN kind = 'assignment' AND status = 'open' THEN 'investigating' WHEN kind = 'rejected' THEN 'investigating'
      WHEN kind = 'approval_requested' THEN 'pending_approval' WHEN kind = 'approved' THEN 'resolved' ELSE status END,
    CASE WHEN kind = 'assignment' AND status = 'open' THEN new_assignee ELSE assignee_id END,
    CASE WHEN p IS NULL AND kind = 'approval_requested' THEN actor_id ELSE requester_id END,
    applied + CASE WHEN p IS NULL THEN 1 ELSE 0 END, refused + CASE WHEN p IS NULL THEN 0 ELSE 1 END,
    coalesce(first_refused, CASE WHEN p IS NOT NULL THEN CAST(seq AS INT) END), coalesce(reason, p)
  FROM (
    SELECT s.case_id, e.seq, s.status, s.assignee_id, s.requester_id, s.applied, s.refused, s.first_refused, s.reason, e.kind, e.actor_id, e.assignee_id AS new_assignee,
      CASE WHEN e.kind = 'approval_requested' AND s.status NOT IN ('open', 'investigating') THEN 'not_requestable'
        WHEN e.kind IN ('approved', 'rejected') AND s.status <> 'pending_approval' THEN 'not_pending'
        WHEN e.kind = 'approved' AND e.role NOT IN ('approver', 'admin') THEN 'role'
        WHEN e.kind = 'approved' AND s.requester_id IS NULL THEN 'no_request'
        WHEN e.kind = 'approved' AND s.requester_id = e.actor_id THEN 'maker' END AS p
    FROM s JOIN e ON e.case_id = s.case_id AND e.seq = s.seq + 1) q
)
SELECT case_id, status, assignee_id, requester_id, applied, refused, first_refused, reason FROM s
QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY seq DESC) = 1""",
    "control_frameworks": "WITH v(framework, control, kind) AS (VALUES "
    + ", ".join(f"('{f}', '{c}', '{k}')" for f, c, kinds in audit.CONTROLS for k in kinds)
    + f"""), c AS (SELECT framework, string_agg(control, ',' ORDER BY control) AS controls FROM (SELECT DISTINCT framework, control FROM v) x GROUP BY framework)
SELECT c.framework, c.controls, CAST(count(e.kind) AS BIGINT) AS events FROM c LEFT JOIN (SELECT DISTINCT framework, kind FROM v) k ON k.framework = c.framework LEFT JOIN ({EVENTS}) e ON e.kind = k.kind GROUP BY ALL""",
    "case_append": f"""SELECT case_id, id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY "at", id) AS INT) AS seq, kind FROM ({CASE_EVENTS}) e""",
    "login_lockout": """
WITH r AS (SELECT user_id, ts AS "at", event_id AS id, event_type = 'purchase' AS ok,
  sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY "at", id) AS failures FROM r WHERE NOT ok)
SELECT user_id, "at", id, CAST(failures AS INT) AS failures, CASE WHEN failures < 5 THEN 0 ELSE CAST(60 * pow(2, least(failures - 5, 10)) AS BIGINT) END AS locked_s FROM f""",
}


def _rate_limit(spark, sf_dir):
    from tally.streaming.jobs import token_bucket_batch

    requests = frame(spark, sf_dir, "SELECT concat('u', CAST(user_id AS STRING)) AS key, ts AS at, event_id AS id FROM events")
    return token_bucket_batch(requests, capacity=3, refill=1 / 36000)


ORACLES["case_stream"] = f"""SELECT r.*, CAST(n AS INT) AS last_seq, 0 AS waiting
FROM ({ORACLES['case_replay']}) r JOIN (SELECT case_id, count(*) AS n FROM ({CASE_EVENTS}) e GROUP BY case_id) c ON c.case_id = r.case_id"""
QUERIES["rate_limit"] = _rate_limit
ORACLES["rate_limit"] = """
WITH RECURSIVE r AS (
  SELECT concat('u', CAST(user_id AS VARCHAR)) AS key, ts, event_id, epoch_us(ts) / 1e6 AS now, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), b AS (
  SELECT key, CAST(0 AS BIGINT) AS i, 3e0 AS tokens, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS TIMESTAMP) AS ts, CAST(NULL AS BIGINT) AS event_id, false AS allowed FROM r GROUP BY key
  UNION ALL
  SELECT key, i, CASE WHEN have >= 1 THEN have - 1 ELSE have END, now, ts, event_id, have >= 1
  FROM (SELECT r.*, CASE WHEN b.last IS NULL THEN b.tokens ELSE least(3e0, b.tokens + greatest(0e0, r.now - b.last) * (1e0 / 36000)) END AS have FROM b JOIN r ON r.key = b.key AND r.i = b.i + 1) q
)
SELECT key, ts AS "at", event_id AS id, allowed FROM b WHERE i > 0"""
