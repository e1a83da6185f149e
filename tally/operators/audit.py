"""Tamper-evident audit logs: canonical bytes, hash chains, verification, anchors, control evidence."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tally.schemas import AUDIT
from tally.storage import discard, written

GENESIS = bytes(32)

#: Event kinds as they are stored.
KINDS = (
    "auth.login.success", "auth.login.failure", "auth.lockout", "auth.logout", "auth.password.changed", "auth.password.reset_requested",
    "auth.password.reset_completed", "auth.refresh.reused", "auth.tenant.switched", "admin.user.created", "admin.user.role_changed",
    "admin.user.disabled", "admin.user.enabled", "admin.user.removed", "data.source.created", "data.source.updated", "data.source.archived",
    "data.ingest.completed", "data.run.created", "case.assigned", "case.event_appended", "system.anchor.created",
)
#: Fixed values: (framework, control, kinds that are its evidence).
CONTROLS = (
    ("ISO 27001", "ISO27001:A.9.2.1", ("admin.user.created", "admin.user.disabled", "admin.user.enabled", "admin.user.removed")),
    ("ISO 27001", "ISO27001:A.9.2.3", ("admin.user.role_changed",)),
    ("ISO 27001", "ISO27001:A.9.4.2", ("auth.login.success", "auth.login.failure", "auth.lockout")),
    ("ISO 27001", "ISO27001:A.9.4.3", ("auth.password.changed", "auth.password.reset_requested", "auth.password.reset_completed")),
    ("ISO 27001", "ISO27001:A.12.4.1", ("system.anchor.created", "data.ingest.completed", "data.run.created", "data.source.created")),
    ("SOC 2", "SOC2:CC6.1", ("auth.login.success", "auth.login.failure", "auth.lockout", "auth.tenant.switched", "auth.refresh.reused")),
    ("SOC 2", "SOC2:CC6.2", ("admin.user.created", "admin.user.role_changed")),
    ("SOC 2", "SOC2:CC6.3", ("admin.user.role_changed", "admin.user.disabled", "admin.user.enabled", "admin.user.removed")),
    ("SOC 2", "SOC2:CC7.2", ("auth.refresh.reused", "auth.lockout", "system.anchor.created")),
    ("FCA", "FCA:SYSC9.1", ("data.ingest.completed", "data.run.created", "case.assigned", "case.event_appended")),
    ("FCA", "FCA:SYSC4.1.10", ("case.event_appended",)),
)


def _sized(c: Column) -> Column:
    """A string as its byte length (four bytes, big-endian) and its bytes."""
    raw = F.encode(c, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 8, "0")), raw)


def canonical_payload(kind: Column, *fields: Column) -> Column:
    """``{"data":{...},"kind":...}``; pass the fields in alphabetical order, nulls are kept."""
    return F.to_json(F.struct(F.struct(*fields).alias("data"), F.translate(kind, ".", "_").alias("kind")), {"ignoreNullFields": "false"})


def entry_hash(prev_hash: Column | None = None) -> Column:
    """SHA-256 over the canonical bytes of an entry with the columns of the audit schema."""
    prev = F.col("prev_hash") if prev_hash is None else prev_hash
    seq = F.unhex(F.lpad(F.hex(F.col("seq")), 16, "0"))
    body = F.concat(prev, seq, *[_sized(F.col(c)) for c in ("tenant_id", "at", "actor_id", "kind", "payload")])
    return F.unhex(F.sha2(body, 256))


def _lp(text: str) -> bytes:
    raw = text.encode()
    return len(raw).to_bytes(4, "big") + raw


#: Rows of a tenant, about, that a task chains; a longer log is chained in stretches, one after the other.
STRETCH = 1_000_000


def append(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Chains (tenant_id, at, actor_id, kind, payload, order) behind the tenants' heads.

    A tenant's log of more than STRETCH rows is cut by ``order``, a number, and
    each stretch is written and chained behind the one before: what a task
    reads stays the same at every size. ``order`` must not be one and the same
    for more rows than a task can take.
    """
    numeric = isinstance(events.schema["order"].dataType, NumericType)
    counts = events.groupBy("tenant_id").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    if not numeric or most <= STRETCH:
        return _append(events, heads)
    rounds = -(-most // STRETCH)
    # Rank errors of a hundredth of a stretch; a tenant has a bound for each round.
    cuts = events.groupBy("tenant_id").agg(F.percentile_approx("order", [k / rounds for k in range(1, rounds)], 100 * rounds).alias("cuts"))
    placed = events.join(F.broadcast(cuts) if counts.count() <= 100_000 else cuts, "tenant_id", "left").withColumn("stretch", F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("order"))), F.lit(0)))
    placed = written(placed.drop("cuts"), "audit-stretches", by="stretch")
    log = None
    for k in range(rounds):
        part = written(_append(placed.where(F.col("stretch") == k).drop("stretch"), heads), "audit-stretch")
        new = heads_of(part)
        heads = written(new if heads is None else new.unionByName(heads.join(new.select("tenant_id"), "tenant_id", "left_anti")), "audit-heads")
        log = part if log is None else log.unionByName(part)
    discard(placed)
    return log


def _append(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """One stretch of :func:`append`.

    Each hash needs the one before it, so a tenant has a single writer: rows
    are dealt by tenant, sorted, and folded as they stream by; a task holds
    one head, not the tenant's log.
    """
    spark = events.sparkSession
    heads = heads if heads is not None else spark.createDataFrame([], "tenant_id string, head_seq bigint, head_hash binary")
    rows = events.join(heads, "tenant_id", "left")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, seq, prev = None, 0, GENESIS
        for b in batches:
            out = []
            for t, at, actor, kind, payload, head_seq, head_hash in b[["tenant_id", "at", "actor_id", "kind", "payload", "head_seq", "head_hash"]].itertuples(index=False):
                if t != tenant:
                    tenant = t
                    seq, prev = (0, GENESIS) if head_hash is None else (int(head_seq), bytes(head_hash))
                seq += 1
                own = hashlib.sha256(prev + seq.to_bytes(8, "big") + b"".join(map(_lp, (t, at, actor, kind, payload)))).digest()
                out.append((t, seq, at, actor, kind, payload, prev, own))
                prev = own
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])

    return rows.repartition("tenant_id").sortWithinPartitions("tenant_id", "order").mapInPandas(fold, AUDIT)


def heads_of(log: DataFrame) -> DataFrame:
    return log.groupBy("tenant_id").agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))


#: What a stretch of a log comes to: its ends, its rows, and the first fault among rows whose predecessor it holds.
_STRETCH = "tenant_id string, arrival long, first_seq long, first_prev binary, first_intact boolean, last_seq long, last_hash binary, checked long, bad_arrival long, bad_seq long, reason string"


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (tenant_id, arrival, seq, prev_hash, hash, intact) of a partition as one stretch per tenant."""
    out: list[list] = []
    for b in batches:
        for tenant, arrival, seq, prev, own, intact in b.itertuples(index=False, name=None):
            if not out or out[-1][0] != tenant:
                out.append([tenant, arrival, seq, prev, intact, seq, own, 1, *((None, None, None) if intact else (arrival, seq, "tampered"))])
                continue
            s = out[-1]
            if s[10] is None:
                reason = "reordered" if seq < s[5] + 1 else "missing" if seq > s[5] + 1 else "wrong_prev" if prev != s[6] else None if intact else "tampered"
                if reason:
                    s[8:] = arrival, seq, reason
            s[5:8] = seq, own, s[7] + 1
    yield pd.DataFrame(out, columns=[f.split()[0] for f in _STRETCH.split(", ")], dtype=object)


def verify(log: DataFrame, expected: DataFrame | None = None, arrival: str = "seq") -> DataFrame:
    """(tenant_id, status, checked, bad_seq, reason) per tenant of ``log``, which may be a range of seqs.

    Rows are taken in the order of the column ``arrival``. The first fault
    counts: a seq that is too small ("reordered") or too large ("missing"), a
    predecessor hash that is not the row before's ("wrong_prev"), a hash that
    is not that of its row ("tampered"). The first row must follow the all-zero
    hash if its seq is 1, else the tenant's expected_prev where ``expected``
    (tenant_id, expected_prev) has one ("wrong_genesis"). A log is dealt out
    in ranges of tenant and arrival, each folded to a stretch by itself, and
    the stretches of a tenant are joined at their seams.
    """
    rows = log.select("tenant_id", F.col(arrival).cast("long").alias("arrival"), F.col("seq").cast("long").alias("seq"), "prev_hash", "hash", F.coalesce(entry_hash() == F.col("hash"), F.lit(False)).alias("intact"))
    dealt = rows.repartitionByRange("tenant_id", "arrival").sortWithinPartitions("tenant_id", "arrival", "seq")
    stretches = dealt.mapInPandas(_fold, _STRETCH)
    if expected is None:
        expected = log.sparkSession.createDataFrame([], "tenant_id string, expected_prev binary")
    order = Window.partitionBy("tenant_id").orderBy("arrival")
    s = stretches.join(expected.select("tenant_id", "expected_prev"), "tenant_id", "left")
    s = s.withColumn("seq_before", F.lag("last_seq").over(order)).withColumn("hash_before", F.lag("last_hash").over(order)).withColumn("n", F.row_number().over(order))
    wanted = F.when(F.col("first_seq") == 1, F.lit(GENESIS)).otherwise(F.col("expected_prev"))
    seam = (
        F.when((F.col("n") == 1) & (F.col("first_prev") != wanted), "wrong_genesis")
        .when(F.col("first_seq") < F.col("seq_before") + 1, "reordered")
        .when(F.col("first_seq") > F.col("seq_before") + 1, "missing")
        .when(F.col("first_prev") != F.col("hash_before"), "wrong_prev")
    )
    fault = F.when(seam.isNotNull(), F.struct(F.col("arrival").alias("at"), F.col("first_seq").alias("seq"), seam.alias("reason"))).when(
        F.col("reason").isNotNull(), F.struct(F.col("bad_arrival").alias("at"), F.col("bad_seq").alias("seq"), F.col("reason").alias("reason"))
    )
    out = s.groupBy("tenant_id").agg(F.sum("checked").alias("checked"), F.min_by(fault, F.when(fault.isNotNull(), F.col("arrival"))).alias("first"))
    return out.select("tenant_id", F.when(F.col("first").isNull(), "valid").otherwise("invalid").alias("status"), "checked", F.col("first.seq").alias("bad_seq"), F.col("first.reason").alias("reason"))


def verify_ranges(log: DataFrame, ranges: DataFrame, arrival: str = "seq") -> DataFrame:
    """:func:`verify` of each tenant's rows from from_seq to to_seq; ``ranges`` (tenant_id, from_seq, to_seq,
    expected_prev) has a row for a tenant, whose nulls set no bound. Anchors may lie outside a range and are not looked at."""
    r = ranges.select("tenant_id", "from_seq", "to_seq")
    within = log.join(r, "tenant_id").where((F.col("from_seq").isNull() | (F.col("seq") >= F.col("from_seq"))) & (F.col("to_seq").isNull() | (F.col("seq") <= F.col("to_seq"))))
    return verify(within.drop("from_seq", "to_seq"), ranges.where("expected_prev is not null"), arrival)


def verify_whole(log: DataFrame, anchors: DataFrame | None = None, arrival: str = "seq") -> DataFrame:
    """:func:`verify` of whole logs; where a chain holds in itself, the latest anchor must agree with it too."""
    found = verify(log, arrival=arrival)
    if anchors is None:
        return found
    j = found.join(check_anchor(log, anchors).select("tenant_id", "anchored_seq", F.col("reason").alias("anchor_reason")), "tenant_id", "left")
    broken = (F.col("status") == "valid") & F.col("anchor_reason").isNotNull()
    return j.select("tenant_id", F.when(broken, "invalid").otherwise(F.col("status")).alias("status"), "checked", F.when(broken, F.col("anchored_seq")).otherwise(F.col("bad_seq")).alias("bad_seq"), F.when(broken, F.col("anchor_reason")).otherwise(F.col("reason")).alias("reason"))


def anchor(log: DataFrame, anchors: DataFrame | None, at: str) -> DataFrame:
    """One new anchor row (anchor_seq, at, tenant_heads, prev_hash, hash) over all tenants' heads."""
    spark = log.sparkSession
    last = (0, GENESIS)
    if anchors is not None:
        row = anchors.agg(F.max("anchor_seq").alias("seq"), F.max_by("hash", "anchor_seq").alias("hash")).first()
        last = (row["seq"] or 0, bytes(row["hash"] or GENESIS))
    heads = heads_of(log)
    # One entry per tenant, in the tenants' order.
    entry = F.struct("tenant_id", F.struct(F.lower(F.hex("head_hash")).alias("hash"), F.col("head_seq").alias("seq")).alias("head"))
    one = heads.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tenant_heads"))
    row = one.select(F.lit(last[0] + 1).cast("bigint").alias("anchor_seq"), F.lit(at).alias("at"), "tenant_heads", F.lit(last[1]).alias("prev_hash"))
    return row.withColumn("hash", _anchor_hash())


def anchor_now(log: DataFrame, anchors: DataFrame | None, at: str) -> tuple[DataFrame, DataFrame]:
    """(the new anchor, the entries it adds): each tenant's own chain tells of the anchor in one further entry.

    The anchor holds the heads before these entries. It is one row with an
    entry for each tenant, so it grows with the tenants and not with their logs.
    """
    row = anchor(log, anchors, at)
    # Two numbers, which each tenant's entry repeats.
    anchor_seq, tenants = row.select("anchor_seq", F.size("tenant_heads")).first()
    heads = heads_of(log)
    kind = "system.anchor.created"
    payload = canonical_payload(F.lit(kind), F.lit(anchor_seq).cast("bigint").alias("anchor_seq"), F.lit(tenants).cast("bigint").alias("tenant_count"))
    told = heads.select("tenant_id", F.lit(at).alias("at"), F.lit("system").alias("actor_id"), F.lit(kind).alias("kind"), payload.alias("payload"), F.lit(0).cast("bigint").alias("order"))
    return row, append(told, heads)


def _anchor_hash() -> Column:
    seq = F.unhex(F.lpad(F.hex("anchor_seq"), 16, "0"))
    return F.unhex(F.sha2(F.concat("prev_hash", seq, F.encode("at", "UTF-8"), F.encode(F.to_json("tenant_heads"), "UTF-8")), 256))


def verify_anchors(anchors: DataFrame) -> DataFrame:
    """(anchor_seq, reason) of anchors whose hash or predecessor is wrong."""
    before = anchors.select((F.col("anchor_seq") + 1).alias("anchor_seq"), F.col("hash").alias("hash_before"))
    rows = anchors.join(before, "anchor_seq", "left")
    reason = F.when(F.col("prev_hash") != F.coalesce("hash_before", F.lit(GENESIS)), "wrong_prev").when(_anchor_hash() != F.col("hash"), "tampered")
    return rows.select("anchor_seq", reason.alias("reason")).where("reason is not null")


def check_anchor(log: DataFrame, anchors: DataFrame) -> DataFrame:
    """(tenant_id, anchored_seq, reason): tenants whose log lacks ('missing') or contradicts ('tampered') the latest anchor."""
    latest = anchors.orderBy(F.desc("anchor_seq")).limit(1).select(F.explode("tenant_heads").alias("tenant_id", "head"))
    heads = latest.select("tenant_id", F.col("head.seq").alias("seq"), F.col("head.hash").alias("anchored"))
    j = heads.join(log.select("tenant_id", "seq", F.lower(F.hex("hash")).alias("own")), ["tenant_id", "seq"], "left")
    reason = F.when(F.col("own").isNull(), "missing").when(F.col("own") != F.col("anchored"), "tampered")
    return j.select("tenant_id", F.col("seq").alias("anchored_seq"), reason.alias("reason")).where("reason is not null")


def filter_log(log: DataFrame, tenant_id: str, kinds: tuple[str, ...] = (), actor_id: str | None = None, at_from: str | None = None, at_to: str | None = None) -> DataFrame:
    """Entries of a tenant; no kinds means all of them."""
    out = log.where(F.col("tenant_id") == tenant_id)
    if kinds:
        out = out.where(F.col("kind").isin(*kinds))
    if actor_id is not None:
        out = out.where(F.col("actor_id") == actor_id)
    if at_from is not None:
        out = out.where(F.col("at") >= at_from)
    if at_to is not None:
        out = out.where(F.col("at") <= at_to)
    return out


def controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, c, list(k)) for f, c, k in CONTROLS], "framework string, control string, event_kinds array<string>")


def control_evidence(log: DataFrame) -> DataFrame:
    """(framework, control, events): how many entries of the log are evidence of each control."""
    # Eleven controls: their table is of fixed size.
    kinds = controls(log.sparkSession).select("framework", "control", F.explode("event_kinds").alias("kind"))
    counts = log.groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.join(counts, "kind", "left").groupBy("framework", "control").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))


def frameworks(log: DataFrame) -> DataFrame:
    """(framework, controls, events): each framework's controls in order, and the entries that are evidence of any of them.

    An entry that several controls of a framework take counts once.
    """
    kinds = controls(log.sparkSession).select("framework", "control", F.explode("event_kinds").alias("kind"))
    # Eleven controls: their lists are of fixed size.
    named = kinds.groupBy("framework").agg(F.array_sort(F.collect_set("control")).alias("controls"))
    counts = log.groupBy("kind").agg(F.count("*").alias("n"))
    n = kinds.select("framework", "kind").distinct().join(counts, "kind", "left").groupBy("framework").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
    return named.join(n, "framework")
