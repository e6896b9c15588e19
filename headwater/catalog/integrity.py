"""Key, identity, ingest and enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.catalog.registry import query
from headwater.functions.text import collection_of_run, normalise_runid
from headwater.operators import enrich, identity, ingest, keys, ranking
from headwater.sources import files
from headwater.sources.driver_tables import BATCH


def dup_sql(table: str, key: str, where: str = "TRUE", what: str = "count(*)") -> str:
    return f"(SELECT COALESCE({what}, 0)::BIGINT FROM (SELECT count(*) AS c FROM {table} WHERE {where} GROUP BY {key} HAVING count(*) > 1))"


def union_sql(parts: dict[str, str], label: str = "code") -> str:
    return " UNION ALL ".join(f"SELECT '{code}' AS {label}, {value} AS count" for code, value in parts.items())


@query(
    "SELECT 'subcatchments' AS name, " + dup_sql("subcatchments", "watershed_id, topazid") + " AS groups, "
    + dup_sql("subcatchments", "watershed_id, topazid", what="sum(c)") + " AS rows UNION ALL SELECT 'channels', "
    + dup_sql("channels", "logical_id, topazid", "logical_id IS NOT NULL") + ", "
    + dup_sql("channels", "logical_id, topazid", "logical_id IS NOT NULL", "sum(c)"),
    "subcatchments channels",
)
def dup_keys(t):
    one = keys.duplicate_summary(t.subcatchments, ["watershed_id", "topazid"]).withColumn("name", F.lit("subcatchments"))
    two = keys.duplicate_summary(t.channels, ["logical_id", "topazid"], True).withColumn("name", F.lit("channels"))
    return one.unionByName(two).select("name", "groups", "rows")


@query(
    """, k AS (SELECT watershed_id, CASE WHEN logical_id IS NULL AND topazid = 1 THEN ' ' ELSE logical_id END AS k FROM channels
  UNION ALL SELECT watershed_id, CASE WHEN topazid > 6 THEN logical_id ELSE logical_id || '-' || weppid END FROM subcatchments),
c AS (SELECT watershed_id, k, count(*) AS n FROM k GROUP BY watershed_id, k)
SELECT watershed_id, COALESCE(sum(n) FILTER (WHERE k IS NULL), 0)::BIGINT AS null_rows,
  COALESCE(sum(n) FILTER (WHERE trim(k) = ''), 0)::BIGINT AS blank_rows,
  COALESCE(sum(n) FILTER (WHERE k IS NOT NULL AND n > 1), 0)::BIGINT AS duplicate_rows,
  COALESCE(sum(n - 1) FILTER (WHERE k IS NOT NULL AND n > 1), 0)::BIGINT AS extra_rows FROM c GROUP BY watershed_id""",
    "channels subcatchments",
)
def dup_rows(t):
    one = t.channels.select(
        "watershed_id", F.when(F.col("logical_id").isNull() & (F.col("topazid") == 1), " ").otherwise(F.col("logical_id")).alias("k")
    )
    two = t.subcatchments.select(
        "watershed_id",
        F.when(F.col("topazid") > 6, F.col("logical_id")).when(
            F.col("logical_id").isNotNull(), F.concat_ws("-", "logical_id", "weppid")
        ).alias("k"),
    )
    return keys.join_key_check(one.unionByName(two), "k", ["watershed_id"])


@query(
    """SELECT (SELECT count(*) FROM subcatchments s WHERE NOT EXISTS (SELECT 1 FROM watersheds w WHERE w.runid = s.watershed_id AND w.balance > 0))
  AS orphan_rows""",
    "subcatchments watersheds",
)
def orphans(t):
    return keys.orphan_rows(t.subcatchments, "watershed_id", t.watersheds.where("balance > 0"), "runid")


@query(
    """, k AS (SELECT * FROM aliases), cur AS (SELECT identity_id, min(runid) AS r FROM aliases WHERE is_current GROUP BY identity_id)
SELECT w.runid, COALESCE(c.r, w.runid) AS current_runid FROM watersheds w LEFT JOIN cur c ON c.identity_id = w.logical_id""",
    "watersheds aliases",
)
def current_alias(t):
    return identity.with_current_runid(t.watersheds, t.aliases).select("runid", "current_runid")


@query(
    f""", asked AS (SELECT runid, count(*) AS requests FROM (
    SELECT CASE WHEN l_linenumber < 4 THEN 'run-' || l_orderkey WHEN l_linenumber = 4 THEN 'x-' || l_orderkey
      ELSE '{BATCH}' || l_partkey END AS runid FROM lineitem) GROUP BY runid),
cur AS (SELECT logical_id AS identity_id, min(runid) AS r FROM watersheds WHERE logical_id IS NOT NULL GROUP BY logical_id)
SELECT a.runid, a.requests,
  CASE WHEN i.identity_id IS NOT NULL THEN CASE WHEN i.status <> 'retired' THEN c.r END
       WHEN al.identity_id IS NULL THEN w.runid END AS watershed,
  CASE WHEN i.status = 'retired' THEN 'gone' WHEN (CASE WHEN i.identity_id IS NOT NULL THEN c.r WHEN al.identity_id IS NULL THEN w.runid END) IS NOT NULL
    THEN 'found' ELSE 'not found' END AS status
FROM asked a LEFT JOIN aliases al ON al.runid = a.runid LEFT JOIN identities i ON i.identity_id = al.identity_id
LEFT JOIN cur c ON c.identity_id = al.identity_id LEFT JOIN watersheds w ON w.runid = a.runid""",
    "aliases identities watersheds",
)
def resolve_runs(t):
    line = F.col("l_linenumber")
    requests = t.lineitem.select(
        F.when(line < 4, F.concat(F.lit("run-"), F.col("l_orderkey").cast("string")))
        .when(line == 4, F.concat(F.lit("x-"), F.col("l_orderkey").cast("string")))
        .otherwise(F.concat(F.lit(BATCH), F.col("l_partkey").cast("string"))).alias("runid")
    )
    return identity.resolve_runs(requests, t.aliases, t.identities, t.watersheds)


AUDIT_MISMATCH = "(SELECT count(*) FROM {c} c LEFT JOIN watersheds w ON w.runid = c.watershed_id WHERE NOT COALESCE(c.logical_id = w.logical_id, FALSE))"
MOVE_MISMATCH = (
    "(SELECT count(*) FROM {c} c JOIN watersheds w ON w.runid = c.watershed_id "
    "WHERE c.logical_id IS NOT NULL AND c.logical_id IS DISTINCT FROM w.logical_id)"
)


@query(
    union_sql({
        "subcatchments_audit": AUDIT_MISMATCH.format(c="subcatchments"), "subcatchments_migration": MOVE_MISMATCH.format(c="subcatchments"),
        "channels_audit": AUDIT_MISMATCH.format(c="channels"), "channels_migration": MOVE_MISMATCH.format(c="channels"),
    }),
    "subcatchments channels watersheds",
)
def identity_mismatch(t):
    parts = {}
    for name, df in (("subcatchments", t.subcatchments), ("channels", t.channels)):
        for form, audit in (("audit", True), ("migration", False)):
            parts[f"{name}_{form}"] = keys.identity_mismatches(df, "watershed_id", t.watersheds, "runid", "logical_id", audit)
    return keys.one_row_each(parts, "mismatched_rows")


@query(
    """, a AS (SELECT DISTINCT lower(c_mktsegment) AS segment, CASE WHEN year(o_orderdate) < 1999 THEN o_custkey ELSE -o_custkey END AS k FROM orders JOIN customer ON c_custkey = o_custkey),
b AS (SELECT DISTINCT lower(c_mktsegment) AS segment, c_custkey AS k FROM customer),
m AS (SELECT COALESCE(a.segment, b.segment) AS segment, a.k AS ak, b.k AS bk FROM a FULL JOIN b ON a.segment = b.segment AND a.k = b.k)
SELECT segment, count(*) FILTER (WHERE bk IS NULL) AS left_only, count(*) FILTER (WHERE ak IS NULL) AS right_only,
  count(*) FILTER (WHERE ak IS NOT NULL AND bk IS NOT NULL) AS common,
  count(*) FILTER (WHERE bk IS NULL OR ak IS NULL) = 0 AS equal FROM m GROUP BY segment""",
    "watersheds",
)
def membership_equality(t):
    """Customers with orders against all customers; an order of 1999 or later names one that does not exist."""
    members = t.customer.select(F.lower("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    seen = t.orders.select(F.col("o_custkey").alias("k"), (F.year("o_orderdate") < 1999).alias("_known")).distinct()
    named = seen.join(members, "k").select("segment", F.when(F.col("_known"), F.col("k")).otherwise(-F.col("k")).alias("k"))
    return keys.compare_membership(named, members, ["k"], ["segment"])


@query(
    """, d AS (SELECT DISTINCT l_linestatus AS scenario, CASE WHEN l_quantity > 25 THEN l_suppkey ELSE -l_suppkey END AS variable FROM lineitem),
o AS (SELECT DISTINCT l_linestatus AS scenario, CASE WHEN l_returnflag <> 'N' AND l_linenumber < 6 THEN l_suppkey ELSE l_suppkey + 1000000 END AS variable FROM lineitem),
m AS (SELECT COALESCE(d.scenario, o.scenario) AS scenario, d.variable AS dv, o.variable AS ov FROM d FULL JOIN o ON d.scenario = o.scenario AND d.variable = o.variable)
SELECT scenario, count(*) FILTER (WHERE ov IS NULL) AS left_only, count(*) FILTER (WHERE dv IS NULL) AS right_only,
  count(*) FILTER (WHERE ov IS NOT NULL AND dv IS NOT NULL) AS common, count(*) FILTER (WHERE ov IS NULL OR dv IS NULL) = 0 AS equal
FROM m GROUP BY scenario""",
    "watersheds",
)
def coverage_pairs(t):
    """Every line declares and observes a variable; some of either name one that the other side has not."""
    side = lambda known, other: t.lineitem.select(
        F.col("l_linestatus").alias("scenario"), F.when(F.expr(known), F.col("l_suppkey")).otherwise(F.expr(other)).alias("variable")
    )
    declared, observed = side("l_quantity > 25", "-l_suppkey"), side("l_returnflag <> 'N' AND l_linenumber < 6", "l_suppkey + 1000000")
    return keys.compare_membership(declared, observed, ["variable"], ["scenario"])


@query(
    union_sql({
        "subcatchment_run_key": dup_sql("subcatchments", "watershed_id, topazid"),
        "subcatchment_logical_key": dup_sql("subcatchments", "logical_id, topazid", "logical_id IS NOT NULL"),
        "channel_run_key": dup_sql("channels", 'watershed_id, topazid, weppid, "order"'),
        "channel_logical_key": dup_sql("channels", 'logical_id, topazid, weppid, "order"', "logical_id IS NOT NULL"),
        "subcatchment_logical_mismatch": MOVE_MISMATCH.format(c="subcatchments"),
        "channel_logical_mismatch": MOVE_MISMATCH.format(c="channels"),
        "collection_key_format": "(SELECT count(*) FROM collections WHERE NOT regexp_full_match(key, '[a-z0-9]+(-[a-z0-9]+)*'))",
        "watershed_key_format": "(SELECT count(*) FROM identities WHERE NOT regexp_full_match(watershed_key, '[a-z0-9]+(-[a-z0-9]+)*'))",
        "watershed_identity_status": "(SELECT count(*) FROM identities WHERE status NOT IN ('active', 'retired'))",
    }),
    "subcatchments channels watersheds collections identities",
)
def integrity_preflight(t):
    return keys.integrity_preflight(t.watersheds, t.subcatchments, t.channels, t.collections, t.identities)


STATES = """, st AS (SELECT i.identity_id, i.status,
    (SELECT count(DISTINCT runid) FROM aliases a WHERE a.identity_id = i.identity_id AND is_current) AS al,
    (SELECT count(DISTINCT runid) FROM watersheds w WHERE w.logical_id = i.identity_id) AS ws FROM identities i),
r AS ("""


@query(
    STATES + " UNION ALL ".join(
        f"SELECT 'violation' AS section, '{c}' AS code, {v} AS count" for c, v in {
            "watersheds_without_logical_identity": "(SELECT count(*) FROM watersheds WHERE logical_id IS NULL)",
            "subcatchments_without_logical_identity": "(SELECT count(*) FROM subcatchments WHERE logical_id IS NULL)",
            "channels_without_logical_identity": "(SELECT count(*) FROM channels WHERE logical_id IS NULL)",
            "subcatchment_identity_mismatches": AUDIT_MISMATCH.format(c="subcatchments"),
            "channel_identity_mismatches": AUDIT_MISMATCH.format(c="channels"),
            "active_identities_without_one_watershed": "(SELECT count(*) FROM st WHERE status = 'active' AND ws <> 1)",
            "active_identities_without_one_current_alias": "(SELECT count(*) FROM st WHERE status = 'active' AND al <> 1)",
            "retired_identities_with_current_alias": "(SELECT count(*) FROM st WHERE status = 'retired' AND al <> 0)",
        }.items()
    ) + " UNION ALL " + " UNION ALL ".join(
        f"SELECT 'total', '{c}', (SELECT count({e}) FROM {s})" for c, e, s in (
            ("watersheds", "*", "watersheds"), ("identities", "*", "identities"),
            ("assigned_watershed_keys", "watershed_key", "identities"), ("run_aliases", "*", "aliases"),
            ("subcatchments", "*", "subcatchments"), ("channels", "*", "channels"),
        )
    ) + """) SELECT section, code, count, CASE WHEN section = 'total' THEN 'info' WHEN count = 0 THEN 'passed' ELSE 'failed' END AS status FROM r""",
    "subcatchments channels watersheds identities aliases",
)
def identity_report(t):
    return identity.identity_report(t.watersheds, t.subcatchments, t.channels, t.identities, t.aliases)


def audit_sql(name: str, key: str, logical: str | None, child: bool) -> list[str]:
    rows = {
        "row_count": f"(SELECT count(*) FROM {name})",
        "duplicate_business_key_groups": dup_sql(name, key),
        "duplicate_business_key_rows": dup_sql(name, key, what="sum(c)"),
    }
    if logical:
        rows["duplicate_logical_key_groups"] = dup_sql(name, logical, f"{logical.split(',')[0]} IS NOT NULL")
    if child:
        rows["orphan_rows"] = f"(SELECT count(*) FROM {name} WHERE watershed_id NOT IN (SELECT runid FROM watersheds))"
    return [f"SELECT '{name}' AS \"table\", '{c}' AS code, {v} AS count" for c, v in rows.items()]


@query(
    ", r AS (" + " UNION ALL ".join(
        audit_sql("watersheds", "runid", "logical_id", False)
        + audit_sql("subcatchments", "watershed_id, topazid", "logical_id, topazid", True)
        + audit_sql("channels", 'watershed_id, topazid, weppid, "order"', 'logical_id, topazid, weppid, "order"', True)
    ) + """) SELECT "table", code, count, CASE WHEN code IN ('duplicate_business_key_groups', 'duplicate_logical_key_groups', 'orphan_rows') AND count > 0
  THEN 'violation' WHEN code = 'row_count' AND count = 0 THEN 'warning' ELSE 'ok' END AS finding FROM r""",
    "watersheds subcatchments channels",
)
def audit_report(t):
    return identity.audit_report({
        "watersheds": (t.watersheds, ["runid"], ["logical_id"]),
        "subcatchments": (t.subcatchments, ["watershed_id", "topazid"], ["logical_id", "topazid"]),
        "channels": (t.channels, ["watershed_id", "topazid", "weppid", "order"], ["logical_id", "topazid", "weppid", "order"]),
    }, t.watersheds)


@query(
    """, sw AS (SELECT 'w-' || c_custkey AS identity_id, CASE WHEN c_acctbal <= 2000 THEN (SELECT 'run-' || max(o_orderkey) FROM orders WHERE o_custkey = c_custkey)
      WHEN c_nationkey < 8 THEN (SELECT 'run-' || min(o_orderkey) FROM orders WHERE o_custkey = c_custkey)
      WHEN c_nationkey < 10 THEN (SELECT 'run-' || min(o_orderkey) FROM orders WHERE o_custkey = c_custkey + 1) ELSE 'new-' || c_custkey END AS runid
    FROM customer),
sw2 AS (SELECT * FROM sw WHERE runid IS NOT NULL),
ck AS (SELECT s.*, a.identity_id AS bound FROM sw2 s LEFT JOIN aliases a ON a.runid = s.runid),
ok AS (SELECT identity_id, runid AS nw, bound FROM ck WHERE bound IS NULL OR bound = identity_id)
SELECT a.runid, a.identity_id, CASE WHEN ok.nw IS NULL THEN a.is_current ELSE a.runid = ok.nw END AS is_current,
  CASE WHEN ok.nw IS NULL THEN 'kept' WHEN a.runid = ok.nw THEN CASE WHEN a.is_current THEN 'unchanged' ELSE 'activated' END
    WHEN a.is_current THEN 'cleared' ELSE 'kept' END AS action FROM aliases a LEFT JOIN ok ON ok.identity_id = a.identity_id
UNION ALL SELECT nw, identity_id, TRUE, 'created' FROM ok WHERE bound IS NULL
UNION ALL SELECT runid, identity_id, FALSE, 'conflict' FROM ck WHERE bound IS NOT NULL AND bound <> identity_id""",
    "aliases",
)
def alias_switch(t):
    """Low balances move to their newest run, the rest to their oldest, to another's or to a new one."""
    lowest = t.orders.groupBy("o_custkey").agg(
        F.concat(F.lit("run-"), F.min("o_orderkey").cast("string")).alias("_own"), F.concat(F.lit("run-"), F.max("o_orderkey").cast("string")).alias("_newest"))
    other = lowest.select((F.col("o_custkey") - 1).alias("c_custkey"), F.col("_own").alias("_other"))
    customers = t.customer.join(lowest, F.col("c_custkey") == F.col("o_custkey"), "left").join(other, "c_custkey", "left")
    switches = customers.select(
        F.concat(F.lit("w-"), F.col("c_custkey").cast("string")).alias("identity_id"),
        F.when(F.col("c_acctbal") <= 2000, F.col("_newest")).when(F.col("c_nationkey") < 8, F.col("_own")).when(F.col("c_nationkey") < 10, F.col("_other"))
        .otherwise(F.concat(F.lit("new-"), F.col("c_custkey").cast("string"))).alias("runid"),
    ).where("runid IS NOT NULL")
    return identity.switch_aliases(t.aliases, switches)


@query(
    f""", asg AS (SELECT '{BATCH}' || o_custkey AS runid,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Bad_' || o_orderkey WHEN o_orderpriority = '2-HIGH' THEN 'ws-' || o_custkey ELSE 'new-' || o_orderkey END AS watershed_key,
      CASE WHEN o_orderstatus = 'F' THEN 'c-1' ELSE 'c-' || c_nationkey END AS collection
    FROM (SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderkey) JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT '{BATCH}' || CASE WHEN extra THEN '' ELSE 'line-' END || l_suppkey, CASE WHEN extra THEN 'extra-' ELSE 'line-' END || l_suppkey, 'c-0'
    FROM (SELECT DISTINCT l_suppkey, l_quantity = 50 AND l_linenumber = 7 AND l_tax = 0 AS extra FROM lineitem)),
n AS (SELECT *, count(*) OVER (PARTITION BY runid) AS rr, count(*) OVER (PARTITION BY watershed_key) AS kk FROM asg)
SELECT n.runid, n.watershed_key, CASE WHEN rr > 1 THEN 'duplicate-runid' WHEN kk > 1 THEN 'duplicate-key'
  WHEN NOT regexp_full_match(n.watershed_key, '[a-z0-9]+(-[a-z0-9]+)*') THEN 'key-format' WHEN w.runid IS NULL THEN 'unknown-run'
  WHEN i.identity_id IS NOT NULL AND i.collection IS DISTINCT FROM n.collection THEN 'identity-conflict'
  WHEN w.logical_id IS NOT NULL AND w.logical_id IS DISTINCT FROM i.identity_id THEN 'identity-conflict'
  WHEN al.identity_id IS NOT NULL AND al.identity_id IS DISTINCT FROM i.identity_id THEN 'alias-conflict' ELSE 'accepted' END AS outcome,
  COALESCE(i.identity_id, 'new:' || n.watershed_key) AS identity_id
FROM n LEFT JOIN watersheds w ON w.runid = n.runid LEFT JOIN identities i ON i.watershed_key = n.watershed_key LEFT JOIN aliases al ON al.runid = n.runid""",
    "watersheds identities aliases",
)
def identity_assignment(t):
    first = t.orders.groupBy("o_custkey").agg(
        F.min_by(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey").alias("_o")
    ).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    text = lambda name: F.col(name).cast("string")
    one = first.select(
        F.concat(F.lit(BATCH), text("o_custkey")).alias("runid"),
        F.when(F.col("_o.o_orderpriority") == "1-URGENT", F.concat(F.lit("Bad_"), text("_o.o_orderkey")))
        .when(F.col("_o.o_orderpriority") == "2-HIGH", F.concat(F.lit("ws-"), text("o_custkey")))
        .otherwise(F.concat(F.lit("new-"), text("_o.o_orderkey"))).alias("watershed_key"),
        F.when(F.col("_o.o_orderstatus") == "F", "c-1").otherwise(F.concat(F.lit("c-"), text("c_nationkey"))).alias("collection"),
    )
    # Some lines name a run that has an assignment already, the others a run that nobody knows.
    extra = F.col("_extra")
    two = t.lineitem.select("l_suppkey", F.expr("l_quantity = 50 AND l_linenumber = 7 AND l_tax = 0").alias("_extra")).distinct().select(
        F.concat(F.lit(BATCH), F.when(extra, "").otherwise(F.lit("line-")), text("l_suppkey")).alias("runid"),
        F.concat(F.when(extra, "extra-").otherwise(F.lit("line-")), text("l_suppkey")).alias("watershed_key"),
        F.lit("c-0").alias("collection"),
    )
    return identity.check_assignments(one.unionByName(two), t.watersheds, t.identities, t.aliases)


CHANGE_SQL = """, b AS (SELECT c_custkey AS k, 'n-' || c_nationkey AS name, c_mktsegment AS seg, c_acctbal AS bal, c_nationkey AS nk FROM customer)
SELECT k, CASE WHEN nk % 5 = 4 AND bal < 0 THEN 'reject' WHEN nk % 5 = 0 THEN 'accept' WHEN nk % 5 = 1 AND bal > 3000 THEN 'accept'
    WHEN nk % 5 = 2 AND bal > 6000 THEN 'accept' WHEN nk % 5 = 3 AND bal > 1000 THEN 'accept' ELSE 'invalid' END AS decision,
  CASE WHEN nk % 5 = 4 AND bal < 0 THEN 'ambiguous-identity' WHEN nk % 5 = 0 THEN 'retained' WHEN nk % 5 = 1 THEN CASE WHEN bal > 3000 THEN 'split' ELSE 'rule' END
    WHEN nk % 5 = 2 THEN CASE WHEN bal > 6000 THEN 'metadata_only' ELSE 'rule' END
    WHEN nk % 5 = 3 THEN CASE WHEN bal > 1000 THEN 'replaced' ELSE 'rule' END ELSE 'conflict' END AS code FROM b"""


@query(CHANGE_SQL, "watersheds")
def identity_changes(t):
    key = F.col("c_custkey").cast("string")
    kind = F.col("c_nationkey") % 5
    balance = F.col("c_acctbal")
    names = lambda *items: F.array(*items)
    none = F.array().cast("array<string>")
    own, left, right = F.concat(F.lit("w-"), key), F.concat(F.lit("w-"), key, F.lit("-a")), F.concat(F.lit("w-"), key, F.lit("-b"))
    run, new_run = F.concat(F.lit("r-"), key), F.concat(F.lit("r-"), key, F.lit("-2"))

    def state(keys, runs, aliases, tombstones, metadata):
        return F.struct(
            keys.alias("watershed_keys"), names(F.lit("c-1")).alias("collection_keys"), runs.alias("runids"),
            names(F.col("c_name")).alias("display_names"), aliases.alias("aliases"), tombstones.alias("tombstones"),
            metadata.alias("metadata_fingerprint"), F.lit("g").alias("geometry_fingerprint"), F.lit("c").alias("child_fingerprint"),
        )

    moved_run = (kind == 3) | (kind == 4)
    changes = t.customer.select(
        F.col("c_custkey").alias("k"),
        F.when(kind == 0, "retained").when(kind == 1, "split").when(kind == 2, "metadata_only").when(kind == 3, "replaced")
        .otherwise(F.lit("unresolved")).alias("kind"),
        state(names(own), names(run), none, none, F.lit("m")).alias("before"),
        state(
            F.when(kind == 1, names(left, right)).otherwise(names(own)),
            F.when(moved_run, names(new_run)).otherwise(names(run)),
            F.when((kind == 3) & (balance > 1000), names(run)).otherwise(none),
            F.when(kind == 1, names(own)).otherwise(none),
            F.when((kind == 2) & (balance > 6000), F.lit("m2")).otherwise(F.lit("m")),
        ).alias("after"),
        F.when(kind == 1, balance > 3000).when(kind == 4, balance >= 0).otherwise(F.lit(True)).alias("reviewed"),
        F.when(kind == 4, "ambiguous-identity").alias("conflict_code"),
    )
    return identity.classify_changes(changes).select("k", "decision", "code")


@query(
    """, o AS (SELECT runid, row_number() OVER (ORDER BY runid) AS ordinal, count(*) OVER () AS n FROM watersheds),
c AS (SELECT o_orderkey AS series FROM orders)
SELECT series, runid FROM c JOIN o ON o.ordinal = 1 + (((series - 1) % n) + n) % n""",
    "watersheds",
)
def round_robin(t):
    series = t.orders.select(F.col("o_orderkey").alias("series"))
    return ranking.assign_round_robin(t.watersheds, "runid", series, "series").select("series", "runid")


@query(
    """SELECT user_id, rows, null_keys, breaks, null_keys = 0 AND breaks = 0 AS increasing FROM (
  SELECT u.user_id, u.rows, u.nulls AS null_keys, COALESCE(b.breaks, 0)::BIGINT AS breaks
  FROM (SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE value > 150) AS nulls FROM events GROUP BY user_id) u
  LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE k <= p) AS breaks FROM (
      SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (
        SELECT user_id, event_id, floor(epoch(ts) / 3600)::BIGINT AS k FROM events WHERE value <= 150)) GROUP BY user_id) b USING (user_id))"""
)
def strict_increase(t):
    hours = F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))
    rows = t.events.select("user_id", "event_id", F.when(F.col("value") <= 150, hours).alias("k"))
    return keys.strictly_increasing(rows, "user_id", "event_id", "k")


@query(
    """SELECT identity_id, count(*) FILTER (WHERE is_current) AS current FROM aliases GROUP BY identity_id HAVING count(*) FILTER (WHERE is_current) > 1""",
    "aliases",
)
def one_current(t):
    return keys.current_conflicts(t.aliases)


@query(
    """, known AS (SELECT DISTINCT p_type AS name FROM part UNION ALL SELECT 'click' UNION ALL SELECT 'view' UNION ALL SELECT 'purchase')
SELECT user_id, event_type AS name, min(event_id) AS first_seen FROM events WHERE event_type IN (SELECT name FROM known) GROUP BY user_id, event_type""",
    "watersheds",
)
def first_seen(t):
    types = t.events.select("user_id", F.col("event_type").alias("name"), "event_id")
    # Known names: part types and the event types that carry a value above 100 as a rule.
    fixed = F.array(F.lit("click"), F.lit("view"), F.lit("purchase"))
    known = t.part.select(F.col("p_type").alias("name")).distinct().unionByName(
        t.region.select(F.explode(fixed).alias("name"))
    )
    return keys.first_seen(types, "name", "event_id", known, ["user_id"])


@query(
    """SELECT runid FROM watersheds UNION SELECT 'run-' || o_orderkey FROM orders UNION SELECT 'run-' || l_orderkey FROM lineitem""",
    "watersheds",
)
def run_union(t):
    run = lambda df, key: df.select(F.concat(F.lit("run-"), F.col(key).cast("string")).alias("runid"))
    return keys.union_of_runs([
        t.watersheds, run(t.orders, "o_orderkey"), run(t.lineitem, "l_orderkey"),
    ])


@query(
    """SELECT l_partkey AS run, l_returnflag AS kind FROM lineitem WHERE year(l_shipdate) < 1997
EXCEPT SELECT l_partkey, l_returnflag FROM lineitem WHERE year(l_shipdate) >= 1997"""
)
def capability_removed(t):
    named = t.lineitem.select(F.col("l_partkey").alias("run"), F.col("l_returnflag").alias("kind"), F.year("l_shipdate").alias("y"))
    return keys.removed_keys(named.where("y < 1997"), named.where("y >= 1997"), ["run", "kind"])


# --- ingest ------------------------------------------------------------------------------


@query(
    """SELECT p_partkey AS key, CASE WHEN p_size > 25 THEN p_name ELSE p_type END AS pws_name, p_brand AS srcname,
  CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END::BIGINT AS hillslope_area,
  CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_retailprice END AS elevation,
  CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 0 THEN 'hillslope_area' ELSE '' END AS rejected FROM part"""
)
def harmonise(t):
    source = t.part.select(
        F.col("p_partkey").alias("key"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("PWS_Name_2"),
        F.col("p_type").alias("PWS_Name"), F.col("p_brand").alias("name"),
        F.when(F.col("p_size") % 4 == 0, F.lit(None)).otherwise(F.col("p_size").cast("string")).alias("area"),
        F.when(F.col("p_size") % 5 == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("elevation"),
        "p_size",
    )
    named = ingest.harmonise(source, {k: ingest.WATERSHED_SOURCES[k] for k in ("pws_name", "srcname")}, ["key", "area", "elevation", "p_size"])
    fields = [f for f in ingest.HILLSLOPE_FIELDS if f[0] in ("hillslope_area", "elevation")]
    tolerant = ingest.typed_fields(named, fields, ["key", "pws_name", "srcname"])
    spoiled = named.withColumn("area", F.when(F.col("p_size") % 3 == 0, F.concat(F.col("area"), F.lit(" ha"))).otherwise(F.col("area")))
    strict = ingest.typed_fields(spoiled.drop("elevation"), fields[:1], ["key"], strict=True)
    return tolerant.join(strict.select("key", F.array_join("rejected", ",").alias("rejected")), "key")


ATTRIBUTES = """, sub AS (SELECT o_custkey AS runid, o_orderkey AS topazid FROM orders),
h AS (SELECT l_orderkey AS topazid, max(l_extendedprice) AS elevation, max(l_partkey) AS area FROM lineitem GROUP BY l_orderkey),
hill AS (SELECT o_custkey AS runid, h.* FROM h JOIN orders ON o_orderkey = topazid WHERE o_orderstatus <> 'F'),
soil AS (SELECT o_custkey AS runid, o_orderkey AS topazid, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS d,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS clay FROM orders WHERE o_orderstatus <> 'O')"""


def attribute_tables(t):
    orders = t.orders.select(F.col("o_custkey").alias("runid"), F.col("o_orderkey").alias("topazid"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    highest = t.lineitem.groupBy(F.col("l_orderkey").alias("topazid")).agg(
        F.max("l_extendedprice").alias("elevation"), F.max("l_partkey").alias("area")
    )
    hill = highest.join(orders.where("o_orderstatus <> 'F'").select("runid", "topazid"), "topazid")
    low = F.col("o_orderpriority") == "5-LOW"
    soil = orders.where("o_orderstatus <> 'O'").select(
        "runid", "topazid", F.when(~low, F.col("o_orderpriority")).alias("desc"), F.when(~low, F.col("o_totalprice")).alias("clay")
    )
    return orders.select("runid", "topazid"), hill, soil


@query(
    ATTRIBUTES + """ SELECT s.runid, s.topazid, h.elevation, h.area AS hillslope_area, soil.d AS soil_desc, soil.clay,
  h.elevation IS NOT NULL OR h.area IS NOT NULL OR soil.d IS NOT NULL OR soil.clay IS NOT NULL AS updated
FROM sub s LEFT JOIN hill h USING (runid, topazid) LEFT JOIN soil USING (runid, topazid)""",
    "watersheds",
)
def attribute_join(t):
    sub, hill, soil = attribute_tables(t)
    pick = lambda fields, names: [f for f in fields if f[0] in names]
    return ingest.attach_attributes(sub, {
        "hillslopes": (hill, pick(ingest.HILLSLOPE_FIELDS, ("elevation", "hillslope_area"))),
        "soils": (soil, pick(ingest.SOIL_FIELDS, ("soil_desc", "clay"))),
    })


@query(
    ATTRIBUTES + """, m AS (SELECT COALESCE(s.runid, h.runid) AS runid, s.topazid AS sk, h.topazid AS hk FROM sub s FULL JOIN hill h ON s.runid = h.runid AND s.topazid = h.topazid)
SELECT runid, count(sk) AS staged_rows, count(hk) AS attribute_rows, count(*) FILTER (WHERE hk IS NULL) AS staged_only,
  count(*) FILTER (WHERE sk IS NULL) AS attribute_only, 0::BIGINT AS null_keys, 0::BIGINT AS repeated_keys,
  count(*) FILTER (WHERE hk IS NULL OR sk IS NULL) = 0 AS exact FROM m GROUP BY runid""",
    "watersheds",
)
def exact_coverage(t):
    sub, hill, _ = attribute_tables(t)
    return ingest.attribute_coverage(sub, hill)


@query(
    """SELECT w.runid, srcname FROM watersheds w WHERE runid IN (SELECT runid FROM watersheds WHERE segment = 'machinery')""",
    "watersheds",
)
def requested_runs(t):
    # Two batches and a standalone source; the request list names runs by id only.
    rows = t.watersheds.select("runid", "srcname", "segment")
    requested = files.discover_runs(rows.where("segment = 'machinery'"))
    loaded = files.load_sources({"nasa-roses-2026-sbs": rows, "victoria-ca-2026-sbs": rows}, None, requested)
    return loaded.select("runid", "srcname")


@query(
    """SELECT w.runid, r.role, 'https://example.test/runs/' || 'batch;;nasa-roses-2026-sbs;;' || upper(split_part(w.runid, ';;', 3)) || '/' || r.file AS path
FROM watersheds w, (VALUES ('subcatchments', 'dem/wbt/subcatchments.WGS.geojson'), ('channels', 'dem/wbt/channels.WGS.geojson'),
  ('hillslopes', 'watershed/hillslopes.parquet'), ('soils', 'soils/soils.parquet'), ('landuse', 'landuse/landuse.parquet')) r(role, file)""",
    "watersheds",
)
def source_catalogue(t):
    return files.run_catalogue(t.watersheds, "https://example.test/")


# Collections by the start of a run's id, as a deployment would configure them.
BATCH_COLLECTIONS = {
    "batch;;nasa-roses-2026-sbs;;": "nasa-roses", "batch;;nasa-roses-202606-psbs;;": "nasa-roses", "batch;;victoria-ca-2026-sbs;;": "victoria-ca",
}


@query(
    """SELECT c_custkey AS key, CASE WHEN b IN ('nasa-roses-2026-sbs', 'nasa-roses-202606-psbs') THEN 'batch;;' || b || ';;' || upper(s)
    WHEN b = '' THEN s ELSE 'batch;;' || b || ';;' || s END AS runid,
  CASE WHEN starts_with(b, 'nasa') THEN 'nasa-roses' WHEN starts_with(b, 'vic') THEN 'victoria-ca' END AS collection
FROM (SELECT c_custkey, list_extract(['nasa-roses-2026-sbs', 'nasa-roses-202606-psbs', 'victoria-ca-2026-sbs', '', 'other'], c_nationkey % 5 + 1) AS b, lower(c_name) AS s FROM customer)"""
)
def run_normalise(t):
    batches = F.array(*[F.lit(b) for b in ("nasa-roses-2026-sbs", "nasa-roses-202606-psbs", "victoria-ca-2026-sbs", "", "other")])
    batch = F.get(batches, F.col("c_nationkey") % 5)
    runid = F.when(batch == "", F.lower("c_name")).otherwise(F.concat_ws(";;", F.lit("batch"), batch, F.lower("c_name")))
    return t.customer.select(
        F.col("c_custkey").alias("key"), normalise_runid(runid).alias("runid"), collection_of_run(runid, {}, BATCH_COLLECTIONS).alias("collection")
    )


@query(
    """SELECT l_linestatus AS runid, l_orderkey AS feature, l_linenumber AS line FROM lineitem WHERE l_tax = 0 OR (l_tax >= 0.01 AND l_tax < 0.02)"""
)
def boundary_flag(t):
    rows = t.lineitem.select(
        F.col("l_linestatus").alias("runid"), F.col("l_orderkey").alias("feature"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_tax") > 0, F.round(F.col("l_tax") * 100)).alias("Watershed"),
    )
    return ingest.boundary_rows(rows).select("runid", "feature", "line")


@query(
    """SELECT o_orderpriority AS phase, 'r-' || o_custkey AS runid, COALESCE(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'F'), 0)::BIGINT AS saved,
  COALESCE(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'O'), 0)::BIGINT AS updated,
  COALESCE(sum(o_orderkey) FILTER (WHERE o_orderstatus = 'P'), 0)::BIGINT AS skipped FROM orders GROUP BY 1, 2"""
)
def load_statistics(t):
    events = t.orders.select(
        F.col("o_orderpriority").alias("phase"), F.concat(F.lit("r-"), F.col("o_custkey").cast("string")).alias("runid"),
        F.when(F.col("o_orderstatus") == "F", "saved").when(F.col("o_orderstatus") == "O", "updated").otherwise(F.lit("skipped")).alias("outcome"),
        F.col("o_orderkey").alias("records"),
    )
    return ingest.load_statistics(events)


@query(
    """WITH l AS (SELECT event_type AS phase, event_id, CASE WHEN value > 120 THEN 'error' WHEN value > 80 THEN 'warning' ELSE 'item' END AS level,
    user_id AS records, 'event ' || event_id AS message FROM events)
SELECT phase, count(*) FILTER (WHERE level = 'item') AS items, sum(records)::BIGINT AS records, count(*) FILTER (WHERE level = 'error') AS errors,
  count(*) FILTER (WHERE level = 'warning') AS warnings,
  COALESCE(array_to_string(list_slice(list(message ORDER BY event_id) FILTER (WHERE level = 'error'), 1, 5), ' | '), '') AS first_errors FROM l GROUP BY phase"""
)
def load_summary(t):
    log = t.events.select(
        F.col("event_type").alias("phase"), F.col("event_id").alias("position"), F.col("user_id").alias("records"),
        F.when(F.col("value") > 120, "error").when(F.col("value") > 80, "warning").otherwise(F.lit("item")).alias("level"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message"),
    )
    return ingest.load_summary(log)


@query(
    """, f AS (SELECT 'w-' || l_suppkey AS runid, count(*) FILTER (WHERE l_returnflag = 'A') AS sub, count(*) FILTER (WHERE l_returnflag = 'R') AS chan FROM lineitem GROUP BY 1),
al AS (SELECT 'w-' || s_suppkey AS runid, array_to_string(list_sort(list_distinct(list('n-' || s_nationkey))), ',') AS aliases FROM supplier GROUP BY 1),
ar AS (SELECT 'w-' || l_suppkey AS runid, array_to_string(list_sort(list(DISTINCT l_linestatus || '=' || md5(l_linestatus))), ',') AS artifacts FROM lineitem GROUP BY 1),
b AS (SELECT 'w-' || l_suppkey AS runid, min(l_tax) AS minx, min(l_discount) AS miny, max(l_tax) AS maxx, max(l_discount) AS maxy,
  count(*) FILTER (WHERE l_quantity = 50 AND l_linenumber = 1) AS bf FROM lineitem GROUP BY 1)
SELECT 'c-' || s_nationkey AS collection, 'w-' || s_suppkey AS runid, s_name AS display_name, COALESCE(aliases, '') AS aliases, COALESCE(artifacts, '') AS artifacts,
  COALESCE(sub, 0) AS subcatchments, COALESCE(chan, 0) AS channels, minx, miny, maxx, maxy, NOT (s_acctbal < 3000) OR COALESCE(bf, 0) = 1 AS boundary_ok
FROM supplier s LEFT JOIN f ON f.runid = 'w-' || s_suppkey LEFT JOIN al ON al.runid = 'w-' || s_suppkey
LEFT JOIN ar ON ar.runid = 'w-' || s_suppkey LEFT JOIN b ON b.runid = 'w-' || s_suppkey""",
    "watersheds",
)
def member_index(t):
    run = lambda c: F.concat(F.lit("w-"), F.col(c).cast("string")).alias("runid")
    runs = t.supplier.select(
        F.concat(F.lit("c-"), F.col("s_nationkey").cast("string")).alias("collection"), run("s_suppkey"),
        F.col("s_name").alias("display_name"), (F.col("s_acctbal") < 3000).alias("standalone"),
    )
    features = t.lineitem.select(
        run("l_suppkey"), F.when(F.col("l_returnflag") == "A", "subcatchments").when(F.col("l_returnflag") == "R", "channels").alias("role")
    )
    aliases = t.supplier.select(run("s_suppkey"), F.concat(F.lit("n-"), F.col("s_nationkey").cast("string")).alias("alias"))
    artifacts = t.lineitem.select(run("l_suppkey"), F.col("l_linestatus").alias("role"), F.md5("l_linestatus").alias("sha256"))
    bounds = t.lineitem.groupBy(run("l_suppkey")).agg(
        F.min("l_tax").alias("minx"), F.min("l_discount").alias("miny"), F.max("l_tax").alias("maxx"), F.max("l_discount").alias("maxy"),
        F.count_if((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 1)).alias("boundary_features"),
    )
    return ingest.member_index(runs, features, aliases, artifacts, bounds)


# --- enrichment --------------------------------------------------------------------------

ENRICH = """, tgt AS (SELECT c_custkey AS pos, 'Customer#' || c_custkey AS code, 'run-' || c_custkey AS runid, c_nationkey::VARCHAR AS geom, CASE WHEN c_acctbal > 9000 THEN c_mktsegment END AS owner FROM customer),
src AS (SELECT 'Customer#' || k AS code, CASE WHEN k % 3 = 0 THEN NULL ELSE 'run-' || m END AS runid, (n)::VARCHAR AS geom, pr AS owner, n AS pop
  FROM (SELECT o_custkey * 2 AS k, min(o_custkey) * CASE WHEN min(o_orderstatus) = max(o_orderstatus) THEN 2 ELSE 1 END AS m,
      (min(o_orderkey) % 25)::INTEGER AS n, upper(substr(min(o_orderpriority), 3)) AS pr FROM orders GROUP BY o_custkey))"""


def enrichment_sides(t):
    target = t.customer.select(
        F.col("c_custkey").alias("pos"), F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")).alias("code"),
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("runid"), F.col("c_nationkey").cast("string").alias("geom"),
        F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).alias("owner"),
    )
    grouped = t.orders.groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("_o"), (F.min("o_orderstatus") == F.max("o_orderstatus")).alias("_one"), F.min("o_orderpriority").alias("_p")
    )
    k = F.col("o_custkey") * 2
    source = grouped.select(
        F.concat(F.lit("Customer#"), k.cast("string")).alias("code"),
        F.when(k % 3 != 0, F.concat(F.lit("run-"), F.when(F.col("_one"), k).otherwise(F.col("o_custkey")).cast("string"))).alias("runid"),
        (F.col("_o") % 25).cast("int").cast("string").alias("geom"), F.upper(F.substr("_p", F.lit(3))).alias("owner"),
        (F.col("_o") % 25).cast("int").alias("pop"),
    )
    return target, source


@query(
    ENRICH + """ SELECT t.pos, t.code, t.runid, t.geom, s.owner, s.pop, s.code IS NOT NULL AS matched,
  CASE WHEN s.code IS NOT NULL AND t.owner IS NOT NULL AND t.owner IS DISTINCT FROM s.owner THEN 'owner' ELSE '' END AS conflicts
FROM tgt t LEFT JOIN src s ON s.code = t.code""",
    "watersheds",
)
def enrich_rows(t):
    target, source = enrichment_sides(t)
    return enrich.enrich(target, source, ["owner", "pop"], "code").withColumn("conflicts", F.array_join("conflicts", ","))


@query(
    ENRICH + """, m AS (SELECT t.code AS tc, s.code AS sc, t.runid AS tr, s.runid AS sr, t.geom AS tg, s.geom AS sg FROM tgt t FULL JOIN src s ON s.code = t.code) """
    + union_sql({
        "matched": "(SELECT count(*) FROM m WHERE tc IS NOT NULL AND sc IS NOT NULL)",
        "target-unmatched": "(SELECT count(*) FROM m WHERE sc IS NULL)",
        "source-unmatched": "(SELECT count(*) FROM m WHERE tc IS NULL)",
        "duplicate-join-key": "(SELECT count(tc) - count(DISTINCT tc) FROM m)",
        "preserved-membership": "(SELECT count(*) FROM tgt)",
        "preserved-runids": "(SELECT count(*) FROM tgt)",
        "preserved-geometry": "(SELECT count(*) FROM tgt)",
        "source-runids-ignored": "(SELECT count(runid) FROM src)",
        "source-geometry-ignored": "(SELECT count(*) FROM src)",
        "source-runid-differences": "(SELECT count(*) FROM m WHERE tc IS NOT NULL AND sc IS NOT NULL AND sr IS NOT NULL AND sr <> tr)",
        "source-geometry-differences": "(SELECT count(*) FROM m WHERE tc IS NOT NULL AND sc IS NOT NULL AND sg IS DISTINCT FROM tg)",
    }),
    "watersheds",
)
def enrich_report(t):
    target, source = enrichment_sides(t)
    return enrich.enrichment_report(target, source, "code", "runid", "geom")


@query(
    ENRICH + """ SELECT code, 'target' AS side FROM tgt WHERE code NOT IN (SELECT code FROM src)
UNION ALL SELECT code, 'source' FROM src WHERE code NOT IN (SELECT code FROM tgt)""",
    "watersheds",
)
def enrich_unmatched(t):
    target, source = enrichment_sides(t)
    return enrich.unmatched(target, source, "code")


@query(
    ENRICH + " " + union_sql({
        "missing": "0::BIGINT", "added": "0::BIGINT", "runid": "0::BIGINT", "geom": "0::BIGINT", "pos": "0::BIGINT",
        "owner": "(SELECT count(*) FROM tgt t LEFT JOIN src s ON s.code = t.code WHERE t.owner IS DISTINCT FROM s.owner)",
    }).replace("AS code", 'AS "check"').replace("AS count", "AS rows"),
    "watersheds",
)
def enrich_preserved(t):
    target, source = enrichment_sides(t)
    output = enrich.enrich(target, source, ["owner", "pop"], "code")
    return enrich.preserved(target, output, "code", ["runid", "geom", "pos", "owner"])
