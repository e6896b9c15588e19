"""Release, fingerprint, quality and operations queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.catalog.registry import flat, query, rounded
from headwater.functions.canonical import canonical_decimal, canonical_integer, canonical_text, json_line
from headwater.operators import fingerprint as FP
from headwater.operators import raster
from headwater.plans import operations, quality, release

COUNTS = ["watersheds", "subcatchments", "channels"]
CHILD = ["subcatchment_fingerprint", "channel_fingerprint", "actual_subcatchments", "actual_channels"]
_ne = lambda f: f"b.{f} IS DISTINCT FROM t.{f}"

PLAN = f""", j AS (SELECT COALESCE(b.watershed_key, t.watershed_key) AS watershed_key, b.watershed_key IS NOT NULL AS had, t.watershed_key IS NOT NULL AS has,
  b.runid AS before_runid, b.run_fingerprint AS before_run_fingerprint, b.capability_fingerprint AS before_capability_fingerprint,
  t.runid AS after_runid, t.run_fingerprint AS after_run_fingerprint, t.capability_fingerprint AS after_capability_fingerprint,
  {_ne('collection')} OR {_ne('runid')} AS d_i, {_ne('metadata_fingerprint')} AS d_m, {_ne('geometry_fingerprint')} AS d_g,
  {' OR '.join(_ne(f) for f in CHILD)} AS d_c, {_ne('capability_fingerprint')} AS d_k, {_ne('run_fingerprint')} AS d_r,
  {', '.join(f'(COALESCE(t.actual_{c}, 0) - COALESCE(b.actual_{c}, 0))::BIGINT AS delta_{c}' for c in COUNTS)}
  FROM base_states b FULL JOIN target_states t ON b.watershed_key = t.watershed_key),
f AS (SELECT *, NOT had OR NOT has AS one FROM j),
c AS (SELECT *, list_filter([CASE WHEN one OR d_i THEN 'identity' END, CASE WHEN one OR d_m THEN 'metadata' END, CASE WHEN one OR d_g THEN 'geometry' END,
  CASE WHEN one OR d_c THEN 'children' END,
  CASE WHEN CASE WHEN one THEN COALESCE(after_capability_fingerprint, before_capability_fingerprint) IS NOT NULL ELSE d_k END THEN 'capability' END], lambda x: x IS NOT NULL) AS found FROM f),
g AS (SELECT *, CASE WHEN len(found) = 0 AND d_r THEN ['identity'] ELSE found END AS ch FROM c),
plan AS (SELECT watershed_key, CASE WHEN NOT had THEN 'add' WHEN NOT has THEN 'remove' WHEN len(ch) > 0 THEN 'change' ELSE 'retain' END AS operation,
  before_runid, before_run_fingerprint, before_capability_fingerprint, after_runid, after_run_fingerprint, after_capability_fingerprint,
  array_to_string(ch, ',') AS change_channels, {', '.join(f'delta_{c}' for c in COUNTS)}, had AND has AND (len(ch) > 0) <> d_r AS disagrees FROM g)"""
STATES = "base_states target_states"


def plan(t):
    return release.plan_forward(t.base_states, t.target_states)


@query(PLAN + " SELECT * FROM plan", STATES)
def release_plan(t):
    return flat(plan(t))


@query(
    PLAN + f""" SELECT watershed_key, CASE operation WHEN 'add' THEN 'remove' WHEN 'remove' THEN 'add' ELSE operation END AS operation,
  after_runid AS before_runid, after_run_fingerprint AS before_run_fingerprint, after_capability_fingerprint AS before_capability_fingerprint,
  before_runid AS after_runid, before_run_fingerprint AS after_run_fingerprint, before_capability_fingerprint AS after_capability_fingerprint,
  change_channels, {', '.join(f'-delta_{c} AS delta_{c}' for c in COUNTS)}, disagrees FROM plan""",
    STATES,
)
def release_inverse(t):
    return flat(release.plan_inverse(plan(t)))


N = lambda o: f"count(*) FILTER (WHERE operation = '{o}')"


@query(
    PLAN + f""" SELECT {', '.join(f"{N(o)} AS actions_{o}" for o in ('add', 'change', 'remove', 'retain'))},
  {', '.join(f'COALESCE(sum(delta_{c}), 0)::BIGINT AS delta_{c}' for c in COUNTS)},
  round(COALESCE({N('remove')} / NULLIF({N('remove')} + {N('change')} + {N('retain')}, 0)::DOUBLE, 0), 6) AS removal_ratio,
  {N('remove')} <= 5 AND COALESCE({N('remove')} / NULLIF({N('remove')} + {N('change')} + {N('retain')}, 0)::DOUBLE, 0) <= 0.1 AS allowed,
  count(*) FILTER (WHERE disagrees) AS disagreements FROM plan""",
    STATES,
)
def release_totals_guard(t):
    return rounded(release.plan_totals(plan(t)), 6)


@query(
    """SELECT watershed_key, 'add' AS operation, runid AS after_runid, CASE WHEN capability_fingerprint IS NULL THEN 'identity,metadata,geometry,children'
  ELSE 'identity,metadata,geometry,children,capability' END AS change_channels, actual_subcatchments::BIGINT AS delta_subcatchments FROM target_states""",
    STATES,
)
def release_empty_build(t):
    built = flat(release.plan_empty_build(t.target_states))
    return built.select("watershed_key", "operation", "after_runid", "change_channels", "delta_subcatchments")


PLAN_ROWS = """, rows AS (SELECT o_custkey AS plan_id, o_orderkey AS position, CASE WHEN o_orderpriority = '5-LOW' THEN 'k' || lpad((o_orderkey // 2)::VARCHAR, 19, '0')
    WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'a' ELSE 'k' || lpad(o_orderkey::VARCHAR, 19, '0') END AS watershed_key,
  CASE WHEN o_orderstatus = 'F' THEN 'retain' WHEN o_orderstatus = 'O' THEN 'change' ELSE 'add' END AS operation,
  CASE WHEN o_orderstatus <> 'P' THEN 'r' END AS before_runid, CASE WHEN o_totalprice > 250000 THEN 'r' ELSE 'r2' END AS after_runid,
  CASE WHEN o_totalprice > 400000 THEN ['geometry', 'metadata'] ELSE ['metadata'] END AS channels, CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END AS d FROM orders),
s AS (SELECT plan_id, count(*) FILTER (WHERE len(channels) = 2) AS "channel-order", count(*) FILTER (WHERE operation = 'retain' AND before_runid IS DISTINCT FROM after_runid) AS "retain-state",
  count(*) FILTER (WHERE operation = 'retain' AND d <> 0) AS "retain-delta", count(*) FILTER (WHERE operation = 'change' AND before_runid IS NOT DISTINCT FROM after_runid) AS "change-state",
  sum(d) AS total FROM rows GROUP BY plan_id),
h AS (SELECT c_custkey AS plan_id, c_nationkey AS nk, c_acctbal > 9000 AS same, COALESCE(s.total, 0) <> CASE WHEN c_nationkey < 12 THEN COALESCE(s.total, 0) ELSE 2 END AS off FROM customer LEFT JOIN s ON s.plan_id = c_custkey),
v AS (SELECT plan_id, 'channel-order' AS rule, "channel-order" AS broken FROM s UNION ALL SELECT plan_id, 'retain-state', "retain-state" FROM s UNION ALL SELECT plan_id, 'retain-delta', "retain-delta" FROM s
  UNION ALL SELECT plan_id, 'change-state', "change-state" FROM s UNION ALL SELECT plan_id, 'row-delta-total', off::BIGINT FROM h UNION ALL SELECT plan_id, 'same-state-plan', same::BIGINT FROM h
  UNION ALL SELECT plan_id, 'action-identity', sum(c - 1)::BIGINT FROM (SELECT plan_id, watershed_key, count(*) AS c FROM rows GROUP BY 1, 2) GROUP BY plan_id
  UNION ALL SELECT plan_id, 'action-order', count(*) FILTER (WHERE watershed_key <= p) FROM (SELECT plan_id, watershed_key, lag(watershed_key) OVER (PARTITION BY plan_id ORDER BY position) AS p FROM rows) GROUP BY plan_id)
SELECT plan_id, rule, broken FROM v WHERE broken > 0"""


@query(PLAN_ROWS, "watersheds")
def plan_rules(t):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    number = lambda column: F.concat(F.lit("k"), F.lpad(column.cast("string"), 19, "0"))
    one = F.when(price > 450000, 1).otherwise(F.lit(0))
    none = F.lit(None).cast("string")
    rows = t.orders.select(
        F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("position"),
        F.when(F.col("o_orderpriority") == "5-LOW", number(F.floor(F.col("o_orderkey") / 2)))
        .when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (status == "F"), "a").otherwise(number(F.col("o_orderkey"))).alias("watershed_key"),
        F.when(status == "F", "retain").when(status == "O", "change").otherwise(F.lit("add")).alias("operation"),
        F.when(status != "P", "r").alias("before_runid"), F.when(price > 250000, "r").otherwise(F.lit("r2")).alias("after_runid"),
        none.alias("before_run_fingerprint"), none.alias("after_run_fingerprint"),
        none.alias("before_capability_fingerprint"), none.alias("after_capability_fingerprint"),
        F.when(price > 400000, F.array(F.lit("geometry"), F.lit("metadata"))).otherwise(F.array(F.lit("metadata"))).alias("change_channels"),
        one.alias("delta_watersheds"), F.lit(0).alias("delta_subcatchments"), F.lit(0).alias("delta_channels"),
    )
    sums = rows.groupBy("plan_id").agg(F.sum("delta_watersheds").alias("_s"))
    total = F.coalesce("_s", F.lit(0))
    headers = t.customer.join(sums, F.col("c_custkey") == F.col("plan_id"), "left").select(
        F.col("c_custkey").alias("plan_id"), F.lit("base").alias("base"),
        F.when(F.col("c_acctbal") > 9000, "base").otherwise(F.lit("target")).alias("target"),
        F.when(F.col("c_nationkey") < 12, total).otherwise(F.lit(2)).alias("expected_watersheds"),
        F.lit(0).alias("expected_subcatchments"), F.lit(0).alias("expected_channels"),
    )
    return release.plan_violations(rows, headers)


MERGE = """, ex AS (SELECT o_custkey AS run, o_orderkey AS topazid, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE year(o_orderdate) < 2000),
st AS (SELECT o_custkey AS run, o_orderkey AS topazid, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE year(o_orderdate) > 1996),
m AS (SELECT COALESCE(e.run, s.run) AS run, COALESCE(e.topazid, s.topazid) AS topazid, CASE WHEN s.topazid IS NULL THEN e.s ELSE s.s END AS s, CASE WHEN s.topazid IS NULL THEN e.p ELSE s.p END AS p,
  CASE WHEN s.topazid IS NULL THEN 'deleted' WHEN e.topazid IS NULL THEN 'created' ELSE 'updated' END AS action,
  e.topazid IS NOT NULL AND s.topazid IS NOT NULL AND (e.s IS DISTINCT FROM s.s OR e.p IS DISTINCT FROM s.p) AS really_changed
  FROM ex e FULL JOIN st s ON e.run = s.run AND e.topazid = s.topazid)"""


def merged_orders(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("topazid"), F.year("o_orderdate").alias("_y"),
        F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("p"), "o_orderpriority",
    )
    staged = rows.where("_y > 1996").withColumn("s", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("s")))
    return release.merge_children(rows.where("_y < 2000"), staged, ["run", "topazid"], ["s", "p"])


@query(MERGE + " SELECT * FROM m", "watersheds")
def child_merge(t):
    return merged_orders(t)


@query(
    MERGE + PLAN + """ SELECT 'runs_' || operation AS measure, count(*) AS count FROM plan GROUP BY operation
UNION ALL SELECT 'children_' || action, count(*) FROM m GROUP BY action
UNION ALL SELECT 'capability_rows', count(*) FROM target_states WHERE capability_fingerprint IS NOT NULL""",
    STATES,
)
def merge_result(t):
    return release.merge_result(plan(t), merged_orders(t), t.target_states.where("capability_fingerprint IS NOT NULL"))


@query(
    """, o AS (SELECT watershed_key, run_fingerprint, actual_subcatchments, actual_channels FROM base_states),
l AS (SELECT watershed_key, run_fingerprint, actual_subcatchments, actual_channels FROM target_states)
SELECT COALESCE(o.watershed_key, l.watershed_key) AS watershed_key, CASE WHEN l.watershed_key IS NULL THEN 'unlisted' WHEN o.watershed_key IS NULL THEN 'absent'
    WHEN o.run_fingerprint <> l.run_fingerprint OR o.actual_subcatchments <> l.actual_subcatchments OR o.actual_channels <> l.actual_channels THEN 'differs' ELSE 'equal' END AS status,
  CASE WHEN l.watershed_key IS NULL OR o.watershed_key IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN o.run_fingerprint <> l.run_fingerprint THEN 'run_fingerprint' END,
    CASE WHEN o.actual_subcatchments <> l.actual_subcatchments THEN 'actual_subcatchments' END, CASE WHEN o.actual_channels <> l.actual_channels THEN 'actual_channels' END], lambda x: x IS NOT NULL), ',') END AS fields
FROM o FULL JOIN l ON o.watershed_key = l.watershed_key""",
    STATES,
)
def noop_check(t):
    return release.ledger_check(t.base_states, t.target_states, "watershed_key", ["run_fingerprint", "actual_subcatchments", "actual_channels"])


@query(
    """, eq AS (SELECT b.watershed_key FROM base_states b JOIN target_states t ON b.watershed_key = t.watershed_key AND b.run_fingerprint = t.run_fingerprint)
SELECT watershed_key, run_fingerprint FROM target_states WHERE capability_fingerprint IS NULL
UNION ALL SELECT watershed_key, run_fingerprint FROM target_states WHERE capability_fingerprint IS NOT NULL AND watershed_key IN (SELECT watershed_key FROM eq)""",
    STATES,
)
def adopted_runs(t):
    fields = ["watershed_key", "run_fingerprint"]
    baseline = t.target_states
    return release.adopt(
        t.base_states.select(fields), baseline.select(fields), baseline.where("capability_fingerprint IS NULL").select(fields),
        "watershed_key", ["run_fingerprint"],
    )



@query(
    PLAN + """, applied AS (SELECT p.watershed_key, p.after_runid AS runid,
  CASE WHEN p.operation = 'add' OR (p.operation = 'change' AND contains(',' || p.change_channels || ',', ',metadata,')) THEN t.metadata_fingerprint ELSE b.metadata_fingerprint END AS metadata_fingerprint,
  CASE WHEN p.operation = 'add' OR (p.operation = 'change' AND contains(',' || p.change_channels || ',', ',geometry,')) THEN t.geometry_fingerprint ELSE b.geometry_fingerprint END AS geometry_fingerprint
FROM plan p LEFT JOIN base_states b ON b.watershed_key = p.watershed_key LEFT JOIN target_states t ON t.watershed_key = p.watershed_key WHERE p.operation <> 'remove')
SELECT * FROM applied""",
    STATES,
)
def applied_watersheds(t):
    return release.apply_to_watersheds(
        t.base_states.select("watershed_key", "runid", "metadata_fingerprint", "geometry_fingerprint"), t.target_states, plan(t),
        ["metadata_fingerprint"], ["geometry_fingerprint"],
    )


@query(
    PLAN + """, b AS (SELECT 'w-' || o_custkey AS watershed_key, 'old' AS watershed_id, o_orderkey AS topazid FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1999),
t AS (SELECT 'w-' || o_custkey AS watershed_key, 'new' AS watershed_id, o_orderkey AS topazid FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 2001),
a AS (SELECT watershed_key, operation, after_runid, operation = 'add' OR (operation = 'change' AND contains(change_channels, 'children')) AS repl FROM plan)
SELECT b.watershed_key, COALESCE(a.after_runid, watershed_id) AS watershed_id, topazid FROM b JOIN a USING (watershed_key) WHERE operation <> 'remove' AND NOT repl
UNION ALL SELECT t.watershed_key, COALESCE(a.after_runid, watershed_id), topazid FROM t JOIN a USING (watershed_key) WHERE repl""",
    STATES,
)
def applied_children(t):
    rows = t.orders.select(
        F.concat(F.lit("w-"), F.col("o_custkey").cast("string")).alias("watershed_key"), F.col("o_orderkey").alias("topazid"),
        F.year("o_orderdate").alias("_y"),
    )
    side = lambda low, high, mark: rows.where(F.col("_y").between(low, high)).select(
        "watershed_key", F.lit(mark).alias("watershed_id"), "topazid"
    )
    return release.apply_to_children(side(1995, 1999, "old"), side(1997, 2001, "new"), plan(t))


# --- fingerprints ------------------------------------------------------------------------

FINGERPRINTED = {
    "region": [("r_name", "s"), ("r_regionkey", "n")],
    "nation": [("n_name", "s"), ("n_nationkey", "n"), ("n_regionkey", "n")],
    "supplier": [("s_acctbal", "d"), ("s_name", "s"), ("s_nationkey", "n"), ("s_suppkey", "n")],
    "customer": [("c_acctbal", "d"), ("c_custkey", "n"), ("c_mktsegment", "s"), ("c_name", "s"), ("c_nationkey", "n")],
    "part": [("p_brand", "s"), ("p_name", "s"), ("p_partkey", "n"), ("p_retailprice", "d"), ("p_size", "n"), ("p_type", "s")],
    "orders": [("o_custkey", "n"), ("o_orderkey", "n"), ("o_orderpriority", "s"), ("o_orderstatus", "s"), ("o_totalprice", "d")],
    "lineitem": [("l_discount", "d"), ("l_extendedprice", "d"), ("l_linenumber", "n"), ("l_linestatus", "s"), ("l_orderkey", "n"),
                 ("l_partkey", "n"), ("l_quantity", "d"), ("l_returnflag", "s"), ("l_suppkey", "n"), ("l_tax", "d")],
}


def row_json_sql(columns: list[tuple[str, str]]) -> str:
    parts = []
    for name, kind in columns:
        value = {"s": f"'\"' || {name} || '\"'", "n": name, "d": f"CAST({name} AS DECIMAL(18, 2))"}[kind]
        parts.append(f"'\"{name}\":' || {value}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def table_sql(name: str, where: str = "TRUE") -> str:
    return (
        f"SELECT '{name}' AS table_name, count(*) AS rows, md5(count(*) || ':' || COALESCE(sum(('0x' || substr(md5({row_json_sql(FINGERPRINTED[name])}), 1, 15))::BIGINT::HUGEINT), 0)) AS fingerprint "
        f"FROM {name} WHERE {where}"
    )


def fingerprint_rows(t, name: str):
    money = {c for c, kind in FINGERPRINTED[name] if kind == "d"}
    return getattr(t, name).select(*[
        F.col(c).cast("decimal(18,2)").alias(c) if c in money else F.col(c) for c, _ in FINGERPRINTED[name]
    ])


def all_fingerprints(t, keep=lambda name, df: df):
    from functools import reduce

    return reduce(
        lambda a, b: a.unionByName(b),
        [FP.table_fingerprint(keep(name, fingerprint_rows(t, name)), name) for name in FINGERPRINTED],
    )


@query(" UNION ALL ".join(table_sql(name) for name in FINGERPRINTED))
def table_fingerprint(t):
    return all_fingerprints(t)


@query(
    "WITH l AS (" + " UNION ALL ".join(table_sql(name) for name in FINGERPRINTED) + "), r AS ("
    + " UNION ALL ".join(table_sql(name, "l_quantity > 0 AND l_linenumber <> 7" if name == "lineitem" else "TRUE") for name in FINGERPRINTED if name != "part")
    + """) SELECT COALESCE(l.table_name, r.table_name) AS table_name, l.rows AS left_rows, r.rows AS right_rows, CASE WHEN l.table_name IS NULL THEN 'missing left' WHEN r.table_name IS NULL THEN 'missing right'
  WHEN l.fingerprint = r.fingerprint AND l.rows = r.rows THEN 'equal' ELSE 'differs' END AS finding FROM l FULL JOIN r ON l.table_name = r.table_name"""
)
def table_compare(t):
    # The second copy has lost one line number of every order, and one whole table.
    damaged = lambda name, df: df.where("l_linenumber <> 7") if name == "lineitem" else df
    return quality.compare_fingerprints(all_fingerprints(t), all_fingerprints(t, damaged).where("table_name <> 'part'"))


def digest_sql(source: str, group: str, key_text: str, line: str, subject: str, out: str) -> str:
    """The sequence digest in SQL, as a chain of CTEs ending in ``out``."""
    header = f"'{{\"fingerprint_version\":\"1\",\"subject\":\"{subject}\"}}' || chr(10)"
    sums = " || ".join(f"sum(('0x' || substr(h, {at}, 15))::BIGINT)::VARCHAR || chr(10)" for at in FP.SLICES)
    return f"""{out}_h AS (SELECT {group}, sha256({key_text} || chr(10) || {line}) AS h FROM {source}),
{out} AS (SELECT {group}, count(*) AS rows, sha256({header} || count(*) || chr(10) || {sums}) AS digest FROM {out}_h GROUP BY {group})"""


SUB_LINE = """'{"attributes":{"area":"' || regexp_replace(regexp_replace(CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR, '(\\.\\d*?)0+$', '\\1'), '\\.$', '') || '","texture":"' || nfc_normalize(o_orderpriority || CASE WHEN o_orderkey % 10 = 0 THEN 'e' || chr(769) ELSE '' END) || '"},"topazid":"' || o_orderkey || '","weppid":"' || o_custkey || '"}' || chr(10)"""
SUB_DIGEST = digest_sql("orders", "o_custkey", "o_orderkey::VARCHAR", SUB_LINE, "serving-subcatchments", "sd")


def subcatchment_digests(t):
    """Some textures are written with a letter and a mark of its own, which the digest composes."""
    texture = F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "e\u0301").otherwise(F.lit("")))
    line = json_line({
        "topazid": canonical_integer(F.col("o_orderkey")), "weppid": canonical_integer(F.col("o_custkey")),
        "attributes": F.struct(
            canonical_decimal(F.col("o_totalprice").cast("decimal(18,2)")).alias("area"), canonical_text(texture).alias("texture")
        ),
    })
    return FP.sequence_digest(t.orders, ["o_custkey"], ["o_orderkey"], line, "serving-subcatchments")


@query(f"WITH {SUB_DIGEST} SELECT * FROM sd")
def sequence_digest(t):
    return subcatchment_digests(t)


CHAN_LINE = """'{"order":"' || l_linenumber || '","topazid":"' || l_orderkey || '","weppid":"' || l_partkey || '"}' || chr(10)"""
CHAN_DIGEST = digest_sql(
    "lineitem", "l_suppkey", "l_orderkey || '|' || l_partkey || '|' || l_linenumber",
    CHAN_LINE, "serving-channels", "cd",
)


@query(f"WITH {CHAN_DIGEST} SELECT * FROM cd")
def channel_digest(t):
    return channel_digests(t)


def channel_digests(t):
    line = json_line({
        "topazid": canonical_integer(F.col("l_orderkey")), "weppid": canonical_integer(F.col("l_partkey")),
        "order": canonical_integer(F.col("l_linenumber")),
    })
    return FP.sequence_digest(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_partkey", "l_linenumber"], line, "serving-channels")


EMPTY = lambda subject: f"sha256('{{\"fingerprint_version\":\"1\",\"subject\":\"{subject}\"}}' || chr(10) || repeat('0' || chr(10), 5))"


@query(
    f"""WITH {SUB_DIGEST}, {CHAN_DIGEST},
w AS (SELECT 1 AS one, c_custkey, '{{"channels":"' || COALESCE(cd.digest, {EMPTY('serving-channels')}) || '","metadata":"' || c_name || '","runid":"' || c_custkey || '","subcatchments":"'
  || COALESCE(sd.digest, {EMPTY('serving-subcatchments')}) || '"}}' || chr(10) AS line FROM customer LEFT JOIN sd ON sd.o_custkey = c_custkey LEFT JOIN cd ON cd.l_suppkey = c_custkey),
{digest_sql('w', 'one', 'c_custkey::VARCHAR', 'line', 'serving-watershed-domain', 'dd')} SELECT rows, digest FROM dd"""
)
def domain_digest(t):
    rows = FP.with_child_digests(
        t.customer, "c_custkey",
        {
            "subcatchments": (subcatchment_digests(t).withColumnRenamed("o_custkey", "c_custkey"), "serving-subcatchments"),
            "channels": (channel_digests(t).withColumnRenamed("l_suppkey", "c_custkey"), "serving-channels"),
        },
    )
    return FP.domain_digest(rows, ["c_custkey"], {
        "runid": canonical_integer(F.col("c_custkey")), "metadata": canonical_text(F.col("c_name")),
        "subcatchments": F.col("subcatchments"), "channels": F.col("channels"),
    })


# --- quality -----------------------------------------------------------------------------


@query(
    """SELECT 'rel-' || r.r_regionkey AS release_id, COALESCE(sum(w), 0)::BIGINT AS watersheds, COALESCE(sum(s), 0)::BIGINT AS subcatchments, COALESCE(sum(h), 0)::BIGINT AS channels,
  COALESCE(sum(w), 0) = CASE WHEN max(r.r_regionkey) < 3 THEN COALESCE(sum(w), 0) ELSE -1 END AS equal
FROM region r LEFT JOIN (SELECT n_regionkey AS k, 1 AS w, count(*) AS s, count(*) FILTER (WHERE c_acctbal > 0) AS h FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 4 AND n_nationkey <> 9 GROUP BY n_nationkey, n_regionkey) x ON x.k = r.r_regionkey
GROUP BY r.r_regionkey""",
)
def release_totals(t):
    states = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).where("n_nationkey NOT IN (4, 9)").groupBy("n_nationkey", "n_regionkey").agg(
        F.count(F.lit(1)).alias("actual_subcatchments"), F.count_if(F.col("c_acctbal") > 0).alias("actual_channels")
    ).select(
        F.concat(F.lit("rel-"), F.col("n_regionkey").cast("string")).alias("release_id"), F.lit(1).alias("actual_watersheds"),
        "actual_subcatchments", "actual_channels",
    )
    sums = states.groupBy("release_id").agg(*[F.sum(f"actual_{c}").alias(f"actual_{c}") for c in COUNTS])
    releases = t.region.select(F.concat(F.lit("rel-"), F.col("r_regionkey").cast("string")).alias("release_id"), "r_regionkey").join(
        sums, "release_id", "left"
    ).select(
        "release_id", F.when(F.col("r_regionkey") < 3, F.coalesce("actual_watersheds", F.lit(0))).otherwise(F.lit(-1)).alias("actual_watersheds"),
        F.coalesce("actual_subcatchments", F.lit(0)).alias("actual_subcatchments"), F.coalesce("actual_channels", F.lit(0)).alias("actual_channels"),
    )
    return quality.release_totals(states, releases)


@query(
    """, led AS (SELECT 'r' || o_custkey AS runid, count(*) AS s, count(*) FILTER (WHERE o_orderstatus = 'P') AS h, count(*) FILTER (WHERE o_orderstatus = 'P') > 2 AS cap FROM orders WHERE year(o_orderdate) > 1995 GROUP BY o_custkey),
w AS (SELECT 'r' || c_custkey AS runid, 1 AS n FROM customer WHERE c_acctbal > -500),
s AS (SELECT 'r' || o_custkey AS runid, count(*) AS n FROM orders GROUP BY 1), h AS (SELECT 'r' || o_custkey AS runid, count(*) AS n FROM orders WHERE o_orderstatus = 'P' AND year(o_orderdate) > 1995 GROUP BY 1),
k AS (SELECT runid FROM w UNION SELECT runid FROM s UNION SELECT runid FROM h UNION SELECT runid FROM led),
j AS (SELECT k.runid, COALESCE(w.n, 0)::BIGINT AS watersheds, COALESCE(s.n, 0) AS subcatchments, COALESCE(h.n, 0) AS channels, CASE WHEN COALESCE(h.n, 0) > 2 THEN 1 ELSE 0 END::BIGINT AS capabilities, led.runid IS NOT NULL AS listed, led.s AS es, led.h AS eh, led.cap AS ec
  FROM k LEFT JOIN w USING (runid) LEFT JOIN s USING (runid) LEFT JOIN h USING (runid) LEFT JOIN led USING (runid))
SELECT runid, watersheds, subcatchments, channels, capabilities, listed AND watersheds = 1 AND subcatchments = COALESCE(es, 0) AND channels = COALESCE(eh, 0) AND capabilities = COALESCE(ec, FALSE)::INTEGER AS exact FROM j""",
    "watersheds",
)
def child_counts(t):
    run = lambda df, key: df.select(F.concat(F.lit("r"), F.col(key).cast("string")).alias("runid"))
    recent = t.orders.where(F.year("o_orderdate") > 1995)
    pending = recent.where("o_orderstatus = 'P'")
    ledger = recent.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("actual_subcatchments"), F.count_if(F.col("o_orderstatus") == "P").alias("actual_channels")
    ).select(
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("runid"), "actual_subcatchments", "actual_channels",
        F.when(F.col("actual_channels") > 2, "cap").alias("capability_fingerprint"),
    )
    capable = run(pending.groupBy("o_custkey").count().where("count > 2"), "o_custkey")
    return quality.child_counts(ledger, run(t.customer.where("c_acctbal > -500"), "c_custkey"), run(t.orders, "o_custkey"), run(pending, "o_custkey"), capable)


@query(
    """WITH c AS (SELECT user_id AS report_id, 'check-' || (event_id % 40) AS code, CASE WHEN value > 150 THEN 'failed' ELSE 'passed' END AS status FROM events),
g AS (SELECT report_id, code, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f FROM c GROUP BY 1, 2),
p AS (SELECT report_id, sum(n)::BIGINT AS checks, sum(f)::BIGINT AS failures, count(*) FILTER (WHERE n > 1) AS repeated_codes, array_to_string(list_sort(list(code) FILTER (WHERE f > 0)), ',') AS failed_codes FROM g GROUP BY 1)
SELECT c_custkey AS report_id, COALESCE(checks, 0) AS checks, COALESCE(failures, 0) AS failures, COALESCE(repeated_codes, 0) AS repeated_codes, COALESCE(failed_codes, '') AS failed_codes,
  CASE WHEN failures > 0 THEN 'failed' ELSE 'passed' END AS status, c_nationkey <= 20 AS times_ordered, 'token=[REDACTED] of ' || c_name AS summary FROM customer LEFT JOIN p ON p.report_id = c_custkey"""
)
def validation_report(t):
    checks = t.events.select(
        F.col("user_id").alias("report_id"), F.concat(F.lit("check-"), (F.col("event_id") % 40).cast("string")).alias("code"),
        F.when(F.col("value") > 150, "failed").otherwise(F.lit("passed")).alias("status"),
    )
    subjects = t.customer.select(
        F.col("c_custkey").alias("report_id"), F.col("c_nationkey").alias("started_at"), F.lit(20).alias("completed_at"),
        F.concat(F.lit("token = abc\n of "), "c_name").alias("summary"),
    )
    return quality.validation_report(checks, subjects)


@query(
    """WITH m AS (SELECT l_suppkey AS c, l_orderkey || '-' || l_partkey || '-' || l_linenumber AS pos, l_orderkey || '-' || l_partkey AS k, l_quantity AS q FROM lineitem),
i AS (SELECT c, pos, CASE WHEN c % 10 = 3 AND q = 50 THEN 'other' ELSE k END AS k FROM m WHERE NOT (c % 10 = 7 AND q = 1)
  UNION ALL SELECT s_suppkey + 1000000, '0', 'alone' FROM supplier WHERE s_acctbal < 0),
j AS (SELECT COALESCE(m.c, i.c) AS collection, m.k AS mk, i.k AS ik FROM m FULL JOIN i ON m.c = i.c AND m.pos = i.pos),
g AS (SELECT collection, count(mk) AS manifest_members, count(ik) AS index_members, count(*) FILTER (WHERE mk IS DISTINCT FROM ik) AS misplaced FROM j GROUP BY collection)
SELECT *, CASE WHEN manifest_members = 0 THEN 'release-index-collection' WHEN manifest_members <> index_members THEN 'release-index-count' WHEN misplaced > 0 THEN 'release-index-membership' ELSE 'consistent' END AS finding FROM g"""
)
def manifest_index(t):
    members = t.lineitem.select(
        F.col("l_suppkey").alias("collection"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("position"),
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("watershed_key"), "l_quantity",
    )
    # The index of some collections has lost members or names others in their place.
    last = F.col("collection") % 10
    index = members.where(~((last == 7) & (F.col("l_quantity") == 1))).withColumn(
        "watershed_key", F.when((last == 3) & (F.col("l_quantity") == 50), "other").otherwise(F.col("watershed_key"))
    )
    alone = t.supplier.where("s_acctbal < 0").select(
        (F.col("s_suppkey") + 1000000).alias("collection"), F.lit("0").alias("position"), F.lit("alone").alias("watershed_key")
    )
    return quality.manifest_index(members, index.drop("l_quantity").unionByName(alone))


@query(
    """, dom AS (SELECT watershed_key, runid, run_fingerprint, CASE WHEN actual_channels > 4 THEN 'other' ELSE capability_fingerprint END AS capability_fingerprint FROM target_states
  UNION ALL SELECT watershed_key, runid, run_fingerprint, capability_fingerprint FROM target_states WHERE actual_subcatchments = 1),
cap AS (SELECT watershed_key, runid, CASE WHEN actual_channels = 3 THEN 'z' ELSE capability_fingerprint END AS fp FROM target_states WHERE capability_fingerprint IS NOT NULL),
g AS (SELECT watershed_key, runid, count(*) AS n, min(run_fingerprint) AS r, min(capability_fingerprint) AS c FROM dom GROUP BY 1, 2)
SELECT 'c' AS collection, t.watershed_key, t.runid, CASE WHEN t.capability_fingerprint IS DISTINCT FROM cap.fp THEN 'run-capability-link' WHEN COALESCE(g.n, 0) <> 1 THEN 'domain-run-link'
  WHEN t.run_fingerprint IS DISTINCT FROM g.r OR t.capability_fingerprint IS DISTINCT FROM g.c THEN 'domain-fingerprint-link' ELSE 'linked' END AS finding
FROM target_states t LEFT JOIN cap USING (watershed_key, runid) LEFT JOIN g USING (watershed_key, runid)""",
    STATES,
)
def fingerprint_links(t):
    states = t.target_states
    fields = ["collection", "watershed_key", "runid", "run_fingerprint"]
    domain = states.select(*fields, F.when(F.col("actual_channels") > 4, "other").otherwise(F.col("capability_fingerprint")).alias("capability_fingerprint")).unionByName(
        states.where("actual_subcatchments = 1").select(*fields, "capability_fingerprint")
    )
    capabilities = states.where("capability_fingerprint IS NOT NULL").select(
        "collection", "watershed_key", "runid",
        F.when(F.col("actual_channels") == 3, "z").otherwise(F.col("capability_fingerprint")).alias("fingerprint"),
    )
    return quality.fingerprint_links(states, capabilities, domain)


@query(
    """WITH cap AS (SELECT 'r' || o_custkey AS runid, CASE WHEN max(o_orderpriority) = '5-LOW' THEN 'both' WHEN min(o_orderpriority) = '1-URGENT' THEN 'dynamic' ELSE 'precomputed' END AS mode,
    max(o_totalprice) > 100000 AS enabled, CASE WHEN min(o_totalprice) < 5000 THEN 'disabled' ELSE 'public' END AS policy, CASE WHEN count(*) > 18 THEN 'scenario-ids' END AS violation
  FROM orders WHERE year(o_orderdate) > 1996 AND o_orderstatus = 'O' GROUP BY o_custkey)
SELECT 'r' || c_custkey AS runid, CASE WHEN cap.runid IS NULL THEN 'none' WHEN violation IS NOT NULL THEN 'invalid' ELSE 'materialized' END AS source,
  COALESCE(violation IS NULL AND enabled AND policy = 'public', FALSE) AS available, COALESCE(violation IS NULL AND enabled AND policy = 'public' AND mode IN ('dynamic', 'both'), FALSE) AS supports_dynamic,
  COALESCE(violation IS NULL AND enabled AND policy = 'public' AND mode IN ('precomputed', 'both'), FALSE) AS supports_precomputed FROM customer LEFT JOIN cap ON cap.runid = 'r' || c_custkey"""
)
def visible_capabilities(t):
    run = lambda key: F.concat(F.lit("r"), F.col(key).cast("string")).alias("runid")
    # Three releases hold rows; only the one the pointer names may be seen.
    rows = t.orders.withColumn("release_id", F.when((F.col("o_orderstatus") == "O") & (F.year("o_orderdate") > 1996), "AFRICA")
                               .when(F.col("o_orderstatus") == "F", "old").otherwise(F.lit("before")))
    capabilities = rows.groupBy("release_id", run("o_custkey")).agg(
        F.when(F.max("o_orderpriority") == "5-LOW", "both").when(F.min("o_orderpriority") == "1-URGENT", "dynamic").otherwise(F.lit("precomputed")).alias("mode"),
        (F.max("o_totalprice") > 100000).alias("enabled"), F.when(F.min("o_totalprice") < 5000, "disabled").otherwise(F.lit("public")).alias("access_policy"),
        F.when(F.count(F.lit(1)) > 18, "scenario-ids").alias("violation"),
    ).withColumn("capability_type", F.lit("rhessys"))
    active = t.region.where("r_regionkey = 0").select(F.col("r_name").alias("release_id"))
    return quality.resolve_capabilities(capabilities, active, t.customer.select(run("c_custkey")), "rhessys")


@query(
    """SELECT 'rel-' || n_nationkey AS release_id, n_nationkey::INTEGER AS watersheds, n_regionkey::INTEGER AS subcatchments, 1 AS channels, COALESCE(runs, 0) AS runs, COALESCE(capabilities, 0) AS capabilities, n_nationkey = 7 AS active
FROM nation LEFT JOIN (SELECT c_nationkey AS k, count(*) AS runs, count(*) FILTER (WHERE c_acctbal > 5000) AS capabilities FROM (SELECT c_acctbal, CASE WHEN c_nationkey = 3 THEN 103 ELSE c_nationkey END AS c_nationkey FROM customer) GROUP BY 1) ON k = n_nationkey"""
)
def release_status(t):
    name = lambda key: F.concat(F.lit("rel-"), F.col(key).cast("string")).alias("release_id")
    releases = t.nation.select(
        name("n_nationkey"), F.col("n_nationkey").alias("actual_watersheds"), F.col("n_regionkey").alias("actual_subcatchments"), F.lit(1).alias("actual_channels")
    )
    # The states of one release name another that is not listed.
    states = t.customer.withColumn("c_nationkey", F.when(F.col("c_nationkey") == 3, 103).otherwise(F.col("c_nationkey"))).select(name("c_nationkey"), F.when(F.col("c_acctbal") > 5000, "cap").alias("capability_fingerprint"))
    return quality.release_status(releases, states, t.nation.where("n_nationkey = 7").select(name("n_nationkey")))


@query(
    """WITH p AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'patch' WHEN event_type = 'click' THEN 'basin' ELSE 'hillslope' END AS role, ['v' || user_id % 20, 'w' || user_id % 7] AS vs FROM events),
e AS (SELECT DISTINCT unnest(vs) AS variable, CASE WHEN role = 'patch' THEN 'patch' ELSE 'hillslope' END AS scale FROM p)
SELECT variable, array_to_string(list_sort(list(scale)), ',') AS scales FROM e GROUP BY variable"""
)
def variable_scales(t):
    name = lambda mark, n: F.concat(F.lit(mark), (F.col("user_id") % n).cast("string"))
    parquets = t.events.select(
        F.when(F.col("event_type") == "error", "patch").when(F.col("event_type") == "click", "basin").otherwise(F.lit("hillslope")).alias("role"),
        F.array(name("v", 20), name("w", 7)).alias("variables"),
    )
    return raster.variable_scales(parquets)


@query(
    """WITH g AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'hillslope' ELSE 'patch' END AS scale, n_nationkey AS position, ['S' || n_regionkey, 'S' || (n_regionkey + 1)] AS scenarios, 'rev-' || n_nationkey AS revision FROM nation),
l AS (SELECT scale, s AS scenario, min_by(revision, position) AS r FROM (SELECT scale, position, revision, unnest(scenarios) AS s FROM g) GROUP BY 1, 2),
a AS (SELECT scale, min_by(revision, position) AS r FROM g GROUP BY 1),
q AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'hillslope' ELSE 'patch' END AS scale, CASE WHEN event_type = 'error' THEN NULL ELSE 'S' || user_id % 8 END AS scenario FROM events)
SELECT event_id, q.scale, q.scenario, CASE WHEN q.scenario IS NULL THEN a.r ELSE l.r END AS revision,
  CASE WHEN q.scale = 'hillslope' THEN 'legacy-hillslope' WHEN q.scenario = 'S2' THEN 'legacy-2021' ELSE 'legacy-1985' END AS legacy
FROM q LEFT JOIN l ON l.scale = q.scale AND l.scenario = q.scenario LEFT JOIN a ON a.scale = q.scale"""
)
def geometry_choice(t):
    name = lambda column: F.concat(F.lit("S"), column.cast("string"))
    geometries = t.nation.select(
        F.when(F.col("n_nationkey") % 2 == 0, "hillslope").otherwise(F.lit("patch")).alias("scale"), F.col("n_nationkey").alias("position"),
        F.array(name(F.col("n_regionkey")), name(F.col("n_regionkey") + 1)).alias("scenarios"),
        F.concat(F.lit("rev-"), F.col("n_nationkey").cast("string")).alias("revision"),
    )
    requests = t.events.select(
        "event_id", F.when(F.col("user_id") % 2 == 0, "hillslope").otherwise(F.lit("patch")).alias("scale"),
        F.when(F.col("event_type") != "error", name(F.col("user_id") % 8)).alias("scenario"),
    )
    chosen = raster.sources_by_role(geometries, requests)
    return chosen.select("event_id", "scale", "scenario", "revision", raster.legacy_revision(F.col("scale"), F.col("scenario")).alias("legacy"))


@query(
    """SELECT runid, 'w-' || split_part(runid, ';;', 3) AS route_id, srcname, segment, COALESCE(logical_id, '') AS watershed_key FROM watersheds""",
    "watersheds",
)
def public_rows(t):
    return t.watersheds.select(
        "runid", F.concat(F.lit("w-"), F.split_part("runid", F.lit(";;"), F.lit(3))).alias("route_id"), "srcname", "segment",
        F.coalesce("logical_id", F.lit("")).alias("watershed_key"),
    )


@query(
    """SELECT 'channel:' || watershed_id || ':' || topazid || ':' || weppid || ':' || "order" AS stable_id, topazid, weppid, "order" FROM channels""",
    "channels",
)
def public_channels(t):
    from headwater.operators.projections import channel_rows

    return channel_rows(t.channels, F.col("watershed_id"))


# --- operations --------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_custkey AS env, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 500) AS seen, o_orderpriority AS act, o_totalprice AS avail FROM orders),
i AS (SELECT c_custkey AS env, CASE WHEN c_nationkey < 12 THEN '5-LOW' ELSE '1-URGENT' END AS rel, TIMESTAMP '1996-01-01' + INTERVAL 1 DAY * c_nationkey AS pub FROM customer),
w AS (SELECT k, act IS NOT DISTINCT FROM rel AS c1, CASE WHEN avail > 450000 THEN 'error' WHEN avail >= 100000 THEN 'passed' ELSE 'failed' END AS c2, avail / 2 - 60000 <= 100000 AS c3,
  epoch(seen)::BIGINT - epoch(pub)::BIGINT AS a4, (k % 500) * 3600 AS a5, env, seen FROM o LEFT JOIN i USING (env))
SELECT env AS environment, seen AS observed_at, code, status FROM (
  SELECT env, seen, unnest(['active-inventory-match', 'storage-capacity', 'storage-growth', 'artifact-age', 'backup-age']) AS code,
    unnest([CASE WHEN c1 THEN 'passed' ELSE 'failed' END, c2, CASE WHEN c3 THEN 'passed' ELSE 'failed' END,
      CASE WHEN a4 < 0 THEN 'error' WHEN a4 <= 720 * 3600 THEN 'passed' ELSE 'failed' END, CASE WHEN a5 <= 26 * 3600 THEN 'passed' ELSE 'failed' END]) AS status FROM w)"""
)
def health_checks(t):
    return health(t)


def health(t):
    hours = F.col("o_orderkey") % 500
    observations = t.orders.select(
        F.col("o_custkey").alias("environment"), (F.col("o_orderdate") + F.make_dt_interval(hours=hours.cast("int"))).alias("observed_at"),
        F.col("o_orderpriority").alias("active_release"), F.col("o_totalprice").alias("available"), F.lit(450000.0).alias("capacity"),
        (F.col("o_totalprice") / 2).alias("artifact_size"), F.lit(60000.0).alias("previous_artifact_size"), F.col("o_orderdate").alias("backup_at"),
    )
    inventory = t.customer.select(
        F.col("c_custkey").alias("environment"), F.when(F.col("c_nationkey") < 12, "5-LOW").otherwise(F.lit("1-URGENT")).alias("release_id"),
        (F.lit("1996-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("c_nationkey"))).alias("published_at"),
    )
    return operations.health_checks(observations, inventory, 100000, 100000, 720, 26)


@query(
    """WITH c AS (SELECT user_id AS env, ts AS seen, count(*) FILTER (WHERE value > 100) AS bad, count(*) AS n FROM events GROUP BY 1, 2)
SELECT env AS environment, seen AS observed_at, CASE WHEN bad = 0 THEN 'passed' ELSE 'failed' END AS status, bad AS not_passed FROM c"""
)
def health_status(t):
    checks = t.events.select(
        F.col("user_id").alias("environment"), F.col("ts").alias("observed_at"), F.when(F.col("value") > 100, "failed").otherwise(F.lit("passed")).alias("status")
    )
    return operations.health_status(checks)


@query(
    """WITH a AS (SELECT o_orderpriority AS kind, list_extract(['pending', 'running', 'failed', 'rollback_failed', 'planning', 'applying', 'succeeded'], (o_orderkey % 7 + 1)::INTEGER) AS status, o_orderdate AS updated, o_orderdate + INTERVAL 1 DAY AS expires, o_orderstatus = 'O' AS active FROM orders)
SELECT kind, count(*) AS attempts, count(*) FILTER (WHERE status IN ('failed', 'rollback_failed')) AS failed, count(*) FILTER (WHERE status IN ('pending', 'running', 'interrupted') AND TIMESTAMP '2000-01-01' - updated > INTERVAL 72 HOUR) AS abandoned,
  count(*) FILTER (WHERE active AND expires <= TIMESTAMP '2000-01-01' AND status IN ('planning', 'staging', 'applying')) AS expired_leases FROM a GROUP BY kind"""
)
def attempt_report(t):
    states = F.array(*[F.lit(s) for s in ("pending", "running", "failed", "rollback_failed", "planning", "applying", "succeeded")])
    attempts = t.orders.select(
        F.col("o_orderpriority").alias("kind"), F.get(states, (F.col("o_orderkey") % 7).cast("int")).alias("status"), F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderdate") + F.make_dt_interval(days=F.lit(1))).alias("lease_expires_at"), (F.col("o_orderstatus") == "O").alias("lease_active"),
    )
    return operations.attempt_report(attempts, F.lit("2000-01-01").cast("timestamp_ntz"), 72, ["kind"])


@query(
    """WITH s AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE 'rel-' || user_id END AS release_id, event_id AS snapshot_id, ts FROM events),
n AS (SELECT release_id, max_by(snapshot_id, {'t': ts, 's': snapshot_id}) AS newest FROM s WHERE release_id IS NOT NULL GROUP BY 1),
k AS (SELECT 'rel-' || c_custkey AS release_id FROM customer WHERE c_nationkey < 12)
SELECT s.release_id, snapshot_id, CASE WHEN snapshot_id = newest AND s.release_id IN (SELECT release_id FROM k) THEN 'keep' ELSE 'forget' END AS decision FROM s JOIN n USING (release_id)
UNION ALL SELECT release_id, NULL, 'missing' FROM k WHERE release_id NOT IN (SELECT release_id FROM n)"""
)
def latest_snapshot(t):
    snapshots = t.events.select(
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("rel-"), F.col("user_id").cast("string"))).alias("release_id"),
        F.col("event_id").alias("snapshot_id"), F.col("ts").alias("time"),
    )
    retained = t.customer.where("c_nationkey < 12").select(F.concat(F.lit("rel-"), F.col("c_custkey").cast("string")).alias("release_id"))
    return operations.snapshot_retention(snapshots, retained)


@query("SELECT event_type, max_by(event_id, ts) AS event_id, max(ts) AS ts FROM events GROUP BY event_type")
def newest_event(t):
    return operations.newest_per_group(t.events, ["event_type"], "ts", "event_id")


@query(
    r"""WITH f AS (SELECT page_id AS k, CASE WHEN page_id % 3 = 0 THEN COALESCE(url, '') ELSE COALESCE(html, '') END AS body FROM pages),
h AS (SELECT k, lower(regexp_replace(substr(body, 1, 1024), '^\s+', '')) AS head FROM f)
SELECT '/objects/' || CASE k % 11 WHEN 5 THEN 'gone-' ELSE '' END || k AS path, CASE WHEN k % 7 = 2 THEN 'soils' ELSE 'metadata' END AS role,
  CASE WHEN k % 11 = 5 THEN 'missing' WHEN k % 7 = 4 THEN 'artifact-uri-safe' WHEN k % 7 = 2 THEN 'media-type' WHEN k % 7 = 3 THEN 'size' WHEN k % 7 = 1 THEN 'sha256'
    WHEN starts_with(head, '<!doctype html') OR starts_with(head, '<html') OR starts_with(head, '<head') OR starts_with(head, '<body') THEN 'artifact-not-html' ELSE 'verified' END AS finding FROM h"""
)
def artifact_verify(t):
    """Pages as stored files, verified against lineage rows with some damage."""
    number = F.col("page_id")
    content = F.encode(F.coalesce(F.when(number % 3 == 0, F.col("url")).otherwise(F.col("html")), F.lit("")), "UTF-8")
    files = t.pages.select(
        F.concat(F.lit("/objects/"), number.cast("string")).alias("path"), F.octet_length(content).cast("bigint").alias("length"),
        F.sha2(content, 256).alias("sha256"), F.substring(content, 1, 4096).alias("head"),
    )
    kind = lambda n: number % 7 == n
    lineage = t.pages.select(
        F.concat(F.lit("/objects/"), F.when(number % 11 == 5, "gone-").otherwise(F.lit("")), number.cast("string")).alias("path"),
        F.when(kind(2), "soils").otherwise(F.lit("metadata")).alias("role"),
        F.concat(F.when(kind(4), "http").otherwise(F.lit("https")), F.lit("://example.test/"), number.cast("string")).alias("uri"),
        F.when(kind(1), F.sha2("url", 224)).otherwise(F.sha2(content, 256)).alias("sha256"),
        (F.octet_length(content) + F.when(kind(3), 1).otherwise(F.lit(0))).cast("bigint").alias("byte_size"), F.lit("application/json").alias("media_type"),
    )
    return quality.verify_artifacts(files, lineage)


@query(
    """WITH d AS (SELECT o_custkey AS document_id, o_orderpriority AS ck, o_orderkey // 3 AS wk, o_orderstatus AS st FROM orders),
col AS (SELECT document_id, ck, count(*) + CASE WHEN document_id % 9 = 0 THEN 1 ELSE 0 END AS e FROM d GROUP BY 1, 2),
rem AS (SELECT document_id, wk + CASE WHEN document_id % 4 = 0 THEN 0 ELSE 100000000 END AS wk FROM d WHERE st = 'P'),
v AS (SELECT document_id, 'member-count-mismatch' AS rule, count(*) AS broken FROM col WHERE document_id % 9 = 0 GROUP BY 1
  UNION ALL SELECT document_id, 'duplicate-watershed-key', sum(c - 1)::BIGINT FROM (SELECT document_id, wk, count(*) AS c FROM d GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT document_id, 'duplicate-removal-key', sum(c - 1)::BIGINT FROM (SELECT document_id, wk, count(*) AS c FROM rem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT document_id, 'target-overlapping-removal', count(*) FROM rem r WHERE EXISTS (SELECT 1 FROM d WHERE d.document_id = r.document_id AND d.wk = r.wk) GROUP BY 1
  UNION ALL SELECT document_id, 'duplicate-lineage-event', sum(c - 1)::BIGINT FROM (SELECT document_id, CASE WHEN ck = '5-LOW' THEN st ELSE st || '-' || wk END AS st, count(*) AS c FROM d GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1)
SELECT * FROM v"""
)
def document_rules(t):
    rows = t.orders.select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("collection_key"),
        F.floor(F.col("o_orderkey") / 3).alias("watershed_key"), F.col("o_orderstatus").alias("event_key"),
    )
    collections = rows.groupBy("document_id", "collection_key").agg(
        (F.count(F.lit(1)) + F.when(F.col("document_id") % 9 == 0, 1).otherwise(F.lit(0))).alias("expected_member_count")
    )
    removals = rows.where("event_key = 'P'").select(
        "document_id", (F.col("watershed_key") + F.when(F.col("document_id") % 4 == 0, 0).otherwise(F.lit(100000000))).alias("watershed_key")
    )
    # Events of one collection are told by their status alone and repeat, the others hardly ever.
    events = rows.withColumn("event_key", F.when(F.col("collection_key") == "5-LOW", F.col("event_key")).otherwise(F.concat_ws("-", "event_key", F.col("watershed_key").cast("string"))))
    return quality.manifest_violations(collections, rows, removals, events)
