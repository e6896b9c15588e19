"""Queries that apply a plan to whole serving tables, verify what came out, and publish it."""

from __future__ import annotations

from pyspark.sql import functions as F

from headwater.catalog.registry import query
from headwater.catalog.releases import EMPTY, PLAN, digest_sql
from headwater.functions import geometry as G
from headwater.functions.canonical import canonical_decimal, canonical_integer, canonical_text, json_line
from headwater.plans import publish, release
from headwater.session import checkpoint, shared_folder

BASE, TARGET = (1995, 1999, "2025"), (1997, 2001, "2026")


def _decimal(value):
    return canonical_decimal(value.cast("decimal(28,12)"))


def shape():
    return publish.Shape(
        metadata=["name"], geometry=["geometry"],
        metadata_line=json_line({"name": canonical_text(F.col("name"))}),
        geometry_line=json_line({"ring": F.array_join(F.transform(G.points(F.col("geometry")), lambda p: F.concat_ws(" ", _decimal(p["x"]), _decimal(p["y"]))), ",")}),
        children={
            "subcatchments": publish.Lines(["topazid"], json_line({
                "area": canonical_decimal(F.col("area").cast("decimal(18,2)")), "texture": canonical_text(F.col("texture")), "topazid": canonical_integer(F.col("topazid"))})),
            "channels": publish.Lines(["topazid"], json_line({"order": canonical_integer(F.col("order")), "topazid": canonical_integer(F.col("topazid"))})),
            "capabilities": publish.Lines(["type"], json_line({"rows": canonical_integer(F.col("rows")), "type": canonical_text(F.col("type"))})),
        },
    )


def serving(t, first: int, last: int, release_id: str) -> dict:
    """The tables of a release: customers with orders in a span of years, their orders as children."""
    customer = F.col("o_custkey").cast("string")
    rows = t.orders.where(F.year("o_orderdate").between(first, last)).withColumns({
        "watershed_key": F.concat(F.lit("w-"), customer),
        "runid": F.concat(F.lit("run-"), customer, F.lit("-"), F.when(F.col("o_custkey") % 3 == 0, release_id).otherwise(F.lit("r"))),
    })
    built = rows.groupBy("watershed_key", "runid").agg(F.min("o_orderpriority").alias("name"), F.min("o_orderkey").alias("lo"), F.count(F.lit(1)).alias("n"))
    x, y, width = F.col("lo") % 17900 / F.lit(-100.0), F.col("lo") % 8900 / F.lit(100.0), (F.col("n") % 50 + 1) / F.lit(100.0)
    corner = lambda a, b: F.struct((x + width * a).alias("x"), (y + width * b).alias("y"))
    ring = F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    pending = rows.where("o_orderstatus = 'P'")
    return {
        "watersheds": built.select("watershed_key", "runid", "name", F.array(F.array(ring)).alias("geometry")),
        "subcatchments": rows.select(
            "watershed_key", F.col("runid").alias("watershed_id"), F.col("o_orderkey").alias("topazid"), F.col("o_totalprice").alias("area"), F.col("o_orderpriority").alias("texture")),
        "channels": pending.select("watershed_key", F.col("runid").alias("watershed_id"), F.col("o_orderkey").alias("topazid"), F.month("o_orderdate").alias("order")),
        "capabilities": pending.groupBy("watershed_key", "runid", F.col("o_orderpriority").alias("type")).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(release_id).alias("release_id"), "watershed_key", "runid", "type", "rows"),
        "identities": t.customer.select(F.concat(F.lit("w-"), F.col("c_custkey").cast("string")).alias("watershed_key"), F.lit("active").alias("status")),
        "aliases": built.select("runid", F.col("watershed_key").alias("identity_id"), F.lit(True).alias("is_current")),
    }


def _dec(value: str) -> str:
    return f"regexp_replace(regexp_replace(CAST({value} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


def serving_sql(first: int, last: int, release_id: str, p: str) -> str:
    """CTEs of the same tables and their states, named with a prefix and ending in ``<p>_states``."""
    corners = " || ',' || ".join(
        f"{_dec(f'CAST(x + width * {a} AS DECIMAL(28,12))')} || ' ' || {_dec(f'CAST(y + width * {b} AS DECIMAL(28,12))')}" for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    )
    sub_line = f"""'{{"area":"' || {_dec('CAST(o_totalprice AS DECIMAL(18,2))')} || '","texture":"' || o_orderpriority || '","topazid":"' || o_orderkey || '"}}' || chr(10)"""
    chan_line = """'{"order":"' || month(o_orderdate) || '","topazid":"' || o_orderkey || '"}' || chr(10)"""
    cap_line = """'{"rows":"' || n || '","type":"' || type || '"}' || chr(10)"""
    return f"""{p}_rows AS (SELECT *, 'w-' || o_custkey AS watershed_key, 'run-' || o_custkey || '-' || CASE WHEN o_custkey % 3 = 0 THEN '{release_id}' ELSE 'r' END AS runid
  FROM orders WHERE year(o_orderdate) BETWEEN {first} AND {last}),
{p}_pending AS (SELECT * FROM {p}_rows WHERE o_orderstatus = 'P'),
{p}_built AS (SELECT watershed_key, runid, min(o_orderpriority) AS name, min(o_orderkey) AS lo, count(*) AS n FROM {p}_rows GROUP BY ALL),
{p}_shapes AS (SELECT watershed_key, runid, name, lo % 17900 / -100.0::DOUBLE AS x, lo % 8900 / 100.0::DOUBLE AS y, (n % 50 + 1) / 100.0::DOUBLE AS width FROM {p}_built),
{p}_caps AS (SELECT watershed_key, runid, o_orderpriority AS type, count(*) AS n FROM {p}_pending GROUP BY ALL),
{digest_sql(f'{p}_rows', 'watershed_key', 'o_orderkey::VARCHAR', sub_line, 'serving-subcatchments', f'{p}_sd')},
{digest_sql(f'{p}_pending', 'watershed_key', 'o_orderkey::VARCHAR', chan_line, 'serving-channels', f'{p}_cd')},
{digest_sql(f'{p}_caps', 'watershed_key', 'type', cap_line, 'serving-capabilities', f'{p}_kd')},
{p}_parts AS (SELECT w.watershed_key, w.runid, sha256('{{"name":"' || name || '"}}' || chr(10)) AS metadata_fingerprint, sha256('{{"ring":"' || {corners} || '"}}' || chr(10)) AS geometry_fingerprint,
  sd.digest AS subcatchment_fingerprint, COALESCE(cd.digest, {EMPTY('serving-channels')}) AS channel_fingerprint, kd.digest AS capability_fingerprint,
  sd.rows AS actual_subcatchments, COALESCE(cd.rows, 0) AS actual_channels, COALESCE(kd.rows, 0) AS actual_capabilities
  FROM {p}_shapes w JOIN {p}_sd sd ON sd.watershed_key = w.watershed_key LEFT JOIN {p}_cd cd ON cd.watershed_key = w.watershed_key LEFT JOIN {p}_kd kd ON kd.watershed_key = w.watershed_key),
{p}_states AS (SELECT *, sha256('{{"capability":' || COALESCE('"' || capability_fingerprint || '"', 'null') || ',"channel":"' || channel_fingerprint || '","geometry":"' || geometry_fingerprint
  || '","metadata":"' || metadata_fingerprint || '","runid":"' || runid || '","subcatchment":"' || subcatchment_fingerprint || '"}}' || chr(10)) AS run_fingerprint, 1 AS one FROM {p}_parts)"""


LINE = """'{"run":"' || run_fingerprint || '","watershed":"' || watershed_key || '"}' || chr(10)"""
BASE_SQL, TARGET_SQL = serving_sql(*BASE, "b"), serving_sql(*TARGET, "t")


def both(t):
    """Base and target tables, their states, and the plan between them. States are written: everything reads them."""
    base, target = serving(t, *BASE), serving(t, *TARGET)
    before, after = checkpoint(publish.run_states(base, shape())), checkpoint(publish.run_states(target, shape()))
    return base, target, before, after, release.plan_forward(before, after)


@query(
    f"""WITH {BASE_SQL}, {TARGET_SQL} SELECT '2025' AS release_id, watershed_key, runid, type, n AS rows FROM b_caps
UNION ALL SELECT '2026', watershed_key, runid, type, n FROM t_caps"""
)
def applied_capabilities(t):
    base, target = serving(t, *BASE), serving(t, *TARGET)
    # The serving table already holds rows of the target release, left by an attempt that failed: they go.
    stale = base["capabilities"].withColumns({"release_id": F.lit(TARGET[2]), "rows": F.col("rows") + 1})
    return release.apply_to_capabilities(base["capabilities"].unionByName(stale), target["capabilities"], TARGET[2])


@query(
    PLAN + """, cs AS (SELECT CASE WHEN actual_subcatchments = 7 THEN 'x' || watershed_key ELSE watershed_key END AS watershed_key,
    CASE WHEN actual_subcatchments = 5 THEN runid || '-old' ELSE runid END AS runid, actual_subcatchments AS n FROM base_states),
cd AS (SELECT watershed_key, runid FROM cs UNION ALL SELECT watershed_key, runid FROM cs WHERE n = 6),
cg AS (SELECT watershed_key, count(*) AS n, min(runid) AS runid FROM cd GROUP BY 1),
cz AS (SELECT CASE WHEN actual_subcatchments = 9 THEN 'y' || watershed_key ELSE watershed_key END AS watershed_key, CASE WHEN actual_subcatchments = 8 THEN 'other' ELSE runid END AS runid FROM target_states),
cj AS (SELECT COALESCE(p.watershed_key, g.watershed_key) AS watershed_key, operation, before_runid, after_runid, g.n, g.runid AS serving, z.runid AS staged
  FROM plan p FULL JOIN cg g ON p.watershed_key = g.watershed_key LEFT JOIN cz z ON z.watershed_key = COALESCE(p.watershed_key, g.watershed_key))
SELECT watershed_key, 'unplanned' AS rule, NULL::VARCHAR AS expected, serving AS observed FROM cj WHERE operation IS NULL
UNION ALL SELECT watershed_key, 'repeated', before_runid, serving FROM cj WHERE n > 1
UNION ALL SELECT watershed_key, 'absent', before_runid, NULL FROM cj WHERE operation <> 'add' AND n IS NULL
UNION ALL SELECT watershed_key, 'drifted', before_runid, serving FROM cj WHERE operation <> 'add' AND serving <> before_runid
UNION ALL SELECT watershed_key, 'present', NULL, serving FROM cj WHERE operation = 'add' AND n IS NOT NULL
UNION ALL SELECT watershed_key, 'unstaged', after_runid, NULL FROM cj WHERE operation <> 'remove' AND staged IS NULL
UNION ALL SELECT watershed_key, 'staged-run', after_runid, staged FROM cj WHERE operation <> 'remove' AND staged <> after_runid""",
    "base_states target_states",
)
def apply_conflicts(t):
    n = F.col("actual_subcatchments")
    key, run = F.col("watershed_key"), F.col("runid")
    drifted = t.base_states.select(
        F.when(n == 7, F.concat(F.lit("x"), key)).otherwise(key).alias("watershed_key"), F.when(n == 5, F.concat(run, F.lit("-old"))).otherwise(run).alias("runid"),
        F.explode(F.when(n == 6, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    staged = t.target_states.select(
        F.when(n == 9, F.concat(F.lit("y"), key)).otherwise(key).alias("watershed_key"), F.when(n == 8, "other").otherwise(run).alias("runid"))
    return release.apply_conflicts(drifted, staged, release.plan_forward(t.base_states, t.target_states))


@query(
    f"""WITH {TARGET_SQL}, l AS (SELECT *, actual_subcatchments % 9 = 2 AS wrong FROM t_states)
SELECT watershed_key, run_fingerprint, CASE WHEN wrong THEN 'differs' ELSE 'equal' END AS status, CASE WHEN wrong THEN 'metadata_fingerprint,actual_channels' ELSE '' END AS fields FROM l"""
)
def apply_verified(t):
    """The applied tables' own digests against the ledger; the ledger of some runs is wrong in two figures."""
    base, target, _, after, plan = both(t)
    made = publish.applied(base, target, checkpoint(plan), TARGET[2], shape())
    observed = checkpoint(publish.run_states(publish.of_release(made, TARGET[2]), shape()))
    wrong = F.col("actual_subcatchments") % 9 == 2
    ledger = after.withColumns({
        "metadata_fingerprint": F.when(wrong, "other").otherwise(F.col("metadata_fingerprint")),
        "actual_channels": F.col("actual_channels") + F.when(wrong, 1).otherwise(F.lit(0)),
    })
    found = release.ledger_check(observed, ledger, "watershed_key", publish.LEDGER)
    return found.join(observed.select("watershed_key", "run_fingerprint"), "watershed_key")


@query(f"WITH {TARGET_SQL}, {digest_sql('t_states', 'one', 'watershed_key', LINE, publish.DOMAIN, 'dd')} SELECT rows, digest FROM dd")
def moved_domain(t):
    """The target's domain digest from the base's kept sums and the watersheds the plan touches."""
    _, target, before, _, plan = both(t)
    kept = checkpoint(publish.run_sums(before))
    total = publish.FP.combined_sums([(kept, 1)], [])
    return publish.moved_domain(total, kept, checkpoint(plan), target, shape())


@query(
    f"""WITH {BASE_SQL}, {TARGET_SQL},
n AS (SELECT 'watersheds' AS table_name, count(*) AS rows FROM t_states UNION ALL SELECT 'subcatchments', count(*) FROM t_rows UNION ALL SELECT 'channels', count(*) FROM t_pending
  UNION ALL SELECT 'capabilities', (SELECT count(*) FROM b_caps) + (SELECT count(*) FROM t_caps)
  UNION ALL SELECT 'identities', count(*) FROM customer
  UNION ALL SELECT 'aliases', count(*) FROM (SELECT runid FROM b_built UNION SELECT runid FROM t_built))
SELECT table_name, rows, TRUE AS drifted_refused, FALSE AS differs, '2026' AS active_release FROM n"""
)
def published_release(t):
    """The whole step: the base written and current, a drifted base refused, then the plan applied, audited, made current."""
    base, target, _, after, plan = both(t)
    plan, root = checkpoint(plan), shared_folder(t.spark)
    publish.start(t.spark, root, BASE[2], base)
    current = publish.read_version(t.spark, root, BASE[2], base)
    moved = {**current, "watersheds": current["watersheds"].withColumn("runid", F.concat(F.lit("x"), "runid"))}
    refused = publish.publish(t.spark, root, TARGET[2], moved, target, plan, after, shape())
    stayed = not refused.isEmpty() and publish.active_release(t.spark, root) == BASE[2]
    differences = publish.publish(t.spark, root, TARGET[2], current, target, plan, after, shape())
    tables = publish.read_version(t.spark, root, publish.active_release(t.spark, root), base)
    counts = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts.withColumns({"drifted_refused": F.lit(stayed), "differs": F.lit(not differences.isEmpty()), "active_release": F.lit(publish.active_release(t.spark, root))})
