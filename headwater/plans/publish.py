"""Write, audit, publish: REL-07 with REL-11 and REL-14 over all serving tables.

A plan is applied to the serving tables of a release and written as a version of its own. The digests of
what was written are computed again and compared with the ledger. Only if nothing differs does the pointer
move, so that readers see the old version or the new one and nothing between. Conflicts and differences are
rows; a refused or failed attempt leaves the pointer where it was and can be repeated.

Tables: ``watersheds`` (watershed_key, runid, columns of the shape), ``subcatchments`` and ``channels``
(watershed_key, watershed_id, own columns), ``capabilities`` (release_id, watershed_key, runid, own columns),
``identities`` (watershed_key, status) and ``aliases`` (runid, identity_id, is_current).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.functions.canonical import json_line
from headwater.operators import fingerprint as FP
from headwater.plans import release
from headwater.session import checkpoint

KINDS = ["subcatchments", "channels", "capabilities"]
DOMAIN = "serving-watershed-domain"
# The parts of a run's line, and so what the ledger of a release lists per run.
PARTS = [
    "runid", "metadata_fingerprint", "geometry_fingerprint", "subcatchment_fingerprint", "channel_fingerprint", "capability_fingerprint",
]
COUNTS = ["actual_subcatchments", "actual_channels", "actual_capabilities"]
LEDGER = ["run_fingerprint", *PARTS, *COUNTS]
_PART_OF = {"subcatchments": "subcatchment", "channels": "channel", "capabilities": "capability"}


@dataclass(frozen=True)
class Lines:
    """How the rows of a table of children are ordered and rendered."""

    order: list[str]
    line: Column


@dataclass(frozen=True)
class Shape:
    """The columns of the watershed table by channel, their lines, and the lines of the children."""

    metadata: list[str]
    geometry: list[str]
    metadata_line: Column
    geometry_line: Column
    children: dict[str, Lines]
    derived: dict[str, Callable[[Column], Column]] = field(default_factory=dict)


def run_states(tables: dict[str, DataFrame], shape: Shape) -> DataFrame:
    """AGG-23, first level: per watershed its run, the digest of every part and the counts, in the form plans take.

    Children are summed per watershed before they meet it, so a hot watershed is a row per task. No rows of a
    kind give the digest of the empty sequence; without capabilities that part is null.
    """
    rows = tables["watersheds"].select(
        "watershed_key", "runid", F.sha2(shape.metadata_line, 256).alias("metadata_fingerprint"), F.sha2(shape.geometry_line, 256).alias("geometry_fingerprint"),
    )
    for kind in KINDS:
        lines, part = shape.children[kind], _PART_OF[kind]
        own = FP.sequence_digest(tables[kind], ["watershed_key"], lines.order, lines.line, f"serving-{kind}").select(
            "watershed_key", F.col("digest").alias(f"_{kind}"), F.col("rows").alias(f"_{kind}_rows")
        )
        none = F.lit(None).cast("string") if kind == "capabilities" else FP.empty_digest(f"serving-{kind}")
        rows = rows.join(own, "watershed_key", "left").withColumns({
            f"{part}_fingerprint": F.coalesce(f"_{kind}", none), f"actual_{kind}": F.coalesce(f"_{kind}_rows", F.lit(0)).cast("bigint"),
        }).drop(f"_{kind}", f"_{kind}_rows")
    line = json_line({name.removesuffix("_fingerprint"): F.col(name) for name in PARTS})
    return rows.withColumns({
        "run_fingerprint": F.sha2(line, 256), "collection": F.lit("serving"), "actual_watersheds": F.lit(1),
        **{f"{name}_fingerprint": F.lit(None).cast("string") for name in ("hillslope", "soil", "landuse")},
    })


def run_sums(states: DataFrame) -> DataFrame:
    """AGG-23, second level, in a form to keep: per watershed the hash slices of its line in the domain."""
    line = json_line({"run": F.col("run_fingerprint"), "watershed": F.col("watershed_key")})
    return FP.sequence_sums(states.withColumn("_line", line), ["watershed_key"], ["watershed_key"], F.col("_line"))


def domain_digest(sums: DataFrame) -> DataFrame:
    """The digest of a domain from the kept sums of its watersheds, one row."""
    return FP.closed_sums(FP.combined_sums([(sums, 1)], []), [], DOMAIN)


def moved_domain(total: DataFrame, kept: DataFrame, plan: DataFrame, staged: dict[str, DataFrame], shape: Shape) -> DataFrame:
    """The digest of the domain after a plan, without reading any run that the plan retains.

    ``total`` is the one row of summed slices before, ``kept`` the rows of ``run_sums`` before. Those of watersheds
    that are removed or changed are taken away; added and changed ones are computed from their staged rows.
    """
    touched = plan.where(F.col("operation") != "retain").select("watershed_key", "operation")
    gone = kept.join(touched, "watershed_key", "left_semi")
    fresh = touched.where(F.col("operation") != "remove").select("watershed_key")
    new = {name: staged[name].join(fresh, "watershed_key", "left_semi") for name in ("watersheds", *KINDS)}
    return FP.closed_sums(FP.combined_sums([(total, 1), (gone, -1), (run_sums(run_states(new, shape)), 1)], []), [], DOMAIN)


def applied(serving: dict[str, DataFrame], staged: dict[str, DataFrame], plan: DataFrame, release_id: str, shape: Shape) -> dict[str, DataFrame]:
    """REL-07: every serving table after the plan."""
    return {
        "watersheds": release.apply_to_watersheds(serving["watersheds"], staged["watersheds"], plan, shape.metadata, shape.geometry, shape.derived),
        **{kind: release.apply_to_children(serving[kind], staged[kind], plan) for kind in ("subcatchments", "channels")},
        "capabilities": release.apply_to_capabilities(serving["capabilities"], staged["capabilities"], release_id),
        "identities": release.apply_to_identities(serving["identities"], plan),
        "aliases": release.apply_to_aliases(serving["aliases"], plan),
    }


def of_release(tables: dict[str, DataFrame], release_id: str) -> dict[str, DataFrame]:
    """The tables with the capabilities of one release only, as its states count them."""
    return {**tables, "capabilities": tables["capabilities"].where(F.col("release_id") == release_id)}


def audit(tables: dict[str, DataFrame], ledger: DataFrame, shape: Shape, release_id: str) -> DataFrame:
    """REL-11 and REL-14: (watershed_key, rule, expected, observed) of everything that differs from the ledger.

    States are computed from the tables themselves. A run is compared in every part and count; the domain as a
    whole by its digest, under a null key.
    """
    states = checkpoint(run_states(of_release(tables, release_id), shape).select("watershed_key", *LEDGER))
    joined = states.select("watershed_key", F.struct(*LEDGER).alias("_o")).join(
        ledger.select("watershed_key", F.struct(*LEDGER).alias("_l")), "watershed_key", "full_outer"
    )
    difference = lambda name: F.struct(F.lit(name).alias("rule"), F.col(f"_l.{name}").cast("string").alias("expected"), F.col(f"_o.{name}").cast("string").alias("observed"))
    found = (
        F.when(F.col("_l").isNull(), F.array(difference("runid").withField("rule", F.lit("unlisted"))))
        .when(F.col("_o").isNull(), F.array(difference("runid").withField("rule", F.lit("absent"))))
        .otherwise(F.array_compact(F.array(*[F.when(~F.col(f"_o.{n}").eqNullSafe(F.col(f"_l.{n}")), difference(n)) for n in LEDGER])))
    )
    runs = joined.select("watershed_key", F.explode(found).alias("_f")).select("watershed_key", "_f.*")
    whole = lambda df, name: domain_digest(run_sums(df)).select(F.concat_ws(":", F.col("rows").cast("string"), "digest").alias(name), F.lit(1).alias("_one"))
    domain = whole(ledger, "expected").join(whole(states, "observed"), "_one").where("expected <> observed").select(
        F.lit(None).cast("string").alias("watershed_key"), F.lit("domain").alias("rule"), "expected", "observed"
    )
    return runs.unionByName(domain)


# -- versions and the pointer ---------------------------------------------------------------------------

def version(root: str, release_id: str, name: str) -> str:
    return f"{root}/release={release_id}/{name}"


def read_version(spark: SparkSession, root: str, release_id: str, schemas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a written release; ``schemas`` gives the names and columns."""
    return {name: spark.read.schema(df.schema).parquet(version(root, release_id, name)) for name, df in schemas.items()}


def active_release(spark: SparkSession, root: str) -> str | None:
    """The release the pointer names: the entry of the highest number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    entries = spark.read.schema("number long, release_id string").parquet(f"{root}/pointer")
    return entries.agg(F.max_by("release_id", "number")).first()[0]


def move_pointer(spark: SparkSession, root: str, release_id: str) -> None:
    """One more entry of one file, which appears at once; entries are never rewritten."""
    entries = 0 if active_release(spark, root) is None else spark.read.schema("number long, release_id string").parquet(f"{root}/pointer").agg(F.max("number")).first()[0]
    spark.createDataFrame([(entries + 1, release_id)], "number long, release_id string").coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def start(spark: SparkSession, root: str, release_id: str, tables: dict[str, DataFrame]) -> None:
    """The first release, written and made current."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(version(root, release_id, name))
    move_pointer(spark, root, release_id)


def publish(
    spark: SparkSession, root: str, release_id: str, serving: dict[str, DataFrame], staged: dict[str, DataFrame], plan: DataFrame,
    ledger: DataFrame, shape: Shape,
) -> DataFrame:
    """Apply ``plan`` to the serving tables and make the result current: (stage, watershed_key, rule, expected, observed).

    No rows: done. Rows of stage ``plan``: the base has drifted, nothing was written. Rows of stage ``audit``: the
    written version differs from the ledger; it stays for inspection, the pointer has not moved. The release that is
    current is never written over.
    """
    if active_release(spark, root) == release_id:
        raise ValueError(f"release {release_id} is current and cannot be written again")
    staging = lambda df, name: df.select(F.lit(name).alias("stage"), "*")
    conflicts = checkpoint(release.apply_conflicts(serving["watersheds"], staged["watersheds"], plan))
    if not conflicts.isEmpty():
        return staging(conflicts, "plan")
    made = applied(serving, staged, plan, release_id, shape)
    for name, df in made.items():
        df.write.mode("overwrite").parquet(version(root, release_id, name))
    differences = audit(read_version(spark, root, release_id, made), ledger, shape, release_id)
    differences.write.mode("overwrite").parquet(version(root, release_id, "audit"))
    written = spark.read.schema(differences.schema).parquet(version(root, release_id, "audit"))
    if written.isEmpty():
        move_pointer(spark, root, release_id)
    return staging(written, "audit")
