"""REL-12: semantic fingerprints of release documents given as JSON text.

Each document is parsed once to a struct, its lists are put in a fixed order, fields that do
not matter (addresses, times, release ids) are left out, and the canonical line is hashed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.functions.canonical import FINGERPRINT_VERSION, canonical_decimal, composed_document, json_line

_NUMBER = "decimal(38,18)"
_ARTIFACT = "struct<sha256:string,bytes:bigint,media_type:string>"

SCHEMAS = {
    "artifact": _ARTIFACT,
    "run": f"""struct<collection_key:string,watershed_key:string,runid:string,display_name:string,aliases:array<string>,
        artifact_fingerprints:map<string,string>,transformation_lineage_fingerprint:string,rhessys_index_fingerprint:string,
        expected:struct<watersheds:bigint,subcatchments:bigint,channels:bigint,bounds:array<{_NUMBER}>>,
        capability_fingerprint:string>""",
    "capability": f"""struct<collection_key:string,watershed_key:string,runid:string,mode:string,durable_base_uri:string,
        geometry_revision:string,scenarios:array<struct<key:string,variables:array<string>>>,
        spatial_inputs:array<struct<role:string,artifact:{_ARTIFACT},required_for_activation:boolean>>,
        parquets:array<struct<role:string,artifact:{_ARTIFACT},spatial_id_field:string,
            columns:array<struct<name:string,physical_type:string>>,variables:array<struct<name:string,units:string>>,
            year_range:array<bigint>,required_for_activation:boolean>>,
        geotiffs:array<struct<scenario:string,variable:string,artifact:{_ARTIFACT},crs:string,bounds:array<{_NUMBER}>,
            dimensions:array<bigint>,bands:bigint,nodata:{_NUMBER},required_for_activation:boolean>>>""",
    "watershed-domain": """struct<runs:array<struct<collection_key:string,watershed_key:string,runid:string,
        run_fingerprint:string,capability_fingerprint:string>>>""",
    "release": f"""struct<compatibility:struct<schema_version:bigint,data_contract:bigint,identity_contract:bigint,
            artifact_contract:bigint,supported_migrations:map<string,string>,materializer:map<string,string>,
            toolchain:map<string,string>>,
        collections:array<struct<collection_key:string,display_name:string,source:struct<kind:string,source_revision:string>,
            member_index:{_ARTIFACT},expected_member_count:bigint,watershed_keys:array<string>>>,
        expected_removals:array<struct<watershed_key:string,reason:string,aliases:array<string>>>,
        lineage:array<struct<event_key:string,kind:string,predecessors:array<string>,successors:array<string>,
            reviewed:boolean>>>""",
}


def _object(**fields: Column) -> Column:
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def _whole(value: Column) -> Column:
    return value.cast("string")


def _wholes(values: Column) -> Column:
    return F.transform(values, _whole)


def _decimals(values: Column) -> Column:
    return F.transform(values, canonical_decimal)


def _sorted_map(values: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(values)))


def _ordered(items: Column, keys: Callable[[Column], list[Column]], build: Callable[[Column], Column]) -> Column:
    """Items rebuilt and put in the order of their keys."""
    keyed = F.transform(
        items, lambda i: F.struct(*[k.alias(f"k{n}") for n, k in enumerate(keys(i))], build(i).alias("item"))
    )
    return F.transform(F.array_sort(keyed), lambda pair: pair["item"])


def _content(artifact: Column) -> Column:
    return _object(sha256=artifact["sha256"], bytes=_whole(artifact["bytes"]), media_type=artifact["media_type"])


def _plain(document: Column, *names: str) -> dict[str, Column]:
    return {name: document[name] for name in names}


def _artifact(d: Column) -> dict[str, Column]:
    return {"content": _content(d)}


def _run(d: Column) -> dict[str, Column]:
    expected = d["expected"]
    return {
        **_plain(
            d, "collection_key", "watershed_key", "runid", "display_name", "transformation_lineage_fingerprint",
            "rhessys_index_fingerprint", "capability_fingerprint",
        ),
        "aliases": F.array_sort(d["aliases"]),
        "artifact_fingerprints": _sorted_map(d["artifact_fingerprints"]),
        "expected": _object(
            bounds=_decimals(expected["bounds"]), **{c: _whole(expected[c]) for c in ("watersheds", "subcatchments", "channels")}
        ),
    }


def _capability(d: Column) -> dict[str, Column]:
    by_name = lambda items, other: _ordered(
        items, lambda i: [i["name"]], lambda i: _object(**_plain(i, "name", other))
    )
    return {
        **_plain(d, "collection_key", "watershed_key", "runid", "mode", "durable_base_uri", "geometry_revision"),
        "scenarios": _ordered(
            d["scenarios"], lambda s: [s["key"]],
            lambda s: _object(key=s["key"], variables=F.array_sort(s["variables"])),
        ),
        "spatial_inputs": _ordered(
            d["spatial_inputs"], lambda s: [s["role"]],
            lambda s: _object(artifact=_content(s["artifact"]), **_plain(s, "role", "required_for_activation")),
        ),
        "parquets": _ordered(
            d["parquets"], lambda p: [p["role"]],
            lambda p: _object(
                artifact=_content(p["artifact"]), columns=by_name(p["columns"], "physical_type"),
                variables=by_name(p["variables"], "units"), year_range=_wholes(p["year_range"]),
                **_plain(p, "role", "spatial_id_field", "required_for_activation"),
            ),
        ),
        "geotiffs": _ordered(
            d["geotiffs"], lambda g: [g["scenario"], g["variable"], g["artifact"]["sha256"]],
            lambda g: _object(
                artifact=_content(g["artifact"]), bounds=_decimals(g["bounds"]), dimensions=_wholes(g["dimensions"]),
                bands=_whole(g["bands"]), nodata=canonical_decimal(g["nodata"]),
                **_plain(g, "scenario", "variable", "crs", "required_for_activation"),
            ),
        ),
    }


def _domain(d: Column) -> dict[str, Column]:
    names = ("collection_key", "watershed_key", "runid", "run_fingerprint", "capability_fingerprint")
    return {
        "runs": _ordered(
            d["runs"], lambda r: [r["collection_key"], r["watershed_key"], r["runid"]],
            lambda r: _object(**_plain(r, *names)),
        )
    }


def _release(d: Column) -> dict[str, Column]:
    c = d["compatibility"]
    return {
        "compatibility": _object(
            **{n: _whole(c[n]) for n in ("schema_version", "data_contract", "identity_contract", "artifact_contract")},
            **{n: _sorted_map(c[n]) for n in ("supported_migrations", "materializer", "toolchain")},
        ),
        "collections": _ordered(
            d["collections"], lambda i: [i["collection_key"]],
            lambda i: _object(
                source=_object(**_plain(i["source"], "kind", "source_revision")), member_index=_content(i["member_index"]),
                expected_member_count=_whole(i["expected_member_count"]), watershed_keys=F.array_sort(i["watershed_keys"]),
                **_plain(i, "collection_key", "display_name"),
            ),
        ),
        "expected_removals": _ordered(
            d["expected_removals"], lambda r: [r["watershed_key"]],
            lambda r: _object(aliases=F.array_sort(r["aliases"]), **_plain(r, "watershed_key", "reason")),
        ),
        "lineage": _ordered(
            d["lineage"], lambda e: [e["event_key"]],
            lambda e: _object(
                predecessors=F.array_sort(e["predecessors"]), successors=F.array_sort(e["successors"]),
                **_plain(e, "event_key", "kind", "reviewed"),
            ),
        ),
    }


_FIELDS = {
    "artifact": _artifact, "run": _run, "capability": _capability, "watershed-domain": _domain, "release": _release,
}


def canonical_subject(subject: str, body: Column) -> Column:
    """The canonical line of a document's subject, its values in composed Unicode form (Arrow for that step).

    The document is composed after its escapes are resolved and before it is rendered again.
    """
    document = F.from_json(composed_document(body), SCHEMAS[subject])
    fields = _FIELDS[subject](document)
    line = json_line({
        **fields, "fingerprint_version": F.lit(str(FINGERPRINT_VERSION)), "subject": F.lit(subject)
    })
    return line


def subject_fingerprints(documents: DataFrame, subject: str, body: str = "body") -> DataFrame:
    """Documents with the SHA-256 of their canonical subject."""
    return documents.withColumn("fingerprint", F.sha2(canonical_subject(subject, F.col(body)).cast("binary"), 256))
