"""Text column functions: run ids, labels, lists, checks, redaction, coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format patterns of stable identifiers.
STABLE_KEY = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
SHA256_HEX = r"^[a-f0-9]{64}$"
RELEASE_ID = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\.[1-9][0-9]*$"
GIT_COMMIT = r"^[a-f0-9]{40}$"
IMAGE_DIGEST = r"^sha256:[a-f0-9]{64}$"

# Names that mark a secret, and the opening tags of a web page.
SECRET_KEYS = (
    "password", "passwd", "token", "secret", "secret_ref",
    "api_key", "apikey", "credential", "credentials",
)
HTML_OPENINGS = ("<!doctype html", "<html", "<head", "<body")

# What is masked in messages, and control characters.
ADDRESS_USER = r"(?i)(https?://)[^/@\s]+@"
ASSIGNED_SECRET = r"""(?i)\b(password|passwd|token|secret|api[_-]?key)\s*[:=]\s*(?:"[^"]*"|'[^']*'|\S+)"""
CONTROLS = r"[\x00-\x1f\x7f]+"


def normalise_runid(runid: Column) -> Column:
    """FN-S01: the last segment is a state code, upper-cased, in ``nasa-roses`` batches only."""
    parts = F.split(runid, ";;")
    last = F.element_at(parts, -1)
    state_batch = (F.size(parts) >= 2) & F.get(parts, F.size(parts) - 2).contains("nasa-roses")
    head = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.when(state_batch, F.concat_ws(";;", F.array_append(head, F.upper(last)))).otherwise(runid)


def scenario_label(scenario: Column) -> Column:
    """FN-S02: ``thinning_40_75`` becomes ``Thinning 40-75``; only first letters change."""
    words = F.split(F.regexp_replace(scenario, r"(\d+)_(\d+)", "$1-$2"), "_")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
    )


def file_display_name(filename: Column, registry: dict[str, str] | None = None) -> Column:
    """FN-S03: the name a registry gives the file; else the extension dropped, underscores to spaces, a capital
    after whatever is no letter."""
    plain = F.regexp_replace(F.regexp_replace(filename, r"\.tif$", ""), "_", " ")
    # A mark and a blank after each such character, so that the next letter begins a word.
    marked = F.regexp_replace(plain, r"([^\p{L}\s])", "$1\u0001 ")
    titled = F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))
    if not registry:
        return titled
    named = F.create_map(*[F.lit(text) for pair in registry.items() for text in pair])
    return F.coalesce(F.try_element_at(named, filename), titled)


def semicolon_list(names: Column, fallback: Column) -> Column:
    """FN-S04: trimmed non-empty items, or the fallback name as the only item."""
    items = F.filter(
        F.transform(F.split(F.coalesce(names, F.lit("")), ";"), lambda s: F.trim(s)), lambda s: s != ""
    )
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.coalesce(fallback, F.lit(""))))


def safe_filename(name: Column) -> Column:
    """FN-S05: word characters, blanks and hyphens only, blanks to underscores."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\w\s-]", ""), r"\s+", "_")


def matches(value: Column, pattern: str) -> Column:
    """FN-S06: format check that is false, not null, on a null value."""
    return F.coalesce(value.rlike(pattern), F.lit(False))


def redact(text: Column, limit: int | None = None) -> Column:
    """FN-S07: user info in addresses and assigned secrets masked, blanks squeezed, cut only at a given limit."""
    masked = F.regexp_replace(text, ADDRESS_USER, "$1[REDACTED]@")
    masked = F.regexp_replace(masked, ASSIGNED_SECRET, "$1=[REDACTED]")
    plain = F.regexp_replace(masked, CONTROLS, " ")
    squeezed = F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))
    return squeezed if limit is None else F.substring(squeezed, 1, limit)


def is_public_https(uri: Column) -> Column:
    """FN-S08: https address with a host, without user info, and without anything in its query or fragment."""
    return matches(uri, r"^(?i:https)://[^/?#@\s]+(/[^?#]*)?\??#?$")


def looks_like_html(text: Column) -> Column:
    """FN-S09: the first 1024 characters, left-trimmed and lower-cased, open a web page."""
    head = F.lower(F.regexp_replace(F.substring(text, 1, 1024), r"^\s+", ""))
    found = F.lit(False)
    for opening in HTML_OPENINGS:
        found = found | head.startswith(opening)
    return F.coalesce(found, F.lit(False))


COORDINATES = r"^(-?\d+(?:\.\d+)?)\s*(?:,\s*|\s+)(-?\d+(?:\.\d+)?)$"


def parse_coordinates(text: Column) -> Column:
    """FN-S10: struct of latitude, longitude (null when unreadable), range check, likeness."""
    trimmed = F.trim(text)
    readable = matches(trimmed, COORDINATES)
    lat = F.when(readable, F.regexp_extract(trimmed, COORDINATES, 1).cast("double"))
    lng = F.when(readable, F.regexp_extract(trimmed, COORDINATES, 2).cast("double"))
    in_range = F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))
    numeric_tokens = F.size(
        F.filter(F.split(trimmed, r"\s+"), lambda t: t.rlike(r"^-?\d+(?:\.\d+)?$"))
    )
    like = matches(trimmed, r"\d") & (readable | trimmed.contains(",") | (numeric_tokens >= 2))
    return F.struct(
        lat.alias("lat"), lng.alias("lng"), in_range.alias("in_range"), like.alias("coordinate_like")
    )


def collection_of_run(runid: Column, by_run: dict[str, str], by_prefix: dict[str, str]) -> Column:
    """FN-S11: collection by exact run id, else by the longest fitting start of the id, else null."""
    choice = F.lit(None).cast("string")
    for prefix in sorted(by_prefix, key=len):
        choice = F.when(runid.startswith(prefix), F.lit(by_prefix[prefix])).otherwise(choice)
    for name, collection in by_run.items():
        choice = F.when(runid == name, F.lit(collection)).otherwise(choice)
    return choice


def secret_keys_in_json(document: Column) -> Column:
    """FN-S12: the secret-bearing object keys anywhere in a JSON text, in document order.

    A key token is a JSON string followed by a colon. Strings are matched whole, so a
    colon inside a value does not turn that value into a key; only keys fill the group.
    """
    string = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
    names = F.regexp_extract_all(document, F.lit(rf'"({string})"\s*+:|"{string}"'), F.lit(1))
    plain = F.transform(
        F.filter(names, lambda n: n != ""), lambda n: F.replace(F.lower(n), F.lit("-"), F.lit("_"))
    )
    return F.filter(plain, lambda n: n.isin(*SECRET_KEYS))
