"""The advisory bundle: strict reading on the driver, then rules as a small table.

A bundle is a folder with a manifest and a list of advisories.  Whatever isn't exactly as the schema says is refused;
that a bundle has expired is told, not refused."""

from __future__ import annotations

import hashlib
import json
import os
import re
from datetime import date, datetime, timezone
from typing import NamedTuple
from urllib.parse import urlsplit

# The bundle's schema.
SCHEMA_VERSION, MANIFEST, ADVISORIES = "1.0", "manifest.json", "advisories.json"
MANIFEST_BYTES, ADVISORIES_BYTES = 64 << 10, 2 << 20
MANIFEST_FIELDS = ("schema_version", "bundle_version", "published_at", "expires_at", "advisories")
RULE_FIELDS = ("id", "title", "source", "component", "version_scheme", "affected", "fixed", "artifact_predicates", "severity", "confidence", "explanation", "action", "published", "reviewed", "verified_by", "fixed_inferred")
SCHEMES = ("llama_cpp_build", "semver")
SEVERITIES, CONFIDENCES = ("critical", "high", "medium", "low", "info"), ("high", "medium", "low")
# End of fixed values.
RULES = "id string, title string, source string, component string, version_scheme string, affected map<string,string>, fixed map<string,string>, predicates array<struct<field:string,operator:string,value:string>>, severity string, confidence string, explanation string, action string"


class BundleError(ValueError):
    """A bundle can't be used."""


class SchemaError(BundleError):
    """It isn't as the schema says."""


class IntegrityError(BundleError):
    """Its digest is another one."""


class ReadError(BundleError):
    """It can't be read within its bounds."""


class Bundle(NamedTuple):
    version: str
    published_at: str
    expires_at: str
    digest: str
    source: str
    expired: bool
    rules: list[dict]

    def table(self, spark):
        """The rules as a table; as many rows as advisories."""
        text = lambda v: json.dumps(v, ensure_ascii=False)
        rows = []
        for r in self.rules:
            limits = [{k: str(v) for k, v in r[side].items()} for side in ("affected", "fixed")]
            predicates = [(p["field"], p["operator"], text(p["value"]) if "value" in p else None) for p in r["artifact_predicates"]]
            rows.append((*(r[k] for k in ("id", "title", "source", "component", "version_scheme")), *limits, predicates, *(r[k] for k in ("severity", "confidence", "explanation", "action"))))
        return spark.createDataFrame(rows, RULES)


def need(ok: bool, where: str, what: str) -> None:
    if not ok:
        raise SchemaError(f"{where}: {what}")


def strict_json(raw: bytes, where: str):
    """JSON in UTF-8 without repeated keys, NaN or infinities."""

    def pairs(items):
        keys = [k for k, _ in items]
        need(len(set(keys)) == len(keys), where, "a key is repeated")
        return dict(items)

    def constant(name):
        raise SchemaError(f"{where}: {name} is not a value")

    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=pairs, parse_constant=constant)
    except SchemaError:
        raise
    except (UnicodeDecodeError, ValueError, RecursionError) as e:
        raise SchemaError(f"{where}: {e}") from e


def canonical_bytes(value) -> bytes:
    """The one form of a JSON value that digests are taken of."""
    try:
        return json.dumps(value, ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":")).encode("utf-8")
    except (TypeError, ValueError) as e:
        raise SchemaError(f"not JSON: {e}") from e


def canonical_digest(value) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()


def closed(value, fields, where: str) -> dict:
    need(isinstance(value, dict), where, "must be an object")
    need(not set(fields) - set(value), where, f"lacks {sorted(set(fields) - set(value))}")
    need(not set(value) - set(fields), where, f"has also {sorted(set(value) - set(fields))}")
    return value


def text(value, where: str) -> str:
    need(isinstance(value, str) and value != "", where, "must be text")
    return value


def dotted(value, where: str) -> str:
    need(re.fullmatch(r"[0-9]+(\.[0-9]+)*", text(value, where)) is not None, where, "must be numbers and dots")
    return value


def whole(value, where: str) -> int:
    need(type(value) is int and value >= 0, where, "must be a whole number")
    return value


def in_utc(moment: datetime) -> datetime:
    need(moment.tzinfo is not None and moment.utcoffset() is not None, "time", "needs a time zone")
    return moment.astimezone(timezone.utc)


def instant(value, where: str) -> datetime:
    need(text(value, where).endswith("Z"), where, "must be a time in UTC that ends in Z")
    try:
        return in_utc(datetime.fromisoformat(value[:-1] + "+00:00"))
    except ValueError as e:
        raise SchemaError(f"{where}: {e}") from e


def day(value, where: str) -> str:
    try:
        need(date.fromisoformat(text(value, where)).isoformat() == value, where, "must be written YYYY-MM-DD")
    except ValueError as e:
        raise SchemaError(f"{where}: {e}") from e
    return value


def secure_url(value, where: str) -> str:
    x = urlsplit(text(value, where))
    need(x.scheme == "https" and x.netloc != "" and not x.username and not x.password, where, "must be an https address without a user")
    return value


def limits(value, where: str, scheme: str) -> dict:
    """Bounds of builds or versions: at least one, none twice."""
    need(isinstance(value, dict) and bool(value) and set(value) <= {"gt", "gte", "lt", "lte"}, where, "must be bounds")
    need(not {"gt", "gte"} <= set(value) and not {"lt", "lte"} <= set(value), where, "has two bounds of one side")
    return {k: whole(v, f"{where}.{k}") if scheme == SCHEMES[0] else text(v, f"{where}.{k}") for k, v in value.items()}


def interval(bounds: dict) -> tuple[int, float]:
    """The whole numbers within bounds, first and last."""
    low = bounds["gt"] + 1 if "gt" in bounds else bounds.get("gte", 0)
    high = bounds["lt"] - 1 if "lt" in bounds else bounds.get("lte", float("inf"))
    return low, high


def overlap(a: dict, b: dict) -> bool:
    (p, q), (r, s) = interval(a), interval(b)
    return max(p, r) <= min(q, s)


def predicate(value, where: str) -> dict:
    need(isinstance(value, dict) and value.get("operator") in ("present", "equals"), where, "must be present or equals")
    fields = ("field", "operator") if value["operator"] == "present" else ("field", "operator", "value")
    name = text(closed(value, fields, where)["field"], f"{where}.field")
    need(all(p.isidentifier() and not p.startswith("_") for p in name.split(".")), where, "must name a public field")
    if "value" in value:
        need(value["value"] is None or type(value["value"]) in (str, int, bool), where, "must be text, a whole number, true, false or null")
    return value


def rule(value, where: str) -> dict:
    r = closed(value, RULE_FIELDS, where)
    need(r["version_scheme"] in SCHEMES, f"{where}.version_scheme", f"must be of {SCHEMES}")
    affected, fixed = (limits(r[k], f"{where}.{k}", r["version_scheme"]) for k in ("affected", "fixed"))
    need(r["version_scheme"] != SCHEMES[0] or not overlap(affected, fixed), where, "affected and fixed builds overlap")
    need(isinstance(r["artifact_predicates"], list) and bool(r["artifact_predicates"]), f"{where}.artifact_predicates", "must be a list")
    for i, p in enumerate(r["artifact_predicates"]):
        predicate(p, f"{where}.artifact_predicates[{i}]")
    need(r["severity"] in SEVERITIES and r["confidence"] in CONFIDENCES, where, "severity or confidence is unknown")
    for k in ("id", "title", "component", "explanation", "action"):
        text(r[k], f"{where}.{k}")
    secure_url(r["source"], f"{where}.source")
    day(r["published"], f"{where}.published")
    day(r["reviewed"], f"{where}.reviewed")
    return r


def manifest(value) -> dict:
    m = closed(value, MANIFEST_FIELDS, "manifest")
    need(dotted(m["schema_version"], "manifest.schema_version") == SCHEMA_VERSION, "manifest", "another schema")
    dotted(m["bundle_version"], "manifest.bundle_version")
    need(instant(m["expires_at"], "manifest.expires_at") > instant(m["published_at"], "manifest.published_at"), "manifest", "expires before it is published")
    a = closed(m["advisories"], ("path", "sha256", "count"), "manifest.advisories")
    need(a["path"] == ADVISORIES, "manifest.advisories.path", f"must be {ADVISORIES}")
    need(re.fullmatch(r"[0-9a-f]{64}", text(a["sha256"], "manifest.advisories.sha256")) is not None, "manifest.advisories.sha256", "must be a digest")
    whole(a["count"], "manifest.advisories.count")
    return m


def advisories(value, m: dict) -> list[dict]:
    root = closed(value, ("schema_version", "bundle_version", "advisories"), "advisories")
    need(all(root[k] == m[k] for k in ("schema_version", "bundle_version")), "advisories", "is of another version than the manifest")
    need(isinstance(root["advisories"], list), "advisories.advisories", "must be a list")
    rules = [rule(r, f"advisories[{i}]") for i, r in enumerate(root["advisories"])]
    ids = [r["id"] for r in rules]
    need(len(ids) == m["advisories"]["count"], "advisories", "count differs from the manifest's")
    need(len(set(ids)) == len(ids), "advisories", "ids are repeated")
    need(ids == sorted(ids), "advisories", "ids are out of order")
    return rules


def read_within(path: str, most: int) -> bytes:
    try:
        with open(path, "rb") as f:
            raw = f.read(most + 1)
    except OSError as e:
        raise ReadError(f"{path}: {e}") from e
    if len(raw) > most:
        raise ReadError(f"{path}: over {most} bytes")
    return raw


def load(path: str, now: datetime | None = None) -> Bundle:
    """The bundle of a folder or of its manifest's path, verified."""
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    if not os.path.isdir(path) and os.path.basename(path) != MANIFEST:
        raise ReadError(f"{path}: neither a folder nor a {MANIFEST}")
    m = manifest(strict_json(read_within(os.path.join(folder, MANIFEST), MANIFEST_BYTES), MANIFEST))
    data = strict_json(read_within(os.path.join(folder, ADVISORIES), ADVISORIES_BYTES), ADVISORIES)
    digest = canonical_digest(data)
    if digest != m["advisories"]["sha256"]:
        raise IntegrityError(f"{ADVISORIES}: digest is {digest}")
    moment = in_utc(now or datetime.now(timezone.utc))
    return Bundle(m["bundle_version"], m["published_at"], m["expires_at"], digest, os.path.realpath(folder), moment >= instant(m["expires_at"], "manifest.expires_at"), advisories(data, m))
