"""Columns over names and contents of files that lie beside a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, suffixes and patterns that decide which files and references count.
NAMES = ("config.json", "tokenizer_config.json", "modelfile")
TEXT_SUFFIXES = (".json", ".md", ".txt", ".yaml", ".yml", ".pem", ".key", ".cfg", ".ini", ".conf")
READ_SUFFIXES = (".md", ".txt", ".yaml", ".yml", ".pem", ".key", ".cfg", ".ini", ".conf")
ADAPTER_SUFFIXES = (".json", ".safetensors", ".bin", ".gguf")
RULE_FILES = (".cursorrules", "rules.md")
INSTRUCTIONS = ".github/copilot-instructions.md"
PROGRAM_SUFFIXES = (".exe", ".bat", ".cmd", ".ps1", ".sh", ".vbs", ".wsf")
IMPOSSIBLE = r"(?i)(?:Q0_[KS]|Q0_0|Q1_[KS])"
REMOTE = r"(?i)(?:https?://|hf://|huggingface\.co/)"
PINNED = r"(?i)(?:@|:|\b)sha256[:=]?[0-9a-f]{64}\b"
LOCAL = ("./", "../", "/", "file://")
FROM = r"(?im)^\s*FROM\s+([^\s#]+)"
BLOCKED_HOSTS = ("malicious-models.com", "fake-huggingface.co")
REPOSITORY_KEYS = ("general.repo_url", "general.base_model.0.repo_url")
# End of fixed values.


def base_name(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, "/"), -1))


def suffix(path: Column) -> Column:
    """The last dot and what follows, of a name that has more before it; else empty."""
    return F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1)


def is_adapter(path: Column) -> Column:
    return base_name(path).contains("adapter") & suffix(path).isin(*ADAPTER_SUFFIXES)


def is_manifest(path: Column) -> Column:
    return base_name(path).contains("manifest")


def is_rules_file(path: Column) -> Column:
    low = F.lower(path)
    return base_name(path).isin(*RULE_FILES) | (low == INSTRUCTIONS) | low.endswith("/" + INSTRUCTIONS)


def is_model_card(path: Column) -> Column:
    return (suffix(path) == ".md") & base_name(path).rlike("readme|model_card|dataset_card")


def is_companion(path: Column) -> Column:
    name = base_name(path)
    return name.isin(*NAMES) | name.startswith("readme") | is_manifest(path) | suffix(path).isin(".py", *READ_SUFFIXES) | is_adapter(path) | is_rules_file(path)


def is_pinned(reference: Column) -> Column:
    return reference.rlike(PINNED)


def is_remote(text: Column) -> Column:
    return text.rlike(REMOTE)


def is_local(reference: Column) -> Column:
    out = F.lit(False)
    for p in LOCAL:
        out = out | reference.startswith(p)
    return out


def stripped(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, f"^[{marks}]+|[{marks}]+$", "")


def from_sources(text: Column) -> Column:
    """What FROM lines name, without quotes; local ones are left out."""
    named = F.transform(F.regexp_extract_all(text, F.lit(FROM), F.lit(1)), lambda r: stripped(r, "\"'"))
    return F.filter(named, lambda r: ~is_local(r))


def remote_snippets(text: Column) -> Column:
    """From each remote address to the end of its line, 512 characters at most."""

    def of_line(line: Column) -> Column:
        # An address within the rest of a line that another one begins counts on its own, so each begins where the texts
        # between addresses and the addresses before it end.
        between, found = F.split(line, REMOTE, -1), F.regexp_extract_all(line, F.lit(REMOTE), F.lit(0))
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda x, y: F.struct(F.length(x).alias("x"), F.length(y).alias("y")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))
        places = F.aggregate(lengths, start, lambda s, n: F.struct((s["at"] + n["x"] + n["y"]).alias("at"), F.concat(s["out"], F.array(s["at"] + n["x"])).alias("out")), lambda s: s["out"])
        bare = F.regexp_replace(line, "[ \"',]+$", "")
        return F.transform(places, lambda p: F.substring(bare, p, F.lit(512)))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(REMOTE))
    return F.flatten(F.transform(lines, of_line))


def blocked_host(metadata: Column) -> Column:
    """The blocked hosts that the repository's address names, of the first key that has one."""
    url = F.coalesce(*(F.nullif(F.element_at(metadata, k), F.lit("")) for k in REPOSITORY_KEYS))
    return F.array_compact(F.array(*(F.when(url.contains(h), F.lit(h)) for h in BLOCKED_HOSTS)))


def declaration(manifest: Column) -> Column:
    """artifact, sha256, architecture and name that a JSON manifest declares; null without an artifact.  The artifact is the
    first of three keys that holds anything, and must be text."""
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string"))
    empty = ("null", '""', "0", "false", "[]", "{}", "0.0")
    value = F.try_parse_json(manifest)
    first = F.lit(None).cast("string")
    for k in ("file", "model", "artifact"):
        raw = F.to_json(F.try_variant_get(value, f"$.{k}", "variant"))
        first = F.when(raw.isNotNull() & ~raw.isin(*empty), text(k)).otherwise(first)
    return F.when(first.isNotNull(), F.struct(first.alias("artifact"), text("sha256").alias("sha256"), text("architecture").alias("architecture"), text("name").alias("name")))
