"""Columns of facts: alignment, tensor sizes, versions, identities, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and type sizes that must equal those of the file format and the runtimes.
RUNTIME_NAMES = ("llama-cli", "llama-server", "llama-run", "llama-simple", "llama-batched", "llama-embedding", "llama-perplexity", "llama-llava-cli", "llama-gemma3-cli", "llama-minicpmv-cli", "llama-qwen2vl-cli")
GGML_TYPES = {
    0: (1, 4), 1: (1, 2), 2: (32, 18), 3: (32, 20), 6: (32, 22), 7: (32, 24), 8: (32, 34), 9: (32, 40), 10: (256, 84), 11: (256, 110), 12: (256, 144), 13: (256, 176), 14: (256, 210), 15: (256, 292),
    16: (256, 66), 17: (256, 74), 18: (256, 98), 19: (256, 50), 20: (32, 18), 21: (256, 110), 22: (256, 82), 23: (256, 136), 24: (1, 1), 25: (1, 2), 26: (1, 4), 27: (1, 8), 28: (1, 8), 29: (256, 56),
    30: (1, 2), 34: (256, 54), 35: (256, 66), 39: (32, 17), 40: (64, 36), 41: (128, 18), 42: (64, 18), 100: (32, 18), 101: (32, 17), 102: (32, 26), 103: (32, 33), 104: (32, 14), 105: (32, 14), 106: (32, 18), 107: (32, 10), 108: (32, 17),
}
BUILD = (r"\b(?:llama[_ .-]*)?build(?:[_ .-]*(?:number|no))?\s*[:= -]\s*b?(\d+)\b", r"\bversion\s*[:= -]\s*b(\d+)\b", r"^\s*b(\d+)\s*$", r"\bversion\s*[:= -]\s*(\d+)\s*(?:\(|$)")
VERSION = (r"\b(?:llama(?:\.cpp)?[_ .-]*)?version\s*[:= -]\s*v?([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][0-9A-Za-z.-]+)?)", r"\bllama(?:\.cpp)?[/ _-]v?([0-9]+\.[0-9]+(?:\.[0-9]+)?(?:[-+][0-9A-Za-z.-]+)?)")
COMMIT = (r"\b(?:git[_ .-]*)?(?:commit|revision|rev)\s*[:= -]\s*([0-9a-f]{7,40})\b", r"\b(?:build|version)\s*[:= -]\s*\d+\s*\(([0-9a-f]{7,40})\)")
# End of fixed values.

U64 = "18446744073709551615"


def align_up(offset: Column, alignment: Column) -> Column:
    return offset + F.pmod(-offset, alignment)


def sound_alignment(a: Column) -> Column:
    return (a >= 8) & (a.bitwiseAND(a - 1) == 0)


def tensor_bytes(dims: Column, block: Column, size: Column) -> Column:
    """Bytes of a tensor (its blocks run along the first dimension); null if that dimension isn't whole blocks, a
    dimension is zero, or a product passes 64 bits."""
    whole = F.pmod(dims[0], block) == 0
    start = (F.floor(dims[0] / block) * size).cast("decimal(38,0)")
    # A product stays null once it passes 64 bits, so no step sees more than 38 digits.
    total = F.aggregate(F.slice(dims, 2, F.size(dims)), start, lambda acc, d: F.when(F.try_multiply(acc, d.cast("decimal(20,0)")) <= F.lit(U64).cast("decimal(38,0)"), F.try_multiply(acc, d.cast("decimal(20,0)")).cast("decimal(38,0)")))
    return F.when(whole & ~F.exists(dims, lambda d: d <= 0), total)


def first_group(text: Column, patterns: tuple[str, ...]) -> Column:
    """Group 1 of the first pattern that matches."""
    found = [F.nullif(F.regexp_extract(text, f"(?dUimu){p}", 1), F.lit("")) for p in patterns]
    return F.coalesce(*found)


def identity(text: Column) -> Column:
    return F.struct(first_group(text, BUILD).cast("bigint").alias("build"), first_group(text, VERSION).alias("version"), F.lower(first_group(text, COMMIT)).alias("commit"))


def component(name: Column) -> Column:
    """Known runtimes count as one component; others by their lower-case name."""
    bare = F.lower(F.trim(name))
    return F.when(bare.isin(*RUNTIME_NAMES), F.lit("llama.cpp")).otherwise(bare)


def version_key(version: Column) -> Column:
    """Numbers of a dotted version: leading digits of each part, parts without are left out."""
    parts = F.split(F.regexp_replace(version, "^v+", ""), r"\.")
    digits = F.filter(F.transform(parts, lambda p: F.regexp_extract(p, "^([0-9]+)", 1)), lambda d: d != "")
    return F.transform(digits, lambda d: d.cast("decimal(38,0)"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1 after padding with zeros; null if either is null."""
    n = F.greatest(F.size(a), F.size(b))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("decimal(38,0)"), n - F.size(x)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(pad(a) < pad(b), -1).when(pad(a) > pad(b), 1).otherwise(0)


def executable_format(head: Column) -> Column:
    """By the first bytes."""
    starts = lambda *hexes: reduce(lambda x, y: x | y, (F.hex(head).startswith(h) for h in hexes))
    macho = ("FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE", "CAFEBABE", "BEBAFECA", "CAFEBABF", "BFBAFECA")
    return F.when(starts("7F454C46"), "elf").when(starts(*macho), "mach-o").when(starts("4D5A"), "pe")


def slug(text: Column) -> Column:
    """An id part: lower case, other characters as dashes, none at the ends."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_.-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit("unknown"))


#: What a parse error points to: words of its message, tried in order, a word for it, what it means and a likely cause.
ORIGINS = (
    (("zero-sized dimension",), "zero_dimension", "One of the tensors has no extent along one of its dimensions, so it can hold nothing.", "A converter or quantizer wrote a tensor that it had emptied."),
    (("truncat",), "truncated", "The header announces more than the file holds.", "A download or copy stopped early, or the storage lost the end."),
    (("magic",), "magic", "The first four bytes are not those of a model file.", "Another kind of file under this name."),
    (("version",), "version", "The file's format version is one that is not read here; versions 2 and 3 are.", "A writer that is older or newer than that."),
    (("duplicate",), "duplicate", "A name that must be unique occurs twice.", "Metadata or tensors were merged or patched in by a tool."),
    (("limit", "budget"), "limit", "Reading on would take more memory or steps than is allowed for a header.", "Very large metadata, or a file made to exhaust its reader."),
    (("alignment",), "alignment", "The place where tensor data begins is not a power of two of eight bytes or more.", "A converter set the wrong alignment."),
    (("overlap",), "overlap", "Two tensors share bytes, so that loading one would read the other.", "A damaged header, or a converter that miscounted."),
    (("utf-8",), "encoding", "A text in the metadata is no valid UTF-8.", "A writer with another encoding, or damage to the file."),
)
OTHER_ORIGIN = ("other", "The header could not be read for another reason.", "Unknown: damage, or something that is not read here.")


def _origin(message: Column, part: int) -> Column:
    low, out = F.lower(message), F.lit(OTHER_ORIGIN[part])
    for words, *said in reversed(ORIGINS):
        out = F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in words)), said[part]).otherwise(out)
    return out


def error_origin(message: Column) -> Column:
    """What a parse error points to, by its words in order."""
    return _origin(message, 0)


def error_explanation(message: Column) -> Column:
    """(origin, explanation, cause) of a parse error."""
    return F.struct(*(_origin(message, i).alias(n) for i, n in enumerate(("origin", "explanation", "cause"))))


def explained(message: str) -> tuple[str, str, str]:
    """The same for one message."""
    return next((tuple(said) for words, *said in ORIGINS if any(w in message.lower() for w in words)), OTHER_ORIGIN)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").when(severity == "low", "note").otherwise("none")


def digest_ok(text: Column) -> Column:
    return text.rlike(r"^[0-9a-fA-F]{64}\z")
