"""Columns about chat templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of models, by architecture first, then by name; a mark of a newer generation decides between two.
BY_ARCHITECTURE = (("qwen", "3", "qwen3-instruct", "qwen25-instruct"), ("llama", "", "llama3-instruct", ""), ("gemma", "3", "gemma3-instruct", "gemma2-instruct"), ("mistral", "", "mistral-instruct", ""), ("deepseek", "", "deepseek-v3", ""))
BY_NAME = (("qwen3", "qwen3-instruct"), ("qwen2.5", "qwen25-instruct"), ("qwen25", "qwen25-instruct"), ("llama-3", "llama3-instruct"), ("llama3", "llama3-instruct"), ("gemma-3", "gemma3-instruct"), ("gemma3", "gemma3-instruct"), ("gemma-2", "gemma2-instruct"), ("gemma2", "gemma2-instruct"), ("mistral", "mistral-instruct"), ("deepseek", "deepseek-v3"))
# End of fixed values.


def family(architecture: Column, name: Column) -> Column:
    a, n, out = F.lower(architecture), F.lower(name), F.lit(None).cast("string")
    for word, kind in reversed(BY_NAME):
        out = F.when(n.contains(word), kind).otherwise(out)
    for word, mark, newer, older in reversed(BY_ARCHITECTURE):
        kind = F.when(a.contains(mark), newer).otherwise(older) if mark else F.lit(newer)
        out = F.when(a.contains(word), kind).otherwise(out)
    return out


def plain_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")
