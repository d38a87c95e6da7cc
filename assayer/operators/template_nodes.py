"""Chat templates as node rows, and what they hold found by joins over them.

A template is parsed once into a row a node: its place in the tree by nested intervals (a node's ``enter`` to ``leave``
hold all below it), its depth, its parent and the part it plays there, the chain of first parts that it stands in, and its
text.  Each detector is a selection or a join of such rows, so a fleet's templates are judged by shuffles on the template's
key, and no task holds more than a template's own rows of a kind.  ``evidence_rows`` gives what ``templates.evidence``
gives for each template."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions.jinja import JinjaError, parse
from assayer.operators import templates as t
from assayer.tables import save

#: enter, leave, depth; parent: its enter, kind and line; part: kid, test, else and so on, pos: its place among those; chain:
#: the enter of the highest node that is reached upwards by first kids only; name: what a callee's link is called; text: of
#: constants and data; value: of other nodes.
NODES = "enter int, leave int, depth int, parent int, parent_kind string, parent_line int, part string, pos int, chain int, kind string, line int, name string, text string, value string"
_TYPES = {"int": pa.int32(), "string": pa.string()}
#: Kinds of rows that stand for a whole template instead of its nodes.
WHOLE = ("#error", "#limit")


def rows_of(text: str) -> list[tuple]:
    """Rows of NODES in order, or one of kind #error or #limit with its message as text."""
    whole = lambda kind, line, said: [(0, 0, 0, None, None, None, None, 0, 0, kind, line, None, said, None)]
    if len(text.encode("utf-8", "surrogatepass")) > t.TEMPLATE_BYTES:
        return whole("#limit", None, "template is too long")
    if t.openers(text) > t.NESTING:
        return whole("#limit", None, "template is nested too deeply")
    try:
        tree = parse(text)
    except JinjaError as e:
        return whole("#error", e.line, str(e))
    out: list[list] = []
    open_: list[int] = []  # rows on the way down
    todo = [(n, None, "kid", i, 0) for i, n in enumerate(tree.kids)][::-1]
    while todo:
        n, parent, part, pos, depth = todo.pop()
        if n is None:  # all below a row are done
            out[open_.pop()][1] = len(out) - 1
            continue
        enter = len(out)
        above = out[parent] if parent is not None else None
        chain = above[8] if above is not None and part == "kid" and pos == 0 else enter
        text_ = n.value if n.kind in ("Const", "Data") and isinstance(n.value, str) else None
        name = n.value if n.kind in ("Getattr", "Name") else None
        if n.kind == "Getitem" and len(n.kids) > 1 and n.kids[1].kind == "Const" and isinstance(n.kids[1].value, str):
            name = n.kids[1].value
        value = n.value if isinstance(n.value, str) and text_ is None else None
        out.append([enter, enter, depth, parent, above and above[9], above and above[10], part, pos, chain, n.kind, n.line, name, text_, value])
        if len(out) > t.NODES:
            return whole("#limit", None, "template has too many nodes")
        open_.append(enter)
        below = [(k, enter, "kid", i, depth + 1) for i, k in enumerate(n.kids)]
        below += [(k, enter, name, i, depth + 1) for name, p in n.body.items() for i, k in enumerate(p if isinstance(p, list) else [p])]
        todo += [(None, None, "", 0, 0), *below[::-1]]
    return [tuple(r) for r in out]


def nodes(df: DataFrame, key: str, template: str) -> DataFrame:
    """(key, *NODES) for every template that is not null."""
    kind = df.select(key).schema[0].dataType.simpleString()
    fields = [f.split() for f in NODES.split(", ")]

    def run(it):
        for b in it:
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                rows = rows_of(text)
                for at in range(0, len(rows), 4096):
                    cols = list(zip(*rows[at : at + 4096]))
                    own = b.column(0).slice(i, 1).take(pa.array([0] * len(cols[0])))
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(c, _TYPES[f[1]]) for c, f in zip(cols, fields))], names=[key, *(f[0] for f in fields)])

    return df.select(key, template).mapInArrow(run, f"`{key}` {kind}, {NODES}")


def _words(words) -> str:
    return r"(?iuU)\b(?:" + "|".join(map(re.escape, words)) + r")\b"


def _first_word(text: Column, words) -> Column:
    """The first of the words, in their order, that a text holds."""
    found = F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(F.lower(text), w))
    return F.try_element_at(found, F.lit(1))


def evidence_rows(df: DataFrame, key: str, template: str) -> DataFrame:
    """(key, seq, kind, node_type, line, detail, severity): what ``templates.evidence`` finds in each template.  Keys must
    tell templates apart."""
    n = save(nodes(df, key, template), "nodes")
    fixed = F.col("text").isNotNull()
    url = F.col("text").rlike("https?://")
    parts: list[DataFrame] = []

    def found(rows: DataFrame, step: int, kind: Column | str, node: Column | str, detail: Column | str, line: str | Column = "line", *order: str | Column) -> None:
        of = lambda x: F.col(x) if isinstance(x, str) else x
        order = tuple(of(x).cast("int") for x in order or ("enter",))
        at = F.array(F.lit(step), *order, *(F.lit(0) for _ in range(3 - len(order))))
        say = lambda x: F.lit(x) if isinstance(x, str) else x
        parts.append(rows.select(key, at.alias("at"), say(kind).alias("kind"), say(node).alias("node_type"), of(line).alias("line"), say(detail).alias("detail")))

    whole = n.where(F.col("kind").isin(*WHOLE))
    found(whole, 0, F.substring("kind", 2, 9), "Template", F.col("text"))
    risky = F.create_map(*(F.lit(x) for pair in t.RISKY_NODES.items() for x in pair))
    found(n.where(F.col("kind").isin(*t.RISKY_NODES)), 1, risky[F.col("kind")], F.col("kind"), F.col("kind"))
    found(n.where((F.col("kind") == "Filter") & F.col("value").isin(*t.RISKY_FILTERS)), 2, "dynamic_filter", "Filter", F.col("value"))

    # A constant that a condition compares with: between it and the condition only And and Or, and a Compare right above it.
    const = n.where((F.col("kind") == "Const") & fixed).withColumn("word", _first_word(F.col("text"), t.SENSITIVE)).where("word is not null")
    c = const.select(key, F.col("enter").alias("c_enter"), F.col("leave").alias("c_leave"), F.col("parent").alias("c_parent"), "word")
    test = n.where("part = 'test' and parent_kind = 'If'").select(F.col(key).alias("k2"), F.col("parent").alias("of"), F.col("parent_line").alias("line"), F.col("enter").alias("t_enter"), F.col("leave").alias("t_leave"))
    asked = c.join(test, F.col(key).eqNullSafe(F.col("k2")) & (F.col("c_enter") >= F.col("t_enter")) & (F.col("c_enter") <= F.col("t_leave"))).drop("k2")
    other = n.where(~F.col("kind").isin("And", "Or")).select(F.col(key).alias("k3"), "enter", "leave", "kind")
    between = (F.col("enter") >= F.col("t_enter")) & (F.col("enter") < F.col("c_enter")) & (F.col("leave") >= F.col("c_leave"))
    stops = F.col(key).eqNullSafe(F.col("k3")) & between & ~((F.col("kind") == "Compare") & (F.col("enter") == F.col("c_parent")))
    found(asked.join(other, stops, "left_anti"), 3, "conditional_trigger", "If", F.col("word"), "line", "of", "c_enter")

    # Names along a callee's chain, outermost first.
    call = n.where("kind = 'Call'").select(key, "enter", "line", "chain", "depth")
    link = n.where("name is not null").select(F.col(key).alias("k2"), F.col("chain").alias("chain2"), F.col("depth").alias("depth2"), "name", "kind")
    below = (F.col(key).eqNullSafe(F.col("k2"))) & (F.col("chain") == F.col("chain2")) & (F.col("depth2") > F.col("depth"))
    chains = call.join(link, below).groupBy(key, "enter", "line", "depth").agg(F.array_sort(F.collect_list(F.struct("depth2", "name", "kind"))).alias("links"))
    names = F.col("links")["name"]
    root, direct = F.element_at(names, -1), (F.col("links")[0]["depth2"] == F.col("depth") + 1) & F.col("links")[0]["kind"].isin("Name", "Getattr")
    dotted = F.concat_ws(".", F.array(root), F.slice(names, 1, F.size(names) - 1))
    dunder = F.try_element_at(F.filter(names, lambda x: x.isin(*t.DUNDER)), F.lit(1))
    what = F.when(dunder.isNotNull(), dunder).when(direct & dotted.isin(*t.DANGEROUS), dotted).when(direct & root.isin(*t.DANGEROUS), root)
    found(chains.withColumn("what", what).where("what is not null"), 4, "dangerous_function", "Call", F.col("what"))
    given = n.where((F.col("parent_kind") == "Filter") & (F.col("part") == "kid") & (F.col("pos") > 0) & (F.col("kind") == "Const") & F.col("text").isin(*t.DUNDER)).select(F.col(key).alias("k2"), "parent").distinct()
    attr = n.where("kind = 'Filter' and value = 'attr'").select(key, "enter", "line").join(given, F.col(key).eqNullSafe(F.col("k2")) & (F.col("enter") == F.col("parent")), "left_semi")
    found(attr, 4, "dangerous_function", "Filter", "attr")

    found(n.where((F.col("kind") == "Const") & url & F.col("text").rlike(r"(?iuU)\?(?:data|token|key|secret|password|auth)=")), 5, "exfiltration_url", "Const", "address with data in its query")
    kids = n.where(F.col("parent_kind").isin("Add", "Concat") & (F.col("part") == "kid"))
    constant = (F.col("kind") == "Const") & fixed
    joins = kids.groupBy(key, "parent", "parent_kind", "parent_line").agg(F.bool_or(constant & url).alias("address"), F.bool_and(constant).alias("fixed"))
    found(joins.where("address and not fixed"), 6, "exfiltration_url", F.col("parent_kind"), "address joined with data", "parent_line", "parent")
    target = n.where("part = 'target' and parent_kind = 'Assign' and kind = 'Name'").where(F.lower("value").contains("system") & F.lower("value").contains("prompt"))
    found(target, 7, "system_prompt_override", "Assign", F.col("value"), "parent_line", "parent")

    # Instructions anywhere below a part of an else branch, once a part and kind.
    says = n.where(F.col("kind").isin("Data", "Const") & F.col("text").rlike(_words(t.OVERRIDE)) & F.col("text").rlike(_words(t.SIGNALS)))
    says = says.select(F.col(key).alias("k2"), F.col("enter").alias("s_enter"), F.col("kind").alias("s_kind"))
    branch = n.where("part = 'else' and parent_kind = 'If'").select(key, "enter", "leave", "parent", "parent_line")
    hidden = branch.join(says, F.col(key).eqNullSafe(F.col("k2")) & (F.col("s_enter") >= F.col("enter")) & (F.col("s_enter") <= F.col("leave"))).select(key, "enter", "parent", "parent_line", "s_kind").distinct()
    found(hidden, 8, "hidden_instruction", "If", "instruction in an else branch", "parent_line", "parent", "enter", F.when(F.col("s_kind") == "Data", 0).otherwise(1))
    injected = kids.where(constant).withColumn("word", _first_word(F.col("text"), t.INJECTION)).where("word is not null")
    found(injected, 9, "prompt_injection", F.col("parent_kind"), F.col("word"), "parent_line", "parent", "pos")
    found(n.where(F.col("kind").isin("Include", "Extends", "Import", "FromImport")), 10, "template_inclusion", F.col("kind"), F.col("kind"))

    # What patterns find in the text itself; in one that can't be parsed with its line.
    broken = whole.select(F.col(key).alias("k2"), F.col("kind").alias("whole"))
    texts = df.select(key, F.col(template).alias("own")).where(F.col("own").isNotNull()).join(broken, F.col(key).eqNullSafe(F.col("k2")), "left").where("whole is null or whole = '#error'")
    bad = F.col("whole").isNotNull()
    for i, (kind, pattern) in enumerate((("dangerous_function", r"(?iu)(?:os\.system|os\.environ|subprocess\.|__import__|eval\(|exec\(|compile\()"), ("unicode_tag_smuggling", r"[\x{E0020}-\x{E007F}]"), ("zero_width_characters", r"[\x{200B}-\x{200D}\x{FEFF}\x{2060}-\x{2064}]"))):
        hit = texts.where(F.col("own").rlike(pattern) & (bad if i == 0 else F.lit(True)))
        before = F.split("own", pattern, 2)[0]
        line = F.when(bad, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")
        found(hit, 11, F.concat(F.when(bad, "poison_").otherwise(""), F.lit(kind)), F.when(bad, "PatternMatch").otherwise("TextContent"), "call of a dangerous function" if i == 0 else kind, line, F.lit(i))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    seq = (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("seq")
    high = F.regexp_replace("kind", "^poison_", "").isin(*t.HIGH)
    return out.select(key, seq, "kind", "node_type", "line", "detail", F.when(high, "high").otherwise("low").alias("severity"))
