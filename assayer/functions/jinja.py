"""A bounded parser of Jinja text into plain nodes; nothing is ever rendered.

Default delimiters, white-space control, comments and raw blocks; the built-in statements only: any other tag is an
error, as it is without extensions.  Depth of nesting is capped, so hostile input cannot exhaust the stack."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_DEPTH = 120


class JinjaError(Exception):
    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.line = line


@dataclass
class Node:
    kind: str
    line: int
    value: object = None
    kids: list = field(default_factory=list)
    body: dict = field(default_factory=dict)  # named parts: test, else, target, ...

    def walk(self):
        """All nodes below, parents first."""
        todo = [*self.parts()][::-1]
        while todo:
            n = todo.pop()
            yield n
            todo += [*n.parts()][::-1]

    def parts(self):
        yield from self.kids
        for p in self.body.values():
            yield from p if isinstance(p, list) else [p]


_OPEN = re.compile(r"\{([%{#])([-+]?)")
_TOKEN = re.compile(r"""\s+|(?P<num>\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<op>\*\*|//|==|!=|>=|<=|[-+/*%~\[\](){}<>=.:|,;])""", re.S)


def tokens(text: str):
    """(kind, value, line): data, begin and end of blocks and expressions, and the tokens inside."""
    at, line, strip = 0, 1, False
    while at < len(text):
        m = _OPEN.search(text, at)
        data = text[at : m.start() if m else len(text)]
        shown = data.lstrip() if strip else data
        if m and m[2] == "-":
            shown = shown.rstrip()
        if shown:
            yield "data", shown, line
        line += data.count("\n")
        if not m:
            return
        at, strip = m.end(), False
        if m[1] == "#":
            end = re.compile(r"([-+]?)#\}").search(text, at)
            if not end:
                raise JinjaError("comment without an end", line)
            line += text.count("\n", at, end.end())
            at, strip = end.end(), end[1] == "-"
            continue
        if m[1] == "%" and (raw := re.compile(r"\s*raw\s*[-+]?%\}").match(text, at)):
            end = re.compile(r"\{%[-+]?\s*endraw\s*([-+]?)%\}").search(text, raw.end())
            if not end:
                raise JinjaError("raw block without an end", line)
            yield "data", text[raw.end() : end.start()], line
            line += text.count("\n", at, end.end())
            at, strip = end.end(), end[1] == "-"
            continue
        close, depth = ("%}", 0) if m[1] == "%" else ("}}", 0)
        yield ("block" if m[1] == "%" else "print"), None, line
        while True:
            space = re.compile(r"\s*").match(text, at)
            line += text.count("\n", at, space.end())
            at = space.end()
            if depth == 0 and (end := re.compile(r"([-+]?)" + re.escape(close)).match(text, at)):
                yield "end", None, line
                at, strip = end.end(), end[1] == "-"
                if m[1] == "%" and text.startswith("\n", at):  # the default keeps it; only the line count matters
                    pass
                break
            t = _TOKEN.match(text, at)
            if not t or at >= len(text):
                raise JinjaError(f"unexpected character at {at}" if at < len(text) else "unexpected end", line)
            kind, value = t.lastgroup, t[0]
            if kind == "op":
                depth += (value in "([{") - (value in ")]}")
                if depth < 0:
                    raise JinjaError(f"unexpected {value}", line)
            yield kind, value, line
            line += value.count("\n")
            at = t.end()


class Parser:
    def __init__(self, text: str):
        self.all = [*tokens(text), ("eof", None, text.count("\n") + 1)]
        self.at, self.depth = 0, 0

    @property
    def now(self):
        return self.all[self.at]

    def line(self):
        return self.now[2]

    def step(self):
        self.at += 1
        return self.all[self.at - 1]

    def has(self, kind: str, *values: str) -> bool:
        return self.now[0] == kind and (not values or self.now[1] in values)

    def skip(self, kind: str, *values: str) -> bool:
        if self.has(kind, *values):
            self.at += 1
            return True
        return False

    def need(self, kind: str, *values: str):
        if not self.has(kind, *values):
            raise JinjaError(f"expected {' or '.join(values) or kind}, found {self.now[1] or self.now[0]}", self.line())
        return self.step()

    def deeper(self, f, *args):
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise JinjaError("nesting too deep", self.line())
        try:
            return f(*args)
        finally:
            self.depth -= 1

    # Statements.
    def parse(self) -> Node:
        return Node("Template", 1, kids=self.until())

    def until(self, *ends: str) -> list[Node]:
        """Nodes up to one of the end tags, which stays open after its name."""
        out = []
        while True:
            kind, value, line = self.now
            if kind == "eof":
                if ends:
                    raise JinjaError(f"expected {' or '.join(ends)} before the end", line)
                return out
            self.at += 1
            if kind == "data":
                out.append(Node("Data", line, value))
            elif kind == "print":
                out.append(self.tuple_or_one())
                self.need("end")
            elif self.has("name", *ends) and ends:
                return out
            else:
                out.append(self.deeper(self.statement))

    def close(self, *ends: str) -> None:
        self.need("name", *ends)
        self.need("end")

    def block(self, end: str) -> list[Node]:
        self.need("end")
        body = self.until(end)
        self.step()
        return body

    def statement(self) -> Node:
        line = self.line()
        name = self.need("name")[1]
        f = getattr(self, f"tag_{name}", None)
        if f is None:
            raise JinjaError(f"unknown tag {name}", line)
        node = f(line)
        self.need("end")
        return node

    def tag_if(self, line: int) -> Node:
        node = Node("If", line, body={"test": self.tuple_or_one()})
        self.need("end")
        node.kids = self.until("elif", "else", "endif")
        node.body["elif"], node.body["else"] = [], []
        while True:
            _, name, at = self.step()
            if name == "elif":
                part = Node("If", at, body={"test": self.tuple_or_one()})
                self.need("end")
                part.kids = self.until("elif", "else", "endif")
                node.body["elif"].append(part)
            elif name == "else":
                self.need("end")
                node.body["else"] = self.until("endif")
            else:
                return node

    def tag_for(self, line: int) -> Node:
        target = self.targets()
        self.need("name", "in")
        node = Node("For", line, body={"target": target, "iter": self.tuple_or_one(with_condition=False)})
        if self.skip("name", "if"):
            node.body["test"] = self.expression()
        self.skip("name", "recursive")
        self.need("end")
        node.kids = self.until("else", "endfor")
        if self.step()[1] == "else":
            self.need("end")
            node.body["else"] = self.until("endfor")
            self.step()
        return node

    def targets(self) -> Node:
        line, out = self.line(), []
        while True:
            if self.skip("op", "("):
                out.append(self.targets())
                self.need("op", ")")
            else:
                n = Node("Name", line, self.need("name")[1])
                if self.skip("op", "."):
                    n = Node("NSRef", line, (n.value, self.need("name")[1]))
                out.append(n)
            if not self.skip("op", ",") or self.has("name", "in"):
                return out[0] if len(out) == 1 else Node("Tuple", line, kids=out)

    def tag_set(self, line: int) -> Node:
        target = self.targets()
        if self.skip("op", "="):
            return Node("Assign", line, body={"target": target, "value": self.tuple_or_one()})
        node = Node("AssignBlock", line, body={"target": target})
        while self.skip("op", "|"):
            node.body.setdefault("filters", []).append(self.filter(Node("Const", line)))
        node.kids = self.block("endset")
        return node

    def signature(self) -> list[Node]:
        out = []
        self.need("op", "(")
        while not self.skip("op", ")"):
            out.append(Node("Name", self.line(), self.need("name")[1]))
            if self.skip("op", "="):
                out.append(self.expression())
            if not self.has("op", ")"):
                self.need("op", ",")
        return out

    def tag_macro(self, line: int) -> Node:
        name = self.need("name")[1]
        return Node("Macro", line, name, self.signature() + self.block("endmacro"))

    def tag_call(self, line: int) -> Node:
        args = self.signature() if self.has("op", "(") else []
        call = self.expression()
        if call.kind != "Call":
            raise JinjaError("call block without a call", line)
        return Node("CallBlock", line, kids=[*args, call, *self.block("endcall")])

    def tag_filter(self, line: int) -> Node:
        node = self.filter(Node("Const", line))
        while self.skip("op", "|"):
            node = self.filter(node)
        return Node("FilterBlock", line, kids=[node, *self.block("endfilter")])

    def context(self) -> None:
        if self.has("name", "with", "without") and self.all[self.at + 1][1] == "context":
            self.at += 2

    def tag_include(self, line: int) -> Node:
        node = Node("Include", line, kids=[self.expression()])
        if self.has("name", "ignore"):
            self.step()
            self.need("name", "missing")
        self.context()
        return node

    def tag_import(self, line: int) -> Node:
        node = Node("Import", line, kids=[self.expression()])
        self.need("name", "as")
        self.need("name")
        self.context()
        return node

    def tag_from(self, line: int) -> Node:
        node = Node("FromImport", line, kids=[self.expression()])
        self.need("name", "import")
        while self.has("name") and not (self.has("name", "with", "without") and self.all[self.at + 1][1] == "context"):
            self.step()
            if self.skip("name", "as"):
                self.need("name")
            if not self.skip("op", ","):
                break
        self.context()
        return node

    def tag_extends(self, line: int) -> Node:
        return Node("Extends", line, kids=[self.expression()])

    def tag_block(self, line: int) -> Node:
        name = self.need("name")[1]
        while self.skip("name", "scoped", "required"):
            pass
        body = self.block("endblock")
        self.skip("name", name)
        return Node("Block", line, name, body)

    def tag_with(self, line: int) -> Node:
        kids = []
        while not self.has("end"):
            kids.append(self.targets())
            self.need("op", "=")
            kids.append(self.expression())
            self.skip("op", ",")
        return Node("With", line, kids=kids + self.block("endwith"))

    def tag_autoescape(self, line: int) -> Node:
        return Node("Scope", line, kids=[self.expression(), *self.block("endautoescape")])

    # Expressions.
    def tuple_or_one(self, with_condition: bool = True) -> Node:
        line, out = self.line(), []
        while True:
            if out and (self.has("end") or self.has("op", ")")):
                break
            out.append(self.expression(with_condition))
            if not self.skip("op", ","):
                if len(out) == 1:
                    return out[0]
                break
        return Node("Tuple", line, kids=out)

    def expression(self, with_condition: bool = True) -> Node:
        return self.deeper(self.conditional if with_condition else self.disjunction)

    def conditional(self) -> Node:
        node = self.disjunction()
        while self.has("name", "if"):
            line = self.step()[2]
            test = self.disjunction()
            other = self.conditional() if self.skip("name", "else") else Node("Nothing", line)
            node = Node("CondExpr", line, body={"test": test, "yes": node, "no": other})
        return node

    def pairs(self, below, kind: str, *names: str) -> Node:
        node = below()
        while self.has("name", *names):
            line = self.step()[2]
            node = Node(kind, line, kids=[node, below()])
        return node

    def disjunction(self) -> Node:
        return self.pairs(self.conjunction, "Or", "or")

    def conjunction(self) -> Node:
        return self.pairs(self.negation, "And", "and")

    def negation(self) -> Node:
        if self.has("name", "not"):
            return Node("Not", self.step()[2], kids=[self.deeper(self.negation)])
        return self.comparison()

    def comparison(self) -> Node:
        line, node, others = self.line(), self.sums(), []
        while True:
            if self.skip("op", "==", "!=", "<", ">", "<=", ">=") or self.skip("name", "in"):
                others.append(self.sums())
            elif self.has("name", "not") and self.all[self.at + 1][:2] == ("name", "in"):
                self.at += 2
                others.append(self.sums())
            else:
                return Node("Compare", line, kids=[node, *others]) if others else node

    def chain(self, below, kinds: dict[str, str]) -> Node:
        node = below()
        while self.has("op", *kinds):
            _, op, line = self.step()
            node = Node(kinds[op], line, kids=[node, below()])
        return node

    def sums(self) -> Node:
        return self.chain(self.joins, {"+": "Add", "-": "Sub"})

    def joins(self) -> Node:
        line, out = self.line(), [self.products()]
        while self.skip("op", "~"):
            out.append(self.products())
        return out[0] if len(out) == 1 else Node("Concat", line, kids=out)

    def products(self) -> Node:
        return self.chain(self.signed, {"*": "Mul", "/": "Div", "//": "FloorDiv", "%": "Mod"})

    def signed(self, filters: bool = True) -> Node:
        if self.has("op", "-", "+"):
            node = Node("Neg", self.step()[2], kids=[self.deeper(self.signed, False)])
        else:
            node = self.postfix(self.primary())
            if self.has("op", "**"):
                node = Node("Pow", self.step()[2], kids=[node, self.deeper(self.signed, False)])
        return self.suffixes(node) if filters else node

    def primary(self) -> Node:
        kind, value, line = self.step()
        if kind == "name":
            plain = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return Node("Const", line, plain[value]) if value in plain else Node("Name", line, value)
        if kind == "num":
            return Node("Const", line, float(value.replace("_", "")) if re.search(r"[.eE]", value) else int(value.replace("_", "")))
        if kind == "str":
            parts = [value]
            while self.has("str"):
                parts.append(self.step()[1])
            return Node("Const", line, "".join(_plain(p) for p in parts))
        if kind == "op" and value == "(":
            node = Node("Tuple", line) if self.has("op", ")") else self.tuple_or_one()
            self.need("op", ")")
            return node
        if kind == "op" and value == "[":
            return Node("List", line, kids=self.listed("]"))
        if kind == "op" and value == "{":
            kids = []
            while not self.skip("op", "}"):
                kids.append(self.expression())
                self.need("op", ":")
                kids.append(self.expression())
                if not self.has("op", "}"):
                    self.need("op", ",")
            return Node("Dict", line, kids=kids)
        raise JinjaError(f"unexpected {value or kind}", line)

    def listed(self, end: str) -> list[Node]:
        out = []
        while not self.skip("op", end):
            if self.skip("op", "*") or self.skip("op", "**"):
                pass
            elif self.has("name") and self.all[self.at + 1][:2] == ("op", "=") and end == ")":
                self.at += 2
            out.append(self.expression())
            if not self.has("op", end):
                self.need("op", ",")
        return out

    def postfix(self, node: Node) -> Node:
        while True:
            line = self.line()
            if self.skip("op", "."):
                kind, value, _ = self.step()
                if kind not in ("name", "num"):
                    raise JinjaError("expected a name after the dot", line)
                node = Node("Getattr" if kind == "name" else "Getitem", line, value, [node])
            elif self.skip("op", "["):
                node = Node("Getitem", line, kids=[node, *self.subscript()])
            elif self.skip("op", "("):
                node = Node("Call", line, kids=[node, *self.listed(")")])
            else:
                return node

    def subscript(self) -> list[Node]:
        out = []
        while not self.skip("op", "]"):
            if not self.skip("op", ":") and not self.skip("op", ","):
                out.append(self.expression())
        return out

    def filter(self, node: Node) -> Node:
        line = self.line()
        name = self.need("name")[1]
        while self.skip("op", "."):
            name += "." + self.need("name")[1]
        return Node("Filter", line, name, [node, *(self.listed(")") if self.skip("op", "(") else [])])

    def suffixes(self, node: Node) -> Node:
        while True:
            if self.skip("op", "|"):
                node = self.filter(node)
            elif self.has("name", "is"):
                line = self.step()[2]
                self.skip("name", "not")
                name, kids = self.need("name")[1], [node]
                if self.skip("op", "("):
                    kids += self.listed(")")
                elif self.now[0] in ("name", "str", "num") and not self.has("name", "else", "or", "and", "is", "if", "in", "not"):
                    kids.append(self.postfix(self.primary()))
                node = Node("Test", line, name, kids)
            elif self.has("op", "(", ".", "["):
                node = self.postfix(node)
            else:
                return node


def _plain(quoted: str) -> str:
    inner = quoted[1:-1]
    if "\\" not in inner:
        return inner
    plain = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}

    def one(m):
        c = m[1]
        return chr(int(c[1:], 16)) if len(c) > 1 else plain.get(c, "\\" + c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|.)", one, inner, flags=re.S)


def parse(text: str) -> Node:
    try:
        return Parser(text).parse()
    except RecursionError:
        raise JinjaError("nesting too deep", 1) from None
