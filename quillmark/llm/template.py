"""A sandboxed template language, compiled to Python closures.

Syntax: ``{{ expression }}``, ``{% for x in expression %}``, ``{% if %} / {% elif %} / {% else %}``, ``{% set x = e %}``
and ``{% generation %} ... {% endgeneration %}``, which marks output that a model is to learn.  Expressions have
literals, names, ``a.b``, ``a['b']``, ``a | filter``, ``+``, comparisons, ``in``, ``and``, ``or`` and ``not``.  There
are no calls, no attributes of Python objects (``a.b`` looks up a key of a mapping) and no filters but those given, so
a template reaches nothing but its inputs.

``compile_template`` parses to a syntax tree, folds constants (expressions of literals, branches with a constant test,
neighbouring literal text) and returns a function that yields (text, learn) pairs.  Loops draw their items one by one,
so a conversation of any length renders in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+\-%|.\[\]()~]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
FILTERS: dict[str, Callable[[Any], Any]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len, "string": str}


class TemplateError(ValueError):
    pass


def tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected text in expression: {source[at : at + 20]!r}")
        at = m.end()
        if m[1]:
            out.append(("const", re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), m[1][1:-1], flags=re.S)))
        elif m[2]:
            out.append(("const", int(m[2])))
        elif m[3]:
            out.append(("const", {"true": True, "false": False, "none": None}[m[3].lower()]) if m[3].lower() in ("true", "false", "none") else ("op" if m[3] in ("and", "or", "not", "in") else "name", m[3]))
        else:
            out.append(("op", m[4]))
    return out


class Expression:
    """Precedence climbing over the tokens of one expression; nodes are tuples."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "-", "~"), ("%",))

    def __init__(self, source: str):
        self.tokens, self.at = tokens(source), 0

    def whole(self) -> tuple:
        tree = self.level(0)
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def level(self, n: int) -> tuple:
        if n == len(self.LEVELS):
            return self.postfix()
        if self.LEVELS[n] == ("not",):
            return ("not", self.level(n)) if self.take("not") else self.level(n + 1)
        left = self.level(n + 1)
        while op := self.take(*self.LEVELS[n]):
            left = ("binary", op, left, self.level(n + 1))
        return left

    def postfix(self) -> tuple:
        tree = self.atom()
        while op := self.take(".", "[", "|"):
            if op == "[":
                tree = ("item", tree, self.level(0))
                if not self.take("]"):
                    raise TemplateError("missing ]")
            else:
                name = self.name()
                tree = ("item", tree, ("const", name)) if op == "." else ("filter", tree, name)
        return tree

    def name(self) -> str:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.level(0)
            if not self.take(")"):
                raise TemplateError("missing )")
            return tree
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("const", "name"):
            self.at += 1
            return self.tokens[self.at - 1]
        raise TemplateError("an expression is missing")


def parse(source: str) -> list[tuple]:
    """The syntax tree: text, out, for, if, set and generation nodes."""
    parts, at = [], 0
    for m in TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    parts.append(("text", source[at:]))
    place = 0

    def block(*ends: str) -> tuple[list[tuple], str]:
        nonlocal place
        nodes: list[tuple] = []
        while place < len(parts):
            kind, what = parts[place]
            place += 1
            if kind == "text":
                if what:
                    nodes.append(("text", what))
            elif kind == "out":
                nodes.append(("out", Expression(what).whole()))
            else:
                word, _, rest = what.partition(" ")
                if word in ends:
                    return nodes, what
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad loop: {rest!r}")
                    nodes.append(("for", m[1], Expression(m[2]).whole(), block("endfor")[0]))
                elif word == "if":
                    branches, test = [], Expression(rest).whole()
                    while True:
                        body, end = block("elif", "else", "endif")
                        branches.append((test, body))
                        if end.split()[0] == "endif":
                            break
                        test = Expression(end.partition(" ")[2]).whole() if end.startswith("elif") else ("const", True)
                    nodes.append(("if", branches))
                elif word == "set":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad assignment: {rest!r}")
                    nodes.append(("set", m[1], Expression(m[2]).whole()))
                elif word == "generation":
                    nodes.append(("generation", block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown or stray tag: {what!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, ""

    return block()[0]


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "%": lambda a, b: a % b if isinstance(a, int) else _refuse("% is for numbers"),
    "~": lambda a, b: str(a) + str(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _refuse(why: str):
    raise TemplateError(why)


def fold(tree: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Constant subexpressions become constants."""
    kind = tree[0]
    if kind == "binary":
        a, b = fold(tree[2], filters), fold(tree[3], filters)
        return ("const", BINARY[tree[1]](a[1], b[1])) if a[0] == b[0] == "const" else ("binary", tree[1], a, b)
    if kind == "not":
        a = fold(tree[1], filters)
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold(tree[1], filters)
        if tree[2] not in filters:
            raise TemplateError(f"unknown filter {tree[2]!r}")
        return ("const", filters[tree[2]](a[1])) if a[0] == "const" else ("filter", a, tree[2])
    if kind == "item":
        return ("item", fold(tree[1], filters), fold(tree[2], filters))
    return tree


def fold_block(nodes: list[tuple], filters: Mapping[str, Callable]) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in nodes:
        if node[0] == "out":
            tree = fold(node[1], filters)
            add(("text", shown(tree[1])) if tree[0] == "const" else ("out", tree))
        elif node[0] == "for":
            add(("for", node[1], fold(node[2], filters), fold_block(node[3], filters)))
        elif node[0] == "set":
            add(("set", node[1], fold(node[2], filters)))
        elif node[0] == "generation":
            add(("generation", fold_block(node[1], filters)))
        elif node[0] == "if":
            branches: list[tuple] = []
            for test, body in node[1]:
                test = fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold_block(body, filters)))
                if test[0] == "const":
                    break
            if branches and branches[0][0][0] == "const":
                for x in branches[0][1]:
                    add(x)
            elif branches:
                add(("if", branches))
        else:
            add(node)
    return out


def shown(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


def evaluator(tree: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda env: value
    if kind == "name":
        name = tree[1]
        return lambda env: env.get(name)
    if kind == "item":
        of, key = evaluator(tree[1], filters), evaluator(tree[2], filters)

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, Mapping):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    if kind == "filter":
        of, f = evaluator(tree[1], filters), filters[tree[2]]
        return lambda env: f(of(env))
    if kind == "not":
        of = evaluator(tree[1], filters)
        return lambda env: not of(env)
    op, a, b = tree[1], evaluator(tree[2], filters), evaluator(tree[3], filters)
    if op == "and":
        return lambda env: a(env) and b(env)
    if op == "or":
        return lambda env: a(env) or b(env)
    f = BINARY[op]
    return lambda env: f(a(env), b(env))


Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def writer(nodes: list[tuple], filters: Mapping[str, Callable]) -> Writer:
    steps = [_step(node, filters) for node in nodes]

    def run(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        for step in steps:
            yield from step(env, learn)

    return run


def _step(node: tuple, filters: Mapping[str, Callable]) -> Writer:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def run(env, learn):
            yield text, learn

    elif kind == "out":
        value = evaluator(node[1], filters)

        def run(env, learn):
            yield shown(value(env)), learn

    elif kind == "set":
        name, value = node[1], evaluator(node[2], filters)

        def run(env, learn):
            env[name] = value(env)
            return iter(())

    elif kind == "generation":
        body = writer(node[1], filters)

        def run(env, learn):
            return body(env, True)

    elif kind == "if":
        branches = [(evaluator(t, filters), writer(b, filters)) for t, b in node[1]]

        def run(env, learn):
            for test, body in branches:
                if test(env):
                    yield from body(env, learn)
                    return

    else:
        name, items, body = node[1], evaluator(node[2], filters), writer(node[3], filters)

        def run(env, learn):
            loop, ahead = iter(items(env) or ()), object()
            item, i = next(loop, ahead), 0
            while item is not ahead:
                after = next(loop, ahead)
                inner = env | {name: item, "loop": {"first": i == 0, "last": after is ahead, "index": i + 1, "index0": i}}
                yield from body(inner, learn)
                item, i = after, i + 1

    return run


def compile_template(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the template's variables that yields (text, learn) pairs in order."""
    known = FILTERS | dict(filters or {})
    body = writer(fold_block(parse(source), known), known)
    return lambda **env: body(dict(env), False)
