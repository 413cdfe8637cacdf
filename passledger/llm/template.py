"""A small sandboxed template language: parser, constant folding, closures.

``{{ expression }}`` writes a value, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in xs %} {% endfor %}``, ``{% set x = e %}`` and ``{% generation %}
{% endgeneration %}``, which marks what it encloses as model output. Expressions have
literals, names, ``a.b`` on mappings, ``+ == != < > in and or not``, parentheses and
filters ``| name``. There are no calls, subscripts or attributes of objects, so a
template reaches nothing but the values it is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|[-+<>|().=]))""")
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """The template is not one of this language."""


def _lex(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.rstrip()
    while at < len(source):
        match = _TOKENS.match(source, at)
        if not match:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind, text = match.lastgroup, match.group(match.lastgroup)
        found.append(("op" if text in _WORDS and kind == "name" and text not in ("true", "false", "none") else kind, text))
        at = match.end()
    return found


class _Expression:
    """Recursive descent; a node is a tuple that begins with its kind."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str | None:
        if self.peek(*wanted):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take("==", "!=", "<", ">", "in"):
            node = (op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "-"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.single()
        while self.take("|"):
            node = ("filter", self.name(), node)
        return node

    def single(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("str", "num", "name"):
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "str":
                node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
            elif kind == "num":
                node = ("const", int(text))
            else:
                fixed = {"true": True, "false": False, "none": None}
                node = ("const", fixed[text]) if text in fixed else ("name", text)
        else:
            raise TemplateError("an expression is missing")
        while self.take("."):
            node = ("field", node, self.name())
        return node


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for match in _PARTS.finditer(source):
        if match.start() > at:
            parts.append(("text", source[at : match.start()]))
        parts.append(("value", match[1]) if match[1] is not None else ("tag", match[2].strip()))
        at = match.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()  # a stack, next part last
    tree, closer = _block(parts)
    if closer:
        raise TemplateError(f"{closer!r} closes nothing")
    return tree


def _block(parts: list[tuple[str, str]]) -> tuple[tuple, str]:
    """Nodes up to a tag that belongs to what encloses them, and that tag."""
    nodes: list[tuple] = []
    while parts:
        kind, body = parts.pop()
        word, _, rest = body.partition(" ")
        if kind == "text":
            nodes.append(("text", body))
        elif kind == "value":
            nodes.append(("write", _Expression(body).whole()))
        elif word == "if":
            nodes.append(_choice(rest, parts))
        elif word == "for":
            target, found, source = rest.partition(" in ")
            if not found or not target.strip().isidentifier():
                raise TemplateError(f"cannot read {body!r}")
            nodes.append(("for", target.strip(), _Expression(source).whole(), _closed(parts, "endfor")))
        elif word == "set":
            target, found, value = rest.partition("=")
            if not found or not target.strip().isidentifier():
                raise TemplateError(f"cannot read {body!r}")
            nodes.append(("set", target.strip(), _Expression(value).whole()))
        elif word == "generation":
            nodes.append(("generation", _closed(parts, "endgeneration")))
        else:
            return ("all", nodes), body
    return ("all", nodes), ""


def _closed(parts: list[tuple[str, str]], closer: str) -> tuple:
    tree, found = _block(parts)
    if found != closer:
        raise TemplateError(f"{closer!r} is missing")
    return tree


def _choice(condition: str, parts: list[tuple[str, str]]) -> tuple:
    test = _Expression(condition).whole()
    then, closer = _block(parts)
    word, _, rest = closer.partition(" ")
    if word == "elif":
        return ("if", test, then, ("all", [_choice(rest, parts)]))
    if word == "else":
        return ("if", test, then, _closed(parts, "endif"))
    if word != "endif":
        raise TemplateError("'endif' is missing")
    return ("if", test, then, ("all", []))


_BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda v: v.strip(), "upper": lambda v: v.upper(), "lower": lambda v: v.lower(), "length": len,
    "string": str, "default": lambda v: "" if v is None else v,
}


def fold(node: tuple, filters: Mapping[str, Callable]) -> tuple:
    """The tree with constant expressions, choices and neighbouring texts worked out."""
    kind = node[0]
    if kind in _BINARY or kind in ("and", "or"):
        left, right = fold(node[1], filters), fold(node[2], filters)
        if left[0] == "const" and kind in ("and", "or"):
            return right if bool(left[1]) == (kind == "and") else left
        if left[0] == right[0] == "const":
            return ("const", _worked(_BINARY[kind], left[1], right[1]))
        return (kind, left, right)
    if kind == "not":
        inner = fold(node[1], filters)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "filter":
        inner = fold(node[2], filters)
        if node[1] not in filters:
            raise TemplateError(f"no filter {node[1]!r}")
        return ("const", _worked(filters[node[1]], inner[1])) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "field":
        return ("field", fold(node[1], filters), node[2])
    if kind == "write":
        inner = fold(node[1], filters)
        return ("text", _text(inner[1])) if inner[0] == "const" else ("write", inner)
    if kind == "if":
        test = fold(node[1], filters)
        if test[0] == "const":
            _known_filters(node, filters)  # those of the branch that goes as well
            return fold(node[2] if test[1] else node[3], filters)
        return ("if", test, fold(node[2], filters), fold(node[3], filters))
    if kind == "for":
        return ("for", node[1], fold(node[2], filters), fold(node[3], filters))
    if kind == "set":
        return ("set", node[1], fold(node[2], filters))
    if kind == "generation":
        return ("generation", fold(node[1], filters))
    if kind == "all":
        nodes: list[tuple] = []
        for inner in (fold(n, filters) for n in node[1]):
            for part in inner[1] if inner[0] == "all" else [inner]:
                if part[0] == "text" and nodes and nodes[-1][0] == "text":
                    nodes[-1] = ("text", nodes[-1][1] + part[1])
                elif part != ("text", ""):
                    nodes.append(part)
        return ("all", nodes)
    return node


def _worked(rule: Callable, *values):
    """A rule on constants; what it cannot take is an error of the template."""
    try:
        return rule(*values)
    except (TypeError, ValueError, AttributeError) as fault:
        raise TemplateError(f"{values!r}: {fault}") from fault


def _known_filters(node, filters: Mapping[str, Callable]) -> None:
    if isinstance(node, tuple) and len(node) > 1 and node[0] == "filter" and node[1] not in filters:
        raise TemplateError(f"no filter {node[1]!r}")
    if isinstance(node, (tuple, list)):
        for part in node:
            _known_filters(part, filters)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(node: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    if kind == "field":
        def field(scope, source=_value(node[1], filters), name=node[2]):
            value = source(scope)
            return value.get(name) if isinstance(value, Mapping) else None

        return field
    if kind == "filter":
        return lambda scope, f=filters[node[1]], v=_value(node[2], filters): f(v(scope))
    if kind == "not":
        return lambda scope, v=_value(node[1], filters): not v(scope)
    left, right = _value(node[1], filters), _value(node[2], filters)
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    if kind == "or":
        return lambda scope: left(scope) or right(scope)
    return lambda scope, f=_BINARY[kind]: f(left(scope), right(scope))


def _writer(node: tuple, filters: Mapping[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        return lambda scope, piece=(node[1], marked): iter((piece,))
    if kind == "write":
        return lambda scope, v=_value(node[1], filters): iter(((_text(v(scope)), marked),))
    if kind == "generation":
        return _writer(node[1], filters, True)
    if kind == "if":
        test, then, other = _value(node[1], filters), _writer(node[2], filters, marked), _writer(node[3], filters, marked)
        return lambda scope: then(scope) if test(scope) else other(scope)
    if kind == "set":
        def assign(scope, name=node[1], v=_value(node[2], filters)):
            scope[name] = v(scope)
            return iter(())

        return assign
    if kind == "for":
        source, body = _value(node[2], filters), _writer(node[3], filters, marked)

        def loop(scope, name=node[1]):
            inner = dict(scope)
            for index, item in enumerate(source(scope) or ()):
                inner[name], inner["loop"] = item, {"index": index + 1, "index0": index, "first": index == 0}
                yield from body(inner)

        return loop
    writers = [_writer(n, filters, marked) for n in node[1]]

    def everything(scope):
        for write in writers:
            yield from write(scope)

    return everything


def compiled(source: str, filters: Mapping[str, Callable] | None = None) -> Callable[[Iterable[Mapping]], Iterator[Piece]]:
    """A function from messages to pieces (text, whether it is model output).

    Messages are taken one at a time, and their pieces come before the next is taken.
    """
    known = FILTERS | dict(filters or {})
    write = _writer(fold(parse(source), known), known, False)
    return lambda messages, **given: write({"messages": messages, **given})
