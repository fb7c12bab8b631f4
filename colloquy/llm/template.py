"""A compiler for chat templates: source to a syntax tree, constants folded, and the tree to Python closures.

The language: text, ``{{ expression }}``, ``{# comment #}``, ``{% set x = .. %}``, ``{% if %} {% elif %} {% else %} {% endif %}``,
``{% for x in .. %} {% endfor %}`` (with ``loop.index0``, ``index``, ``first``, ``last``) and ``{% generation %} {% endgeneration %}`` around what a
model shall learn; a ``-`` inside a tag strips white space on that side.  Expressions: strings, integers, ``true false none``, names, ``x.field``,
``x[..]``, ``not and or``, comparisons, ``in``, ``+``, ``~`` (joins as text), ``a if c else b`` and filters.  The sandbox holds only texts, numbers, lists and
dictionaries: there are no calls, no attributes of Python objects and no loop without a list, so every template ends.

A template has one loop over ``messages``, at its top level, and uses ``messages`` for nothing else but ``messages | length``.  Therefore any run of
messages can be rendered apart from the others, given its place, and the pieces of a conversation add up to the whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace


class TemplateError(ValueError):
    """The template is malformed or asks for what the sandbox does not hold."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or a filter on its operands; ``and``, ``or`` and ``if`` evaluate only those they need."""

    operator: str
    operands: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    condition: object
    then: tuple
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass
class Rendered:
    """Text under way, with its length in code points and the spans of it that are generated."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


DEEPEST = 50
_TAG = re.compile(r"\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>()\[\].,|+~]))""", re.S)
_WORDS = {"true": True, "false": False, "none": None}


def _shown(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be written")


def _get(of: object, key: object) -> object:
    """A field of a dictionary or a place of a list or text; what is not there is none."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _plus(a: object, b: object) -> object:
    if type(a) is type(b) and type(a) in (str, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


def _less(a: object, b: object) -> bool:
    if type(a) is type(b) and type(a) in (str, int):
        return a < b
    raise TemplateError("only two texts or two numbers have an order")


def _in(a: object, b: object) -> bool:
    return a in b if isinstance(b, (list, dict)) or isinstance(b, str) and isinstance(a, str) else False


def _text(value: object) -> str:
    if isinstance(value, str):
        return value
    raise TemplateError("this filter takes a text")


def _length(value: object) -> int:
    if isinstance(value, (str, list, dict)):
        return len(value)
    raise TemplateError("this has no length")


_STRICT: dict[str, Callable] = {
    "get": _get, "not": lambda a: not a, "+": _plus, "~": lambda a, b: _shown(a) + _shown(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": _less, ">": lambda a, b: _less(b, a), "<=": lambda a, b: not _less(b, a), ">=": lambda a, b: not _less(a, b), "in": _in,
    "list": lambda *items: list(items),
}
_FILTERS: dict[str, Callable] = {
    "trim": lambda a: _text(a).strip(), "upper": lambda a: _text(a).upper(), "lower": lambda a: _text(a).lower(), "length": _length,
    "default": lambda a, b: b if a is None else a, "replace": lambda a, b, c: _text(a).replace(_text(b), _text(c)),
}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        self.at = self.deep = 0
        end = 0
        source = source.rstrip()
        while end < len(source):
            if not (found := _TOKEN.match(source, end)):
                raise TemplateError(f"unknown sign in {source!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            end = found.end()

    def peek(self, *wanted: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in wanted

    def take(self, *wanted: str) -> str | None:
        if not self.peek(*wanted):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted} expected")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        if kind != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return text

    def whole(self):
        found = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} not expected")
        return found

    def choice(self):
        self.deep += 1
        if self.deep > DEEPEST:
            raise TemplateError("nested too deeply")
        found = self.chain(0)
        if self.take("if"):
            condition = self.chain(0)
            found = Apply("if", (condition, found, self.choice() if self.take("else") else Const(None)))
        self.deep -= 1
        return found

    def chain(self, level: int):
        """Binary operators from the loosest to the tightest."""
        levels = (("or",), ("and",), None, ("==", "!=", "<", ">", "<=", ">=", "in"), ("+", "~"))
        if level == len(levels):
            return self.postfix()
        if levels[level] is None:
            turned = 0
            while self.take("not"):
                turned += 1
            found = self.chain(level + 1)
            return Apply("not", (Apply("not", (found,)) if turned % 2 == 0 else found,)) if turned else found
        found = self.chain(level + 1)
        while sign := self.take(*levels[level]):
            found = Apply(sign, (found, self.chain(level + 1)))
        return found

    def postfix(self):
        found = self.atom()
        while sign := self.take(".", "[", "|"):
            if sign == ".":
                found = Apply("get", (found, Const(self.name())))
            elif sign == "[":
                found = Apply("get", (found, self.choice()))
                self.need("]")
            else:
                name, operands = self.name(), [found]
                if self.take("("):
                    while not self.take(")"):
                        operands.append(self.choice())
                        if not self.peek(")"):
                            self.need(",")
                found = Name("messages_length") if name == "length" and found == Name("messages") else Apply(f"|{name}", tuple(operands))
        return found

    def atom(self):
        if self.take("("):
            found = self.choice()
            self.need(")")
            return found
        if self.take("["):
            items = []
            while not self.take("]"):
                items.append(self.choice())
                if not self.peek("]"):
                    self.need(",")
            return Apply("list", tuple(items))
        if self.at == len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if kind == "name":
            return Const(_WORDS[text]) if text in _WORDS else Name(text)
        raise TemplateError(f"{text!r} not expected")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    end, strip = 0, False
    for tag in [*_TAG.finditer(source), None]:
        text = source[end : tag.start() if tag else len(source)]
        text = text.lstrip() if strip else text
        if tag and tag[0][2] == "-" and tag[0][1] != "#":
            text = text.rstrip()
        if text:
            pieces.append(("text", text))
        if tag:
            end, strip = tag.end(), tag[0][-3] == "-" and tag[0][1] != "#"
            if tag[0][1] != "#":
                pieces.append((tag[0][1], tag[0][2:-2].strip("-").strip()))
    body, rest = _block(pieces, 0, (), 0)
    if rest < len(pieces):
        raise TemplateError(f"{pieces[rest][1]!r} not expected")
    return body


def _block(pieces: list[tuple[str, str]], at: int, until: tuple[str, ...], deep: int) -> tuple[tuple, int]:
    """The nodes from ``at`` to one of the closing tags ``until``, and the place of that tag."""
    if deep > DEEPEST:
        raise TemplateError("nested too deeply")
    nodes: list = []
    while at < len(pieces):
        kind, text = pieces[at]
        word, _, rest = text.partition(" ")
        if kind == "text":
            nodes.append(Text(text))
        elif kind == "{":
            nodes.append(Output(_Expression(text).whole()))
        elif word in until:
            return tuple(nodes), at
        elif word == "set":
            name, sign, value = rest.partition("=")
            if not sign or not name.strip().isidentifier() or name.strip() in ("messages", "loop"):
                raise TemplateError(f"{text!r} sets no name")
            nodes.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "if":
            node, at = _branches(pieces, at, rest, deep)
            nodes.append(node)
        elif word == "for":
            name, sign, over = rest.partition(" in ")
            if not sign or not name.strip().isidentifier():
                raise TemplateError(f"{text!r} loops over nothing")
            body, at = _block(pieces, at + 1, ("endfor",), deep + 1)
            nodes.append(For(name.strip(), _Expression(over).whole(), body))
        elif word == "generation":
            body, at = _block(pieces, at + 1, ("endgeneration",), deep + 1)
            nodes.append(Generation(body))
        else:
            raise TemplateError(f"{text!r} not expected")
        at += 1
    if until:
        raise TemplateError(f"{until[-1]} is missing")
    return tuple(nodes), at


def _branches(pieces: list[tuple[str, str]], at: int, condition: str, deep: int) -> tuple[If, int]:
    then, at = _block(pieces, at + 1, ("elif", "else", "endif"), deep + 1)
    word, _, rest = pieces[at][1].partition(" ")
    otherwise: tuple = ()
    if word == "elif":
        node, at = _branches(pieces, at, rest, deep + 1)
        otherwise = (node,)
    elif word == "else":
        otherwise, at = _block(pieces, at + 1, ("endif",), deep + 1)
    return If(_Expression(condition).whole(), then, otherwise), at


def fold(node, filters: dict[str, Callable]):
    """The tree with every part worked out that depends on no name: operators on constants, branches never taken, texts side by side."""
    if isinstance(node, tuple):
        out: list = []
        for part in node:
            part = fold(part, filters)
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + one.text)
                elif one != Text(""):
                    out.append(one)
        return tuple(out)
    if isinstance(node, Apply):
        node = Apply(node.operator, tuple(fold(x, filters) for x in node.operands))
        first = node.operands[0] if node.operands else None
        if node.operator in ("if", "and", "or") and isinstance(first, Const):
            if node.operator == "if":
                return node.operands[1 if first.value else 2]
            return node.operands[1] if bool(first.value) == (node.operator == "and") else first
        return Const(closure(node, filters)({})) if all(isinstance(x, Const) for x in node.operands) else node
    if isinstance(node, Output):
        value = fold(node.value, filters)
        return Text(_shown(value.value)) if isinstance(value, Const) else Output(value)
    if isinstance(node, Set):
        return replace(node, value=fold(node.value, filters))
    if isinstance(node, If):
        condition = fold(node.condition, filters)
        if isinstance(condition, Const):
            return fold(node.then if condition.value else node.otherwise, filters)
        return If(condition, fold(node.then, filters), fold(node.otherwise, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


def closure(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A function of the names in scope that evaluates an expression."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    parts = [closure(x, filters) for x in node.operands]
    if node.operator == "if":
        condition, then, otherwise = parts
        return lambda scope: then(scope) if condition(scope) else otherwise(scope)
    if node.operator == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.operator == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    function = filters.get(node.operator[1:]) if node.operator[0] == "|" else _STRICT.get(node.operator)
    if function is None:
        raise TemplateError(f"there is no filter {node.operator[1:]}")
    if len(parts) == 1:
        only = parts[0]
        return lambda scope: function(only(scope))
    if len(parts) == 2:
        one, two = parts
        return lambda scope: function(one(scope), two(scope))
    return lambda scope: function(*[p(scope) for p in parts])


def writer(nodes: tuple, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    """A function that writes the nodes for the names in scope."""
    steps = [_step(n, filters) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def write(scope: dict, out: Rendered) -> None:
        for step in steps:
            step(scope, out)

    return write


def _step(node, filters: dict[str, Callable]) -> Callable[[dict, Rendered], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda scope, out: out.add(text)
    if isinstance(node, Output):
        value = closure(node.value, filters)
        return lambda scope, out: out.add(_shown(value(scope)))
    if isinstance(node, Set):
        name, value = node.name, closure(node.value, filters)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if isinstance(node, If):
        condition, then, otherwise = closure(node.condition, filters), writer(node.then, filters), writer(node.otherwise, filters)
        return lambda scope, out: (then if condition(scope) else otherwise)(scope, out)
    if isinstance(node, Generation):
        body = writer(node.body, filters)

        def generate(scope: dict, out: Rendered) -> None:
            start = out.length
            body(scope, out)
            out.spans.append((start, out.length))

        return generate
    over, each = closure(node.over, filters), _each(node, filters)

    def loop(scope: dict, out: Rendered) -> None:
        items = over(scope)
        if not isinstance(items, list):
            raise TemplateError("a loop takes a list")
        each(scope, out, items, 0, len(items))

    return loop


def _each(node: For, filters: dict[str, Callable]) -> Callable:
    """Writes the body of a loop for a run of its items, which begins at ``first`` of ``total``; names set in the body end with it."""
    name, body = node.name, writer(node.body, filters)

    def each(scope: dict, out: Rendered, items: Sequence, first: int, total: int) -> None:
        for at, item in enumerate(items, first):
            body({**scope, name: item, "loop": {"index0": at, "index": at + 1, "first": at == 0, "last": at == total - 1, "length": total}}, out)

    return each


def _names(node) -> list[str]:
    if isinstance(node, Name):
        return [node.name]
    if isinstance(node, tuple):
        return [n for x in node for n in _names(x)]
    return [n for x in getattr(node, "__dict__", {}).values() if isinstance(x, tuple) or hasattr(x, "__dict__") for n in _names(x)]


class ChatTemplate:
    """A compiled template.  ``controls`` are the strings that mark turns; the filter ``escape`` makes a text free of them, :meth:`unescape` undoes it.

    A backslash goes before each backslash and before each character that a control string begins with, so no control string can begin in an
    escaped text, nor at its end together with what follows.
    """

    def __init__(self, source: str, controls: Sequence[str]) -> None:
        starts = "".join(sorted({c[0] for c in controls}))
        marked = re.compile(f"[{re.escape(starts)}\\\\]")
        filters = _FILTERS | {"escape": lambda a: marked.sub(r"\\\g<0>", _shown(a))}
        self.tree = fold(parse(source), filters)
        loops = [i for i, node in enumerate(self.tree) if isinstance(node, For) and node.over == Name("messages")]
        if len(loops) != 1 or _names(self.tree).count("messages") != 1:
            raise TemplateError("a template has one loop over messages and no other use of them but their length")
        at = loops[0]
        self._head, self._each, self._tail = writer(self.tree[:at], filters), _each(self.tree[at], filters), writer(self.tree[at + 1 :], filters)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def render(self, messages: Sequence[dict], first: int = 0, total: int | None = None) -> tuple[str, list[tuple[int, int]]]:
        """Text and generated spans (code points, end exclusive) of the messages from place ``first`` of a conversation of ``total``."""
        total = len(messages) if total is None else total
        scope, out, unseen = {"messages_length": total}, Rendered(), Rendered()
        self._head(scope, unseen if first else out)
        self._each(scope, out, messages, first, total)
        if first + len(messages) == total:
            self._tail(scope, out)
        return "".join(out.parts), out.spans
