"""A small sandboxed template language, compiled to closures.

Text with ``{{ expression }}``, ``{# comment #}`` and the statements ``for``, ``if``/``elif``/``else``,
``set`` and ``generation``; ``-`` inside a mark trims the white space beside it. ``generation`` marks
what a model is trained to write. Expressions hold constants, names, ``value.field``,
``value['field']``, filters, comparisons, ``in``, ``and``/``or``/``not``, ``~`` (joins as text), ``+``,
``-``, ``%`` and ``a if c else b``. There are no calls; only fields of dictionaries are read, and every name must
be known when the template is compiled, so a template reaches nothing but the messages and its own variables.

The source is parsed into a tree; operations on constants are done there, branches that cannot be taken
go, and neighbouring texts are joined. What is left becomes Python closures. ``messages`` is consumed
as a stream: the loop over it stands at the top level, once, and a rendered conversation comes out turn by
turn, so memory holds one turn and the one after it (for ``loop.last``).
"""

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

Segment = tuple[str, bool]  # text, and whether it stands under the generation mark
Write = Callable[[dict, list[Segment]], None]

LOOP_FIELDS = ("index", "index0", "first", "last")
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(_text(v)),
    "string": lambda v: _text(v),
}


class TemplateError(ValueError):
    """The template cannot be compiled, or read a field that is not there."""


# --- tree -------------------------------------------------------------------


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Field(NamedTuple):
    value: Any
    field: Any


class Apply(NamedTuple):
    """A pure function of its parts: an operator or a filter."""

    function: Callable
    parts: tuple


class Choose(NamedTuple):
    """``kind`` is ``and``, ``or`` or ``if``; later parts are evaluated only if needed."""

    kind: str
    parts: tuple


class Text(NamedTuple):
    value: str


class Output(NamedTuple):
    value: Any


class If(NamedTuple):
    branches: tuple  # (condition, body) pairs; Const(True) stands for else


class For(NamedTuple):
    name: str
    source: Any
    body: tuple


class Set(NamedTuple):
    name: str
    value: Any


class Generation(NamedTuple):
    body: tuple


# --- reading ----------------------------------------------------------------

_MARK = re.compile(r"(?s)\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}")
_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
    r"""|(?P<sign>==|!=|<=|>=|[-<>+~%|.()\[\]=]))""", re.S)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_ADD = {"+": operator.add, "-": operator.sub, "~": lambda a, b: _text(a) + _text(b)}
_WORDS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_RESERVED = {"and", "or", "not", "in", "if", "else", "is", "for"} | set(_WORDS)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content) pairs of kind text, output or statement, trimmed."""
    found, at, cut = [], 0, False
    for mark in _MARK.finditer(source):
        text = source[at : mark.start()]
        out_l, out, out_r, stat_l, stat, stat_r, note_l, note_r = mark.groups()
        text = text.lstrip() if cut else text
        text = text.rstrip() if out_l or stat_l or note_l else text
        found.append(("text", text))
        if out is not None:
            found.append(("output", out))
        elif stat is not None:
            found.append(("statement", stat.strip()))
        at, cut = mark.end(), bool(out_r or stat_r or note_r)
    rest = source[at:]
    if "{{" in rest or "{%" in rest or "{#" in rest:
        raise TemplateError(f"unclosed mark: {rest[:40]!r}")
    return found + [("text", rest.lstrip() if cut else rest)]


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.tokens, at = filters, [], 0
        source = source.rstrip()
        while at < len(source):
            match = _TOKEN.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at = 0

    def whole(self) -> Any:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            other = self.choice() if self.take("else") else Const("")
            return Choose("if", (condition, value, other))
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            value = Choose("or", (value, self.both()))
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            value = Choose("and", (value, self.negated()))
        return value

    def negated(self) -> Any:
        if self.take("not"):
            return Apply(operator.not_, (self.negated(),))
        return self.compared()

    def compared(self) -> Any:
        value = self.sum()
        while True:
            if sign := self.take(*_COMPARE):
                value = Apply(_COMPARE[sign], (value, self.sum()))
            elif self.take("in"):
                value = Apply(lambda a, b: a in b, (value, self.sum()))
            elif self.take("not"):
                self.need("in")
                value = Apply(lambda a, b: a not in b, (value, self.sum()))
            else:
                return value

    def sum(self) -> Any:
        value = self.rest()
        while sign := self.take(*_ADD):
            value = Apply(_ADD[sign], (value, self.rest()))
        return value

    def rest(self) -> Any:
        value = self.filtered()
        while self.take("%"):
            # Remainders only: formatting with % could make texts of any size.
            value = Apply(lambda a, b: int(a) % int(b), (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.part()
        while self.take("|"):
            kind, name = self.next()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            value = Apply(self.filters[name], (value,))
        return value

    def next(self) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise TemplateError("expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def part(self) -> Any:
        kind, value = self.next()
        if kind == "string":
            tree: Any = Const(re.sub(r"(?s)\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        elif kind == "number":
            tree = Const(int(value))
        elif value == "(":
            tree = self.choice()
            self.need(")")
        elif kind == "name" and value in _WORDS:
            tree = Const(_WORDS[value])
        elif kind == "name" and value not in _RESERVED:
            tree = Name(value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                kind, value = self.next()
                if kind != "name":
                    raise TemplateError(f"unexpected {value!r} after a dot")
                tree = Field(tree, Const(value))
            else:
                tree = Field(tree, self.choice())
                self.need("]")
        return tree


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.pieces, self.filters, self.at = _pieces(source), filters, 0

    def whole(self) -> tuple:
        body, end = self.body(())
        assert end is None
        return body

    def expression(self, source: str) -> Any:
        return _Expression(source, self.filters).whole()

    def body(self, ends: tuple[str, ...]) -> tuple[tuple, str | None]:
        nodes: list[Any] = []
        while self.at < len(self.pieces):
            kind, content = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Text(content))
            elif kind == "output":
                nodes.append(Output(self.expression(content)))
            elif content.split(None, 1)[:1] and content.split(None, 1)[0] in ends:
                return tuple(nodes), content
            else:
                nodes.append(self.statement(content))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), None

    def statement(self, content: str) -> Any:
        word, _, rest = content.partition(" ")
        if word == "if":
            branches, end = [], f"if {rest}"
            while not end.startswith("endif"):
                condition = Const(True) if end.strip() == "else" else self.expression(end.partition(" ")[2])
                ends = ("endif",) if end.strip() == "else" else ("elif", "else", "endif")
                body, end = self.body(ends)
                branches.append((condition, body))
            return If(tuple(branches))
        if word == "for":
            match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not match or match[1] in _RESERVED:
                raise TemplateError(f"cannot read {content!r}")
            source = self.expression(match[2])
            return For(match[1], source, self.body(("endfor",))[0])
        if word == "set":
            match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not match or match[1] in _RESERVED or match[1] in ("messages", "loop"):
                raise TemplateError(f"cannot read {content!r}")
            return Set(match[1], self.expression(match[2]))
        if content == "generation":
            return Generation(self.body(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {content!r}")


# --- folding ----------------------------------------------------------------


def fold(tree: Any) -> Any:
    """An expression with its constant parts worked out."""
    if isinstance(tree, Field):
        return Field(fold(tree.value), fold(tree.field))
    if isinstance(tree, Apply):
        parts = tuple(map(fold, tree.parts))
        if all(isinstance(p, Const) for p in parts):
            try:
                return Const(tree.function(*[p.value for p in parts]))
            except (TypeError, ValueError, ArithmeticError) as fault:
                raise TemplateError(f"constant expression fails: {fault}") from fault
        return Apply(tree.function, parts)
    if isinstance(tree, Choose):
        first, *rest = map(fold, tree.parts)
        if not isinstance(first, Const):
            return Choose(tree.kind, (first, *rest))
        if tree.kind == "if":
            return rest[0] if first.value else rest[1]
        return first if bool(first.value) == (tree.kind == "or") else rest[0]
    return tree


def fold_body(body: Iterable[Any]) -> tuple:
    """Nodes with constants folded, dead branches gone and neighbouring texts joined."""
    nodes: list[Any] = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and nodes and isinstance(nodes[-1], Text):
            nodes[-1] = Text(nodes[-1].value + node.value)
        elif not (isinstance(node, Text) and not node.value):
            nodes.append(node)

    for node in body:
        if isinstance(node, Output):
            value = fold(node.value)
            add(Text(_text(value.value)) if isinstance(value, Const) else Output(value))
        elif isinstance(node, If):
            branches: list[tuple] = []
            for condition, inner in node.branches:
                condition = fold(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold_body(inner)))
                if isinstance(condition, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for inner in branches[0][1]:
                    add(inner)
            elif branches:
                add(If(tuple(branches)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.source), fold_body(node.body)))
        elif isinstance(node, Set):
            add(Set(node.name, fold(node.value)))
        elif isinstance(node, Generation):
            add(Generation(fold_body(node.body)))
        else:
            add(node)
    return tuple(nodes)


# --- closures ---------------------------------------------------------------


def _value(tree: Any, known: set[str]) -> Callable[[dict], Any]:
    if isinstance(tree, Const):
        return lambda scope, v=tree.value: v
    if isinstance(tree, Name):
        if tree.name == "messages":
            raise TemplateError("messages can only be looped over, once, at the top level")
        if tree.name not in known:
            raise TemplateError(f"unknown name {tree.name!r}")
        return lambda scope, n=tree.name: scope[n]
    if isinstance(tree, Field):
        value, field = _value(tree.value, known), _value(tree.field, known)

        def read(scope: dict) -> Any:
            holder, name = value(scope), field(scope)
            if not isinstance(holder, dict) or name not in holder:
                raise TemplateError(f"no field {name!r}")
            return holder[name]

        return read
    if isinstance(tree, Apply):
        parts = [_value(p, known) for p in tree.parts]
        if len(parts) == 1:
            return lambda scope, f=tree.function, a=parts[0]: f(a(scope))
        return lambda scope, f=tree.function, a=parts[0], b=parts[1]: f(a(scope), b(scope))
    first, second, *third = [_value(p, known) for p in tree.parts]
    if tree.kind == "if":
        return lambda scope: second(scope) if first(scope) else third[0](scope)
    if tree.kind == "and":
        return lambda scope: first(scope) and second(scope)
    return lambda scope: first(scope) or second(scope)


def _body(nodes: tuple, known: set[str], marked: bool) -> Write:
    steps = [_node(n, known, marked) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: list[Segment]) -> None:
        for step in steps:
            step(scope, out)

    return run


def _node(node: Any, known: set[str], marked: bool) -> Write:
    """``known`` gains the names that the node sets."""
    if isinstance(node, Text):
        segment = (node.value, marked)
        return lambda scope, out: out.append(segment)
    if isinstance(node, Output):
        value = _value(node.value, known)
        return lambda scope, out: out.append((_text(value(scope)), marked))
    if isinstance(node, Set):
        value = _value(node.value, known)
        known.add(node.name)
        return lambda scope, out, n=node.name: scope.__setitem__(n, value(scope))
    if isinstance(node, Generation):
        if marked:
            raise TemplateError("generation inside generation")
        return _body(node.body, known, True)
    if isinstance(node, If):
        before, after = set(known), []
        branches = []
        for condition, body in node.branches:
            inner = set(before)
            branches.append((_value(condition, before), _body(body, inner, marked)))
            after.append(inner)
        whole = isinstance(node.branches[-1][0], Const)
        known |= set.intersection(*after) if whole else set()

        def choose(scope: dict, out: list[Segment]) -> None:
            for condition, body in branches:
                if condition(scope):
                    return body(scope, out)

        return choose
    raise TemplateError("a loop over messages stands at the top level, other loops are not known")


class Template:
    """A compiled template. ``control`` strings in a text are masked by the filter ``guard``."""

    def __init__(self, source: str, control: Iterable[str] = (), names: dict[str, Any] | None = None):
        self.constants = dict(names or {})
        self.guard = Guard(control)
        filters = FILTERS | {"guard": lambda v: self.guard.mask(_text(v))}
        self.tree = fold_body(_Parser(source, filters).whole())
        known, self.steps = set(self.constants), []
        looped = False
        for node in self.tree:
            if isinstance(node, For):
                if node.source != Name("messages") or looped:
                    raise TemplateError("messages can only be looped over, once, at the top level")
                looped = True
                # What a turn sets is gone after the loop, as a conversation may have no turn.
                self.steps.append((node.name, _body(node.body, known | {node.name, "loop"}, False)))
            else:
                self.steps.append((None, _node(node, known, False)))

    def render(self, messages: Iterable[dict]) -> Iterator[Segment]:
        """Segments in order; ``messages`` is read as the segments are."""
        scope = dict(self.constants)
        for name, write in self.steps:
            if name is None:
                out: list[Segment] = []
                write(scope, out)
                yield from out
                continue
            inner = dict(scope)
            for index, (message, last) in enumerate(_with_last(messages)):
                out = []
                inner[name] = message
                inner["loop"] = dict(zip(LOOP_FIELDS, (index + 1, index, index == 0, last)))
                write(inner, out)
                yield from out


def _with_last(items: Iterable[Any]) -> Iterator[tuple[Any, bool]]:
    waiting, none = None, True
    for item in items:
        if not none:
            yield waiting, False
        waiting, none = item, False
    if not none:
        yield waiting, True


class Guard:
    r"""Masks control strings reversibly: a backslash more after the first character.

    ``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``; other backslashes stay. No masked text holds
    a control string, and taking one backslash off gives the text back. A first character must not
    occur again in any control string, so that no two of them overlap.
    """

    def __init__(self, control: Iterable[str]):
        self.control = tuple(dict.fromkeys(control))
        firsts = {c[:1] for c in self.control}
        for text in self.control:
            if len(text) < 2 or "\\" in text[:2] or firsts & set(text[1:]):
                raise TemplateError(f"cannot guard {text!r}")
        each = "|".join(
            f"{re.escape(f)}(\\\\*)(?={'|'.join(re.escape(c[1:]) for c in self.control if c[0] == f)})" for f in sorted(firsts))
        self._plain = re.compile(each) if each else None

    def mask(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0] + "\\", text) if self._plain else text

    def unmask(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][:-1] if m[0].endswith("\\") else m[0], text) if self._plain else text
