"""A sandboxed template language for conversations, compiled to Python closures.

``Template`` reads a source to a syntax tree, folds what is constant, and turns every node into a
closure.  Statements: ``{{ expression }}``, ``{% if %} .. {% elif %} .. {% else %} .. {% endif %}``, ``{% for x in list %} .. {% endfor %}``,
``{% set x = expression %}`` (within its block), ``{% generation %} .. {% endgeneration %}`` (its text goes under the loss
mask), ``{# comment #}``; ``-`` beside a brace strips blanks on that side.  Expressions: texts, whole numbers, ``true false none``, lists,
names, ``a.b`` and ``a[b]``, ``+ - % ~``, comparisons, ``in``, ``not and or``, ``x if c else y``, ``is [not] none / defined``, filters ``x | name(...)``.

Sandbox: names stand for what the caller gives, ``.`` and ``[]`` read keys of dicts and places of lists and never
attributes of objects, there are no calls but the filters below, and loops only walk given lists.

A template's outermost loop over ``messages`` makes it divisible: what stands before, in and after
that loop renders on its own (``Template.head``, ``turn``, ``tail``), so a conversation of any length can be rendered in pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class TemplateError(ValueError):
    """The source is no template of this language, or asks for what it may not have."""


class Output:
    """Text under construction, with the spans (start, end) of generation blocks."""

    def __init__(self):
        self.parts: list[str] = []
        self.n = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.n += len(text)

    def text(self) -> str:
        return "".join(self.parts)


# ------------------------------------------------------------------ filters
def guard(text: str) -> str:
    """Break control strings: one ``!`` more after a ``<`` that ``!`` and ``|`` follow.  No
    ``<|`` is left, and ``unguard`` gives the text back."""
    return re.sub(r"<(!*)\|", r"<!\1|", text)


def unguard(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


def line(text: str) -> str:
    """A text without line feeds: backslashes and line feeds as two characters."""
    return text.replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def _text(value: Any) -> str:
    if value is None:
        return ""
    if value is True or value is False:
        return "true" if value else "false"
    return value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable] = {
    "guard": lambda x: guard(_text(x)), "line": lambda x: line(_text(x)), "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or ()),
    "default": lambda x, y="": y if x is None else x, "replace": lambda x, a, b: _text(x).replace(a, b),
    "join": lambda x, sep="": sep.join(map(_text, x or ())),
}

# ------------------------------------------------------------------ lexing
_TAG = re.compile(r"(\{\{-?|\{%-?|\{#)")
_ENDS = {"{{": re.compile(r"-?\}\}"), "{%": re.compile(r"-?%\}"), "{#": re.compile(r"-?#\}")}
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<sign>==|!=|<=|>=|[-+%~|.,()\[\]<>=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        at, kind = m.end(), m.lastgroup
        value: Any = m[kind]
        if kind == "text":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif kind == "number":
            value = int(value)
        elif kind == "name" and value in _WORDS:
            kind, value = "sign", value.lower()
        out.append((kind, value))
    return [*out, ("end", None)]


def _end_of_tag(source: str, at: int, kind: str) -> re.Match:
    """The tag's end; braces inside quoted texts do not count."""
    end = _ENDS[kind]
    while at < len(source):
        m = end.match(source, at)
        if m:
            return m
        if kind != "{#" and source[at] in "'\"":
            quoted = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\"""", re.S).match(source, at)
            if not quoted:
                break
            at = quoted.end()
        else:
            at += 1
    raise TemplateError(f"{kind} is not closed")


def _pieces(source: str) -> list[tuple[str, Any]]:
    """("text", str), ("{{", tokens) and ("{%", tokens) in order."""
    out, at, strip = [], 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at:m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        if m is None:
            out.append(("text", text))
            return out
        out.append(("text", text.rstrip() if m[0].endswith("-") else text))
        kind = m[0][:2]
        end = _end_of_tag(source, m.end(), kind)
        if kind != "{#":
            out.append((kind, _tokens(source[m.end():end.start()])))
        at, strip = end.end(), end[0].startswith("-")


# ------------------------------------------------------------------ syntax tree
# expressions: ("const", v) ("name", n) ("item", a, b) ("list", [..]) ("filter", name, [..]) ("not", a) ("and"|"or", a, b)
#              ("if", test, yes, no) ("defined", name) (operator, a, b)
# statements:  ("text", s) ("show", e) ("if", [(test, body) ..]) ("for", name, e, body) ("set", name, e) ("generation", body)
_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in (b if b is not None else ()), "+": lambda a, b: a + b, "-": lambda a, b: a - b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _modulo(a, b):
    if not isinstance(a, int):
        raise TemplateError("% takes numbers")
    return a % b


def _item(a, b):
    if isinstance(a, dict):
        return a.get(b)
    if isinstance(a, (list, str)) and isinstance(b, int):
        return a[b] if -len(a) <= b < len(a) else None
    return None


_BINARY |= {"%": _modulo, "item": _item}
_LOOP = ("index", "index0", "first", "last", "length")


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self, *signs) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "sign" and value in signs

    def take(self, *signs):
        kind, value = self.tokens[self.at]
        if not self.peek(*signs):
            raise TemplateError(f"expected {' or '.join(signs)}, found {value!r}")
        self.at += 1
        return value

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def done(self) -> None:
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        value = self.either()
        if self.peek("if"):
            self.take("if")
            test = self.either()
            no = ("const", None)
            if self.peek("else"):
                self.take("else")
                no = self.expression()
            return ("if", test, value, no)
        return value

    def _chain(self, signs, part):
        left = part()
        while self.peek(*signs):
            left = (self.take(*signs), left, part())
        return left

    def either(self):
        return self._chain(("or",), lambda: self._chain(("and",), self.negated))

    def negated(self):
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        left = self.joined()
        if self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            return (self.take("==", "!=", "<", ">", "<=", ">=", "in"), left, self.joined())
        if self.peek("not"):
            self.take("not")
            self.take("in")
            return ("not", ("in", left, self.joined()))
        if self.peek("is"):
            self.take("is")
            negate = self.peek("not") and bool(self.take("not"))
            if self.peek("none"):
                self.take("none")
                test = ("==", left, ("const", None))
            elif self.name() == "defined" and left[0] in ("name", "item"):
                test = ("!=", left, ("const", None)) if left[0] == "item" else ("defined", left[1])
            else:
                raise TemplateError("tests are none and defined")
            return ("not", test) if negate else test
        return left

    def joined(self):
        return self._chain(("~",), lambda: self._chain(("+", "-"), self.product))

    def product(self):
        return self._chain(("%",), self.filtered)

    def filtered(self):
        value = self.postfix()
        while self.peek("|"):
            self.take("|")
            name, args = self.name(), [value]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.peek("("):
                self.take("(")
                args += self.listed(")")
            value = ("filter", name, args)
        return value

    def listed(self, end):
        out = []
        while not self.peek(end):
            out.append(self.expression())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return out

    def postfix(self):
        value = self.atom()
        while self.peek(".", "["):
            if self.take(".", "[") == ".":
                value = ("item", value, ("const", self.name()))
            else:
                value = ("item", value, self.expression())
                self.take("]")
        return value

    def atom(self):
        kind, value = self.tokens[self.at]
        if kind in ("text", "number"):
            self.at += 1
            return ("const", value)
        if kind == "name":
            return ("name", self.name())
        sign = self.take("true", "false", "none", "(", "[", "-")
        if sign == "(":
            value = self.expression()
            self.take(")")
            return value
        if sign == "[":
            return ("list", self.listed("]"))
        if sign == "-":
            return ("-", ("const", 0), self.atom())
        return ("const", {"true": True, "false": False, "none": None}[sign])


def _body(pieces: list, ends: tuple[str, ...]) -> tuple[list, str, _Parser | None]:
    """Statements up to one of the ``ends``, which is taken; ``pieces`` stands in reverse."""
    out: list = []
    while pieces:
        kind, value = pieces.pop()
        if kind == "text":
            if value:
                out.append(("text", value))
            continue
        p = _Parser(value)
        if kind == "{{":
            out.append(("show", p.expression()))
            p.done()
            continue
        word = p.take("if", "else") if p.peek("if", "else") else p.name()
        if word in ends:
            return out, word, p
        if word == "if":
            arms, test = [], p.expression()
            while True:
                p.done()
                body, word, p = _body(pieces, ("endif",) if word == "else" else ("elif", "else", "endif"))
                arms.append((test, body))
                if word == "endif":
                    break
                test = p.expression() if word == "elif" else ("const", True)
            out.append(("if", arms))
        elif word == "for":
            name = p.name()
            p.take("in")
            source = p.expression()
            p.done()
            body, _, p = _body(pieces, ("endfor",))
            out.append(("for", name, source, body))
        elif word == "set":
            name = p.name()
            p.take("=")
            out.append(("set", name, p.expression()))
        elif word == "generation":
            p.done()
            body, _, p = _body(pieces, ("endgeneration",))
            out.append(("generation", body))
        else:
            raise TemplateError(f"no statement {word}")
        p.done()
    if ends:
        raise TemplateError(f"missing {ends[-1]}")
    return out, "", None


# ------------------------------------------------------------------ folding
def _computed(node, args):
    """The constant that a filter or operator gives; one that fails is left to fail where it is run."""
    try:
        return ("const", FILTERS[node[1]](*args) if node[0] == "filter" else _BINARY[node[0]](*args))
    except (ArithmeticError, TypeError, AttributeError, TemplateError):
        return node


def fold(node, given: dict):
    """An expression with every constant part computed; names in ``given`` are constants."""
    kind = node[0]
    if kind == "name" and node[1] in given:
        return ("const", given[node[1]])
    if kind == "defined" and node[1] in given:
        return ("const", True)
    if kind in ("const", "name", "defined"):
        return node
    if kind in ("list", "filter"):
        args = [fold(x, given) for x in node[-1]]
        if all(a[0] == "const" for a in args):
            values = [a[1] for a in args]
            return ("const", values) if kind == "list" else _computed((*node[:-1], args), values)
        return (*node[:-1], args)
    parts = [fold(x, given) for x in node[1:]]
    if kind == "not":
        return ("const", not parts[0][1]) if parts[0][0] == "const" else ("not", parts[0])
    if kind in ("and", "or", "if") and parts[0][0] == "const":
        yes = bool(parts[0][1])
        if kind == "if":
            return parts[1] if yes else parts[2]
        return parts[1] if yes == (kind == "and") else parts[0]
    if kind in _BINARY and all(p[0] == "const" for p in parts):
        return _computed((kind, *parts), [p[1] for p in parts])
    return (kind, *parts)


def fold_body(body: list, given: dict) -> list:
    """Statements with constant texts merged and arms that cannot be taken left out."""
    out: list = []

    def put(node):
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for node in body:
        kind = node[0]
        if kind == "show":
            e = fold(node[1], given)
            put(("text", _text(e[1])) if e[0] == "const" else ("show", e))
        elif kind == "if":
            arms = []
            for test, arm in node[1]:
                test = fold(test, given)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold_body(arm, given)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const" and not any(n[0] == "set" for n in arms[0][1]):
                for n in arms[0][1]:
                    put(n)
            elif arms:
                put(("if", arms))
        elif kind == "for":
            put(("for", node[1], fold(node[2], given), fold_body(node[3], given)))
        elif kind == "set":
            put(("set", node[1], fold(node[2], given)))
        elif kind == "generation":
            put(("generation", fold_body(node[1], given)))
        else:
            put(node)
    return out


# ------------------------------------------------------------------ closures
def _value(node) -> Callable[[dict], Any]:
    """A closure from names to the expression's value."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "defined":
        return lambda env, n=node[1]: n in env
    if kind == "list":
        parts = [_value(x) for x in node[1]]
        return lambda env: [p(env) for p in parts]
    if kind == "filter":
        call, parts = FILTERS[node[1]], [_value(x) for x in node[2]]
        if len(parts) == 1:
            only = parts[0]
            return lambda env: call(only(env))
        return lambda env: call(*[p(env) for p in parts])
    parts = [_value(x) for x in node[1:]]
    if kind == "not":
        return lambda env, a=parts[0]: not a(env)
    if kind == "and":
        return lambda env, a=parts[0], b=parts[1]: a(env) and b(env)
    if kind == "or":
        return lambda env, a=parts[0], b=parts[1]: a(env) or b(env)
    if kind == "if":
        return lambda env, t=parts[0], a=parts[1], b=parts[2]: a(env) if t(env) else b(env)
    return lambda env, call=_BINARY[kind], a=parts[0], b=parts[1]: call(a(env), b(env))


def _loop(index: int, length: int) -> dict:
    return dict(zip(_LOOP, (index + 1, index, index == 0, index + 1 == length, length)))


def _statement(node) -> Callable[[dict, Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda env, out, s=node[1]: out.add(s)
    if kind == "show":
        return lambda env, out, e=_value(node[1]): out.add(_text(e(env)))
    if kind == "set":
        def assign(env, out, name=node[1], e=_value(node[2])):
            env[name] = e(env)
        return assign
    if kind == "generation":
        def marked(env, out, body=_block(node[1])):
            start = out.n
            body(env, out)
            out.spans.append((start, out.n))
        return marked
    if kind == "if":
        def chosen(env, out, arms=[(_value(t), _block(b)) for t, b in node[1]]):
            for test, body in arms:
                if test(env):
                    return body(env, out)
        return chosen

    def repeated(env, out, name=node[1], source=_value(node[2]), body=_block(node[3])):
        items = source(env) or []
        if not isinstance(items, list):
            raise TemplateError("for walks lists")
        for k, item in enumerate(items):
            body({**env, name: item, "loop": _loop(k, len(items))}, out)
    return repeated


def _block(body: list) -> Callable[[dict, Output], None]:
    parts = [_statement(n) for n in body]
    if len(parts) == 1:
        return parts[0]

    def run(env, out):
        for p in parts:
            p(env, out)
    return run


def _names(node) -> set[str]:
    """Names that a statement or expression reads."""
    if isinstance(node, tuple) and node and node[0] in ("name", "defined"):
        return {node[1]}
    if isinstance(node, (tuple, list)):
        return set().union(*[_names(x) for x in node])
    return set()


def _bound(body: list) -> set[str]:
    """Names that statements set or loop with."""
    out = {"loop"}
    for n in body:
        if n[0] in ("set", "for"):
            out.add(n[1])
        inner = [n[3]] if n[0] == "for" else [n[1]] if n[0] == "generation" else [b for _, b in n[1]] if n[0] == "if" else []
        out |= set().union(*map(_bound, inner))
    return out


class Template:
    """A compiled template.  ``head(out)``, ``turn(message, index, length, out)`` and
    ``tail(out)`` render its parts, ``render(messages)`` all of it."""

    def __init__(self, source: str, given: dict | None = None):
        body, _, _ = _body(_pieces(source)[::-1], ())
        given = dict(given or {})
        self.tree = fold_body(body, {k: v for k, v in given.items() if k not in _bound(body)})
        walks = [k for k, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        if len(walks) != 1 or sum("messages" in _names(n) for n in self.tree) != 1 or "messages" in _names(self.tree[walks[0]][3]):
            raise TemplateError("a template reads messages in one outermost loop, once")
        at = walks[0]
        self.name = self.tree[at][1]
        self._head, self._turn, self._tail = _block(self.tree[:at]), _block(self.tree[at][3]), _block(self.tree[at + 1:])
        self.env = given
        start = Output()
        self._head(self.env, start)  # what the head sets holds for the turns
        self._start = start

    def head(self, out: Output) -> None:
        shift = out.n
        out.add(self._start.text())
        out.spans += [(a + shift, b + shift) for a, b in self._start.spans]

    def turn(self, message: dict, index: int, length: int, out: Output) -> None:
        self._turn({**self.env, self.name: message, "loop": _loop(index, length)}, out)

    def tail(self, out: Output) -> None:
        self._tail(dict(self.env), out)

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        """Text and spans under the loss mask, of a whole conversation."""
        out = Output()
        self.head(out)
        for k, m in enumerate(messages):
            self.turn(m, k, len(messages), out)
        self.tail(out)
        return out.text(), out.spans
