"""The part of the CUE language that configuration files use.

Structs, lists, strings, numbers, booleans, types, disjunctions with defaults, references, let, comments, and fields of several
labels. All files are one package: what they say about a field is unified, so their order doesn't matter; two different
concrete values are an error, and a default gives way to a concrete value.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r'(?P<space>[ \t\r]+|//[^\n]*)|(?P<nl>\n)|(?P<long>"""\n?.*?""")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<num>[+-]?\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<id>[#_A-Za-z$][\w$#]*)|(?P<sign>\.\.\.|[{}\[\]:,|*&().?!<>=])', re.S)
TYPES = {"string": str, "int": int, "float": float, "number": float, "bool": bool}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "/": "/"}


class CueError(ValueError):
    pass


class Bottom(Exception):
    """Values that don't fit together."""


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else ESCAPES.get(m[1], m[0]), text)


def _long(text: str) -> str:
    lines = text[3:-3].removeprefix("\n").split("\n")
    indent = lines[-1] if not lines[-1].strip() else ""
    return _unescape("\n".join(line.removeprefix(indent) for line in lines[:-1]) if indent == lines[-1] else "\n".join(lines))


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise CueError(f"unexpected {source[at]!r} at line {source.count(chr(10), 0, at) + 1}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("nl", "\n"), ("end", "")]


class Parser:
    """Expressions: ('lit', v), ('type', name), ('ref', [names]), ('struct', fields, lets), ('list', items), ('or', [(default, e)]),
    ('and', [e]). fields: [(label, e)]."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, skip: bool = False) -> tuple[str, str]:
        while skip and self.tokens[self.at][0] == "nl":
            self.at += 1
        return self.tokens[self.at]

    def take(self, text: str = "", skip: bool = False) -> tuple[str, str]:
        token = self.peek(skip)
        if text and token[1] != text:
            raise CueError(f"expected {text!r}, found {token[1]!r}")
        self.at += 1
        return token

    def fields(self, close: str):
        out, lets = [], {}
        while self.peek(True)[1] != close or self.peek()[0] in ("str", "long"):
            kind, text = self.take()
            if kind == "end":
                raise CueError("a struct isn't closed")
            if text == "," and kind == "sign":
                continue
            if text == "..." and kind == "sign":
                continue
            if text == "package" and self.peek()[0] == "id":
                self.take()
                continue
            if text == "let" and self.peek()[0] == "id":
                name = self.take()[1]
                self.take("=")
                lets[name] = self.expression()
                continue
            if kind not in ("id", "str", "num"):
                raise CueError(f"unexpected {text!r}")
            label = _unescape(text[1:-1]) if kind == "str" else text
            if self.peek()[1] in ("?", "!"):
                self.take()
            if self.peek()[1] != ":":
                raise CueError(f"expected ':' after {label!r}")
            self.take(":")
            out.append((label, self.value_of_field()))
        self.take(close, True) if close else None
        return out, lets

    def value_of_field(self):
        """What stands behind a label: another label and its value, or an expression."""
        kind, text = self.peek(True)
        after = self.tokens[self.at + 1][1], self.tokens[self.at + 2][1]
        if kind in ("id", "str") and (after[0] == ":" or (after[0] in ("?", "!") and after[1] == ":")):
            self.take()
            if self.peek()[1] in ("?", "!"):
                self.take()
            self.take(":")
            label = _unescape(text[1:-1]) if kind == "str" else text
            return ("struct", [(label, self.value_of_field())], {})
        return self.expression()

    def expression(self):
        options = []
        while True:
            default = self.peek(True) == ("sign", "*")
            if default:
                self.take()
            parts = [self.operand()]
            while self.peek() == ("sign", "&"):
                self.take()
                parts.append(self.operand())
            options.append((default, parts[0] if len(parts) == 1 else ("and", parts)))
            if self.peek() != ("sign", "|"):
                return options[0][1] if len(options) == 1 and not options[0][0] else ("or", options)
            self.take()

    def operand(self):
        kind, text = self.take(skip=True)
        if kind == "str":
            if re.search(r"(?<!\\)(?:\\\\)*\\\(", text):
                raise CueError("interpolation isn't supported")
            return ("lit", _unescape(text[1:-1]))
        if kind == "long":
            return ("lit", _long(text))
        if kind == "num":
            plain = text.replace("_", "")
            return ("lit", float(plain) if re.search("[.eE]", plain) else int(plain))
        if text == "{":
            return ("struct", *self.fields("}"))
        if text == "[":
            return self.items()
        if text == "(":
            inner = self.expression()
            self.take(")", True)
            return inner
        if kind == "id":
            if text in ("true", "false", "null"):
                return ("lit", {"true": True, "false": False, "null": None}[text])
            if text in TYPES or text == "_":
                return ("type", text)
            names = [text]
            while self.peek()[1] in (".", "["):
                if self.take()[1] == ".":
                    names.append(self.take()[1].strip('"'))
                else:
                    names.append(_unescape(self.take()[1][1:-1]))
                    self.take("]")
            return ("ref", names)
        raise CueError(f"unexpected {text!r}")

    def items(self):
        out = []
        while self.peek(True)[1] != "]":
            if self.peek() == ("id", "for"):  # [for k, v in pass {v}]: the fields' values
                self.take()
                names = [self.take()[1]]
                while self.peek()[1] == ",":
                    self.take()
                    names.append(self.take()[1])
                if self.take()[1] != "in":
                    raise CueError("expected 'in'")
                source = self.operand()
                body = re.sub(r"\s", "", "".join(t for _, t in self._braces()))
                if body.strip("{}") != names[-1]:
                    raise CueError("a comprehension can only list values as they are")
                out.append(("each", source))
            else:
                out.append(("item", self.expression()))
            if self.peek(True)[1] == ",":
                self.take()
        self.take("]", True)
        return ("list", out)

    def _braces(self):
        depth, out = 0, []
        while True:
            token = self.take(skip=True)
            depth += (token[1] == "{") - (token[1] == "}")
            out.append(token)
            if not depth or token[0] == "end":
                return out


def parse(source: str):
    """The fields and lets of a file."""
    p = Parser(source)
    found = p.fields("")
    if p.peek(True)[0] != "end":
        raise CueError(f"unexpected {p.peek()[1]!r}")
    return found


class Alternatives(list):
    """(default, value) pairs."""


class Kind:
    def __init__(self, name: str):
        self.name = name


class Package:
    """All files together. value() gives plain data: dicts, lists, scalars."""

    def __init__(self):
        self.fields: list[tuple[str, tuple, dict]] = []
        self.open: set[str] = set()

    def add(self, source: str) -> list[str]:
        """Takes a file; returns the names of the passes that it defines."""
        fields, lets = parse(source)
        self.fields += [(name, e, lets) for name, e in fields]
        return [label for name, e in fields if name == "pass" and e[0] == "struct" for label, _ in e[1]]

    def unified(self, name: str):
        if name in self.open:
            raise CueError(f"{name} refers to itself")
        self.open.add(name)
        try:
            found = [self.evaluate(e, lets) for label, e, lets in self.fields if label == name]
            return self.all_of(found, name)
        finally:
            self.open.discard(name)

    def all_of(self, values: list, path: str):
        out = Kind("_")
        for value in values:
            try:
                out = unify(out, value)
            except Bottom as error:
                raise CueError(f"{path}: {error}") from error
        return out

    def evaluate(self, e, lets: dict):
        kind = e[0]
        if kind == "lit":
            return e[1]
        if kind == "type":
            return Kind(e[1])
        if kind == "or":
            out = Alternatives()
            for default, x in e[1]:
                value = self.evaluate(x, lets)
                out += [(default or d, v) for d, v in value] if isinstance(value, Alternatives) else [(default, value)]
            return out
        if kind == "and":
            return self.all_of([self.evaluate(x, lets) for x in e[1]], "&")
        if kind == "struct":
            inner, out = lets | e[2], {}
            for label, x in e[1]:
                value = self.evaluate(x, inner)
                try:
                    out[label] = unify(out[label], value) if label in out else value
                except Bottom as error:
                    raise CueError(f"{label}: {error}") from error
            return out
        if kind == "list":
            out = []
            for what, x in e[1]:
                value = self.evaluate(x, lets)
                out += list(value.values()) if what == "each" else [value]
            return out
        head, *rest = e[1]
        if head in lets:
            value = self.evaluate(lets[head], {k: v for k, v in lets.items() if k != head})
        elif any(label == head for label, *_ in self.fields):
            value = self.unified(head)
        else:
            raise CueError(f"reference {head!r} not found")
        for name in rest:
            if not isinstance(value, dict) or name not in value:
                raise CueError(f"undefined field {'.'.join(e[1])}")
            value = value[name]
        return value

    def names(self) -> list[str]:
        return list(dict.fromkeys(label for label, *_ in self.fields))


def unify(a, b):
    if isinstance(a, Kind) and a.name == "_":
        return b
    if isinstance(b, Kind) and b.name == "_":
        return a
    if isinstance(a, Alternatives) or isinstance(b, Alternatives):
        x, y = (v if isinstance(v, Alternatives) else Alternatives([(None, v)]) for v in (a, b))
        out = Alternatives()
        for d, v in x:
            for e, w in y:
                try:
                    both = unify(v, w)
                except Bottom:
                    continue
                # a side without defaults has no say
                has = [s for s, m in ((d, x), (e, y)) if any(k for k, _ in m)]
                out.append((bool(has) and all(has), both))
        if not out:
            raise Bottom(f"conflicting values {plain_text(a)} and {plain_text(b)}")
        return out[0][1] if len(out) == 1 else out
    if isinstance(a, Kind) and isinstance(b, Kind):
        if a.name == b.name or {a.name, b.name} <= {"int", "float", "number"} and "number" in (a.name, b.name):
            return a if b.name == "number" else b
        raise Bottom(f"conflicting values {a.name} and {b.name}")
    if isinstance(a, Kind) or isinstance(b, Kind):
        kind, value = (a, b) if isinstance(a, Kind) else (b, a)
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) if kind.name in ("float", "number") else isinstance(value, TYPES[kind.name]) and (kind.name == "bool" or not isinstance(value, bool))
        if not fits:
            raise Bottom(f"{plain_text(value)} is no {kind.name}")
        return value
    if isinstance(a, dict) and isinstance(b, dict):
        out = dict(a)
        for k, v in b.items():
            try:
                out[k] = unify(out[k], v) if k in out else v
            except Bottom as error:
                raise Bottom(f"{k}: {error}") from error
        return out
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [unify(x, y) for x, y in zip(a, b)]
    if type(a) is type(b) and a == b or {type(a), type(b)} == {int, float} and a == b:
        return a
    raise Bottom(f"conflicting values {plain_text(a)} and {plain_text(b)}")


def plain_text(value) -> str:
    return value.name if isinstance(value, Kind) else repr(value)


def concrete(value, path: str = ""):
    """Plain data of a value: of alternatives the default."""
    if isinstance(value, Alternatives):
        chosen = [v for d, v in value if d] or [v for _, v in value]
        different = []
        for v in chosen:
            if not isinstance(v, Kind) and v not in different:
                different.append(v)
        if len(different) != 1 or (not any(d for d, _ in value) and len(value) > 1):
            raise CueError(f"{path}: incomplete or ambiguous value")
        return concrete(different[0], path)
    if isinstance(value, Kind):
        raise CueError(f"{path}: incomplete value {value.name}")
    if isinstance(value, dict):
        return {k: concrete(v, f"{path}.{k}".lstrip(".")) for k, v in value.items()}
    return [concrete(v, f"{path}[{k}]") for k, v in enumerate(value)] if isinstance(value, list) else value
