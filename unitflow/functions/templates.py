"""Text templates in the syntax that prompt files use: actions in double braces, with if, range, with, define and template.

A template is compiled to nested tuples, which can be sent to tasks, and rendered over dicts and lists. A field that a dict lacks
is an error; an empty value is false.
"""

from __future__ import annotations

import re

ACTION = re.compile(r"\{\{(?:-(?=\s))?(.*?)(?:(?<=\s)-)?\}\}", re.S)
TOKEN = re.compile(r'\s+|(?P<str>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<num>-?\d+(?:\.\d+)?)|(?P<path>\$?[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*|\$?(?:\.[A-Za-z_][A-Za-z0-9_]*)+|\$|\.)|(?P<sign>:=|[|(),=])')
ENDS = ("end", "else")


class TemplateError(ValueError):
    pass


def _pieces(source: str) -> list[tuple[str, str]]:
    """Texts and actions in turn, with the white space gone that an action trims."""
    out, at, trim = [], 0, False
    for m in ACTION.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        text = text.rstrip() if re.match(r"\{\{-\s", m[0]) else text
        out += [("text", text)] if text else []
        trim, at = bool(re.search(r"\s-\}\}$", m[0])), m.end()
        body = m[1].strip()
        if not body.startswith("/*"):
            out.append(("action", body))
    rest = source[at:].lstrip() if trim else source[at:]
    if "{{" in rest:
        raise TemplateError("an action isn't closed")
    return [*out, ("text", rest)] if rest else out


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(code):
        m = TOKEN.match(code, at)
        if not m:
            raise TemplateError(f"unexpected {code[at]!r} in {{{{{code}}}}}")
        out += [(m.lastgroup, m[0])] if m.lastgroup else []
        at = m.end()
    return out


def _expression(code: str):
    """('pipe', [commands]); a command is a list of operands: ('lit', value), ('path', text) or another pipe."""
    tokens = _tokens(code)

    def pipe(at: int, inner: bool):
        commands, words = [], []
        while at < len(tokens):
            kind, text = tokens[at]
            at += 1
            if text == ")" and kind == "sign":
                if not inner:
                    raise TemplateError(f"unexpected ) in {{{{{code}}}}}")
                return ("pipe", [*commands, words]), at
            if kind == "sign" and text == "|":
                commands, words = [*commands, words], []
            elif kind == "sign" and text == "(":
                value, at = pipe(at, True)
                words.append(value)
            elif kind == "str":
                words.append(("lit", text[1:-1] if text[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1])))
            elif kind == "num":
                words.append(("lit", float(text) if "." in text else int(text)))
            elif kind == "path":
                words.append(("lit", {"true": True, "false": False, "nil": None}[text]) if text in ("true", "false", "nil") else ("path", text))
            else:
                raise TemplateError(f"unexpected {text!r} in {{{{{code}}}}}")
        if inner:
            raise TemplateError(f"( isn't closed in {{{{{code}}}}}")
        return ("pipe", [*commands, words]), at

    value, _ = pipe(0, False)
    if not all(value[1]):
        raise TemplateError(f"empty command in {{{{{code}}}}}")
    return value


def compile_template(*sources: str) -> dict:
    """Named templates of all sources; what the last source says outside of definitions is named ''."""
    found: dict = {}
    for source in sources:
        pieces = _pieces(source)
        body, at, stop = _block(pieces, 0, found)
        if stop:
            raise TemplateError(f"unexpected {stop}")
        found[""] = body
    return found


def _block(pieces, at: int, found: dict):
    """Nodes up to the end or else that closes them: (nodes, next place, that action's text)."""
    out = []
    while at < len(pieces):
        kind, text = pieces[at]
        at += 1
        if kind == "text":
            out.append(("text", text))
            continue
        word, _, rest = text.partition(" ")
        if word in ENDS:
            return out, at, text
        if word in ("if", "range", "with"):
            node, at = _branch(word, rest, pieces, at, found)
            out.append(node)
        elif word in ("define", "block"):
            m = re.match(r'\s*"([^"]+)"\s*(.*)$', rest, re.S)
            body, at, stop = _block(pieces, at, found)
            if not m or stop != "end":
                raise TemplateError(f"{word} isn't closed by end")
            found[m[1]] = body
            out += [("template", m[1], _expression(m[2] or "."))] if word == "block" else []
        elif word == "template":
            m = re.match(r'\s*"([^"]+)"\s*(.*)$', rest, re.S)
            if not m:
                raise TemplateError("template without a name")
            out.append(("template", m[1], _expression(m[2]) if m[2] else None))
        else:
            m = re.match(r"(\$[A-Za-z_]\w*)\s*:?=\s*(.*)$", text, re.S)
            out.append(("set", m[1], _expression(m[2])) if m else ("show", _expression(text)))
    return out, at, ""


def _branch(word, rest, pieces, at, found):
    names = []
    m = re.match(r"\s*(\$\w+)(?:\s*,\s*(\$\w+))?\s*:=\s*(.*)$", rest, re.S)
    if m:
        names, rest = [n for n in m.groups()[:2] if n], m[3]
    body, at, stop = _block(pieces, at, found)
    other = []
    if stop.startswith("else"):
        more = stop[4:].strip()
        if more:
            inner, _, condition = more.partition(" ")
            node, at = _branch(inner, condition, pieces, at, found)
            return (word, names, _expression(rest), body, [node]), at
        other, at, stop = _block(pieces, at, found)
    if stop != "end":
        raise TemplateError(f"{word} isn't closed by end")
    return (word, names, _expression(rest), body, other), at


def _field(value, names: list[str]):
    for name in names:
        if value is None:
            raise TemplateError(f"no field {name} of nothing")
        if name not in value:
            raise TemplateError(f"can't evaluate field {name}")
        value = value[name]
    return value


def shown(value) -> str:
    if value is None:
        return "<no value>"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + " ".join(map(shown, value)) + "]"
    return str(value)


def _printf(form: str, *values) -> str:
    rest = iter(values)
    quote = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\t", "\\t") + '"'
    return re.sub(r"%([%sdvq])", lambda m: "%" if m[1] == "%" else quote(next(rest)) if m[1] == "q" else shown(next(rest)), form)


def _index(value, *keys):
    for k in keys:
        value = value[k]
    return value


FUNCTIONS = {
    "not": lambda x: not x,
    "len": len,
    "index": _index,
    "print": lambda *x: "".join(map(shown, x)),
    "println": lambda *x: " ".join(map(shown, x)) + "\n",
    "printf": _printf,
    "eq": lambda a, *b: any(a == x for x in b),
    "ne": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "le": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b,
}


def render(templates: dict, data, name: str = "") -> str:
    out: list[str] = []
    _run(templates, templates[name], data, {"$": data}, out)
    return "".join(out)


def _value(operand, dot, names):
    kind, value = operand
    if kind == "lit":
        return value
    if kind == "pipe":
        return _piped(operand, dot, names)
    head, *fields = value.split(".")
    if head.startswith("$"):
        if head not in names:
            raise TemplateError(f"undefined variable {head}")
        return _field(names[head], fields)
    if head:
        raise TemplateError(f"function {head!r} not defined")
    return _field(dot, [f for f in fields if f])


def _piped(pipe, dot, names):
    value = done = None
    for command in pipe[1]:
        name = command[0][1] if command[0][0] == "path" else ""
        given = [("lit", value)] if done else []
        if name in ("and", "or"):
            for operand in [*command[1:], *given]:
                value = _value(operand, dot, names)
                if bool(value) == (name == "or"):
                    break
        elif name in FUNCTIONS:
            try:
                value = FUNCTIONS[name](*[_value(x, dot, names) for x in [*command[1:], *given]])
            except (TypeError, LookupError, StopIteration) as error:
                raise TemplateError(f"error calling {name}: {error}") from error
        elif len(command) + len(given) == 1:
            value = _value(command[0], dot, names)
        else:
            raise TemplateError(f"{shown(command[0][1])} takes no arguments")
        done = True
    return value


def _run(templates, nodes, dot, names, out) -> None:
    for node in nodes:
        kind = node[0]
        if kind == "text":
            out.append(node[1])
        elif kind == "show":
            out.append(shown(_piped(node[1], dot, names)))
        elif kind == "set":
            names[node[1]] = _piped(node[2], dot, names)
        elif kind == "template":
            if node[1] not in templates:
                raise TemplateError(f"template {node[1]!r} not defined")
            inner = _piped(node[2], dot, names) if node[2] else None
            _run(templates, templates[node[1]], inner, {"$": inner}, out)
        else:
            _, given, condition, body, other = node
            value = _piped(condition, dot, names)
            if not value:
                _run(templates, other, dot, dict(names), out)
            elif kind == "range":
                pairs = sorted(value.items()) if isinstance(value, dict) else enumerate(value)
                for k, x in pairs:
                    _run(templates, body, x, names | dict(zip(given[-1:], [x])) | (dict(zip(given, [k, x])) if len(given) == 2 else {}), out)
            else:
                _run(templates, body, value if kind == "with" else dot, names | dict(zip(given, [value])), out)
