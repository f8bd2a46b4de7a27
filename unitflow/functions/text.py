"""Column functions over symbols, ids, paths, sources and messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: symbol kinds of functions and of types, in the order of their numbers, and SARIF levels by severity.
FUNCTION_KINDS = ["Constructor", "Function", "Macro", "Method", "AbstractMethod", "MethodSpecification", "ProtocolMethod", "PureVirtualMethod", "TraitMethod", "TypeClassMethod", "MethodAlias", "SingletonMethod", "StaticMethod"]
TYPE_KINDS = ["Class", "Enum", "Interface", "Protocol", "Struct", "Trait", "Type", "TypeAlias", "TypeClass", "Union"]
LEVELS = {"critical": "error", "high": "error", "medium": "warning"}
SEVERITIES = ["critical", "high", "medium", "low", "info"]


def glob_regex(glob: str) -> str:
    """One glob as an anchored pattern: * and ? don't cross a slash. A malformed one matches nothing."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                return "(?!)"
            out += "[" + glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[") + "]"
            i = end
        elif c == "\\":
            if i + 1 == len(glob):
                return "(?!)"
            i += 1
            out += "\\" + glob[i] if not glob[i].isalnum() else glob[i]
        else:
            out += c if c.isalnum() or c in "/_-" else "\\" + c
        i += 1
    return f"^{out}$"


def matches_any(path: Column, globs: list[str]) -> Column:
    """True if any glob matches; no globs keep every path."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(g)) for g in globs]) if globs else F.lit(True)


def function_id(package: Column, name: Column, receiver: Column, disambiguator: Column) -> Column:
    base = F.when(receiver != "", F.concat(package, F.lit(".("), receiver, F.lit(")."), name)).otherwise(F.concat(package, F.lit("."), name))
    return F.when(disambiguator != "", F.concat(base, F.lit("("), disambiguator, F.lit(")"))).otherwise(base)


def package_of(fn_id: Column) -> Column:
    """What stands before .( or else before the last dot."""
    method = F.instr(fn_id, ".(")
    return F.when(method > 0, F.substring(fn_id, F.lit(1), method - 1)).otherwise(F.regexp_replace(fn_id, "\\.[^.]*$", ""))


def strip_pointer(receiver: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(receiver, "^\\*", ""), "\\[.*$", "")


def strip_file_uri(uri: Column) -> Column:
    """Without file://, and without the slash before a drive letter; percent signs decoded where they can be."""
    path = F.regexp_replace(F.regexp_replace(uri, "^file://", ""), "^/([A-Za-z]:)", "$1")
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://"), F.coalesce(decoded, path)).otherwise(uri)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def sarif_level(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), severity), F.lit("note"))


def symbol_class(kind: Column, descriptor_suffix: Column) -> Column:
    """function, type or null: by kind, else by the suffix of the last descriptor."""
    return F.when(kind.isin(FUNCTION_KINDS) | (~kind.isin(TYPE_KINDS) & descriptor_suffix.isin("Method", "Macro")), "function").when(kind.isin(TYPE_KINDS) | (descriptor_suffix == "Type"), "type")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts one after another."""
    return F.sha2(F.concat(*parts), 256)


def slice_lines(text: Column, start: Column, end_line: Column, end_char: Column) -> Column:
    """Whole lines from start (from 0) to the end; an end at column 0 leaves its line out. The end is held between the start and the
    last line; a start past the text gives null; line breaks at the end go."""
    return slice_of(F.split(text, "\n", -1), start, end_line, end_char)


def slice_of(lines: Column, start: Column, end_line: Column, end_char: Column) -> Column:
    """slice_lines of a text whose lines are known."""
    last = F.when(end_char == 0, end_line - 1).otherwise(end_line)
    last = F.greatest(start, F.least(last, F.size(lines) - 1))
    return F.when((start >= 0) & (start < F.size(lines)), F.regexp_replace(F.array_join(F.slice(lines, start + 1, last - start + 1), "\n"), "\\n+$", ""))


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def locate_snippet(body: Column, code: Column, hint: Column) -> Column:
    """Line (from 1) of the body that holds the trimmed code nearest to the hint, earliest on ties; the first without a hint; the
    hint itself where no line holds it; 0 for blank code."""
    wanted = trim_space(code)
    found = F.filter(F.transform(F.split(body, "\n", -1), lambda line, i: F.when(F.contains(line, wanted), i + 1)), lambda i: i.isNotNull())
    nearest = F.array_min(F.transform(found, lambda i: F.struct(F.abs(i - hint).alias("far"), i.alias("line"))))["line"]
    return F.when(wanted == "", 0).when(F.size(found) == 0, hint).when((hint <= 0) | (F.size(found) == 1), F.get(found, F.lit(0))).otherwise(nearest)
