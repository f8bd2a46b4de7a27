"""Prompt templates: built in, from files, from a folder, or inline."""

from __future__ import annotations

from pathlib import Path

from unitflow.functions import models
from unitflow.functions.templates import compile_template, render

BUILTIN = Path(__file__).resolve().parents[1] / "prompts"


def _read(folder: Path, name: str, base_required: bool = False) -> dict:
    base = folder / "_base.txt"
    if base_required and not base.exists():
        raise FileNotFoundError(f"no base template in {folder}")
    return compile_template(*([base.read_text(encoding="utf-8")] if base.exists() else []), (folder / name).read_text(encoding="utf-8"))


def load(path: str) -> dict:
    """builtin:NAME, or a file; _base.txt beside it is optional."""
    if not path:
        raise ValueError("prompt path is empty")
    if path.startswith("builtin:"):
        return _read(BUILTIN, path.removeprefix("builtin:") + ".txt", base_required=True)
    return _read(Path(path).parent, Path(path).name)


def load_from(folder: str, name: str) -> dict:
    """NAME.txt of a folder."""
    if not name:
        raise ValueError("prompt name is empty")
    return _read(Path(folder), name + ".txt")


def load_inline(text: str) -> dict:
    """A template's text; it sees the built-in blocks."""
    return compile_template((BUILTIN / "_base.txt").read_text(encoding="utf-8"), text)


def load_all(passes, folder: str = "") -> dict[str, dict]:
    """The templates of all enabled passes, and type_summary's. Inline text comes first; then, where a folder is given, builtin names
    are read from it; then the pass's path, a relative one from its prompt_dir."""
    out = {}
    for p in passes:
        if not p.enabled:
            continue
        try:
            if p.inline_prompt:
                out[p.name] = load_inline(p.inline_prompt)
            elif folder and p.prompt.startswith("builtin:"):
                out[p.name] = load_from(folder, p.prompt.removeprefix("builtin:"))
            elif p.prompt:
                out[p.name] = load(p.prompt if p.prompt.startswith("builtin:") else str(Path(p.prompt_dir) / p.prompt))
            else:
                raise ValueError("prompt or inline_prompt must be specified")
        except (OSError, ValueError) as error:
            raise ValueError(f"load prompt {p.name}: {error}") from error
    try:
        out["type_summary"] = load_from(folder, "type_summary") if folder else load("builtin:type_summary")
    except (OSError, ValueError):
        out["type_summary"] = load("builtin:type_summary")
    return out


def _told(s: dict | None) -> dict:
    s = s or {}
    return {"Purpose": s.get("purpose") or "", "Behavior": s.get("behavior") or "", "Invariants": s.get("invariants") or [], "Security": s.get("security") or []}


def _method(m: dict) -> dict:
    signature, doc = models.display(m.get("signature") or "", m.get("doc") or "")
    return {"Name": m.get("name") or "", "Signature": signature, "Doc": " ".join(doc.split())}


def unit_context(ctx: dict) -> dict:
    """A unit's context by the names that templates use. One function stands at the top, several in Functions."""
    shown = [{"Name": f["name"], "Package": f.get("package") or "", "Receiver": f.get("receiver") or "", "Signature": f.get("signature") or "", "Body": f.get("body") or "", "Doc": f.get("doc") or ""} for f in ctx["functions"]]
    blank = dict.fromkeys(("Name", "Package", "Receiver", "Signature", "Body", "Doc"), "")
    out = {"Language": ctx.get("language") or "source", "Functions": shown if len(shown) != 1 else [], **(shown[0] if len(shown) == 1 else blank)}
    receiver = ctx.get("receiver")
    out["ReceiverType"] = None
    if receiver:
        signature, doc = models.display(receiver.get("signature") or "", receiver.get("doc") or "")
        out["ReceiverType"] = {"Name": receiver["name"], "Kind": receiver["kind"], "Signature": signature, "Body": receiver.get("body") or "", "Doc": doc, "Methods": [_method(m) for m in receiver.get("methods") or []], **_told(receiver.get("summary"))}
    out["Summary"] = _told(ctx["summary"]) if ctx.get("summary") else None
    out["Callees"] = [{"Name": c["unit_id"], **_told(c["summary"])} for c in ctx.get("callees") or []]
    out["ExternalFuncs"] = [{"Package": e.get("package") or "", "Name": e.get("name") or "", "Signature": e.get("signature") or "", "Doc": e.get("doc") or "", "Invariants": [], "Pitfalls": []} for e in ctx.get("externals") or []]
    return out


def type_context(ctx: dict) -> dict:
    signature, doc = models.display(ctx.get("signature") or "", ctx.get("doc") or "")
    return {"Language": ctx.get("language") or "source", "Name": ctx["name"], "Kind": ctx["kind"], "Package": ctx.get("package") or "", "Signature": signature, "Body": ctx.get("body") or "", "Doc": doc, "Methods": [_method(m) for m in ctx.get("methods") or []]}


def prompt(template: dict, ctx: dict, of_type: bool = False) -> str:
    return render(template, type_context(ctx) if of_type else unit_context(ctx))
