"""Configuration: files, inline texts and the environment, unified with the schema and its defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from glob import glob
from pathlib import Path

from unitflow.plans.cue import Alternatives, Bottom, CueError, Kind, Package, concrete, unify
from unitflow.plans.review import Config, Pass

API_KEY = "UNITFLOW_API_KEY"
#: Fields that may be left out; empty then.
OPTIONAL = ("api_key", "prompt", "inline_prompt")


@dataclass
class Settings:
    llm: dict
    cache_dir: str = ".unitflow/cache"
    cache_enabled: bool = True
    output: dict[str, str] = field(default_factory=dict)
    passes: list[Pass] = field(default_factory=list)

    def review(self, prompts: str = "", state: str = "") -> Config:
        return Config(llm=_request(self.llm), passes=self.passes, cache=self.cache_dir if self.cache_enabled else "", prompts=prompts, state=state)


def _request(llm: dict) -> dict:
    return {k: llm[k] for k in ("model", "max_tokens", "temperature")}


def _default(kind: str, value) -> Alternatives:
    return Alternatives([(False, Kind(kind)), (True, value)])


def _llm(env: dict) -> dict:
    return {"provider": "openai", "base_url": Kind("string"), "model": Kind("string"), "api_key": _default("string", env[API_KEY]) if API_KEY in env else Kind("string"), "max_tokens": _default("int", 32768), "temperature": _default("float", 0.1)}


def _pass(name: str, folder: str) -> dict:
    return {"name": name, "prompt": Kind("string"), "inline_prompt": Kind("string"), "prompt_dir": _default("string", folder), "description": _default("string", ""), "enabled": _default("bool", True)}


def _fit(value, schema: dict, path: str) -> dict:
    """The value unified with a closed struct."""
    for k in value:
        if k not in schema:
            raise CueError(f"{path}.{k}: field not allowed")
    try:
        both = unify(schema, value)
    except Bottom as error:
        raise CueError(f"{path}: {error}") from error
    return {k: "" if k in OPTIONAL and isinstance(v, Kind) else v for k, v in both.items()}


def expand(paths: list[str]) -> list[str]:
    """Paths as they are; of what globs match the .cue files, sorted. The suffix counts after a glob alone."""
    out = []
    for p in paths:
        out += sorted(m for m in glob(p) if m.endswith(".cue")) if any(c in p for c in "*?[") else [p]
    return out


def load(paths: list[str], inline: list[str] = (), env: dict | None = None) -> Settings:
    """Settings from files and inline texts. env (by default the process's) is what `env` refers to. A pass's relative prompt
    belongs to the folder of the file that defines it. Without analyse all passes run, in the order they are defined."""
    env = dict(os.environ) if env is None else env
    package, folders = Package(), {}
    for path in expand(list(paths)):
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as error:
            raise CueError(f"read config {path}: {error}") from error
        for name in package.add(text):
            folders.setdefault(name, str(Path(path).absolute().parent))
    for text in inline:
        package.add(text)
    package.fields.append(("env", ("struct", [(k, ("lit", v)) for k, v in env.items()], {}), {}))
    defined = package.unified("pass")
    for name in defined if isinstance(defined, dict) else ():  # a pass is named as its field
        package.fields.append(("pass", ("struct", [(name, ("struct", [("name", ("lit", name))], {}))], {}), {}))
    known = {"llm", "cache", "output", "pass", "analyse", "env"}
    for name in package.names():
        if name not in known and not name.startswith(("_", "#")):
            raise CueError(f"{name}: field not allowed")

    def found(name: str, empty):
        value = package.unified(name)
        return empty if isinstance(value, Kind) else value

    llm = concrete(_fit(found("llm", {}), _llm(env), "llm"), "llm")
    cache = concrete(_fit(found("cache", {}), {"dir": _default("string", ".unitflow/cache"), "enabled": _default("bool", True)}, "cache"), "cache")
    output = concrete(_fit(found("output", {}), {k: _default("string", "") for k in ("json", "markdown", "sarif")}, "output"), "output")

    def as_pass(value: dict) -> Pass:
        name = concrete(value.get("name", Kind("string")), "analyse.name")
        own = {k: v for k, v in value.items() if k != "llm"}
        made = concrete(_fit(own, _pass(name, folders.get(name, "")), f"pass.{name}"), f"pass.{name}")
        model = _request(concrete(_fit(value["llm"], _llm(env), f"pass.{name}.llm"), f"pass.{name}.llm")) if "llm" in value else None
        return Pass(name, made["prompt"], made["enabled"], model, made["inline_prompt"], made["prompt_dir"])

    defined = found("pass", {})
    chosen = found("analyse", list(defined.values()))
    if isinstance(chosen, Alternatives):
        chosen = next(v for _, v in sorted(chosen, key=lambda x: not x[0]))
    return Settings(llm, cache["dir"], cache["enabled"], output, [as_pass(value) for value in chosen])
