"""Model clients and the texts of requests. A client has complete(request) -> content, and is sent to the executors."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from unitflow.functions.text import SEVERITIES


class Client(Protocol):
    def complete(self, request: dict) -> str: ...


@dataclass
class HttpClient:
    """A chat-completions endpoint; errors of any kind raise, nothing is tried twice."""

    base_url: str
    api_key: str = ""
    timeout: float = 120

    def complete(self, request: dict) -> str:
        schema = request.get("schema")
        body = {"model": request["model"], "messages": [{"role": "user", "content": request["prompt"]}], "max_tokens": request["max_tokens"], "temperature": request["temperature"]}
        if schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": schema["name"], "strict": True, "schema": schema["schema"]}}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        call = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(call, timeout=self.timeout) as answer:
            got = json.load(answer)
        if got.get("error"):
            raise RuntimeError(f"api error: {got['error'].get('message', '')}")
        if not got.get("choices"):
            raise RuntimeError("no choices in response")
        return got["choices"][0]["message"]["content"]


@dataclass
class KeyedClient:
    """Answers by pass and id, since tasks have no order; otherwise by the kind of answer; otherwise an empty list of issues."""

    answers: dict[tuple[str, str], str] = field(default_factory=dict)
    others: dict[str, str] = field(default_factory=dict)

    def complete(self, request: dict) -> str:
        other = self.others.get(request["schema"]["name"], '{"issues": []}')
        return self.answers.get((request["pass"], request["id"]), other)


def _object(properties: dict, required: list[str]) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


_STRING, _STRINGS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
SUMMARY = {"name": "summary", "schema": _object({"purpose": _STRING, "behavior": _STRING, "invariants": _STRINGS, "security": _STRINGS}, ["purpose", "behavior", "invariants", "security"])}
_ISSUE = {"function": _STRING, "line": {"type": "integer"}, "code": _STRING, "severity": _STRING | {"enum": SEVERITIES}, "message": _STRING, "suggestion": _STRING}
ISSUES = {"name": "issues", "schema": _object({"issues": {"type": "array", "items": _object(_ISSUE, [k for k in _ISSUE if k != "suggestion"])}}, ["issues"])}


def _typed(value, kind, what: str):
    """The value if it is of the kind; null and what is missing are empty."""
    if value is None:
        return kind()
    if not isinstance(value, kind) or (kind is int and isinstance(value, bool)):
        raise ValueError(f"{what} is no {kind.__name__}")
    return value


def _fields(value, kinds: dict, what: str) -> dict:
    """An object's fields by name in any case; of names that differ only in case the last counts; other fields are ignored."""
    found = {k.lower(): v for k, v in _typed(value, dict, what).items()}
    out = {}
    for name, kind in kinds.items():
        held = _typed(found.get(name), list if kind is list else kind, f"{what}.{name}")
        out[name] = [_typed(x, str, f"{what}.{name}") for x in held] if kind is list else held
    return out


def decoded(content: str, kind: str) -> dict:
    """A summary or issues with every field there; content that is no JSON or has a field of another type raises with its raw text."""
    try:
        value = json.loads(content)
        if kind == "summary":
            return _fields(value, {"purpose": str, "behavior": str, "invariants": list, "security": list}, "summary")
        listed = {k.lower(): v for k, v in _typed(value, dict, "answer").items()}.get("issues")
        return {"issues": [_fields(i, {k: int if k == "line" else str for k in _ISSUE}, "issue") for i in _typed(listed, list, "issues")]}
    except (ValueError, TypeError) as error:
        raise ValueError(f"failed to parse response: {error}: {content}") from error


def display(signature: str, doc: str) -> tuple[str, str]:
    """Both trimmed. Without a signature, the first line of doc's first fenced block is it, and the block leaves doc; a block that is
    empty, open, or begins with a blank line changes nothing."""
    signature, doc = signature.strip(), doc.strip()
    lines = doc.split("\n")
    fences = [k for k, line in enumerate(lines) if line.strip().startswith("```")][:2]
    if not signature and len(fences) == 2 and fences[1] > fences[0] + 1 and lines[fences[0] + 1].strip():
        signature = lines[fences[0] + 1].strip()
        doc = "\n".join(lines[: fences[0]] + lines[fences[1] + 1 :]).strip()
    return signature, doc
