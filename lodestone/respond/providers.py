"""Responders that ask a service over HTTP or run a program. Nothing here is called unless it is configured."""

from __future__ import annotations

import json
import re
import subprocess
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from .. import prompts
from .core import Fingerprint, SetupError
from .templates import BOUNDARY, problems, render, request_body

#: Posts a body and returns status and response body.
Transport = Callable[[str, dict, bytes, float], tuple[int, bytes]]


class CallError(RuntimeError):
    """This request got no answer; another may."""


class AnswerError(ValueError):
    """There is an answer, but not one that fits."""


def post(url: str, headers: dict, body: bytes, timeout: float) -> tuple[int, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        raise CallError(f"no connection: {e}") from e


def unfenced(text: str) -> str:
    """Content of a code fence around the whole text, or the text."""
    m = re.fullmatch(r"```[A-Za-z]*[ \t]*\n?(.*?)\n?```", text.strip(), re.S)
    return (m[1] if m else text).strip()


def checked(text: object, schema: dict | None) -> object:
    """The JSON value of an answer's text, checked against its schema."""
    if not isinstance(text, str):
        raise AnswerError("the response holds no text")
    try:
        value = json.loads(unfenced(text))
    except ValueError as e:
        raise AnswerError(f"not JSON: {e}") from e
    if schema and (bad := problems(value, schema)):
        raise AnswerError("; ".join(bad))
    return value


def _dig(value: object, *path: object) -> object:
    for p in path:
        try:
            value = value[p]
        except (KeyError, IndexError, TypeError):
            return None
    return value


@dataclass
class HttpResponder:
    """Asks a service that takes ``form`` "messages" (blocks, of which those before the boundary may be kept) or "chat" (one text).

    ``params`` go into the body; the first form needs ``max_tokens`` among them.
    """

    url: str
    model: str
    key: str
    form: str = "messages"
    params: dict = field(default_factory=dict)
    headers: dict = field(default_factory=dict)
    schemas: dict = field(default_factory=dict)
    ontology_sha: str = ""
    timeout: float = 60.0
    template: Callable[[str], str] = prompts.template
    transport: Transport = post

    def __post_init__(self):
        if self.form not in ("messages", "chat"):
            raise ValueError(f"unknown form {self.form}")

    def body(self, prompt: str, inputs: dict) -> dict:
        text = render(self.template(prompt), inputs)
        if self.form == "chat":
            return {"model": self.model, "messages": [{"role": "user", "content": text.replace(BOUNDARY, "")}], **self.params}
        if not isinstance(self.params.get("max_tokens"), int):
            raise SetupError("the service needs max_tokens among the parameters")
        return {"model": self.model, "messages": [{"role": "user", "content": request_body(text)}], **self.params}

    def call(self, prompt: str, inputs: dict) -> object:
        own = {"x-api-key": self.key} if self.form == "messages" else {"authorization": f"Bearer {self.key}"}
        body = json.dumps(self.body(prompt, inputs), ensure_ascii=False).encode()
        status, got = self.transport(self.url, {"content-type": "application/json", **own, **self.headers}, body, self.timeout)
        if not 200 <= status < 300:
            raise CallError(f"status {status}: {got[:200].decode('utf-8', 'replace')}")
        try:
            value = json.loads(got)
        except ValueError as e:
            raise AnswerError(f"the response is no JSON: {e}") from e
        text = _dig(value, "content", 0, "text") if self.form == "messages" else _dig(value, "choices", 0, "message", "content")
        return checked(text, self.schemas.get(prompt))

    def fingerprint(self) -> Fingerprint:
        return Fingerprint(prompts.packaged_sha(), self.ontology_sha, self.model, f"http-{self.form}/1 {self.url}")


def last_answer(lines: Iterable[str], observer: Callable[[str, dict], None] | None = None) -> str:
    """The answer in a program's JSON lines: its last ``result``, or its last completed agent message; a failure is an error.

    Lines that aren't JSON objects are skipped. The observer hears of tools used and their results.
    """
    text, why = None, "the program ended without an answer"
    for line in lines:
        try:
            e = json.loads(line)
        except ValueError:
            continue
        if not isinstance(e, dict):
            continue
        for block in _dig(e, "message", "content") or [] if isinstance(_dig(e, "message", "content"), list) else []:
            if observer is not None and isinstance(block, dict) and block.get("type") in ("tool_use", "tool_result"):
                observer(block["type"], {"name": block.get("name"), "ok": not block.get("is_error", False)})
        if e.get("type") == "result":
            text, why = (None, str(e.get("result"))) if e.get("is_error") else (e.get("result"), "")
        elif e.get("type") == "item.completed" and _dig(e, "item", "type") == "agent_message":
            text = _dig(e, "item", "text")
        elif e.get("type") == "turn.failed":
            text, why = None, str(_dig(e, "error", "message"))
    if not isinstance(text, str):
        raise CallError(why)
    return text


@dataclass
class ProgramResponder:
    """Runs a program for each request, in ``folder``; ``{prompt}`` and ``{model}`` among its arguments are filled in. It may read files by itself."""

    command: list[str]
    model: str
    folder: str
    version: str = "1"
    schemas: dict = field(default_factory=dict)
    ontology_sha: str = ""
    observer: Callable[[str, dict], None] | None = None
    template: Callable[[str], str] = prompts.template

    def call(self, prompt: str, inputs: dict) -> object:
        text = render(self.template(prompt), inputs).replace(BOUNDARY, "")
        args = [text if a == "{prompt}" else a.replace("{model}", self.model) for a in self.command]
        try:
            child = subprocess.Popen(args, cwd=self.folder, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE, text=True, encoding="utf-8", errors="replace")
        except OSError as e:
            raise SetupError(f"can't run {args[0]}: {e}") from e
        said: list[str] = []
        # a full error pipe would stop the program
        drain = threading.Thread(target=lambda: said.append(child.stderr.read()))
        drain.start()
        try:
            answer = last_answer(child.stdout, self.observer)
        except CallError as e:
            status = child.wait()
            drain.join()
            raise CallError(f"status {status}: {e} {''.join(said)[:200]}".strip()) from e
        finally:
            child.stdout.close()
            child.wait()
            drain.join()
            child.stderr.close()
        return checked(answer, self.schemas.get(prompt))

    def fingerprint(self) -> Fingerprint:
        return Fingerprint(prompts.packaged_sha(), self.ontology_sha, self.model, f"program/{self.version} {self.command[0]}")
