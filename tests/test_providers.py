"""Responders over HTTP and of programs, with transports and programs made for the test."""

import json
import sys

import pytest

from lodestone.respond import providers as P
from lodestone.respond.core import SetupError
from lodestone.respond.templates import BOUNDARY

INPUTS = {"DIR_RELATIVE": "a/b", "RATIONALE_BUNDLE": {"n": [1]}}
SCHEMA = {"classify": {"type": "object", "required": ["kind"]}}


class Wire:
    def __init__(self, status, answer):
        self.status, self.answer, self.sent = status, answer, []

    def __call__(self, url, headers, body, timeout):
        self.sent.append((url, headers, json.loads(body)))
        return self.status, self.answer if isinstance(self.answer, bytes) else json.dumps(self.answer).encode()


def test_messages_form():
    wire = Wire(200, {"content": [{"type": "text", "text": '```json\n{"kind": "service"}\n```'}]})
    r = P.HttpResponder("https://host/v1", "m", "secret", params={"max_tokens": 9, "temperature": 0}, schemas=SCHEMA, transport=wire)
    assert r.call("classify", INPUTS) == {"kind": "service"}
    url, headers, body = wire.sent[0]
    assert url == "https://host/v1" and headers["x-api-key"] == "secret" and (body["max_tokens"], body["temperature"], body["model"]) == (9, 0, "m")
    head, tail = body["messages"][0]["content"]
    assert head["cache_control"] and "cache_control" not in tail and "Directory: a/b" in tail["text"] and '{"n": [1]}' in tail["text"]
    with pytest.raises(SetupError):
        P.HttpResponder("u", "m", "k", transport=wire).call("classify", INPUTS)
    assert r.fingerprint() != P.HttpResponder("https://other", "m", "k").fingerprint()


def test_chat_form():
    wire = Wire(200, {"choices": [{"message": {"content": '{"kind": "x"}'}}]})
    r = P.HttpResponder("u", "m", "k", "chat", transport=wire)
    assert r.call("classify", INPUTS) == {"kind": "x"} and wire.sent[0][1]["authorization"] == "Bearer k"
    assert BOUNDARY not in wire.sent[0][2]["messages"][0]["content"]
    with pytest.raises(ValueError):
        P.HttpResponder("u", "m", "k", "telegram")


@pytest.mark.parametrize(("status", "answer", "error", "says"), [(500, b"down", P.CallError, "500: down"), (200, b"<html>", P.AnswerError, "no JSON"), (200, {"content": []}, P.AnswerError, "no text"), (200, {"content": [{"text": "words"}]}, P.AnswerError, "not JSON"), (200, {"content": [{"text": "{}"}]}, P.AnswerError, "missing kind")])
def test_answers_that_do_not_fit(status, answer, error, says):
    with pytest.raises(error, match=says):
        P.HttpResponder("u", "m", "k", params={"max_tokens": 1}, schemas=SCHEMA, transport=Wire(status, answer)).call("classify", INPUTS)


def test_no_connection():
    with pytest.raises(P.CallError, match="no connection"):
        P.post("http://127.0.0.1:9/", {}, b"{}", 2)


def program(lines, status=0):
    code = f"import sys; sys.stderr.write('e' * 100000); print({chr(10).join(lines)!r}); sys.exit({status})"
    return [sys.executable, "-c", code, "{prompt}", "--model={model}"]


def test_programs(tmp_path):
    seen = []
    lines = ["noise", json.dumps({"type": "a", "message": {"content": [{"type": "tool_use", "name": "Read"}, {"type": "tool_result", "is_error": True}, {"type": "text"}]}}), json.dumps({"type": "result", "result": '{"kind": "service"}'}), "[1]"]
    run = lambda lines, status=0, **k: P.ProgramResponder(program(lines, status), "m", str(tmp_path), **k).call("classify", INPUTS)
    assert run(lines, schemas=SCHEMA, observer=lambda e, d: seen.append((e, d["name"], d["ok"]))) == {"kind": "service"}
    assert seen == [("tool_use", "Read", True), ("tool_result", None, False)]
    assert run([json.dumps({"type": "item.completed", "item": {"type": "agent_message", "text": "[]"}})]) == []
    with pytest.raises(P.CallError, match="status 3"):
        run(["nothing"], 3)
    with pytest.raises(P.CallError, match="too hot"):
        run([json.dumps({"type": "turn.failed", "error": {"message": "too hot"}})])
    with pytest.raises(P.CallError, match="broken"):
        run([json.dumps({"type": "result", "is_error": True, "result": "broken"})])
    with pytest.raises(SetupError):
        P.ProgramResponder(["/not/there"], "m", str(tmp_path)).call("classify", INPUTS)
