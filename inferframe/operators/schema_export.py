"""JSON Schemas of the record types and of prompts."""

from __future__ import annotations

import json
from typing import Any

from .pages import FLAGS, SOURCES
from .schema import DRAFT_07

TYPES = ("ChatInput", "ChatOutput", "ChatPrompt", "OcrInput", "OcrOutput")

_ANY: dict[str, Any] = {}
_STRINGS = {"type": "array", "items": {"type": "string"}}


def _object(properties: dict, required: tuple[str, ...] = (), open_: bool = False, description: str | None = None) -> dict:
    out: dict[str, Any] = {"type": "object", "properties": properties, "required": list(required)}
    if description:
        out["description"] = description
    return out | {"additionalProperties": open_}


_DEFINITIONS = {
    "Status": {"type": "string", "enum": ["ok", "skipped", "incomplete", "failed"], "description": "What became of the record."},
    "TokenUsage": _object({"prompt_tokens": {"type": "integer", "minimum": 0}, "completion_tokens": {"type": "integer", "minimum": 0}}, ("prompt_tokens", "completion_tokens")),
    "Analysis": _object({"image_source": {"type": "string", "enum": list(SOURCES)}, **{f: {"type": "boolean"} for f in FLAGS}}, ("image_source", *FLAGS)),
    "Message": {
        "oneOf": [
            _object({"user": _object({"text": {"type": ["string", "null"]}, "images": _STRINGS})}, ("user",)),
            _object({"assistant": _object({"json": _ANY}, ("json",))}, ("assistant",)),
        ]
    },
    "Schema": {
        "anyOf": [
            _object({"path": {"type": "string"}}, ("path",), description="A JSON Schema in a file."),
            _object({"description": {"type": "string"}, "title": {"type": ["string", "null"]}, "items": {"$ref": "#/definitions/Schema"}}, ("description", "items"), True),
            _object({"description": {"type": "string"}, "title": {"type": ["string", "null"]}, "properties": {"type": "object", "additionalProperties": {"$ref": "#/definitions/Schema"}}}, ("description", "properties"), True),
            _object({"description": {"type": "string"}, "title": {"type": ["string", "null"]}, "type": {"type": "string", "enum": ["string", "number", "boolean"]}, "enum": {"type": ["array", "null"], "items": {"type": "string"}}}, ("description",)),
        ]
    },
}


def _ref(name: str) -> dict:
    return {"$ref": f"#/definitions/{name}"}


_INPUT = {"id": {"description": "Any JSON value; only passed through."}, "skip_processing": {"type": ["boolean", "null"], "default": None}, "passthrough_data": {"type": ["object", "null"], "additionalProperties": True, "default": None}}
_OUTPUT = {"id": {"description": "The input's id."}, "status": _ref("Status"), "errors": _STRINGS, "estimated_cost": {"type": ["number", "null"]}, "token_usage": {"anyOf": [_ref("TokenUsage"), {"type": "null"}]}, "passthrough_data": {"type": ["object", "null"], "additionalProperties": True}}


def schema_for(name: str, inline: bool = False) -> dict:
    """Draft-7 JSON Schema of a record type; with inline, without references (a schema inside itself becomes any value)."""
    if name not in TYPES:
        raise ValueError(f"unknown type {name!r}; known: {', '.join(TYPES)}")
    body = {
        "ChatInput": _object(_INPUT, ("id",), True, "A record to run a prompt on; other fields are template variables."),
        "ChatOutput": _object(_OUTPUT | {"response": {"description": "What the model answered."}}, ("id", "status", "errors")),
        "ChatPrompt": _object({"developer": {"type": ["string", "null"]}, "response_schema": _ref("Schema"), "messages": {"type": "array", "items": _ref("Message")}}, ("response_schema", "messages")),
        "OcrInput": _object(_INPUT | {"path": {"type": "string"}, "password": {"type": ["string", "null"], "default": None}}, ("id", "path"), True),
        "OcrOutput": _object(_OUTPUT | {"path": {"type": "string"}, "text": {"type": ["string", "null"]}, "page_count": {"type": ["integer", "null"]}, "analysis": {"anyOf": [_ref("Analysis"), {"type": "null"}]}}, ("id", "status", "errors", "path")),
    }[name]
    used: set[str] = set()

    def walk(value: Any, inside: tuple[str, ...] = ()) -> Any:
        if isinstance(value, list):
            return [walk(v, inside) for v in value]
        if not isinstance(value, dict):
            return value
        if "$ref" in value:
            target = value["$ref"].rsplit("/", 1)[1]
            if inline:
                return {} if target in inside else walk(_DEFINITIONS[target], (*inside, target))
            if target not in used:
                used.add(target)
                walk(_DEFINITIONS[target])
            return value
        return {k: walk(v, inside) for k, v in value.items()}

    out = {"$schema": DRAFT_07, "title": name, **walk(body)}
    return out | ({"definitions": {k: _DEFINITIONS[k] for k in sorted(used)}} if used else {})


def schema_text(name: str, inline: bool = False) -> str:
    return json.dumps(schema_for(name, inline), indent=2)
