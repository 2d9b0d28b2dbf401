"""Prompts: reading, checking, and rendering to columns."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import template as tpl
from .schema import ExternalSchema, Schema, SchemaError, check_supported, parse_schema


class PromptError(ValueError):
    """A prompt document that can't be used; names the file and line where known."""


@dataclass
class Message:
    """A user message with text, images or both, or an assistant message with JSON."""

    role: str
    text: str | None = None
    images: list[str] = field(default_factory=list)
    json: Any = None


@dataclass
class Prompt:
    response_schema: Schema | ExternalSchema
    messages: list[Message]
    developer: str | None = None

    def check(self) -> None:
        """Messages must be (user, assistant)* user; a user message has text or an image."""
        if not self.messages:
            raise PromptError("the prompt has no messages")
        for i, m in enumerate(self.messages):
            if m.role != ("assistant" if i % 2 else "user"):
                raise PromptError(f"message {i}: user and assistant messages must take turns")
            if m.role == "user" and m.text is None and not m.images:
                raise PromptError(f"message {i}: a user message needs a text or an image")
        if len(self.messages) % 2 == 0:
            raise PromptError("the last message must be a user's")

    def templates(self) -> list[str]:
        out: list[str] = [] if self.developer is None else [self.developer]
        for m in self.messages:
            out += [] if m.text is None else [m.text]
            out += m.images
            tpl.render_json(m.json, lambda s: out.append(s) or s)
        return out


def read_document(path: str) -> Any:
    """A TOML document, or JSON if the name says so."""
    with open(path, "rb") as f:
        data = f.read()
    try:
        if os.path.splitext(path)[1].lower() == ".json":
            return json.loads(data)
        return _plain(tomllib.loads(data.decode()))
    except (json.JSONDecodeError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise PromptError(f"{path}: {e}") from e


def _plain(value: Any) -> Any:
    """TOML as JSON values: dates and non-finite numbers have no form there."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise PromptError("a number must be finite")
    if value is None or isinstance(value, (str, bool, int, float)):
        return value
    raise PromptError(f"no JSON form for {value!r}")


def _only(value: dict, known: set[str], where: str) -> None:
    if not isinstance(value, dict):
        raise PromptError(f"{where}: must be a table")
    if unknown := sorted(set(value) - known):
        raise PromptError(f"{where}: unknown field {unknown[0]!r}")


def parse_prompt(document: Any, base: str = ".") -> Prompt:
    """A prompt from its document; external schemas are read relative to `base`, then to the working folder."""
    _only(document, {"developer", "response_schema", "messages"}, "prompt")
    if "response_schema" not in document:
        raise PromptError("prompt: missing field `response_schema`")
    given = document["response_schema"]
    schema: Schema | ExternalSchema
    if isinstance(given, dict) and "path" in given:
        path = os.path.join(base, given["path"])
        external = read_document(path if os.path.exists(path) else given["path"])
        check_supported(external)
        schema = ExternalSchema(external, given["path"])
    else:
        schema = parse_schema(given)
    messages = []
    for i, m in enumerate(document.get("messages", [])):
        if not isinstance(m, dict) or len(m) != 1 or next(iter(m)) not in ("user", "assistant"):
            raise PromptError(f"messages[{i}]: must have exactly one of user and assistant")
        role, body = next(iter(m.items()))
        _only(body, {"text", "images"} if role == "user" else {"json"}, f"messages[{i}].{role}")
        if role == "user":
            messages.append(Message("user", body.get("text"), list(body.get("images", []))))
        else:
            messages.append(Message("assistant", json=body.get("json")))
    for m in messages:
        for text in [*([m.text] if m.text else []), *m.images]:
            tpl.parse(text)
    return Prompt(schema, messages, document.get("developer"))


def load_prompt(prompt: str | dict | Prompt) -> Prompt:
    """A prompt from a path, a document or a Prompt."""
    if isinstance(prompt, Prompt):
        return prompt
    if isinstance(prompt, dict):
        return parse_prompt(prompt)
    document = read_document(prompt)
    try:
        return parse_prompt(document, os.path.dirname(prompt) or ".")
    except (PromptError, SchemaError) as e:
        raise PromptError(f"{prompt}{_line_of(prompt, str(e))}: {e}") from e


def _line_of(path: str, message: str) -> str:
    """`:line` of the field that a message names last, where the file has it."""
    names = re.findall(r"[`']([\w-]+)[`']|\.(\w+)(?=:)", message)
    with open(path, encoding="utf-8") as f:
        lines = f.read().splitlines()
    for name in (a or b for a, b in reversed(names)):
        for i, line in enumerate(lines, 1):
            if re.search(rf"\b{re.escape(name)}\b", line):
                return f":{i}"
    return ""


def render_columns(prompt: Prompt, bindings: tpl.Bindings, files: tpl.Files | None = None) -> Column:
    """Struct of developer and messages (role, text, images, json), rendered in the JVM."""
    prompt.check()

    def f(text: str) -> Column:
        return tpl.compile_template(text, bindings, files)

    def as_json(value: Any) -> Column:
        """JSON text whose strings are templates."""
        if isinstance(value, str):
            quoted = F.to_json(F.array(f(value)))
            return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        if isinstance(value, list):
            return F.concat(F.lit("["), F.concat_ws(",", *map(as_json, value)), F.lit("]")) if value else F.lit("[]")
        if isinstance(value, dict):
            return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(as_json(k), F.lit(":"), as_json(v)) for k, v in value.items())), F.lit("}")) if value else F.lit("{}")
        return F.lit(json.dumps(value))

    null = F.lit(None).cast("string")
    rows = []
    for m in prompt.messages:
        images = F.array(*map(f, m.images)) if m.images else F.array().cast("array<string>")
        rows.append(F.struct(F.lit(m.role).alias("role"), (null if m.text is None else f(m.text)).alias("text"), images.alias("images"), (as_json(m.json) if m.role == "assistant" else null).alias("json")))
    return F.struct((null if prompt.developer is None else f(prompt.developer)).alias("developer"), F.array(*rows).alias("messages"))


def last_user_text(messages: Column) -> Column:
    """Text of the last user message that has any."""
    return F.try_element_at(F.filter(messages, lambda m: (m["role"] == "user") & m["text"].isNotNull()), F.lit(-1))["text"]


def valid_roles(roles: Column) -> Column:
    """Whether an array of roles is (user, assistant)* user, after at most one system message."""
    return F.coalesce(F.concat_ws(",", roles).rlike("^(system,)?(user,assistant,)*user$"), F.lit(False))


def openai_messages(rendered: Column) -> Column:
    """Messages of an OpenAI-compatible request: array of role, content (text) and parts (type, value)."""
    kind = "array<struct<role:string,content:string,parts:array<struct<type:string,value:string>>>>"
    none = F.lit(None).cast("array<struct<type:string,value:string>>")
    system = F.when(
        rendered["developer"].isNotNull(),
        F.array(F.struct(F.lit("system").alias("role"), rendered["developer"].alias("content"), none.alias("parts"))).cast(kind),
    ).otherwise(F.array().cast(kind))

    def one(m: Column) -> Column:
        many = F.size(m["images"]) > 0
        text = F.when(m["text"].isNotNull(), F.array(F.struct(F.lit("text").alias("type"), m["text"].alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>"))
        parts = F.concat(text, F.transform(m["images"], lambda u: F.struct(F.lit("image_url").alias("type"), u.alias("value"))))
        content = F.when(m["role"] == "assistant", m["json"]).when(~many, m["text"])
        return F.struct(m["role"].alias("role"), content.alias("content"), F.when(many, parts).alias("parts"))

    return F.concat(system, F.transform(rendered["messages"], one).cast(kind))
