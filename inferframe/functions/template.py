"""Templates: {{name}}, {{a.b}}, helpers, and blocks.

Templates without blocks become Spark columns; those with blocks
are rendered by the same parser in workers. Nothing is HTML-escaped, and a
missing variable is an empty string.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .data_url import data_url, mime_type, sniff


class TemplateError(ValueError):
    """A template that can't be parsed or rendered."""


@dataclass(frozen=True)
class Var:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple[Any, ...]


@dataclass
class Block:
    kind: str
    arg: Any
    body: list = field(default_factory=list)
    other: list = field(default_factory=list)


HELPERS = ("concat", "image-data-url", "text-file-contents", "to-string")
_TAG = re.compile(r"\{\{\{\s*(.*?)\s*\}\}\}|\{\{!--.*?--\}\}|\{\{\s*(.*?)\s*\}\}", re.S)
_ARG = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^\s"']+)""")


def _argument(text: str) -> Any:
    if text[0] in "\"'":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    if text in ("true", "false"):
        return text == "true"
    return Var(tuple(x for x in text.removeprefix("this.").split(".") if x)) if text != "this" else Var(())


def _expression(text: str) -> Any:
    parts, at = [], 0
    while at < len(text):
        m = _ARG.match(text, at)
        if not m:
            raise TemplateError(f"can't read {{{{{text}}}}}")
        parts.append(m[1])
        at = m.end()
    if not parts:
        raise TemplateError("empty {{}}")
    if len(parts) == 1 and parts[0] not in HELPERS:
        return _argument(parts[0])
    if parts[0] not in HELPERS:
        raise TemplateError(f"unknown helper {parts[0]}")
    return Call(parts[0], tuple(_argument(p) for p in parts[1:]))


def parse(template: str) -> list:
    """Nodes: str, Var, Call, literals and Block."""
    root: list = []
    stack: list[tuple[Block | None, list]] = [(None, root)]
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            stack[-1][1].append(template[at : m.start()])
        at, inner = m.end(), m[1] if m[1] is not None else m[2]
        if inner is None or inner.startswith("!"):
            continue
        if inner.startswith("#"):
            kind, _, arg = inner[1:].partition(" ")
            if kind not in ("if", "unless", "each", "with") or not arg.strip():
                raise TemplateError(f"unknown block {inner}")
            block = Block(kind, _expression(arg.strip()))
            stack[-1][1].append(block)
            stack.append((block, block.body))
        elif inner == "else":
            if stack[-1][0] is None:
                raise TemplateError("{{else}} outside a block")
            stack[-1] = stack[-1][0], stack[-1][0].other
        elif inner.startswith("/"):
            if stack[-1][0] is None or stack[-1][0].kind != inner[1:].strip():
                raise TemplateError(f"unexpected {{{{{inner}}}}}")
            stack.pop()
        else:
            node = _expression(inner)
            stack[-1][1].append((node,) if isinstance(node, str) else node)
    if len(stack) > 1:
        raise TemplateError(f"{{{{#{stack[-1][0].kind}}}}} is never closed")
    if at < len(template):
        root.append(template[at:])
    return root


def has_blocks(template: str) -> bool:
    return any(isinstance(n, Block) for n in parse(template))


def variables(template: str) -> set[str]:
    """First names of all variables."""
    out: set[str] = set()

    def walk(nodes) -> None:
        for n in nodes:
            if isinstance(n, Var) and n.path:
                out.add(n.path[0])
            elif isinstance(n, Call):
                walk(n.args)
            elif isinstance(n, Block):
                walk([n.arg])
                walk(n.body)
                walk(n.other)

    walk(parse(template))
    return out


#: bindings(path) -> (text of the value or null, its JSON text or null)
Bindings = Callable[[tuple[str, ...]], tuple[Column, Column]]
#: files(path column) -> content column
Files = Callable[[Column], Column]


def compile_template(template: str, bindings: Bindings, files: Files | None = None) -> Column:
    """The rendered template as a column."""

    def value(node) -> Column:
        if isinstance(node, Var):
            return F.coalesce(bindings(node.path)[0], F.lit(""))
        if isinstance(node, bool):
            return F.lit(str(node).lower())
        return F.lit(str(node))

    def call(node: Call) -> Column:
        if node.name == "concat":
            return F.concat(*map(value, node.args)) if node.args else F.lit("")
        if len(node.args) != 1:
            raise TemplateError(f"{node.name} takes one argument")
        arg = node.args[0]
        if node.name == "to-string":
            return F.coalesce(bindings(arg.path)[1], F.lit("null")) if isinstance(arg, Var) else F.lit(json.dumps(arg, ensure_ascii=False))
        if files is None:
            raise TemplateError(f"{node.name} needs files")
        content = files(value(arg))
        if node.name == "text-file-contents":
            return F.decode(content, "UTF-8")
        return data_url(F.coalesce(mime_type(content), F.raise_error(F.concat(F.lit("unknown type of image "), value(arg)))), content)

    parts = []
    for node in parse(template):
        if isinstance(node, Block):
            raise TemplateError("blocks are rendered by render()")
        parts.append(F.lit(node) if isinstance(node, str) else F.lit(node[0]) if isinstance(node, tuple) else call(node) if isinstance(node, Call) else value(node))
    return F.concat(*parts) if parts else F.lit("")


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def render(template: str, bindings: dict, read: Callable[[str], bytes] | None = None) -> str:
    """The rendered template for one row's bindings, blocks included."""

    def look_up(path: tuple[str, ...], here: Any, extra: dict) -> Any:
        if path and path[0].startswith("@"):
            return extra.get(path[0])
        now = here
        for name in path:
            if isinstance(now, list) and name.isdigit():
                now = now[int(name)] if int(name) < len(now) else None
            else:
                now = now.get(name) if isinstance(now, dict) else None
        return now

    def value(node, here, extra) -> Any:
        if isinstance(node, Var):
            return look_up(node.path, here, extra)
        if isinstance(node, tuple):
            return node[0]
        if not isinstance(node, Call):
            return node
        args = [value(a, here, extra) for a in node.args]
        if node.name == "concat":
            return "".join(map(_text, args))
        if len(args) != 1:
            raise TemplateError(f"{node.name} takes one argument")
        if node.name == "to-string":
            return json.dumps(args[0], ensure_ascii=False, separators=(",", ":"))
        if read is None:
            raise TemplateError(f"{node.name} needs files")
        content = read(_text(args[0]))
        if node.name == "text-file-contents":
            return content.decode()
        kind = sniff(content)
        if kind is None:
            raise TemplateError(f"unknown type of image {args[0]}")
        return f"data:{kind};base64,{base64.b64encode(content).decode()}"

    def run(nodes, here, extra) -> str:
        out = []
        for n in nodes:
            if isinstance(n, str):
                out.append(n)
            elif not isinstance(n, Block):
                out.append(_text(value(n, here, extra)))
            else:
                arg = value(n.arg, here, extra)
                if n.kind in ("if", "unless"):
                    out.append(run(n.body if bool(arg) == (n.kind == "if") else n.other, here, extra))
                elif n.kind == "with":
                    out.append(run(n.body, arg, extra) if arg else run(n.other, here, extra))
                else:
                    items = list(arg.items()) if isinstance(arg, dict) else list(enumerate(arg)) if isinstance(arg, list) else []
                    for i, (key, item) in enumerate(items):
                        out.append(run(n.body, item, {"@index": i, "@key": key, "@first": i == 0, "@last": i == len(items) - 1}))
                    if not items:
                        out.append(run(n.other, here, extra))
        return "".join(out)

    return run(parse(template), bindings, {})


def render_json(value: Any, f: Callable[[str], str]) -> Any:
    """Renders the strings of a JSON value, keys included; other scalars stay."""
    if isinstance(value, str):
        return f(value)
    if isinstance(value, list):
        return [render_json(x, f) for x in value]
    if isinstance(value, dict):
        return {f(k): render_json(x, f) for k, x in value.items()}
    return value
