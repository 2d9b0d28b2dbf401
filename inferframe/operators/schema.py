"""Response schemas: the short form of prompts, JSON Schema, Spark types, validation."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DRAFT_07 = "http://json-schema.org/draft-07/schema#"
DEFAULT_TITLE = "ResponseFormat"


class SchemaError(ValueError):
    """A schema that can't be read."""


@dataclass(frozen=True)
class Schema:
    """The short form: an array (items), an object (properties) or a scalar."""

    description: str
    title: str | None = None
    items: Schema | None = None
    properties: dict[str, Schema] | None = None
    type: str = "string"
    enum: tuple[str, ...] | None = None

    @property
    def kind(self) -> str:
        return "array" if self.items else "object" if self.properties is not None else "scalar"


@dataclass(frozen=True)
class ExternalSchema:
    """A JSON Schema of its own (read from `path`, or given)."""

    document: dict = field(hash=False)
    path: str | None = None


def parse_schema(value: Any, where: str = "response_schema") -> Schema:
    """Reads the short form; a description is needed at every level; items come before properties."""
    if not isinstance(value, dict):
        raise SchemaError(f"{where}: must be a table")
    if not isinstance(value.get("description"), str):
        raise SchemaError(f"{where}: missing field `description`")
    title, description = value.get("title"), value["description"]
    if "items" in value:
        return Schema(description, title, items=parse_schema(value["items"], f"{where}.items"))
    if "properties" in value:
        if not isinstance(value["properties"], dict):
            raise SchemaError(f"{where}.properties: must be a table")
        return Schema(description, title, properties={k: parse_schema(v, f"{where}.properties.{k}") for k, v in value["properties"].items()})
    kind = value.get("type", "string")
    if kind not in ("string", "number", "boolean"):
        raise SchemaError(f"{where}: unknown type {kind!r}")
    enum = value.get("enum")
    if enum is not None and not (isinstance(enum, list) and all(isinstance(x, str) for x in enum)):
        raise SchemaError(f"{where}.enum: must be a list of strings")
    return Schema(description, title, type=kind, enum=None if enum is None else tuple(enum))


def to_json_schema(schema: Schema | ExternalSchema, root: bool = True) -> dict:
    """JSON Schema (draft 7) of a response; objects need all their properties and allow no others."""
    if isinstance(schema, ExternalSchema):
        return schema.document
    out: dict[str, Any] = {"$schema": DRAFT_07} if root else {}
    out["description"] = schema.description
    if schema.items:
        out |= {"type": "array", "items": to_json_schema(schema.items, False)}
    elif schema.properties is not None:
        if schema.title:
            out["title"] = schema.title
        out |= {"type": "object", "properties": {k: to_json_schema(v, False) for k, v in schema.properties.items()}, "required": list(schema.properties), "additionalProperties": False}
    else:
        out["type"] = schema.type
        if schema.enum is not None:
            out["enum"] = list(schema.enum)
    return out


def schema_title(schema: Schema | ExternalSchema) -> str:
    title = schema.document.get("title") if isinstance(schema, ExternalSchema) else schema.title
    return title or DEFAULT_TITLE


def to_spark_type(schema: Schema) -> T.DataType:
    if schema.items:
        return T.ArrayType(to_spark_type(schema.items))
    if schema.properties is not None:
        return T.StructType([T.StructField(k, to_spark_type(v)) for k, v in schema.properties.items()])
    return {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}[schema.type]


def is_valid(value: Column, schema: Schema) -> Column:
    """Whether a VARIANT column fits the short form (types are never converted); false for null."""
    kind = F.schema_of_variant(value)
    if schema.items:
        each = F.forall(F.try_variant_get(value, "$", "array<variant>"), lambda x: is_valid(x, schema.items))
        fits = kind.startswith("ARRAY") & each
    elif schema.properties is not None:
        names = sorted(schema.properties)
        keys = F.array_sort(F.json_object_keys(F.to_json(value)))
        fits = kind.startswith("OBJECT") & (keys == F.array(*map(F.lit, names)).cast("array<string>"))
        for name in names:
            fits = fits & is_valid(_member(value, name), schema.properties[name])
    elif schema.type == "string":
        fits = kind == "STRING"
    elif schema.type == "boolean":
        fits = kind == "BOOLEAN"
    else:
        fits = kind.rlike(_NUMBER)
    if schema.enum is not None:
        fits = fits & F.try_variant_get(value, "$", "string").isin(*schema.enum)
    return F.coalesce(fits, F.lit(False))


_KNOWN = {"$schema", "$id", "$ref", "$defs", "definitions", "title", "description", "default", "examples", "format", "type", "properties", "required", "additionalProperties", "items", "enum", "const", "anyOf", "allOf", "oneOf", "not", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "minItems", "maxItems", "uniqueItems", "multipleOf"}


def check_supported(document: Any) -> None:
    """Raises NotImplementedError on keywords that problems() doesn't judge."""
    if isinstance(document, dict):
        if unknown := sorted(set(document) - _KNOWN):
            raise NotImplementedError(f"JSON Schema keywords {', '.join(unknown)}")
        for key in ("properties", "definitions", "$defs"):
            for v in document.get(key, {}).values():
                check_supported(v)
        for key in ("items", "additionalProperties", "not"):
            check_supported(document.get(key))
        for key in ("anyOf", "allOf", "oneOf"):
            for v in document.get(key, []):
                check_supported(v)
    elif isinstance(document, list):
        for v in document:
            check_supported(v)


def _is(value: Any, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": number, "integer": number and float(value).is_integer(),
    }.get(kind, False)


def _same(a: Any, b: Any) -> bool:
    if isinstance(a, bool) != isinstance(b, bool):
        return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _target(root: Any, ref: str) -> Any:
    """What a reference inside the document names."""
    for part in ref.removeprefix("#").split("/"):
        if part:
            root = root[part.replace("~1", "/").replace("~0", "~")]
    return root


class RecursiveSchema(SchemaError):
    """A schema that refers to itself, whose depth only a document tells."""


def _member(value: Column, name: str) -> Column:
    """A member of a VARIANT object; null if it isn't there (a JSON null is a VARIANT)."""
    for quote in "'\"":
        if quote not in name:
            return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")
    # a path can't name both quotes
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(name))


def _equals(value: Column, constant: Any) -> Column:
    """Whether a VARIANT is this JSON value; numbers by their value."""
    kind = F.schema_of_variant(value)
    if constant is None:
        return kind == "VOID"
    if isinstance(constant, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == constant)
    if isinstance(constant, (int, float)):
        return kind.rlike(_NUMBER) & (F.try_variant_get(value, "$", "double") == float(constant))
    if isinstance(constant, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == constant)
    if isinstance(constant, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        fits = kind.startswith("ARRAY") & (F.size(items) == len(constant))
        for i, x in enumerate(constant):
            fits = fits & F.coalesce(_equals(F.get(items, F.lit(i)), x), F.lit(False))
        return fits
    fits = kind.startswith("OBJECT") & (F.size(F.try_variant_get(value, "$", "map<string,variant>")) == len(constant))
    for name, x in constant.items():
        fits = fits & F.coalesce(_equals(_member(value, name), x), F.lit(False))
    return fits


_NUMBER = "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"


def fits_schema(value: Column, schema: Any, root: Any = None, within: tuple[str, ...] = ()) -> Column:
    """Whether a VARIANT column fits a JSON Schema, as problems() finds none, in SQL functions only; false for null.

    The keywords become predicates, and references those of what they name. Raises RecursiveSchema for one that
    comes back to itself. Patterns are Java's, with Unicode classes.
    """
    root = schema if root is None else root
    if schema is True or schema is None:
        return F.lit(True)
    if schema is False:
        return F.lit(False)
    if "$ref" in schema:
        if schema["$ref"] in within:
            raise RecursiveSchema(f"{schema['$ref']} refers to itself")
        return fits_schema(value, _target(root, schema["$ref"]), root, (*within, schema["$ref"]))

    def of(x: Column, inner: Any) -> Column:
        return fits_schema(x, inner, root, within)

    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    is_kind = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN",
        "null": kind == "VOID", "number": kind.rlike(_NUMBER), "integer": kind.rlike(_NUMBER) & (number % 1.0 == 0),
    }
    every: list[Column] = []

    def where(name: str, fits: Column) -> None:
        """Asked of values of this kind only."""
        every.append(~is_kind[name] | F.coalesce(fits, F.lit(False)))

    if (kinds := schema.get("type")) is not None:
        fits = F.lit(False)
        for k in [kinds] if isinstance(kinds, str) else kinds:
            fits = fits | is_kind.get(k, F.lit(False))
        every.append(fits)
    for constants in (schema.get("enum"), [schema["const"]] if "const" in schema else None):
        if constants is not None:
            fits = F.lit(False)
            for x in constants:
                fits = fits | F.coalesce(_equals(value, x), F.lit(False))
            every.append(fits)
    known = schema.get("properties", {})
    for name in schema.get("required", []):
        where("object", _member(value, name).isNotNull())
    for name, inner in known.items():
        where("object", _member(value, name).isNull() | of(_member(value, name), inner))
    if (more := schema.get("additionalProperties")) is not None and more is not True:
        entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
        where("object", F.forall(entries, lambda e: (e["key"].isin(*known) if known else F.lit(False)) | of(e["value"], more)))
    array = F.try_variant_get(value, "$", "array<variant>")
    items = schema.get("items")
    if isinstance(items, list):
        for i, inner in enumerate(items):
            where("array", (F.size(array) <= i) | of(F.get(array, F.lit(i)), inner))
    elif items is not None and items is not True:
        where("array", F.forall(array, lambda x: of(x, items)))
    text = F.try_variant_get(value, "$", "string")
    bounds = (("array", F.size(array), "minItems", "maxItems"), ("string", F.length(text), "minLength", "maxLength"), ("number", number, "minimum", "maximum"))
    for name, size, low, high in bounds:
        if low in schema:
            where(name, size >= schema[low])
        if high in schema:
            where(name, size <= schema[high])
    if "exclusiveMinimum" in schema:
        where("number", number > schema["exclusiveMinimum"])
    if "exclusiveMaximum" in schema:
        where("number", number < schema["exclusiveMaximum"])
    if "multipleOf" in schema:
        where("number", (number / schema["multipleOf"]) % 1.0 == 0)
    if schema.get("uniqueItems"):
        where("array", F.size(F.array_distinct(F.transform(array, F.to_json))) == F.size(array))
    if "pattern" in schema:
        where("string", text.rlike("(?U)" + schema["pattern"]))
    every += [of(value, x) for x in schema.get("allOf", [])]
    for key in ("anyOf", "oneOf"):
        if key in schema:
            fitting = F.lit(0)
            for x in schema[key]:
                fitting = fitting + of(value, x).cast("int")
            every.append(fitting == 1 if key == "oneOf" else fitting > 0)
    if "not" in schema:
        every.append(~of(value, schema["not"]))
    fits = value.isNotNull()
    for x in every:
        fits = fits & F.coalesce(x, F.lit(False))
    return fits


def problems(value: Any, schema: Any, root: dict | None = None, at: str = "$") -> list[str]:
    """What in a JSON value doesn't fit a JSON Schema."""
    root = schema if root is None else root
    if schema is True or schema is None:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    if "$ref" in schema:
        return problems(value, _target(root, schema["$ref"]), root, at)
    out: list[str] = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not of type {kinds}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}: {k} is missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            out += problems(v, known[k] if k in known else schema.get("additionalProperties"), root, f"{at}.{k}")
    elif isinstance(value, list):
        items = schema.get("items")
        for i, v in enumerate(value):
            out += problems(v, (items[i] if i < len(items) else None) if isinstance(items, list) else items, root, f"{at}[{i}]")
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            out.append(f"{at}: wrong number of items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            out.append(f"{at}: repeated items")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            out.append(f"{at}: wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: doesn't match {schema['pattern']}")
    elif _is(value, "number"):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf) or not schema.get("exclusiveMinimum", -math.inf) < value < schema.get("exclusiveMaximum", math.inf):
            out.append(f"{at}: out of range")
        if "multipleOf" in schema and not float(value / schema["multipleOf"]).is_integer():
            out.append(f"{at}: no multiple of {schema['multipleOf']}")
    for x in schema.get("allOf", []):
        out += problems(value, x, root, at)
    fitting = [sum(not problems(value, x, root, at) for x in schema.get(k, [])) for k in ("anyOf", "oneOf")]
    if "anyOf" in schema and not fitting[0] or "oneOf" in schema and fitting[1] != 1:
        out.append(f"{at}: fits the wrong number of alternatives")
    if "not" in schema and not problems(value, schema["not"], root, at):
        out.append(f"{at}: fits what it must not")
    return out
