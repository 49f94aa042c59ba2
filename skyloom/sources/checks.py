"""JSON schema files (draft-07) as Column checks over records' JSON text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.sources.contract import DATE_TIME, UUID

#: How a parsed value's type begins for each type of a schema but object, and what a report calls it.
TYPES = {
    "string": (("STRING",), "a string"),
    "integer": (("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "a whole number"),
    "number": (("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "a number"),
    "boolean": (("BOOLEAN",), "true or false"),
    "object": ((), "an object"),
    "array": (("ARRAY",), "an array"),
    "null": (("VOID",), "null"),
}
#: Keywords that say nothing about a record.
SILENT = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions"}
KNOWN = {"$ref", "type", "required", "properties", "additionalProperties", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "format"}
#: How deep references may lead: a schema that refers to itself has no end as Columns.
DEEPEST = 16


def compile_schema(schema: dict, raw: Column) -> Column:
    """The violations of a schema in a record's JSON text: an array of 'path: message' in order of paths, empty for a valid record.

    All violations are listed, each of one keyword. Text that is not JSON, or
    null, has one: '<root>: not JSON'. References lead to places in the same
    file. A keyword, format or type that is not known here raises at once, so
    nothing is taken as valid because it was not looked at.
    """
    # Each check is an expression of its own over paths from the root, with no lambda around it: so it runs
    # compiled, and what checks have in common (the parsed record, a value, its type) is worked out once.
    root = F.try_parse_json(raw)
    no_names = F.array().cast("array<string>")
    found: list[tuple[str, str, Column, bool]] = []

    def look(rule: dict | bool, at: str, path: str, depth: int) -> None:
        """Note the violations of a rule in the value at a place, if there is one."""
        value = root if at == "$" else F.try_variant_get(root, at, "variant")
        kind, names = F.schema_of_variant(value), F.map_keys(F.try_variant_get(root, at, "map<string,variant>"))
        number, text = F.try_variant_get(root, at, "double"), F.try_variant_get(root, at, "string")

        def tell(failed: Column, message: str) -> None:
            told = f"{path or '<root>'}: {message}"
            found.append((path, told, F.when(value.isNotNull() & failed, F.lit(told)), False))

        def is_(t: str) -> Column:
            if t == "object":
                return names.isNotNull()
            ok = reduce(or_, (kind.startswith(begin) for begin in TYPES[t][0]))
            return ok & (number % 1 == 0) if t == "integer" else ok

        if rule is True or rule == {}:
            return
        if rule is False:
            tell(F.lit(True), "not allowed")
            return
        if "$ref" in rule:
            if depth >= DEEPEST or not rule["$ref"].startswith("#"):
                raise ValueError(f"reference {rule['$ref']!r} at {path or '<root>'}")
            target = schema
            for step in rule["$ref"].lstrip("#").strip("/").split("/"):
                target = target[step.replace("~1", "/").replace("~0", "~")] if step else target
            look(target, at, path, depth + 1)  # draft-07: what stands beside a reference counts for nothing
            return
        if unknown := rule.keys() - KNOWN - SILENT:
            raise ValueError(f"keywords {sorted(unknown)} at {path or '<root>'}")
        if "type" in rule:
            kinds = [rule["type"]] if isinstance(rule["type"], str) else list(rule["type"])
            if not set(kinds) <= TYPES.keys():
                raise ValueError(f"type {rule['type']!r} at {path or '<root>'}")
            tell(~reduce(or_, map(is_, kinds), F.lit(False)), "not " + " or ".join(TYPES[t][1] for t in kinds))
        allowed = rule.get("enum", [rule["const"]] if "const" in rule else None)
        if allowed is not None:
            if not all(isinstance(a, str) for a in allowed):
                raise ValueError(f"values that are not strings at {path or '<root>'}")
            tell(~(is_("string") & F.coalesce(text.isin(*allowed), F.lit(False))), "not one of " + ", ".join(allowed))
        bounds = {"minimum": (number < rule.get("minimum"), "less than"), "maximum": (number > rule.get("maximum"), "more than"), "exclusiveMinimum": (number <= rule.get("exclusiveMinimum"), "not above"), "exclusiveMaximum": (number >= rule.get("exclusiveMaximum"), "not below")}
        for word, (failed, message) in bounds.items():
            if word in rule:
                tell(is_("number") & failed, f"{message} {rule[word]}")
        if "minLength" in rule:
            tell(is_("string") & (F.length(text) < rule["minLength"]), f"shorter than {rule['minLength']}")
        if "maxLength" in rule:
            tell(is_("string") & (F.length(text) > rule["maxLength"]), f"longer than {rule['maxLength']}")
        if "pattern" in rule:
            tell(is_("string") & ~text.rlike(rule["pattern"]), f"does not match {rule['pattern']}")
        if "format" in rule:
            forms = {"date-time": ~text.rlike(DATE_TIME) | text.try_cast("timestamp").isNull(), "uuid": ~text.rlike(UUID)}
            if rule["format"] not in forms:
                raise ValueError(f"format {rule['format']!r} at {path or '<root>'}")
            tell(is_("string") & forms[rule["format"]], f"not a {rule['format']}")
        inside = rule.get("properties", {})
        for name in dict.fromkeys(rule.get("required", [])):
            tell(is_("object") & ~F.array_contains(names, name), f"lacks {name}")
        extra = rule.get("additionalProperties", True)
        if extra is False:
            others, told = F.array_except(names, F.array(*map(F.lit, inside)).cast("array<string>")), f"{path or '<root>'}: unknown field "
            # only records that have such fields pay for the lambda, which is not compiled
            named = F.transform(F.sort_array(others), lambda k: F.concat(F.lit(told), k))
            found.append((path, told, F.when(F.size(others) > 0, named).otherwise(no_names), True))
        elif extra is not True:
            raise ValueError(f"additionalProperties with a schema at {path or '<root>'}")
        for name, own in inside.items():
            look(own, f"{at}['{name}']", f"{path}.{name}" if path else name, depth + 1)

    look(schema, "$", "", 0)
    found.append(("", "<root>: not JSON", F.when(root.isNull(), F.lit("<root>: not JSON")), False))
    # the checks' order is that of what they tell, so that nothing needs sorting in a record
    found.sort(key=lambda x: (x[0].encode(), x[1].encode()))
    blocks = [x[2] if x[3] else F.array(x[2]) for x in found]
    return F.array_except(F.concat(*blocks), F.array(F.lit(None).cast("string")))
