"""Declarative rules, compiled from JSON to Columns."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import text as T


class RuleError(ValueError):
    """A rule that names no known condition."""


def condition(spec: dict) -> Column:
    """A condition on nodes: and / or / not over leaves ``node_type``, ``name_regex``, ``label``,
    ``complexity_above``, ``complexity_below``, ``property`` ({name, value}) and ``scope``."""
    tests = []
    for key, value in spec.items():
        if key in ("and", "or"):
            parts = [condition(x) for x in value]
            tests.append(reduce(Column.__and__ if key == "and" else Column.__or__, parts, F.lit(key == "and")))
        elif key == "not":
            tests.append(~condition(value))
        elif key == "node_type":
            tests.append(F.col("node_type") == value.lower())
        elif key == "name_regex":
            tests.append(F.col("name").rlike(value))
        elif key == "label":
            tests.append(F.array_contains("labels", value))
        elif key in ("complexity_above", "complexity_below"):
            c = F.expr("try_cast(properties['cyclomatic'] AS bigint)")
            tests.append(c > value if key.endswith("above") else c < value)
        elif key == "property":
            tests.append(F.col("properties")[value["name"]] == value["value"])
        elif key == "scope":
            tests.append(T.in_scope(F.col("qualified_name"), F.col("file_path"), value))
        else:
            raise RuleError(f"no condition is called {key}")
    return F.coalesce(reduce(Column.__and__, tests, F.lit(True)), F.lit(False))


def ruleset(text: str) -> list[tuple[str, Column, list[dict]]]:
    """(name, condition, actions) of a JSON ruleset ``{"rules": [{"name", "match", "actions"}]}``."""
    return [(r["name"], condition(r.get("match", {})), r.get("actions", [])) for r in json.loads(text)["rules"]]


def _without(props: Column, name: str) -> Column:
    return F.map_filter(props, lambda k, v: k != name)


def apply(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes with the labels and properties that the rules' actions give, in their order:
    ``{"add_label": x}`` and ``{"set_property": {"name": n, "value": v}}``."""
    labels, props = F.coalesce("labels", F.array().cast("array<string>")), F.coalesce("properties", F.from_json(F.lit("{}"), "map<string,string>"))
    for _, test, actions in ruleset(text):
        for a in actions:
            if "add_label" in a:
                labels = F.when(test, F.array_union(labels, F.array(F.lit(a["add_label"])))).otherwise(labels)
            elif "set_property" in a:
                name, value = a["set_property"]["name"], a["set_property"]["value"]
                props = F.when(test, F.map_concat(_without(props, name), F.create_map(F.lit(name), F.lit(value)))).otherwise(props)
            else:
                raise RuleError(f"no action is called {next(iter(a), None)}")
    return nodes.withColumns({"labels": labels, "properties": props})


def matched(nodes: DataFrame, text: str) -> DataFrame:
    """(rule, n): how many nodes each rule would touch."""
    sums = [F.sum(F.when(test, 1).otherwise(0)).alias(name) for name, test, _ in ruleset(text)]
    one = nodes.agg(*sums)
    return one.select(F.explode(F.create_map(*[x for c in one.columns for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)))])).alias("rule", "n"))


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def boundary(annotations: Column, name: Column, path: Column) -> Column:
    """What an entry point serves, by its annotations, then its name and path."""
    has = lambda pattern: F.coalesce(F.exists(annotations, lambda a: F.lower(a).rlike(pattern)), F.lit(False))
    return first_match(
        [
            (has(r"(get|post|put|delete|patch|request)mapping|route|restcontroller"), "REST"),
            (has(r"listener|consumer|subscribe"), "MESSAGING"),
            (has(r"scheduled|cron"), "SCHEDULED"),
            (has(r"command|cli\b"), "CLI"),
            (has(r"\btest\b") | (T.role(path, name) == "test"), "TEST"),
        ],
        "INTERNAL",
    )


def statement_rule(spec: dict) -> Column:
    """A rule on statement texts: ``any``, ``all``, ``regex``, ``unless_any``."""
    t, tests = F.col("text"), []
    if spec.get("any"):
        tests.append(reduce(Column.__or__, [t.contains(x) for x in spec["any"]]))
    if spec.get("all"):
        tests.append(reduce(Column.__and__, [t.contains(x) for x in spec["all"]]))
    if spec.get("regex"):
        tests.append(t.rlike(spec["regex"]))
    if not tests:
        raise RuleError("a statement rule needs any, all or regex")
    out = reduce(Column.__and__, tests)
    return out & ~reduce(Column.__or__, [t.contains(x) for x in spec["unless_any"]]) if spec.get("unless_any") else out


def statement_roles(stmts: DataFrame, rules: list[dict]) -> DataFrame:
    """``stmts`` with ``source``, ``sink`` and ``sanitizer``: the first rule of each role that
    matches a statement, or null. Rules have ``role``, ``name`` and a condition."""
    for role in ("source", "sink", "sanitizer"):
        cases = [F.when(statement_rule(r), r["name"]) for r in rules if r["role"] == role]
        stmts = stmts.withColumn(role, F.coalesce(*cases) if cases else F.lit(None).cast("string"))
    return stmts


def verdict(reachable: Column, affected: Column, used: Column) -> Column:
    """What an advisory means for a project."""
    return first_match([(~affected, "not_affected"), (affected & reachable, "exploitable"), (affected & used, "affected"), (affected, "under_investigation")], "unknown")
