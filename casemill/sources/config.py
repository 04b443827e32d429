"""Configuration: YAML files of a directory, validated on the driver; a session setting may name another directory."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from casemill.functions.text import PLACEHOLDER
from casemill.plans.rules import RuleError, validate

#: Session setting with the directory to use instead of the one that is asked for.
SETTING = "spark.casemill.configDir"
#: Shapes of dates, and words, that a template must not hold: letters get both from fields.
DATE_SHAPE = re.compile(r"\b\d{1,2}\.\d{1,2}\.\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b")
#: What a literal in a rule must not look like: long runs of digits, addresses of mail, placeholders.
PERSONAL = re.compile(rf"\d{{8,}}|[^\s@]+@[^\s@]+\.[^\s@]+|{PLACEHOLDER}")


class ConfigError(ValueError):
    """Configuration that cannot be used."""


def load_config(spark: SparkSession | None, directory: str, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, Any]:
    """Subsystem -> content: exactly one file ``<subsystem>*.yaml`` for each required one; an optional one may be None."""
    import yaml

    at = spark.conf.get(SETTING, directory) if spark is not None else directory
    names = sorted(n for n in os.listdir(at) if n.endswith((".yaml", ".yml")))
    found: dict[str, Any] = {}
    for name in (*required, *optional):
        files = [n for n in names if re.fullmatch(rf"{re.escape(name)}(_v\d+)?\.ya?ml", n)]
        if len(files) > 1 or (not files and name in required):
            raise ConfigError(f"{name}: {len(files)} files in {at}")
        if files:
            with open(os.path.join(at, files[0]), encoding="utf-8") as f:
                found[name] = yaml.safe_load(f)
        else:
            found[name] = None
    return found


def check_unique(values: Iterable[Any], what: str) -> None:
    seen: set[Any] = set()
    for v in values:
        if v in seen:
            raise ConfigError(f"{what} {v!r} is there twice")
        seen.add(v)


def check_subset(values: Iterable[Any], known: Iterable[Any], what: str) -> None:
    unknown = sorted(set(values) - set(known))
    if unknown:
        raise ConfigError(f"unknown {what}: {unknown}")


def check_sorted(values: Sequence[Any], what: str) -> None:
    if list(values) != sorted(values):
        raise ConfigError(f"{what} are not in order")


def leaves(rule: Mapping[str, Any]) -> list[Mapping[str, Any]]:
    """The comparisons of a predicate."""
    if "field" in rule:
        return [rule]
    return [x for part in rule.get("all", []) + rule.get("any", []) for x in leaves(part)]


def lint_rule(rule: Mapping[str, Any], *, identity: Sequence[str] = (), texts: Sequence[str] = (), qualifying: Sequence[str] | None = None) -> list[str]:
    """What is wrong with a predicate: fields of identity may only be tested for presence, texts only searched or tested for presence,
    literals must not look like personal data, and if ``qualifying`` is given, no other field may stand there."""
    try:
        validate(rule)
    except RuleError as error:
        return [str(error)]
    wrong = []
    for leaf in leaves(rule):
        name, op, value = leaf["field"], leaf["op"], leaf["value"]
        presence = op in ("eq", "ne") and value is None
        if any(name == p or name.startswith(p + ".") for p in identity) and not presence:
            wrong.append(f"{name}: an identity field may only be tested for presence")
        if name in texts and not presence and op not in ("contains", "matches"):
            wrong.append(f"{name}: a text may only be searched")
        if qualifying is not None and name not in qualifying:
            wrong.append(f"{name}: not a qualifying field")
        for literal in value if isinstance(value, list | tuple) else [value]:
            if isinstance(literal, str) and PERSONAL.search(literal):
                wrong.append(f"{name}: a literal looks like personal data")
    return wrong


def lint_template(template: str, declared: Sequence[str], forbidden: Sequence[str] = ()) -> list[str]:
    """Undeclared and unused names, shapes of dates and forbidden words of a template."""
    used = re.findall(r"\{(\w+)\}", template)
    wrong = [f"undeclared name {n!r}" for n in sorted(set(used) - set(declared))] + [f"unused name {n!r}" for n in sorted(set(declared) - set(used))]
    if DATE_SHAPE.search(template):
        wrong.append("a date is written out")
    return wrong + [f"forbidden word {w!r}" for w in forbidden if w.casefold() in template.casefold()]


def dangling(references: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References (to units, procedures, fields) that name nothing known."""
    return references.join(known.select(key).distinct(), key, "left_anti")
