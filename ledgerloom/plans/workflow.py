"""From a task in words to a query that is checked, advised on and explained; nothing is run here."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ledgerloom.plans.builder import explain
from ledgerloom.plans.catalog import Catalog, TableDef
from ledgerloom.plans.lexer import SyntaxProblem
from ledgerloom.plans.validator import TEMPLATES, Finding, choose_template, fill_template, validate


@dataclass
class Workflow:
    text: str
    template: str | None = None
    findings: list[Finding] = field(default_factory=list)
    advice: list[tuple[str, str]] = field(default_factory=list)
    explanation: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not any(f.severity == "error" for f in self.findings)


def features(task: str, catalog: Catalog) -> dict[str, str]:
    """What a task speaks of: a table whose name it holds, a resource and a group of that table, a number."""
    words = {w for w in re.findall(r"\w+", task.lower()) if len(w) > 3}
    like = lambda name: any(name.lower().startswith(w[:5]) or w.startswith(name.lower()[:5]) for w in words)
    named = [(n, t) for n, t in catalog.tables.items() if like(n.split(".")[-1])] or list(catalog.tables.items())
    key, table = max(named, key=lambda x: (bool(x[1].resources), bool(x[1].dims)))
    russian = lambda column: next((k for k, v in table.columns.items() if v == column and re.search("[а-я]", k)), column)
    resource = next((r for r in table.resources if like(russian(r))), (table.resources or [table.presentation or table.key])[0])
    group = next((c for c in table.dims if like(russian(c))), (table.dims or [table.key])[0])
    number = re.search(r"\d+", task)
    other = next((t.name for t in catalog.tables.values() if isinstance(t, TableDef) and t.name != table.name), table.name)
    return {"table": table.name, "resource": russian(resource), "group": russian(group), "field": russian(group), "fields": f"Т.{russian(group)} КАК {russian(group)}", "n": number[0] if number else "10", "other": other}


def generate(task: str, catalog: Catalog) -> tuple[str, str]:
    """(template, text) for a task."""
    name = choose_template(task)
    wanted = set(re.findall(r"{(\w+)}", next(t[2] for t in TEMPLATES if t[0] == name)))
    known = features(task, catalog)
    return name, fill_template(name, **{k: v for k, v in known.items() if k in wanted})


def advise(text: str, spark) -> list[tuple[str, str]]:
    """(rule, message) of the query rules the text breaks."""
    from ledgerloom.operators import rules

    df = spark.createDataFrame([(1, text)], "k int, t string")
    return sorted((r.rule_id, r.message) for r in rules.check_queries(df, "k", "t").collect())  # a row per rule


def run(task_or_text: str, catalog: Catalog, spark) -> Workflow:
    """Generate (unless the text is a query already), validate, advise, explain."""
    if re.match(r"\s*(?:выбрать|select)\b", task_or_text, re.I):
        flow = Workflow(task_or_text)
    else:
        name, text = generate(task_or_text, catalog)
        flow = Workflow(text, name)
    flow.findings = validate(flow.text, catalog)
    flow.advice = advise(flow.text, spark)
    try:
        flow.explanation = explain(flow.text)
    except SyntaxProblem:
        flow.explanation = {}
    return flow
