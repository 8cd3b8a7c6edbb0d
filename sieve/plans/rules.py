"""Rule dictionaries: validation (E5) and compilation to check outcomes.

A rule is a plain dict with ``name``, ``type``, ``severity`` and type-specific
fields. ``compile_rule`` turns it into an ``Outcome`` over the given tables.
New rule types plug in through ``register_check``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators import completeness as C
from sieve.operators import custom_sql as Q
from sieve.operators import duplicates as D
from sieve.operators import outliers as O
from sieve.operators import patterns as PT
from sieve.operators import ranges as N
from sieve.operators import nested as NE
from sieve.operators import reconcile as RC
from sieve.operators import referential as R
from sieve.operators import temporal as TM
from sieve.operators.base import Outcome

SEVERITIES = ("critical", "high", "medium", "low")
SEVERITY_RANK = {s: i for i, s in enumerate(SEVERITIES)}  # 0 = most severe


#: Where a suite leaves what it already knows of an outlier rule's column.
STATISTICS = "__statistics"


class RuleError(ValueError):
    """A rule file that cannot be run at all (missing name/type/severity...)."""


CheckFn = Callable[[SparkSession, dict, dict], Outcome]
_REGISTRY: dict[str, CheckFn] = {}
#: Fields a rule of each type must have; of a tuple, one at least.
_REQUIRED: dict[str, tuple] = {}


def register_check(rule_type: str, fn: CheckFn, required: tuple = ()) -> None:
    """Extension point: ``fn(spark, tables, rule) -> Outcome``. ``required``: fields a rule of this type must have
    (of a tuple among them, one at least)."""
    _REGISTRY[rule_type.lower()] = fn
    _REQUIRED[rule_type.lower()] = tuple(required)


def rule_types() -> list[str]:
    return sorted(_REGISTRY)


def _table(tables: dict, rule: dict, key: str = "table") -> DataFrame:
    name = rule.get(key)
    if name not in tables:
        raise ValueError(f"unknown table {name!r}")
    return tables[name]


def _columns_exist(df: DataFrame, cols) -> None:
    have = set(df.columns)
    for c in cols:
        if c not in have:
            raise ValueError(f"unknown column {c!r}")


def _completeness(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, rule["columns"])
    return C.completeness(df, list(rule["columns"]), rule.get("check_empty_strings", True),
                          rule.get("check_whitespace", False))


def _referential(spark, tables, rule):
    df, ref = _table(tables, rule), _table(tables, rule, "reference_table")
    _columns_exist(df, [rule["column"]])
    _columns_exist(ref, [rule["reference_column"]])
    return R.orphans(df, rule["column"], ref, rule["reference_column"], rule.get("allow_null", True))


def _duplicates(spark, tables, rule):
    cols = rule.get("columns") or [rule["column"]]
    df = _table(tables, rule)
    _columns_exist(df, cols)
    return D.duplicates(df, list(cols), rule.get("case_sensitive", True), rule.get("ignore_null", True))


def _fuzzy(spark, tables, rule):
    df = _table(tables, rule)
    cols = [rule["id_column"], *rule["phonetic_columns"], *rule.get("exact_columns", [])]
    _columns_exist(df, cols)
    return D.fuzzy_duplicates(df, rule["id_column"], list(rule["phonetic_columns"]),
                              list(rule.get("exact_columns", [])))


def _range(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["column"]])
    return N.value_range(df, rule["column"], rule.get("min"), rule.get("max"), rule.get("inclusive", True))


def _date_range(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["column"]])
    hi = rule.get("max")
    if hi == "now":
        hi = rule.get("as_of", "now")
    return N.date_range(df, rule["column"], rule.get("min"), hi)


def _future_dates(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["column"]])
    return N.future_dates(df, rule["column"], rule.get("as_of"))


def _cross_field(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["left"], rule["right"]])
    return N.cross_field(df, rule["left"], rule["operator"], rule["right"])


def _pattern(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["column"]])
    if rule.get("like"):
        return PT.like(df, rule["column"], rule["like"], rule.get("inverse", False), rule.get("match_null", True))
    return PT.pattern(df, rule["column"], rule["pattern"], rule.get("inverse", False), rule.get("match_null", True),
                      rule.get("must_contain"))


def _outliers(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [rule["column"]])
    kw = {"statistics": rule.get(STATISTICS)}
    if rule.get("quartiles"):
        kw["quartiles"] = rule["quartiles"]
    return O.outliers(df, rule["column"], rule.get("method", "zscore"), rule.get("threshold"),
                      rule.get("direction", "both"), **kw)


def _custom_sql(spark, tables, rule):
    return Q.custom_sql(spark, rule["query"], rule.get("count_query"))


def _multi_parent(spark, tables, rule):
    df, links = _table(tables, rule), []
    for link in rule["links"]:
        parent = _table(tables, link, "reference_table")
        _columns_exist(df, [link["column"]])
        _columns_exist(parent, [link["reference_column"]])
        links.append((link["column"], parent, link["reference_column"]))
    return R.multi_parent_orphans(df, links)


def _condition(rule, field):
    return F.expr(rule[field]) if rule.get(field) else None


def _inactive_parents(spark, tables, rule):
    parent, child = _table(tables, rule), _table(tables, rule, "child_table")
    _columns_exist(parent, [rule["key"]])
    _columns_exist(child, [rule["child_key"]])
    recent = _condition(rule, "child_filter")
    if rule.get("within"):
        _columns_exist(child, [rule["child_date"]])
        window = Q.since(child, rule["child_date"], rule["within"], rule.get("as_of"))
        recent = window if recent is None else recent & window
    return Q.inactive_parents(parent, rule["key"], child, rule["child_key"], _condition(rule, "filter"), recent)


def _child_after_parent(spark, tables, rule):
    child, parent = _table(tables, rule), _table(tables, rule, "parent_table")
    _columns_exist(child, [rule["child_key"], rule["child_date"]])
    _columns_exist(parent, [rule["parent_key"], rule["parent_date"]])
    return Q.child_after_parent_event(child, rule["child_key"], rule["child_date"], parent, rule["parent_key"],
                                      rule["parent_date"], _condition(rule, "parent_filter"))


def _pairs(value) -> list[tuple[str, str]]:
    """Join columns: a name both tables have, a pair of names, or a list of either."""
    items = [value] if isinstance(value, str) else list(value)
    return [(c, c) if isinstance(c, str) else tuple(c) for c in items]


def _state_at_event(spark, tables, rule):
    df, states = _table(tables, rule), _table(tables, rule, "state_table")
    on = _pairs(rule["on"])
    _columns_exist(df, [a for a, _ in on] + [rule["time"]])
    _columns_exist(states, [b for _, b in on] + [rule["state_time"], *rule["state_columns"]])
    return TM.state_at_event(df, states, on, (rule["time"], rule["state_time"]), rule["state_columns"], rule["violation"],
                             strict=rule.get("strict", False), within=rule.get("within"), tie=rule.get("tie"))


def _overlap(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, [*rule["keys"], rule["start"], rule["end"]])
    return TM.overlaps(df, list(rule["keys"]), rule["start"], rule["end"], inclusive=rule.get("inclusive", False))


def _reconciliation(spark, tables, rule):
    return RC.reconcile(_table(tables, rule), _table(tables, rule, "reference_table"), rule.get("columns"))


def _nested_completeness(spark, tables, rule):
    df = _table(tables, rule)
    _columns_exist(df, rule["columns"])
    return NE.nested_completeness(df, list(rule["columns"]), rule.get("paths"), rule.get("check_empty_strings", True))


for _t, _fn, _need in (
    ("completeness", _completeness, ("table", "columns")),
    ("referential_integrity", _referential, ("table", "column", "reference_table", "reference_column")),
    ("multi_parent", _multi_parent, ("table", "links")),
    ("duplicates", _duplicates, ("table", ("columns", "column"))),
    ("uniqueness", _duplicates, ("table", ("columns", "column"))),
    ("fuzzy_duplicates", _fuzzy, ("table", "id_column", "phonetic_columns")),
    ("range", _range, ("table", "column", ("min", "max"))),
    ("date_range", _date_range, ("table", "column", ("min", "max"))),
    ("future_dates", _future_dates, ("table", "column")),
    ("cross_field", _cross_field, ("table", "left", "operator", "right")),
    ("pattern", _pattern, ("table", "column", ("pattern", "like"))),
    ("outliers", _outliers, ("table", "column")),
    ("custom_sql", _custom_sql, ("query",)),
    ("inactive_parents", _inactive_parents, ("table", "key", "child_table", "child_key")),
    ("child_after_parent", _child_after_parent,
     ("table", "child_key", "child_date", "parent_table", "parent_key", "parent_date")),
    ("state_at_event", _state_at_event, ("table", "on", "time", "state_table", "state_time", "state_columns", "violation")),
    ("overlap", _overlap, ("table", "keys", "start", "end")),
    ("reconciliation", _reconciliation, ("table", "reference_table")),
    ("nested_completeness", _nested_completeness, ("table", "columns")),
):
    register_check(_t, _fn, _need)


def _missing_fields(rule: dict) -> list[str]:
    """Required fields the rule lacks; alternatives are named together."""
    def there(field: str) -> bool:
        value = rule.get(field)
        return value is not None and value != [] and not (isinstance(value, str) and not value.strip())

    need = [f if isinstance(f, tuple) else (f,) for f in _REQUIRED[str(rule["type"]).lower()]]
    return [" or ".join(alternatives) for alternatives in need if not any(there(f) for f in alternatives)]


def validate_rules(rules: list[dict]) -> None:
    """E5: every rule has a unique name, a known type with the fields that type needs, and a known severity.

    Checked for all rules before any job runs. What depends on the data (unknown tables or columns, SQL that does
    not run) becomes one failed result at run time and leaves the other rules alone (E4)."""
    seen = set()
    for i, rule in enumerate(rules):
        if not isinstance(rule, dict):
            raise RuleError(f"rule number {i + 1} is no mapping")
        for f in ("name", "type", "severity"):
            if f not in rule:
                raise RuleError(f"rule number {i + 1} has no {f!r}")
        name = rule["name"]
        if str(rule["severity"]).lower() not in SEVERITIES:
            raise RuleError(f"rule {name!r}: severity {rule['severity']!r} is none of {', '.join(SEVERITIES)}")
        if str(rule["type"]).lower() not in _REGISTRY:
            raise RuleError(f"rule {name!r}: type {rule['type']!r} is none of {', '.join(rule_types())}")
        if lacking := _missing_fields(rule):
            raise RuleError(f"rule {name!r} ({rule['type']}) lacks {', '.join(lacking)}")
        if name in seen:
            raise RuleError(f"two rules are named {name!r}")
        seen.add(name)


def compile_rule(spark: SparkSession, tables: dict, rule: dict) -> Outcome:
    return _REGISTRY[str(rule["type"]).lower()](spark, tables, rule)
