"""sieve: data-quality checks as Spark jobs.

    from sieve import run_suite, register_check
    report = run_suite(spark, {"orders": orders_df, ...}, rules)

Operators live in ``sieve.operators`` (one module per check family), Column
predicates in ``sieve.functions``, suite / reports in ``sieve.plans``, sources
and sinks in ``sieve.sources``, streaming checks in ``sieve.streaming``.
"""

from sieve.plans.rules import RuleError, register_check, rule_types
from sieve.plans.suite import SuiteReport, run_rule, run_suite

__version__ = "0.1.0"

__all__ = ["RuleError", "SuiteReport", "register_check", "rule_types", "run_rule", "run_suite", "__version__"]
