"""Free-text labels to fixed codes.

Each rule list of ``fixed_values`` becomes one CASE expression, either as a
Column or as the body of a SQL function, so DataFrame and SQL users share it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, SparkSession, functions as F

from folioscan import fixed_values as fixed
from folioscan.functions.text import (
    SPACE, WHITESPACE, bounded, contains_any, contains_word, first_match, fold, let, literal_map
)

Condition = dict[str, tuple[str, ...]]
Rules = tuple[tuple[str, tuple[Condition, ...]], ...]

_YEAR_WORD = bounded("20[0-9]{2}", length=4)
_YEAR_LEAD = r"^\p{Nd}{2}"


def _holds(text: Column, condition: Condition) -> Column:
    tests = []
    if "parts" in condition:
        tests.append(contains_any(text, condition["parts"]))
    if "words" in condition:
        tests.append(contains_word(text, condition["words"]))
    return reduce(Column.__or__, tests)


def _choose(text: Column, rules: Rules) -> Column:
    chain = F
    for code, conditions in rules:
        chain = chain.when(reduce(Column.__and__, [_holds(text, c) for c in conditions]), F.lit(code))
    return chain.otherwise(F.lit(None).cast("string"))


# Each function takes the raw label. With ``folded`` it takes a column that went
# through ``fold`` before, which lets Spark generate code for the whole rule chain;
# otherwise the text is folded once per value.

def _on_folded(label: Column, folded: bool, rule: Callable[[Column], Column]) -> Column:
    return rule(label) if folded else let(fold(label), rule)


def session_kind(label: Column, folded: bool = False) -> Column:
    return _on_folded(label, folded, lambda text: _choose(text, fixed.SESSION_RULES))


def session_year(label: Column, folded: bool = False) -> Column:
    return _on_folded(
        label,
        folded,
        lambda text: F.coalesce(first_match(text, _YEAR_WORD), F.concat(F.lit("20"), first_match(text, _YEAR_LEAD))),
    )


def session_code(label: Column, folded: bool = False) -> Column:
    """``2024_NORMAL``; null unless both year and kind are found."""
    return F.concat(session_year(label, folded), F.lit("_"), session_kind(label, folded))


def serie(label: Column, folded: bool = False) -> Column:
    return _on_folded(label, folded, lambda text: _choose(text, fixed.SERIE_RULES))


def discipline(label: Column, folded: bool = False) -> Column:
    return _on_folded(label, folded, lambda text: _choose(text, fixed.DISCIPLINE_RULES))


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def location(label: Column, folded: bool = False, single: Column | None = None) -> Column:
    """Exact label first, then the rules on ``single``, the folded text with single blanks."""
    def rule(text: Column) -> Column:
        exact = F.try_element_at(literal_map(fixed.LOCATION_LABELS), text)
        if single is not None:
            return F.coalesce(exact, _choose(single, fixed.LOCATION_RULES))
        return F.coalesce(exact, let(single_blanks(text), lambda words: _choose(words, fixed.LOCATION_RULES)))

    return _on_folded(label, folded, rule)


# --- the same rules for SQL users --------------------------------------------

def _quote(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def _case_sql(text: str, rules: Rules) -> str:
    def holds(condition: Condition) -> str:
        tests = [f"contains({text}, '{part}')" for part in condition.get("parts", ())]
        if "words" in condition:
            tests.append(f"{text} RLIKE {_quote(bounded('|'.join(condition['words'])))}")
        return "(" + " OR ".join(tests) + ")"

    branches = " ".join(f"WHEN {' AND '.join(map(holds, conditions))} THEN '{code}'" for code, conditions in rules)
    return f"CASE {branches} END"


def sql_functions() -> dict[str, str]:
    """Name to body of the label functions; the argument is called ``t``."""
    blanks = "concat(" + ", ".join(f"decode(X'{c.encode().hex()}', 'UTF-8')" for c in WHITESPACE) + ")"
    text = f"lower(btrim(t, {blanks}))"
    year = (
        f"coalesce(nullif(regexp_extract({text}, {_quote(_YEAR_WORD)}, 0), ''),"
        f" '20' || nullif(regexp_extract({text}, {_quote(_YEAR_LEAD)}, 0), ''))"
    )
    kind = _case_sql(text, fixed.SESSION_RULES)
    exact = " ".join(f"WHEN '{label}' THEN '{code}'" for label, code in fixed.LOCATION_LABELS.items())
    single = f"regexp_replace({text}, {_quote(SPACE + '+')}, ' ')"
    return {
        "label_session_kind": kind,
        "label_session_code": f"{year} || '_' || {kind}",
        "label_serie": _case_sql(text, fixed.SERIE_RULES),
        "label_discipline": _case_sql(text, fixed.DISCIPLINE_RULES),
        "label_location": f"coalesce(CASE {text} {exact} END, {_case_sql(single, fixed.LOCATION_RULES)})",
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create the label functions as temporary SQL functions (Catalyst inlines them)."""
    bodies = sql_functions()
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {body}")
    return sorted(bodies)
