"""Data contracts: row checks, table checks and their enforcement."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordering import null_nan
from tidemark.operators.features import BILLS, PAY_STATUS, PAYMENTS
from tidemark.operators.profile import missing, one_row_to_long

MODES = ("strict", "warn", "log_only")


@dataclass(frozen=True)
class Rule:
    """What one column must hold; ``above`` is an exclusive lower bound."""

    column: str
    type: str
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    above: float | None = None
    allowed: tuple = ()
    unique: bool = False
    required: bool = True


@dataclass(frozen=True)
class Contract:
    """A named, versioned list of rules with an owner, an age limit and a mode."""

    name: str
    rules: tuple[Rule, ...]
    version: str = "1"
    owner: str = ""
    mode: str = "strict"
    max_age_hours: float = 24.0
    created_at: datetime | None = None
    tags: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")


# Domains and bounds of the credit table.
SEX = (1, 2)
EDUCATION = (1, 2, 3, 4)
MARRIAGE = (1, 2, 3)
PAY_STATUS_VALUES = (-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9)
LABEL_SOURCES = ("core_banking", "manual_review", "heuristic", "synthetic")

RAW_RULES = (
    Rule("ID", "bigint", above=0, unique=True),
    Rule("LIMIT_BAL", "double", low=10_000, high=1_000_000),
    Rule("SEX", "bigint", allowed=SEX),
    Rule("EDUCATION", "bigint", allowed=EDUCATION),
    Rule("MARRIAGE", "bigint", allowed=MARRIAGE),
    Rule("AGE", "bigint", low=18, high=100),
    *(Rule(c, "bigint", allowed=PAY_STATUS_VALUES) for c in PAY_STATUS),
    *(Rule(c, "double") for c in BILLS),
    *(Rule(c, "double", low=0) for c in PAYMENTS),
    Rule("DEFAULT_PAYMENT_NEXT_MONTH", "bigint", allowed=(0, 1)),
)
DERIVED_RULES = (
    Rule("utilization_rate", "double", low=-1.0, high=20.0),
    Rule("payment_ratio", "double", low=0.0, high=500.0),
    Rule("max_delay", "double", low=-2.0, high=9.0),
    Rule("avg_delay", "double", low=-2.0, high=9.0),
    Rule("consecutive_delays", "double", low=0.0, high=6.0),
    Rule("bill_trend", "double", low=-500.0, high=500.0),
    Rule("total_payment_ratio", "double", low=0.0, high=500.0),
)
RAW_CONTRACT = Contract("raw_credit", RAW_RULES)
FEATURE_CONTRACT = Contract("credit_features", RAW_RULES + DERIVED_RULES)
LABEL_CONTRACT = Contract(
    "label_batch",
    (
        Rule("applicant_id", "bigint", above=0),
        Rule("label", "bigint", allowed=(0, 1)),
        Rule("label_source", "string", allowed=LABEL_SOURCES),
        Rule("policy_version", "string"),
        Rule("label_timestamp", "string"),
        Rule("observation_date", "string"),
        Rule("outcome_date", "string"),
        Rule("is_corrected", "boolean"),
    ),
)


def _coerced(df: DataFrame, rule: Rule) -> Column:
    value = F.col(f"`{rule.column}`").try_cast(rule.type)
    return null_nan(value) if rule.type in ("double", "float") else value


def _failures(df: DataFrame, rule: Rule) -> dict[str, Column]:
    """Check name -> condition that is true where a row breaks it."""
    raw, value = F.col(f"`{rule.column}`"), _coerced(df, rule)
    empty = missing(df, rule.column)
    out = {"type": ~empty & raw.try_cast(rule.type).isNull()}
    if not rule.nullable:
        out["not_null"] = empty
    if rule.low is not None and rule.high is not None:
        out["range"] = ~value.between(rule.low, rule.high)
    elif rule.low is not None:
        out["low"] = value < rule.low
    elif rule.high is not None:
        out["high"] = value > rule.high
    if rule.above is not None:
        out["above"] = value <= rule.above
    if rule.allowed:
        out["allowed"] = ~value.isin(*rule.allowed)
    return out


def with_violations(df: DataFrame, contract: Contract, name: str = "_violations") -> DataFrame:
    """Add the broken checks of each row as an array of (column, check, value), in one pass.

    Uniqueness is not seen here.  The array comes through a generator, so that a
    later filter on it is not moved below it and does not repeat every check.
    """
    checks = [
        F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(r.column).alias("column"), F.lit(n).alias("check"), F.col(f"`{r.column}`").cast("string").alias("value")))
        for r in contract.rules if r.column in df.columns for n, cond in _failures(df, r).items()
    ]
    found = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(found)).alias(name))


def row_violations(df: DataFrame, contract: Contract, keys: Sequence[str]) -> DataFrame:
    """Every broken check of every row: (keys, column, check, value).

    Row checks are one narrow pass; uniqueness groups by the key first, so a
    key with many copies is combined before the shuffle.
    """
    checked = with_violations(df, contract).select(*keys, "_violations")
    return checked.select(*keys, F.explode("_violations").alias("_v")).select(*keys, "_v.*").unionByName(_copies(df, contract, keys))


def _repeated(df: DataFrame, contract: Contract) -> list[tuple[Rule, Column, DataFrame]]:
    """Each unique rule with its column and the values that stand in more than one row."""
    found = [(r, F.col(f"`{r.column}`")) for r in contract.rules if r.unique and r.column in df.columns]
    return [(r, c, df.groupBy(c.alias("_same")).agg(F.count("*").alias("_n")).where("_n > 1").select("_same")) for r, c in found]


def _copies(df: DataFrame, contract: Contract, keys: Sequence[str]) -> DataFrame:
    """Rows whose value of a unique column stands in more rows."""
    out = None
    for r, column, dup in _repeated(df, contract):
        rows = df.join(dup, column == F.col("_same"), "left_semi").select(
            *keys, F.lit(r.column).alias("column"), F.lit("unique").alias("check"), column.cast("string").alias("value")
        )
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        text = [F.lit(None).cast("string").alias(c) for c in ("column", "check", "value")]
        out = df.select(*keys, *text).limit(0)
    return out


def _schema_facts(df: DataFrame, rules: Sequence[Rule]) -> dict[str, Column]:
    """Subject "column|check" -> number of failed rows, as aggregates."""
    facts: dict[str, Column] = {}
    for r in rules:
        if r.column not in df.columns:
            if r.required:
                facts[f"{r.column}|missing"] = F.coalesce(F.max(F.lit(1)), F.lit(1)).cast("long")
            continue
        value = _coerced(df, r)
        conds = {"type": ~missing(df, r.column) & F.col(f"`{r.column}`").try_cast(r.type).isNull()}
        if not r.nullable:
            conds["null"] = missing(df, r.column)
        if r.low is not None:
            conds["below_min"] = value < r.low
        if r.high is not None:
            conds["above_max"] = value > r.high
        if r.allowed:
            conds["not_allowed"] = ~value.isin(*r.allowed)
        facts.update({f"{r.column}|{n}": F.count_if(cond) for n, cond in conds.items()})
    return facts


def _split_subject(first: str, second: str) -> list[Column]:
    return [
        F.split_part("subject", F.lit("|"), F.lit(1)).alias(first),
        F.split_part("subject", F.lit("|"), F.lit(2)).alias(second),
    ]


def schema_check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failed rows per column and check, all counted in one pass."""
    facts = {s: {"n_failed": c} for s, c in _schema_facts(df, rules).items()}
    out = one_row_to_long(df, facts, "subject")
    return out.select(*_split_subject("column", "check"), "n_failed").withColumn("passed", F.col("n_failed") == 0)


@dataclass(frozen=True)
class StatCheck:
    """min_rows, null_rate, positive_rate, mean_range, std_positive or no_inf."""

    kind: str
    column: str | None = None
    low: float | None = None
    high: float | None = None


STAT_KINDS = ("min_rows", "null_rate", "positive_rate", "mean_range", "std_positive", "no_inf")


def _stat(df: DataFrame, check: StatCheck) -> tuple[Column, Column]:
    """Observed value and pass condition as aggregates."""
    def inside(v: Column) -> Column:
        ok = F.lit(True)
        if check.low is not None:
            ok = ok & (v >= check.low)
        if check.high is not None:
            ok = ok & (v <= check.high)
        return F.coalesce(ok, F.lit(True))

    if check.kind == "min_rows":
        v = F.count("*").cast("double")
        return v, v >= check.low
    empty = missing(df, check.column).cast("double")
    number = null_nan(F.col(f"`{check.column}`").cast("double"))
    if check.kind == "null_rate":
        v = F.avg(empty)
        return v, F.coalesce(v <= check.high, F.lit(True))
    if check.kind == "positive_rate":
        v = F.avg(number)
        return v, F.coalesce(v.between(check.low, check.high), F.lit(False))
    if check.kind == "mean_range":
        v = F.avg(number)
        return v, inside(v)
    if check.kind == "std_positive":
        v = F.stddev_samp(number)
        return v, F.coalesce(v > 0, F.lit(True))
    v = F.count_if(F.abs(number) == float("inf")).cast("double")
    return v, v == 0


def _stat_facts(df: DataFrame, checks: Sequence[StatCheck]) -> dict[str, dict[str, Column]]:
    facts = {}
    for c in checks:
        if c.kind not in STAT_KINDS or (c.kind != "min_rows" and c.column not in df.columns):
            continue
        value, passed = _stat(df, c)
        facts[f"{c.column or ''}|{c.kind}"] = {"value": value, "passed": passed}
    return facts


def statistical_checks(df: DataFrame, checks: Sequence[StatCheck]) -> DataFrame:
    """Table statistics against limits in one pass; an absent column passes."""
    out = one_row_to_long(df, _stat_facts(df, checks), "subject")
    return out.select(*_split_subject("column", "check"), "value", "passed")


CREDIT_GATE_RULES = (
    Rule("LIMIT_BAL", "double", low=0),
    Rule("AGE", "int", low=18, high=100),
    Rule("default.payment.next.month", "int", allowed=(0, 1)),
)
CREDIT_GATE_STATS = (
    StatCheck("min_rows", low=100),
    StatCheck("null_rate", "default.payment.next.month", high=0.05),
    StatCheck("positive_rate", "default.payment.next.month", 0.01, 0.7),
    StatCheck("mean_range", "LIMIT_BAL", 5000, 1_000_000),
)


def validation_gate(df: DataFrame, rules: Sequence[Rule], stats: Sequence[StatCheck]) -> DataFrame:
    """Schema and statistical checks as one result table, from one pass."""
    facts = {s: {"value": c.cast("double"), "passed": c == 0} for s, c in _schema_facts(df, rules).items()}
    facts.update(_stat_facts(df, stats))
    return one_row_to_long(df, facts, "subject").select(*_split_subject("column", "check"), "value", "passed")


class GateFailed(ValueError):
    """A gate in raising mode found failures."""


def raise_on_failure(results: DataFrame, name: str = "gate") -> None:
    """Action: raise with the failed checks (at most one row per check)."""
    failed = results.where(~F.col("passed")).collect()
    if failed:
        lines = ", ".join(f"{r['column']}:{r['check']}={r['value']}" for r in failed)
        raise GateFailed(f"{name}: {len(failed)} failed checks: {lines}")


@dataclass
class Enforcement:
    """Lazy parts of an enforced contract."""

    passed: DataFrame
    quarantine: DataFrame
    summary: DataFrame


def enforce(df: DataFrame, contract: Contract, keys: Sequence[str], now: datetime) -> Enforcement:
    """Rows that pass, rows with their violations, and one summary row.

    ``warn`` and ``log_only`` let every row through.  Call ``finish`` for the
    single action that raises in strict mode.
    """
    violations = row_violations(df, contract, keys)
    passed = df
    if contract.mode == "strict":
        passed = with_violations(df, contract).where(F.size("_violations") == 0).drop("_violations")
        for _, column, dup in _repeated(df, contract):
            passed = passed.join(dup, column == F.col("_same"), "left_anti")
    age = (
        (now - contract.created_at).total_seconds() / 3600 if contract.created_at is not None else 0.0
    )
    # One row per broken row first: the check counts then add up in one pass.
    per_row = violations.groupBy(*keys).agg(F.count("*").alias("_n"))
    summary = per_row.agg(
        F.count("*").alias("n_bad_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_violations")
    ).select(
        F.lit(contract.name).alias("contract"), F.lit(contract.version).alias("version"),
        F.lit(contract.mode).alias("mode"), "n_bad_rows", "n_violations",
        F.lit(float(age)).alias("age_hours"), F.lit(age > contract.max_age_hours).alias("is_stale"),
        ((F.col("n_violations") == 0) | F.lit(contract.mode != "strict")).alias("passed"),
    )
    return Enforcement(passed, violations, summary)


def finish(result: Enforcement) -> None:
    """Action: raise if the enforced contract failed."""
    row = result.summary.first()
    if not row["passed"]:
        raise GateFailed(f"{row['contract']}: {row['n_violations']} violations in {row['n_bad_rows']} rows")


def duplicate_versions(catalog: DataFrame) -> DataFrame:
    """(name, version) pairs registered more than once, which is refused."""
    return catalog.groupBy("name", "version").agg(F.count("*").alias("n")).where("n > 1")


def bounds_quality(df: DataFrame, bounds: Sequence[tuple[str, float | None, float | None, float]]) -> DataFrame:
    """(name, low, high, max null rate): one pass; rates divide by all rows."""
    n = F.count("*")
    facts = {}
    for name, low, high, max_null in bounds:
        if name not in df.columns:
            facts[name] = {
                "null_rate": F.max(F.lit(1.0)), "out_of_range_rate": F.max(F.lit(0.0)),
                "min_value": F.max(F.lit(None).cast("double")), "max_value": F.max(F.lit(None).cast("double")),
                "passed": F.max(F.lit(False)),
            }
            continue
        v = null_nan(F.col(f"`{name}`").cast("double"))
        outside = [v < low] if low is not None else []
        outside += [v > high] if high is not None else []
        broken = reduce(lambda a, b: a | b, outside, F.lit(False))
        null_rate = F.coalesce(F.try_divide(F.count_if(v.isNull()), n), F.lit(0.0))
        range_rate = F.coalesce(F.try_divide(F.count_if(broken), n), F.lit(0.0))
        facts[name] = {
            "null_rate": null_rate, "out_of_range_rate": range_rate, "min_value": F.min(v), "max_value": F.max(v),
            "passed": (null_rate <= max_null) & (range_rate == 0),
        }
    return one_row_to_long(df, facts, "feature")


def infinite_columns(df: DataFrame) -> DataFrame:
    """Names of floating columns that hold an infinity."""
    floats = [c for c, kind in df.dtypes if kind in ("double", "float")]
    facts = {c: {"n_infinite": F.count_if(F.abs(F.col(f"`{c}`")) == float("inf"))} for c in floats}
    return one_row_to_long(df, facts).where("n_infinite > 0")


# JSON types a declared push type accepts (a JSON boolean passes as a number).
PUSH_TYPES = {
    "float": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "BOOLEAN"),
    "int": ("BIGINT", "BOOLEAN"),
    "bool": ("BOOLEAN",),
    "str": ("STRING",),
}


def push_event_errors(
    df: DataFrame, payload: str, required: Sequence[str], types: dict[str, str], key: str | None = None, name: str = "errors"
) -> DataFrame:
    """Add the errors of each JSON payload as an array of strings, empty when valid.

    With ``key``, a missing or empty entity key is an error of its own.
    """
    # The document is parsed once per row and the wanted fields are read once.
    fields = list(dict.fromkeys([*required, *types]))
    parsed = df.withColumn("_doc", F.try_parse_json(payload))
    read = parsed.withColumns({f"_f{i}": F.try_variant_get("_doc", f"$.{n}", "variant") for i, n in enumerate(fields)})
    value = {n: F.col(f"_f{i}") for i, n in enumerate(fields)}
    found = [F.when(value[n].isNull(), F.lit(f"missing:{n}")) for n in required]
    for n, kind in types.items():
        actual = F.regexp_extract(F.schema_of_variant(value[n]), "^[A-Z]+", 0)
        wrong = value[n].isNotNull() & ~F.is_variant_null(value[n]) & ~actual.isin(*PUSH_TYPES[kind])
        found.append(F.when(wrong, F.concat(F.lit(f"type:{n}:"), F.lower(actual))))
    if key is not None:
        found.insert(0, F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", F.lit(f"empty:{key}")))
    broken = F.when(F.col("_doc").isNull(), F.array(F.lit("malformed")))
    errors = F.coalesce(broken, F.filter(F.array(*found), lambda e: e.isNotNull()))
    # Through a generator, so that a later filter on the errors is not moved below
    # the parse, where it would repeat it for every field.
    return read.withColumn(name, F.explode(F.array(errors))).drop("_doc", *[f"_f{i}" for i in range(len(fields))])
