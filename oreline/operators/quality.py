"""Declarative data-quality suites.

A suite is ``{"tables": [{"table": name, "checks": [check, ...]}, ...]}`` and a check a
dict with ``name``, ``type``, optional ``severity`` (``error`` by default, ``warn``) and
the keys its type needs::

    not_null         column                    no NULLs
    unique           columns                   no value group twice (NULL is a value)
    positive         column                    no value <= 0
    non_negative     column                    no value < 0
    in_set           column, values            no value outside (NULL passes)
    row_count        min, max (both optional)  rows within the bounds
    min_date_before  column, date              min <= date; passes when empty
    max_date_after   column, date              max >= date; fails when empty
    max_age_days     column, days              max >= run date - days; fails when empty
    future_beyond    column, days              max <= run date + days; passes when empty
    fk               column, ref_table, [ref_column]   no row without a match (NULL is one)
    sql              query                     first cell of the first row is 0

All checks of a table that one pass can measure share one aggregate over it, and all its
``unique`` checks one scan by grouping sets; ``sql`` checks are the columns of one SELECT, whose
subqueries Catalyst merges where they read alike; each ``fk`` plans its own.  ``watch`` measures
one-pass checks while a table is written.  The result has one row per check.

A table is a DataFrame given under that name or else a table or view of the catalog, which
may be named ``schema.table``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.util import inheritable_thread_target

# Severities and the keys each check type needs.
SEVERITIES = ("error", "warn")
REQUIRED_KEYS = {
    "not_null": ("column",),
    "unique": ("columns",),
    "positive": ("column",),
    "non_negative": ("column",),
    "in_set": ("column", "values"),
    "row_count": (),
    "min_date_before": ("column", "date"),
    "max_date_after": ("column", "date"),
    "max_age_days": ("column", "days"),
    "future_beyond": ("column", "days"),
    "fk": ("column", "ref_table"),
    "sql": ("query",),
}
# What the count measured by a check type counts.
COUNTED = {
    "not_null": "NULL rows",
    "unique": "duplicate groups",
    "positive": "non-positive rows",
    "non_negative": "negative rows",
    "in_set": "values outside whitelist",
    "fk": "orphaned values",
    "sql": "violating rows",
}

RESULT = T.StructType(
    [
        T.StructField("check_no", T.IntegerType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("check_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("measured", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)


class QualityGateError(RuntimeError):
    """At least one check of severity ``error`` failed."""


class _Unusable(Exception):
    """The check cannot be evaluated against this table; says why."""


@dataclass(frozen=True)
class _Check:
    number: int
    table: str
    spec: Mapping

    @property
    def kind(self) -> str:
        return self.spec["type"]

    def result(self, passed: str, measured: str, detail: str) -> str:
        """The check's result row as a SQL struct.  The arguments are SQL expressions.

        Text, because a suite makes hundreds of them: one string per check costs one
        call into the JVM where nested column objects would cost dozens.
        """
        values = (
            str(self.number),
            _quoted(self.table),
            _quoted(self.spec["name"]),
            _quoted(self.kind),
            _quoted(self.spec.get("severity", "error")),
            passed,
            measured,
            detail,
        )
        fields = [
            f"'{f.name}', CAST({v} AS {f.dataType.simpleString()})" for v, f in zip(values, RESULT.fields)
        ]
        return f"named_struct({', '.join(fields)})"

    def failure(self, reason: str) -> str:
        return self.result("false", "NULL", _quoted(f"error evaluating: {reason}"))


def _quoted(text: str) -> str:
    """``text`` as a SQL string literal."""
    escaped = str(text).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _rows(df: DataFrame, results: list[str]) -> DataFrame:
    """``results`` as rows, evaluated over the single row of ``df``."""
    return df.selectExpr(f"inline(array({', '.join(results)}))")


def read_suite(spark: SparkSession, path: str) -> dict:
    """A suite declared in a JSON file, on any storage that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_suite(suite: Mapping) -> list[_Check]:
    """Validate a suite and number its checks; raises ``ValueError`` on a bad declaration."""
    checks: list[_Check] = []
    for entry in suite["tables"]:
        table = entry.get("table")
        if not table:
            raise ValueError(f"suite entry without a table: {entry}")
        for spec in entry["checks"]:
            missing = [k for k in ("name", "type") if not spec.get(k)]
            if missing:
                raise ValueError(f"{table}: check without {' and '.join(missing)}: {spec}")
            label = f"{table}.{spec['name']}"
            if spec["type"] not in REQUIRED_KEYS:
                raise ValueError(f"{label}: unknown check type {spec['type']!r}")
            if spec.get("severity", "error") not in SEVERITIES:
                raise ValueError(f"{label}: unknown severity {spec['severity']!r}")
            absent = [k for k in REQUIRED_KEYS[spec["type"]] if spec.get(k) in (None, [], "")]
            if absent:
                raise ValueError(f"{label}: missing {', '.join(absent)}")
            if "date" in spec:
                date.fromisoformat(spec["date"])
            for bound in ("min", "max", "days"):
                if not isinstance(spec.get(bound, 0), (int, float)):
                    raise ValueError(f"{label}: {bound} is not a number")
            if spec["type"] == "row_count":
                spec = {"min": 0, "max": float("inf"), **spec}
            checks.append(_Check(len(checks), table, spec))
    return checks


# -- measuring ---------------------------------------------------------------


def _field(df: DataFrame, name: str, table: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name.lower() == name.lower():
            return field
    raise _Unusable(f"no column {name} in {table}")


def _table(spark: SparkSession, tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    if name in tables:
        return tables[name]
    try:
        return spark.table(name)
    except PySparkException:
        raise _Unusable(f"no table {name}") from None


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _typed_values(values: list, field: T.StructField) -> list:
    """Whitelist values in the column's own type, so that no cast can fail at run time."""

    def wrong(value):
        return _Unusable(f"{value!r} cannot be compared with {field.dataType.simpleString()}")

    typed = []
    for value in values:
        if isinstance(field.dataType, T.StringType):
            fits = isinstance(value, str)
        elif isinstance(field.dataType, T.BooleanType):
            fits = isinstance(value, bool)
        elif isinstance(field.dataType, T.NumericType):
            fits = isinstance(value, (int, float)) and not isinstance(value, bool)
        elif isinstance(field.dataType, T.DateType):
            fits = isinstance(value, str)
            value = date.fromisoformat(value) if fits else value
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            fits = isinstance(value, str)
            if fits:
                datetime.fromisoformat(value)
                value = F.lit(value).cast(field.dataType)
        else:
            fits = False
        if not fits:
            raise wrong(value)
        typed.append(value)
    return typed


def _count_measure(check: _Check, df: DataFrame) -> Column:
    """Aggregate counting the violating rows."""
    field = _field(df, check.spec["column"], check.table)
    value = _col(field.name)
    if check.kind == "not_null":
        return F.count_if(value.isNull())
    if check.kind == "in_set":
        allowed = _typed_values(check.spec["values"], field)
        return F.count_if(~value.isin(allowed))
    if not isinstance(field.dataType, T.NumericType):
        raise _Unusable(f"column {field.name} is {field.dataType.simpleString()}, not numeric")
    if check.kind == "positive":
        return F.count_if(value <= 0)
    return F.count_if(value < 0)


def _date_measure(check: _Check, df: DataFrame) -> Column:
    field = _field(df, check.spec["column"], check.table)
    if not isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise _Unusable(f"column {field.name} is {field.dataType.simpleString()}, not a date")
    extreme = F.min if check.kind == "min_date_before" else F.max
    return F.to_date(extreme(_col(field.name)))


def _one_pass(check: _Check, df: DataFrame, run_date: date) -> tuple[Column, str]:
    """For a check one aggregate measures: that aggregate, to be named as ``_measured``
    says, and the result over it."""
    spec, m = check.spec, _measured(check)
    if check.kind == "row_count":
        low, high = spec["min"], spec["max"]
        upper = "" if high == float("inf") else f" AND {m} <= {high}"
        # Fixed value: the wording of this detail.
        shown = f"concat('count=', {m}, ' (expected [{low}, {high}])')"
        return F.count(F.lit(1)), check.result(f"{m} >= {low}{upper}", m, shown)
    if check.kind in ("not_null", "positive", "non_negative", "in_set"):
        return _count_measure(check, df), _zero_result(check, m)

    word, sign, when_empty = {
        "min_date_before": ("min", "<=", "true"),
        "max_date_after": ("max", ">=", "false"),
        "max_age_days": ("max", ">=", "false"),
        "future_beyond": ("max", "<=", "true"),
    }[check.kind]
    limit = {
        "max_age_days": lambda: run_date - timedelta(days=spec["days"]),
        "future_beyond": lambda: run_date + timedelta(days=spec["days"]),
    }.get(check.kind, lambda: date.fromisoformat(spec["date"]))()
    # Fixed value: the wording of this detail.
    shown = f"concat('{word}=', coalesce(CAST({m} AS STRING), 'None'), ' (must be {sign} {limit})')"
    passed = f"coalesce({m} {sign} DATE '{limit}', {when_empty})"
    return _date_measure(check, df), check.result(passed, m, shown)


def _measured(check: _Check) -> str:
    return f"m{check.number}"


def _zero_result(check: _Check, measured: str) -> str:
    return check.result(f"{measured} = 0", measured, f"concat({measured}, ' {COUNTED[check.kind]}')")


def _key_names(check: _Check, df: DataFrame) -> tuple[str, ...]:
    return tuple(sorted({_field(df, c, check.table).name for c in check.spec["columns"]}))


def _unique(checks: list[_Check], df: DataFrame) -> DataFrame:
    """Value groups that occur twice, of all ``unique`` checks of a table in one scan.

    A row is counted once per set of columns; the sets are told apart by the grouping id, as a
    column left out of a set is NULL like a missing value."""
    keys = {check.number: _key_names(check, df) for check in checks}
    sets = list(dict.fromkeys(keys.values()))
    if len(sets) == 1:
        groups = df.groupBy(*[_col(c) for c in sets[0]]).agg(F.count(F.lit(1)).alias("_rows"))
        groups = groups.withColumn("_set", F.lit(0))
        number = {sets[0]: 0}
    else:
        columns = list(dict.fromkeys(c for s in sets for c in s))
        groups = df.groupingSets([[_col(c) for c in s] for s in sets], *[_col(c) for c in columns]).agg(
            F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("_rows")
        )
        number = {s: int("".join(str(int(c not in s)) for c in columns), 2) for s in sets}
    measures = [
        F.count_if((F.col("_set") == number[s]) & (F.col("_rows") > 1)).alias(_measured(check))
        for check in checks
        for s in [keys[check.number]]
    ]
    return _rows(groups.agg(*measures), [_zero_result(c, _measured(c)) for c in checks])


def _number_form(kind: T.NumericType) -> str:
    """A pattern that fits every text which can be cast to ``kind`` (and some that cannot)."""
    blank, sign = r"[\x00-\x20\x7F]*", "[+-]?"
    if isinstance(kind, T.IntegralType):
        digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10}.get(type(kind), 19)
        return rf"\A{blank}{sign}0*[0-9]{{1,{digits}}}{blank}\z"
    word = r"[\p{Nd}.][\p{Nd}.A-Za-z]*([eEpP][+-]?\p{Nd}+)?[dDfF]?|(?i:nan|inf(inity)?)"
    return rf"\A{blank}{sign}({word}){blank}\z"


def _comparable(field: T.StructField, other: T.StructField) -> Column:
    """``field`` as a key to meet ``other``.  Of text and number the text is converted, to
    NULL where it is no number; other types must be equal."""
    kinds = (field.dataType, other.dataType)
    number, text = ([isinstance(k, c) for k in kinds] for c in (T.NumericType, T.StringType))
    if kinds[0] == kinds[1] or all(number):
        return _col(field.name)
    if number[1] and text[0]:
        # Each text that a cast refuses costs an exception; the pattern spares those of another form.
        value = _col(field.name)
        return F.when(value.rlike(_number_form(kinds[1])), value.try_cast(kinds[1]))
    if not (number[0] and text[1]):
        raise _Unusable(f"{field.name} and {other.name} differ in type")
    return _col(field.name)


def _fk(check: _Check, df: DataFrame, ref: DataFrame) -> DataFrame:
    """Orphan rows.  Both sides shrink to distinct keys before they are shuffled."""
    spec = check.spec
    field = _field(df, spec["column"], check.table)
    ref_field = _field(ref, spec.get("ref_column", spec["column"]), spec["ref_table"])
    keys = df.groupBy(_comparable(field, ref_field).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    known = ref.select(_comparable(ref_field, field).alias("_key")).distinct()
    orphans = keys.join(known, "_key", "left_anti")
    return _rows(
        orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("m")),
        [_zero_result(check, "m")],
    )


def _sql(check: _Check, spark: SparkSession) -> tuple[DataFrame, str, str]:
    """For a ``sql`` check its answer by itself, the same as a subquery of one struct (NULL
    where the query gives no row), and the result over a column of that name."""
    answer = spark.sql(check.spec["query"])
    names = ["_v", *[f"_{i}" for i in range(1, len(answer.columns))]]
    name = _measured(check)
    alone = answer.limit(1).toDF(*names).agg(F.first(F.struct(F.col("_v").alias("v"))).alias(name))
    inside = f"(SELECT named_struct('v', _v) FROM (\n{check.spec['query']}\n) AS t({', '.join(names)}) LIMIT 1)"
    return alone, f"{inside} AS {name}", _sql_result(check, answer.columns[0], answer.schema.fields[0].dataType)


def _sql_result(check: _Check, cell: str, kind: T.DataType) -> str:
    m = f"{_measured(check)}.v"
    if isinstance(kind, T.BooleanType):
        zero, shown = f"NOT {m}", f"initcap(CAST({m} AS STRING))"
    elif isinstance(kind, T.NumericType):
        zero, shown = f"{m} = 0", f"CAST({m} AS STRING)"
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        zero, shown = "false", f"CAST(CAST({m} AS DATE) AS STRING)"
    else:
        zero, shown = "false", f"CAST({m} AS STRING)"
    verdict = check.result(
        f"coalesce({zero}, false)", shown, f"concat(coalesce({shown}, 'None'), ' {COUNTED['sql']}')"
    )
    empty = check.failure(f"no row for {cell}")
    return f"IF({_measured(check)} IS NULL, {empty}, {verdict})"


def _sql_answers(spark: SparkSession, planned: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """All ``sql`` checks in one SELECT of subqueries; each by itself where they cannot be (a
    statement that is no query, say)."""
    if len(planned) > 1:
        try:
            together = spark.sql("SELECT " + ", ".join(inside for _, inside, _ in planned))
            return [_rows(together, [result for *_, result in planned])]
        except PySparkException:
            pass
    return [_rows(alone, [result]) for alone, _, result in planned]


def _reason(exc: Exception) -> str:
    """Short and stable: Spark's error condition where there is one."""
    if isinstance(exc, PySparkException) and exc.getCondition():
        return exc.getCondition()
    return str(exc).split("\n", 1)[0]


def _plan(
    spark: SparkSession, checks: list[_Check], tables: Mapping[str, DataFrame], run_date: date
) -> DataFrame:
    if isinstance(run_date, datetime):
        run_date = run_date.date()
    parts: list[DataFrame] = []
    failures: list[str] = []
    fused: dict[str, list[tuple[Column, str]]] = {}
    unique: dict[str, list[_Check]] = {}
    answers: list[tuple[DataFrame, str, str]] = []
    for check in checks:
        try:
            if check.kind == "sql":
                answers.append(_sql(check, spark))
                continue
            df = _table(spark, tables, check.table)
            if check.kind == "unique":
                _key_names(check, df)
                unique.setdefault(check.table, []).append(check)
            elif check.kind == "fk":
                parts.append(_fk(check, df, _table(spark, tables, check.spec["ref_table"])))
            else:
                measure, result = _one_pass(check, df, run_date)
                fused.setdefault(check.table, []).append((measure.alias(_measured(check)), result))
        except (_Unusable, PySparkException, ValueError) as exc:
            failures.append(check.failure(_reason(exc)))
    parts += _sql_answers(spark, answers)
    for table, group in unique.items():
        parts.append(_unique(group, _table(spark, tables, table)))
    for table, measures in fused.items():
        parts.append(_rows(_table(spark, tables, table).agg(*[m for m, _ in measures]), [r for _, r in measures]))
    if failures:
        parts.append(_rows(spark.range(1), failures))
    if not parts:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.unionAll, parts)


@contextmanager
def _views(spark: SparkSession, tables: Mapping[str, DataFrame], checks: list[_Check]) -> Iterator[None]:
    """``tables`` as temp views while ``sql`` checks are planned; views that had the names
    before come back.  A dotted name cannot be a view: SQL finds it in the catalog."""
    names = [n for n in tables if "." not in n] if any(c.kind == "sql" for c in checks) else []
    hidden = {}
    for name in names:
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            hidden[name] = spark.table(name)
    try:
        for name in names:
            tables[name].createOrReplaceTempView(name)
        yield
    finally:
        for name in names:
            spark.catalog.dropTempView(name)
        for name, df in hidden.items():
            df.createOrReplaceTempView(name)


def evaluate(
    spark: SparkSession, tables: Mapping[str, DataFrame], suite: Mapping, run_date: date
) -> DataFrame:
    """One result row per check; nothing runs until the caller acts on it.

    What can be known from the schemas (a missing table or column, a type that does not
    fit, SQL that does not compile) fails that check alone.
    """
    checks = load_suite(suite)
    with _views(spark, tables, checks):
        return _plan(spark, checks, tables, run_date)


def run_suite(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    suite: Mapping,
    run_date: date,
    at_once: int = 4,
) -> DataFrame:
    """Evaluate now, isolating run-time errors too.

    Tries each table's checks together, ``at_once`` tables side by side.  Should that fail
    (say a cast inside a ``sql`` check), the group is halved until the failing checks are
    alone: for one bad check of n about 2 log2 n further tries.  Jobs carry the tag
    ``quality-<table>``, by which ``spark.interruptTag`` ends a table's checks.
    Brings one row per check to the driver.
    """
    checks = load_suite(suite)

    def results(group: list[_Check]) -> list:
        try:
            return _plan(spark, group, tables, run_date).collect()
        except Exception as exc:  # noqa: BLE001 - find out which check it was
            if len(group) == 1:
                return _rows(spark.range(1), [group[0].failure(_reason(exc))]).collect()
        half = (len(group) + 1) // 2
        return results(group[:half]) + results(group[half:])

    def of_table(group: list[_Check]) -> list:
        tag = "quality-" + group[0].table.replace(",", " ")
        spark.addTag(tag)
        try:
            return results(group)
        finally:
            spark.removeTag(tag)

    # One-pass checks first: they fail or pass together more often than not.
    order = sorted(checks, key=lambda c: c.kind in ("sql", "unique", "fk"))
    groups = [[c for c in order if c.table == t] for t in dict.fromkeys(c.table for c in checks)]
    with _views(spark, tables, checks), ThreadPoolExecutor(max(1, min(at_once, len(groups)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(of_table), groups)
        rows = [row for part in found for row in part]
    return spark.createDataFrame(sorted(rows, key=lambda r: r.check_no), RESULT)


@dataclass
class Watched:
    """A table on its way to be written, and the checks measured on the way."""

    rows: DataFrame
    _observation: Observation
    _schema: T.StructType
    _results: list[str]
    _failures: list[str]

    def results(self) -> DataFrame:
        """One result row per check, once ``rows`` were written (it waits for that)."""
        spark = self.rows.sparkSession
        parts = []
        if self._results:
            got = self._observation.get
            row = spark.createDataFrame([tuple(got[f.name] for f in self._schema)], self._schema)
            parts.append(_rows(row, self._results))
        if self._failures:
            parts.append(_rows(spark.range(1), self._failures))
        return reduce(DataFrame.unionAll, parts, spark.createDataFrame([], RESULT))


def watch(df: DataFrame, table: str, suite: Mapping, run_date: date) -> Watched:
    """Measure the one-pass checks of ``table`` while ``df`` is written: no second read.

    Write ``.rows`` (once) instead of ``df``, then ask for ``.results()``.  ``unique``, ``fk`` and
    ``sql`` checks need a shuffle of their own and are left to ``evaluate``.
    """
    measures, results, failures = [], [], []
    for check in load_suite(suite):
        if check.table == table and check.kind not in ("unique", "fk", "sql"):
            try:
                measure, result = _one_pass(check, df, run_date)
                measures.append(measure.alias(_measured(check)))
                results.append(result)
            except (_Unusable, PySparkException, ValueError) as exc:
                failures.append(check.failure(_reason(exc)))
    observation = Observation()
    schema = df.agg(*measures).schema if measures else T.StructType()
    rows = df.observe(observation, *measures) if measures else df
    return Watched(rows, observation, schema, results, failures)


# -- roll-up -----------------------------------------------------------------


def _failed(severity: str) -> Column:
    return F.count_if(~F.col("passed") & (F.col("severity") == severity))


def _status() -> Column:
    return (
        F.when(_failed("error") > 0, "FAIL").when(_failed("warn") > 0, "WARN").otherwise("PASS")
    )


def overall_status(results: DataFrame) -> DataFrame:
    """``FAIL`` on a failed error check, else ``WARN`` on a failed warn check, else ``PASS``."""
    return results.agg(_status().alias("overall_status"))


def gate_counts(results: DataFrame) -> DataFrame:
    """Failed checks per severity and the ``passed`` of ``total`` tally, in one row."""
    return results.agg(
        _failed("error").alias("failed_errors"),
        _failed("warn").alias("failed_warnings"),
        F.count_if("passed").alias("passed_checks"),
        F.count(F.lit(1)).alias("total_checks"),
    )


def enforce(results: DataFrame) -> None:
    """Raise ``QualityGateError`` when an error check failed (runs the evaluation)."""
    counts = gate_counts(results).first()
    if counts.failed_errors:
        raise QualityGateError(
            f"{counts.failed_errors} error(s), {counts.failed_warnings} warning(s), "
            f"{counts.passed_checks}/{counts.total_checks} checks passed"
        )


def report(results: DataFrame, generated_at: datetime) -> DataFrame:
    """One nested row for ``.write.json``: time, status, and the checks of each table.

    Gathers result rows only, of which there are as many as the suite declares.
    """
    entry = F.struct(
        "check_no",
        F.col("check_name").alias("name"),
        F.col("check_type").alias("type"),
        "severity",
        "passed",
        "measured",
        "detail",
    )
    names = ["name", "type", "severity", "passed", "measured", "detail"]
    per_table = results.groupBy("table_name").agg(
        F.min("check_no").alias("first_no"),
        F.transform(
            F.array_sort(F.collect_list(entry)), lambda c: F.struct(*[c[n].alias(n) for n in names])
        ).alias("checks"),
        _failed("error").alias("errors"),
        _failed("warn").alias("warnings"),
    )
    tables = F.transform(
        F.array_sort(F.collect_list(F.struct("first_no", "table_name", "checks"))),
        lambda t: F.struct(t["table_name"].alias("table"), t["checks"].alias("checks")),
    )
    return per_table.agg(
        F.lit(generated_at.isoformat(timespec="seconds")).alias("generated_at"),
        F.when(F.sum("errors") > 0, "FAIL")
        .when(F.sum("warnings") > 0, "WARN")
        .otherwise("PASS")
        .alias("overall_status"),
        tables.alias("tables"),
    )
