"""Bounce-rule list (SRC-7/8).

Format: ``<bounces><regex type=".." category=".."><or>pattern</or>...</regex>...</bounces>``.
A rule's regex is its alternatives joined as ``((alt1)|(alt2)|...)``; the
default order is N..1 in document order (the first rule ranks highest).
Read with Spark's built-in XML source, so any Hadoop path works.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from .default_rules import DEFAULT_RULES

RULES_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("default_order", T.IntegerType(), False),
    T.StructField("patterns", T.ArrayType(T.StringType()), True),
    T.StructField("regex", T.StringType(), True),
    T.StructField("hits", T.LongType(), False),
])

_XML_ROW = T.StructType([
    T.StructField("_type", T.StringType(), True),
    T.StructField("_category", T.StringType(), True),
    T.StructField("or", T.ArrayType(T.StringType()), True),
])


class InvalidRuleList(ValueError):
    pass


def _combined_regex(patterns) -> str:
    return "(" + "|".join("(" + p + ")" for p in patterns) + ")"


def rules_from_list(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    """Rule table from (type, category, [patterns]) tuples in document order."""
    n = len(rules)
    rows = [(i + 1, t, c, n - i, list(p), _combined_regex(p), 0) for i, (t, c, p) in enumerate(rules)]
    return spark.createDataFrame(rows, RULES_SCHEMA)


def default_rules(spark: SparkSession) -> DataFrame:
    return rules_from_list(spark, DEFAULT_RULES)


def write_rules_xml(path: str, rules=DEFAULT_RULES, spark: SparkSession | None = None) -> None:
    """Write a rule list file in the agent's XML format: a local path, or with ``spark`` any that Spark reads."""
    out = ["<bounces>"]
    for t, c, pats in rules:
        out.append(f"    <regex type={quoteattr(t)} category={quoteattr(c)}>")
        out.extend(f"        <or>{escape(p)}</or>" for p in pats)
        out.append("    </regex>")
    out.append("</bounces>")
    text = "\n".join(out) + "\n"
    if spark is not None:  # any file system that Spark reads
        storage.write_text(spark, path, text)
        return
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def _read_rows(spark: SparkSession, path: str) -> list:
    """The rule elements in document order (configuration: tens of rows)."""
    raw = (spark.read.format("xml").option("rowTag", "regex").option("ignoreSurroundingSpaces", "false")
           .schema(_XML_ROW).load(path))
    # one small file is read by one task, in order
    rows = raw.withColumn("_pos", F.monotonically_increasing_id()).collect()
    return sorted(rows, key=lambda r: r["_pos"])


def validate_bounce_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: one row per violation (rule_id, reason, detail); empty = valid."""
    top = spark.read.format("xml").option("rowTag", "bounces").load(path)
    problems = [(0, "bounces element must have just 'regex' children", c)
                for c in top.columns if c not in ("regex", "_corrupt_record")]
    for i, r in enumerate(_read_rows(spark, path), start=1):
        alts = r["or"] or []
        if r["_category"] is None:
            problems.append((i, "missing category", None))
        elif not alts:
            problems.append((i, "no 'or' alternative", r["_category"]))
        elif any(a is None or a == "" for a in alts):
            problems.append((i, "empty alternative", r["_category"]))
    return spark.createDataFrame(problems, "rule_id int, reason string, detail string")


def _check_compiles(spark: SparkSession, patterns: list[str]) -> list[str]:
    """Patterns that Java's regular expressions refuse; no job runs, so a lost cluster is not taken for a bad rule."""
    jvm, bad = spark.sparkContext._jvm, []
    for p in patterns:
        try:
            jvm.java.util.regex.Pattern.compile(p)
        except IllegalArgumentException:  # a PatternSyntaxException in Java
            bad.append(p)
    return bad


def load_bounce_rules(spark: SparkSession, path: str) -> DataFrame:
    """SRC-7: load and validate a rule list; raise InvalidRuleList if invalid.

    Callers keep their previous rule table when this raises (CLS-5)."""
    problems = validate_bounce_rules(spark, path).collect()
    if problems:
        raise InvalidRuleList("; ".join(f"rule {r.rule_id}: {r.reason} ({r.detail})" for r in problems))
    ordered = _read_rows(spark, path)
    n = len(ordered)
    bad = _check_compiles(spark, [p for r in ordered for p in r["or"]])
    if bad:
        raise InvalidRuleList("invalid regular expressions: " + ", ".join(bad))
    data = [(i, r["_type"], r["_category"], n - i + 1, list(r["or"]), _combined_regex(r["or"]), 0)
            for i, r in enumerate(ordered, start=1)]
    return spark.createDataFrame(data, RULES_SCHEMA)
