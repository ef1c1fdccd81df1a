"""Stakeholder briefs as a table of JSON documents: parse, check, split and render.

All steps are built-in column expressions over a text column, so a batch of any size is
handled in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vendastat.functions.numeric import to_number
from vendastat.functions.shapes import Fields, Items, Text, Whole, broken_rules

# Keys, allowed statuses and list sizes of a brief document.
REQUIRED_KEYS = ["actions", "caveat", "findings", "headline", "risks", "status", "summary"]
STATUSES = ["Strong", "Stable", "Watch closely", "At risk"]
FINDINGS = 3
ACTIONS = 3
MIN_RISKS = 1
MAX_RISKS = 2
LAST_PRIORITY = 99

BRIEF_SCHEMA = """
    status string, headline string, summary string,
    findings array<struct<label: string, number: string, detail: string>>,
    risks array<string>,
    actions array<struct<priority: string, action: string, reason: string, expected_impact: string>>,
    caveat string
"""

# The declared shape of a brief document, which the strict form asks for.
BRIEF_SHAPE = Fields(
    status=Text(one_of=tuple(STATUSES)),
    headline=Text(),
    summary=Text(),
    findings=Items(Fields(label=Text(), number=Text(), detail=Text()), FINDINGS, FINDINGS),
    risks=Items(Text(), MIN_RISKS, MAX_RISKS),
    actions=Items(
        Fields(priority=Whole(one_of=(1, 2, 3)), action=Text(), reason=Text(), expected_impact=Text()), ACTIONS, ACTIONS
    ),
    caveat=Text(),
)

# Headings and default caveat of the rendered text.
TITLE = "# Stakeholder Brief — "
DEFAULT_CAVEAT = (
    "These figures describe the selected data and filters; they do not establish causation."
)


_STRICT_JSON = {"allowSingleQuotes": "false"}


def _top_level(document: str) -> Column:
    """Keys and raw values of the document; NULL unless it is exactly one JSON object."""
    # Inside a list, text after the object no longer goes unnoticed.
    single = F.json_array_length(F.concat(F.lit("["), F.col(document), F.lit("]"))) == 1
    return F.when(single, F.from_json(document, "map<string,string>", _STRICT_JSON))


def parse_briefs(df: DataFrame, document: str = "document") -> DataFrame:
    """Adds the typed ``brief``; NULL where the text is not a JSON object."""
    brief = F.from_json(document, BRIEF_SCHEMA, _STRICT_JSON)
    return df.withColumn("brief", F.when(_top_level(document).isNotNull(), brief))


def validate_briefs(df: DataFrame, document: str = "document") -> DataFrame:
    """Adds ``is_valid``, the first broken rule as ``error``, and its ``error_detail``.

    Rules in order: JSON object, required keys (present, even if null), status, number of
    findings, of actions, of risks. A list that is no list breaks the rule on its size.
    """
    df = df.withColumn("_top", _top_level(document))
    keys = F.map_keys("_top")
    missing = F.sort_array(F.array_except(F.array(*[F.lit(k) for k in REQUIRED_KEYS]), keys))
    status = F.element_at("_top", F.lit("status"))

    def size(key: str) -> Column:
        return F.coalesce(F.json_array_length(F.element_at("_top", F.lit(key))), F.lit(-1))

    rules = [
        ("malformed_json", F.col("_top").isNull(), F.lit(None).cast("string")),
        ("missing_keys", F.size(missing) > 0, F.concat_ws(", ", missing)),
        ("invalid_status", ~F.coalesce(status.isin(STATUSES), F.lit(False)), status),
        ("findings_count", size("findings") != FINDINGS, size("findings").cast("string")),
        ("actions_count", size("actions") != ACTIONS, size("actions").cast("string")),
        ("risks_count", ~size("risks").between(MIN_RISKS, MAX_RISKS), size("risks").cast("string")),
    ]
    error = detail = None
    for name, broken, why in rules:
        error = F.when(broken, name) if error is None else error.when(broken, name)
        detail = F.when(broken, why) if detail is None else detail.when(broken, why)
    return (
        df.withColumns({"error": error, "error_detail": detail})
        .withColumn("is_valid", F.col("error").isNull())
        .drop("_top")
    )


def broken_paths(df: DataFrame, document: str = "document") -> DataFrame:
    """Adds ``broken``: every rule of ``BRIEF_SHAPE`` that a document breaks, as ``path: what``.

    Text that is no JSON, or repeats a key, breaks the rule on the whole document.
    """
    return df.withColumn("broken", broken_rules(F.try_parse_json(document), BRIEF_SHAPE))


def validate_briefs_strictly(df: DataFrame, document: str = "document") -> DataFrame:
    """``validate_briefs`` plus ``is_strict``: exact nested keys and types, nothing extra.

    Priorities must be the whole numbers 1 to 3. Repeated keys are not accepted.
    """
    strict = F.col("is_valid") & (F.size("broken") == 0)
    return broken_paths(validate_briefs(df, document), document).withColumn("is_strict", strict).drop("broken")


def split_briefs(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected documents."""
    return validated.where("is_valid"), validated.where("NOT is_valid")


def actions_by_priority(actions: Column) -> Column:
    """Actions in order of priority; equal ones keep their order.

    Priorities are kept as they were written, and ordered by the number they hold: 1.5 comes
    between 1 and 2. Those without one, or with text that is no number, come last.
    """

    def rank(action: Column) -> Column:
        return F.coalesce(to_number(action["priority"]), F.lit(float(LAST_PRIORITY)))

    return F.array_sort(actions, lambda left, right: F.signum(rank(left) - rank(right)).cast("int"))


def render_markdown(df: DataFrame, status: str, audience: str, context: str) -> DataFrame:
    """Adds ``markdown``, built from ``brief`` and the named columns.

    The status is passed in because it comes from the rule, not from the document.
    """

    def text(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit(""))

    def lines(items: Column, render) -> Column:
        return F.transform(F.coalesce(items, F.array()), render)

    brief = F.col("brief")
    findings = lines(
        brief["findings"],
        lambda f: F.concat(F.lit("- **"), text(f["number"]), F.lit(" — "), text(f["label"]), F.lit(":** "), text(f["detail"])),
    )
    risks = lines(brief["risks"], lambda r: F.concat(F.lit("- "), text(r)))
    actions = lines(
        actions_by_priority(brief["actions"]),
        lambda a: F.concat(
            text(a["priority"]), F.lit(". **"), text(a["action"]), F.lit("**\n   - Reason: "), text(a["reason"]),
            F.lit("\n   - Expected impact: "), text(a["expected_impact"]),
        ),
    )

    def block(*parts: Column | str) -> Column:
        return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    whole = F.concat(
        block(F.concat(F.lit(TITLE), text(F.col(context))), ""),
        block(F.concat(F.lit("**Audience:** "), text(F.col(audience)))),
        block(F.concat(F.lit("**Status:** "), text(F.col(status))), ""),
        block("## Conclusion", text(brief["headline"]), ""),
        block("## Summary", text(brief["summary"]), ""),
        block("## Findings"), findings,
        block("", "## Risks"), risks,
        block("", "## Prioritised Actions"), actions,
        block("", "## Caveat", F.coalesce(brief["caveat"], F.lit(DEFAULT_CAVEAT))),
    )
    return df.withColumn("markdown", F.when(brief.isNotNull(), F.array_join(whole, "\n")))
