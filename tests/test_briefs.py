import json

from pyspark.sql import functions as F

from vendastat.plans import briefs


def brief(**changes):
    doc = {
        "status": "Stable",
        "headline": "Sales rose",
        "summary": "More orders.",
        "findings": [{"label": f"l{i}", "number": str(i), "detail": f"d{i}"} for i in range(3)],
        "risks": ["one"],
        "actions": [
            {"priority": p, "action": f"do {p}", "reason": f"r{p}", "expected_impact": f"e{p}"} for p in (3, 1, 2)
        ],
        "caveat": "Only 2020.",
    }
    doc.update(changes)
    return {k: v for k, v in doc.items() if v != "DROP"}


def check(spark, *documents):
    texts = [d if isinstance(d, str) else json.dumps(d) for d in documents]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, document string")
    rows = briefs.validate_briefs_strictly(df).orderBy("n").collect()
    return [(r["error"], r["error_detail"], r["is_strict"]) for r in rows]


def test_rules_in_order(spark):
    two, four = brief()["findings"][:2], brief()["actions"] + brief()["actions"][:1]
    got = check(
        spark,
        brief(),
        '{"status": "Stable"',
        "[1]",
        "",
        json.dumps(brief()) + " and more",
        json.dumps(brief()).replace('"', "'"),
        brief(caveat="DROP", risks="DROP", status="Bad"),
        brief(status="Bad", findings=two),
        brief(status=None),
        brief(findings=two, actions=four),
        brief(findings="abc"),
        brief(actions=four, risks=[]),
        brief(risks=[]),
        brief(risks=["a", "b", "c"]),
        brief(risks=None),
    )
    assert [g[:2] for g in got] == [
        (None, None),
        ("malformed_json", None),
        ("malformed_json", None),
        ("malformed_json", None),
        ("malformed_json", None),
        ("malformed_json", None),
        ("missing_keys", "caveat, risks"),
        ("invalid_status", "Bad"),
        ("invalid_status", None),
        ("findings_count", "2"),
        ("findings_count", "-1"),
        ("actions_count", "4"),
        ("risks_count", "0"),
        ("risks_count", "3"),
        ("risks_count", "-1"),
    ]
    assert [g[2] for g in got] == [True] + [False] * 14


def test_strict_rules(spark):
    def actions(**first):
        out = brief()["actions"]
        out[0].update(first)
        return out

    findings = brief()["findings"]
    got = check(
        spark,
        brief(caveat=None),
        brief(extra=1),
        brief(actions=actions(priority=4)),
        brief(actions=actions(priority="1")),
        brief(actions=actions(owner="me")),
        brief(findings=[*findings[:2], {"label": "x", "number": "1"}]),
        brief(findings=[*findings[:2], {**findings[2], "number": 5}]),
        brief(risks=["a", 1]),
        brief(headline=5),
    )
    assert got == [(None, None, False)] * 9


def render(spark, doc):
    df = spark.createDataFrame([(json.dumps(doc), "Strong", "Board", "Sales")], "document string, s string, a string, c string")
    return briefs.render_markdown(briefs.parse_briefs(df), "s", "a", "c").first()["markdown"]


def test_markdown(spark):
    assert render(spark, brief()).split("\n") == [
        "# Stakeholder Brief — Sales", "", "**Audience:** Board", "**Status:** Strong", "",
        "## Conclusion", "Sales rose", "", "## Summary", "More orders.", "",
        "## Findings", "- **0 — l0:** d0", "- **1 — l1:** d1", "- **2 — l2:** d2", "",
        "## Risks", "- one", "",
        "## Prioritised Actions",
        "1. **do 1**", "   - Reason: r1", "   - Expected impact: e1",
        "2. **do 2**", "   - Reason: r2", "   - Expected impact: e2",
        "3. **do 3**", "   - Reason: r3", "   - Expected impact: e3", "",
        "## Caveat", "Only 2020.",
    ]


def test_markdown_of_gaps(spark):
    unranked = [{"action": "late"}, {"priority": 2, "action": "soon"}, {"action": "later"}]
    text = render(spark, brief(actions=unranked, caveat="DROP", headline="DROP", findings="DROP"))
    lines = text.split("\n")
    assert [x for x in lines if "**" in x][-3:] == ["2. **soon**", ". **late**", ". **later**"]
    assert lines[-1] == briefs.DEFAULT_CAVEAT
    assert "## Conclusion\n\n\n## Summary" in text and "## Findings\n\n## Risks" in text


def test_priorities_that_are_no_whole_numbers(spark):
    written = [(2, "b"), ("high", "d"), (1.5, "a2"), ("1", "a"), (None, "e"), (3, "c")]
    text = render(spark, brief(actions=[{"priority": p, "action": name} for p, name in written]))
    lines = [x for x in text.split("\n") if ". **" in x]
    assert lines == ["1. **a**", "1.5. **a2**", "2. **b**", "3. **c**", "high. **d**", ". **e**"]


def test_split_and_unreadable_documents(spark):
    df = spark.createDataFrame([(json.dumps(brief()),), ("nothing",), ("[{}]",)], "document string")
    accepted, rejected = briefs.split_briefs(briefs.validate_briefs(df))
    assert (accepted.count(), rejected.count()) == (1, 2)
    named = briefs.parse_briefs(df).withColumns({c: F.lit("x") for c in "sac"})
    texts = [r["markdown"] for r in briefs.render_markdown(named, "s", "a", "c").collect()]
    assert texts[0].startswith(briefs.TITLE) and texts[1] is None and texts[2] is None
