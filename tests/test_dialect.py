import random
import re

import pytest
from pyspark.sql import functions as F

from leafwright.functions import text
from leafwright.operators import layer1, layer2, layer3
from leafwright.plans import slate
from leafwright.plans.dialect import CODED, DUCK, SPARK, apply, has, hinted, hits, levels, needed, ungrouped
from leafwright.plans.leaves import leaves

PATTERNS = [layer2.TEMPORAL_A, layer2.TEMPORAL_B, layer2.HISTORY_A, layer2.HISTORY_B, layer2.CONDITION_A, layer2.CUE_A, layer2.CUE_B, layer1.CONDITIONAL_CLAUSE, r"\bnegative\b", r"\b([a-z][a-z\s\-]+?)\s+requiring\s+([a-z][a-z\s\-]+)\b", r"(<=|>=|<|>|=)\s*\d", r"a?b", r"^x", r"(no\b|[^a]b)"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_hints_change_no_match(pattern):
    """Patterns with a look ahead find the same places, and each match holds the text that is asked for first."""
    rng, words = random.Random(3), "no within the last 3 days weeks negative nonnegative before requiring a-b x b >= <5 2,000.5 grade 2 history of if only unless 7 % mg/dl study entry".split(" ")
    quick, held = hinted(pattern)
    for _ in range(2000):
        text = rng.choice(["", " ", "x"]) + rng.choice([" ", ""]).join(rng.choices(words, k=rng.randint(0, 9)))
        plain, found = re.search(pattern, text), re.search(quick, text)
        assert (plain and (plain.span(), plain.groups())) == (found and (found.span(), found.groups()))
        assert not plain or held in plain[0]


def test_null_and_missing_texts(spark):
    own = spark.createDataFrame([(None,), ("",), ("a bed requiring rest",), ("a requirement",)], "x string").select("x", F.expr(SPARK.like("x", r"\brequiring\b")).alias("l"), F.expr(SPARK.extract("x", r"(\w+) requiring", 1)).alias("e"), F.size(F.expr(SPARK.among("split(x, ' ')", ("a", "bed")))).alias("n"))
    assert [tuple(r)[1:] for r in own.collect()][1:] == [(False, "", 0), (True, "bed", 2), (False, "", 1)]
    assert tuple(own.where("x is null").first())[:3] == (None, None, None)


def test_rules_are_compiled_projections(spark):
    """No generator between the rules: its code was longer than HotSpot compiles, or was interpreted."""
    plan = slate.queries()["branch_agreement"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate inline" not in plan and spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


ODD = ["", None, " ", "  a\tb  c ", "The dose of 2,000,5 mg", "≤ 3 × ULN", "two x  uln the end", "other", "one–two—3", "a;b;c", ";", "\r\nx\fy", "no (b|c) d", "café 1,2"]


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if "(" in p])
def test_groups_that_are_not_kept_change_no_match(pattern):
    assert re.compile(ungrouped(pattern)).groups == 0
    for x in filter(None, ODD):
        assert bool(re.search(pattern, x)) == bool(re.search(ungrouped(pattern), x))


def test_short_cuts_change_no_text(spark):
    """What passes a text by, or asks for less, comes to what the plain patterns do, which the oracle runs."""
    import duckdb

    own = spark.createDataFrame([(i, x) for i, x in enumerate(ODD)], "i int, x string")
    forms = lambda d: [text.norm(d, "x"), text.clinical(d, "x"), text.numeric_base(d, "x"), text.numeric(d, "x"), d.joined(f"{'list' if d is DUCK else 'array'}_sort({d.words('x', '[^a-z0-9]+', 'length(t) >= 1')})", "|"), hits(d, "x", ("a", "b")), hits(d, "x", ("a", "b", "c", "d", "e"))]
    rows = ", ".join(f"({i}, {'NULL' if x is None else DUCK.text(x)})" for i, x in enumerate(ODD))
    wanted = duckdb.sql(f"SELECT {', '.join(forms(DUCK))} FROM (VALUES {rows}) AS v(i, x) ORDER BY i").fetchall()
    assert [tuple(r) for r in own.orderBy("i").selectExpr(*(f"{e} AS c{n}" for n, e in enumerate(forms(SPARK)))).collect()] == wanted


def test_sets_are_made_only_where_they_are_looked_at(spark):
    own = spark.createDataFrame([("a bed", "in a bed", "x"), ("a bed", "a chair", "x"), ("", "a", "x")], "evidence_text string, clause_text string, item_text string").selectExpr("*", "'' AS low_entity_text", "CAST(NULL AS STRING) AS unit")
    made = apply(own, lambda d: [("low_evidence_text", "lower(evidence_text)")], text.clause_columns, text.token_columns, wanted="ev_clause cl_clause").collect()
    assert [(r.ev_clause, r.cl_clause) for r in made] == [(None, None), (["bed"], ["chair"]), ([], [])]


def test_columns_share_projections(spark):
    """What does not need each other is one projection, as late as it is needed; windows come first. A column reads what its own step made before it."""
    steps = (lambda d: [("a1", "x + 1"), ("a2", "a1 + 1")], lambda d: [("b1", "x + 10")], lambda d: [("c1", "a2 + b1"), ("w1", "count(*) OVER (PARTITION BY x)")], lambda d: [("d1", "c1 + w1"), ("unused", "x")])
    made = needed(steps, "d1")
    assert [[n for n, _ in own] for own in levels(made)] == [["a1", "w1"], ["a2", "b1"], ["c1"], ["d1"]]
    own = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert sorted(r.d1 for r in apply(own, *steps, wanted="d1").collect()) == [16, 16, 17]
    assert apply(own, *steps).columns == ["x", "a1", "a2", "b1", "c1", "w1", "d1", "unused"]


def test_source_words_are_made_once(spark):
    plan = slate.queries()["source_warnings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("patients with") == 1 and plan.count("filter(") == 2


def test_tasks_come_from_the_numbers_of_the_codes(spark):
    """The task by numbers is the one that the text names, also for operators of no category that hold a fragment; no text is searched for it."""
    data, odd = "/root/testdata/sf0.001", "CASE k % 5 WHEN 0 THEN 'a negation' WHEN 1 THEN 'odd duration_marker_missing' WHEN 2 THEN CAST(NULL AS STRING) ELSE operator END"
    own = apply(leaves(spark, data).withColumn("operator", F.expr(odd)), text.columns, *slate.LAYER3, wanted="named_task_a named_task_b said_a said_b")
    rows = own.select("named_task_a", "named_task_b", "said_a", "said_b").collect()
    named = lambda said, default: next((task for task, parts in layer3.RESCUE_TASKS if any(p in said for p in parts)), default)
    assert all((r.named_task_a, r.named_task_b) == (named(r.said_a, "structured_llm_rescue_branch_a"), named(r.said_b, "structured_llm_judge_branch_b")) for r in rows)
    assert len({r.named_task_a for r in rows}) > 2 and any("odd duration_marker_missing" in r.said_a for r in rows)
    plan = slate.queries()["decisions"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "AS said_a" not in plan and "AS said_b" not in plan and "AS codes_1a" not in plan


def test_numbers_hold_what_the_text_names(spark):
    columns = [c for c in CODED if c.startswith("codes")]
    own = apply(leaves(spark, "/root/testdata/sf0.001"), text.columns, *slate.LAYER1, wanted=" ".join(f"{c} bits_{c}" for c in columns))
    for r in own.select(*columns, *(f"bits_{c}" for c in columns)).collect():
        for c in columns:
            assert sum(1 << CODED[c].index(n) for n in r[c].split(";") if n) == r[f"bits_{c}"]


def test_blank_texts(spark):
    own = spark.createDataFrame([(x,) for x in ODD], "x string").selectExpr(f"({text.blank(SPARK, 'x')}) = (trim(regexp_replace(coalesce(x, ''), '[ \\\\t\\\\n\\\\r\\\\f]+', ' ')) = '') AS same")
    assert all(r.same for r in own.collect())


def test_patterns_with_classes_of_unicode(spark):
    r"""Python cannot read ``\p{..}``, so there is no look ahead, and the test is the pattern's own."""
    assert hinted(r"\p{L}[a-z]") == (f"\\p{{L}}[{''.join(map(chr, range(97, 123)))}]", "")
    own = spark.createDataFrame([(x,) for x in ("Ärzte", "١٢", "5 ≤", "≤", "?", "")], "x string")
    tests = [SPARK.like("x", p) for p in (r"\p{L}", r"^\p{Nd}+$", r"[\p{Nd}≤]")]
    got = [tuple(r) for r in own.selectExpr(*(f"{t} AS t{k}" for k, t in enumerate(tests))).collect()]
    assert got == [(True, False, False), (False, True, True), (False, False, True), (False, False, True), (False, False, False), (False, False, False)]
