"""Queries against the oracle database, and invariants of the scores."""

import duckdb
import pytest

from leafwright.operators import layer1
from leafwright.plans import slate
from leafwright.plans.leaves import leaves

DATA = "/root/testdata/sf0.001"
TABLES = "lineitem part orders documents conversations events customer".split()


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return own


def cell(x):
    return f"{x:.9g}" if isinstance(x, float) else str(x)


CHOSEN = "consistency_codes risk_reasons rescue_plan applied_rescue normal_leaves leaves_with_clause before_after scalar_forms merged_spans structural_codes source_warnings policy_b risk_by_operator_category routing_b decisions final_decisions reverified_after_repair extracted_fields token_overlaps item_split tree_paths spans_over_items best_anchor auroc ablation_crosstab and_or_runs suppressed_spans flat_spans greedy_span_match gold_scores gold_matches bio_labels label_ids entity_scores tag_correlation group_folds group_part clause_places clause_sanity logic_chains first_quantifiers clause_audit tree_chains trace_tokens judged_rescue tree_criteria tree_operator_paths tree_any_leaves tree_item_rows schema_errors both_branches assembled_documents applied_trees apply_audit cleaned_spans grounding_rates carried_labels branch_label_shares run_first rescue_plan_b candidate_payloads clause_anchors value_grounding annotation_edges annotated_rows ranking_by_variant layer1_without_policy tolerant_json final_reasons plan_group_summary".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_same_as_sql(spark, db, name):
    got = slate.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    found = db.execute(slate.oracle_sql()[name])
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall())
    assert sorted(names) == columns
    assert sorted(tuple(cell(r[c]) for c in columns) for r in got.collect()) == want


def test_every_query_has_sql_or_a_test():
    assert set(slate.queries()) == set(slate.oracle_sql())


def test_leaf_keys_are_unique_and_codes_varied(spark):
    df = leaves(spark, DATA)
    assert df.count() == df.select("key_id").distinct().count()
    counts = {r.code: r.n for r in slate.queries()["complete_code_counts"](spark, DATA).collect()}
    assert set(counts) == set(layer1.STRUCTURAL) and sum(n > 0 for n in counts.values()) >= 30


def test_scores_are_minima(spark):
    rows = slate.queries()["scores_a"](spark, DATA).collect()
    parts = [c for c in rows[0].asDict() if c.endswith("_support") and c != "leaf_support"]
    assert len(parts) == 8
    assert all(abs(r.leaf_support - min(r[c] for c in parts)) < 1e-6 and 0 <= r.leaf_support <= 1 for r in rows)
    assert len({r.risk_label for r in rows}) >= 2
