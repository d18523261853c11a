"""Every structural and source code once, beside a clean leaf that has none."""

import pytest

from leafwright.functions import text
from leafwright.operators import layer1
from leafwright.plans.dialect import apply

CLEAN = {
    "criterion_id": "NCT1_inc__item1_C1", "entity_type": "lab", "history_context": None, "entity_text": "serum creatinine", "evidence_text": "serum creatinine < 2 mg/dl",
    "operator": "<", "value_type": "scalar", "value_kind": "number", "value_text": "2", "value_min": None, "value_max": None, "unit": "mg/dl",
    "t_relation": None, "t_value": None, "t_unit": None, "t_anchor": None, "computability": "computable", "non_computable_reason": None,
    "cond_text": None, "exc_text": None, "concept_system": None, "concept_code": None,
}
RANGE = {"operator": "between", "value_type": "range", "value_kind": "range", "value_text": None, "value_min": 1.0, "value_max": 2.0}
EXISTS = {"operator": "exists", "value_type": "null", "value_kind": "null", "value_text": None, "unit": None, "entity_type": "drug", "entity_text": "aspirin", "evidence_text": "use of aspirin"}
TEMPORAL = {"t_relation": "before", "t_value": "3", "t_unit": "day", "t_anchor": "screening"}
STRUCTURAL = {
    "criterion_id_missing": {"criterion_id": None}, "criterion_id_malformed": {"criterion_id": "x"}, "entity_type_invalid_enum": {"entity_type": "device"}, "history_context_invalid_enum": {"history_context": "past"},
    "entity_text_empty": {"entity_text": " "}, "evidence_text_empty": {"evidence_text": None}, "operator_missing": {"operator": None}, "comparison_without_scalar_value": {"value_kind": "null"},
    "equality_without_value": {"operator": "=", "value_kind": "null"}, "pattern_operator_without_scalar_value": {"operator": "contains", "value_kind": "null"}, "between_without_range_value": RANGE | {"value_kind": "number"},
    "range_with_both_bounds_missing": RANGE | {"value_min": None, "value_max": None}, "range_with_missing_bound": RANGE | {"value_min": None}, "range_min_greater_than_max": RANGE | {"value_min": 5.0},
    "list_operator_without_list_value": {"operator": "in"}, "existence_operator_with_non_null_value": EXISTS | {"value_kind": "number", "value_text": "1"}, "comparison_value_is_numeric_string": {"value_kind": "string"},
    "null_value_type_with_non_null_value": {"value_type": "null"}, "scalar_value_type_with_complex_value": {"value_kind": "list"}, "list_value_type_without_list_value": {"value_type": "list"}, "range_value_type_without_dict_value": {"value_type": "range"},
    "temporal_context_missing_relation": TEMPORAL | {"t_relation": None}, "temporal_context_invalid_relation": TEMPORAL | {"t_relation": "near"}, "temporal_context_missing_anchor_event": TEMPORAL | {"t_anchor": None},
    "temporal_context_invalid_anchor_event": TEMPORAL | {"t_anchor": "visit"}, "temporal_context_invalid_unit": TEMPORAL | {"t_unit": "fortnight"}, "temporal_context_missing_value": TEMPORAL | {"t_value": None}, "temporal_context_missing_unit": TEMPORAL | {"t_unit": None},
    "computable_with_non_computable_reason": {"non_computable_reason": "r"}, "non_computable_without_reason": {"computability": "non_computable"}, "computable_with_exception_context": {"exc_text": "x"}, "unit_present_without_value": {"value_type": "null"},
    "operator_invalid_enum": {"operator": "about"}, "value_type_invalid_enum": {"value_type": "many"}, "computability_invalid_enum": {"computability": "maybe"}, "normalized_concept_invalid_system": {"concept_system": "X", "concept_code": "1"}, "normalized_concept_system_without_code": {"concept_system": "LOINC"},
}
SOURCE = {
    "comparison_with_non_quantitative_entity": {"entity_type": "drug", "evidence_text": "serum creatinine < 2", "entity_text": "serum creatinine"}, "comparison_entity_mismatch_from_source": {"entity_text": "bilirubin"},
    "categorical_value_missing": EXISTS | {"evidence_text": "negative aspirin test"}, "temporal_marker_without_temporal_context": EXISTS | {"evidence_text": "aspirin before use"}, "duration_marker_missing_from_temporal_context": EXISTS | {"evidence_text": "aspirin within six months"},
    "critical_qualifier_missing_from_entity": EXISTS | {"evidence_text": "severe aspirin use"}, "requirement_object_inversion": EXISTS | {"evidence_text": "infection requiring aspirin"}, "condition_context_present_without_handling": EXISTS | {"evidence_text": "aspirin unless stopped"},
    "temporal_anchor_mismatch_from_source": EXISTS | TEMPORAL | {"evidence_text": "aspirin at baseline"}, "existence_operator_on_quantitative_phrase": EXISTS | {"entity_type": "lab", "evidence_text": "aspirin level"}, "entity_text_too_generic": EXISTS | {"entity_text": "of"},
}


@pytest.fixture(scope="module")
def found(spark):
    cases = {"clean": {}, "clean_exists": EXISTS, "clean_temporal": TEMPORAL, "clean_range": RANGE} | {f"a:{k}": v for k, v in STRUCTURAL.items()} | {f"c:{k}": v for k, v in SOURCE.items()}
    kinds = {"value_min": "double", "value_max": "double"}
    rows = [tuple((CLEAN | v)[c] for c in CLEAN) + (name,) for name, v in cases.items()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in CLEAN) + ", name string")
    steps = (text.columns, layer1.structural_codes, layer1.source_warnings, layer1.action_hint)
    return {r.name: r for r in apply(df, *steps).collect()}


def test_lists_are_complete():
    assert set(STRUCTURAL) == set(layer1.STRUCTURAL) and len(STRUCTURAL) == 37 and set(SOURCE) == set(layer1.WARNINGS) and len(SOURCE) == 11


def test_clean_leaves_have_no_code(found):
    for name in ("clean", "clean_exists", "clean_range"):
        assert (found[name].codes_1a, found[name].codes_1c, found[name].hint_1a) == ("", "", "no_action")
    assert found["clean_temporal"].codes_1a == ""


def test_each_code(found):
    for name, row in found.items():
        if name[:2] == "a:":
            assert name[2:] in row.codes_1a.split(";"), name
        elif name[:2] == "c:":
            assert name[2:] in row.codes_1c.split(";"), name


def test_hints(found):
    assert found["a:computable_with_exception_context"].hint_1a == "safe_normalization_candidate"
    assert found["a:range_with_missing_bound"].hint_1a == "flag_only"
    assert found["a:range_with_both_bounds_missing"].hint_1a == "conservative_rewrite_candidate"
