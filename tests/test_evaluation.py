"""Gold matches, tags, splits, clauses, chains, the judge loop and traces against plain loops."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafwright.operators import clauses, gold, judge, nested, splits, tagging
from leafwright.sources import shared

SIDES = "doc long, span long, a long, b long, label string, side string"


def sides(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = rng.choice([None, *[rng.randrange(60)] * 9])
        side = rng.choice(("gold", "pred"))
        if a is None and side == "gold":
            a = 5
        rows.append((rng.randrange(8), i, a, None if a is None else a + rng.choice((1, 2, 2, 9)), rng.choice("xyz"), side))
    return [*rows, (90, 900, 1, 2, "x", "gold"), (91, 901, 1, 2, "x", "pred")]


def plain_matches(rows, exact, typed):
    out = []
    docs = {r[0] for r in rows if r[5] == "gold"} & {r[0] for r in rows if r[5] == "pred"}
    for d in docs:
        used = set()
        golds = sorted((r for r in rows if r[0] == d and r[5] == "gold"), key=lambda r: r[1])
        for p in sorted((r for r in rows if r[0] == d and r[5] == "pred"), key=lambda r: r[1]):
            best, at = -1, None
            for g in golds:
                if g[1] in used or p[2] is None or typed and g[4] != p[4]:
                    continue
                shared_ = max(0, min(p[3], g[3]) - max(p[2], g[2]))
                if ((p[2], p[3]) == (g[2], g[3]) if exact else shared_ > 0) and shared_ > best:
                    best, at = shared_, g[1]
            if at is not None:
                used.add(at)
                out.append((d, p[1], at))
    return sorted(out)


def test_gold_matches(spark):
    rows = sides(4)
    df = spark.createDataFrame(rows, SIDES)
    got = gold.matches(df).collect()
    scores = {(r.kind, r.label): r for r in gold.scores(df).collect()}
    kept = {r[0] for r in rows if r[5] == "gold"} & {r[0] for r in rows if r[5] == "pred"}
    for kind in gold.KINDS:
        want = plain_matches(rows, kind.startswith("exact"), kind.endswith("typed"))
        assert sorted((r.doc, r.span, r.gold_span) for r in got if r.kind == kind) == want
        n_pred, n_gold = (sum(r[0] in kept and r[5] == s for r in rows) for s in ("pred", "gold"))
        p, q = round(len(want) / n_pred, 4), round(len(want) / n_gold, 4)
        row = scores[kind, "all"]
        assert (row.tp, row.predicted, row.gold, row.precision, row.recall) == (len(want), n_pred, n_gold, p, q)
        assert row.f1 == pytest.approx(round(2 * p * q / (p + q), 4), abs=1e-4)
        for label in "xyz":
            only = [r for r in rows if r[4] == label and r[0] in kept]
            own = plain_matches(only, kind.startswith("exact"), False)
            assert scores[kind, label].tp == len(own)
    none = gold.scores(df.limit(0)).collect()
    assert len(none) == 4 and all(r.tp == 0 and r.precision is None and r.f1 is None for r in none)


def test_entities_and_tags(spark):
    rng = random.Random(8)
    notes, tokens = [], []
    for doc in range(5):
        for k in range(60):
            pieces = [[s := rng.randrange(-3, 900), s + rng.randint(0, 30)] for _ in range(rng.randint(0, 3))]
            notes.append((doc, k, rng.choice(["Drug", "Scope", None, "Lab"]), [*pieces, [1]][: rng.randint(0, 4)], 880))
        at = 0
        while at < 880:
            size = rng.randint(1, 12)
            tokens.append((doc, len(tokens), at, at + size))
            at += size + rng.randint(0, 2)
        tokens.append((doc, len(tokens), 0, 0))
    df = spark.createDataFrame(notes, "doc long, span long, label string, offsets array<array<long>>, n_chars long")
    raw = []
    for doc, k, label, offsets, n in notes:
        valid = [o for o in offsets if len(o) == 2 and 0 <= o[0] < o[1] <= n]
        if label != "Scope" and valid:
            raw.append((doc, min(o[0] for o in valid), max(o[1] for o in valid), k, label or "Other"))
    flat = {d: [] for d in range(5)}
    for doc, a, b, k, label in sorted(raw, key=lambda r: (r[0], r[1], -(r[2] - r[1]), r[3])):
        if all(b <= x or a >= y for x, y, *_ in flat[doc]):
            flat[doc].append((a, b, k, label))
    own = tagging.flat_entities(df)
    assert sorted((r.doc, r.a, r.b, r.span, r.label) for r in own.collect()) == sorted((d, *e) for d, es in flat.items() for e in es)
    want = {}
    for doc, pos, a, b in tokens:
        tag = None if a == b == 0 else "O"
        for s, e, _, label in flat[doc]:
            if tag and not (b <= s or a >= e):
                tag = ("B-" if a == s or a >= s and a - s <= 1 else "I-") + label
                break
        want[doc, pos] = tag
    got = tagging.bio_labels(spark.createDataFrame(tokens, "doc long, pos long, a long, b long"), own)
    assert {(r.doc, r.pos): r.tag for r in got.collect()} == want
    names = sorted({e[3] for es in flat.values() for e in es})
    assert [r.tag for r in tagging.label_list(own).orderBy("id").collect()] == ["O", *(p + n for n in names for p in ("B-", "I-"))]


def plain_chunks(tags):
    out, start = set(), None
    for k, tag in enumerate([*tags, "O"]):
        before = tags[k - 1] if k else "O"
        if start is not None and (tag == "O" or tag[0] == "B" or tag[2:] != before[2:]):
            out.add((start, k - 1, before[2:]))
            start = None
        if start is None and tag != "O":
            start = k
    return out


def test_entity_scores_and_correlation(spark):
    rng = random.Random(2)
    names = ["O", "O", "B-a", "I-a", "B-b", "I-b"]
    rows = []
    for doc in range(6):
        truth = [rng.choice(names) for _ in range(80)]
        rows += [(doc, k, t, t if rng.random() < 0.7 else rng.choice(names)) for k, t in enumerate(truth)]
    rows += [(0, 200, None, "B-a")]
    df = spark.createDataFrame(rows, "doc long, pos long, truth string, guess string")
    want, got = ({(d, *c) for d in range(6) for c in plain_chunks([r[s] for r in rows if r[0] == d and r[2]])} for s in (2, 3))
    row = tagging.entity_scores(df).first()
    assert (row.tp, row.predicted, row.gold) == (len(want & got), len(got), len(want))
    assert row.f1 == pytest.approx(2 * row.tp / (len(got) + len(want))) and row.accuracy == pytest.approx(sum(r[2] == r[3] for r in rows if r[2]) / 480)
    t, g = Counter(r[2] for r in rows if r[2]), Counter(r[3] for r in rows if r[2])
    c, s = sum(r[2] == r[3] for r in rows if r[2]), 480
    mcc = (c * s - sum(t[k] * g[k] for k in names[1:])) / math.sqrt((s * s - sum(v * v for v in t.values())) * (s * s - sum(v * v for v in g.values())))
    assert tagging.matthews(df).first().mcc == pytest.approx(mcc)
    same = df.withColumn("truth", F.lit("O")).withColumn("guess", F.lit("O"))
    assert tagging.matthews(same).first().mcc == 0.0 and tagging.entity_scores(df.limit(0)).first().f1 == 0.0


def test_folds_are_balanced_and_keep_groups(spark):
    rng = random.Random(3)
    sizes = [rng.choice((1, 1, 1, 2, 3, 7, 40)) for _ in range(300)] + [500]
    rows = [(f"g{g}",) for g, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string")
    got = splits.group_folds(df, "g", 5, 1).collect()
    assert len(got) == len(sizes) and len({r.g for r in got}) == len(sizes)
    load = Counter()
    for r in got:
        load[r.fold] += r["size"]
    # One after the other, largest first, to the lightest.
    plain = [0] * 5
    for n in sorted(sizes, reverse=True):
        plain[plain.index(min(plain))] += n
    assert sorted(load.values()) == sorted(plain)
    assert {r.g: r.fold for r in splits.group_folds(df, "g", 5, 1).collect()} == {r.g: r.fold for r in got}
    part = splits.group_part(df, "g", 0.1111, 13).collect()
    assert sum(r.chosen for r in part) == math.ceil(301 * 0.1111)
    other = {r.g for r in splits.group_part(df, "g", 0.1111, 14).collect() if r.chosen}
    assert other != {r.g for r in part if r.chosen}


@pytest.mark.parametrize("sizes", [[(1, 1_000_000_007)], [(5, 3), (1, 10**9)], [(100, 1), (3, 7), (1, 2)], []])
def test_dealing_many_groups_at_once(sizes):
    out = splits.dealt(sizes, 7)
    for size, n in sizes:
        ranges = sorted((a, b) for s, _, a, b in out if s == size)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(x[1] == y[0] for x, y in zip(ranges, ranges[1:]))
    load = Counter({f: 0 for f in range(7)})
    for s, f, a, b in out:
        load[f] += s * (b - a)
    assert max(load.values()) - min(load.values()) <= max([s for s, _ in sizes], default=0)


ITEM = [("aspirin 5 mg", "takes aspirin", False, "AND", None, None), ("aspirin 5 mg", "takes aspirin", True, "OR", "AT_LEAST", 2), ("", "no such text", None, None, None, None), ("Patient", "x", False, "AND", None, None), (None, None, None, None, None, None)]


def test_clause_places_chains_and_checks(spark):
    text = "Patient takes aspirin 5 mg or aspirin 5 mg daily"
    rows = [("i1", text, [(e and None, e, n, c, q, v) if False else (t, e, n, c, q, v) for e, t, n, c, q, v in ITEM]), ("i2", None, [("a", "b", False, None, None, None)]), ("i3", text, [])]
    df = spark.createDataFrame(rows, f"item_uid string, item_text string, clauses {clauses.CLAUSE}")
    got = {r.item_uid: r for r in clauses.located(clauses.with_ids(df)).collect()}
    # The second phrase lies behind the first; what is not found ahead is looked for from the start.
    assert [(c.clause_id, c.start, c.end) for c in got["i1"].clauses] == [("C1", 14, 26), ("C2", 30, 42), ("C3", None, None), ("C4", 0, 7), ("C5", None, None)]
    assert [(c.start, c.end) for c in got["i2"].clauses] == [(None, None)] and got["i3"].clauses == []
    chain = {r.item_uid: r.c for r in clauses.with_ids(df).select("item_uid", clauses.logic_chain(F.col("clauses")).alias("c")).collect()}
    assert chain["i1"] == "C1: takes aspirin AND [AT_LEAST 2] NOT(C2: takes aspirin) OR C3: no such text C4: x AND C5: " and chain["i3"] == ""
    assert {r.item_uid: r.error for r in clauses.sanity(df).collect()} == {"i1": "Clause 3 has empty evidence_text.", "i2": "Clause 1 evidence_text is not an exact substring of item_text.", "i3": "No clauses returned."}
    assert clauses.first_quantifier(df).where("item_uid = 'i1'").first().quantifier == ("AT_LEAST", 2)
    bad = clauses.bad_offsets(df, spark.createDataFrame([("i1", 0, 7), ("i1", 5, 5), ("i1", -1, 4), ("i1", 40, 99), ("i1", None, 4), ("zz", 0, 1)], "item_uid string, start int, end int"))
    assert sorted((r.start, r.end) for r in bad.collect()) == [(-1, 4), (5, 5), (40, 99)]


def test_trees_as_text(spark):
    leaf = lambda i, text, op="exists": {"node_type": "criterion", "criterion": {"criterion_id": f"d_{i}", "entity_text": text, "operator": op}}
    group = lambda op, *children, **more: {"node_type": "group", "group_operator": op, "children": list(children)} | more
    tree = group("AND", leaf("C1", "a  b"), group("OR", leaf("C2", "c", "not_exists"), group("NOT", group("AND", leaf("C3", "d"), leaf("C4", "e"))), group_quantifier={"quantifier_type": "AT_LEAST", "value": 2}), group("OR"))
    docs = spark.createDataFrame([("d", json.dumps({"rules_v3_ast": {"inclusion_criteria": tree, "exclusion_criteria": None}})), ("e", json.dumps({"rules_v3_ast": {"exclusion_criteria": leaf("C9", "z")}}))], "document_id string, doc string")
    got = {(r.document_id, r.section): (r.n, r.chain) for r in nested.logic_text(docs).collect()}
    assert got == {("d", "inclusion_criteria"): (5, "(C1: a b AND [AT_LEAST 2] (NOT(C2: c) OR NOT((C3: d AND C4: e))) AND OR())"), ("e", "exclusion_criteria"): (1, "C9: z")}


def test_traces(spark):
    rows = [('[{"token_usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}},{"kind":"x"},{"token_usage":{"prompt_tokens":9}},{"token_usage":{"total_tokens":4,"prompt_tokens":null}},7]',), ("{}",), ("[",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(*judge.token_use("t")).collect()
    assert [tuple(r) for r in got] == [(2, 3, 2, 9), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


PLANS = "plan_id string, criterion_id string, rescue_task_type string, leaf string, context_text string, a_leaf string"
VERDICTS = "plan_id string, candidate_id string, parse_status string, parse_error string, average_score double, scores map<string,double>, critical_errors array<string>"
REPAIRS = "plan_id string, attempt int, abstain boolean, leaf string"


def recorded(seed, n):
    rng = random.Random(seed)
    plans, verdicts, repairs = [], [], []
    for k in range(n):
        p = f"p{k}"
        entity = rng.choice(["aspirin", "aspirin", "aspirin", "unknown drug", ""])
        leaf = {"criterion_id": f"c{k}", "entity_type": "drug", "entity_text": entity, "operator": "exists", "value_type": "null", "value": None, "computability": "computable", "evidence_text": "takes aspirin"}
        plans.append((p, f"c{k}", "", json.dumps(leaf), "the patient takes aspirin daily", "{}"))
        for c in ["B_current", *(f"LLM_candidate_{i}" for i in (1, 2, 3))]:
            if rng.random() < 0.9:
                status = rng.choice(["ok"] * 8 + ["error"])
                verdicts.append((p, c, status, "why", rng.choice([None, 7.0, -1.0, *[round(rng.uniform(2, 5), 2)] * 6]), {"semantic_completeness": 4.0, "non_hallucination": 9.0}, rng.choice([[], [], [" "], ["wrong"]])))
        for i in (1, 2, 3):
            if rng.random() < 0.8:
                new = rng.choice([{"entity_text": "aspirin"}, {"entity_text": "aspirin", "entity_type": "device"}, {"entity_text": "x"}, {"computability": "non_computable"}, [1], None])
                repairs.append((p, i, rng.random() < 0.15, None if new is None else json.dumps(new)))
    return plans, verdicts, repairs


def plain_loop(plans, verdicts, repairs):
    judged = {}
    for p, c, status, why, score, scores, crit in verdicts:
        if status != "ok":
            judged[p, c] = 0.0, ["failed"]
        else:
            mean = sum(max(0.0, min(5.0, scores.get(k, 0.0))) for k in judge.CRITERIA) / 8
            judged[p, c] = mean if score is None else max(0.0, min(5.0, score)), [e for e in crit if e.strip()]
    made = {(p, i): json.loads(leaf) for p, i, abstain, leaf in repairs if not abstain and leaf is not None}

    def valid(leaf):
        e = leaf["entity_text"].strip()
        grounded = bool(e) and (e in leaf["evidence_text"] or e in "the patient takes aspirin daily takes aspirin")
        return grounded and leaf["entity_type"] == "drug" and (leaf["computability"] == "computable" or bool(leaf.get("non_computable_reason")))

    out = {}
    for p, c, _, text, *_ in plans:
        leaf = json.loads(text)
        original, crit = judged.get((p, "B_current"), (0.0, ["missing"]))
        best = "B_current", leaf, original
        used = 0
        if not (original >= 4.5 and not crit):
            for i in (1, 2, 3):
                used = i
                new = made.get((p, i))
                if not isinstance(new, dict):
                    continue
                new = leaf | new
                if not valid(new):
                    continue
                score, crit = judged.get((p, f"LLM_candidate_{i}"), (0.0, ["missing"]))
                if score > best[2] and not crit:
                    best = f"LLM_candidate_{i}", new, score
                if best[0] != "B_current" and best[2] >= 4.0 and best[2] - original >= 0.25:
                    break
        decision = "no_change" if best[0] == "B_current" and original >= 4.5 else "select_candidate" if best[0] != "B_current" and best[2] >= 4.0 and best[2] - original >= 0.25 else "human_review"
        if decision != "human_review" and not valid(best[1]):
            decision = "human_review"
        out[p] = (decision, "none" if decision == "human_review" else best[0], round(original, 6), round(best[2], 6), used, None if decision == "human_review" else best[1])
    return out


def test_judge_loop_and_its_restart(spark, monkeypatch):
    plans, verdicts, repairs = recorded(6, 120)
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((plans, PLANS), (verdicts, VERDICTS), (repairs, REPAIRS))]
    rows = judge.run(*frames, "whole").collect()
    got = {r.plan_id: (r.final_decision, r.selected_source, round(r.original_score, 6), round(r.best_score, 6), r.used, r.selected_leaf and json.loads(r.selected_leaf)) for r in rows}
    want = plain_loop(plans, verdicts, repairs)
    assert got == want and {x[0] for x in want.values()} == {"no_change", "select_candidate", "human_review"} and {x[4] for x in want.values()} == {0, 1, 2, 3}
    # A run that breaks off behind the first attempt goes on from there, and does not judge again.
    wrote = shared.written

    def breaking(df, path=None):
        if path and path.endswith("/2"):
            raise RuntimeError("lost")
        return wrote(df, path)

    monkeypatch.setattr(shared, "written", breaking)
    with pytest.raises(RuntimeError):
        judge.run(*frames, "broken")
    seen = []
    monkeypatch.setattr(shared, "written", lambda df, path=None: (seen.append(path.rpartition("/")[2]), wrote(df, path))[1])
    again = judge.run(*frames, "broken").collect()
    assert seen == ["2", "3"] and sorted(map(str, again)) == sorted(map(str, rows))
