"""Operators of the catalog engine against plain Python and on edge cases."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text, values
from quarrystone.operators import catalog, entities, evaluation, inventory, knowledge_base, retrieval


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f, given, want",
    [
        (text.normalize, "  A  b\n", "a b"),
        (text.normalize, None, ""),
        (text.or_not_specified, " NaN ", "not specified"),
        (text.clean_name, "The ETT_small-dataset (v2)!", "the ett small"),
        (text.clean_name, "Unknown", ""),
        (text.first_integer, "1,234 of 5", 1234),
        (text.first_integer, None, -1),
        (text.clean_url, "['HTTP://A.org/x/?q=1']", "http://a.org/x"),
        (text.standard_name, "google/Traffic (Subset)-small", "Traffic"),
        (text.standard_name, "UCR/ab", "UCR/ab"),
        (text.tidy_url, "[a](https://b.org/c). ", "https://b.org/c"),
        (text.hyperlink_urls, '=HYPERLINK("http://a","x") & HYPERLINK("http://b","y")', "http://a, http://b"),
        (text.guard_formula, "=1+1", "'=1+1"),
        (text.strip_fences, "```json\n{}\n```", "{}"),
        (text.arxiv_id, "see https://arxiv.org/abs/2106.13008v1", "2106.13008"),
        (text.frequency, "sampled every 15 Minutes", "15 minutes"),
        (text.frequency, "nothing", None),
        (text.sheet_id, "https://docs.x/d/abc-1/edit", "abc-1"),
        (text.capitalized, "aBC", "Abc"),
    ],
)
def test_text_functions(spark, f, given, want):
    assert one(spark, f(F.lit(given).cast("string"))) == want


def test_in_scope_and_classes(spark):
    rows = [("ETTh1", True, "Dataset"), ("run.csv", False, None), ("MNIST-1D", False, None), ("", False, None), ("Monash archive", True, "Collection"), ("PeMS", True, "Collection"), ("NOAA", True, "Provider"), ("pems-bay x", True, "Dataset")]
    d = spark.createDataFrame(rows, "n string, ok boolean, type string")
    for r in d.select("ok", "type", text.in_scope("n").alias("a"), catalog.entity_type("n").alias("b")).collect():
        assert (r["a"], r["b"]) == (r["ok"], r["type"])


@pytest.mark.parametrize(
    "a, b, want",
    [("x", "x", False), ("abc", "abd", True), ("series 1 of m", "series 1 of m", False), ("long name 1", "long name 2", True), ("traffic hourly", "traffic daily", True), ("electricity load", "electricity loads", False)],
)
def test_distinct_variants(spark, a, b, want):
    assert one(spark, text.distinct_variants(F.lit(a), F.lit(b))) is want


def test_values(spark):
    assert one(spark, values.rescaled(F.lit("85"))) == 0.85 and one(spark, values.rescaled(F.lit("7"))) == 0.7 and one(spark, values.rescaled(F.lit("nan"))) == 0.0
    assert one(spark, values.plausibility(F.lit("Total Variables"), F.lit("0"))) == "Below Min"
    assert one(spark, values.plausibility(F.lit("Variables per Location"), F.lit("1 million"))) == "Above Max"
    assert one(spark, values.plausibility(F.lit("Domain"), F.lit("0"))) == ""
    assert one(spark, values.vetoed(F.lit("Total Variables"), F.lit("0"), F.lit(0.9)))["value"] == "[implausible]"


@pytest.mark.parametrize(
    "given, want",
    [("", []), ('{"a": [1, 2,],}', [1, 2]), ('x {"a": 1} y', {"a": 1}), ("```json\n{\"k\": 2}\n```", {"k": 2}), ("[1\n thought: [2]", []), ("no json", []), (None, [])],
)
def test_recover_json(given, want):
    assert values.recover_json(given) == want


def test_answers(spark):
    answer = lambda text, field="": tuple(one(spark, values.parsed_answer(F.lit(text), F.lit(field))))
    assert answer('{"value": ["a", "b"], "confidence": 90, "rationale": "r"}') == ("a, b", 0.9, "r")
    assert answer('"value": "x", "confidence": 0.4') == ("x", 0.4, "JSON Parse Error")
    assert answer("nothing") == ("[missing]", 0.0, "JSON Parse Error") and answer('{"value": null}') == ("[missing]", 0.0, "JSON Parse Error")
    assert answer('{"value": "go to https://a.b/c, d"}', "Other URL")[0] == "https://a.b/c"
    assert answer('```json\n{"value": "[\'a\']", "confidence": "7",}\n```') == ("a", 0.7, "") and answer('{"value": " a\\nb "}')[0] == "a b"


def test_dimension():
    assert values.dimension("{'Num': 5}", "num") == "5" and values.dimension("{'a': 1}", "zz") == "[extraction_error: dict_returned]" and values.dimension("{a", "x") == "{a"
    assert values.dimension("{'ETT': 1, 'ETTh1': 2}", "ETTh1") == "2" and values.dimension("{'ETT': 1, 'x': 2}", "etth1") == "1"
    assert values.dimension("sizes {'a': 1, 'b': 2, 'c': 3} rows", "b") == "2" and values.dimension("{a}", "x") == "[extraction_error: complex_string]"
    assert values.dimension("1-5", "x") == "1-5" and values.dimension(None) == "" and values.dimension("{'a': 1}") == "[extraction_error: dict_returned]"


def _fold(updates, lock=0.95):
    missing = set(catalog.MISSING_CELL)
    value, conf, taken = "[missing]", 0.0, 0
    for v, c in updates:
        empty = value in missing
        if conf >= lock and not empty:
            continue
        if (empty and v not in missing) or (not empty and c > conf):
            value, conf, taken = v, c, taken + 1
    return value, conf, taken


def test_fold_equals_sequential(spark):
    r = random.Random(1)
    cells = {k: [(r.choice(["[missing]", "a", "b", "Unknown", "unknown"]), r.choice([0.0, 0.5, 0.94, 0.95, 1.0])) for _ in range(r.randint(1, 8))] for k in range(60)}
    rows = [(k, o, v, c) for k, u in cells.items() for o, (v, c) in enumerate(u)]
    r.shuffle(rows)
    got = catalog.fold_updates(spark.createDataFrame(rows, "key int, ord int, value string, confidence double"), ["key"], "ord").collect()
    assert {x["key"]: (x["value"], x["confidence"], x["taken"]) for x in got} == {k: _fold(u) for k, u in cells.items()}


def test_effective_name(spark):
    d = spark.createDataFrame([("unknown", "DS_1", "n/a, Good", "canon"), ("V", None, None, None), ("", None, "", "C"), ("", "", "", "")], "variant string, name string, aliases string, canonical string")
    got = [r["x"] for r in d.select(catalog.effective_name(F.col("variant"), F.col("name"), F.col("canonical"), aliases=F.col("aliases"), at=2).alias("x")).collect()]
    assert got == ["Good", "V", "C", ""]


def test_anchored_jobs_boundary(spark):
    d = spark.createDataFrame([(1, k, s) for k, s in enumerate([0, 14_400, 14_401, 28_801, 28_802])], "u int, o int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["o"]: r["job"] for r in inventory.anchored_jobs(d, "u", "ts", "o").collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


def test_resolve_chains_with_cycle(spark):
    d = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (7, 8), (8, 9), (9, 7), (10, 7), (5, 5)], "dropped long, kept long")
    got = {r["dropped"]: r["root"] for r in knowledge_base.resolve_chains(d).collect()}
    assert got[2] == got[3] == got[4] == 1
    assert got[7] == got[8] == got[9] == got[10] == 7 and 5 not in got


def test_leader_groups_equal_sequential(spark):
    r = random.Random(2)
    n = 60
    match = {(a, b) for b in range(n) for a in range(b) if r.random() < 0.06}
    leaders, want = [], {}
    for b in range(n):
        found = next((a for a in leaders if (a, b) in match), None)
        if found is None:
            leaders.append(b)
        want[b] = b if found is None else found
    d = spark.createDataFrame([(k, k) for k in range(n)], "id long, ord long")
    edges = spark.createDataFrame([(a, b, a, b, "x") for a, b in match], "a_id long, b_id long, a_ord long, b_ord long, reason string")
    assert {x["id"]: x["leader"] for x in entities.leader_groups(d, edges).collect()} == want


def test_pair_reasons(spark):
    names = [
        (1, "Electricity Load Diagrams", "Dataset", "", "", "http://archive.example.org/electricity", ""),
        (2, "electricity load diagrams dataset", "Dataset", "", "", "", ""),
        (3, "Electricity Load Diagrames", "Dataset", "", "", "", ""),
        (4, "electricity load diagrams", "Provider", "", "", "", ""),
        (5, "Something Else", "Dataset", "", "", "http://archive.example.org/electricity/", ""),
        (6, "", "Dataset", "", "", "", ""),
        (7, "dataset", "Dataset", "", "", "", ""),
    ]
    d = spark.createDataFrame(names, "id int, n string, ty string, t string, v string, u string, du string")
    p = entities.prepared(d, "id", F.col("n"), F.col("ty"), F.col("t"), F.col("v"), F.col("u"), F.col("du"), [F.col("id")])
    got = {(r["a_id"], r["b_id"]): (r["reason"], r["matched"]) for r in entities.reason(entities.candidate_pairs(p)).collect()}
    assert got[1, 2] == ("EXACT_NAME", True) and got[1, 3] == ("FUZZY_STRONG", True) and got[1, 4] == ("EXACT_NAME_TYPE_MISMATCH", False)
    assert got[1, 5] == ("EXACT_URL_MATCH_WEAK_NAME", False)
    assert not any(6 in k or 7 in k for k in got)


def test_candidates_hold_all_strong_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 16))).strip() or "q" for _ in range(25)]
    names = base + ["".join(c for k, c in enumerate(b) if k != r.randrange(len(b))) for b in base]
    d = spark.createDataFrame(list(enumerate(names)), "id int, n string")
    none = F.lit("")
    p = entities.prepared(d, "id", F.col("n"), none, none, none, none, none, [F.col("id")])
    clean = {x["id"]: x["clean"] for x in p.collect()}
    pairs = {(x["a_id"], x["b_id"]) for x in entities.candidate_pairs(p).collect()}
    for b in range(len(names)):
        for a in range(b):
            if clean[a] and clean[b] and difflib.SequenceMatcher(None, clean[b], clean[a]).ratio() >= 0.9:
                assert (a, b) in pairs, (clean[a], clean[b])


def test_fusion_rules(spark):
    rows = [
        (1, 1, "http://a", "0.5", "short", "0.2", "x", "0.5"),
        (1, 2, "http://b", "0.9", "longer text", "0.1", "y", "0.4"),
        (1, 3, '=HYPERLINK("http://a", "n")', "0.1", "", "1.0", "z", "1.0"),
        (1, 4, "http://c", "0.1", "tiny", "0.9", "w", "1.0"),
    ]
    d = spark.createDataFrame(rows, "leader int, id int, `Primary URL` string, `Primary URL (C)` string, Description string, `Description (C)` string, Domain string, `Domain (C)` string")
    got = entities.fuse(d.select("id", "leader"), d.drop("leader"), "id", "id", ["Primary URL"], ["Description"], ["Domain"]).first()
    assert got["Primary URL"] == 'http://a & " | Alt: http://b" & " | Alt: http://c"' and got["Primary URL (C)"] == 0.9
    assert got["Description"] == "longer text" and got["Domain"] == "z" and got["Domain (C)"] == 1.0 and got["members"] == 4


def test_upsert_and_ids_on_empty(spark):
    base = spark.createDataFrame([], "k long, v string")
    batch = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert {(r["k"], r["v"]) for r in knowledge_base.upsert(base, batch, ["k"], ["v"]).collect()} == {(1, "a"), (2, None)}
    ids = knowledge_base.new_ids(batch, spark.createDataFrame([], "id string"), "id", "DS_", ["k"]).collect()
    assert {r["id"] for r in ids} == {"DS_001", "DS_002"}


def test_confusion_guards(spark):
    d = spark.createDataFrame([("m", "True Negative")], "model string, status string")
    r = evaluation.confusion(d, ["model"]).first()
    assert (r["precision"], r["recall"], r["f1"], r["hallucination_rate"]) == (0.0, 0.0, 0.0, 0.0)


def test_votes_drop_nulls(spark):
    d = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "x"), ("a", None)], "k string, norm_value string")
    assert [(r["norm_value"], r["votes"], r["total_votes"]) for r in evaluation.consensus(evaluation.jury_vote(d, ["k"]), ["k"]).collect()] == [("x", 2, 3)]


def test_chunks(spark):
    d = spark.createDataFrame([(1, "a b. c d! e f g h i j"), (2, ""), (3, None)], "id int, t string")
    assert [(r["id"], r["chunk"], r["text"]) for r in retrieval.chunks(d, "id", "t", 4).collect()] == [(1, 0, "a b. c d!"), (1, 1, "e f g h i j")]


def test_stall():
    assert inventory.stalled([10, 9, 8, 7]) and not inventory.stalled([10, 5, 4, 3]) and not inventory.stalled([3, 2])
