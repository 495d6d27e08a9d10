"""Golden cases of answer extraction, grading, storage, sampling and parsing."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradloom.functions import answers as A
from gradloom.functions import text as X
from gradloom.operators import evaluation as E
from gradloom.operators import judging as J
from gradloom.operators import losses as L
from gradloom.operators import preparation as P
from gradloom.operators import sampling as S
from gradloom.operators import tries as T
from gradloom.sources import storage
from gradloom.streaming import evaluator as V


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_boxes(spark):
    said = [r"\boxed{1} and \boxed {\frac{1}{2}}", r"\boxed 42.", r"\boxed{}", r"\boxed{a{b{c{d}}}}", "none", r"\boxed{(1,2)}, \boxed\frac{1}{3}", None, ""]
    assert apply(spark, A.boxes, said) == [["1", r"\frac{1}{2}"], ["42"], [], ["a{b{c{d}}}"], [], ["(1,2)", r"\frac{1}{3}"], None, []]


def test_normalized(spark):
    cases = {"Answer: $1,234$": "1,234", r"\$1,234": "1234", "(B)": "b", r"\text{(C)}": "c", "(A) some words": "a", r"\dfrac12": "frac{1}{2}", "3/4": "frac{3}{4}", r"x \in \{1\}": r"\{1\}", "10, 2, 3": "10,2,3", r"\left( 1, 2 \right)": "(1,2)", "√5": "sqrt{5}", "": "", None: ""}
    got = dict(zip(cases, apply(spark, A.normalized, list(cases)), strict=True))
    assert got == {k: v for k, v in cases.items()}


def test_scalar_core(spark):
    cases = {"x = 5": "5", r"30^\circ": "30", "12 cm": "12", "5 apples": None, "(1,2)": None, "1,2": None, r"\boxed{7}": "7", "a sentence.": None, "": None}
    assert dict(zip(cases, apply(spark, A.scalar_core, list(cases)), strict=True)) == cases


def test_top_level(spark):
    assert apply(spark, A.top_level, ["f(a,b),c", "[1,2],{3,4}", "x", ""]) == [["f(a,b)", "c"], ["[1,2]", "{3,4}"], ["x"], [""]]


def test_gold(spark):
    cases = {"steps\n#### 7\n#### 8": "8", r"so \boxed{3}": "3", "Final Answer: 12.": "12", "a\n**Answer:** $9$": "9", "just text": "just text", "": ""}
    assert dict(zip(cases, apply(spark, A.gold_answer, list(cases)), strict=True)) == cases


TAILS = [
    ("Therefore, the final answer is: $\\boxed{4}$. I hope it is correct.", "4", "standard_single_line", True),
    ("work\nFinal Answer: 12", "12", "standard_single_line", True),
    ("Therefore, the final answer is:\nAnswer: 5", "5", "standard_multi_line", True),
    ("Therefore, the final answer is:\n\\[\n\\boxed{6}\n\\]", "6", "standard_multi_line", True),
    ("text\n1. **Answer: 7**", "7", "legacy_answer_line", False),
    ("Thus, we have \\boxed{8}", "8", "legacy_conclusion_boxed", False),
    ("Answer:\n\\boxed{9}", "9", "legacy_answer_line", False),
    ("Therefore:\n$\\boxed{10}$", "10", "legacy_conclusion_boxed", False),
    ("hm\n\\boxed{11}.", "11", "tail_boxed", False),
    ("Therefore, the final answer is:\n13", "13", "standard_multi_line", True),
    ("Conclusion:\nit is \\boxed{14} then", "14", "legacy_conclusion_boxed", False),
    ("Final Answer:\n15", "15", "standard_multi_line", True),
    ("Therefore, the final answer is:", None, "standard_multi_line", True),
    ("see \\boxed{16} above\nand more words", "16", "tail_boxed", False),
    ("nothing here", None, None, False),
    ("", None, None, False),
    ("see \\boxed{answer}", None, None, False),
    ("\n".join(["\\boxed{17}"] + ["filler"] * 12), None, None, False),
]


def test_tails(spark):
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TAILS)], "i int, completion string")
    got = [(r.tail.answer, r.tail.source, r.tail.standard) for r in A.inspected(rows).orderBy("i").collect()]
    assert got == [t[1:] for t in TAILS]


def test_violations(spark):
    cases = {"": ["empty_completion", "missing_final_answer_line"], "words": ["missing_final_answer_line", "last_line_not_final_answer"], "Final Answer: 1\nFinal Answer: 2": ["multiple_final_answer_lines"], "Final Answer: 1\nFinal Answer: 1": [], "Therefore, the final answer is:": ["missing_final_answer_line", "empty_final_answer"], "Final Answer: 3\n\\boxed{4}": ["multiple_final_answer_lines", "boxed_final_answer_mismatch"]}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, completion string")
    assert [r.violations for r in A.inspected(rows).orderBy("i").collect()] == list(cases.values())


def test_typed_match(spark):
    cases = [("(B)", "b", True), ("x = 1/2", r"\frac12", True), ("(1, 2]", "(1,2]", True), ("(1,2]", "[1,2]", False), ("(1,2)", "(2,1)", False), (r"\{1,2\}", "2, 1", True), ("red", "Red", True), ("red", "blue", False), ("5", "words", False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, l string, r string, want boolean")
    assert [(r.l, r.r, r.typed_match) for r in A.typed_match(rows, "l", "r").orderBy("i").collect()] == cases


def test_membership(spark):
    said = [r"x \in 3", r"a \in b \in c \in d \in e \in f \in 7", "x \u2208 (1, 2] ", r"x \in y \in", r"x \in", "plain", None, ""]
    assert apply(spark, A.membership, said) == ["3", "7", "(1, 2]", r"y \in", r"x \in", "plain", None, ""]


def test_scores_are_typed_or_legacy_matches(spark):
    forms = ["B", "(b)", "3", "3.0", r"\$3,000", "3000", "1,2", "2, 1", "(1,2)", "[1,2)", r"x \in \{2,1\}", r"x = 5 \text{cm}", "5", "90^\\circ", "two words", "Two  words", "$", r"\{b\}"]
    rows = spark.createDataFrame([(f"Final Answer: {a}", b, "stop") for a in forms for b in forms], "completion string, gold string, finish_reason string")
    own = A.scored(rows.withColumn("same", F.lit(7))).select("completion", "gold", "answer", "is_correct", "typed_match", "same").withColumn("legacy", A.legacy_match(F.col("answer"), F.col("gold")))
    found = own.collect()
    assert all(r.is_correct == (r.answer is not None and (r.typed_match or r.legacy)) and r.same == 7 for r in found)
    assert sum(r.is_correct for r in found) > len(forms)


def test_scores(spark):
    cases = [("Final Answer: \\boxed{4}", "4", "stop", 1.2), ("Final Answer: 4", "4", "stop", 1.15), ("so \\boxed{4}", "4", None, 1.0), ("so \\boxed{5}", "4", "stop", 0.0), ("no", "4", "length", -0.2), ("Final Answer: 5", "4", "length", 0.1), ("", "4", "stop", 0.0)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, completion string, gold string, finish_reason string, want double")
    for r in A.scored(rows).orderBy("i").collect():
        assert r.total_reward == pytest.approx(r.want), r.completion
        assert r.is_correct == (r.total_reward > 0.5)


def test_text(spark):
    assert apply(spark, X.strip, ["  a \n", "\x1c", "b"]) == ["a", "", "b"]
    assert apply(spark, X.slug, ["MATH-500/test", "--", None]) == ["math_500_test", "eval", "eval"]
    assert apply(spark, X.verdict, ["No... YES!", "nope", None]) == [True, None, None]
    assert apply(spark, lambda c: X.render("{{{a}}} {b} {c}", {"a": c, "b": F.lit("$1")}), ["x", None]) == ["{x} $1 {c}", "{None} $1 {c}"]
    assert apply(spark, lambda c: F.to_json(X.json_object(c)), ['{"a": 1}', '```json\n{"b": [1]}\n``` x', 'say {"c": {}} end', "[1]", "{bad", None]) == ['{"a":1}', '{"b":[1]}', '{"c":{}}', None, None, None]
    assert apply(spark, lambda c: J.judge_response(c)["is_correct"], ['{"is_correct": true}', '{"is_correct": "false"}', "{}", "x"]) == [True, None, None, None]
    assert apply(spark, P.sanitized, ["$ 5$", "5$", "a  b", r"\$5", ""]) == ["5", "5", "a b", "$5", ""]


def test_parsing(spark):
    assert apply(spark, X.parse_bool, [" Yes", "off", None]) == [True, False, None]
    with pytest.raises(Exception, match="no boolean"):
        apply(spark, X.parse_bool, ["maybe"])
    assert apply(spark, X.int_list, ["1, 2,,3", "", None]) == [[1, 2, 3], [], []]
    assert apply(spark, lambda c: X.combined(F.split(c, ";")), ["a; ;b", " "]) == ["a, b", None]
    kept = apply(spark, lambda c: F.array_sort(F.map_keys(X.metric_values(c))), ['{"a": true, "b": 1.5, "c": "x", "d": null, "e": [1], "f": {}}'])
    assert kept == [["a", "b", "c", "d"]]
    labels = apply(spark, lambda c: A.parse_label(c, F.array(F.lit("empty")), enforce=True), ["7", ""])
    assert labels == ["<invalid_format: empty> 7", "<invalid_format: empty> <unparsed>"]
    assert apply(spark, lambda c: T.with_end(F.split(c, " "), F.lit("<e>")), ["a b", "a <e>"]) == [["a", "b", "<e>"], ["a", "<e>"]]
    schema = spark.createDataFrame([], "a int, b string").schema
    assert [tuple(r) for r in P.conform(spark.createDataFrame([("7", 1), ("x", 2)], "a string, z int"), schema).collect()] == [(7, None), (None, None)]


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    storage.write_table(rows, f"{tmp_path}/d/data/train-0.parquet")
    assert storage.load_dataset(spark, f"{tmp_path}/d").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        storage.write_table(rows, f"{tmp_path}/d/data/train-0.parquet")
    with pytest.raises(FileNotFoundError):
        storage.load_dataset(spark, f"{tmp_path}/none")
    (tmp_path / "x.jsonl").write_text('﻿{"a": 1, "b": "x"}\n\n{bad\n{"a": 2}\n')
    assert [tuple(r) for r in storage.read_jsonl(spark, f"{tmp_path}/x.jsonl", "a int, b string").collect()] == [(1, "x"), (2, None)]
    assert storage.read_jsonl(spark, f"{tmp_path}/no.jsonl", "a int").count() == 0
    (tmp_path / "metrics").mkdir()
    for i in (20, 3, 100):
        (tmp_path / "metrics" / f"eval_step_{i}_summary.json").write_text("{}")
    assert [r.step for r in storage.step_files(spark, str(tmp_path)).collect()] == [3, 20, 100]
    storage.write_summary(rows.limit(1), f"{tmp_path}/s.json")
    storage.write_summary(rows.limit(1), f"{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1, "b": "é"}
    storage.write_csv(rows.withColumn("0", F.lit(1)), f"{tmp_path}/c", ["b", "a"])
    assert spark.read.option("header", "true").csv(f"{tmp_path}/c").columns == ["b", "a", "0"]
    assert storage.write_once(spark, f"{tmp_path}/once", lambda: rows).count() == storage.write_once(spark, f"{tmp_path}/once", None).count() == 2


def test_sampling(spark):
    pool = spark.range(10).withColumnRenamed("id", "row_id")
    got = S.sampled(pool, 25, 3, 0).orderBy("place").collect()
    ids = [r.row_id for r in got]
    assert sorted(ids[:10]) == list(range(10)) == sorted(ids[10:20]) and ids[:10] != ids[10:20] and len(ids) == 25
    with pytest.raises(ValueError, match="expected 4"):
        S.validated_stages([{"name": "a", "start": 1, "end": 3, "weights": {"x:y": 1}}, {"name": "b", "start": 5, "end": 9, "weights": {"x:y": 1}}], 9)
    with pytest.raises(Exception, match="source:group"):
        spark.createDataFrame([("nokey",)], "k string").select(S.parsed_group_key(F.col("k"))).collect()


def test_small_cases(spark):
    with pytest.raises(ValueError):
        L.variant("rloo")
    empty = spark.createDataFrame([], "question_id long, reward double, rollout_index int")
    assert E.pass_at_1(empty).first().accuracy == 0.0 and T.group_advantage(empty).count() == 0
    one = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 0.0)], "question_id long, reward double")
    assert sorted(round(r.advantage, 6) for r in T.group_advantage(one).collect()) == [-1.0, 1.0]
    runs = spark.createDataFrame([("d", 1, None), ("d", 2, 0.5), ("d", 3, 0.5)], "k string, run_index int, accuracy double")
    r = E.best_worst_run(runs, ("k",)).first()
    assert (r.best_run, r.worst_run, r.latest_run) == (2, 2, 3)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, "d", "c", math.sin(s * 7 + i), 1.0) for s in range(4) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "step int, run_index int, dataset_key string, checkpoint string, accuracy double, eval_seconds double").withColumn("ts", F.current_timestamp())
    for i in (0, 1, 0):  # a part arrives twice
        df.where(F.col("run_index") % 2 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        V.evaluate(V.run_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/log", most_repeats=4).awaitTermination()
    want = V.summaries(df.where("run_index <= 4"))
    rounded = lambda d: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert rounded(V.current(spark, f"{tmp_path}/out").select(want.columns)) == rounded(want)
    assert spark.read.parquet(f"{tmp_path}/out/skipped").where("skipped = 'repeats'").count() == 4


def test_control(spark):
    runs = spark.createDataFrame([(1, 1), (5, 1), (5, 9)], "step int, run_index int")
    reasons = lambda *rows: [r.skipped for r in V.obeyed(runs, spark.createDataFrame(rows, V.CONTROL), 5).orderBy("step", "run_index").collect()]
    assert reasons() == [None, None, "repeats"]
    assert reasons((True, 1, 9, 0.0, ""), (False, 2, 3, 0.0, "")) == ["superseded", None, "repeats"]
    assert reasons((False, 1, 0, 0.0, ""), (True, 2, 0, 0.0, "")) == ["stopped"] * 3
    assert [r.skipped for r in V.obeyed(runs, None, 5).orderBy("step", "run_index").collect()] == [None, None, "repeats"]


def test_trie_of_deep_sequences(spark):
    """Node statistics of long and branching sequences against prefixes written out."""
    rng = random.Random(2)
    long = [rng.choice("ab") for _ in range(3000)]
    rows = [("q", i, long[: 2000 + i] + [rng.choice("abc") for _ in range(rng.randint(0, 40))], i % 2 == 0, 1.0) for i in range(6)] + [("r", 1, ["a"], True, 1.0), ("r", 2, ["a", "b"], False, 1.0)]
    nodes = T.node_stats(spark.createDataFrame(rows, "question_id string, rollout_index int, tokens array<string>, success boolean, weight double"))
    want = Counter()
    for q, _, tokens, success, _ in rows:
        for d in range(len(tokens) + 1):
            want[q, d, tuple(tokens[:d])] += 1
    assert Counter((r.question_id, r.depth, r.visits) for r in nodes.collect()) == Counter((q, d, n) for (q, d, _), n in want.items())


def test_response_examples(spark):
    rows = [("q", 1, d, d != 1, 3) for d in range(4)] + [("q", 2, 0, True, None)]
    tokens = spark.createDataFrame(rows, "question_id string, rollout_index int, depth int, valid boolean, n_logprobs int")
    of = lambda most: sorted(tuple(r)[1:] for r in T.response_examples(tokens, most).collect())
    assert of(None) == [(1, [1, 0, 1, 1], False), (2, [1], False)] and of(3) == [(1, [1, 0, 1], True), (2, [1], False)]


def test_sampling_goes_through_the_pool_again(spark):
    pool = spark.range(7).withColumnRenamed("id", "row_id")
    got = S.sampled(pool, 17, 3, 1).orderBy("place").collect()
    assert [r.place for r in got] == list(range(17)) and [r["repeat"] for r in got] == [0] * 7 + [1] * 7 + [2] * 3
    assert all(len({r.row_id for r in got[a:b]}) == b - a for a, b in ((0, 7), (7, 14), (14, 17)))
    assert len(S.sampled(pool, 10**6, 3, 1)._jdf.queryExecution().logical().toString()) < 20_000


def test_artifacts(spark):
    from gradloom.operators import artifacts as R

    files = spark.createDataFrame([(p,) for p in ("/e/a/checkpoint-3/model.safetensors", "/e/a/checkpoint-3/model.safetensors.index.json", "/e/a/checkpoint-20/x.bin", "/e/a/checkpoints/iter_7_actor/pytorch_model-1.bin", "/e/a/checkpoints/anchor_ema/model.safetensors", "/e/b/final/pytorch_model.bin")], "path string")
    rows = [(r.experiment, r.name, r.type, r.step) for r in R.checkpoints(files, most=9).collect()]
    assert rows == [("/e/a", "anchor_ema", "anchor_ema", None), ("/e/a", "checkpoint-3", "trainer_checkpoint", 3), ("/e/a", "iter_7_actor", "iter_actor", 7), ("/e/b", "final", "weight_dir", None)]
    assert R.checkpoints(files, anchor=False).count() == 3 and R.checkpoints(files.limit(0)).count() == 0

    rows = spark.createDataFrame([(1, ["a", "b"]), (2, [None, "", "b"]), (3, ["z"]), (4, [])], "k int, c array<string>")
    there = spark.createDataFrame([("b",), ("b",), ("",)], "path string")
    assert {r.k: r.found for r in R.first_existing(rows, "c", there).collect()} == {1: "b", 2: "b", 3: None, 4: None}

    prompts = spark.createDataFrame([(1,), (2,)], "prompt_id long")
    made = spark.createDataFrame([(1, 1, "y", "stop"), (1, 0, "x", None), (9, 0, "w", "stop")], "prompt_id long, choice_idx int, text string, finish_reason string")
    assert {r.prompt_id: [c.text for c in r.choices] for r in R.with_generations(prompts, made).collect()} == {1: ["x", "y"], 2: []}

    four = spark.range(4).withColumnRenamed("id", "position")
    golds = lambda *a: spark.createDataFrame(list(enumerate(a)), "position long, answer string")
    assert [r.answer for r in R.with_answers(four, golds("p", "q")).orderBy("position").collect()] == ["p", "p", "q", "q"]
    assert [r.answer for r in R.with_answers(four, golds()).collect()] == [None] * 4
    with pytest.raises(ValueError, match="4 completions for 3"):
        R.with_answers(four, golds("p", "q", "r"))

    assert sorted(r.position for r in R.without_rows(four, [1, 1, 3]).collect()) == [0, 2] and R.without_rows(four, []).count() == 4
    with pytest.raises(ValueError, match="out of range"):
        R.without_rows(four, [4])


def test_settings():
    from gradloom.settings import Teacher, merged

    assert merged({"a": 1, "n": {"x": 1, "y": 2}}, {"a": 2, "b": 3, "n": {"x": 5}}, {"a": None}) == {"a": 2, "b": 3, "n": {"x": 5, "y": 2}}
    assert merged({"a": 1}, {"b": 2}, known_only=True) == {"a": 1}
    with pytest.raises(ValueError, match="missing settings: c"):
        merged({}, {"a": 1}, required=("a", "c"))
    given = dict(beta=0.1, reward_clip_min=-5, reward_clip_max=5, min_success_count=2, frontier_min_success_count=1, frontier_min_visit_count=1, include_frontier_negative_samples=True, negative_weight_mode="uniform", other=1)
    made = Teacher.of(given)
    assert made.deduplicate_rollouts and made.append_eos_to_response and not Teacher.of(given | {"deduplicate_rollouts": False}).deduplicate_rollouts


def test_token_count_with_a_tokenizer(spark):
    df = spark.createDataFrame([("ab c",), ("",), (None,)], "t string")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    got = df.select(X.token_count(F.col("t")).alias("words"), X.token_count(F.col("t"), letters).alias("letters")).collect()
    assert [tuple(r) for r in got] == [(2, 4), (0, 0), (0, 0)]


def test_short_logs_count_as_missing(spark):
    from gradloom.operators.losses import old_logprobs

    df = spark.createDataFrame([([0.1, 0.2, 0.3], [1, 2]), ([0.1], [1, 2]), (None, [1]), (None, []), ([], [])], "logged array<double>, response array<int>")
    assert [r[0] for r in df.select(old_logprobs(F.col("logged"), F.col("response"))).collect()] == [[0.1, 0.2], None, None, None, []]
