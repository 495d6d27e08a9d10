"""Boxes and lists of any depth against a plain scan."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gradloom.functions import answers as A
from gradloom.functions import brackets as B
from gradloom.functions import text as X


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_boxes(text):
    out, at = [], 0
    while (at := text.find("\\boxed", at)) >= 0:
        at += 6
        p = at + len(text[at:]) - len(text[at:].lstrip())
        level, close = 0, None
        for i in range(p, len(text)) if text[p : p + 1] == "{" else ():
            level += {"{": 1, "}": -1}.get(text[i], 0)
            if level == 0:
                close = i
                break
        if close is not None:
            out.append(text[p + 1 : close].strip())
            at = close + 1
        elif m := re.match(B.BARE, text[p:]):
            out.append(m[0].strip().rstrip(".,;:!?"))
            at = p + m.end()
        else:
            at = p + 1
    return [x for x in out if x]


def nested(depth, inside="7"):
    return "\\boxed{" + "f{" * depth + inside + "}" * depth + "}"


BOXED = [nested(d) for d in (0, 4, 5, 6, 7, 50)] + [
    "a " + nested(9) + " b \\boxed{2} \\boxed x.", "{" * 8 + "\\boxed{1}", "\\boxed{1" + "{" * 9, "\\boxed{" * 7 + "3" + "}" * 4, "\\boxed  {a}" + "}{" * 9, "\\boxed{}" + "{}" * 7, "\\boxed \\boxed{3}" + "{}" * 6,
    "\\boxed\\frac{1}{2}, then " + "{}" * 6, "\\boxed(1, 2) [" + "{x}" * 7, "}" * 9 + "\\boxed{4{5}}" + "{" * 9, "\\boxed", "no box " + "{" * 9, "é {{{{{{ \\boxed{日本}", "\\boxed{ " + "{a}" * 6 + " } \\boxed{b}",
]


def test_any_depth(spark):
    assert apply(spark, A.boxes, BOXED) == [plain_boxes(t) for t in BOXED]


def test_random_boxes(spark):
    rng = random.Random(4)
    parts = ["\\boxed", "\\boxed{", "{", "}", "}", " ", "1", "x+2", "\\frac{1}{2}", ".", ",", "(a)", "\\text", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert apply(spark, A.boxes, texts) == [plain_boxes(t) for t in texts]
    spans = apply(spark, B.box_spans, texts)  # the fold alone, for shallow texts too
    assert [[s.content for s in x] for x in spans] == [plain_boxes(t) for t in texts]


def test_box_only(spark):
    cases = {nested(9): "f{" * 9 + "7" + "}" * 9, "$" + nested(9) + "$": "f{" * 9 + "7" + "}" * 9, nested(9) + " .": "f{" * 9 + "7" + "}" * 9, nested(9) + " x": None, "x " + nested(9): None, "\\boxed{abc": None, "\\boxed{abc" + "{" * 8: None, "\\boxed 5.": "5", "\\boxed{1}": "1", None: None, "": None}
    assert dict(zip(cases, apply(spark, A.box_only, list(cases)), strict=True)) == cases


def test_cache_keys(spark):
    def plain(text):
        box = re.compile(r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}")
        while m := box.search(text):
            text = text[: m.start()] + m[1] + text[m.end() :]
        return text.lower()

    texts = ["\\boxed{" * d + "5" + "}" * d for d in (0, 1, 4, 5, 9, 50)] + ["\\boxed{a{\\boxed{b{\\boxed{c{d}}}}}}", "\\boxed{a{b{c}}}", "\\boxed{x", None and "", "\\boxed{1}\\boxed{2}"]
    assert apply(spark, X.cache_key, texts) == [plain(t or "") for t in texts]


def test_lists(spark):
    def plain(text):
        depth, out = dict.fromkeys("([{", 0), [""]
        for ch in text:
            if ch in depth:
                depth[ch] += 1
            elif ch in ")]}":
                k = {")": "(", "]": "[", "}": "{"}[ch]
                depth[k] = max(0, depth[k] - 1)
            if ch == "," and not any(depth.values()):
                out.append("")
            else:
                out[-1] += ch
        return out

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab,,()[]{}é ") for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["(" * 60 + "1,2" + ")" * 60 + ",3"]
    assert apply(spark, A.top_level, texts) == [plain(t) for t in texts]


@pytest.mark.parametrize("text", ["x" * 1_000_000 + "{}" * 20_000 + nested(50), "\\boxed{" * 500 + "x" * 1_000_000, ("\\boxed{" + "{" * 9 + "1" + "}" * 10 + " words ") * 300])
def test_long_texts(spark, text):
    began = time.perf_counter()
    assert apply(spark, A.boxes, [text])[0] is not None and apply(spark, A.top_level, [text[-20_000:]])[0]
    assert time.perf_counter() - began < 30
