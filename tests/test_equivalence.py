"""Expressions that are the same, that aren't, and that nobody can tell."""

import time

import pytest

from gradloom.functions import answers as A
from gradloom.functions import equivalence as E

SAME = [("1/2","0.5"), ("x+1","1+x"), (r"\frac{1}{2}",".5"), (r"\frac12","1/2"), (r"(x+1)^2","x^2+2x+1"), (r"\sqrt{8}",r"2\sqrt2"), (r"\frac{1}{\sqrt{2}}",r"\frac{\sqrt{2}}{2}"), (r"1\frac{1}{2}","1.5"), ("50\\%","0.5"), (r"\frac{x^2-4}{x-2}","x+2"), ("(1,1/2)","(1, 0.5)"), ("1,2","2,1"), (r"\{1,2\}","2, 1"), ("[0,1)","[0,1)"), (r"2\pi r",r"2r\pi"), ("x=5","5"), ("1,234","1234"), ("2^{10}","1024"), (r"\sqrt[3]{54}",r"3\sqrt[3]{2}"), (r"\sin(x)^2+\cos(x)^2","1"), (r"\log 100","2"), (r"\sqrt{x^2+2x+1}",r"\sqrt{(x+1)^2}"), ("5!","120"), (r"x^{-1}",r"\frac1x"), ("3 \\text{ cm}","3"), (r"30^\circ","30"), (r"-\frac{1}{2}","-0.5"), (r"a/b/c",r"\frac{a}{bc}")]
DIFFERENT = [("x+1","x+2"), ("1/3","0.333"), ("(1,2)","(2,1)"), ("[0,1]","[0,1)"), (r"\sqrt{2}","1.41421356"), ("x","y"), ("1,2","1,3")]
UNDECIDED = [(r"\frac{1}{","1"), ("x+","x"), ("","1"), (None,"1"), ("1/0","1"), ("2x)","2x"), ("a"*500,"a"), (r"1 \pm 2","3"), ("hello: world","x"), ("(x+1)^{30}(y+1)^{30}(z+1)^{30}","1")]


@pytest.mark.parametrize("pairs, want", [(SAME, True), (DIFFERENT, False), (UNDECIDED[:-1], None)])
def test_pairs(pairs, want):
    for a, b in pairs:
        assert E.same_expression(a, b) is want and E.same_expression(b, a) is want, (a, b)


def test_more_pairs():
    assert E.same_expression(r"\sin^2 x", r"(\sin x)^2") and not E.same_expression("red", "der") and E.same_expression("xy", "yx")
    assert E.same_expression(r"\frac{3}{\sqrt{3}}", r"\sqrt{3}") and E.same_expression("2^{1/2}", r"\sqrt2") and not E.same_expression(r"\infty", "5")


def test_work_is_bounded():
    for text in ("(x+1)^{30}(y+1)^{30}(z+1)^{30}", "9" * 399, "(" * 390, r"\sqrt" * 70, "x^{30}^{30}^{30}", "1/" * 199 + "7", "30!" * 90, "-" * 399 + "1", r"\sqrt{999999999989}"):
        began = time.perf_counter()
        E.same_expression(text, text + "+1")
        assert time.perf_counter() - began < 2, text


def test_scores_with_verification(spark):
    rows = spark.createDataFrame([("Final Answer: x+1", "1+x", "stop"), ("Final Answer: 0.5", "1/2", "stop"), ("Final Answer: 3", "4", "stop"), ("", "4", "stop"), ("Final Answer: 3", "3", "stop"), ("Final Answer: \\frac{1}{", "1", None)], "completion string, gold string, finish_reason string")
    plain = [r.is_correct for r in A.scored(rows).collect()]
    assert plain == [False, False, False, False, True, False]
    assert [r.is_correct for r in A.scored(rows, verify=E.equivalent).collect()] == [True, True, False, False, True, False]
