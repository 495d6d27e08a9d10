"""Queries of answer extraction and grading (U rows), with SQL built from the rules' patterns for RE2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import equivalence as E
from ..functions import text as X
from ..sources.relations import ANSWERS, answers, table
from .registry import query


def _q(s: str) -> str:
    return s.replace("'", "''")


def _rr(x: str, *pairs: tuple[str, str]) -> str:
    for p, r in pairs:
        x = f"regexp_replace({x}, '{_q(p)}', '{_q(r)}', 'g')"
    return x


def _strip(x: str) -> str:
    return _rr(x, (r"^\s+|\s+$", ""))


def _dollars(x: str) -> str:
    return _strip(_rr(_strip(x), (r"^\$+|\$+$", "")))


def _rm(x: str, *literals: str) -> str:
    for s in literals:
        x = f"replace({x}, '{_q(s)}', '')"
    return x


_BOX = r"\\boxed\s*(?:\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}|(\\[a-zA-Z]+(?:\{[^{}]*\})*|\([^()\n]*\)|\[[^\[\]\n]*\]|[-+]?[^\s,;:!?]+))"
_TEXT = r"\\(?:text|mathrm|textbf|textit|mathbf|mathit)\{([^}]*)\}"
_SIDE = r"(\\sqrt\{[^{}]+\}|[A-Za-z0-9]+)"


def _canonical(x: str) -> str:
    return _rr(_strip(f"coalesce({x}, '')"), (r"(?i)^\s*(?:final\s*)?answer\s*[:：]\s*", ""), ("[−–—]", "-"), ("[⁄∕]", "/"), (r"\\[()\[\]]", ""), (r"\\[dt]frac", r"\\frac"), (r"√\s*([A-Za-z0-9]+)", r"\\sqrt{\1}"),
               (r"\\frac\s*([A-Za-z0-9])\s*([A-Za-z0-9])", r"\\frac{\1}{\2}"), (r"\\frac\s*([A-Za-z0-9])\s*\{([^{}]+)\}", r"\\frac{\1}{\2}"), (r"\\frac\s*\{([^{}]+)\}\s*([A-Za-z0-9])", r"\\frac{\1}{\2}"), (r"\\sqrt\s*([A-Za-z0-9])", r"\\sqrt{\1}"), (rf"{_SIDE}\s*/\s*{_SIDE}", r"\\frac{\1}{\2}"))


def _boxes(x: str) -> str:
    one = _rr("trim(regexp_extract(b, '" + _q(_BOX) + "', 2))", (r"[.,;:!?]+$", ""))
    return f"list_filter(list_transform(regexp_extract_all({x}, '{_q(_BOX)}'), lambda b: CASE WHEN regexp_extract(b, '{_q(_BOX)}', 1) <> '' THEN {_strip(chr(114) + 'egexp_extract(b, ' + chr(39) + _q(_BOX) + chr(39) + ', 1)')} ELSE {one} END), lambda b: b <> '')"


def _last(x: str) -> str:
    return f"({_boxes(x)})[-1]"


def _member(x: str) -> str:
    for _ in range(2):
        x = _strip(_rr(_strip(x), (r"^\s*[A-Za-z](?:_[A-Za-z0-9]+)?\s*(?:\\in|∈)\s*(.+?)\s*$", r"\1")))
    return x


def _stages(source: str, column: str, prefix: str) -> list[str]:
    """Common table expressions that end in {prefix}z with columns of ``source``, choice and norm (of ``column``)."""
    p = prefix
    marks = r"\\([a-zA-Z]+)"
    return [
        f"{p}a AS (SELECT *, {_canonical(column)} AS {p}c FROM {source})",
        f"{p}b AS (SELECT *, {_rm(_rr(_dollars(_member(f'{p}c')), (_TEXT, chr(92) + '1')), chr(92) + 'left', chr(92) + 'right')} AS {p}d, {_member(f'{p}c')} AS {p}m FROM {p}a)",
        f"{p}e AS (SELECT *, {_strip(_rr(f'coalesce({_last(f'{p}d')}, {p}d)', (marks, chr(92) + '1'), (chr(92) + 's+', ' ')))} AS {p}f, {_rr(_rm(f'replace(replace({p}m, chr(92) || chr(36), chr(36)), chr(92) || chr(44), chr(44))', chr(92) + '!'), (chr(92) + 's+', ''))} AS {p}g FROM {p}b)",
        f"{p}h AS (SELECT *, coalesce(lower(nullif(regexp_extract({p}f, '^\\(?\\s*([A-Za-z])\\s*\\)?$', 1), '')), lower(nullif(regexp_extract({p}f, '^\\(\\s*([A-Za-z])\\s*\\)\\s+.+$', 1), ''))) AS {p}choice, CASE WHEN regexp_matches({p}g, '^\\$[-+]?\\d[\\d,]*(?:\\.\\d+)?$') THEN replace(replace({p}g, '$', ''), ',', '') ELSE {p}m END AS {p}cur FROM {p}e)",
        f"{p}i AS (SELECT *, lower({_rr(_rm(_rr(_rm(f'replace({p}cur, chr(92) || chr(36), chr(36))', '$'), (chr(92) * 2 + r'[ ,;:]', ' '), (chr(92) * 2 + r'[\]\[]', ''), (_TEXT, chr(92) + '1')), chr(92) + 'left', chr(92) + 'right', chr(92) + '!'), (marks, chr(92) + '1'), (r'[ \n\t]', ''))}) AS {p}n FROM {p}h)",
        f"""{p}z AS (SELECT *, coalesce({p}choice, CASE WHEN contains({p}n, ',') AND NOT regexp_matches({p}n, 'begin\\{{|end\\{{|matrix|cases|cup') AND NOT regexp_matches({p}n, '[()\\[\\]{{}}=:]') AND len(list_filter(string_split({p}n, ','), lambda v: NOT regexp_matches(v, '\\d'))) = 0
  THEN array_to_string(list_sort(list_transform(string_split({p}n, ','), lambda v: trim(v))), ',') ELSE {p}n END) AS {p}norm FROM {p}i)""",
    ]


_FORMS = r"""forms AS (SELECT row_id, CASE row_id % 10 WHEN 0 THEN completion WHEN 1 THEN concat('Answer: ', gold, '/4') WHEN 2 THEN concat('\dfrac ', row_id % 9 + 1, ' 7') WHEN 3 THEN concat('√', row_id, ' – 2') WHEN 4 THEN concat('\(\frac{', row_id, '} 5\)') WHEN 5 THEN concat('\$', row_id, ',000')
  WHEN 6 THEN concat('x \in y \in ', gold) WHEN 7 THEN concat('(', chr(65 + CAST(row_id % 5 AS INTEGER)), ') some text') WHEN 8 THEN concat('7, ', row_id, ' , 3') ELSE concat('\text{', gold, '}\, \left( a \right)') END AS t, gold FROM answers)"""


def _forms(spark, sf):
    r = F.col("row_id")
    made = [F.col("completion"), F.concat(F.lit("Answer: "), "gold", F.lit("/4")), F.concat(F.lit("\\dfrac "), (r % 9 + 1).cast("string"), F.lit(" 7")), F.concat(F.lit("\u221a"), r.cast("string"), F.lit(" \u2013 2")), F.concat(F.lit("\\(\\frac{"), r.cast("string"), F.lit("} 5\\)")), F.concat(F.lit("\\$"), r.cast("string"), F.lit(",000")),
            F.concat(F.lit("x \\in y \\in "), "gold"), F.concat(F.lit("("), F.char(65 + r % 5), F.lit(") some text")), F.concat(F.lit("7, "), r.cast("string"), F.lit(" , 3")), F.concat(F.lit("\\text{"), "gold", F.lit("}\\, \\left( a \\right)"))]
    return answers(spark, sf).select("row_id", F.element_at(F.array(*made), (r % 10 + 1).cast("int")).alias("t"), "gold")


@query(f"SELECT row_id, {_canonical('t')} AS canonical FROM forms", ANSWERS, _FORMS)
def latex_canonicalize(spark, sf):
    """U1."""
    return _forms(spark, sf).select("row_id", A.canonical(F.col("t")).alias("canonical"))


@query(f"SELECT row_id, {_boxes('completion')} AS boxed, {_last('completion')} AS last_boxed FROM answers", ANSWERS)
def extract_boxed(spark, sf):
    """U4."""
    return answers(spark, sf).select("row_id", A.boxes(F.col("completion")).alias("boxed"), A.last_box(F.col("completion")).alias("last_boxed"))


@query("SELECT row_id, zchoice AS choice FROM zz", ANSWERS, _FORMS, *_stages("forms", "t", "z"))
def choice_letter(spark, sf):
    """U11, U12."""
    return _forms(spark, sf).select("row_id", A.choice(F.col("t")).alias("choice"))


@query("SELECT row_id, znorm AS normalized FROM zz", ANSWERS, _FORMS, *_stages("forms", "t", "z"))
def normalize_answer(spark, sf):
    """U14, U3, U13."""
    return _forms(spark, sf).select("row_id", A.normalized(F.col("t")).alias("normalized"))


@query("""SELECT row_id, CASE WHEN regexp_matches(c, '^\\$[-+]?\\d[\\d,]*(?:\\.\\d+)?$') THEN replace(replace(c, '$', ''), ',', '') ELSE trim(t) END AS amount FROM (SELECT row_id, t, regexp_replace(replace(replace(replace(trim(t), '\\$', '$'), '\\,', ','), '\\!', ''), '\\s+', '', 'g') AS c FROM
  (SELECT row_id, CASE row_id % 3 WHEN 0 THEN concat('\\$', row_id, ',500.25') WHEN 1 THEN concat('$ -', row_id) ELSE concat(row_id, ' dollars') END AS t FROM answers))""", ANSWERS)
def currency(spark, sf):
    """U13."""
    r = F.col("row_id")
    t = F.when(r % 3 == 0, F.concat(F.lit("\\$"), r.cast("string"), F.lit(",500.25"))).when(r % 3 == 1, F.concat(F.lit("$ -"), r.cast("string"))).otherwise(F.concat(r.cast("string"), F.lit(" dollars")))
    return answers(spark, sf).select("row_id", A.currency(t).alias("amount"))


@query("""SELECT row_id, CASE WHEN row_id % 4 = 0 THEN t ELSE array_to_string(list_sort(list_transform(string_split(t, ','), lambda v: trim(v))), ',') END AS sorted FROM (SELECT row_id, concat(row_id, ', 3, ', CASE WHEN row_id % 4 = 0 THEN 'x' ELSE '1a' END) AS t FROM answers)""", ANSWERS)
def unordered_list(spark, sf):
    """U3."""
    return answers(spark, sf).select("row_id", A.unordered(F.concat(F.col("row_id").cast("string"), F.lit(", 3, "), F.when(F.col("row_id") % 4 == 0, "x").otherwise("1a"))).alias("sorted"))


_LINES = r"""said AS (SELECT row_id, CASE row_id % 8 WHEN 0 THEN concat('**Answer:** ', row_id) WHEN 1 THEN concat('1. Final Answer: $', row_id, '$.') WHEN 2 THEN concat('- **final answer: ', row_id, '**') WHEN 3 THEN concat('Therefore, the final answer is: ', row_id, '. I hope it is correct')
  WHEN 4 THEN '**Conclusion:**' WHEN 5 THEN concat('Thus, x = ', row_id) WHEN 6 THEN concat('Something ', row_id) ELSE concat('Final Answer: ', row_id) END AS line FROM answers)"""


def _said(spark, sf):
    r = F.col("row_id").cast("string")
    made = [F.concat(F.lit("**Answer:** "), r), F.concat(F.lit("1. Final Answer: $"), r, F.lit("$.")), F.concat(F.lit("- **final answer: "), r, F.lit("**")), F.concat(F.lit("Therefore, the final answer is: "), r, F.lit(". I hope it is correct")), F.lit("**Conclusion:**"), F.concat(F.lit("Thus, x = "), r), F.concat(F.lit("Something "), r), F.concat(F.lit("Final Answer: "), r)]
    return answers(spark, sf).select("row_id", F.element_at(F.array(*made), (F.col("row_id") % 8 + 1).cast("int")).alias("line"))


_CLEAN = _rr(_rr("line", (r"^(?:[-*]\s+|\d+\s*[.)]\s+)", "")), (r"^\*\*(.+)\*\*$", r"\1"))


@query(f"SELECT row_id, lower(trim(regexp_replace({_CLEAN}, '[:：]+$', ''))) IN ('conclusion', 'therefore', 'thus', 'hence', 'so') AS header, regexp_matches(lower({_CLEAN}), '^(?:conclusion|therefore|thus|hence|so)(?:$|[:：, .])') AS cue FROM said", ANSWERS, _LINES)
def line_cues(spark, sf):
    """U6."""
    return _said(spark, sf).select("row_id", A.is_conclusion_header(F.col("line")).alias("header"), A.has_conclusion_cue(F.col("line")).alias("cue"))


@query("SELECT row_id, CASE WHEN row_id % 8 = 0 THEN 'answer' WHEN row_id % 8 IN (1, 2, 7) THEN 'finalanswer' END AS label, CASE WHEN row_id % 8 = 1 THEN concat(row_id, '$') WHEN row_id % 8 IN (0, 2, 7) THEN CAST(row_id AS VARCHAR) END AS answer FROM said", ANSWERS, _LINES)
def parse_answer_line(spark, sf):
    """What the line was made from comes back."""
    line = A.answer_line(F.col("line"))
    return _said(spark, sf).withColumn("l", line).select("row_id", F.col("l.label").alias("label"), F.when(F.col("l").isNotNull(), A.answer_in(F.col("l.raw"))["answer"]).alias("answer"))


@query("SELECT row_id, CASE WHEN row_id % 8 = 3 THEN CAST(row_id AS VARCHAR) WHEN row_id % 8 = 7 THEN CAST(row_id AS VARCHAR) END AS said FROM said", ANSWERS, _LINES)
def final_answer_line(spark, sf):
    """U8."""
    return _said(spark, sf).select("row_id", A.final_line(F.col("line")).alias("said"))


@query(r"""SELECT row_id, CASE row_id % 12 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN concat('\frac{', p_size, '}{3}') WHEN 3 THEN CAST(p_size AS VARCHAR) WHEN 4 THEN concat(p_size, '/7') WHEN 5 THEN '\text{(B)}' WHEN 6 THEN concat('\$', p_size, ',000')
  WHEN 7 THEN concat('x \in \{', p_size, ', 2, 10\}') WHEN 8 THEN concat('(', p_size, ', 4]') WHEN 9 THEN concat('x = ', p_size, ' \text{cm}') WHEN 10 THEN '' ELSE concat('No marker ', p_size) END AS gold_text FROM answers a JOIN part p ON p.p_partkey = a.row_id""", ANSWERS)
def extract_gold(spark, sf):
    """U16: the part that the completion was written around."""
    return answers(spark, sf).select("row_id", A.gold_answer(F.col("completion")).alias("gold_text"))


@query(r"""SELECT row_id, CASE row_id % 4 WHEN 0 THEN CAST(row_id AS VARCHAR) WHEN 1 THEN concat('\frac{', row_id, '}{3}') WHEN 2 THEN NULL ELSE CAST(row_id AS VARCHAR) END AS core FROM answers""", ANSWERS)
def scalar_core(spark, sf):
    """U15."""
    r = F.col("row_id").cast("string")
    t = F.element_at(F.array(F.concat(F.lit("x = "), r, F.lit(" \\text{cm}")), F.concat(F.lit("$"), r, F.lit("/3$")), F.concat(F.lit("the value "), r), F.concat(r, F.lit("^\\circ"))), (F.col("row_id") % 4 + 1).cast("int"))
    return answers(spark, sf).select("row_id", A.scalar_core(t).alias("core"))


@query("SELECT row_id, lnorm = rnorm AND rnorm <> '' AS same FROM rz", ANSWERS, "pairs AS (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN concat('$', gold, '$') WHEN row_id % 3 = 1 THEN upper(gold) ELSE concat(gold, '1') END AS p, gold AS g FROM answers)", *_stages("pairs", "p", "l"), *_stages("lz", "g", "r"))
def legacy_match(spark, sf):
    """U20."""
    r = F.col("row_id")
    p = F.when(r % 3 == 0, F.concat(F.lit("$"), "gold", F.lit("$"))).when(r % 3 == 1, F.upper("gold")).otherwise(F.concat("gold", F.lit("1")))
    return answers(spark, sf).select("row_id", A.legacy_match(p, F.col("gold")).alias("same"))


@query("SELECT row_id, CASE WHEN finish_reason IS NULL OR lower(finish_reason) = 'stop' THEN 0.0::DOUBLE WHEN row_id % 2 = 0 THEN -0.05::DOUBLE ELSE -0.2::DOUBLE END AS penalty FROM answers", ANSWERS)
def length_penalty(spark, sf):
    """U22."""
    return answers(spark, sf).select("row_id", A.length_penalty(F.col("finish_reason"), F.col("row_id") % 2 == 0).cast("double").alias("penalty"))


@query("SELECT row_id, ['f(a,b)', concat('[', row_id, ',2]'), 'c'] AS parts FROM answers", ANSWERS)
def split_top_level(spark, sf):
    """U2."""
    return answers(spark, sf).select("row_id", A.top_level(F.concat(F.lit("f(a,b),["), F.col("row_id").cast("string"), F.lit(",2],c"))).alias("parts"))


#: What each of the twelve forms of completions says, stated by form and apart from the patterns that find it.
_SAID = r"""said AS (SELECT *, CASE form WHEN 0 THEN s WHEN 1 THEN s WHEN 2 THEN concat('\frac{', s, '}{3}') WHEN 4 THEN concat(s, '/7') WHEN 5 THEN '\text{(B)}' WHEN 6 THEN concat('\$', s, ',000')
    WHEN 7 THEN concat('x \in \{', s, ', 2, 10\}') WHEN 8 THEN concat('(', s, ', 4]') WHEN 9 THEN concat('x = ', s, ' \text{cm}') END AS answer
  FROM (SELECT a.*, a.row_id % 12 AS form, CAST(p_size AS VARCHAR) AS s FROM answers a JOIN part p ON p.p_partkey = a.row_id))"""
_GRADED = """graded AS (SELECT *, round(format_reward + answer_reward + length_reward, 6) AS total_reward FROM (SELECT *, CASE WHEN is_correct THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS answer_reward FROM (
  SELECT *, CASE WHEN answer IS NULL THEN false WHEN form IN (0, 1, 9) THEN s = gold ELSE true END AS is_correct, CASE WHEN form = 0 THEN 0.2::DOUBLE WHEN form IN (2, 8) THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END AS format_reward,
    CASE WHEN coalesce(finish_reason, 'stop') = 'stop' THEN 0.0::DOUBLE WHEN answer IS NULL THEN -0.2::DOUBLE ELSE -0.05::DOUBLE END AS length_reward FROM said)))"""


@query("""SELECT row_id, answer, CASE WHEN form IN (0, 4, 5, 9) THEN answer END AS boxed, CASE WHEN form IN (0, 2, 8) THEN 'standard_single_line' WHEN form IN (1, 6, 7) THEN 'legacy_answer_line'
  WHEN form IN (4, 9) THEN 'legacy_conclusion_boxed' WHEN form = 5 THEN 'tail_boxed' END AS source, form IN (0, 2, 8) AS standard FROM said""", ANSWERS, _SAID)
def tail_answer(spark, sf):
    """U9, U26."""
    return A.inspected(answers(spark, sf)).select("row_id", "tail.answer", "tail.boxed", "tail.source", "tail.standard")


@query("""SELECT row_id, CASE WHEN form IN (0, 2, 8) THEN []::VARCHAR[] WHEN form = 10 THEN ['empty_completion', 'missing_final_answer_line'] ELSE ['missing_final_answer_line', 'last_line_not_final_answer'] END AS violations,
  CASE WHEN form IN (0, 2, 8) THEN [answer] ELSE []::VARCHAR[] END AS final_lines FROM said""", ANSWERS, _SAID)
def format_violations(spark, sf):
    """U10, U27."""
    return A.inspected(answers(spark, sf)).select("row_id", "violations", "final_lines")


@query(r"""SELECT row_id, CASE form WHEN 4 THEN concat('\frac{', s, '}{7}') ELSE coalesce(answer, '') END AS answer_text, CASE form WHEN 2 THEN concat('frac{', s, '}{3}') WHEN 4 THEN concat('frac{', s, '}{7}') WHEN 5 THEN 'b' WHEN 6 THEN concat(s, '000')
  WHEN 7 THEN concat('\{', s, ',2,10\}') WHEN 8 THEN concat('(', s, ',4]') WHEN 9 THEN concat('x=', s, 'cm') ELSE coalesce(answer, '') END AS answer FROM said""", ANSWERS, _SAID)
def pred_answer(spark, sf):
    """U28."""
    return A.inspected(answers(spark, sf)).select("row_id", A.canonical(F.col("tail.answer")).alias("answer_text"), A.normalized(F.col("tail.answer")).alias("answer"))


@query("""SELECT row_id, CASE form WHEN 3 THEN s WHEN 10 THEN '' WHEN 11 THEN concat('No marker ', s) ELSE answer END AS answer, gold, CASE WHEN form IN (6, 10, 11) THEN false WHEN form IN (0, 1, 3, 9) THEN s = gold ELSE true END AS typed_match FROM said""", ANSWERS, _SAID)
def typed_match(spark, sf):
    """U17, U18, U29."""
    return A.typed_match(answers(spark, sf).withColumn("answer", A.gold_answer(F.col("completion"))), "answer", "gold").select("row_id", "answer", "gold", "typed_match")


@query("SELECT row_id, format_reward FROM graded", ANSWERS, _SAID, _GRADED)
def format_reward(spark, sf):
    """U21."""
    return A.scored(answers(spark, sf)).select("row_id", "format_reward")


@query("SELECT row_id, answer, is_correct, format_reward, answer_reward, length_reward, total_reward FROM graded", ANSWERS, _SAID, _GRADED)
def score_completions(spark, sf):
    """U23."""
    return A.scored(answers(spark, sf)).select("row_id", "answer", "is_correct", "format_reward", "answer_reward", "length_reward", "total_reward")


@query("SELECT count(*) AS n, round(avg(is_correct::INT::DOUBLE), 6) AS accuracy, round(avg(total_reward), 6) AS mean_reward, CAST(sum((trim(completion) = '')::INT) AS BIGINT) AS empty FROM graded", ANSWERS, _SAID, _GRADED)
def eval_run_compose(spark, sf):
    """A run scored row by row and summed up."""
    rows = A.scored(answers(spark, sf))
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"), F.round(F.avg("total_reward"), 6).alias("mean_reward"), F.sum((X.strip(F.col("completion")) == "").cast("long")).alias("empty"))


# What each form of a pair must give; null where a side is no whole expression.
_PAIRS = [
    (lambda s: (F.concat(F.lit("\\frac{"), s, F.lit("}{2}")), (s.cast("double") / 2).cast("string")), True),
    (lambda s: (F.concat(F.lit("x+"), s), F.concat(s, F.lit("+x"))), True),
    (lambda s: (F.concat(F.lit("(x+"), s, F.lit(")^2")), F.concat(F.lit("x^2+"), (s.cast("int") * 2).cast("string"), F.lit("x+"), (s.cast("int") * s.cast("int")).cast("string"))), True),
    (lambda s: (F.concat(F.lit("\\sqrt{"), (s.cast("int") * s.cast("int") * 2).cast("string"), F.lit("}")), F.concat(s, F.lit("\\sqrt2"))), True),
    (lambda s: (F.concat(s, F.lit("\\%")), F.concat(s, F.lit("/100"))), True),
    (lambda s: (F.concat(s, F.lit("x")), F.concat(s, F.lit("+x"))), False),
    (lambda s: (F.concat(F.lit("\\frac{"), s, F.lit("}{")), s), None),
    (lambda s: (F.concat(F.lit("\\frac{x^2-"), (s.cast("int") * s.cast("int")).cast("string"), F.lit("}{x-"), s, F.lit("}")), F.concat(F.lit("x+"), s)), True),
    (lambda s: (F.concat(F.lit("(1/2, "), s, F.lit(")")), F.concat(F.lit("("), s, F.lit(", 0.5)"))), False),
    (lambda s: (F.concat(F.lit("\\{"), s, F.lit(", 1/2\\}")), F.concat(F.lit("0.5, "), s)), True),
    (lambda s: (F.concat(F.lit("\\sin^2 x + \\cos^2 x + "), s), (s.cast("int") + 1).cast("string")), True),
    (lambda s: (F.concat(F.lit("value of "), s), s), None),
]


@query(f"SELECT p_partkey AS row_id, (CAST([{', '.join({True: 'true', False: 'false', None: 'NULL'}[p[1]] for p in _PAIRS)}] AS BOOLEAN[]))[p_partkey % {len(_PAIRS)} + 1] AS same FROM part")
def expression_equivalence(spark, sf):
    """Pairs in twelve forms; the SQL says what each must give."""
    k, s = (F.col("p_partkey") % len(_PAIRS) + 1).cast("int"), F.col("p_size").cast("string")
    pairs = [F.struct(a.alias("l"), b.alias("r")) for a, b in (p[0](s) for p in _PAIRS)]
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.element_at(F.array(*pairs), k).alias("pair"))
    return rows.select("row_id", E.equivalent(F.col("pair.l"), F.col("pair.r")).alias("same"))


@query("""SELECT row_id, concat(repeat('f{', d), s, repeat('}', d)) AS last_boxed, CAST(s AS VARCHAR) AS key, [concat('g{', repeat('(', d), '1,2', repeat(')', d), '}'), CAST(s AS VARCHAR)] AS parts FROM (SELECT p_partkey AS row_id, CAST(p_partkey % 40 AS BIGINT) AS d, p_size AS s FROM part)""")
def nested_boxes(spark, sf):
    """Brackets up to forty deep; the SQL says what was put in."""
    d, s = (F.col("p_partkey") % 40).cast("int"), F.col("p_size").cast("string")
    times = lambda text: F.repeat(F.lit(text), d)
    said = F.concat(F.lit("so \\boxed{1} and \\boxed{"), times("f{"), s, times("}"), F.lit("}."))
    keyed = F.concat(times("\\boxed{"), s, times("}"))
    listed = F.concat(F.lit("g{"), times("("), F.lit("1,2"), times(")"), F.lit("},"), s)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), said.alias("said"), keyed.alias("keyed"), listed.alias("listed"))
    return rows.select("row_id", A.last_box(F.col("said")).alias("last_boxed"), X.cache_key(F.col("keyed")).alias("key"), A.top_level(F.col("listed")).alias("parts"))
