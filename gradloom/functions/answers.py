"""Answer extraction, normalisation and grading, in built-in expressions.

A completion's tail is read as an array of content lines; what its last two lines are (answer lines, boxes, headers,
conclusions) is found once, as columns, and one ladder of conditions picks the answer.  Boxes and brackets nest to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brackets import BARE, MARKER, box_spans, let, reused, split_at_commas
from .text import LINE_END, strip

# Cue words, wrappers, units and phrases that the grading rules name.
CONCLUSIONS = ("conclusion", "therefore", "thus", "hence", "so")
WRAPPERS = ("\\[", "\\]", "\\(", "\\)", "$", "$$")
UNITS = "inch(?:es)?|cm|mm|meters?|meter|units?|unit|calories?|calorie|degrees?"
SCALAR_WORDS = ("frac", "dfrac", "tfrac", "sqrt", "pi", "theta", "circ")
MATRIX_WORDS = "begin\\{|end\\{|matrix|cases|cup"
TAIL_LINES = 12
COLON = "[:\uff1a]"
LABELS = r"answer|final\s*answer"
TEXT_COMMAND = r"\\(?:text|mathrm|textbf|textit|mathbf|mathit)\{([^}]*)\}"


def _nested(depth: int) -> str:
    inner = r"[^{}]"
    for _ in range(depth):
        inner = rf"[^{{}}]|\{{(?:{inner})*+\}}"
    return rf"(?:{inner})*+"


_DEPTH = 5
BOX = rf"\\boxed\s*(?:\{{({_nested(_DEPTH)})\}}|({BARE}))"
_BOX_LINE = rf"^\\boxed\s*(?:\{{({_nested(_DEPTH)})\}}|(?!\{{)({BARE}))\s*[.,;:!?]*\s*$"


def _shallow(c: Column) -> Column:
    """Whether a text has too few braces to nest deeper than ``BOX`` reads, which is the quick way."""
    return F.regexp_count(c, F.lit(r"\{")) <= _DEPTH


def _sub(c: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def _drop(c: Column, *literals: str) -> Column:
    for x in literals:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def _end(c: Column) -> Column:
    return strip(_sub(c, (r"[.,;:!?]+$", "")))


def _dollars(c: Column) -> Column:
    return strip(_sub(strip(c), (r"^\$+|\$+$", "")))


@reused
def canonical(c: Column) -> Column:
    """LaTeX shorthand written out: U1."""
    out = _sub(strip(F.coalesce(c, F.lit(""))), (rf"^(?i)\s*(?:{LABELS})\s*{COLON}\s*", ""), ("[\u2212\u2013\u2014]", "-"), ("[\u2044\u2215]", "/"), (r"\\[()\[\]]", ""), (r"\\[dt]frac", r"\\frac"))
    out = _sub(out, (r"\u221a\s*([A-Za-z0-9]+)", r"\\sqrt{$1}"), (r"\\frac\s*([A-Za-z0-9])\s*([A-Za-z0-9])", r"\\frac{$1}{$2}"), (r"\\frac\s*([A-Za-z0-9])\s*\{([^{}]+)\}", r"\\frac{$1}{$2}"), (r"\\frac\s*\{([^{}]+)\}\s*([A-Za-z0-9])", r"\\frac{$1}{$2}"))
    side = r"(\\sqrt\{[^{}]+\}|[A-Za-z0-9]+)"
    return _sub(out, (r"\\sqrt\s*([A-Za-z0-9])", r"\\sqrt{$1}"), (rf"{side}\s*/\s*{side}", r"\\frac{$1}{$2}"))


@reused
def boxes(c: Column, deep: bool = True) -> Column:
    """The contents of all boxes in order, braced or bare, at any depth: U4.  Without ``deep`` to six levels, a smaller plan."""
    found = lambda t: F.zip_with(F.regexp_extract_all(t, F.lit(BOX), 1), F.regexp_extract_all(t, F.lit(BOX), 2), lambda a, b: F.when(a != "", strip(a)).otherwise(_sub(strip(b), (r"[.,;:!?]+$", ""))))
    quick = lambda t: F.filter(found(t), lambda x: x != "")
    any_ = lambda t: quick(t) if not deep else F.when(_shallow(t), quick(t)).otherwise(F.transform(box_spans(t), lambda x: x["content"]))
    return let(c, lambda t: F.when(F.contains(t, F.lit(MARKER)), any_(t)).when(t.isNotNull(), F.array().cast("array<string>")))


@reused
def last_box(c: Column, deep: bool = True) -> Column:
    return F.try_element_at(boxes(c, deep), F.lit(-1))


@reused
def box_only(line: Column) -> Column:
    """The content of a line that is one box and nothing else: U5."""

    def deep(own: Column) -> Column:
        first = F.try_element_at(box_spans(own), F.lit(1))
        rest = F.substring(own, first["after"], F.length(own))
        brace = F.rlike(own, F.lit(r"^\\boxed\s*\{"))
        return F.when((first["start"] == 1) & (first["braced"] == brace) & F.rlike(rest, F.lit(r"^\s*[.,;:!?]*\s*$")), first["content"])

    read = lambda own: F.when(_shallow(own), F.when(F.rlike(own, F.lit(_BOX_LINE)), last_box(own, deep=False))).otherwise(deep(own))
    return let(_dollars(line), lambda own: F.when(F.startswith(own, F.lit(MARKER)), read(own)))


def without_marker(c: Column) -> Column:
    return _sub(strip(c), (r"^\s*(?:[-*]\s+|\d+\s*[.)]\s+)", ""))


def without_bold(c: Column) -> Column:
    return let(strip(c), lambda t: F.coalesce(F.nullif(strip(F.regexp_extract(t, r"(?s)^\*\*(.+)\*\*$", 1)), F.lit("")), t))


def _plain_line(c: Column) -> Column:
    return without_bold(without_marker(c))


@reused
def is_conclusion_header(line: Column) -> Column:
    return F.coalesce(F.lower(strip(_sub(_plain_line(line), (rf"{COLON}+$", "")))).isin(*CONCLUSIONS), F.lit(False))


@reused
def has_conclusion_cue(line: Column) -> Column:
    """U6."""
    return F.coalesce(F.rlike(F.lower(_plain_line(line)), F.lit(rf"^(?:{'|'.join(CONCLUSIONS)})(?:$|[:\uff1a,\x20.])")), F.lit(False))


@reused
def is_placeholder(c: Column) -> Column:
    """F11."""
    return F.coalesce(_sub(F.lower(c), (r"[\s{}<>_\\]+", "")).isin("answer", "youranswer"), F.lit(False))


@reused
def answer_in(text: Column) -> Column:
    """struct(answer, boxed): a box wins; else the text without dollars and closing marks, null if nothing is left: U25."""
    rest = lambda t: F.nullif(_end(_dollars(t)), F.lit(""))
    return let(F.struct(text.alias("t"), last_box(text).alias("b")), lambda s: F.struct(F.coalesce(s["b"], rest(s["t"])).alias("answer"), s["b"].alias("boxed")))


_FINAL_PHRASE = rf"^(?i)\s*Therefore,\s*the\s+final\s+answer\s+is\s*{COLON}\s*(.+?)(?:\.\s*I\s+hope\s+it\s+is\s+correct)?\s*$"
_FINAL_LABEL = rf"^(?i)\s*Final Answer\s*{COLON}\s*(.*?)\s*$"
_FINAL_HEADER = rf"^(?i)\s*Therefore,\s*the\s+final\s+answer\s+is\s*{COLON}\s*$"
_PLAIN_LABEL = rf"^(?i)\s*({LABELS})\s*{COLON}\s*(.*?)\s*$"
_BOLD_LABEL = rf"^(?i)\s*\*\*({LABELS})\s*{COLON}\*\*\s*(.*?)\s*$"


@reused
def final_line(line: Column) -> Column:
    """What a final-answer line says, null for other lines: U8."""
    return F.coalesce(*[F.when(F.rlike(line, F.lit(p)), F.regexp_extract(line, p, 1)) for p in (_FINAL_PHRASE, _FINAL_LABEL)])


@reused
def answer_line(line: Column) -> Column:
    """struct(label, raw) of an answer line, past bold and list markers; null for other lines: U7."""
    tries = F.array(strip(line), without_bold(line), without_marker(line), _plain_line(line))
    read = lambda c, p: F.when(F.rlike(c, F.lit(p)), F.struct(_sub(F.lower(F.regexp_extract(c, p, 1)), (" ", "")).alias("label"), strip(F.regexp_extract(c, p, 2)).alias("raw")))
    found = F.filter(F.transform(tries, lambda c: F.coalesce(read(c, _BOLD_LABEL), read(c, _PLAIN_LABEL))), lambda x: x.isNotNull())
    return F.try_element_at(found, F.lit(1))


@reused
def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), strip), lambda x: x != "")


@reused
def membership(c: Column) -> Column:
    r"""Without leading ``x \in``, however many, as long as a line of text is left: U12."""
    several = r"^(?:\s*[A-Za-z](?:_[A-Za-z0-9]+)?\s*(?:\\in|\u2208)\s*(?=.+?\s*$))+(.+?)\s*$"
    some = lambda t: F.contains(t, F.lit("\\in")) | F.contains(t, F.lit("\u2208"))
    return let(strip(c), lambda t: F.when(some(t), strip(_sub(t, (several, "$1")))).otherwise(t))


@reused
def choice(c: Column) -> Column:
    """The letter of a multiple-choice answer, null for others: U11."""
    return _letter(membership(canonical(c)))


@reused
def _letter(inner: Column) -> Column:
    own = _drop(_sub(_dollars(inner), (TEXT_COMMAND, "$1")), "\\left", "\\right")
    own = let(own, lambda t: F.coalesce(last_box(t, deep=False), t))  # no letter is six levels deep
    own = strip(_sub(_sub(own, (r"\\([a-zA-Z]+)", "$1")), (r"\s+", " ")))
    return F.lower(F.nullif(F.regexp_extract(own, r"^(?:\(?\s*(?=[A-Za-z]\s*\)?$)|\(\s*(?=[A-Za-z]\s*\)\s+.))([A-Za-z])", 1), F.lit("")))


def currency(c: Column) -> Column:
    """An amount in dollars without sign and commas; others unchanged: U13."""
    compact = lambda t: _sub(_drop(F.replace(F.replace(t, F.lit("\\$"), F.lit("$")), F.lit("\\,"), F.lit(",")), "\\!"), (r"\s+", ""))
    amount = lambda t: F.nullif(F.translate(F.regexp_extract(compact(t), r"^\$([-+]?\d[\d,]*(?:\.\d+)?)$", 1), ",", ""), F.lit(""))
    return let(strip(c), lambda t: F.coalesce(amount(t), t))


def unordered(c: Column) -> Column:
    """A list of scalars in sorted order; matrices, brackets, equations and parts without a digit stay as they are: U3."""
    parts = lambda t: F.transform(F.split(t, ",", -1), strip)
    scalar = lambda t: ~F.rlike(F.lower(t), F.lit(MATRIX_WORDS)) & ~F.rlike(t, F.lit(r"[()\[\]{}=:]")) & F.forall(parts(t), lambda x: F.rlike(x, F.lit(r"\d")))
    return let(c, lambda t: F.when(F.contains(t, F.lit(",")) & scalar(t), F.array_join(F.array_sort(parts(t)), ",")).otherwise(t))


@reused
def normalized(c: Column) -> Column:
    """The form in which answers are compared: U14."""

    return let(membership(canonical(c)), lambda inner: F.coalesce(_letter(inner), _plain_form(inner)))


@reused
def _plain_form(inner: Column) -> Column:
    """The form of what is no letter."""
    own = F.replace(F.replace(currency(inner), F.lit("\\$"), F.lit("$")), F.lit("$"), F.lit(""))
    own = _drop(_sub(own, (r"\\[\x20,;:]", " "), (r"\\[\]\[]", ""), (TEXT_COMMAND, "$1")), "\\left", "\\right", "\\!")
    return unordered(F.lower(_sub(own, (r"\\([a-zA-Z]+)", "$1"), (r"[\x20\n\t]", ""))))


@reused
def scalar_core(c: Column) -> Column:
    """The scalar in an answer, past its equation, angle or unit; null where it is no scalar: U15."""
    own = let(canonical(c), lambda t: F.coalesce(last_box(t, deep=False), t))
    own = _drop(_dollars(membership(own)), "\\left", "\\right", "\\!")
    own = strip(_sub(own, (r"\\[,;:\x20]", " "), (TEXT_COMMAND, " $1 "), (r"\s+", " ")))
    own = _sub(own, (r"^\s*[A-Za-z](?:_[A-Za-z0-9]+)?\s*=\s*(.+?)\s*$", "$1"), (r"^(?i)\s*(.+?)\s*(?:\^?\s*\\circ|\u00b0)\s*$", "$1"), (rf"^(?i)\s*(.+?)\s+(?:{UNITS})\.?\s*$", "$1"))
    words = lambda t: F.regexp_extract_all(t, F.lit(r"[A-Za-z]{2,}"), 0)
    bad = lambda t: F.rlike(t, F.lit(r"^[(\[{].*[)\]}]$|[=.!?]|\\in|\u2208")) | (F.size(top_level(t)) > 1) | F.exists(words(t), lambda w: ~F.lower(w).isin(*SCALAR_WORDS))
    return let(_end(own), lambda t: F.when((t != "") & ~bad(t), t))


def top_level(c: Column) -> Column:
    """Parts between commas outside all brackets: U2."""
    return F.when(~F.contains(c, F.lit(",")), F.array(c)).otherwise(split_at_commas(c))


@reused
def gold_answer(c: Column) -> Column:
    """The reference answer in a solution: last #### line, else last box, else last answer line, else all of it: U16."""

    def found(text: Column) -> Column:
        marks = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*####\s*(.+?)\s*$"), 1), strip), lambda x: x != "")
        said = F.filter(F.transform(lines_of(text), lambda line: F.coalesce(answer_in(final_line(line))["answer"], answer_in(answer_line(line)["raw"])["answer"])), lambda x: x.isNotNull())
        return F.coalesce(F.try_element_at(marks, F.lit(-1)), last_box(text), F.try_element_at(said, F.lit(-1)), text)

    return let(strip(c), found)


def inspected(rows: DataFrame, completion: str = "completion") -> DataFrame:
    """``rows`` with ``tail``: struct(answer, boxed, source, standard, violations): U9, U10, U26, U27.

    Parts that are used more than once are columns of their own, so each is computed once.
    """
    df = rows.withColumn("__lines", lines_of(F.col(completion)))
    window = F.slice("__lines", F.greatest(F.lit(1), F.size("__lines") - TAIL_LINES + 1), F.lit(TAIL_LINES))
    df = df.withColumn("__content", F.filter(window, lambda x: ~x.isin(*WRAPPERS) & ~F.startswith(x, F.lit("```"))))
    df = df.withColumn("__last", F.try_element_at("__content", F.lit(-1))).withColumn("__prev", F.try_element_at("__content", F.lit(-2)))
    last, prev = F.col("__last"), F.col("__prev")
    df = df.withColumns({"__final": final_line(last), "__line": answer_line(last), "__prev_line": answer_line(prev), "__box": last_box(last), "__only": box_only(last), "__header": F.coalesce(F.rlike(prev, F.lit(_FINAL_HEADER)), F.lit(False)), "__concl": is_conclusion_header(prev)})
    df = df.withColumns({"__from_final": answer_in(F.col("__final")), "__from_line": answer_in(F.col("__line.raw")), "__from_prev": answer_in(F.col("__prev_line.raw")), "__from_last": answer_in(last)})
    box, only, header = F.col("__box"), F.col("__only"), F.col("__header")
    real = box.isNotNull() & ~is_placeholder(box)
    none = F.array().cast("array<string>")

    def result(answer, boxed, source, standard, violations=none):
        return F.struct(answer.cast("string").alias("answer"), boxed.cast("string").alias("boxed"), (F.lit(source) if isinstance(source, str) or source is None else source).cast("string").alias("source"), (F.lit(standard) if isinstance(standard, bool) else standard).alias("standard"), violations.alias("violations"))

    empty = lambda answer, standard=F.lit(True): F.when(answer.isNull() & standard, F.array(F.lit("empty_final_answer"))).otherwise(none)
    own = lambda s, source, standard=True: result(F.col(f"{s}.answer"), F.col(f"{s}.boxed"), source, standard, empty(F.col(f"{s}.answer"), F.lit(standard) if isinstance(standard, bool) else standard))
    final_label, prev_final = F.col("__line.label") == "finalanswer", F.col("__prev_line.label") == "finalanswer"
    line_source = F.when(header, "standard_multi_line").when(final_label, "standard_single_line").otherwise("legacy_answer_line")
    prev_source = F.when(prev_final, "standard_multi_line").otherwise("legacy_answer_line")
    mismatch = F.when(F.col("__from_prev.answer").isNotNull() & ~((normalized(F.col("__from_prev.answer")) != "") & (normalized(F.col("__from_prev.answer")) == normalized(only))), F.array(F.lit("boxed_final_answer_mismatch"))).otherwise(none)
    tail_boxes = F.filter(F.flatten(F.transform("__content", lambda x: F.array(last_box(x)))), lambda x: x.isNotNull() & ~is_placeholder(x))
    tail_box = F.try_element_at(tail_boxes, F.lit(-1))
    ladder = (
        F.when(last.isNull(), result(F.lit(None), F.lit(None), None, False))
        .when(F.col("__final").isNotNull(), own("__from_final", "standard_single_line"))
        .when(F.col("__line").isNotNull(), own("__from_line", line_source, header | final_label))
        .when(real & has_conclusion_cue(last), result(box, box, "legacy_conclusion_boxed", False))
        .when(only.isNotNull() & header, result(only, only, "standard_multi_line", True))
        .when(only.isNotNull() & F.col("__prev_line").isNotNull(), result(only, only, prev_source, prev_final, mismatch))
        .when(only.isNotNull() & F.col("__concl"), result(only, only, "legacy_conclusion_boxed", False))
        .when(only.isNotNull(), result(only, only, "tail_boxed", False))
        .when(header, own("__from_last", "standard_multi_line"))
        .when(F.col("__concl") & real, result(box, box, "legacy_conclusion_boxed", False))
        .when(F.col("__prev_line").isNotNull() & F.col("__from_prev.answer").isNull(), own("__from_last", prev_source, prev_final))
        .when(F.rlike(last, F.lit(_FINAL_HEADER)), result(F.lit(None), F.lit(None), "standard_multi_line", True, F.array(F.lit("empty_final_answer"))))
        .when(tail_box.isNotNull(), result(tail_box, tail_box, "tail_boxed", False))
        .otherwise(result(F.lit(None), F.lit(None), None, False))
    )
    df = df.withColumn("tail", ladder)
    said = F.filter(F.transform("__lines", lambda x: answer_in(final_line(x))["answer"]), lambda x: x.isNotNull())
    df = df.withColumn("__said", said).withColumn("__norm", F.transform("__said", normalized)).withColumn("__tail_norm", normalized(F.col("tail.answer")))
    more = F.col("tail.standard") & F.col("tail.answer").isNotNull() & ~((F.col("__tail_norm") != "") & F.array_contains("__norm", F.col("__tail_norm")))
    df = df.withColumn("final_lines", F.when(more, F.concat("__said", F.array("tail.answer"))).otherwise(F.col("__said"))).withColumn("__norm", F.when(more, F.concat("__norm", F.array("__tail_norm"))).otherwise(F.col("__norm")))
    end = F.try_element_at("__lines", F.lit(-1))
    df = df.withColumn("last_is_final", F.coalesce(final_line(end).isNotNull(), F.lit(False)))
    note = lambda flag, text: F.when(flag, F.array(F.lit(text))).otherwise(none)
    n_final = F.size("final_lines")
    found = F.concat(note(F.size("__lines") == 0, "empty_completion"), note(n_final == 0, "missing_final_answer_line"), note((n_final > 0) & (F.size(F.array_distinct(F.filter("__norm", lambda x: x != ""))) > 1), "multiple_final_answer_lines"),
                     F.when(F.col("tail.standard"), F.col("tail.violations")).otherwise(note((F.size("__lines") > 0) & ~F.col("last_is_final"), "last_line_not_final_answer")), F.col("tail.violations"))
    df = df.withColumn("violations", F.array_distinct(found))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


@reused
def unwrapped(c: Column) -> Column:
    """Past membership, dollars and escaped braces."""
    return _sub(_dollars(membership(canonical(c))), (r"\\([{}])", "$1"))


@reused
def _bracketed(c: Column) -> Column:
    """struct(open, close, parts) of a bracketed list, null for others: U17."""
    inner = lambda t: strip(F.substring(t, F.lit(2), F.length(t) - 2))
    pair = lambda t: F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1))
    read = lambda t: F.struct(pair(t).alias("pair"), F.transform(top_level(inner(t)), strip).alias("parts"))
    listed = let(unwrapped(c), lambda t: F.when((F.length(t) > 2) & pair(t).isin("()", "[]", "[)", "(]", "{}") & (inner(t) != ""), read(t)))
    return let(listed, lambda s: F.when(~F.exists(s["parts"], lambda x: x == ""), s))


@reused
def _bare_set(c: Column) -> Column:
    parts = let(unwrapped(c), lambda t: F.when(F.contains(t, F.lit(",")) & ~F.rlike(t, F.lit(r"^[(\[].*[)\]]$")), F.transform(top_level(t), strip)))
    return let(parts, lambda p: F.when((F.size(p) > 1) & ~F.exists(p, lambda x: x == ""), p))


def _compared(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ``typed_match`` and ``same``, which is ``typed_match`` or else what U20 says of the two.

    The first kind that both sides have decides: choice, scalar, interval, tuple, set, plain text.  What only later kinds
    need is null where an earlier one has decided, so it isn't computed there.
    """
    df, sides = rows, (("l", F.col(left)), ("r", F.col(right)))
    col = lambda side, name: F.col(f"__{side}_{name}")
    both = lambda name: F.when(col("l", name).isNotNull() & col("r", name).isNotNull(), col("l", name) == col("r", name))
    for side, x in sides:
        df = df.withColumns({f"__{side}_inner": membership(canonical(x)), f"__{side}_core": scalar_core(x)}).withColumn(f"__{side}_choice", F.when(x.isNotNull(), _letter(col(side, "inner"))))
    cores = col("l", "core").isNotNull() & col("r", "core").isNotNull()
    df = df.withColumns({f"__{side}_scalar": F.when(cores, F.nullif(normalized(col(side, "core")), F.lit(""))) for side, _ in sides})
    df = df.withColumn("__choice", both("choice")).withColumn("__scalar", both("scalar"))
    undecided = F.col("__choice").isNull() & F.col("__scalar").isNull()
    for side, x in sides:
        df = df.withColumns({f"__{side}_list": F.when(undecided, _bracketed(x)), f"__{side}_bare": F.when(undecided, _bare_set(x)), f"__{side}_norm": F.when(undecided, F.coalesce(_letter(col(side, "inner")), _plain_form(col(side, "inner"))))})
        listed = col(side, "list")
        df = df.withColumns({f"__{side}_items": F.transform(listed["parts"], normalized), f"__{side}_bares": F.transform(col(side, "bare"), normalized)})
        pair, items, bare = listed["pair"], col(side, "items"), col(side, "bares")
        whole = ~F.exists(items, lambda i: i == "")
        plain = let(unwrapped(x), lambda t: F.rlike(t, F.lit(r"\p{L}")) & ~F.rlike(t, F.lit(r"[\\{}\[\](),=^_/$]")))
        df = df.withColumns({
            f"__{side}_interval": F.when(pair.isin("[]", "[)", "(]") & (F.size(items) == 2) & whole, F.struct(pair, items)), f"__{side}_tuple": F.when((pair == "()") & whole, items),
            f"__{side}_set": F.coalesce(F.when((pair == "{}") & whole, F.array_sort(items)), F.when(~F.exists(bare, lambda i: i == ""), F.array_sort(bare))), f"__{side}_text": F.coalesce(F.when(undecided, plain), F.lit(False)),
        })
    norms = col("l", "norm") == col("r", "norm")
    df = df.withColumn("typed_match", F.coalesce("__choice", "__scalar", *map(both, ("interval", "tuple", "set")), F.when(col("l", "text") & col("r", "text"), norms), F.lit(False)))
    # letters are the normal forms of choices
    legacy = F.coalesce("__scalar", "__choice", norms & (col("r", "norm") != ""), F.lit(False))
    return df.withColumn("same", F.col("typed_match") | legacy).drop(*[c for c in df.columns if c.startswith(("__l_", "__r_")) or c in ("__choice", "__scalar")])


def typed_match(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ``typed_match``: whether the first kind that both sides have is the same in both: U18, U29."""
    named = rows.withColumnsRenamed({"same": "__own_same"})
    return _compared(named, left, right).drop("same").withColumnsRenamed({"__own_same": "same"})


def legacy_match(prediction: Column, gold: Column) -> Column:
    """Scalar cores where both have one, else normal forms: U20."""
    core = lambda x: F.nullif(let(scalar_core(x), lambda t: F.when(t.isNotNull(), normalized(t))), F.lit(""))
    forms = lambda x, name: F.struct(core(x).alias("core"), normalized(x).alias("norm")).alias(name)
    both = let(F.struct(prediction.alias("p"), gold_answer(gold).alias("g")), lambda s: F.struct(forms(s["p"], "p"), forms(s["g"], "g")))
    return let(both, lambda s: F.coalesce(s["p"]["core"] == s["g"]["core"], (s["p"]["norm"] == s["g"]["norm"]) & (s["g"]["norm"] != ""), F.lit(False)))


def length_penalty(reason: Column, submitted: Column, with_: float = -0.05, without: float = -0.20) -> Column:
    """U22."""
    return F.when(reason.isNull() | (F.lower(reason) == "stop"), 0.0).when(submitted, with_).otherwise(without)


def scored(rows: DataFrame, completion: str = "completion", gold: str = "gold", reason: str = "finish_reason", verify=None) -> DataFrame:
    """``rows`` with format_reward, answer_reward, length_reward, total_reward, is_correct: U21, U23, U28.

    ``verify``: an optional function of (prediction, gold) columns that may find them equal where the rules don't, such as
    ``equivalence.equivalent`` (U19).
    """
    df = inspected(rows, completion).withColumn("answer", F.nullif(strip(F.col("tail.answer")), F.lit(""))).withColumn("__gold", gold_answer(F.col(gold)))
    df = _compared(df.withColumnsRenamed({"same": "__own_same"}), "answer", "__gold")
    submitted = F.col("answer").isNotNull()
    open_ = lambda c: F.when(submitted & ~F.col("same"), c)  # noqa: E731  what the rules have settled isn't verified
    same = F.col("same") | F.coalesce(verify(open_(F.col("answer")), open_(F.col("__gold"))), F.lit(False)) if verify else F.col("same")
    cut = F.coalesce(F.lower(reason) != "stop", F.lit(False))
    correct = submitted & same & ~(cut & ~submitted)
    standard = F.coalesce(F.col("tail.standard"), F.lit(False)) & F.col("tail.answer").isNotNull()
    single = standard & (F.size("final_lines") == 1) & F.col("tail.boxed").isNotNull() & (normalized(F.col("tail.boxed")) == normalized(F.col("tail.answer")))
    points = lambda flag, x: F.when(F.coalesce(flag, F.lit(False)), x).otherwise(0.0)
    df = df.withColumn("is_correct", correct).withColumn("format_reward", F.round(points(standard, 0.10) + points(F.col("last_is_final"), 0.05) + points(single, 0.05), 6))
    df = df.withColumn("answer_reward", points(F.col("is_correct"), 1.0)).withColumn("length_reward", length_penalty(F.col(reason), submitted))
    return df.withColumn("total_reward", F.round(F.col("format_reward") + F.col("answer_reward") + F.col("length_reward"), 6)).drop("__gold", "same").withColumnsRenamed({"__own_same": "same"})


def parse_label(parsed: Column, violations: Column, enabled: bool = True, available: bool = True, enforce: bool = False) -> Column:
    """What a log says about a parsed answer: U30."""
    prefix = F.when(F.lit(enforce) & (F.size(violations) > 0), F.concat(F.lit("<invalid_format: "), F.array_join(violations, ", "), F.lit("> "))).otherwise("")
    body = F.lit("<verification disabled>") if not enabled else F.lit("<verification unavailable>") if not available else F.coalesce(F.nullif(parsed, F.lit("")), F.lit("<unparsed>"))
    return F.concat(prefix, body)
