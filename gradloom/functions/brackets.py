"""Boxes and lists in brackets of any depth, as folds over a text's brackets: linear in its length, in built-in expressions."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MARKER = "\\boxed"
_MOST_KEPT = 64  # expressions of a function
#: What a box without braces may hold.  Fixed values.
BARE = r"\\[a-zA-Z]+(?:\{[^{}]*\})*|\([^()\n]*\)|\[[^\[\]\n]*\]|[-+]?[^\s,;:!?]+"


def reused(f):
    """A function of one column whose expression for a named column is built once and then kept.

    Building takes thousands of calls to the JVM, which a query that runs again, or uses a name twice, needn't repeat.
    Expressions of anything but a plain name are built anew.
    """
    kept: dict = {}

    @wraps(f)
    def build(c: Column, *more, **options) -> Column:
        node = c._jc.node() if hasattr(c, "_jc") else None
        if node is None or node.getClass().getSimpleName() != "UnresolvedAttribute":
            return f(c, *more, **options)
        jvm = SparkContext._gateway
        key = (id(jvm), str(c._jc.toString()), more, tuple(sorted(options.items())))
        if key not in kept:
            if len(kept) >= _MOST_KEPT:
                kept.clear()
            kept[key] = (jvm, f(c, *more, **options))  # holds on to the gateway, so that its id stays its own
        return kept[key][1]

    return build


def let(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _closed(text: Column) -> Column:
    """Array of (at, end): where the content of a braced box begins and its brace closes, for boxes that close."""
    opened, ended = "array<struct<depth:int,at:int>>", "array<struct<at:int,end:int>>"
    start = F.struct(F.lit(1).alias("pos"), F.lit(0).alias("depth"), F.array().cast(opened).alias("open"), F.array().cast(ended).alias("ends"))

    def step(s: Column, token: Column) -> Column:
        opens, closes = F.endswith(token, F.lit("{")), token == "}"
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        last = F.try_element_at(s["open"], F.lit(-1))
        hit = closes & F.coalesce(last["depth"] == depth, F.lit(False))
        after = s["pos"] + F.length(token)
        box = F.struct(s["depth"].alias("depth"), after.alias("at"))
        still = F.when(opens & (F.length(token) > 1), F.concat(s["open"], F.array(box))).when(hit, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).otherwise(s["open"])
        ends = F.when(hit, F.concat(s["ends"], F.array(F.struct(last["at"].alias("at"), s["pos"].alias("end"))))).otherwise(s["ends"])
        return F.struct(after.alias("pos"), depth.alias("depth"), still.alias("open"), ends.alias("ends"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(r"(\\boxed\s*\{|[{}]|[^{}\\]+|\\)"), 1), start, step, lambda s: s["ends"])


def box_spans(text: Column) -> Column:
    """Array of (content, start, after, braced) of the boxes of a text in order, at any depth.

    A braced box whose brace never closes, and one without braces, hold what ``BARE`` finds.  The search goes on after a
    box, so boxes within boxes don't count.  Contents are stripped; those without braces lose closing marks.
    """

    def with_ends(x: Column) -> Column:
        text, ends = x["text"], x["ends"]
        out = "array<struct<content:string,start:int,after:int,braced:boolean>>"
        start = F.struct(F.lit(1).alias("pos"), F.lit(1).alias("resume"), F.array().cast(out).alias("out"))

        def step(s: Column, part: Column) -> Column:
            """``part`` is what stands before the next marker, ``pos`` where it begins; the marker is just before it."""
            begin = s["pos"] - len(MARKER)
            rest = lambda at: F.substring(text, at, F.length(text))
            # one after the other, so that each is computed once, and nothing for a marker within a box
            at = F.when(begin >= s["resume"], s["pos"] + F.length(F.regexp_extract(part, r"^(\s*)", 1)))
            closed = lambda at: F.struct(at.alias("at"), F.try_element_at(F.filter(ends, lambda e: e["at"] == at + 1), F.lit(1))["end"].alias("end"))
            read = lambda h: F.struct(h["at"].alias("at"), h["end"].alias("end"), F.when(h["at"].isNotNull() & h["end"].isNull(), F.regexp_extract(rest(h["at"]), rf"^({BARE})", 1)).alias("bare"))

            def box(h: Column) -> Column:
                inside = F.when(h["end"].isNotNull(), strip(F.substring(text, h["at"] + 1, h["end"] - h["at"] - 1))).otherwise(F.regexp_replace(strip(h["bare"]), r"[.,;:!?]+$", ""))
                after = F.when(h["end"].isNotNull(), h["end"] + 1).otherwise(h["at"] + F.greatest(F.length(h["bare"]), F.lit(1)))
                return F.struct(inside.alias("content"), begin.alias("start"), after.alias("after"), h["end"].isNotNull().alias("braced"))

            def longer(x: Column) -> Column:
                out = F.when(F.length(x["content"]) > 0, F.concat(s["out"], F.array(x))).otherwise(s["out"])
                return F.struct((s["pos"] + F.length(part) + len(MARKER)).alias("pos"), F.coalesce(x["after"], s["resume"]).alias("resume"), out.alias("out"))

            return let(let(let(let(at, closed), read), box), longer)

        parts = F.split(text, r"\\boxed", -1)
        first = F.struct((F.length(parts[0]) + 1 + len(MARKER)).alias("pos"), start["resume"].alias("resume"), start["out"].alias("out"))
        return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), first, step, lambda s: s["out"])

    return let(F.struct(text.alias("text"), _closed(text).alias("ends")), with_ends)


def split_at_commas(text: Column) -> Column:
    """Parts between the commas outside all brackets, unstripped.  Brackets are counted per kind, closing ones too many don't count."""
    start = F.struct(F.lit(1).alias("pos"), *[F.lit(0).alias(x) for x in "rsb"], F.array().cast("array<int>").alias("cuts"))

    def step(s: Column, token: Column) -> Column:
        depth = lambda f, a, b: F.when(token == a, s[f] + 1).when(token == b, F.greatest(F.lit(0), s[f] - 1)).otherwise(s[f]).alias(f)
        cut = (token == ",") & (s["r"] + s["s"] + s["b"] == 0)
        return F.struct((s["pos"] + F.length(token)).alias("pos"), depth("r", "(", ")"), depth("s", "[", "]"), depth("b", "{", "}"), F.when(cut, F.concat(s["cuts"], F.array(s["pos"]))).otherwise(s["cuts"]).alias("cuts"))

    cuts = F.aggregate(F.regexp_extract_all(text, F.lit(r"([()\[\]{},]|[^()\[\]{},]+)"), 1), start, step, lambda s: s["cuts"])
    whole = lambda x: F.zip_with(F.concat(F.array(F.lit(0)), x["cuts"]), F.concat(x["cuts"], F.array(F.length(x["text"]) + 1)), lambda a, b: F.substring(x["text"], a + 1, b - a - 1))
    return let(F.struct(text.alias("text"), cuts.alias("cuts")), whole)
