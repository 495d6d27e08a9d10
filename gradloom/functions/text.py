"""Column functions for text: stripping, previews, slugs, paths, templates, keys, verdicts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and str.splitlines treat as blank or as a line's end (fixed values).
BLANK = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def or_empty(c: Column, none_text: bool = False) -> Column:
    """Null as an empty string, or as the word None where a source writes it: section 1.2."""
    return strip(F.coalesce(c, F.lit("None" if none_text else "")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def preview(c: Column, limit: int = 400) -> Column:
    """One line, cut with a mark: P5."""
    flat = strip(F.replace(F.coalesce(c, F.lit("None")), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit), F.lit("...<truncated>")))


def render(template: str, fields: dict[str, Column]) -> Column:
    """``{name}`` becomes the field; unknown names stay as written, doubled braces become single ones: P4."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{(\w+)\}", template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m.group(1) is None:
            parts.append(F.lit(m.group()[0]))
        else:
            parts.append(F.coalesce(fields[m.group(1)].cast("string"), F.lit("None")) if m.group(1) in fields else F.lit(m.group()))
    return F.concat(*parts, F.lit(template[at:]))


def slug(c: Column, default: str = "eval") -> Column:
    """P10."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")), F.lit("")), F.lit(default))


def base_name(path: Column) -> Column:
    """Last part of a path with either slash: P11."""
    return F.element_at(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)


def parent_name(path: Column) -> Column:
    return F.coalesce(F.try_element_at(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), F.lit(-2)), F.lit(""))


def verdict(c: Column) -> Column:
    """The last whole word yes or no, as a boolean; null where there is none: P18."""
    return F.lower(F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)\b(yes|no)\b"), 1), F.lit(-1))) == "yes"


def fingerprint(c: Column) -> Column:
    """SHA-1 of a response with blanks collapsed, in lower case: P20."""
    return F.sha1(F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{BLANK}+", " "))))


def cache_key(c: Column) -> Column:
    """An answer as verdicts are cached by: boxes opened to the end, delimiters, spacing and blanks removed: P19.

    A box opens once its content nests one level at most; every pass opens some, so as many passes as there are boxes do.
    """
    box = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
    n = F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\\boxed\{"))
    passes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(passes, F.coalesce(c, F.lit("")), lambda text, _: F.when(F.contains(text, F.lit("\\boxed{")), F.regexp_replace(text, box, "$1")).otherwise(text))
    out = F.regexp_replace(out, r"\$+|\\[()\[\]]|\\[,!;]|\\left|\\right", "")
    return F.lower(F.regexp_replace(F.regexp_replace(out, f"{BLANK}+", ""), r"[.,;:!?]+$", ""))


def run_seed(base: Column, *parts: Column) -> Column:
    """base + the first 12 hex digits of sha256(parts joined by ::) modulo 10**9: P21."""
    digest = F.sha2(F.concat_ws("::", *[p.cast("string") for p in parts]), 256)
    return base + F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % 1_000_000_000


def json_object(c: Column) -> Column:
    """The first of the text, a fenced block and the outermost braces that parses to an object, as a variant: P17."""
    text = strip(c)
    outer = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    found = [F.try_parse_json(x) for x in (text, fenced, outer)]
    return F.coalesce(*[F.when(F.schema_of_variant(v).startswith("OBJECT"), v) for v in found])


def finish_reason(c: Column) -> Column:
    """P13."""
    return blank_to_null(c)


def token_count(c: Column, tokenizer: Callable[[Column], Column] | None = None) -> Column:
    """Words between blanks, the tokenizer that needs no files, or the length of what ``tokenizer`` makes of a text: P14.

    ``tokenizer`` maps a string column to an array column, such as an Arrow function over a vocabulary; null counts 0.
    """
    if tokenizer is not None:
        return F.size(tokenizer(F.coalesce(c, F.lit("")))).cast("bigint")
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\S+")).cast("bigint")


def parse_bool(c: Column) -> Column:
    """Words for yes and no as a boolean; anything else is an error, null stays null: P24."""
    word = F.lower(strip(c.cast("string")))
    return F.when(word.isin("1", "true", "yes", "on", "y"), True).when(word.isin("0", "false", "no", "off", "n"), False).when(word.isNotNull(), F.raise_error(F.concat(F.lit("no boolean: "), word)))


def int_list(c: Column) -> Column:
    """Whole numbers between commas; blanks and empty parts don't count: P24."""
    return F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != ""), lambda x: x.cast("bigint"))


def combined(values: Column, separator: str = ", ") -> Column:
    """The values that aren't blank, joined; null if there are none: A22."""
    return F.nullif(F.array_join(F.filter(F.transform(values, strip), lambda x: x != ""), separator), F.lit(""))


def metric_values(c: Column) -> Column:
    """The booleans, numbers, strings and nulls of a JSON object, as variants by name; lists and objects are dropped: P31."""
    kind = lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return F.map_filter(F.from_json(c, "map<string,variant>"), lambda _, v: ~F.startswith(kind(v), F.lit("ARRAY")) & ~F.startswith(kind(v), F.lit("OBJECT")))
