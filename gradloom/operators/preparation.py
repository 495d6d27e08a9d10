"""Corpus preparation: projections with defaults, reason-coded drops counted while the rest is written, length filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import text as X

#: Sources that the contest corpus is taken from (fixed values).
CONTEST_SOURCES = ("olympiads", "olympiads_ref", "amc_aime", "cn_contest", "inequalities", "number_theory")
MATRIX_MARKS = ("\\begin{pmatrix}", "\\begin{bmatrix}", "\\begin{matrix}", "\\begin{cases}")


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of a schema in its order: missing ones null, others cast where they can be: section 1.3."""
    return df.select(*[(F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def normalized_problem(df: DataFrame) -> DataFrame:
    """problem, answer, source, domain, solve_rate with their defaults: P1."""
    rate = F.coalesce(F.expr("try_cast(solve_rate AS double)"), F.lit(-1.0))
    source = F.coalesce(X.blank_to_null(F.col("source")), F.lit("big_math"))
    domain = F.when(F.col("domain").isNull(), F.array().cast("array<string>")).otherwise(F.array("domain"))
    return df.select("row_id", X.or_empty(F.col("problem")).alias("problem"), X.or_empty(F.col("answer")).alias("answer"), source.alias("source"), domain.alias("domain"), rate.alias("solve_rate"))


def sanitized(c: Column) -> Column:
    """An extracted answer on one line, without enclosing dollars: P2."""
    t = F.regexp_replace(F.regexp_replace(F.replace(X.strip(c), F.lit("\\$"), F.lit("$")), f"{X.BLANK}+", " "), r"^\$\x20+", r"\$")
    dollars = lambda t: F.length(t) - F.length(F.replace(t, F.lit("$"), F.lit("")))
    inner = lambda t: F.when((F.length(t) >= 2) & F.rlike(t, F.lit(r"^\$.*\$$")), F.substring(t, F.lit(2), F.length(t) - 2)).when(F.endswith(t, F.lit("$")) & (dollars(t) == 1), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)
    return X.strip(A.let(t, inner))


def is_verbose(c: Column) -> Column:
    """An answer that reads like an explanation: F3."""
    words = F.regexp_count(F.regexp_replace(c, r"\\[A-Za-z]+", " "), F.lit("[A-Za-z]{2,}"))
    matrix = [F.contains(c, F.lit(m)) for m in MATRIX_MARKS]
    return (F.length(c) > 80) & ~(matrix[0] | matrix[1] | matrix[2] | matrix[3]) & (words >= 8)


def competition_reason(answer: Column, solution: Column) -> Column:
    """Why an extracted answer is invalid, null if it isn't: F2."""
    low = F.lower(answer)
    return (
        F.when(X.strip(answer) == "", "empty_answer")
        .when(A.normalized(answer) == A.normalized(solution), "answer_equals_solution")
        .when(F.contains(low, F.lit("boxed")) | F.contains(low, F.lit("final answer")), "contains_format_marker")
        .when(is_verbose(answer), "verbose_explanation")
    )


def contest_reason(answer: Column, question_type: Column, source: Column) -> Column:
    """F4."""
    low = F.lower(X.strip(answer))
    return F.when(question_type != "math-word-problem", "question_type_mismatch").when(low.isin("proof", "notfound"), F.concat(F.lit("answer_"), low)).when(~source.isin(*CONTEST_SOURCES), "source_not_allowed")


def with_drop_reason(df: DataFrame, invalid: Column | None = None) -> DataFrame:
    """``drop_reason``: the first rule that fails, null for rows to keep: F1."""
    reason = F.when(F.col("problem") == "", "empty_problem").when(F.col("answer") == "", "empty_answer")
    return df.withColumn("drop_reason", reason.when(invalid.isNotNull(), invalid) if invalid is not None else reason)


def drop_counts(df: DataFrame) -> DataFrame:
    """A1."""
    return df.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def prepared(df: DataFrame, path: str, reasons: tuple[str, ...], length: str | None = None, most: int | None = None) -> tuple[DataFrame, dict]:
    """Writes the rows of ``df`` (with ``drop_reason``) to keep as a table at ``path``, counted in the same pass: F1, F5, F14, A1.

    Returns the table and counts: input, kept, a count per reason of ``reasons``, ``other``; with ``length`` and ``most`` also
    too_long (what the length filter drops, after the reasons) and max_seen, max_kept.  The counts are metrics that tasks
    report with their results, so there is one job, and a task that is run again counts once.
    """
    reason, fits = F.col("drop_reason"), F.lit(True) if most is None else F.coalesce(F.col(length) <= most, F.lit(False))
    how_many = lambda condition: F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))
    named = {"input": F.count(F.lit(1)), "kept": how_many(reason.isNull() & fits), "other": how_many(reason.isNotNull() & ~reason.isin(*reasons)), **{r: how_many(reason == r) for r in reasons}}
    if most is not None:
        longest = lambda condition: F.coalesce(F.max(F.when(condition, F.col(length))), F.lit(0))
        named |= {"too_long": how_many(reason.isNull() & ~fits), "max_seen": longest(reason.isNull()), "max_kept": longest(reason.isNull() & fits)}
    seen = Observation()
    df.observe(seen, *[c.alias(n) for n, c in named.items()]).where(reason.isNull() & fits).drop("drop_reason").write.parquet(path)
    return df.sparkSession.read.parquet(path), dict(seen.get)


def length_summary(df: DataFrame, length: str, most: int) -> DataFrame:
    """Kept and removed rows and the lengths seen, 0 where there are none: F5."""
    fits = F.col(length) <= most
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return df.agg(zero(F.sum(fits.cast("int"))).alias("kept"), zero(F.sum((~fits).cast("int"))).alias("removed"), zero(F.max(length)).alias("max_seen"), zero(F.max(F.when(fits, F.col(length)))).alias("max_kept"), zero(F.min(length)).alias("min_seen"))


def sft_example(prompt: Column, response: Column, answer: Column) -> Column:
    """Prompt and response, with the final answer appended unless the response has it in any case: P6."""
    has = F.contains(F.lower(response), F.lower(F.concat(F.lit("final answer: "), answer)))
    return F.concat(prompt, F.when(has, response).otherwise(F.concat(response, F.lit("\n\nFinal Answer: "), answer)))


def truncated_pair(prompt: Column, response: Column, most: int, eos: int) -> Column:
    """struct(ids, labels): the response is kept, the prompt loses its head, the end is forced; labels are -100 over the prompt: P7."""
    ended = F.when(F.coalesce(F.try_element_at(response, F.lit(-1)) == eos, F.lit(False)), response).otherwise(F.concat(response, F.array(F.lit(eos).cast("bigint"))))
    cut = F.when(F.size(ended) > most, F.concat(F.slice(ended, 1, most - 1), F.array(F.lit(eos).cast("bigint")))).otherwise(ended)

    def pair(r: Column) -> Column:
        room = F.greatest(F.lit(0), most - F.size(r))
        head = F.when(room == 0, F.slice(prompt, 1, 0)).when(F.size(prompt) > room, F.slice(prompt, F.size(prompt) - room + 1, room)).otherwise(prompt)
        return F.struct(F.concat(head, r).alias("ids"), F.concat(F.array_repeat(F.lit(-100).cast("bigint"), F.size(head)), r).alias("labels"))

    return A.let(cut, pair)


def flattened(messages: DataFrame, by: str, order: str, text: str, reason: str | None = None) -> DataFrame:
    """Messages of a conversation joined by line ends in order; the first non-null finish reason wins: P12."""
    parts = F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t"))))
    more = [F.min_by(reason, F.when(F.col(reason).isNotNull(), F.col(order))).alias("finish_reason")] if reason else []
    return messages.groupBy(by).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("text"), F.count("*").alias("n"), *more)
