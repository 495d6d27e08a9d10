"""Secret scans with a trigram inverted index.

Each rule's parsed regular expression yields a Boolean query over trigrams that every match must contain: what stands
side by side is strings whose trigrams are all needed, alternatives are an OR, and what may be left out or may be many
things ends a string.  A block of documents is indexed by trigram (lower-cased bytes; postings are sorted document
numbers), the queries intersect and unite postings, and only the documents left are searched with the expression.  Rules
without mandatory trigrams (runs of hex digits) scan every text.

The index holds the trigrams that some rule asks for, so its size per block is bounded by rules times documents.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as _re
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, trimmed
from .text import text_buffer


@dataclass(frozen=True)
class Rule:
    """``least``: code points that ``group`` of a match must have; shorter matches are dropped, without a retry."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False

    def spans(self, text: str):
        for m in re.compile(self.pattern).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least:
                yield m.start(), m.end()


def any_case(word: str) -> str:
    """The word with ASCII letters in either case, as character classes."""
    return "".join(f"[{c.upper()}{c}]" if c.isascii() and c.isalpha() else re.escape(c) for c in word)


_KEYS = ("password", "passwd", "secret", "token")

#: The contract's three kinds, then published formats of well-known credentials.
RULES = (
    Rule("assign", "(" + "|".join([*map(any_case, _KEYS), any_case("api") + "_?" + any_case("key")]) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12, True),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18, True),
    # a run of under 16 digits would be dropped anyway, so only long runs are looked for
    Rule("hex", "(?<![0-9a-f])[0-9a-f]{16,}", 0, 16, True),
    Rule("session", r"(?<![A-Z0-9])ASIA[A-Z0-9]{16}(?![A-Z0-9])"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("google", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
)


#: How many characters a class, and how many strings a stretch of an expression, may stand for before its string ends.
CHARACTERS, STRINGS = 8, 64
#: What letters also match where case is ignored beyond ASCII.
_ALSO = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def trigrams(literal: str) -> list[int]:
    """Codes of the literal's trigrams of bytes, A-Z lower-cased."""
    b = "".join(c.lower() if c.isascii() else c for c in literal).encode("utf-8", "surrogatepass")
    return sorted({b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)})


def all_of(parts: list) -> tuple | None:
    """AND of queries; one that asks for nothing is None."""
    parts = [p for p in parts if p is not None]
    return parts[0] if len(parts) == 1 else ("all", parts) if parts else None


def any_of(parts: list) -> tuple | None:
    """OR of queries; nothing is asked for where one asks for nothing."""
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("any", parts)


def one_of(strings: set[str]) -> tuple | None:
    """The query for one of ``strings``: what has the trigrams of another one needn't be asked for."""
    own = sorted({frozenset(trigrams(s)) for s in strings}, key=lambda t: (len(t), sorted(t)))
    least = [t for i, t in enumerate(own) if not any(u <= t for u in own[:i])]
    return any_of([("all", sorted(t)) if t else None for t in least])


def _characters(items, flags: int) -> set[str] | None:
    """The characters, A-Z lower-cased, that a class has, or None if these are too many or not listed."""
    found: set[str] = set()
    for op, value in items:
        if op is _re.LITERAL:
            points = [value]
        elif op is _re.RANGE and value[1] - value[0] < 64:
            points = range(value[0], value[1] + 1)
        else:
            return None
        for c in map(chr, points):
            if flags & re.IGNORECASE and not c.isascii():
                return None
            c = c.lower() if c.isascii() else c
            found |= {c, *(_ALSO.get(c, "") if flags & re.IGNORECASE and not flags & re.ASCII else "")}
    return found if len(found) <= CHARACTERS else None


def _derived(nodes, flags: int) -> tuple[set[str] | None, tuple | None]:
    """(the strings that a sequence of parsed nodes stands for, or None, the query for what they don't say)."""
    strings, queries, exact = {""}, [], True

    def end() -> None:
        nonlocal strings, exact
        queries.append(one_of(strings))
        strings, exact = {""}, False

    for op, value in nodes:
        own, query = None, None
        if op is _re.AT or op in (_re.ASSERT, _re.ASSERT_NOT):
            continue  # take no characters
        if op is _re.LITERAL:
            own = _characters([(op, value)], flags)
        elif op is _re.IN:
            own = _characters(value, flags)
        elif op is _re.SUBPATTERN:
            own, query = _derived(value[3], (flags | value[1]) & ~value[2])
        elif op is _re.ATOMIC_GROUP:
            own, query = _derived(value, flags)
        elif op is _re.BRANCH:
            ways = [_derived(way, flags) for way in value[1]]
            if all(w is not None for w, _ in ways):
                own = set().union(*[w for w, _ in ways])
            else:
                query = any_of([q if w is None else one_of(w) for w, q in ways])
        elif op in (_re.MAX_REPEAT, _re.MIN_REPEAT, _re.POSSESSIVE_REPEAT):
            least, most, body = value
            way, inner = _derived(body, flags)
            if (least, most) == (0, 1):
                own = None if way is None else way | {""}
            elif least:
                if way is not None and len(way) ** min(least, 8) <= STRINGS:
                    for _ in range(min(least, 8)):
                        if len(strings) * len(way) > STRINGS:
                            end()
                        strings = {a + b for a in strings for b in way}
                    if most == least <= 8:
                        continue
                query = inner if way is None else one_of(way)
        if own is None or len(own) > STRINGS:
            end()
            queries.append(query if own is None else one_of(own))
            continue
        if len(strings) * len(own) > STRINGS:
            end()
        strings = {a + b for a in strings for b in own}
    if exact:
        return strings, None
    end()
    return None, all_of(queries)


def trigram_query(rule: Rule) -> tuple | None:
    """The Boolean query that follows from the rule's expression: ("all" or "any", trigrams and queries).

    None if no trigram is mandatory, so that a scan is needed.
    """
    parsed = _parser.parse(rule.pattern)
    strings, query = _derived(parsed, parsed.state.flags)
    return query if strings is None else one_of(strings)


def codes_of(query: tuple | int | None) -> set[int]:
    """All trigrams that a query asks for."""
    return set() if query is None else {query} if isinstance(query, int) else set().union(*map(codes_of, query[1]))


class BlockIndex:
    """Postings of a block of texts for the trigrams in ``vocabulary`` (a table of 2**24 flags)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray):
        self.n = len(offsets) - 1
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
        pairs = [np.zeros(0, np.int64)]
        for lo in range(0, max(0, len(low) - 2), 1 << 20):  # sections, so that codes take little memory
            part = low[lo : lo + (1 << 20) + 2]
            codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
            at = np.flatnonzero(vocabulary[codes])
            doc = np.searchsorted(offsets, at + lo, "right") - 1
            inside = at + lo + 3 <= offsets[doc + 1]
            pairs.append(codes[at[inside]].astype(np.int64) << 32 | doc[inside])
        pairs = np.unique(np.concatenate(pairs))
        self.codes, first = np.unique(pairs >> 32, return_index=True)
        self.postings = np.split(pairs & 0xFFFFFFFF, first[1:]) if len(self.codes) else []

    def posting(self, code: int) -> np.ndarray:
        i = np.searchsorted(self.codes, code)
        return self.postings[i] if i < len(self.codes) and self.codes[i] == code else np.zeros(0, np.int64)

    def candidates(self, query: tuple | int) -> np.ndarray:
        """The documents that have what ``query`` asks for."""
        if isinstance(query, int):
            return self.posting(query)
        found = sorted(map(self.candidates, query[1]), key=len)  # the shortest first
        if query[0] == "any":
            return np.unique(np.concatenate(found))
        out = found[0]
        for more in found[1:]:
            out = out[np.isin(out, more, assume_unique=True)] if len(out) else out
        return out


class Scanner:
    """Searches batches of texts with ``rules``: an index of the batch, the rules' queries, then the candidates."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.queries = rules, [trigram_query(r) for r in rules]
        self.vocabulary = np.zeros(1 << 24, bool)
        self.vocabulary[sorted(set().union(*map(codes_of, self.queries)))] = True

    def spans(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, nth rule, end) of what each text has, in order; a null text has nothing."""
        data, offsets = text_buffer(texts)
        index, spans, decoded = BlockIndex(data, offsets, self.vocabulary), [[] for _ in range(len(texts))], {}
        for nth, (rule, query) in enumerate(zip(self.rules, self.queries, strict=True)):
            for i in index.candidates(query) if query is not None else range(index.n):
                text = decoded.get(i)
                if text is None:
                    text = decoded[i] = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                spans[i] += [(s, nth, e) for s, e in rule.spans(text)]
        return [sorted(x) for x in spans]


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a column ``secrets``: array<struct<kind string, start int, end int>> by start, then rule order.

    Offsets are code points, ends exclusive.  Null texts count as empty and get an empty array; all other columns pass
    unchanged, but one named ``secrets`` is replaced.  Repeated rows each get their own; an empty table gives an empty
    result.  Runs where the rows are: no shuffle.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != "secrets"]
    docs = docs.select(*[f"`{c}`" for c in kept])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        scanner = Scanner(rules)
        for batch in batches:
            found = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.spans(batch.column(kept.index("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*kept, "secrets"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(trimmed(scan), f"{fields}, secrets array<struct<kind string, start int, end int>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "<secret:{}>") -> DataFrame:
    """``docs`` with every secret in the text replaced by its masked kind; overlapping spans become one.

    Null texts stay null; texts without a secret stay as they are; all columns pass.
    """
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    at_text = columns.index("text")

    def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
        parts, at = [], 0
        for start, k, end in spans:
            if start >= at:
                parts += [text[at:start], mask.format(rules[k].kind)]
            at = max(at, end)
        return "".join([*parts, text[at:]])

    def replace(batches):
        scanner = Scanner(rules)
        for batch in batches:
            texts = batch.column(at_text)
            found = scanner.spans(texts)
            texts = [replaced(t, x) if x else t for t, x in zip(texts.to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_text], pa.array(texts, batch.column(at_text).type), *batch.columns[at_text + 1 :]], columns)

    return docs.mapInArrow(trimmed(replace), docs.schema)


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans of the scan's result."""
    bounded_batches(docs.sparkSession)
    base = [i for i, r in enumerate(rules) if r.base]

    def digests(batches):
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.spans(batch.column(1))
            of = lambda spans: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)
            counts = [pa.array([sum(k == i for _, k, _ in x) for x in found], pa.int64()) for i in base]
            sha = pa.array([hashlib.sha256(of([s for s in x if s[1] in base]).encode()).hexdigest() for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([of(x) for x in found], pa.string())], ["doc_id", *[f"n_{rules[i].kind}" for i in base], "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(trimmed(digests), "doc_id long, " + "".join(f"n_{rules[i].kind} long, " for i in base) + "base_sha256 string, spans string")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
