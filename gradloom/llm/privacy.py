"""Personal data: exact base patterns and a semi-Markov conditional random field over candidate segments.

The field scores whole segments of up to ``LONGEST`` tokens: digit counts, grouping, separators, checksums, address
ranges, the characters that adjoin, cue words before.  A text's segmentation is the best-scoring one, found by dynamic
programming that chooses boundaries and types jointly; tokens outside entities score 0, so only the stretches that some
candidate segment covers need the program.  Weights are fitted by maximum likelihood (forward and backward sums over all
segmentations) to sentences that a seeded generator writes from published formats, with look-alikes that are no
personal data; the corpus has no part in the training.

Spans of the field that meet no base span are added to the base spans.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents

LONGEST, MOST = 20, 80  # tokens in a segment: blanks and brackets left out, and in all
KINDS = ("email", "ip", "card", "phone", "ssn")
BASE_KINDS = KINDS[:4]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def email_spans(text: str):
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time.

    The part before a sign is the whole run of its characters, as far as the last match leaves it.
    """
    free = 0
    for sign in re.finditer("@", text):
        at = first = sign.start()
        domain = _DOMAIN.match(text, at + 1)
        while domain and first > free and text[first - 1] in _LOCAL:
            first -= 1
        if first < at:
            free = domain.end()
            yield first, free


def ip_spans(text: str):
    """Leftmost matches of four dotted numbers of at most 255, in linear time: a row of dotted numbers is dealt in fours."""
    for row in _DOTTED.finditer(text):
        parts, at = row.group().split("."), row.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in four):
                yield at, end
            at = end + 1


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; matches that fail their test are dropped."""
    out = [("email", *s) for s in email_spans(text)]
    if "." in text:
        out += [("ip", *s) for s in ip_spans(text)]
    for m in _CARD.finditer(text):
        if 13 <= len(m.group()) and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[\x20\t]+|[^A-Za-z0-9\x20\t]")
_CUES = {
    "email": {"mail", "email", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "from", "address"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"},
    "phone": {"tel", "telephone", "phone", "call", "mobile", "cell", "fax", "dial", "number"},
    "ssn": {"ssn", "social", "security"},
}
_AT, _DOT = {"at"}, {"dot"}
_GAPS = " \t()[]{}"
CONTEXT = 8  # tokens that are looked at before and after a candidate


def foreign(token: str) -> bool:
    """Whether no address holds the token (gaps left out)."""
    return not token.isalnum() and token not in "._%+-@"


def parted(a: str, b: str) -> bool:
    """Whether two tokens with blanks or brackets alone between them belong to no common address."""
    return {a, b}.isdisjoint(_AT | _DOT | {"@"})


class Stretch:
    """Tokens of a piece of text; ``segments`` of a range of first tokens: (first, end, feature names).

    An address is unbroken: it holds no ``foreign`` character, and what has blanks or brackets between is joined by "at",
    "@" or "dot".  A number has digits and its separators alone.
    """

    def __init__(self, words: list[str], starts: list[int]):
        self.words, self.starts, self.ends = words, starts, [s + len(w) for s, w in zip(starts, words, strict=True)]
        self._low = low = [w.lower() for w in words]
        # digits and signs of addresses up to each token, and tokens that count towards the longest segment
        self._signs = list(accumulate((t[0].isdigit() and len(t) or 7 * (t == "@" or t in _AT) for t in low), initial=0))
        self._marks = sum(t == "@" or t in _AT for t in low)
        self._counted = list(accumulate((t[0] not in _GAPS for t in words), initial=0))
        # for every first token: the next sign of an address, the next dot, where an address and where a number has to end
        n = len(words)
        self._at, self._dot, self._address, self._number = [n] * (n + 1), [n] * (n + 1), [n] * (n + 1), [n] * (n + 1)
        after, spaced = n, False
        for i in range(n - 1, -1, -1):
            t = low[i]
            self._at[i] = i if t == "@" or t in _AT else self._at[i + 1]
            self._dot[i] = i if t == "." or t in _DOT else self._dot[i + 1]
            self._address[i] = self._address[i + 1]
            if t[0] in _GAPS:
                spaced = True
            else:
                if foreign(t):
                    self._address[i] = i
                elif after < n and spaced and parted(t, low[after]):
                    self._address[i] = after
                after, spaced = i, False
            plus = i + 1 if i + 1 < n and words[i + 1] == "+" else n
            own = t[0].isdigit() or t[0] == " " or t in ".-()+/"
            self._number[i] = min(plus, self._number[i + 1]) if own else i

    @property
    def quiet(self) -> bool:
        """Whether there can't be candidates: no address has a dot after its sign, and no four digits are there."""
        return self._dot[self._at[0]] == len(self.words) and self._signs[-1] - 7 * self._marks < 4

    def segments(self, lo: int = 0, hi: int | None = None) -> list[tuple[int, int, list[str]]]:
        words, low, signs, counted, found = self.words, self._low, self._signs, self._counted, []
        n = len(words)
        for i in range(lo, n if hi is None else min(hi, n)):
            if not (words[i].isalnum() or words[i] in "+("):
                continue
            most = min(i + MOST, bisect_right(counted, counted[i] + LONGEST) - 1)
            at = self._at[i]
            address = range(self._dot[at] + 1, min(most, self._address[i]) + 1) if i < at else range(0)
            number = range(bisect_left(signs, signs[i] + 4, i), min(most, self._number[i]) + 1)
            if not address and not number:
                continue
            near = {low[k] for k in range(max(0, i - CONTEXT + 1), i) if words[k].isalpha()}
            cues = [f"cue:{kind}" for kind, names in _CUES.items() if near & names]
            for j in chain(number, address):
                if words[j - 1].isalnum() and (names := features(words, low, i, j)) is not None:
                    found.append((i, j, names + cues))
        return found


def features(tokens: list[str], low: list[str], i: int, j: int) -> list[str] | None:
    """Names of the features of tokens[i:j] as one segment, cues before it left out; None if it can't be an entity of any kind.

    ``low``: the tokens in small letters.
    """
    part, small = tokens[i:j], low[i:j]
    text = "".join(part)
    if text[0] in " \t" or text[-1] in " \t" or not (part[0].isalnum() or part[0] in "+(") or not part[-1].isalnum():
        return None
    before, after = (tokens[i - 1] if i else ""), (tokens[j] if j < len(tokens) else "")
    groups = [p for p in part if p[0].isdigit()]
    digits, letters = "".join(groups), [p for p in part if p[0].isalpha()]
    out = ["bias"]
    marked = "@" in part or not _AT.isdisjoint(small)
    if marked:
        if text[0] in "+(":
            return None
        at = next(k for k, p in enumerate(small) if p == "@" or p in _AT)
        left, right = part[:at], part[at + 1 :]
        dotted = sum(p == "." or p in _DOT for p in small[at + 1 :])
        if not dotted or not left:
            return None
        out += ["at:sign" if "@" in part else "at:word", f"dots:{min(dotted, 3)}", f"tld:{2 <= len(part[-1]) <= 6 and part[-1].isalpha()}"]
        word = "@" not in part
        if word:
            framed = all(k > 0 and part[k - 1] in "([{ " for k, p in enumerate(part) if p.lower() in _AT)
            bracketed, dotword = any(p in "([{" for p in part), any(p.lower() in _DOT for p in right)
            out += [f"framed:{bracketed}:{framed}", f"spoken:{bracketed}:{dotword}"]
            follows = [t.lower() for t in tokens[j : j + 4] if t[0] not in " \t()[]{}"]
            whole = all(part.count(a) == part.count(b) for a, b in ("()", "[]", "{}"))
            out += [f"ends:{part[-1].lower() in _DOT}", f"whole:{whole}", f"more:{follows[:1] == ['dot']}"]
        out.append(f"blanks:{min(2, sum(p[0] in ' ' for p in part))}:{word}")
        out.append(f"ats:{min(2, sum(p == '@' or p.lower() in _AT for p in part))}")
    elif len(digits) < 4 or letters or "+" in part[1:] or any(p not in " .-()+/" for p in part if not p[0].isdigit() and p[0] != " "):
        return None
    else:
        dots = part.count(".")
        if len(digits) < 7 and dots != 3:
            return None
        pattern = "-".join(str(len(g)) for g in groups)
        out += [f"groups:{min(len(groups), 7)}", f"digits:{min(len(digits), 20)}", f"pattern:{pattern}" if len(pattern) < 16 else "pattern:long"]
        out.append("separators:" + "".join(sorted({p[0] for p in part if not p[0].isdigit()})))
        out.append(f"plus:{part[0] == '+'}")
        out.append(f"parens:{'(' in part}:{part.count('(') == part.count(')')}:{part[0] == '('}")
        out.append(f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}:{13 <= len(digits) <= 19}")
        quad = len(groups) == 4 and dots == 3 and len(part) == 7
        out.append(f"quad:{quad}:{quad and all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
        if pattern == "3-2-4":
            out.append(f"area:{groups[0] not in ('000', '666') and groups[0] < '900' and groups[1] != '00' and groups[2] != '0000'}")
        if part.count("-") and len({p for p in part if p in '-./ '}) == 1 and len(groups[0]) == 4 and len(groups) == 3 and len(digits) <= 8:
            out.append("date")
    out.append(f"before:{before.isalnum()}:{before in ('.', '-', '/', '=', '$', '#', '_', ':') and before}")
    out.append(f"after:{after.isalnum()}:{after in ('-', '/', '%', '_', '@') and after}")
    if after == "." and j + 1 < len(tokens) and tokens[j + 1][0].isalnum():
        out.append("goes on")
    return out


_SIGN = re.compile(r"[0-9]+|@|(?i:\bat\b)")


def reach(text: str, sign: str, lo: int, hi: int, back: bool) -> tuple[int, int]:
    """Offsets how far an address with ``sign`` may go on, and ``CONTEXT`` tokens beyond, before ``hi`` (``back``) or after ``lo``.

    Words are read in windows that double until nothing is cut, so a word of any length is one token.
    """
    width, sign = 64, sign.lower()
    while True:
        a, b = (max(lo, hi - width), hi) if back else (lo, min(hi, lo + width))
        tokens = list(_TOKEN.finditer(text, a, b))
        if back:
            tokens.reverse()
        whole = (a, b) == (lo, hi)
        if not whole:
            tokens.pop()
        n = counted = 0
        last, spaced = sign, False
        for m in tokens:
            t = m.group().lower()
            if t[0] in _GAPS:
                spaced = True
            elif foreign(t) or spaced and parted(last, t) or counted == LONGEST:
                break
            else:
                counted, last, spaced = counted + 1, t, False
            n += 1
            if n == MOST:
                break
        if whole or n + CONTEXT <= len(tokens):
            place = lambda k: (hi if back else lo) if k == 0 else tokens[k - 1].start() if back else tokens[k - 1].end()
            return place(n), place(min(n + CONTEXT, len(tokens)))
        width *= 2


def stretches(text: str):
    """The parts of a text that can have candidate segments, one after another; everything else is outside entities.

    Signs (digits, @, "at") at most 40 characters apart, or with nothing between them that breaks an address, share one.
    """
    first = last = None
    floor = 0
    for m in chain(_SIGN.finditer(text), [None]):
        if first is not None:
            if m is not None and m.start() - last.end() <= 40:
                last = m
                continue
            ceiling = len(text) if m is None else m.start()
            end, hi = reach(text, last.group(), last.end(), ceiling, False)
            if m is not None and end == ceiling:
                last = m
                continue
            lo = reach(text, first.group(), floor, first.start(), True)[1]
            tokens = list(_TOKEN.finditer(text, lo, hi))
            yield Stretch([t.group() for t in tokens], [t.start() for t in tokens])
            floor = last.end()
        first = last = m


class SemiMarkov:
    """Weights of (feature, kind)."""

    def __init__(self, names: dict[str, int], weights: np.ndarray):
        self.names, self.weights = names, weights

    def scores(self, segments: list) -> np.ndarray:
        """(segments, kinds)"""
        return np.stack([self.weights[[self.names[n] for n in names if n in self.names]].sum(axis=0) for _, _, names in segments])

    def best(self, stretch: Stretch, block: int = 256) -> list[tuple[str, int, int]]:
        """The best segmentation's entities, by dynamic programming over token positions.

        A position's score is settled once all segments that start before it are known, so candidates are written out
        for ``block`` first tokens at a time, however long the stretch.
        """
        n = len(stretch.starts)
        if stretch.quiet:
            return []
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        for lo in range(0, n, block):
            found = stretch.segments(lo, lo + block)
            own = iter(())
            if found:
                scores = self.scores(found)
                own = zip(found, scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist(), strict=True)
            now = next(own, None)
            for t in range(lo, min(lo + block, n)):
                if t and best[t - 1] >= best[t]:
                    best[t], back[t] = best[t - 1], None
                while now is not None and now[0][0] == t:
                    (_, j, _), kind, score = now
                    if best[t] + score > best[j]:
                        best[j], back[j] = best[t] + score, (t, kind)
                    now = next(own, None)
        if n and best[n - 1] >= best[n]:
            back[n] = None
        out, t = [], n
        while t:
            if back[t] is None:
                t -= 1
            else:
                i, kind = back[t]
                out.append((KINDS[kind], stretch.starts[i], stretch.ends[t - 1]))
                t = i
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for stretch in stretches(text):
            # two stretches may both reach into the text between their signs: the first one's span stays
            out += [s for s in self.best(stretch) if not out or s[1] >= out[-1][2]]
        return out


def expectations(scores: np.ndarray, segments: list, n: int) -> tuple[float, np.ndarray]:
    """(log Z, probability of each (segment, kind)) over all segmentations of ``n`` tokens, outside tokens scoring 0."""
    total = np.logaddexp.reduce(scores, axis=1)
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    by_end, by_start = {}, {}
    for s, (i, j, _) in enumerate(segments):
        by_end.setdefault(j, []).append(s)
        by_start.setdefault(i, []).append(s)
    for t in range(1, n + 1):
        forward[t] = np.logaddexp.reduce([forward[t - 1], *[forward[segments[s][0]] + total[s] for s in by_end.get(t, ())]])
    for t in range(n - 1, -1, -1):
        backward[t] = np.logaddexp.reduce([backward[t + 1], *[backward[segments[s][1]] + total[s] for s in by_start.get(t, ())]])
    ends = np.array([(i, j) for i, j, _ in segments])
    return forward[n], np.exp(forward[ends[:, 0], None] + scores + backward[ends[:, 1], None] - forward[n])


def written_sentence(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with labelled personal data, or with a look-alike."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card() -> str:
        d = rng.choice("3456") + number(rng.choice([13, 14, 14, 14, 14, 17]))
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = rng.choice("23456789") + number(2), number(3), number(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"00{rng.randint(20, 99)} {a} {b}{c}", f"({a}){b}-{c}"])

    def email() -> str:
        user, host, top = rng.choice([word(), f"{word()}.{word()}", f"{word()}{number(2)}", f"{word()}_{word()}"]), word(), rng.choice(["com", "org", "net", "de", "fr", "io", "example.com", "co.uk"])
        dot, at = rng.choice([(".", "@")] * 4 + [(" dot ", " at "), (" [dot] ", " [at] "), (" (dot) ", " (at) "), (".", " (at) "), (".", "[at]")])
        return f"{user}{at}{host}{dot}{top.replace('.', dot)}"

    make = {"email": email, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone, "ssn": lambda: f"{rng.randint(1, 899):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"}
    decoys = [
        lambda: f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1900, 2030)}",
        lambda: f"{rng.randint(1, 999)}.{number(2)}", lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 999)}.{rng.randint(300, 999)}.{rng.randint(0, 999)}", lambda: number(rng.randint(5, 20)),
        lambda: f"{rng.randint(1, 99)},{number(3)},{number(3)}", lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}", lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: f"{word()}={number(4)}{word()}{number(5)}", lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1990, 2030)}",
        lambda: f"{rng.randint(0, 23):02d}:{number(2)}:{number(2)}.{number(3)}", lambda: f"{word()} at {word()}. {word().capitalize()} {word()}", lambda: f"meet at {rng.randint(1, 12)}.{number(2)}", lambda: f"{number(8)}-{number(4)}-{number(4)}-{number(4)}-{number(12)}", lambda: f"{number(1)}.{number(1)}.{number(1)}.{number(1)}.{number(1)}",
        lambda: " ".join(number(rng.randint(1, 4)) for _ in range(rng.randint(3, 8))), lambda: f"{word()} at {word()} dot {word()}", lambda: f"${number(3)}.{number(2)}", lambda: f"{word()}{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}-{number(3)}", lambda: f"{number(9)}", lambda: f"{number(10)}",
    ]
    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ", ", ": ", "\n", ". ", " ("])
        if rng.random() < 0.55:
            kind = rng.choice(KINDS)
            if rng.random() < 0.5:
                text += rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": ", " is "])
            value = make[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
        else:
            value = rng.choice(decoys)()
        text += value + rng.choice([" ", ". ", ", ", "\n", ") "])
    return text + " ".join(word() for _ in range(rng.randint(0, 4))), spans


def trained(sentences: int = 500, epochs: int = 12, seed: int = 3) -> SemiMarkov:
    """Weights that maximise the penalised likelihood of written sentences, by adaptive gradient steps."""
    rng = random.Random(seed)
    data, names = [], {}
    for _ in range(sentences):
        text, spans = written_sentence(rng)
        gold = {(s, e): KINDS.index(k) for k, s, e in spans}
        for stretch in stretches(text):
            if segments := stretch.segments():
                target = np.array([gold.get((stretch.starts[i], stretch.ends[j - 1]), -1) for i, j, _ in segments])
                index = [np.array([names.setdefault(n, len(names)) for n in own]) for _, _, own in segments]
                data.append((len(stretch.starts), segments, index, target))
    weights, square = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-3)
    for _ in range(epochs):
        rng.shuffle(data)
        for n, segments, index, target in data:
            scores = np.stack([weights[f].sum(axis=0) for f in index])
            _, p = expectations(scores, segments, n)
            pull = -p
            pull[np.flatnonzero(target >= 0), target[target >= 0]] += 1
            step = np.zeros_like(weights)
            np.add.at(step, np.concatenate(index), np.repeat(pull, [len(f) for f in index], axis=0))
            touched = np.unique(np.concatenate(index))
            g = step[touched] - 1e-4 * weights[touched]
            square[touched] += g * g
            weights[touched] += 0.25 * g / np.sqrt(square[touched])
    return SemiMarkov(names, weights)


def find_personal_data(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """``docs`` with ``personal``: array<struct<kind string, start int, end int, base boolean>>, by kind, then start.

    Offsets are code points, ends exclusive.  Null texts count as empty and get an empty array; other columns pass
    unchanged, but one named ``personal`` is replaced.  Rows stay where they are: no shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trained() if model is None else model)
    kept = [c for c in docs.columns if c != "personal"]
    docs = docs.select(*[f"`{c}`" for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    any_sign = re.compile(r"[0-9@]|(?i:\bat\b)")

    def find(batches):
        field, order = shared.value, {k: i for i, k in enumerate(KINDS)}
        for batch in batches:
            found = []
            for text in batch.column(kept.index("text")).to_pylist():
                if not text or not any_sign.search(text):
                    found.append([])
                    continue
                base = base_spans(text)
                more = [s for s in field.spans(text) if all(s[2] <= b[1] or s[1] >= b[2] for b in base)]
                own = [(*s, True) for s in base] + [(*s, False) for s in more]
                found.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in sorted(own, key=lambda s: (order[s[0]], s[1]))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*kept, "personal"])

    return docs.mapInArrow(find, f"{schema}, personal array<struct<kind string, start int, end int, base boolean>>")


def digest(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans."""
    found = find_personal_data(docs.select("doc_id", "text"), model)
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("personal", lambda s: s["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text("personal").alias("spans"))


def op2_personal_data(spark, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
