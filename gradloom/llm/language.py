"""Language identification by a bidirectional gated recurrent network over bytes.

The network is written and trained in numpy: two recurrent layers read a window of bytes in either direction, and at
every position the two states vote for a language.  Training is by backpropagation through time, with the loss at every
position; a document's probabilities are the mean over all its positions.  Texts are read whole, in windows that are
padded at the end of a text; all windows of a batch are read in step.

It is fitted on the driver to at most ``SAMPLE`` windows a language of labelled documents; that bound is all that the
corpus' size touches there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, documents, unit
from .text import text_buffer

WINDOW = 128  # bytes
HIDDEN = 12
#: Windows per language that training may use.
SAMPLE = 1500


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class BiGru:
    """Parameters: per direction a table of input terms by byte (256, 3h), recurrent weights (h, 3h), votes (h, languages)."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        rng, h, n = np.random.default_rng(seed), hidden, len(languages)
        self.languages, self.hidden = languages, h
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"b": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(256, 3 * h, scale=0.3), f"u{d}": draw(h, 3 * h, scale=h**-0.5), f"v{d}": draw(h, n, scale=h**-0.5)}

    def states(self, windows: np.ndarray, d: str, keep: bool = False):
        """States (T, B, h) after each byte of ``windows`` (T, B), read in direction ``d``; with ``keep`` what BPTT needs."""
        h, (steps, width), x, u = self.hidden, windows.shape, self.p[f"x{d}"], self.p[f"u{d}"]
        out, state, kept = np.empty((steps, width, h), np.float32), np.zeros((width, h), np.float32), [None] * steps
        g, add, c = (np.empty((width, k), np.float32) for k in (3 * h, 3 * h, h))
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, windows[t], axis=0, out=add, mode="clip")
            np.matmul(state, u, out=g)
            gates = _sigmoid(g[:, : 2 * h] + add[:, : 2 * h])
            np.multiply(gates[:, h:], g[:, 2 * h :], out=c)
            c += add[:, 2 * h :]
            np.tanh(c, out=c)
            if keep:
                kept[t] = state, gates, g[:, 2 * h :].copy(), c.copy()
            np.subtract(c, state, out=out[t])
            out[t] *= gates[:, :h]
            out[t] += state
            state = out[t]
        return (out, kept) if keep else out

    def votes(self, windows: np.ndarray, d: str) -> np.ndarray:
        """(languages, T * B): the votes of the states of direction ``d``, as ``states`` has them.

        The three gates are arrays of their own here, so every operation runs over contiguous memory; and what goes into
        the sigmoids (half a tanh of half of it, and a half) is halved in the weights, which is exact.
        """
        h, (steps, width) = self.hidden, windows.shape
        half = np.array([0.5, 0.5, 1.0], np.float32)[:, None, None]
        x, u = (half * self.p[f"{k}{d}"].reshape(-1, 3, h).transpose(1, 0, 2) for k in "xu")
        out, state = np.empty((steps, width, h), np.float32), np.zeros((width, h), np.float32)
        g, add = np.empty((3, width, h), np.float32), np.empty((3, width, h), np.float32)
        gates, (z, r, c) = g[:2], g
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, windows[t], axis=1, out=add, mode="clip")
            np.matmul(state, u, out=g)
            gates += add[:2]
            np.tanh(gates, out=gates)
            gates += 1.0
            gates *= 0.5
            c *= r
            c += add[2]
            np.tanh(c, out=c)
            new = out[t]
            np.subtract(c, state, out=new)
            new *= z
            new += state
            state = new
        return self.p[f"v{d}"].T @ out.reshape(-1, h).T

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(languages, T, B): the label distribution of every position."""
        votes = self.votes(windows, "f")
        votes += self.votes(windows, "b")
        votes += self.p["b"][:, None]
        votes -= votes.max(axis=0)
        np.exp(votes, out=votes)
        votes /= votes.sum(axis=0)
        return votes.reshape(-1, *windows.shape)

    def gradients(self, windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions within ``lengths`` and its gradients, by backpropagation through time."""
        h, (steps, width) = self.hidden, windows.shape
        runs = {d: self.states(windows, d, keep=True) for d in "fb"}
        votes = sum(runs[d][0] @ self.p[f"v{d}"] for d in "fb") + self.p["b"]
        votes -= votes.max(axis=2, keepdims=True)
        p = np.exp(votes)
        p /= p.sum(axis=2, keepdims=True)
        inside = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        weight = inside / inside.sum()
        loss = -float((np.log(p[:, np.arange(width), labels] + 1e-12) * weight).sum())
        error = p
        error[:, np.arange(width), labels] -= 1
        error *= weight[:, :, None]
        grads = {"b": error.sum(axis=(0, 1))}
        flat_error = error.reshape(steps * width, -1)
        one_hot = np.zeros((steps * width, 256), np.float32)
        one_hot[np.arange(steps * width), windows.reshape(-1)] = 1
        for d in "fb":
            out, kept = runs[d]
            grads[f"v{d}"] = out.reshape(-1, h).T @ flat_error
            from_votes = error @ self.p[f"v{d}"].T
            into, du = np.zeros((steps, width, 3 * h), np.float32), np.zeros_like(self.p[f"u{d}"])
            carry = np.zeros((width, h), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                state, gates, g, c = kept[t]
                z, r = gates[:, :h], gates[:, h:]
                dh = from_votes[t] + carry
                to_c = dh * z * (1 - c * c)
                step = into[t]
                step[:, :h] = dh * (c - state) * z * (1 - z)
                step[:, h : 2 * h] = to_c * g * r * (1 - r)
                step[:, 2 * h :] = to_c
                through = step.copy()
                through[:, 2 * h :] *= r
                du += state.T @ through
                carry = dh * (1 - z) + through @ self.p[f"u{d}"].T
            grads[f"u{d}"], grads[f"x{d}"] = du, one_hot.T @ into.reshape(-1, 3 * h)
        return loss, grads


def trained(windows: list[bytes], labels: list[str], steps: int = 400, batch: int = 128, seed: int = 5, hidden: int = HIDDEN) -> BiGru:
    """A network fitted by Adam to byte windows of at most ``WINDOW`` bytes; languages are drawn alike often."""
    names = sorted(set(labels))
    net, rng = BiGru(names, hidden, seed), np.random.default_rng(seed)
    table, lengths = np.zeros((len(windows), WINDOW), np.uint8), np.array([min(WINDOW, len(w)) for w in windows])
    for i, w in enumerate(windows):
        table[i, : lengths[i]] = np.frombuffer(w[:WINDOW], np.uint8)
    which = np.array([names.index(x) for x in labels])
    of = [np.flatnonzero(which == i) for i in range(len(names))]
    mean, square = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(o, -(-batch // len(names))) for o in of])
        _, grads = net.gradients(table[pick].T.copy(), lengths[pick], which[pick])
        rate = 0.01 * min(1.0, 2 * (1 - (step - 1) / steps))
        norm = min(1.0, 5.0 / (sum(float((g * g).sum()) for g in grads.values()) ** 0.5 + 1e-9))
        for k, g in grads.items():
            g = g * norm
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            net.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def is_training(n: int = 4, out: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(n)) != out


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """At most ``sample`` windows a language, from documents drawn by their id's hash, from anywhere in their texts."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND length(text) > 0")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    drawn = labelled.where(unit(F.lit(71), "doc_id") < share)
    room = F.greatest(F.lit(0), F.length("text") - WINDOW)
    at = F.floor(unit(F.lit(72), "doc_id") * (room + 1)).cast("int")
    rows = drawn.withColumn("at", at + 1).select("lang", F.substring("text", F.col("at"), F.lit(WINDOW)).alias("w"), F.xxhash64("doc_id").alias("o"))
    windows, labels = [], []
    taken = dict.fromkeys(counts, 0)
    for r in sorted(rows.collect(), key=lambda r: (r["o"], r["w"])):  # about ``sample`` a language
        if taken[r["lang"]] < sample:
            taken[r["lang"]] += 1
            windows.append(r["w"].encode()[:WINDOW])
            labels.append(r["lang"])
    return windows, labels


def pooled(net: BiGru, data: np.ndarray, offsets: np.ndarray, group: int = 768) -> np.ndarray:
    """(documents, languages): mean of the position probabilities over each whole text; zeros for empty texts."""
    lengths = np.diff(offsets)
    per_doc = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), per_doc)
    first = np.cumsum(per_doc) - per_doc
    start = offsets[doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    size = np.minimum(WINDOW, offsets[doc + 1] - start)
    sums, padded = np.zeros((len(lengths), len(net.languages))), np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    order = np.argsort(-size, kind="stable")  # windows of like size together
    for lo in range(0, len(order), group):
        pick = order[lo : lo + group]
        steps = int(size[pick[0]])
        at = start[pick] + np.arange(steps)[:, None]
        windows, inside = padded[at], np.arange(steps)[:, None] < size[pick]
        windows[~inside] = 0
        p = net.probabilities(windows)
        p *= inside
        np.add.at(sums, doc[pick], p.sum(axis=1).T)
    return sums / np.maximum(lengths, 1)[:, None]


def identify(docs: DataFrame, net: BiGru | None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1): the language with the largest pooled probability.

    A null text, or one without a letter, is ``und`` with score 0; so is every text if there is no network (nothing was
    labelled).  Ties go to the language that is first by name.  Columns of these names are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 4000, 8)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letters = "__letters"
    docs = docs.select(*[f"`{c}`" for c in kept], F.coalesce(F.regexp_like("text", F.lit(r"\p{L}")), F.lit(False)).alias(letters))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != letters) + ", lang_pred string, score double"
    shared, text = spark.sparkContext.broadcast(net), kept.index("text")

    def predict(batches):
        for batch in batches:
            said, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            if shared.value is not None:
                data, offsets = text_buffer(batch.column(text))
                p = pooled(shared.value, data, offsets)
                there = batch.column(len(kept)).to_numpy(zero_copy_only=False)
                best = p.argmax(axis=1)
                said[there] = np.array(shared.value.languages, object)[best[there]]
                score[there] = np.clip(p[np.arange(len(p)), best], 0, 1)[there]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(said, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)


def language_id(docs: DataFrame, training: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of ``docs`` (doc_id, text, lang).

    Learns from text and non-null lang of the rows where ``training`` (by default crc32(doc_id) mod 4 is not 2); neither
    lang nor doc_id is an input of a prediction.  An empty table gives an empty result; repeated rows each get a row.
    """
    training = is_training() if training is None else training
    windows, labels = training_windows(docs.where(training).select("doc_id", "text", "lang"), sample)
    net = trained(windows, labels) if windows else None
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training).alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))
