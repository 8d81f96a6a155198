"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows:
``PER_LANGUAGE`` documents of each language (those with the smallest hash of their id) and ``CHUNKS``
stretches of at most ``CHUNK`` bytes from each. So what reaches the driver is bounded by the number of languages.
For prediction a text is cut into stretches of at most ``STRETCH`` bytes, every byte gets a probability of
each language, and the document's probability is the mean over all its bytes.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text when
nothing could be learned; ties go to the language first in order; rows whose doc_id is null are neither
held out nor learned from; repeated rows give repeated results; only text is ever an input of a prediction.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.words import text_slices

UNKNOWN = "und"
HIDDEN = 8
CHUNK, CHUNKS, PER_LANGUAGE = 64, 6, 300
BATCH, STEPS, RATE, SEED = 96, 600, 0.02, 7
STRETCH, LANES = 256, 512
PAD = 256  # a symbol whose update gate is shut, so that the state stays zero


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte capitals that follow byte C3."""
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    return low + np.where(after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97), np.uint8(32), np.uint8(0))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _pass(table: np.ndarray, inner: np.ndarray, bias: np.ndarray, x: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States of one direction: steps x hidden x sequences."""
    steps, n = x.shape
    size = inner.shape[1]
    state = np.zeros((size, n), np.float32)
    out = np.empty((steps, size, n), np.float32)
    for t in range(steps):
        g = table[:, x[t]]
        a = inner @ state
        gates = _sigmoid(g[:2 * size] + a[:2 * size])
        z, r = gates[:size], gates[size:]
        own = a[2 * size:] + bias
        new = np.tanh(g[2 * size:] + r * own)
        if trace is not None:
            trace.append((state, z, r, own, new))
        state = new + z * (state - new)
        out[t] = state
    return out


def _backward(inner: np.ndarray, trace: list, x: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of table, inner weights and bias from those of the states."""
    size = inner.shape[1]
    d_inner, d_bias = np.zeros_like(inner), np.zeros((size, 1), np.float32)
    d_gates = np.empty((x.shape[0], 3 * size, x.shape[1]), np.float32)
    carried = np.zeros_like(outer[0])
    for t in range(x.shape[0] - 1, -1, -1):
        before, z, r, own, new = trace[t]
        d = outer[t] + carried
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * own * r * (1 - r)
        d_own = d_new * r
        d_a = np.concatenate((d_z, d_r, d_own))
        d_inner += d_a @ before.T
        d_bias += d_own.sum(1, keepdims=True)
        carried = d * z + inner.T @ d_a
        d_gates[t, :size], d_gates[t, size:2 * size], d_gates[t, 2 * size:] = d_z, d_r, d_new
    d_table = np.zeros((PAD + 1, 3 * size), np.float32)
    np.add.at(d_table, x.ravel(), d_gates.transpose(0, 2, 1).reshape(-1, 3 * size))
    d_table[PAD] = 0
    return d_table.T.copy(), d_inner, d_bias


def _logits(model: dict, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Steps x languages x sequences."""
    return np.matmul(model["out_f"], forward) + np.matmul(model["out_b"], backward) + model["out"]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def train(chunks: list[bytes], labels: list[str]) -> dict:
    """Fit the network to labelled stretches of bytes; the same input gives the same network."""
    names = sorted(set(labels))
    rng = np.random.default_rng(SEED)
    x = np.full((CHUNK, len(chunks)), PAD, np.int64)
    for i, chunk in enumerate(chunks):
        x[:len(chunk[:CHUNK]), i] = folded(np.frombuffer(chunk[:CHUNK], np.uint8))
    y = np.searchsorted(names, labels)
    of_class = [np.flatnonzero(y == c) for c in range(len(names))]
    n, h = len(names), HIDDEN
    model = {"out_f": rng.normal(0, 0.3, (n, h)), "out_b": rng.normal(0, 0.3, (n, h)), "out": np.zeros((n, 1))}
    for d in "fb":
        model |= {f"table_{d}": rng.normal(0, 0.3, (3 * h, PAD + 1)), f"inner_{d}": rng.normal(0, 0.3, (3 * h, h)), f"bias_{d}": np.zeros((h, 1))}
        model[f"table_{d}"][:h, PAD] = 60
    model = {k: v.astype(np.float32) for k, v in model.items()}
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items()}
    for step in range(1, STEPS + 1):
        pick = np.array([rng.choice(of_class[i % n]) for i in range(max(BATCH, n))])
        xs, ys = x[:, pick], y[pick]
        traces: dict[str, list] = {"f": [], "b": []}
        ahead = _pass(model["table_f"], model["inner_f"], model["bias_f"], xs, traces["f"])
        back = _pass(model["table_b"], model["inner_b"], model["bias_b"], xs[::-1], traces["b"])[::-1]
        error = _softmax(_logits(model, ahead, back))
        error[:, ys, np.arange(len(ys))] -= 1
        real = (xs != PAD)[:, None, :]
        error *= real / real.sum()
        grads = {
            "out_f": np.einsum("tcn,thn->ch", error, ahead), "out_b": np.einsum("tcn,thn->ch", error, back),
            "out": error.sum((0, 2))[:, None],
        }
        for d, seen in (("f", xs), ("b", xs[::-1])):
            outer = np.matmul(model[f"out_{d}"].T, error if d == "f" else error[::-1])
            grads[f"table_{d}"], grads[f"inner_{d}"], grads[f"bias_{d}"] = _backward(model[f"inner_{d}"], traces[d], seen, outer)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model | {"names": names}


def label_positions(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: mean probability of each language over its bytes, and shares of the bytes' labels."""
    rows, n = len(offsets) - 1, len(model["names"])
    sizes = np.diff(offsets)
    parts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(rows), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = offsets[owner] + nth * sizes[owner] // np.maximum(parts[owner], 1)
    lengths = offsets[owner] + (nth + 1) * sizes[owner] // np.maximum(parts[owner], 1) - starts
    by_length = np.argsort(lengths, kind="stable")
    total, votes = np.zeros((rows, n)), np.zeros((rows, n))
    for lo in range(0, len(by_length), LANES):
        own = by_length[lo:lo + LANES]
        at = np.arange(int(lengths[own].max()))[:, None]
        real = at < lengths[own][None, :]
        x = np.where(real, data[np.minimum(starts[own][None, :] + at, len(data) - 1)], PAD)
        ahead = _pass(model["table_f"], model["inner_f"], model["bias_f"], x)
        back = _pass(model["table_b"], model["inner_b"], model["bias_b"], x[::-1])[::-1]
        p = _softmax(_logits(model, ahead, back))
        p *= real[:, None, :]
        np.add.at(total, owner[own], p.sum(0, dtype=np.float64).T)
        np.add.at(votes, owner[own], ((p == p.max(1, keepdims=True)) & real[:, None, :]).sum(0).T)
    sizes = np.maximum(sizes, 1)[:, None]
    return total / sizes, votes / sizes


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches at even distances over the whole text."""
    for batch in batches:
        langs, cut = [], []
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            data = text.encode()
            starts = {i * max(0, len(data) - CHUNK) // (CHUNKS - 1): CHUNK >> (i % 3) for i in range(CHUNKS)}
            for start, size in sorted(starts.items()):
                langs.append(lang)
                cut.append(data[start:start + size])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cut, pa.binary())], names=["lang", "chunk"])


def fit(docs: DataFrame) -> dict | None:
    """Learn from labelled rows that are not held out; None if there are none."""
    known = docs.filter(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out() & F.col("text").rlike(r"\p{L}")
    ).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.select("doc_id", "lang").withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= PER_LANGUAGE)
    # at most PER_LANGUAGE ids of each language
    picked = known.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    rows = picked.select("lang", "text").mapInArrow(_sample, "lang string, chunk binary").collect()
    pairs = sorted((r["lang"], bytes(r["chunk"])) for r in rows)
    return train([c for _, c in pairs], [lang for lang, _ in pairs]) if pairs else None


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


_FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("share", T.DoubleType())])


def predicted(text: Column, model: dict | None) -> Column:
    """``lang_pred, score, share`` (of the bytes whose own label is the prediction) of a text column.

    Only the text goes to Python; what else a row holds stays where it is.
    """
    held = pickle.dumps(model)

    @F.arrow_udf(_FOUND)
    def label(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        net = pickle.loads(held)
        for texts, lettered in batches:
            found = []
            for lo, hi, data, offsets in text_slices(texts, LANES * STRETCH):
                some = np.asarray(lettered.slice(lo, hi - lo).to_numpy(zero_copy_only=False), bool)
                names, scores, shares = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo)
                if net is not None and some.any():
                    p, votes = label_positions(net, folded(data), offsets)
                    best = p.argmax(1)
                    rows = np.arange(hi - lo)
                    names = [net["names"][b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
                    scores, shares = np.where(some, np.clip(p[rows, best], 0, 1), 0.0), np.where(some, votes[rows, best], 0.0)
                found.append(pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(shares)], _FOUND.fieldNames()))
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("share", pa.float64())]))
            del texts, lettered, found
            pa.default_memory_pool().release_unused()

    # not to be evaluated again by what reads the column
    return label.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def predict(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """All columns with ``lang_pred``, ``score`` and ``share``; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in _FOUND.fieldNames()]
    found = docs.select(F.struct(*kept).alias("row"), predicted(F.col(text).cast("string"), model).alias("found"))
    return found.select("row.*", "found.*")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and predict each row: ``doc_id, held_out, lang_pred, score, share``."""
    asked = docs.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(asked, fit(docs)).drop("text")


def keep_known(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows whose language is known with a score of at least ``least``, with all columns."""
    found = docs.select(F.struct(*docs.columns).alias("row"), predicted(F.col("text").cast("string"), fit(docs)).alias("found"))
    return found.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")
