"""Language identification with a bidirectional gated recurrent network over bytes.

Each text is cut into windows of bytes; a forward and a backward network read every
window, a linear layer labels every position from both states, and a document's
probabilities are the mean of those of its positions. Training is backpropagation
through time in numpy, on windows from a bounded sample of labelled documents; scoring
reads all of every text inside Arrow batches and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import fold, packed, table

UNKNOWN = "und"
#: Bounds of the training sample: documents per language (the least seeded hashes), windows per document.
SAMPLE_DOCS = 500
SAMPLE_WINDOWS = 4
SEED = 11
WINDOW = 96
HIDDEN = 16
STEPS = 160
BATCH = 128
RATE = 0.02
#: Windows read at once when scoring.
TOGETHER = 1024


class Gru:
    """One direction; ``x`` has a row per byte, so the input layer is a lookup.

    update z and reset r are sigmoids, n = tanh(x_n + r * (h U_n + c)), and
    h' = n + z (h - n). Columns of ``x`` and ``u``: z, r, n.
    """

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.x = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.u = (rng.normal(0, 1, (hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.c = np.zeros(hidden, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c]

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, batch, hidden) for codes (time, batch). ``keep`` gathers what backpropagation needs.

        Every array is whole (no slices of columns), which keeps numpy's inner loops
        long. sigmoid(a) = (1 + tanh(a / 2)) / 2: the halves go into the weights once.
        """
        n, hidden, kind = codes.shape[1], self.h, self.x.dtype
        xz, xr, xn = (np.ascontiguousarray(self.x[:, k * hidden:(k + 1) * hidden]) * kind.type(f)
                      for k, f in enumerate((0.5, 0.5, 1)))
        uz, ur, um = (np.ascontiguousarray(self.u[:, k * hidden:(k + 1) * hidden]) * kind.type(0.5) for k in range(3))
        c = self.c * kind.type(0.5)
        out = np.empty((len(codes), n, hidden), kind)
        h = np.zeros((n, hidden), kind)
        z, r, s, m, a = (np.empty((n, hidden), kind) for _ in range(5))
        for t, code in enumerate(codes):
            for gate, x, u in ((z, xz, uz), (r, xr, ur)):
                np.take(x, code, axis=0, out=gate, mode="clip")
                np.matmul(h, u, out=a)
                gate += a
                np.tanh(gate, out=gate)
                gate += 1  # twice the sigmoid
            np.matmul(h, um, out=m)  # half of h U_n + c
            m += c
            np.take(xn, code, axis=0, out=s, mode="clip")
            np.multiply(r, m, out=a)
            s += a
            np.tanh(s, out=s)
            if keep is not None:
                keep.append((code, h, z / 2, r / 2, m * 2, s.copy()))
            np.subtract(h, s, out=a)
            a *= z
            a *= 0.5
            h = out[t]
            np.add(s, a, out=h)
        return out

    def gradients(self, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time: gradients of x, u and c from those of the states."""
        dx, du, dc = (np.zeros_like(p) for p in self.parameters())
        inputs = np.empty((len(kept), *d_out.shape[1:2], self.x.shape[1]), self.x.dtype)
        dh = np.zeros_like(d_out[0])
        for t in range(len(kept) - 1, -1, -1):
            _, h, z, r, m, n = kept[t]
            dh = dh + d_out[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            inner = np.concatenate([dz, dr, dm], axis=1)
            inputs[t] = np.concatenate([dz, dr, dn], axis=1)
            du += h.T @ inner
            dc += dm.sum(0)
            dh = dh * z + inner @ self.u.T
        codes = np.concatenate([step[0] for step in kept])
        order = np.argsort(codes, kind="stable")
        present, first = np.unique(codes[order], return_index=True)
        dx[present] = np.add.reduceat(inputs.reshape(len(codes), -1)[order], first, axis=0)
        return [dx, du, dc]


class Model:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Gru(hidden, rng), Gru(hidden, rng)
        self.w = (rng.normal(0, 1, (2 * hidden, len(languages))) / np.sqrt(2 * hidden)).astype(np.float32)
        self.b = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.w, self.b]

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of every language and position: (language, time, batch)."""
        hidden = self.ahead.h
        ahead, back = self.ahead.states(codes).reshape(-1, hidden), self.back.states(codes[::-1])[::-1].reshape(-1, hidden)
        logits = self.w[:hidden].T @ ahead.T + self.w[hidden:].T @ back.T + self.b[:, None]
        return _softmax(logits, 0).reshape(-1, *codes.shape)

    def loss_and_gradients(self, codes: np.ndarray, used: np.ndarray, labels: np.ndarray):
        """Mean cross-entropy of the positions in use, and the gradients of all parameters."""
        ahead, back = [], []
        hidden = self.ahead.h
        states = np.concatenate([self.ahead.states(codes, ahead), self.back.states(codes[::-1], back)[::-1]], axis=2)
        p = _softmax(states @ self.w + self.b, 2)
        at = np.broadcast_to(labels, codes.shape)
        own = np.take_along_axis(p, at[..., None], 2)[..., 0]
        total = used.sum()
        loss = -(np.log(np.maximum(own, 1e-12)) * used).sum() / total
        d = p.copy()
        np.put_along_axis(d, at[..., None], own[..., None] - 1, 2)
        d *= (used / total)[..., None].astype(d.dtype)
        d_states = d @ self.w.T
        flat = d.reshape(-1, d.shape[2])
        return loss, [*self.ahead.gradients(ahead, d_states[..., :hidden]),
                      *self.back.gradients(back, d_states[::-1, :, hidden:]),
                      states.reshape(-1, 2 * hidden).T @ flat, flat.sum(0)]

    def train(self, windows: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH) -> Model:
        """Adam on batches in which every language is equally likely; the seed fixes the order."""
        codes, used = _codes(windows)
        rng = np.random.default_rng(SEED)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m, v = [np.zeros_like(p) for p in self.parameters()], [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            label = rng.integers(0, len(by_label), batch)
            rows = np.array([rng.choice(by_label[k]) for k in label])
            _, gradients = self.loss_and_gradients(codes[:, rows], used[:, rows], label)
            size = np.sqrt(sum(float((g * g).sum()) for g in gradients))
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
            for p, g, a, b in zip(self.parameters(), gradients, m, v, strict=True):
                g = g * min(1.0, 1.0 / (size + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * a / (np.sqrt(b) + 1e-8)).astype(p.dtype)
        return self

    def labels(self, text: str) -> list[str]:
        """The language of every byte of a text."""
        data = text.encode("utf-8", "surrogatepass")
        windows = [data[a:a + WINDOW] for a in range(0, len(data), WINDOW)]
        codes, _ = _codes(windows)
        best = self.probabilities(codes).argmax(0).T.ravel()[:len(data)]
        return [self.languages[k] for k in best]

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each whole text; unknown and 0 without any letter."""
        sums, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        windows: list[bytes] = []
        owners: list[int] = []

        def read() -> None:
            codes, used = _codes(windows)
            np.add.at(sums, owners, (self.probabilities(codes) * used).sum(1).T)
            windows.clear()
            owners.clear()

        for k, text in enumerate(texts):
            if text is None or not any(map(str.isalpha, text)):
                continue
            data = text.encode("utf-8", "surrogatepass")
            sizes[k] = len(data)
            for a in range(0, len(data), WINDOW):
                windows.append(data[a:a + WINDOW])
                owners.append(k)
                if len(windows) == TOGETHER:
                    read()
        if windows:
            read()
        share = sums / np.maximum(sizes, 1)[:, None]
        best = share.argmax(1)
        return ([self.languages[b] if n else UNKNOWN for b, n in zip(best, sizes, strict=True)],
                [min(1.0, float(share[k, b])) if n else 0.0 for k, (b, n) in enumerate(zip(best, sizes, strict=True))])


def _softmax(a: np.ndarray, axis: int) -> np.ndarray:
    a = a - a.max(axis, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis, keepdims=True)
    return a


def _codes(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(time, batch) bytes and which of them are text; a short window is filled up with zero bytes."""
    sizes = np.array([len(w) for w in windows])
    codes = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for w in windows), np.uint8).reshape(-1, WINDOW)
    return np.ascontiguousarray(codes.T), np.arange(WINDOW)[:, None] < sizes


def _windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``SAMPLE_WINDOWS`` windows of each text, at even distances."""
    for part in parts:
        rows = []
        for lang, h, text in zip(part["lang"].to_pylist(), part["h"].to_pylist(), part["text"], strict=True):
            text = text.as_py()
            if not any(map(str.isalpha, text)):
                continue
            data = text.encode("utf-8", "surrogatepass")
            n = min(SAMPLE_WINDOWS, -(-len(data) // WINDOW))
            rows += [(lang, h, k, data[k * len(data) // n:][:WINDOW]) for k in range(n)]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
            pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["lang", "h", "k", "window"])


def sample(docs: DataFrame, training: Column, per_language: int = SAMPLE_DOCS) -> list:
    """Training windows (lang, h, k, window) of the documents with the least hashes of each language.

    A hash is of id and text, so rows that share one are equal and count once. How many
    rows a language has tells below which hash about twice as many as are wanted must lie;
    only those are ranked, so no language ever meets in one task. Where repeated rows leave
    too few of them, the bound is moved up.
    """
    labelled = docs.select("text", "lang", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"), training.alias("use")).filter(
        F.col("use") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return []

    def up_to(bounds: dict[str, int]) -> Column:
        return F.create_map(*(F.lit(part) for pair in bounds.items() for part in pair))[F.col("lang")]

    share = {lang: min(1.0, 2 * per_language / size) for lang, size in sizes.items()}
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    while True:
        near = labelled.filter(F.col("h") <= up_to({lang: _bound(part) for lang, part in share.items()})).select("lang", "h").distinct()
        found = {r.lang: r for r in near.withColumn("rank", rank).filter(F.col("rank") <= per_language).groupBy("lang").agg(
            F.max("h").alias("last"), F.count("*").alias("n")).collect()}
        few = [lang for lang, part in share.items() if part < 1 and (lang not in found or found[lang].n < per_language)]
        if not few:
            break
        share.update({lang: min(1.0, 4 * share[lang]) for lang in few})
    chosen = labelled.filter(F.col("h") <= up_to({lang: r["last"] for lang, r in found.items()})).dropDuplicates(["lang", "h"])
    windows = chosen.select("lang", "h", "text").mapInArrow(_windows, "lang string, h long, k int, window binary").collect()
    return sorted(windows, key=lambda r: (r.lang, r.h, r.k, bytes(r.window)))


def _bound(share: float) -> int:
    """The hash below which this share of all hashes lies."""
    return -2 ** 63 + max(0, min(2 ** 64 - 1, int(share * 2 ** 64)))


def trained(docs: DataFrame, training: Column) -> Model | None:
    """A model of the languages in ``docs`` (text, lang, doc_id), or None where no row can be learned from."""
    rows = sample(docs, training)
    if not rows:
        return None
    languages = sorted({r.lang for r in rows})
    return Model(languages).train([bytes(r.window) for r in rows], np.array([languages.index(r.lang) for r in rows]))


def predict(rows: DataFrame, model: Model | None, kept: str) -> DataFrame:
    """``kept``, lang_pred and score of ``rows`` (kept, text).

    A null text, and one without any letter, is ``und`` with score 0; without a model every
    text is. Every row is predicted by itself, also where rows repeat; texts are read whole,
    in windows. An empty table gives no rows, other columns are never read.
    """
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part["text"].to_pylist()
            found = model.documents(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([part[kept], pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())],
                                             names=[kept, "lang_pred", "score"])

    kind = rows.schema[kept].dataType.simpleString()
    return rows.select(kept, "text").mapInArrow(batches, f"{kept} {kind}, lang_pred string, score double")


def learnable() -> Column:
    """Rows that the contract lets a model learn from."""
    return fold(F.col("doc_id"), 3) != 1


def known_language(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that have no language (null texts, texts without a letter); all columns kept.

    Where no row can be learned from, the same rows go: there is no model to ask, but no doubt either.
    """
    model = trained(docs, learnable())
    if model is None:
        return docs.filter(F.rlike("text", F.lit(r"\p{L}")))
    rows = packed(docs, F.col("text"))
    return predict(rows, model, "row").filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def op3_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; a third of the documents is held out of training."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, learnable())
    return predict(docs.select("doc_id", "text"), model, "doc_id").select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
