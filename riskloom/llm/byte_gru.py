"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a letter run between two blanks in both
directions and labels every position; a document's probabilities are the means
over the positions of all its letter runs. It is trained in numpy by
backpropagation through time. Letter runs are lower-cased and are the unit of
the recurrence, so a worker can keep the sums of a run's position probabilities
in a bounded cache and whole texts cost one pass of the network per new run
(runs longer than ``RUN_BYTES`` are read in pieces).

Training uses at most about ``SAMPLE_DOCS`` documents per language (chosen by a
hash of doc_id) and ``SAMPLE_WORDS`` runs of each, none longer than
``TRAIN_BYTES``; everything else reads all rows.

Null texts and texts without a letter get ``und`` with score 0. With no labelled
row at all every text does. Repeated rows are predicted row by row, other
columns are ignored, an empty table gives an empty result. Ties go to the
language first in alphabetical order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm import segments as S
from riskloom.llm.rowwise import add_from_text
from riskloom.session import ship_package

HIDDEN = 20
STEPS = 400
BATCH = 256
SAMPLE_DOCS = 1500
SAMPLE_WORDS = 48
RUN_BYTES = 32
TRAIN_BYTES = 20
UNKNOWN = "und"
_GATES = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class GRU:
    """One direction. ``W``: input part of the gates (update, reset, state) by byte."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.h = hidden
        self.W = rng.normal(0, 0.3, (256, _GATES * hidden)).astype(np.float32)
        self.U = rng.normal(0, hidden ** -0.5, (hidden, _GATES * hidden)).astype(np.float32)
        self.b = np.zeros(_GATES * hidden, np.float32)

    def forward(self, x: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (n, time, hidden) of padded byte rows; a row's state stands still where it isn't live."""
        n, steps, k = x.shape[0], x.shape[1], self.h
        h, out, tape = np.zeros((n, k), np.float32), np.empty((n, steps, k), np.float32), []
        for t in range(steps):
            a, u = self.W[x[:, t]] + self.b, h @ self.U
            gates = _sigmoid(a[:, :2 * k] + u[:, :2 * k])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(a[:, 2 * k:] + r * u[:, 2 * k:])
            m = live[:, t, None]
            new = np.where(m, c + z * (h - c), h)
            if keep:
                tape.append((h, z, r, c, u[:, 2 * k:], m))
            h = out[:, t] = new
        return out, tape

    def backward(self, x: np.ndarray, tape: list, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients of W, U, b through time."""
        k = self.h
        dW, dU, das = np.zeros_like(self.W), np.zeros_like(self.U), np.zeros((*x.shape, _GATES * k), np.float32)
        dh = np.zeros_like(dout[:, 0])
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, c, uc, m = tape[t]
            dh = dh + dout[:, t]
            d = np.where(m, dh, 0)
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            das[:, t] = da
            dU += h.T @ du
            dh = np.where(m, d * z + du @ self.U.T, dh)
        das = das.reshape(-1, _GATES * k)
        order = np.argsort(x, axis=None, kind="stable")
        present, first = np.unique(x.ravel()[order], return_index=True)
        dW[present] = np.add.reduceat(das[order], first)
        return [dW, dU, das.sum(0)]


class ByteTagger:
    """Bidirectional tagger: probabilities per language for every byte."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = GRU(rng, hidden), GRU(rng, hidden)
        self.V = rng.normal(0, 0.1, (2 * hidden, classes)).astype(np.float32)
        self.c = np.zeros(classes, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.ahead.W, self.ahead.U, self.ahead.b, self.back.W, self.back.U, self.back.b, self.V, self.c]

    def states(self, runs: list[bytes], keep: bool = False):
        """Runs between blanks, padded at the end; the backward network reads each run reversed."""
        n = np.fromiter(map(len, runs), np.int64, len(runs)) + 2
        steps = int(n.max())
        x = np.full((len(runs), steps), 32, np.uint8)
        live = np.arange(steps) < n[:, None]
        for i, r in enumerate(runs):
            x[i, 1:1 + len(r)] = np.frombuffer(r, np.uint8)
        turn = np.where(live, n[:, None] - 1 - np.arange(steps), np.arange(steps))
        y = np.take_along_axis(x, turn, 1)
        f, tape_f = self.ahead.forward(x, live, keep)
        g, tape_g = self.back.forward(y, live, keep)
        both = np.concatenate([f, np.take_along_axis(g, turn[:, :, None], 1)], 2)
        live = live & (np.arange(steps) > 0) & (np.arange(steps) < n[:, None] - 1)  # the letters
        return both, live, (x, y, turn, tape_f, tape_g)

    def probabilities(self, both: np.ndarray) -> np.ndarray:
        logits = both @ self.V + self.c
        logits -= logits.max(-1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(-1, keepdims=True)

    def gradients(self, runs: list[bytes], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients."""
        both, live, (x, y, turn, tape_f, tape_g) = self.states(runs, keep=True)
        p = self.probabilities(both)
        rows = np.arange(len(runs))
        total = float(max(1, live.sum()))
        loss = -np.log(p[rows, :, labels] + 1e-9)[live].sum() / total
        p[rows, :, labels] -= 1
        d = p * live[:, :, None] / total
        dV = np.tensordot(both, d, ([0, 1], [0, 1]))
        dboth = d @ self.V.T
        k = self.ahead.h
        grads = self.ahead.backward(x, tape_f, dboth[:, :, :k])
        grads += self.back.backward(y, tape_g, np.take_along_axis(dboth[:, :, k:], turn[:, :, None], 1))
        return float(loss), [*grads, dV, d.sum((0, 1))]

    def fit(self, runs: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 5) -> "ByteTagger":
        """Adam over batches with as many runs of each language."""
        rng = np.random.default_rng(seed)
        by = [np.flatnonzero(labels == c) for c in np.unique(labels)]
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters]
        for t in range(1, steps + 1):
            at = np.concatenate([rng.choice(g, max(1, batch // len(by))) for g in by])
            _, grads = self.gradients([runs[i] for i in at], labels[at])
            norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
            rate = 0.02 * min(1, t / 30) * (1 - 0.9 * t / steps) * np.sqrt(1 - 0.99 ** t) / (1 - 0.9 ** t)
            for p, g, (m, v) in zip(self.parameters, grads, moment):
                g = g / norm
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        return self

    def run_sums(self, runs: list[bytes], batch: int = 2048) -> np.ndarray:
        """(runs, languages + 1): summed probabilities of a run's letters, and their number."""
        out = np.zeros((len(runs), len(self.c) + 1), np.float32)
        order = np.argsort(np.fromiter(map(len, runs), np.int64, len(runs)), kind="stable")
        for at in range(0, len(order), batch):
            sel = order[at:at + batch]
            both, live, _ = self.states([runs[i] for i in sel])
            out[sel, :-1] = (self.probabilities(both) * live[:, :, None]).sum(1)
            out[sel, -1] = live.sum(1)
        return out


def letter_runs(part: bytes) -> list[bytes]:
    """Lower-cased letter runs, in pieces of at most RUN_BYTES at character borders."""
    text = part.decode().lower()
    if not text.isascii():
        text = "".join(c if c.isalpha() else " " for c in text)
    runs = []
    for w in text.split():
        b = w.encode()
        while len(b) > RUN_BYTES:
            end = next(e for e in range(RUN_BYTES, 0, -1) if b[e] & 0xC0 != 0x80)
            runs.append(b[:end])
            b = b[end:]
        runs.append(b)
    return runs


_LETTER = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)])
_CUT = S.class_cuts(_LETTER)


class LanguageReader:
    """Pooled probabilities of whole texts on a worker."""

    def __init__(self, tagger: ByteTagger):
        self.tagger = tagger
        self.store = S.Rows(np.float32, len(tagger.c) + 1)
        self.cache = S.SegmentCache(self._encode, self.store.reset)

    def _encode(self, parts: list[bytes]) -> int:
        runs = [letter_runs(p) for p in parts]
        flat = [r for rs in runs for r in rs]
        own = np.repeat(np.arange(len(parts)), np.fromiter(map(len, runs), np.int64, len(runs)))
        out = np.zeros((len(parts), self.store.width), np.float32)
        if flat:
            np.add.at(out, own, self.tagger.run_sums(flat))
        return self.store.append(out)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities (texts, languages) and the number of letter bytes."""
        raw = [(t or "").encode().lower() for t in texts]
        total = np.zeros((len(raw), self.store.width))
        for ids, parts in S.chunks(raw, _CUT):
            buf, arr, starts, ends, which = S.cuts(parts, _CUT)
            letters = np.flatnonzero(_LETTER[arr[starts]])
            if len(letters):
                starts, ends, which = starts[letters], ends[letters], which[letters]
                rows = self.cache.rows(buf, starts, ends, S.hash_segments(arr, starts, ends))
                values = self.store.data[rows]
                for c in range(values.shape[1]):
                    total[:, c] += np.bincount(ids[which], weights=values[:, c], minlength=len(raw))
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


def held_out(modulus: int, remainder: int) -> Column:
    """Rows whose crc32 of doc_id as text has the remainder; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def training_runs(labelled: DataFrame, docs_per_lang: int = SAMPLE_DOCS, words: int = SAMPLE_WORDS) -> tuple[list[bytes], list[str]]:
    """Letter runs and their languages from a bounded sample of labelled rows (doc_id, text, lang)."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_lang / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[str, bytes]] = []
            for i, (t, lang) in enumerate(zip(b.column("text").to_pylist(), b.column("lang").to_pylist())):
                got = sorted({r for r in letter_runs(t.encode()) if len(r) <= TRAIN_BYTES})
                rng = np.random.default_rng([len(t), i])
                out += [(lang, got[j]) for j in rng.permutation(len(got))[:words]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "run"])

    found = rows.where(draw < share).mapInArrow(run, "lang string, run binary").orderBy("lang", "run").collect()
    return [bytes(r["run"]) for r in found], [r["lang"] for r in found]


def fit_language_model(labelled: DataFrame, **sample) -> tuple[ByteTagger | None, list[str]]:
    ship_package(labelled.sparkSession)
    runs, langs = training_runs(labelled, **sample)
    if not runs:
        return None, []
    names = sorted(set(langs))
    return ByteTagger(len(names)).fit(runs, np.searchsorted(np.array(names), np.array(langs))), names


def predict_language(docs: DataFrame, tagger: ByteTagger | None, names: list[str], kept: list[str]) -> DataFrame:
    """Columns ``kept`` of ``docs``, ``lang_pred`` and ``score`` for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((tagger, names))

    def make():
        model, langs = shared.value
        reader = LanguageReader(model) if model else None

        def compute(texts: list) -> list[pa.Array]:
            if not reader:
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
            p, n = reader(texts)
            best = p.argmax(1)
            pred = [langs[k] if m else UNKNOWN for k, m in zip(best, n)]
            score = np.where(n > 0, p[np.arange(len(p)), best], 0.0)
            return [pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))]
        return compute

    return add_from_text(docs, kept, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
