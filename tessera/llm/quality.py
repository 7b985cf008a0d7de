"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 3)."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import sliced

DIM, RANK, BINS = 1 << 15, 8, 16
MAX_TRAIN_ROWS = 6_000
#: Most features (8 bytes each) of all training rows together that reach the driver.
MAX_TRAIN_FEATURES = 4_000_000
THRESHOLD = 0.3
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 12, 400, 128, 0.02, 1e-4, 11

STATS = ("bytes", "upper", "digit", "mark", "bar", "line", "space", "beyond", "word", "new_words", "new_lines", "top_line", "short", "end", "loud", "control")
_CLASS = np.zeros(256, np.uint8)
for _k, _set in enumerate((range(65, 91), range(48, 58), b"#$%&*@^~<>{}[]\\_+=", b"|", b"\n", b" \t", range(128, 256), b"!?", range(0, 9)), 1):
    _CLASS[list(_set)] = _k


class WordSlots(dict):
    """word -> its feature, by crc32; kept per worker, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        got = self[word] = len(STATS) * BINS + zlib.crc32(word) % (DIM - len(STATS) * BINS)
        return got


_slots = WordSlots()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text: the bins of its structure statistics, and its hashed words with log counts of unit length."""
    raw = text.encode("utf-8", "surrogatepass")
    words, lines, n = raw.lower().split(), raw.split(b"\n"), max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=10) if raw else np.zeros(10, np.int64)
    nw, distinct = max(1, len(words)), set(words)
    seen: dict[bytes, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    shares = (
        math.log2(n + 1) / 20, c[1] / n, c[2] / n, c[3] / n, c[4] / n, c[5] / n, c[6] / n, c[7] / n, n / nw / 40,
        len(distinct) / nw, len(seen) / len(lines), max(k * len(x) for x, k in seen.items()) / n,
        sum(len(w) < 4 for w in words) / nw, raw[-1:] in (b".", b"!", b"?"), c[8] / n, c[9] / n,
    )
    bins = [s * BINS + min(BINS - 1, int(BINS * math.sqrt(v))) for s, v in enumerate(shares)]
    slots, counts = np.unique(np.fromiter(map(_slots.__getitem__, words), np.int64, len(words)), return_counts=True)
    weight = np.log1p(counts)
    norm = math.sqrt(float(weight @ weight)) or 1.0
    return np.concatenate([np.array(bins, np.int64), slots]), np.concatenate([np.full(len(bins), 1 / math.sqrt(len(bins))), weight / norm])


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + 1/2 sum_f ((v_f.x)^2 - v_f^2.x^2)): all pairs of features in time linear in their number."""

    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        p = self.v[at] * x[:, None]
        s = p.sum(0)
        return self.bias + float(self.w[at] @ x) + 0.5 * float(s @ s - (p * p).sum())

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The scores of many texts at once, null ones as empty."""
        if not texts:
            return np.zeros(0)
        rows = [features(t or "") for t in texts]
        at, x = (np.concatenate(c) for c in zip(*rows, strict=True))
        size = np.array([len(r[0]) for r in rows])
        start = np.cumsum(size) - size
        pv = self.v[at] * x[:, None]
        s = np.add.reduceat(pv, start)
        z = self.bias + np.add.reduceat(self.w[at] * x, start) + 0.5 * (s * s - np.add.reduceat(pv * pv, start)).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
    """Adam on the log loss, ``EPOCHS`` times over the rows and for ``LEAST_STEPS`` at least, in an order fixed by a seed.

    Without rows every score is 0.5.
    """
    if not rows:
        return Machine(0.0, np.zeros(DIM), np.zeros((DIM, RANK)))
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(DIM), rng.normal(0, 0.01, (DIM, RANK)))
    p = np.clip(labels.mean(), 0.01, 0.99)
    m.bias = float(np.log(p / (1 - p)))
    moments, step = [np.zeros((DIM, RANK + 1)), np.zeros((DIM, RANK + 1))], 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // max(BATCH, len(rows))))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            mine = order[k : k + BATCH]
            at = np.concatenate([rows[i][0] for i in mine])
            x = np.concatenate([rows[i][1] for i in mine])
            size = np.array([len(rows[i][0]) for i in mine])
            row, start = np.repeat(np.arange(len(mine)), size), np.cumsum(size) - size
            pv = m.v[at] * x[:, None]
            s = np.add.reduceat(pv, start)
            z = m.bias + np.add.reduceat(m.w[at] * x, start) + 0.5 * (s * s - np.add.reduceat(pv * pv, start)).sum(1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[mine]) / len(mine)
            used, inv = np.unique(at, return_inverse=True)
            each = (g[row] * x)[:, None] * np.concatenate([np.ones((len(at), 1)), s[row] - pv], 1)
            grad = np.stack([np.bincount(inv, each[:, f], len(used)) for f in range(RANK + 1)], 1)
            now = np.concatenate([m.w[used, None], m.v[used]], 1)
            grad += DECAY * now
            step += 1
            a, b = moments
            a[used] = 0.9 * a[used] + 0.1 * grad
            b[used] = 0.999 * b[used] + 0.001 * grad * grad
            now -= RATE * (a[used] / (1 - 0.9**step)) / (np.sqrt(b[used] / (1 - 0.999**step)) + 1e-8)
            m.w[used], m.v[used] = now[:, 0], now[:, 1:]
            m.bias -= RATE * float(g.sum())
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, max_features: int = MAX_TRAIN_FEATURES) -> Machine:
    """Fit on at most ``max_rows`` labelled rows that are not held out, chosen by a hash of the id, and on as many of them as have
    ``max_features`` features together: the bounds on what reaches the driver.

    Null labels and ids teach nothing; of an id with several labels the largest counts, of one with several texts the least; null texts are
    empty. Without labels or documents every score is 0.5.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def run(batches):
        for b in sliced(batches):
            got = [features(t or "") for t in b.column(1).to_pylist()]
            ends = pa.array(np.cumsum([0, *(len(a) for a, _ in got)]), pa.int32())
            flat = lambda k, t: pa.array(np.concatenate([r[k] for r in got] or [[]]).astype(t))
            lists = [pa.ListArray.from_arrays(ends, flat(k, t)) for k, t in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], names=["doc_id", "y", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = picked.mapInArrow(run, f"doc_id {kind}, y int, at array<int>, x array<float>")
    upto = F.sum(F.size("at")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # at most max_rows rows
    got = rows.withColumn("upto", upto).where(F.col("upto") <= max_features).drop("upto").toArrow()
    at, x = (got[c].combine_chunks() for c in ("at", "x"))
    ends, flat_at, flat_x = at.offsets.to_numpy(), at.values.to_numpy().astype(np.int64), x.values.to_numpy().astype(float)
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    return fit([(flat_at[ends[i] : ends[i + 1]], flat_x[ends[i] : ends[i + 1]]) for i in order], got["y"].to_numpy()[order].astype(float))


def score(docs: DataFrame, model: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted``, in the place of columns of these names.

    Null texts score as empty; every row gets a score.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        m = shared.value
        for b in sliced(batches):
            scores = m.scores(b.column(names.index(text_col)).to_pylist())
            predicted = pa.array((scores >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), predicted], names=[*names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def accepted(docs: DataFrame, model: Machine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are; null texts score as empty."""
    shared, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for b in sliced(batches):
            yield b.filter(pa.array(m.scores(b.column(place).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; nothing but the text enters a score.

    Null texts score as empty ones; rows with one text have one score, whatever their ids; an empty table gives an empty table.
    """
    model = train(docs, labels, max_rows=max_rows)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
