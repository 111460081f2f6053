"""Quality classifier by gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded from its bytes (hashed character trigrams and shares
of byte classes); a learned layer embeds it; gated attention, learned from document labels alone, weighs the passages;
the weighted embedding is scored. Training reads a bounded sample of labelled rows, scoring all passages of all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.registry import query, table
from assay.llm.words import mix, text_bytes, unspaced

PASSAGE = 64  # words
BUCKETS = 256  # of character trigrams
CLASSES = ("letter", "capital", "digit", "space", "line", "mark", "symbol", "wide")
FEATURES = BUCKETS + len(CLASSES) + 2
HIDDEN, GATE = 32, 16
#: Labelled documents that training reads at most, those whose hashed ids are smallest; the only bound on learning.
TRAINING_ROWS = 6000
SHRINK = 16  # words
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
CHUNK = 1 << 18  # bytes encoded at a time


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 6, np.int64)
    kind[97:123] = 0
    kind[65:91] = 1
    kind[48:58] = 2
    kind[32] = kind[9] = 3
    kind[10:14] = 4
    kind[[ord(c) for c in ".,;:!?'\"()-"]] = 5
    kind[128:] = 7
    return kind


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the offsets of the rows among them; a row without words has one empty passage."""
    data, rows = text_bytes(column)
    word_bytes, kinds = unspaced(), _byte_classes()
    codes = mix(np.arange(1, 769, dtype=np.uint64)).astype(np.uint32).reshape(3, 256)
    parts, counts = [], []
    low = 0
    while low < len(rows) - 1:
        high = max(low + 1, int(np.searchsorted(rows, rows[low] + CHUNK, "right")) - 1)
        base, size = int(rows[low]), int(rows[high] - rows[low])
        bytes_ = data[base : base + size]
        ends = rows[low : high + 1] - base
        inside = word_bytes[bytes_]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cut = ends[(ends > 0) & (ends < size)]
        first[cut] = inside[cut]
        starts = np.flatnonzero(first)
        word_ends = np.searchsorted(starts, ends)
        n_words = np.diff(word_ends)
        n_parts = np.maximum(1, -(-n_words // PASSAGE))
        opens = np.concatenate([[0], np.cumsum(n_parts)])
        # A passage begins with its row or with its first word.
        number = np.arange(opens[-1]) - np.repeat(opens[:-1], n_parts)
        word = np.repeat(word_ends[:-1], n_parts) + number * PASSAGE
        begin = np.where(number > 0, starts[np.minimum(word, max(len(starts) - 1, 0))] if len(starts) else 0, np.repeat(ends[:-1], n_parts))
        length = np.diff(np.append(begin, size))
        owner = np.repeat(np.arange(len(begin)), length)
        out = np.zeros((len(begin), FEATURES), np.float32)
        if size:
            kind = np.bincount(owner * len(CLASSES) + kinds[bytes_], minlength=len(begin) * len(CLASSES)).reshape(len(begin), -1)
            total = np.maximum(length, 1)[:, None]
            out[:, BUCKETS:-2] = kind / total
            if size > 2:
                gram = (codes[0][bytes_[:-2]] + codes[1][bytes_[1:-1]] + codes[2][bytes_[2:]]) * np.uint32(0x9E3779B1) >> np.uint32(24)
                # Not those that begin in another row than they end in.
                whole = np.ones(size - 2, bool)
                for back in (1, 2):
                    at = ends[1:-1] - back
                    whole[at[(at >= 0) & (at < size - 2)]] = False
                grams = np.bincount((owner[2:] * BUCKETS + gram)[whole], minlength=len(begin) * BUCKETS)
                out[:, :BUCKETS] = np.sqrt(grams.reshape(len(begin), -1) / total)
            n = np.minimum(PASSAGE, np.repeat(n_words, n_parts) - number * PASSAGE)
            out[:, -2] = n / PASSAGE
            out[:, -1] = np.log1p(length / np.maximum(n, 1))
        parts.append(out)
        counts.append(n_parts)
        low = high
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets[:-1], axis=0)


class AttentionPooling:
    """Embedding, gated attention over a bag's passages, and a logistic score of the weighted embedding."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        weight = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.p = {
            "embed": weight(FEATURES, HIDDEN), "embed_bias": np.zeros(HIDDEN),
            "view": weight(HIDDEN, GATE), "gate": weight(HIDDEN, GATE), "attend": weight(GATE, 1),
            "score": weight(HIDDEN, 1), "score_bias": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        p, owner = self.p, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        h = np.tanh(x @ p["embed"] + p["embed_bias"])
        view, gate = np.tanh(h @ p["view"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        e = (view * gate) @ p["attend"]
        e = np.exp(e - np.maximum.reduceat(e, offsets[:-1])[owner])
        a = e / _sums(e, offsets)[owner]
        z = _sums(a * h, offsets)
        y = 1 / (1 + np.exp(-np.clip(z @ p["score"] + p["score_bias"], -30, 30)))
        return {"h": h, "view": view, "gate": gate, "a": a, "z": z, "y": y[:, 0], "owner": owner}

    def gradients(self, x: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, offsets)
        owner, h, a = f["owner"], f["h"], f["a"]
        dy = ((f["y"] - labels) / len(labels))[:, None]
        dz = dy @ p["score"].T
        da = (dz[owner] * h).sum(1, keepdims=True)
        de = a * (da - _sums(a * da, offsets)[owner])
        dm = de @ p["attend"].T
        dview, dgate = dm * f["gate"] * (1 - f["view"] ** 2), dm * f["view"] * f["gate"] * (1 - f["gate"])
        dh = (a * dz[owner] + dview @ p["view"].T + dgate @ p["gate"].T) * (1 - h**2)
        return {
            "embed": x.T @ dh, "embed_bias": dh.sum(0), "view": h.T @ dview, "gate": h.T @ dgate,
            "attend": (f["view"] * f["gate"]).T @ de, "score": f["z"].T @ dy, "score_bias": dy.sum(0),
        }

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> AttentionPooling:
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-3
        bags = [self.scaled(b) for b in bags]
        rng, moment, square, step = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(EPOCHS):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                offsets = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
                step += 1
                for k, g in self.gradients(np.concatenate([bags[i] for i in chosen]), offsets, labels[chosen]).items():
                    g = g + DECAY * self.p[k]
                    moment[k] = 0.9 * moment.get(k, 0) + 0.1 * g
                    square[k] = 0.999 * square.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * moment[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(self.scaled(x), offsets)["y"]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Standard features; the trigram shares of a passage count less the fewer words they come from."""
        out = (x - self.mean) / self.scale
        words = x[:, -2:-1] * PASSAGE
        out[:, :BUCKETS] *= words / (words + SHRINK)
        return out


def held_out() -> F.Column:
    """Rows no label is learnt from: crc32 of the id as text leaves 1 when divided by 3, or there is no id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _encode_rows(batches):
    for batch in batches:
        x, offsets = encode(batch["text"])
        bags = pa.array([x[a:b].astype(np.float32).tobytes() for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], bags], names=["doc_id", "quality", "bag"])


def _score_rows(model):
    def run(batches):
        for batch in batches:
            x, offsets = encode(batch["text"])
            scores = model.score(x, offsets) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(scores)], names=["doc_id", "score"])

    return run


def fit_quality(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> AttentionPooling | None:
    """A model of ``labels`` (doc_id, quality 0 or 1) over the texts, learnt from at most ``rows`` labelled documents
    that are not held out; None where there are none."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & ~held_out())
    chosen = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows)
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    examples = texts.mapInArrow(_encode_rows, "doc_id long, quality int, bag binary").toArrow()
    # A row for each training example in an order of its own, so that the fit doesn't depend on the tasks.
    found = sorted(zip(examples["doc_id"].to_pylist(), examples["quality"].to_pylist(), examples["bag"].to_pylist()))
    if not found:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in found]
    return AttentionPooling().fit(bags, np.array([q for _, q, _ in found], np.float64))


def quality_scores(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted.

    A null or empty text is scored as one passage without words. Without any label to learn from the score is 0.5.
    """
    model = fit_quality(documents, labels, rows)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        scored = docs.select("doc_id", F.lit(0.5).alias("score"))
    else:
        scored = docs.mapInArrow(_score_rows(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_attention_pooling")
def op4_attention_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def accepted_documents(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows of ``documents`` whose text scores at least 0.5, with all their columns."""
    model = fit_quality(documents, labels, rows)
    if model is None:
        return documents

    def keep(batches):
        for batch in batches:
            x, offsets = encode(batch["text"])
            yield batch.filter(pa.array(model.score(x, offsets) >= 0.5)) if batch.num_rows else batch

    return documents.mapInArrow(keep, documents.schema)
