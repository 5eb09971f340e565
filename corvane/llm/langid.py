"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A document's vector is the mean of the embeddings of its byte 2- and 3-grams, taken inside words with a blank on each side and hashed
into ``BUCKETS``. Training uses a bounded sample of different labelled rows (about ``SAMPLE`` for each label, by a hash of doc_id and text, fewer where
that makes more than ``MOST_ROWS`` for all labels), and to about half of them, by another bit of that hash, a disguised copy: its letters are
exchanged by a random permutation, so it has words and lengths of prose but no learned language. Disguised rows are a class of
their own, which is never predicted but takes probability from the others. A fifth of the sample sets the softmax temperature
and the confidence under which a prediction is rejected: the one that rejects ``LOST`` of the right predictions there.
Because the mean and the softmax layer are linear, prediction needs one score for each bucket and label,
which has a fixed size and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 1 << 14
SAMPLE = 800
MOST_ROWS = 20_000
LOST = 0.002
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def subwords(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of a block, document after document, and the offsets of documents."""
    n = len(off) - 1
    text = np.full(len(data) + n + 3, 32, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(off))
    text[np.arange(len(data)) + doc + 1] = _LETTER[data]
    pair = text[:-2] | text[1:-1] << 8
    triple = pair | text[2:] << 16
    at = np.flatnonzero(text[1:-1] != 32)  # the second byte is a letter, so every letter has one gram of either size
    codes = np.stack((pair[at] | np.uint32(1 << 24), triple[at]), axis=1).ravel().astype(np.uint64)
    buckets = (codes * tk.U(0x9E3779B97F4A7C15) >> tk.U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return buckets, 2 * np.searchsorted(at, off + np.arange(n + 1))


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a Unicode letter."""
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))
    found = total[off[1:]] > total[off[:-1]]
    wide = np.concatenate(([0], np.cumsum(data > 127)))
    for d in np.flatnonzero(~found & (wide[off[1:]] > wide[off[:-1]])):
        found[d] = any(c.isalpha() for c in data[off[d] : off[d + 1]].tobytes().decode())
    return found


def disguised(data: np.ndarray, off: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The same texts with a permutation of the letters a-z in each, and one of the bytes of other characters."""
    out = data.copy()
    for a, b in zip(off[:-1], off[1:]):
        table = np.arange(256, dtype=np.uint8)
        letters = rng.permutation(26)
        table[97:123], table[65:91], table[128:] = 97 + letters, 65 + letters, 128 + rng.permutation(128)
        out[a:b] = table[data[a:b]]
    return out


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # a row for each bucket, a column for each label and one for no language, in units of the calibrated softmax
    bias: np.ndarray
    threshold: float

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Of each text the probability of each label; what is missing to 1 is that of no learned language."""
        buckets, at = subwords(data, off)
        total = np.empty((len(off) - 1, len(self.bias)))
        doc = np.repeat(np.arange(len(off) - 1), np.diff(at))
        for k in range(len(self.bias)):
            total[:, k] = np.bincount(doc, weights=self.scores[:, k][buckets], minlength=len(total))
        logits = total / np.maximum(1, np.diff(at))[:, None] + self.bias
        logits -= logits.max(axis=1, keepdims=True, initial=-np.inf)
        p = np.exp(logits)
        return (p / p.sum(axis=1, keepdims=True))[:, : len(self.labels)]


def is_held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the doc_id as text is a multiple of 5; a null doc_id is held out too, so nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _sample(docs: DataFrame) -> DataFrame:
    """About SAMPLE different rows for each label, or fewer to stay within MOST_ROWS: those whose hash is under the label's share, or all of a rarer label.

    Copies of a row count once, so neither ids that repeat nor the way ids are given out decide what is learned.
    """
    rows = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("h", F.xxhash64("doc_id", "text", F.lit("langid")))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("count"))
    labels = counts.count()
    if labels > MOST_ROWS:
        raise ValueError(f"{labels} labels are more than the {MOST_ROWS} rows that are learned from")
    place = F.pmod("h", F.lit(1 << 30)).cast("double") / (1 << 30)
    near = rows.join(F.broadcast(counts), "lang").where(place * F.col("count") < min(SAMPLE, MOST_ROWS // max(1, labels)))
    return near.select("h", "doc_id", "text", "lang").dropDuplicates(["h", "lang"]).orderBy("h", "lang", "doc_id", "text").limit(MOST_ROWS)


def _features(docs: DataFrame) -> list:
    """(lang, buckets, weights) of the sample, and of the disguised copies with a null lang.

    At most BUCKETS numbers for each row, whatever its length, and 2 * MOST_ROWS rows reach the driver, where Spark holds several copies of
    them on their way: they come as packed buckets and counts and become weights there.
    """

    def counted(data, off):
        buckets, at = subwords(data, off)
        for a, b in zip(at[:-1], at[1:]):
            ids, counts = np.unique(buckets[a:b], return_counts=True)
            yield tk.pack(ids.astype(np.uint16), delta=True), tk.pack(counts.astype(np.uint32))

    def run(batches):
        for batch in batches:
            ids, lang = batch.column("h").to_pylist(), batch.column("lang").to_pylist()
            out = []
            for first, data, off in tk.blocks(batch.column("text")):
                for i, packed in enumerate(counted(data, off)):
                    out.append((ids[first + i], lang[first + i], *packed))
                for i in range(len(off) - 1):
                    if ids[first + i] >> 40 & 1:
                        text = data[off[i] : off[i + 1]]
                        rng = np.random.default_rng(abs(ids[first + i]))
                        out += [(ids[first + i], None, *x) for x in counted(disguised(text, np.array([0, len(text)]), rng), np.array([0, len(text)]))]
            columns = list(zip(*out)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "lang", "ids", "counts"])

    rows = docs.select("h", "text", "lang").mapInArrow(tk.tidy_map(run), "h long, lang string, ids binary, counts binary").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["h"][i].as_py(), rows["lang"][i].as_py() or "", rows["lang"][i].as_py() is None))
    out = []
    for i in order:
        ids, counts = tk.unpack(rows["ids"][i].as_py(), np.uint16, delta=True), tk.unpack(rows["counts"][i].as_py(), np.uint32)
        if len(ids):
            out.append((rows["lang"][i].as_py(), ids.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
    return out


def fit(rows: list, dim: int = 16, epochs: int = 6, rate: float = 4.0, seed: int = 7) -> LanguageModel | None:
    """Plain SGD over (label, buckets, weights) rows in a seeded order, label None for no language; None without labelled rows."""
    labels = sorted({r[0] for r in rows if r[0] is not None})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    check, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    embed = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels) + 1), np.float32), np.zeros(len(labels) + 1, np.float32)
    number = {x: i for i, x in enumerate([*labels, None])}
    target = np.array([number[r[0]] for r in rows])
    done, steps = 0, epochs * len(train)
    for _ in range(epochs):
        for i in rng.permutation(train):
            _, ids, weights = rows[i]
            lr = np.float32(rate * (1 - done / steps))
            hidden = weights @ embed[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= np.float32(0.01) * lr * p
            embed[ids] -= lr * np.outer(weights, back)
            done += 1
    scores = embed @ out
    seen = check if len(check) else train
    logits = np.array([rows[i][2] @ scores[rows[i][1]] + bias for i in seen], np.float64)
    truth = target[seen]

    def soft(t):
        e = np.exp(logits / t - (logits / t).max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    loss = {t: -np.log(np.maximum(soft(t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.25, 8, 41)}
    best = min(loss, key=loss.get)
    p = soft(best)
    best_label = p[:, :-1].argmax(axis=1)
    right = p[np.arange(len(truth)), best_label][best_label == truth]
    threshold = float(min(0.5, np.quantile(right, LOST))) if len(right) else 0.0
    return LanguageModel(labels, scores / best, bias / best, threshold)


def train(docs: DataFrame) -> LanguageModel | None:
    """Learn from text and lang of the rows that are not held out; None if there is none.

    docs: doc_id, text, lang; other columns are ignored. Rows with a null doc_id, text or lang are not learned from, nor are
    texts without letters; repeated rows count once.
    """
    tk.ship(docs.sparkSession)
    return fit(_features(_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))))


def predict(docs: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, lang_pred, score, rejected) for every row of documents.

    lang_pred: the most probable label, of equal ones the first by name; "und" with score 0 where the text is null or
    has no letter, and for all rows if the model has learned from none. score: its calibrated probability, next to the other
    labels and to no learned language. rejected: "und", or a score under the model's threshold. Each row is judged by its whole text alone; keep names the
    columns carried along (doc_id), as ``name_in`` where the result has that name.
    """
    spark = docs.sparkSession
    tk.ship(spark)
    keep = keep or ["doc_id"]
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            model, pred, score = known.value, [], []
            for _, data, off in tk.blocks(batch.column(batch.num_columns - 1)):
                ok = has_letter(data, off)
                p = model.probabilities(data, off) if model else np.zeros((len(ok), 1))
                best = p.argmax(axis=1)
                pred += [model.labels[k] if model and o else UNKNOWN for k, o in zip(best, ok)]
                score += np.where(ok, p[np.arange(len(best)), best], 0.0).tolist()
            low = model.threshold if model else 0.0
            rejected = [x == UNKNOWN or s < low for x, s in zip(pred, score)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    made = ("lang_pred", "score", "rejected")
    rows = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keep)], F.col("text").cast("string").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(tk.tidy_map(run), f"{ddl}, lang_pred string, score double, rejected boolean").toDF(*tk.kept_names(keep, made), *made)
