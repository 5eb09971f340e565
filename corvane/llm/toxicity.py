"""Toxicity by compression distance: what a zstandard dictionary of toxic text saves on top of one of ordinary text.

Texts are lower-cased, everything but letters becomes a blank, and the rest is cut at blanks into windows of about ``WINDOW`` bytes.
Two dictionaries are trained separately. The ordinary one is trained on windows of ordinary documents. The toxic one is trained on
the words of toxic documents that stand in many more different surroundings there than in ordinary ones (``ODDS``), so that it
spends its bytes on what tells the two apart; surroundings count once, as copies of one document are no evidence. A window's distance is its compressed length
under the ordinary dictionary less that under both, the toxic one in front: 0 for ordinary windows, several bytes where the toxic
dictionary has something that the ordinary one has not. A document's windows are reduced to their mean and largest distance and to numbers and shares
of windows beyond two thresholds, which a logistic regression turns into a score. It is fitted on distances under dictionaries that have not seen the document
(``FOLDS`` parts of the sample).

Learning uses a bounded sample of labelled rows: at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS``, the first by a hash, of texts of at most
``MOST_BYTES``. The model is a few kilobytes, which are broadcast. Scoring reads whole texts, one window at a time.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .langid import is_held_out

WINDOW = 48
TOXIC_BYTES = 2048
ORDINARY_BYTES = 8192
ODDS = 16.0
LEAST_SURROUNDINGS = 5
THRESHOLDS = (4, 6)
TOXIC_ROWS = 1500
ORDINARY_ROWS = 4500
MOST_BYTES = 1 << 16
FOLDS = 3

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WINDOW = re.compile(rb"[^ ].{0,%d}[^ ]{0,%d}" % (WINDOW, WINDOW))


def windows(text: bytes) -> list[bytes]:
    """Runs of whole words, each with a blank on either side; a word of more than twice WINDOW bytes is cut. A text without letters has one, the empty one."""
    found = _WINDOW.findall(b" ".join(text.translate(_LETTERS).split()))
    return [b" %b " % w.rstrip() for w in found] or [b""]


def _compressor(content: bytes):
    import zstandard as zs

    known = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
    how = zs.ZstdCompressionParameters(
        window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, target_length=64, strategy=zs.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    known.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(dict_data=known, compression_params=how)


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary that is trained on these samples; none where they are too few to train on."""
    import zstandard as zs

    try:
        whole = zs.train_dictionary(size + 600, samples, k=segment, d=6).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]
    # the content stands behind the entropy tables, which end with the three starting offsets 1, 4 and 8
    return whole.partition(b"\x01\0\0\0\x04\0\0\0\x08\0\0\0")[2][-size:] or whole[-size:]


@dataclass
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    _codecs: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_codecs": []}

    def distances(self, text: bytes) -> np.ndarray:
        if not self._codecs:
            self._codecs[:] = [_compressor(self.ordinary), _compressor(self.toxic + self.ordinary)]
        alone, both = (c.compress for c in self._codecs)
        return np.array([len(alone(w)) - len(both(w)) for w in windows(text)])

    def score(self, text: bytes) -> float:
        x = (features(self.distances(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40))))


def features(d: np.ndarray) -> np.ndarray:
    over = [(d >= t).sum() for t in THRESHOLDS]
    return np.array([d.mean(), d.max(), np.log(len(d)), *(n / len(d) for n in over), *np.log1p(over)])


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words of toxic texts, each as often as it has different neighbours there, whose share of surroundings is ODDS times that in ordinary texts."""

    def surroundings(texts):
        found = set()
        for text in texts:
            w = text.translate(_LETTERS).split()
            found.update(zip([b"", *w], w, [*w[1:], b""]))
        return Counter(map(itemgetter(1), found))

    a, b = surroundings(toxic), surroundings(ordinary)
    ratio = (sum(b.values()) + 1) / (sum(a.values()) + 1)
    return [b" %b " % w for w in sorted(a) if a[w] >= LEAST_SURROUNDINGS and (a[w] + 0.5) / (b.get(w, 0) + 0.5) * ratio >= ODDS for _ in range(a[w])]


def _dictionaries(rows: list[tuple[int, bytes]], rng: np.random.Generator) -> tuple[bytes, bytes]:
    parts = [[t for y, t in rows if y == k] for k in (1, 0)]
    words = telling_words(*parts)
    words = [words[i] for i in rng.permutation(len(words))] * 4  # every stretch of the samples has all words
    return _dictionary(words, TOXIC_BYTES, 24), _dictionary([w for t in parts[1] for w in windows(t)], ORDINARY_BYTES, 32)


def fit(rows: list[tuple[int, bytes]], seed: int = 7) -> ToxicityModel | None:
    """Learn from (label, text) rows; None unless both labels occur. Toxic rows weigh a third of the ordinary ones in all."""
    labels = np.array([y for y, _ in rows], float)
    if not len(rows) or labels.min() == labels.max():
        return None
    rng, none = np.random.default_rng(seed), (np.zeros(0), np.zeros(1), np.ones(1))
    part = np.empty(len(rows), int)
    for y in (0, 1):  # either label in every fold
        at = np.flatnonzero(labels == y)
        part[rng.permutation(at)] = np.arange(len(at)) % FOLDS
    x = np.zeros((len(rows), len(features(np.zeros(1)))))
    for k in range(FOLDS):
        apart = ToxicityModel(*_dictionaries([r for r, p in zip(rows, part) if p != k], rng), *none)
        for i in np.flatnonzero(part == k):
            x[i] = features(apart.distances(rows[i][1]))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    share = np.where(labels == 1, len(rows) / 4 / labels.sum(), len(rows) * 3 / 4 / (1 - labels).sum())
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        w += np.linalg.solve((z.T * (share * p * (1 - p) + 1e-9)) @ z + 0.1 * np.eye(len(w)), z.T @ (share * (labels - p)) - 0.1 * w)
    return ToxicityModel(*_dictionaries(rows, rng), w, mean, scale)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Learn labels.toxic of the documents that are not held out; None unless both labels occur among them.

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Rows with a null doc_id, text or label are not learned from, nor
    are texts of more than MOST_BYTES; a doc_id that is labelled both ways counts as toxic. Repeated documents are taken each time, within the bounds.
    """
    tk.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~is_held_out() & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(~is_held_out() & (F.octet_length("text") <= MOST_BYTES))
    rows = []
    for y, most in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS)):
        picked = known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(most)  # of fixed size
        of = texts.join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(most)
        rows += [(y, r.text.encode()) for r in of.collect()]
    return fit(rows)


def score(docs: DataFrame, model: ToxicityModel | None, keep: list[str] | None = None) -> DataFrame:
    """(kept columns, score, predicted) for every row of documents.

    score: 0 to 1, higher where label 1 is likelier; a null text counts as empty, and empty texts and those without letters have the score of one window
    at distance 0. predicted: 1 from 0.5 on. Without a model, score 0. Each row is judged by its whole text alone, so repeated
    rows are judged alike; keep names the columns carried along (doc_id), as ``name_in`` where the result has that name.
    """
    spark = docs.sparkSession
    tk.ship(spark)
    keep = keep or ["doc_id"]
    known = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            model, found = known.value, []
            for _, data, off in tk.blocks(batch.column(batch.num_columns - 1)):
                whole = data.tobytes()
                found += [model.score(whole[a:b]) if model else 0.0 for a, b in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=[f"k{i}" for i in range(len(keep))] + ["score", "predicted"]
            )

    rows = docs.select(*keep, F.col("text").cast("string"))
    kinds = [f.dataType.simpleString() for f in rows.schema.fields[:-1]]
    rows = rows.toDF(*[f"k{i}" for i in range(len(keep))], "text")
    ddl = ", ".join(f"k{i} {kind}" for i, kind in enumerate(kinds))
    return rows.mapInArrow(tk.tidy_map(run), f"{ddl}, score double, predicted int").toDF(*tk.kept_names(keep, ("score", "predicted")), "score", "predicted")
