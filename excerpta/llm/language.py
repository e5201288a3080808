"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's features are the two- and three-character windows of its lower-cased letters, every other character being a
word's border; windows of borders alone are left out. Each window hashes to one of ``BUCKETS`` rows of an embedding table,
a text is the average of its rows, and a linear softmax over that average gives the language.

Training: a bounded sample of labelled rows (``sample`` per label, those of least hash of id and text) is turned into
bucket counts by the tasks, so whole texts are used and at most ``BUCKETS`` numbers per sampled row reach the driver, where
numpy runs stochastic gradient descent. One sampled row in five is kept from it. On these, and on short draws of their
windows, a temperature and a shrinkage of short texts are fitted. Two levels reject a text: a confidence under half of what
all but ``tolerance`` of the right answers reach, and a share of windows never met in training above what all but
``tolerance`` of the kept rows and draws have, carried a third of the way to the share that chance windows would have.

Prediction: the average and the softmax's matrix are linear, so the model is one table of class scores per bucket. All
the windows of a run of texts are hashed, looked up and summed as arrays. Rows never leave their task.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from excerpta.llm.common import batches, in_small_batches, per_worker, settle, slices, text_runs

BUCKETS = 1 << 15
DIMENSIONS = 16
SAMPLE = 600
LABELS = 1000
TOLERANCE = 0.001
RUN_CHARS = 1 << 16
UNDETERMINED = "und"
COUNTED = pa.schema([("label", pa.string()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
PREDICTED = pa.schema([("_lang_pred", pa.string()), ("_score", pa.float64()), ("_rejected", pa.bool_())])


def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def windows(texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each window, number of the text it stands in), windows of one text together."""
    joined = " " + " ".join(t.lower() for t in texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t.lower()) + 1 for t in texts])
    owner = np.repeat(np.arange(len(texts)), sizes)  # of the window that starts one place before
    letter = is_letter[codes]
    codes = np.where(letter, codes, 0).astype("u8")
    pair = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    two = letter[:-1] | letter[1:]
    triple = pair[:-1] * np.uint64(0x165667B19E3779F9) + codes[2:] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)
    three = two[:-1] & letter[1:-1]
    shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
    # Both windows that start at a place belong to the text that the place after it is in.
    at_two, at_three = np.flatnonzero(two[: len(owner)]), np.flatnonzero(three[: len(owner)])
    buckets = np.concatenate([_mixed(pair[at_two]) >> shift, _mixed(triple[at_three]) >> shift]).astype("i4")
    owners = np.concatenate([owner[at_two], owner[at_three]])
    return buckets, owners


def _mixed(h):
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Model:
    """Class scores per bucket, labels, temperature, shrinkage of short texts, rejection level, which buckets training met
    and the share of others that rejects."""

    def __init__(self, labels, table, temperature, shrinkage, level, met, strange):
        self.labels, self.table, self.temperature, self.shrinkage, self.level = labels, table, temperature, shrinkage, level
        self.met, self.strange = met, strange

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, whether the text has any letter, whether too many of its windows are new) of each text."""
        is_letter = per_worker("letters", letters)
        buckets, owners = windows(texts, is_letter)
        n = np.bincount(owners, minlength=len(texts))
        scores = np.empty((len(texts), len(self.labels)))
        for k in range(len(self.labels)):
            scores[:, k] = np.bincount(owners, self.table[k][buckets], len(texts))
        new = np.bincount(owners, ~self.met[buckets], len(texts)) > self.strange * n
        return calibrated(scores / np.maximum(n, 1)[:, None], n, self.temperature, self.shrinkage), n > 0, new


def softmax(scores):
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def calibrated(scores, n, temperature, shrinkage):
    """Probabilities of average scores over ``n`` windows: few windows say little, so their scores count less."""
    return softmax(scores * (n / (n + shrinkage))[:, None] / temperature)


def bucket_counts(docs: DataFrame, label: str, text: str) -> DataFrame:
    """Label and the counts of each row's buckets."""

    def run(it):
        def rows():
            for batch in slices(it):
                labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_runs(texts, RUN_CHARS):
                    buckets, owners = windows(texts[a:b], per_worker("letters", letters))
                    for n in range(b - a):
                        found, counts = np.unique(buckets[owners == n], return_counts=True)
                        yield labels[a + n], found, counts

        return batches(rows(), COUNTED, 64)

    return in_small_batches(docs.select(F.col(label), F.col(text))).mapInArrow(run, "label string, buckets array<int>, counts array<int>")


def fit(rows: list[tuple], epochs=6, rate=0.5, seed=7, tolerance=TOLERANCE) -> Model | None:
    """A model of rows (label, buckets, counts); None without any. Ties and repeated rows count as they come."""
    rows = [(label, np.asarray(b), np.asarray(c, "f8") / np.sum(c), int(np.sum(c))) for label, b, c in rows if len(b)]
    labels = sorted({r[0] for r in rows})
    if not labels:
        return None
    random = np.random.default_rng(seed)
    rows.sort(key=lambda r: (r[0], len(r[1]), tuple(r[1][:8])))
    rows = [rows[i] for i in random.permutation(len(rows))]
    kept, seen = rows[::5], [r for n, r in enumerate(rows) if n % 5] or rows
    number = {label: k for k, label in enumerate(labels)}
    table = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    matrix = random.normal(0, 0.1, (DIMENSIONS, len(labels)))
    steps = epochs * len(seen)
    for step in range(steps):
        label, buckets, weights, _ = seen[random.integers(len(seen))]
        slow = rate * (1 - step / steps)
        average = weights @ table[buckets]
        error = softmax(average @ matrix)
        error[number[label]] -= 1
        back = matrix @ error
        matrix -= slow * np.outer(average, error)
        # An average spreads its gradient thinly; rows are scaled back up, to the text's most frequent window.
        table[buckets] -= slow * np.outer(weights / weights.max(), back)
    classes = table @ matrix
    met = np.zeros(BUCKETS, bool)
    for _, buckets, _, _ in seen:
        met[buckets] = True
    scores, n, truth, new = [], [], [], []
    for label, buckets, weights, size_of_row in kept:
        for size in (3, 10, 30, 100, None):  # draws stand for short texts of the same language
            drawn = buckets if size is None else random.choice(buckets, size, p=weights / weights.sum())
            scores.append(weights @ classes[buckets] if size is None else classes[drawn].mean(0))
            new.append(weights @ ~met[buckets] if size is None else (~met[drawn]).mean())
            n.append(size_of_row if size is None else size)
            truth.append(number[label])
    scores, n, truth, new = map(np.array, (scores, n, truth, new))
    loss = lambda t, s: -np.log(calibrated(scores, n, t, s)[np.arange(len(truth)), truth] + 1e-12).mean()
    grid = [(t, s) for t in np.geomspace(0.02, 5, 25) for s in (0, *np.geomspace(1, 300, 16))]
    temperature, shrinkage = min(grid, key=lambda p: loss(*p))
    chances = calibrated(scores, n, temperature, shrinkage)
    right = chances.max(1)[chances.argmax(1) == truth]
    level = 0.5 * np.quantile(right, tolerance) if len(right) else 0.0
    usual, chance = np.quantile(new, 1 - tolerance), 1 - met.mean()
    strange = usual + max(0.0, chance - usual) / 3
    return Model(labels, np.ascontiguousarray(classes.T), float(temperature), float(shrinkage), float(level), met, float(strange))


def train(docs: DataFrame, label="lang", text="text", key="doc_id", sample=SAMPLE, labels=LABELS, **options) -> Model | None:
    """Fit on at most ``sample`` rows per label: those of least hash of id and text among labelled rows.

    The sample is drawn by row: rows of one id and different texts are different rows, a null id is an id, and rows that
    repeat each other (label, id and text) count once. A null text is empty and teaches nothing. Without labelled rows
    there is no model. More than ``labels`` labels are refused: sample and labels bound what reaches the driver.
    """
    rows = docs.where(F.col(label).isNotNull()).select(
        F.col(label).cast("string").alias("_label"),
        F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("_hash"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )
    hashes = settle(rows.select("_label", "_hash"), "language-rows")
    many = hashes.groupBy("_label").agg(F.approx_count_distinct("_hash", 0.02).alias("n")).limit(labels + 1)
    shares = [(r["_label"], min(1.0, (2 * sample + 100) / max(1, r["n"]))) for r in many.collect()]
    if len(shares) > labels:
        raise ValueError(f"more than {labels} labels")
    if not shares:
        return None
    # About twice the sample of each label is ranked: the others' hashes are too large to be among the least.
    place = F.expr("pmod(_hash, 1000003)")
    shares = docs.sparkSession.createDataFrame(shares, "_label string, _share double")
    small = hashes.join(F.broadcast(shares), "_label").where(place < 1000003 * F.col("_share")).select("_label", "_hash").distinct()
    first = Window.partitionBy("_label").orderBy(place, "_hash")
    chosen = small.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample).drop("_rank")
    texts = rows.join(F.broadcast(chosen), ["_label", "_hash"], "left_semi")  # at most sample per label
    texts = texts.groupBy("_label", "_hash").agg(F.min("_text").alias("_text"))
    return fit([tuple(r) for r in bucket_counts(texts, "_label", "_text").collect()], **options)


def predict(docs: DataFrame, model: Model | None, text="text", lang="lang_pred", score="score", rejected="rejected") -> DataFrame:
    """``docs`` with the predicted language, its calibrated probability and whether the text is rejected: its probability
    is under the level, or too many of its windows were never met in training.

    A null text, a text without letters and any text under no model give ``und``, 0.0 and true.
    """
    if model is None:
        return docs.withColumns({lang: F.lit(UNDETERMINED), score: F.lit(0.0), rejected: F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.temperature, model.shrinkage, model.level, model.met, model.strange))

    def run(it):
        own = Model(*shared.value)

        def rows(texts):
            for a, b in text_runs(texts, RUN_CHARS):
                chances, any_letter, new = own.probabilities(texts[a:b])
                for best, chance, some, strange in zip(chances.argmax(1), chances.max(1), any_letter, new):
                    yield (own.labels[best], float(chance), bool(strange or chance < own.level)) if some else (UNDETERMINED, 0.0, True)

        for batch in slices(it):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows(texts)), PREDICTED)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=[*kept, lang, score, rejected])

    kept = [c for c in docs.columns if c not in (lang, score, rejected)]
    # The text goes to Python once, whether or not it comes back.
    at = kept.index(text) if text in kept else len(kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    schema = f"{fields}, `{lang}` string, `{score}` double, `{rejected}` boolean".lstrip(", ")
    rows = docs.select(*kept, *([] if text in kept else [F.col(text).alias("_text_read")]))
    return in_small_batches(rows).mapInArrow(run, schema)


def held_out(key: Column, folds=5) -> Column:
    """Whether a row's fold is the one never learned from; a null id never is learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(True))
