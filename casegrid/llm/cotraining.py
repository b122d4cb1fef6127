"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view is a logistic regression. In every round a view gives its confident decisions on unlabelled
rows to the other as pseudo-labels, as far as its confidence holds on held-out labels. Then both
are calibrated (Platt scaling) and combined by a logistic regression over their log-odds, all on
held-out labels, and every document is scored by both.

Fitting uses a bounded sample; scoring reads every document whole.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.bytetext import RollingHash, Texts, chunks, mix, repeated, windows
from casegrid.llm.memo import lean

# Bounds of the sample, in rows.
LABELLED_ROWS = 5_000
UNLABELLED_ROWS = 3_000
ROUNDS = 2
# Probability from which a view's decision becomes a pseudo-label, and the share of held-out
# decisions as confident that have to be right.
CONFIDENT = 0.95
# Share of good held-out documents that the threshold may reject.
REJECTED_GOOD = 0.002

GRAMS = 2048  # hashed byte 3-grams
_DENSE = 8  # shares of upper case, digits, marks, symbols, distinct words, repeated word pairs; two lengths
META = 1024  # hashed source, language and length classes
_META_DENSE = 3
_BLOCK = 512  # rows that are scored at once while fitting

COLUMNS = ("text", "source", "lang", "n_chars")
SCHEMA = "doc_id bigint, p_text double, p_metadata double, p_quality double, kept boolean"


def _classes(pattern) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for b in range(256) if pattern(b)]] = True
    return out


_UPPER = _classes(lambda b: 65 <= b <= 90)
_DIGIT = _classes(lambda b: 48 <= b <= 57)
_MARK = _classes(lambda b: b in b".,;:!?'\"-()")
_SYMBOL = _classes(lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in b".,;:!?'\"-()")


def _gram_ids(data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes from each place on."""
    wide = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 11)).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dense(texts: Texts) -> np.ndarray:
    """Content measures of every text, each about between 0 and 1."""
    n = np.maximum(1, np.diff(texts.offsets))
    starts, ends, owner = texts.words()
    words = np.maximum(1, np.bincount(owner, minlength=len(texts)))
    hashes = RollingHash(texts.data).spans(starts, ends)
    salt = mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    first = np.unique(hashes ^ salt[owner], return_index=True)[1]
    distinct = np.bincount(owner[first], minlength=len(texts))
    values, at = windows(hashes, owner, 2)
    twice = np.bincount(owner[at][repeated(values ^ salt[owner[at]])], minlength=len(texts))
    out = [_sums(kind[texts.data], texts.offsets) / n for kind in (_UPPER, _DIGIT, _MARK, _SYMBOL)]
    lengths = np.bincount(owner, weights=ends - starts, minlength=len(texts))
    return np.stack([*out, distinct / words, twice / words, lengths / words / 16, np.log1p(words) / 10], axis=1)


def text_features(texts: Texts) -> np.ndarray:
    """Rows of the content view: shares of hashed byte 3-grams (scaled) and the content measures."""
    sizes = np.diff(texts.offsets)
    cell = np.repeat(np.arange(len(texts)), sizes) * GRAMS + _gram_ids(texts.data)
    shares = np.bincount(cell, minlength=len(texts) * GRAMS).reshape(len(texts), GRAMS) / np.maximum(1, sizes)[:, None]
    return np.concatenate([shares * 16, _dense(texts)], axis=1)


def text_scores(texts: Texts, weights: np.ndarray) -> np.ndarray:
    """``text_features(texts) @ weights`` without the table of features."""
    n = np.maximum(1, np.diff(texts.offsets))
    return 16 * _sums(weights[:GRAMS][_gram_ids(texts.data)], texts.offsets) / n + _dense(texts) @ weights[GRAMS:]


def _hashed(column: pa.Array, kind: str) -> np.ndarray:
    """Bucket of every value, null included."""
    coded = column.cast(pa.string()).fill_null("\0null").dictionary_encode()
    table = np.array([zlib.crc32(f"{kind}={v}".encode()) % META for v in coded.dictionary.to_pylist()], np.int64)
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.int64)


def metadata_features(batch: pa.RecordBatch, texts: Texts) -> np.ndarray:
    """Rows of the metadata view: source, language, their pair, length class, and the page's layout."""
    chars = batch.column("n_chars").cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
    length = np.log2(np.maximum(1, chars))
    lines = np.diff(np.concatenate([[0], np.cumsum(texts.data == 10)])[texts.offsets]) + 1
    out = np.zeros((batch.num_rows, META + _META_DENSE))
    rows = np.arange(batch.num_rows)
    source, lang = _hashed(batch.column("source"), "source"), _hashed(batch.column("lang"), "lang")
    sizes = _hashed(pa.array(length.astype(np.int64)), "length")
    for bucket in (source, lang, (source * 31 + lang) % META, sizes, (sizes * 17 + lang) % META):
        np.add.at(out, (rows, bucket), 1)
    out[:, META:] = np.stack([length / 16, np.log2(lines) / 8, np.log2(np.maximum(1, chars) / lines) / 8], axis=1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.clip(z, -60, 60) / 2))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Weights and, last, the bias, by accelerated gradient descent on the mean loss."""
    wide = np.ones((len(x), x.shape[1] + 1), np.float32)
    wide[:, :-1] = x
    x = wide
    weight = (weight / max(1e-9, weight.sum())).astype(np.float32)
    # The loss curves by no more than a quarter of the largest eigenvalue of the weighted features.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    rate = 1 / (0.25 * norm + ridge)
    w = ahead = np.zeros(x.shape[1], np.float32)
    for k in range(steps):
        slope = x.T @ (weight * (_sigmoid(x @ ahead) - y).astype(np.float32)) + ridge * ahead
        new = ahead - rate * slope
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w.astype(np.float64)


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    # In blocks, as a product with doubles copies the features.
    parts = [x[at : at + _BLOCK] @ w[:-1] + w[-1] for at in range(0, len(x), _BLOCK)]
    return np.concatenate(parts) if parts else np.zeros(0)


@dataclass
class Model:
    """Weights of both views, their calibration (slope, offset), the combination and the threshold."""

    text: np.ndarray
    metadata: np.ndarray
    text_scale: np.ndarray
    metadata_scale: np.ndarray
    combine: np.ndarray
    threshold: float
    pseudo_labels: int = 0

    def probabilities(self, text_z: np.ndarray, metadata_z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = _sigmoid(text_z * self.text_scale[0] + self.text_scale[1])
        b = _sigmoid(metadata_z * self.metadata_scale[0] + self.metadata_scale[1])
        return a, b, _sigmoid(_apply(self.combine, np.stack([_logit(a), _logit(b)], axis=1)))

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Probabilities by text, by metadata and together, and the verdict. A text without words has 0."""
        texts = Texts(batch.column("text"))
        text_z = text_scores(texts, self.text[:-1]) + self.text[-1]
        a, b, p = self.probabilities(text_z, _apply(self.metadata, metadata_features(batch, texts)))
        empty = np.bincount(texts.words()[2], minlength=len(texts)) == 0
        a, p = np.where(empty, 0.0, a), np.where(empty, 0.0, p)
        return a, b, p, (p >= self.threshold) & ~empty


def _balanced(y: np.ndarray) -> np.ndarray:
    good = max(1e-9, float(y.mean())) if len(y) else 0.5
    return np.where(y > 0.5, 0.5 / good, 0.5 / max(1e-9, 1 - good))


def _platt(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset; smoothed targets, so that separable scores keep finite odds."""
    up, down = float(y.sum()), float((1 - y).sum())
    target = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    return fit_logistic(z[:, None] / max(1e-9, float(z.std())), target, np.ones(len(z)), 1e-6, 400) / np.array([max(1e-9, float(z.std())), 1])


def cotrain(text: np.ndarray, metadata: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """``y`` is 0, 1 or nan where unlabelled. Every third labelled row is held out."""
    labelled = np.flatnonzero(~np.isnan(y))
    held, train = labelled[::3], np.setdiff1d(labelled, labelled[::3])
    views = [text, metadata]
    pseudo: list[dict[int, float]] = [{}, {}]  # what each view has been taught
    weights, scales = [None, None], [None, None]
    free = set(np.flatnonzero(np.isnan(y)).tolist())
    for turn in range(rounds + 1):
        for v in (0, 1):
            rows = np.concatenate([train, np.array(list(pseudo[v]), np.int64)])
            target = np.concatenate([y[train], np.array(list(pseudo[v].values()))])
            weights[v] = fit_logistic(views[v][rows], target, _balanced(target))
            scales[v] = _platt(_apply(weights[v], views[v][held]), y[held])
        if turn == rounds:
            break
        for v in (0, 1):
            p = _sigmoid(_apply(weights[v], views[v]) * scales[v][0] + scales[v][1])
            for label, sure in ((1.0, p >= CONFIDENT), (0.0, p <= 1 - CONFIDENT)):
                checked = held[sure[held]]
                if len(checked) < 20 or (y[checked] == label).mean() < CONFIDENT:
                    continue  # the view's confidence does not hold
                for row in np.flatnonzero(sure):
                    if row in free:
                        pseudo[1 - v].setdefault(int(row), label)
    odds = [_logit(_sigmoid(_apply(weights[v], views[v][held]) * scales[v][0] + scales[v][1])) for v in (0, 1)]
    combine = fit_logistic(np.stack(odds, axis=1), y[held], np.ones(len(held)), 1e-3, 400)
    p = _sigmoid(_apply(combine, np.stack(odds, axis=1)))
    good = np.sort(p[y[held] > 0.5])
    threshold = min(0.5, float(good[int(REJECTED_GOOD * len(good))])) if len(good) else 0.5
    return Model(*weights, *scales, combine, threshold, len(pseudo[0]) + len(pseudo[1]))


def _columns(docs: DataFrame) -> DataFrame:
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "bigint"}
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS))


def _picked(column: str, share: float, salt: str):
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1_000_000_000)) < int(share * 1e9)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model | None:
    """Fit on about ``LABELLED_ROWS`` and ``UNLABELLED_ROWS`` documents, picked by a hash of doc_id.

    Several labels of one doc_id count by majority (a tie is good), null labels not at all. Without
    labels of both kinds there is nothing to fit: None.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("_y")
    )
    some = known.where(_picked("_id", min(1.0, LABELLED_ROWS / max(1, known.count())), "labelled"))
    rows = _columns(docs)
    # The ids of a sample of bounded size.
    with_y = rows.join(F.broadcast(some), F.col("doc_id") == F.col("_id")).drop("_id")
    free = rows.where("doc_id is not null").where(_picked("doc_id", min(1.0, UNLABELLED_ROWS / max(1, docs.count())), "unlabelled")).withColumn("_y", F.lit(None).cast("double"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = Texts(part.column("text"))
                x, m = text_features(texts).astype("<f2"), metadata_features(part, texts).astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_y"), pa.array([r.tobytes() for r in x]), pa.array([r.tobytes() for r in m])],
                    ["doc_id", "y", "text", "metadata"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _trained(pa.Table.from_batches(list(batches), _FEATURES))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)])], ["model"])

    # The sample, of bounded size, meets in one task, and only weights come to the driver.
    found = with_y.unionByName(free).mapInArrow(lean(features), "doc_id bigint, y double, text binary, metadata binary")
    models = found.repartition(1).mapInArrow(lean(train), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else None


_FEATURES = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("text", pa.binary()), ("metadata", pa.binary())])


def _trained(found: pa.Table) -> Model | None:
    """The model of a sample, the same in whatever order its rows come."""
    ids, y = found.column("doc_id").to_numpy(), found.column("y").to_numpy()
    # A labelled document is not unlabelled as well.
    order = np.lexsort((np.isnan(y), mix(ids.astype(np.uint64)) if len(ids) else ids))
    labelled = set(ids[~np.isnan(y)].tolist())
    order = np.array([i for i in order if not np.isnan(y[i]) or ids[i] not in labelled], np.int64)
    y = y[order]
    if not {0.0, 1.0} <= set(y.tolist()) or min((y == 0).sum(), (y == 1).sum()) < 6:
        return None
    views = []
    for name in ("text", "metadata"):
        column = found.column(name)
        view = np.empty((len(order), len(column[0].as_py()) // 2), np.float32)
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        at = 0
        for chunk in column.chunks:
            rows = Texts(chunk).data.view("<f2").reshape(len(chunk), -1)
            here = place[at : at + len(chunk)]
            view[here[here >= 0]] = rows[here >= 0]
            at += len(chunk)
        views.append(view)
    return cotrain(*views, y)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, p_text, p_metadata, p_quality, kept`` for every row of
    ``docs(doc_id, text, lang, source, n_chars)``.

    A text without words, or null, has probability 0 and goes. Null metadata are a value of their own.
    Rows with equal or null ids are scored one by one. Where nothing can be fitted every text with words
    is kept, with null probabilities.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_verdict(model, part)], [c.split()[0] for c in SCHEMA.split(", ")])

    return _columns(docs).mapInArrow(lean(run), SCHEMA)


def _verdict(model: Model | None, batch: pa.RecordBatch) -> list[pa.Array]:
    if model is None:
        texts = Texts(batch.column("text"))
        words = np.bincount(texts.words()[2], minlength=len(texts)) > 0
        return [pa.nulls(len(texts), pa.float64())] * 3 + [pa.array(words)]
    return [pa.array(c) for c in model.score(batch)]


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``score_documents`` keeps, with all their columns."""
    model = fit(docs, labels)
    names = docs.columns
    # Behind the columns of docs, and read by place: names may clash.
    wide = docs.select("*", *(F.col(c).cast("bigint" if c == "n_chars" else "string").alias(f"_{c}_") for c in COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, len(names)):
                inputs = pa.RecordBatch.from_arrays([part.column(len(names) + i) for i in range(len(COLUMNS))], list(COLUMNS))
                kept = _verdict(model, inputs)[-1]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(names))], names).filter(kept)

    return wide.mapInArrow(lean(run), docs.schema)
