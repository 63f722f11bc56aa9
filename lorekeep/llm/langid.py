"""Language identification with a byte convolutional network trained here.

Bytes are embedded, filters of several widths slide over fixed-length windows,
the maximum over a window's positions of each filter feeds a softmax.  It is
trained in numpy, on the driver, on a bounded and documented sample of
labelled rows; windows cover every text in whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
DIM = 6
#: Documented bound of the training sample: labelled rows of each language, and windows of each row.
SAMPLE_ROWS = 1500
SAMPLE_WINDOWS = 3
#: Bound of the whole sample: with many languages each gives fewer rows, but no fewer than LEAST_ROWS.
SAMPLE_TOTAL = 60_000
LEAST_ROWS = 20
#: Least number of training steps.
STEPS = 800
#: Windows that go through the filters at once.
STEP = 64
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ByteCnn:
    languages: list[str]
    embed: np.ndarray  # 257 x DIM; row 256 pads
    filters: list[np.ndarray]  # width * DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 17) -> ByteCnn:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        return cls(
            languages,
            np.concatenate([rng.normal(0, 0.5, (256, DIM)), np.zeros((1, DIM))]).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
            np.zeros(n, np.float32), rng.normal(0, 1 / np.sqrt(n), (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32),
        )

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        """The maximum of each filter over each window, after a ReLU; and where it was reached."""
        x = self.embed[windows]
        rows, length = windows.shape
        tops, kept = [], []
        for k, w in enumerate(WIDTHS):
            span = np.lib.stride_tricks.sliding_window_view(x.reshape(rows, -1), w * DIM, axis=1)[:, ::DIM]
            wide = np.ascontiguousarray(span).reshape(-1, w * DIM)
            z = (wide @ self.filters[k]).reshape(rows, length - w + 1, FILTERS)
            tops.append(z.max(axis=1))
            kept.append((wide.reshape(rows, length - w + 1, -1), z))
        h = np.concatenate(tops, axis=1) + self.bias
        return h, kept

    def logits(self, windows: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.features(windows[at : at + STEP])[0], 0) @ self.out + self.out_bias for at in range(0, len(windows), STEP)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteCnn:
        """Adam on the cross-entropy; the same input gives the same network."""
        rng = np.random.default_rng(seed)
        weights = [self.embed, *self.filters, self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                xs, ys = windows[pick], labels[pick]
                h, kept = self.features(xs)
                a = np.maximum(h, 0)
                logits = a @ self.out + self.out_bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(ys)), ys] -= 1
                p /= len(ys)
                grads: list[np.ndarray] = [np.zeros_like(self.embed)]
                dh = (p @ self.out.T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    wide, z = kept[k]
                    where = z.argmax(axis=1)  # rows x FILTERS
                    rows = np.arange(len(xs))[:, None]
                    part = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    grads.append(np.einsum("rf,rfd->df", part, wide[rows, where]).astype(np.float32))
                    back = (part[:, :, None] * self.filters[k].T[None]).reshape(len(xs), FILTERS, w, DIM)
                    for j in range(w):
                        np.add.at(grads[0], xs[rows, where + j], back[:, :, j])
                grads += [dh.sum(axis=0), a.T @ p, p.sum(axis=0)]
                grads[0][256] = 0
                step += 1
                for w_, g, m, v in zip(weights, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as windows of ``WINDOW`` bytes, the last one padded; white space runs count once."""
    data = b" ".join(text.split())
    n = max(1, -(-len(data) // WINDOW))
    out = np.full(n * WINDOW, 256, dtype=np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> ByteCnn | None:
    """Train on at most about ``rows`` rows of each label; None if there is nothing to learn from.

    Every label is learned.  Rows are picked by a hash of id and text against
    each label's rate, so reruns pick the same and no label is crowded out;
    repeated rows teach once.  Rows with a null label or no letter teach
    nothing.  So many labels that LEAST_ROWS of each exceed SAMPLE_TOTAL are
    an error: such a column does not name languages.
    """
    known = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    most = SAMPLE_TOTAL // LEAST_ROWS
    sizes = known.groupBy("label").count().limit(most + 1).collect()
    if len(sizes) > most:
        raise ValueError(f"more than {most} labels in {label_col}")
    if not sizes:
        return None
    rows = min(rows, max(LEAST_ROWS, SAMPLE_TOTAL // len(sizes)))
    languages = sorted(r["label"] for r in sizes)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(99)), F.lit(1_000_000))
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(int(1_000_000 * rows / r["count"]) + 1))])
    picked = known.where(draw < rate[F.col("label")]).dropDuplicates(["doc_id", "text", "label"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            labels, parts = [], []
            for text, label in zip(raw_texts(batch), batch.column("label").to_pylist()):
                if not has_letter(text):
                    continue
                w = windows_of(text)
                chosen = np.random.default_rng(zlib.crc32(text)).choice(len(w), min(len(w), SAMPLE_WINDOWS), replace=False)
                for i in sorted(chosen.tolist()):
                    labels.append(label)
                    parts.append(w[i].astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(parts, pa.binary())], ["label", "window"])

    sample = picked.mapInArrow(pick, "label string, window binary").toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["label", "window"], kind="stable")
    windows = np.stack([np.frombuffer(bytes(w), "<i2") for w in sample["window"]]).astype(np.int16)
    index = {name: i for i, name in enumerate(languages)}
    # small samples are gone through more often, so that training takes some STEPS steps at least
    epochs = max(4, -(-STEPS * 64 // len(windows)))
    return ByteCnn.fresh(languages).train(windows, np.array([index[x] for x in sample["label"]]), epochs)


def judged(texts: list[bytes | None], model: ByteCnn | None) -> tuple[list[str], list[float]]:
    """Language and score of each text (see ``predict``)."""
    names, scores = ["und"] * len(texts), [1.0] * len(texts)
    able = [i for i, t in enumerate(texts) if t and has_letter(t)]
    if model is None:
        for i in able:
            scores[i] = 0.0
    elif able:
        parts = [windows_of(texts[i]) for i in able]
        windows = np.concatenate(parts)
        begins = np.cumsum([0, *map(len, parts[:-1])])
        z = model.logits(windows).astype(np.float64)
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        filled = (windows != 256).sum(axis=1)
        mean = np.add.reduceat(logp * filled[:, None], begins, axis=0) / np.add.reduceat(filled, begins)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(able, p):
            best = int(row.argmax())
            names[i], scores[i] = model.languages[best], float(row[best])
    return names, scores


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score`` and the columns of ``keep``; one row per input row.

    A text's score for a language is its windows' mean log-probability,
    weighted by their filled length, renormalised.  Null texts and texts
    without a letter (``str.isalpha``) are ``und`` with score 1; without a
    model all are ``und`` with score 0.  Ties go to the language that is first
    by code point.  Repeated rows get the same result.  Long texts are read
    in whole, some windows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=2 << 20):
            names, scores = judged(raw_texts(batch), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *keep)), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", *keep, "lang_pred", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).alias("text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields[1:-1])
    return slim.mapInArrow(run, f"doc_id long, {kinds}lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ByteCnn | None, least: float = 0.4, text_col: str = "text") -> DataFrame:
    """The input's rows whose language is told with a score of at least ``least``; all columns stay.

    Null texts and texts without a letter go; without a model nothing is told
    and all rows go.
    """
    tagged = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=2 << 20):
            told = [n != "und" and s >= least for n, s in zip(*judged(raw_texts(batch), model))]
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(told, pa.bool_()))], ["row"])

    kept = tagged.mapInArrow(run, tagged.select("row").schema)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def held_out(id_col: str = "doc_id"):
    """True for the ids whose crc32 (of the id as text) leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
