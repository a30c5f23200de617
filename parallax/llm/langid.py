"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, ASCII letters
folded, every other ASCII character read as a blank, no blank inside an n-gram). A linear layer
and a softmax follow. Embeddings and layer are trained together by stochastic gradient descent
in numpy on a bounded sample, inside one task; the driver only ever holds the finished model.
A part of the sample is set aside to fit the softmax temperature and the score under which a
prediction is rejected.

Sample: of every label the rows whose hash of id and text is below `PER_LANG` (less, if there are
so many labels that this exceeds `HARD_CAP`) / rows of the label, so as many rows are expected at
any corpus size; training reads them in the order of the hash until it has `HARD_CAP` texts or
`SAMPLE_BYTES` bytes. No label is left out by a rank. Everything else covers all rows.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected; without
any labelled text every row is `und`; rows with a null label are predicted, never learned from;
a null doc_id hashes as the empty string; rows that repeat an id are drawn and predicted each on
its own; of labels with equal scores the first by name wins; a text of any length is read whole,
in blocks of `SEGMENT` bytes; an empty table gives no model and no rows; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import few_or_merged, map_arrow, materialise, slices

#: The bounds of the sample: rows of a label (expected), rows and bytes in all.
PER_LANG, HARD_CAP, SAMPLE_BYTES = 800, 40_000, 64 << 20
#: The model: hash buckets, width of an embedding, n-gram sizes.
BUCKET_BITS, WIDTH, SIZES = 16, 16, (2, 3, 4)
#: Training: passes, first step, documents of a step.
EPOCHS, RATE, BATCH = 12, 0.5, 16
#: Share of right calibration predictions that rejection may cost; bytes of texts that are held at once.
FALSE_REJECTION, SEGMENT = 0.002, 1 << 20
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(data: np.ndarray, starts: np.ndarray, first: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the bucket of each n-gram of texts laid end to end, and the text it is in.

    starts: where each text starts in `data`; n-grams across texts and blanks inside are left out.
    first: only n-grams that begin among so many first bytes.
    """
    folded = _FOLD[data]
    text = np.zeros(len(data), np.int32)
    np.add.at(text, starts[1:][starts[1:] < len(data)], 1)
    text = np.cumsum(text, dtype=np.int32)
    blank = folded == 0x20
    for n in SIZES:
        if len(data) < n:
            continue
        m = min(len(data) - n + 1, first or len(data))
        code = np.full(m, n, np.uint32)
        keep = text[:m] == text[n - 1 : n - 1 + m]
        for k in range(n):
            code = (code ^ folded[k : k + m]) * np.uint32(0x01000193)
            if 0 < k < n - 1:
                keep &= ~blank[k : k + m]
        keep &= ~(blank[:m] & blank[n - 1 : n - 1 + m])
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
        yield (code[keep] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), text[:m][keep]


def gram_blocks(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of one text, block by block."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), SEGMENT):
        for bucket, _ in grams(data[at : at + SEGMENT + max(SIZES) - 1], np.zeros(1, np.int64), SEGMENT):
            yield bucket


def shares(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of a text, and the share of its n-grams that each has."""
    if len(text) <= SEGMENT:
        found = list(gram_blocks(text))
        bucket, count = np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)
    else:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for found in gram_blocks(text):
            total += np.bincount(found, minlength=len(total))
        bucket = np.flatnonzero(total)
        count = total[bucket]
    return bucket, (count / max(1, count.sum())).astype(np.float32)


class Model:
    """Embeddings (buckets x width), layer (width x labels), temperature and rejection score."""

    def __init__(self, labels: list[str], embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray, temperature: float = 1.0, floor: float = 0.0):
        self.labels, self.embedding, self.layer, self.bias, self.temperature, self.floor = labels, embedding, layer, bias, temperature, floor
        # with few labels it is cheaper to add up finished logits than embeddings
        self._sums = (embedding @ layer).astype(np.float32) if len(labels) <= WIDTH else embedding

    def logits_of(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Logits from shares()."""
        mean = np.array([share @ self._sums[bucket] for bucket, share in rows]).reshape(len(rows), self._sums.shape[1])
        return (mean if len(self.labels) <= WIDTH else mean @ self.layer) + self.bias

    def logits(self, texts: list[bytes]) -> np.ndarray:
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(texts), np.uint8)
        total, count = np.zeros((len(texts), self._sums.shape[1])), np.zeros(len(texts))
        for bucket, text in grams(data, starts):
            if not len(bucket):
                continue
            count += np.bincount(text, minlength=len(texts))
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            total[text[first]] += np.add.reduceat(self._sums[bucket], first, axis=0)
        mean = total / np.maximum(count, 1)[:, None]
        return (mean if len(self.labels) <= WIDTH else mean @ self.layer) + self.bias

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Label numbers and calibrated scores."""
        long = [i for i, t in enumerate(texts) if len(t) > SEGMENT]
        z = self.logits([b"" if len(t) > SEGMENT else t for t in texts])
        if long:
            z[long] = self.logits_of([shares(texts[i]) for i in long])
        return self.scores(z)

    def scores(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = logits / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, labels=np.array(self.labels), embedding=self.embedding.astype(np.float32), layer=self.layer, bias=self.bias, fit=np.array([self.temperature, self.floor]))
        return out.getvalue()

    @staticmethod
    def load(raw: bytes) -> Model:
        x = np.load(io.BytesIO(raw))
        return Model(x["labels"].tolist(), x["embedding"], x["layer"], x["bias"], *x["fit"].tolist())


def train(texts: list[bytes], labels: list[str], calibration: list[bool], seed: int = 0) -> Model | None:
    return train_on([shares(t) for t in texts], labels, calibration, seed)


def train_on(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], calibration: list[bool], seed: int = 0) -> Model | None:
    """Fit on the rows (from shares()) outside `calibration`; fit temperature and rejection on those inside."""
    names = sorted(set(labels))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    number = {n: k for k, n in enumerate(names)}
    y = np.array([number[n] for n in labels])
    embedding = rng.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    learn = [i for i, held in enumerate(calibration) if not held and len(rows[i][0])] or [i for i in range(len(rows)) if len(rows[i][0])]
    share = np.bincount(y[learn], minlength=len(names)) if learn else np.ones(len(names))
    weight = np.where(share > 0, len(learn) / np.maximum(share, 1) / len(names), 0)
    steps, step = max(1, EPOCHS * -(-len(learn) // BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(learn)
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            rate, step = RATE * (1 - step / steps), step + 1
            mean = np.array([rows[i][1] @ embedding[rows[i][0]] for i in batch])
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= weight[y[batch]][:, None] / len(batch)
            back = p @ layer.T
            layer -= rate * 8 * mean.T @ p
            bias -= rate * p.sum(axis=0)
            for i, g in zip(batch, back, strict=True):
                embedding[rows[i][0]] -= (rate * 64 * rows[i][1])[:, None] * g.astype(np.float32)
    model = Model(names, embedding, layer, bias)
    return calibrate(model, [r for r, h in zip(rows, calibration, strict=True) if h], [n for n, h in zip(labels, calibration, strict=True) if h])


def calibrate(model: Model, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str]) -> Model:
    """The temperature of least log loss, and the score that all but FALSE_REJECTION of the right predictions reach."""
    pairs = [(r, n) for r, n in zip(rows, labels, strict=True) if n in set(model.labels) and len(r[0])]
    if not pairs:
        return model
    z, y = model.logits_of([r for r, _ in pairs]), np.array([model.labels.index(n) for _, n in pairs])

    # smoothed targets: without errors among n rows, one error in n + 2 is as sure as it gets
    doubt = 1 / (len(y) + 2)
    target = np.full(z.shape, doubt / max(1, len(model.labels) - 1))
    target[np.arange(len(y)), y] = 1 - doubt

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (target * s).sum(axis=1)))

    model.temperature = min(np.geomspace(0.02, 20, 90).tolist(), key=loss)
    best, score = model.scores(z)
    right = score[best == y]
    if len(right):
        # never above an even chance between two labels: a clean text that is short is no reason to go
        model.floor = min(float(np.quantile(right, FALSE_REJECTION, method="lower")), 0.5)
    return model


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> bytes | None:
    """A model from text and label of the rows outside fold 0; fold 1 of the sample calibrates."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where((fold(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialise(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "label-counts")
    each = min(per_lang, HARD_CAP / max(1, counts.count()))
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = labelled.withColumn("at", chance).join(few_or_merged(counts), "lang").where(F.col("n") * F.col("at") < each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, calibration, size = [], [], [], 0
        for lang, number, text in (r.values() for b in batches for part in slices(b) for r in part.to_pylist()):
            if len(rows) == HARD_CAP or size > SAMPLE_BYTES:
                break
            raw = text.encode()
            size += len(raw)
            rows.append(shares(raw))
            labels.append(lang)
            calibration.append(number == 1)
        if model := train_on(rows, labels, calibration):
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()], pa.binary())], ["model"])

    one = map_arrow(sample.repartition(1).sortWithinPartitions("at", "doc_id", "lang", "text").select("lang", fold(F.col("doc_id")).alias("fold"), "text"), run, "model binary")
    found = one.collect()
    return bytes(found[0].model) if found else None


def _judged(texts: pa.Array, model: Model | None, letter) -> tuple[list[str], list[float], list[bool]]:
    """Label, score and rejection of each text, in segments of bounded size."""
    langs, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        if held:
            best, score = model.predict([t for _, t in held])
            for (i, _), b, s in zip(held, best.tolist(), score.tolist(), strict=True):
                langs[i], scores[i], rejected[i] = model.labels[b], s, s < model.floor
        held.clear()

    for i, value in enumerate(texts):
        text = value.as_py()
        if model and text and letter.search(text):
            raw = text.encode()
            held.append((i, raw))
            size += len(raw)
            if size > SEGMENT:
                flush()
                size = 0
    flush()
    return langs, scores, rejected


def _letter():
    import regex

    return regex.compile(r"\p{L}")


def predict(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letter = Model.load(shared.value) if shared.value else None, _letter()
        for batch in batches:
            langs, scores, rejected = _judged(batch.column(2), own, letter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: bytes | None) -> DataFrame:
    """The rows of `docs`, all columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, letter = Model.load(shared.value) if shared.value else None, _letter()
        for batch in batches:
            yield batch.filter(pa.array([not r for r in _judged(batch.column(at), own, letter)[2]], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
