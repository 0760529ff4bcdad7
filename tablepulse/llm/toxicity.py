"""Toxicity by a convolutional text classifier, trained in numpy on a bounded sample.

Words are lower-cased (A-Z) and stripped of ASCII punctuation.  A word's embedding is the sum
of those of its hash and of the hashes of its beginnings, so that unseen forms of a stem are
known; hashes seen in fewer than ``MIN_DOCS`` sample texts have none.  Filters of several widths slide over the
embeddings, each keeps its maximum over the whole text, and a linear layer gives the logit.
Thresholds are calibrated by language on all labelled rows of a fold that training left out,
from counts by logit: a score is the logistic function of the logit less the threshold of the
text's language, so 0.5 is the decision.
The language is guessed from function words of the text alone.

Sample of the weights: at most ``PER_CLASS`` labelled rows of each class, those with the
smallest id hashes.
Rows: NULL and empty texts, and texts without a word, are scored from the bias alone.
Labels that are NULL, or that contradict each other for one id, are not learnt from.  Without
rows of both classes every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepulse.llm.pieces import Numbers, slices
from tablepulse.llm.storage import give_back, ship, tidied

PER_CLASS = 2048
MIN_DOCS = 3
DIMENSIONS = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
EPOCHS = 5
BATCH = 32
MIN_CALIBRATION = 15  # rows of each class that a language needs for a threshold of its own
BLOCK_WORDS = 100_000
BEGINNINGS = (3, 4, 5, 6, 7)  # lengths of the beginnings of words, in characters
MAX_TYPES = 100_000  # distinct words that a task keeps
STEPS, MAX_LOGIT = 64, 64  # logits are counted in steps of 1/64 up to this size
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be by this are from at an",
    "de": "der die und den von zu das mit sich des auf nicht ein eine dem als auch es an",
    "fr": "le la les des et en un une du que qui dans pour sur est par au il ne pas",
    "es": "el la los las y en un una del que por con para su se lo al es no como",
}


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, as they are looked up."""
    return [w.strip(PUNCTUATION) for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []


def hashes_of(word: bytes) -> list[int]:
    """CRC-32 of the word, then of its beginnings (-1 where it is not longer)."""
    letters = word.decode("utf-8", "replace")
    starts = [zlib.crc32(b"\n" + letters[:n].encode()) if len(letters) > n else -1 for n in BEGINNINGS]
    return [zlib.crc32(word), *starts]


class Types:
    """Numbers distinct words and keeps the hashes of each."""

    def __init__(self):
        self.number, self.hashes = Numbers(), np.empty((0, 1 + len(BEGINNINGS)), np.int64)

    def codes(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        known = len(self.number)
        out = [np.fromiter(map(self.number.__getitem__, t), np.int64, len(t)) for t in texts]
        if new := [hashes_of(w) for w in islice(self.number, known, None)]:
            self.hashes = np.r_[self.hashes, np.array(new, np.int64)]
        return out


@dataclass
class Model:
    hashes: np.ndarray  # ascending; hashes[i] has row i of the embeddings
    embeddings: np.ndarray  # the last row is zero, for what has no hash
    filters: list[np.ndarray]  # by width: width x dimensions x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language, the last for no language

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of hashes; -1, the zero row, for those without one."""
        if not len(self.hashes):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def vectors(self, hashes: np.ndarray) -> np.ndarray:
        """Embedding of each word, and a zero row for padding."""
        rows = self.rows(hashes)
        made = np.zeros((len(rows) + 1, DIMENSIONS), np.float32)
        for column in rows.T:
            made[:-1] += self.embeddings[column]
        return made

    def pooled(self, seen: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum of each filter over each text (zero at least).

        Texts lie one after the other with ``max(WIDTHS)`` zero rows behind each.
        """
        parts = [self._slide(seen, k, b) for k, b in zip(self.filters, self.biases)]
        return np.concatenate([np.maximum.reduceat(p, starts, axis=0) for p in parts], axis=1)

    @staticmethod
    def _slide(seen: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
        width, n = len(kernel), len(seen)
        made = np.full((n, kernel.shape[2]), bias, np.float32)
        for j in range(width):
            made[: n - j] += seen[j:] @ kernel[j]
        return np.maximum(made, 0)

    def logits(self, codes: list[np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language of each text, given as word numbers; long texts go in overlapping blocks."""
        pad, vectors, of_word = max(WIDTHS), self.vectors(hashes), languages_of(hashes[:, 0])
        none = len(FUNCTION_WORDS)
        parts, owner, languages = [], [], np.full(len(codes), none)
        for number, text in enumerate(codes):
            counts = np.bincount(of_word[text], minlength=none + 1)[:none]
            if counts.any():
                languages[number] = counts.argmax()
            for at in range(0, max(1, len(text)), BLOCK_WORDS):
                parts.append(np.r_[text[at : at + BLOCK_WORDS + pad - 1], np.full(pad, -1)])
                owner.append(number)
        best, owner, at = np.zeros((len(codes), FILTERS * len(WIDTHS)), np.float32), np.array(owner), 0
        while at < len(parts):
            size, to = len(parts[at]), at + 1
            while to < len(parts) and size + len(parts[to]) <= 2 * BLOCK_WORDS:
                size, to = size + len(parts[to]), to + 1
            starts = np.r_[0, np.cumsum([len(p) for p in parts[at : to - 1]], dtype=np.int64)]
            np.maximum.at(best, owner[at:to], self.pooled(vectors[np.concatenate(parts[at:to])], starts))
            at = to
        return best @ self.weights + self.bias, languages

    def scores(self, texts: list[list[bytes]], types: Types) -> np.ndarray:
        codes = types.codes(texts)
        logits, languages = self.logits(codes, types.hashes)
        return 1 / (1 + np.exp(-np.clip((logits - self.thresholds[languages]).astype(np.float64), -30, 30)))


def languages_of(words: np.ndarray) -> np.ndarray:
    """Number of the first language with this function word, by hash; the number of languages for none."""
    out = np.full(len(words), len(FUNCTION_WORDS))
    for number, listed in reversed(list(enumerate(FUNCTION_WORDS.values()))):
        out[np.isin(words, [zlib.crc32(w.encode()) for w in listed.split()])] = number
    return out


def _start(texts: list[np.ndarray], hashes: np.ndarray, share: float, seed: int) -> Model:
    random = np.random.default_rng(seed)
    seen = [np.unique(hashes[np.unique(t)]) for t in texts]
    known, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.empty(0, np.int64), np.empty(0))
    known = known[(counts >= MIN_DOCS) & (known >= 0)]
    normal = lambda *shape: random.normal(0, 0.2, shape).astype(np.float32)
    model = Model(
        known, normal(len(known) + 1, DIMENSIONS), [normal(w, DIMENSIONS, FILTERS) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS)),
        float(np.log(share / (1 - share))) if 0 < share < 1 else (30.0 if share else -30.0),
        np.zeros(len(FUNCTION_WORDS) + 1),
    )
    model.embeddings[-1] = 0
    return model


def _step(model: Model, texts: list[np.ndarray], rows: np.ndarray, labels: np.ndarray, state: dict, rate: float) -> None:
    """One Adagrad step on a batch; only the words under a maximum get a gradient.

    ``rows`` has the embedding rows of each word number.
    """
    pad = max(WIDTHS)
    words, inverse = np.unique(np.concatenate([np.r_[t, np.full(pad, -1)] for t in texts]), return_inverse=True)
    used = np.where((words >= 0)[:, None], rows[words], -1)
    seen = model.embeddings[used].sum(axis=1)[inverse]
    starts = np.r_[0, np.cumsum([len(t) + pad for t in texts[:-1]], dtype=np.int64)]
    pools, places = [], []
    for kernel, bias in zip(model.filters, model.biases):
        made = model._slide(seen, kernel, bias)
        where = np.stack([s + made[s : s + max(1, len(t))].argmax(axis=0) for s, t in zip(starts, texts)])
        pools.append(np.take_along_axis(made, where, axis=0))
        places.append(where)
    pooled = np.concatenate(pools, axis=1)
    error = (1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30))) - labels).astype(np.float32) / len(texts)

    def learn(name: str, value: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        before = state.setdefault(name, np.zeros_like(value))
        before[at] += gradient**2
        value[at] -= rate * gradient / (np.sqrt(before[at]) + 1e-6)

    back = error[:, None] * model.weights[None, :] * (pooled > 0)
    learn("weights", model.weights, pooled.T @ error)
    bias = np.array([model.bias], np.float32)
    learn("bias", bias, np.array([error.sum()], np.float32))
    model.bias = float(bias[0])
    to_words, to_values = [], []
    for number, (kernel, where) in enumerate(zip(model.filters, places)):
        own = back[:, number * FILTERS : (number + 1) * FILTERS]
        for j in range(len(kernel)):
            under = np.minimum(where + j, len(inverse) - 1)
            to_words.append(inverse[under].ravel())
            to_values.append((own[:, :, None] * kernel[j].T[None]).reshape(-1, DIMENSIONS))
            learn(f"f{number}_{j}", kernel[j], np.einsum("nf,nfd->df", own, seen[under]))
        learn(f"b{number}", model.biases[number], own.sum(axis=0))
    at = used[np.concatenate(to_words)]
    values = np.repeat(np.concatenate(to_values), at.shape[1], axis=0)
    at = at.ravel()
    unique, place = np.unique(at[at >= 0], return_inverse=True)
    if len(unique):
        total = np.zeros((len(unique), DIMENSIONS), np.float32)
        np.add.at(total, place, values[at >= 0])
        learn("embeddings", model.embeddings, total, unique)


def _threshold(counts: np.ndarray) -> float:
    """Middle of the gap between steps of logits that makes the fewest errors; rows of (step, label, n)."""
    steps, place = np.unique(counts[:, 0], return_inverse=True)
    zeros, ones = (np.bincount(place, counts[:, 2] * (counts[:, 1] == k), len(steps)) for k in (0, 1))
    wrong = np.r_[0, np.cumsum(ones)] + zeros.sum() - np.r_[0, np.cumsum(zeros)]
    at = np.flatnonzero(wrong == wrong.min())
    at = at[len(at) // 2]
    low = steps[at - 1] if at else steps[0] - STEPS
    high = steps[at] if at < len(steps) else steps[-1] + STEPS
    return float((low + high) / 2 / STEPS)


def train(texts: Iterable[list[bytes]], labels: np.ndarray, calibrate: np.ndarray, seed: int = 7) -> Model:
    """Fit on the texts outside ``calibrate``; thresholds are zero.  Of a text only its word numbers are kept."""
    types, codes, left = Types(), [], iter(texts)
    while some := list(islice(left, 64)):
        codes += types.codes(some)
    own, target = [t for t, c in zip(codes, calibrate) if not c], labels[~calibrate].astype(np.float32)
    model = _start(own, types.hashes, float(labels.mean()) if len(labels) else 0.0, seed)
    if not 0 < target.sum() < len(target):
        model.weights[:] = 0
        return model
    rows, state, random = model.rows(types.hashes), {}, np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        order = random.permutation(len(own))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            _step(model, [own[i] for i in chosen], rows, target[chosen], state, 0.1 / (1 + epoch / 2))
    return model


def _counts(docs: DataFrame, labels: DataFrame, model: Model, id_col: str, text: str) -> np.ndarray:
    """(step of the logit, label, rows, language) over all rows of ``docs`` that ``labels`` (id, label) names."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    named = labels.select(F.col(id_col).alias("__id"), "label")
    rows = docs.select(id_col, text).join(named, docs[id_col] == named["__id"]).where(F.col(text).isNotNull()).select("label", F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types()
        for whole in batches:
            for start, stop in slices(whole.column(1), 1 << 20):
                if len(types.number) > MAX_TYPES:
                    types = Types()
                batch = whole.slice(start, stop - start)
                codes = types.codes([words_of(v) for v in batch.column(1).to_pylist()])
                logits, languages = shared.value.logits(codes, types.hashes)
                steps = np.round(np.clip(logits, -MAX_LOGIT, MAX_LOGIT) * STEPS).astype(np.int64)
                columns = [pa.array(steps), batch.column(0).cast(pa.int64()), pa.array(languages.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["step", "label", "language"])

    found = rows.mapInArrow(tidied(run), "step bigint, label bigint, language bigint").groupBy("step", "label", "language").agg(F.count("*").alias("n"))
    # At most 2 * STEPS * MAX_LOGIT + 1 steps for each label and language.
    return np.array([(r.step, r.label, r.n, r.language) for r in found.collect()], np.int64).reshape(-1, 4)


def calibrate(docs: DataFrame, labels: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> None:
    """Set the thresholds of a model from all rows of fold 1, or of all folds but 0 if those are of one class."""
    own = fold(F.col(id_col))
    counts = _counts(docs.where(own == 1), labels.where(own == 1), model, id_col, text)
    if len(set(counts[:, 1].tolist())) < 2:
        counts = _counts(docs.where(own != 0), labels.where(own != 0), model, id_col, text)
    model.thresholds[:] = _threshold(counts)
    for number in range(len(FUNCTION_WORDS)):
        mine = counts[counts[:, 3] == number]
        if min(mine[mine[:, 1] == k, 2].sum() for k in (0, 1)) >= MIN_CALIBRATION:
            model.thresholds[number] = _threshold(mine)


def fold(id_col: Column) -> Column:
    """CRC-32 of the id as text, modulo five; fold 0 is held out (NULL ids too)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """A model from the labelled documents outside fold 0; all of fold 1 calibrates."""
    known = labels.where(labels[id_col].isNotNull() & labels[label].isin(0, 1) & (fold(labels[id_col]) != 0))
    agreed = known.groupBy(id_col).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    chosen = None
    for value in (0, 1):
        part = agreed.where(F.col("label") == value).orderBy(F.xxhash64(id_col), id_col).limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class ids, so they are sent to all tasks.
    ids = F.broadcast(chosen.select(F.col(id_col).alias("__id"), "label", fold(F.col(id_col)).alias("fold")))
    sample = docs.select(id_col, text).join(ids, docs[id_col] == ids["__id"])
    one = sample.groupBy("__id", "label", "fold").agg(F.max(text).alias("text"))
    rows = sorted((r["__id"], r["label"], r["fold"], r["text"]) for r in one.toLocalIterator() if r["text"] is not None)
    texts = (words_of(r[3]) for r in rows)
    model = train(texts, np.array([r[1] for r in rows], np.int64), np.array([r[2] == 1 for r in rows], bool))
    del rows, texts
    give_back()
    if model.weights.any():
        calibrate(docs, agreed.select(id_col, "label"), model, id_col, text)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with ``column``: the likelihood of label 1 by the text alone; an existing column is replaced."""
    ship(docs.sparkSession)
    base = docs.drop(column) if column != text else docs
    at = base.columns.index(text)
    # The model is bounded by the sample: some ten thousand embeddings of sixteen numbers.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = Types()
        for whole in batches:
            for start, stop in slices(whole.column(at), 1 << 20):
                if len(types.number) > MAX_TYPES:
                    types = Types()
                batch = whole.slice(start, stop - start)
                found = shared.value.scores([words_of(v) for v in batch.column(at).to_pylist()], types)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, column])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(tidied(run), f"{fields}, `{column}` double")
