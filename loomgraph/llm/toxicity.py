"""Toxicity as ordinal regression: a cumulative-link model over sparse text features.

P(grade <= k) = sigmoid(threshold_k - w.x), one weight vector w for all thresholds.  Features
are words (A-Z in lower case) and the first four to six characters of longer words, x the logarithm
of one more than the count.  Grades come from the labels alone: 0 clean, 1 toxic but of low quality
(junk that few read), 2 toxic in a sound text.  Grades that no labelled text has get no threshold:
without a column `quality` there is one.

Fitted on a bounded sample: at most `sample` labelled rows of either class, picked by hash of those
that have a document, whatever their length.  Executors count the features of the sampled texts;
the driver gets their sums, and of each text the features chosen.  Scores cover every row and every
whole text.

Defined results: a null or empty text has no features and the grade they give; of labels of one
document the worst counts, null labels do not; rows with null or repeated doc_id are scored like
others (of those labelled one text is learnt from); without labels of both classes every severity
is 0; an empty table gives no rows; further columns are ignored, or kept in toxicity_filter()."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import alone, mix, shingle_sets, slices, stored, table, tokenised, trimmed, word_hashes

PREFIXES = (4, 5, 6)


def features(word: str) -> list[str]:
    bare = word.strip(".,;:!?\"'()[]*%$&#-_")
    return [bare] + [f"{bare[:n]}-" for n in PREFIXES if len(bare) > n] if bare else []


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the features of one text; the lower case is that of A-Z alone, as when
    scoring."""
    _, _, words, index = tokenised(pa.array([text or ""]))
    names, counts = [], []
    for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist(), strict=True):
        for f in features(w.decode()):
            names.append(f.encode())
            counts.append(n)
    keys, at = np.unique(word_hashes(names), return_inverse=True)
    return keys, np.bincount(at, counts, minlength=len(keys)).astype(np.int32)


@dataclass
class OrdinalModel:
    """Weights by feature and increasing thresholds; without thresholds every grade is 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each score and threshold k."""
        t = np.array(self.thresholds).reshape(1, -1)
        return 1 / (1 + np.exp(np.clip(t - scores.reshape(-1, 1), -500, 500)))


def select_features(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int], most: int, z: float = 5.0) -> np.ndarray:
    """keys: hashes; toxic, clean: texts of each class that have them, of n texts.  Those whose rates in the
    classes differ by z standard errors, the strongest `most`, sorted."""
    a, b = toxic.astype(np.float64), clean.astype(np.float64)
    odds = np.log((a + 0.5) / (n[0] - a + 0.5)) - np.log((b + 0.5) / (n[1] - b + 0.5))
    spread = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    strength = np.abs(a / n[0] - b / n[1]) / np.sqrt((a + b) / (n[0] + n[1]) * (1 / n[0] + 1 / n[1]))
    good = np.flatnonzero((strength >= z) & (np.abs(odds) > 2.5 * spread))
    return np.sort(keys[good[np.lexsort((keys[good], -strength[good]))][:most]])


def least_shingles(texts: pa.Array, ways: int = 4) -> np.ndarray:
    """Least three-word shingles of each text under several hashes; 0 without words."""
    values, offsets = shingle_sets(texts, 3)
    out = np.zeros((len(offsets) - 1, ways), np.uint64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        for k in range(ways):
            out[full, k] = np.minimum.reduceat(mix(values, k), offsets[full])
    return out


def without_copies(least: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Indices of the texts, of copies and near copies in a class only the first: else the rare words
    of a text with many copies would look like signs of its class.  Copies share the least
    of their shingles under one of several hashes."""
    seen, keep = set(), []
    for i, (t, row) in enumerate(zip(toxic.tolist(), least.tolist(), strict=True)):
        keys = {(t, k, m) for k, m in enumerate(row) if m}
        if not keys & seen:
            keep.append(i)
        seen |= keys
    return np.array(keep, np.int64)


@dataclass
class Design:
    """Sparse rows (row, column, value) of texts and their grades."""

    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    grade: np.ndarray
    features: int

    def loss(self, w: np.ndarray, t: np.ndarray, l2: float) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood with a quadratic penalty, and its derivatives by w and t.  t: the
        first threshold, then the logarithms of the gaps, so that thresholds stay in order."""
        n, grade = len(self.grade), self.grade
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        score = np.bincount(self.row, w[self.col] * self.val, minlength=n)
        upper, lower = np.append(theta, np.inf)[grade], np.concatenate([[-np.inf], theta])[grade]
        pu, pl = (1 / (1 + np.exp(np.clip(score - x, -500, 500))) for x in (upper, lower))
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
        by_score = (du - dl) / n
        by_w = np.bincount(self.col, by_score[self.row] * self.val, minlength=len(w)) + l2 * w
        by_theta = np.array([(dl[grade == k + 1].sum() - du[grade == k].sum()) / n for k in range(len(t))])
        tail = np.cumsum(by_theta[::-1])[::-1]
        return float(-np.log(p).mean() + l2 * (w @ w) / 2), by_w, np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])


def fit(design: Design, rounds: int = 400, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least loss."""
    w, t = np.zeros(design.features), np.zeros(int(design.grade.max()))
    first, second = np.zeros(len(w) + len(t)), np.zeros(len(w) + len(t))
    for state in range(1, rounds + 1):
        _, gw, gt = design.loss(w, t, l2)
        g = np.concatenate([gw, gt])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        step = 0.1 * (first / (1 - 0.9**state)) / (np.sqrt(second / (1 - 0.99**state)) + 1e-8)
        w, t = w - step[: len(w)], t - step[len(w) :]
    return w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """Stored rows (doc_id, text, grade) of the sample."""
    quality = F.col("quality").cast("int") if "quality" in labels.columns else F.lit(None).cast("int")
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"), F.min(quality).alias("quality"))
    grade = F.when(F.col("toxic") <= 0, 0).when(F.col("quality") <= 0, 1).otherwise(2)
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    there = stored(one.select("doc_id", grade.alias("grade")).join(texts.select("doc_id"), "doc_id", "left_semi"), "labels")
    ids = [there.filter(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in ("grade = 0", "grade > 0")]
    # 2 * sample ids, so the broadcast is bounded
    ids = stored(ids[0].unionByName(ids[1]), "labelled")
    return stored(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")), "labelled-texts")


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, most_features: int = 4000, least_docs: int = 4) -> OrdinalModel:
    """docs: doc_id, text; labels: doc_id, toxic and, if there, quality.  Features of fewer than `least_docs`
    sampled texts are left out."""
    rows = labelled(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, sample)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in slices(batch, "text"):
                least = pa.array([x.tobytes() for x in least_shingles(some.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("grade"), least], ["doc_id", "grade", "least"])

    # a row for each sampled text
    got = rows.mapInArrow(sketched, "doc_id long, grade int, least binary").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return OrdinalModel()
    grade = got.column("grade").to_numpy()
    kept = without_copies(np.frombuffer(b"".join(got.column("least").to_pylist()), np.uint64).reshape(got.num_rows, -1), grade > 0)
    ids, grade = got.column("doc_id").to_numpy()[kept], grade[kept]
    n = int((grade > 0).sum()), int((grade == 0).sum())
    if not all(n):
        return OrdinalModel()

    def kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, str]]:
        for batch in trimmed(batches):
            for some in slices(batch, "text"):
                here = some.filter(pa.array(np.isin(some.column("doc_id").to_numpy(), ids)))
                yield from zip(here.column("doc_id").to_pylist(), here.column("grade").to_pylist(), here.column("text").to_pylist(), strict=True)

    def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, toxic = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for _, g, text in kept_texts(batches):
            keys.append(counted(text)[0])
            toxic.append(np.full(len(keys[-1]), g > 0))
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        both = [np.bincount(at, x, minlength=len(every)).astype(np.int64) for x in (np.concatenate(toxic), ~np.concatenate(toxic))]
        yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, both)], ["key", "toxic", "clean"])

    tally = rows.mapInArrow(tallied, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = tally.filter(F.col("toxic") + F.col("clean") >= least_docs).toArrow()  # of a bounded sample
    keys = select_features(often.column("key").to_numpy().view(np.uint64), often.column("toxic").to_numpy(), often.column("clean").to_numpy(), n, most_features)
    if not len(keys):
        return OrdinalModel()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, _, text in kept_texts(batches):
            k, counts = counted(text)
            at = np.searchsorted(keys, k)
            there = keys[np.minimum(at, len(keys) - 1)] == k
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([at[there].astype("<i4").tobytes()]), pa.array([counts[there].astype("<i4").tobytes()])], ["doc_id", "at", "counts"])

    cells = rows.mapInArrow(chosen, "doc_id long, at binary, counts binary").toArrow().sort_by("doc_id")
    at, counts = ([np.frombuffer(x, "<i4") for x in cells.column(c).to_pylist()] for c in ("at", "counts"))
    # grades that do not occur have no threshold
    design = Design(np.repeat(np.arange(len(at)), [len(x) for x in at]), np.concatenate(at), np.log1p(np.concatenate(counts)), np.unique(grade, return_inverse=True)[1], len(keys))
    weights, thresholds = fit(design)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the chosen hashes stand for."""
        for batch in trimmed(batches):
            found = set()
            for some in slices(batch, "text"):
                words = [f for w in tokenised(some.column("text"))[2] for f in features(w.decode())]
                found.update(w for w, h in zip(words, np.isin(word_hashes([w.encode() for w in words]), keys).tolist(), strict=True) if h)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["name"])

    # as many as features were chosen
    known = sorted(r["name"] for r in rows.select("text").mapInArrow(names, "name string").distinct().collect())
    at = np.searchsorted(keys, word_hashes([f.encode() for f in known]))
    return OrdinalModel(dict(zip(known, weights[at].tolist(), strict=True)), thresholds.tolist())


#: P(grade > 0) from which a text counts as toxic; clean texts are far below, one weak sign is not
THRESHOLD = 0.25


def judged(texts: pa.Array, model: OrdinalModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(expected grade, median grade, P(grade > 0)) of each text."""
    get, starts = model.weights.get, {f[:4] for f in model.weights}
    _, lengths, words, index = tokenised(texts)
    n = len(lengths)
    doc = np.repeat(np.arange(n), lengths)
    pairs = [(i, f) for i, w in enumerate(words) for f in features(w.decode()) if f[:4] in starts and get(f) is not None]
    total = np.zeros(n)
    if pairs:
        names = {f: j for j, f in enumerate(dict.fromkeys(f for _, f in pairs))}
        weight = np.array([get(f) for f in names])
        at, feature = np.array([i for i, _ in pairs], np.int64), np.array([names[f] for _, f in pairs], np.int64)
        first = np.searchsorted(at, np.arange(len(words) + 1))
        k = np.diff(first)[index]
        ends = np.cumsum(k)
        rows = np.repeat(doc, k)
        cols = feature[np.arange(int(ends[-1])) - np.repeat(ends - k, k) + np.repeat(first[:-1][index], k)]
        cell, count = np.unique(rows * len(names) + cols, return_counts=True)
        total = np.bincount(cell // len(names), weight[cell % len(names)] * np.log1p(count), minlength=n)
    over = model.exceed(total)
    if not over.shape[1]:
        return np.zeros(n), np.zeros(n, np.int32), np.zeros(n)
    return over.sum(axis=1), (over >= 0.5).sum(axis=1).astype(np.int32), over[:, 0]


def score(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs: doc_id, text.  Rows (doc_id, severity, grade, p_toxic, toxic): severity is the expected
    grade, grade the median, toxic tells whether P(grade > 0) reaches the threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            for some in slices(batch, "text"):
                severity, grade, p = judged(some.column("text"), model)
                cols = [some.column("doc_id"), pa.array(severity), pa.array(grade), pa.array(p), pa.array(p >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(work, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def toxicity_filter(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text, any further columns) that are not toxic, unchanged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in alone(batches):
            for some in slices(batch, "text"):
                yield some.filter(pa.array(judged(some.column("text"), model)[2] < threshold))

    return docs.mapInArrow(work, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
