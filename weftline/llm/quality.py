"""Quality classifier by co-training over two views.

The content view is computed from the whole text: character-trigram frequencies hashed into a fixed number of columns,
shares of letters, capitals, digits, marks and repeats, and word statistics.  The metadata view uses the other columns: language,
source and length.  Each view has a logistic regression, fitted to labelled documents first and calibrated on labelled
documents held out from training.  In each round either view labels every unlabelled document of which its calibrated
probability is sure, and the other view learns from those labels too.  At the end the calibrated log-odds of both are
combined into one score.

Only labelled documents are sampled: at most ``MAX_LABELLED``, chosen by hash, take part in training.  A round is one pass
over all other documents.  What leaves a task is a gradient and a count for each view and label, whose size does not
depend on the documents, so pseudo-labels are neither capped nor collected.  Gradients are sums of integers, hence
the same however the documents are dealt over tasks.  Scoring reads every document once more; no pass shuffles texts.
"""

from __future__ import annotations

from collections.abc import Callable
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.batches import settled, small_batches, text_chunks

MAX_LABELLED = 6000
DAMPING = 20
TRIGRAMS = 256
META = 64
ROUNDS = 3
CONFIDENT = 0.95
#: The pseudo-labels of one kind weigh at most ``EACH`` apiece and ``SHARE`` of the labels of that kind together.
EACH, SHARE = 0.3, 0.3
FIXED = float(1 << 20)
CHUNK = 2 << 20


def _classes() -> np.ndarray:
    """For each byte its kind: 0 lower, 1 upper, 2 digit, 3 space, 4 other mark, 5 part of a non-ASCII character."""
    kind = np.full(256, 4, np.int64)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1] = 0, 1, 2
    kind[[9, 10, 11, 12, 13, 32]], kind[128:] = 3, 5
    return kind


KINDS = _classes()


def content_features(texts: list[str | None]) -> np.ndarray:
    """One row for each whole text: trigram frequencies, shares of character kinds and repeats, word statistics, log length.

    Frequencies are damped by a constant in the denominator, so that a short text is near the origin and not an extreme.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raw])
    out = np.zeros((len(raw), TRIGRAMS + 12), np.float32)
    total = int(sizes.sum())
    if not total:
        return out
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    who = np.repeat(np.arange(len(raw)), sizes)
    kind = KINDS[b]
    shares = np.bincount(who * 6 + kind, minlength=len(raw) * 6).reshape(len(raw), 6)
    many = sizes + DAMPING
    if total > 2:
        inside = who[2:] == who[:-2]
        low = np.where(kind == 1, b + 32, b)
        gram = ((low[2:] * 31 + low[1:-1]) * 31 + low[:-2]) * 0x9E3779B1 >> 12 & TRIGRAMS - 1
        grams = np.bincount((who[2:] * TRIGRAMS + gram)[inside], minlength=len(raw) * TRIGRAMS).reshape(len(raw), TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(grams / (many + 9 * DAMPING)[:, None])
        twice = (b[1:] == b[:-1]) & (who[1:] == who[:-1])
        thrice = twice[1:] & twice[:-1]
        out[:, -3] = np.bincount(who[1:][twice], minlength=len(raw)) / many
        out[:, -2] = np.bincount(who[2:][thrice], minlength=len(raw)) / many
    out[:, TRIGRAMS : TRIGRAMS + 6] = shares / many[:, None]
    for i, r in enumerate(raw):
        words = r.split()
        n = len(words)
        out[i, TRIGRAMS + 6] = sum(map(eq, words, words[1:])) / (n + 5)
        out[i, TRIGRAMS + 7] = len(set(words)) / (n + 5)
        out[i, TRIGRAMS + 8] = sizes[i] / (10 * n + 50)
    out[:, -1] = np.log1p(sizes) / 10
    return out


def meta_features(columns: list[list], sizes: list) -> np.ndarray:
    """Hashed values of the categorical columns, one block of ``META`` columns for each, and the log length."""
    n = len(sizes)
    out = np.zeros((n, META * len(columns) + 1), np.float32)
    for k, values in enumerate(columns):
        slot = [xxhash.xxh3_64_intdigest(str(v)) % META for v in values]
        out[np.arange(n), k * META + np.array(slot, np.int64)] = 1
    out[:, -1] = np.log1p(np.array([max(0, s or 0) for s in sizes], np.float64)) / 10
    return out


class Logistic:
    """Logistic regression on columns standardised and clipped, by Newton steps with a ridge."""

    def __init__(self, ridge: float = 3.0, steps: int = 12):
        self.ridge, self.steps = ridge, steps
        self.platt = (1.0, 0.0)

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -10, 10), np.ones((len(x), 1))]).astype(np.float64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.w = np.zeros(x.shape[1] + 1)
        return self.learn(x, y, np.zeros(x.shape[1] + 1), 0.0)

    def learn(self, x: np.ndarray, y: np.ndarray, slope: np.ndarray, weight: float) -> Logistic:
        """Move to the optimum over labelled rows and others, of which only their gradient here and weight are known.

        The loss of the others is replaced by its linear part and the quadratic bound of a logistic loss, a quarter of the
        second moments, taken from the labelled rows.
        """
        z = self.design(x)
        start, w = self.w, self.w.copy()
        near = z.T @ z * (0.25 * weight / len(z))
        ridge = np.full(z.shape[1], self.ridge)
        ridge[-1] = 1e-3
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (p - y) + ridge * w + slope + near @ (w - start)
            h = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(ridge) + near
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-5:
                break
        self.w = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.w, -15, 15)

    def share(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds."""
        return self.platt[0] * self.margin(x) + self.platt[1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit slope and offset to rows that did not train; left as they are where all bear one label."""
        if len(set(y.tolist())) == 2:
            self.platt = _platt(self.margin(x), y)


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that calibrate margins, slightly smoothed; a slope below 0 counts as no information: the share of
    good labels is all that is known then."""
    a, b = 0.5, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-4)
        g = np.array([((p - y) * m).sum() + 0.5 * (a - 0.5), (p - y).sum()])
        h = np.array([[(s * m * m).sum() + 0.5, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    if a <= 0:
        a, b = 0.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
    return a, b


def exchange(models: list[Logistic], views: list[np.ndarray], confident: float) -> np.ndarray:
    """What the unlabelled rows of ``views`` teach: for each view and label the number of rows to which the other view
    gives that label, and this view's gradient over them, as integers in units of 1 / ``FIXED`` (counts in ones).

    A view is as sure as its calibrated probability says, so one that knows little gives few labels.
    """
    sure, out = np.log(confident / (1 - confident)), []
    for v, x in enumerate(views):
        z, own, giver = models[v].design(x), models[v].share(x), models[1 - v].odds(views[1 - v])
        for side, odds in ((0, -giver), (1, giver)):
            pick = odds >= sure
            pull = z[pick] * (own[pick] - side)[:, None]
            out += [np.array([pick.sum()]), np.rint(pull * FIXED).astype(np.int64).sum(0)]
    return np.concatenate(out)


class CoTrained:
    """Two views trained on each other's confident labels; ``score`` combines their calibrated log-odds."""

    def fit(
        self, text: np.ndarray, meta: np.ndarray, label: np.ndarray, others: Callable[[list[Logistic], float], np.ndarray] | None = None,
        rounds: int = ROUNDS, confident: float = CONFIDENT,
    ) -> CoTrained:
        """``label`` is 0 or 1; every fifth row calibrates and does not train.

        ``others`` gives the sum of ``exchange`` over all unlabelled documents; ``taught`` notes its counts by round, the
        content view's first, bad before good.
        """
        rows = np.arange(len(label))
        held, train = rows[::5], np.delete(rows, rows[::5])
        self.constant, self.taught = None, []
        if len(set(label[train].tolist())) < 2:
            self.constant = float(label.mean()) if len(label) else 1.0
            return self
        views, y = [text, meta], label.astype(float)
        self.models = [Logistic().fit(x[train], y[train]) for x in views]
        for m, x in zip(self.models, views, strict=True):
            m.calibrate(x[held], y[held])
        for _ in range(rounds if others else 0):
            got, at, lessons = others(self.models, confident), 0, []
            self.taught.append([])
            for x in views:
                slope, weight = np.zeros(x.shape[1] + 1), 0.0
                for side in (0, 1):
                    n, pull = int(got[at]), got[at + 1 : at + 2 + x.shape[1]] / FIXED
                    at += 2 + x.shape[1]
                    self.taught[-1].append(n)
                    if n:
                        each = min(EACH, SHARE * float((y[train] == side).sum()) / n)
                        slope, weight = slope + each * pull, weight + each * n
                lessons.append((slope, weight))
            if not any(self.taught[-1]):
                break
            for m, x, (slope, weight) in zip(self.models, views, lessons, strict=True):
                m.learn(x[train], y[train], slope, weight).calibrate(x[held], y[held])
        self.base = float(np.log((y.sum() + 1) / ((1 - y).sum() + 1)))
        return self

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: by content, by metadata, and by both (the prior counts once)."""
        if self.constant is not None:
            return (np.full(len(text), self.constant),) * 3
        odds = [m.odds(x) for m, x in zip(self.models, (text, meta), strict=True)]
        both = odds[0] + odds[1] - self.base
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*odds, both))


def _features(batches, categories: int):
    for batch in batches:
        for part in text_chunks(batch, "text", CHUNK):
            cols = [part.column(i).to_pylist() for i in range(part.num_columns)]
            yield part, content_features(cols[1]), meta_features(cols[3 : 3 + categories], cols[2])


def _view(docs: DataFrame, doc_id: str, text: str, size: str, categories: tuple[str, ...]) -> DataFrame:
    cats = [F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(categories)]
    return small_batches(docs).select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{size}`").cast("bigint").alias("size"), *cats
    )


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, doc_id: str = "doc_id",
    text: str = "text", size: str = "n_chars", categories: tuple[str, ...] = ("source", "lang"), label: str = "quality",
) -> CoTrained:
    """Fit on at most ``max_labelled`` labelled documents, the first by a hash of the id, and on all others without labels.

    Contradicting labels of one id count as their minimum; null ids and labels are ignored.  Of several rows of a labelled id
    the one with the smallest features trains; the others of that id are left out.  All other rows, those without id and
    repeated ones included, take part in the exchange of pseudo-labels.  Without labels of both kinds the model is the
    share of good labels (1 without any).
    """
    pick = labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    pick = pick.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"))
    known = pick.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = {r.doc_id: r.label for r in known.collect()}  # at most max_labelled rows
    n, spark = len(categories), docs.sparkSession

    @settled("quality")
    def features(batches):
        for part, a, b in _features(batches, n):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], names=["doc_id", "a", "b"]
            )

    wanted = F.broadcast(spark.createDataFrame([(i,) for i in chosen] or [(None,)], "doc_id bigint"))
    view = _view(docs, doc_id, text, size, categories)
    rows = view.join(wanted, "doc_id", "left_semi").mapInArrow(features, "doc_id bigint, a binary, b binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("x")).select("doc_id", "x.*").collect()
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r.doc_id)), r.doc_id))
    matrix = [np.stack([np.frombuffer(r[k], np.float32) for r in rows]) if rows else np.zeros((0, 1), np.float32) for k in ("a", "b")]
    free = view.join(wanted, "doc_id", "left_anti")

    def others(models: list[Logistic], confident: float) -> np.ndarray:
        """One pass over the unlabelled documents; tasks send sums of one fixed length, added up by position."""
        width = 2 * sum(len(m.w) + 1 for m in models)

        @settled("quality")
        def run(batches):
            total = np.zeros(width, np.int64)
            for _, a, b in _features(batches, n):
                total += exchange(models, [a, b], confident)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["total"])

        sums = free.mapInArrow(run, "total array<bigint>").select(F.posexplode("total").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        out = np.zeros(width, np.int64)
        for r in sums.collect():  # one row for each of a fixed number of positions
            out[r["at"]] = r["x"]
        return out

    return CoTrained().fit(*matrix, np.array([chosen[r.doc_id] for r in rows], np.int64), others)


def score(
    docs: DataFrame, model: CoTrained, doc_id: str = "doc_id", text: str = "text", size: str = "n_chars", categories: tuple[str, ...] = ("source", "lang")
) -> DataFrame:
    """``(doc_id, text_score, meta_score, score)`` for every row of ``docs``, repeated rows included.

    Null texts count as empty, null metadata as a value of its own; an empty table gives none; other columns are left
    out.
    """
    held, n = docs.sparkSession.sparkContext.broadcast(model), len(categories)

    @settled("quality")
    def run(batches):
        for part, a, b in _features(batches, n):
            found = [pa.array(x.astype(np.float64)) for x in held.value.score(a, b)]
            yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["doc_id", "text_score", "meta_score", "score"])

    return _view(docs, doc_id, text, size, categories).mapInArrow(run, "doc_id bigint, text_score double, meta_score double, score double")


def keep_good(docs: DataFrame, model: CoTrained, threshold: float = 0.5, text: str = "text", size: str = "n_chars", categories: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns and no shuffle."""
    held, names, n = docs.sparkSession.sparkContext.broadcast(model), docs.columns, len(categories)
    at = [names.index(c) for c in (text, size, *categories)]

    @settled("quality")
    def run(batches):
        for batch in batches:
            plain = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in text_chunks(plain, f"c{at[0]}", CHUNK):
                cols = [part.column(i).to_pylist() for i in at]
                good = held.value.score(content_features(cols[0]), meta_features(cols[2 : 2 + n], cols[1]))[2] >= threshold
                yield part.filter(pa.array(good)).rename_columns(names)

    return small_batches(docs).mapInArrow(run, docs.schema)
