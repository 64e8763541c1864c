"""Quality classifier by co-training of a text view and a page-metadata view.

Two logistic classifiers see different columns: figures of the text's content, and the metadata
(hashed language and source, length).  They start from the labelled documents; in each round each one
scores a pool of unlabelled documents, and the ones that it is surest of, in the proportion of the
labels' classes, are given to the other as pseudo-labels.  At the end both views are calibrated on
scores from folds that they weren't fitted on, and a logistic rule over the two calibrated log-odds
scores every document.

The fit takes place on the driver on a bounded sample: MAX_LABELLED labelled and MAX_POOL unlabelled
documents on average, taken by a hash of their id.  Everything else covers all documents.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, named, small_batches, table

MAX_LABELLED, MAX_POOL = 6_000, 6_000
#: Labelled rows of one id that the fit takes.
PER_ID = 4
ROUNDS, PER_ROUND = 5, 0.05
FOLDS = 5
#: Documents below this probability of good quality are rejected; a low bar, for clean documents are to stay.
KEEP_FROM = 0.2
_HASHED = 32

_KINDS = np.full(256, 7, dtype=np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\v\f\r", b".,;:'\"()?-", b"|<>{}[]/\\_=+~`", b"!#$%&*@^")):
    _KINDS[list(_chars)] = _kind
TEXT_FEATURES = 22


def text_features(text: str | None) -> np.ndarray:
    """Figures of one whole text: shares of kinds of characters, variety of words and lines, and lengths."""
    raw = (text or "").encode()
    bytes_ = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = max(1, len(raw))
    kinds = np.bincount(_KINDS, weights=bytes_, minlength=8) / n
    chance = bytes_[bytes_ > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    ends = sum(1 for x in lines if x[-1:] in (b".", b"?", b"!"))
    return np.array([
        *kinds,
        float(-(chance * np.log(chance)).sum()),
        np.log1p(len(words)),
        len(counts) / m,
        max(counts.values(), default=0) / m,
        np.sqrt(len(counts)) / np.sqrt(m),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        len(set(lines)) / max(1, len(lines)),
        ends / max(1, len(lines)),
        np.log1p(len(lines)),
        np.log1p(lengths.max()),
        sum(c for w, c in counts.items() if len(w) == 1) / m,
    ])


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, and the length's logarithm with its square; unknown ones have a place of their own."""
    out = np.zeros(2 * _HASHED + 3)
    for i, value in enumerate((lang, source)):
        out[i * _HASHED + (0 if value is None else 1 + zlib.crc32(value.encode()) % (_HASHED - 1))] = 1
    size = np.log1p(max(0, n_chars or 0))
    out[-3:] = (size / 10, size * size / 100, n_chars is None)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients (the intercept last) by Newton's method with a ridge on all but the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * w
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class View:
    """One classifier: standardisation, coefficients and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] * self.log_odds(x) + self.calibration[1]


def _view(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    return View(mean, scale, fit_logistic(np.clip((x - mean) / scale, -8, 8), y, weight))


@dataclass
class Model:
    """Both views and the rule that joins them."""

    text: View
    meta: View
    joint: np.ndarray

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by the text, by the metadata, joint."""
        a, b = self.text.calibrated(text), self.meta.calibrated(meta)
        chance = lambda s: 1 / (1 + np.exp(-np.clip(s, -30, 30)))
        return chance(a), chance(b), chance(self.joint[0] * a + self.joint[1] * b + self.joint[2])


def co_train(views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model | None:
    """Fit both views by exchange of pseudo-labels; None unless both classes are labelled."""
    if len(y) == 0 or y.min() == y.max():
        return None
    good = y.mean()

    def exchange(rows: np.ndarray) -> list[View]:
        """Co-training from these labelled rows only."""
        given: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        free = [np.ones(len(pool[0]), dtype=bool), np.ones(len(pool[0]), dtype=bool)]
        own: list[View] = []
        for at in range(rounds + 1):
            own = []
            for v in (0, 1):
                x = np.vstack([views[v][rows], *[pool[v][i] for i, _ in given[v]]])
                labels = np.concatenate([y[rows], *[p for _, p in given[v]]])
                weight = np.concatenate([np.ones(len(rows)), *[np.full(len(p), 0.5) for _, p in given[v]]])
                own.append(_view(x, labels, weight))
            if at == rounds or not len(pool[0]):
                break
            for v in (0, 1):
                other, score = 1 - v, own[v].log_odds(pool[v])
                many = max(2, int(PER_ROUND * len(pool[0])))
                # Only log-odds beyond 2 in the class's favour are sure enough to be handed over.
                for label, take, sure in ((1.0, round(many * good), score), (0.0, round(many * (1 - good)), -score)):
                    able = np.flatnonzero(free[other] & (sure > 2))
                    best = able[np.argsort(-sure[able], kind="stable")[:take]]
                    free[other][best] = False
                    if len(best):
                        given[other].append((best, np.full(len(best), label)))
        return own

    fold = np.arange(len(y)) % FOLDS
    out = np.zeros((2, len(y)))
    for k in range(FOLDS):
        fit, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(held) == 0 or y[fit].min() == y[fit].max():
            continue
        for v, view in enumerate(exchange(fit)):
            out[v, held] = view.log_odds(views[v][held])
    final = exchange(np.arange(len(y)))
    for v in (0, 1):
        a, b = fit_logistic(out[v][:, None], y, np.ones(len(y)), ridge=1e-3)
        final[v].calibration = (float(a), float(b))
    calibrated = np.stack([final[v].calibration[0] * out[v] + final[v].calibration[1] for v in (0, 1)], axis=1)
    return Model(final[0], final[1], fit_logistic(calibrated, y, np.ones(len(y)), ridge=1e-3))


def _numbers(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    return [*text_features(text).tolist(), *meta_features(lang, source, n_chars).tolist()]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
    return pa.array([_numbers(*row) for row in zip(texts.to_pylist(), langs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), strict=True)], pa.list_(pa.float64()))


def _columns(df: DataFrame, text_col: str) -> list:
    """Text, lang, source and n_chars; absent ones are null."""
    known = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    return [F.col(text_col), known("lang", "string"), known("source", "string"), known("n_chars", "long")]


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, max_pool: int = MAX_POOL) -> Model | None:
    """Co-train on a bounded sample of the documents.  Of several labels for one id the mean's side counts; even ones and nulls drop out."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col)), 1) / F.lit(float(1 << 63))
    known = labels.groupBy(id_col).agg(F.avg(label_col).alias("y")).filter(F.col("y").isNotNull() & (F.col("y") != 0.5) & F.col(id_col).isNotNull())
    n_known, n_all = known.count(), df.count()
    if n_known == 0 or n_all == 0:
        return None
    few = known.filter(place < min(1.0, max_labelled / n_known)).select(F.col(id_col).alias("td_id"), (F.col("y") > 0.5).cast("double").alias("y"))
    # The sample of labels is bounded, so it can be broadcast.
    # Rows are placed by id and text, so that one id's many rows, or those without one, aren't drawn together.
    spread = F.shiftrightunsigned(F.xxhash64(F.lit(12), F.col(id_col), F.col(text_col)), 1) / F.lit(float(1 << 63))
    facts = df.select(F.col(id_col).alias("td_own"), F.xxhash64(text_col).alias("td_h"), spread.alias("td_place"), *[c.alias(f"td_f{i}") for i, c in enumerate(_columns(df, text_col))])
    rows = facts.join(F.broadcast(few), F.col("td_own") == F.col("td_id"), "left").filter(F.col("y").isNotNull() | (F.col("td_place") < min(1.0, max_pool / n_all)))
    # Equal rows of the sample say the same; one of each counts, and of one id's labelled rows the first PER_ID.
    rows = rows.dropDuplicates(["td_own", "td_h"])
    own = Window.partitionBy("td_own").orderBy("td_h")
    rows = rows.withColumn("td_at", F.row_number().over(own)).filter(F.col("y").isNull() | (F.col("td_at") <= PER_ID))
    got = rows.select(F.col("td_own").alias("id"), F.col("td_h").alias("h"), "y", _features(*[F.col(f"td_f{i}") for i in range(4)]).alias("x")).collect()
    got.sort(key=lambda r: (r["id"] is None, r["id"] or 0, r["h"]))
    x = np.array([r["x"] for r in got], dtype=np.float64).reshape(len(got), TEXT_FEATURES + 2 * _HASHED + 3)
    y = np.array([np.nan if r["y"] is None else r["y"] for r in got], dtype=np.float64)
    has = ~np.isnan(y)
    views = lambda rows: (x[rows][:, :TEXT_FEATURES], x[rows][:, TEXT_FEATURES:])
    return co_train(views(has), y[has], views(~has))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with p_text, p_meta, quality (probabilities of good quality) and is_good (quality of KEEP_FROM or more).

    Null texts count as empty, null or absent metadata has a feature of its own.  Unless both classes
    are labelled nothing can be told: probabilities are null and is_good is true.  Equal rows
    get equal scores; columns of the four names are replaced, others kept; an empty table gives
    an empty one.
    """
    small_batches(df.sparkSession)
    model = fit(df, labels, id_col, text_col)
    keep = [c for c in df.columns if c not in {"p_text", "p_meta", "quality", "is_good"}]
    if model is None:
        return df.select(*named(keep)).withColumns({c: F.lit(None).cast("double") for c in ("p_text", "p_meta", "quality")}).withColumn("is_good", F.lit(True))

    @F.arrow_udf("p_text double, p_meta double, quality double")
    def scores(texts: pa.Array, langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> pa.Array:
        a = np.array([text_features(t) for t in texts.to_pylist()]).reshape(len(texts), TEXT_FEATURES)
        b = np.array([meta_features(*m) for m in zip(langs.to_pylist(), sources.to_pylist(), sizes.to_pylist(), strict=True)]).reshape(len(texts), 2 * _HASHED + 3)
        return pa.StructArray.from_arrays([pa.array(p) for p in model.score(a, b)], ["p_text", "p_meta", "quality"])

    out, back = aside(df, keep)
    scored = df.select(*out, scores(*_columns(df, text_col)).alias("td_scores"))
    return scored.select(*back, "td_scores.p_text", "td_scores.p_meta", "td_scores.quality", (F.col("td_scores.quality") >= KEEP_FROM).alias("is_good"))


def op2(spark, sf_dir) -> DataFrame:
    """Every document's quality."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_text", "p_meta", "quality", "is_good")


def stage(spark, docs, sf_dir) -> DataFrame:
    """Documents that the classifier rejects go."""
    return classify(docs, table(spark, sf_dir, "labels")).filter("is_good").select(*named(docs.columns))
