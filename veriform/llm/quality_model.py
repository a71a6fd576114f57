"""A quality score by random Fourier features, ridge regression and isotonic calibration.

Statistics of each text are one row of a few numbers. Random cosines of them approximate a Gaussian kernel; each task
sums the normal equations of its rows, the sums meet in one small aggregate, and the solution is calibrated on other
labelled rows by pooling adjacent violators over a bounded number of bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .lexer import slices
from .text_stats import features


@dataclass(frozen=True)
class Settings:
    cosines: int = 256
    width: float = 5.0  # of the kernel, in standard deviations of the statistics
    clip: float = 2.0  # standard deviations beyond which statistics count alike, so that odd texts stay near known ones
    ridge: float = 1e-5  # per row
    bins: int = 1000  # of raw scores that are calibrated
    max_rows: int = 1_000_000  # labelled rows that are fitted, chosen by a hash
    seed: int = 7


def basis(settings: Settings, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(settings.seed)
    return rng.normal(0, 1 / settings.width, (n, settings.cosines)), rng.uniform(0, 2 * np.pi, settings.cosines)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, settings: Settings) -> np.ndarray:
    """Random Fourier features of rows of statistics, a constant last."""
    w, b = basis(settings, x.shape[1])
    z = np.clip((x - mean) / scale, -settings.clip, settings.clip)
    return np.concatenate((np.sqrt(2 / settings.cosines) * np.cos(z @ w + b), np.ones((len(x), 1))), axis=1)


def isotonic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to means ``y`` with weights, in the order of ``x`` (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(y[np.argsort(x)], weight[np.argsort(x)], strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools]) if pools else np.zeros(0)


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (hash of the text), ``x`` (statistics) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), values], names=["id", "h", "x"])

    kind = dict(docs.dtypes)[id_col]
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, f"id {kind}, h long, x array<double>")


def _stack(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    return np.array([r["m"] for r in each]), np.maximum(np.array([r["s"] for r in each]), 1e-6)


def fit(labelled: DataFrame, settings: Settings = Settings()) -> dict:  # noqa: B008
    """``x``, ``y`` (0 or 1), ``calibrate`` -> the model. Without rows of both labels, the score is their share (0.5 if none)."""
    share = labelled.agg(F.avg("y"), F.min("y"), F.max("y")).first()
    if share[0] is None or share[1] == share[2]:
        return {"constant": 0.5 if share[0] is None else float(share[0])}
    train = labelled.where("not calibrate")
    if train.agg(F.min("y") == F.max("y")).first()[0] in (None, True):
        train = labelled
    mean, scale = _moments(train)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                z = cosines(_stack(part.column("x")), mean, scale, settings)
                z = np.concatenate((z, part.column("y").to_numpy(zero_copy_only=False)[:, None]), axis=1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = train.select("x", "y").coalesce(16).mapInArrow(sums, "i int, row array<double>")
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    d = settings.cosines + 2
    gram = np.zeros((d, d))
    got = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("v")).collect()
    for r in got:
        gram[r["i"]] = r["v"]
    n = gram[d - 2, d - 2]
    penalty = np.eye(d - 1) * settings.ridge * n
    penalty[-1, -1] = 0
    beta = np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])
    model = {"mean": mean, "scale": scale, "beta": beta}
    held = labelled.where("calibrate")
    scored = score(held if held.limit(1).count() else labelled, model, settings, "y double", ["y"])
    step = 1.0 / settings.bins
    bins = scored.groupBy(F.round(F.greatest(F.least("score", F.lit(1.5)), F.lit(-0.5)) / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    x = np.array([b["bin"] * step for b in bins])
    y = isotonic(x, np.array([float(b["n"]) for b in bins]), np.array([b["y"] for b in bins]))
    return model | {"knots": x, "levels": y}


def judged(x: np.ndarray, model: dict, settings: Settings) -> np.ndarray:
    """Scores of rows of statistics: raw, or calibrated if the model has been."""
    if "constant" in model:
        return np.full(len(x), model["constant"])
    s = cosines(x, model["mean"], model["scale"], settings) @ model["beta"]
    return np.interp(s, model["knots"], model["levels"]) if "knots" in model else s


def score(rows: DataFrame, model: dict, settings: Settings, schema: str, carry: list[str]) -> DataFrame:
    """Columns ``carry`` (as in ``schema``) and ``score``: raw, or calibrated if the model has been."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                s = judged(_stack(part.column("x")), model, settings)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(s)], names=[*carry, "score"])

    return rows.select("x", *carry).mapInArrow(run, f"{schema}, score double")


def held_out(id_: Column, folds: int = 5) -> Column:
    """Rows whose labels are not learned: CRC32 of the id as text, modulo ``folds``, is 0. Null ids are held out."""
    return F.coalesce(F.crc32(id_.cast("string")) % folds == 0, F.lit(True))


def learned(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, settings: Settings) -> tuple[DataFrame, dict]:
    """Statistics of all rows (``id``, ``h``, ``x``), and the model fitted to those with labels that are not held out."""
    rows = materialise(with_features(docs, id_col, text_col))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    known = known.where(F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    fold = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 20))
    known = known.withColumn("calibrate", F.pmod(fold, F.lit(4)) == 0).withColumn("fold", fold)
    n = known.count()
    if n > settings.max_rows:
        known = known.where(F.col("fold") < int((1 << 20) * settings.max_rows / n))
    return rows, fit(materialise(rows.join(known, "id").select("x", "y", "calibrate")), settings)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                   settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Per row of ``docs``: ``id``, ``h`` (hash of the text), ``held_out`` and ``score``, from 0 to 1.

    Labels are joined on the id; of several for one id the greatest counts, null labels none. A quarter of the learned
    labels only calibrates. Null and empty texts have a score like any other.
    """
    rows, model = learned(docs, labels, id_col, text_col, label_col, settings)
    kind = dict(docs.dtypes)[id_col]
    return score(rows, model, settings, f"id {kind}, h long", ["id", "h"]).withColumn("held_out", held_out(F.col("id")))


def good_rows(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
              settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` without the rows that score below ``threshold``; all columns.

    Texts are judged where they are read: their statistics are made once more rather than joined, so no text is shuffled.
    """
    _, model = learned(docs, labels, id_col, text_col, label_col, settings)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{at}"):
                keep = judged(features(part.column(at)), model, settings) >= threshold
                yield pa.RecordBatch.from_arrays(part.columns, names=names).filter(pa.array(keep))

    return docs.select(*(F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names))).mapInArrow(run, docs.schema)
