"""A toxicity score by a factorization machine over hashed terms.

Terms are words and their first bytes, hashed. The terms that tell the labels apart most are chosen by counts over
the labelled rows of the sample (``max_rows``), so words of other rows only are not learned; the machine then learns a weight and a short vector for each, so that pairs such as an insult and
the mention of a group weigh more, or less, together than the sum of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .lexer import Words, ascii_lower, byte_set, mix, slices
from .quality_model import held_out


@dataclass(frozen=True)
class Settings:
    bits: int = 22  # hashed terms are numbers below 2**bits
    prefixes: tuple[int, ...] = (4, 5)  # bytes of a word's start that are terms too
    terms: int = 1024  # the most telling ones, which the machine learns
    factors: int = 8
    max_rows: int = 100_000  # labelled rows that it learns from, chosen by a hash
    epochs: int = 12
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 11


def term_ids(column: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed term, each different term of a row once. Words: ASCII letters, digits and all beyond ASCII."""
    w = Words(column, byte_set((0, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)), ascii_lower())
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, terms = [w.row], [w.hashes()]
    for n in settings.prefixes:
        longer = w.end - w.start > n
        rows.append(w.row[longer])
        terms.append(mix(w.hashes(n)[longer] ^ np.uint64(n)))
    term = np.concatenate(terms) >> np.uint64(64 - settings.bits)
    pair = np.unique(np.concatenate(rows).astype(np.uint64) << np.uint64(settings.bits) | term)
    return (pair >> np.uint64(settings.bits)).astype(np.int64), (pair & np.uint64((1 << settings.bits) - 1)).astype(np.int64)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def _chosen(part: pa.RecordBatch, chosen: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    row, term = term_ids(part.column("text"), settings)
    if not len(chosen):
        return row[:0], term[:0]
    at = np.minimum(np.searchsorted(chosen, term), len(chosen) - 1)
    hit = chosen[at] == term
    return row[hit], at[hit]


def _sum_rows(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, row, values)
    return out


def predict(row: np.ndarray, term: np.ndarray, n: int, model: dict) -> np.ndarray:
    """Probabilities of ``n`` rows, given the (row, term) pairs that are set."""
    v = model["v"][term]
    s = _sum_rows(row, v, n)
    raw = model["b"] + _sum_rows(row, model["w"][term], n) + 0.5 * ((s**2).sum(axis=1) - _sum_rows(row, (v**2).sum(axis=1), n))
    return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def learn(lists: list[np.ndarray], y: np.ndarray, settings: Settings) -> dict:
    """Weights and factors by mini-batches (Adam), rows of the rarer label counting as much as the others together, up to tenfold."""
    rng = np.random.default_rng(settings.seed)
    m = {"b": np.zeros(1), "w": np.zeros(settings.terms), "v": rng.normal(0, 0.05, (settings.terms, settings.factors))}
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
        m["b"][0] = np.log(share / (1 - share))
        return m | {"b": m["b"][0]}
    share = y.mean()
    m["b"][0] = np.log(share / (1 - share))
    mean, var = {k: np.zeros_like(x) for k, x in m.items()}, {k: np.zeros_like(x) for k, x in m.items()}
    step, size = 0, 512
    weight = np.where(y == 1, min(10.0, max(1.0, (1 - share) / share) ** 0.5), 1.0)
    for _ in range(settings.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            pick = order[at : at + size]
            row = np.repeat(np.arange(len(pick)), [len(lists[i]) for i in pick])
            term = np.concatenate([lists[i] for i in pick]) if len(row) else np.zeros(0, np.int64)
            v = m["v"][term]
            s = _sum_rows(row, v, len(pick))
            raw = m["b"] + _sum_rows(row, m["w"][term], len(pick)) + 0.5 * ((s**2).sum(axis=1) - _sum_rows(row, (v**2).sum(axis=1), len(pick)))
            g = weight[pick] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) / len(pick)
            grad = {"b": np.array([g.sum()]), "w": settings.decay * m["w"], "v": settings.decay * m["v"]}
            np.add.at(grad["w"], term, g[row])
            np.add.at(grad["v"], term, g[row][:, None] * (s[row] - v))
            step += 1
            for k in m:
                mean[k] = 0.9 * mean[k] + 0.1 * grad[k]
                var[k] = 0.999 * var[k] + 0.001 * grad[k] ** 2
                m[k] = m[k] - settings.rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"b": m["b"][0]}


def telling_terms(pairs: DataFrame, totals: tuple[int, int], settings: Settings) -> np.ndarray:
    """``term``, ``y`` -> the terms whose presence tells most about the label, by the likelihood ratio of their counts."""
    n0, n1 = totals
    c = pairs.groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    c = c.where("a + b >= 3")
    p = (F.col("a") + F.col("b")) / float(n0 + n1)
    part = lambda k, n, q: k * F.log(F.greatest(q, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - q, F.lit(1e-12)))
    g = part(F.col("a"), F.lit(n1), F.col("a") / n1) + part(F.col("b"), F.lit(n0), F.col("b") / n0) - part(F.col("a"), F.lit(n1), p) - part(F.col("b"), F.lit(n0), p)
    rows = c.select("term", g.alias("g")).orderBy(F.desc("g"), "term").limit(settings.terms).collect()
    return np.sort(np.array([r["term"] for r in rows], np.int64))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Per row of ``docs``: ``id``, ``held_out`` and ``score``, from 0 to 1.

    Labels are joined on the id; of several for one id the greatest counts, null labels none. A row without terms,
    such as a null or empty text, has the score of the constant. Without labels of both kinds all scores are their
    share, or 0.01.
    """
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    count = known.count()
    fold = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 20))
    if count > settings.max_rows:
        known = known.where(fold < int((1 << 20) * settings.max_rows / count))
    known = materialise(known)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, term = term_ids(part.column("text"), settings)
                yield pa.RecordBatch.from_arrays([_lists(row, term, part.num_rows), part.column("y")], names=["terms", "y"])

    # At most about max_rows ids and labels: sent to the tasks, so that no text is shuffled.
    chosen_rows = rows.join(F.broadcast(known), "id").select("text", "y")
    labelled = materialise(chosen_rows.mapInArrow(terms, "terms array<int>, y int"))
    counts = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = np.zeros(0, np.int64)
    if counts.get(0) and counts.get(1):
        chosen = telling_terms(labelled.select(F.explode("terms").alias("term"), "y"), (counts[0], counts[1]), settings)
    keep = chosen.copy()

    def chosen_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, out_row, out_term = batch.column("terms"), [], []
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(keep):
                at = np.minimum(np.searchsorted(keep, term), len(keep) - 1)
                hit = keep[at] == term
                out_row, out_term = row[hit], at[hit]
            else:
                out_row, out_term = row[:0], term[:0]
            yield pa.RecordBatch.from_arrays([_lists(out_row, out_term, batch.num_rows), batch.column("y")], names=["terms", "y"])

    sample = labelled.mapInArrow(chosen_only, "terms array<int>, y int").groupBy("terms", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("terms", "y").collect()
    lists, y = [], []
    for r in sample:  # rows with the same terms are learned once each, in a fixed order
        lists += [np.array(r["terms"], np.int64)] * r["n"]
        y += [r["y"]] * r["n"]
    model = learn(lists, np.array(y, float), settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, term = _chosen(part, keep, settings)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(predict(row, term, part.num_rows, model))], names=["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double").withColumn("held_out", held_out(F.col("id")))
