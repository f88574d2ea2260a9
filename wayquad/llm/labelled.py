"""Labelled documents, bounded samples of them, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayquad.llm.common import crc_of_id, first, pin


def learn_rows(modulus: int, held: int) -> Column:
    """Rows whose crc32 of the id written as text leaves another remainder than ``held``."""
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(modulus)) != held


def usable(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> tuple[DataFrame, np.ndarray]:
    """doc_id and y of the labelled ids that ``learn`` allows and whose document is there with a text; how many have y 0 and 1.

    Rows with a null id or a label other than 0 and 1 take no part; an id with several labels has the largest.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    found = pin(known.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"))
    counted = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found, np.array([counted.get(0, 0), counted.get(1, 0)])


def sample(found: DataFrame, totals: np.ndarray, per_class: tuple[int, int]) -> DataFrame:
    """At most ``per_class`` of the ``totals`` rows of y 0 and 1, those with the smallest hashes of their ids: the same at any partitioning."""
    parts = [first(found.where(F.col("y") == y), "doc_id", per_class[y], int(totals[y])) for y in (0, 1)]
    return pin(parts[0].union(parts[1]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of standardised columns and, last, the bias, by Newton steps; columns are scaled back."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack(((x - mean) / spread, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty, z.T @ (p - y) / len(y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scaled = w[:-1] / spread
    return np.append(scaled, w[-1] - scaled @ mean)
