"""What an iterative search for a cell order needs: rewards of order prefixes, schedules, returns, stopping.

The search itself is sequential and runs on the driver over a bounded table of cells; Spark evaluates
rewards, which are queries over cells and trajectories.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayquad.functions.geometry import Grid
from wayquad.operators import cost, search
from wayquad.operators.order import complete_order


def prefix_reward(queries: DataFrame, trajectories: DataFrame, cells: DataFrame, default: DataFrame, length: int, prefix: DataFrame, grid: Grid) -> DataFrame:
    """One row: mean over queries of the cost by codes less the cost by the first ``length`` cells of ``prefix`` and the default rest."""
    order = complete_order(prefix.where(F.col("ord") < length), default)
    by_code = cost.query_cost(queries, search.code_intervals(queries, trajectories, cells, grid)).select("query_id", F.col("cost").alias("a"))
    by_order = cost.query_cost(queries, search.order_intervals(queries, trajectories, cells, order, grid)).select("query_id", F.col("cost").alias("b"))
    return by_code.join(by_order, "query_id").agg(F.round(F.avg(F.col("a") - F.col("b")), 6).alias("reward")).select(F.lit(length).alias("length"), "reward")


def checkpoints(n: int, k: int, exponent: float) -> list[int]:
    """Lengths of prefixes at which rewards are paid, denser at the beginning."""
    return sorted({min(n, max(1, math.ceil(n * (i / k) ** max(1.0, exponent)))) for i in range(1, k + 1)})


def weight(start: float, episode: int, warm_up: int) -> float:
    """Weight of the global reward, rising to 1 in ``warm_up`` episodes."""
    return start + (1 - start) * min(1.0, (episode - 1) / warm_up)


def action_limit(base: int | None, first: float, last: float, episode: int, decay: int) -> int | None:
    """How many of the most similar cells may come next; none if there is no limit."""
    if not base or base <= 0:
        return None
    low, high = max(1, round(base * first)), max(1, round(base * last))
    return max(1, round(low + (high - low) * min(1.0, episode / max(1, decay))))


def returns(rewards: list[float], values: list[float], done: list[bool], discount: float = 0.99, decay: float = 0.95) -> list[float]:
    """Generalised advantages plus values."""
    out, advantage, following = [0.0] * len(rewards), 0.0, 0.0
    for t in reversed(range(len(rewards))):
        go_on = 0.0 if done[t] else 1.0
        advantage = rewards[t] + discount * following * go_on - values[t] + discount * decay * go_on * advantage
        out[t], following = advantage + values[t], values[t]
    return out


@dataclass
class EarlyStop:
    """Stops after too many negative validations in a row, or when no gain has come for ``patience`` of them."""

    patience: int
    min_delta: float
    max_negative: int
    best: float = -math.inf
    waited: int = 0
    negative: int = 0

    def update(self, score: float) -> bool:
        self.negative = self.negative + 1 if score < 0 else 0
        if score > self.best + self.min_delta:
            self.best, self.waited = score, 0
        else:
            self.waited += 1
        return self.negative >= self.max_negative or self.waited >= self.patience


def best_run(metrics: DataFrame) -> DataFrame:
    """The row with the largest score (hgs), the first episode on ties."""
    return metrics.orderBy(F.desc("hgs"), "episode").limit(1)
