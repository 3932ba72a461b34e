"""Many weightings of one history, reduced without multiplying its rows.

A scored row holds eight component scores; under S scenarios it has S composites. Here these are one
vector of S places that never leaves its task: Arrow batches of rows meet the matrix of weights, and
the mean, the worst and the days in the high regime of each scope are kept place by place. One row of
vectors for each scope and task is shuffled, where ``score.assess`` with scenarios makes, and a
grouping then reads, S rows of each. Built-in aggregates know no element-wise sum of arrays, hence
the Arrow batches.

Sums of a row follow the component order, as in ``score``, so each composite is the same double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline import params as P
from tideline.operators.score import BROADCAST_SCENARIOS, COMPONENTS, Scenarios, scenario_weights, with_composite, with_weights

#: Composites made at once in a task, and bytes of vectors held before they are passed on.
CELLS, HELD_BYTES = 1 << 20, 64 << 20
SUMMARY = "scope string, scenario string, dates bigint, mean double, worst double, days_high bigint"


def weight_matrix(scenarios: Scenarios | DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Names and weights of the scenarios, or None where a table holds more than the stated bound."""
    if isinstance(scenarios, DataFrame):
        rows = scenario_weights(scenarios).orderBy("scenario").limit(BROADCAST_SCENARIOS + 1).collect()
        if len(rows) > BROADCAST_SCENARIOS:
            return None
        return [r["scenario"] for r in rows], np.array([[r[f"w_{k}"] for k in COMPONENTS] for r in rows], float).reshape(-1, len(COMPONENTS))
    unknown = {k for own in scenarios.values() for k in own} - set(COMPONENTS)
    if unknown:
        raise ValueError(f"unknown components: {sorted(unknown)}")
    return list(scenarios), np.array([[float(own.get(k, P.COMPONENTS[k][1])) for k in COMPONENTS] for own in scenarios.values()])


def composites(score: np.ndarray, floor: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(composite, whether any component counts) of each row under each scenario. NaN: no score."""
    total = np.zeros((len(score), len(weight)))
    available = np.zeros_like(total)
    for k in range(score.shape[1]):
        w, s = weight[:, k], score[:, k]
        counts = ~np.isnan(s)[:, None] & (w > 0)[None, :]
        total += np.where(counts, s[:, None] * w[None, :], 0.0)
        available += np.where(counts, w[None, :], 0.0)
    there = available > 0
    base = np.where(there, np.divide(total, available, out=np.zeros_like(total), where=there) * 100.0, 0.0)
    return np.maximum(base, np.where(there, floor[:, None], 0.0)), there


def summary(scored: DataFrame, scenarios: Scenarios | DataFrame) -> DataFrame:
    """scope, scenario, dates, mean, worst, days_high of the unrounded composite, from rows of
    ``score.with_scores`` without dated parameters.

    The weights come to the driver and go to every task, up to a checked number of scenarios; a larger
    table multiplies rows instead.
    """
    known = weight_matrix(scenarios)
    if known is None:
        rows = with_composite(with_weights(scored, scenarios))
        return rows.groupBy("scope", "scenario").agg(
            F.count("*").alias("dates"), F.avg("composite_raw").alias("mean"), F.max("composite_raw").alias("worst"),
            F.count_if(F.col("regime") == "high").alias("days_high"),
        )
    names, weight = known
    high = P.REGIME_HIGH

    def reduce(batches):
        held: dict = {}

        def passed_on():
            rows = [{"scope": s, "dates": n, "total": t.tobytes(), "worst": m.tobytes(), "high": h.tobytes()} for s, (n, t, m, h) in held.items()]
            held.clear()
            return pa.RecordBatch.from_pylist(rows, PARTIAL)

        step = max(1, CELLS // max(1, len(names)))
        for batch in batches:
            scopes = np.array(batch.column(0).to_pylist(), object)
            score = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(COMPONENTS))], 1)
            floor = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(scopes), step):
                part = slice(at, at + step)
                composite, there = composites(score[part], floor[part], weight)
                for scope in dict.fromkeys(scopes[part]):
                    mine = scopes[part] == scope
                    n, t, m, h = held.get(scope, (0, 0.0, -np.inf, 0))
                    own = composite[mine]
                    held[scope] = (n + len(own), t + own.sum(0), np.maximum(m, own.max(0)), h + (there[mine] & (own >= high)).sum(0))
                if len(held) * len(names) * 24 > HELD_BYTES:
                    yield passed_on()
        yield passed_on()

    def merge(table: pa.Table) -> pa.Table:
        vector = lambda c, kind: np.stack([np.frombuffer(b, kind) for b in table[c].to_pylist()])
        dates = sum(table["dates"].to_pylist())
        return pa.table(
            {
                "scope": pa.array([table["scope"][0].as_py()] * len(names), pa.string()), "scenario": names, "dates": np.full(len(names), dates),
                "mean": vector("total", float).sum(0) / dates, "worst": vector("worst", float).max(0), "days_high": vector("high", np.int64).sum(0),
            }
        )

    floors = ", ".join(f"if(rule_{r}, {f}D, 0.0D)" for r, f in P.RULE_FLOORS.items())
    rows = scored.selectExpr("scope", f"greatest({floors}) as floor", *[f"comp_{k}" for k in COMPONENTS])
    partial = rows.mapInArrow(reduce, "scope string, dates bigint, total binary, worst binary, high binary")
    return partial.groupBy("scope").applyInArrow(merge, SUMMARY)


PARTIAL = pa.schema([("scope", pa.string()), ("dates", pa.int64()), ("total", pa.binary()), ("worst", pa.binary()), ("high", pa.binary())])
