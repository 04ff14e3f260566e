"""An isolation forest of our own: fitted on a bounded sample on the driver, scored by a vectorised function.

A forest of 100 trees over 256 rows each is small whatever the table's size, so fitting is no distributed problem; the
sample is (at most `cap` rows, by a seeded hash, so the same rows on every run). Scoring is: every row falls through
all trees in numpy, batch by batch, and the forest travels once per executor. Scores grow with strangeness, in (0, 1).
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import FEATURES

#: Heavy-tailed inputs, on a log scale. Fixed values.
LOGGED = ("n_in", "n_out", "value_out_sat", "fee_sat", "vsize", "fee_rate_sat_vb", "max_equal_output_count")
INPUTS = (*LOGGED, "round_amount_fraction", "rbf_signaled")
assert {*INPUTS} == {*FEATURES}
CAP = 50_000


def vector(prefix: str = "") -> Column:
    """The inputs as ARRAY<DOUBLE>; null if any is null (such rows are neither fitted nor scored, never filled in)."""
    parts = [F.log1p(F.col(f"{prefix}{n}").cast("double")) for n in LOGGED]
    parts += [F.col(f"{prefix}round_amount_fraction").cast("double"), F.col(f"{prefix}rbf_signaled").cast("int").cast("double")]
    usable = None
    for n in INPUTS:
        here = F.col(f"{prefix}{n}").isNotNull()
        usable = here if usable is None else usable & here
    return F.when(usable & (F.least(*[F.col(f"{prefix}{n}").cast("double") for n in LOGGED]) > -1), F.array(*parts))


def path_average(n: int) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n: what a leaf of n rows adds."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, left, right, and at leaves the depth they stand for."""

    trees: list[dict]
    sample_size: int
    seed: int

    def scores(self, matrix):
        import numpy as np

        total = np.zeros(len(matrix))
        for tree in self.trees:
            feature, cut, left, right, depth = (np.asarray(tree[k]) for k in ("feature", "cut", "left", "right", "depth"))
            node = np.zeros(len(matrix), dtype=np.int64)
            rows = np.arange(len(matrix))
            while len(rows):
                at = node[rows]
                inner = feature[at] >= 0
                rows, at = rows[inner], at[inner]
                goes_left = matrix[rows, feature[at]] <= cut[at]
                node[rows] = np.where(goes_left, left[at], right[at])
            total += depth[node]
        return 2.0 ** (-(total / len(self.trees)) / max(path_average(self.sample_size), 1e-12))

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees, "sample_size": self.sample_size, "seed": self.seed}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Forest":
        return cls(**json.loads(text))

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def grow(matrix, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest:
    """Random cuts of random columns, to the depth at which a mean search ends. The same data and seed give the same forest."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = min(sample, len(matrix))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    made = []
    for _ in range(trees):
        rows = matrix[rng.choice(len(matrix), size, replace=False)]
        tree: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "depth")}
        todo = [(rows, 0, -1, "")]
        while todo:
            part, depth, parent, side = todo.pop()
            here = len(tree["feature"])
            if parent >= 0:
                tree[side][parent] = here
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            leaf = depth >= limit or len(part) <= 1 or not len(open_)
            f = -1 if leaf else int(rng.choice(open_))
            cut = 0.0 if leaf else float(rng.uniform(low[f], high[f]))
            for k, x in (("feature", f), ("cut", cut), ("left", -1), ("right", -1), ("depth", depth + path_average(len(part)) if leaf else 0.0)):
                tree[k].append(x)
            if not leaf:
                goes = part[:, f] <= cut
                todo += [(part[~goes], depth + 1, here, "right"), (part[goes], depth + 1, here, "left")]
        made.append(tree)
    return Forest(made, size, seed)


def sample(df: DataFrame, cap: int = CAP, seed: int = 7, key: str = "txid") -> DataFrame:
    """At most cap rows, the least by a seeded hash of the key (and of the row, for repeated keys)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(cap)


def fit(df: DataFrame, trees: int = 100, size: int = 256, seed: int = 7, cap: int = CAP, key: str = "txid", least: int = 100) -> Forest:
    """The driver gets at most cap rows of nine numbers."""
    import numpy as np

    rows = sample(df.withColumn("__v", vector()).where("__v is not null").select(key, "__v"), cap, seed, key).toPandas()
    if len(rows) < least:
        raise ValueError(f"only {len(rows)} usable rows; {least} are needed")
    return grow(np.vstack(rows.sort_values(key, kind="stable")["__v"].to_numpy()), trees, size, seed)


def score(df: DataFrame, forest: Forest, into: str = "score") -> DataFrame:
    """df with its score; null for rows with a null input."""
    import pandas as pd

    shared = df.sparkSession.sparkContext.broadcast(forest.to_json())  # of fixed size: trees times sample

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        f = Forest.from_json(shared.value)
        for v in batches:
            known = v.notna().to_numpy()
            out = pd.Series([None] * len(v), dtype="float64")
            if known.any():
                out[known] = f.scores(np.vstack(v[known].to_numpy()))
            yield out

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(into, F.pandas_udf(run, "double")(vector()))
