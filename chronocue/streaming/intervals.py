"""Continuous periods and gaps of entities as their intervals arrive.

The state of an (entity, slab) is its interval map, so a hot entity's state is
as many bounded pieces as it has slabs. Each batch emits the slab's periods
anew; ``merged`` over the newest of each slab gives periods and gaps across
slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.intervals import SLAB, IntervalMap, clean

STATE = "starts array<bigint>, ends array<bigint>, version bigint"


def slab_periods(rows: DataFrame, entity: str, start: str, end: str, slab: int = SLAB) -> DataFrame:
    """entity, slab, version, a, b, gap_before: of each slab that a batch touched all periods that begin in it; the greatest version is the newest. gap_before is the gap's length within the slab, null at its first period."""
    kind = dict(rows.dtypes)[entity]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, version = state.get if state.exists else ([], [], 0)
        m = IntervalMap(list(starts), list(ends))
        for p in batches:
            for a, b in zip(p["a"].tolist(), p["b"].tolist()):
                m.insert(a, b)
        state.update((m.starts, m.ends, version + 1))
        gaps = [None] + [b - a for a, b in m.gaps()]
        yield pd.DataFrame({"entity": key[0], "slab": key[1], "version": version + 1, "a": m.starts, "b": m.ends, "gap_before": pd.Series(gaps, dtype="Int64")})

    return clean(rows, entity, start, end, slab).groupBy("entity", "slab").applyInPandasWithState(
        update, f"entity {kind}, slab bigint, version bigint, a bigint, b bigint, gap_before bigint", STATE, "append", GroupStateTimeout.NoTimeout,
    )


def newest(emitted: DataFrame) -> DataFrame:
    """entity, slab, a, b of the greatest version of each slab."""
    from pyspark.sql import functions as F

    top = emitted.groupBy("entity", "slab").agg(F.max("version").alias("version"))
    return emitted.join(top, ["entity", "slab", "version"]).select("entity", "slab", "a", "b")
