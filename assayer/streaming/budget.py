"""Running spend over a stream of calls. An extension: the batch form is operators.ledger.running_budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import HARD_STOP, TARGET


def running_budget(costs: DataFrame, key: str = "ledger", target: float = TARGET, hard_stop: float = HARD_STOP) -> DataFrame:
    """costs: key, seq, cost (a stream). key, seq, cost, spent, remaining, exceeded; the spend of each
    key is kept as state, and calls of one batch are taken by seq."""

    def add(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        before = state.get[0] if state.exists else 0.0
        spent = before + rows["cost"].cumsum()
        state.update((float(spent.iloc[-1]),))
        yield pd.DataFrame({key: k[0], "seq": rows["seq"], "cost": rows["cost"], "spent": spent, "remaining": (target - spent).clip(lower=0.0), "exceeded": spent >= hard_stop})

    kind = costs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, seq long, cost double, spent double, remaining double, exceeded boolean"
    return costs.select(key, "seq", "cost").groupBy(key).applyInPandasWithState(add, schema, "spent double", "append", GroupStateTimeout.NoTimeout)
