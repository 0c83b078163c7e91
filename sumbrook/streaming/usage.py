"""Token accounting over a stream: an account's sums are kept as state until a reset tells them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "segment long, calls long, input_tokens long, output_tokens long"


def _told(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    segment, calls, read, wrote = state.get if state.exists else (0, 0, 0, 0)
    rows = pd.concat(list(parts)).sort_values(["time", "number"], kind="stable")
    out = []
    for reset, n_in, n_out in zip(rows.reset, rows.input_tokens, rows.output_tokens, strict=True):
        if reset:
            out.append((key[0], segment, calls, read, wrote, read + wrote))
            segment, calls, read, wrote = segment + 1, 0, 0, 0
        else:
            calls, read, wrote = calls + 1, read + int(n_in), wrote + int(n_out)
    state.update((segment, calls, read, wrote))
    yield pd.DataFrame(out, columns=["account", "segment", "calls", "input_tokens", "output_tokens", "total_tokens"])


def spent_at_resets(stream: DataFrame, account: str, time: str, number: str, reset: Column, input_tokens: Column, output_tokens: Column) -> DataFrame:
    """account (text), segment, calls, input_tokens, output_tokens, total_tokens of each segment, once its reset has come.

    Rows of one trigger are put in order of time, then number; a row that comes in a later trigger counts from there on, as a counter that is read does.
    State is four numbers an account. Null tokens count as none.
    """
    rows = stream.select(
        F.col(account).cast("string").alias("account"), F.col(time).alias("time"), F.col(number).cast("long").alias("number"), F.coalesce(reset, F.lit(False)).alias("reset"),
        F.coalesce(input_tokens.cast("long"), F.lit(0)).alias("input_tokens"), F.coalesce(output_tokens.cast("long"), F.lit(0)).alias("output_tokens"),
    )
    return rows.groupBy("account").applyInPandasWithState(_told, "account string, segment long, calls long, input_tokens long, output_tokens long, total_tokens long", _STATE, "append", GroupStateTimeout.NoTimeout)
