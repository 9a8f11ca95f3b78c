"""A bounded memory of keys: what was seen lately is not shown again.

Each viewer remembers its keys in the order in which they came.  A key that is remembered is left out, and does not become
younger by that.  Once there are more than `cap`, the oldest are forgotten down to `keep`; a forgotten key counts as new.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAP, KEEP = 5000, 4000


def unseen(rows: DataFrame, viewer: str, key: str, order: list[str], cap: int = CAP, keep: int = KEEP) -> DataFrame:
    """The rows of a stream whose key its viewer does not remember, in the order of `order` within a micro-batch.

    State is at most `cap` keys of a viewer, in the checkpoint; a null key is a key like others.
    """
    columns = rows.columns
    at = columns.index(viewer)

    def work(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict.fromkeys(state.get[0] if state.exists else ())
        # a viewer's rows of one micro-batch, bounded by what the source admits
        batch = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        shown = []
        for i, k in zip(batch.index, batch[key].map(lambda x: None if pd.isna(x) else str(x)), strict=True):
            if k in known:
                continue
            known[k] = None
            shown.append(i)
            if len(known) > cap:
                for old in list(known)[: len(known) - keep]:
                    del known[old]
        state.update((list(known),))
        out = batch.loc[shown, columns].reset_index(drop=True)
        out.iloc[:, at] = group[0] if len(out) else out.iloc[:, at]
        yield out

    return rows.groupBy(viewer).applyInPandasWithState(work, rows.schema, "keys array<string>", "append", GroupStateTimeout.NoTimeout)
