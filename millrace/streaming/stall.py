"""Stall warnings on a progress stream, also for a source that has gone silent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.progress import STALL_SECONDS

OUTPUT = "domain string, total_tokens long, last_gain double, warned_at double"
STATE = "total_tokens long, timer double, last_gain double"


def stall_warnings(
    log: DataFrame, seconds: int = STALL_SECONDS, watch_silence: bool = False
) -> DataFrame:
    """A warning each time ``seconds`` pass without a token gain; the timer then restarts.

    ``log`` is a stream of ``(domain, ts double, total_tokens long)``, one row per
    written batch, in time order from one micro-batch to the next.  The state is
    three numbers per domain.  A domain's rows of one micro-batch are put in time order
    together, however many Arrow batches they come in.
    ``watch_silence`` also warns, by processing time, when no row comes at all;
    such a warning carries the time of the last row plus ``seconds``.
    """

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        warnings = []
        if state.hasTimedOut:
            total, timer, gain = state.get
            timer += seconds
            state.update((total, timer, gain))
            warnings.append((key[0], total, gain, timer))
        else:
            total, timer, gain = state.get if state.exists else (None, None, None)
            rows = pd.concat(list(batches)).sort_values(["ts", "total_tokens"])
            ts, seen = rows["ts"].to_numpy(float), rows["total_tokens"].to_numpy("int64")
            changed = np.r_[total is None or seen[0] != total, seen[1:] != seen[:-1]]
            starts = np.unique(np.r_[0, np.flatnonzero(changed)])
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(ts)], strict=True):
                if changed[low]:
                    total, timer, gain = int(seen[low]), float(ts[low]), float(ts[low])
                while (at := low + int(np.searchsorted(ts[low:high] - timer, seconds, "right"))) < high:
                    timer = float(ts[at])
                    warnings.append((key[0], total, gain, timer))
            state.update((total, timer, gain))
        if watch_silence:
            state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame(warnings, columns=["domain", "total_tokens", "last_gain", "warned_at"])

    timeout = (
        GroupStateTimeout.ProcessingTimeTimeout if watch_silence else GroupStateTimeout.NoTimeout
    )
    return log.groupBy("domain").applyInPandasWithState(follow, OUTPUT, STATE, "append", timeout)
