"""Guards with expiry in a stream: one keyed state per user, dropped when the user's time to live has passed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT = "user_id string, grp string, seq long, guard long, write_ts timestamp, life timestamp, accepted boolean"


def mark_lives_stream(rows: DataFrame, ttl_seconds: int, watermark: str = "2 minutes") -> DataFrame:
    """The rows' keys with ``life`` and ``accepted``, as ``operators.expiry.mark_lives`` has them.

    The state of a user is the life's begin, the last applied write, and the guards of the groups; the watermark drops
    it once the time to live has passed. Rows that come behind the watermark are dropped.
    """

    def judge(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        life, last, groups, guards = state.get if state.exists else (None, None, [], [])
        held = dict(zip(groups, guards))
        batch = pd.concat(list(frames)).sort_values(["write_ts", "seq"], kind="stable")
        out = []
        for grp, seq, guard, now in zip(batch["grp"], batch["seq"], batch["guard"], batch["write_ts"]):
            micros = now.value // 1000
            if last is None or last + ttl_seconds * 1_000_000 <= micros:
                life, held = micros, {}
            accepted = grp not in held or held[grp] <= guard
            if accepted:
                held[grp], last = int(guard), max(last or micros, micros)
            out.append((key[0], grp, seq, guard, now, pd.Timestamp(life, unit="us"), accepted))
        state.update((life, last, list(held), list(held.values())))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    timed = rows.where("guard is not null and write_ts is not null").withWatermark("write_ts", watermark)
    return timed.groupBy("user_id").applyInPandasWithState(
        judge, OUT, "life long, last long, groups array<string>, guards array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )
