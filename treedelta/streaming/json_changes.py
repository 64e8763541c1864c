"""Changes of a JSON column per key over a stream: each event is compared with the key's last one.

The last JSON of a key is its state.  Rows of a key are taken in the order of time, then id, within a
micro-batch; a row older than the key's last one is late and is dropped, as a watermark would.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, path string, from_value string, to_value string"
_STATE = "ts timestamp, event_id long, props string"


def changed_leaves(old: str | None, new: str | None) -> list[tuple[str, str | None, str | None]]:
    """(path, from, to) of scalar leaves that differ; nothing for invalid or equal JSON."""

    def leaves(text: str | None) -> dict[str, str]:
        try:
            work, out = [("", json.loads(text or "{}"))], {}
        except ValueError:
            return {}
        while work:
            path, value = work.pop()
            if isinstance(value, dict):
                work += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
            elif isinstance(value, list):
                work += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
            else:
                out[path] = value if isinstance(value, str) else json.dumps(value)
        return out

    a, b = leaves(old), leaves(new)
    return [(p, a.get(p), b.get(p)) for p in sorted(a.keys() | b.keys()) if a.get(p) != b.get(p)]


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    ts, last_id, props = state.get if state.exists else (None, None, None)
    out = []
    for r in rows.itertuples():
        if ts is not None and (r.ts, r.event_id) < (ts, last_id):
            continue
        if ts is not None:
            out += [(key[0], r.event_id, *change) for change in changed_leaves(props, r.props)]
        ts, last_id, props = r.ts, r.event_id, r.props
    if ts is not None:
        state.update((ts.to_pydatetime() if hasattr(ts, "to_pydatetime") else ts, int(last_id), props))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "path", "from_value", "to_value"])


def stream_json_changes(events: DataFrame) -> DataFrame:
    """The changes of props per user_id; events has event_id, ts, user_id and props, and may be a stream or a table."""
    rows = events.select("event_id", "ts", "user_id", "props")
    return rows.groupBy("user_id").applyInPandasWithState(_step, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
