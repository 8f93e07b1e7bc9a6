"""Import counts kept by session: which assistant texts of a stream of transcript items are new.

Transcripts come again and again, whole or their new items alone. A session's state
is one value, how far its items were taken in; it is forgotten after a time without
any, and a session that comes back later is imported from its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Milliseconds after which a silent session is forgotten.
TTL = 30 * 24 * 3600 * 1000
_OUT = "session_id string, project string, harness string, kind string, content string, created_at long"


def _imported(project: str, ttl: int):
    def new(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        upto, n = state.get if state.exists else (-1, 0)
        most, seen = upto, set()
        for items in rows:
            items = items[items["index"] > upto]
            if len(items):
                most = max(most, int(items["index"].max()))
            said = items[(items["role"] == "assistant") & (items["kind"] == "text")]
            # A batch may hold a transcript more than once.
            said = said[~said["index"].isin(seen)].drop_duplicates("index")
            seen.update(said["index"].tolist())
            if len(said):
                stamp = said["timestamp"].fillna(0).astype("int64")
                yield pd.DataFrame({"session_id": key[0], "project": project, "harness": said["harness"], "kind": "assistant", "content": said["text_full"], "created_at": stamp})
        state.update((most, n + len(seen)))
        state.setTimeoutDuration(ttl)

    return new


def import_stream(items: DataFrame, project: str = "", ttl: int = TTL) -> DataFrame:
    """The events that import_items() gives, each once, of a stream of items (session, harness, index, role, kind, text_full, timestamp).

    A session's items come in order of index, from one batch to the next; in a
    batch they may come in any order and more than once, and a batch may repeat
    earlier ones. Nulls among the stamps are 0. A trigger that ends by itself isn't
    for this stream: silent sessions are looked for as long as it runs.
    """
    narrow = items.select("session", "harness", "index", "role", "kind", "text_full", "timestamp")
    return narrow.groupBy("session").applyInPandasWithState(_imported(project, ttl), _OUT, "upto long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)
