"""GAP_DETECTED resync timer.

Per entity the ingestion state machine is replayed over the transition
stream. Entering GAP_DETECTED arms an event-time timer 60 s later; leaving
the state disarms it; when the watermark passes the timer, a resync request
row is emitted instead of the reference's HTTP call.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.validation import TRANSITIONS
from .stateful import bucket_fold, values_of

# Fixed value: resync timeout.
AUTO_RESYNC_TIMEOUT_MS = 60000
_LEGAL = {(a, b) for a, b in TRANSITIONS["ingestion"]}

OUT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("kind", T.StringType()),
                    T.StructField("state", T.StringType()), T.StructField("at_ms", T.LongType())])


def resync_requests(transitions: DataFrame, entity: str = "entity", to: str = "to_state", time_ms: str = "time_ms",
                    timeout_ms: int = AUTO_RESYNC_TIMEOUT_MS, order: list[str] | None = None) -> DataFrame:
    """``transitions`` needs a watermark on an event-time column. Emits one
    ``transition`` row per applied request and one ``resync_request`` row when
    an entity stays in GAP_DETECTED for ``timeout_ms``, whether the watermark passes the
    timer first or a later request shows it; the entity keeps its state.
    ``order`` tells requests of equal time apart."""

    def fold(pdf, held, watermark):
        pdf = pdf.sort_values(order or [time_ms], kind="mergesort").reset_index(drop=True)
        states, rows = {}, []
        for key, ent, t, nxt in zip(pdf["_gw_key"].tolist(), values_of(pdf, entity), values_of(pdf, time_ms), pdf[to].tolist()):
            if key not in states:
                states[key] = held[key][0] if key in held else (ent, "PENDING", None)
            ent, cur, since = states[key]
            if since is not None and t - since >= timeout_ms:  # due before this request: fired once, the entity stays where it is
                rows.append((ent, "resync_request", cur, since + timeout_ms))
                since = None
            if (cur, nxt) in _LEGAL:
                cur = nxt
                since = int(t) if cur == "GAP_DETECTED" else None
                rows.append((ent, "transition", cur, int(t)))
            states[key] = ent, cur, since
        for key, (ent, cur, since) in states.items():
            held[key] = (ent, cur, since), None if since is None else max(since + timeout_ms, watermark + 1)
        return pd.DataFrame(rows, columns=OUT.names) if rows else None

    def fired(key, value):
        ent, cur, since = value
        return [pd.DataFrame([(ent, "resync_request", cur, since + timeout_ms)], columns=OUT.names)], ((ent, cur, None), None)

    return bucket_fold(transitions, entity, OUT, fold, fired)
