"""Per-key stream state (R4-R9) with ``applyInPandasWithState``.

``stream_fold`` runs the same step functions as the batch folds in
``operators.folds``: per micro-batch and bucket of keys, the stored states are loaded,
the new rows are sorted by the order columns and folded by key, and the
states are saved back to the state store (checkpointed, so a restarted query
resumes where it stopped). A bucket's states are one pickled Python value in a
``binary`` field; a key's is bounded by the fold (a timestamp, a counter, at
most ``window`` buffered sequence numbers). With ``expires`` the fold itself
says until when a state matters, and the store drops it when the watermark is
there. With ``timeout_ms`` the key's state expires in event time ``timeout_ms``
after its latest row; ``on_timeout`` may emit rows when that happens.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.folds import _with_fields

#: How long a closed connection is remembered, so that late chunks are still refused.
CLOSED_LINGER_MS = 3_600_000


#: Parts that the keys of a stream are dealt to; fixed for the life of a checkpoint.
BUCKETS = 1024
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def bucket_fold(df: DataFrame, keys, schema: T.StructType, fold, fired=None, timers: bool = True, buckets: int = BUCKETS) -> DataFrame:
    """State per key in the state store, in calls that each handle a bucket of keys.

    A call of ``applyInPandasWithState`` costs a millisecond or so whatever it does, so
    one per key makes a micro-batch as slow as it has keys. Here keys are dealt to ``buckets``
    by hash; the store holds one value per bucket that has a living key, ``{key: (state, due)}``.

    ``fold(pdf, held, watermark)`` gets a bucket's new rows (``_gw_key`` is their key), changes ``held``
    and returns a frame. A key whose ``due`` (ms) the watermark has passed, and that has no new row, is
    taken from ``held`` and given to ``fired(key, state)``, which returns a list of frames and what to
    hold instead, ``(state, due)`` or None. A bucket's timer is that of its earliest key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    columns = df.columns
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, _WHOLE) and f.nullable]
    plain = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.StringType)
    key = F.col(f"`{keys[0]}`") if plain else F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]))
    # pandas has no nulls in whole numbers: they travel as zeros with a mark, so the other keys' numbers stay as they are
    shipped = df.select(F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(buckets)).alias("_gw_bucket"), key.alias("_gw_key"),
                        *[F.coalesce(F.col(f"`{c}`"), F.lit(0).cast(df.schema[c].dataType)).alias(c) if c in whole else F.col(f"`{c}`") for c in columns],
                        *[F.col(f"`{c}`").isNull().alias(f"_gw_null_{c}") for c in whole])
    state_schema = T.StructType([T.StructField("blob", T.BinaryType(), True)])

    def func(_, pdfs, state):
        held = pickle.loads(state.get[0]) if state.exists else {}
        watermark = state.getCurrentWatermarkMs() if timers else None
        found, met = [], set()
        parts = [] if state.hasTimedOut else [p for p in pdfs if len(p)]
        if parts:
            pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            for c in whole:
                if pdf[f"_gw_null_{c}"].any():
                    pdf[c] = pdf[c].astype("Int64").mask(pdf[f"_gw_null_{c}"].astype(bool))
            met.update(pdf["_gw_key"].tolist())
            found.append(fold(pdf, held, watermark))
        if timers:
            for k in [k for k, (_, due) in held.items() if due is not None and due < watermark and k not in met]:
                st, _ = held.pop(k)
                if fired is not None:
                    frames, left = fired(k, st)
                    found += frames
                    if left is not None:
                        held[k] = left
        if held:
            state.update((pickle.dumps(held),))
            due = min((d for _, d in held.values() if d is not None), default=None)
            if due is not None:
                state.setTimeoutTimestamp(max(int(due), watermark))
        elif state.exists:
            state.remove()
        for f in found:
            if f is not None and len(f):
                yield f

    return shipped.groupBy("_gw_bucket").applyInPandasWithState(func, schema, state_schema, "append", "EventTimeTimeout" if timers else "NoTimeout")


def values_of(pdf: pd.DataFrame, column: str) -> list:
    """A column's values; a key with a null among its whole numbers has floats, as in a frame of its own."""
    s = pdf[column]
    if s.dtype != "Int64":
        return s.tolist()
    ids = pdf["_gw_key"].tolist()
    odd = {k for k, null in zip(ids, s.isna()) if null}
    return [v if k not in odd else float("nan") if v is pd.NA else float(v) for k, v in zip(ids, s.tolist())]


def stream_fold(df: DataFrame, keys, order: list[str], spec, timeout_ms: int | None = None,
                event_time_ms: str | None = None, on_timeout=None, expires=None, buckets: int = BUCKETS) -> DataFrame:
    """Fold ``spec = (inputs, out_fields, start, step)`` over a streaming DataFrame per key.

    ``expires(state)`` gives the event time (ms) from which a state says no more
    than a fresh one, or None if it says nothing already; the state store then
    holds a key only until the watermark passes that time, so it is bounded by the
    keys alive, not by all keys ever seen. The input needs a watermark; rows
    are sorted within a micro-batch and bucket of keys (:func:`bucket_fold`), whose rows are in memory together.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    inputs, out_fields, start, step = spec
    schema = _with_fields(df.schema, *out_fields)
    names = [n for n, _ in out_fields]
    columns = df.columns

    def fold(pdf, held, watermark):
        pdf = pdf.sort_values(order, kind="mergesort").reset_index(drop=True)
        ids = pdf["_gw_key"].tolist()
        states = {k: held[k][0][0] if k in held else start() for k in dict.fromkeys(ids)}
        cols = [values_of(pdf, c) for c in inputs]
        res = [[None] * len(pdf) for _ in names]
        for i, k in enumerate(ids):
            states[k], outs = step(states[k], *[c[i] for c in cols])
            for j, v in enumerate(outs):
                res[j][i] = v
        latest = {}
        for k, t in zip(ids, values_of(pdf, event_time_ms)) if timeout_ms is not None else ():
            latest[k] = max(t, latest.get(k, t))
        named = dict(zip(ids, zip(*[values_of(pdf, k) for k in keys]))) if on_timeout is not None else {}
        for k, st in states.items():
            due = None
            if expires is not None:
                due = expires(st)
                if due is None or due <= watermark:
                    held.pop(k, None)
                    continue
            elif timeout_ms is not None:
                due = max(int(latest[k]) + timeout_ms, watermark + 1)
            held[k] = ((st, named.get(k)), due if due is None else int(due))
        for n, r in zip(names, res):
            pdf[n] = pd.Series(r, dtype=object)
        return pdf[columns + names]

    def fired(_, value):
        rows = on_timeout(value[1], value[0]) if on_timeout is not None else None
        return [] if rows is None else [rows], None

    return bucket_fold(df, keys, schema, fold, fired, timeout_ms is not None or expires is not None, buckets)


def _keep_until(state, value, due: int | None) -> None:
    """Store ``value`` with a timer at ``due``, or drop it if the watermark is there already."""
    if due is None or due <= state.getCurrentWatermarkMs():
        if state.exists:
            state.remove()
        return
    state.update((pickle.dumps(value),))
    state.setTimeoutTimestamp(int(due))


def dedup_within_watermark(df: DataFrame, key: str = "nonce", time_col: str = "time",
                           delay: str = "5 seconds") -> DataFrame:
    """R4 (fast form): keep the first claim per nonce while it is inside the
    watermark delay. Expiry follows the watermark rather than each claim's own
    5 s, so a nonce may be rejected slightly longer than the exact guard."""
    return df.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([key])


def event_time(df: DataFrame, ms_col: str, out: str = "event_time") -> DataFrame:
    """A ``timestamp`` column from epoch milliseconds (watermarks need ``timestamp``)."""
    return df.withColumn(out, F.timestamp_millis(F.col(ms_col)))


def stream_reassemble(df: DataFrame, conn: str = "connection_id", time_ms: str = "time_ms", chunk: str = "chunk",
                      timeout_ms: int | None = None, position: str | None = None, linger_ms: int = CLOSED_LINGER_MS) -> DataFrame:
    """Fragment reassembly per connection over a stream.

    The partial buffer, timer and closed flag live in the state store (the
    buffer is bounded by the 64 KiB limit). With ``timeout_ms`` (and a
    watermark on the input) an idle partial message is cleared when the
    watermark passes its deadline, which emits ``partial_message_timeout`` at the
    position after the chunk that left it, as the next chunk would. ``position`` names a
    column that numbers a connection's chunks from 0; a connection is then in
    the store only while a message is incomplete, or ``linger_ms`` after it was
    closed. Without it the store keeps one counter per connection.
    """
    from ..operators.folds import MESSAGE_TIMEOUT_MS, REASSEMBLY_OUT, reassembly_spec
    start, step = reassembly_spec(timeout_ms=timeout_ms or MESSAGE_TIMEOUT_MS)
    out_schema = T._parse_datatype_string(REASSEMBLY_OUT)
    state_schema = T.StructType([T.StructField("blob", T.BinaryType(), True)])
    cols = ["connection_id", "event_pos", "kind", "payload", "buffer_bytes"]

    def due(st):
        """Time of the connection's timer, if any: its message's deadline or the end of its closed mark."""
        if st["closed"]:
            return st["last"] + linger_ms
        return st["armed"] + timeout_ms if st["armed"] is not None else None

    def store(state, st):
        if timeout_ms is None:
            state.update((pickle.dumps(st),))
        elif position is not None:
            _keep_until(state, st, due(st))
        else:
            state.update((pickle.dumps(st),))
            if due(st) is not None:
                state.setTimeoutTimestamp(max(due(st), state.getCurrentWatermarkMs() + 1))

    def func(key, pdfs, state):
        cid = key[0]
        st = pickle.loads(state.get[0]) if state.exists else start()
        if state.hasTimedOut:
            left, st["buf"], st["armed"] = len(st["buf"]), b"", None
            if position is not None or st["closed"]:
                state.remove()
            else:
                state.update((pickle.dumps(st),))
            if left:
                yield pd.DataFrame([(cid, st["pos"] + 1, "partial_message_timeout", None, left)], columns=cols)
            return
        by = [position] if position is not None else [time_ms]
        pdf = pd.concat([p for p in pdfs], ignore_index=True).sort_values(by, kind="mergesort")
        out = []
        places = pdf[position].tolist() if position is not None else [None] * len(pdf)
        for now, data, place in zip(pdf[time_ms].tolist(), pdf[chunk].tolist(), places):
            if place is not None:
                st["pos"] = int(place) - 1
            st, events = step(st, now, data)
            st["last"] = int(now)
            out.extend((cid, st["pos"], kind, payload, size) for kind, payload, size in events)
        store(state, st)
        if out:
            yield pd.DataFrame(out, columns=cols).astype({"event_pos": "int64", "buffer_bytes": "Int64"})

    timeout = "EventTimeTimeout" if timeout_ms is not None else "NoTimeout"
    return df.groupBy(conn).applyInPandasWithState(func, out_schema, state_schema, "append", timeout)
