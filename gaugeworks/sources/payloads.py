"""Signed-payload JSON source (S5) and payload verdicts.

Bodies arrive as JSON text, either an envelope ``{"payload": {...},
"publicKey": "..."}`` or a flat payload. They are parsed once into a
VARIANT, which keeps JSON types, so "``deviceId`` must be a string" is a
type test on the parsed value rather than a string coercion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import validation as V

PAYLOAD_FIELDS = ("deviceId", "nonce", "signature", "timestamp")


def _type_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _is_string(v: Column, path: str) -> Column:
    return F.coalesce(_type_of(v, path) == F.lit("STRING"), F.lit(False))


def _is_number(v: Column, path: str) -> Column:
    t = _type_of(v, path)
    return F.coalesce(t.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | t.startswith("DECIMAL"),
                      F.lit(False))


def parse_bodies(bodies: DataFrame, text: str = "body") -> DataFrame:
    """Flatten envelope or flat bodies into payload columns plus
    ``malformed`` (typed fields missing; the flat branch does not check
    ``timestamp``) and ``public_key`` (NULL when absent or not a string)."""
    # Parse once into a column; every field test below reads the parsed value.
    bodies = bodies.withColumn("_v", F.try_parse_json(F.col(text)))
    v = F.col("_v")
    bodies = bodies.withColumn("_p", F.when(F.variant_get(v, "$.payload", "variant").isNotNull(),
                                            F.variant_get(v, "$.payload", "variant")).otherwise(v))
    enveloped = F.coalesce(_type_of(v, "$.payload").startswith("OBJECT"), F.lit(False))
    has_payload_key = F.variant_get(v, "$.payload", "variant").isNotNull()
    p = F.col("_p")
    typed = _is_string(p, "$.deviceId") & _is_string(p, "$.nonce") & _is_string(p, "$.signature")
    malformed = (v.isNull()
                 | (has_payload_key & ~(enveloped & typed & _is_number(p, "$.timestamp")))
                 | (~has_payload_key & ~typed))
    return bodies.select(
        "*",
        malformed.alias("malformed"),
        F.variant_get(p, "$.deviceId", "string").alias("device_id"),
        F.variant_get(p, "$.nonce", "string").alias("nonce"),
        F.variant_get(p, "$.signature", "string").alias("signature"),
        F.try_variant_get(p, "$.timestamp", "bigint").alias("ts_ms"),
        F.when(_is_string(v, "$.publicKey"), F.variant_get(v, "$.publicKey", "string")).alias("public_key"),
    ).drop("_v", "_p")


def payload_verdicts(parsed: DataFrame, received_ms: str = "received_ms", signature_ok: str = "signature_ok",
                     window_ms: int = V.NONCE_WINDOW_MS, replay_window_ms: int | None = None) -> DataFrame:
    """Ordered verdict; the nonce is claimed only by payloads that pass
    every other check (replay guard W1 over those rows, keyed by nonce).
    Returns ``(event_id, nonce, received_ms, replay, verdict)``.

    ``window_ms`` is the freshness window and, without ``replay_window_ms``, the
    replay window too. Bodies are judged once, into a narrow checkpointed table; only
    eligible rows, which all have a nonce, are folded.
    """
    from ..operators.folds import replay_guard
    pre = V.verdict(F.col("malformed"), F.col("public_key"), F.col("signature"), F.col("ts_ms"),
                    F.col(received_ms), F.col(signature_ok), window_ms=window_ms)
    judged = parsed.select("event_id", "nonce", received_ms, pre.alias("verdict")).checkpoint()
    claims = replay_guard(judged.where(F.col("verdict") == V.VALID), "nonce", received_ms, [received_ms, "event_id"], replay_window_ms or window_ms)
    claims = claims.withColumn("verdict", F.when(F.col("replay"), F.lit(V.REASON_REPLAY)).otherwise(F.lit(V.VALID)))
    rest = judged.where(F.col("verdict") != V.VALID).withColumn("replay", F.lit(False))
    cols = ["event_id", "nonce", received_ms, "replay", "verdict"]
    return claims.select(*cols).unionByName(rest.select(*cols))
