"""Billing: enrichment joins (J1), cycle totals (A22), balance reconciliation
(J4), sequence drift (J5), pending scan (P14), known-state guard (P15).

Dimension joins carry no broadcast hint unless the dimension has a fixed
size: AQE broadcasts at runtime when a side is under
``spark.sql.autoBroadcastJoinThreshold`` and keeps a shuffle join otherwise,
so an account table that grows with the data never lands whole on every
executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money

# Reconciliation error text (the address follows).
NO_NATIVE_BALANCE = "No native balance found for "
# Billing-cycle states and legal transitions.
CYCLE_STATES = ("OPEN", "FINALIZING", "FINALIZED", "SETTLED")
CYCLE_TRANSITIONS = (("OPEN", "FINALIZING"), ("FINALIZING", "FINALIZED"), ("FINALIZED", "SETTLED"))


def enrich_records(records: DataFrame, accounts: DataFrame, nations: DataFrame | None = None) -> DataFrame:
    """Billing record -> account (and the account's nation, a fixed 25-row table)."""
    acc = accounts.select("account_id", "address", "c_custkey")
    out = records.join(acc, "account_id", "left")
    if nations is not None:
        out = out.join(nations, "c_nationkey", "left")
    return out


def store_bucketed(df: DataFrame, by: str, buckets: int, tag: str) -> DataFrame:
    """Store ``df`` as a table bucketed and sorted by ``by`` (one file per bucket) in the shared folder; equi-joins on ``by`` then need no shuffle.

    Null keys join nothing, so they are spread over the buckets under keys of their own (``_key``).
    """
    import uuid

    from ..session import checkpoint_root

    spark, name = df.sparkSession, f"gw_{tag}_{uuid.uuid4().hex}"
    own = F.concat(F.lit("\u0000"), F.xxhash64(*df.columns).cast("string"))
    out = df.withColumn("_key", F.coalesce(F.col(by).cast("string"), own)).repartition(buckets, "_key")
    out.write.bucketBy(buckets, "_key").sortBy("_key").option("path", f"{checkpoint_root(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def billing_links(records: DataFrame, devices: DataFrame, cycles: DataFrame, accounts: DataFrame, logs: DataFrame, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The foreign keys of the billing tables as joins; rows whose key points nowhere are kept.

    Returns records with their device, account, cycle and the cycle's account, and log entries with their cycle
    and its account. Records, cycles and log entries are stored bucketed by cycle, accounts and cycles by account, so the
    cycle joins and the account join of cycles read co-located buckets; only the cycles with their accounts, one row a
    cycle, and the small sides of the device and account links move.
    """
    buckets = buckets or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = accounts.select("account_id", F.col("address").alias("cycle_address"))
    owned = store_bucketed(cycles.select("cycle_id", F.col("account_id").alias("cycle_account_id"), F.col("state").alias("cycle_state")), "cycle_account_id", buckets, "cycles")
    owned = owned.join(store_bucketed(held, "account_id", buckets, "accounts").drop("account_id"), "_key", "left").drop("_key")
    owned = store_bucketed(owned, "cycle_id", buckets, "owned").drop("cycle_id")
    recs = store_bucketed(records, "cycle_id", buckets, "records").join(owned, "_key", "left")
    dev = devices.select("device_id", F.lit(True).alias("_device"))
    acc = accounts.select("account_id", F.col("address").alias("account_address"))
    recs = recs.join(dev, "device_id", "left").join(acc, "account_id", "left")
    recs = recs.select("record_id", "device_id", F.col("_device").isNotNull().alias("device_known"), "account_id", "account_address",
                       "cycle_id", "cycle_state", "cycle_account_id", "cycle_address")
    entries = store_bucketed(logs, "cycle_id", buckets, "logs").join(owned, "_key", "left")
    return recs, entries.select("log_id", "cycle_id", "cycle_state", "cycle_account_id", "cycle_address")


def cycle_totals(records: DataFrame) -> DataFrame:
    """Exact usage per billing cycle with a 64-bit overflow flag."""
    g = records.groupBy("cycle_id", "account_id").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(money.dec("usage_amount")).alias("total_exact"),
        F.min("time").alias("period_first"),
        F.max("time").alias("period_last"),
    )
    return g.select(
        "cycle_id", "account_id", "record_count", "period_first", "period_last",
        F.when(money.is_overflow("total_exact"), F.lit(None).cast("bigint"))
         .otherwise(F.col("total_exact").cast("bigint")).alias("total_usage"),
        money.is_overflow("total_exact").alias("overflow"),
    )


def native_balances(balances: DataFrame) -> DataFrame:
    """First ``native`` balance per address (by ``position``)."""
    w = Window.partitionBy("address").orderBy("position")
    return (balances.where(F.col("asset_type") == "native")
                    .withColumn("_rn", F.row_number().over(w))
                    .where(F.col("_rn") == 1)
                    .select("address", F.col("balance").alias("native_balance")))


def reconcile(accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Compare local balances with the ledger's native balance.

    ``discrepancy = local - onchain``; when non-zero the corrected local
    balance is the on-chain one. An address without a native balance gives
    an error row (``error`` set, balances NULL).
    """
    nb = native_balances(balances)
    j = accounts.select("account_id", "address", "local_balance").join(nb, "address", "left")
    onchain = money.decimal_string_to_units(F.col("native_balance"))
    disc = F.col("local_balance") - onchain
    return j.select(
        "account_id", "address",
        onchain.alias("onchain_balance"),
        disc.alias("discrepancy"),
        (disc != 0).alias("corrected"),
        F.when(onchain.isNull(), F.lit(None).cast("bigint"))
         .when(disc != 0, onchain).otherwise(F.col("local_balance")).alias("resulting_local_balance"),
        F.when(F.col("native_balance").isNull(), F.concat(F.lit(NO_NATIVE_BALANCE), F.col("address")))
         .alias("error"),
    )


def sequence_drift(local: DataFrame, ledger: DataFrame) -> DataFrame:
    """Adopt the ledger sequence when it is ahead or drift exceeds one."""
    j = local.join(ledger, "address")
    diff = F.col("local_seq") - F.col("ledger_seq")
    adopt = (F.col("ledger_seq") > F.col("local_seq")) | (F.abs(diff) > 1)
    return j.select("address", "local_seq", "ledger_seq", adopt.alias("adopted"),
                    F.when(adopt, F.col("ledger_seq")).otherwise(F.col("local_seq")).alias("synced_seq"))


def pending(records: DataFrame) -> DataFrame:
    """Records still pending settlement."""
    return records.where(F.col("status") == "pending")


def guard_known_state(df: DataFrame, state_col: str = "state", states=CYCLE_STATES,
                      mode: str = "raise") -> DataFrame:
    """An unknown stored state raises (``mode='raise'``) or is filtered out
    (``mode='quarantine'``; use ``unknown_states`` to keep the rejects)."""
    known = F.col(state_col).isin(*states)
    if mode == "raise":
        return df.withColumn(state_col, F.when(known, F.col(state_col)).otherwise(
            F.raise_error(F.concat(F.lit("Unknown billing cycle state: "), F.col(state_col).cast("string")))))
    return df.where(known)


def unknown_states(df: DataFrame, state_col: str = "state", states=CYCLE_STATES) -> DataFrame:
    return df.where(~F.col(state_col).isin(*states) | F.col(state_col).isNull())
