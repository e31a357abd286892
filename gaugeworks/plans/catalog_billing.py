"""Queries: billing records, cycles, reconciliation and exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import money
from ..operators import billing
from ..sources import tables
from .oracle_views import with_views
from .registry import register


@register("billing_scan", with_views("billing_records") + """SELECT time, device_id, account_id, usage_amount,
       CAST(NULL AS VARCHAR) AS tx_hash, COALESCE(status, 'pending') AS status, cycle_id
FROM billing_records""")
def billing_scan(spark, sf_dir):
    """The billing record table."""
    r = tables.billing_records(spark, sf_dir)
    return r.select("time", "device_id", "account_id", "usage_amount",
                    F.lit(None).cast("string").alias("tx_hash"),
                    F.coalesce("status", F.lit("pending")).alias("status"), "cycle_id")


@register("billing_pending", with_views("billing_records") + """SELECT record_id, time, account_id, usage_amount
FROM billing_records WHERE status = 'pending'""")
def billing_pending(spark, sf_dir):
    """Pending records."""
    return billing.pending(tables.billing_records(spark, sf_dir)).select("record_id", "time", "account_id", "usage_amount")


@register("billing_enriched", with_views("billing_records", "accounts") + """SELECT r.record_id, r.account_id, r.device_id, r.cycle_id, r.usage_amount, a.address, n.n_name
FROM billing_records r
LEFT JOIN accounts a ON r.account_id = a.account_id
LEFT JOIN customer c ON a.c_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""", bench=True)
def billing_enriched(spark, sf_dir):
    """Record -> account -> nation."""
    recs = tables.billing_records(spark, sf_dir)
    acc = tables.accounts(spark, sf_dir)
    nations = tables.read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name")
    acc = acc.join(nations, "c_nationkey", "left")
    return (recs.join(acc.select("account_id", "address", "n_name"), "account_id", "left")
                .select("record_id", "account_id", "device_id", "cycle_id", "usage_amount", "address", "n_name"))


_LINKS_SQL = """
devices AS (SELECT DISTINCT 'dev-' || CAST(c_custkey % 150 AS VARCHAR) AS device_id FROM customer WHERE c_custkey % 150 % 37 <> 0),
recs AS (SELECT record_id, device_id, account_id, CASE WHEN record_id % 19 <> 0 THEN cycle_id END AS cycle_id, time,
                CAST(replace(account_id, 'acct-', '') AS BIGINT) AS n FROM billing_records),
every AS (SELECT DISTINCT account_id || ':' || strftime(time, '%Y-%m') AS cycle_id, account_id, n, month(time) AS m FROM recs),
cycles AS (SELECT cycle_id, CASE WHEN n % 23 = 0 THEN 'closed-' || CAST(n AS VARCHAR) ELSE account_id END AS account_id,
                  CASE WHEN n % 3 = 0 THEN 'FINALIZED' ELSE 'OPEN' END AS state FROM every WHERE NOT (m = 2 AND n % 5 = 0)),
logs AS (SELECT 'fin-' || cycle_id AS log_id, cycle_id FROM every WHERE n % 3 = 0),
owned AS (SELECT c.cycle_id, c.state AS cycle_state, c.account_id AS cycle_account_id, a.address AS cycle_address FROM cycles c LEFT JOIN accounts a USING (account_id))"""


def _links(spark, sf_dir):
    """Billing tables with keys that point nowhere: missing devices and cycles, cycles of closed accounts, records without a cycle."""
    r = tables.billing_records(spark, sf_dir).withColumn("n", F.regexp_replace("account_id", "acct-", "").cast("bigint"))
    number = F.col("c_custkey") % 150
    devices = tables.read_table(spark, sf_dir, "customer").where(number % 37 != 0).select(F.concat(F.lit("dev-"), number.cast("string")).alias("device_id")).distinct()
    every = r.select("cycle_id", "account_id", "n", F.month("time").alias("m")).distinct()
    owner = F.when(F.col("n") % 23 == 0, F.concat(F.lit("closed-"), F.col("n").cast("string"))).otherwise(F.col("account_id"))
    cycles = every.where(~((F.col("m") == 2) & (F.col("n") % 5 == 0))).select(
        "cycle_id", owner.alias("account_id"), F.when(F.col("n") % 3 == 0, "FINALIZED").otherwise("OPEN").alias("state"))
    logs = every.where(F.col("n") % 3 == 0).select(F.concat(F.lit("fin-"), F.col("cycle_id")).alias("log_id"), "cycle_id")
    recs = r.select("record_id", "device_id", "account_id", F.when(F.col("record_id") % 19 != 0, F.col("cycle_id")).alias("cycle_id"))
    return billing.billing_links(recs, devices, cycles, tables.accounts(spark, sf_dir), logs)


@register("billing_links", with_views("billing_records", "accounts", extra=_LINKS_SQL) + """SELECT r.record_id, r.device_id, d.device_id IS NOT NULL AS device_known, r.account_id, a.address AS account_address,
       r.cycle_id, o.cycle_state, o.cycle_account_id, o.cycle_address
FROM recs r LEFT JOIN devices d ON r.device_id = d.device_id LEFT JOIN accounts a ON r.account_id = a.account_id LEFT JOIN owned o ON r.cycle_id = o.cycle_id""")
def billing_links(spark, sf_dir):
    """Record to device, account and cycle, and cycle to account, over stored bucketed tables; orphans are kept."""
    return _links(spark, sf_dir)[0]


@register("finalization_links", with_views("billing_records", "accounts", extra=_LINKS_SQL) + """SELECT l.log_id, l.cycle_id, o.cycle_state, o.cycle_account_id, o.cycle_address
FROM logs l LEFT JOIN owned o ON l.cycle_id = o.cycle_id""")
def finalization_links(spark, sf_dir):
    """Finalization log to cycle and the cycle's account; entries of missing cycles are kept."""
    return _links(spark, sf_dir)[1]


@register("cycle_totals", with_views("billing_records", extra="""
recs AS (SELECT * REPLACE (CASE WHEN CAST(replace(account_id, 'acct-', '') AS BIGINT) % 10 = 0 THEN usage_amount + 9200000000000000000 ELSE usage_amount END AS usage_amount)
         FROM billing_records)""") + """SELECT cycle_id, account_id, COUNT(*) AS record_count,
       MIN(time) AS period_first, MAX(time) AS period_last,
       CASE WHEN SUM(CAST(usage_amount AS HUGEINT)) > 9223372036854775807
              OR SUM(CAST(usage_amount AS HUGEINT)) < -9223372036854775808 THEN NULL
            ELSE CAST(SUM(CAST(usage_amount AS HUGEINT)) AS BIGINT) END AS total_usage,
       SUM(CAST(usage_amount AS HUGEINT)) > 9223372036854775807
         OR SUM(CAST(usage_amount AS HUGEINT)) < -9223372036854775808 AS overflow
FROM recs GROUP BY cycle_id, account_id""", bench=True)
def cycle_totals(spark, sf_dir):
    """Exact usage per billing cycle; accounts ending in 0 use so much that two records overflow 64 bits."""
    heavy = F.regexp_replace("account_id", "acct-", "").cast("bigint") % 10 == 0
    recs = tables.billing_records(spark, sf_dir)
    return billing.cycle_totals(recs.withColumn("usage_amount", F.when(heavy, F.col("usage_amount") + F.lit(9_200_000_000_000_000_000)).otherwise(F.col("usage_amount"))))


# --------------------------------------------------------------------------- reconciliation


def _balances(acc: DataFrame) -> DataFrame:
    """Ledger balance lines per address: one credit line, then the native line
    (missing for every 50th customer)."""
    credit = F.struct(F.lit(0).alias("position"), F.lit("credit_alphanum4").alias("asset_type"),
                      F.lit("12.5000000").alias("balance"))
    native = F.struct(F.lit(1).alias("position"), F.lit("native").alias("asset_type"),
                      money.units_to_decimal_string(F.col("onchain_balance")).alias("balance"))
    lines = F.when(F.col("c_custkey") % 50 == 0, F.array(credit)).otherwise(F.array(credit, native))
    return acc.select("address", F.inline(lines))


_BALANCES_SQL = """balances AS (
  SELECT address, 0 AS position, 'credit_alphanum4' AS asset_type, '12.5000000' AS balance FROM accounts
  UNION ALL
  SELECT address, 1, 'native',
         CASE WHEN onchain_balance < 0 THEN '-' ELSE '' END
           || CAST(abs(onchain_balance) // 10000000 AS VARCHAR) || '.'
           || lpad(CAST(abs(onchain_balance) % 10000000 AS VARCHAR), 7, '0')
  FROM accounts WHERE c_custkey % 50 <> 0),
nb AS (SELECT address, balance AS native_balance FROM (
         SELECT *, row_number() OVER (PARTITION BY address ORDER BY position) AS rn
         FROM balances WHERE asset_type = 'native') WHERE rn = 1),
parsed AS (
  SELECT a.account_id, a.address, a.local_balance, nb.native_balance,
         CAST(CASE WHEN nb.native_balance LIKE '-%' THEN -1 ELSE 1 END
              * (CAST(split_part(regexp_replace(nb.native_balance, '^[+-]', ''), '.', 1) AS HUGEINT) * 10000000
                 + CAST(rpad(substr(split_part(regexp_replace(nb.native_balance, '^[+-]', ''), '.', 2), 1, 7), 7, '0') AS HUGEINT))
              AS BIGINT) AS onchain_balance
  FROM accounts a LEFT JOIN nb ON a.address = nb.address)"""


@register("balance_reconcile", with_views("accounts", extra=_BALANCES_SQL) + """SELECT account_id, address, onchain_balance,
       local_balance - onchain_balance AS discrepancy,
       local_balance - onchain_balance <> 0 AS corrected,
       CASE WHEN onchain_balance IS NULL THEN NULL
            WHEN local_balance - onchain_balance <> 0 THEN onchain_balance ELSE local_balance END AS resulting_local_balance,
       CASE WHEN native_balance IS NULL THEN 'No native balance found for ' || address END AS error
FROM parsed""")
def balance_reconcile(spark, sf_dir):
    """Local vs on-chain balances; missing native balance is an error row."""
    acc = tables.accounts(spark, sf_dir)
    return billing.reconcile(acc, _balances(acc))


@register("seq_drift", """SELECT 'G' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS address,
       c_custkey * 100 + c_nationkey % 4 AS local_seq,
       c_custkey * 100 + c_custkey % 5 - 1 AS ledger_seq,
       (c_custkey * 100 + c_custkey % 5 - 1 > c_custkey * 100 + c_nationkey % 4)
         OR abs((c_nationkey % 4) - (c_custkey % 5 - 1)) > 1 AS adopted,
       CASE WHEN (c_custkey * 100 + c_custkey % 5 - 1 > c_custkey * 100 + c_nationkey % 4)
                 OR abs((c_nationkey % 4) - (c_custkey % 5 - 1)) > 1
            THEN c_custkey * 100 + c_custkey % 5 - 1 ELSE c_custkey * 100 + c_nationkey % 4 END AS synced_seq
FROM customer""")
def seq_drift(spark, sf_dir):
    """Per-account sequence sync against the ledger's sequence."""
    c = tables.read_table(spark, sf_dir, "customer")
    addr = F.concat(F.lit("G"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("address")
    local = c.select(addr, (F.col("c_custkey") * 100 + F.col("c_nationkey") % 4).alias("local_seq"))
    led = c.select(addr, (F.col("c_custkey") * 100 + F.col("c_custkey") % 5 - 1).alias("ledger_seq"))
    return billing.sequence_drift(local, led)


# --------------------------------------------------------------------------- money functions



@register("money_rescale", with_views("billing_records") + """SELECT record_id, usage_amount AS raw_value, CAST(record_id % 12 AS INTEGER) AS source_decimals,
       CAST(CASE WHEN record_id % 12 = 7 THEN usage_amount
                 WHEN record_id % 12 > 7 THEN CAST(usage_amount AS HUGEINT) // CAST(10 ** (record_id % 12 - 7) AS HUGEINT)
                 ELSE CAST(usage_amount AS HUGEINT) * CAST(10 ** (7 - record_id % 12) AS HUGEINT) END AS BIGINT) AS value_7dp
FROM billing_records""")
def money_rescale(spark, sf_dir):
    """rescale usage amounts from 0..11 source decimals to 7."""
    r = tables.billing_records(spark, sf_dir)
    d = (F.col("record_id") % 12).cast("int")
    return r.select("record_id", F.col("usage_amount").alias("raw_value"), d.alias("source_decimals"),
                    money.to_target_precision("usage_amount", d).alias("value_7dp"))


@register("money_multiply", with_views("billing_records") + """SELECT record_id, usage_amount AS a, record_id * 1000 + 7 AS b,
       CAST((CAST(usage_amount AS HUGEINT) * CAST(record_id * 1000 + 7 AS HUGEINT)) // CAST(10000 AS HUGEINT) AS DECIMAL(38,0)) AS product_4dp
FROM billing_records""")
def money_multiply(spark, sf_dir):
    """``a * b / 10^4`` truncated."""
    r = tables.billing_records(spark, sf_dir)
    b = F.col("record_id") * 1000 + 7
    return r.select("record_id", F.col("usage_amount").alias("a"), b.alias("b"),
                    money.multiply_with_precision("usage_amount", b, 4).alias("product_4dp"))


@register("money_overflow", with_views("billing_records") + """SELECT record_id,
       CAST(CAST(usage_amount AS HUGEINT) * CAST(record_id AS HUGEINT) * CAST(100000000000 AS HUGEINT) AS DECIMAL(38,0)) AS value,
       CAST(usage_amount AS HUGEINT) * CAST(record_id AS HUGEINT) * CAST(100000000000 AS HUGEINT) > CAST('9223372036854775807' AS HUGEINT)
         OR CAST(usage_amount AS HUGEINT) * CAST(record_id AS HUGEINT) * CAST(100000000000 AS HUGEINT) < CAST('-9223372036854775808' AS HUGEINT) AS overflow
FROM billing_records""")
def money_overflow(spark, sf_dir):
    """signed 64-bit range check of an exact product."""
    r = tables.billing_records(spark, sf_dir)
    v = (money.dec("usage_amount") * money.dec("record_id")).cast(money.D38) * money.dec(F.lit(100000000000))
    v = v.cast(money.D38)
    return r.select("record_id", v.alias("value"), money.is_overflow(v).alias("overflow"))


@register("money_checked", with_views("billing_records") + """SELECT record_id,
       CASE WHEN CAST(usage_amount AS HUGEINT) * (CAST(record_id AS HUGEINT) * 100000000000 + 1) > 9223372036854775807
              OR CAST(usage_amount AS HUGEINT) * (CAST(record_id AS HUGEINT) * 100000000000 + 1) < -9223372036854775808 THEN NULL
            ELSE CAST(CAST(usage_amount AS HUGEINT) * (CAST(record_id AS HUGEINT) * 100000000000 + 1) AS BIGINT) END AS checked_product,
       CASE WHEN CAST(usage_amount AS HUGEINT) + CAST(9223372036800000000 AS HUGEINT) > 9223372036854775807 THEN NULL
            ELSE CAST(CAST(usage_amount AS HUGEINT) + CAST(9223372036800000000 AS HUGEINT) AS BIGINT) END AS checked_sum
FROM billing_records""")
def money_checked(spark, sf_dir):
    """checked multiply and add; overflow quarantined as NULL."""
    r = tables.billing_records(spark, sf_dir)
    return r.select("record_id",
                    money.checked_multiply("usage_amount", F.col("record_id") * F.lit(100000000000) + 1).alias("checked_product"),
                    money.checked_add("usage_amount", F.lit(9223372036800000000)).alias("checked_sum"))


@register("round_up_div", with_views("billing_records") + """SELECT record_id,
       CASE WHEN record_id % 2 = 0 THEN usage_amount ELSE -usage_amount END AS dividend,
       record_id % 13 - 6 AS divisor,
       CAST(CASE WHEN record_id % 13 - 6 = 0 THEN NULL
            WHEN usage_amount = 0 THEN 0
            WHEN (CASE WHEN record_id % 2 = 0 THEN usage_amount ELSE -usage_amount END < 0) <> (record_id % 13 - 6 < 0)
              THEN -((abs(CAST(usage_amount AS HUGEINT)) + abs(record_id % 13 - 6) - 1) // abs(record_id % 13 - 6))
            ELSE (abs(CAST(usage_amount AS HUGEINT)) + abs(record_id % 13 - 6) - 1) // abs(record_id % 13 - 6) END AS DECIMAL(38,0)) AS quotient
FROM billing_records""")
def round_up_div(spark, sf_dir):
    """division rounding away from zero; zero divisor gives NULL."""
    r = tables.billing_records(spark, sf_dir)
    a = F.when(F.col("record_id") % 2 == 0, F.col("usage_amount")).otherwise(-F.col("usage_amount"))
    b = F.col("record_id") % 13 - 6
    return r.select("record_id", a.alias("dividend"), b.alias("divisor"), money.round_up_div(a, b).alias("quotient"))


@register("price_units", with_views("billing_records") + """SELECT record_id, usage_amount AS price, CAST(regexp_replace(account_id, 'acct-', '') AS BIGINT) * 1000000000 AS units,
       CASE WHEN ABS(CAST(usage_amount AS HUGEINT) * CAST(regexp_replace(account_id, 'acct-', '') AS HUGEINT) * 1000000000) > 9223372036854775807 THEN NULL
            ELSE CAST(CAST(usage_amount AS HUGEINT) * CAST(regexp_replace(account_id, 'acct-', '') AS HUGEINT) * 1000000000 AS BIGINT) END AS product,
       CAST(usage_amount AS HUGEINT) * CAST(regexp_replace(account_id, 'acct-', '') AS HUGEINT) * 1000000000 > 7378697629483820646 AS above_watermark
FROM billing_records""")
def price_units(spark, sf_dir):
    """F8: checked price x units with the 80 % watermark flag."""
    r = tables.billing_records(spark, sf_dir)
    units = F.regexp_replace("account_id", "acct-", "").cast("bigint") * F.lit(1000000000)
    return r.select("record_id", F.col("usage_amount").alias("price"), units.alias("units"),
                    money.checked_multiply("usage_amount", units).alias("product"),
                    money.price_units_flag("usage_amount", units).alias("above_watermark"))


@register("stroops", """SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS balance_text,
       CAST(CASE WHEN CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) LIKE '-%' THEN -1 ELSE 1 END
            * (CAST(split_part(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR), '^[+-]', ''), '.', 1) AS HUGEINT) * 10000000
               + CAST(rpad(substr(split_part(regexp_replace(CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR), '^[+-]', ''), '.', 2), 1, 7), 7, '0') AS HUGEINT))
            AS BIGINT) AS stroops
FROM customer""")
def stroops(spark, sf_dir):
    """account balance text to 7-decimal integer units."""
    c = tables.read_table(spark, sf_dir, "customer")
    txt = F.col("c_acctbal").cast("decimal(15,2)").cast("string")
    return c.select("c_custkey", txt.alias("balance_text"), money.decimal_string_to_units(txt).alias("stroops"))
