"""DuckDB text of the derived views, for the oracle SQL of each query.

These mirror ``gaugeworks.sources.tables`` expression by expression; the
driver tables are pre-registered DuckDB views with the same names as the
Parquet files.
"""

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

VIEWS = {
    "telemetry": f"""telemetry AS (
  SELECT event_id, ts AS time, 'dev-' || CAST(user_id AS VARCHAR) AS device_id,
         CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3
                         WHEN 'signup' THEN 4 WHEN 'error' THEN 5 END AS metric_id,
         CAST(value AS DECIMAL(18,2)) AS metric_value,
         'r' || CAST(user_id % 8 AS VARCHAR) AS region,
         't' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         {K} AS k,
         ts + to_seconds({K}) AS ingested_at,
         user_id, event_type
  FROM events)""",
    "ledger": f"""ledger AS (
  SELECT 'ledger' AS stream_id, event_id AS sequence, ts AS arrival_ts, event_id AS arrival_id
  FROM events WHERE {K} % 25 <> 0)""",
    "billing_records": """billing_records AS (
  SELECT o_orderkey AS record_id, o_orderdate AS time,
         'acct-' || CAST(o_custkey AS VARCHAR) AS account_id,
         'dev-' || CAST(o_custkey % 150 AS VARCHAR) AS device_id,
         CAST(round(o_totalprice * 100) AS BIGINT) AS usage_amount,
         CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'failed' END AS status,
         'acct-' || CAST(o_custkey AS VARCHAR) || ':' || strftime(o_orderdate, '%Y-%m') AS cycle_id
  FROM orders)""",
    "accounts": """accounts AS (
  SELECT 'acct-' || CAST(c_custkey AS VARCHAR) AS account_id,
         'G' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS address,
         CAST(round(c_acctbal * 100) AS BIGINT) * 100000 AS local_balance,
         CAST(round(c_acctbal * 100) AS BIGINT) * 100000
           + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS onchain_balance,
         c_custkey
  FROM customer)""",
    "event_log": """event_log AS (
  SELECT CAST(conv_id AS VARCHAR) AS tenant_id, turn AS arrival, role AS event_type, text AS payload
  FROM conversations)""",
    "outcomes": f"""outcomes AS (
  SELECT event_id, ts AS time, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'rejected'
              ELSE 'accepted' END AS outcome,
         event_type AS profile, {K} AS k
  FROM events)""",
    "payloads": f"""payloads AS (
  SELECT event_id, 'dev-' || CAST(user_id AS VARCHAR) AS device_id,
         CAST(user_id AS VARCHAR) || ':' || CAST({K} % 10 AS VARCHAR) AS nonce,
         epoch_us(ts) // 1000 AS ts_ms, epoch_us(ts) // 1000 + {K} * 100 AS received_ms, {K} AS k
  FROM events)""",
}


def with_views(*names: str, extra: str = "", recursive: bool = False) -> str:
    """``WITH`` prefix defining the named views (and optional extra CTEs)."""
    parts = [VIEWS[n] for n in names]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
