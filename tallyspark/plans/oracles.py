"""The same queries as SQL text over the provided tables, for another engine to run.

Shared parts are named tables; a query gets those it mentions, and what they
mention in turn.
"""

import re

from tallyspark.operators import quality

TABLES = {}
QUERIES = {}

TABLES["accounts"] = """
SELECT s_suppkey AS account_id, s_name AS account_name,
       CASE WHEN s_suppkey % 2 = 0 THEN 'personal' ELSE 'small_business' END AS account_type,
       s_name AS owner_name, 'USD' AS currency, CAST(s_acctbal AS DECIMAL(12,2)) AS opening_balance
FROM supplier"""

TABLES["categories"] = """
SELECT md5(p_type) AS category_id, p_type AS category_name,
       CASE WHEN p_type LIKE 'LARGE%' OR p_type LIKE 'STANDARD%' THEN 'variable_expense'
            WHEN p_type LIKE 'SMALL%' OR p_type LIKE 'MEDIUM%' THEN 'discretionary'
            WHEN p_type LIKE 'ECONOMY%' THEN 'fixed_expense'
            WHEN p_type LIKE 'PROMO%' THEN 'transfer' END AS category_group
FROM (SELECT DISTINCT p_type FROM part)"""

TABLES["merchants"] = """
SELECT md5(p_brand) AS merchant_id, p_brand AS merchant_name, p_type AS default_category
FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn
      FROM part GROUP BY p_brand, p_type) WHERE rn = 1"""

TABLES["ledger"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR)) AS transaction_id,
       l_suppkey AS account_id, CAST(l_shipdate AS DATE) AS txn_date,
       strftime(l_shipdate, '%Y-%m') AS month,
       p_brand AS merchant_name, p_type AS category_name,
       CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
       CASE WHEN l_linestatus = 'F' THEN 'credit' ELSE 'debit' END AS txn_type,
       concat_ws(' - ', p_brand, p_type) AS description, l_returnflag = 'R' AS is_recurring
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey"""

TABLES["orphan_ledger"] = """
SELECT transaction_id, account_id, txn_date, merchant_name, category_name, amount, txn_type FROM ledger
UNION ALL SELECT 'a-' || transaction_id, account_id + 1000000000, CAST(txn_date + to_days(36500) AS DATE), merchant_name,
                 category_name, amount, txn_type FROM ledger WHERE is_recurring
UNION ALL SELECT 'c-' || transaction_id, account_id, CAST(txn_date + to_days(36500) AS DATE), merchant_name,
                 'Uncharted', amount, txn_type FROM ledger WHERE is_recurring"""

TABLES["moved_ledger"] = """
SELECT *, txn_date < DATE '1992-04-01' AS early, NOT is_recurring AND amount < 20000 AND txn_date < DATE '1992-04-01' AS gone,
  CASE WHEN txn_date < DATE '1992-04-01' AND is_recurring AND txn_type <> 'credit'
       THEN CAST(txn_date + 366 AS DATE) ELSE txn_date END AS new_date
FROM ledger"""

TABLES["changed_months"] = """
SELECT month AS m FROM moved_ledger WHERE early AND (txn_type = 'credit' OR is_recurring OR gone)
UNION SELECT strftime(new_date, '%Y-%m') FROM moved_ledger
WHERE early AND NOT gone AND (txn_type = 'credit' OR is_recurring)"""

TABLES["fct"] = """
SELECT t.*, c.category_group FROM ledger t LEFT JOIN categories c ON c.category_name = t.category_name"""

TABLES["ev"] = """
SELECT event_id AS transaction_id, user_id AS account_id, CAST(ts AS DATE) AS txn_date,
       regexp_extract(props, '"k": *([0-9]+)', 1) AS merchant_name, event_type AS category_name,
       CAST(value AS DECIMAL(12,2)) AS amount
FROM events"""

TABLES["monthly"] = """
SELECT account_id, month,
       sum(CASE WHEN txn_type = 'credit' THEN amount ELSE 0 END) AS total_income,
       sum(CASE WHEN txn_type = 'debit' THEN amount ELSE 0 END) AS total_expense,
       sum(CASE WHEN txn_type = 'credit' THEN amount ELSE -amount END) AS net_flow
FROM ledger GROUP BY account_id, month"""

TABLES["spend"] = """
SELECT account_id, month, category_name, category_group, sum(amount) AS total_amount, count(*) AS txn_count
FROM fct WHERE txn_type = 'debit' GROUP BY account_id, month, category_name, category_group"""

TABLES["last_day"] = """
SELECT account_id, max(txn_date) AS last_date,
       sum(CASE WHEN txn_type = 'credit' THEN amount ELSE -amount END) AS net_movement
FROM ledger GROUP BY account_id"""

TABLES["burn"] = """
SELECT l.account_id, sum(l.amount) AS recent_debit FROM ledger l JOIN last_day d ON d.account_id = l.account_id
WHERE l.txn_type = 'debit' AND l.txn_date >= d.last_date - INTERVAL 30 DAY GROUP BY l.account_id"""

TABLES["health"] = """
SELECT a.account_id, a.account_name, a.account_type,
       CAST(a.opening_balance + coalesce(d.net_movement, 0) AS DOUBLE) AS current_balance,
       round(CAST(coalesce(b.recent_debit, 0) AS DOUBLE) / 30, 6) AS avg_daily_burn
FROM accounts a LEFT JOIN last_day d ON d.account_id = a.account_id LEFT JOIN burn b ON b.account_id = a.account_id"""

TABLES["month_cents"] = """
SELECT account_id, category_name, month, CAST(sum(amount) * 100 AS BIGINT) AS month_cents
FROM fct WHERE txn_type = 'debit' AND category_group IN ('variable_expense', 'discretionary')
GROUP BY account_id, category_name, month"""

TABLES["budget_months"] = """
SELECT DISTINCT strftime(e - to_days(CAST(30 * i AS INTEGER)), '%Y-%m') AS month
FROM (SELECT max(txn_date) AS e FROM ledger) CROSS JOIN range(6) AS r(i)"""

TABLES["budgets"] = """
SELECT account_id, category_name, m.month,
       CAST(((2 * s + n) // (2 * n)) AS DECIMAL(20,0)) / 100 AS budgeted_amount,
       ((2 * s + n) // (2 * n)) AS budget_cents
FROM (SELECT account_id, category_name, CAST(sum(month_cents) AS BIGINT) AS s, count(*) AS n
      FROM month_cents GROUP BY account_id, category_name) CROSS JOIN budget_months m"""

TABLES["bva"] = """
SELECT b.account_id, b.month, b.category_name, b.budgeted_amount, b.budget_cents,
       coalesce(s.total_amount, 0) AS actual_amount, CAST(coalesce(s.total_amount, 0) * 100 AS BIGINT) AS actual_cents
FROM budgets b LEFT JOIN spend s
  ON s.account_id = b.account_id AND s.month = b.month AND s.category_name = b.category_name"""

TABLES["recurring"] = """
SELECT account_id, merchant_name, count(*) AS occurrence_count,
       (2 * CAST(sum(amount) * 100 AS BIGINT) + count(*)) // (2 * count(*)) AS typical_cents,
       max(txn_date) AS last_txn_date,
       arg_max(amount, (txn_date, transaction_id)) AS last_amount
FROM ledger WHERE is_recurring AND txn_type = 'debit' AND merchant_name IS NOT NULL
GROUP BY account_id, merchant_name"""

TABLES["raw_accounts"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS account_ref, '  ' || s_name || ' ' AS account_name,
       CASE WHEN s_suppkey % 2 = 0 THEN ' personal' ELSE 'small_business ' END AS account_type,
       s_name || '  ' AS owner_name,
       CASE WHEN s_nationkey < 5 THEN '  ' WHEN s_nationkey < 10 THEN NULL
            WHEN s_nationkey < 15 THEN ' EUR ' ELSE 'USD' END AS currency,
       CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS opening_balance
FROM supplier"""

TABLES["raw_merchants"] = """
SELECT merchant_name || ' ' AS merchant_name,
       CASE WHEN merchant_name = 'Brand#1' THEN 'Uncharted' ELSE ' ' || default_category END AS default_category
FROM merchants"""

TABLES["raw_txn"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, amt) AS source_txn_id,
       CASE WHEN d = 0.1 AND k = 1 THEN 'x' WHEN d = 0.1 AND k = 2 THEN '-1' WHEN d = 0.1 AND k = 3 THEN '999999999999'
            WHEN d = 0.01 AND k = 1 THEN 'y' ELSE CAST(l_suppkey AS VARCHAR) END AS account_ref,
       CASE WHEN d = 0 AND k = 3 THEN '' WHEN d = 0 AND k = 4 THEN '2026-13-01'
            ELSE strftime(l_shipdate, '%Y-%m-%d') END AS txn_date,
       CASE WHEN d = 0 AND k = 6 THEN 'Nameless Kiosk' WHEN d = 0.01 AND k = 5 THEN NULL
            ELSE p_brand || ' ' END AS merchant_name,
       CASE WHEN d = 0.1 AND k = 4 THEN 'Uncharted' ELSE ' ' || p_type END AS category_name,
       CASE WHEN (d = 0.1 AND k = 5) OR (d = 0.01 AND k = 1) THEN 'abc' WHEN d = 0.1 AND k = 6 THEN '-' || amt
            WHEN d = 0.1 AND k = 7 THEN '0' WHEN d = 0 AND k = 7 THEN '1e3'
            WHEN d = 0.01 AND k = 2 THEN ' ' || amt || ' ' WHEN d = 0.01 AND k = 3 THEN 'NaN'
            WHEN d = 0.01 AND k = 4 THEN '1.2.3' WHEN d = 0.01 AND k = 6 THEN '19.999' ELSE amt END AS amount,
       CASE WHEN d = 0 AND k = 1 THEN 'refund' WHEN d = 0 AND k = 2 THEN ' Debit '
            WHEN l_linestatus = 'F' THEN 'credit' ELSE 'debit' END AS txn_type,
       CASE WHEN d = 0.01 AND k = 7 THEN '   ' ELSE concat_ws(' - ', p_brand, p_type) END AS description,
       CASE WHEN d = 0 AND k = 5 THEN 'true' WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS is_recurring
FROM (SELECT *, l_discount AS d, l_linenumber AS k,
             CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS amt
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""

TABLES["checked"] = """
SELECT r.source_txn_id AS transaction_id, a.account_id, m.merchant_id, trim(r.category_name) AS category_name,
       TRY_CAST(r.amount AS DECIMAL(12,2)) AS amount,
       CASE WHEN a.account_id IS NULL THEN 'account_ref'
            WHEN c.category_id IS NULL THEN 'category'
            WHEN TRY_CAST(r.amount AS DECIMAL(12,2)) IS NULL THEN 'amount_numeric'
            WHEN TRY_CAST(r.amount AS DECIMAL(12,2)) <= 0 THEN 'amount_positive'
            WHEN lower(trim(r.txn_type)) NOT IN ('credit', 'debit') THEN 'txn_type'
            WHEN TRY_CAST(r.txn_date AS DATE) IS NULL THEN 'txn_date'
            WHEN NOT regexp_full_match(r.is_recurring, '[0-9]+') THEN 'is_recurring' END AS reason_code,
       CASE WHEN a.account_id IS NULL THEN 'unknown account_ref: ' || r.account_ref
            WHEN c.category_id IS NULL THEN 'unknown category: ' || r.category_name
            WHEN TRY_CAST(r.amount AS DECIMAL(12,2)) IS NULL THEN 'amount is not a number: ' || r.amount
            WHEN TRY_CAST(r.amount AS DECIMAL(12,2)) <= 0 THEN 'non-positive amount: ' || r.amount
            WHEN lower(trim(r.txn_type)) NOT IN ('credit', 'debit') THEN 'bad txn_type: ' || r.txn_type
            WHEN r.txn_date = '' THEN 'missing txn_date'
            WHEN TRY_CAST(r.txn_date AS DATE) IS NULL THEN 'bad txn_date: ' || r.txn_date
            WHEN NOT regexp_full_match(r.is_recurring, '[0-9]+') THEN 'bad is_recurring: ' || r.is_recurring
       END AS reason
FROM raw_txn r
LEFT JOIN accounts a ON CAST(a.account_id AS VARCHAR) = r.account_ref
LEFT JOIN categories c ON c.category_name = trim(r.category_name)
LEFT JOIN merchants m ON m.merchant_name = trim(r.merchant_name)"""

TABLES["stg_txn"] = """
SELECT source_txn_id AS transaction_id, TRY_CAST(account_ref AS BIGINT) AS account_id,
       TRY_CAST(txn_date AS DATE) AS txn_date, trim(merchant_name) AS merchant_name,
       trim(category_name) AS category_name, TRY_CAST(amount AS DECIMAL(12,2)) AS amount,
       lower(trim(txn_type)) AS txn_type, description, is_recurring = '1' AS is_recurring
FROM raw_txn
WHERE regexp_full_match(amount, '[0-9.]+') AND TRY_CAST(amount AS DECIMAL(12,2)) IS NOT NULL
  AND lower(trim(txn_type)) IN ('credit', 'debit') AND TRY_CAST(txn_date AS DATE) IS NOT NULL"""

TABLES["stg_accounts"] = """
SELECT CAST(account_ref AS BIGINT) AS account_id, trim(account_name) AS account_name,
       trim(account_type) AS account_type, trim(owner_name) AS owner_name,
       coalesce(nullif(trim(currency), ''), 'USD') AS currency,
       CAST(opening_balance AS DECIMAL(12,2)) AS opening_balance
FROM raw_accounts"""

TABLES["stg_merchants"] = """
SELECT md5(trim(merchant_name)) AS merchant_id, trim(merchant_name) AS merchant_name,
       trim(default_category) AS default_category FROM raw_merchants"""

TABLES["ev_stats"] = """
SELECT category_name, avg(CAST(amount AS DOUBLE)) AS m,
       coalesce(nullif(stddev_samp(CAST(amount AS DOUBLE)), 0),
                (SELECT nullif(stddev_samp(CAST(amount AS DOUBLE)), 0) FROM ev)) AS s
FROM ev GROUP BY category_name"""

TABLES["ev_features"] = """
SELECT e.*, round((CAST(e.amount AS DOUBLE) - st.m) / st.s, 6) AS z_amount,
       count(*) OVER (PARTITION BY e.account_id, e.txn_date) AS same_day,
       CAST(isodow(e.txn_date) - 1 AS BIGINT) AS day_of_week, CAST(day(e.txn_date) AS BIGINT) AS day_of_month
FROM ev e JOIN ev_stats st ON st.category_name = e.category_name"""

REASON = """coalesce(nullif(concat_ws('; ',
    CASE WHEN abs(z_amount) > 2 THEN printf('amount %.1f std devs from category norm', z_amount) END,
    CASE WHEN same_day > 3 THEN same_day || ' transactions same day (possible duplicate/testing)' END), ''),
  'unusual combination of amount/timing features')"""

TABLES["debits"] = "SELECT * FROM ledger WHERE txn_type = 'debit' AND category_name IS NOT NULL"

TABLES["debit_stats"] = """
SELECT category_name, avg(CAST(amount AS DOUBLE)) AS m, stddev_samp(CAST(amount AS DOUBLE)) AS s
FROM debits GROUP BY category_name"""

TABLES["distance_flags"] = f"""
SELECT transaction_id, floor(abs(z_amount) * 1000) / 10000 AS anomaly_score, {REASON} AS reason
FROM (SELECT d.transaction_id, round((CAST(d.amount AS DOUBLE) - st.m) / st.s, 6) AS z_amount,
             count(*) OVER (PARTITION BY d.account_id, d.txn_date) AS same_day
      FROM debits d JOIN debit_stats st ON st.category_name = d.category_name)
WHERE abs(z_amount) > 1.5"""

TABLES["daily"] = """
SELECT account_id, txn_date, sum(CASE WHEN txn_type = 'credit' THEN amount ELSE -amount END) AS net_flow
FROM ledger GROUP BY account_id, txn_date"""

TABLES["dense"] = """
SELECT c.account_id, c.txn_date, coalesce(d.net_flow, 0) AS net_flow
FROM (SELECT account_id, CAST(unnest(generate_series(CAST(min(txn_date) AS TIMESTAMP), CAST(max(txn_date) AS TIMESTAMP),
                                                     INTERVAL 1 DAY)) AS DATE) AS txn_date
      FROM daily GROUP BY account_id) c
LEFT JOIN daily d ON d.account_id = c.account_id AND d.txn_date = c.txn_date"""

_LAGS = ", ".join(
    f"CAST(lag(net_flow, {k}) OVER (PARTITION BY account_id ORDER BY txn_date) AS DOUBLE) AS lag_{k}"
    for k in range(1, 8))

TABLES["lagged"] = f"""
SELECT account_id, txn_date, CAST(net_flow AS DOUBLE) AS net_flow, {_LAGS},
       CAST(isodow(txn_date) - 1 AS BIGINT) AS dow, CAST(day(txn_date) AS BIGINT) AS day_of_month,
       CASE WHEN count(*) OVER w = 7 THEN CAST(sum(net_flow) OVER w AS DOUBLE) / 7 END AS rolling_mean_7
FROM dense WINDOW w AS (PARTITION BY account_id ORDER BY txn_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""

TABLES["split"] = """
SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY account_id) AS n_rows,
         row_number() OVER (PARTITION BY account_id ORDER BY txn_date)
           <= (count(*) OVER (PARTITION BY account_id) * 85) // 100 AS is_train
  FROM lagged WHERE lag_7 IS NOT NULL)
WHERE n_rows >= 45"""

TABLES["naive"] = """
SELECT w.account_id, CAST(w.last_date + to_days(CAST(k AS INTEGER)) AS DATE) AS forecast_date,
       CAST(w.net_flow AS DOUBLE) AS predicted_net_flow,
       CAST(h.opening + coalesce(sum(w.net_flow) OVER (PARTITION BY w.account_id ORDER BY k), 0) AS DOUBLE)
         AS predicted_balance
FROM (SELECT account_id, net_flow, max(txn_date) OVER (PARTITION BY account_id) AS last_date,
             row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC) AS age FROM dense) w
JOIN range(1, 31) AS r(k) ON w.age = 7 - (k - 1) % 7
LEFT JOIN (SELECT account_id, CAST(current_balance AS DECIMAL(22,2)) AS opening FROM health) h
  ON h.account_id = w.account_id
WHERE w.age <= 7"""

TABLES["kpi"] = """
SELECT a.account_id, coalesce(h.current_balance, 0) AS current_balance, coalesce(h.avg_daily_burn, 0) AS avg_daily_burn,
       CASE WHEN h.avg_daily_burn > 0 THEN h.current_balance / h.avg_daily_burn END AS runway_days,
       coalesce(l.n, 0) AS last_month_net
FROM accounts a LEFT JOIN health h ON h.account_id = a.account_id
LEFT JOIN (SELECT account_id, CAST(arg_max(net_flow, month) AS DOUBLE) AS n FROM monthly GROUP BY account_id) l
  ON l.account_id = a.account_id"""

TABLES["budget_totals"] = """
SELECT account_id, category_name, sum(budget_cents) AS b, sum(actual_cents) AS a FROM bva
GROUP BY account_id, category_name"""

TABLES["raw_budgets"] = """
SELECT CAST(account_id AS VARCHAR) AS account_ref, month, category_name, budget_cents, load_seq
FROM (SELECT account_id, month, category_name || ' ' AS category_name, budget_cents, 1 AS load_seq FROM budgets
      UNION ALL SELECT account_id, month, category_name || ' ', budget_cents + 10000, 2 FROM budgets
      UNION ALL SELECT account_id, month, 'Uncharted', budget_cents, 3 FROM budgets)"""

# --- sources and sinks ---
QUERIES["src_csv"] = """
SELECT source_txn_id, account_ref, txn_date, coalesce(merchant_name, '') AS merchant_name, category_name, amount,
       txn_type, replace(description, ' - ', chr(10) || '"-", ') AS description, is_recurring
FROM raw_txn"""
QUERIES["src_accounts_ref"] = "SELECT account_ref, account_name, opening_balance FROM raw_accounts"
QUERIES["src_table"] = """
SELECT transaction_id, account_id, CAST(amount AS DOUBLE) AS amount FROM ledger WHERE txn_type = 'debit'"""
QUERIES["sink_raw_overwrite"] = """
SELECT 'accounts' AS table_name, count(*) AS n FROM raw_accounts
UNION ALL SELECT 'categories', count(*) FROM categories
UNION ALL SELECT 'merchants', count(*) FROM raw_merchants
UNION ALL SELECT 'transactions', count(*) FROM raw_txn
UNION ALL SELECT 'budgets', count(*) FROM raw_budgets"""
QUERIES["sink_loaded_at"] = "SELECT count(*) AS n, count(*) AS n_stamped FROM raw_txn"
QUERIES["sink_ml_replace"] = f"""
SELECT transaction_id, {REASON} AS reason FROM ev_features WHERE abs(z_amount) > 2 OR same_day > 3"""
QUERIES["sink_materialize"] = QUERIES["monthly_cashflow"] = """
SELECT account_id, month, CAST(total_income AS DOUBLE) AS total_income,
       CAST(total_expense AS DOUBLE) AS total_expense, CAST(net_flow AS DOUBLE) AS net_flow FROM monthly"""
QUERIES["sink_csv_export"] = """
SELECT transaction_id, z_amount AS anomaly_score, 'User #' || account_id || '''s Account' AS account_name,
       'user_' || account_id || '_s_account' AS account_slug
FROM ev_features WHERE abs(z_amount) > 2 OR same_day > 3"""

# --- cleaning, validation, keys ---
for _rule, _name in (
    ("account_ref", "val_account_ref"), ("category", "val_category"), ("amount_numeric", "val_amount_numeric"),
    ("amount_positive", "val_amount_positive"), ("txn_type", "val_txn_type"), ("txn_date", "val_date_present"),
    ("is_recurring", "val_is_recurring"),
):
    QUERIES[_name] = f"SELECT transaction_id, reason_code, reason FROM checked WHERE reason_code = '{_rule}'"
QUERIES["val_merchant_optional"] = """
SELECT transaction_id, account_id, category_name FROM checked WHERE reason_code IS NULL AND merchant_id IS NULL"""
QUERIES["val_round_cents"] = """
SELECT transaction_id, CAST(amount AS DOUBLE) AS amount FROM checked WHERE reason_code IS NULL"""
QUERIES["val_report"] = """
SELECT coalesce(reason_code, 'accepted') AS outcome, count(*) AS n, min(reason) AS example FROM checked GROUP BY 1"""
QUERIES["val_reject_sample"] = """
SELECT transaction_id, reason_code, reason FROM checked WHERE reason_code IS NOT NULL
ORDER BY transaction_id, reason LIMIT 10"""
QUERIES["stg_report"] = """
SELECT CASE WHEN NOT regexp_full_match(amount, '[0-9.]+') OR TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount'
            WHEN TRY_CAST(amount AS DECIMAL(12,2)) IS NULL THEN 'amount_too_large'
            WHEN lower(trim(txn_type)) NOT IN ('credit', 'debit') THEN 'txn_type'
            WHEN TRY_CAST(txn_date AS DATE) IS NULL THEN 'txn_date' ELSE 'kept' END AS outcome, count(*) AS n
FROM raw_txn GROUP BY 1"""
QUERIES["load_accounts"] = """
SELECT CAST(account_ref AS BIGINT) AS account_id, account_name, account_type, owner_name, currency,
       CAST(opening_balance AS DOUBLE) AS opening_balance FROM raw_accounts"""
QUERIES["load_categories"] = "SELECT category_name, category_id, category_group FROM categories"
QUERIES["load_merchants"] = """
SELECT m.merchant_id, m.merchant_name, c.category_id AS default_category_id
FROM stg_merchants m LEFT JOIN categories c ON c.category_name = m.default_category"""
QUERIES["load_merchants_repeated"] = QUERIES["load_merchants"]
QUERIES["load_budgets"] = """
SELECT account_id, md5(category_name) AS category_id, category_name, month, CAST(budget_cents + 10000 AS DOUBLE) / 100 AS budgeted_amount FROM budgets"""
QUERIES["stg_accounts"] = """
SELECT account_id, account_name, account_type, owner_name, currency,
       CAST(opening_balance AS DOUBLE) AS opening_balance FROM stg_accounts"""
QUERIES["stg_categories"] = QUERIES["dim_categories"] = """
SELECT category_id, category_name, category_group FROM categories"""
QUERIES["stg_merchants"] = "SELECT merchant_id, merchant_name, default_category FROM stg_merchants"
QUERIES["stg_transactions"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, merchant_name, category_name,
       CAST(amount AS DOUBLE) AS amount, txn_type, description, is_recurring FROM stg_txn"""
QUERIES["stg_budgets"] = """
SELECT CAST(account_ref AS BIGINT) AS account_id, trim(category_name) AS category_name, month,
       CAST(budget_cents AS DOUBLE) / 100 AS budgeted_amount FROM raw_budgets"""
QUERIES["clean_text"] = "SELECT source_txn_id, nullif(trim(description), '') AS description FROM raw_txn"
QUERIES["suggest_category"] = """
SELECT l.transaction_id, m.default_category AS suggested_category,
       CASE WHEN l.is_recurring THEN l.category_name ELSE m.default_category END AS effective_category
FROM ledger l LEFT JOIN merchants m ON m.merchant_name = l.merchant_name"""
QUERIES["budget_baseline"] = """
SELECT account_id, category_name, month, CAST(budget_cents AS DOUBLE) / 100 AS budgeted_amount FROM budgets"""

# --- data quality ---
QUERIES["dq_unique"] = """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
QUERIES["dq_not_null"] = "SELECT source_txn_id FROM raw_txn WHERE merchant_name IS NULL"
QUERIES["dq_relationships"] = """
SELECT trim(category_name) AS value, count(*) AS n FROM raw_txn
WHERE trim(category_name) NOT IN (SELECT category_name FROM categories) GROUP BY 1"""
QUERIES["dq_accepted_values"] = """
SELECT source_txn_id, txn_type FROM raw_txn WHERE txn_type NOT IN ('credit', 'debit')"""


def _test_sql(test, names):
    table = names[test.table]
    if isinstance(test, quality.Unique):
        keys = ", ".join(test.columns)
        some = " AND ".join(f"{c} IS NOT NULL" for c in test.columns)
        kind, label = "unique", ",".join(test.columns)
        count = f"SELECT count(*) FROM (SELECT {keys} FROM {table} WHERE {some} GROUP BY {keys} HAVING count(*) > 1)"
    elif isinstance(test, quality.NotNull):
        kind, label = "not_null", test.column
        count = f"SELECT count(*) FROM {table} WHERE {test.column} IS NULL"
    elif isinstance(test, quality.Accepted):
        values = ", ".join(f"'{v}'" for v in test.values)
        kind, label = "accepted_values", test.column
        count = f"SELECT count(*) FROM {table} WHERE {test.column} NOT IN ({values})"
    else:
        kind, label = "relationships", test.column
        count = (
            f"SELECT count(*) FROM {table} x WHERE x.{test.column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {names[test.parent]} y WHERE y.{test.parent_column} = x.{test.column})")
    return (f"SELECT '{kind}' AS test, '{test.table}' AS table_name, '{label}' AS column_name, "
            f"({count}) AS failures")


def _tests_sql(tests, names):
    return "\nUNION ALL ".join(_test_sql(test, names) for test in tests)


TABLES["stg_health"] = "SELECT account_id FROM stg_accounts"
QUERIES["dq_schema_checks"] = _tests_sql(quality.SCHEMA_TESTS, {
    "accounts": "stg_accounts", "categories": "categories", "merchants": "stg_merchants",
    "transactions": "stg_txn", "budgets": "budgets"})
QUERIES["dq_gate"] = _tests_sql(quality.STAGING_TESTS + quality.MART_TESTS, {
    "stg_accounts": "stg_accounts", "stg_categories": "categories", "stg_merchants": "stg_merchants",
    "stg_transactions": "stg_txn", "dim_accounts": "stg_accounts", "fct_transactions": "stg_txn",
    "account_health": "stg_health"})

# --- marts ---
QUERIES["dim_accounts"] = """
SELECT account_id, account_name, account_type, owner_name, currency,
       CAST(opening_balance AS DOUBLE) AS opening_balance FROM accounts"""
QUERIES["fct_transactions"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, merchant_name, category_name,
       category_group, CAST(amount AS DOUBLE) AS amount, txn_type, description, is_recurring FROM fct"""
QUERIES["category_spend_monthly"] = QUERIES["srv_category_spend"] = """
SELECT account_id, month, category_name, category_group, CAST(total_amount AS DOUBLE) AS total_amount, txn_count
FROM spend"""
QUERIES["account_health"] = QUERIES["srv_health"] = """
SELECT account_id, account_name, account_type, current_balance, avg_daily_burn FROM health"""
QUERIES["budget_vs_actual"] = QUERIES["srv_budget_vs_actual"] = """
SELECT account_id, month, category_name, CAST(budget_cents AS DOUBLE) / 100 AS budgeted_amount,
       CAST(actual_amount AS DOUBLE) AS actual_amount FROM bva"""
QUERIES["recurring_transactions"] = QUERIES["srv_recurring"] = """
SELECT account_id, merchant_name, occurrence_count, CAST(typical_cents AS DOUBLE) / 100 AS typical_amount,
       CAST(last_txn_date AS VARCHAR) AS last_txn_date, CAST(last_amount AS DOUBLE) AS last_amount FROM recurring"""

# --- the ten questions ---
QUERIES["q01_accounts"] = """
SELECT account_id, account_name, account_type, CAST(opening_balance AS DOUBLE) AS opening_balance FROM accounts"""
QUERIES["q02_recent_txns"] = """
SELECT t.transaction_id, CAST(t.txn_date AS VARCHAR) AS txn_date, a.account_name, t.merchant_name, t.category_name,
       CAST(t.amount AS DOUBLE) AS amount, t.txn_type
FROM orphan_ledger t JOIN accounts a ON a.account_id = t.account_id
JOIN categories c ON c.category_name = t.category_name
ORDER BY t.txn_date DESC, t.transaction_id LIMIT 10"""
QUERIES["q03_category_total"] = """
SELECT t.category_name, CAST(sum(t.amount) AS DOUBLE) AS total_spend
FROM orphan_ledger t JOIN categories c ON c.category_name = t.category_name
WHERE t.txn_type = 'debit' GROUP BY t.category_name"""
QUERIES["q04_high_expense_accounts"] = """
SELECT account_id, CAST(sum(total_expense) AS DOUBLE) / count(*) AS avg_monthly_expense FROM monthly
GROUP BY account_id HAVING sum(total_expense) > 3000 * count(*)"""
QUERIES["q05_mom_change"] = """
SELECT account_id, month, CAST(net_flow AS DOUBLE) AS net_flow,
       CAST(net_flow - lag(net_flow) OVER (PARTITION BY account_id ORDER BY month) AS DOUBLE) AS mom_change
FROM monthly"""
QUERIES["q06_rolling7"] = """
SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, CAST(s AS DOUBLE) AS daily_spend,
       CAST(sum(s) OVER w AS DOUBLE) / count(*) OVER w AS rolling_7day_avg
FROM (SELECT account_id, txn_date, sum(amount) AS s FROM ledger WHERE txn_type = 'debit' GROUP BY account_id, txn_date)
WINDOW w AS (PARTITION BY account_id ORDER BY txn_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"""
QUERIES["q07_top3_categories"] = """
SELECT account_id, month, category_name, CAST(total_amount AS DOUBLE) AS total_amount, rnk
FROM (SELECT *, rank() OVER (PARTITION BY account_id, month ORDER BY total_amount DESC) AS rnk FROM spend)
WHERE rnk <= 3"""
QUERIES["q08_anomaly_review"] = """
SELECT f.transaction_id, f.anomaly_score, f.reason, CAST(t.txn_date AS VARCHAR) AS txn_date, a.account_name,
       CAST(t.amount AS DOUBLE) AS amount, t.category_name
FROM (SELECT transaction_id, anomaly_score, reason FROM distance_flags
      UNION ALL SELECT p || transaction_id, 9, 'x' FROM ledger, (VALUES ('a-'), ('gone-')) v(p) WHERE is_recurring) f
JOIN orphan_ledger t ON t.transaction_id = f.transaction_id
JOIN accounts a ON a.account_id = t.account_id
ORDER BY f.anomaly_score DESC, f.transaction_id LIMIT 20"""
QUERIES["q09_budget_variance"] = """
SELECT account_id, month, category_name, CAST(budget_cents AS DOUBLE) / 100 AS budgeted_amount,
       CAST(actual_amount AS DOUBLE) AS actual_amount,
       CAST(actual_cents - budget_cents AS DOUBLE) / 100 AS variance FROM bva"""
QUERIES["q10_runway"] = """
SELECT account_id, account_name, current_balance, avg_daily_burn,
       CASE WHEN avg_daily_burn > 0 THEN current_balance / avg_daily_burn END AS runway_days FROM health"""

# --- serving ---
QUERIES["srv_accounts"] = "SELECT account_id, account_name, account_type FROM accounts"
QUERIES["srv_monthly"] = QUERIES["monthly_cashflow"]
QUERIES["srv_forecast"] = QUERIES["fc_seasonal_naive"] = """
SELECT account_id, CAST(forecast_date AS VARCHAR) AS forecast_date, predicted_net_flow, predicted_balance FROM naive"""
QUERIES["srv_anomalies"] = """
SELECT f.transaction_id, f.anomaly_score, f.reason, t.account_id, CAST(t.txn_date AS VARCHAR) AS txn_date,
       CAST(t.amount AS DOUBLE) AS amount, t.category_name
FROM distance_flags f JOIN ledger t ON t.transaction_id = f.transaction_id"""
QUERIES["srv_txn_count"] = "SELECT count(*) AS n FROM lineitem"
QUERIES["srv_category_drilldown"] = """
SELECT account_id, transaction_id, CAST(txn_date AS VARCHAR) AS txn_date, merchant_name,
       CAST(amount AS DOUBLE) AS amount, is_recurring
FROM ledger WHERE category_name = 'PROMO' AND txn_type = 'debit' AND month BETWEEN '1998-01' AND '1998-06'"""
QUERIES["srv_categories"] = "SELECT category_id, category_name FROM categories"
QUERIES["srv_merchants"] = "SELECT merchant_id, merchant_name, default_category FROM merchants"
QUERIES["srv_recent_300"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, merchant_name, category_name,
       CAST(amount AS DOUBLE) AS amount, txn_type, description, is_recurring
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY txn_date DESC, transaction_id DESC) AS rn
      FROM ledger) WHERE rn <= 300"""
QUERIES["srv_data_status"] = """
SELECT count(*) AS n, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_txn_date, true AS is_stamped
FROM lineitem"""
QUERIES["srv_access_filter"] = """
SELECT 'demo' AS username, account_id, account_name FROM accounts
UNION ALL SELECT 'nation_3', s_suppkey, s_name FROM supplier WHERE s_nationkey = 3"""
QUERIES["srv_data_status_stored"] = """
SELECT count(*) AS n, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS last_txn_date FROM lineitem"""

# --- reports in SQL with bound parameters ---
for _call, _report in (
    ("health_of", "srv_health"), ("monthly_cashflow_of", "srv_monthly"), ("category_spend_of", "srv_category_spend"),
    ("budget_vs_actual_of", "srv_budget_vs_actual"), ("recurring_of", "srv_recurring"),
    ("anomalies_of", "srv_anomalies"), ("newest_transactions", "srv_recent_300"),
):
    QUERIES[f"sql_{_call}"] = f"SELECT * FROM ({QUERIES[_report]}) WHERE account_id = 7"
QUERIES["sql_forecast_of"] = QUERIES["srv_forecast"]
QUERIES["sql_category_drilldown"] = QUERIES["srv_category_drilldown"]
QUERIES["sql_accounts_visible_to"] = """
SELECT account_id, account_name, account_type FROM accounts
WHERE account_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)"""

# --- report frames ---
QUERIES["rep_kpi"] = "SELECT account_id, current_balance, avg_daily_burn, runway_days, last_month_net FROM kpi"
QUERIES["rep_runway_status"] = """
SELECT account_id,
       CASE WHEN runway_days IS NULL THEN 'no burn detected' WHEN runway_days < 60 THEN 'below 60-day buffer'
            ELSE 'healthy buffer' END AS runway_status,
       CASE WHEN last_month_net >= 0 THEN 'inflow' ELSE 'outflow' END AS net_flow_status,
       coalesce(runway_days < 60, false) AS warn FROM kpi"""
QUERIES["rep_net_flow_sign"] = """
SELECT account_id, month, CAST(net_flow AS DOUBLE) AS net_flow,
       CASE WHEN net_flow < 0 THEN 'critical' ELSE 'good' END AS mark FROM monthly"""
QUERIES["rep_month_range"] = QUERIES["category_spend_monthly"] + " WHERE month BETWEEN '1998-11' AND '1999-03'"
QUERIES["rep_category_rollup"] = """
SELECT account_id, category_name, CAST(total AS DOUBLE) AS total_amount,
       row_number() OVER (PARTITION BY account_id ORDER BY total DESC, category_name) AS position,
       CAST(max(total) OVER (PARTITION BY account_id) AS DOUBLE) AS max_spend,
       '$' || format('{:,}', CAST(round(total, 0) AS BIGINT)) AS label
FROM (SELECT account_id, category_name, sum(total_amount) AS total FROM spend
      WHERE month BETWEEN '1998-01' AND '1998-12' GROUP BY account_id, category_name)"""
QUERIES["rep_budget_rollup"] = """
SELECT account_id, category_name, CAST(b AS DOUBLE) / 100 AS budgeted_amount, CAST(a AS DOUBLE) / 100 AS actual_amount,
       CASE WHEN a > b THEN 'over' ELSE 'within' END AS status FROM budget_totals"""
QUERIES["rep_over_budget_names"] = """
SELECT account_id, string_agg(category_name, ', ' ORDER BY b, category_name) AS over_budget
FROM budget_totals WHERE a > b GROUP BY account_id"""
QUERIES["rep_recurring_changed"] = """
SELECT account_id, string_agg(merchant_name, ', ' ORDER BY last_txn_date DESC, merchant_name) AS changed_merchants
FROM recurring WHERE typical_cents > 0 AND abs(CAST(last_amount * 100 AS BIGINT) - typical_cents) * 20 > typical_cents
GROUP BY account_id"""
TABLES["rec_latest"] = """
SELECT * FROM (SELECT *, max(month) OVER (PARTITION BY account_id) AS last_month FROM spend) WHERE month = last_month"""
TABLES["rec_over"] = """
SELECT b.account_id, b.category_name, CAST(actual_cents - budget_cents AS DOUBLE) / 100 AS savings,
       actual_amount AS spent, CAST(budget_cents AS DECIMAL(20,0)) / 100 AS budget
FROM bva b JOIN (SELECT DISTINCT account_id, month FROM rec_latest) l
  ON l.account_id = b.account_id AND l.month = b.month
WHERE actual_cents > budget_cents"""
TABLES["rec_all"] = """
SELECT account_id, category_name, 1 AS kind, savings, spent, budget FROM rec_over
UNION ALL
SELECT s.account_id, s.category_name, 2, CAST(CAST(total_amount * 100 AS BIGINT) * 15 AS DOUBLE) / 10000,
       total_amount, NULL
FROM rec_latest s WHERE category_group IN ('discretionary', 'variable_expense') AND total_amount > 0
  AND NOT EXISTS (SELECT 1 FROM rec_over o WHERE o.account_id = s.account_id AND o.category_name = s.category_name)"""
TABLES["rec_top"] = """
SELECT r.*, h.current_balance AS bal, h.avg_daily_burn AS burn, f.old_forecast_balance,
       greatest(h.avg_daily_burn - r.savings / 30, 0.0) AS new_burn,
       h.avg_daily_burn > 0 AND h.current_balance > 0 AS ok
FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY kind, savings DESC, category_name) AS position
      FROM rec_all) r
JOIN health h ON h.account_id = r.account_id
LEFT JOIN (SELECT account_id, arg_max(predicted_balance, forecast_date) AS old_forecast_balance
           FROM naive GROUP BY account_id) f ON f.account_id = r.account_id
WHERE position <= 3"""
_MONEY = "'$' || format('{{:,}}', CAST(round({}, 0) AS BIGINT))"
QUERIES["rep_recommendations"] = f"""
SELECT account_id, position, category_name,
       CASE WHEN kind = 1 THEN 'Get back to budget' ELSE 'Hypothetical: cut it by 15%' END AS action,
       savings AS monthly_savings,
       CASE WHEN ok THEN bal / burn END AS old_runway,
       CASE WHEN ok AND new_burn > 0 THEN bal / new_burn END AS new_runway,
       CASE WHEN NOT ok THEN CASE WHEN bal <= 0 THEN 'not meaningful with a negative balance'
                                  ELSE 'no burn detected' END END AS runway_na_reason,
       CASE WHEN NOT ok THEN NULL WHEN new_burn <= 0 THEN 'no longer burning cash'
            WHEN round(bal / new_burn - bal / burn) = 0 THEN 'no meaningful change'
            ELSE CASE WHEN round(bal / new_burn - bal / burn) > 0 THEN '+' ELSE '' END
                 || format('{{:,}}', CAST(round(bal / new_burn - bal / burn) AS BIGINT)) || ' days' END AS runway_change,
       old_forecast_balance, round(old_forecast_balance + savings, 4) AS new_forecast_balance,
       CASE WHEN kind = 1 THEN category_name || ' is ' || {_MONEY.format("CAST(savings AS DECIMAL(24,4))")}
                 || ' over its ' || {_MONEY.format("budget")} || ' budget this month (' || {_MONEY.format("spent")}
                 || ' spent).'
            ELSE category_name || ' is your top discretionary/variable spend this month at '
                 || {_MONEY.format("spent")} || '.' END AS headline
FROM rec_top"""

# --- anomalies ---
QUERIES["anom_input"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, category_name,
       CAST(amount AS DOUBLE) AS amount
FROM orphan_ledger WHERE txn_type = 'debit' AND category_name IN (SELECT category_name FROM categories)"""
QUERIES["anom_calendar"] = "SELECT transaction_id, day_of_week, day_of_month FROM ev_features"
QUERIES["anom_zscore"] = "SELECT transaction_id, z_amount FROM ev_features"
QUERIES["anom_same_day"] = "SELECT transaction_id, same_day FROM ev_features"
QUERIES["anom_features"] = """
SELECT transaction_id, CAST(amount AS DOUBLE) AS f0_amount, coalesce(z_amount, 0) AS f1_z_amount,
       CAST(same_day AS DOUBLE) AS f2_same_day, CAST(day_of_week AS DOUBLE) AS f3_day_of_week,
       CAST(day_of_month AS DOUBLE) AS f4_day_of_month FROM ev_features"""
QUERIES["anom_reason"] = f"SELECT transaction_id, {REASON} AS reason FROM ev_features"
QUERIES["anom_rules"] = f"""
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, z_amount, same_day, {REASON} AS reason
FROM ev_features WHERE abs(z_amount) > 2 OR same_day > 3"""
QUERIES["anom_duplicate_charges"] = """
SELECT account_id, category_name AS merchant_name, CAST(txn_date AS VARCHAR) AS txn_date,
       floor(CAST(amount AS DOUBLE)) AS amount, count(*) AS n
FROM ev GROUP BY ALL HAVING count(*) > 1"""
QUERIES["anom_small_bursts"] = """
SELECT account_id, 'any' AS category_name, CAST(txn_date AS VARCHAR) AS txn_date, count(*) AS n,
       CAST(sum(amount) AS DOUBLE) AS total
FROM ev WHERE amount <= 15 GROUP BY account_id, txn_date HAVING count(*) >= 5"""

# --- forecasts ---
QUERIES["fc_daily_net"] = """
SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, CAST(net_flow AS DOUBLE) AS net_flow FROM daily"""
QUERIES["fc_densify"] = QUERIES["fc_daily_net"].replace("FROM daily", "FROM dense")
_L = ", ".join(f"lag_{k}" for k in range(1, 8))
QUERIES["fc_lags"] = f"SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, net_flow, {_L} FROM lagged"
QUERIES["fc_calendar"] = """
SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, net_flow, dow, day_of_month FROM lagged"""
QUERIES["fc_rolling_mean"] = """
SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, net_flow, rolling_mean_7 FROM lagged"""
QUERIES["fc_dropna"] = f"""
SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, net_flow, dow, day_of_month, {_L}, rolling_mean_7
FROM lagged WHERE lag_7 IS NOT NULL"""
QUERIES["fc_min_history"] = """
SELECT account_id, greatest(n_days - 7, 0) AS n_rows
FROM (SELECT account_id, date_diff('day', min(txn_date), max(txn_date)) + 1 AS n_days FROM ev GROUP BY account_id)
WHERE n_days - 7 < 45"""
QUERIES["fc_split"] = "SELECT account_id, CAST(txn_date AS VARCHAR) AS txn_date, n_rows, is_train FROM split"
QUERIES["fc_naive_mae"] = """
SELECT account_id, CAST(sum(abs(CAST(net_flow AS DECIMAL(22,2)) - CAST(lag_7 AS DECIMAL(22,2)))) AS DOUBLE) / count(*)
         AS mae_naive
FROM split WHERE NOT is_train GROUP BY account_id"""

QUERIES["fc_gbt_fit_facts"] = """
SELECT account_id, max(n_rows) AS n_rows, round(avg(net_flow), 4) AS start, 150 AS n_trees, 150 * 7 AS n_inner,
       150 * 8 AS n_leaves FROM split GROUP BY account_id"""
QUERIES["fc_backtest_facts"] = """
SELECT account_id, round(avg(abs(net_flow - lag_7)), 6) AS mae_naive, true AS is_error, true AS agrees
FROM split WHERE NOT is_train GROUP BY account_id"""
QUERIES["fc_forecast_facts"] = """
SELECT account_id, 30 AS n, 30 AS n_days, CAST(CAST(max(txn_date) + to_days(1) AS DATE) AS VARCHAR) AS first_day,
       CAST(CAST(max(txn_date) + to_days(30) AS DATE) AS VARCHAR) AS last_day, true AS balance_follows
FROM split GROUP BY account_id"""
QUERIES["fc_write_facts"] = """
SELECT 'gbr_lag_features_v1' AS model_version, 30 * count(DISTINCT account_id) AS n,
       count(DISTINCT account_id) AS n_accounts FROM split"""
TABLES["z_scored"] = """
SELECT transaction_id, round(abs(coalesce(z_amount, 0)) / 1000, 9) AS raw_score FROM ev_features"""
QUERIES["anom_threshold_of_distance"] = """
SELECT round(max(q), 9) AS threshold, count(*) AS n, count(*) FILTER (raw_score > q) AS n_flagged
FROM z_scored, (SELECT quantile_cont(raw_score, 0.98) AS q FROM z_scored)"""
QUERIES["anom_normalize_of_distance"] = """
SELECT transaction_id, round((raw_score - lo) / (hi - lo), 4) AS anomaly_score
FROM z_scored, (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM z_scored)"""
QUERIES["anom_forest_facts"] = """
SELECT count(*) AS n, true AS scores_in_range, true AS flags_follow, 200 AS n_trees, 200 AS n_binary FROM events"""
QUERIES["run_pipeline_facts"] = """
SELECT 'accounts' AS table_name, count(*) AS n FROM raw_accounts
UNION ALL SELECT 'account_health', count(*) FROM raw_accounts
UNION ALL SELECT 'categories', count(*) FROM categories
UNION ALL SELECT 'merchants', count(*) FROM raw_merchants
UNION ALL SELECT 'raw_transactions', count(*) FROM raw_txn
UNION ALL SELECT 'checked', count(*) FROM checked
UNION ALL SELECT 'rejected', count(*) FROM checked WHERE reason_code IS NOT NULL
UNION ALL SELECT 'fct_transactions', count(*) FROM checked WHERE reason_code IS NULL
UNION ALL SELECT 'malformed_rows', 0
UNION ALL SELECT 'data_tests', 18
UNION ALL SELECT 'budgets', count(*) FROM budgets
UNION ALL SELECT 'skipped_accounts', count(*) FROM accounts WHERE account_id NOT IN (SELECT account_id FROM split)"""

# --- change sets ---
QUERIES["edit_append"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date, merchant_name, category_name,
       CAST(amount AS DOUBLE) AS amount, txn_type, description, is_recurring FROM ledger
UNION ALL
SELECT 'e-' || transaction_id, account_id, CAST(txn_date AS VARCHAR), merchant_name, category_name, CAST(amount AS DOUBLE),
       'debit', NULL, false FROM ev"""
QUERIES["edit_update_delete"] = """
SELECT transaction_id, account_id, CAST(txn_date AS VARCHAR) AS txn_date,
       CASE WHEN is_recurring THEN NULL ELSE merchant_name END AS merchant_name, category_name,
       CAST(amount AS DOUBLE) AS amount, CASE WHEN is_recurring THEN 'credit' ELSE txn_type END AS txn_type,
       description, is_recurring
FROM ledger WHERE NOT amount < 30000"""
QUERIES["edit_stored_months"] = """
SELECT transaction_id, account_id, CAST(new_date AS VARCHAR) AS txn_date, merchant_name, category_name,
       CAST(CASE WHEN early AND txn_type = 'credit' THEN amount * 2 ELSE amount END AS DOUBLE) AS amount, txn_type,
       description, is_recurring, strftime(new_date, '%Y-%m') IN (SELECT m FROM changed_months) AS rewritten
FROM moved_ledger WHERE NOT gone"""
QUERIES["edit_merchant_upsert"] = """
SELECT merchant_id, merchant_name, default_category FROM merchants
UNION ALL
SELECT md5(name), name, c FROM (SELECT 'Brand#' || merchant_name AS name, arg_min(category_name, transaction_id) AS c
                                FROM ev GROUP BY 1)
WHERE name NOT IN (SELECT merchant_name FROM merchants)"""
QUERIES["edit_category_rules"] = """
SELECT m.merchant_id, m.merchant_name, coalesce(r.c, m.default_category) AS default_category
FROM merchants m LEFT JOIN (SELECT p_brand, min(p_type) AS c FROM part WHERE p_brand >= 'Brand#2' GROUP BY p_brand) r
  ON r.p_brand = m.merchant_name"""
QUERIES["slug"] = """
SELECT account_id, trim(regexp_replace(lower(account_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM accounts"""


def complete(body: str) -> str:
    """The query with the named tables it needs, in order of need."""
    needed: list[str] = []

    def visit(text):
        for name in TABLES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(TABLES[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed) + "\n" + body


def all_sql() -> dict[str, str]:
    return {name: complete(body) for name, body in QUERIES.items()}
