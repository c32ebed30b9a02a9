"""Check-side views: what the tables of `registry.tables` should hold, stated directly in SQL.

They spell out expected values per row variant instead of parsing text, and use joins and
ordered windows where the library uses aggregates, so they check it by another way.
"""

from spendloom.registry import tables as t
from spendloom.registry.core import VIEWS


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


MODELS, NAMES = _list(t.MODEL_IDS), _list(t.BILLING_NAMES)
CODES, REGIONS = _list(t.REGION_CODES), _list(t.REGIONS)
UNMAPPED = "('Custom22', 'Custom23', 'Custom24')"

VIEWS["lines0"] = f"""
  SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
         CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS x,
         l_partkey % 25 AS slot, l_orderkey % 8 AS v, l_shipdate AS shipped,
         '{t.ACCOUNT_HEAD}' || (l_partkey % 25 % 4) AS acct,
         {REGIONS}[l_partkey % 25 % 6 + 1] AS reg, {MODELS}[l_partkey % 25 + 1] AS mdl
  FROM lineitem"""

VIEWS["calls"] = """
  SELECT k, n, p, s, q, x, slot, v, shipped,
    'req-' || k || '-' || n AS requestid,
    shipped + INTERVAL 1 SECOND * ((k * 37 + n * 1009) % 86400) AS happened,
    strftime(shipped, '%Y-%m-%d') AS usage_date,
    acct AS accountid, reg AS region, reg AS executionregion, mdl,
    CASE v WHEN 3 THEN 'us.' || mdl WHEN 4 THEN 'global.' || mdl
      WHEN 5 THEN 'arn:aws:bedrock:us-east-1:' || acct || ':inference-profile/us.' || mdl
      WHEN 6 THEN 'arn:aws:bedrock:' || reg || '::foundation-model/' || mdl
      WHEN 7 THEN 'arn:aws:bedrock:eu-west-1:' || acct || ':inference-profile/global.' || mdl
      ELSE mdl END AS modelid,
    CASE WHEN v IN (4, 7) THEN 'global.' || mdl
      WHEN v = 6 THEN 'arn:aws:bedrock:' || reg || '::foundation-model/' || mdl ELSE mdl END AS resolvedmodelid,
    CASE WHEN v = 6 THEN 'arn:aws:bedrock:' || reg || '::foundation-model/' || mdl ELSE mdl END AS cost_model,
    CASE v WHEN 5 THEN 'us-east-1' WHEN 7 THEN 'eu-west-1' ELSE reg END AS sourceregion,
    CASE WHEN v IN (3, 5) THEN 'geo' WHEN v = 7 THEN 'global' ELSE 'none' END AS crossregiontype,
    CASE WHEN v IN (3, 5) THEN 'cross-region-geo' WHEN v IN (4, 7) THEN 'cross-region-global'
      ELSE 'none' END AS usage_cross,
    q * 10 AS inputtokens, x // 100 AS outputtokens,
    CASE WHEN n % 5 != 0 THEN x % 5000 ELSE x % 3000 END AS latencyms,
    CASE WHEN s % 10 = 0 THEN q * 2 ELSE 0 END AS cachewriteinputtokens,
    CASE WHEN s % 7 = 0 THEN x % 500 ELSE 0 END AS cachereadinputtokens,
    CASE WHEN slot = 18 THEN k % 4 + 1 END AS imagecount,
    CASE WHEN slot = 17 THEN CAST(q * 0.5 AS DOUBLE) END AS videodurationseconds,
    CASE s % 5 WHEN 0 THEN 'arn:aws:iam::' || acct || ':user/u' || s
      WHEN 1 THEN 'arn:aws:iam::' || acct || ':role/r' || s
      WHEN 2 THEN 'arn:aws:sts::' || acct || ':assumed-role/Team/s' || s
      WHEN 3 THEN 'arn:aws:sts::' || acct || ':federated-user/f' || s
      ELSE 'svc-' || s END AS callerarn,
    CASE s % 5 WHEN 0 THEN 'u' || s WHEN 1 THEN 'r' || s WHEN 2 THEN 'Team/s' || s
      WHEN 3 THEN 'federated-user/f' || s ELSE 'svc-' || s END AS resolvedusername,
    CASE k % 5 WHEN 0 THEN 'priority' WHEN 1 THEN 'flex' ELSE 'standard' END AS inferencetier,
    CASE WHEN s % 10 = 0 THEN CASE WHEN k % 5 IN (1, 2) THEN 'cacheWrite1h' ELSE 'cacheWrite5m' END
      WHEN s % 7 = 0 AND x % 500 > 0 THEN 'cacheRead' ELSE 'none' END AS cachetype,
    CASE WHEN s % 20 = 3 THEN 'agent-' || s END AS agentid,
    CASE WHEN k % 9 = 0 THEN 'guard-' || (k % 3) END AS guardrailid,
    replace(replace(CASE WHEN v IN (5, 7) THEN
        CASE v WHEN 5 THEN 'us.' ELSE 'global.' END || mdl
      WHEN v = 3 THEN 'us.' || mdl WHEN v = 4 THEN 'global.' || mdl ELSE mdl END, '.', ' '), '-', ' ')
      AS friendlymodelname
  FROM lines0"""

VIEWS["bill0"] = f"""
  SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 25 AS slot, o_orderdate AS ordered,
    strftime(o_orderdate, '%Y-%m-%d') AS usage_date, strftime(o_orderdate, '%Y-%m') AS billing_period,
    {CODES}[o_custkey % 25 % 6 + 1] AS region_code, {REGIONS}[o_custkey % 25 % 6 + 1] AS region,
    {NAMES}[o_custkey % 25 + 1] AS model_billing_name, {MODELS}[o_custkey % 25 + 1] AS model_id,
    CASE WHEN o_orderkey % 6 < 2 THEN 'input-tokens' WHEN o_orderkey % 6 < 4 THEN 'output-tokens'
      WHEN o_orderkey % 6 = 4 THEN 'cache-read-input-token-count'
      ELSE 'cache-write-input-token-count' END AS token_type,
    CASE o_orderkey // 6 % 4 WHEN 2 THEN 'cross-region-global' WHEN 3 THEN 'cross-region-geo'
      ELSE 'none' END AS cross_region_type,
    '{t.ACCOUNT_HEAD}' || (o_custkey % 25 % 4) AS account_id,
    CASE WHEN o_custkey % 25 = 18 AND o_orderkey % 2 = 0 THEN 'Images'
      WHEN o_custkey % 25 = 17 AND o_orderkey % 2 = 0 THEN 'Seconds' ELSE '1K tokens' END AS pricing_unit,
    CASE WHEN o_orderkey % 30 = 0 THEN 0.0 ELSE CAST(o_orderkey % 1000 AS DOUBLE) END AS usage_amount,
    CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice / 1000 ELSE o_totalprice / 1000 END AS unblended_cost,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL
      ELSE CAST('0.00' || (o_orderkey % 9 + 1) AS DOUBLE) END AS unit_price
  FROM orders"""

# The billing lines that count: right product, readable usage type.
VIEWS["lines"] = "SELECT * FROM bill0 WHERE k % 20 != 0 AND k % 50 != 7"

VIEWS["buckets"] = """
  SELECT *, row_number() OVER (ORDER BY usage_date, account_id, region, model_billing_name, token_type,
      cross_region_type, pricing_unit) AS bucket_id
  FROM (
    SELECT usage_date, account_id, region, model_billing_name, model_id, token_type, cross_region_type,
      pricing_unit, sum(unblended_cost) AS cost,
      CASE WHEN pricing_unit = 'Images' THEN 'imagecount'
        WHEN pricing_unit = 'Seconds' THEN 'videodurationseconds'
        WHEN token_type = 'output-tokens' THEN 'outputtokens'
        WHEN token_type = 'cache-read-input-token-count' THEN 'cachereadinputtokens'
        WHEN token_type = 'cache-write-input-token-count' THEN 'cachewriteinputtokens'
        ELSE 'inputtokens' END AS measure
    FROM lines
    GROUP BY usage_date, account_id, region, model_billing_name, model_id, token_type, cross_region_type,
      pricing_unit
    HAVING sum(unblended_cost) != 0)"""

VIEWS["usage"] = "\n  UNION ALL\n".join(
    f"""
  SELECT usage_date, accountid, executionregion AS region, cost_model AS model_id, usage_cross, callerarn AS user_id,
    resolvedusername AS user_name, '{m}' AS measure, CAST(sum({m}) AS DOUBLE) AS tokens
  FROM calls WHERE coalesce({m}, 0) > 0
  GROUP BY usage_date, accountid, executionregion, cost_model, usage_cross, callerarn, resolvedusername"""
    for m in (
        "inputtokens",
        "outputtokens",
        "cachereadinputtokens",
        "cachewriteinputtokens",
        "imagecount",
        "videodurationseconds",
    )
)

# Every usage row a bucket might take, with its priority; the best priority of a bucket wins.
VIEWS["candidates"] = """
  SELECT b.*, u.user_id, u.user_name, u.tokens, u.usage_cross,
    CASE WHEN u.usage_cross = b.cross_region_type THEN 0 WHEN u.usage_cross = 'cross-region-global' THEN 1
      ELSE 2 END AS priority
  FROM buckets b JOIN usage u ON u.usage_date = b.usage_date AND u.accountid = b.account_id
    AND u.region = b.region AND u.model_id = b.model_id AND u.measure = b.measure
    AND (u.usage_cross = b.cross_region_type OR b.cross_region_type = 'none')"""

VIEWS["matched"] = """
  SELECT * FROM candidates QUALIFY priority = min(priority) OVER (PARTITION BY bucket_id)"""

VIEWS["shares"] = """
  SELECT *, sum(tokens) OVER (PARTITION BY bucket_id) AS total,
    round(tokens / sum(tokens) OVER (PARTITION BY bucket_id) * cost, 10) AS share,
    row_number() OVER (PARTITION BY bucket_id ORDER BY user_id DESC, user_name DESC) AS from_last
  FROM matched"""

VIEWS["reconciled"] = """
  SELECT usage_date, account_id, region, model_id, model_billing_name, token_type, cross_region_type, pricing_unit,
    user_id AS resolved_user_id, user_name AS resolved_user_name, tokens AS user_tokens,
    total AS total_tokens_in_bucket, tokens / total AS proportion, cost AS bucket_unblended_cost,
    CASE WHEN from_last = 1 THEN cost - coalesce(sum(share) OVER (PARTITION BY bucket_id
        ORDER BY user_id, user_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      ELSE share END AS attributed_cost, 'reconciled' AS reconciliation_status, bucket_id
  FROM shares
  UNION ALL
  SELECT usage_date, account_id, region, model_id, model_billing_name, token_type, cross_region_type, pricing_unit,
    'UNMATCHED', 'UNMATCHED', 0.0, 0.0, 0.0, cost, cost, 'unmatched', bucket_id
  FROM buckets WHERE bucket_id NOT IN (SELECT bucket_id FROM matched)"""

# Each call with its cost: the nested joins of the dashboard query.
VIEWS["costs"] = """
  SELECT account_id, usage_date, model_id, resolved_user_id, sum(attributed_cost) AS totalcost,
    sum(CASE WHEN token_type != 'output-tokens' THEN attributed_cost ELSE 0 END) AS inputcost,
    sum(CASE WHEN token_type = 'output-tokens' THEN attributed_cost ELSE 0 END) AS outputcost,
    max(reconciliation_status) AS reconciliation_status
  FROM reconciled GROUP BY account_id, usage_date, model_id, resolved_user_id"""

VIEWS["priced"] = """
  SELECT c.*, coalesce(r.totalcost / g.n, 0) AS totalcost, coalesce(r.inputcost / g.n, 0) AS inputcost,
    coalesce(r.outputcost / g.n, 0) AS outputcost,
    coalesce(r.reconciliation_status, 'pending') AS reconciliation_status
  FROM calls c
  JOIN (SELECT accountid, usage_date, cost_model, callerarn, count(*) AS n FROM calls
        GROUP BY accountid, usage_date, cost_model, callerarn) g
    ON g.accountid = c.accountid AND g.usage_date = c.usage_date AND g.cost_model = c.cost_model
    AND g.callerarn = c.callerarn
  LEFT JOIN costs r ON r.account_id = c.accountid AND r.usage_date = c.usage_date
    AND r.model_id = c.cost_model AND r.resolved_user_id = c.callerarn"""

VIEWS["metrics"] = f"""
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {REGIONS}[user_id % 6 + 1] AS region,
    {MODELS}[user_id % 25 + 1] AS modelid, count(*) AS invocationcount, avg(value) AS invocationlatencyavg,
    quantile_cont(value, 0.99) AS invocationlatencyp99,
    count(*) FILTER (event_type = 'signup') AS throttledcount,
    count(*) FILTER (event_type = 'error') AS errorcount,
    replace(replace({MODELS}[user_id % 25 + 1], '.', ' '), '-', ' ') AS friendlymodelname
  FROM events GROUP BY 1, 2, 3, user_id % 25"""
