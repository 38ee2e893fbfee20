"""SQL of the bridge views, for the independent oracle (DuckDB)."""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

INV = f"""inv AS (
  SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) / 1e6 AS started, 'm' || (user_id % 40) AS model,
    CASE event_type WHEN 'click' THEN '/api/chat' WHEN 'purchase' THEN '/v1/chat/completions' WHEN 'signup' THEN '/api/embed' ELSE '/api/generate' END AS endpoint,
    'c' || (user_id % 7) AS source, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS purpose, state,
    CAST(CASE state WHEN 'error' THEN 499 + event_id % 2 WHEN 'completed' THEN 200 END AS INT) AS status,
    CASE WHEN state <> 'running' THEN value END AS duration,
    CASE WHEN event_type <> 'signup' AND event_id % 97 <> 0 THEN value * 0.1::DOUBLE END AS ttft,
    CASE WHEN event_id % 11 <> 0 THEN {K} END AS prompt_tokens,
    CASE WHEN event_type <> 'signup' THEN event_id % 300 END AS generated_tokens,
    props AS request, CASE WHEN state IN ('completed', 'error') THEN 'answer ' || props END AS response,
    event_id % 13 = 0 AS truncated, CASE WHEN state = 'error' THEN 'upstream failed' END AS error, event_id AS finish_seq
  FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 97 = 0 THEN 'running' WHEN event_id % 89 = 0 THEN 'interrupted' ELSE 'completed' END AS state FROM events))"""

FIN = (
    INV
    + """, fin AS (
  SELECT *, coalesce(prompt_tokens, 0) * 1000000 AS prompt_ns, endpoint IN ('/api/chat', '/api/generate') AS has_prompt_ns,
    (finish_seq % 50) * 100000000 AS eval_ns, endpoint IN ('/api/chat', '/api/generate') AS has_eval_ns,
    (finish_seq % 7) * 10000000 AS load_ns, endpoint = '/api/chat' AS has_load_ns
  FROM inv WHERE status IS NOT NULL)"""
)

SAMPLES = """samples AS (
  SELECT event_type AS metric, CAST(user_id % 3 AS VARCHAR) AS instance, ts,
    CAST(row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY ts) % 250 AS DOUBLE) AS value FROM events)"""

GAUGES = "samples AS (SELECT event_type AS metric, CAST(user_id % 3 AS VARCHAR) AS instance, ts, value FROM events)"

LOGS = """logs AS (
  SELECT ts, event_type || ' ' || props AS line, CASE WHEN user_id % 2 = 0 THEN 'docker' ELSE 'journal' END AS source,
    CASE WHEN user_id % 2 = 0 THEN 'svc' || (user_id % 5) END AS container, CASE WHEN user_id % 2 <> 0 THEN 'unit' || (user_id % 3) END AS unit, event_id AS line_id
  FROM events)"""

RUNS = f"""runs AS (
  SELECT event_type AS phase, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seq, epoch_us(ts) / 1e6 AS started, {K} AS prompt_tokens,
    event_id % 300 AS output_tokens, CASE WHEN event_id % 17 <> 0 THEN value END AS decode_seconds, value * 1.25::DOUBLE AS wall_seconds, value * 0.1::DOUBLE AS ttft,
    CASE WHEN event_id % 13 = 0 THEN 'length' ELSE 'stop' END AS done_reason FROM events)"""

ANSWERS = """answers AS (
  SELECT item_id AS case_id, 'cat' || (item_id % 3) AS category, expected,
    CASE item_id % 4 WHEN 0 THEN '  Answer: ' || expected || '. ' WHEN 1 THEN '"' || expected || '"' WHEN 2 THEN ' ' || expected || chr(10) ELSE 'no ' || expected END AS actual
  FROM (SELECT item_id, trim(translate(text, chr(10) || chr(9), '  '), ' ') AS expected FROM benchmark))"""
