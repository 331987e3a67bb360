"""The queries' results in SQL, from the given tables' own columns.

Nothing here reads the JSON that the binding builds: tokens, costs, ids and
texts are derived from the given columns a second time.
"""

from __future__ import annotations

SQL: dict[str, str] = {}

CTES = {
    "sess": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey AS n,
            CASE WHEN c_custkey % 3 = 0 THEN 'about ' || c_custkey END AS summary,
            CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS title,
            CASE c_custkey % 4 WHEN 1 THEN 'model-a' WHEN 2 THEN 'model-b' WHEN 3 THEN 'model-c' END AS active_model,
            CAST(c_nationkey AS VARCHAR) AS entity_id, c_mktsegment AS group_id,
            TIMESTAMP '2023-12-01' + INTERVAL 1 DAY * (c_custkey % 60) AS created_at,
            TIMESTAMP '2023-12-01' + INTERVAL 1 DAY * (c_custkey % 60) + INTERVAL 1 HOUR * (c_custkey % 24) AS updated_at,
            CASE WHEN c_acctbal < 0 THEN 'system' ELSE 'chat' END AS interaction_kind,
            CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'csv_mapping' END AS system_source,
            CASE WHEN c_acctbal >= 0 AND c_custkey % 9 = 0 THEN 'welcome' END AS opened_by
        FROM customer""",
    "ev0": """
        SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type = 'purchase' AS llm FROM events""",
    "ev": """
        SELECT CAST(event_id AS VARCHAR) AS id, event_id + 1 AS seq, CAST(user_id AS VARCHAR) AS session_id, user_id,
            ts, k, llm,
            CASE event_type WHEN 'purchase' THEN 'llm_response' WHEN 'click' THEN 'tool_call_result'
                WHEN 'error' THEN 'llm_error'
                WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'tool_call_extracted' ELSE 'turn_start' END
                ELSE CASE WHEN k % 2 = 0 THEN 'tool_call_repair_invoked' ELSE 'retry' END END AS event_type,
            CASE WHEN k % 2 = 0 THEN k END AS duration_ms,
            CASE WHEN llm THEN k ELSE 0 END AS tokens_in,
            CASE WHEN llm THEN k // 2 ELSE 0 END AS tokens_out,
            CASE WHEN llm AND k % 4 = 0 THEN k ELSE 0 END AS cache_write,
            CASE WHEN llm AND k % 4 = 0 THEN 2 * k ELSE 0 END AS cache_read,
            CAST(CASE WHEN llm THEN value ELSE 0 END AS DECIMAL(18,2)) AS cost_in,
            CAST(CASE WHEN llm THEN k / 100.0 ELSE 0 END AS DECIMAL(18,2)) AS cost_out,
            CAST(CASE WHEN llm AND user_id % 4 <> 0 AND k % 3 = 0 THEN k END AS DECIMAL(18,2)) AS price,
            CASE WHEN llm THEN CASE k % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'none' END END AS currency
        FROM ev0""",
    "ranked": """
        SELECT *, CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS session_id,
            SUM(CASE WHEN llm THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS r,
            LAG(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before_event,
            LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before_type,
            LAG(k) OVER (PARTITION BY user_id ORDER BY event_id) AS before_k
        FROM ev0""",
    "main": """
        SELECT * FROM ranked WHERE llm AND NOT (k % 10 = 0 AND COALESCE(before_type = 'view' AND before_k % 2 = 0, false))""",
    "entries": """
        SELECT session_id, id AS response_id, i AS idx,
            CASE WHEN user_id % 6 IN (2, 3) THEN 1 ELSE 2 END AS n_entries,
            CASE user_id % 6 WHEN 3 THEN 'dup' WHEN 2 THEN 'call-1'
                ELSE 'tc-' || user_id || '-' || r || CASE i WHEN 0 THEN '' ELSE 'b' END END AS call_id,
            '{"id":"' || CASE user_id % 6 WHEN 3 THEN 'dup' WHEN 2 THEN 'call-1'
                ELSE 'tc-' || user_id || '-' || r || CASE i WHEN 0 THEN '' ELSE 'b' END END
                || CASE i WHEN 0 THEN '", "n":2.50}' ELSE '","n":1e3}' END AS entry
        FROM main, (VALUES (0), (1)) t(i)
        WHERE i = 0 OR user_id % 6 NOT IN (2, 3)""",
    "payloads": """
        SELECT id, COALESCE(CASE WHEN llm AND k % 10 = 0 THEN CAST(before_event AS VARCHAR) END, '') AS parent_id,
            CASE WHEN llm THEN '{"v":3,"tokens_in":' || k || ',"tokens_out":' || k // 2
                || CASE WHEN k % 4 = 0 THEN ',"cache_write_tokens":' || k || ',"cache_read_tokens":' || 2 * k ELSE '' END
                || ',"cost_input":' || value || ',"cost_output":' || k / 100.0::DOUBLE
                || CASE k % 5 WHEN 0 THEN ',"cost_currency":"USD"' WHEN 1 THEN ',"cost_currency":"EUR"'
                    WHEN 2 THEN ',"cost_currency":""' ELSE '' END
                || CASE WHEN user_id % 4 <> 0 AND k % 3 = 0 THEN ',"price":' || k ELSE '' END
                || ',"native_tool_calls_raw": [{"id":"' || CASE user_id % 6 WHEN 3 THEN 'dup' WHEN 2 THEN 'call-1'
                    ELSE 'tc-' || user_id || '-' || r END || '", "n":2.50}'
                || CASE WHEN user_id % 6 IN (2, 3) THEN ''
                    ELSE ',  {"id":"tc-' || user_id || '-' || r || 'b","n":1e3}' END || ']}'
            WHEN event_type IN ('click', 'signup') THEN '{"v":1,"call_id":"tr-' || k % 10 || '","status":"'
                || CASE WHEN k % 3 = 0 THEN 'error' ELSE 'ok' END || '"}'
            WHEN event_type = 'error' THEN '{"response_body_excerpt":"' || repeat('x', 4 * k) || '"}'
            ELSE '{"v":1}' END AS payload
        FROM ranked""",
    "msg": """
        SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn, turn + 1 AS seq, role, text AS content,
            CASE WHEN role = 'user' AND turn % 2 = 0 THEN 'tr-' || turn END AS tool_call_id,
            CASE WHEN (conv_id + turn) % 5 = 2 THEN '{"prompt_type": "confirm", "n":' || turn || '.50}' END AS metadata,
            CASE WHEN role = 'system' THEN 'hidden' END AS visibility,
            TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (4 * turn) + INTERVAL 1 MINUTE * conv_id AS created_at
        FROM conversations""",
    "stored": """
        SELECT session_id, seq, ord, call_id, n_ids FROM (
            SELECT session_id, seq, 0 AS ord, CASE conv_id % 6 WHEN 2 THEN 'call-1' WHEN 3 THEN 'dup'
                ELSE 'tc-' || conv_id || '-' || turn END AS call_id,
                CASE WHEN conv_id % 6 IN (1, 5) THEN 2 ELSE 1 END AS n_ids
            FROM msg WHERE role = 'assistant' AND conv_id % 6 <> 4
            UNION ALL
            SELECT session_id, seq, 1, CASE conv_id % 6 WHEN 5 THEN 'gone' ELSE 'tc-' || conv_id || '-' || turn || 'b' END, 2
            FROM msg WHERE role = 'assistant' AND conv_id % 6 IN (1, 5))""",
    "attributed": """
        SELECT s.session_id, s.seq, s.n_ids, s.ord, e.response_id, e.idx, e.n_entries, e.entry
        FROM stored s JOIN entries e USING (session_id, call_id)
        WHERE s.call_id <> 'call-1'
          AND (SELECT COUNT(*) FROM entries x WHERE x.session_id = s.session_id AND x.call_id = s.call_id) = 1
          AND (SELECT COUNT(*) FROM stored x WHERE x.session_id = s.session_id AND x.call_id = s.call_id) = 1""",
    "served": """
        SELECT session_id, seq, ANY_VALUE(n_ids) AS n_ids, MIN(response_id) AS response_id,
            MIN(n_entries) = COUNT(*) AND BOOL_AND(idx = ord) AS is_whole,
            CASE WHEN MIN(n_entries) = COUNT(*) AND BOOL_AND(idx = ord)
                THEN '[' || STRING_AGG(entry, ',  ' ORDER BY ord) || ']'
                ELSE '[' || STRING_AGG(entry, ',' ORDER BY ord) || ']' END AS tool_calls
        FROM attributed GROUP BY session_id, seq HAVING COUNT(*) = ANY_VALUE(n_ids)""",
    "errs": """
        SELECT session_id, seq AS event_seq, ts, CASE WHEN k BETWEEN 1 AND 50 THEN '[LLM error] ' || repeat('x', 4 * k)
            ELSE '[LLM error] The request could not be completed.' END AS content, repeat('x', 4 * k) AS excerpt
        FROM ev WHERE event_type = 'llm_error'""",
    "usage": """
        SELECT o_orderkey AS n, o_orderpriority AS group_id, CAST(o_custkey AS VARCHAR) AS entity_id,
            CASE o_orderstatus WHEN 'F' THEN 'chat' WHEN 'O' THEN 'system' ELSE 'job' END AS kind,
            CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS price,
            o_orderdate AS created_at
        FROM orders""",
    "positions": """
        SELECT CAST(c_custkey AS VARCHAR) AS session_id, c_custkey * 37 AS since_seq FROM customer
        UNION ALL
        SELECT 'nobody-' || c_custkey, 0 FROM customer WHERE c_custkey % 100 = 0""",
    "debug": """
        SELECT CAST(page_id AS VARCHAR) AS id, CAST(page_id % 10 AS VARCHAR) AS session_id,
            CASE WHEN page_id % 4 <> 0 THEN 'tr-' || page_id ELSE '' END AS trace_id,
            TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (page_id // 40) AS ts,
            CASE (page_id // 10) % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'response' ELSE 'error' END AS direction,
            CASE (page_id // 10) % 3 WHEN 1 THEN 200 ELSE 0 END AS status,
            CASE WHEN page_id % 7 <> 0 THEN url ELSE '' END AS url, html AS body
        FROM pages""",
}

NEEDS = {
    "ev": ["ev0"], "ranked": ["ev0"], "main": ["ranked"], "payloads": ["ranked"], "entries": ["main"], "stored": ["msg"],
    "attributed": ["entries", "stored"], "served": ["attributed"], "errs": ["ev"],
}


def _with(names: list[str], body: str, extra: str = "") -> str:
    """The statement with the named tables, and those they need, in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in ordered] + ([extra] if extra else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def sql(name: str, tables: str, body: str, extra: str = "") -> None:
    SQL[name] = _with(tables.split(), body, extra)


def at(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


STATS = """
    CAST(COUNT(*) FILTER (WHERE e.event_type = 'llm_response') AS BIGINT) AS llm_call_count,
    CAST(COUNT(*) FILTER (WHERE e.event_type = 'tool_call_result') AS BIGINT) AS tool_call_count,
    CAST(COALESCE(SUM(e.tokens_in), 0) AS BIGINT) AS tokens_in_total,
    CAST(COALESCE(SUM(e.tokens_out), 0) AS BIGINT) AS tokens_out_total,
    CAST(COALESCE(SUM(e.cache_write), 0) AS BIGINT) AS cache_write_tokens_total,
    CAST(COALESCE(SUM(e.cache_read), 0) AS BIGINT) AS cache_read_tokens_total,
    CAST(COALESCE(SUM(e.cost_in), 0) AS DOUBLE) AS cost_input_total,
    CAST(COALESCE(SUM(e.cost_out), 0) AS DOUBLE) AS cost_output_total,
    CAST(SUM(e.price) AS DOUBLE) AS price_total"""
COSTS = """
    CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'USD') AS DOUBLE) AS cost_usd,
    CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'EUR') AS DOUBLE) AS cost_eur,
    CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'none') AS DOUBLE) AS cost_none,
    COUNT(DISTINCT e.currency) AS n_currencies"""
COST_TOTAL = "CAST(COALESCE(SUM(e.cost_in + e.cost_out), 0) AS DOUBLE)"
LEFT = "FROM sess s LEFT JOIN ev e ON e.session_id = s.id"
INNER = "FROM sess s JOIN ev e ON e.session_id = s.id"
GROUP = "s.group_id = 'BUILDING'"
WINDOW = "e.ts >= TIMESTAMP '2024-01-05' AND e.ts < TIMESTAMP '2024-01-20'"
COUNTS = "COUNT(DISTINCT s.id) AS session_count, COUNT(e.id) AS event_count"

# --- sources and sinks
sql("src_tables", "", """
    SELECT 'sessions' AS table_name, COUNT(*) AS n_rows FROM customer
    UNION ALL SELECT 'messages', COUNT(*) FROM conversations
    UNION ALL SELECT 'session_events', COUNT(*) FROM events
    UNION ALL SELECT 'prompt_snapshots', COUNT(DISTINCT text) FROM documents
    UNION ALL SELECT 'ai_debug_events', COUNT(*) FROM pages
    UNION ALL SELECT 'profile_usage', COUNT(*) FROM orders""")
EVENT = f"id, session_id, seq, {at('ts')} AS ts, event_type, '' AS parent_id, COALESCE(duration_ms, 0) AS duration_ms"
sql("events_no_payload", "ev", f"SELECT {EVENT} FROM ev")
RENAMES = """renames AS (
    SELECT c_custkey * 2 AS n, c_custkey AS seq, CASE c_custkey % 5 WHEN 0 THEN 'New name ' || c_custkey
        WHEN 1 THEN '' WHEN 2 THEN repeat('é', 200) ELSE repeat('é', 201) END AS title FROM customer
    UNION ALL
    SELECT c_custkey * 2, c_custkey + 1000000000, 'Later ' || c_custkey FROM customer WHERE c_custkey % 10 = 0)"""
sql("rename_apply", "sess", f"""
    SELECT s.id, COALESCE(r.title, s.title) AS title,
        CASE WHEN r.title IS NULL THEN {at('s.updated_at')} ELSE '2024-06-01 00:00:00.000000' END AS updated_at
    FROM sess s LEFT JOIN (
        SELECT n, arg_max(title, seq) AS title FROM renames WHERE length(title) BETWEEN 1 AND 200 GROUP BY n) r
        ON r.n = s.n""", RENAMES)
sql("rename_rejects", "sess", """
    SELECT CAST(r.n AS VARCHAR) AS id, r.seq, length(r.title) AS n_chars,
        CASE WHEN r.title = '' THEN 'empty title' WHEN length(r.title) > 200 THEN 'title too long'
            ELSE 'unknown session' END AS reason
    FROM renames r LEFT JOIN sess s ON s.n = r.n
    WHERE s.n IS NULL OR length(r.title) NOT BETWEEN 1 AND 200""", RENAMES)
sql("export_sessions", "sess ev", """
    SELECT '{"id":"' || id || '"'
        || ',"entity_id":"' || entity_id || '"' || ',"group_id":"' || group_id || '"'
        || COALESCE(',"title":"' || title || '"', '') || COALESCE(',"summary":"' || summary || '"', '')
        || COALESCE(',"active_model":"' || active_model || '"', '')
        || ',"created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '"'
        || ',"interaction_kind":"' || interaction_kind || '"'
        || ',"system_source":"' || COALESCE(system_source, '') || '"'
        || ',"opened_by":"' || COALESCE(opened_by, '') || '"'
        || ',"llm_call_count":' || n_calls
        || ',"price_total":' || COALESCE(CAST(price / 8 AS VARCHAR), 'null')
        || ',"cost_by_currency":{' || concat_ws(',', '"EUR":' || eur, '"USD":' || usd, '"none":' || none) || '}'
        || '}' AS json
    FROM sess JOIN (
        SELECT e.session_id AS id, COUNT(*) FILTER (WHERE e.llm) AS n_calls, CAST(SUM(e.price) AS DOUBLE) AS price,
            CAST(CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'EUR') AS DOUBLE) AS VARCHAR) AS eur,
            CAST(CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'USD') AS DOUBLE) AS VARCHAR) AS usd,
            CAST(CAST(SUM(e.cost_in + e.cost_out) FILTER (WHERE e.currency = 'none') AS DOUBLE) AS VARCHAR) AS none
        FROM ev e GROUP BY e.session_id) t USING (id)""")

# --- filters
for _name, _where in {
    "f_entity": "entity_id = '7'", "f_group": "group_id = 'BUILDING'",
    "f_include": "entity_id IN ('1', '2', '3', '5')",
    "f_exclude": "group_id = 'BUILDING' AND entity_id NOT IN ('1', '2', '3')",
    "f_kind": "interaction_kind = 'system'", "f_system_source": "system_source = 'csv_mapping'",
    "f_opened_by": "opened_by = 'welcome'",
    "f_title": "interaction_kind = 'chat' AND contains(lower(title), 'stomer#00000001')",
}.items():
    sql(_name, "sess", f"SELECT id FROM sess WHERE {_where}")
for _name, _way, _sign in (("f_include_table", "IN", ">"), ("f_exclude_table", "NOT IN", "<")):
    sql(_name, "", f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
        WHERE CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END {_way} (SELECT c_custkey FROM customer WHERE c_acctbal {_sign} 0)""")
sql("f_time_window", "ev", f"SELECT id, {at('ts')} AS ts FROM ev e WHERE {WINDOW}")
sql("f_event_type", "ev", "SELECT id FROM ev WHERE event_type = 'llm_error'")
sql("f_session", "ev", "SELECT id, session_id FROM ev WHERE session_id = '7'")
sql("f_visible_messages", "msg", "SELECT session_id, seq, role FROM msg WHERE role <> 'system'")
sql("f_after_seq", "ev positions", """
    SELECT e.session_id, e.seq, e.id FROM ev e JOIN positions p USING (session_id) WHERE e.seq > p.since_seq""")
sql("f_keyset", "sess", f"""
    SELECT id, {at('created_at')} AS created_at FROM sess
    WHERE (created_at, id) < (TIMESTAMP '2023-12-20', '5')""")
sql("f_json_array_has", "", """
    SELECT c_custkey, c_custkey % 7 <> 0 AND (c_custkey % 3 = 2 OR c_custkey % 5 = 2) AS has_t2 FROM customer""")

# --- projections
sql("session_rows", "sess", f"""
    SELECT id, entity_id, group_id, COALESCE(title, '') AS title, COALESCE(summary, '') AS summary,
        COALESCE(active_model, '') AS active_model, interaction_kind, COALESCE(system_source, '') AS system_source,
        COALESCE(opened_by, '') AS opened_by, {at('created_at')} AS created_at, {at('updated_at')} AS updated_at
    FROM sess""")
sql("event_rows", "ev payloads", f"""
    SELECT {EVENT}, regexp_replace(payload, ',"native_tool_calls_raw".*', '}}') AS payload
    FROM ev JOIN (SELECT id, payload FROM payloads) USING (id)""")
sql("payload_fields", "ev", """
    SELECT id, tokens_in, tokens_out, cache_write AS cache_write_tokens, cache_read AS cache_read_tokens,
        CAST(cost_in AS DOUBLE) AS cost_input, CAST(cost_out AS DOUBLE) AS cost_output,
        CAST(price AS DOUBLE) AS price, currency AS cost_currency FROM ev""")
sql("session_metadata", "", """
    SELECT CAST(c_custkey AS VARCHAR) AS id, t.name,
        CASE t.name WHEN 'channel' THEN 'c' || c_custkey % 3 ELSE CAST(c_custkey % 7 AS VARCHAR) END AS value
    FROM customer, (VALUES ('channel'), ('n')) t(name) WHERE c_custkey % 11 <> 0 AND c_custkey % 4 <> 0""")

# --- joins
sql("join_left_scope", "sess ev", f"SELECT s.id, e.id AS event_id, e.event_type {LEFT} WHERE {GROUP}")
sql("join_inner_scope", "sess ev", f"SELECT s.id, e.id AS event_id, e.event_type {LEFT} WHERE {GROUP} AND {WINDOW}")
sql("events_scoped", "sess ev", f"SELECT e.id, e.session_id, {at('e.ts')} AS ts {INNER} WHERE {GROUP} AND {WINDOW}")
sql("events_orphans", "sess ev", f"""
    SELECT e.id, 'no filter' AS scope FROM ev e WHERE {WINDOW}
    UNION ALL
    SELECT e.id, 'kind' {INNER} WHERE s.n % 3 <> 0 AND s.interaction_kind = 'chat' AND {WINDOW}""")
sql("currency_for_page", "sess ev", """
    SELECT e.session_id, e.currency, CAST(SUM(e.cost_in + e.cost_out) AS DOUBLE) AS cost
    FROM ev e WHERE e.llm AND e.session_id IN (
        SELECT s.id FROM sess s LEFT JOIN ev x ON x.session_id = s.id GROUP BY s.id
        ORDER BY COALESCE(SUM(x.cost_in + x.cost_out), 0) DESC, s.id DESC LIMIT 50)
    GROUP BY e.session_id, e.currency""")
sql("session_presence", "sess ev positions", """
    SELECT p.session_id, p.since_seq, COUNT(e.id) AS n_new,
        CASE WHEN ANY_VALUE(s.id) IS NULL THEN 'unknown' WHEN COUNT(e.id) = 0 THEN 'caught_up' ELSE 'has_rows' END AS state
    FROM positions p LEFT JOIN sess s ON s.id = p.session_id
        LEFT JOIN ev e ON e.session_id = p.session_id AND e.seq > p.since_seq
    GROUP BY p.session_id, p.since_seq""")
sql("main_loop_responses", "main", "SELECT session_id, id FROM main")
sql("tool_call_rows", "served", """
    SELECT session_id, seq, CAST(n_ids AS BIGINT) AS n_ids, is_whole, response_id FROM served""")
sql("tool_calls_text", "served", "SELECT session_id, seq, tool_calls FROM served")
sql("tool_result_pairs", "ev msg", """
    SELECT m.session_id, m.seq AS message_seq, m.tool_call_id AS call_id,
        COUNT(*) FILTER (WHERE e.event_type = 'tool_call_extracted') AS n_extracted,
        COUNT(*) FILTER (WHERE e.event_type = 'tool_call_result') AS n_results,
        arg_min(e.id, e.seq) FILTER (WHERE e.event_type = 'tool_call_extracted') AS extracted_id,
        arg_min(e.id, e.seq) FILTER (WHERE e.event_type = 'tool_call_result') AS result_id,
        arg_min(CASE WHEN e.k % 3 = 0 THEN 'error' ELSE 'ok' END, e.seq)
            FILTER (WHERE e.event_type = 'tool_call_result') AS result_status
    FROM msg m JOIN ev e ON e.session_id = m.session_id AND 'tr-' || e.k % 10 = m.tool_call_id
        AND e.event_type IN ('tool_call_extracted', 'tool_call_result')
    GROUP BY m.session_id, m.seq, m.tool_call_id""")
sql("tool_result_events", "ev msg", """
    SELECT m.session_id, m.seq AS message_seq, m.tool_call_id AS call_id, e.seq AS event_seq, e.id AS event_id, e.event_type,
        CASE WHEN e.k % 3 = 0 THEN 'error' ELSE 'ok' END AS status
    FROM msg m JOIN ev e ON e.session_id = m.session_id AND 'tr-' || e.k % 10 = m.tool_call_id
        AND e.event_type IN ('tool_call_extracted', 'tool_call_result')""")
sql("prompt_resolve", "", """
    SELECT r.sha256, r.n_refs, p.source IS NOT NULL AS is_found, p.source AS kind, length(p.text) AS n_chars, md5(p.text) AS content_md5
    FROM (SELECT CASE WHEN doc_id % 4 = 0 THEN sha256(text || '?') ELSE sha256(text) END AS sha256, COUNT(*) AS n_refs
          FROM documents GROUP BY 1) r
    LEFT JOIN (SELECT sha256(text) AS sha256, arg_min(source, doc_id) AS source, arg_min(text, doc_id) AS text
          FROM documents GROUP BY 1) p USING (sha256)""")

# --- aggregations
sql("agg_count_type", "ev", """
    SELECT session_id, COUNT(*) FILTER (WHERE event_type = 'llm_response') AS llm_call_count,
        COUNT(*) FILTER (WHERE event_type = 'tool_call_result') AS tool_call_count FROM ev GROUP BY session_id""")
sql("agg_tokens", "ev", """
    SELECT session_id, CAST(SUM(tokens_in) AS BIGINT) AS tokens_in_total, CAST(SUM(tokens_out) AS BIGINT) AS tokens_out_total
    FROM ev GROUP BY session_id""")
sql("agg_cost", "ev", """
    SELECT session_id, CAST(SUM(cost_in) AS DOUBLE) AS cost_input_total, CAST(SUM(cost_out) AS DOUBLE) AS cost_output_total
    FROM ev GROUP BY session_id""")
sql("agg_price", "ev", "SELECT session_id, CAST(SUM(price) AS DOUBLE) AS price_total FROM ev GROUP BY session_id")
sql("session_stats", "sess ev", f"SELECT s.id, {STATS} {LEFT} GROUP BY s.id")
sql("session_stats_window", "sess ev", f"SELECT s.id, {STATS} {LEFT} WHERE {GROUP} AND {WINDOW} GROUP BY s.id")
sql("session_stats_star", "", f"""
    SELECT CAST(o.o_orderkey AS VARCHAR) AS id, {STATS} FROM orders o LEFT JOIN (
        SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'llm_response' WHEN 'A' THEN 'tool_call_result' END AS event_type,
            l_returnflag = 'R' AS llm, CASE WHEN llm THEN CAST(l_quantity AS BIGINT) END AS tokens_in, 0 AS tokens_out,
            0 AS cache_write, 0 AS cache_read, CASE WHEN llm THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS cost_in,
            CASE WHEN llm THEN CAST(l_discount AS DECIMAL(18,2)) END AS cost_out,
            CASE WHEN llm AND l_linenumber = 1 THEN CAST(0.5 AS DECIMAL(18,2)) END AS price
        FROM lineitem) e ON e.l_orderkey = o.o_orderkey
    GROUP BY o.o_orderkey""")
sql("session_totals", "sess ev", f"SELECT COUNT(DISTINCT s.id) AS session_count, {STATS} {LEFT} WHERE {GROUP}")
sql("event_totals", "sess ev", f"SELECT {COUNTS}, {STATS} {LEFT} WHERE {WINDOW}")
sql("event_totals_by_filter_type", "sess ev", f"""
    SELECT {COUNTS}, {STATS} {LEFT} WHERE {GROUP} AND e.event_type = 'tool_call_result'""")
sql("currency_total", "sess ev", f"""
    SELECT e.currency, CAST(SUM(e.cost_in + e.cost_out) AS DOUBLE) AS cost {INNER} WHERE e.llm AND {GROUP} GROUP BY 1""")
sql("currency_by_session", "sess ev", f"""
    SELECT e.session_id, e.currency, CAST(SUM(e.cost_in + e.cost_out) AS DOUBLE) AS cost {INNER}
    WHERE e.llm AND {WINDOW} GROUP BY 1, 2""")
DAY = "strftime(date_trunc('{}', e.ts), '%Y-%m-%d')"
sql("currency_by_bucket", "sess ev", f"""
    SELECT {DAY.format('week')} AS bucket, e.currency, CAST(SUM(e.cost_in + e.cost_out) AS DOUBLE) AS cost {INNER}
    WHERE e.llm AND {GROUP} GROUP BY 1, 2""")
sql("currency_map", "ev", f"SELECT e.session_id, {COSTS} FROM ev e GROUP BY e.session_id")
sql("by_event_type", "sess ev", f"""
    SELECT e.event_type, COUNT(*) AS event_count, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, e.event_type) AS pos
    {INNER} WHERE {GROUP} GROUP BY e.event_type""")
for _g in ("day", "week", "month", "year"):
    sql(f"buckets_{_g}", "sess ev", f"SELECT {DAY.format(_g)} AS bucket, {COUNTS}, {STATS} {INNER} WHERE {GROUP} GROUP BY 1")
sql("stats_rollup_day", "sess ev", f"""
    SELECT {DAY.format('day')} AS bucket, CAST(0 AS BIGINT) AS is_total, {COUNTS}, {STATS} {INNER} WHERE {WINDOW} GROUP BY 1
    UNION ALL SELECT NULL, 1, {COUNTS}, {STATS} {INNER} WHERE {WINDOW}""")
sql("rollup_buckets_week", "sess ev", f"SELECT {DAY.format('week')} AS bucket, {COUNTS}, {STATS} {INNER} WHERE {GROUP} GROUP BY 1")
sql("rollup_totals_day", "sess ev", f"""
    SELECT {DAY.format('day')} AS bucket, CAST(0 AS BIGINT) AS is_total, {COUNTS}, {STATS} {INNER} GROUP BY 1
    UNION ALL SELECT NULL, 1, {COUNTS}, {STATS} {INNER}""")
SINCE = "TIMESTAMP '1997-06-01'"
sql("budget_total", "usage", f"""
    SELECT group_id, CAST(SUM(price) AS DOUBLE) AS price_total FROM usage
    WHERE kind = 'chat' AND created_at >= {SINCE} GROUP BY group_id""")
sql("budget_by_entity", "usage", f"""
    SELECT group_id, entity_id, CAST(SUM(price) AS DOUBLE) AS price_total FROM usage
    WHERE kind IN ('system', 'job') AND created_at >= {SINCE} GROUP BY group_id, entity_id""")
sql("budget_rules", "usage", """
    SELECT r.rule_id, r.group_id, r.entity_id, CAST(COALESCE(SUM(u.price), 0) AS DOUBLE) AS price_total,
        COALESCE(SUM(u.price), 0) >= 1000000 AS is_used_up
    FROM rules r LEFT JOIN usage u ON u.group_id = r.group_id AND u.created_at >= r.since
        AND (r.entity_id IS NULL OR r.entity_id = u.entity_id)
        AND ((r.jobs AND u.kind IN ('system', 'job')) OR (NOT r.jobs AND u.kind = 'chat'))
    GROUP BY r.rule_id, r.group_id, r.entity_id""", """rules AS (
    SELECT o_orderkey AS rule_id, o_orderpriority AS group_id,
        CASE WHEN o_orderkey % 100 = 0 THEN CAST(o_custkey AS VARCHAR) END AS entity_id, o_orderkey % 150 = 0 AS jobs,
        TIMESTAMP '1997-01-01' + INTERVAL 1 SECOND * (o_orderkey % 8 * 15778800) AS since
    FROM orders WHERE o_orderkey % 50 = 0)""")
sql("last_activity", "ev", f"""
    SELECT event_type, session_id, COUNT(*) AS event_count, {at('MAX(ts)')} AS last_ts FROM ev e WHERE {WINDOW} GROUP BY 1, 2""")
sql("stats_after_key", "sess ev", f"""
    SELECT s.id, {COST_TOTAL} AS cost_total {LEFT} GROUP BY s.id
    HAVING COALESCE(SUM(e.cost_in + e.cost_out), 0) < 100.5
        OR (COALESCE(SUM(e.cost_in + e.cost_out), 0) = 100.5 AND s.id < '3')""")

# --- windows
sql("sample_sessions", "sess ev", f"""
    SELECT event_type, rank, session_id, {at('last_ts')} AS last_ts FROM (
        SELECT e.event_type, e.session_id, MAX(e.ts) AS last_ts,
            ROW_NUMBER() OVER (PARTITION BY e.event_type ORDER BY MAX(e.ts) DESC, e.session_id) AS rank
        {INNER} WHERE {GROUP} GROUP BY 1, 2) WHERE rank <= 5""")
sql("error_rows", "errs", f"""
    SELECT session_id, event_seq, CAST(0 AS BIGINT) AS seq, 'error' AS role, content, {at('ts')} AS created_at, excerpt FROM errs""")


def _transcript(columns: str, shown: str) -> str:
    return f"""
    SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY key, is_error, own) AS pos, {columns} FROM (
        SELECT session_id, seq AS own, seq, 0 AS is_error, role, content, tool_call_id, metadata, visibility, created_at,
            MAX(created_at) OVER (PARTITION BY session_id ORDER BY seq) AS key FROM msg WHERE {shown}
        UNION ALL
        SELECT session_id, event_seq, 0, 1, 'error', content, NULL, NULL, NULL, ts,
            MAX(ts) OVER (PARTITION BY session_id ORDER BY event_seq) FROM errs)"""


sql("transcript", "msg errs", _transcript(
    f"seq, role, content, tool_call_id, metadata, visibility, {at('created_at')} AS created_at", "role <> 'system'"))
sql("transcript_hidden", "msg errs", _transcript(
    f"seq, role, visibility, {at('created_at')} AS created_at", "true"))


# --- sorts and pages
def _top(name: str, value: str, way: str, n: int, where: str = "true", published: str = "v") -> None:
    sql(name, "sess ev", f"""
        SELECT ROW_NUMBER() OVER (ORDER BY v {way}, id {way}) AS pos, id, {published} AS sort_value
        FROM (SELECT s.id, {value} AS v {LEFT} WHERE {where} GROUP BY s.id ORDER BY v {way}, s.id {way} LIMIT {n})""")


_top("top_created_at", "ANY_VALUE(s.created_at)", "DESC", 200, published=at("v"))
_top("top_updated_at", "ANY_VALUE(s.updated_at)", "ASC", 200, published=at("v"))
_top("top_active_model", "COALESCE(ANY_VALUE(s.active_model), '')", "ASC", 200)
_top("top_cost_total", COST_TOTAL, "DESC", 200)
_top("top_llm_calls", "COUNT(*) FILTER (WHERE e.llm)", "DESC", 200, GROUP)
_top("top_tool_calls", "COUNT(*) FILTER (WHERE e.event_type = 'tool_call_result')", "ASC", 200, WINDOW)
_top("top_tokens_in", "CAST(COALESCE(SUM(e.tokens_in), 0) AS BIGINT)", "DESC", 200)
_top("top_tokens_out", "CAST(COALESCE(SUM(e.tokens_out), 0) AS BIGINT)", "DESC", 200)


def _page(name: str, value: str, way: str, n: int, columns: str, where: str = "true", after: str = "true") -> None:
    sql(name, "sess ev", f"""
        SELECT pos, id, {columns} pos = {n} AND total > {n} AS is_boundary FROM (
            SELECT *, ROW_NUMBER() OVER (ORDER BY v {way}, id {way}) AS pos, COUNT(*) OVER () AS total FROM (
                SELECT s.id, ANY_VALUE(s.active_model) AS active_model, {value} AS v {LEFT} WHERE {where} GROUP BY s.id)
            WHERE {after}) WHERE pos <= {n}""")


_page("page_by_model", "COALESCE(ANY_VALUE(s.active_model), '')", "DESC", 100, "active_model,",
      after="(v, id) < ('model-b', '50')")
_page("page_by_cost", COST_TOTAL, "ASC", 100, "v AS cost_total,", after="(v, id) > (0, '500')")
_page("page_boundary", "COALESCE(SUM(e.tokens_in), 0)", "DESC", 25, "", where="s.interaction_kind = 'system'")
_NULLED = "(SELECT id, CASE WHEN n % 3 <> 0 THEN created_at END AS c FROM sess)"
_TURNED = " UNION ALL ".join(f"""
    SELECT '{_w}' AS way, pos, id, {at('c')} AS created_at, pos = 100 AND total > 100 AS is_boundary FROM (
        SELECT *, ROW_NUMBER() OVER (ORDER BY c {_w} NULLS {_nulls}, id {_w}) AS pos, COUNT(*) OVER () AS total
        FROM {_NULLED} WHERE {_after}) WHERE pos <= 100""" for _w, _nulls, _after in (
    ("asc", "FIRST", "c IS NOT NULL OR id > '50'"), ("desc", "LAST", "c IS NULL AND id < '50'")))
sql("page_null_keys", "sess", _TURNED)
sql("page_index", "sess ev", f"""
    SELECT pos // 25 AS page, pos, id, v AS sort_value FROM (
        SELECT id, v, ROW_NUMBER() OVER (ORDER BY v DESC, id DESC) AS pos FROM (
            SELECT s.id, CAST(COALESCE(SUM(e.tokens_in), 0) AS BIGINT) AS v {LEFT} GROUP BY s.id)) WHERE pos % 25 = 0""")
EVENT_PAGE = """SELECT pos, id, session_id, seq, {ts} AS ts, {columns}, pos = {n} AND total > {n} AS is_boundary FROM (
    SELECT e.*, ROW_NUMBER() OVER (ORDER BY e.ts DESC, e.id DESC) AS pos, COUNT(*) OVER () AS total {rows}) WHERE pos <= {n}"""
sql("events_page", "sess ev", EVENT_PAGE.format(
    ts=at("ts"), columns="event_type", n=200, rows=f"{INNER} WHERE {GROUP} AND e.ts < TIMESTAMP '2024-01-20'"))
sql("tail_events", "ev positions", """
    SELECT session_id, pos, seq, id, n > 20 AS has_more FROM (
        SELECT e.*, ROW_NUMBER() OVER (PARTITION BY e.session_id ORDER BY e.seq) AS pos,
            COUNT(*) OVER (PARTITION BY e.session_id) AS n
        FROM ev e JOIN positions p USING (session_id) WHERE e.seq > p.since_seq) WHERE pos <= 20""")
sql("debug_replay", "debug", f"""
    SELECT session_id, pos, id, trace_id, {at('ts')} AS ts, direction, CAST(status AS BIGINT) AS status, url, md5(body) AS body_md5,
        n > 20 AS has_more
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ts, id) AS pos,
        COUNT(*) OVER (PARTITION BY session_id) AS n FROM debug) WHERE pos <= 20""")
sql("tail_events_whole", "ev positions", """
    SELECT session_id, ROW_NUMBER() OVER (PARTITION BY e.session_id ORDER BY e.seq) AS pos, seq, id, false AS has_more
    FROM ev e JOIN positions p USING (session_id) WHERE e.seq > p.since_seq""")
sql("debug_replay_whole", "debug", """
    SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ts, id) AS pos, id, direction,
        md5(body) AS body_md5, false AS has_more FROM debug""")
sql("debug_pairs", "debug", """
    SELECT session_id, id AS response_id, CASE WHEN before_direction = 'request' THEN before_id END AS request_id FROM (
        SELECT *, LAG(id) OVER w AS before_id, LAG(direction) OVER w AS before_direction
        FROM debug WINDOW w AS (PARTITION BY session_id ORDER BY ts, id)) WHERE direction = 'response'""")
sql("session_event_log", "ev", f"""
    SELECT session_id, seq, id, {at('ts')} AS ts, event_type, COALESCE(duration_ms, 0) AS duration_ms FROM ev""")

# --- scalar functions
sql("fn_json_int", "ev0", "SELECT event_id, CASE WHEN k % 6 < 3 THEN k ELSE 0 END AS n FROM ev0")
NUMBER = "CASE k % 5 WHEN 0 THEN k + CAST(0.25 AS DOUBLE) WHEN 1 THEN k + CAST(0.5 AS DOUBLE) END"
sql("fn_json_double", "ev0", f"SELECT event_id, COALESCE({NUMBER}, 0) AS x FROM ev0")
sql("fn_json_double_null", "ev0", f"SELECT event_id, {NUMBER} AS x FROM ev0")
sql("fn_json_text", "ev0", "SELECT event_id, CASE WHEN k % 4 = 0 THEN 'v' || k END AS t FROM ev0")
sql("fn_date_bucket", "ev", "SELECT id, " + ", ".join(
    f"{DAY.format(g)} AS \"{g}\"" for g in ("day", "week", "month", "year")) + " FROM ev e")
sql("bucket_scaffold", "ev", f"""
    SELECT strftime(b.start, '%Y-%m-%d') AS bucket, COUNT(e.id) AS n_events
    FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-02-02', INTERVAL 7 DAY)) AS start) b
    LEFT JOIN ev e ON date_trunc('week', e.ts) = b.start GROUP BY 1""")


def _filled(name: str, unit: str, first: str, last: str, since: str, until: str) -> None:
    sql(name, "sess ev", f"""
        SELECT strftime(b.start, '%Y-%m-%d') AS bucket, {COUNTS.replace('s.id', 'e.session_id')}, {STATS}, {COSTS}
        FROM (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 {unit})) AS start) b
        LEFT JOIN (SELECT e.* {INNER} WHERE {GROUP} AND e.ts >= TIMESTAMP '{since}' AND e.ts < TIMESTAMP '{until}') e
            ON date_trunc('{unit}', e.ts) = b.start GROUP BY 1""")


_filled("buckets_filled_day", "day", "2023-12-28", "2024-02-02", "2023-12-28 12:00:00", "2024-02-03")
_filled("buckets_filled_month", "month", "2023-11-01", "2024-03-01", "2023-11-15", "2024-04-01")
sql("fn_rfc3339_utc", "", f"""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN {at("date_trunc('second', ts)")}
        WHEN 1 THEN {at("date_trunc('second', ts) - INTERVAL 2 HOUR")}
        WHEN 2 THEN {at("date_trunc('second', ts) + INTERVAL 330 MINUTE + INTERVAL 250 MILLISECOND")} END AS at
    FROM events""")
sql("fn_made_up_id", "ev0", "SELECT event_id, k % 6 IN (0, 2, 3) AS is_made_up FROM ev0")
sql("fn_stored_call_ids", "msg stored", """
    SELECT session_id, seq, STRING_AGG(call_id, ' ' ORDER BY ord) AS ids,
        CAST(NULL AS VARCHAR) AS ids_junk, CAST(NULL AS VARCHAR) AS ids_two
    FROM msg LEFT JOIN stored USING (session_id, seq) GROUP BY session_id, seq""")
sql("fn_call_entries", "entries", """
    SELECT session_id, response_id, CAST(idx AS BIGINT) AS idx, CAST(n_entries AS BIGINT) AS n_entries, call_id, entry,
        CASE WHEN idx = 0 THEN '[' || STRING_AGG(entry, ',  ') OVER (PARTITION BY response_id ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) || ']' END AS raw
    FROM entries""")
sql("fn_error_text", "errs ev", "SELECT id, content FROM errs JOIN ev ON ev.seq = errs.event_seq")
sql("fn_metadata_gate", "msg", """
    SELECT session_id, seq, metadata, CAST(NULL AS VARCHAR) AS behind, CAST(NULL AS VARCHAR) AS member,
        CAST(NULL AS VARCHAR) AS junk FROM msg""")
VALUE = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ')"


def _token(text: str) -> str:
    return f"rtrim(translate(to_base64(encode({text})), '+/', '-_'), '=')"


sql("fn_page_token", "sess", f"""SELECT id, {_token(f"'created_at|desc|' || {VALUE} || '|' || id")} AS token FROM sess""")
sql("fn_page_token_decode", "sess", f"""
    SELECT id, CASE n % 5 WHEN 2 THEN 'mismatch' WHEN 3 THEN 'malformed' WHEN 4 THEN 'malformed' ELSE 'ok' END AS status,
        CASE WHEN n % 5 < 2 THEN 'created_at' WHEN n % 5 = 2 THEN 'updated_at' END AS sort,
        CASE WHEN n % 5 < 3 THEN 'desc' END AS direction, CASE WHEN n % 5 < 3 THEN {VALUE} END AS value,
        CASE WHEN n % 5 < 3 THEN id END AS token_id FROM sess""")

# --- streams end where the batch results are
sql("stream_tail", "ev", f"SELECT session_id, seq, id, {at('ts')} AS ts, event_type FROM ev")
sql("stream_session_stats", "ev", f"SELECT e.session_id, COUNT(*) AS event_count, {STATS} FROM ev e GROUP BY e.session_id")
for _g in ("day", "week"):
    sql(f"stream_buckets_{_g}", "sess ev", f"SELECT {DAY.format(_g)} AS bucket, {COUNTS}, {STATS} {INNER} GROUP BY 1")

# --- reports
sql("report_sessions", "sess ev", f"""
    SELECT 'row' AS part, pos, pos = 50 AND total > 50 AS is_boundary, CAST(1 AS BIGINT) AS session_count, * EXCLUDE (pos, v, total) FROM (
        SELECT *, ROW_NUMBER() OVER (ORDER BY v DESC, id DESC) AS pos, COUNT(*) OVER () AS total FROM (
            SELECT s.id, {STATS}, {COSTS}, SUM(e.cost_in + e.cost_out) AS v {LEFT} WHERE {GROUP} AND {WINDOW} GROUP BY s.id))
    WHERE pos <= 50
    UNION ALL
    SELECT 'totals', 0, false, COUNT(DISTINCT s.id), '', {STATS}, {COSTS} {LEFT} WHERE {GROUP} AND {WINDOW}""")
_NONE = {"text": "CAST(NULL AS VARCHAR)", "long": "CAST(NULL AS BIGINT)", "double": "CAST(NULL AS DOUBLE)"}
_MEASURED = {
    "event_count": "long", "llm_call_count": "long", "tool_call_count": "long", "tokens_in_total": "long",
    "tokens_out_total": "long", "cache_write_tokens_total": "long", "cache_read_tokens_total": "long",
    "cost_input_total": "double", "cost_output_total": "double", "price_total": "double", "cost_usd": "double",
    "cost_eur": "double", "cost_none": "double", "n_currencies": "long", "channel": "text", "n_metadata": "long"}
_OWN = {"pos": "long", "seq": "long", "tool_calls": "text", "tool_call_id": "text", "own_metadata": "text", "visibility": "text",
        "at": "text", "duration_ms": "long", "parent_id": "text", "payload": "text"}


def _part(part: str, kind: str, body: str, **columns: str) -> str:
    """One part of a long table: the columns that it lacks are NULL."""
    found = {**{n: _NONE[t] for n, t in {**_MEASURED, **_OWN}.items()}, **columns}
    return f"'{part}' AS part, {kind} AS kind, {body} AS body, " + ", ".join(f"{v} AS {n}" for n, v in found.items())


sql("report_session_detail", "sess ev msg errs served payloads", f"""
    SELECT id AS session_id, {_part("session", "interaction_kind", "COALESCE(title, '')", **{n: n for n in _MEASURED})}
    FROM (SELECT s.id, ANY_VALUE(s.interaction_kind) AS interaction_kind, ANY_VALUE(s.title) AS title, COUNT(e.id) AS event_count,
            {STATS}, {COSTS},
            CASE WHEN s.n % 11 <> 0 AND s.n % 4 <> 0 THEN 'c' || s.n % 3 END AS channel,
            CAST(CASE WHEN s.n % 11 <> 0 AND s.n % 4 <> 0 THEN 2 ELSE 0 END AS BIGINT) AS n_metadata
          {LEFT} GROUP BY s.id, s.n)
    UNION ALL
    SELECT t.session_id, {_part("message", "t.role", "t.content", pos="t.pos", seq="t.seq", tool_calls="c.tool_calls",
                                tool_call_id="t.tool_call_id", own_metadata="t.metadata", visibility="t.visibility", at="t.at")}
    FROM ({_transcript(f"seq, role, content, tool_call_id, metadata, visibility, {at('created_at')} AS at", "role <> 'system'")}) t
        LEFT JOIN served c ON c.session_id = t.session_id AND c.seq = t.seq
    UNION ALL
    SELECT session_id, {_part("event", "event_type", "ev.id", seq="seq", at=at("ts"), duration_ms="COALESCE(duration_ms, 0)",
                              parent_id="parent_id", payload="payload")}
    FROM ev JOIN payloads USING (id)""")
sql("report_by_type", "sess ev", f"""
    SELECT 'all' AS event_type, COUNT(e.id) AS event_count, CAST(0 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS samples,
        COUNT(DISTINCT s.id) AS session_count, {STATS}, {COSTS} {LEFT} WHERE {GROUP} AND {WINDOW}
    UNION ALL
    SELECT t.event_type, t.event_count, ROW_NUMBER() OVER (ORDER BY t.event_count DESC, t.event_type) AS pos, x.samples,
        {", ".join(["NULL"] * 14)}
    FROM (SELECT e.event_type, COUNT(*) AS event_count {INNER} WHERE {GROUP} AND {WINDOW} GROUP BY 1) t
    JOIN (SELECT event_type, STRING_AGG(session_id, ' ' ORDER BY rank) AS samples FROM (
        SELECT e.event_type, e.session_id,
            ROW_NUMBER() OVER (PARTITION BY e.event_type ORDER BY MAX(e.ts) DESC, e.session_id) AS rank
        {INNER} WHERE {GROUP} AND {WINDOW} GROUP BY 1, 2) WHERE rank <= 3 GROUP BY 1) x USING (event_type)""")
sql("report_buckets", "sess ev", f"""
    SELECT 'total' AS bucket, {COUNTS}, {STATS}, {COSTS} {LEFT} WHERE {WINDOW}
    UNION ALL SELECT {DAY.format('week')}, {COUNTS}, {STATS}, {COSTS} {INNER} WHERE {WINDOW} GROUP BY 1""")
PAYLOAD = """'{"v":3,"tokens_in":' || k || ',"tokens_out":' || k // 2
    || CASE WHEN k % 4 = 0 THEN ',"cache_write_tokens":' || k || ',"cache_read_tokens":' || 2 * k ELSE '' END
    || ',"cost_input":' || (SELECT x.value FROM events x WHERE x.event_id = seq - 1) || ',"cost_output":' || k / 100.0::DOUBLE
    || CASE k % 5 WHEN 0 THEN ',"cost_currency":"USD"' WHEN 1 THEN ',"cost_currency":"EUR"'
        WHEN 2 THEN ',"cost_currency":""' ELSE '' END
    || CASE WHEN user_id % 4 <> 0 AND k % 3 = 0 THEN ',"price":' || k ELSE '' END || '}' AS payload"""
sql("report_events", "sess ev", EVENT_PAGE.format(
    ts=at("ts"), columns=f"COALESCE(duration_ms, 0) AS duration_ms, {PAYLOAD}", n=100,
    rows=f"{INNER} WHERE s.interaction_kind = 'chat' AND e.llm AND {WINDOW}"))
sql("report_budget", "usage", f"""
    SELECT 'group' AS level, group_id, NULL AS entity_id, CAST(SUM(price) AS DOUBLE) AS price_total
    FROM usage WHERE kind IN ('chat', 'system') AND created_at >= {SINCE} GROUP BY group_id
    UNION ALL
    SELECT 'entity', group_id, entity_id, CAST(SUM(price) AS DOUBLE)
    FROM usage WHERE kind IN ('chat', 'system') AND created_at >= {SINCE} GROUP BY group_id, entity_id""")
