"""The registered queries as plain SQL over the same tables."""

from __future__ import annotations

from casewright.operators.rules import STANDARD_RULES
from casewright.plans.catalog import QUESTION, QUESTION_OF_CURRENCY, SINGLE_CLIENT
from casewright.plans.investigation import ASSUMED_DAY, ASSUMED_RATE, REQUESTED
from casewright.sources import warehouse as w


def _case(column: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{key}' THEN '{_quoted(value)}'" for key, value in mapping.items())
    return f"CASE {column} {arms} END"


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def _values(rows: list[tuple]) -> str:
    literal = lambda value: "NULL" if value is None else f"'{value}'"
    return ", ".join(f"({', '.join(map(literal, row))})" for row in rows)


def _words(words: list[str]) -> str:
    return "[" + ", ".join(f"'{word}'" for word in words) + "]"


def _time(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


NATIONS = f"""nations AS (
  SELECT n_nationkey, {_case('r_name', w.COUNTRY_OF_REGION)} AS country,
         coalesce({_case('n_name', w.CODE_OF_NATION)}, {_case('r_name', w.CODE_OF_REGION)}) AS code
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""
CLIENTS = f"""clients AS (
  SELECT c_custkey AS client_id, country,
         CASE WHEN c_acctbal < 2000 THEN 'High' WHEN c_acctbal < 6000 THEN 'Medium' ELSE 'Low' END AS risk_rating,
         {_case('c_mktsegment', w.CLIENT_TYPE_OF_SEGMENT)} AS client_type
  FROM customer JOIN nations ON c_nationkey = n_nationkey)"""
PAYMENTS = f"""payments AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS payment_id,
         o_custkey AS client_id, s_name AS beneficiary_name, country AS beneficiary_country,
         code AS beneficiary_country_code, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
         {_case('o_orderpriority', w.CURRENCY_OF_PRIORITY)} AS currency,
         {_case('o_orderstatus', w.CHANNEL_OF_STATUS)} AS channel, CAST(o_orderdate AS DATE) AS payment_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nations ON s_nationkey = n_nationkey)"""
RULES = f"""rules AS (
  SELECT rule_id, source, scope_country, kind, CAST(threshold AS DECIMAL(18,2)) AS threshold,
         currency, destination_code, action
  FROM (VALUES {_values(STANDARD_RULES)})
       AS r(rule_id, source, scope_country, kind, threshold, currency, destination_code, action))"""
WINDOWS = """windows AS (
  SELECT client_id, beneficiary_name, payment_date, count(*) AS payment_count, sum(amount) AS total_amount,
         CASE WHEN min(currency) = max(currency) THEN min(currency) ELSE 'mixed' END AS currency
  FROM payments GROUP BY ALL)"""
DECISIONS = """decisions AS (
  SELECT p.payment_id, p.client_id, c.country AS client_country, p.beneficiary_country_code,
         CAST(p.amount AS DOUBLE) AS amount, p.currency, CAST(p.payment_date AS VARCHAR) AS payment_date,
         r.rule_id, r.source, CAST(r.threshold AS DOUBLE) AS threshold, r.currency AS rule_currency,
         r.action AS review_action,
         CASE WHEN r.currency IS NULL THEN 'not_a_comparison' WHEN r.currency = p.currency THEN 'native'
              ELSE 'one_to_one_assumed' END AS comparison_basis
  FROM payments p JOIN clients c USING (client_id)
  JOIN rules r ON (r.scope_country IS NULL OR r.scope_country = c.country)
   AND ((r.kind = 'amount' AND p.amount > r.threshold)
        OR (r.kind = 'destination' AND r.destination_code = p.beneficiary_country_code)))"""
PAYMENT_COLUMNS = """payment_id, client_id, beneficiary_name, beneficiary_country, beneficiary_country_code,
  CAST(amount AS DOUBLE) AS amount, currency, channel, CAST(payment_date AS VARCHAR) AS payment_date"""
PROFILES = f"""profiles AS (
  SELECT c.*, coalesce(round(date_diff('day', f.first_day, (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)) / 365.25, 1), 0.0)
         AS relationship_years
  FROM clients c LEFT JOIN (SELECT o_custkey AS client_id, CAST(min(o_orderdate) AS DATE) AS first_day FROM orders GROUP BY 1) f
  USING (client_id))"""
PAY = f"WITH {NATIONS}, {PAYMENTS}"
PAY_CLIENT = f"WITH {NATIONS}, {CLIENTS}, {PAYMENTS}, {RULES}"

BLOCK = "chr(1)"


def _chunks(table: str, key: str) -> str:
    return rf"""blocks AS (
  SELECT {key} AS source, string_split(regexp_replace(regexp_replace(text, '\n[ \t]*\n', {BLOCK}, 'g'),
         '\n([ \t]*([-*#]+|[0-9]+\.)[ \t])', {BLOCK} || '\1', 'g'), {BLOCK}) AS parts FROM {table}),
numbered AS (SELECT source, unnest(parts) AS block, unnest(range(len(parts))) AS block_no FROM blocks),
cut AS (SELECT *, unnest(range(CAST(floor(greatest(length(block) - 51, 0) / 450) AS BIGINT) + 1)) AS part_no
        FROM numbered WHERE length(trim(block)) > 0),
chunks AS (SELECT concat_ws('#', source, block_no, part_no) AS chunk_id, source,
                  substring(block, part_no * 450 + 1, 500) AS text FROM cut)"""


def _tokens(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


POSTINGS = f"""words AS (SELECT chunk_id, source, {_tokens('text')} AS tokens FROM chunks),
lengths AS (SELECT chunk_id, source, len(tokens) AS n_words FROM words),
postings AS (SELECT chunk_id, source, term, count(*) AS tf
             FROM (SELECT chunk_id, source, unnest(tokens) AS term FROM words) GROUP BY ALL),
norms AS (SELECT chunk_id, sqrt(sum(pow(1 + ln(tf), 2))) AS norm FROM postings GROUP BY 1),
asked AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_tokens(f"'{QUESTION}'")}) AS term) GROUP BY 1),
figures AS (SELECT count(*) AS n, avg(n_words) AS mean_length FROM lengths),
known AS (SELECT term, qtf, count(*) AS df FROM asked JOIN postings USING (term) GROUP BY ALL)"""
DOC_INDEX = f"{_chunks('documents', 'doc_id')}, {POSTINGS}"
TFIDF = f"""WITH {DOC_INDEX},
weights AS (SELECT term, (1 + ln(qtf)) * ln(n / df) AS weight FROM known, figures),
scores AS (SELECT chunk_id, source, round(sum(weight * (1 + ln(tf)) / norm) / (SELECT sqrt(sum(pow(weight, 2))) FROM weights), 6) AS score
           FROM postings JOIN weights USING (term) JOIN norms USING (chunk_id) GROUP BY ALL)"""
BM25 = f"""WITH {DOC_INDEX},
scores AS (SELECT p.chunk_id, p.source, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                  / (tf + 1.2 * (0.25 + 0.75 * n_words / mean_length))), 6) AS score
           FROM postings p JOIN known USING (term) JOIN lengths USING (chunk_id), figures GROUP BY ALL)"""
OVERLAP = f"""WITH {DOC_INDEX},
scores AS (SELECT chunk_id, source, round(count(*) / (SELECT count(*) FROM asked), 6) AS score
           FROM postings JOIN asked USING (term) GROUP BY ALL)"""
TOP_TEN = "SELECT chunk_id, source, score FROM scores WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 10"

OPS = f"""numbered_events AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
ops AS (SELECT CAST(user_id AS VARCHAR) AS incident, event_id, ts, event_type, 'svc-' || (k % 25 + 1) AS component,
               {_words(w.ADJECTIVES)}[k % 8 + 1] || ' ' || {_words(w.NOUNS)}[(k // 8) % 8 + 1] AS words FROM numbered_events),
logs AS (SELECT incident, date_trunc('second', ts) AS ts, coalesce({_case('event_type', w.LEVEL_OF_EVENT)}, 'INFO') AS level,
                component, words || ': event_id=' || event_id AS message, CAST(event_id AS VARCHAR) AS event_id, words AS signature FROM ops),
deploys AS (SELECT incident, 'v' || event_id AS version, date_trunc('minute', ts) AS ts, component,
                   'changed ' || words AS change FROM ops WHERE event_type = 'signup')"""
CATALOGUES = f"""records AS (
  SELECT {_case('p_type', w.CATALOGUE_OF_TYPE)} AS kind, p_partkey, p_name, p_size, 'svc-' || split_part(p_brand, '#', 2) AS component,
         CASE WHEN p_retailprice > 1000 THEN 'unverified' ELSE 'confirmed' END AS standing FROM part),
known_issues AS (SELECT 'KI-' || p_partkey AS issue_id, p_name || ' fault' AS title, 'seen as ' || p_name || ', in logs' AS signature,
                        component AS affected_component, standing AS notes, p_name FROM records WHERE kind = 'known_issue'),
runbooks AS (SELECT 'RB-' || p_partkey AS runbook_id, 'Fault of ' || component AS title,
                    '`' || component || '` logging ' || p_name || '.' AS symptoms,
                    'restart ' || component || ' (' || standing || ').' AS remediation, CAST(p_size AS BIGINT) AS mttr_minutes,
                    CASE standing WHEN 'unverified' THEN standing ELSE '' END AS caveat, component, p_name
             FROM records WHERE kind = 'runbook'),
previous_incidents AS (SELECT 'INC-' || p_partkey AS incident_id, '2023-05-01' AS date,
                    '`' || component || '` logging ' || p_name || '.' AS summary, standing || '.' AS root_cause, 'restarted.' AS resolution,
                    CAST(p_size AS BIGINT) AS mttr_minutes,
                    CASE standing WHEN 'unverified' THEN standing ELSE '' END AS caveat, component, p_name
             FROM records WHERE kind = 'previous_incident')"""
HYPOTHESES = """hypotheses AS (
  SELECT incident, component, signature, count(*) AS line_count, count(*) FILTER (level = 'ERROR') AS error_count,
         min(ts) AS first_ts, max(ts) AS last_ts
  FROM logs WHERE level IN ('WARN', 'ERROR') GROUP BY ALL)"""
SCORED = f"""ki AS (SELECT affected_component AS component, p_name AS signature, issue_id AS id, issue_id || ': ' || title AS excerpt,
       CASE notes WHEN 'unverified' THEN 0.5 ELSE 1.0 END AS weight FROM known_issues
       QUALIFY row_number() OVER (PARTITION BY component, p_name ORDER BY weight DESC, id) = 1),
rb AS (SELECT component, p_name AS signature, runbook_id AS id, mttr_minutes, remediation,
       CASE caveat WHEN '' THEN 1.0 ELSE 0.5 END AS weight FROM runbooks
       QUALIFY row_number() OVER (PARTITION BY component, p_name ORDER BY weight DESC, id) = 1),
pi AS (SELECT component, p_name AS signature, incident_id AS id, root_cause,
       CASE caveat WHEN '' THEN 1.0 ELSE 0.5 END AS weight FROM previous_incidents
       QUALIFY row_number() OVER (PARTITION BY component, p_name ORDER BY weight DESC, id) = 1),
dp AS (SELECT h.incident, h.component, h.first_ts, d.version AS id,
              d.version || ' ' || strftime(d.ts, '%Y-%m-%d %H:%M') || ' ' || d.component || ' ' || d.change AS excerpt
       FROM (SELECT DISTINCT incident, component, first_ts FROM hypotheses) h
       JOIN deploys d ON d.incident = h.incident AND d.component = h.component
        AND d.ts <= h.first_ts AND d.ts >= h.first_ts - INTERVAL 7 DAY
       QUALIFY row_number() OVER (PARTITION BY h.incident, h.component, h.first_ts ORDER BY d.ts DESC, d.version DESC) = 1),
weighted AS (
  SELECT h.*, dp.id AS dp_id, dp.excerpt AS dp_excerpt, ki.id AS ki_id, ki.excerpt AS ki_excerpt, rb.id AS rb_id, rb.mttr_minutes,
         rb.remediation, pi.id AS pi_id, pi.root_cause,
         CASE WHEN error_count > 0 OR line_count >= 2 THEN 1.0 ELSE 0.5 END + CASE WHEN dp.id IS NULL THEN 0 ELSE 1.0 END
         + coalesce(ki.weight, 0) + coalesce(rb.weight, 0) + coalesce(pi.weight, 0) AS weight,
         1 + (dp.id IS NOT NULL)::INT + (ki.id IS NOT NULL)::INT + (rb.id IS NOT NULL)::INT + (pi.id IS NOT NULL)::INT AS source_count
  FROM hypotheses h LEFT JOIN dp USING (incident, component, first_ts) LEFT JOIN ki USING (component, signature)
  LEFT JOIN rb USING (component, signature) LEFT JOIN pi USING (component, signature)),
scored AS (SELECT *, CAST(least(95, round(20 * weight, 1)) AS DOUBLE) AS confidence_score FROM weighted)"""
INCIDENT = f"WITH {OPS}, {CATALOGUES}, {HYPOTHESES}, {SCORED}"

_asks = f"""questions AS (
  SELECT 'Q-' || payment_id AS question_id, payment_id, {_case('currency', QUESTION_OF_CURRENCY)} AS question, currency FROM payments)"""

def _templates(depth: int, branches: int) -> str:
    """Templates of log lines: one level of the tree after the other."""
    levels = "".join(f"""
    c{n} AS (SELECT node, count(DISTINCT w[{n}]) AS children FROM r{n - 1} WHERE len(w) >= {n} GROUP BY 1),
    r{n} AS (SELECT CASE WHEN len(w) >= {n} AND children > {branches} THEN list_concat(w[1:{n - 1}], ['<*>'], w[{n + 1}:]) ELSE w END AS w, n, CASE WHEN len(w) < {n} THEN node WHEN children > {branches} THEN node || '|<*>' ELSE node || '|' || w[{n}] END AS node
             FROM r{n - 1} LEFT JOIN c{n} USING (node)),""" for n in range(1, depth + 1))
    return f"""lines AS (SELECT list_filter(string_split_regex(concat_ws(' ', level, component, message), '\\s+'), lambda x: x <> '') AS t FROM logs),
    r0 AS (SELECT w, count(*) AS n, CAST(len(w) AS VARCHAR) AS node FROM (SELECT list_transform(
      t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM lines) WHERE len(w) > 0 GROUP BY w),{levels}
    places AS (SELECT node, i, CASE WHEN min(w[i]) = max(w[i]) THEN min(w[i]) ELSE '<*>' END AS x
               FROM (SELECT node, w, unnest(range(1, len(w) + 1)) AS i FROM r{depth}) GROUP BY node, i),
    texts AS (SELECT node, string_agg(x, ' ' ORDER BY i) AS template FROM places GROUP BY node),
    counts AS (SELECT node, sum(n) AS n, count(*) AS k FROM r{depth} GROUP BY node)
    SELECT template, CAST(sum(n) AS BIGINT) AS message_count, CAST(sum(k) AS BIGINT) AS wording_count
    FROM counts JOIN texts USING (node) GROUP BY template"""


def _evidence(table: str, key: str) -> str:
    """Best passages of a table's texts for every user turn."""
    return f"""WITH {_chunks(table, key)},
    words AS (SELECT chunk_id, {_tokens('text')} AS tokens FROM chunks),
    postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM words) GROUP BY ALL),
    norms AS (SELECT chunk_id, sqrt(sum(pow(1 + ln(tf), 2))) AS norm FROM postings GROUP BY 1),
    df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
    questions AS (SELECT concat_ws('-', conv_id, turn) AS question_id, {_tokens('text')} AS tokens FROM conversations WHERE role = 'user'),
    asked AS (SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest(tokens) AS term FROM questions) GROUP BY ALL),
    weights AS (SELECT question_id, term, (1 + ln(qtf)) * ln((SELECT count(*) FROM chunks) / df) AS weight FROM asked JOIN df USING (term)),
    qnorms AS (SELECT question_id, sqrt(sum(pow(weight, 2))) AS qnorm FROM weights GROUP BY 1),
    scores AS (SELECT question_id, chunk_id, round(sum(weight * (1 + ln(tf)) / norm) / any_value(qnorm), 6) AS score
      FROM weights JOIN postings USING (term) JOIN norms USING (chunk_id) JOIN qnorms USING (question_id) GROUP BY ALL),
    fetched AS (SELECT * FROM scores WHERE score > 0
      QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) <= 10),
    covered AS (SELECT question_id, chunk_id, count(*) AS hits FROM asked JOIN postings USING (term) GROUP BY ALL),
    sizes AS (SELECT question_id, count(*) AS terms FROM asked GROUP BY 1),
    rescored AS (SELECT question_id, chunk_id, score * hits / terms AS score
      FROM fetched JOIN covered USING (question_id, chunk_id) JOIN sizes USING (question_id))
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
    FROM rescored QUALIFY rank <= 3"""


ORACLES: dict[str, str] = {
    "client_profiles": f"WITH {NATIONS}, {CLIENTS}, {PROFILES} SELECT * FROM profiles",
    "client_profile_lookup": f"WITH {NATIONS}, {CLIENTS}, {PROFILES} SELECT * FROM profiles WHERE client_id = {SINGLE_CLIENT}",
    "tool_calls_in_sql": f"""WITH {NATIONS}, {CLIENTS}, {PAYMENTS}
        SELECT client_id, country, count(*) AS payment_count, CAST(sum(amount) AS DOUBLE) AS total_amount
        FROM clients JOIN payments USING (client_id) GROUP BY ALL""",
    "clients_by_country": f"WITH {NATIONS}, {CLIENTS} SELECT * FROM clients WHERE country = 'Singapore'",
    "payment_lookup": f"{PAY} SELECT {PAYMENT_COLUMNS} FROM payments ORDER BY payments.amount DESC, payment_id DESC LIMIT 1",
    "client_payments": f"{PAY} SELECT {PAYMENT_COLUMNS} FROM payments WHERE client_id = {SINGLE_CLIENT}",
    "clients_without_large_payments": f"""WITH {NATIONS}, {CLIENTS}, {PAYMENTS} SELECT * FROM clients
        WHERE client_id NOT IN (SELECT client_id FROM payments WHERE amount > 104000)""",
    "country_code_mismatches": f"""{PAY} SELECT payment_id, beneficiary_country, beneficiary_country_code,
        CASE beneficiary_country WHEN 'UK' THEN 'GB' WHEN 'Hong Kong' THEN 'HK' WHEN 'Singapore' THEN 'SG'
             WHEN 'Switzerland' THEN 'CH' WHEN 'UAE' THEN 'AE' END AS code_of_name
        FROM payments WHERE code_of_name <> beneficiary_country_code""",
    "review_decisions": f"{PAY_CLIENT}, {DECISIONS} SELECT * FROM decisions",
    "high_risk_payments": f"{PAY} SELECT {PAYMENT_COLUMNS} FROM payments WHERE beneficiary_country_code = 'AE'",
    "beneficiary_windows": f"""{PAY}, {WINDOWS} SELECT client_id, beneficiary_name, CAST(payment_date AS VARCHAR) AS payment_date,
        payment_count, CAST(total_amount AS DOUBLE) AS total_amount, currency FROM windows""",
    "currency_totals": f"""{PAY} SELECT client_id, beneficiary_name, CAST(payment_date AS VARCHAR) AS payment_date, currency,
        count(*) AS payment_count, CAST(sum(amount) AS DOUBLE) AS total_amount FROM payments GROUP BY ALL""",
    "beneficiary_24h": f"""{PAY}, {WINDOWS}, favourite AS (SELECT beneficiary_name FROM payments WHERE client_id = {SINGLE_CLIENT}
        GROUP BY 1 ORDER BY count(*) DESC, beneficiary_name LIMIT 1)
        SELECT client_id, beneficiary_name, CAST(payment_date AS VARCHAR) AS payment_date, payment_count,
        CAST(total_amount AS DOUBLE) AS total_amount, currency FROM windows
        WHERE client_id = {SINGLE_CLIENT} AND beneficiary_name = (SELECT beneficiary_name FROM favourite)""",
    "structuring_triggers": f"""{PAY_CLIENT}, {WINDOWS}
        SELECT v.client_id, beneficiary_name, CAST(payment_date AS VARCHAR) AS payment_date, c.country AS client_country, payment_count,
        CAST(total_amount AS DOUBLE) AS total_amount, v.currency, rule_id, source, CAST(threshold AS DOUBLE) AS threshold,
        action AS review_action, CASE WHEN r.currency IS NULL THEN 'not_a_comparison' WHEN r.currency = v.currency THEN 'native'
        ELSE 'one_to_one_assumed' END AS comparison_basis
        FROM windows v JOIN clients c USING (client_id)
        JOIN rules r ON (r.scope_country IS NULL OR r.scope_country = c.country) AND r.kind IN ('combined', 'escalation')
        WHERE payment_count >= 2 AND total_amount > 100000""",
    "structuring_members": f"""{PAY}, {WINDOWS} SELECT p.client_id, p.beneficiary_name, CAST(p.payment_date AS VARCHAR) AS payment_date,
        payment_id, CAST(amount AS DOUBLE) AS amount, channel, payment_count, CAST(total_amount AS DOUBLE) AS window_total
        FROM payments p JOIN windows v USING (client_id, beneficiary_name, payment_date)
        WHERE payment_count >= 2 AND total_amount > 100000""",
    "repeated_beneficiaries": f"""{PAY} SELECT client_id, beneficiary_name, count(*) AS payment_count,
        CAST(sum(amount) AS DOUBLE) AS total_amount FROM payments GROUP BY ALL HAVING count(*) > 1""",
    "rolling_24h_activity": f"""SELECT DISTINCT user_id, {_time('ts')} AS ts, count(*) OVER last_day AS count_24h,
        CAST(sum(CAST(value AS DECIMAL(18,2))) OVER last_day AS DOUBLE) AS total_24h FROM events
        WINDOW last_day AS (PARTITION BY user_id ORDER BY events.ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)""",
    "asof_prior_event": f"""WITH probes AS (SELECT user_id, ts, count(*) AS probe_count FROM events WHERE event_type = 'error' GROUP BY ALL),
        marks AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY ALL)
        SELECT p.user_id, {_time('p.ts')} AS ts, probe_count,
        CASE WHEN m.ts >= p.ts - INTERVAL 7 DAY THEN m.event_id ELSE -1 END AS prior_event_id,
        CASE WHEN m.ts >= p.ts - INTERVAL 7 DAY THEN {_time('m.ts')} ELSE '' END AS prior_ts
        FROM probes p ASOF LEFT JOIN marks m ON p.user_id = m.user_id AND p.ts >= m.ts""",
    "event_pair_latency": f"""WITH v AS (SELECT user_id, ts, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL),
        c AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'click'),
        pairs AS (SELECT v.user_id, v.ts AS started, c.ts AS ended, n FROM v ASOF JOIN c ON c.user_id = v.user_id AND v.ts <= c.ts)
        SELECT user_id, {_time('started')} AS started_at, {_time('ended')} AS ended_at, n AS start_count,
        CAST(floor(epoch_us(ended) / 1e6 - epoch_us(started) / 1e6) AS BIGINT) AS latency_seconds FROM pairs""",
    "error_episodes": f"""WITH e AS (SELECT user_id, ts, ts > lag(ts) OVER along + INTERVAL 720 MINUTE AS opens FROM events
          WHERE event_type = 'error' WINDOW along AS (PARTITION BY user_id ORDER BY ts)),
        n AS (SELECT *, sum(coalesce(opens, false)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS episode FROM e)
        SELECT user_id, CAST(episode AS BIGINT) AS episode, count(*) AS event_count, {_time('min(ts)')} AS first_at,
        {_time('max(ts)')} AS last_at FROM n GROUP BY user_id, episode""",
    "clean_documents": r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
        '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""",
    "chunk_documents": f"WITH {_chunks('documents', 'doc_id')} SELECT chunk_id, source, md5(text) AS text_md5 FROM chunks",
    "term_statistics": f"""WITH {_chunks('documents', 'doc_id')}, t AS (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM chunks)
        SELECT term, count(DISTINCT chunk_id) AS chunk_count, count(*) AS term_count FROM t GROUP BY 1""",
    "tfidf_topk": f"{TFIDF} {TOP_TEN}",
    "bm25_topk": f"{BM25} {TOP_TEN}",
    "keyword_overlap_topk": f"{OVERLAP} {TOP_TEN}",
    "policy_document": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents WHERE source = 'src7'",
    "rank_documents": f"{BM25} SELECT source, max(score) AS score FROM scores WHERE score > 0 GROUP BY 1",
    "policy_evidence": _evidence("benchmark", "item_id"),
    "evidence_topk_pruned": _evidence("documents", "doc_id"),
    "index_after_changes": f"""WITH texts AS (
          SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents
          WHERE (lang IS NULL OR lang <> 'fr') AND (source IS NULL OR source <> 'src3')
          UNION ALL SELECT CAST(doc_id AS VARCHAR), text || chr(10) || chr(10) || 'Amended afterwards.' FROM documents WHERE source = 'src3'
          UNION ALL SELECT 'item-' || item_id, text FROM benchmark),
        {_chunks('texts', 'id')}, t AS (SELECT chunk_id, unnest({_tokens('text')}) AS term FROM chunks)
        SELECT term, count(DISTINCT chunk_id) AS chunk_count, count(*) AS term_count FROM t GROUP BY 1""",
    "vector_topk": """WITH axes AS (SELECT unnest(range(1, 65)) AS i),
        mean AS (SELECT i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM embeddings, axes GROUP BY i),
        dots AS (SELECT vec_id, label, sum(CAST(embedding[i] AS DOUBLE) * x) AS dot FROM embeddings, mean GROUP BY ALL)
        SELECT vec_id, CAST(label AS BIGINT) AS label, round(dot, 6) AS score FROM dots ORDER BY score DESC, vec_id LIMIT 10""",
    "log_events": f"WITH {OPS} SELECT incident, {_time('ts')} AS ts, level, component, message, event_id, signature FROM logs",
    "deployments": f"WITH {OPS} SELECT incident, version, {_time('ts')} AS ts, component, change FROM deploys",
    "known_issues": f"WITH {CATALOGUES} SELECT issue_id, title, signature, affected_component, notes FROM known_issues",
    "runbooks": f"WITH {CATALOGUES} SELECT runbook_id, title, symptoms, remediation, mttr_minutes, caveat FROM runbooks",
    "previous_incidents": f"""WITH {CATALOGUES} SELECT incident_id, date, summary, root_cause, resolution, mttr_minutes, caveat
        FROM previous_incidents""",
    "call_tree": """SELECT CAST(o_orderkey AS VARCHAR) AS incident, e.parent, e.child FROM (SELECT *, unnest([
          {'parent': 'client-' || o_custkey, 'child': 'order-' || o_orderkey},
          {'parent': 'order-' || o_orderkey, 'child': 'status-' || o_orderstatus},
          {'parent': 'client-' || o_custkey, 'child': 'billing'}]) AS e FROM orders)""",
    "components": """SELECT CAST(o_orderkey AS VARCHAR) AS incident, 'order-' || o_orderkey AS component,
        'has priority ' || o_orderpriority || '.' AS description FROM orders
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'billing', 'shared.' FROM orders""",
    "api_endpoints": """SELECT CAST(p_partkey AS VARCHAR) AS incident, 'GET' AS method, '/parts/' || p_partkey AS path, p_brand AS owner,
        'size:integer:up to ' || p_size || ',type:string:' || p_type AS fields, p_partkey AS timeout_ms,
        '200 OK,404 NO_' || p_type AS response_codes FROM part""",
    "hypotheses": f"""WITH {OPS}, {HYPOTHESES} SELECT incident, component, signature, line_count, error_count,
        {_time('first_ts')} AS first_ts, {_time('last_ts')} AS last_ts FROM hypotheses""",
    "corroboration": f"""{INCIDENT} SELECT incident, component, signature, line_count, CAST(source_count AS BIGINT) AS source_count,
        confidence_score, confidence_score < 50 AS needs_human_review, coalesce(dp_id, '') AS deployment, coalesce(ki_id, '') AS known_issue,
        coalesce(rb_id, '') AS runbook, coalesce(pi_id, '') AS previous_incident FROM scored""",
    "evidence_rows": f"""{INCIDENT}, items AS (
          SELECT incident, component, signature, 'logs' AS source_type, component AS record_id,
                 CASE WHEN error_count > 0 OR line_count >= 2 THEN 1.0 ELSE 0.5 END AS weight FROM scored
          UNION ALL SELECT incident, component, signature, 'deployment', dp_id, 1.0 FROM scored WHERE dp_id IS NOT NULL
          UNION ALL SELECT s.incident, component, signature, 'known_issue', ki.id, ki.weight FROM scored s JOIN ki USING (component, signature)
          UNION ALL SELECT s.incident, component, signature, 'runbook', rb.id, rb.weight FROM scored s JOIN rb USING (component, signature)
          UNION ALL SELECT s.incident, component, signature, 'previous_incident', pi.id, pi.weight FROM scored s JOIN pi USING (component, signature))
        SELECT incident, component, signature, source_type, record_id, CAST(weight AS DOUBLE) AS weight FROM items""",
    "before_and_after": f"""WITH {OPS}, marks AS (SELECT incident, component, max(ts) AS mark_ts FROM deploys GROUP BY ALL)
        SELECT incident, component, {_time('mark_ts')} AS mark_ts,
        count(*) FILTER (level <> 'ERROR' AND ts < mark_ts) AS clean_before, count(*) FILTER (level = 'ERROR' AND ts < mark_ts) AS failed_before,
        count(*) FILTER (level <> 'ERROR' AND ts >= mark_ts) AS clean_after, count(*) FILTER (level = 'ERROR' AND ts >= mark_ts) AS failed_after
        FROM logs JOIN marks USING (incident, component) GROUP BY incident, component, marks.mark_ts""",
    "component_paths": """WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        leaves AS (SELECT r_name, n_name, c_name AS name FROM customer JOIN n ON c_nationkey = n_nationkey
          UNION ALL SELECT r_name, n_name, s_name FROM supplier JOIN n ON s_nationkey = n_nationkey)
        SELECT r_name AS incident, r_name AS ancestor, n_name AS component, CAST(1 AS BIGINT) AS hops FROM n
        UNION ALL SELECT r_name, n_name, name, 1 FROM leaves UNION ALL SELECT r_name, r_name, name, 2 FROM leaves
        UNION ALL SELECT r_name, unnest([c_name, n_name, r_name]), 'Order#' || o_orderkey, unnest([1, 2, 3])
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN n ON c_nationkey = n_nationkey""",
    "component_reach": """WITH RECURSIVE o AS (
          SELECT o_custkey AS k, o_orderkey AS a, unnest([lead(o_orderkey) OVER by_date, lead(o_orderkey, 2) OVER by_date]) AS b
          FROM orders WINDOW by_date AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
        e AS (SELECT * FROM o WHERE b IS NOT NULL),
        r AS (SELECT k, a, b, CAST(1 AS BIGINT) AS hops FROM e
              UNION SELECT r.k, r.a, e.b, r.hops + 1 FROM r JOIN e ON e.k = r.k AND e.a = r.b)
        SELECT CAST(k AS VARCHAR) AS incident, CAST(a AS VARCHAR) AS ancestor, CAST(b AS VARCHAR) AS component, min(hops) AS hops
        FROM r GROUP BY ALL""",
    "call_cycles": """WITH RECURSIVE t AS (SELECT o_orderpriority AS m, c_nationkey AS a, s_nationkey AS b, sum(CAST(l_quantity AS BIGINT)) AS n
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
        e AS (SELECT m, a, b FROM t QUALIFY row_number() OVER (PARTITION BY m, a ORDER BY n DESC, b) = 1),
        r AS (SELECT m, a, b FROM e UNION SELECT r.m, r.a, e.b FROM r JOIN e ON e.m = r.m AND e.a = r.b)
        SELECT x.m AS incident, printf('N%02d', x.a) AS component, printf('N%02d', min(least(x.a, x.b))) AS cycle,
               count(DISTINCT x.b) AS members
        FROM r x JOIN r y ON y.m = x.m AND y.a = x.b AND y.b = x.a GROUP BY x.m, x.a""",
    "deployments_in_force": f"""WITH {OPS} SELECT l.component, l.event_id, d.version FROM logs l JOIN deploys d
        ON d.component = l.component AND d.ts <= l.ts AND l.ts < d.ts + INTERVAL 12 HOUR WHERE l.level = 'ERROR'""",
    "message_templates": f"WITH {OPS}, {_templates(4, 8)}",
    "incident_reports": f"""{INCIDENT},
        leads AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY incident
          ORDER BY confidence_score DESC, line_count DESC, first_ts, component, signature) = 1),
        moments AS (SELECT DISTINCT l.incident, l.ts FROM logs l JOIN leads USING (incident, component, signature) WHERE l.level = 'ERROR'),
        impacted AS (SELECT incident, string_agg(component, ',' ORDER BY component) AS impacted_systems FROM (
          SELECT incident, component FROM leads UNION
          SELECT l.incident, l.component FROM logs l JOIN moments USING (incident, ts) WHERE l.level = 'ERROR') GROUP BY 1)
        SELECT incident, CASE WHEN confidence_score < 50
          THEN 'Unconfirmed. Best lead is ' || component || ': ' || signature || '; the evidence is too thin to name a cause.'
          ELSE component || ': ' || signature || CASE WHEN dp_id IS NULL THEN '' ELSE ' after ' || dp_excerpt END || '. Recorded cause: '
               || coalesce(root_cause, ki_excerpt, 'no recorded cause matches') END AS root_cause,
        CAST(source_count AS BIGINT) AS evidence_count, impacted_systems,
        CASE WHEN confidence_score < 50 THEN -1 ELSE coalesce(mttr_minutes, -1) END AS mttr_minutes,
        CASE WHEN confidence_score < 50 THEN 'Unconfirmed: collect per-stage timing and metrics for ' || component || ' before acting'
               || coalesce('. Candidate step: ' || remediation, '.')
          ELSE coalesce(remediation, 'no matching runbook; escalate to the component owner') END AS remediation,
        confidence_score, confidence_score < 50 AS needs_human_review
        FROM leads JOIN impacted USING (incident)""",
    "case_sections": f"""{PAY_CLIENT}, {DECISIONS}, {WINDOWS}, {_asks},
        per AS (SELECT payment_id, string_agg(review_action || ' by ' || source, '; ' ORDER BY source, review_action) AS stated,
                       list(DISTINCT review_action) AS actions, bool_or(comparison_basis = 'one_to_one_assumed') AS assumed FROM decisions GROUP BY 1),
        facts AS (SELECT q.question_id, q.payment_id, p.*, c.country, c.risk_rating, per.stated, per.actions, coalesce(per.assumed, false) AS assumed,
            q.currency = 'CHF' AS asks, q.currency = 'CHF' AND v.payment_count >= 2 AND v.total_amount > 100000 AS splits, v.currency AS window_currency
          FROM questions q JOIN payments p USING (payment_id) JOIN clients c USING (client_id)
          JOIN windows v USING (client_id, beneficiary_name, payment_date) LEFT JOIN per USING (payment_id)),
        listed AS (SELECT *, list_sort(list_distinct(list_concat(coalesce(actions, []), CASE WHEN splits THEN ['structuring review'] ELSE [] END))) AS todo FROM facts)
        SELECT question_id, payment_id, currency || ' ' || CAST(amount AS VARCHAR) || ' to ' || beneficiary_name || '; destination code '
            || beneficiary_country_code || '; client in ' || country || ' rated ' || risk_rating AS observed_facts,
        concat_ws('; ', stated, CASE WHEN splits THEN 'structuring review by combined value' END) AS policy_triggers,
        concat_ws('; ', CASE WHEN assumed OR (splits AND window_currency <> 'USD') THEN '{_quoted(ASSUMED_RATE)}' END,
                        CASE WHEN asks THEN '{ASSUMED_DAY}' END) AS assumptions,
        CASE WHEN len(todo) > 0 THEN '{_quoted(REQUESTED)}' ELSE '' END AS missing_evidence,
        CASE WHEN len(todo) > 0 THEN array_to_string(todo, ' and ') ELSE 'standard monitoring' END AS next_action FROM listed""",
    "answer_members": f"""{PAY}, asked AS (SELECT DISTINCT client_id, beneficiary_name, payment_date FROM payments WHERE currency = 'CHF')
        SELECT client_id, beneficiary_name, CAST(payment_date AS VARCHAR) AS payment_date, payment_id, CAST(amount AS DOUBLE) AS amount, channel
        FROM payments JOIN asked USING (client_id, beneficiary_name, payment_date)""",
    "payment_answers": f"""{PAY_CLIENT}, {DECISIONS}, {WINDOWS}, {_asks},
        actions AS (SELECT payment_id, string_agg(review_action, ',' ORDER BY source, review_action) AS review_actions,
                           list(DISTINCT source) AS sources FROM decisions GROUP BY 1),
        per_client AS (SELECT client_id, count(*) FILTER (payment_count >= 2 AND total_amount > 100000) AS client_windows FROM windows GROUP BY 1),
        facts AS (SELECT q.question_id, q.payment_id, q.currency, p.amount, c.country, v.payment_count, v.total_amount, a.review_actions, n.client_windows,
            list_sort(list_distinct(list_concat(['global_payment_policy.md'],
              CASE c.country WHEN 'Singapore' THEN ['regional_singapore.md'] WHEN 'Switzerland' THEN ['regional_switzerland.md'] ELSE [] END,
              coalesce(a.sources, []), CASE q.currency WHEN 'HKD' THEN ['high_risk_jurisdictions.md'] ELSE [] END))) AS cited
          FROM questions q JOIN payments p USING (payment_id) JOIN clients c USING (client_id) JOIN windows v USING (client_id, beneficiary_name, payment_date)
          JOIN per_client n USING (client_id) LEFT JOIN actions a USING (payment_id))
        SELECT question_id, payment_id, array_to_string(cited, ',') AS citations,
        CASE currency WHEN 'CHF' THEN 'get_payment,get_client_profile,get_client_payments,aggregate_beneficiary_24h'
             ELSE 'get_payment,get_client_profile' END AS tools_used, CAST(amount AS DOUBLE) AS amount,
        CASE currency WHEN 'CHF' THEN payment_count ELSE 0 END AS payment_count,
        CASE currency WHEN 'CHF' THEN CAST(total_amount AS DOUBLE) ELSE 0.0 END AS combined_amount,
        CASE currency WHEN 'CHF' THEN client_windows ELSE -1 END AS client_windows,
        coalesce(review_actions, '') AS review_actions FROM facts""",
}
