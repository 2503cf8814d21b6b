"""Registered queries, and DuckDB SQL that computes the same rows from the input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audits, records, web

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "page_fact_states": web.page_fact_states, "snapshot_hash": web.snapshot_hashes, "decode_guard": web.decode_guard, "page_title": web.page_title, "main_heading": web.main_heading, "job_status": web.job_statuses,
    "visible_li_blocks": web.visible_li_blocks, "links": web.links, "canonical_url": web.canonical_urls, "duplicate_captures": web.duplicate_captures, "page_type": web.page_types, "automatic_facts": web.automatic_facts,
    "crawl_frontier": web.crawl_frontier, "decode_blocks": web.decode_blocks, "confirmed_claims": web.confirmed_claims, "request_schemas": records.request_schemas, "fetch_codes": records.fetch_codes, "redirect_chains": records.redirect_chains, "label_envelopes": records.label_envelopes, "replay_reports": records.replay_reports, "snapshot_sources": web.snapshot_sources, "bound_evidence": web.bound_evidence,
    "rt_label_scalar": web.rt_label_scalar, "rt_units_currency": web.rt_units_currency, "rt_reconcile_states": web.rt_reconcile_states, "rt_jsonld": web.rt_jsonld, "rt_plan_cards": web.rt_plan_cards,
    "rt_plan_columns": web.rt_plan_columns, "rt_offers": web.rt_offers, "rt_details_dl": web.rt_details_dl, "rt_details_tr": web.rt_details_tr, "rt_hidden": web.rt_hidden, "rt_verify_tampered": web.rt_verify_tampered,
    "nearest_card": web.nearest_card, "source_nodes": web.source_nodes, "scoped_evidence": web.scoped_evidence, "common_scopes": web.common_scopes,
    "case_summary": records.case_summary, "refusals": records.refusals, "failure_examples": records.failure_examples, "label_exports": records.label_exports,
    "field_correctness": records.field_correctness, "score_summary": records.score_summary, "score_by_category": records.score_by_category, "rows_correct": records.rows_correct, "bootstrap_ci": records.bootstrap_ci,
    "wrong_accepted": records.wrong_accepted, "conflict_bags": records.conflict_bags, "latency_percentiles": records.latency_percentiles, "agreement": records.agreement, "human_row_errors": records.human_row_errors,
    "supported_values": records.supported_values, "label_rules": records.label_rules, "gate_checks": records.gate_checks,
    "tenant_metrics": records.tenant_metrics, "recent_jobs": records.recent_jobs, "retention_survivors": records.retention_survivors, "deleted_jobs": records.deleted_jobs, "review_minutes": records.review_minutes,
    "label_totals": records.label_totals,
    "host_start_gaps": records.host_start_gaps, "session_overlap": records.session_overlap, "claim_replay": records.claim_replay, "job_sink": records.job_sink, "claim_first_owner": records.claim_first_owner, "paced_starts": records.paced_starts,
    "review_replay": records.review_replay, "inventory_balance": records.inventory_balance, "target_violations": records.target_violations,
    **audits.QUERIES,
}


def _text(tag: str) -> str:
    return f"trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<{tag}>(.*?)</{tag}>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))"


_FACTS = f"facts AS (SELECT page_id, 'page_title' AS field, {_text('title')} AS value FROM pages UNION ALL SELECT page_id, 'main_heading', {_text('h1')} FROM pages)"
_HOST = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_CANON = "regexp_replace(url, '#.*$', '')"
_TRACK = "regexp_replace(regexp_replace(" + _CANON + ", '([?&])(utm_[a-z]+|fbclid|gclid)=[^&]*', '\\1', 'g'), '[?&]+$', '')"
_PRICE = "CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR)"


def _canonical_number(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '(\\.[0-9]*[1-9])0+$', '\\1'), '\\.0*$', '')"


def _state(number: str) -> str:
    return f"(['verified', 'conflicting', 'missing', 'blocked', 'unverified'])[CAST(({number}) % 5 AS INT) + 1]"


_SCORED = f"""
scored0 AS (
  SELECT doc_id, lang AS category, CASE WHEN toxic = 1 THEN {_state('doc_id')} ELSE 'verified' END AS state,
    CASE WHEN quality = 1 THEN 'verified' ELSE {_state('doc_id + doc_id // 7')} END AS expected_state,
    CAST(doc_id % 10 AS VARCHAR) AS value, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE CAST(doc_id % 10 AS VARCHAR) END AS expected_value
  FROM labels JOIN documents USING (doc_id)),
scored1 AS (SELECT *, CASE WHEN state IN ('verified', 'conflicting') THEN doc_id % 11 <> 0 END AS evidence_valid FROM scored0),
scored AS (SELECT *, CASE WHEN state = 'verified' THEN state = expected_state AND value = expected_value AND evidence_valid
    WHEN state = 'conflicting' THEN state = expected_state AND doc_id % 3 <> 0 AND evidence_valid ELSE state = expected_state END AS correct FROM scored1)"""
_COUNTS = """count(*) AS fields, count(*) FILTER (expected_state = 'verified') AS expected_values, count(*) FILTER (state = 'verified') AS accepted,
 count(*) FILTER (state = 'verified' AND correct) AS correct_accepted, count(*) FILTER (state = 'verified' AND NOT correct) AS incorrect_accepted,
 count(*) FILTER (expected_state = 'verified' AND NOT (state = 'verified' AND correct)) AS missed_values, count(*) FILTER (state <> 'verified') AS abstentions,
 count(*) FILTER (expected_state = 'conflicting') AS expected_conflicts, count(*) FILTER (expected_state = 'conflicting' AND correct) AS detected_conflicts,
 count(evidence_valid) AS evidence_checked, count(*) FILTER (evidence_valid) AS evidence_valid"""
_RATIOS = """round_even(correct_accepted / nullif(accepted, 0), 4) AS field_precision, round_even(correct_accepted / nullif(expected_values, 0), 4) AS field_recall,
 round_even(abstentions / nullif(fields, 0), 4) AS abstention_rate, round_even(detected_conflicts / nullif(expected_conflicts, 0), 4) AS conflict_detection,
 round_even(evidence_valid / nullif(evidence_checked, 0), 4) AS evidence_validity"""
_PARTS = f"""parts AS (SELECT p_partkey, {_canonical_number(_PRICE)} AS value, CASE WHEN p_partkey % 3 = 0 THEN 'USD' WHEN p_partkey % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency,
 CASE WHEN p_partkey % 2 = 0 THEN 'month' ELSE 'year' END AS billing_period FROM part)"""
_SESSIONS = """s AS (SELECT user_id AS job_id, event_type AS field_name, event_id, epoch_us(ts) / 1e6 AS started_at, CASE WHEN event_id % 10 <> 0 THEN CAST(round_even(abs(value), 3) AS DECIMAL(18,3)) END AS seconds FROM events)"""

ORACLE_SQL: dict[str, str] = {
    "page_fact_states": f"""WITH {_FACTS}, wanted AS (SELECT page_id, unnest(['page_title', 'main_heading', 'page_description', 'site_name']) AS field FROM pages)
        SELECT page_id, field, CASE WHEN length(value) BETWEEN 1 AND 200 THEN 'verified' ELSE 'missing' END AS state, CASE WHEN length(value) BETWEEN 1 AND 200 THEN value END AS value,
        CAST(CASE WHEN length(value) BETWEEN 1 AND 200 THEN 1 ELSE 0 END AS INT) AS n_evidence FROM wanted LEFT JOIN facts USING (page_id, field)""",
    "snapshot_hash": "SELECT page_id, sha256(html) AS snapshot_hash FROM pages",
    "decode_guard": "SELECT page_id, 'utf-8' AS encoding, CAST(0 AS INT) AS errors, true AS same FROM pages",
    "page_title": f"WITH {_FACTS} SELECT page_id, value AS title FROM facts WHERE field = 'page_title' AND length(value) BETWEEN 1 AND 200",
    "main_heading": f"WITH {_FACTS} SELECT page_id, value AS heading FROM facts WHERE field = 'main_heading' AND length(value) BETWEEN 1 AND 200",
    "job_status": """SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'failed' WHEN bool_and(o_orderstatus = 'F') AND count(*) FILTER (o_orderpriority = '1-URGENT') = 0 THEN 'complete' ELSE 'partial' END AS status
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "decode_blocks": f"""WITH {_FACTS} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'CAPTURE_DECODE_MISMATCH' END AS code, 2 + CASE WHEN page_id % 3 = 0 THEN 2 ELSE count(*) FILTER (length(value) NOT BETWEEN 1 AND 200) END AS missing,
        max(CASE WHEN page_id % 3 <> 0 AND field = 'page_title' AND length(value) BETWEEN 1 AND 200 THEN value END) AS title FROM facts GROUP BY page_id""",
    "confirmed_claims": f"WITH {_FACTS} SELECT page_id, field AS key, value FROM facts WHERE page_id % 5 > 1 AND length(value) BETWEEN 1 AND 200",
    "request_schemas": """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN 'no JSON' ELSE concat_ws('|', CASE WHEN p_partkey % 4 = 0 THEN 'unknown keyword' END, CASE WHEN p_partkey % 3 = 0 THEN 'title' END,
        CASE WHEN p_partkey % 5 = 0 THEN '3 to 10 properties' WHEN p_partkey % 13 = 0 THEN 'required' END, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN 'property name' WHEN p_partkey % 11 = 0 THEN 'x-currency' END) END AS violations FROM part""",
    "fetch_codes": """WITH e AS (SELECT event_id, user_id % 50 AS h, ([200, 200, 403, 500, 200, 451, 404])[CAST(event_id % 7 AS INT) + 1] AS status FROM events)
        SELECT event_id, CASE WHEN event_id % 9 = 0 OR event_id % 11 = 0 THEN 'OUT_OF_SCOPE' WHEN h % 6 IN (4, 5) THEN 'ROBOTS_UNAVAILABLE' WHEN status IN (403, 451) THEN 'ACCESS_DENIED' WHEN status <> 200 THEN 'HTTP_ERROR'
        WHEN event_id % 10 = 0 THEN 'TOO_LARGE' WHEN event_id % 8 = 0 THEN 'UNSUPPORTED_CONTENT' END AS code FROM e""",
    "claim_replay": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS tenant, event_type AS idem, event_id AS seq, CAST(event_id AS DOUBLE) AS t, (['claim', 'renew', 'put', 'claim', 'release', 'cancel'])[CAST(event_id % 6 AS INT) + 1] AS cmd,
            CASE WHEN event_id % 10 = 0 THEN 'h2' ELSE 'h1' END AS eh, 'w' || (event_id % 2) AS ew, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events),
        r AS (SELECT DISTINCT tenant, idem, 0::BIGINT AS n, NULL::VARCHAR AS h, NULL::VARCHAR AS st, NULL::VARCHAR AS w, NULL::DOUBLE AS lease, NULL::INT AS tries, NULL::BIGINT AS seq, NULL::DOUBLE AS t, NULL::VARCHAR AS cmd, NULL::VARCHAR AS outcome, NULL::DOUBLE AS ended, NULL::VARCHAR AS lost_w, NULL::INT AS lost_tries FROM e
            UNION ALL SELECT tenant, idem, n, CASE o WHEN 'owner' THEN eh WHEN 'released' THEN NULL ELSE h END, CASE WHEN o = 'owner' THEN 'pending' WHEN o = 'released' THEN NULL WHEN o = 'stored' THEN 'complete' WHEN cmd = 'cancel' AND o = 'cancelled' THEN 'cancelled' ELSE st END,
                CASE o WHEN 'owner' THEN ew WHEN 'released' THEN NULL ELSE w END, CASE WHEN o IN ('owner', 'renewed') THEN t + 4 WHEN o IN ('released', 'stored') OR o = 'cancelled' AND cmd = 'cancel' OR lapsed THEN NULL ELSE lease END,
                CASE o WHEN 'owner' THEN coalesce(tries, 0) + 1 WHEN 'released' THEN NULL ELSE tries END, seq, t, cmd, o, CASE WHEN lapsed THEN lease END, CASE WHEN lapsed THEN w END, CASE WHEN lapsed THEN tries END
            FROM (SELECT e.*, r.h, r.st, r.w, r.lease, r.tries, coalesce(r.st = 'pending' AND r.lease < e.t, false) AS lapsed,
                CASE e.cmd WHEN 'claim' THEN CASE WHEN r.st IS NULL THEN 'owner' WHEN r.h <> eh THEN 'conflict' WHEN r.st = 'pending' AND (r.lease IS NULL OR r.lease < e.t) THEN 'owner' ELSE r.st END WHEN 'cancel' THEN CASE WHEN r.st = 'pending' THEN 'cancelled' ELSE 'refused' END
                    ELSE CASE WHEN coalesce(r.st = 'pending' AND r.h = eh AND r.w = ew, false) THEN CASE e.cmd WHEN 'renew' THEN 'renewed' WHEN 'release' THEN 'released' ELSE 'stored' END WHEN e.cmd = 'put' THEN 'CLAIM_LOST' ELSE 'refused' END END AS o
                FROM r JOIN e ON e.tenant = r.tenant AND e.idem = r.idem AND e.n = r.n + 1))
        SELECT tenant, idem, seq, t AS at, cmd AS command, outcome, w AS owner, tries AS attempts FROM r WHERE n > 0 UNION ALL SELECT tenant, idem, NULL, ended, 'expire', 'expired', lost_w, lost_tries FROM r WHERE ended IS NOT NULL""",
    "review_replay": """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS tenant, event_id AS seq, CAST(event_id AS DOUBLE) AS t, event_type AS job, 'f' || (event_id % 2) AS f, 'r' || (event_id % 3) AS v,
            (['start', 'start', 'stop', 'save'])[CAST(('0x' || md5(CAST(event_id AS VARCHAR))[1:4])::INT % 4 AS INT) + 1] AS cmd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        r AS (SELECT DISTINCT tenant, 0::BIGINT AS n, []::STRUCT(job VARCHAR, f VARCHAR, v VARCHAR, t DOUBLE)[] AS active, []::STRUCT(job VARCHAR, f VARCHAR, v VARCHAR, t DOUBLE)[] AS spent, NULL::BIGINT AS seq, NULL::VARCHAR AS job, NULL::VARCHAR AS f, NULL::VARCHAR AS v, NULL::VARCHAR AS cmd, NULL::VARCHAR AS outcome, NULL::DOUBLE AS seconds FROM e
            UNION ALL SELECT tenant, n, CASE o WHEN 'started' THEN list_append(active, {'job': job, 'f': f, 'v': v, 't': t}) WHEN 'stopped' THEN list_filter(active, lambda x: x.job <> job) ELSE active END,
                CASE o WHEN 'stopped' THEN list_append(spent, {'job': job, 'f': f, 'v': v, 't': t - mine.t}) ELSE spent END, seq, job, f, v, cmd, o, CASE o WHEN 'stopped' THEN t - mine.t WHEN 'saved' THEN round(list_sum(list_transform(own, lambda x: x.t)), 3) END
            FROM (SELECT *, CASE cmd WHEN 'start' THEN CASE WHEN mine IS NOT NULL OR len(list_filter(active, lambda x: x.v = g.v)) > 0 THEN 'refused' ELSE 'started' END WHEN 'stop' THEN CASE WHEN mine.f = f AND mine.v = v THEN 'stopped' ELSE 'refused' END
                    ELSE CASE WHEN mine IS NOT NULL OR len(own) = 0 THEN 'refused' ELSE 'saved' END END AS o
                FROM (SELECT e.*, r.active, r.spent, list_filter(r.active, lambda x: x.job = e.job)[1] AS mine, list_filter(r.spent, lambda x: x.job = e.job AND x.f = e.f AND x.v = e.v) AS own FROM r JOIN e ON e.tenant = r.tenant AND e.n = r.n + 1) g))
        SELECT tenant, seq, job AS job_id, f AS field_name, v AS reviewer_id, cmd AS command, outcome, seconds FROM r WHERE n > 0""",
    "job_sink": """WITH p AS (SELECT o_orderkey AS k, CAST(o_custkey % 10 AS VARCHAR) AS tenant, CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey - 1 ELSE o_orderkey END AS idem, o_orderkey % 5 <> 0 AS own, o_orderkey // 7 % 4 AS batch FROM orders),
        d AS (SELECT p.*, own AND c.k IS NOT NULL AND row_number() OVER (PARTITION BY p.tenant, p.idem, own ORDER BY p.batch, p.k) = 1 AS ok FROM p LEFT JOIN (SELECT tenant, k FROM p WHERE idem = k) c ON c.tenant = p.tenant AND c.k = p.idem),
        n AS (SELECT *, unnest([k % 5, (k + 1) % 5, (k + 2) % 5]) AS s FROM d WHERE ok), s AS (SELECT tenant, count(*) FILTER (s = 0) AS verified_fields, count(*) FILTER (s = 1) AS conflicting_fields, count(*) FILTER (s = 2) AS missing_fields, count(*) FILTER (s = 3) AS blocked_fields, count(*) FILTER (s = 4) AS unverified_fields FROM n GROUP BY tenant)
        SELECT d.tenant, count(*) FILTER (NOT ok) AS lost, count(*) FILTER (ok) AS stored, count(*) FILTER (ok) AS snapshots, count(*) FILTER (ok) AS jobs, CAST(coalesce(sum(k % 4) FILTER (ok), 0) AS BIGINT) AS pages_fetched, any_value(verified_fields) AS verified_fields, any_value(conflicting_fields) AS conflicting_fields,
            any_value(missing_fields) AS missing_fields, any_value(blocked_fields) AS blocked_fields, any_value(unverified_fields) AS unverified_fields FROM d JOIN s USING (tenant) GROUP BY d.tenant""",
    "redirect_chains": """WITH e AS (SELECT event_id AS k, user_id AS u, unnest(range(event_id % 6 + 1)) AS i FROM events),
        h AS (SELECT k, u, i, (u + i * (k % 4)) % 60 AS host, k * 2.0 + i AS t, i < k % 6 AS more, CASE WHEN i < k % 6 THEN 302 ELSE ([200, 200, 200, 403, 200, 500, 301])[CAST(u % 7 AS INT) + 1] END AS status FROM e),
        r AS (SELECT c_custkey % 60 AS host, c_custkey * 5.0 AS t, ([200, 200, 404, 200, 503])[CAST(c_custkey % 5 AS INT) + 1] AS robots, c_custkey // 60 % 3 = 0 AS denied FROM customer),
        j AS (SELECT h.*, r.robots, r.denied FROM h ASOF LEFT JOIN r ON h.host = r.host AND h.t >= r.t),
        f AS (SELECT *, CASE WHEN i > 4 THEN NULL WHEN host >= 56 THEN 'OUT_OF_SCOPE' WHEN robots IS NULL OR robots = 503 THEN 'ROBOTS_UNAVAILABLE' WHEN robots = 200 AND denied THEN 'ROBOTS_DENIED' WHEN status IN (301, 302) AND NOT (more AND (k + i) % 17 <> 0) THEN 'BAD_REDIRECT' WHEN status = 302 AND i = 4 THEN 'REDIRECT_LIMIT' END AS code FROM j),
        m AS (SELECT k, arg_min(code, i) FILTER (code IS NOT NULL) AS code, min(i) FILTER (code IS NOT NULL) AS hop, max(i) AS last, arg_max(status, i) AS status FROM f GROUP BY k),
        a AS (SELECT *, CASE WHEN status = 403 THEN 'ACCESS_DENIED' WHEN status <> 200 THEN 'HTTP_ERROR' WHEN k % 10 = 0 THEN 'TOO_LARGE' WHEN k % 8 = 0 THEN 'UNSUPPORTED_CONTENT' END AS answer FROM m)
        SELECT k AS event_id, coalesce(code, answer) AS code, CAST(coalesce(hop, CASE WHEN answer IS NOT NULL THEN last END) AS INT) AS hop FROM a""",
    "paced_starts": """WITH e AS (SELECT event_id AS seq, user_id, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
        m AS (SELECT seq, t, k, max(t - 2.0 * (k - 1)) OVER (PARTITION BY user_id ORDER BY k) AS m FROM e) SELECT seq, round_even(2.0 * (k - 1) + m - t, 2) AS waited FROM m""",
    "visible_li_blocks": """WITH l AS (SELECT page_id, list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1, 's'), lambda x: trim(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'))) AS b FROM pages),
        k AS (SELECT page_id, list_filter(b, lambda x: length(x) BETWEEN 1 AND 400) AS b FROM l) SELECT page_id, CAST(len(b) AS INT) AS n_blocks, array_to_string(b, '|') AS texts FROM k WHERE len(b) > 0""",
    "links": """WITH h AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages),
        u AS (SELECT page_id, host, unnest(l) AS href, generate_subscripts(l, 1) AS pos FROM h),
        a AS (SELECT page_id, host, pos, regexp_replace(CASE WHEN starts_with(href, 'http') THEN replace(href, '&amp;', '&') ELSE host || replace(href, '&amp;', '&') END, '#.*$', '') AS url FROM u),
        d AS (SELECT page_id, url, min(pos) AS pos FROM a WHERE starts_with(url, host) AND NOT regexp_matches(regexp_replace(url, '[?].*$', ''), '(?i)[.](pdf|jpg|png|css|js|zip)$') GROUP BY 1, 2),
        s AS (SELECT *, CAST(10 * CAST(contains(lower(url), 'page') AS INT) + 2 * CAST(contains(lower(url), 'pricing') AS INT) + 2 * CAST(contains(lower(url), 'about') AS INT) + 2 * CAST(contains(lower(url), 'plans') AS INT) + 2 * CAST(contains(lower(url), 'faq') AS INT) AS INT) AS score FROM d)
        SELECT page_id, url, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM s""",
    "canonical_url": f"SELECT page_id, {_CANON} AS canonical, {_TRACK} AS tracking_key FROM pages",
    "duplicate_captures": """WITH f AS (SELECT page_id, page_id * 2 AS fetch_seq, regexp_replace(url, '#.*$', '') AS url, sha256(html) AS h FROM pages),
        both_ AS (SELECT page_id, fetch_seq, TRACKED AS k, h FROM f UNION ALL SELECT page_id, fetch_seq + 1, TRACKED, h FROM f)
        SELECT page_id, fetch_seq, CASE WHEN row_number() OVER (PARTITION BY k, h ORDER BY fetch_seq) > 1 THEN 'duplicate' ELSE 'fetched' END AS status FROM both_""".replace("TRACKED", _TRACK),
    "page_type": "SELECT page_id, 'general' AS page_type, '' AS alternatives FROM pages",
    "snapshot_sources": "SELECT sha256(html) AS snapshot_hash, count(*) AS sources, min(page_id) AS first_page FROM pages GROUP BY 1",
    "bound_evidence": "SELECT page_id, page_id % 5 <> 0 AS bound FROM pages",
    "rt_label_scalar": f"""WITH c AS (SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS raw_value FROM customer), v AS (SELECT *, {_canonical_number('raw_value')} AS value FROM c)
        SELECT c_custkey, value, CASE WHEN contains(value, '.') THEN 'decimal-string' ELSE 'integer' END AS encoding, raw_value FROM v""",
    "rt_units_currency": f"""SELECT p_partkey, {_canonical_number(_PRICE)} AS value, CASE WHEN p_partkey % 2 = 0 THEN 'month' ELSE 'year' END AS unit,
        CASE WHEN p_partkey % 3 = 0 THEN 'USD' WHEN p_partkey % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency, p_partkey % 3 = 1 AS kept FROM part""",
    "rt_reconcile_states": """SELECT c_custkey, CASE count(DISTINCT o_orderstatus) WHEN 0 THEN 'missing' WHEN 1 THEN 'verified' ELSE 'conflicting' END AS state,
        CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS value, CAST(CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN count(o_orderkey) ELSE 0 END AS INT) AS n_evidence,
        CAST(CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN count(DISTINCT o_orderstatus) ELSE 0 END AS INT) AS n_candidates FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "rt_jsonld": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'country_name' AS field, n_name AS value, n_name AS raw_value, CAST(0 AS INT) AS item_idx, CAST(NULL AS VARCHAR) AS encoding FROM nation
        UNION ALL SELECT n_nationkey, 'region', r_name, r_name, 0, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_nationkey, 'weight', n_nationkey || '.5', n_nationkey || '.50', 0, 'decimal-string' FROM nation
        UNION ALL SELECT n_nationkey, 'rank', CAST(n_nationkey AS VARCHAR), CAST(n_nationkey AS VARCHAR), 1, 'integer' FROM nation""",
    "rt_plan_cards": f"WITH {_PARTS} SELECT p_partkey, value, 'month' AS unit, currency, billing_period FROM parts UNION SELECT p_partkey, CAST(p_partkey AS VARCHAR), 'month', currency, billing_period FROM parts",
    "rt_plan_columns": f"WITH {_PARTS} SELECT p_partkey, value, CAST(NULL AS VARCHAR) AS unit, currency, billing_period FROM parts",
    "rt_offers": f"""WITH o AS (SELECT replace(p_brand, '#', '') || '-' || (p_partkey // 1000) AS page_key, p_partkey, {_PRICE} AS value,
        row_number() OVER (PARTITION BY p_brand, p_partkey // 1000 ORDER BY p_partkey) AS n FROM part)
        SELECT page_key, 'Offer: Part ' || p_partkey AS offer, value, 'USD' AS currency, 'decimal-string' AS encoding FROM o WHERE n <= 12""",
    "rt_details_dl": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'detail:nation' AS key, 'Nation' AS label, n_name AS value FROM nation
        UNION ALL SELECT n_nationkey, 'detail:region', 'Region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT n_nationkey, 'detail:part_of', 'Part of', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "rt_details_tr": """SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, 'detail:nation' AS key, 'Nation' AS label, n_name AS value FROM nation
        UNION ALL SELECT n_nationkey, 'detail:region', 'Region', r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "rt_hidden": "SELECT event_id, event_type AS value FROM events WHERE event_id % 6 = 5",
    "rt_verify_tampered": "SELECT c_custkey, c_mktsegment AS value FROM customer WHERE c_custkey % 5 NOT IN (0, 1)",
    "nearest_card": "SELECT s_suppkey, 'html:nth-of-type(1) > body:nth-of-type(1) > section:nth-of-type(1) > div:nth-of-type(1)' AS scope_path FROM supplier",
    "source_nodes": "SELECT page_id, substr(regexp_extract(html, '<h1>.*?</h1>', 0, 's'), 1, 4000) AS source FROM pages",
    "scoped_evidence": "SELECT page_id, page_id % 2 = 0 AS evidence_matches FROM pages",
    "common_scopes": "SELECT page_id, 'article' AS tag FROM pages",
    "case_summary": """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 <> 1 THEN s_suppkey % 40 + 20.0 END AS r, CASE WHEN s_suppkey % 7 <> 0 THEN 96.0 END AS b FROM supplier)
        SELECT count(*) AS cases, count(*) FILTER (k % 5 = 0) AS failures, count(*) FILTER (k % 4 = 0) AS access_failures, count(*) FILTER (k % 3 = 0) AS reviewed_rows_correct, count(r) AS reviewed_cases,
        count(*) FILTER (r IS NOT NULL AND b IS NOT NULL) AS paired_cases, round_even(avg(k % 8 * 0.5), 4) AS mean_latency_seconds, round_even(count(*) FILTER (k % 5 = 0) / count(*), 4) AS failure_rate,
        round_even(count(b) / (6 * count(b)), 4) AS manual_baseline_error_rate, round_even(sum(k % 2) / (6 * count(*)), 4) AS corrected_row_error_rate,
        CAST(round_even(sum(b - r) / sum(b) FILTER (r IS NOT NULL), 4) AS DOUBLE) AS paired_assisted_time_reduction, CAST(sum(k % 5 + 3) AS BIGINT) AS total_http_requests_started FROM s""",
    "refusals": """WITH r AS (SELECT s_suppkey AS case_id, concat_ws('|', CASE WHEN s_suppkey % 7 = 0 THEN 'no baseline' END, CASE WHEN s_suppkey % 3 = 1 THEN 'no review' END, CASE WHEN s_suppkey % 6 = 0 THEN 'no code revision' END,
        CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 <> 0 THEN 'one reviewer' END, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 < 1 THEN 'agreement after capture' END) AS reasons FROM supplier) SELECT * FROM r WHERE reasons <> ''""",
    "failure_examples": f"""WITH {_SCORED}, f AS (SELECT CAST(doc_id % 50 + 1 AS VARCHAR) AS case_id, bool_and(correct) AS ok FROM scored GROUP BY 1),
        c AS (SELECT CAST(s_suppkey AS VARCHAR) AS case_id, CASE WHEN s_suppkey % 5 = 0 THEN 'TimeoutError' END AS failure FROM supplier)
        SELECT case_id, failure, CAST(CASE WHEN NOT coalesce(ok, true) THEN 1 ELSE 0 END AS INT) AS wrong FROM c LEFT JOIN f USING (case_id) WHERE failure IS NOT NULL OR NOT coalesce(ok, true)""",
    "label_exports": "SELECT user_id AS job_id, count(DISTINCT event_type) AS reviewed_fields, count(*) AS sessions FROM events GROUP BY 1",
    "field_correctness": f"WITH {_SCORED} SELECT doc_id, state, expected_state, correct FROM scored",
    "score_summary": f"WITH {_SCORED}, c AS (SELECT {_COUNTS} FROM scored) SELECT *, {_RATIOS} FROM c",
    "score_by_category": f"WITH {_SCORED}, c AS (SELECT category, grouping(category) = 1 AS is_total, {_COUNTS} FROM scored GROUP BY GROUPING SETS ((category), ())) SELECT *, {_RATIOS} FROM c",
    "rows_correct": f"WITH {_SCORED} SELECT doc_id // 20 AS case_id, bool_and(expected_state = 'verified' AND state = 'verified' AND correct) AS reviewed_row_correct FROM scored GROUP BY 1",
    "wrong_accepted": f"WITH {_SCORED} SELECT doc_id, value, expected_value FROM scored WHERE state = 'verified' AND NOT correct",
    "conflict_bags": "SELECT l_orderkey, l_orderkey % 20 = 0 OR bool_and(l_returnflag = 'N') AS bag_matches FROM lineitem GROUP BY l_orderkey",
    "latency_percentiles": "SELECT event_type, median(value) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
    "agreement": "SELECT doc_id AS site_id, doc_id % 11 <> 0 AND (doc_id % 9 <> 0 OR quality IS NULL) AS agrees FROM labels",
    "human_row_errors": f"""WITH b AS (SELECT p_partkey AS site, {_state('p_partkey')} AS state, p_brand AS value FROM part),
        p AS (SELECT site, CASE WHEN site % 7 = 0 THEN 'missing' ELSE state END AS state, CASE WHEN site % 4 = 0 THEN NULL ELSE value END AS value FROM b WHERE site % 17 <> 0)
        SELECT b.site, CASE WHEN p.site IS NULL THEN 'field is not labelled' WHEN p.state <> b.state THEN 'wrong state' WHEN p.state = 'verified' AND p.value IS DISTINCT FROM b.value THEN 'wrong value or plan context'
        WHEN p.state NOT IN ('verified', 'conflicting') AND p.value IS NOT NULL THEN 'unsupported value or evidence for nonverified state' END AS error FROM b LEFT JOIN p USING (site)""",
    "supported_values": "SELECT o_orderkey, o_orderkey % 3 <> 0 AS supported FROM orders",
    "label_rules": f"""WITH l AS (SELECT doc_id AS k, {_state('doc_id')} AS state, quality FROM labels) SELECT k AS doc_id, concat_ws('|',
        CASE WHEN k % 6 = 0 OR quality IS NULL THEN 'no measured reviewer time' END, CASE WHEN k % 8 = 0 THEN 'wrong plan' END, CASE WHEN state = 'verified' AND k % 3 = 0 THEN 'no evidence' END,
        CASE WHEN state = 'verified' AND k % 4 = 0 THEN 'no rationale' END, CASE WHEN state = 'conflicting' AND k % 2 = 0 THEN 'too few candidates' END,
        CASE WHEN state IN ('missing', 'blocked', 'unverified') AND (k % 2 = 0 OR k % 3 > 0) THEN 'unsupported value' END) AS violations FROM l""",
    "gate_checks": """WITH f AS (SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_suppkey % 2 = 0),
        q AS (SELECT count(*) FILTER (l_returnflag <> 'R') AS accepted, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber <> 7) AS good, count(*) AS n FROM f),
        h AS (SELECT sum(90.0) AS base_s, sum(s_suppkey % 40 + 20.0) AS review_s, sum(s_suppkey % 2) AS corrected, count(*) AS baseline FROM supplier WHERE s_suppkey % 2 = 0),
        a AS (SELECT sum(s_suppkey % 40 + 20.0 + 30.0 + 90.0) / 3600 * 36.0 + sum(0.25) AS usd, count(*) FILTER (s_suppkey % 4 <> 0) AS done FROM supplier),
        c AS (SELECT accepted = good AS critical_claims, true AS evidence_valid_check, round_even(good / nullif(accepted, 0), 4) >= 0.95 AS precision, accepted >= 24 AS accepted_count, round_even(good / nullif(n, 0), 4) >= 0.5 AS recall,
        round_even((base_s - review_s) / base_s, 4) >= 0.25 AS review_time, corrected <= baseline AS review_error, true AS robots_scope_policy, true AS access_failure_count, true AS request_bounds,
        round_even(usd / nullif(done, 0), 4) <= 5 AS cost_ceiling, CAST(round_even(usd / nullif(done, 0), 4) AS DOUBLE) AS usd_per_row FROM q, h, a)
        SELECT *, CASE WHEN critical_claims AND precision AND accepted_count AND recall AND review_time AND review_error AND cost_ceiling THEN 'go' ELSE 'no-go' END AS decision FROM c""",
    "tenant_metrics": f"""WITH log AS (SELECT user_id AS tenant, event_id // 4 AS job_id, event_id % 3 AS p, {_state('event_id')} AS state FROM events),
        j AS (SELECT tenant, job_id, max(p) AS p, count(*) FILTER (state = 'verified') AS v, count(*) FILTER (state = 'conflicting') AS c, count(*) FILTER (state = 'missing') AS m, count(*) FILTER (state = 'blocked') AS b, count(*) FILTER (state = 'unverified') AS u FROM log GROUP BY ALL),
        t AS (SELECT tenant, count(*) AS jobs, sum(p) AS p, sum(v) AS v, sum(c) AS c, sum(m) AS m, sum(b) AS b, sum(u) AS u FROM j GROUP BY 1),
        n AS (SELECT c_custkey AS tenant FROM customer UNION SELECT user_id FROM events)
        SELECT tenant, coalesce(jobs, 0) AS jobs, CAST(coalesce(p, 0) AS BIGINT) AS pages_fetched, CAST(coalesce(v, 0) AS BIGINT) AS verified_fields, CAST(coalesce(c, 0) AS BIGINT) AS conflicting_fields, CAST(coalesce(m, 0) AS BIGINT) AS missing_fields,
        CAST(coalesce(b, 0) AS BIGINT) AS blocked_fields, CAST(coalesce(u, 0) AS BIGINT) AS unverified_fields FROM n LEFT JOIN t USING (tenant)""",
    "recent_jobs": """WITH r AS (SELECT o_custkey AS tenant, o_orderkey AS job_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders)
        SELECT * FROM r WHERE rank <= 12""",
    "retention_survivors": f"SELECT l_orderkey AS job_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '{records.NOW}' - INTERVAL 7 DAYS GROUP BY 1",
    "deleted_jobs": "SELECT o_custkey AS tenant, count(*) AS jobs FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1",
    "review_minutes": f"WITH {_SESSIONS} SELECT job_id, field_name, CAST(sum(seconds) AS DOUBLE) AS time_spent_seconds, count(*) AS sessions FROM s WHERE seconds IS NOT NULL GROUP BY 1, 2",
    "label_totals": f"""WITH {_SESSIONS}, l AS (SELECT job_id, field_name, max(event_id) % 3 <> 0 AS right_ FROM s GROUP BY 1, 2),
        r AS (SELECT job_id, count(*) AS reviewed_fields, count(*) FILTER (right_ AND job_id % 2 = 0) AS accepted FROM l GROUP BY 1), m AS (SELECT job_id, sum(seconds) AS t FROM s WHERE seconds IS NOT NULL GROUP BY 1)
        SELECT job_id, reviewed_fields, accepted, CAST(round_even(coalesce(CAST(t AS DOUBLE), 0) / 60, 4) AS DOUBLE) AS minutes FROM r LEFT JOIN m USING (job_id)""",
    "label_envelopes": f"""WITH {_SESSIONS}, l AS (SELECT job_id, field_name, max(event_id) % 4 <> 0 AS right_ FROM s WHERE event_id % 2 = 0 GROUP BY 1, 2), r AS (SELECT job_id, count(*) AS n, count(*) FILTER (right_ AND job_id % 3 <> 0) AS ok FROM l GROUP BY 1),
        m AS (SELECT job_id, coalesce(CAST(sum(seconds) AS DOUBLE), 0) / 60 AS t, coalesce(string_agg(CAST(event_id AS VARCHAR) || CASE WHEN event_id % 4 = 0 THEN 'wrong' ELSE 'correct' END, '|' ORDER BY event_id) FILTER (event_id % 2 = 0), '') AS history,
            string_agg(field_name || CASE WHEN seconds IS NULL THEN '?' ELSE '' END, '|' ORDER BY started_at, field_name, event_id) AS sessions, coalesce(string_agg(md5(CAST(event_id AS VARCHAR)), '|' ORDER BY event_id) FILTER (event_id % 3 > 0), '') AS hashes FROM s GROUP BY 1)
        SELECT job_id, coalesce(n, 0) AS reviewed_fields, round_even(t, 4) AS review_minutes_total, CASE WHEN ok > 0 THEN CAST(floor(round_even(t / ok, 4) * 10) AS BIGINT) END AS tenths_per_accepted, history, sessions, hashes FROM m LEFT JOIN r USING (job_id)""",
    "replay_reports": f"""WITH {_SCORED}, x AS (SELECT scored.*, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 AS odd, source FROM scored JOIN documents USING (doc_id)),
        g AS (SELECT CASE WHEN s = 2 THEN 'all' WHEN s = 1 THEN 'development' ELSE 'held_out' END AS split, x.* FROM x, (VALUES (0), (1), (2)) v(s) WHERE s = 2 OR odd = s),
        c AS (SELECT split, category, {_COUNTS} FROM g GROUP BY 1, 2), t AS (SELECT split, {_COUNTS} FROM g GROUP BY 1), n AS (SELECT split, string_agg(category || '=' || correct_accepted, '|' ORDER BY category) AS categories FROM c GROUP BY 1),
        d AS (SELECT CASE WHEN s = 2 THEN 'all' WHEN s = 1 THEN 'development' ELSE 'held_out' END AS split, count(DISTINCT source) AS sites FROM documents, (VALUES (0), (1), (2)) v(s) WHERE s = 2 OR CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 2 = s GROUP BY 1)
        SELECT split, split AS told_split, sites, true AS offline_replay, fields, expected_values, accepted, correct_accepted, round_even(correct_accepted / nullif(accepted, 0), 4) AS field_precision, round_even(correct_accepted / nullif(expected_values, 0), 4) AS field_recall, categories FROM t JOIN n USING (split) JOIN d USING (split)""",
    "host_start_gaps": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS t0 FROM events), g AS (SELECT event_id AS seq, t0 - lag(t0) OVER w AS gap, lag(t0) OVER w + 2 - t0 AS o FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id))
        SELECT seq, round_even(gap, 3) AS gap, round_even(greatest(0, coalesce(o, 0)), 3) AS overlap, coalesce(gap >= 1, true) AS kept FROM g""",
    "session_overlap": f"""WITH {_SESSIONS}, o AS (SELECT job_id, started_at, lag(started_at) OVER (PARTITION BY job_id ORDER BY started_at) + 3600 AS p FROM s WHERE seconds IS NOT NULL)
        SELECT job_id, count(*) AS overlaps FROM o WHERE p > started_at GROUP BY 1""",
    "claim_first_owner": """SELECT CAST(user_id AS VARCHAR) AS tenant, event_type AS idem, 'owner' AS outcome, min(event_id) AS seq FROM events WHERE event_id % 6 IN (0, 3) GROUP BY 1, 2""",
    "inventory_balance": """WITH r AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'held_out' ELSE 'development' END AS split, (['article', 'organization_service', 'product', 'saas_pricing'])[(s_suppkey // 2) % 4 + 1] AS page_type FROM supplier),
        w AS (SELECT unnest(['article', 'organization_service', 'product', 'saas_pricing']) AS page_type, split FROM (VALUES ('development'), ('held_out')) v(split))
        SELECT w.split, w.page_type, count(r.split) AS n, count(r.split) = 3 AS balanced FROM w LEFT JOIN r ON r.split = w.split AND r.page_type = w.page_type GROUP BY 1, 2""",
    "target_violations": """WITH k AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 20 = 0 THEN c_custkey - 1 ELSE c_custkey END AS h FROM customer),
        n AS (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM k)
        SELECT k AS c_custkey, concat_ws('|', CASE WHEN k % 7 = 0 THEN 'incomplete' END, CASE WHEN h IS NULL THEN 'seed URL' END, CASE WHEN h IS NULL THEN 'allowed hosts' END, CASE WHEN c > 1 THEN 'repeated host' END,
        CASE WHEN k % 8 = 0 THEN 'limits' END, CASE WHEN k % 11 = 0 THEN 'paid without account' END) AS violations, 'selection_status' AS pending FROM n""",
    **audits.ORACLE_SQL,
}
