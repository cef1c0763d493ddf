"""DuckDB SQL for the queries of catalog.py."""

TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]{{1,}}'), lambda x: lower(x))"
DOCS = "code AS (SELECT concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS path, text, source, lang, doc_id, n_chars FROM documents)"
_OWN = "concat_ws(' ', path, lang, text)"
TF = DOCS + ", tok AS (SELECT path, unnest(" + TOKENS.format("text") + ") AS term FROM code), tf AS (SELECT path, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM code)"
VOTES = """votes AS (
  SELECT doc_id AS case_id, 'scan' AS expert, list_extract(['VULNERABLE','SAFE','ABSTAIN'], n_chars % 3 + 1) AS label, (50 + (n_chars % 11) * 5) / 100.0::DOUBLE AS confidence, 0 AS vote_order FROM documents
  UNION ALL SELECT doc_id, 'taint', list_extract(['VULNERABLE','SAFE','ABSTAIN'], (n_chars // 3) % 3 + 1), (50 + (doc_id % 11) * 5) / 100.0::DOUBLE, 1 FROM documents
  UNION ALL SELECT doc_id, 'authz', list_extract(['VULNERABLE','SAFE','ABSTAIN'], (doc_id * 7 + 1) % 3 + 1), (50 + ((n_chars // 5) % 11) * 5) / 100.0::DOUBLE, 2 FROM documents)"""
EXEC = """ex AS (SELECT conv_id AS case_id, turn AS position, list_extract(['scan','taint','authz'], (turn + conv_id) % 3 + 1) AS expert, list_extract(['VULNERABLE','SAFE','ABSTAIN'], length(text) % 3 + 1) AS label, (50 + (length(text) % 11) * 5) / 100.0::DOUBLE AS confidence, length(text) % 7 AS calls FROM conversations)"""
PRED = """pred AS (SELECT doc_id AS case_id, system, quality = 1 AS actual, list_extract(['VULNERABLE','SAFE','VULNERABLE','SAFE','ABSTAIN'], (n_chars + doc_id * CAST(substr(system, 2, 1) AS INT)) % 5 + 1) AS label, lang AS category, lang IN ('en','de') AS is_primary FROM labels JOIN documents USING (doc_id), (SELECT unnest(['V1','V2','V3']) AS system))"""
RES = """res0 AS (SELECT *, CAST(substr(system, 2, 1) AS INT) AS k FROM labels, (SELECT unnest(['E1','E2']) AS system)),
res1 AS (SELECT *, CASE (doc_id * k) % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'not_run' WHEN 2 THEN 'abstained' ELSE 'completed' END AS status FROM res0),
res AS (SELECT doc_id AS case_id, system, status, CASE WHEN status = 'completed' THEN CASE WHEN (doc_id + k) % 4 <> 0 THEN 'VULNERABLE' ELSE 'SAFE' END END AS predicted_label, CASE WHEN quality = 1 THEN 'VULNERABLE' ELSE 'SAFE' END AS ground_truth, doc_id % 5 AS model_calls, doc_id % 3 AS tool_calls FROM res1)"""
JOUR = """j AS (SELECT event_id AS seq, ts AS time, user_id % 20 AS stream, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'received' WHEN 'purchase' THEN 'reply' WHEN 'signup' THEN 'invalid' WHEN 'error' THEN 'error' END AS event, CAST(event_id % 3000 AS VARCHAR) AS request_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""
EDGES = """e AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
SPANS = "spans AS (SELECT source AS file, CAST(doc_id AS VARCHAR) AS path, lang AS symbol, doc_id AS first, doc_id + n_chars // 50 AS last FROM documents)"
POINTS = "points AS (SELECT doc_id AS point_id, source AS file, doc_id + n_chars % 7 AS line, CASE WHEN toxic = 1 THEN 'fr' ELSE 'none' END AS symbol FROM labels JOIN documents USING (doc_id))"
ENTRIES = "entries AS (SELECT doc_id AS entry_id, source AS repo, 'c' || (n_chars % 5) AS commit, doc_id % 97 AS report_id, n_chars % 4 <> 0 AS verified FROM documents)"
WORDS = r"[\p{L}\p{N}_\p{M}]+|[^\p{L}\p{N}_\p{M}\s]"


def _rate(top: str, bottom: str) -> str:
    return f"CASE WHEN ({bottom}) = 0 THEN NULL ELSE CAST({top} AS DOUBLE) / ({bottom}) END"


def _wilson(s: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054::DOUBLE"
    c = f"(CAST({s} AS DOUBLE)/({n}) + {z}*{z}/(2*({n}))) / (1 + {z}*{z}/({n}))"
    r = f"{z} * sqrt((CAST({s} AS DOUBLE)/({n}))*(1-CAST({s} AS DOUBLE)/({n}))/({n}) + {z}*{z}/(4.0*({n})*({n}))) / (1 + {z}*{z}/({n}))"
    return f"round(CASE WHEN ({n}) > 0 THEN greatest(0.0, {c} - {r}) END, 9)", f"round(CASE WHEN ({n}) > 0 THEN least(1.0, {c} + {r}) END, 9)"


_BM25 = f"""WITH {TF.replace('unnest(' + TOKENS.format('text') + ')', 'unnest(' + TOKENS.format(_OWN) + ')')}, len AS (SELECT path, sum(tf) AS len FROM tf GROUP BY path), tot AS (SELECT sum(len) AS total FROM len),
q AS (SELECT item_id AS query_id, unnest(list_distinct({TOKENS.format("'bench/item' || item_id || ' ' || text")})) AS term FROM benchmark),
s AS (SELECT query_id, path, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / (CAST(total AS DOUBLE) / n)))), 9) AS score
  FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (path), n, tot GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 5 AND score > 0)"""


def _tfidf(tf: str, asked: str, k: int) -> str:
    """Scores of asked (query_id, query) over the terms of tf, with what paths add."""
    return f"""WITH {tf}, a AS ({asked}), p AS (SELECT query_id, query, regexp_matches(query, '/|::|\\.|\\\\') AS path_like FROM a),
q AS (SELECT query_id, path_like, unnest({TOKENS.format('query')}) AS term FROM p), qc AS (SELECT query_id, path_like, term, count(*) AS q FROM q GROUP BY ALL),
pt AS (SELECT path, unnest({TOKENS.format('path')}) AS term FROM code), ptf AS (SELECT path, term, count(*) AS tf FROM pt GROUP BY ALL),
fr AS (SELECT DISTINCT query_id, trim(unnest(regexp_extract_all(lower(query), '[A-Za-z0-9_./\\\\-]+\\.[A-Za-z0-9_./\\\\-]+')), '.,;:') AS part, 1000 AS worth FROM a UNION ALL SELECT query_id, trim(lower(query)), 50 FROM p WHERE path_like AND trim(query) <> ''),
s AS (SELECT query_id, path, round(sum(s), 9) AS score FROM (SELECT query_id, path, q * (1 + ln(tf)) * (ln((n + 1)::DOUBLE / (df + 1)) + 1) AS s FROM tf JOIN qc USING (term) JOIN df USING (term), n
  UNION ALL SELECT query_id, path, q * (4 + ln(tf)) FROM ptf JOIN qc USING (term) WHERE path_like UNION ALL SELECT query_id, path, worth FROM fr JOIN code ON contains(lower(path), part)) GROUP BY ALL),
ti AS (SELECT * FROM (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= {k} AND score > 0)"""


_TFIDF = _tfidf(TF, "SELECT item_id AS query_id, text AS query FROM benchmark", 5)
_PATHS = _tfidf(TF.replace("CAST(doc_id AS VARCHAR)) AS path", "CAST(doc_id AS VARCHAR)) || '.py' AS path"), "SELECT CAST(n_nationkey AS BIGINT) AS query_id, CASE n_nationkey % 3 WHEN 0 THEN 'Src' WHEN 1 THEN 'see en/' ELSE 'the license ' END || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.py.' ELSE '/en' END AS query FROM nation", 8)
_BFS = f"""{EDGES}, back AS (SELECT dst AS src, src AS dst FROM e),
h0 AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS path FROM region), h1 AS (SELECT DISTINCT seed, dst AS path FROM h0 JOIN back ON path = src), h2 AS (SELECT DISTINCT seed, dst AS path FROM h1 JOIN back ON path = src), h3 AS (SELECT DISTINCT seed, dst AS path FROM h2 JOIN back ON path = src),
bfs AS (SELECT seed, path, min(d) AS distance FROM (SELECT *, 0 AS d FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY ALL)"""
_MAJ = """t AS (SELECT case_id, count(*) FILTER (label = 'VULNERABLE') AS nv, count(*) FILTER (label = 'SAFE') AS ns, avg(confidence) FILTER (label = 'VULNERABLE') AS cv, avg(confidence) FILTER (label = 'SAFE') AS cs, max(confidence) FILTER (label <> 'ABSTAIN') AS top FROM votes GROUP BY case_id)"""
_FAST = """t AS (SELECT case_id, count(*) FILTER (label = 'VULNERABLE') AS nv, count(*) FILTER (label = 'SAFE') AS ns, avg(confidence) FILTER (label = 'VULNERABLE') AS cv, avg(confidence) FILTER (label = 'SAFE') AS cs, min(vote_order) FILTER (label = 'VULNERABLE') AS fv, min(vote_order) FILTER (label = 'SAFE') AS fs FROM {0} WHERE label <> 'ABSTAIN' AND confidence >= 0.8::DOUBLE GROUP BY case_id),
f AS (SELECT case_id, CASE WHEN greatest(nv, ns) < 2 THEN NULL WHEN nv > ns OR (nv = ns AND fv < fs) THEN 'VULNERABLE' ELSE 'SAFE' END AS label, cv, cs FROM t)"""
_TERN = """count(*) FILTER (actual AND label = 'VULNERABLE') AS tp, count(*) FILTER (NOT actual AND label = 'VULNERABLE') AS fp, count(*) FILTER (NOT actual AND label = 'SAFE') AS tn, count(*) FILTER (actual AND label = 'SAFE') AS fn, count(*) FILTER (actual AND label = 'ABSTAIN') AS abstain_positive, count(*) FILTER (NOT actual AND label = 'ABSTAIN') AS abstain_negative"""
_RL, _RH = _wilson("tp", "positives")
_FL, _FH = _wilson("fp", "negatives")

ORACLES = {
    "term_statistics": f"WITH {TF} SELECT term, df, round(ln((n + 1)::DOUBLE / (df + 1)) + 1, 9) AS idf FROM df, n",
    "bm25_topk": _BM25 + " SELECT * FROM bm",
    "tfidf_topk": _TFIDF + " SELECT * FROM ti",
    "path_search": _PATHS + " SELECT * FROM ti",
    "context_budget": _BM25 + rf""", w AS (SELECT query_id, rank, path, len(regexp_extract_all(text, '{WORDS}')) AS n FROM bm JOIN code USING (path)),
c AS (SELECT *, 2000 - (sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) - n) AS room FROM w WHERE n > 0)
SELECT query_id, rank, path, CAST(least(n, room) AS BIGINT) AS n_tokens FROM c WHERE room > 0""",
    "hybrid_search": _BM25 + f""", ti AS (SELECT * FROM ({_TFIDF} SELECT * FROM ti)), u AS (SELECT query_id, path, rank, 0 AS branch FROM bm UNION ALL SELECT query_id, path, rank, 1 FROM ti),
f AS (SELECT query_id, path, min(branch * 1000 + rank) AS o FROM u GROUP BY ALL)
SELECT * FROM (SELECT query_id, path, CAST(o // 1000 AS INT) AS branch, row_number() OVER (PARTITION BY query_id ORDER BY o, path) AS rank FROM f) WHERE rank <= 8""",
    "graph_bfs": f"WITH {_BFS} SELECT * FROM bfs",
    "graph_rank": f"""WITH {_BFS}, s AS (SELECT seed AS query_id, path, distance, round(1.0::DOUBLE / (1 + distance), 9) AS score FROM bfs)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, path) AS rank FROM s) WHERE rank <= 12""",
    "graph_edges": """WITH d AS (SELECT DISTINCT 'p' || p_partkey AS dst, p_brand AS symbol FROM part UNION SELECT DISTINCT 's' || s_suppkey, s_name FROM supplier),
o AS (SELECT dst, symbol FROM d WHERE contains(symbol, '.') OR symbol IN (SELECT symbol FROM d GROUP BY symbol HAVING count(*) = 1)),
c AS (SELECT 'o' || l_orderkey AS src, unnest([p_brand, s_name]) AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT DISTINCT src, dst FROM c JOIN o USING (symbol) WHERE src <> dst""",
    "reply_closure": """WITH RECURSIVE e AS (SELECT conv_id || ':' || turn AS src, conv_id || ':' || (turn - 1) AS dst FROM conversations WHERE turn > 0), r AS (SELECT src AS seed, dst AS path, 1 AS h FROM e UNION ALL SELECT seed, e.dst, h + 1 FROM r JOIN e ON path = e.src WHERE h < 8) SELECT DISTINCT seed, path FROM r""",
    "quorum_majority": f"""WITH {VOTES}, {_MAJ} SELECT case_id, CASE WHEN nv = ns OR greatest(nv, ns) < 2 THEN 'ABSTAIN' WHEN nv > ns THEN 'VULNERABLE' ELSE 'SAFE' END AS label, round(CASE WHEN nv = ns OR greatest(nv, ns) < 2 THEN coalesce(top, 0) WHEN nv > ns THEN cv ELSE cs END, 9) AS confidence FROM t""",
    "quorum_fast": f"""WITH {VOTES}, {_FAST.format('votes')} SELECT v.case_id, label, round(CASE label WHEN 'VULNERABLE' THEN cv WHEN 'SAFE' THEN cs END, 9) AS confidence FROM (SELECT DISTINCT case_id FROM votes) v LEFT JOIN f USING (case_id)""",
    "single_vote": f"WITH {VOTES} SELECT case_id, label, confidence FROM votes WHERE vote_order = 0",
    "last_ballots": f"WITH {EXEC} SELECT case_id, expert, arg_max(label, position) AS label, arg_max(confidence, position) AS confidence, max(position) AS position, sum(calls)::BIGINT AS calls FROM ex GROUP BY case_id, expert",
    "quorum_replay": f"""WITH {EXEC}, b AS (SELECT case_id, expert, arg_max(label, position) AS label, arg_max(confidence, position) AS confidence, max(position) AS position FROM ex GROUP BY case_id, expert),
edge AS (SELECT case_id, max(position) FILTER (expert IN ('scan','taint')) AS cut, count(*) FILTER (expert IN ('scan','taint')) AS n, min(position) FILTER (expert = 'authz') AS other FROM b GROUP BY case_id),
ok AS (SELECT * FROM edge WHERE n = 2 AND coalesce(other, 2147483647) > cut), bb AS (SELECT *, CASE expert WHEN 'scan' THEN 0 ELSE 1 END AS vote_order FROM b WHERE expert IN ('scan','taint')), {_FAST.format('bb')},
g AS (SELECT ok.case_id, cut, label FROM ok JOIN f USING (case_id) WHERE label IS NOT NULL)
SELECT ex.case_id, max(g.label) IS NOT NULL AS eligible, max(g.label) AS label, coalesce(sum(calls) FILTER (position > cut), 0)::BIGINT AS saved_calls FROM ex LEFT JOIN g USING (case_id) GROUP BY ex.case_id""",
    "cost_rollup": f"WITH {EXEC} SELECT case_id, sum(calls)::BIGINT AS calls, count(*) AS tasks, count(DISTINCT expert) AS experts FROM ex GROUP BY case_id",
    "binary_metrics": f"""WITH {PRED}, c AS (SELECT category, count(*) FILTER (actual AND label = 'VULNERABLE') AS tp, count(*) FILTER (NOT actual AND label = 'VULNERABLE') AS fp, count(*) FILTER (NOT actual AND label <> 'VULNERABLE') AS tn, count(*) FILTER (actual AND label <> 'VULNERABLE') AS fn FROM pred WHERE system = 'V1' GROUP BY GROUPING SETS ((), (category)))
SELECT *, {_rate('tp', 'tp + fn')} AS recall, {_rate('fp', 'fp + tn')} AS fpr, {_rate('tp', 'tp + fp')} AS precision FROM c""",
    "ternary_metrics": f"""WITH {PRED}, c AS (SELECT system, {_TERN} FROM pred GROUP BY system)
SELECT *, {_rate('tp + fp + tn + fn', 'tp + fp + tn + fn + abstain_positive + abstain_negative')} AS coverage, {_rate('abstain_positive + abstain_negative', 'tp + fp + tn + fn + abstain_positive + abstain_negative')} AS abstain_rate, {_rate('tp', 'tp + fn + abstain_positive')} AS strict_recall, {_rate('tp', 'tp + fn')} AS covered_recall,
{_rate('fp', 'fp + tn + abstain_negative')} AS population_fpr, {_rate('fp + abstain_negative', 'fp + tn + abstain_negative')} AS conservative_fpr, {_rate('fp', 'fp + tn')} AS covered_fpr, {_rate('tp', 'tp + fp')} AS precision FROM c""",
    "failure_metrics": f"""WITH {RES}, c AS (SELECT system, count(*) FILTER (status = 'completed' AND ground_truth = 'VULNERABLE' AND predicted_label = 'VULNERABLE') AS tp, count(*) FILTER (status = 'completed' AND ground_truth = 'SAFE' AND predicted_label = 'VULNERABLE') AS fp, count(*) FILTER (status = 'completed' AND ground_truth = 'SAFE' AND predicted_label = 'SAFE') AS tn, count(*) FILTER (status = 'completed' AND ground_truth = 'VULNERABLE' AND predicted_label = 'SAFE') AS fn,
count(*) FILTER (status = 'abstained') AS abstained, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'interrupted') AS interrupted, count(*) FILTER (status = 'not_run') AS not_run, count(*) AS total, count(*) FILTER (ground_truth = 'VULNERABLE') AS positives, sum(model_calls)::BIGINT AS model_requests, sum(tool_calls)::BIGINT AS tool_calls, count(*) FILTER (ground_truth = 'SAFE') AS negatives FROM res GROUP BY system)
SELECT *, not_run > 0 OR interrupted > 0 AS provisional, {_rate('tp + fp + tn + fn', 'total')} AS coverage, {_rate('tp', 'positives')} AS strict_recall, {_rate('tp', 'tp + fn')} AS covered_recall, {_rate('tp', 'tp + fp')} AS precision, {_rate('fp', 'negatives')} AS population_fpr, {_rate('fp', 'fp + tn')} AS covered_fpr, {_rate('negatives - tn', 'negatives')} AS conservative_fpr, {_rate('tp + tn', 'total')} AS accuracy,
CASE WHEN not_run + interrupted = 0 THEN {_RL} END AS recall_low, CASE WHEN not_run + interrupted = 0 THEN {_RH} END AS recall_high, CASE WHEN not_run + interrupted = 0 THEN {_FL} END AS fpr_low, CASE WHEN not_run + interrupted = 0 THEN {_FH} END AS fpr_high FROM c""",
    "wilson_intervals": f"""WITH c AS (SELECT source, count(*) AS total, count(*) FILTER (lang = 'en') AS success FROM documents GROUP BY source) SELECT source, success, total, {_wilson('success', 'total')[0]} AS low, {_wilson('success', 'total')[1]} AS high FROM c""",
    "paired_comparison": f"""WITH {RES}, p AS (SELECT a.status IN ('failed','interrupted','not_run') OR b.status IN ('failed','interrupted','not_run') AS off, a.predicted_label IS NOT DISTINCT FROM a.ground_truth AS l, b.predicted_label IS NOT DISTINCT FROM b.ground_truth AS r, a.predicted_label IS DISTINCT FROM b.predicted_label AS d FROM res a JOIN res b USING (case_id) WHERE a.system = 'E1' AND b.system = 'E2')
SELECT count(*) FILTER (NOT off AND l AND NOT r) AS left_wins, count(*) FILTER (NOT off AND NOT l AND r) AS right_wins, count(*) FILTER (NOT off AND l = r) AS ties, count(*) FILTER (off) AS unavailable, count(*) FILTER (NOT off AND d) AS disagreements FROM p""",
    "label_transitions": f"WITH {PRED} SELECT a.actual, a.label || '->' || b.label AS transition, count(*) AS n FROM pred a JOIN pred b USING (case_id) WHERE a.system = 'V1' AND b.system = 'V3' GROUP BY ALL",
    "subset_report": f"""WITH {PRED}, c AS (SELECT *, label = 'VULNERABLE' AS v FROM pred)
SELECT system, 'overall' AS level, NULL AS category, count(*) AS n, count(*) FILTER (actual AND v) AS tp, count(*) FILTER (NOT actual AND v) AS fp, count(*) FILTER (label = 'ABSTAIN') AS abstained FROM c GROUP BY system
UNION ALL SELECT system, 'category', category, count(*), count(*) FILTER (actual AND v), count(*) FILTER (NOT actual AND v), count(*) FILTER (label = 'ABSTAIN') FROM c GROUP BY system, category
UNION ALL SELECT system, 'primary', NULL, count(*), count(*) FILTER (actual AND v), count(*) FILTER (NOT actual AND v), count(*) FILTER (label = 'ABSTAIN') FROM c WHERE is_primary GROUP BY system""",
    "rule_scan": r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, unnest(x) AS code FROM (SELECT doc_id, CASE WHEN s[-1] = '' THEN s[:-2] ELSE s END AS x FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS s FROM documents)))
SELECT doc_id, CAST(line AS INT) AS line, rule FROM l, (VALUES ('long-number', '[0-9]{6,}'), ('assignment', '\b(?:token|password|secret)\s*='), ('mail', '[A-Za-z0-9.]+@[A-Za-z0-9.]+')) r(rule, p) WHERE regexp_matches(code, p)""",
    "rule_smallest_span": f"""WITH {SPANS}, h AS (SELECT s.file, p.first AS source_line, s.symbol AS rule, s.path, s.last - s.first AS n_lines, s.path LIKE '%0' AS is_module FROM spans s JOIN spans p ON s.file = p.file AND s.first <= p.first AND p.first <= s.last)
SELECT file, source_line, rule, path FROM (SELECT *, row_number() OVER (PARTITION BY file, source_line, rule ORDER BY n_lines, is_module, path) AS r FROM h) WHERE r = 1""",
    "span_locate": f"""WITH {SPANS}, {POINTS}, b AS (SELECT point_id, s.path, row_number() OVER (PARTITION BY point_id ORDER BY last - first, first, path) AS r FROM points p JOIN spans s ON s.file = p.file AND first <= line AND line <= last)
SELECT p.point_id, file, line, path FROM points p LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (point_id)""",
    "nearest_document": f"""WITH {SPANS}, {POINTS}, j AS (SELECT point_id, path, first, last, line, CASE WHEN s.symbol = p.symbol THEN 0 WHEN first <= line AND line <= last THEN 1 ELSE 2 END AS tier FROM points p JOIN spans s USING (file)), c AS (SELECT *, CASE WHEN tier = 2 THEN abs(first - line) ELSE last - first END AS cost FROM j)
SELECT point_id, path, tier FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY tier, cost, path) AS r FROM c) WHERE r = 1""",
    "merged_ranges": f"""WITH {SPANS}, m AS (SELECT *, max(last) OVER (PARTITION BY file ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans), i AS (SELECT *, sum(CASE WHEN b IS NULL OR first > b THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY first, last ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT file, min(first) AS first, max(last) AS last FROM i GROUP BY file, island""",
    "discovery_score": f"""WITH cand AS (SELECT doc_id AS case_id, source AS repo, lang AS commit, n_chars AS file, doc_id % 9 AS line FROM documents), refs AS (SELECT doc_id AS entry_id, source AS repo, lang AS commit, n_chars AS file, (doc_id + toxic) % 9 AS line, doc_id % 50 AS report_id FROM labels JOIN documents USING (doc_id)), {RES},
said AS (SELECT DISTINCT system, case_id, repo, commit, file, line FROM res JOIN cand USING (case_id) WHERE status = 'completed' AND predicted_label = 'VULNERABLE'),
hit AS (SELECT system, count(DISTINCT entry_id) AS d, count(DISTINCT (repo, report_id)) AS a FROM refs JOIN said USING (repo, commit, file, line) GROUP BY system),
stray AS (SELECT system, count(DISTINCT case_id) AS u FROM said WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.repo = said.repo AND refs.commit = said.commit AND refs.file = said.file AND refs.line = said.line) GROUP BY system),
st AS (SELECT system, count(*) FILTER (status IN ('completed','abstained')) AS reviewed FROM res GROUP BY system)
SELECT system, coalesce(d, 0) AS detected_entries, coalesce(a, 0) AS detected_advisories, coalesce(u, 0) AS unmatched, CAST(coalesce(d, 0) AS DOUBLE) / (SELECT count(*) FROM refs) AS recall, (SELECT count(*) FROM cand) - reviewed AS unreviewed, reviewed <> (SELECT count(*) FROM cand) AS provisional FROM st LEFT JOIN hit USING (system) LEFT JOIN stray USING (system)""",
    "planned_vs_observed": f"""WITH {RES}, obs AS (SELECT case_id, system, status, model_calls AS calls FROM res WHERE status <> 'not_run'), plan AS (SELECT doc_id AS case_id, system, lang AS truth FROM documents, (SELECT unnest(['E1','E3']) AS system))
SELECT case_id, system, coalesce(status, 'not_run') AS status, coalesce(calls, 0) AS calls, truth, TRUE AS planned FROM plan LEFT JOIN obs USING (case_id, system)
UNION ALL SELECT case_id, system, status, calls, NULL, FALSE FROM obs WHERE (case_id, system) NOT IN (SELECT case_id, system FROM plan)""",
    "acceptance_issues": f"""WITH {RES}, plan AS (SELECT doc_id AS case_id, system, CASE WHEN n_chars % 2 = 0 THEN 'VULNERABLE' ELSE 'SAFE' END AS truth FROM documents, (SELECT unnest(['E1']) AS system)), s AS (SELECT case_id, system, count(*) AS n, min(status) AS status, min(predicted_label) AS label FROM res GROUP BY ALL),
b AS (SELECT coalesce(plan.case_id, s.case_id) AS case_id, coalesce(plan.system, s.system) AS system, truth, plan.case_id IS NOT NULL AS p, n, status, label FROM plan FULL JOIN s ON plan.case_id = s.case_id AND plan.system = s.system)
SELECT case_id, system, 'missing' AS issue, 'run_integrity' AS category FROM b WHERE n IS NULL UNION ALL SELECT case_id, system, 'unexpected', 'run_integrity' FROM b WHERE NOT p UNION ALL SELECT case_id, system, 'duplicate', 'run_integrity' FROM b WHERE n > 1
UNION ALL SELECT case_id, system, 'status', 'run_integrity' FROM b WHERE p AND n = 1 AND status NOT IN ('completed','abstained') UNION ALL SELECT case_id, system, 'label', 'detection_quality' FROM b WHERE p AND n = 1 AND status = 'completed' AND label IS DISTINCT FROM truth""",
    "stratified_sample": """SELECT doc_id, lang, source, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256('quillet-sample-1:' || doc_id), CAST(doc_id AS VARCHAR)) AS place FROM documents WHERE lang IS NOT NULL) WHERE place <= 3""",
    "heldout_split": f"""WITH {ENTRIES}, dev AS (SELECT 'src0' AS repo UNION ALL SELECT 'src7'), used AS (SELECT DISTINCT report_id FROM entries WHERE repo IN (SELECT repo FROM dev))
SELECT entry_id, repo, report_id, CASE WHEN NOT verified THEN 'unverified' WHEN repo IN (SELECT repo FROM dev) THEN 'development_repository' WHEN report_id IN (SELECT report_id FROM used) THEN 'development_advisory' END AS reason FROM entries""",
    "subject_selection": f"WITH {ENTRIES}, c AS (SELECT repo, commit, count(*) AS n FROM entries WHERE verified GROUP BY ALL) SELECT repo, commit, n FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, commit) AS r FROM c) WHERE r = 1",
    "dataset_profile": f"WITH {ENTRIES} SELECT count(*) AS entries, count(*) FILTER (verified) AS verified, count(DISTINCT report_id) AS reports, count(DISTINCT repo) AS repos, count(DISTINCT (repo, commit)) AS commits FROM entries",
    "key_differences": "SELECT doc_id, 'missing' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "usage_tagged": f"""WITH {JOUR}, g AS (SELECT request_id, count(*) FILTER (event = 'start') AS s, count(*) FILTER (event = 'reply') AS r, count(*) FILTER (event = 'invalid') AS i, count(*) FILTER (event = 'received') AS rc, list(DISTINCT tokens) FILTER (event = 'received' AND tokens >= 0) AS got, list(DISTINCT tokens) FILTER (event IN ('reply','invalid') AND tokens >= 0) AS late FROM j GROUP BY request_id), t AS (SELECT *, coalesce(CASE WHEN rc > 0 THEN got ELSE late END, []) AS tot FROM g)
SELECT count(*) FILTER (s > 0) AS requests, count(*) FILTER (s > 0 AND r > 0) AS responses, count(*) FILTER (s > 0 AND i > 0) AS invalid, sum(CASE WHEN s > 0 THEN s - 1 ELSE 0 END)::BIGINT AS duplicate_starts, count(*) FILTER (s = 0 AND rc + r > 0) AS orphans, sum(CASE WHEN s > 0 AND len(tot) = 1 THEN tot[1] ELSE 0 END)::BIGINT AS tokens, count(*) FILTER (s > 0 AND len(tot) <> 1) AS unknown, count(*) FILTER (s > 0 AND len(tot) > 1) AS conflicts FROM t""",
    "usage_streams": f"""WITH {JOUR}, a AS (SELECT *, sum(CASE WHEN event = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS epoch FROM j), b AS (SELECT *, coalesce(max(CASE WHEN event = 'received' THEN 1 ELSE 0 END) OVER (PARTITION BY stream, epoch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM a), c AS (SELECT *, (event = 'received' OR (event IN ('reply','invalid') AND had = 0)) AND tokens >= 0 AS k FROM b)
SELECT stream, count(*) FILTER (event = 'start') AS requests, coalesce(sum(tokens) FILTER (k), 0)::BIGINT AS tokens, count(*) FILTER (event = 'start') - count(*) FILTER (k) AS unknown FROM c GROUP BY stream""",
    "in_flight": f"""WITH {JOUR}, a AS (SELECT *, sum(CASE WHEN event = 'start' THEN 1 WHEN event IN ('reply','error') THEN -1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS running FROM j) SELECT stream, max(running)::BIGINT AS peak, arg_max(running, seq)::BIGINT AS final, CAST(floor(epoch(max(time))) - floor(epoch(min(time))) AS BIGINT) AS seconds FROM a GROUP BY stream""",
    "transport_gaps": f"WITH {JOUR} SELECT request_id, count(*) AS starts FROM j WHERE event = 'start' AND request_id NOT IN (SELECT request_id FROM j WHERE event IN ('reply','received')) GROUP BY request_id",
    "usage_rollup": f"WITH {JOUR} SELECT stream, count(*) AS events, CASE WHEN count(*) = count(tokens) THEN sum(tokens)::BIGINT END AS tokens FROM j GROUP BY ROLLUP (stream)",
    "page_links": r"""SELECT page_id, CAST(len(h) AS INT) AS links, CAST(len(list_distinct(h)) AS INT) AS distinct_links, h[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""",
    "page_text": r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g')) AS text FROM pages""",
    "token_counts": rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,}}')) AS INT) AS identifiers, CAST(len(regexp_extract_all(text, '{WORDS}')) AS INT) AS context_tokens, CAST(octet_length(encode(text)) AS INT) AS byte_bound FROM documents",
    "retained_callees": """WITH req AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem), kept AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS i FROM lineitem WHERE l_quantity >= 10) SELECT k AS l_orderkey, bool_and((k, i) IN (SELECT k, i FROM kept)) AS complete FROM req GROUP BY k""",
    "repair_choice": """SELECT o_custkey, max(CASE WHEN p = c THEN o_orderpriority END) AS commit, count(*) FILTER (c IS NULL OR p < c) AS rejected FROM (SELECT *, o_orderkey AS p, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS c FROM orders) GROUP BY o_custkey""",
    "usage_stream": f"WITH {JOUR} SELECT stream, strftime(time, '%Y-%m-%d') AS begin, count(*) FILTER (event = 'start') AS starts, count(*) FILTER (event = 'reply') AS replies, sum(tokens)::BIGINT AS tokens FROM j GROUP BY ALL",
    "augmentation_shares": _BM25 + """, c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i FROM bm), f AS (SELECT *, least(1488 - (n - 1), greatest(1488 // n, 512)) AS first FROM c)
SELECT query_id, path, rank, CAST(CASE WHEN n = 1 THEN 1488 WHEN i = 0 THEN first ELSE (1488 - first) // (n - 1) + CASE WHEN i - 1 < (1488 - first) % (n - 1) THEN 1 ELSE 0 END END AS BIGINT) AS share FROM f""",
    "fallback_parse": r"""SELECT CAST(page_id AS VARCHAR) AS file, CAST(len(c) AS INT) AS calls, array_to_string(c, ',') AS names FROM (SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '\b([A-Za-z_]\w*)\s*\(', 1))) AS c FROM pages)""",
}
