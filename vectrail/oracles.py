"""DuckDB SQL for the registered queries, written against the driver's tables alone.

Rounding adds 3e-12 first, here as in the queries: values of at most eleven digits are then never
halfway, where the two engines round differently.
"""

from __future__ import annotations

from . import queries as q

CONTEXT = """ctx AS (SELECT event_id AS item_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS ts, CASE WHEN event_id % 7 <> 0 THEN user_id % 5 END AS geo,
  event_type AS platform, CASE WHEN event_id % 6 = 0 THEN []::VARCHAR[] ELSE [event_type, 'u' || (user_id % 3)] END AS entities, least(value / 100, 1) AS quality FROM events)"""
ITEMS = CONTEXT + """, items AS (SELECT c.*, e.label AS persona_id, e.embedding::DOUBLE[] AS emb FROM embeddings e JOIN ctx c ON c.item_id = e.vec_id)"""
PAIRS = ITEMS + """, pairs AS (SELECT a.item_id AS i, b.item_id AS j, round(list_cosine_similarity(a.emb, b.emb), 9) AS score, a.persona_id = b.persona_id AS is_genuine
  FROM items a JOIN items b ON a.item_id < b.item_id)"""


def context_score(a: str, b: str) -> str:
    geo, time, ent = f"({a}.geo IS NOT NULL AND {b}.geo IS NOT NULL)", f"({a}.ts IS NOT NULL AND {b}.ts IS NOT NULL)", f"(len({a}.entities) > 0 AND len({b}.entities) > 0)"
    weight = f"(CASE WHEN {geo} THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {time} THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {ent} THEN 0.3::DOUBLE ELSE 0 END)"
    total = (
        f"(CASE WHEN {geo} AND {a}.geo = {b}.geo THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN {time} THEN 0.3::DOUBLE * pow(0.5::DOUBLE, abs(epoch_us({a}.ts) - epoch_us({b}.ts)) / 86400e6::DOUBLE / 30) ELSE 0 END"
        f" + CASE WHEN {ent} THEN 0.3::DOUBLE * {jaccard(f'{a}.entities', f'{b}.entities')} ELSE 0 END)"
    )
    return f"(CASE WHEN {weight} > 0 THEN least(1, greatest(0, {total} / {weight})) ELSE 0::DOUBLE END)"


def jaccard(x: str, y: str) -> str:
    return f"(len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))))"


FUSE = "least(1, greatest(0, {a} * face + {b} * context))"


def curve(pairs: str, keys: str = "", part: str = "") -> str:
    """counts and points CTEs over ``pairs``; keys ends with a comma, part starts with PARTITION BY."""
    group = f"GROUP BY {keys} score" if keys else "GROUP BY score"
    by_key = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""counts AS (SELECT {keys} score, count(*) FILTER (is_genuine) AS gen, count(*) FILTER (NOT is_genuine) AS imp FROM {pairs} {group}),
 points AS (SELECT {keys} score AS threshold, (sum(imp) OVER ({part} ORDER BY score DESC))::DOUBLE / nullif(sum(imp) OVER ({part}), 0) AS fmr,
   coalesce(sum(gen) OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / nullif(sum(gen) OVER ({part}), 0) AS fnmr FROM counts
   UNION ALL SELECT {keys} nextafter(max(score), 'infinity'::DOUBLE), 0, 1 FROM counts {by_key})"""


def eer_of(keys: str, part: str) -> str:
    """e: keys, eer from points."""
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""steps AS (SELECT *, fmr - fnmr AS gap, lag(fmr) OVER w AS p_fmr, lag(fnmr) OVER w AS p_fnmr FROM points WINDOW w AS ({part} ORDER BY threshold)),
 e AS (SELECT {keys} arg_min(CASE WHEN p_fmr IS NULL THEN (fmr + fnmr) / 2 ELSE p_fmr + (p_fmr - p_fnmr) / ((p_fmr - p_fnmr) - gap) * (fmr - p_fmr) END, threshold) AS eer FROM steps WHERE gap <= 0 {group})"""


def fixed_of(target: str, keys: str, name: str = "f") -> str:
    group = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    return f"""{name} AS (SELECT {keys} arg_min(p_fmr + ({target} - p_fnmr) / (fnmr - p_fnmr) * (fmr - p_fmr), threshold) AS fmr_at_fnmr FROM steps WHERE fnmr > {target} {group})"""


SEVERITY = "severities AS (SELECT unnest([" + ", ".join(f"{s}::DOUBLE" for s in q.SEVERITIES) + "]) AS severity)"
PROBES = ITEMS + f""", {SEVERITY}, probes AS (SELECT severity, item_id, persona_id, quality, CASE WHEN severity = 0 THEN emb ELSE list_transform(emb, lambda x: floor(x / severity + 0.5) * severity) END AS v, emb FROM items, severities),
 kept AS (SELECT * FROM probes WHERE len(list_filter(v, lambda x: x <> 0)) > 0),
 cpairs AS (SELECT a.severity, a.item_id AS i, b.item_id AS j, round(list_cosine_similarity(a.v, b.emb), 9) AS score, a.persona_id = b.persona_id AS is_genuine, a.quality AS qi, b.quality AS qj
   FROM kept a JOIN kept b ON a.severity = b.severity)"""

EVIDENCE = ITEMS + """, sims AS (SELECT a.item_id AS q_id, a.persona_id AS q_persona, b.persona_id, b.item_id, round(list_cosine_similarity(a.emb, b.emb), 9) AS face FROM items a JOIN items b ON a.item_id <> b.item_id),
 best AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY q_id, persona_id ORDER BY face DESC, item_id) = 1),
 usable AS (SELECT * FROM best QUALIFY max((persona_id = q_persona)::INT) OVER (PARTITION BY q_id) = 1)"""


def scored(source: str = "usable", qctx: str = "items", extra: str = "") -> str:
    return f"""ev AS (SELECT u.*, round({context_score('qc', 'cc')}, 9) AS context, (qc.ts IS NOT NULL OR qc.geo IS NOT NULL OR len(qc.entities) > 0) AS has{extra}
  FROM {source} u JOIN {qctx} qc ON qc.item_id = u.q_id JOIN items cc ON cc.item_id = u.item_id)"""


def ranks(keys: str = "q_id", a: str = "0.7::DOUBLE", b: str = "0.3::DOUBLE") -> str:
    w = f"PARTITION BY {keys}"
    at = lambda r, c: f"max(CASE WHEN face_rank = {r} THEN {c} END) OVER ({w})"
    return f"""fu AS (SELECT *, round({FUSE.format(a=a, b=b)} + 3e-12, 9) AS fused FROM ev),
 r1 AS (SELECT *, row_number() OVER ({w} ORDER BY face DESC, persona_id) AS face_rank, row_number() OVER ({w} ORDER BY fused DESC, persona_id) AS fused_rank FROM fu),
 r2 AS (SELECT *, round({at(1, 'face')} - {at(2, 'face')}, 9) AS gap, {at(1, 'fused')} AS f1, {at(2, 'fused')} AS f2 FROM r1),
 ranked AS (SELECT *, CASE WHEN gap <= {q.GATE} THEN fused_rank ELSE face_rank END AS selective_rank,
   CASE WHEN gap <= {q.GATE} AND has AND f2 > f1 AND face_rank <= 2 THEN 3 - face_rank ELSE face_rank END AS tiebreak_rank FROM r2)"""


def true_ranks(extra: str = "", methods=("face", "fused", "selective", "tiebreak")) -> str:
    parts = " UNION ALL ".join(f"SELECT q_id, {extra} q_persona, gap, '{m}' AS method, {m}_rank AS rank FROM ranked WHERE persona_id = q_persona" for m in methods)
    return f"tr AS ({parts})"


METRICS = "count(*) AS n, avg((rank <= 1)::INT) AS hit_at_1, avg((rank <= 5)::INT) AS hit_at_k, avg(1.0::DOUBLE / rank) AS mrr"
RANKED = f"WITH {EVIDENCE}, {scored()}, {ranks()}"
TRUE = f"{RANKED}, {true_ranks()}"
SET_KEY = "CASE " + " ".join(f"WHEN q_persona IN ({', '.join(map(str, s))}) THEN '{'|'.join(map(str, sorted(s)))}'" for s in q.SETS) + " END"
R = lambda *cols: ", ".join(f"round({c} + 3e-12, 6) + 0 AS {c}" for c in cols)
M = "n, " + R("hit_at_1", "hit_at_k", "mrr")
D = R("delta_hit_at_1", "delta_hit_at_k", "delta_mrr")


def deltas(table: str, keys: str) -> str:
    on = " AND ".join(f"f.{k} = m.{k}" for k in keys.split(",") if k) or "true"
    pre = "".join(f"m.{k}, " for k in keys.split(",") if k)
    return f"SELECT {pre} m.method, m.hit_at_1 - f.hit_at_1 AS delta_hit_at_1, m.hit_at_k - f.hit_at_k AS delta_hit_at_k, m.mrr - f.mrr AS delta_mrr FROM {table} m JOIN {table} f ON f.method = 'face' AND {on} WHERE m.method <> 'face'"


SET_ROWS = ", ".join(f"({n}, {p}, '{'|'.join(map(str, sorted(s)))}')" for n, s in enumerate(q.SETS) for p in s)
CANDIDATES = EVIDENCE + f""", sets AS (SELECT * FROM (VALUES {SET_ROWS}) t(set_no, persona, set_key)),
 cand AS (SELECT u.*, k.set_key FROM usable u LEFT JOIN sets k ON k.persona = u.q_persona WHERE k.set_no IS NULL OR EXISTS (SELECT 1 FROM sets m WHERE m.set_no = k.set_no AND m.persona = u.persona_id))"""
ABLATION = f"WITH {CANDIDATES}, {scored('cand')}, {ranks()}, {true_ranks('set_key,')}"


def scopes(source: str = "tr", keys: str = "", per_set: bool = True) -> str:
    """m: keys, scope, method and metrics of every scope and method."""
    each = [f"SELECT *, 'overall' AS scope FROM {source}", f"SELECT *, 'near_tie' FROM {source} WHERE set_key IS NOT NULL"] + ([f"SELECT *, set_key FROM {source} WHERE set_key IS NOT NULL"] if per_set else [])
    return f"sc AS ({' UNION ALL '.join(each)}), m AS (SELECT {keys} scope, method, {METRICS} FROM sc GROUP BY {keys} scope, method)"


def draw(item: str, seed: int, stream: str) -> str:
    """The same whole number below 1,000,003 as ranking.draw."""
    base = f"((({item} % 1000003) * 7919 + {seed % 1000003} * 104729 + ({stream}) * 15485) % 1000003)"
    square = lambda x: f"(({x} * {x}) % 1000003)"
    return f"(({square(square(base))} * {base}) % 1000003)"


STREAM = "round(rate * 1000)::BIGINT"
NOISE = f"""WITH {CANDIDATES}, rates AS (SELECT unnest([{', '.join(f'{r}::DOUBLE' for r in q.RATES)}]) AS rate, unnest([{', '.join(map(str, range(len(q.RATES))))}]) AS ordinal),
 numb AS (SELECT *, row_number() OVER (ORDER BY persona_id::VARCHAR, item_id) - 1 AS place FROM items), stretch AS (SELECT persona_id, min(place) AS start, count(*) AS own, (SELECT count(*) FROM items) AS total FROM numb GROUP BY persona_id),
 drawn AS (SELECT i.*, r.rate, {draw('i.item_id', q.SEED, STREAM)} < rate * 1000003 AS hit, ['replace', 'drop'][{draw('i.item_id', q.SEED + 1, STREAM)} % 2 + 1] AS kind,
   floor({draw('i.item_id', q.SEED + 2, STREAM)} * (s.total - s.own) / 1000003.0::DOUBLE)::BIGINT AS at, s.start, s.own FROM items i JOIN stretch s USING (persona_id) CROSS JOIN rates r),
 noisy AS (SELECT x.rate, x.item_id, x.hit, CASE WHEN hit AND kind = 'replace' THEN dd.ts ELSE x.ts END AS ts, CASE WHEN hit AND kind = 'replace' THEN dd.geo ELSE x.geo END AS geo,
   CASE WHEN hit AND kind = 'replace' THEN dd.entities WHEN hit THEN []::VARCHAR[] ELSE x.entities END AS entities FROM drawn x JOIN numb dd ON dd.place = CASE WHEN x.at < x.start THEN x.at ELSE x.at + x.own END),
 {scored('cand', 'noisy', ', qc.rate')}, {ranks('q_id, rate')}, {true_ranks('rate, set_key,')}, {scopes('tr', 'rate,', False)}, dl AS ({deltas('m', 'rate,scope')})"""
WEIGHT_ROWS = ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE)" for n, (a, b) in enumerate(q.WEIGHTS))
WEIGHTS = f"""WITH {CANDIDATES}, {scored('cand')}, weights AS (SELECT * FROM (VALUES {WEIGHT_ROWS}) t(ordinal, alpha, beta)),
 fw AS (SELECT ev.*, w.*, round(least(1, greatest(0, alpha * face + beta * context)) + 3e-12, 9) AS fused FROM ev CROSS JOIN weights w),
 rk AS (SELECT *, 'fused' AS method, row_number() OVER (PARTITION BY q_id, ordinal ORDER BY fused DESC, persona_id) AS rank FROM fw), own AS (SELECT * FROM rk WHERE persona_id = q_persona),
 {scopes('own', 'ordinal, alpha, beta,', False)}"""
CENTROIDS = ITEMS + """, comp AS (SELECT persona_id, pos - 1 AS pos, round(avg(x), 12) AS x, count(*) AS n_items FROM (SELECT persona_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS pos FROM items) GROUP BY persona_id, pos),
 cent AS (SELECT persona_id, max(n_items) AS n_items, list(x ORDER BY pos) AS emb FROM comp GROUP BY persona_id),
 ppairs AS (SELECT a.persona_id AS i, b.persona_id AS j, round(list_cosine_similarity(a.emb, b.emb), 9) AS score FROM cent a JOIN cent b ON a.persona_id < b.persona_id)"""
TRUST = f"CASE WHEN quality IS NULL OR isnan(quality) THEN 'reject' WHEN quality >= {q.QUALITY_MIN} THEN 'full' WHEN quality >= {q.QUALITY_MIN / 2} THEN 'low' ELSE 'reject' END"


def rates_at(pairs: str, thresholds: list[float]) -> str:
    return f"""SELECT t AS threshold, round(avg((score >= t)::INT) FILTER (NOT is_genuine) + 3e-12, 6) AS fmr, round(avg((score < t)::INT) FILTER (is_genuine) + 3e-12, 6) AS fnmr
 FROM {pairs}, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in thresholds)}]) AS t) GROUP BY t"""


HITS = ITEMS + f""", hits AS (SELECT a.item_id AS q_id, b.item_id, round(list_cosine_similarity(a.emb, b.emb), 9) AS score, row_number() OVER (PARTITION BY a.item_id ORDER BY round(list_cosine_similarity(a.emb, b.emb), 9) DESC, b.item_id) AS rank
  FROM items a JOIN items b ON a.item_id % 100 = 0 QUALIFY rank <= {q.K})"""
STATE = "CASE WHEN len(entities) = 0 AND geo IS NULL AND ts IS NULL THEN 'none' ELSE concat_ws('+', CASE WHEN len(entities) > 0 THEN 'entities' END, CASE WHEN geo IS NOT NULL THEN 'geo' END, CASE WHEN ts IS NOT NULL THEN 'time' END) END"
ROC = f"WITH {PAIRS}, {curve('pairs')}"
BANDED = lambda quantile: f"band AS (SELECT least(quantile_cont(score, {quantile}), 1 - 1e-9) AS low, 1::DOUBLE AS high FROM ppairs)"


def oracle_sql() -> dict[str, str]:
    out = {
        "knn_exact_topk": f"WITH {ITEMS}, one AS (SELECT emb FROM items ORDER BY item_id LIMIT 1) SELECT item_id, round(s + 3e-12, 6) AS score FROM (SELECT item_id, round(list_cosine_similarity(items.emb, one.emb), 9) AS s FROM items, one ORDER BY s DESC, item_id LIMIT {q.K})",
        "knn_batch_topk": f"WITH {HITS} SELECT q_id, item_id, round(score + 3e-12, 6) AS score, rank FROM hits",
        "fused_topk_search": f"""WITH {HITS}, j AS (SELECT h.q_id, h.item_id, h.score AS face, h.rank AS face_rank, CASE WHEN c.item_id % 11 <> 0 THEN {context_score('qq', 'c')} END AS context FROM hits h JOIN items qq ON qq.item_id = h.q_id JOIN items c ON c.item_id = h.item_id),
 f AS (SELECT *, CASE WHEN context IS NOT NULL THEN {FUSE.format(a='0.7::DOUBLE', b='0.3::DOUBLE')} END AS fused FROM j)
 SELECT q_id, item_id, round(face + 3e-12, 6) AS face_score, round(context + 3e-12, 6) AS context_score, round(fused + 3e-12, 6) AS fused_score, row_number() OVER (PARTITION BY q_id ORDER BY round(fused, 9) DESC NULLS LAST, face_rank) AS rank FROM f""",
        "pair_scores": f"WITH {PAIRS} SELECT i, j, {R('score')}, is_genuine FROM pairs",
        "probe_gallery_scores": f"WITH {PROBES} SELECT i, j, {R('score')}, is_genuine FROM cpairs WHERE severity = 0.5",
        "fmr_fnmr_at_threshold": f"WITH {PAIRS} {rates_at('pairs', q.THRESHOLDS)}",
        "roc_custom_thresholds": f"WITH {PAIRS} {rates_at('pairs', [round(-1 + 0.05 * i, 2) for i in range(41)])}",
        "roc_curve": f"{ROC} SELECT {R('threshold', 'fmr', 'fnmr')} FROM points",
        "plot_ready_roc": f"{ROC} SELECT {R('threshold')}, greatest(round(fmr + 3e-12, 6), 5e-5) AS fmr, greatest(round(fnmr + 3e-12, 6), 5e-5) AS fnmr FROM points",
        "eer": f"WITH {PAIRS}, {curve('pairs')}, {eer_of('', '')} SELECT {R('eer')} FROM e",
        "fmr_at_fnmr": f"WITH {PAIRS}, {curve('pairs')}, {eer_of('', '')}, {', '.join(fixed_of(str(t), '', f'f{n}') for n, t in enumerate((0.01, 0.05, 0.1)))} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS target, {R('fmr_at_fnmr')} FROM f{n}" for n, t in enumerate((0.01, 0.05, 0.1))),
        "condition_sweep": f"""WITH {PROBES}, {curve('cpairs', 'severity,', 'PARTITION BY severity')}, {eer_of('severity,', 'PARTITION BY severity')}, {fixed_of('0.01', 'severity,')},
 n AS (SELECT severity, count(*) AS n_pairs, count(*) FILTER (is_genuine) AS n_genuine, count(*) FILTER (NOT is_genuine) AS n_impostor, count(*) FILTER (i = j) AS n_scored FROM cpairs GROUP BY severity)
 SELECT s.severity, round(CASE WHEN ok THEN eer END + 3e-12, 6) AS eer, round(CASE WHEN ok THEN fmr_at_fnmr END + 3e-12, 6) AS fmr_at_fnmr, CASE WHEN ok THEN n_pairs END AS n_pairs, CASE WHEN ok THEN n_genuine END AS n_genuine, CASE WHEN ok THEN n_impostor END AS n_impostor,
  coalesce(n_scored, 0) AS n_scored, (SELECT count(*) FROM items) - coalesce(n_scored, 0) AS n_query_dropped, (SELECT count(*) FROM items) AS n_images
 FROM severities s LEFT JOIN n USING (severity) LEFT JOIN e USING (severity) LEFT JOIN f USING (severity), LATERAL (SELECT coalesce(n_scored, 0) >= 2 AND n_impostor > 0 AS ok)""",
        "gate_ablation": f"""WITH {PROBES}, b AS (SELECT severity, 'full' AS subset, i, j, score, is_genuine FROM cpairs UNION ALL SELECT severity, 'gated', i, j, score, is_genuine FROM cpairs WHERE qi * (1 - severity) >= 0.3 AND qj * (1 - severity) >= 0.3),
 {curve('b', 'severity, subset,', 'PARTITION BY severity, subset')}, {eer_of('severity, subset,', 'PARTITION BY severity, subset')}, {fixed_of('0.01', 'severity, subset,')},
 g AS (SELECT severity, subset, count(*) FILTER (i = j) AS n, count(*) AS n_pairs, count(*) FILTER (is_genuine) AS n_genuine, count(*) FILTER (NOT is_genuine) AS n_impostor, avg((score >= 0.5)::INT) FILTER (NOT is_genuine) AS fmr, avg((score < 0.5)::INT) FILTER (is_genuine) AS fnmr FROM b GROUP BY severity, subset),
 a AS (SELECT s.severity, k.subset, coalesce(g.n, 0) AS n, g.n_pairs, g.n_genuine, g.n_impostor, g.fmr, g.fnmr, e.eer, f.fmr_at_fnmr, coalesce(g.n >= 2 AND g.n_impostor > 0, false) AS ok
   FROM severities s CROSS JOIN (SELECT unnest(['full', 'gated']) AS subset) k LEFT JOIN g ON g.severity = s.severity AND g.subset = k.subset LEFT JOIN e ON e.severity = s.severity AND e.subset = k.subset LEFT JOIN f ON f.severity = s.severity AND f.subset = k.subset),
 w AS (SELECT *, bool_or(ok) FILTER (subset = 'full') OVER (PARTITION BY severity) AS full_ok, max(n) FILTER (subset = 'full') OVER (PARTITION BY severity) AS n_full FROM a)
 SELECT severity, subset, CASE WHEN subset = 'full' OR full_ok THEN n ELSE 0 END AS n, round(CASE WHEN subset = 'full' THEN 1::DOUBLE WHEN full_ok THEN n::DOUBLE / n_full ELSE 0 END + 3e-12, 6) AS pass_rate,
  {', '.join(f'CASE WHEN full_ok AND ok THEN {c} END AS {c}' for c in ('n_pairs', 'n_genuine', 'n_impostor'))}, {', '.join(f'round(CASE WHEN full_ok AND ok THEN {c} END + 3e-12, 6) AS {c}' for c in ('fmr', 'fnmr', 'eer', 'fmr_at_fnmr'))} FROM w""",
        "ann_append": f"WITH {ITEMS} SELECT count(*) AS n, max(item_id) AS max_id, count(DISTINCT item_id) AS n_ids FROM items",
        "ann_all_cells": f"WITH {HITS} SELECT q_id, item_id, round(score + 3e-12, 6) AS score, rank FROM hits",
        "brightened_pixels": f"WITH {ITEMS}, v AS (SELECT item_id, list_transform(emb[1:32], lambda x: ((round(abs(x) * 500)::INT * 37) % 256)) AS px FROM items) SELECT item_id, 'clean' AS condition, (list_sum(px) * 96)::BIGINT AS total FROM v UNION ALL SELECT item_id, 'brightness', (list_sum(list_transform(px, lambda x: least(255, x + 51))) * 96)::BIGINT FROM v",
        "form_metadata": f"""WITH {CONTEXT}, f AS (SELECT *, item_id % 10 = 0 OR item_id % 15 IN (0, 1) AS rejected, ts IS NOT NULL OR geo IS NOT NULL OR item_id % 15 <> 2 AS present FROM ctx)
 SELECT item_id, rejected, NOT rejected AND present AS has_context, CASE WHEN NOT rejected AND present THEN CASE WHEN item_id % 15 = 2 THEN 0 ELSE len(entities) END END AS n_entities FROM f""",
        "best_detections": "SELECT user_id, event_id, round(value + 3e-12, 6) AS detection_score, round(CASE WHEN event_id % 3 = 0 THEN 0.25::DOUBLE ELSE value / 100 END + 3e-12, 6) AS quality FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
        "sanitised_paths": f"WITH {CONTEXT} SELECT item_id, item_id || '.json' AS file, item_id || '.json|plain' AS files FROM ctx",
        "trust_gate": f"WITH {CONTEXT} SELECT item_id, {R('quality')}, {TRUST} AS trust FROM ctx",
        "ingest_report": f"WITH {CONTEXT} SELECT {TRUST} AS trust, count(*) AS n FROM ctx GROUP BY 1",
        "ingest_ids": f"WITH {CONTEXT} SELECT item_id, row_number() OVER (ORDER BY item_id) + (SELECT max(vec_id) FROM embeddings) AS vector_id FROM ctx WHERE {TRUST} <> 'reject'",
        "sidecar_upsert_latest": "SELECT user_id AS vector_id, event_id, event_type, round(value + 3e-12, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
        "sidecar_get_many": f"WITH {ITEMS} SELECT c.item_id, c.platform, round(c.quality + 3e-12, 6) AS quality, -w.item_id AS pos FROM items w JOIN ctx c ON c.item_id = w.item_id * 3 WHERE w.item_id % 100 = 0",
        "sidecar_point_lookup": f"WITH {CONTEXT} SELECT item_id, platform, {R('quality')} FROM ctx WHERE item_id = 7",
        "duplicate_vector_ids": "WITH b AS (SELECT user_id AS vec_id, count(*) AS n_batch FROM events GROUP BY user_id) SELECT b.vec_id, n_batch, e.vec_id IS NOT NULL AS stored FROM b LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e USING (vec_id) WHERE n_batch > 1 OR e.vec_id IS NOT NULL",
        "max_vector_id": "SELECT max(vec_id) AS max_id FROM embeddings",
        "index_size": "SELECT count(*) AS n FROM embeddings",
        "vector_validation": "SELECT len(embedding)::INT AS dim, count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS n_valid, count(DISTINCT label) AS n_identities FROM embeddings GROUP BY 1",
        "normalised_norms": f"WITH {ITEMS}, u AS (SELECT item_id, list_transform(emb, lambda x: x / n) AS v FROM (SELECT item_id, emb, sqrt(list_dot_product(emb, emb)) AS n FROM items)) SELECT item_id, round(sqrt(list_dot_product(v, v)) + 3e-12, 6) AS unit_norm FROM u",
        "context_score_pairs": f"WITH {ITEMS} SELECT a.item_id AS q_id, b.item_id, round({context_score('a', 'b')} + 3e-12, 6) AS context_score FROM items a JOIN items b ON a.item_id <> b.item_id WHERE a.item_id % 100 = 0",
        "entity_jaccard": f"WITH {ITEMS} SELECT a.item_id AS q_id, b.item_id, round({jaccard('a.entities', 'b.entities')} + 3e-12, 6) AS jaccard FROM items a JOIN items b ON a.item_id <> b.item_id WHERE a.item_id % 100 = 0 AND len(a.entities) > 0 AND len(b.entities) > 0",
        "ambiguous_band": f"WITH {PAIRS} SELECT i, j, {R('score')} FROM pairs WHERE score BETWEEN {q.BAND[0]} AND {q.BAND[1]}",
        "rank_metrics": f"{TRUE}, m AS (SELECT method, {METRICS} FROM tr GROUP BY method) SELECT method, {M} FROM m",
        "rank_metrics_per_set": f"{TRUE}, m AS (SELECT method, {SET_KEY} AS set_key, {METRICS} FROM tr GROUP BY 1, 2) SELECT method, set_key, {M} FROM m WHERE set_key IS NOT NULL",
        "rank_metrics_scopes": f"{ABLATION}, {scopes()} SELECT scope, method, {M} FROM m",
        "ablation_deltas": f"{ABLATION}, {scopes()}, dl AS ({deltas('m', 'scope')}) SELECT scope, method, {D} FROM dl",
        "ablation_gap_le": f"{ABLATION}, t AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in q.GAPS)}]) AS gap_le), ms AS (SELECT unnest(['face', 'fused', 'tiebreak']) AS method), m AS (SELECT t.gap_le, ms.method, count(rank) AS n, avg((rank <= 1)::INT) AS hit_at_1, avg((rank <= 5)::INT) AS hit_at_k, avg(1.0::DOUBLE / rank) AS mrr FROM t CROSS JOIN ms LEFT JOIN tr ON tr.method = ms.method AND tr.gap <= t.gap_le GROUP BY 1, 2) SELECT gap_le, method, {M} FROM m",
        "ablation_gaps": f"{ABLATION}, s AS (SELECT *, 'overall' AS scope FROM tr UNION ALL SELECT *, 'near_tie' FROM tr WHERE set_key IS NOT NULL) SELECT scope, count(*) AS n, round(avg(gap) + 3e-12, 6) AS mean_gap, round(quantile_cont(gap, 0.5) + 3e-12, 6) AS median_gap FROM s WHERE method = 'face' AND gap IS NOT NULL GROUP BY scope",
        "ablation_counts": f"WITH {EVIDENCE} SELECT count(DISTINCT q_id) AS n_queries, (SELECT count(*) FROM items) - count(DISTINCT q_id) AS n_skipped FROM usable",
        "gap_slices": f"{TRUE}, t AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in q.GAPS)}]) AS gap_le), ms AS (SELECT unnest(['face', 'fused', 'selective', 'tiebreak']) AS method), m AS (SELECT t.gap_le, ms.method, count(rank) AS n, avg((rank <= 1)::INT) AS hit_at_1, avg((rank <= 5)::INT) AS hit_at_k, avg(1.0::DOUBLE / rank) AS mrr FROM t CROSS JOIN ms LEFT JOIN tr ON tr.method = ms.method AND tr.gap <= t.gap_le GROUP BY 1, 2) SELECT gap_le, method, {M} FROM m",
        "gap_summary": f"{TRUE} SELECT count(*) AS n, round(avg(gap) + 3e-12, 6) AS mean_gap, round(quantile_cont(gap, 0.5) + 3e-12, 6) AS median_gap FROM tr WHERE method = 'face' AND gap IS NOT NULL",
        "method_deltas": f"{TRUE}, m AS (SELECT method, {METRICS} FROM tr GROUP BY method), dl AS ({deltas('m', '')}) SELECT method, {D} FROM dl",
        "noise_sweep": f"{NOISE} SELECT rate, scope, method, {D} FROM dl",
        "noise_corrupted": f"{NOISE} SELECT rate, count(*) FILTER (hit) AS n_corrupted FROM noisy WHERE item_id IN (SELECT q_id FROM usable) GROUP BY rate",
        "first_negative_rate": f"{NOISE} SELECT scope, method, arg_min(rate, ordinal) FILTER (round(delta_hit_at_1, 9) < 0) AS rate FROM dl JOIN rates USING (rate) GROUP BY scope, method",
        "weight_sweep": f"{WEIGHTS} SELECT ordinal, alpha, beta, scope, {M}, round(CASE WHEN alpha > 0 THEN beta / alpha END + 3e-12, 6) AS ratio FROM m",
        "weight_peak": f"{WEIGHTS} SELECT scope, alpha, beta, {R('hit_at_1', 'mrr')} FROM m ORDER BY scope = 'near_tie' DESC, round(m.hit_at_1, 9) DESC, round(m.mrr, 9) DESC, ordinal LIMIT 1",
        "persona_centroids": f"WITH {CENTROIDS} SELECT persona_id, max(n_items) OVER (PARTITION BY persona_id) AS n_items, pos::INT AS pos, {R('x')} FROM comp",
        "adaptive_band": f"WITH {CENTROIDS}, {BANDED(0.9)} SELECT {R('low', 'high')} FROM band",
        "near_tie_pairs": f"WITH {CENTROIDS}, {BANDED(0.5)} SELECT i, j, {R('score')} FROM ppairs, band WHERE score BETWEEN low AND high",
        "shared_assets": f"WITH {CONTEXT}, a AS (SELECT concat_ws('/', platform, geo) AS asset, label FROM ctx JOIN embeddings ON vec_id = item_id) SELECT asset, count(DISTINCT label) AS n_personas FROM a GROUP BY asset HAVING count(DISTINCT label) > 1",
        "context_state_mix": f"WITH {CONTEXT} SELECT {STATE} AS state, count(*) AS n FROM ctx GROUP BY 1",
        "context_own_vs_rivals": f"""WITH {EVIDENCE}, {scored()}, per AS (SELECT q_id, max(context) FILTER (persona_id = q_persona) AS own, max(context) FILTER (persona_id <> q_persona) AS rival FROM ev GROUP BY q_id),
 s AS (SELECT per.*, {STATE} AS state FROM per JOIN items ON item_id = q_id WHERE rival IS NOT NULL)
 SELECT state, count(*) AS n, count(*) FILTER (own > rival) AS wins, count(*) FILTER (own = rival) AS ties, count(*) FILTER (own < rival) AS losses, round(avg(own) + 3e-12, 6) AS mean_own, round(avg(rival) + 3e-12, 6) AS mean_rival FROM s GROUP BY state""",
        "active_period_join": f"WITH {CONTEXT}, e AS (SELECT * FROM ctx WHERE ts IS NOT NULL AND geo IS NOT NULL), t AS (SELECT min(ts) AS t0 FROM e) SELECT geo, count(*) AS n FROM e, t WHERE ts BETWEEN t0 + geo * 2 * INTERVAL 1 DAY AND t0 + (geo * 2 + 5) * INTERVAL 1 DAY GROUP BY geo",
        "latency_percentiles": "SELECT event_type, count(*) AS n, round(avg(value) + 3e-12, 6) AS mean, round(quantile_cont(value, 0.5) + 3e-12, 6) AS p50, round(quantile_cont(value, 0.9) + 3e-12, 6) AS p90, round(quantile_cont(value, 0.95) + 3e-12, 6) AS p95, round(quantile_cont(value, 0.99) + 3e-12, 6) AS p99 FROM events GROUP BY event_type",
        "stream_ingest": f"WITH {CONTEXT} SELECT item_id, platform, {R('quality')}, {TRUST} AS trust FROM ctx WHERE {TRUST} <> 'reject'",
    }
    labels = ", ".join(f"({s}::DOUBLE, {n + 1}, 'quantised {s:g}')" for n, s in enumerate(q.SEVERITIES))
    bars = " UNION ALL ".join(f"SELECT ordinal, label, '{m}' AS metric, max({m}) FILTER (subset = 'full') AS \"full\", max({m}) FILTER (subset = 'gated') AS gated, max(pass_rate) FILTER (subset = 'gated') AS pass_rate FROM g GROUP BY ordinal, label" for m in ("fmr", "fnmr"))
    out["gate_bars"] = f"WITH g AS (SELECT * FROM ({out['gate_ablation']}) JOIN (VALUES {labels}) l(severity, ordinal, label) USING (severity)) {bars}"
    out["fusion_bars"] = " UNION ALL ".join(f"SELECT scope, method, '{m}' AS metric, {m} AS value FROM ({out['rank_metrics_scopes']})" for m in ("hit_at_1", "hit_at_k", "mrr"))
    for m in ("face", "fused", "selective", "tiebreak"):
        out[f"persona_{m}_rank"] = f"{RANKED} SELECT q_id, persona_id, {R('face', 'fused')}, {m}_rank AS rank FROM ranked"
    return out
