"""Candidates, scoring, fusion and failover (neutral SQL over provider answers)."""

from __future__ import annotations

from marquetry.plans.store import _ITEM, _LATEST, norm

# one row a provider answer, in the order that ties are broken: confidence, registration, match_id
_CAND = """(SELECT m.query_id, m.match_id, m.provider, p.seq, m.confidence, m.accepted, m.signals.title AS title, m.signals.artist AS artist, m.signals.year AS year, m.signals.runtime AS runtime, lower(m.signals.medium) AS medium, m.signals.season AS season,
    row_number() OVER (PARTITION BY m.query_id ORDER BY m.confidence DESC NULLS LAST, p.seq NULLS LAST, m.match_id) AS rn
    FROM (SELECT DISTINCT query_id, match_id, lower(trim(provider)) AS provider, confidence, accepted, signals FROM @provider_match) m LEFT JOIN @provider p ON p.provider = m.provider)"""
_YEAR = "CASE WHEN year BETWEEN 1000 AND 2100 THEN year END"
TEXTS = {
    "route_providers": """
        SELECT q.query_id, p.provider FROM (SELECT DISTINCT query_id, lower(trim(signals.medium)) AS medium FROM @provider_match) q JOIN (SELECT provider, unnest_rows(media) AS medium FROM @provider) p ON p.medium = q.medium
        UNION SELECT q.query_id, p.provider FROM (SELECT DISTINCT query_id, 1 AS one FROM @provider_match WHERE signals.medium IS NULL) q JOIN (SELECT provider, 1 AS one FROM @provider) p ON p.one = q.one""",
    "route_kind": "SELECT i.pk, i.kind, p.provider FROM (SELECT DISTINCT pk, kind FROM @item) i JOIN (SELECT provider, unnest_rows(media) AS medium FROM @provider) p ON p.medium = i.kind",
    "capable_sources": "SELECT kind, source, row_number() OVER (PARTITION BY kind ORDER BY n DESC, source) AS ask_order FROM (SELECT kind, source, count(*) AS n FROM @catalog_item WHERE title IS NOT NULL GROUP BY kind, source) s",
    "provider_counts": "SELECT provider, count(*) AS total, count(CASE WHEN accepted THEN 1 END) AS active, count(DISTINCT signals.medium) AS media FROM (SELECT DISTINCT match_id, lower(trim(provider)) AS provider, accepted, signals FROM @provider_match) m GROUP BY provider",
    "candidates_ranked": f"SELECT query_id, match_id, provider, rn AS position FROM {_CAND} c",
    "kind_candidates": f"SELECT query_id, medium, match_id, position FROM (SELECT query_id, medium, match_id, row_number() OVER (PARTITION BY query_id, medium ORDER BY rn) AS position FROM {_CAND} c WHERE trim(medium) <> '' AND medium NOT IN ('unknown', 'n/a')) t WHERE position <= 3",
    "variant_year_filter": f"SELECT v.item_id, v.year, o.first_year FROM {_LATEST} v JOIN (SELECT kind, lower(trim(title)) AS name, min(year) AS first_year FROM @catalog_item WHERE year IS NOT NULL GROUP BY kind, lower(trim(title))) o ON o.kind = v.kind AND o.name = lower(trim(v.title)) WHERE v.year >= o.first_year - 1",
    "two_stage_topk": f"SELECT query_id, match_id, members FROM (SELECT query_id, match_id, coalesce(runtime, 0) AS members, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(CASE WHEN isnan(runtime) THEN NULL ELSE runtime END, 0) DESC, rn) AS nth FROM {_CAND} c WHERE rn <= 10 AND NOT isnan(coalesce(runtime, 0))) t WHERE nth <= 5",
    "rating_rank": f"SELECT query_id, match_id, nth FROM (SELECT query_id, match_id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(confidence, seq / 10.0, 0) DESC, match_id) AS nth FROM {_CAND} c) t WHERE nth <= 10",
    "source_failover": f"""
        SELECT kind, name, source, overview, n_empty FROM (SELECT kind, lower(trim(title)) AS name, source, overview, row_number() OVER (PARTITION BY kind, lower(trim(title)) ORDER BY CASE WHEN overview IS NULL THEN 1 ELSE 0 END, source, item_id) AS nth, count(CASE WHEN overview IS NULL THEN 1 END) OVER (PARTITION BY kind, lower(trim(title))) AS n_empty FROM {_LATEST} c WHERE trim(title) <> '') t WHERE nth = 1""",
    "resolve_batch": f"SELECT q.query_id, b.match_id, CASE WHEN b.match_id IS NULL THEN 'no accepted answer' END AS error FROM (SELECT DISTINCT query_id FROM @provider_match) q LEFT JOIN (SELECT query_id, min_by(match_id, rn) AS match_id FROM {_CAND} c WHERE accepted GROUP BY query_id) b ON b.query_id = q.query_id",
    "repeat_questions": f"SELECT hash, count(*) AS asked, min(match_id) AS first_match FROM (SELECT DISTINCT match_id, concat({norm("coalesce(signals.title, '')")}, '|', coalesce(CAST(signals.year AS STRING), '')) AS hash FROM @provider_match) h GROUP BY hash",
    "title_overlay": f"SELECT query_id, match_id, coalesce(title, {norm('provider')}) AS title, coalesce({_YEAR}, 1900 + seq) AS year, coalesce(medium, 'generic') AS medium FROM {_CAND} c",
    "extract_signals": "SELECT pk, CASE WHEN kind IN ('artist', 'playlist') THEN trim(rx_get(name, ~'^(.+?) - ', 1)) END AS artist, CASE WHEN kind IN ('artist', 'playlist') THEN trim(rx_get(name, ~' - (.+)$', 1)) ELSE trim(rx_get(name, ~'^([^(]*)', 1)) END AS title, try_cast(nullif(rx_get(name, ~'\\(([0-9]{4})\\)', 1), '') AS INT) AS year FROM (SELECT DISTINCT pk, kind, CASE WHEN kind IN ('artist', 'playlist') THEN concat(norm, ' - ', title) ELSE concat(norm, ' (', CAST(year AS STRING), ')') END AS name FROM @item) n",
    "parse_music_name": "SELECT pk, trim(CASE WHEN rx_is(stem, ~'^\\s*.+?\\s*-\\s*.+?\\s*$') THEN rx_get(stem, ~'^\\s*(.+?)\\s*-\\s*.+?\\s*$', 1) END) AS artist, trim(CASE WHEN rx_is(stem, ~'^\\s*.+?\\s*-\\s*.+?\\s*$') THEN rx_get(stem, ~'^\\s*.+?\\s*-\\s*(.+?)\\s*$', 1) WHEN rx_is(stem, ~'^\\s*[0-9]{1,3}[\\s._-]+.+$') THEN rx_get(stem, ~'^\\s*[0-9]{1,3}[\\s._-]+(.+?)\\s*$', 1) ELSE stem END) AS title FROM (SELECT DISTINCT pk, CASE pk % 3 WHEN 0 THEN concat('A', CAST(pk AS STRING), ' - T ', kind) WHEN 1 THEN concat(pad2(pk % 40), ' Song ', kind) ELSE concat('Solo ', kind) END AS stem FROM @item) s",
    "cut_dedup": f"SELECT name, keep, copies - 1 AS n_delete, freed FROM (SELECT kind, lower(trim(title)) AS name, max_by(item_id, coalesce(CASE WHEN isnan(runtime_min) THEN NULL ELSE runtime_min END, 0) * 10000000 + item_id) AS keep, count(*) AS copies, CAST(sum(length(title)) - max(length(title)) AS BIGINT) AS freed FROM {_LATEST} c WHERE trim(title) <> '' GROUP BY kind, lower(trim(title))) t WHERE copies > 1",
    "channel_scan": f"SELECT hash, min(item_id) AS first_upload, count(*) - 1 AS duplicates FROM (SELECT item_id, md5(concat(kind, '|', lower(trim(title)))) AS hash FROM {_LATEST} c WHERE runtime_min > 40 AND NOT isnan(runtime_min) AND title IS NOT NULL) h GROUP BY hash",
    "cut_summary": "SELECT item_id, CASE WHEN dc AND th THEN 'Multiple versions' WHEN dc THEN 'Director''s Cut' WHEN ac THEN 'Assembly Cut' WHEN ex THEN 'Extended / Special Edition' WHEN th THEN 'Theatrical' END AS version FROM (SELECT item_id, rx_is(lower(cuts), ~'director.?s.?cut') AS dc, rx_is(lower(cuts), 'theatrical') AS th, rx_is(lower(cuts), ~'special.?edition|extended') AS ex, rx_is(lower(cuts), ~'assembly.?cut') AS ac FROM (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Theatrical (116:37) Director''s Cut (120:01)' WHEN 1 THEN 'Assembly Cut' WHEN 2 THEN concat(title, ' Extended') WHEN 3 THEN 'theatrical' WHEN 4 THEN 'directors cut' ELSE title END AS cuts FROM @catalog_item) c) t",
}
