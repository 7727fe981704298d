"""SQL text of the derived tables, for engines that check the results."""

from __future__ import annotations

from casenet.functions import text as T
from casenet.plans.case_tables import DEFECTS_SQL, TOKENS_SQL

TABLES = {t: t for t in ("lineitem", "orders", "customer", "part", "supplier")}


SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"  # Unicode white space


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def clean_unicode(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def core(x: str) -> str:
    return rf"regexp_extract({x}, '\S.*\S|\S')"


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z]+|[^A-Za-z]+'), lambda t: upper(t[1:1]) || lower(t[2:])), '')"


def person(x: str) -> str:
    bare = rf"trim(regexp_replace({clean(x)}, '(?i)^(?:(?:{T.NORMALIZER_TITLES})\s+)+', ''))"
    bare = f"CASE WHEN {bare} = '' THEN {clean(x)} ELSE {bare} END"
    return rf"array_to_string(list_transform(string_split({bare}, ' '), lambda w: CASE WHEN regexp_full_match(w, '[A-Za-z]\.(?:[A-Za-z]\.)*') THEN upper(w) WHEN regexp_full_match(w, '[A-Z][A-Z]+') OR (regexp_matches(w, '[A-Za-z]') AND lower(w) = w) THEN upper(w[1:1]) || lower(w[2:]) ELSE w END), ' ')"


def station(x: str) -> str:
    bare = clean(rf"regexp_replace(regexp_replace({clean(x)}, '[,.\-_]+$', ''), '(?i)\b(?:{T.STATION_WORDS})\b', '', 'g')")
    return f"CASE WHEN {bare} = '' THEN trim({x}) ELSE {title(bare)} || ' Police Station' END"


def _pattern(acts: str) -> str:
    return rf"(?i)^([\d\w/(),\s]+?)\s+({acts})$"


def clauses(x: str) -> str:
    return rf"list_transform(regexp_split_to_array({x}, '(?i)\s+(?:and|&)\s+'), lambda c: trim(c))"


def sections(c: str, acts: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(regexp_extract({c}, '{_pattern(acts)}', 1), '[/,]'), lambda s: trim(s)), lambda s: s <> '')"


def act(c: str, acts: str) -> str:
    got = f"regexp_extract({c}, '{_pattern(acts)}', 2)"
    return rf"CASE WHEN regexp_full_match({got}, '(?i)ipc\.?') THEN 'IPC' ELSE upper({clean(got)}) END"


def statute(x: str) -> str:
    acts = T.NORMALIZER_ACTS
    one = f"CASE WHEN regexp_extract(c, '{_pattern(acts)}', 2) = '' OR len({sections('c', acts)}) = 0 THEN [c] ELSE list_transform({sections('c', acts)}, lambda s: ({act('c', acts)}) || '_' || upper(s)) END"
    return f"array_to_string(flatten(list_transform({clauses(clean(x))}, lambda c: {one})), ' | ')"


def plausible(x: str) -> str:
    bare = rf"trim(regexp_replace({clean(x)}, '(?i)^(?:(?:{T.CHECKER_TITLES})(?:\s+|$))+', ''))"
    return rf"(NOT regexp_matches({clean(x)}, '(?i)\b(?:{T.LEGAL_WORDS})\b') AND length(regexp_replace({bare}, '[^A-Za-z]', '', 'g')) >= 2 AND (regexp_matches({bare}, '[A-Za-z][A-Za-z]') OR regexp_matches({bare}, '(?:^| )[A-Za-z]\.(?: |$)')))"


SPLIT = r"(?i),\s*([^,]+(?:P\.S\.?|PS|Police\s+Station).*)$"
_TAIL = f"regexp_extract(text, '{SPLIT}', 1)"
_HEAD = f"text[1:length(text) - length(regexp_extract(text, '{SPLIT}'))]"


def _mention(kind: str, raw: str, normal: str, start: str, confidence: str, method: str) -> str:
    return f"{{'entity_type': '{kind}', 'raw_value': {raw}, 'normalized_value': {normal}, 'start_char': CAST({start} AS INTEGER), 'extraction_confidence': CAST({confidence} AS DOUBLE), 'extraction_method': '{method}'}}"


def _start(x: str) -> str:
    return rf"length(regexp_extract({x}, '^\s*'))"


_ARRAYS = f"""list_filter(CASE
    WHEN category_id = 0 THEN [CASE WHEN {core('text')} <> '' THEN {_mention('POLICE_STATION', core('text'), station(core('text')), _start('text'), '0.95', 'category_0_station')} END]
    WHEN category_id = 2 THEN [CASE WHEN {core('text')} <> '' THEN {_mention('STATUTE', core('text'), statute(core('text')), _start('text'), '0.95', 'category_2_statute')} END]
    WHEN category_id = 3 AND regexp_matches(text, '{SPLIT}') THEN [
        CASE WHEN {plausible(core(_HEAD))} THEN {_mention('PERSON', core(_HEAD), person(core(_HEAD)), _start(_HEAD), '0.90', 'category_3_person_split')} END,
        CASE WHEN {core(_TAIL)} <> '' THEN {_mention('POLICE_STATION', core(_TAIL), station(core(_TAIL)), f'length(text) - length({_TAIL}) + {_start(_TAIL)}', '0.92', 'category_3_station_split')} END]
    WHEN category_id = 3 THEN [CASE WHEN {plausible(core('text'))} THEN {_mention('PERSON', core('text'), person(core('text')), _start('text'), '0.92', 'category_3_person')} END]
    ELSE [] END, lambda m: m IS NOT NULL)"""

STEPS = {
    "tokens": TOKENS_SQL.format(**TABLES),
    "defects": DEFECTS_SQL.format(tokens="tokens"),
    "files": "SELECT DISTINCT image_name FROM tokens WHERE image_id % 101 <> 0 UNION ALL SELECT DISTINCT 'extra_' || image_id || '.jpg' FROM tokens WHERE image_id % 107 = 0",
    "arrays": f"SELECT case_id, fir_id, evidence_id, image_id, source_index, category_id, text, score, {_ARRAYS} AS ms FROM tokens",
    "mentions": """SELECT case_id, fir_id, evidence_id, image_id, source_index, category_id, score AS ocr_confidence, CAST(i - 1 AS INTEGER) AS span_index, m.entity_type, m.raw_value, m.normalized_value, m.start_char,
        CAST(m.start_char + length(m.raw_value) AS INTEGER) AS end_char, m.extraction_confidence, m.extraction_method, round(least(1.0, greatest(0.0, 0.3 * score + 0.7 * m.extraction_confidence)), 4) AS final_confidence, score < 0.6 AS low_ocr_confidence
        FROM (SELECT *, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM arrays)""",
    "keyed": """SELECT *, CASE WHEN length(trim(normalized_value)) >= 2 THEN lower(trim(normalized_value)) END AS norm_key FROM mentions""",
    "ranked": """SELECT *, CASE WHEN norm_key IS NOT NULL THEN sha256(concat_ws('|', case_id, entity_type, norm_key, CASE WHEN entity_type = 'PERSON' THEN fir_id END)) END AS entity_key,
        row_number() OVER k AS rn, first_value(fir_id) OVER k AS first_fir FROM keyed WINDOW k AS (PARTITION BY case_id, entity_type, norm_key ORDER BY image_id, source_index, span_index)""",
    "resolutions": """SELECT *, CASE WHEN entity_key IS NULL THEN NULL ELSE trim(first_value(raw_value) OVER (PARTITION BY entity_key ORDER BY image_id, source_index, span_index)) END AS entity_name,
        CASE WHEN norm_key IS NULL THEN 'KEPT_SEPARATE_AMBIGUOUS' WHEN rn = 1 THEN 'CREATED_NEW' WHEN fir_id = first_fir THEN 'MATCHED_EXISTING_SAME_FIR' WHEN entity_type = 'PERSON' THEN 'KEPT_SEPARATE_CROSS_FIR' ELSE 'MATCHED_EXISTING_CROSS_FIR' END AS decision FROM ranked""",
    "entities": """SELECT entity_key, min(case_id) AS case_id, min(entity_type) AS entity_type, min(entity_name) AS name, min(lower(trim(normalized_value))) AS normalized_name, max(final_confidence) AS confidence, count(*) AS n_mentions, count(DISTINCT fir_id) AS n_firs FROM resolutions WHERE entity_key IS NOT NULL GROUP BY entity_key""",
    "presence": "SELECT DISTINCT case_id, fir_id, entity_type, entity_key FROM resolutions WHERE entity_key IS NOT NULL",
    "structured": """SELECT a.case_id, 'structured' AS origin, a.entity_key AS source, b.entity_key AS target, r.relation, a.fir_id FROM presence a
        JOIN (VALUES ('PERSON', 'POLICE_STATION', 'visited'), ('PERSON', 'STATUTE', 'connected_to'), ('STATUTE', 'POLICE_STATION', 'associated_with')) r(f, t, relation) ON a.entity_type = r.f
        JOIN presence b ON b.entity_type = r.t AND a.case_id = b.case_id AND a.fir_id = b.fir_id""",
    "edge_docs": """SELECT * FROM structured UNION ALL SELECT a.case_id, 'cooccurrence', a.entity_key, b.entity_key, 'associated_with', a.fir_id
        FROM presence a JOIN presence b ON a.case_id = b.case_id AND a.fir_id = b.fir_id AND a.entity_key < b.entity_key""",
    "edges": """SELECT case_id, origin, source, target, relation, CASE relation WHEN 'visited' THEN 'LOCATED_AT' ELSE 'ASSOCIATED_WITH' END AS relationship_type, count(*) AS weight, min(fir_id) AS primary_fir,
        round(count(*) / (count(*) + 1), 4) AS confidence FROM edge_docs GROUP BY 1, 2, 3, 4, 5""",
    "ends": "SELECT case_id, source AS entity_key, target AS other, weight FROM edges UNION ALL SELECT case_id, target, source, weight FROM edges WHERE source <> target",
    "degrees": "SELECT case_id, entity_key, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM ends GROUP BY 1, 2",
}


def pagerank_steps(rounds: int) -> dict[str, str]:
    steps = {
        "outs": "SELECT DISTINCT entity_key AS src, other AS dst FROM ends WHERE entity_key <> other", "outdeg": "SELECT src, count(*) AS od FROM outs GROUP BY src",
        "pr0": "SELECT e.entity_key AS node, od, 1.0 / (SELECT count(*) FROM entities) AS pr FROM entities e LEFT JOIN outdeg d ON e.entity_key = d.src",
    }
    for k in range(1, rounds + 1):
        steps[f"got{k}"] = f"SELECT o.dst AS node, sum(p.pr / p.od) AS got FROM pr{k - 1} p JOIN outs o ON p.node = o.src GROUP BY 1"
        steps[f"pr{k}"] = f"SELECT p.node, p.od, CAST(0.15 / (SELECT count(*) FROM entities) + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(pr), 0) FROM pr{k - 1} WHERE od IS NULL) / (SELECT count(*) FROM entities)) AS DOUBLE) AS pr FROM pr{k - 1} p LEFT JOIN got{k} g ON p.node = g.node"
    return steps


def first_level_steps(sweeps: int) -> dict[str, str]:
    """Louvain's first level over the edges, half of the waiting nodes at a time; ``firsts`` has the communities after all sweeps, named by their least member."""
    steps = {
        "lw": "SELECT entity_key AS src, other AS dst, CAST(sum(weight) AS DOUBLE) AS weight FROM ends WHERE entity_key <> other GROUP BY 1, 2",
        "l0": "SELECT src AS node, src AS community, sum(weight) AS k, false AS moved, true AS waits FROM lw GROUP BY 1",
    }
    for p in range(1, 2 * sweeps + 1):
        sweep, turn = divmod(p - 1, 2)
        steps[f"n{p}"] = f"""SELECT s.node, s.community, s.k, s.waits OR b.node IS NOT NULL AS waits, {'NOT ' if turn else ''}contains('02468ace', md5(s.node || '|{sweep}')[1:1]) AS may FROM l{p - 1} s
            LEFT JOIN (SELECT DISTINCT w.src AS node FROM lw w JOIN l{p - 1} m ON w.dst = m.node WHERE m.moved) b ON s.node = b.node"""
        steps[f"t{p}"] = f"SELECT community, sum(k) AS tot, count(*) AS n FROM l{p - 1} GROUP BY 1"
        steps[f"o{p}"] = f"""SELECT node, community, sum(w_in) AS w_in FROM (SELECT n.node, d.community, w.weight AS w_in FROM n{p} n JOIN lw w ON w.src = n.node JOIN l{p - 1} d ON d.node = w.dst WHERE n.waits AND n.may
            UNION ALL SELECT node, community, 0 FROM n{p} WHERE waits AND may) GROUP BY 1, 2"""
        steps[f"g{p}"] = f"""SELECT o.node, o.community, n.community AS home, round(o.w_in - n.k * CASE WHEN o.community = n.community THEN t.tot - n.k ELSE t.tot END / (SELECT sum(k) FROM l0), 9) AS gain, h.n AS n_home, t.n AS n_there
            FROM o{p} o JOIN n{p} n ON o.node = n.node JOIN t{p} t ON t.community = o.community JOIN t{p} h ON h.community = n.community"""
        steps[f"b{p}"] = f"""SELECT node, community, gain, max(CASE WHEN community = home THEN gain END) OVER (PARTITION BY node) AS stay, row_number() OVER (PARTITION BY node ORDER BY gain DESC, community) AS rn
            FROM g{p} WHERE NOT (n_home = 1 AND n_there = 1 AND community > home)"""
        steps[f"l{p}"] = f"""SELECT n.node, CASE WHEN b.gain > b.stay THEN b.community ELSE n.community END AS community, n.k, coalesce(b.gain > b.stay, false) AS moved, n.waits AND NOT n.may AS waits
            FROM n{p} n LEFT JOIN b{p} b ON b.node = n.node AND b.rn = 1"""
    steps["placed"] = f"SELECT e.entity_key, coalesce(l.community, e.entity_key) AS c FROM entities e LEFT JOIN l{2 * sweeps} l ON l.node = e.entity_key"
    steps["firsts"] = "SELECT entity_key, min(entity_key) OVER (PARTITION BY c) AS community FROM placed"
    return steps


def sql(select: str, *needed: str, extra: dict[str, str] | None = None) -> str:
    """``select`` over the derived tables up to the last of ``needed`` (and ``extra`` steps), as one statement."""
    names = list(STEPS)
    last = max((names.index(n) for n in needed), default=-1)
    steps = {n: STEPS[n] for n in names[: last + 1]} | (extra or {})
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in steps.items()) + f" {select}"
