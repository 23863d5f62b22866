"""SQL for DuckDB that gives the rows of plans.queries, from the same Parquet tables.

A query is a last SELECT over named common tables; sql() puts those that it
needs before it. Derived doubles are rounded to 9 digits on both sides.
"""

from __future__ import annotations

import re

from evscreen.functions.numerics import two_sided_z
from evscreen.operators.ensemble import CONTRACT, TASK
from evscreen.plans import queries as q

_Z = two_sided_z(0.95)
_LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\pZ]"
_REPLIES = "[" + ", ".join("'" + r.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for r in q._REPLIES) + "]"


def _byte(digest: str, i: int) -> str:
    return f"('0x' || substr({digest}, {2 * i + 1}, 2))::INTEGER"


def _rating(digest: str) -> str:
    return f"({_byte(digest, 0)} % 3 - 1)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _voted(seed: int) -> str:
    return f"""SELECT record_id, track, pos, vendor, digest, {_rating("digest")} AS rating, -({_byte("digest", 1)} / 255.0::DOUBLE) * 3.0::DOUBLE AS logprob
  FROM (SELECT *, sha256('{seed}:' || vendor || ':{q.MODEL}:' || record_id) AS digest FROM records CROSS JOIN raters) WHERE {_byte("digest", 2)} >= {q.MISS}"""


def _counted(source: str, *by: str) -> str:
    keys = ", ".join(["record_id", *by])
    return f"SELECT {keys}, count(*) FILTER (rating = -1) AS n_neg, count(*) FILTER (rating = 0) AS n_zero, count(*) FILTER (rating = 1) AS n_pos FROM {source} GROUP BY {keys}"


def _decided(source: str, tau: float, policy: str = "escalate") -> str:
    return f"""SELECT *, CASE WHEN NOT escalate THEN CASE WHEN n_pos < n_neg THEN -1 ELSE 1 END END::INTEGER AS auto_label
  FROM (SELECT *, boundary OR dispersion > {tau} OR (n_pos = n_neg AND {policy == "escalate"}) AS escalate
  FROM (SELECT *, n_neg + n_zero + n_pos AS x, n_neg > 0 AND n_pos > 0 AS boundary,
    CASE WHEN n_neg + n_zero + n_pos <= 1 THEN 0 ELSE sqrt(((n_neg + n_zero + n_pos) * (n_neg + n_pos) - (n_pos - n_neg) * (n_pos - n_neg))::DOUBLE / ((n_neg + n_zero + n_pos) * (n_neg + n_zero + n_pos - 1))::DOUBLE) END AS dispersion FROM ({source})))"""


def _agreed(source: str, by: str = "", weight: str = "1", more: str = "") -> str:
    """alpha, raw_agreement, n_units and more sums over rows n_neg, n_zero, n_pos of source, by the columns by."""
    m = "(n_neg + n_zero + n_pos)"
    part = lambda x: f"coalesce(sum(CASE WHEN {m} >= 2 THEN {weight} * {x} END), 0)::DOUBLE"
    lead, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""SELECT * EXCLUDE (o_nz, o_zp, o_np, m_n, m_z, m_p, agreeing, pairs, d_nz, d_zp, d_np, chance),
    CASE WHEN chance > 0 THEN 1 - (m_n + m_z + m_p - 1) * (o_nz * d_nz + o_zp * d_zp + o_np * d_np) / chance END AS alpha, agreeing / nullif(pairs, 0) AS raw_agreement
  FROM (SELECT *, m_n * m_z * d_nz + m_z * m_p * d_zp + m_n * m_p * d_np AS chance
  FROM (SELECT *, pow((m_n + m_z) / 2, 2) AS d_nz, pow((m_z + m_p) / 2, 2) AS d_zp, pow(m_n / 2 + m_z + m_p / 2, 2) AS d_np
  FROM (SELECT {lead}{part(f"n_neg * n_zero / ({m} - 1)::DOUBLE")} AS o_nz, {part(f"n_zero * n_pos / ({m} - 1)::DOUBLE")} AS o_zp, {part(f"n_neg * n_pos / ({m} - 1)::DOUBLE")} AS o_np,
    {part("n_neg")} AS m_n, {part("n_zero")} AS m_z, {part("n_pos")} AS m_p, {part("(n_neg * (n_neg - 1) + n_zero * (n_zero - 1) + n_pos * (n_pos - 1)) / 2.0")} AS agreeing, {part(f"{m} * ({m} - 1) / 2.0")} AS pairs, count(*) AS n_units{more}
  FROM ({source}){group})))"""


def _parsed(reply: str) -> str:
    """rating and problem columns of the replies in column r of the table reply."""
    letter = lambda x: f"CASE upper(regexp_replace({x}, '^[.,:;()]+|[.,:;()]+$', '', 'g')) WHEN 'E' THEN -1 WHEN 'U' THEN 0 WHEN 'I' THEN 1 END"
    strip = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    return f"""SELECT *, coalesce(whole, final, CASE WHEN len(spelled) = 1 THEN spelled[1] END)::INTEGER AS rating
  FROM (SELECT *, {letter("own")} AS whole, {letter("list_filter(list_transform(string_split_regex(own, '" + _LINE_ENDS + "'), lambda x: " + strip("x") + "), lambda x: x <> '')[-1]")} AS final,
    list_distinct(list_filter(list_transform(string_split_regex(own, '{_BLANK}+'), lambda x: {letter("x")}), lambda x: x IS NOT NULL)) AS spelled
  FROM (SELECT *, {strip("coalesce(r, '')")} AS own FROM {reply}))"""


def _draw(population: str, by: str | None, plane: str) -> str:
    key = f"sha256('{q.SEED}:' || record_id)"
    n = f"(SELECT greatest(1, count(*) // {q.AUDIT_SHARE}) FROM {population})"
    if by is None:
        return f"SELECT record_id, 'all' AS stratum_kind, 'all' AS stratum, '{plane}' AS plane FROM {population} ORDER BY {key}, record_id LIMIT {n}"
    sizes = f"SELECT {by} AS stratum, count(*) AS size, min(record_id) AS first_seen FROM {population} GROUP BY {by}"
    return f"""SELECT d.record_id, '{by}' AS stratum_kind, d.stratum, '{plane}' AS plane
  FROM (SELECT record_id, {by} AS stratum, row_number() OVER (PARTITION BY {by} ORDER BY {key}, record_id) AS rank FROM {population}) d
  JOIN ({_apportioned(sizes, n)}) a ON d.stratum = a.stratum WHERE d.rank <= a.allocated"""


def _apportioned(sizes: str, n: str) -> str:
    return f"""SELECT stratum, size, (base + (rank <= {n} - sum(base) OVER ())::BIGINT)::BIGINT AS allocated
  FROM (SELECT *, row_number() OVER (ORDER BY raw - base DESC, first_seen) AS rank
  FROM (SELECT *, floor(raw)::BIGINT AS base FROM (SELECT *, ({n} * size)::DOUBLE / (sum(size) OVER ())::DOUBLE AS raw FROM ({sizes}))))"""


def _strata(draw: str, population: str, by: str, role: str) -> str:
    return f"""SELECT '{role}' AS role, '{by}' AS stratum_kind, stratum, n, m, population
  FROM (SELECT stratum, count(*) AS n, count(*) FILTER (human_label = 1) AS m FROM {draw} JOIN human USING (record_id) GROUP BY stratum)
  JOIN (SELECT {by} AS stratum, count(*) AS population FROM {population} GROUP BY {by}) USING (stratum)"""


def _choose(n: str, k: str) -> str:
    """The log of n over k; k at most n."""
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


def _bounds(strata: str, alpha: str) -> str:
    """strata with exact_upper and exact_lower, each by summing a tail for every candidate."""
    chance = f"exp({_choose('k', 'i')} + {_choose('(population - k)', '(n - i)')} - {_choose('population', 'n')})"
    fits = "i <= k AND n - i <= population - k AND n - i >= 0"
    tail = lambda lo, hi: f"coalesce(list_sum(list_transform(list_filter(range({lo}, {hi}), lambda i: {fits}), lambda i: {chance})), 0)"
    return f"""SELECT s.*, CASE WHEN n = population THEN m ELSE (SELECT max(k) FROM (SELECT unnest(range(s.m, s.population + 1)) AS k, s.n AS n, s.m AS m, s.population AS population) WHERE {tail("0", "m + 1")} >= {alpha} - 1e-12) END AS exact_upper,
    CASE WHEN n = population OR m = 0 THEN m ELSE (SELECT min(k) FROM (SELECT unnest(range(s.m, s.population + 1)) AS k, s.n AS n, s.m AS m, s.population AS population) WHERE {tail("m", "n + 1")} >= {alpha} - 1e-12) END AS exact_lower FROM {strata} s"""


def _wilson(m: str, n: str) -> tuple[str, str]:
    p, z = f"({m}::DOUBLE / {n})", f"{_Z!r}::DOUBLE"
    scale = f"(1 + {z} * {z} / {n})"
    mid, half = f"({p} + {z} * {z} / (2 * {n})) / {scale}", f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0::DOUBLE * {n} * {n})) / {scale}"
    return f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"


_LOW, _HIGH = _wilson("m", "n")
_UPPER = f"CASE WHEN m = 0 THEN 3.0::DOUBLE / n ELSE {_HIGH} END"
_FPC = "CASE WHEN population <= 1 OR n >= population THEN 0 ELSE sqrt((population - n)::DOUBLE / (population - 1)) END"
_NAMED = ", ".join(f"({i}, '{v}')" for i, v in enumerate(q.VENDORS))
_MATRIX = "count(*) FILTER (label = 1 AND truth = 1) AS tp, count(*) FILTER (label = 1 AND truth <> 1) AS fp, count(*) FILTER (coalesce(label, 9) <> 1 AND label IS NOT NULL AND truth = 1) AS fn, count(*) FILTER (label <> 1 AND truth <> 1) AS tn"

#: Common tables by name; each may use those before it.
TABLES: dict[str, str] = {
    "records": "SELECT doc_id AS seq, 'doc-' || doc_id AS record_id, text AS abstract, lang AS track FROM documents",
    "gold": "SELECT 'doc-' || doc_id AS record_id, CASE WHEN quality = 0 THEN -1 WHEN toxic = 1 THEN 0 ELSE 1 END AS truth FROM labels",
    "raters": f"SELECT * FROM (VALUES {_NAMED}) AS r(pos, vendor)",
    "votes": _voted(q.SEED),
    "later_votes": _voted(q.OTHER_SEED),
    "counts": _counted("votes"),
    "track_counts": _counted("votes", "track"),
    "decisions": _decided("SELECT * FROM counts", q.TAU),
    "human": f"SELECT record_id, coalesce(truth, {_rating("sha256('human:' || record_id)")})::INTEGER AS human_label FROM records LEFT JOIN gold USING (record_id)",
    "final_labels": "SELECT record_id, CASE WHEN escalate THEN human_label ELSE auto_label END AS label, CASE WHEN escalate AND human_label IS NULL THEN 'unresolved' END AS problem FROM decisions LEFT JOIN human USING (record_id)",
    "deduplicated": "SELECT *, first_value(record_id) OVER same AS kept_id, row_number() OVER same > 1 AS duplicate FROM records WINDOW same AS (PARTITION BY sha256(lower(trim(coalesce(abstract, '')))) ORDER BY seq, record_id)",
    "outcomes": f"""SELECT record_id, track, duplicate, CASE WHEN duplicate THEN NULL WHEN regexp_replace(coalesce(abstract, ''), '{_BLANK}', '', 'g') = '' THEN 'empty_abstract' WHEN length(abstract) < 40 THEN 'short' END AS code FROM deduplicated""",
    "passed": "SELECT record_id, track FROM outcomes WHERE NOT duplicate AND code IS NULL",
    "replies": f"SELECT record_id, {_REPLIES}[{_byte('sha256(record_id)', 0)} % {len(q._REPLIES)} + 1] AS r FROM records",
    "parsed_replies": _parsed("replies"),
    "all_replies": "SELECT text AS r FROM conversations UNION ALL SELECT r FROM replies",
    "sizes": "SELECT DISTINCT n_neg + n_zero + n_pos AS x FROM counts",
    "reachable": "SELECT DISTINCT x, CASE WHEN x <= 1 OR k = 0 THEN 0 ELSE sqrt((k * (x - k))::DOUBLE / (x * (x - 1))::DOUBLE) END AS dispersion FROM (SELECT x, unnest(range(0, x // 2 + 1)) AS k FROM sizes)",
    "probabilities": "SELECT record_id, vendor, CASE WHEN vendor IN ('mistral', 'openai', 'together') THEN least(1.0, exp(logprob)) END AS probability FROM votes",
    "confidences": "SELECT record_id, CASE WHEN count(probability) >= 3 THEN median(probability) ELSE 0 END AS median_probability, count(probability) AS n_supporting, count(*) AS n_total, count(probability) >= 3 AS scored FROM probabilities GROUP BY record_id",
    "tiers": "SELECT record_id, CASE WHEN NOT scored THEN 'unscored' WHEN median_probability <= 0.5 THEN 'low' ELSE 'high' END AS tier FROM confidences",
    "covered": "SELECT v.*, truth FROM votes v JOIN gold USING (record_id) QUALIFY count(*) OVER (PARTITION BY record_id) = (SELECT count(DISTINCT vendor) FROM votes)",
    "excluded": "SELECT record_id, coalesce(track, 'unknown') AS track FROM decisions LEFT JOIN records USING (record_id) WHERE NOT escalate AND auto_label <> 1",
    "excluded_tiers": "SELECT * FROM excluded JOIN tiers USING (record_id)",
    "included": "SELECT record_id, coalesce(track, 'unknown') AS track, CASE WHEN escalate THEN 'escalated' ELSE 'included' END AS status FROM decisions LEFT JOIN records USING (record_id) WHERE escalate OR auto_label = 1",
    "draw_by_track": _draw("excluded", "track", "recall_audit"),
    "draw_by_status": _draw("included", "status", "inclusion_audit"),
    "exclusion": _strata("draw_by_track", "excluded", "track", "exclusion"),
    "inclusion": _strata("draw_by_status", "included", "status", "inclusion"),
    "rates": f"SELECT *, m::DOUBLE / n AS rate, {_LOW} AS low, {_HIGH} AS high, least(1.0, m::DOUBLE / n + ({_UPPER} - m::DOUBLE / n) * {_FPC}) AS rate_floor FROM exclusion",
    "strata_alone": "SELECT count(*) AS many FROM exclusion",
    "strata_both": "SELECT (SELECT count(*) FROM exclusion) + (SELECT count(*) FROM inclusion) AS many",
    "bounds_alone": _bounds("exclusion", "(0.05 / (SELECT many FROM strata_alone))"),
    "bounds_joint": _bounds("exclusion", "(0.05 / (SELECT many FROM strata_both))"),
    "bounds_inside": _bounds("inclusion", "(0.05 / (SELECT many FROM strata_both))"),
    "misses": "SELECT sum(rate * population) AS fn, sum(rate_floor * population) AS fn_floor, sqrt(sum(pow((high - low) * population / 2, 2))) AS half FROM rates",
    "subsets": f"SELECT mask, list_aggregate(list_transform(list_filter(range(0, {len(q.VENDORS)}), lambda i: (mask >> i) & 1 = 1), lambda i: {list(q.VENDORS)}[i + 1]), 'string_agg', '+') AS subset, bit_count(mask::BIGINT)::INTEGER AS x FROM (SELECT unnest(range(1, {2 ** len(q.VENDORS)})) AS mask)",
    "subset_counts": "SELECT mask, subset, x AS raters, record_id, truth, count(*) FILTER (rating = -1) AS n_neg, count(*) FILTER (rating = 0) AS n_zero, count(*) FILTER (rating = 1) AS n_pos FROM votes JOIN gold USING (record_id) JOIN subsets ON (mask >> pos) & 1 = 1 GROUP BY ALL",
    "subset_decisions": "SELECT *, (CASE WHEN escalate THEN truth ELSE auto_label END) = 1 AS said FROM (" + _decided("SELECT * FROM subset_counts", q.TAU) + ")",
    "subset_metrics": "SELECT mask, subset, raters, alpha, raw_agreement, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, escalated / n_units::DOUBLE AS escalation_rate, n_units AS n_records FROM ("
    + _agreed("SELECT * FROM subset_decisions", "mask, subset, raters", more=", count(*) FILTER (said AND truth = 1)::DOUBLE AS tp, count(*) FILTER (said AND truth <> 1)::DOUBLE AS fp, count(*) FILTER (NOT said AND truth = 1)::DOUBLE AS fn, count(*) FILTER (escalate)::DOUBLE AS escalated")
    + ")",
    "moves": "SELECT vendor, record_id, a.rating AS was, b.rating AS now FROM votes a JOIN later_votes b USING (vendor, record_id)",
    "crossings": "SELECT vendor, count(*) FILTER (was >= 0 AND now = -1) AS polarity_crossings, coalesce(string_agg(record_id, ',' ORDER BY record_id) FILTER (was >= 0 AND now = -1), '') AS ids FROM moves GROUP BY vendor",
    "drifts": "SELECT *, polarity_crossings >= 2 AS hard_trigger, coalesce(alpha < 0.8, false) AS advisory_flag FROM (" + _agreed("SELECT vendor, (was = -1)::BIGINT + (now = -1)::BIGINT AS n_neg, (was = 0)::BIGINT + (now = 0)::BIGINT AS n_zero, (was = 1)::BIGINT + (now = 1)::BIGINT AS n_pos FROM moves", "vendor") + ") JOIN crossings USING (vendor)",
    "reviewed": """SELECT record_id, dispersion, boundary, median_probability, scored, array_to_string(list_filter([CASE WHEN boundary THEN 'boundary' END, CASE WHEN dispersion > 0 THEN 'dispersion' END, CASE WHEN scored AND median_probability <= 0.5 THEN 'low_confidence' END], lambda r: r IS NOT NULL), ',') AS selection_reason,
    CASE WHEN scored THEN 1 - median_probability ELSE 0 END AS doubt FROM decisions LEFT JOIN confidences USING (record_id)""",
}

_DECISION = "SELECT record_id, x, round(dispersion, 9) AS dispersion, boundary, escalate, auto_label FROM "
_SIZES = "SELECT 'all' AS kind, 'all' AS stratum, count(*) AS population FROM {0} UNION ALL SELECT 'track', track, count(*) FROM {0} GROUP BY track UNION ALL SELECT '{1}', {1}, count(*) FROM {0} GROUP BY {1}"
_RATES = "round(rate, 9) AS rate, round(low, 9) AS low, round(high, 9) AS high, round(rate_floor, 9) AS rate_floor, round(rate * population, 9) AS estimated, round(rate_floor * population, 9) AS estimated_floor"
_REVIEW = "SELECT record_id, round(dispersion, 9) AS dispersion, boundary, round(median_probability, 9) AS median_probability, scored, selection_reason, 'active_learning' AS plane FROM reviewed WHERE selection_reason <> ''"
_ALPHA = "round(alpha, 9) AS alpha, round(raw_agreement, 9) AS raw_agreement"
_METRICS = ("alpha", "raw_agreement", "recall", "precision", "escalation_rate")


def _recalled(tp: str, fn: str) -> str:
    return f"round(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0 END, 9)"


#: The last SELECT of each query.
SELECTS: dict[str, str] = {
    "normalize_records": "SELECT doc_id AS seq, 'doc-' || doc_id AS id, lang AS track, 'doi' AS kind, '10.1/' || lower(upper(source)) AS value FROM documents",
    "contract_violations": """SELECT seq, id, rule FROM (SELECT seq, id, unnest(list_filter([CASE WHEN coalesce(id, '') = '' THEN 'id is empty' END, CASE WHEN title IS NULL THEN 'title is missing' END, CASE WHEN text IS NULL THEN 'abstract is missing' END,
    CASE WHEN trim(coalesce(lang, '')) = '' THEN 'track is empty' END, CASE WHEN gold NOT IN (-1, 0, 1) THEN 'gold label is outside -1, 0 and 1' END], lambda r: r IS NOT NULL)) AS rule
    FROM (SELECT d.doc_id AS seq, sha256(text) AS id, CASE WHEN n_chars >= 50 THEN substr(text, 1, 80) END AS title, text, lang, quality + toxic AS gold FROM documents d LEFT JOIN labels USING (doc_id)))
  UNION ALL SELECT min(d.doc_id), sha256(text), 'id is repeated' FROM documents d LEFT JOIN labels USING (doc_id) WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1""",
    "prefilter_dedup": "SELECT record_id, kept_id, duplicate FROM deduplicated",
    "prefilter_exclusions": "SELECT record_id, code, CASE code WHEN 'short' THEN 'abstract is short' ELSE 'abstract is empty' END AS reason FROM outcomes WHERE code IS NOT NULL",
    "prisma_counts": "SELECT count(*) AS identified, count(*) FILTER (duplicate) AS duplicates_removed, count(*) FILTER (NOT duplicate) AS after_dedup, count(code) AS prefilter_excluded, count(*) FILTER (NOT duplicate AND code IS NULL) AS screened FROM outcomes",
    "seeded_votes": "SELECT record_id, vendor, rating, round(logprob, 9) + 0.0::DOUBLE AS logprob FROM votes",
    "votes_missing": "SELECT vendor, count(*) AS missing FROM records CROSS JOIN raters ANTI JOIN votes USING (record_id, vendor) GROUP BY vendor",
    "chunked_votes": f"""SELECT record_id, vendor, {_rating("digest")} AS rating FROM (SELECT record_id, vendor, sha256('{q.SEED}:' || vendor || ':{q.MODEL}:' || record_id || CASE WHEN len(peers) = 0 THEN '' ELSE ':' || array_to_string(peers, ',') END) AS digest
  FROM (SELECT record_id, list_sort(list_filter(list(record_id) OVER (PARTITION BY chunk), lambda r: r <> record_id)) AS peers
  FROM (SELECT record_id, (row_number() OVER (ORDER BY seq, record_id) - 1) // {q.PACKED.batch_size} AS chunk FROM records)) CROSS JOIN raters)""",
    "prompt_resolution": "SELECT track, CASE track WHEN 'en' THEN 'Include English trials.' WHEN 'de' THEN 'Include German trials.' ELSE 'Include trials.' END AS prompt, count(*) AS n FROM records GROUP BY ALL",
    "prompted_votes": f"""SELECT track, vendor, {_rating("digest")} AS rating, count(*) AS n FROM (SELECT track, vendor, sha256('{q.SEED}:' || vendor || ':{q.MODEL}:' || record_id || ':' || coalesce(CASE track WHEN 'en' THEN 'Include English trials.' WHEN 'de' THEN 'Include German trials.' ELSE 'Include trials.' END, {_text(TASK)}) || {_text(chr(10) * 2 + CONTRACT)}) AS digest FROM records CROSS JOIN raters) GROUP BY ALL""",
    "parse_replies": f"SELECT rating, CASE WHEN rating IS NULL THEN CASE WHEN len(spelled) > 1 THEN 'ambiguous' ELSE 'none' END END AS problem, count(*) AS n FROM ({_parsed('all_replies')}) GROUP BY ALL",
    "parse_batch_replies": "SELECT record_id, rating FROM parsed_replies",
    "batch_reassemble": "SELECT record_id, rating FROM parsed_replies JOIN records USING (record_id) QUALIFY count(*) FILTER (rating IS NULL) OVER (PARTITION BY track, length(abstract)) = 0",
    "batch_services": """SELECT vendor, rating, count(*) AS n FROM (
  SELECT rating FROM (SELECT record_id, rating, track, (row_number() OVER (PARTITION BY track ORDER BY seq, record_id) - 1) // 3 AS chunk FROM parsed_replies JOIN records USING (record_id))
  QUALIFY count(*) FILTER (rating IS NULL) OVER (PARTITION BY track, chunk) = 0
) CROSS JOIN (VALUES ('anthropic'), ('google'), ('mistral'), ('openai'), ('together')) AS v(vendor) GROUP BY ALL""",
    "decide_escalate": _DECISION + "decisions",
    "decide_include": _DECISION + "(" + _decided("SELECT * FROM counts", 0.6, "include") + ")",
    "vote_vectors": "SELECT record_id, string_agg(vendor || '=' || rating, ',' ORDER BY pos) AS vector FROM votes GROUP BY record_id",
    "decision_table": "SELECT n_neg, n_zero, n_pos, round(dispersion, 9) AS dispersion, boundary, escalate, auto_label FROM ("
    + _decided(f"SELECT a.i AS n_neg, b.i AS n_zero, {len(q.VENDORS)} - a.i - b.i AS n_pos FROM range(0, {len(q.VENDORS) + 1}) a(i), range(0, {len(q.VENDORS) + 1}) b(i) WHERE a.i + b.i <= {len(q.VENDORS)}", q.TAU)
    + ")",
    "escalation_rate": "SELECT round(avg(escalate::INTEGER), 9) AS escalation_rate FROM decisions",
    "escalation_by_track": "SELECT track, count(*) AS n, count(*) FILTER (escalate) AS escalated, count(*) FILTER (auto_label = 1) AS included FROM decisions JOIN records USING (record_id) GROUP BY track",
    "tau_reachable": "SELECT x, round(dispersion, 9) AS dispersion FROM reachable",
    "tau_report": f"SELECT x, round(max(dispersion) FILTER (dispersion < {q.TAU}), 9) AS effective_breakpoint, round(max(dispersion) FILTER (dispersion <= {q.TAU}), 9) AS interval_low, round(min(dispersion) FILTER (dispersion > {q.TAU}), 9) AS interval_high, max(dispersion) <= {q.TAU} AS dispersion_inert, count(*) AS reachable FROM reachable GROUP BY x",
    "vote_confidence": "SELECT record_id, vendor, round(probability, 9) AS probability FROM probabilities",
    "record_confidence": "SELECT record_id, round(median_probability, 9) AS median_probability, n_supporting, n_total, scored FROM confidences",
    "confidence_tiers": "SELECT tier, count(*) AS n FROM tiers GROUP BY tier",
    "agreement_overall": f"SELECT {_ALPHA}, n_units, (SELECT count(DISTINCT vendor) FROM votes) AS n_raters FROM ({_agreed('SELECT * FROM counts')})",
    "agreement_by_track": f"SELECT track, {_ALPHA}, n_units, n_raters FROM ({_agreed('SELECT * FROM track_counts', 'track')}) JOIN (SELECT track, count(DISTINCT vendor) AS n_raters FROM votes GROUP BY track) USING (track)",
    "alpha_pairwise": "SELECT vendor_a, vendor_b, round(alpha, 9) AS alpha FROM ("
    + _agreed("SELECT a.vendor AS vendor_a, b.vendor AS vendor_b, (a.rating = -1)::BIGINT + (b.rating = -1)::BIGINT AS n_neg, (a.rating = 0)::BIGINT + (b.rating = 0)::BIGINT AS n_zero, (a.rating = 1)::BIGINT + (b.rating = 1)::BIGINT AS n_pos FROM votes a JOIN votes b ON a.record_id = b.record_id AND a.vendor < b.vendor", "vendor_a, vendor_b")
    + ") WHERE alpha IS NOT NULL",
    "agreement_order_lines": f"SELECT o_orderstatus, {_ALPHA}, n_units FROM ("
    + _agreed("SELECT o_orderstatus, n_neg, n_zero, n_pos FROM (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n_neg, count(*) FILTER (l_returnflag = 'N') AS n_zero, count(*) FILTER (coalesce(l_returnflag, '') NOT IN ('R', 'N')) AS n_pos FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey", "o_orderstatus")
    + ")",
    "reliability_matrix": "SELECT record_id, " + ", ".join(f"any_value(rating) FILTER (vendor = '{v}') AS {v}" for v in q.VENDORS) + " FROM votes GROUP BY record_id",
    "error_indicators": "SELECT record_id, vendor, rating <> truth AS error FROM votes JOIN gold USING (record_id)",
    "full_coverage": "SELECT truth, count(DISTINCT record_id) AS records, count(*) AS votes FROM covered GROUP BY truth",
    "fn_correlation": """SELECT vendor_a, vendor_b, round(CASE WHEN n >= 2 AND s > 0 THEN ("both" * neither - only_a * only_b) / sqrt(s) END, 9) AS correlation, n::BIGINT AS n, "both"::BIGINT AS "both", only_a::BIGINT AS only_a, only_b::BIGINT AS only_b, neither::BIGINT AS neither
  FROM (SELECT *, ("both" + only_a) * (only_b + neither) * ("both" + only_b) * (only_a + neither) AS s FROM (SELECT p.vendor AS vendor_a, r.vendor AS vendor_b, count(a.rating)::DOUBLE AS n, count(*) FILTER (a.rating <> 1 AND b.rating <> 1)::DOUBLE AS "both",
    count(*) FILTER (a.rating <> 1 AND b.rating = 1)::DOUBLE AS only_a, count(*) FILTER (a.rating = 1 AND b.rating <> 1)::DOUBLE AS only_b, count(*) FILTER (a.rating = 1 AND b.rating = 1)::DOUBLE AS neither
  FROM raters p JOIN raters r ON p.vendor < r.vendor LEFT JOIN (SELECT * FROM covered WHERE truth = 1) a ON a.vendor = p.vendor LEFT JOIN (SELECT * FROM covered WHERE truth = 1) b ON b.vendor = r.vendor AND a.record_id = b.record_id GROUP BY ALL))""",
    "confusion": f"SELECT {_MATRIX} FROM final_labels JOIN gold USING (record_id)",
    "confusion_by_track": f"SELECT track, {_MATRIX} FROM final_labels JOIN gold USING (record_id) JOIN records USING (record_id) GROUP BY track",
    "excluded_population": "SELECT record_id, track FROM excluded",
    "included_population": "SELECT record_id, track, status FROM included",
    "population_sizes": _SIZES.format("excluded_tiers", "tier"),
    "inclusion_population_sizes": _SIZES.format("included", "status"),
    "frame_hash": "SELECT count(DISTINCT record_id) AS n, sha256(string_agg(DISTINCT record_id, chr(10) ORDER BY record_id)) AS frame_hash FROM excluded",
    "apportion": _apportioned("SELECT c_nationkey AS stratum, count(*) AS size, min(c_custkey) AS first_seen FROM customer GROUP BY c_nationkey", f"(SELECT count(*) // {q.AUDIT_SHARE} FROM customer)"),
    "audit_draw": _draw("excluded", None, "recall_audit"),
    "audit_draw_by_track": "SELECT * FROM draw_by_track",
    "audit_draw_by_tier": _draw("excluded_tiers", "tier", "recall_audit"),
    "inclusion_draw_by_status": "SELECT * FROM draw_by_status",
    "exclusion_strata": "SELECT * FROM exclusion",
    "inclusion_strata": "SELECT * FROM inclusion",
    "stratum_rates": f"SELECT stratum, {_RATES} FROM rates",
    "wilson_by_part_size": f"SELECT p_size, n, m, round({_LOW}, 9) AS low, round({_HIGH}, 9) AS high FROM (SELECT p_size, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_size)",
    "hypergeometric_bounds": _bounds("(SELECT stratum, n, m, population FROM exclusion)", "0.05"),
    "recall_stratified": f"SELECT {_recalled('tp', 'fn')} AS point, {_recalled('tp', 'fn_floor')} AS floor, {_recalled('tp', 'fn_exact')} AS exact_floor, {_recalled('tp', '(fn + half)')} AS ci_low, {_recalled('tp', 'greatest(0, fn - half)')} AS ci_high, tp AS true_positives, round(fn, 9) AS estimated_fn, round(fn_floor, 9) AS estimated_fn_floor, fn_exact AS estimated_fn_exact_floor FROM misses, (SELECT sum(exact_upper)::DOUBLE AS fn_exact FROM bounds_alone), (SELECT count(*)::DOUBLE AS tp FROM final_labels JOIN gold USING (record_id) WHERE label = 1 AND truth = 1)",
    "recall_audited": f"SELECT {_recalled('tp', 'fn')} AS point, NULL::DOUBLE AS floor, {_recalled('found', 'missed')} AS exact_floor, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, round(tp, 9) AS true_positives, round(fn, 9) AS estimated_fn, round(fn_floor, 9) AS estimated_fn_floor, missed AS estimated_fn_exact_floor FROM misses, (SELECT sum(exact_upper)::DOUBLE AS missed FROM bounds_joint), (SELECT sum(exact_lower)::DOUBLE AS found FROM bounds_inside), (SELECT sum(m::DOUBLE / n * population) AS tp FROM inclusion)",
    "adjudication_queue": "SELECT record_id, round(dispersion, 9) AS dispersion, boundary, CASE WHEN boundary THEN 'boundary' WHEN dispersion > 0 THEN 'dispersion' ELSE 'tie' END AS selection_reason, 'adjudication' AS plane FROM decisions WHERE escalate",
    "final_labels": "SELECT record_id, label, problem FROM final_labels",
    "adjudicated_decisions": "SELECT record_id, escalate AND human_label IS NULL AS escalate, CASE WHEN escalate AND human_label IS NOT NULL THEN human_label ELSE auto_label END AS auto_label FROM decisions LEFT JOIN human USING (record_id)",
    "unresolved_escalations": "SELECT record_id FROM decisions ANTI JOIN gold USING (record_id) WHERE escalate",
    "usable_labels": "SELECT record_id, coalesce(truth, human_label)::INTEGER AS human_label FROM decisions JOIN human USING (record_id) LEFT JOIN gold USING (record_id) WHERE escalate",
    "active_learning_select": _REVIEW,
    "active_learning_top_100": _REVIEW + " ORDER BY reviewed.dispersion DESC, doubt DESC, record_id LIMIT 100",
    "ablation_sweep": f"SELECT subset, raters AS x, {', '.join(f'round({m}, 9) AS {m}' for m in _METRICS)}, n_records FROM subset_metrics WHERE raters >= 2",
    "ablation_leave_one_out": f"SELECT m.subset, v.vendor AS removed, {', '.join(f'round(m.{c} - r.{c}, 9) AS delta_{c}' for c in _METRICS)} FROM subset_metrics m JOIN raters v ON (m.mask >> v.pos) & 1 = 1 JOIN subset_metrics r ON r.mask = m.mask - (1::BIGINT << v.pos::BIGINT) WHERE m.raters >= 2",
    "drift_evaluation": f"SELECT vendor, n_units AS n_records, {_ALPHA}, polarity_crossings, sha256(ids) AS crossed, hard_trigger, advisory_flag FROM drifts",
    "drift_summary": "SELECT coalesce(string_agg(vendor, ',' ORDER BY vendor) FILTER (hard_trigger), '') AS hard, coalesce(string_agg(vendor, ',' ORDER BY vendor) FILTER (advisory_flag), '') AS advisory, coalesce(bool_or(hard_trigger), false) AS triggered FROM drifts",
    "drift_staleness": "SELECT max(ts) AS last_evaluated_at, round((epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(max(ts)::TIMESTAMP)) / 86400e6, 9) AS staleness_days, coalesce((epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(max(ts)::TIMESTAMP)) / 86400e6 > 30, true) AS stale FROM events",
    "config_diff": "SELECT coalesce(c.field, s.field) AS field, c.value AS before, s.value AS after FROM (SELECT 'nation.' || c_nationkey AS field, count(*)::VARCHAR AS value FROM customer GROUP BY c_nationkey) c FULL JOIN (SELECT 'nation.' || s_nationkey AS field, count(*)::VARCHAR AS value FROM supplier GROUP BY s_nationkey) s ON c.field = s.field WHERE c.value IS DISTINCT FROM s.value",
    "changelog_lineage": """WITH RECURSIVE c AS (SELECT c_custkey AS seq, c_mktsegment || '-' || c_nationkey AS after FROM customer
), e AS (SELECT c.seq, c.after, (SELECT max(b.after) FROM c b WHERE b.seq + 1 + b.seq % 3 = c.seq) AS before FROM c
), p AS (SELECT x.seq, max(y.seq) AS parent FROM e x JOIN e y ON y.after = x.before AND y.seq < x.seq GROUP BY x.seq
), walk(depth, seq) AS (
  SELECT 0, max(seq) FROM e UNION ALL SELECT depth + 1, parent FROM walk JOIN p USING (seq)
) SELECT depth::INTEGER AS depth, before, after FROM walk JOIN e USING (seq)""",
    "manifest_verify": "SELECT c_custkey::VARCHAR AS artifact, CASE WHEN s_suppkey IS NULL THEN 'missing' ELSE 'hash_mismatch' END AS problem FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE s_suppkey IS NULL OR c_nationkey <> s_nationkey",
    "upsert_latest": "SELECT user_id, event_type, event_id, round(value, 9) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "screening_flow": "SELECT track, count(*) AS screened, count(*) FILTER (escalate) AS escalated, count(*) FILTER (auto_label = 1) AS included, count(*) FILTER (auto_label = -1) AS excluded FROM passed JOIN decisions USING (record_id) GROUP BY track",
}


def sql(name: str) -> str:
    """The SQL of a query, with the common tables it needs, in order."""
    needed, open_ = set(), [SELECTS[name]]
    while open_:
        words = set(re.findall(r"\w+", open_.pop()))
        new = {t for t in TABLES if t in words} - needed
        needed |= new
        open_ += [TABLES[t] for t in new]
    common = ",\n".join(f"{t} AS ({TABLES[t]})" for t in TABLES if t in needed)
    return f"WITH {common}\n{SELECTS[name]}" if needed else SELECTS[name]


ORACLES: dict[str, str] = {name: sql(name) for name in SELECTS}
