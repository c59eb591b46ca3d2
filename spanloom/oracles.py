"""DuckDB SQL for the queries of the fact engine, written from what each operator is to compute."""

from __future__ import annotations

from . import samples as S
from .functions import text as T
from .operators import clauses as K
from .operators import documents as D
from .operators import facts as X
from .operators import policies as P
from .operators import review as R

TEXT = "coalesce(text, '')"
WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _id(prefix: str, *parts: str, size: int = 32) -> str:
    return f"'{prefix}' || substr(sha256(concat_ws('|', {', '.join(f"coalesce(({p})::VARCHAR, '')" for p in parts)})), 1, {size})"


def _strip(v: str) -> str:
    return f"regexp_replace({v}, '^{WS}+|{WS}+$', '', 'g')"


def _fold(v: str) -> str:
    return f"replace(replace(lower({v}), 'ß', 'ss'), 'ς', 'σ')"


def _folded(v: str) -> str:
    return _fold(_strip(f"regexp_replace({v}, '{WS}+', ' ', 'g')"))


def _key(v: str) -> str:
    marks = "[" + "".join("\\" + c if c in "[]" else c for c in T.EDGES) + "]"
    plain = f"translate({v}, '{T.DASHES + T.QUOTES}', '{_q('-' * len(T.DASHES) + T.PLAIN_QUOTES)}')"
    bare = f"regexp_replace({_strip(plain)}, '^{_q(marks)}+|{_q(marks)}+$', '', 'g')"
    return f"coalesce(nullif({_fold(f"regexp_replace({bare}, '{WS}+', ' ', 'g')")}, ''), {v})"


def _stems(v: str) -> str:
    cases = " ".join(f"WHEN starts_with(w, '{a}') THEN '{b}'" for a, b in T.PREFIXES)
    cases += f" WHEN w IN ({', '.join(f"'{x}'" for x in T.SYNONYMS)}) THEN '{T.MEANING}' "
    cases += " ".join(f"WHEN length(w) > {len(e) + 3} AND ends_with(w, '{e}') THEN left(w, length(w) - {len(e)})" for e in T.SUFFIXES)
    return f"list_transform(regexp_extract_all({_fold(v)}, '[a-z0-9]+'), lambda w: CASE {cases} ELSE w END)"


def _chunk_sql(window: int, overlap: int) -> str:
    step = window - overlap
    ts, te = f"k * {step}", f"least(k * {step} + {window}, len(t))"
    return f"""tok AS (SELECT doc_id, source, sha256({TEXT}) AS h, regexp_extract_all({TEXT}, '{D.TOKEN}') AS t FROM documents),
    cut AS (SELECT *, {ts} AS token_start, {te} AS token_end FROM tok, unnest(generate_series(0, ceil(greatest(len(t) - {window}, 0) / {step}.0)::BIGINT)) AS u(k) WHERE len(t) > 0),
    put AS (SELECT doc_id, source, h, k AS chunk_index, token_start, token_end, array_to_string(t[token_start + 1:token_end], '') AS text, array_to_string(t[1:token_start], '') AS before FROM cut),
    chunk AS (SELECT doc_id, source, chunk_index, token_start, token_end, text, length(before) AS start_char, strlen(before) AS start_byte, length(before) + length(text) AS end_char, strlen(before) + strlen(text) AS end_byte,
      {_id('chunk-', 'doc_id', 'h', 'chunk_index', 'strlen(before)', 'strlen(before) + strlen(text)', 'token_start', 'token_end')} AS chunk_id FROM put)"""


def _facts_sql(lenses=X.LENSES, table: str = "documents", name: str = "facts") -> str:
    """CTEs up to ``name``: every match of every lens with its offsets, keys and sample confidences."""
    chunked = table == "chunk"
    own = "chunk_id, start_char AS c0, start_byte AS b0" if chunked else "NULL AS chunk_id, 0 AS c0, 0 AS b0"
    parts = []
    for x in lenses:
        lens, category, field, pattern = x[:4]
        p = _q(pattern)
        parts.append(
            f"SELECT r, doc_id, source, chunk_id, c0, b0, '{lens}' AS lens, '{category}' AS category, '{field}' AS field, i - 1 AS ordinal, ms[i] AS value, gs[i] AS gap"
            f" FROM (SELECT *, regexp_extract_all(t, '{p}') AS ms, regexp_split_to_array(t, '{p}') AS gs FROM base_{name}), unnest(generate_series(1, len(ms))) AS u(i)"
        )
    at = "(coalesce(sum({f}(value) + {f}(gap)) OVER (PARTITION BY r, lens, field ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {f}(gap))::BIGINT"
    ids = ["doc_id", *(["chunk_id"] if chunked else []), "lens", "category", "field", "value", "start_char"]
    return f"""base_{name} AS (SELECT row_number() OVER () AS r, doc_id, source, {TEXT} AS t, {own} FROM {table}),
    raw_{name} AS ({' UNION ALL '.join(parts)}),
    placed_{name} AS (SELECT *, c0 + {at.format(f='length')} AS start_char, b0 + {at.format(f='strlen')} AS start_byte FROM raw_{name}),
    {name} AS (SELECT doc_id, source, chunk_id, lens, category, field, ordinal, value, start_char, start_char + length(value) AS end_char, start_byte, start_byte + strlen(value) AS end_byte,
      round(((doc_id * 7 + ordinal * 3) % 100) / 100.0, 2)::DOUBLE AS confidence, {_id('cand-', *ids)} AS candidate_id, {_key('value')} AS key FROM placed_{name})"""


def _claim_sql() -> str:
    """The sample's claims beside their chunks, with every place of every value by trying each start."""
    headed = "WITH headed AS (SELECT doc_id, source, regexp_replace(text, '(?m)^([^\\n]{1,60})$', '# \\1', 'g') AS text FROM documents), "
    w = headed + _chunk_sql(*S.CHUNK).replace("FROM documents)", "FROM headed)", 1) + ", " + _facts_sql(table="chunk")
    at = lambda test, size: f"list_transform(list_filter(generate_series(1, length(t)), lambda i: {test}), lambda i: {{'a': i - 1, 'z': i - 1 + {size}}})"
    upper = f"translate(f.value, '{S.LETTERS}', '{S.LETTERS.upper()}')"
    same = lambda v: at(f"substr(t, i, length({v})) = {v}", f"length({v})")
    return w + f""", kind AS (SELECT f.*, k.text AS t, k.start_char AS k0, (f.doc_id + f.ordinal) % 8 AS h FROM facts f JOIN chunk k USING (chunk_id)),
      said AS (SELECT candidate_id, doc_id, chunk_id, lens, ordinal, t, k0, h, CASE WHEN h = 5 THEN 'metric_name' ELSE field END AS field, f.value AS plain, CASE WHEN h = 7 THEN 0 ELSE length(f.value) END AS n,
          CASE h WHEN 1 THEN ' ' || f.value || ' ' WHEN 2 THEN {upper} WHEN 3 THEN replace(f.value, ' ', '  ') WHEN 4 THEN f.value || 'zq' ELSE f.value END AS value,
          CASE h WHEN 5 THEN start_char - 40 WHEN 6 THEN start_char + 1000000 ELSE start_char + doc_id % 3 END AS claim FROM kind f),
      one AS (SELECT *, {_strip('value')} AS bare, {same('value')} AS s1 FROM said),
      two AS (SELECT *, CASE WHEN len(s1) > 0 THEN s1 WHEN bare <> value AND bare <> '' THEN {same('bare')} ELSE [] END AS s2 FROM one),
      three AS (SELECT *, CASE WHEN len(s2) > 0 THEN s2 ELSE {at("lower(substr(t, i, length(value))) = lower(value)", "length(value)")} END AS s3,
          '^' || array_to_string(list_transform(list_filter(regexp_split_to_array(value, '{WS}+'), lambda x: x <> ''), lambda x: regexp_escape(x)), '{WS}+') AS pattern FROM two),
      place AS (SELECT *, CASE WHEN len(s3) > 0 THEN s3 WHEN NOT regexp_matches(value, '{WS}') THEN [] ELSE {at("regexp_matches(substr(t, i), pattern)", "length(regexp_extract(substr(t, i), pattern))")} END AS spots FROM three)"""


DEDUP = "dd AS (SELECT *, min(candidate_id) OVER (PARTITION BY doc_id, lens, category, field, key, start_char, end_char) AS primary_id FROM facts)"
SLOTS = "plan(category, field) AS (VALUES {})".format(", ".join(f"('{c}', '{f}')" for c, f in S.PLAN))


def _review_sql(w: str) -> str:
    """Checks, the sample's verdicts and what the critic makes of them, from ``facts`` of chunks."""
    return w + f""", {SLOTS}, checked AS (SELECT f.*, p.field IS NOT NULL AS field_ok, f.category IN (SELECT category FROM plan) AS category_ok, (doc_id * 3 + ordinal) % 11 AS h
        FROM facts f LEFT JOIN plan p USING (category, field)),
      said AS (SELECT candidate_id, 0 AS pos, h FROM checked WHERE h <> 7 UNION ALL SELECT candidate_id, 1, -1 FROM checked WHERE ordinal % 5 = 0 UNION ALL SELECT 'unknown-' || candidate_id, 0, 8 FROM checked WHERE h = 3),
      first_ AS (SELECT candidate_id, arg_min(h, pos) AS said FROM said GROUP BY candidate_id),
      fixed AS (SELECT c.*, said, CASE
          WHEN said = 2 THEN CASE WHEN field_ok THEN 'preserved' ELSE 'rejected' END
          WHEN said = 3 AND length(value) > 1 THEN CASE WHEN field_ok THEN 'corrected' ELSE 'rejected' END
          WHEN said IN (3, 4) THEN CASE WHEN field_ok THEN 'preserved' ELSE 'rejected' END
          WHEN said IN (5, 6) THEN 'rejected' END AS outcome,
        CASE WHEN said = 2 THEN 'slot_not_approved' WHEN said = 3 AND length(value) > 1 THEN CASE WHEN field_ok THEN '' ELSE 'slot_not_approved' END
          WHEN said IN (3, 4) THEN 'span_text_mismatch' WHEN said = 5 THEN CASE WHEN field_ok THEN '' ELSE 'slot_not_approved,' END || 'value_not_grounded' WHEN said = 6 THEN 'no_correction' END AS faults
        FROM checked c LEFT JOIN first_ USING (candidate_id)),
      report AS (SELECT *, CASE WHEN said IS NULL THEN 'critic_missing_report' WHEN said = -1 THEN 'critic_rejected' WHEN said = 0 AND ordinal % 2 = 1 THEN 'critic_rejected'
          WHEN said = 1 AND NOT field_ok THEN 'category_not_approved' WHEN outcome = 'rejected' THEN 'invalid_correction' END AS reason FROM fixed),
      critic AS (SELECT *, reason IS NULL AS accepted, coalesce(outcome = 'corrected', false) AS corrected FROM report),
      vsaid AS (SELECT *, (doc_id * 5 + ordinal) % 7 AS v FROM checked),
      vpair AS (SELECT *, CASE WHEN v = 0 THEN ['verifier_missing_report'] WHEN v = 2 THEN ['verifier_rejected'] WHEN v = 3 AND NOT field_ok THEN ['schema_violation'] ELSE [] END AS own,
          CASE WHEN NOT category_ok THEN ['category_not_approved'] WHEN NOT field_ok THEN ['schema_violation'] ELSE [] END AS mech FROM vsaid),
      vcodes AS (SELECT *, list_concat(own, list_filter(mech, lambda x: NOT list_contains(own, x))) AS codes FROM vpair),
      ex AS (SELECT *, CASE WHEN NOT category_ok THEN ['category_not_approved'] WHEN NOT field_ok THEN ['schema_violation'] ELSE [] END AS codes FROM checked),
      drops AS (SELECT 'executor' AS stage, candidate_id, codes FROM ex WHERE len(codes) > 0 UNION ALL SELECT 'critic', candidate_id, [reason] FROM critic WHERE NOT accepted UNION ALL SELECT 'verifier', candidate_id, codes FROM vcodes WHERE len(codes) > 0)"""


def _group_sql(w: str) -> str:
    return w + f""", {SLOTS}, rule AS (SELECT doc_id, category, field, key, min(candidate_id) AS source_id, list(candidate_id) AS ids, row_number() OVER (PARTITION BY doc_id ORDER BY category, field, key) AS group_pos FROM facts GROUP BY doc_id, category, field, key),
      g AS (SELECT doc_id, group_pos, source_id, ids FROM rule WHERE group_pos % 4 <> 0 UNION ALL SELECT doc_id, 100000, source_id, [source_id] FROM rule WHERE group_pos = 1),
      m AS (SELECT doc_id, group_pos, source_id, unnest(ids) AS candidate_id FROM g),
      a AS (SELECT m.*, f.category, f.field, f.value, f.confidence, f.start_char, f.end_char, min(group_pos) OVER (PARTITION BY doc_id, candidate_id) AS first_pos FROM m JOIN facts f USING (doc_id, candidate_id)),
      b AS (SELECT *, arg_min(candidate_id, {{'a': length(value), 'b': length(value), 'c': candidate_id}}) OVER (PARTITION BY doc_id, group_pos) AS best_id, max((first_pos < group_pos)::INT) OVER (PARTITION BY doc_id, group_pos) AS reused FROM a),
      assessed AS (SELECT b.doc_id, group_pos, candidate_id, best_id, b.category, b.field, first_pos, CASE WHEN plan.field IS NULL THEN 'schema_violation' WHEN reused = 1 THEN 'reconciler_rejected' END AS fault, value, confidence FROM b LEFT JOIN plan USING (category, field))"""


def _match_sql(w: str) -> str:
    place = "start_char, end_char, start_byte, end_byte"
    key = f"doc_id, {_folded('category')} AS kc, {_folded('field')} AS kf, {_folded('value')} AS kv"
    k = "doc_id, kc, kf, kv"
    return w + f""", one AS (SELECT 'exp-' || candidate_id AS expected_id, doc_id, category, field, CASE WHEN doc_id % 5 = 0 AND ordinal = 0 THEN value || 'x' ELSE value END AS value, value AS source_text,
        start_char + (ordinal % 3 = 1)::INT AS start_char, end_char + (ordinal % 3 = 1)::INT AS end_char, start_byte, end_byte, ordinal FROM facts WHERE ordinal % 6 <> 5),
      want AS (SELECT * FROM one UNION ALL SELECT 'dup-' || expected_id, doc_id, category, field, value, source_text, start_char, end_char, start_byte, end_byte, ordinal FROM one WHERE ordinal % 7 = 2),
      l AS (SELECT expected_id, {key}, {place}, source_text AS st FROM want), f AS (SELECT candidate_id, {key}, {place}, value AS st FROM facts),
      l1 AS (SELECT *, row_number() OVER (PARTITION BY {k}, {place}, st ORDER BY expected_id) AS r FROM l), f1 AS (SELECT *, row_number() OVER (PARTITION BY {k}, {place}, st ORDER BY candidate_id) AS r FROM f),
      exact AS (SELECT expected_id, candidate_id FROM l1 JOIN f1 USING ({k}, {place}, st, r)),
      l2 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY expected_id) AS r FROM l WHERE expected_id NOT IN (SELECT expected_id FROM exact)),
      f2 AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY candidate_id) AS r FROM f WHERE candidate_id NOT IN (SELECT candidate_id FROM exact)),
      loose AS (SELECT expected_id, candidate_id FROM l2 JOIN f2 USING ({k}, r)),
      met AS (SELECT expected_id, candidate_id AS data_point_id, 'exact' AS status FROM exact UNION ALL SELECT expected_id, candidate_id, 'matched' FROM loose
        UNION ALL SELECT expected_id, NULL, 'missing' FROM l2 WHERE expected_id NOT IN (SELECT expected_id FROM loose) UNION ALL SELECT NULL, candidate_id, 'unexpected' FROM f2 WHERE candidate_id NOT IN (SELECT candidate_id FROM loose))"""


def _score_sql(w: str) -> str:
    ratios = """round(CASE WHEN actual = 0 THEN 0.0 ELSE hits / actual END, 6) AS precision, round(CASE WHEN expected = 0 THEN 1.0 ELSE hits / expected END, 6) AS recall,
        round(CASE WHEN expected = 0 THEN 1.0 ELSE exact / expected END, 6) AS provenance_recall, CASE WHEN expected + actual = 0 OR hits = 0 AND expected > 0 THEN 0.0 WHEN actual = 0 THEN 0.0
        ELSE round(2 * (hits / actual) * (CASE WHEN expected = 0 THEN 1.0 ELSE hits / expected END) / nullif(hits / actual + CASE WHEN expected = 0 THEN 1.0 ELSE hits / expected END, 0), 6) END AS f1"""
    return _match_sql(w) + f""", ev AS (SELECT doc_id::VARCHAR AS fixture, category, field, 1 AS e, 0 AS a, 0 AS h, 0 AS x FROM want UNION ALL SELECT doc_id::VARCHAR, category, field, 0, 1, 0, 0 FROM facts
        UNION ALL SELECT doc_id::VARCHAR, category, field, 0, 0, 1, (status = 'exact')::INT FROM want JOIN met USING (expected_id) WHERE status IN ('exact', 'matched')),
      sums AS (SELECT CASE WHEN grouping(fixture) = 0 THEN 'fixture' WHEN grouping(category) = 1 THEN 'suite' WHEN grouping(field) = 1 THEN 'category' ELSE 'field' END AS scope, fixture, category, field,
        sum(e)::BIGINT AS expected, sum(a)::BIGINT AS actual, sum(h)::BIGINT AS hits, sum(x)::BIGINT AS exact, 0::BIGINT AS violations FROM ev GROUP BY GROUPING SETS ((category, field), (category), (), (fixture))),
      sc AS (SELECT *, {ratios} FROM sums)"""


def _sentence_sql() -> str:
    """CTEs from ``d`` (doc_id, t) to ``sentence``."""
    titles = "', '".join(t + "." for t in D.TITLES)
    return f"""ms AS (SELECT doc_id, t, regexp_extract_all(t, '[.!?]|\\n\\n') AS m, regexp_split_to_array(t, '[.!?]|\\n\\n') AS g FROM d),
    at_ AS (SELECT doc_id, t, i, m[i] AS x, (sum(length(g[i])) OVER w + coalesce(sum(length(m[i])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS p
      FROM ms, unnest(generate_series(1, len(m))) AS u(i) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    look AS (SELECT *, right(substr(t, 1, p), 80) AS before, substr(t, p + 2, 200) AS rest FROM at_),
    cut AS (SELECT doc_id, t, p, CASE WHEN x = chr(10) || chr(10) THEN p ELSE p + 1 END AS e, CASE WHEN x = chr(10) || chr(10) THEN p + 2 ELSE p + 1 END AS s FROM look
      WHERE x = chr(10) || chr(10) OR (regexp_matches(rest, '^({WS}|$)') AND lower(regexp_extract(before, '([^ \\n]*)$', 1) || '.') NOT IN ('{titles}') AND NOT regexp_matches(regexp_extract(before, '([^ \\n]*)$', 1) || '.', '(?:[A-Z]\\.)+[A-Z]\\.$')
        AND NOT regexp_matches(rest, '^{WS}*\\p{{Ll}}'))),
    ends AS (SELECT doc_id, t, p, e, s FROM cut UNION ALL SELECT doc_id, t, length(t) + 1, length(t), length(t) FROM d),
    seg AS (SELECT doc_id, t, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY p), 0) AS a, e FROM ends),
    txt AS (SELECT doc_id, a, substr(t, a + 1, e - a) AS q FROM seg WHERE e > a),
    ok AS (SELECT doc_id, a + length(q) - length(regexp_replace(q, '^{WS}+', '')) AS start_char, {_strip('q')} AS z FROM txt),
    sentence AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS sentence_index, start_char, start_char + length(z) AS end_char FROM ok WHERE z <> '' AND NOT starts_with(z, '#') AND regexp_matches(z, '[\\p{{L}}\\p{{N}}]'))"""


def _deal_sql() -> str:
    """The sample's documents with sentences of a contract behind their text."""
    who = "CASE doc_id % 3 WHEN 1 THEN 'Contractor' ELSE 'Manufacturer' END"
    more = (
        f"chr(10) || chr(10) || 'This is agreed; the ' || {who} || ' must deliver ' || doc_id || ' units to Wholesalers, unless ' || coalesce(source, 'nobody') || ' is closed; it shall pay 5 € é. Notwithstanding this, ' || {who} || 's of ' || coalesce(lang, 'xx')"
        " || ' work with Wholesalers and Distributors, Electricians, except for holidays. \"Units\" means goods of ' || coalesce(source, 'nobody') || '; on 5 May 2026 the Board approved them at 10:30 am. Report of it! Éa began'"
    )
    return f"deal AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN text ELSE {TEXT} || {more} END AS text FROM documents)"


def _clause_sql(lens: str) -> str:
    """A lens over sentences, each cue or entity tried against each sentence of its document."""
    base = f"WITH {_deal_sql()}, d AS (SELECT doc_id, {TEXT} AS t FROM deal WHERE length({TEXT}) > 0), " + _sentence_sql()
    lenses = [x for x in X.LENSES if x[0] == "entity"] if lens == "relation" else [x for x in K.CUES if x[0] == lens]
    inside = "inside AS (SELECT f.*, s.start_char AS s0, s.end_char AS s1, d.t FROM facts f JOIN d USING (doc_id) JOIN sentence s ON s.doc_id = f.doc_id AND f.start_char >= s.start_char AND f.end_char <= s.end_char)"
    w = f"{base}, {_facts_sql(lenses, 'deal')}, {inside}"
    if lens == "relation":
        w += """, pair AS (SELECT *, lag(start_char) OVER p AS a0, lag(end_char) OVER p AS a1, lag(start_byte) OVER p AS ab, lag(s0) OVER p AS as0 FROM inside WINDOW p AS (PARTITION BY doc_id ORDER BY start_char, end_char DESC, field)),
          good AS (SELECT * FROM pair WHERE as0 = s0 AND a1 <= start_char AND start_char - a1 <= 80 AND regexp_matches(substr(t, a1 + 1, start_char - a1), '[a-z]')),
          made AS (SELECT doc_id, source, 'relation' AS lens, 'Relation' AS category, 'related' AS field, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, end_char DESC, field) - 1 AS ordinal, substr(t, a0 + 1, end_char - a0) AS value, a0 AS start_char, ab AS start_byte FROM good)"""
    else:
        head, rest = "substr(t, s0 + 1, start_char - s0)", "substr(t, end_char + 1, s1 - end_char)"
        before = f"regexp_replace(regexp_extract({head}, '([^,;]*)$', 1), '^\\s+', '')" if lens == "obligation" else "''"
        stop = "^[^;]*" if lens == "obligation" else "^[^,;]*"
        w += f", bite AS (SELECT *, {before} AS before, regexp_extract({rest}, '{stop}') AS after FROM inside), made AS (SELECT doc_id, source, lens, category, field, ordinal, before || value || after AS value, start_char - length(before) AS start_char, start_byte - strlen(before) AS start_byte FROM bite)"
    return w + f" SELECT *, start_char + length(value) AS end_char, start_byte + strlen(value) AS end_byte, 1.0::DOUBLE AS confidence, {_id('cand-', 'doc_id', 'lens', 'category', 'field', 'value', 'start_char')} AS candidate_id FROM made"


#: Stored chains of users' events (``stored``), and the same as the sample alters them (``x``).
CHAIN = """ev AS (SELECT user_id, event_id || '|' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
  stored AS (SELECT user_id, seq, payload, sha256(payload) AS payload_hash, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || sha256(payload)) AS chain_hash FROM ev WHERE seq = 0
    UNION ALL SELECT ev.user_id, ev.seq, ev.payload, sha256(ev.payload), s.chain_hash, sha256(s.chain_hash || sha256(ev.payload)) FROM stored s JOIN ev ON ev.user_id = s.user_id AND ev.seq = s.seq + 1),
  m AS (SELECT *, (seq * 7 + user_id) % 61 AS m FROM stored),
  x AS (SELECT user_id, CASE WHEN m <> 40 THEN seq END AS seq, payload || CASE WHEN m = 17 THEN 'x' ELSE '' END AS payload, payload_hash || CASE WHEN m = 23 THEN 'x' ELSE '' END AS payload_hash,
    CASE WHEN seq = 0 AND user_id % 9 = 4 THEN repeat('1', 64) ELSE previous_hash END AS previous_hash, chain_hash || CASE WHEN m = 29 THEN 'x' ELSE '' END AS chain_hash
    FROM m, range(CASE WHEN m = 11 THEN 2 ELSE 1 END) WHERE m <> 3)"""


#: The sample's words of lines, each looked for behind the one before, step by step (``spot``); lines that lack one (``lost``).
ALIGN = f"""WITH RECURSIVE line AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS t FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS u(i)),
  said AS (SELECT doc_id, line_no, t, list_concat(list_filter(list_filter(string_split(t, ' '), lambda x: x <> ''), lambda x, i: i % 3 <> 0), CASE WHEN doc_id % 7 = 5 AND line_no % 3 = 1 THEN ['zqzq9'] ELSE [] END) AS ws FROM line),
  walk AS (SELECT doc_id, line_no, t, ws, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS e, true AS ok FROM said WHERE len(ws) > 0
    UNION ALL SELECT doc_id, line_no, t, ws, i + 1, e + p - 1, e + p - 1 + length(ws[i + 1]), p > 0 FROM (SELECT *, instr(substr(t, e + 1), ws[i + 1]) AS p FROM walk WHERE i < len(ws) AND ok)),
  lost AS (SELECT doc_id, line_no FROM walk WHERE NOT ok),
  spot AS (SELECT doc_id, line_no, t, ws, i - 1 AS k, s, e FROM walk WHERE i > 0 AND (doc_id, line_no) NOT IN (SELECT (doc_id, line_no) FROM lost))"""


def _rounds_sql(w: str) -> str:
    """Askings and replies; then attempt after attempt as a recursion, over replies numbered within each."""
    said = ", ".join(f"({h}, {k}, {t}, {pos}, '{d}', {f"'{fault}'" if fault else 'NULL'})" for h, one in enumerate(S.ROUNDS) for k, t, pos, d, fault in one)
    most, wait = S.ATTEMPTS, S.PATIENCE
    return w.replace("WITH ", "WITH RECURSIVE ", 1) + f""", shape(h, attempt, after, pos, decision, fault) AS (VALUES {said}),
      ask AS (SELECT candidate_id, doc_id * 1000 AS "at" FROM facts),
      reply AS (SELECT CASE WHEN ordinal % 11 = 7 THEN 'unknown-' || candidate_id ELSE candidate_id END AS candidate_id, attempt, doc_id * 1000 + after AS "at", pos, decision, CASE WHEN decision = 'reject' THEN 'critic_rejected' END AS code, fault
        FROM facts JOIN shape ON h = (doc_id * 3 + ordinal) % {len(S.ROUNDS)}),
      one AS (SELECT * FROM reply WHERE attempt <= {most} QUALIFY row_number() OVER (PARTITION BY candidate_id, attempt ORDER BY "at", fault IS NOT NULL, pos) = 1),
      try_ AS (SELECT candidate_id, 0 AS k, "at" AS e, '' AS why FROM ask
        UNION ALL SELECT t.candidate_id, k + 1, CASE WHEN fault IS NOT NULL AND "at" >= e AND "at" <= e + {wait} THEN "at" ELSE e + {wait} END, CASE WHEN fault IS NOT NULL AND "at" >= e AND "at" <= e + {wait} THEN fault ELSE 'missing_reply' END
          FROM try_ t LEFT JOIN one ON one.candidate_id = t.candidate_id AND attempt = k + 1 WHERE k < {most}),
      over_ AS (SELECT candidate_id, e, why FROM try_ WHERE k = {most}),
      good AS (SELECT one.* FROM one JOIN over_ USING (candidate_id) WHERE fault IS NULL AND "at" <= e QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY "at", attempt) = 1),
      again AS (SELECT t.candidate_id, (k + 1)::BIGINT AS attempt, e AS "at", why AS complaint FROM try_ t LEFT JOIN good g USING (candidate_id) WHERE k BETWEEN 1 AND {most - 1} AND (g."at" IS NULL OR e < g."at"))"""


def oracle_sql() -> dict[str, str]:
    chunk = "WITH " + _chunk_sql(*S.CHUNK)
    w = "WITH " + _facts_sql()
    c = chunk + ", " + _facts_sql(table="chunk")
    dd = c + ", " + DEDUP
    claim = _claim_sql()
    review = _review_sql(c)
    cross = "groups_ AS (SELECT category, field, key, count(DISTINCT doc_id) AS n_docs, count(*) AS n_facts, min(candidate_id) AS first_id, " + _id("xdg-", "category", "field", "key") + " AS group_id FROM facts GROUP BY category, field, key HAVING count(DISTINCT doc_id) >= 2)"
    match, score, group = _match_sql(w), _score_sql(w), _group_sql(w)
    lens_cols = "doc_id, source, lens, category, field, ordinal, value, start_char, end_char, start_byte, end_byte, 1.0::DOUBLE AS confidence, candidate_id"
    lens = {f"lens_{k}": f"WITH {_deal_sql()}, " + _facts_sql([x for x in X.LENSES if x[0] == k], "deal") + f" SELECT {lens_cols} FROM facts" for k in ("number", "citation", "entity", "temporal", "quantity_with_unit", "definition", "event", "claim")}
    fmt = " ".join(f"WHEN suffix = '{k}' THEN '{v}'" for k, v in D.FORMATS.items())
    lines = f"SELECT doc_id, i - 1 AS line_no, ls[i] AS line, ls[i - 1] AS prev, length(array_to_string(ls[1:i - 1], chr(10))) + (i > 1)::INT AS c0, strlen(array_to_string(ls[1:i - 1], chr(10))) + (i > 1)::INT AS b0 FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents WHERE length({TEXT}) > 0), unnest(generate_series(1, len(ls))) AS u(i)"
    role = "CASE WHEN length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '^(?:[-*]|[0-9]+[.)]) ') THEN 'list_item' WHEN len(string_split(line, ' ')) <= 8 THEN 'heading' ELSE 'paragraph' END"
    block = f"b AS (SELECT doc_id, 'line:' || line_no AS span_id, {role} AS role, c0 AS start_char, c0 + length(line) AS end_char, b0 AS start_byte, b0 + strlen(line) AS end_byte FROM ({lines}) WHERE line <> '')"
    tables_text = f"(SELECT doc_id, {TEXT} AS t FROM documents WHERE length({TEXT}) > 0)"
    sentence = f"""WITH d AS {tables_text}, {_sentence_sql()} SELECT doc_id, sentence_index, start_char, end_char FROM sentence"""
    kinds = " UNION ALL ".join(f"SELECT {i}::INT AS ord, '{k}' AS kind" for i, k in enumerate(R.SUMMARY_ORDER))
    order = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(R.DIFF_ORDER)) + " END"
    diff = w + f""", p1 AS (SELECT * FROM facts WHERE ordinal = 0 OR doc_id % 7 = 5),
      p2 AS (SELECT doc_id, category, field, CASE WHEN doc_id % 7 = 1 THEN 'new ' || value ELSE value END AS value, CASE WHEN doc_id % 7 = 2 THEN start_char + 1 ELSE start_char END AS start_char, end_char, CASE WHEN doc_id % 7 = 3 THEN confidence + 1 ELSE confidence END AS confidence, candidate_id FROM p1 WHERE doc_id % 7 <> 0
        UNION ALL SELECT doc_id, category, 'extra_' || field, value, start_char, end_char, confidence, candidate_id FROM p1 WHERE doc_id % 7 = 4),
      s1 AS (SELECT doc_id, category, field, count(*) AS n, string_agg(candidate_id, ',' ORDER BY start_char, candidate_id) AS ids, min(value) AS v, min(start_char) AS s, min(end_char) AS e, min(confidence) AS c FROM p1 GROUP BY ALL),
      s2 AS (SELECT doc_id, category, field, count(*) AS n, string_agg(candidate_id, ',' ORDER BY start_char, candidate_id) AS ids, min(value) AS v, min(start_char) AS s, min(end_char) AS e, min(confidence) AS c FROM p2 GROUP BY ALL),
      both_ AS (SELECT doc_id, category, field, CASE WHEN s1.n > 1 OR s2.n > 1 THEN 'ambiguous_match' WHEN s1.v <> s2.v THEN 'changed_value' WHEN s1.s <> s2.s OR s1.e <> s2.e THEN 'changed_provenance' WHEN s1.c <> s2.c THEN 'changed_confidence' ELSE 'unchanged' END AS kind, s1.ids AS old_ids, s2.ids AS new_ids FROM s1 JOIN s2 USING (doc_id, category, field)),
      df AS (SELECT * FROM both_ UNION ALL SELECT doc_id, category, field, 'removed', candidate_id, '' FROM p1 WHERE (doc_id, category, field) NOT IN (SELECT (doc_id, category, field) FROM s2)
        UNION ALL SELECT doc_id, category, field, 'added', '', candidate_id FROM p2 WHERE (doc_id, category, field) NOT IN (SELECT (doc_id, category, field) FROM s1))"""
    bins = match + """, right_ AS (SELECT data_point_id AS candidate_id, (status IN ('exact', 'matched'))::INT::DOUBLE AS ok FROM met WHERE data_point_id IS NOT NULL),
      gb AS (SELECT least(floor(confidence * 5), 4)::INT AS bin, count(*) AS n, avg(confidence) AS c, avg(coalesce(ok, 0.0)) AS a FROM facts LEFT JOIN right_ USING (candidate_id) GROUP BY 1),
      bins_ AS (SELECT b::INT AS bin, coalesce(n, 0)::BIGINT AS n, round(c, 6) AS mean_confidence, round(a, 6) AS accuracy, round(abs(c - a), 6) AS gap FROM generate_series(0, 4) AS s(b) LEFT JOIN gb ON gb.bin = b)"""
    mut = w + """, ch AS (SELECT doc_id AS mutation_id, candidate_id AS expected_id, '<' || value || '>' AS retired, '[' || value || ']' AS introduced FROM facts WHERE ordinal = 0),
      vals AS (SELECT doc_id AS mutation_id, CASE (doc_id + length(value)) % 4 WHEN 0 THEN 'old <' || value || '>' WHEN 1 THEN 'both <' || value || '> [' || value || ']' ELSE 'NEW [' || upper(value) || ']' END AS value FROM facts WHERE ordinal = 0),
      hit AS (SELECT mutation_id, expected_id, retired, introduced, max((contains({v}, {r}))::INT) AS r, max((contains({v}, {i}))::INT) AS i FROM ch LEFT JOIN vals USING (mutation_id) GROUP BY ALL),
      fails AS (SELECT mutation_id, expected_id, 'retired_value_retained' AS code, retired AS value FROM hit WHERE r = 1 UNION ALL SELECT mutation_id, expected_id, 'introduced_value_missing', introduced FROM hit WHERE i = 0)""".replace("{v}", _folded("value")).replace("{r}", _folded("retired")).replace("{i}", _folded("introduced"))
    triage = ", ".join(f"'{x}'" for x in R.TRIAGE)
    few = " UNION ALL ".join(f"SELECT '{s}' AS scope, {f"'{a}'" if a else 'NULL'} AS category, {f"'{b}'" if b else 'NULL'} AS field, '{m}' AS metric, 0.9::DOUBLE AS threshold" for s, a, b in (("suite", None, None), ("category", "Quantity", None), ("category", "Nothing", None), ("field", "Entity", "name")) for m in R.RATIOS)
    schemas = ", ".join(f"('{i}', '{k}', {h if h else '[]::VARCHAR[]'})" for i, k, h in S.SCHEMAS)
    made = {
        "doc_identity": f"SELECT doc_id, 'doc-' || substr(sha256({TEXT}), 1, 32) AS doc_key, sha256({TEXT}) AS text_sha256, length({TEXT}) AS chars, strlen({TEXT}) AS bytes FROM documents",
        "format_detect": f"WITH s AS (SELECT page_id, regexp_extract(lower(url), '([.][^./]+)$', 1) AS suffix FROM pages), f AS (SELECT *, CASE {fmt} END AS format FROM s) SELECT *, CASE WHEN format IS NULL THEN 'unsupported format: ' || suffix END AS error FROM f",
        "page_and_source_map": f"SELECT doc_id, 1::BIGINT AS page_number, 'source' AS kind, 0::BIGINT AS start_char, length({TEXT}) AS end_char, 0::BIGINT AS start_byte, strlen({TEXT}) AS end_byte FROM documents WHERE length({TEXT}) > 0",
        "chunk_token_window": chunk + " SELECT doc_id, chunk_index, token_start, token_end, start_char, start_byte, end_char, end_byte, chunk_id FROM chunk",
        "chunk_ids": "WITH " + _chunk_sql(D.WINDOW, D.OVERLAP) + " SELECT doc_id, chunk_index, chunk_id FROM chunk",
        "chunk_pages_overlap": f"""WITH s AS (SELECT doc_id, length({TEXT}) AS n, k FROM documents, unnest(generate_series(0, (length({TEXT}) - 1) // 700)) AS u(k) WHERE length({TEXT}) > 0)
          SELECT doc_id, k AS span_index, array_to_string(generate_series(k * 700 // 1000 + 1, (least((k + 1) * 700, n) - 1) // 1000 + 1), ',') AS pages FROM s""",
        "section_carry_forward": f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM (SELECT doc_id, string_split({TEXT}, chr(10)) AS ls FROM documents), unnest(generate_series(1, len(ls))) AS u(i))
          SELECT doc_id, line_no, last_value(CASE WHEN len(string_split(line, ' ')) <= 8 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM l WHERE line <> ''""",
        "sentence_spans": sentence,
        "layout_blocks": f"WITH {block} SELECT * FROM b",
        "layout_errors": f"SELECT doc_id, '' AS errors FROM documents WHERE length({TEXT}) > 0",
        "chunk_boundaries": f"""WITH {block}, d AS (SELECT doc_id, length({TEXT}) AS n, strlen({TEXT}) AS m FROM documents WHERE length({TEXT}) > 0),
          e AS (SELECT doc_id, 0 AS char_offset, 0 AS byte_offset, 0 AS priority, 'document:start' AS boundary_id, 'document_start' AS kind, NULL::BIGINT AS page_number FROM d UNION ALL SELECT doc_id, n, m, 0, 'document:end', 'document_end', NULL FROM d
            UNION ALL SELECT doc_id, 0, 0, 10, 'page:1:start', 'page_start', 1 FROM d UNION ALL SELECT doc_id, n, m, 10, 'page:1:end', 'page_end', 1 FROM d
            UNION ALL SELECT doc_id, start_char, start_byte, CASE role WHEN 'table' THEN 30 ELSE 20 END, CASE role WHEN 'table' THEN 'table:' ELSE 'layout:' END || span_id || ':start', CASE role WHEN 'table' THEN 'table_start' ELSE 'layout_start' END, 1 FROM b
            UNION ALL SELECT doc_id, end_char, end_byte, CASE role WHEN 'table' THEN 30 ELSE 20 END, CASE role WHEN 'table' THEN 'table:' ELSE 'layout:' END || span_id || ':end', CASE role WHEN 'table' THEN 'table_end' ELSE 'layout_end' END, 1 FROM b)
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_offset, byte_offset, priority, boundary_id) - 1 AS rank FROM e""",
        "word_alignment": ALIGN + """ SELECT doc_id, line_no, k::BIGINT AS word_index, s AS start_char, e AS end_char, strlen(substr(t, 1, s)) AS start_byte, strlen(substr(t, 1, e)) AS end_byte FROM spot
          UNION ALL SELECT doc_id, line_no, NULL, NULL, NULL, NULL, NULL FROM lost""",
        "cell_alignment": ALIGN + """ SELECT doc_id, line_no, (k // 3)::BIGINT AS row_index, (k % 3)::BIGINT AS column_index, s AS start_char, e AS end_char, CASE WHEN k < 3 THEN '' ELSE ws[k % 3 + 1] END AS headers FROM spot
          UNION ALL SELECT doc_id, line_no, NULL, NULL, NULL, NULL, NULL FROM lost""",
        "page_join": f"""WITH p AS (SELECT conv_id AS doc_id, turn, {TEXT} AS t, row_number() OVER w AS page_number, coalesce(sum(length({TEXT}) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char, coalesce(sum(strlen({TEXT}) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, {TEXT})), h AS (SELECT doc_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY page_number)) AS text_sha256 FROM p GROUP BY doc_id)
          SELECT doc_id, text_sha256, page_number, start_char, start_char + length(t) AS end_char, start_byte, start_byte + strlen(t) AS end_byte FROM p JOIN h USING (doc_id)""",
        "html_tag_counts": "SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<h[1-6][ >]'))::BIGINT AS headings, len(regexp_extract_all(coalesce(html, ''), '<p[ >]'))::BIGINT AS paragraphs, len(regexp_extract_all(coalesce(html, ''), '<li[ >]'))::BIGINT AS items, regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) AS title FROM pages",
        **lens,
        **{f"lens_{k}": _clause_sql(k) for k in ("relation", "obligation", "condition", "exception")},
        "span_roundtrip_check": w + " SELECT candidate_id, f.doc_id, lens, ordinal, substr(text, start_char + 1, end_char - start_char) = value AND decode(encode(text)[start_byte + 1:end_byte]) = value AS span_ok FROM facts f JOIN documents d USING (doc_id)",
        "span_invariants": w + f""", j AS (SELECT candidate_id, (f.doc_id + ordinal) % 5 AS h, {TEXT} AS t, start_char FROM facts f JOIN documents USING (doc_id))
          SELECT candidate_id, 'source_span_out_of_bounds' AS code FROM j WHERE h = 1 UNION ALL SELECT candidate_id, 'source_span_byte_offset_mismatch' FROM j WHERE h = 2 UNION ALL SELECT candidate_id, 'source_span_byte_mismatch' FROM j WHERE h = 2
          UNION ALL SELECT candidate_id, 'source_span_text_mismatch' FROM j WHERE h = 3 UNION ALL SELECT candidate_id, 'source_span_byte_mismatch' FROM j WHERE h = 3""",
        "resolve_claim_offsets": claim + f""", s AS (SELECT *, claim - k0 AS p, CASE WHEN claim >= k0 AND n > 0 AND claim - k0 + n <= length(t) THEN substr(t, (claim - k0 + 1)::BIGINT, n) END AS cut FROM place),
          y AS (SELECT *, contains(cut, value) OR (bare <> '' AND contains(cut, bare)) OR contains({_folded('cut')}, {_folded('value')}) AS holds, coalesce(n <= 24 AND len(list_filter(generate_series(1, length(t)), lambda i: substr(t, i, n) = cut)) > 1, false) AS vague,
            len(spots) AS m, list_filter(spots, lambda x: NOT regexp_matches(regexp_extract(left(t, x.a::BIGINT), '([^\n]*)$', 1), '^{WS}*#')) AS body FROM s),
          r AS (SELECT *, CASE WHEN (cut IS NULL OR NOT holds) AND m = 1 THEN spots[1]
              WHEN cut IS NOT NULL AND NOT holds AND m > 1 AND field = 'metric_name' THEN coalesce(list_filter(body, lambda x: x.a >= p)[1], CASE WHEN len(body) = 1 THEN body[1] END) END AS fix FROM y)
          SELECT candidate_id AS claim_id, doc_id, lens, ordinal, claim AS start_char,
            CASE WHEN fix IS NOT NULL THEN 'repaired' WHEN cut IS NULL OR vague OR (NOT holds AND m > 1) THEN 'rejected' ELSE 'claimed' END AS resolution,
            (CASE WHEN fix IS NOT NULL THEN fix.a + k0 WHEN cut IS NULL THEN k0 ELSE claim END)::BIGINT AS resolved_start,
            CASE WHEN fix IS NOT NULL THEN substr(t, (fix.a + 1)::BIGINT, (fix.z - fix.a)::BIGINT) WHEN cut IS NULL THEN left(t, 1) ELSE cut END AS source_text,
            CASE WHEN fix IS NOT NULL THEN '' WHEN cut IS NULL AND m = 0 THEN 'invalid_source_offsets' WHEN cut IS NOT NULL AND vague THEN 'ambiguous_source_span' WHEN cut IS NULL OR (NOT holds AND m > 1) THEN 'invalid_source_offsets,ambiguous_source_span' ELSE '' END AS codes FROM r""",
        "value_matches": claim + " SELECT candidate_id AS claim_id, len(spots)::BIGINT AS n, spots[1].a::BIGINT AS first_start, spots[len(spots)].z::BIGINT AS last_end FROM place",
        "value_supported": f"""WITH l AS ({lines}), j AS (SELECT doc_id, line_no, {_folded('line')} AS a, {_folded('prev')} AS b, {_stems('line')} AS x, {_stems('prev')} AS y FROM l WHERE line_no > 0 AND line <> '')
          SELECT doc_id, line_no, contains(b, a) OR (len(x) > 0 AND len(list_filter(x, lambda q: NOT list_contains(y, q))) = 0) AS supported FROM j""",
        "canonical_key": f"""WITH v AS (SELECT 'benchmark' AS origin, item_id AS id, {TEXT} AS value FROM benchmark UNION ALL SELECT 'documents', doc_id, {TEXT} FROM documents UNION ALL SELECT 'conversations', conv_id, {TEXT} FROM conversations),
          k AS (SELECT origin, id, {_key('value')} AS key FROM v) SELECT origin, id, length(key) AS key_chars, sha256(key) AS key_sha256 FROM k""",
        "dedup_survivors": dd + " SELECT candidate_id, doc_id, lens, category, field, key FROM dd WHERE candidate_id = primary_id",
        "dedup_rejections": dd + f" SELECT {_id('rej-', 'candidate_id', 'primary_id', chr(39) + 'duplicate_candidate' + chr(39))} AS rejection_id, candidate_id, primary_id, 'merged_into:' || primary_id AS message FROM dd WHERE candidate_id <> primary_id",
        "dedup_clusters": c + " SELECT doc_id, lens, category, field, key, count(*) AS members, count(DISTINCT chunk_id) AS spans, min(candidate_id) AS primary_id, string_agg(candidate_id, ',' ORDER BY candidate_id) AS all_ids FROM facts GROUP BY doc_id, lens, category, field, key, start_char, end_char HAVING count(*) >= 2",
        "field_conflicts": w + f", k AS (SELECT doc_id, category, field, count(DISTINCT key) AS n_keys, count(*) AS n_facts, list_sort(list_distinct(list(key))) AS ks FROM facts GROUP BY doc_id, category, field HAVING count(DISTINCT key) >= 2) SELECT doc_id, category, field, n_keys, n_facts, {_id('conf-', 'doc_id', 'category', 'field', 'array_to_string(ks, chr(10))')} AS conflict_id FROM k",
        "crossdoc_groups": w + f", {cross} SELECT * FROM groups_",
        "crossdoc_conflicts": w + f", {cross} SELECT category, field, count(*) AS n_groups, sum(n_facts)::BIGINT AS n_facts, {_id('xdc-', 'category', 'field')} AS conflict_id FROM groups_ GROUP BY category, field HAVING count(*) > 1",
        "crossdoc_skipped": w + ", l AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id) SELECT CASE WHEN q IS NULL THEN 'missing_manifest' WHEN q <> 1 THEN 'run_not_completed' WHEN doc_id % 9 = 0 THEN 'document_missing' WHEN t = 1 THEN 'schema_missing' END AS reason, count(*) AS n, count(DISTINCT f.doc_id) AS n_docs FROM facts f LEFT JOIN l USING (doc_id) GROUP BY 1",
        "source_specificity_pick": w + " SELECT category, field, key, arg_min(candidate_id, {'a': length(value), 'b': candidate_id}) AS picked_id FROM facts GROUP BY category, field, key",
        "review_batches": c + " SELECT candidate_id, doc_id, chunk_id, ((row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY lens, field, ordinal) - 1) // 20)::BIGINT AS batch FROM facts",
        "source_context": w + " SELECT candidate_id, f.doc_id, lens, ordinal, 'matched' AS status, substr(text, greatest(start_char - 30, 0) + 1, least(30, start_char)) AS prefix, substr(text, start_char + 1, end_char - start_char) AS highlight, substr(text, end_char + 1, 30) AS suffix FROM facts f JOIN documents d USING (doc_id)",
        "approved_fields": review + " SELECT candidate_id, array_to_string(codes, ',') AS codes, field_ok AS valid FROM ex",
        "critic_reports": review + " SELECT candidate_id, accepted, reason, accepted::INT::DOUBLE AS score, corrected, CASE WHEN corrected THEN left(value, length(value) - 1) ELSE value END AS value, start_char, end_char - corrected::INT AS end_char FROM critic",
        "corrections": review + " SELECT candidate_id, outcome, faults FROM fixed WHERE said BETWEEN 2 AND 6",
        "verifier_reports": review + " SELECT candidate_id, doc_id, len(codes) = 0 AS accepted, array_to_string(codes, ',') AS codes, (len(codes) = 0)::INT::DOUBLE AS score, true AS span_verified, field_ok AS category_verified FROM vcodes",
        "rejection_summary": review + " SELECT lens, reason, count(DISTINCT candidate_id) AS n, count(DISTINCT doc_id) AS n_docs FROM critic WHERE NOT accepted GROUP BY ROLLUP (lens, reason)",
        "drop_summary": review + ", e AS (SELECT stage, unnest(codes) AS code FROM drops) SELECT stage, code, count(*) AS n FROM e GROUP BY stage, code UNION ALL SELECT stage, NULL, count(*) FROM e GROUP BY stage UNION ALL SELECT NULL, NULL, count(*) FROM drops",
        "rejected_candidates": review + ", e AS (SELECT stage, candidate_id, unnest(codes) AS code FROM drops) SELECT stage, code, count(DISTINCT candidate_id) AS n FROM e GROUP BY stage, code",
        "verdict_complaints": review + " SELECT DISTINCT candidate_id, 'unknown_id' AS complaint FROM said WHERE candidate_id NOT IN (SELECT candidate_id FROM facts) UNION ALL SELECT candidate_id, 'missing_id' FROM facts WHERE candidate_id NOT IN (SELECT candidate_id FROM said)",
        "mirrored_reports": review + f", {DEDUP} SELECT dd.candidate_id, primary_id, accepted, reason FROM dd JOIN critic r ON r.candidate_id = primary_id WHERE dd.candidate_id <> primary_id",
        "candidate_fates": review + f", {DEDUP}, s AS (SELECT *, min(primary_id) OVER (PARTITION BY doc_id, lens, category, field, key) AS rest FROM dd) SELECT s.candidate_id, CASE WHEN s.candidate_id <> rest THEN 'dedup_then_' ELSE '' END || CASE WHEN accepted THEN 'data_point' ELSE 'critic_rejected' END AS fate FROM s JOIN critic r ON r.candidate_id = rest",
        "fact_confidence": review + f", {DEDUP}, r AS (SELECT candidate_id AS primary_id, accepted::INT::DOUBLE AS score FROM critic) SELECT primary_id AS candidate_id, count(*) AS members, least(min(confidence), any_value(score)) AS confidence FROM dd JOIN r USING (primary_id) GROUP BY primary_id",
        "reconcile_groups": group + " SELECT doc_id, group_pos, candidate_id, best_id, category, field, first_pos, fault FROM assessed",
        "data_points": group + """, dp AS (SELECT doc_id, group_pos, best_id, category, field, least(min(confidence), 0.8::DOUBLE) AS confidence, array_to_string(list_sort(list(candidate_id)), ',') AS members FROM assessed WHERE fault IS NULL GROUP BY doc_id, group_pos, best_id, category, field)
          SELECT dp.doc_id, group_pos, best_id, dp.category, dp.field, dp.confidence, members, f.value, f.start_char, f.end_char FROM dp JOIN facts f ON f.candidate_id = best_id""",
        "reconcile_rejections": group + ", x AS (SELECT doc_id, candidate_id, count(*) FILTER (fault IS NULL) AS sound, arg_min(fault, group_pos) FILTER (fault IS NOT NULL) AS fault FROM assessed GROUP BY doc_id, candidate_id) SELECT f.doc_id, f.candidate_id, coalesce(fault, CASE WHEN length(value) = 1 THEN 'invented_span' END, 'reconciler_rejected') AS code FROM facts f LEFT JOIN x USING (candidate_id) WHERE coalesce(sound, 0) = 0 OR fault IS NOT NULL",
        "conflict_complaints": group + ", kept AS (SELECT DISTINCT f.doc_id, f.candidate_id, f.category, f.field, f.key FROM facts f JOIN m USING (candidate_id)) SELECT f.doc_id, f.candidate_id, string_agg(k.candidate_id, ',' ORDER BY k.candidate_id) AS kept_ids FROM facts f JOIN kept k ON k.doc_id = f.doc_id AND k.category = f.category AND k.field = f.field AND k.key <> f.key WHERE f.candidate_id NOT IN (SELECT candidate_id FROM m) GROUP BY f.doc_id, f.candidate_id",
        "confidence_buckets": w + " SELECT ord::INT AS ord, bucket, least::DOUBLE AS least, top::DOUBLE AS top, count(candidate_id) AS n FROM (VALUES (0, 'high', 0.9, 1.0, 9.0), (1, 'medium', 0.7, 0.9, 0.9), (2, 'low', 0.0, 0.7, 0.7)) AS b(ord, bucket, least, top, lim) LEFT JOIN facts ON confidence >= least AND confidence < lim GROUP BY ALL",
        "match_labels": match + " SELECT * FROM met",
        "score_overall": score + " SELECT scope, fixture, category, field, expected, actual, hits, exact, violations, precision, recall, provenance_recall, f1 FROM sc",
        "score_by_field": score + " SELECT scope, category, field, expected, actual, hits, exact, violations, precision, recall, provenance_recall, f1 FROM sc WHERE scope <> 'fixture'",
        "threshold_failures": score + f""", th AS ({few}), long AS (UNPIVOT (SELECT scope, category, field, precision::DOUBLE AS precision, recall::DOUBLE AS recall, f1::DOUBLE AS f1, provenance_recall::DOUBLE AS provenance_recall FROM sc WHERE scope <> 'fixture') ON precision, recall, f1, provenance_recall INTO NAME metric VALUE actual),
          j AS (SELECT th.*, coalesce(actual, CASE WHEN th.metric IN ('recall', 'provenance_recall') THEN 1.0 ELSE 0.0 END)::DOUBLE AS actual FROM th LEFT JOIN long l ON l.scope = th.scope AND l.metric = th.metric AND l.category IS NOT DISTINCT FROM th.category AND l.field IS NOT DISTINCT FROM th.field)
          SELECT scope, category, field, metric, actual, threshold, 'min' AS comparator FROM j WHERE actual < threshold""",
        "calibration_bins": bins + " SELECT * FROM bins_",
        "calibration_error": bins + " SELECT sum(n)::BIGINT AS n, round(sum(n * coalesce(gap, 0.0)) / sum(n), 6) AS ece FROM bins_",
        "triage_missing": match + f""", ft AS (SELECT doc_id, {_folded('category')} AS kc, {_folded('field')} AS kf, {_folded('value')} AS kv, (ordinal + doc_id) % 7 + 1 AS rank FROM facts), by_ AS (SELECT doc_id, kc, kf, kv, min(rank) AS rank, count(*) AS n FROM ft GROUP BY ALL),
          near_ AS (SELECT doc_id, kc, kf, sum(n) AS near FROM by_ GROUP BY ALL), gone AS (SELECT l.* FROM l JOIN met USING (expected_id) WHERE status = 'missing')
          SELECT expected_id, coalesce([{triage}][rank], 'no_candidate') AS bucket, (CASE WHEN rank IS NULL THEN coalesce(near, 0) ELSE 0 END)::BIGINT AS near FROM gone LEFT JOIN by_ USING (doc_id, kc, kf, kv) LEFT JOIN near_ USING (doc_id, kc, kf)""",
        "span_shapes": match + " SELECT met.expected_id, data_point_id AS candidate_id, CASE WHEN f.start_char >= l.start_char AND f.end_char <= l.end_char THEN 'narrower' WHEN f.start_char <= l.start_char AND f.end_char >= l.end_char THEN 'wider' WHEN f.end_char <= l.start_char OR f.start_char >= l.end_char THEN 'disjoint' ELSE 'shifted' END AS shape FROM met JOIN l USING (expected_id) JOIN f ON f.candidate_id = data_point_id WHERE status = 'matched'",
        "run_diff": diff + f" SELECT *, ({order})::INT AS ord FROM df",
        "diff_summary": diff + f" SELECT ord, k.kind, count(df.kind) AS n FROM ({kinds}) k LEFT JOIN df ON df.kind = k.kind GROUP BY ord, k.kind",
        "integrity_chain": "WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, sha256(event_id || '|' || event_type) AS h FROM events), c AS (SELECT user_id, i, sha256(repeat('0', 64) || h) AS x FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, sha256(c.x || e.h) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1) SELECT user_id, max(i) AS n_events, arg_max(x, i) AS chain_hash FROM c GROUP BY user_id",
        "reconcile_batches": f"""WITH r AS (SELECT doc_id, replace(replace(list_extract([{", ".join(f"'{_q(x)}'" for x in S.REPLIES)}], (doc_id % {len(S.REPLIES)} + 1)::INT), 'I', 'c' || doc_id), 'J', 'd' || doc_id) AS p FROM documents),
          a AS (SELECT doc_id, CASE WHEN json_valid(p) THEN p::JSON END AS v FROM r),
          b AS (SELECT doc_id, CASE WHEN json_type(v) <> 'VARCHAR' THEN v WHEN json_valid(v->>'$') THEN (v->>'$')::JSON END AS v FROM a),
          c AS (SELECT doc_id, v, v->'groups' AS g, v->'rejected' AS x FROM b),
          d AS (SELECT doc_id, v, {", ".join(f"CASE json_type({k}) WHEN 'ARRAY' THEN {k} WHEN 'VARCHAR' THEN CASE WHEN json_valid({k}->>'$') AND json_type(({k}->>'$')::JSON) = 'ARRAY' THEN ({k}->>'$')::JSON END END AS {k}" for k in "gx")} FROM c),
          gs AS (SELECT doc_id, pos, CASE WHEN json_type(e) = 'ARRAY' AND json_array_length(e) = 2 AND json_type(e, '$[0]') = 'VARCHAR' THEN e->>'$[0]' END AS id,
            CASE WHEN json_type(e) = 'ARRAY' AND json_array_length(e) = 2 THEN CASE json_type(e, '$[1]') WHEN 'VARCHAR' THEN [e->>'$[1]'] WHEN 'ARRAY' THEN list_transform((e->'$[1]')::JSON[], lambda m: CASE WHEN json_type(m) = 'VARCHAR' THEN m->>'$' END) END END AS ms
            FROM (SELECT doc_id, unnest(g::JSON[]) AS e, generate_subscripts(g::JSON[], 1) AS pos FROM d)),
          xs AS (SELECT doc_id, CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' WHEN 'ARRAY' THEN CASE WHEN json_array_length(e) IN (1, 2) AND json_type(e, '$[0]') = 'VARCHAR' THEN e->>'$[0]' END END AS id,
            CASE WHEN json_type(e) = 'ARRAY' AND json_array_length(e) = 2 THEN e->>'$[1]' ELSE 'reconciler_rejected' END AS code FROM (SELECT doc_id, unnest(x::JSON[]) AS e FROM d)),
          gf AS (SELECT doc_id, bool_or(coalesce(id, '') = '' OR ms IS NULL OR len(list_filter(ms, lambda m: coalesce(m, '') = '')) > 0) AS bad, bool_or(NOT coalesce(list_contains(ms, id), false)) AS apart, bool_or(len(list_distinct(ms)) < len(ms)) AS twice FROM gs GROUP BY doc_id),
          xf AS (SELECT doc_id, bool_or(coalesce(id, '') = '') AS bad, bool_or(code NOT IN ({", ".join(f"'{x}'" for x in P.CODES)})) AS strange, count(DISTINCT id) < count(id) AS twice FROM xs GROUP BY doc_id),
          f AS (SELECT doc_id, CASE WHEN v IS NULL THEN 'not_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' WHEN len(list_filter(json_keys(v), lambda k: k NOT IN ('groups', 'rejected'))) > 0 THEN 'unknown_key'
            WHEN g IS NULL THEN 'groups_not_list' WHEN x IS NULL THEN 'rejected_not_list' WHEN gf.bad THEN 'bad_group' WHEN xf.bad THEN 'bad_rejection' WHEN xf.strange THEN 'unknown_code'
            WHEN gf.apart THEN 'source_not_member' WHEN gf.twice THEN 'members_repeated' WHEN xf.twice THEN 'rejected_repeated' END AS error FROM d LEFT JOIN gf USING (doc_id) LEFT JOIN xf USING (doc_id))
          SELECT doc_id, 'error' AS kind, 0::BIGINT AS pos, NULL::VARCHAR AS id, error AS detail FROM f WHERE error IS NOT NULL
          UNION ALL SELECT doc_id, 'group', pos, id, array_to_string(ms, ',') FROM gs JOIN f USING (doc_id) WHERE error IS NULL
          UNION ALL SELECT doc_id, 'rejected', 0, id, code FROM xs JOIN f USING (doc_id) WHERE error IS NULL""",
        "chain_breaks": f"""WITH RECURSIVE {CHAIN}, own AS (SELECT *, coalesce(seq >= 0, false) AS placed FROM x),
          seen AS (SELECT user_id, seq, count(*) AS n, list(chain_hash) AS hs FROM own WHERE placed GROUP BY ALL),
          j AS (SELECT o.*, coalesce(a.n, 0) AS alike, coalesce(b.n, 0) AS before, coalesce(list_contains(b.hs, o.previous_hash), false) AS met FROM own o LEFT JOIN seen a ON a.user_id = o.user_id AND a.seq = o.seq LEFT JOIN seen b ON b.user_id = o.user_id AND b.seq = o.seq - 1),
          c AS (SELECT user_id, seq, chain_hash, concat_ws(',', CASE WHEN sha256(payload) <> payload_hash THEN 'payload_changed' END, CASE WHEN sha256(previous_hash || payload_hash) <> chain_hash THEN 'hash_wrong' END,
            CASE WHEN alike > 1 THEN 'repeated' END, CASE WHEN placed AND seq > 0 AND before = 0 THEN 'missing_before' END,
            CASE WHEN placed AND (CASE WHEN seq = 0 THEN previous_hash <> repeat('0', 64) ELSE before > 0 AND NOT met END) THEN 'link_broken' END, CASE WHEN NOT placed THEN 'unplaced' END) AS codes FROM j)
          SELECT * FROM c WHERE codes <> ''""",
        "chain_digests": f"WITH RECURSIVE {CHAIN} SELECT user_id, (seq // 16)::BIGINT AS stretch, count(*) AS n, sha256(string_agg(seq || ':' || payload_hash || ':' || chain_hash, ',' ORDER BY seq, payload_hash, chain_hash)) AS digest FROM x WHERE seq >= 0 GROUP BY 1, 2",
        "retry_outcomes": _rounds_sql(w) + """, n AS (SELECT candidate_id, count(*) AS n_replies FROM reply GROUP BY 1), q AS (SELECT candidate_id, count(*) AS n FROM again GROUP BY 1)
          SELECT a.candidate_id, CASE WHEN g."at" IS NULL THEN 'failed' ELSE 'settled' END AS status, g.attempt::BIGINT AS attempt, g.decision, g.code, 1 + coalesce(q.n, 0) AS n_asked, coalesce(g."at", o.e) AS closed_at, CASE WHEN g."at" IS NULL THEN o.why END AS fault, coalesce(n_replies, 0) AS n_replies
          FROM ask a JOIN over_ o USING (candidate_id) LEFT JOIN good g USING (candidate_id) LEFT JOIN n USING (candidate_id) LEFT JOIN q USING (candidate_id)
          UNION ALL SELECT candidate_id, 'unknown_id', NULL, NULL, NULL, NULL, NULL, NULL, n_replies FROM n WHERE candidate_id NOT IN (SELECT candidate_id FROM ask)""",
        "retry_requests": _rounds_sql(w) + " SELECT * FROM again",
        "chain_divergence": f"""WITH RECURSIVE {CHAIN}, u AS (SELECT user_id, seq, payload_hash, chain_hash, 1 AS side FROM stored UNION ALL SELECT user_id, seq, payload_hash, chain_hash, -1 FROM x WHERE seq >= 0),
          g AS (SELECT user_id, seq, sum(side) AS more FROM u GROUP BY user_id, seq, payload_hash, chain_hash HAVING sum(side) <> 0)
          SELECT user_id, min(seq) AS first_seq, sum(greatest(more, 0))::BIGINT AS n_only, sum(greatest(-more, 0))::BIGINT AS n_replica_only FROM g GROUP BY user_id""",
        "stage_completeness": dd + ", k AS (SELECT candidate_id FROM dd WHERE candidate_id <> primary_id OR lens <> 'number') SELECT doc_id, count(*) AS expected, count(k.candidate_id) AS accounted, CASE WHEN count(k.candidate_id) = 0 THEN 'pending' WHEN count(k.candidate_id) = count(*) THEN 'complete' ELSE 'partial' END AS state FROM facts f LEFT JOIN k USING (candidate_id) GROUP BY doc_id",
        "mutation_sensitivity": f"""WITH b AS (SELECT item_id, {_folded(TEXT)} AS t FROM benchmark), n AS (SELECT item_id, t, left(t, 1) || 'x' || substr(t, 2) AS x FROM b WHERE t <> ''), d AS (SELECT {_folded(TEXT)} AS t FROM documents),
          k AS (SELECT item_id, count(*) FILTER (contains(d.t, n.t)) AS kept_in, count(*) FILTER (contains(d.t, n.x)) AS changed_in FROM n, d GROUP BY item_id) SELECT *, (kept_in = 0 AND changed_in > 0)::INT::DOUBLE AS sensitivity FROM k""",
        "mutation_failures": mut + " SELECT * FROM fails",
        "mutation_suite": mut + ", s AS (SELECT mutation_id, count(*) AS n, coalesce(any_value(bad), 0) AS bad FROM ch LEFT JOIN (SELECT mutation_id, count(DISTINCT expected_id) AS bad FROM fails GROUP BY 1) USING (mutation_id) GROUP BY 1) SELECT count(*) AS mutations, round(avg(round((n - bad) / n, 6)), 6) AS sensitivity, round(avg(round((n - bad) / n, 6)), 6) >= 1 AS passed FROM s",
        "usage_by_stage": "WITH k AS (SELECT CASE event_type WHEN 'click' THEN 'critic' WHEN 'view' THEN 'verifier' ELSE event_type END AS stage, floor(coalesce(value, 0))::BIGINT AS a, event_id % 97 AS b, event_id % 5 AS c, event_id % 3 AS d FROM events) SELECT stage, count(*) AS calls, sum(a)::BIGINT AS input_tokens, sum(b)::BIGINT AS output_tokens, sum(c)::BIGINT AS cache_read_tokens, sum(d)::BIGINT AS cache_creation_tokens FROM k GROUP BY stage",
        "schema_fit": f"""WITH s(schema_id, k, hs) AS (VALUES {schemas}), d AS (SELECT doc_id, CASE WHEN lang IS NULL OR lang = 'es' THEN 'unknown_document' ELSE lang END AS k, [source, 'any'] AS given, CASE WHEN doc_id % 10 = 3 THEN 0.5 ELSE 0.9 END AS sure FROM documents),
          g AS (SELECT doc_id, d.k, sure, count(schema_id) AS candidates, min(schema_id) AS one FROM d LEFT JOIN s ON s.k = d.k AND len(list_filter(hs, lambda h: NOT list_contains(given, h))) = 0 GROUP BY ALL), f AS (SELECT *, CASE WHEN sure >= 0.8 THEN candidates ELSE 0 END AS fits FROM g)
          SELECT doc_id, CASE WHEN fits = 1 THEN 'reuse' ELSE 'refuse' END AS decision, CASE WHEN fits = 1 THEN one END AS schema_id, candidates, CASE WHEN fits = 1 THEN NULL WHEN candidates = 0 AND k = 'unknown_document' THEN 'document_out_of_scope' WHEN candidates = 0 THEN 'no_approved_schema_candidates' WHEN fits > 1 THEN 'ambiguous_schema_candidates' ELSE 'coverage_below_threshold' END AS code FROM f""",
        "run_status": """WITH e AS (SELECT user_id AS run_id, ts, event_id, ['created', 'running', 'completed', 'failed', 'refused'][(event_id * 7) % 5 + 1] AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY run_id ORDER BY ts, event_id) AS prev FROM e)
          SELECT run_id, arg_max(status, {'t': ts, 'e': event_id}) AS status, arg_max(event_id, {'t': ts, 'e': event_id}) AS last_event, count(*) AS n_events, count(*) FILTER (NOT coalesce(CASE WHEN prev IS NULL THEN status = 'created' WHEN prev = 'created' THEN status IN ('running', 'failed') WHEN prev = 'running' THEN status IN ('completed', 'failed', 'refused') WHEN prev = 'failed' THEN status = 'running' ELSE false END, false)) AS illegal FROM l GROUP BY run_id""",
    }
    made["acceptance_checks"] = f"""WITH u AS ({made['usage_by_stage']}), t AS (SELECT coalesce(sum(calls) FILTER (stage = 'critic'), 0)::BIGINT AS c, coalesce(sum(calls) FILTER (stage = 'verifier'), 0)::BIGINT AS v, coalesce(sum(cache_read_tokens) FILTER (stage = 'critic'), 0)::BIGINT AS cc, coalesce(sum(cache_read_tokens) FILTER (stage = 'verifier'), 0)::BIGINT AS vc FROM u)
      SELECT 'critic_batches_le_6' AS "check", c <= 6 AS passed, c AS actual, 6::BIGINT AS "limit" FROM t UNION ALL SELECT 'verifier_batches_le_5', v <= 5, v, 5 FROM t UNION ALL SELECT 'critic_cache_read_tokens_nonzero', cc > 0, cc, NULL FROM t UNION ALL SELECT 'verifier_cache_read_tokens_nonzero', vc > 0, vc, NULL FROM t"""
    p = made["page_join"]
    made["page_segments"] = f"""WITH p AS ({p}) SELECT doc_id, 'unmapped:page:' || page_number AS segment_id, 'unmapped' AS kind, start_char, end_char, start_byte, end_byte FROM p WHERE end_char > start_char
      UNION ALL SELECT doc_id, 'generated:page-separator:' || (page_number - 1) || ':' || page_number, 'generated', start_char - 2, start_char, start_byte - 2, start_byte FROM p WHERE page_number > 1"""
    made["boundary_contiguity"] = f"WITH s AS ({made['page_segments']}) SELECT doc_id, true AS contiguous, sum(end_char - start_char)::BIGINT AS covered FROM s GROUP BY doc_id"
    return made
