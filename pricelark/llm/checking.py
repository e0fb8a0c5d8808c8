"""DuckDB SQL that says again what the queries return."""

from __future__ import annotations

from pricelark.llm import decontaminate, license_rules, license_scan, quality_rules

SQL: dict[str, str] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality_rules() -> str:
    """Windows are unnested and counted; the rounds of the estimate are written out one by one."""
    rules = list(quality_rules.RULES)
    votes = ",\n".join(
        f"CASE WHEN {bad} THEN -1" + (f" WHEN {good} THEN 1" if good else "") + f" ELSE 0 END AS v_{r}"
        for r, (good, bad) in quality_rules.RULES.items()
    )
    start = quality_rules.START_ACCURACY
    low, high = quality_rules.BOUNDS
    odds = " + ".join(["ln(g / (1 - g))", *[f"v_{r} * ln(a_{r} / (1 - a_{r}))" for r in rules]])
    parts = [
        f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {WORDS} AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
          FROM documents)""",
        "p AS (SELECT k, i, w[i:i + 4] AS x FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d))",
        "c AS (SELECT k, x, count(*) AS n, min(i) AS i1, list(i) AS places FROM p GROUP BY k, x)",
        "u AS (SELECT k, count(*) AS n_distinct FROM c GROUP BY k)",
        """r AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, unnest(places) AS i FROM c WHERE n > 1),
            (SELECT unnest(range(0, 5)) AS j) GROUP BY k)""",
        """b AS (SELECT d.k, doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
            length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclaim,
            length(regexp_replace(t, '[^\\p{Lu}]+', '', 'g')) AS n_upper,
            len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
            greatest(len(w) - 4, 0) AS n_windows, coalesce(n_distinct, 0) AS n_distinct,
            CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
          FROM d LEFT JOIN u USING (k) LEFT JOIN r USING (k))""",
        f"""v AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            {votes} FROM b)""",
        f"""q AS MATERIALIZED (SELECT {", ".join(f"v_{r}" for r in rules)}, count(*) AS n FROM v
            WHERE NOT base_failed GROUP BY ALL)""",
        f"""m0 AS (SELECT CAST({quality_rules.START_GOOD} AS DOUBLE) AS g,
            {", ".join(f"CAST({start} AS DOUBLE) AS a_{r}" for r in rules)})""",
    ]
    for i in range(quality_rules.ROUNDS):
        new = ", ".join(
            f"""CASE WHEN count(nullif(v_{r}, 0)) = 0 THEN any_value(a_{r}) ELSE least(greatest(
            sum(CASE WHEN v_{r} > 0 THEN n * p WHEN v_{r} < 0 THEN n * (1 - p) END)
            / sum(CASE WHEN v_{r} <> 0 THEN n END), {low}), {high}) END AS a_{r}"""
            for r in rules
        )
        parts.append(
            f"""m{i + 1} AS MATERIALIZED (SELECT least(greatest(sum(n * p) / sum(n), 0.05), 0.95) AS g, {new}
            FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM q, m{i}))"""
        )
    score = f"round(1 / (1 + exp(-({odds}))), 6)"
    return (
        ",\n".join(parts)
        + f"""
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT base_failed AND {score} >= 0.5 AS kept, {score} AS p_good
        FROM v, m{quality_rules.ROUNDS}"""
    )


SQL["op2_quality_rules"] = _quality_rules()

SQL["op5_pareto_mixing"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5(concat_ws('|', 'mix', doc_id, coalesce(text, ''))), 1, 12)) AS BIGINT) + 0.5::DOUBLE)
      / 281474976710656::DOUBLE AS u
  FROM documents),
c AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE length(bin(size)) * 8
        + list_position(['100', '101', '110', '111'], rpad(substr(bin(size), 1, 3), 3, '0')) + 3 END AS class FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
        CAST(2 * source_size AS DOUBLE) AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW f AS (ORDER BY cap / weight, source NULLS LAST)),
m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT l.source, source_size, coalesce(least(cap, m.level * weight), cap) AS target FROM l LEFT JOIN m ON TRUE),
g AS (SELECT source, class, count(*) AS n, CAST(sum(size) AS BIGINT) AS x FROM c GROUP BY ALL),
r AS (SELECT g.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
        sum(n) OVER (PARTITION BY g.source ORDER BY class DESC ROWS UNBOUNDED PRECEDING) AS seen
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(ratio) AS certain, floor((ratio - floor(ratio)) * seen::DOUBLE + 0.5::DOUBLE)
        - floor((ratio - floor(ratio)) * (seen - n)::DOUBLE + 0.5::DOUBLE) AS more FROM r),
p AS (SELECT c.*, n, source_size, target, certain, more,
        least(0.999999::DOUBLE, more * x::DOUBLE / (n::DOUBLE * n::DOUBLE * size)) AS pi
      FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source AND c.class = q.class),
o AS (SELECT *, CASE WHEN size > 0 THEN row_number() OVER (PARTITION BY source, class ORDER BY
        CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END, doc_id, size) END AS nth FROM p)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE certain + CASE WHEN nth <= more THEN 1 ELSE 0 END END AS BIGINT) * size AS taken,
  CAST(CASE WHEN size = 0 THEN 0 ELSE certain + CASE WHEN nth <= more THEN 1 ELSE 0 END END AS INTEGER) AS copies
FROM o"""

SQL["op3_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT k, doc_id, i, regexp_extract_all(l[i], '[^\x20\x09-\x0D]+') AS w
      FROM (SELECT k, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
f AS (SELECT * FROM e WHERE len(w) > 0),
u AS MATERIALIZED (SELECT w, len(w) AS n, min((doc_id, i)) AS p FROM f GROUP BY w),
c AS (SELECT b.w FROM u AS a JOIN u AS b ON a.n = b.n AND a.p < b.p AND a.n >= 8
      WHERE len(list_filter(list_zip(a.w, b.w), lambda z: z[1] <> z[2])) = 1
      UNION
      SELECT CASE WHEN s.p < t.p THEN t.w ELSE s.w END FROM u AS s JOIN u AS t ON t.n = s.n + 1 AND s.n >= 8
      WHERE (s.w[1] = t.w[1] OR s.w[s.n] = t.w[t.n])
        AND len(list_filter(range(1, t.n + 1), lambda i: t.w[1:i - 1] || t.w[i + 1:] = s.w)) > 0),
g AS (SELECT f.k, u.p < (f.doc_id, f.i) AS exact, c.w IS NOT NULL AS near
      FROM f JOIN u ON f.w = u.w LEFT JOIN c ON c.w = f.w)
SELECT doc_id, count(exact) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
  count(*) FILTER (NOT near AND NOT exact) AS n_kept
FROM d LEFT JOIN g USING (k) GROUP BY k, doc_id"""


def _decontaminate() -> str:
    """Windows of template tokens of documents and items, joined as lists."""
    number, unit, name = decontaminate.NUMBER, decontaminate.UNIT, decontaminate.NAME
    t = "coalesce(text, '')"
    for pattern, into, _ in decontaminate.STEPS:
        into = into.replace("$1", r"\1").replace("$2", r"\2").replace("$3", r"\3")
        t = f"regexp_replace({t}, '{pattern}', '{into}', 'g')"
    tokens = f"list_filter(string_split_regex(lower({t}), '(?:{decontaminate.BREAK})+'), lambda x: x <> '')"
    size = decontaminate.WINDOW
    slot = f"x[1] IN ('{number}', '{unit}', '{name}')"

    def windows(table: str, key: str) -> str:
        return f"""
        (SELECT {key}, i, v[i + 1:i + {size}] AS win, list_filter(w[i + 1:i + {size}], lambda x: {slot}) AS slots FROM (
          SELECT {key}, w, list_transform(w, lambda x: CASE WHEN {slot} THEN x[1] ELSE x END) AS v, unnest(range(0, len(w) - {size - 1})) AS i FROM (
            SELECT {key}, CASE WHEN len(w) BETWEEN 1 AND {size - 1} THEN list_resize(w, {size}, '') ELSE w END AS w FROM (
              SELECT {key}, {tokens} AS w FROM {table}))))"""

    literal = size - decontaminate.LITERAL
    return f"""
    WITH d AS (SELECT * FROM {windows("documents", "doc_id")} WHERE len(slots) <= {literal}),
    b AS (SELECT *, count(DISTINCT win) OVER (PARTITION BY item_id) AS n_windows FROM {windows("benchmark", "item_id")}
          WHERE len(slots) <= {literal}),
    m AS (SELECT doc_id, item_id, n_windows, win, d.i AS place, list_zip(b.slots, d.slots) AS links FROM d JOIN b USING (win)),
    l AS (SELECT doc_id, item_id, count(DISTINCT x) AS n, count(DISTINCT x[1]) AS n1, count(DISTINCT x[2]) AS n2,
            bool_and(x[1] = x[2]) AS same FROM (SELECT doc_id, item_id, unnest(links) AS x FROM m) GROUP BY ALL),
    f AS (SELECT doc_id, item_id, count(DISTINCT win) AS n_matched, CAST(any_value(n_windows) AS BIGINT) AS n_windows,
            min(place) AS first_token FROM m GROUP BY ALL)
    SELECT f.doc_id, f.item_id, n_matched, n_windows, coalesce(same, TRUE) AS verbatim, first_token
    FROM f LEFT JOIN l ON f.doc_id = l.doc_id AND f.item_id = l.item_id
    WHERE n_matched >= {decontaminate.SHARE} * n_windows AND coalesce(n1 = n AND n2 = n, TRUE)"""


SQL["op1_decontaminate"] = _decontaminate()


def _license_scan() -> str:
    """Rules as a table; places from the pieces between the matches."""
    phrases = license_scan.PHRASES
    text = lambda x: "'" + str(x).replace("'", "''") + "'"
    table = ", ".join(
        f"({i}, {text(label)}, {p}, {text(k)}, {text(' ' + x.replace(' ', '  ') + ' ')})"
        for i, (label, p, k, x) in enumerate(license_rules.rules())
    )
    gate = " OR ".join(f"contains(t, {text(s)})" for s in license_rules.STEMS)
    there = {p: f"contains(t, ' {p} ')" for p in phrases}
    spaces = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    first = ", ".join(f"CASE WHEN {there[p]} THEN {spaces(f'''left(t, strpos(t, ' {p} '))''')} - 1 END" for p in phrases)
    last = ", ".join(
        f"""CASE WHEN {there[p]} THEN n_words - ({spaces(f"left(reverse(t), strpos(reverse(t), ' {p[::-1]} '))")} - 1)
        - {len(p.split())} END"""
        for p in phrases
    )
    places = " + ".join(
        f"(length(wide) - length(replace(wide, ' {p.replace(' ', '  ')} ', ''))) // {len(p.replace(' ', '  ')) + 2}" for p in phrases
    )
    found = ", ".join(f"CASE WHEN {there[p]} THEN '{label}' END" for p, label in phrases.items())
    sure = ", ".join(map(str, license_scan.CONFIDENCE))
    return rf"""
    WITH rules(id, label, priority, keyword, pattern) AS (VALUES {table}),
    n AS (SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(
            translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'),
            '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS one FROM documents),
    s AS (SELECT k, doc_id, ' ' || one || CASE WHEN one = '' THEN '' ELSE ' ' END AS t FROM n),
    d AS (SELECT *, CAST({spaces("t")} - 1 AS BIGINT) AS n_words, substr(replace(t, ' ', '  '), 2, length(replace(t, ' ', '  ')) - 2) AS wide
          FROM s),
    b AS (SELECT *, list_filter([{found}], lambda x: x IS NOT NULL) AS base, CAST({places} AS BIGINT) AS n_base,
            CAST(least({first}) AS BIGINT) AS first_word, CAST(greatest({last}) AS BIGINT) AS last_word FROM d),
    h AS (SELECT k, id, label, priority, regexp_extract_all(wide, pattern) AS hits, string_split_regex(wide, pattern) AS pieces
          FROM d JOIN rules ON contains(t, keyword) WHERE {gate}),
    c AS (SELECT k, id, label, priority, list_transform(hits, lambda x: {spaces("x")} // 2) AS hw,
            list_transform(pieces, lambda x: {spaces("x")} // 2) AS pw FROM h WHERE len(hits) > 0),
    p AS (SELECT k, id, label, priority, list_sum(pw[1:j]) + coalesce(list_sum(hw[1:j - 1]), 0) AS a, hw[j] AS n
          FROM (SELECT *, unnest(range(1, len(hw) + 1)) AS j FROM c)),
    kept AS (SELECT * FROM p AS x WHERE NOT EXISTS (SELECT 1 FROM p AS y WHERE y.k = x.k AND y.a <= x.a AND y.a + y.n >= x.a + x.n
          AND (y.priority > x.priority OR (y.priority = x.priority AND (y.n > x.n OR (y.n = x.n AND y.id < x.id)))))),
    own AS (SELECT k, list(DISTINCT label) AS labels, max(priority) AS top, count(*) AS n FROM kept GROUP BY k)
    SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(list_sort(base), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
      CAST(coalesce(greatest(CAST([{sure}][top + 1] AS DOUBLE), CASE WHEN len(base) > 0 THEN {license_scan.BASE_CONFIDENCE} END), 0) AS DOUBLE) AS score,
      CAST(coalesce(own.n, 0) AS BIGINT) AS n_detections
    FROM b LEFT JOIN own USING (k)"""


SQL["op4_license_scan"] = _license_scan()

SQL["op11_fill_in_middle"] = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
    h AS (SELECT *, CAST('0x' || s[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || s[9:16] AS BIGINT) % (n + 1) AS y,
      CAST('0x' || s[17:24] AS BIGINT) % 100 AS whole, CAST('0x' || s[25:32] AS BIGINT) % 100 AS turned FROM d),
    f AS (SELECT *, least(x, y) AS l, greatest(x, y) AS r, CASE WHEN n = 0 OR whole >= 90 OR contains(t, '<P>')
      OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN turned < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substring(t, 1, l) AS a, substring(t, l + 1, r - l) AS m, substring(t, r + 1, n - r) AS z FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN l END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN r - l END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m
        ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM p"""
