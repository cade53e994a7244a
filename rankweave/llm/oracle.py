"""SQL counterparts, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH split AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL
), listed AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split
), marked AS (
    SELECT *, regexp_matches(line, '[^\x20\x09-\x0D]') AS worded FROM listed
), numbered AS (
    SELECT *, sum(worded::INT) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS place FROM marked
), counted AS (
    SELECT doc_id, line, place::BIGINT AS place FROM numbered WHERE worded
), windows AS (
    SELECT a.doc_id, a.place, a.line AS l0, b.line AS l1, c.line AS l2
    FROM counted a JOIN counted b ON b.doc_id = a.doc_id AND b.place = a.place + 1
    JOIN counted c ON c.doc_id = a.doc_id AND c.place = a.place + 2
), placed AS (
    SELECT doc_id, place, first_value(doc_id) OVER w AS first_doc, first_value(place) OVER w AS first_at
    FROM windows WINDOW w AS (PARTITION BY l0, l1, l2 ORDER BY doc_id, place)
), covers AS (
    SELECT doc_id, CASE WHEN doc_id = first_doc THEN greatest(place, first_at + 3) ELSE place END AS from_line,
        place + 2 AS to_line
    FROM placed WHERE doc_id <> first_doc OR place <> first_at
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(from_line, to_line + 1)) AS place FROM covers
), kept AS (
    SELECT n.doc_id,
        string_agg(n.line, chr(10) ORDER BY n.pos) FILTER (WHERE g.place IS NULL) AS text,
        sum((n.worded AND g.place IS NOT NULL)::INT)::BIGINT AS n_removed, sum(n.worded::INT)::BIGINT AS n_lines
    FROM numbered n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.place = n.place GROUP BY n.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
    coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

SQL = {"op9_line_dedup": LINE_DEDUP}


def _secret_scan() -> str:
    """Matches and the texts between them give the places; RE2 finds the same matches as Java."""
    from rankweave.llm.secret_scan import BASE_RULES, RULES

    def re2(pattern: str) -> str:
        if not pattern.startswith("(?i)"):
            return pattern
        # Spelt out, since RE2 folds some other letters to k and s.
        head, tail = pattern[4:].split(")", 1)
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail

    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS rule, {quoted(r.kind)} AS kind, {r.least} AS least, "
        f"string_split_regex(text, {quoted(re2(r.pattern))}) AS gaps, "
        f"regexp_extract_all(text, {quoted(re2(r.pattern))}, 0) AS found, "
        f"regexp_extract_all(text, {quoted(re2(r.pattern))}, {r.group}) AS part "
        f"FROM documents WHERE regexp_matches(text, {quoted(re2(r.pattern))})"
        for n, r in enumerate(RULES)
    )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    base = ", ".join(f"'{r.kind}'" for r in BASE_RULES)
    outer = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH each AS ({each}), nth AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM each), placed AS (
    SELECT doc_id, rule, kind, length(part[i]) >= least AS keep, length(found[i]) AS long,
        sum(length(gaps[i]) + length(found[i])) OVER (PARTITION BY doc_id, rule ORDER BY i)::BIGINT AS stop
    FROM nth
), listed AS (
    SELECT doc_id, {counts},
        string_agg(kind || ':' || (stop - long) || ':' || stop, ',' ORDER BY stop - long, rule) AS spans,
        string_agg(kind || ':' || (stop - long) || ':' || stop, ',' ORDER BY stop - long, rule)
            FILTER (WHERE kind IN ({base})) AS base_spans
    FROM placed WHERE keep GROUP BY doc_id
)
SELECT doc_id, {outer}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""


def _license_scan() -> str:
    from rankweave.llm.license_texts import EQUIVALENT, LICENSE_TEXTS, notice_rows
    from rankweave.llm.licenses import COPYRIGHT_LINE

    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def digest(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted('(?m)' + COPYRIGHT_LINE)}, ' ', 'g')"
        out = f"' ' || regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for said, meant in EQUIVALENT:
            out = f"replace({out}, ' {said} ', ' {meant} ')"
        return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"

    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted(LICENSE_TEXTS.items()))
    notices = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in notice_rows())
    return f"""
WITH known AS (SELECT name, {digest('body')} AS digest FROM (VALUES {known}) v(name, body)),
notices AS (SELECT min(name) AS notice, {digest('body')} AS digest FROM (VALUES {notices}) v(name, body) GROUP BY 2),
said AS (
    SELECT doc_id, {digest('line')} AS digest
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
), noted AS (
    SELECT doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n
    FROM said JOIN notices USING (digest) GROUP BY doc_id
), whole AS (SELECT doc_id, {digest("coalesce(text, '')")} AS digest FROM documents)
SELECT doc_id, w.digest, name AS license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notice_lines
FROM whole w LEFT JOIN known k ON k.digest = w.digest LEFT JOIN noted USING (doc_id)
"""


SQL["op6_license_scan"] = _license_scan()
SQL["op2_secret_scan"] = _secret_scan()


def _walsh_clusters(rounds: int = 3, clusters: int = 16, scale: int = 64) -> str:
    """Three rounds written out: vectors and centroids as (row, component, value), joined on the component."""
    nearest = """
        SELECT row, cluster, distance FROM (
            SELECT x.row, c.cluster, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS distance
            FROM parts x JOIN centroids{n} c USING (component) GROUP BY 1, 2
        ) QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1"""
    steps = [f"""
centroids0 AS (
    SELECT cluster, component, x FROM parts JOIN (
        SELECT row, (row_number() OVER (ORDER BY sha256('{1}:' || vec_id)) - 1)::INT AS cluster FROM kept
        QUALIFY cluster < {clusters}
    ) USING (row)
)"""]
    for n in range(rounds):
        steps.append(f"near{n} AS ({nearest.format(n=n)})")
        steps.append(f"""
means{n} AS (
    SELECT cluster, component, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS m
    FROM parts JOIN near{n} USING (row) GROUP BY 1, 2
), centroids{n + 1} AS (
    SELECT cluster, component,
        CASE WHEN m IS NULL THEN c.x ELSE ((s - ((s % m) + m) % m) // m)::BIGINT END AS x
    FROM centroids{n} c LEFT JOIN means{n} USING (cluster, component)
)""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), parts AS (
    SELECT row, unnest(x) AS x, generate_subscripts(x, 1) AS component FROM kept
), {', '.join(steps)}, final AS ({nearest.format(n=rounds)}),
hashes AS (
    SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY component)) AS centroid_sha256
    FROM centroids{rounds} GROUP BY cluster
)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
    sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256
FROM final JOIN kept USING (row) JOIN hashes USING (cluster)
"""


SQL["op12_walsh_clusters"] = _walsh_clusters()

SQL["op13_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), met AS (
    SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM met GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM met SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), langs AS (
    SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS lang_n FROM kept GROUP BY 1
), groups AS (
    SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce(lang_n, 0) AS lang_n, coalesce(group_n, 0)::HUGEINT AS group_n
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)
    LEFT JOIN (SELECT lang, source, sum(n) AS group_n FROM counts GROUP BY 1, 2) USING (lang, source)
), shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + 1000000000 * (coalesce(c.n, 0) + 1) // (group_n + v) AS p, 1 + 1000000000 * (k.n + 1) // (lang_n + v) AS q
    FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
    row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 200
"""
