"""DuckDB equivalents of the operators that SQL can express."""

from __future__ import annotations

SQL = {
    "op4_mixing": """
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                   md5(coalesce(doc_id::VARCHAR, '')) AS k
            FROM documents),
        per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS rank FROM per),
        weighed AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM ranked),
        level AS (
            SELECT *, sum(source_size) OVER () AS total,
                   sum(cap) OVER (ORDER BY cap / weight, rank ROWS UNBOUNDED PRECEDING) - cap AS before_,
                   sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_
            FROM weighed),
        judged AS (SELECT *, cap * left_ <= weight * (total - before_) AS capped FROM level),
        rest AS (SELECT (total - before_)::DOUBLE AS words, left_ FROM judged WHERE NOT capped ORDER BY cap / weight, rank LIMIT 1),
        shares AS (
            SELECT source, source_size, weight,
                   CASE WHEN capped THEN cap::DOUBLE ELSE weight * (SELECT words FROM rest) / (SELECT left_ FROM rest)::DOUBLE END AS target
            FROM judged),
        placed AS (
            SELECT d.doc_id, d.size, s.source_size, s.target, s.weight, floor(s.target)::BIGINT AS demand,
                   (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start_
            FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
        cut AS (SELECT *, coalesce(demand // nullif(source_size, 0), 0)::BIGINT AS whole FROM placed),
        part AS (SELECT *, greatest(0, least(size, demand - whole * source_size - start_))::BIGINT AS piece FROM cut),
        curve AS (
            SELECT *, [-0.6, 0.0, 0.6][weight]::DOUBLE AS slope, start_::DOUBLE / nullif(demand, 0)::DOUBLE AS share,
                   whole * size + piece AS taken FROM part)
        SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
               CASE WHEN taken > 0 THEN whole + CASE WHEN piece > 0 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS passes,
               CASE WHEN taken > 0 THEN 2 * share / (1 - slope + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END AS position
        FROM curve
    """,
    "op9_benchmark_decontamination": """
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
            FROM benchmark WHERE item_id IS NOT NULL),
        needles AS (
            SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS win
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT n FROM needles),
        found AS (
            SELECT d.doc_id, d.i, s.n, array_to_string(d.ws[d.i : d.i + s.n - 1], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) d, sizes s
            WHERE d.i + s.n - 1 <= len(d.ws)),
        hits AS (SELECT f.doc_id, f.i, f.n, k.item_id FROM found f JOIN needles k USING (n, win)),
        covered AS (
            SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS line
            FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
               coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.line, '')) AS items_sha256,
               coalesce(c.n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
    """,
    "op11_phrase_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        spread AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
        windows AS (
            SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
        firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos
            FROM windows JOIN firsts USING (win) WHERE first_id < doc_id),
        kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS line, count(*) AS n
            FROM spread ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept.line, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op12_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
        grams AS (
            SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f
            FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k))
            GROUP BY ALL),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
        candidates AS (
            SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM grams WHERE k > 1 AND f >= 10),
        parts AS (
            SELECT c.*, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c),
        scored AS (
            SELECT c.lang, c.k, c.phrase, c.f AS a, c.cut, h.f AS l, t.f AS r,
                   ((1000000::HUGEINT * c.f * c.f) // (h.f::HUGEINT * t.f))::BIGINT AS score
            FROM parts c JOIN grams h ON h.lang = c.lang AND h.k = c.cut AND h.phrase = c.head
                         JOIN grams t ON t.lang = c.lang AND t.k = c.k - c.cut AND t.phrase = c.tail),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inside AS (
            SELECT lang, inner_, max(f) AS most
            FROM (SELECT lang, f, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS inner_ FROM candidates WHERE k = 3)
            GROUP BY ALL),
        kept AS (
            SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.inner_ = s.phrase AND s.k = 2
            WHERE i.most IS NULL OR 100 * i.most < 50 * s.a),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC)::BIGINT AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_lexical_search": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
            FROM documents),
        stats AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0),
        tf AS (
            SELECT doc_id, n, term, count(*)::BIGINT AS tf
            FROM (SELECT doc_id, len(ws)::BIGINT AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
        weights AS (
            SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM stats) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM tf GROUP BY term),
        q AS (
            SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term
            FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        scored AS (
            SELECT q.item_id, tf.doc_id,
                   sum(weights.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * stats.n_docs) // stats.n_terms))))::BIGINT AS score
            FROM q JOIN tf USING (term) JOIN weights USING (term), stats GROUP BY q.item_id, tf.doc_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
