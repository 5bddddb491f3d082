"""The queries of the corpus operators and their SQL.

SQL states what the operators compute by plain means (all pairs that share something, recursive
components). Codecs, tokenizers, trained models, seeded choices and xxHash draws can't be
written in it; tests hold those queries against brute force.
"""

from __future__ import annotations

from . import embeddings, licenses, lines, media, mixing, near_dups, packing, quality, sharding, toxicity

QUERIES = {
    "op1_hash_tree_shards": sharding.op1,
    "op2_license_scan": licenses.op2,
    "op3_line_dedup": lines.op3,
    "op4_source_mix": mixing.op4,
    "op5_telephony_audio": media.op5,
    "op6_lattice_near_dups": embeddings.op6,
    "op7_minhash_near_dups": near_dups.op7,
    "op8_toxicity": toxicity.op8,
    "op9_weak_quality": quality.op9,
    "op10_packing": packing.op10,
}

_LOWER = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
_SPLIT = r"'[^\x20\x09-\x0D]+'"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def license_sql(templates: dict[str, str] = licenses.TEMPLATES, threshold: float = licenses.CONTAINMENT) -> str:
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES.items())
    sets = licenses.template_words(templates)
    known = ", ".join(f"('{k}', {_list(v)}, {licenses.needed(len(v), threshold)}, {licenses.run_length(templates[k])})" for k, v in sets.items())
    return rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        p(words, label) AS (VALUES {phrases}), t(label, words, need, width) AS (VALUES {known}),
        spots AS (SELECT doc_id, label, i FROM d, p, range(0, len(w)) r(i) WHERE w[i + 1] = words[1] AND w[i + 1:i + len(words)] = words),
        b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spots GROUP BY 1),
        likely AS (SELECT doc_id, w, label, words, need, width FROM d, t WHERE len(list_intersect(list_distinct(w), words)) >= need),
        held AS (SELECT doc_id, label, len(words) AS n, need, max(len(list_intersect(list_distinct(w[i + 1:i + width]), words))) AS most
                 FROM likely, range(0, greatest(1, len(w) - width + 1)) r(i) GROUP BY ALL),
        found AS (SELECT doc_id, label, most / n AS share FROM held WHERE most >= need),
        every AS (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM spots),
        l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY 1),
        s AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


def line_sql(words: int = lines.LEAST_WORDS, chars: int = lines.LEAST_CHARS) -> str:
    return rf"""
        WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line, regexp_extract_all(string_split(coalesce(text, ''), chr(10))[i], {_SPLIT}) AS w
                   FROM documents, range(1, len(string_split(coalesce(text, ''), chr(10))) + 1) r(i)),
        k AS (SELECT doc_id, i, array_to_string(w, ' ') AS whole, len(w) >= {words} AS long,
                     CASE WHEN len(w) >= {words} THEN w ELSE string_split(array_to_string(w, ' '), '') END AS units FROM l WHERE len(w) > 0),
        f AS (SELECT *, row_number() OVER (PARTITION BY whole ORDER BY doc_id, i) > 1 AS copy FROM k),
        u AS (SELECT doc_id, i, whole, long, units FROM f WHERE NOT copy AND (long OR length(whole) >= {chars})),
        v AS (SELECT doc_id, i, long, j, array_to_string(units[1:j - 1] || ['?'] || units[j + 1:], chr(1)) AS put, array_to_string(units[1:j - 1] || units[j + 1:], chr(1)) AS cut
              FROM u, range(1, len(units) + 1) r(j)),
        m AS (SELECT doc_id, i, long, array_to_string(units, chr(1)) AS cut FROM u),
        near AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY long, j, put ORDER BY doc_id, i) AS place FROM v) WHERE place > 1
                 UNION SELECT m.doc_id, m.i FROM m JOIN v ON m.cut = v.cut AND m.long = v.long AND (v.doc_id, v.i) < (m.doc_id, m.i)
                 UNION SELECT v.doc_id, v.i FROM m JOIN v ON m.cut = v.cut AND m.long = v.long AND (m.doc_id, m.i) < (v.doc_id, v.i)),
        gone AS (SELECT doc_id, i FROM f WHERE copy UNION SELECT doc_id, i FROM near),
        kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) FILTER (len(w) > 0) AS n FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
        SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_lines_gone, coalesce(kept.n, 0)::BIGINT AS n_lines_kept, md5(coalesce(kept.text, '')) AS text_md5
        FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""


_COMPONENTS = """
        r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
        c AS (SELECT id, least(id, min(other)) AS component FROM r GROUP BY 1)"""

EMBEDDINGS = f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
        ok AS (SELECT * FROM v WHERE len(x) > 0 AND NOT list_contains(list_transform(x, lambda y: y IS NOT NULL AND isfinite(y)), false) AND list_contains(list_transform(x, lambda y: y <> 0), true)),
        e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= {embeddings.COSINE}),
        {_COMPONENTS},
        n AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id)::BIGINT AS component_id, coalesce(component, vec_id) = vec_id AS kept
        FROM v LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.id = vec_id"""

NEAR_DUPS = rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPLIT}) AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + {near_dups.SHINGLE}], ' ') AS s FROM d, range(0, greatest(1, len(w) - {near_dups.SHINGLE - 1})) r(i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {near_dups.DENOMINATOR} * common >= {near_dups.NUMERATOR} * (x.n + y.n - common)),
        {_COMPONENTS}
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op3_line_dedup": line_sql(),
    "op6_lattice_near_dups": EMBEDDINGS,
    "op7_minhash_near_dups": NEAR_DUPS,
}
