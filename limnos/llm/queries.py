"""Registered queries of the operators, and the SQL that states their results."""

from __future__ import annotations

from ..sources.tables import table


def op1_token_blocks(spark, sf):
    from .token_blocks import token_blocks
    return token_blocks(table(spark, sf, "documents").select("doc_id", "text"))


def op2_jaccard(spark, sf):
    from .jaccard_join import jaccard_components
    return jaccard_components(table(spark, sf, "documents").select("doc_id", "text"))


def op3_url_rules(spark, sf):
    from .url_rules import judge
    return judge(table(spark, sf, "pages"))


def op4_suffix_match(spark, sf):
    from .suffix_match import affected
    return affected(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")).drop("longest")


def op5_bpe(spark, sf):
    from .bpe import encode_decode
    return encode_decode(table(spark, sf, "documents").select("doc_id", "text"))


def op6_posting_lists(spark, sf):
    from .posting_lists import nearest
    return nearest(table(spark, sf, "embeddings"))


def op7_edit_counts(spark, sf):
    from .edit_counts import count_edited, revisions, trees
    from .store import Stage
    stored = Stage(spark, "edit-counts").keep(trees(table(spark, sf, "documents")), "trees")
    return count_edited(revisions(stored)).drop("leaf_chars", "leaf_tokens", "text_crc32")


def op8_secrets(spark, sf):
    from .secret_scan import scan
    return scan(table(spark, sf, "documents")).drop("found")


def op9_lattice(spark, sf):
    from .lattice import score_texts
    return score_texts(table(spark, sf, "documents").select("doc_id", "text"))


def op10_quality(spark, sf):
    from .quality import classify
    return classify(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


def op11_divergence(spark, sf):
    from .divergence import audit
    return audit(table(spark, sf, "documents"))


def op12_simhash(spark, sf):
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


def op13_merkle(spark, sf):
    from .merkle import newline_audit
    return newline_audit(table(spark, sf, "documents"))


Q = {f.__name__: f for f in (op1_token_blocks, op2_jaccard, op3_url_rules, op4_suffix_match, op5_bpe, op6_posting_lists, op7_edit_counts, op8_secrets, op9_lattice, op10_quality, op11_divergence, op12_simhash, op13_merkle)}
#: The pages of the given tables have no redirect or canonical link, so a page without a rule is allowed.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
#: crc32 of the decimal doc_id, byte by byte and bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::UBIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, z: xor(c >> 1, (c & 1::UBIGINT) * 3988292384::UBIGINT)))"""
SQL = {
    "op4_suffix_match": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        sized AS (SELECT item_id, w, least(10, len(w)) AS size FROM i WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS words
                    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS k FROM sized)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS words
                   FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, sizes WHERE len(w) >= size)),
        hits AS (SELECT doc_id, size, p, item_id FROM places JOIN windows USING (size, words)),
        covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        o AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
        full_c AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        totals AS (SELECT lang, source, sum(n) AS total FROM full_c GROUP BY lang, source),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p FROM full_c JOIN totals USING (lang, source) JOIN v USING (lang)),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (any_value(t) + 2 * any_value(v))::HUGEINT AS q
              FROM full_c JOIN (SELECT lang, sum(total) AS t FROM totals GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
                  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank
                   FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op13_merkle": f"""
        WITH RECURSIVE leaves AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
                CASE WHEN text IS NOT NULL AND xor({_CRC}, 4294967295::UBIGINT) % 2 = 0
                     THEN {_LEAF.format("strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')")} END AS changed FROM documents),
        placed AS (SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
                row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM leaves),
        nodes AS (SELECT 0 AS level, tree, n, k, leaf AS d FROM placed
            UNION ALL SELECT level + 1, tree, (n + 2) // 3, k // 3, sha256(string_agg(d, '' ORDER BY k)) FROM nodes WHERE n > 1 GROUP BY level, tree, n, k // 3),
        subroots AS (SELECT tree, max(level) AS depth, arg_max(d, level) AS subroot FROM nodes WHERE n = 1 GROUP BY tree),
        upper AS (SELECT 0 AS level, (SELECT count(*) FROM subroots) AS n, tree AS k, subroot AS d FROM subroots
            UNION ALL SELECT level + 1, (n + 2) // 3, k // 3, sha256(string_agg(d, '' ORDER BY k)) FROM upper WHERE n > 1 GROUP BY level, n, k // 3),
        sides AS (SELECT tree, level, k, n,
                coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, n, k // 3 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, n, k // 3 ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
                FROM (SELECT * FROM nodes UNION ALL SELECT level, -1, n, k, d FROM upper) WHERE n > 1),
        climbs AS (SELECT doc_id, leaf, subroot, depth, p.tree, k, coalesce(changed, leaf) AS d, '' AS proof, 0 AS level FROM placed p JOIN subroots USING (tree)
            UNION ALL SELECT doc_id, leaf, subroot, depth, c.tree, CASE WHEN c.level + 1 = depth THEN c.tree ELSE c.k // 3 END, sha256(l || d || r), proof || l || r, c.level + 1
            FROM climbs c JOIN sides s ON s.tree = c.tree AND s.level = c.level AND s.k = c.k WHERE c.level < depth),
        tops AS (SELECT doc_id, leaf, subroot, tree AS k, d, proof, 0 AS level FROM climbs WHERE level = depth
            UNION ALL SELECT doc_id, leaf, subroot, t.k // 3, sha256(l || d || r), proof || l || r, t.level + 1
            FROM tops t JOIN sides s ON s.tree = -1 AND s.level = t.level AND s.k = t.k),
        root AS (SELECT d AS root FROM upper WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified
        FROM tops, root WHERE tops.level = (SELECT max(level) FROM upper)""",
    "op3_url_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        p AS (SELECT page_id,
                     translate(regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(url, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's') AS path FROM u),
        r(h, q, rule, decision) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
            ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
        f AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(decision, length(rule)) AS decision
              FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id, host, path)
        SELECT page_id, host, path, rule, coalesce(decision, 'allow') AS verdict FROM f""",
}
