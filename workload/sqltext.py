"""Oracle SQL fragments shared by the corpus and retrieval queries."""

from __future__ import annotations

from lamina.constants import FRENCH_STOP_WORDS
from lamina.functions import stemming
from lamina.operators.embed import HASH_DIM

_STOP = ", ".join("'" + w + "'" for w in FRENCH_STOP_WORDS)


def stripped(column: str) -> str:
    """White space removed at both ends."""
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def words(column: str) -> str:
    return f"regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}_]+')"


def _ends(endings) -> str:
    """The longest of ``endings`` at the end of a word, as a pattern: the leftmost match is the longest."""
    return f"'(?:{'|'.join(endings)})$'"


def _of(*kinds: str) -> str:
    return ", ".join(f"'{e}'" for k in kinds for e in stemming.NOUN_ENDINGS[k])


def _cut(column: str, n: int) -> str:
    return f"substr({column}, 1, length({column}) - {n})"


def _either(column: str, ending: str, instead: str) -> str:
    """``ending``, known to be there, goes if it lies in R2 and is replaced if not."""
    n = len(ending)
    return f"CASE WHEN length({column}) - {n} >= r2 THEN {_cut(column, n)} ELSE {_cut(column, n)} || '{instead}' END"


def stemmed(words: str) -> str:
    """(word, stem) for a relation of different words, by the published rules written as patterns."""
    v = f"[{stemming.VOWELS}]"
    c = f"[^{stemming.VOWELS}]"
    rest = "substr({0}, rv + 1)"
    return f"""
    WITH marked AS (
      SELECT word, array_to_string(list_transform(regexp_extract_all(word, '{v}[ui]{v}|{v}y|ë|ï|y{v}|qu|.'), lambda t: CASE
        WHEN t = 'ë' THEN 'He' WHEN t = 'ï' THEN 'Hi' WHEN length(t) = 3 THEN t[1] || upper(t[2]) || t[3] WHEN t = 'qu' THEN 'qU'
        WHEN length(t) = 2 AND regexp_matches(t, '^{v}y$') THEN t[1] || 'Y' WHEN length(t) = 2 THEN 'Y' || t[2] ELSE t END), '') AS w
      FROM ({words})),
    first AS (
      SELECT *, CASE WHEN regexp_matches(w, '^(?:{v}{v}.|{'|'.join(stemming.BEGINNINGS)})') THEN 3
          WHEN regexp_matches(w, '^.{c}*{v}') THEN length(regexp_extract(w, '^.{c}*{v}')) ELSE length(w) END AS rv,
        CASE WHEN regexp_matches(w, '{v}{c}') THEN length(regexp_extract(w, '^{c}*{v}+{c}')) ELSE length(w) END AS r1 FROM marked),
    regions AS (
      SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{v}{c}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '^{c}*{v}+{c}')) ELSE length(w) END AS r2,
        regexp_extract(w, {_ends(stemming._NOUN)}) AS e FROM first),
    begun AS (SELECT *, length(w) - length(e) AS n, substr(w, 1, length(w) - length(e)) AS b FROM regions),
    nouns AS (
      SELECT *, CASE WHEN e = '' THEN w
        WHEN e IN ({_of('remove', 'agent', 'if', 'ité')}) THEN CASE WHEN n >= r2 THEN b ELSE w END
        WHEN e IN ({_of('log')}) THEN CASE WHEN n >= r2 THEN b || 'log' ELSE w END
        WHEN e IN ({_of('u')}) THEN CASE WHEN n >= r2 THEN b || 'u' ELSE w END
        WHEN e IN ({_of('ent')}) THEN CASE WHEN n >= r2 THEN b || 'ent' ELSE w END
        WHEN e = 'eaux' THEN b || 'eau'
        WHEN e = 'aux' THEN CASE WHEN n >= r1 THEN b || 'al' ELSE w END
        WHEN e IN ({_of('euse')}) THEN CASE WHEN n >= r2 THEN b WHEN n >= r1 THEN b || 'eux' ELSE w END
        WHEN e IN ({_of('issement')}) THEN CASE WHEN n >= r1 AND regexp_matches(b, '{c}$') THEN b ELSE w END
        WHEN e IN ({_of('ement')}) THEN CASE WHEN n >= rv THEN b ELSE w END
        WHEN e = 'amment' THEN CASE WHEN n >= rv THEN b || 'ant' ELSE w END
        WHEN e = 'emment' THEN CASE WHEN n >= rv THEN b || 'ent' ELSE w END
        WHEN n > rv AND regexp_matches(b, '{v}$') THEN b ELSE w END AS x FROM begun),
    settled AS (SELECT *, x <> w AND e NOT IN ({_of('amment', 'emment', 'ment')}) AS done FROM nouns),
    followed AS (
      SELECT *, CASE WHEN NOT done THEN x
        WHEN e IN ({_of('agent')}) AND x LIKE '%ic' THEN {_either('x', 'ic', 'iqU')}
        WHEN e IN ({_of('if')}) AND x LIKE '%at' AND length(x) - 2 >= r2 THEN CASE WHEN x LIKE '%icat' THEN
          CASE WHEN length(x) - 4 >= r2 THEN {_cut('x', 4)} ELSE {_cut('x', 4)} || 'iqU' END ELSE {_cut('x', 2)} END
        WHEN e IN ({_of('ité')}) THEN CASE WHEN x LIKE '%abil' THEN {_either('x', 'abil', 'abl')} WHEN x LIKE '%ic' THEN {_either('x', 'ic', 'iqU')}
          WHEN x LIKE '%iv' AND length(x) - 2 >= r2 THEN {_cut('x', 2)} ELSE x END
        WHEN e IN ({_of('ement')}) THEN CASE
          WHEN x LIKE '%iv' AND length(x) - 2 >= r2 THEN CASE WHEN x LIKE '%ativ' AND length(x) - 4 >= r2 THEN {_cut('x', 4)} ELSE {_cut('x', 2)} END
          WHEN x LIKE '%eus' THEN CASE WHEN length(x) - 3 >= r2 THEN {_cut('x', 3)} WHEN length(x) - 3 >= r1 THEN {_cut('x', 3)} || 'eux' ELSE x END
          WHEN (x LIKE '%abl' OR x LIKE '%iqU') AND length(x) - 3 >= r2 THEN {_cut('x', 3)}
          WHEN (x LIKE '%ièr' OR x LIKE '%Ièr') AND length(x) - 3 >= rv THEN {_cut('x', 3)} || 'i' ELSE x END
        ELSE x END AS y FROM settled),
    i_verbs AS (
      SELECT *, regexp_extract({rest.format('y')}, {_ends(stemming.I_VERB_ENDINGS)}) AS e2 FROM followed),
    i_done AS (
      SELECT *, NOT done AND e2 <> '' AND regexp_matches(substr(y, rv + 1, length(y) - rv - length(e2)), '[^H{stemming.VOWELS}]$') AS hit2 FROM i_verbs),
    verbs AS (
      SELECT *, CASE WHEN hit2 THEN substr(y, 1, length(y) - length(e2)) ELSE y END AS z,
        CASE WHEN done OR hit2 THEN '' ELSE regexp_extract({rest.format('y')}, {_ends(('ions', *stemming.ER_VERB_ENDINGS, *stemming.A_VERB_ENDINGS))}) END AS e3
      FROM i_done),
    v_done AS (
      SELECT *, e3 <> '' AND (e3 <> 'ions' OR length(z) - 4 >= r2) AS hit3, substr(z, 1, length(z) - length(e3)) AS s FROM verbs),
    ended AS (
      SELECT *, CASE WHEN NOT hit3 THEN z
        WHEN e3 IN ({", ".join(f"'{e}'" for e in stemming.A_VERB_ENDINGS)}) AND length(s) > rv AND s LIKE '%e' THEN {_cut('s', 1)} ELSE s END AS f FROM v_done),
    s_cut AS (
      SELECT *, CASE WHEN NOT (done OR hit2 OR hit3) AND length(f) > 1 AND regexp_matches(f, '(?:His|[^{stemming.KEEPS_S}]s)$') THEN {_cut('f', 1)} ELSE f END AS g FROM ended),
    last AS (
      SELECT *, CASE WHEN done OR hit2 OR hit3 THEN '' ELSE regexp_extract({rest.format('g')}, {_ends(stemming.LAST_ENDINGS)}) END AS e4 FROM s_cut),
    finished AS (
      SELECT word, CASE WHEN done OR hit2 OR hit3 THEN CASE WHEN g LIKE '%Y' THEN {_cut('g', 1)} || 'i' WHEN g LIKE '%ç' THEN {_cut('g', 1)} || 'c' ELSE g END
        WHEN e4 = 'ion' THEN CASE WHEN length(g) - 3 >= r2 AND regexp_matches({rest.format('g')}, '[st]ion$') THEN {_cut('g', 3)} ELSE g END
        WHEN e4 = 'e' THEN {_cut('g', 1)} WHEN e4 <> '' THEN substr(g, 1, length(g) - length(e4)) || 'i' ELSE g END AS h FROM last),
    doubled AS (SELECT word, CASE WHEN regexp_matches(h, {_ends(stemming.DOUBLED)}) THEN {_cut('h', 1)} ELSE h END AS h FROM finished)
    SELECT word, replace(replace(replace(replace(replace(replace(regexp_replace(h, '[éè]({c}+)$', 'e\\1'), 'I', 'i'), 'U', 'u'), 'Y', 'y'),
      'He', 'ë'), 'Hi', 'ï'), 'H', '') AS stem FROM doubled"""


def entries(heading: str, content: str, key: str, relation: str) -> str:
    """(chunk_id, weight, term, pos): the stemmed words of heading and body, the body behind the heading's last term."""
    def side(weight: str, column: str) -> str:
        return (f"SELECT chunk_id, '{weight}' AS weight, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM "
                f"(SELECT {key} AS chunk_id, {words(column)} AS w FROM {relation})")

    return (
        f"WITH raw AS (SELECT * FROM ({side('A', heading)} UNION ALL {side('B', content)}) WHERE word NOT IN ({_STOP})), "
        f"known AS ({stemmed('SELECT DISTINCT word FROM raw')}), "
        "behind AS (SELECT chunk_id, max(pos) AS shift FROM raw WHERE weight = 'A' GROUP BY chunk_id) "
        "SELECT chunk_id, weight, stem AS term, pos + CASE WHEN weight = 'B' THEN coalesce(shift, 0) ELSE 0 END AS pos "
        "FROM raw JOIN known USING (word) LEFT JOIN behind USING (chunk_id)"
    )


def postings(heading: str, content: str, key: str, relation: str) -> str:
    """Weighted term counts of a relation with positions, as ``term_index`` gives them."""
    return (
        "SELECT chunk_id, term, weight, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions "
        f"FROM ({entries(heading, content, key, relation)}) GROUP BY 1, 2, 3"
    )


def query_terms(key: str, column: str, relation: str) -> str:
    asked = f"SELECT {key} AS query_id, unnest({words(column)}) AS word FROM {relation}"
    return (
        f"WITH asked AS (SELECT DISTINCT * FROM ({asked}) WHERE word NOT IN ({_STOP})), "
        f"known AS ({stemmed('SELECT DISTINCT word FROM asked')}) SELECT DISTINCT query_id, stem AS term FROM asked JOIN known USING (word)"
    )


def cells(key: str, column: str, prefix: str, relation: str) -> str:
    """Sparse form (id, cell, v) of the hashed unit vectors, in single precision."""
    counted = (
        f"SELECT {key} AS id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {HASH_DIM} AS cell, count(*) "
        f"AS n FROM (SELECT {key}, unnest({words(repr(prefix) + ' || ' + column)}) AS term "
        f"FROM {relation}) GROUP BY 1, 2"
    )
    return (
        f"SELECT id, cell, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v "
        f"FROM ({counted})"
    )


def similarities(queries: str, corpus: str) -> str:
    """Cosine of every query and chunk from two relations of cells."""
    def unit(relation: str) -> str:
        return f"SELECT id, cell, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {relation}"

    return (
        f"SELECT a.id AS query_id, b.id AS chunk_id, round(sum(a.v * b.v), 9) AS score FROM "
        f"({unit(queries)}) a JOIN ({unit(corpus)}) b USING (cell) GROUP BY 1, 2"
    )


def top(relation: str, k: int) -> str:
    """The best k chunks of every query with their rank."""
    return (
        f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
        f"chunk_id) AS rank FROM ({relation})) WHERE rank <= {k}"
    )


KEYWORD = (
    "SELECT query_id, chunk_id, round(sum(tf * CASE WHEN weight = 'A' THEN 1.0 ELSE 0.4 END), 6) AS "
    "score FROM postings JOIN wanted USING (term) GROUP BY 1, 2"
)


def branches(k: int = 20, where: str = "true") -> str:
    """CTEs of both retrieval branches: benchmark passages against documents, those that ``where`` holds for."""
    return (
        f"WITH chunks AS (SELECT doc_id AS chunk_id, 'doc-' || doc_id AS source_id, source || ' > ' || "
        f"lang AS section, text AS content, source AS title, source || ' ' || lang AS heading FROM documents WHERE {where}), "
        f"postings AS ({postings('heading', 'content', 'chunk_id', 'chunks')}), "
        f"wanted AS ({query_terms('item_id', 'text', 'benchmark')}), "
        f"qcells AS ({cells('item_id', 'text', 'query: ', 'benchmark')}), "
        f"ccells AS ({cells('chunk_id', 'content', 'passage: ', 'chunks')}), "
        f"dense AS ({top(similarities('qcells', 'ccells'), k)}), "
        f"keyword AS ({top(KEYWORD, k)}), "
        "fused AS (SELECT query_id, chunk_id, score, dense_rank, keyword_rank, row_number() OVER "
        "(PARTITION BY query_id ORDER BY round(score, 12) DESC, dense_rank IS NULL, "
        "coalesce(dense_rank, keyword_rank)) AS rank FROM (SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) "
        "AS score, min(CASE WHEN b = 0 THEN rank END) AS dense_rank, min(CASE WHEN b = 1 THEN rank END) AS "
        "keyword_rank FROM (SELECT query_id, chunk_id, rank, 0 AS b FROM dense UNION ALL SELECT query_id, "
        "chunk_id, rank, 1 FROM keyword) GROUP BY 1, 2)) "
    )
