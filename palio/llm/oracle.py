"""DuckDB SQL that gives the rows of some queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({text}, ''), '[ \t-\r]+'), lambda x: x <> '')"


def _plain_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-/:-`{{-\\x7f]+'), lambda x: x <> '')"


#: Windows of 20 words that also start earlier, and the digest of the words that none of them covers.
SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_words("text")} w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + k p FROM later, (SELECT unnest(range(20)) k)),
word AS (SELECT doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) rest, count(*) c FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) n_removed, sha256(coalesce(rest, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

#: Words inside occurrences of ten-word windows of items; an item of fewer words is one window.
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_plain_words("text")} w FROM documents), i AS (SELECT item_id, {_plain_words("text")} w FROM benchmark WHERE item_id IS NOT NULL),
item AS (SELECT DISTINCT item_id, size, array_to_string(w[s : s + size - 1], ' ') g FROM (SELECT item_id, w, least(10, len(w)) size, unnest(range(1, len(w) - least(10, len(w)) + 2)) s FROM i WHERE len(w) > 0)),
win AS (SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') g FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) s FROM d, (SELECT DISTINCT size FROM item))),
hit AS (SELECT doc_id, s, size, item_id FROM win JOIN item USING (size, g)),
place AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) p FROM (SELECT DISTINCT doc_id, s, size FROM hit)),
n AS (SELECT doc_id, count(*) n_hit FROM place GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

#: Ten documents of highest score for every item.
SEARCH = f"""
WITH t AS (SELECT doc_id, unnest({_plain_words("text")}) term FROM documents), q AS (SELECT item_id, term, count(*) c FROM (SELECT item_id, unnest({_plain_words("text")}) term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY ALL), nn AS (SELECT doc_id, count(*) n FROM t GROUP BY doc_id), tot AS (SELECT count(*) docs, CAST(sum(n) AS BIGINT) total FROM nn),
df AS (SELECT term, count(*) df FROM tf GROUP BY term), w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) w FROM df, tot),
sc AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN nn USING (doc_id), tot GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) r FROM sc WHERE score > 0) WHERE r <= 10"""

#: Components of documents whose sets of word pairs have a similarity of 0.8 or more.
SIMILAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(2, len(w)) - 1], ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(2, len(w)) + 2)) i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM k UNION SELECT y, x FROM k),
reach(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON l.x = r.y),
c AS (SELECT x doc_id, min(y) component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) n_shingles, component_id, doc_id = component_id kept FROM c LEFT JOIN n USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op3_decontaminate": CONTAMINATION, "op10_substring_dedup": SUBSTRING, "op12_best_position_search": SEARCH, "op13_lsh_forest_dedup": SIMILAR}
