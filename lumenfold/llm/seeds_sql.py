"""Spaced-seed decontamination as one DuckDB statement, with masked words in place of their hashes."""

from __future__ import annotations

from .spaced_seeds import IDENTITY, LEAST, MASKS, MISMATCH, SPAN


def _words(table: str, key: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low = f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')"
    return rf"SELECT {key}, list_filter(regexp_split_to_array({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM {table}"


def _seeds(words: str, key: str, whole: str) -> str:
    """(key, position, seed) for every mask; whole: the condition under which a short item's own mask of n words is used."""
    parts = []
    for salt, mask in enumerate(MASKS):
        seen = ", ".join(f"ws[i + {k}]" for k, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, i, '{salt}:' || concat_ws(' ', {seen}) AS seed FROM (SELECT {key}, ws, unnest(range(1, len(ws) - {SPAN - 2})) AS i FROM {words} WHERE len(ws) >= {SPAN})")
    parts.append(f"SELECT {key}, i, 'w' || n || ':' || array_to_string(ws[i:i + n - 1], ' ') AS seed FROM (SELECT {key}, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM {words}, short WHERE {whole})")
    return " UNION ALL ".join(parts)


def statement() -> str:
    return f"""
WITH d AS ({_words("documents", "doc_id")}), b AS ({_words("benchmark", "item_id")}),
short AS (SELECT DISTINCT len(ws) AS n FROM b WHERE len(ws) BETWEEN 1 AND {SPAN - 1}),
ds AS ({_seeds("d", "doc_id", "len(ws) >= n")}), bs AS ({_seeds("b", "item_id", "len(ws) = n")}),
diag AS (SELECT DISTINCT doc_id, item_id, ds.i - bs.i AS shift FROM ds JOIN bs USING (seed)),
pair AS (SELECT diag.*, d.ws AS dws, b.ws AS bws FROM diag JOIN d USING (doc_id) JOIN b USING (item_id)),
cell AS (SELECT doc_id, item_id, shift, len(bws) AS item_words, k, dws[k + shift] = bws[k] AS same FROM (SELECT *, unnest(range(greatest(1, 1 - shift), least(len(bws), len(dws) - shift) + 1)) AS k FROM pair)),
run AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE -{MISMATCH} END) OVER w AS total, sum(CAST(same AS INTEGER)) OVER w AS hits FROM cell WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY k)),
base AS (SELECT doc_id, item_id, shift, item_words, k, total, hits, coalesce(lag(total) OVER w, 0) AS prior, coalesce(lag(hits) OVER w, 0) AS before FROM run WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY k)),
low AS (SELECT *, min(prior) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS least FROM base),
fin AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY total - least DESC, k) AS r FROM low),
seg AS (SELECT f.doc_id, f.item_id, f.shift, f.item_words, f.k AS last, f.hits, (SELECT min(struct_pack(k := s.k, before := s.before)) FROM base s WHERE s.doc_id = f.doc_id AND s.item_id = f.item_id AND s.shift = f.shift AND s.k <= f.k AND s.prior = f.least) AS first FROM fin f WHERE r = 1),
good AS (SELECT *, hits - first.before AS matched, last - first.k + 1 AS width FROM seg),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) AS r FROM good WHERE matched >= least({LEAST}, item_words) AND matched >= {IDENTITY!r}::DOUBLE * width)
SELECT doc_id, item_id, CAST(first.k + shift - 1 AS BIGINT) AS doc_begin, CAST(last + shift AS BIGINT) AS doc_end, CAST(first.k - 1 AS BIGINT) AS item_begin, CAST(matched AS BIGINT) AS matched, CAST(item_words AS BIGINT) AS item_words FROM best WHERE r = 1
"""
