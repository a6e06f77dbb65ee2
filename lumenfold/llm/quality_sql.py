"""The quality rules as one DuckDB statement, written out step by step from the same parameters."""

from __future__ import annotations

from math import log

from .quality_rules import CORE, FLOOR, P, PAIRS, PRIOR, QUANTILE, STEPS, chi_square

_COUNTS = r"""
w AS (SELECT doc_id, coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tri AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT doc_id, g FROM tri GROUP BY doc_id, g HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT tri.doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri JOIN twice ON tri.doc_id = twice.doc_id AND tri.g = twice.g) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
st AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN lines ON w.doc_id = lines.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id),
x AS (SELECT *, least(ln(1 + n_words), 50) AS x0, least(CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END, 50) AS x1, CASE WHEN word_chars > 0 THEN sqrt(n_symbols::DOUBLE / word_chars) ELSE 0 END AS x2, CASE WHEN n_lines > 0 THEN sqrt(n_dup_lines::DOUBLE / n_lines) ELSE 0 END AS x3, CASE WHEN n_words > 0 THEN sqrt(n_repeat_words::DOUBLE / n_words) ELSE 0 END AS x4 FROM st)"""


def _medians(name: str, rows: str, value: str, out: str) -> list[str]:
    """CTEs for the binned medians of a value of each feature (a template of its number)."""
    bins = f"{name}b AS (SELECT lang, source, unnest(range({len(P)})) AS f, unnest([{', '.join(f'CAST(floor(({value.format(i=i)}) * 200) AS BIGINT)' for i in P)}]) AS bin FROM {rows})"
    upto = f"{name}c AS (SELECT lang, source, f, bin, sum(count(*)) OVER (PARTITION BY lang, source, f ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY lang, source, f) AS total FROM {name}b GROUP BY lang, source, f, bin)"
    least = f"{name}d AS (SELECT lang, source, f, min(bin) AS bin FROM {name}c WHERE upto >= 0.5 * total GROUP BY lang, source, f)"
    wide = f"{name} AS (SELECT lang, source, {', '.join(f'max(CASE WHEN f = {i} THEN bin / 200::DOUBLE + 0.0025::DOUBLE END) AS {out}{i}' for i in P)} FROM {name}d GROUP BY lang, source)"
    return [bins, upto, least, wide]


def _moments(name: str, keys: str, core: str, stretch: float) -> str:
    """A CTE for n, means m.. and covariances c.. of the core's rows."""
    return f"{name} AS (SELECT {keys}, count(*)::DOUBLE AS n, {', '.join(f'avg(x{i}) AS m{i}' for i in P)}, {', '.join(f'covar_pop(x{i}, x{j}) * {stretch!r}::DOUBLE AS c{i}{j}' for i, j in PAIRS)} FROM {core} GROUP BY {keys})"


def _inverted(name: str, keys: str, moments: str) -> list[str]:
    """CTEs for inverse covariances p.. and the determinant's logarithm, by a Cholesky factor of the covariances and floors."""
    out, last = [], moments

    def add(column: str, expression: str) -> None:
        nonlocal last
        new = f"{name}_{column}"
        out.append(f"{new} AS (SELECT *, {expression} AS {column} FROM {last})")
        last = new

    for i, j in PAIRS:
        rest = f"c{i}{j} + {(FLOOR[i] ** 2 if i == j else 0.0)!r}::DOUBLE" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
        add(f"l{i}{j}", f"sqrt(greatest({rest}, 1e-12::DOUBLE))" if i == j else f"({rest}) / l{j}{j}")
    for j in P:
        add(f"v{j}{j}", f"1 / l{j}{j}")
        for i in range(j + 1, len(P)):
            add(f"v{i}{j}", "-(" + " + ".join(f"l{i}{k} * v{k}{j}" for k in range(j, i)) + f") / l{i}{i}")
    inverse = ", ".join("(" + " + ".join(f"v{k}{i} * v{k}{j}" for k in range(i, len(P))) + f") AS p{i}{j}" for i, j in PAIRS)
    logdet = " + ".join(f"2 * ln(l{i}{i})" for i in P)
    return [*out, f"{name} AS (SELECT {keys}, n, {_columns('mc')}, {inverse}, {logdet} AS logdet FROM {last})"]


def _columns(kinds: str) -> str:
    return ", ".join(f"m{i}" for i in P if "m" in kinds) + ", " + ", ".join(f"{k}{i}{j}" for k in kinds if k != "m" for i, j in PAIRS)


def _shrunk(name: str, moments: str) -> list[str]:
    """CTEs for every group's estimate with PRIOR rows of its language's moments, and in those PRIOR of all rows'."""
    names = [*(f"s{i}" for i in P), *(f"q{i}{j}" for i, j in PAIRS)]
    sums = ", ".join([*(f"n * m{i} AS s{i}" for i in P), *(f"n * (c{i}{j} + m{i} * m{j}) AS q{i}{j}" for i, j in PAIRS)])
    mean = lambda c: f"(coalesce({name}s.{c}, 0) + {PRIOR!r}::DOUBLE * (coalesce({name}l.{c}, 0) + {PRIOR!r}::DOUBLE * coalesce({name}a.{c} / {name}a.n, 0)) / (coalesce({name}l.n, 0) + {PRIOR!r}::DOUBLE)) / (coalesce({name}s.n, 0) + {PRIOR!r}::DOUBLE) AS {c}"
    return [
        f"{name}s AS (SELECT lang, source, n, {sums} FROM {moments})",
        f"{name}l AS (SELECT lang, sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM {name}s GROUP BY lang)",
        f"{name}a AS (SELECT sum(n) AS n, {', '.join(f'sum({c}) AS {c}' for c in names)} FROM {name}l)",
        f"{name}g AS (SELECT grp.lang, grp.source, coalesce({name}s.n, 0) AS n, {', '.join(mean(c) for c in names)} FROM grp LEFT JOIN {name}s ON grp.lang = {name}s.lang AND grp.source = {name}s.source LEFT JOIN {name}l ON grp.lang = {name}l.lang, {name}a)",
        f"{name}m AS (SELECT lang, source, n, {', '.join(f's{i} AS m{i}' for i in P)}, {', '.join(f'q{i}{j} - s{i} * s{j} AS c{i}{j}' for i, j in PAIRS)} FROM {name}g)",
        *_inverted(name, "lang, source", f"{name}m"),
    ]


MAHALANOBIS = " + ".join(f"p{i}{j} * (x{i} - m{i}) * (x{j} - m{j}) * {1 if i == j else 2}" for i in P for j in range(i + 1))


def statement() -> str:
    xs = ", ".join(f"x{i}" for i in P)
    group, keys = "lang, source", "lang, source, start"
    ctes = [_COUNTS.strip(), f"g AS (SELECT lang, source, {xs} FROM x)", "grp AS (SELECT DISTINCT lang, source FROM g)"]
    ctes += _medians("mid", "g", "x{i}", "m")
    ctes += _medians("spr", "(SELECT g.*, mid.* EXCLUDE (lang, source) FROM g JOIN mid USING (lang, source))", "abs(x{i} - m{i})", "s")
    ctes += [_moments("allm", group, "g", 1.0), *_inverted("allp", group, "allm")]
    diagonal = lambda width: ", ".join((f"1 / pow({width(i)}, 2)" if i == j else "0::DOUBLE") + f" AS p{i}{j}" for i, j in PAIRS)
    means, mads, units = ", ".join(f"m{i}" for i in P), diagonal(lambda i: f"(1.4826::DOUBLE * s{i} + {FLOOR[i]!r}::DOUBLE)"), diagonal(lambda i: f"{FLOOR[i]!r}::DOUBLE")
    ctes.append(f"e0 AS (SELECT lang, source, 0 AS start, {means}, {mads} FROM mid JOIN spr USING (lang, source) UNION ALL SELECT lang, source, 1, {_columns('mp')} FROM allp UNION ALL SELECT lang, source, 2, {means}, {units} FROM mid)")
    narrowed = 1 / (1 + log(1 / (1 - CORE)) / len(P))
    for k in range(STEPS):
        ctes += [
            f"b{k} AS (SELECT {keys}, {xs}, CAST(floor(ln(1 + ({MAHALANOBIS})) * 64) AS BIGINT) AS bin FROM g JOIN e{k} USING (lang, source))",
            f"u{k} AS (SELECT {keys}, bin, sum(count(*)) OVER (PARTITION BY {keys} ORDER BY bin) AS upto, sum(count(*)) OVER (PARTITION BY {keys}) AS total FROM b{k} GROUP BY {keys}, bin)",
            f"q{k} AS (SELECT {keys}, min(bin) AS most FROM u{k} WHERE upto >= {CORE!r}::DOUBLE * total GROUP BY {keys})",
            f"k{k} AS (SELECT b{k}.* FROM b{k} JOIN q{k} USING (lang, source, start) WHERE bin <= most)",
            _moments(f"mom{k}", keys, f"k{k}", 1 / narrowed),
            *_inverted(f"e{k + 1}", keys, f"mom{k}"),
        ]
    ctes += [
        f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY round(logdet, 6), start) AS r FROM e{STEPS}) WHERE r = 1)",
        *_shrunk("near", "best"),
        f"kept AS (SELECT lang, source, {xs} FROM g JOIN near USING (lang, source) WHERE {MAHALANOBIS} <= {chi_square(len(P), 0.975)!r}::DOUBLE)",
        _moments("fin", group, "kept", 1.0),
        *_shrunk("model", "fin"),
    ]
    failed = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"
    ctes.append(f"r AS (SELECT x.*, {failed} AS base_failed, {MAHALANOBIS} AS distance2 FROM x LEFT JOIN model USING (lang, source))")
    limit = f"{chi_square(len(P), QUANTILE)!r}::DOUBLE"
    kept = lambda c: c.split(" ")[0][:1] in "gdkben" and "_" not in c.split(" ")[0]
    return "WITH " + ",\n".join(c.replace("AS (", "AS MATERIALIZED (", 1) if kept(c) else c for c in ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(distance2, 0) <= {limit} AS kept, round(distance2, 4) AS distance2 FROM r"
