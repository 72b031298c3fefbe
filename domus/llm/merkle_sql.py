"""DuckDB SQL of the Merkle manifest: one group of views a level."""

from __future__ import annotations


def _value(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _tree(name: str, leaves: str, levels: int) -> list[str]:
    """Views {name}0 .. of nodes (g, i, m, d), {name}r1 .. of runs (g, i, kids) and
    {name}top (g, d) over ``leaves`` (g, i, m, d)."""
    views = [f"{name}0 AS (SELECT g, i, m, d FROM {leaves})"]
    for k in range(levels):
        views.append(f"{name}r{k + 1} AS (SELECT g, m, i // 16 AS i, list(d ORDER BY i) AS kids FROM {name}{k} "
                     f"WHERE (m + {16 ** k - 1}) // {16 ** k} > 1 GROUP BY g, m, i // 16)")
        views.append(f"{name}{k + 1} AS (SELECT g, i, m, sha256(array_to_string(kids, '')) AS d FROM {name}r{k + 1})")
    tops = " UNION ALL ".join(
        f"SELECT g, d FROM {name}{k} WHERE (m + {16 ** k - 1}) // {16 ** k} = 1" for k in range(levels + 1))
    return [*views, f"{name}top AS ({tops})"]


def _paths(name: str, leaves: str, tree: str, levels: int) -> list[str]:
    """Views {name}0 .. that add the siblings of each level to ``proof`` and fold ``f``."""
    views = [f"{name}0 AS (SELECT * FROM {leaves})"]
    for k in range(levels):
        at = f"CAST((a.i // {16 ** k}) % 16 AS INTEGER)"
        left, right = f"array_to_string(r.kids[1:{at}], '')", f"array_to_string(r.kids[{at} + 2:], '')"
        views.append(f"{name}{k + 1} AS (SELECT a.* REPLACE ("
                     f"CASE WHEN r.kids IS NULL THEN a.proof ELSE a.proof || {left} || {right} END AS proof, "
                     f"CASE WHEN r.kids IS NULL THEN a.f ELSE sha256({left} || a.f || {right}) END AS f) "
                     f"FROM {name}{k} a LEFT JOIN {tree}r{k + 1} r ON r.g = a.g AND r.i = a.i // {16 ** (k + 1)})")
    return views


def merkle_sql(leaf_levels: int = 7, group_levels: int = 4) -> str:
    """Right for up to 16 ** leaf_levels rows a source and 16 ** group_levels sources."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(_value(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # CRC-32 of the decimal id, a character and then a bit at a time
    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT))), "
           "lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), "
           "lambda e, j: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)")
    views = [
        f"rows_ AS (SELECT doc_id, coalesce('+' || source, '') AS g, {leaf('text')} AS d, {leaf(lower)} AS changed, "
        f"doc_id IS NOT NULL AND {crc} % 5 = 0 AS bad FROM documents)",
        "leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i, "
        "count(*) OVER (PARTITION BY g) AS m FROM rows_)",
        *_tree("d", "leaves", leaf_levels),
        "subs AS (SELECT '' AS g, g AS source, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM dtop)",
        *_tree("s", "subs", group_levels),
        "claims AS (SELECT doc_id, g, i, d AS leaf, '' AS proof, CASE WHEN bad THEN changed ELSE d END AS f FROM leaves)",
        *_paths("p", "claims", "d", leaf_levels),
        f"inside AS (SELECT p.doc_id, p.leaf, p.proof, p.f, s.d AS subroot, s.i, '' AS g FROM p{leaf_levels} p JOIN subs s ON s.source = p.g)",
        *_paths("q", "inside", "s", group_levels),
    ]
    return "WITH " + ",\n".join(views) + (
        f"\nSELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified "
        f"FROM q{group_levels} CROSS JOIN stop t")
