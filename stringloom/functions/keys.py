"""XOR key candidates: a column predicate and a score, as SQL for either dialect."""

from __future__ import annotations

from .dialect import Dialect, both, count_true, either

# Words that keys don't contain.
STOP_WORDS = ("http", "www", "com.", "error", "failed", "usage", "version", "copyright", "lib", "usr", "bin", "main", "std::", "runtime", "github", "windows", "program")


def entropy_sql(d: Dialect, c: str) -> str:
    """Shannon entropy of a text's characters in bits, from counts of the distinct ones."""
    if d.spark:
        n = f"length({c})"
        chars = f"array_distinct(split({c}, ''))"
        return f"aggregate(transform({chars}, x -> (length({c}) - length(replace({c}, x, ''))) / {n}), 0D, (a, p) -> a - p * log2(p))"
    chars = f"list_distinct(string_split({c}, ''))"
    return f"list_sum(list_transform({chars}, lambda x: -((length({c}) - length(replace({c}, x, ''))) / length({c})) * log2((length({c}) - length(replace({c}, x, ''))) / length({c}))))"


def candidate_sql(d: Dialect, c: str) -> str:
    """ASCII of 15 to 32 bytes with mixed classes, high entropy and no word in it."""
    classes = count_true(d.match(c, "[a-z]"), d.match(c, "[A-Z]"), d.match(c, "[0-9]"), d.match(c, "[^A-Za-z0-9]"))
    return both(f"{d.size(c)} BETWEEN 15 AND 32", d.match(c, r"^[ -~]+$"), f"NOT {d.has(c, '_')}", f"NOT {d.match(c, '(?i)(' + '|'.join(w.replace('.', chr(92) + '.') for w in STOP_WORDS) + ')')}", f"{classes} >= 2", either(d.match(c, "[0-9]"), d.match(c, "[^A-Za-z0-9]")), f"({entropy_sql(d, c)}) >= 3.5")


def score_sql(d: Dialect, c: str) -> str:
    """Length (40 to 100), distinct characters (0 to 60) and entropy (0 to 50)."""
    distinct = f"{'size(array_distinct(split(' + c + ', ' + d.lit('') + ')))' if d.spark else 'len(list_distinct(string_split(' + c + ', ' + d.lit('') + ')))'}"
    length = f"CASE WHEN {d.size(c)} = 31 THEN 100 WHEN {d.size(c)} IN (16, 24, 32) THEN 90 WHEN {d.size(c)} >= 20 THEN 70 ELSE 40 END"
    return f"({length} + {d.div(f'({distinct} * 60)', d.size(c))} + CAST(floor(least({entropy_sql(d, c)}, 5.0) * 10) AS INT))"
