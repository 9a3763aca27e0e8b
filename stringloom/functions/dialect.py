"""SQL text for two engines from one description.

Rules are written once against a Dialect: SPARK gives text for F.expr(), DUCKDB the same meaning
for checking. Patterns keep to what Java's and RE2's regular expressions share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def lit(self, s: str) -> str:
        return "'" + (s.replace("\\", "\\\\").replace("'", "\\'") if self.spark else s.replace("'", "''")) + "'"

    def match(self, c: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({c}, {self.lit(pattern)})"

    def size(self, c: str) -> str:
        """Bytes."""
        return f"{'octet_length' if self.spark else 'strlen'}({c})"

    def replace(self, c: str, pattern: str, by: str = "") -> str:
        return f"regexp_replace({c}, {self.lit(pattern)}, {self.lit(by)}{'' if self.spark else ", 'g'"})"

    def extract(self, c: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({c}, {self.lit(pattern)}, {group})"

    def every(self, c: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({c}, {self.lit(pattern)}, {group})"

    def count(self, c: str, chars: str) -> str:
        """Number of ASCII characters of a class (written as inside brackets)."""
        return self.size(self.replace(c, f"[^{chars}]"))

    def pieces(self, c: str, piece: str) -> str:
        """Occurrences of a literal."""
        return self.div(f"({self.size(c)} - {self.size(f'replace({c}, {self.lit(piece)}, {self.lit("")})')})", str(len(piece.encode())))

    def div(self, a: str, b: str) -> str:
        return f"({a} {'div' if self.spark else '//'} {b})"

    def percent(self, part: str, whole: str) -> str:
        return self.div(f"({part} * 100)", f"greatest({whole}, 1)")

    def has(self, c: str, *pieces: str) -> str:
        if len(pieces) > 6:  # one pattern: less generated code
            return self.match(c, "|".join(re.sub(r"([^0-9A-Za-z _/<>=:;!&'\"%-])", r"\\\1", p) for p in pieces))
        return "(" + " OR ".join(f"contains({c}, {self.lit(p)})" for p in pieces) + ")"

    def starts(self, c: str, *pieces: str) -> str:
        return "(" + " OR ".join(f"{'startswith' if self.spark else 'starts_with'}({c}, {self.lit(p)})" for p in pieces) + ")"

    def ends(self, c: str, *pieces: str) -> str:
        return "(" + " OR ".join(f"{'endswith' if self.spark else 'ends_with'}({c}, {self.lit(p)})" for p in pieces) + ")"

    def among(self, c: str, values: Iterable[str]) -> str:
        return f"({c} IN ({', '.join(self.lit(v) for v in values)}))"

    def part(self, c: str, sep: str, n: int) -> str:
        return f"split_part({c}, {self.lit(sep)}, {n})"

    def first_is_word(self, c: str, words: Iterable[str]) -> str:
        """Whether the first occurrence of any of the words stands at the start or behind a blank."""
        items = ", ".join(self.lit(w) for w in words)
        at = f"{'instr' if self.spark else 'strpos'}({c}, w)"
        test = f"{at} = 1 OR ({at} > 1 AND substr({c}, {at} - 1, 1) = ' ')"
        return f"exists(array({items}), w -> {test})" if self.spark else f"list_bool_or(list_transform([{items}], lambda w: {test}))"

    def number(self, c: str) -> str:
        return f"try_cast({c} AS INT)"

    def head(self, c: str, n: int) -> str:
        return f"substr({c}, 1, {n})"


SPARK, DUCKDB = Dialect(True), Dialect(False)


def both(*tests: str) -> str:
    return "(" + " AND ".join(tests) + ")"


def either(*tests: str) -> str:
    return "(" + " OR ".join(tests) + ")"


def count_true(*tests: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests) + ")"
