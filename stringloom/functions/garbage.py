"""NOT garbage: which values are noise, as an ordered rule table in SQL for either dialect.

The order is: what is clearly valid passes; what is clearly noise goes; what has a kind or looks
like an indicator passes; statistics over character classes decide the rest.
"""

from __future__ import annotations


from .dialect import Dialect, both

# Limits of the statistics.
MIN_FAST_VALID, MAX_BLANK_PERCENT, MIN_ALNUM_PERCENT, MAX_NON_ASCII_PERCENT = 12, 33, 30, 20
# Short words that are no noise although they have few vowels.
SHORT_WORDS = ("init", "main", "type", "file", "func", "data", "test", "temp", "code", "info", "user", "node", "sync", "async", "true", "null", "void", "char", "bool", "time", "size", "path", "name", "text")
# Substrings that make a value an indicator.
IOC_PIECES = ("http://", "https://", "ftp://", "stratum+", "nanopool", "minergate", "LDAP://", "HKEY_", "<script", "/bin/", "/tmp/", "/etc/", "C:\\", "cmd.exe", "powershell", "BEGIN ", "eyJ", "${", "$(", "function ", "eval(", "import ", "SELECT ", "UNION ")
#: Methods whose rows always pass, and kinds that do.
KEPT_METHODS = ("Base64Decode", "HexDecode", "UrlDecode", "UnicodeEscapeDecode", "ScriptDecode", "StackString", "XorStackPair", "InstructionPattern")
KEPT_KINDS = ("Section", "Import", "Export", "FuncName", "Entitlement", "EntitlementsXml", "XorKey", "AppId", "CodeSignatureHash")


def garbage_rules(d: Dialect, c: str, kind: str) -> list[tuple[bool, str]]:
    """(is garbage, test) in order, over a trimmed value and its kind (an SQL expression, may be NULL)."""
    n = d.size(c)
    upper, lower, digit = d.count(c, "A-Z"), d.count(c, "a-z"), d.count(c, "0-9")
    alpha, vowels = d.count(c, "A-Za-z"), d.count(c, "AEIOUaeiou")
    alnum = f"({alpha} + {digit})"
    plain = d.percent(d.count(c, "A-Za-z0-9 _./-"), n)
    blank = d.percent(d.count(c, " \\t\\n\\r"), n)
    other = f"({n} - {d.count(c, '\\x00-\\x7f')})"
    special = f"({n} - {alnum} - {d.count(c, ' \\t\\n\\r')} - {other})"
    hexed = d.match(c, "(?i)^(0x)?[0-9a-f]{8,}$")
    turns = f"({d.size(d.replace(c, '([a-z])([A-Z0-9])|([A-Z])([0-9])|([0-9])([A-Za-z])', '___'))} - {n})"
    return [
        (False, both(f"{n} >= {MIN_FAST_VALID}", d.match(c, "^[A-Za-z]"), f"{plain} >= 80", f"{vowels} * 8 >= {alpha}", f"{turns} * 4 < {n}")),
        (True, f"{n} <= 1"),
        (True, d.match(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")),
        (True, both(f"{n} <= 4", d.match(c, "^[^A-Za-z0-9]+$"))),
        (False, f"{kind} IS NOT NULL"),
        (False, d.has(c, *IOC_PIECES)),
        (False, d.match(c, r"^[0-9]{8,16}:[A-Za-z0-9_-]{30,64}$")),
        (False, d.match(c, r"^_?\$s[0-9A-Za-z_]{6,}$|^_Z[0-9A-Za-z_]{4,}$")),
        (False, d.match(c, r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")),
        (False, d.match(c, r"^[a-z]{2,3}[_-][A-Z]{2,3}$|^\*\.[A-Za-z0-9]{1,5}$")),
        (False, both(hexed, d.match(c, "[0-9]"), d.match(c, "(?i)[a-f]"))),
        (True, both(f"{n} >= 8", f"{digit} >= 6", f"{alpha} <= 2")),
        (True, both(f"{n} BETWEEN 4 AND 10", f"{upper} = 0", f"{lower} >= 3", f"{digit} >= 1", f"NOT {d.match(c, '[aeiou]')}")),
        (True, both(f"{n} BETWEEN 4 AND 5", f"{lower} = {n}", f"{vowels} <= 1", f"NOT {d.among(c, SHORT_WORDS)}")),
        (True, d.has(c, '""', "'''")),
        (True, both(f"{n} = 4", f"{upper} = {n}", f"{vowels} = 0")),
        (True, both(f"{n} BETWEEN 2 AND 6", f"{upper} > 0", f"{lower} > 0", f"{digit} > 0", f"{special} > 0")),
        (True, both(f"{n} BETWEEN 6 AND 40", f"{turns} >= 4", f"{turns} * 100 > {n} * 40", f"NOT {d.match(c, '[ _./-]')}")),
        (True, f"{blank} > {MAX_BLANK_PERCENT}"),
        (True, both(f"{n} >= 4", f"{d.percent(alnum, n)} < {MIN_ALNUM_PERCENT}", f"{other} = 0")),
        (True, both(f"{other} > 0", f"{n} <= 10", f"{d.percent(other, n)} > 50", f"{alpha} <= 2")),
        (True, both(f"{d.percent(other, n)} > {MAX_NON_ASCII_PERCENT}", f"{d.percent(special, n)} > 20")),
        (True, both(f"{n} >= 6", f"{alpha} * 10 >= {n} * 8", f"{vowels} = 0", f"{upper} <> {n}", f"{other} = 0")),
        (True, d.match(c, r"(AAAA|aaaa|XXXX|\?\?\?\?|@@@@|####|\$\$\$\$)")),
    ]


def garbage_sql(d: Dialect, c: str = "value", kind: str = "kind") -> str:
    """TRUE for noise. c is trimmed."""
    arms = " ".join(f"WHEN {test} THEN {'TRUE' if bad else 'FALSE'}" for bad, test in garbage_rules(d, c, kind))
    return f"CASE {arms} ELSE FALSE END"



