"""kind = classify(value): an ordered table of rules, as SQL for either dialect.

A rule is (kind, test); the first whose test holds decides, and a kind of None decides for "no
kind". What needs loops over decoded bytes (Base85, the tail of Base64, Unicode escapes) is left
to `classify_rest` in stringloom.functions.codecs, which sees only values undecided here: those
rules carry the kind DEFER.
"""

from __future__ import annotations

from . import lexicon as L
from .dialect import Dialect, both, count_true, either

DEFER = "?"
LONG, PREFIX = 1000, 256
BASE58 = "1-9A-HJ-NP-Za-km-z"


OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def ipv4(d: Dialect, c: str) -> str:
    """Four decimal octets (a sign and leading zeros are read over) that don't read as a version number."""
    plain = d.replace(c, r"(^|\.)\+?0+([0-9])", "$1$2" if d.spark else r"\1\2")
    low = "1?[0-9]"
    private = d.match(plain, r"^(10\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.)")
    version = either(d.match(plain, r"\.0\.0$|^127\.|^2\.5\."), both(f"NOT {private}", d.match(plain, rf"^[0-9]+\.0\.{low}\.{low}$|(^|\.)0\.([0-9]+\.)?([0-9]+\.)?0(\.|$)")))
    return both(d.match(c, r"^\+?[0-9]+(\.\+?[0-9]+){3}$"), d.match(plain, rf"^{OCTET}(\.{OCTET}){{3}}$"), either(d.among(plain, L.PUBLIC_RESOLVERS), f"NOT {version}"))


def suspicious_path(d: Dialect, c: str) -> str:
    return either(
        d.has(c, "/."),
        both(d.starts(c, "/etc/"), d.has(c, "ld.so.preload", "ld.so.conf", "cron", "init.d", "systemd", "rc.local")),
        both(d.starts(c, "/dev/"), d.has(c, "shm", "mem", "kmem")),
        both(f"NOT {d.starts(c, '/etc/', '/dev/')}", d.starts(c, "/proc/", "/sys/", "/tmp/", "/var/tmp/", "/var/spool/cron", "/Library/Launch")),
    )


def python_code(d: Dialect, c: str) -> str:
    signs = [d.has(c, "import "), both(d.has(c, "from "), d.has(c, " import"))]
    signs += [d.has(c, x) for x in ("def ", "class ", "exec(", "eval(", "__import__", "__import__", "subprocess", "getattr(", "lambda ", "sys.")]
    signs += [either(d.has(c, "os.path", "os.system", "os.environ", "os.name", "os.getcwd"), both(d.has(c, "os."), d.has(c, "import os", "from os"))), both(d.has(c, "__name__"), d.has(c, "__main__"))]
    markup = both(d.match(c, r"^[ \t\r\n\f]*<"), d.has(c, ">"), d.has(c, *L.MARKUP))
    other = either(d.has(c, ".(*", "go.shape.", "syscall.Handle"), both(d.has(c, "import ", "package "), d.has(c, *L.OTHER_LANGUAGE_PACKAGES)), both(d.starts(c, "import "), d.ends(c, ";")), markup)
    return both(f"{d.size(c)} >= 8", d.has(c, *L.PYTHON_TRIGGERS), f"NOT {other}", f"{count_true(*signs)} >= 2")


def javascript_code(d: Dialect, c: str) -> str:
    signs = [d.has(c, "function "), *(both(d.has(c, x), d.has(c, " = ")) for x in ("const ", "let ", "var ")), *(d.has(c, x) for x in ("require(", "document.", "window.", "console.log")), both(d.has(c, "=>"), d.has(c, "{"))]
    return both(f"{d.size(c)} >= 8", d.has(c, *L.SCRIPT_TRIGGERS), f"{count_true(*signs)} >= 2")


def php_code(d: Dialect, c: str) -> str:
    signs = [d.has(c, " = "), both(d.has(c, "eval"), d.has(c, "base64_decode")), both(d.has(c, "function "), d.has(c, "{"))]
    return both(f"{d.size(c)} >= 5", either(d.has(c, "<?php"), d.match(c, r"^(?s:.*?)<\?=[A-Za-z0-9 $]"), both(f"{d.pieces(c, '$')} >= 2", f"{count_true(*signs)} >= 2")))


def applescript(d: Dialect, c: str) -> str:
    stems = [x for s in L.APPLESCRIPT_STEMS for x in (s, s.title() if s.isalpha() else s.capitalize(), s.upper())]
    phrases = "|".join(L.APPLESCRIPT_PHRASES)
    assigns = both(d.match(c, r"(?i)(^|[ \t\n])set "), either(d.match(c, "(?i) to "), d.has(c, "=")))
    return both(f"{d.size(c)} >= 8", d.has(c, " "), d.has(c, *stems), either(d.match(c, f"(?i)({phrases})"), assigns))


def subshell(d: Dialect, c: str) -> str:
    """The first $(...) reads as a command."""
    inside = d.extract(c, r"\$\(([^)]*)\)", 1)
    n = d.size(inside)
    return both(
        d.match(c, r"\$\([^)]*\)"), f"{n} >= 2", f"{d.percent(d.count(inside, '\\x00-\\x7f'), n)} > 90",
        f"{d.percent(d.count(inside, 'A-Za-z0-9'), n)} > 40", either(d.has(inside, " "), d.starts(inside, *L.SUBSHELL_STARTS)),
    )


def shell_command(d: Dialect, c: str) -> str:
    env = "#!/usr/bin/env "
    head = d.head(c, 10)
    before_colon = d.extract(head, r"^([^:]*):", 1)
    coded = both(f"{d.size(c)} >= 6", d.has(head, ":"), d.match(before_colon, "[A-Z]"), d.match(before_colon, "[0-9]"))
    reject = either(
        both(d.has(c, "{0}", "{1}", "%s", "%d"), d.has(c, *L.SHELL_ERROR_WORDS)), coded, both(f"NOT {d.has(c, ' ')}", f"NOT {d.starts(c, '/bin/', '$(')}"),
        d.match(c, "`[0-9]"), d.has(c, *L.SHELL_COMPARISONS),
    )
    quoted = d.extract(c, r"^`([^`]*)`", 1)
    tick = both(d.match(c, r"^`[^`]+`"), f"NOT {d.has(c, chr(92) + '`')}", d.has(quoted, " "), f"NOT {d.starts(quoted, 'go ')}", f"NOT {d.has(quoted, ' doc ')}", f"{d.percent(d.count(quoted, '\\x00-\\x7f'), d.size(quoted))} > 90")

    service = d.match(c, f"(^| )service ({'|'.join(L.SERVICE_ACTIONS)})")
    commands = either(both(d.match(c, "(^| )(" + "|".join(L.SHELL_COMMANDS) + ")"), d.first_is_word(c, L.SHELL_COMMANDS)), service)
    yes = either(
        d.has(c, *L.SHELL_REDIRECTS), both(d.has(c, " | "), either(d.has(c, *L.SHELL_PIPES), d.starts(c, "ls ", "find ", "ps "))), both(d.has(c, " && "), d.has(c, "cd ", "mkdir ", "rm ")),
        subshell(d, c), tick, commands,
    )
    interpreter = d.match(c, r"^#!/usr/bin/env +(bash|sh|zsh|dash|ksh)([ \t\n\r\f]|$)")
    return both(f"{d.size(c)} >= 4", either(d.starts(c, *L.SHELL_STARTS), interpreter, both(f"NOT {d.starts(c, env)}", d.match(c, "[ /$|&>;`]"), f"NOT {reject}", yes)))


def email_rules(d: Dialect, c: str) -> tuple[str, str]:
    """(one @ and a dot in a value of six bytes, and whether that is an address)."""
    local, domain = d.part(c, "@", 1), d.part(c, "@", 2)
    gate = both(f"{d.size(c)} >= 6", f"{d.pieces(c, '@')} = 1", d.has(c, "."))
    good = both(
        f"NOT {d.has(c, '..')}", d.match(local, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*$"), d.match(domain, r"^[A-Za-z0-9-][A-Za-z0-9-]+\.[A-Za-z0-9.-]*$"), d.match(domain, r"\.[A-Za-z]{2,}$"),
        f"NOT {d.match(domain, r'^v[0-9]+\.')}", d.match(domain, r"^[0-9-]*[A-Za-z][A-Za-z0-9-]*\."),
    )
    enough = f"{d.percent(d.count(c, 'A-Za-z0-9@._+-'), d.size(c))} >= 85"
    return gate, both(good, enough)


def wallet(d: Dialect, c: str) -> str:
    n = d.size(c)
    alnum = d.percent(d.count(c, "A-Za-z0-9"), n)
    camel = f"({d.size(d.replace(c, '[a-z][A-Z]', '___'))} - {n})"
    return either(
        both(d.match(c, f"^[13][{BASE58}]{{25,34}}$")), both(d.starts(c, "bc1"), f"{n} >= 42", f"{alnum} >= 95"), d.match(c, "^0x[0-9A-Fa-f]{40}$"),
        both(d.starts(c, "4", "8"), f"{n} BETWEEN 95 AND 108", f"{alnum} >= 95"), both(d.match(c, f"^[LM][{BASE58}]{{25,34}}$"), f"{camel} < 3"), d.match(c, f"^D[{BASE58}]{{33}}$"),
    )


def api_key(d: Dialect, c: str) -> str:
    n = d.size(c)
    share = lambda chars: f"{d.percent(d.count(c, chars), n)} >= 90"
    return either(
        both(d.starts(c, "AKIA"), f"{n} >= 20", share("A-Za-z0-9")), both(d.starts(c, "ghp_"), f"{n} >= 36", share("A-Za-z0-9_")),
        both(d.starts(c, "sk_live_", "pk_live_"), f"{n} >= 20", share("A-Za-z0-9_")), both(d.starts(c, "xox"), f"{n} >= 30", share("A-Za-z0-9-")),
    )


def hex_pairs(d: Dialect, c: str, graphic: str) -> str:
    """Pairs of a hex text that decode to a class, counted by replacing each pair by a mark."""
    marked = d.replace(d.replace(c, "(..)", "$1," if d.spark else r"\1,"), f"(?:{graphic}),", "+")
    return d.count(marked, "+")


GRAPHIC_PAIR = "2[1-9A-Fa-f]|[3-6][0-9A-Fa-f]|7[0-9A-Ea-e]"
PRINTABLE_PAIR = "2[0-9A-Fa-f]|[3-6][0-9A-Fa-f]|7[0-9A-Ea-e]|0[9AaCcDd]"


def hash_value(d: Dialect, c: str) -> str:
    n = d.size(c)
    return both(f"{n} IN (32, 40, 64, 128)", d.match(c, "^[0-9A-Fa-f]+$"), f"{hex_pairs(d, c, GRAPHIC_PAIR)} * 4 < {n}")


def hex_encoded(d: Dialect, c: str) -> str:
    n = d.size(c)
    shape = both(f"{n} >= 16", f"{n} % 2 = 0", d.match(c, "^[0-9A-Fa-f]+$"))
    pairs = f"regexp_extract_all(lower({c}), '..', 0)"
    distinct = f"{'size(array_distinct(' + pairs + '))' if d.spark else 'len(list_distinct(' + pairs + '))'} >= 3"
    return both(shape, f"{hex_pairs(d, c, PRINTABLE_PAIR)} * 20 > {n} * 7", distinct)


def base58(d: Dialect, c: str) -> str:
    n = d.size(c)
    camel = f"({d.size(d.replace(c, '[a-z][A-Z]', '___'))} - {n})"
    lead = d.size(d.extract(c, "^[A-Z]*", 0))
    letters, vowels = d.count(c, "A-Za-z"), d.count(c, "AEIOUaeiou")
    return both(
        f"{n} >= 20", d.match(c, f"^[{BASE58}]+$"), d.match(c, "[A-Z]"), d.match(c, "[a-z]"), d.match(c, "[1-9]"), f"{lead} < 3", f"NOT ({lead} >= 2 AND {camel} >= 2)", f"NOT ({lead} = 1 AND {camel} >= 7)",
        f"NOT ({n} < 40 AND {d.match(c, '(?i)(http2|grpc|proto)')})", f"{d.percent(vowels, letters)} < 28",
    )


def base32(d: Dialect, c: str) -> str:
    n = d.size(c)
    return both(f"{n} >= 16", f"NOT {d.match(c, '[0189a-z]')}", d.match(c, "[A-Z]"), d.match(c, "[2-7]"), f"{d.count(c, 'A-Z2-7=')} * 10 >= {n} * 9")


def base64_gate(d: Dialect, c: str) -> str:
    n = d.size(c)
    return both(
        f"{n} >= 16", f"{n} % 4 = 0", d.match(c, "^[A-Za-z0-9+/=]+$"), d.match(c, "[A-Z]"), d.match(c, "[a-z]"), d.match(c, "[0-9]"), f"NOT {d.match(c, '^([A-Z]{4}|[a-z]{4})')}",
        f"NOT ({n} < 40 AND {d.match(c, '(?i)(http2|grpc|proto)')})", f"NOT {d.has(c, 'ABCDE', '012345')}", f"NOT {d.match(c, '[0-9]{8}')}",
    )


def base85_gate(d: Dialect, c: str) -> str:
    n = d.size(c)
    fenced = both(d.starts(c, "<~"), d.ends(c, "~>"), f"{n} < 10000")
    plain = both(
        f"NOT {d.starts(c, '@', '/', '+', ' ')}", f"NOT {d.ends(c, '=')}", f"NOT {d.match(c, '^[A-Z_0-9]+$')}", f"NOT {d.match(c, '(?i)(http|apple)')}", f"NOT {d.has(c, 'Authority', 'plist', 'version', ':*:')}",
        f"{d.pieces(c, '.')} <= 2", f"{d.count(c, '!-uz')} * 10 >= {n} * 9", f"NOT ({d.has(c, '+')} AND {d.has(c, '/')})",
    )
    return both(f"{n} >= 20", either(fenced, plain))


def url_encoded(d: Dialect, c: str) -> str:
    n = d.size(c)
    good = d.size(d.replace(d.replace(c, "%[0-9A-Fa-f]{2}", "\u0001"), "[^\u0001]"))
    control = d.size(d.replace(d.replace(c, "%(0[0-8BbCc]|0[EeFf]|1[0-9A-Fa-f]|7[Ff])", "\u0001"), "[^\u0001]"))
    printed = d.size(d.replace(d.replace(d.replace(c, f"%({PRINTABLE_PAIR})", "a"), "%[0-9A-Fa-f]{2}", "\u0001"), "[^!-~ \\t\\n\\r\\f]"))
    decoded = f"({n} - 2 * {good})"
    return both(f"{n} >= 12", d.has(c, "%"), f"{good} >= 2", f"NOT ({control} > 0 AND {control} * 2 >= {good})", f"{good} * 10 >= {d.pieces(c, '%')} * 7", f"{printed} * 10 > {decoded} * 6")


def env_var(d: Dialect, c: str) -> str:
    name = d.replace(c, "=$")
    return both(d.match(c, "^[A-Z][A-Z0-9_]{2,}=?$"), either(d.has(c, "_"), both(d.starts(c, "GO"), f"{d.size(name)} >= 4"), d.among(name, L.ENV_NAMES)))


def rules(d: Dialect, c: str) -> list[tuple[str | None, str]]:
    n = d.size(c)
    gate, address = email_rules(d, c)
    trimmed = d.replace(c, r"[ \t\n\x0b\f\r]+$")
    host, port = d.extract(trimmed, r"^(.*):([^:]*)$", 1), d.extract(trimmed, r"^(.*):([^:]*)$", 2)
    groups = d.match(trimmed, r"(^|:)[0-9A-Fa-f]{2,}(:|$)")
    ipv6 = both(
        f"{d.pieces(trimmed, ':')} >= 2", f"NOT ({d.match(trimmed, ':$')} AND NOT {d.match(trimmed, '::$')})", f"NOT {d.has(trimmed, ':::')}", f"NOT {d.match(trimmed, '::.*::')}",
        d.match(trimmed, "^[0-9A-Fa-f:.]+$"), groups,
    )
    special = f"({n} - {d.count(c, 'A-Za-z0-9 \\t\\n\\f\\r')})"
    path = d.starts(c, "/", "C:\\", "./", "../")
    no_path = either(both(d.starts(c, "/"), d.has(c, ":"), f"NOT {d.has(c, '://')}"), f"NOT {d.match(c, '[A-Za-z0-9]')}", f"{d.percent(special, n)} > 30")
    quoted = f"substr({c}, 2, length({c}) - 2)"
    injected = either(
        both(d.has(c, "; "), d.has(c, "cat", "wget", "curl")), both(d.has(c, "| "), d.has(c, "whoami", "id", "uname")), subshell(d, c),
        both(d.match(c, "^`(?s:.*)`$"), f"{n} >= 5", f"{d.percent(d.count(quoted, '\\x00-\\x7f'), d.size(quoted))} > 90", d.has(quoted, " ", "cat", "ls", "pwd", "echo", "wget", "curl")),
    )
    return [
        (None, f"{n} < 3"),
        ("CTFFlag", both(d.starts(c, *L.FLAG_STARTS), d.ends(c, "}"))),
        ("GUID", both(d.starts(c, "{"), d.ends(c, "}"), f"{n} BETWEEN 36 AND 38", f"{d.pieces(c, '-')} = 4", f"{d.count(c, '0-9A-Fa-f')} BETWEEN 30 AND 32")),
        ("GUID", d.match(c, "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$")),
        ("Hash", hash_value(d, c)),
        ("CryptoWallet", wallet(d, c)),
        ("Email", both(gate, address)),
        (None, both(gate, f"NOT {address}")),
        ("TorAddress", both(d.has(c, ".onion"), f"{n} >= 10")),
        ("JWT", both(f"{n} >= 50", d.match(c, r"^eyJ[A-Za-z0-9_=-]*\.[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+$"))),
        ("APIKey", api_key(d, c)),
        ("SQLInjection", both(either(d.has(c, "'", "-"), d.has(c, "UNION")), either(d.has(c, "' OR '", "1'='1", "admin'--"), both(d.has(c, "UNION"), d.has(c, "SELECT"))))),
        ("XSSPayload", either(both(d.has(c, "<script>"), d.has(c, "</script>")), both(d.has(c, "onerror="), d.has(c, "alert(")), d.starts(c, "javascript:"))),
        ("LDAPPath", either(d.has(c, "LDAP://"), both(d.has(c, "CN="), d.has(c, "DC=")))),
        ("Mutex", d.starts(c, "Global\\", "Local\\")),
        ("RansomNote", either(both(d.has(c, "ENCRYPTED", "DECRYPT", "RANSOM"), f"{d.percent(d.count(c, 'A-Z'), n)} > 50"), d.among(c, L.RANSOM_NAMES), d.ends(c, *L.RANSOM_ENDS))),
        ("MiningPool", both(either(d.starts(c, "s"), d.has(c, ":", "p")), either(d.has(c, "stratum+tcp://", "stratum+ssl://"), both(d.has(c, "pool.", "nanopool", "minergate"), d.has(c, ".com", ".org", ":"))))),
        (None, d.starts(c, "https://www.apple.com/appleca")),
        ("Url", d.starts(c, *L.URL_SCHEMES)),
        ("PhpCode", php_code(d, c)),
        ("PythonCode", python_code(d, c)),
        ("JavaScriptCode", javascript_code(d, c)),
        ("AppleScript", applescript(d, c)),
        ("CommandInjection", injected),
        ("ShellCmd", shell_command(d, c)),
        ("IPPort", both(d.match(c, "^[0-9]"), d.match(port, r"^\+?[0-9]+$"), f"{d.number(port)} BETWEEN 1 AND 65535", ipv4(d, host))),
        ("IP", both(d.match(c, "^[0-9]"), either(ipv4(d, trimmed), ipv6))),
        ("Registry", d.starts(c, *L.REGISTRY_STARTS)),
        ("FilePath", d.ends(c, *L.KNOWN_FILES)),
        (None, both(path, no_path)),
        ("SuspiciousPath", both(path, suspicious_path(d, c))),
        ("Path", path),
        (DEFER, both(f"{n} >= 20", f"{d.pieces(c, chr(92) + 'x')} + {d.pieces(c, chr(92) + 'u')} >= 5")),
        ("UrlEncoded", url_encoded(d, c)),
        ("HexEncoded", hex_encoded(d, c)),
        ("Base58", base58(d, c)),
        ("Base32", base32(d, c)),
        (DEFER, base85_gate(d, c)),
        (DEFER, base64_gate(d, c)),
        ("EnvVar", env_var(d, c)),
    ]


def prefix_rules(d: Dialect, c: str) -> list[tuple[str | None, str]]:
    """For values over LONG bytes: what their first PREFIX bytes say."""
    rooted = d.starts(c, "/", "./", "../")
    return [
        ("Url", d.starts(c, *L.URL_SCHEMES)), ("SuspiciousPath", both(rooted, suspicious_path(d, c))), ("Path", either(rooted, d.starts(c, "C:\\"))), ("Registry", both(d.match(c, "^[HS]"), d.starts(c, *L.REGISTRY_STARTS))),
        ("PhpCode", d.starts(c, "<?php")), ("ShellCmd", d.starts(c, "#!")), ("PythonCode", python_code(d, c)), ("JavaScriptCode", javascript_code(d, c)), ("ShellCmd", shell_command(d, c)),
    ]


def case(d: Dialect, table: list[tuple[str | None, str]]) -> str:
    arms = "\n".join(f"WHEN {test} THEN {'NULL' if kind is None else d.lit(kind)}" for kind, test in table)
    return f"CASE {arms} ELSE NULL END"


def kind_sql(d: Dialect, c: str = "value") -> str:
    """The kind of column c, DEFER where bytes have to be decoded. c is a plain column name.

    Short words of plain letters, the bulk of any text, meet no rule: one pattern sets them aside.
    """
    return f"CASE WHEN {d.match(c, '^[A-Za-z]?[a-z]{0,14}$')} THEN NULL WHEN {d.size(c)} > {LONG} THEN {case(d, prefix_rules(d, d.head(c, PREFIX)))} ELSE {case(d, rules(d, c))} END"
