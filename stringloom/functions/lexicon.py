"""Names, priorities and word lists that results depend on."""

from __future__ import annotations

# Provenance methods: (name, priority when rows of an offset are deduplicated, priority on display).
METHODS = (
    ("Structure", 3, 3), ("StackString", 3, 3), ("XorStackPair", 3, 3), ("InstructionPattern", 3, 3), ("XorDecode", 3, 2), ("Base64Decode", 3, 2),
    ("Base32Decode", 3, 2), ("Base85Decode", 3, 2), ("HexDecode", 3, 2), ("UrlDecode", 3, 2), ("UnicodeEscapeDecode", 3, 2), ("Utf16LeDecode", 3, 2),
    ("Utf16BeDecode", 3, 2), ("ScriptDecode", 3, 2), ("R2String", 2, 2), ("R2Symbol", 2, 2), ("WideString", 2, 2), ("SpacedAscii", 2, 0),
    ("CodeSignature", 2, 2), ("PclntabSymbol", 2, 2), ("Heuristic", 1, 1), ("RawScan", 0, 0), ("Base64ObfuscatedDecode", 0, 3),
)

# Severity of each kind; a row without a kind is Info.
SEVERITY = {
    "High": (
        "IP", "IPPort", "Hostname", "Url", "ShellCmd", "SuspiciousPath", "Base64", "HexEncoded", "UnicodeEscaped", "UrlEncoded", "Base32", "Base58", "Base85", "Overlay", "OverlayWide", "StackString", "Entitlement",
        "AppId", "XorKey", "CryptoWallet", "MiningPool", "Email", "TorAddress", "CTFFlag", "SQLInjection", "XSSPayload", "CommandInjection", "JWT", "APIKey", "Mutex", "GUID", "Hash", "RansomNote", "LDAPPath",
    ),
    "Medium": ("Path", "FilePath", "Import", "EnvVar", "Registry", "Error", "Section", "EntitlementsXml"),
    "Low": ("FuncName", "Export"),
    "Info": ("MapKey", "Arg", "Ident", "Garbage", "CodeSignatureHash", "AppleScript", "PythonCode", "JavaScriptCode", "PhpCode", "PowerShellCode"),
}
SEVERITIES = ("High", "Medium", "Low", "Info")

# Order of rows in the notable summary; kinds of severity High that are not named come last.
NOTABLE_ORDER = (("IP", 0), ("IPPort", 0), ("ShellCmd", 1), ("SuspiciousPath", 1), ("Base64", 2), ("Overlay", 3), ("OverlayWide", 3), ("Url", 4))

FLAG_STARTS = ("CTF{", "flag{", "FLAG{", "picoCTF{", "HTB{")
URL_SCHEMES = ("http://", "https://", "ftp://", "postgresql://", "mysql://", "redis://", "mongodb://", "ssh://", "tcp://", "udp://")
RANSOM_NAMES = (".locked", ".encrypted", ".crypted", ".wannacry", ".ryuk", ".locky")
RANSOM_ENDS = ("-DECRYPT-INSTRUCTIONS.txt", "HOW-TO-DECRYPT.html")
REGISTRY_STARTS = (
    "HKEY_", "HKLM\\", "HKCU\\", "HKCR\\", "HKU\\", "HKCC\\", "SOFTWARE\\", "SYSTEM\\", "Software\\Microsoft\\", "Software\\Wow6432Node\\", "Software\\Classes\\", "Software\\Policies\\", "Software\\JavaSoft\\",
    "Software\\Clients\\", "Software\\WOW6432Node\\", "Software\\Mozilla\\", "Software\\Google\\", "System\\CurrentControlSet\\", "System\\Setup\\", "SAM\\", "SECURITY\\",
)
KNOWN_FILES = (
    ".DS_Store", ".localized", ".bashrc", ".zshrc", ".profile", ".bash_profile", ".gitignore", ".gitconfig", ".ssh/", ".aws/", ".docker/",
    "authorized_keys", "id_rsa", "id_ed25519", "known_hosts", ".npmrc", ".yarnrc", "package.json", "Cargo.toml", "go.mod", "requirements.txt",
)
PUBLIC_RESOLVERS = ("8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "9.9.9.9", "4.2.2.1", "4.2.2.2", "208.67.222.222", "208.67.220.220")
ENV_NAMES = (
    "PATH", "HOME", "USER", "SHELL", "TERM", "LANG", "PWD", "TMP", "TEMP", "TMPDIR", "EDITOR", "PAGER", "MAIL", "LOGNAME", "HOSTNAME", "DISPLAY", "TZ", "UID", "GID", "EUID", "EGID",
    "COLUMNS", "LINES", "COLORTERM", "CLICOLOR", "LSCOLORS", "CC", "CXX", "CFLAGS", "CXXFLAGS", "LDFLAGS", "MAKE", "AR", "AS", "LD", "NM", "RANLIB", "STRIP",
    "PYTHONPATH", "RUBYLIB", "DEBUG", "VERBOSE", "TRACE", "APPDATA", "LOCALAPPDATA", "PROGRAMFILES", "SYSTEMROOT", "WINDIR", "USERPROFILE", "COMPUTERNAME",
)

APPLESCRIPT_PHRASES = (
    "tell application", "path to desktop", "path to documents", "every file of", "whose name extension", "posix file", "end tell", "do shell script", " dialog",
    "choose file", "choose folder", "duplicate ", " to posix file", "repeat with", "end repeat", " as alias", " with replacing", "set volume",
)
APPLESCRIPT_STEMS = ("tell", "path", "file", "end ", "set ", "with", "shel", "dial", "alia")
PYTHON_TRIGGERS = (
    "import ", "from ", "def ", "class ", "exec(", "eval(", "__import__", "subprocess", "getattr(", "lambda ", "sys.", "os.path", "os.system", "os.environ", "os.name", "os.getcwd", "__name__",
)
OTHER_LANGUAGE_PACKAGES = ("android.", "java.", "javax.", "kotlin.", "com.google.", "org.apache.")
MARKUP = ("<script", "</script", "<style", "</style", "<template", "</template", "<svelte:", "<div", "</div", "<span", "</span", "<button", "</button", " class=", 'class="', "class='")
SCRIPT_TRIGGERS = ("function ", "const ", "let ", "var ", "require(", "document.", "window.", "console.log", "=>")
SHELL_STARTS = ("#!/bin/bash", "#!/bin/sh", "#!/bin/zsh", "#!/bin/dash", "#!/bin/ksh")
SHELL_ERROR_WORDS = ("Error", "error", "Failed", "Could not", "Unable to", "Cannot", "Invalid", "Unsupported", "not supported", "not found", "access", "service", "[Click", "prompt")
SHELL_COMPARISONS = ("!=", "==", "<=", ">=")
SHELL_REDIRECTS = (">/dev/null", "2>/dev/null", "2>&1")
SHELL_PIPES = ("grep", "awk", "sed", "sort", "uniq", "head", "tail", "cat ", "xargs", "wc ", "cut ", "tr ")
SHELL_COMMANDS = (
    "sed ", "rm ", "kill ", "chmod ", "chown ", "wget ", "curl ", "bash ", "sh ", "/bin/sh", "/bin/bash", "nc ", "ncat ", "python ", "perl ", "ruby ", "php ", "echo ", "cat ", "mkdir ", "cp ", "mv ",
    "touch ", "tar ", "gzip ", "gunzip ", "base64 ", "openssl ", "dd ", "mount ", "umount ", "iptables ", "systemctl ", "crontab ", "useradd ", "userdel ", "passwd ", "sudo ", "su ", "chroot ",
    "nohup ", "setsid ", "eval ",
)
SERVICE_ACTIONS = ("start", "stop", "restart", "status", "enable", "disable")
SUBSHELL_STARTS = ("whoami", "id", "pwd", "hostname", "uname")

METADATA_HOSTS = (
    "curl.haxx.se", "ns.adobe.com", "schemas.microsoft.com", "schemas.openxmlformats.org", "www.apple.com", "crl.microsoft.com", "github.com", "go.dev", "www.microsoft.com", "www.openssl.org", "www.w3.org",
)
METADATA_DOMAINS = ("digicert.com", "symcb.com", "symauth.com", "verisign.com")
METADATA_METHODS = ("RawScan", "Heuristic", "InstructionPattern", "Structure", "R2String", "WideString")
SYSTEM_PATHS = (
    "/bin/bash", "/bin/cat", "/bin/dash", "/bin/echo", "/bin/false", "/bin/ls", "/bin/sh", "/bin/true", "/bin/zsh", "/dev/egd-pool", "/dev/null", "/dev/random", "/dev/srandom", "/dev/stderr", "/dev/stdin", "/dev/stdout", "/dev/tty",
    "/dev/ubskey", "/dev/urandom", "/etc/egd-pool", "/etc/entropy", "/etc/apache/mime.types", "/etc/apache2/mime.types", "/etc/group", "/etc/hosts", "/etc/httpd/conf/mime.types", "/etc/mdns.allow", "/etc/mime.types",
    "/etc/nsswitch.conf", "/etc/passwd", "/etc/pki/tls/certs/ca-bundle.crt", "/etc/pki/ca-trust/extracted/pem/tls-ca-bundle.pem", "/etc/pki/tls/cacert.pem", "/etc/pki/tls/certs", "/etc/protocols", "/etc/resolv.conf",
    "/etc/services", "/etc/ssl/ca-bundle.pem", "/etc/ssl/cert.pem", "/etc/ssl/certs", "/etc/ssl/certs/ca-certificates.crt", "/etc/zoneinfo", "/lib/time/zoneinfo.zip", "/lib64/ld-linux-x86-64.so.2", "/proc/meminfo",
    "/proc/self/auxv", "/proc/sys/kernel/hostname", "/proc/sys/net/core/somaxconn", "/system/etc/security/cacerts", "/usr/bin/bash", "/usr/bin/curl", "/usr/bin/env", "/usr/bin/false", "/usr/bin/perl", "/usr/bin/python",
    "/usr/bin/python3", "/usr/bin/ruby", "/usr/bin/sh", "/usr/bin/true", "/usr/bin/wget", "/usr/bin/zsh", "/usr/bin/ntlm_auth", "/usr/lib/dyld", "/usr/local/share/mime/globs2", "/usr/share/mime/globs2", "/var/run/egd-pool",
    "c:\\windows\\explorer.exe", "c:\\windows\\notepad.exe", "c:\\windows\\system32\\cmd.exe", "c:\\windows\\system32\\powershell.exe", "c:\\windows\\system32\\rundll32.exe",
)
SYSTEM_PATH_STARTS = ("/dev/", "/root/go/", "/System/Library/Frameworks/", "/root/openssl-prefix/", "/sys/kernel/mm/")
SYSTEM_PATH_PARTS = ("/.cargo/registry/src/", "/lib/rustlib/src/")
SOURCE_ENDS = (".c", ".cc", ".cpp", ".cxx", ".go", ".h", ".hh", ".hpp", ".java", ".m", ".mm", ".rs", ".swift")
BUILD_ENDS = (*SOURCE_ENDS, ".js", ".py", ".ts")
BUILD_TREES = ("/src/", "/include/", "/node_modules/", "/vendor/", "/go/pkg/mod/", "/rustc/")

# Kinds that a string behind a file's own end keeps; the others become Overlay or OverlayWide.
OVERLAY_KEPT = (
    "Base32", "Base58", "Base64", "Base85", "CryptoWallet", "MiningPool", "IP", "IPPort", "Hostname", "Url", "Email", "TorAddress", "ShellCmd", "SuspiciousPath",
    "XorKey", "HexEncoded", "APIKey", "JWT", "CTFFlag",
)
