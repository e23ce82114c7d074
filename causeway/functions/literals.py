"""Column predicates over string literals: sensitive paths and suspicious shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.functions.blank import BLANK

#: Hosts of the official index (fixed values).
INDEX_HOSTS = ("pypi.org", "files.pythonhosted.org", "test.pypi.org")
#: What stands for the home directory in front of a path (fixed values).
HOME_PREFIXES = ("~/", "$HOME/", "${HOME}/", "%USERPROFILE%/")
#: Literals that are a home directory or the root (fixed values).
HOME_OR_ROOT = ("", "~", "$HOME", "${HOME}", "%USERPROFILE%", "/home", "/root", "/Users")
SHELLS = ("sh", "bash", "zsh", "python", "python3")


def trimmed(v: Column) -> Column:
    return F.regexp_replace(v, rf"^{BLANK}+|{BLANK}+$", "")


def normalised(v: Column) -> Column:
    return F.translate(trimmed(v), "\\", "/")


def without_home(v: Column) -> Column:
    return F.regexp_replace(v, r"^(?:~|\$HOME|\$\{HOME\}|%USERPROFILE%)/", "")


def path_under(path: Column, prefix: str) -> Column:
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/"))


def sensitive_path(pattern: str, v: Column) -> Column:
    """M-07: a home-relative pattern is the path below home or what lies under it; others also end paths."""
    v = normalised(v)
    if pattern.startswith("~/"):
        return path_under(without_home(v), pattern[2:])
    return path_under(v, pattern) | F.endswith(v, F.lit("/" + pattern))


def url_not_index(v: Column) -> Column:
    """M-08: a whole literal that is a URL, no template, of a host that is not the index."""
    host = F.lower(F.regexp_extract(trimmed(v), r"^(?:https?|ftp)://(?:[^/?#]*@)?([^/?#:@]*)", 1))
    return ~F.contains(v, F.lit("{")) & (host != "") & ~host.isin(*INDEX_HOSTS)


def command_with_url(v: Column) -> Column:
    """M-09: such a URL among at least two words."""
    words = F.filter(F.split(v, rf"{BLANK}+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"""^["'`]+|["'`]+$""", ""))
    return (F.size(words) >= 2) & F.exists(bare, url_not_index)


def raw_ip(v: Column) -> Column:
    """M-10: an IPv4 address, perhaps with a port, neither loopback nor unspecified."""
    host = F.regexp_replace(trimmed(v), r":[0-9]+$", "")
    parts = F.split(host, r"\.")
    fits = host.rlike(r"^\+?[0-9]{1,3}(?:\.\+?[0-9]{1,3}){3}$") & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(256)) <= 255))
    return fits & ~F.startswith(host, F.lit("127.")) & (host != "0.0.0.0")


def shell_pipeline(v: Column) -> Column:
    """M-11: a download piped into a shell, or a shell's network device."""
    low = F.lower(v)
    segments = F.split(low, r"\|")
    program = lambda s: F.regexp_extract(s, rf"^{BLANK}*(?:\S*/)?([^\s/]*)", 1)
    piped = F.exists(F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: program(s).isin(*SHELLS))
    fetches = F.contains(low, F.lit("curl ")) | F.contains(low, F.lit("wget "))
    return (fetches & piped) | F.contains(low, F.lit("/dev/tcp/"))


def wallet_address(v: Column) -> Column:
    """M-12."""
    return trimmed(v).rlike(r"^(?:[13][1-9A-HJ-NP-Za-km-z]{25,34}|bc1[a-z0-9]{11,71}|0x[0-9a-fA-F]{40})$")


def home_or_root(v: Column) -> Column:
    """M-13."""
    v = normalised(v)
    cut = F.regexp_replace(v, "/+$", "")
    return (v != "") & (cut.rlike("^[A-Za-z]:$") | cut.isin(*HOME_OR_ROOT))


def escape_encoded(v: Column) -> Column:
    """M-15: at least four printable characters, and half of all, are spelt as escapes.

    Escapes are taken left to right; what is not part of one counts byte by byte.
    """
    tokens = F.regexp_extract_all(v, F.lit(r"\\x[\s\S]{2}|\\u[\s\S]{4}|\\[0-7]{1,3}|\\[\s\S]|[\s\S]"), F.lit(0))

    def code(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^\\x[0-9a-fA-F]{2}$"), F.conv(F.substring(t, 3, 2), 16, 10))
            .when(t.rlike(r"^\\u\+?[0-9a-fA-F]+$") & (F.length(t) == 6), F.conv(F.ltrim(F.substring(t, 3, 4), F.lit("+")), 16, 10))
            .when(t.rlike(r"^\\[0-7]+$"), F.conv(F.substring(t, 2, 3), 8, 10))
            .cast("int")
        )

    good = F.size(F.filter(tokens, lambda t: F.coalesce(code(t).between(0x20, 0x7E), F.lit(False))))
    all_ = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + F.when(F.startswith(t, F.lit("\\")), 1).otherwise(F.octet_length(t)))
    return (good >= 4) & (good * 2 >= all_)


LITERAL_SHAPES = {
    "<literal:url-not-index>": url_not_index,
    "<literal:command-with-url>": command_with_url,
    "<literal:raw-ip>": raw_ip,
    "<literal:shell-pipeline>": shell_pipeline,
    "<literal:wallet-address>": wallet_address,
    "<literal:home-or-root-path>": home_or_root,
}


def literal_matches(kind: str, pattern: str, v: Column) -> Column:
    """M-16."""
    if kind == "sensitive_file":
        return sensitive_path(pattern, v)
    if kind == "suspicious_literal" and pattern in LITERAL_SHAPES:
        return LITERAL_SHAPES[pattern](v)
    return F.lit(False)


def written_location(pattern: str, literals: Column, site_dir: Column) -> Column:
    """M-18: whether a file built from ``literals`` is the place named; ``site_dir``: a name of a site directory took part."""
    cleaned = F.transform(literals, normalised)
    if pattern == "site-packages/*.pth":
        inside = lambda v: F.contains(v, F.lit("site-packages")) | F.contains(v, F.lit("dist-packages"))
        return F.exists(cleaned, lambda v: F.endswith(v, F.lit(".pth"))) & (site_dir | F.exists(cleaned, inside))
    if pattern.startswith("/"):
        return F.exists(cleaned, lambda v: F.startswith(v, F.lit(pattern)))
    below = pattern.removeprefix("~/")

    def at(v: Column) -> Column:
        rest = without_home(v)
        return path_under(rest, below) | F.endswith(rest, F.lit("/" + below)) | F.contains(rest, F.lit(f"/{below}/"))

    return F.exists(cleaned, at)


def official_index(url: Column) -> Column:
    """M-20: https, no user information, host exactly one of the index's."""
    authority = F.regexp_extract(url, r"^https://([^/?#]*)", 1)
    host = F.regexp_extract(authority, "^([^:]*)", 1)
    return ~F.contains(authority, F.lit("@")) & host.isin(*INDEX_HOSTS)
