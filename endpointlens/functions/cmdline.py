"""Command-line tokens, executable checks and secret redaction."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import TEMP_HINT, is_temp_path
from .text import basename, has_separator, jtrim

# Unicode whitespace without the no-break spaces.
_WS = r"\s\x1C-\x1F\u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000"
_TOKEN = rf"""(?:[^{_WS}"']|"[^"]*(?:"|$)|'[^']*(?:'|$))+"""
_FIRST = rf"""^(?:[{_WS}]|""|'')*({_TOKEN})"""
_QUOTED = r""""([^"]*)(?:"|$)|'([^']*)(?:'|$)"""

# Shell punctuation.
REDIRECTIONS = (">", ">>", ">|", "<")
SEPARATORS = ("|", "||", "&&", ";", "&")

# Secret words and the mask.
POSIX_SECRET_WORDS = ("password", "passwd", "token", "secret", "apikey", "accesskey", "credential")
WINDOWS_SECRET_FLAGS = ("password", "passwd", "pass", "token", "secret", "apikey", "credential",
                        "encodedcommand", "encoded", "enc")
MASK = "<redacted>"

# Interpreters per platform.
POSIX_INTERPRETERS = ("sh", "bash", "zsh", "osascript", "perl", "ruby", "node")
WINDOWS_INTERPRETERS = ("powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe",
                        "node.exe")


def _unquote(token: Column) -> Column:
    return F.regexp_replace(token, _QUOTED, "$1$2")


def tokenize(cmdline: Column) -> Column:
    """Whitespace split that keeps quoted regions together and drops the quote marks."""
    raw = F.regexp_extract_all(cmdline, F.lit(_TOKEN), F.lit(0))
    return F.filter(F.transform(raw, _unquote), lambda t: t != "")


def first_token(cmdline: Column) -> Column:
    return _unquote(F.regexp_extract(cmdline, _FIRST, 1))


def executable_from_temp(cmdline: Column) -> Column:
    """The executed file itself lies in a temp or download path."""
    return F.coalesce(cmdline.rlike(TEMP_HINT) & is_temp_path(first_token(F.lower(cmdline))),
                      F.lit(False))


def path_argument_from_temp(cmdline: Column) -> Column:
    """Some token other than a redirection target is a temp or download path."""
    start = F.struct(F.lit(False).alias("skip"), F.lit(False).alias("hit"))

    def step(acc, token):
        redirect = ~acc["skip"] & token.isin(*REDIRECTIONS)
        counts = ~acc["skip"] & ~token.isin(*REDIRECTIONS, *SEPARATORS)
        return F.struct(redirect.alias("skip"),
                        (acc["hit"] | (counts & is_temp_path(token))).alias("hit"))

    folded = F.aggregate(tokenize(F.lower(cmdline)), start, step)
    return F.coalesce(cmdline.rlike(TEMP_HINT) & folded["hit"], F.lit(False))


def is_interpreter_posix(path: Column) -> Column:
    base = basename_posix(path)
    return base.isin(*POSIX_INTERPRETERS) | base.startswith("python")


def is_interpreter_windows(path: Column) -> Column:
    base = F.lower(basename(path))
    return base.isin(*WINDOWS_INTERPRETERS) | (base.startswith("python") & base.endswith(".exe"))


def basename_posix(path: Column) -> Column:
    return F.regexp_replace(path, "(?s)^.*/", "")


def _posix_secret(flag: Column) -> Column:
    name = F.regexp_replace(F.lower(flag), "[-_]", "")
    return name.rlike("|".join(POSIX_SECRET_WORDS))


def redact_argv(args: Column) -> Column:
    """`--flag value` and `--flag=value`; the first element is never touched."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))

    def step(acc, tok):
        flag = (F.size(acc["out"]) > 0) & ~acc["hide"] & tok.startswith("-")
        has_value = F.contains(tok, F.lit("="))
        name = F.regexp_extract(tok, "(?s)^([^=]*)", 1)
        shown = (F.when(acc["hide"], F.lit(MASK))
                 .when(flag & has_value & _posix_secret(name),
                       F.concat(name, F.lit("=" + MASK)))
                 .otherwise(tok))
        return F.struct(F.concat(acc["out"], F.array(shown)).alias("out"),
                        (flag & ~has_value & _posix_secret(tok)).alias("hide"))

    return F.aggregate(args, start, step)["out"]


def posix_cmdline(exe: Column, args: Column) -> Column:
    """Redacted argv joined by blanks, with the executable path in first place."""
    argv = redact_argv(args)
    rest = F.slice(argv, F.lit(2), F.greatest(F.size(argv) - 1, F.lit(0)))
    return F.when(args.isNull() | (F.size(args) == 0), exe).otherwise(
        F.array_join(F.concat(F.array(exe), rest), " "))


_WIN_TEXT = r"""(?:"[^"]*(?:"|$)|[^ \t"])*"""
_WIN_PIECE = rf"({_WIN_TEXT})([ \t]*)"


def redact_windows(cmdline: Column) -> Column:
    """`-Password x`, `/token:x`, `--password=x`; the spacing stays as it was."""
    texts = F.regexp_extract_all(cmdline, F.lit(_WIN_PIECE), F.lit(1))
    gaps = F.regexp_extract_all(cmdline, F.lit(_WIN_PIECE), F.lit(2))
    pieces = F.filter(
        F.zip_with(texts, gaps, lambda t, g: F.struct(t.alias("text"), g.alias("gap"))),
        lambda p: (p["text"] != "") | (p["gap"] != ""))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("hide"))

    def step(acc, p):
        tok = p["text"]
        name = F.lower(F.regexp_extract(tok, r"(?s)^[-/]+([^=:]*)", 1))
        secret = ~acc["hide"] & name.isin(*WINDOWS_SECRET_FLAGS)
        has_value = tok.rlike(r"(?s)^[-/]+[^=:]*[=:]")
        shown = (F.when(acc["hide"], F.lit(MASK))
                 .when(secret & has_value,
                       F.concat(F.regexp_extract(tok, r"(?s)^([-/]+[^=:]*[=:])", 1), F.lit(MASK)))
                 .otherwise(tok))
        return F.struct(F.concat(acc["out"], shown, p["gap"]).alias("out"),
                        (secret & ~has_value).alias("hide"))

    return F.aggregate(pieces, start, step)["out"]


def with_argv0(cmdline: Column, exe: Column) -> Column:
    """First token replaced by the full executable path when one is known."""
    return F.when(has_separator(exe),
                  F.concat(exe, F.regexp_replace(cmdline, "^" + _WIN_TEXT, ""))).otherwise(cmdline)


def target_matches(target: Column, proc_path: Column, fold_case: bool) -> Column:
    """Would an action on `target` hit the process at `proc_path`?"""
    wanted = F.regexp_extract(jtrim(target), r"^([^ \t]*)", 1)
    actual = proc_path
    if fold_case:
        wanted, actual = F.lower(wanted), F.lower(actual)
    same = F.when(has_separator(wanted), wanted == actual).otherwise(wanted == basename(actual))
    return F.coalesce((wanted != "") & (actual != "") & same, F.lit(False))


def target_key(target: Column, fold_case: bool) -> Column:
    """Equi-join form of `target_matches`: the first token of the target."""
    wanted = F.regexp_extract(jtrim(target), r"^([^ \t]*)", 1)
    return F.lower(wanted) if fold_case else wanted
