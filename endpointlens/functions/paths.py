"""Path classification: temp/download, autorun, watch lists."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import jtrim

# Lower-case path families. One non-empty segment stands for the user.
_TEMP_POSIX = r"^/(?:tmp/|private/tmp/|var/folders/|users/[^/]+/downloads/|home/[^/]+/downloads/)"
_TEMP_WINDOWS = (r"^(?:\p{L}:)?\\(?:temp\\|windows\\temp\\"
                 r"|users\\[^\\]+\\(?:appdata\\local\\temp\\|downloads\\))")
_AUTORUN_POSIX = (r"^/(?:library/launchagents/|library/launchdaemons/"
                  r"|system/library/launchagents/|users/[^/]+/library/launchagents/)")
_STARTUP = r"microsoft\\windows\\start menu\\programs\\startup\\"
_AUTORUN_WINDOWS = (r"^(?:\p{L}:)?\\(?:users\\[^\\]+\\appdata\\roaming\\" + _STARTUP
                    + r"|programdata\\" + _STARTUP + ")")
_RUN_KEY = "\\software\\microsoft\\windows\\currentversion\\run"

# Any temp path has one of these in it; lets most command lines skip tokenising.
TEMP_HINT = r"(?i)tmp/|/var/folders/|downloads|\\temp\\"


def is_temp_path(p: Column) -> Column:
    """Expects lower case."""
    return F.coalesce(p.rlike(f"{_TEMP_POSIX}|{_TEMP_WINDOWS}"), F.lit(False))


def is_autorun_path(path: Column) -> Column:
    p = F.replace(jtrim(F.lower(path)), F.lit('"'), F.lit(""))
    hit = p.rlike(f"{_AUTORUN_POSIX}|{_AUTORUN_WINDOWS}") | F.contains(p, F.lit(_RUN_KEY))
    return F.coalesce(hit, F.lit(False))


def expand_home(path: str, home: str) -> str:
    if home and path == "~":
        return home
    if home and path.startswith("~/"):
        return re.sub(r"/+", "/", f"{home}/{path[2:]}").rstrip("/")
    return path


def expand_home_column(path: Column, home: str) -> Column:
    joined = F.rtrim(F.regexp_replace(F.concat(F.lit(home + "/"), F.substr(path, F.lit(3))),
                                      "/+", "/"), F.lit("/"))
    return (F.when(F.lit(home == ""), path).when(path == "~", F.lit(home))
            .when(path.startswith("~/"), joined).otherwise(path))


def under_watch_posix(path: Column, watch_paths: list[str]) -> Column:
    """Equal to a watched folder or below it."""
    hit = F.lit(False)
    for w in (w[:-1] if w.endswith("/") else w for w in watch_paths):
        if w:
            hit = hit | (path == w) | path.startswith(w + "/")
    return F.coalesce(hit & (path != ""), F.lit(False))


_DEVICE = r"^\\device\\harddiskvolume[0-9]+"


def normalize_windows_path(path: Column) -> Column:
    p = F.replace(F.lower(jtrim(path)), F.lit("/"), F.lit("\\"))
    p = F.regexp_replace(p, r"^\\\?\?\\", "")
    return F.when(p.rlike(_DEVICE), F.regexp_replace(p, _DEVICE, "")).otherwise(
        F.regexp_replace(p, "^[a-z]:", ""))


def _normalize_windows_literal(p: str) -> str:
    p = p.strip().lower().replace("/", "\\")
    p = p[4:] if p.startswith("\\??\\") else p
    device = re.match(_DEVICE, p)
    if device:
        return p[device.end():]
    return re.sub(r"^[a-z]:", "", p)


def watch_pattern_windows(watch_paths: list[str]) -> str:
    """Regex over normalised paths; `*` stands for exactly one path segment."""
    patterns = []
    for w in watch_paths:
        prefix = _normalize_windows_literal(w)
        if not prefix:
            continue
        prefix = prefix[:-1] if prefix.endswith("\\") else prefix
        segments = [r"[^\\]*" if s == "*" else re.escape(s) for s in prefix.split("\\")]
        patterns.append(r"\\".join(segments))
    return r"(?s)^(?:" + "|".join(patterns) + r")(?:\\.*)?$" if patterns else "(?!)"


def under_watch_windows(path: Column, watch_paths: list[str]) -> Column:
    p = normalize_windows_path(path)
    return F.coalesce((p != "") & p.rlike(watch_pattern_windows(watch_paths)), F.lit(False))
