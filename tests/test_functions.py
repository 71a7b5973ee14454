"""Scalar functions on the published cases."""

import shlex

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from endpointlens.functions import cmdline, detail, dns, ids, net, paths, text


def run(spark, fn, values, type_="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {type_}")
    got = rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in got]


def test_alert_id_golden(spark):
    row = spark.range(1).select(ids.alert_id(F.lit("t1"), F.lit("host-1"), F.lit("RULE_A"),
                                             F.lit(1000))).first()
    assert row[0] == "b5e40e20-dce7-3e32-bb6a-8f944d0559f7"


def test_temp_paths(spark):
    cases = {
        "/tmp/x": True, "/tmpx/y": False, "/users/me/downloads/a": True, "/users//downloads/a": False,
        "/private/tmp/a": True, "/app/tmp/a": False, "c:\\users\\u\\downloads\\e.exe": True,
        "\\users\\u\\appdata\\local\\temp\\e": True, "c:\\app\\temp\\x": False, "c:\\temp\\x": True,
        "/home/a/b/downloads/x": False,
    }
    assert run(spark, paths.is_temp_path, list(cases)) == list(cases.values())


def test_autorun_paths(spark):
    startup = "\\Microsoft\\Windows\\Start Menu\\Programs\\Startup\\x.lnk"
    cases = {
        "/Library/LaunchAgents/a.plist": True, "/Users/u/Library/LaunchAgents/a": True,
        "/dev/Library/LaunchAgents/a": False, "C:\\dev\\startup\\x": False,
        '"C:\\ProgramData' + startup + '"': True, "C:\\Users\\u\\AppData\\Roaming" + startup: True,
        "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run\\x": True, "": False,
    }
    assert run(spark, paths.is_autorun_path, list(cases)) == list(cases.values())


SILENT = [
    "/usr/bin/open -n /Applications/A.app --args --permission-status-file /var/folders/y0/T/s.json",
    "/usr/bin/find /private/var/tmp/videos -maxdepth 1 -name *.part -mmin -5",
    "/sbin/mount_apfs -o nobrowse /dev/disk1 /private/tmp/Sandbox/Root",
]


def test_executable_from_temp(spark):
    loud = ["/tmp/evil.sh a", '"/Users/me/Downloads/my tool" x', "'/tmp/a b' c", '"" /tmp/x']
    assert run(spark, cmdline.executable_from_temp, SILENT + loud) == [False] * 3 + [True] * 4


def test_path_arguments(spark):
    cases = {
        "/bin/zsh -c pwd -P >| /tmp/cwd && echo done": False,
        "/bin/zsh -c pwd -P >| /tmp/cwd && /tmp/evil.sh": True,
        "/bin/zsh -c true && /tmp/evil.sh": True,
        "/bin/bash -c ls ; /Users/me/Downloads/evil.sh": True,
        "/bin/zsh -c eval 'S=/private/tmp/x; grep a' < /dev/null && pwd >| /tmp/c": False,
        "powershell -File C:\\Program Files\\App\\run.ps1": False,
        "> > /tmp/x": True,
    }
    assert run(spark, cmdline.path_argument_from_temp, list(cases)) == list(cases.values())


def tokens_by_hand(s):
    out, token, quote = [], "", ""
    for ch in s:
        if quote:
            quote, token = ("", token) if ch == quote else (quote, token + ch)
        elif ch in "\"'":
            quote = ch
        elif ch.isspace():
            if token:
                out.append(token)
            token = ""
        else:
            token += ch
    return out + ([token] if token else [])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\"' \t>/", max_size=14), min_size=30, max_size=30))
def test_tokens_match_scan(spark, lines):
    assert run(spark, cmdline.tokenize, lines) == [tokens_by_hand(s) for s in lines]


@pytest.mark.parametrize("line,want", [
    ("net.exe user admin -Password s3 /add", "net.exe user admin -Password <redacted> /add"),
    ("tool.exe --password=hunter2 --verbose", "tool.exe --password=<redacted> --verbose"),
    ("tool.exe /Token:abc123", "tool.exe /Token:<redacted>"),
    ('tool.exe -Token "a b c" next', "tool.exe -Token <redacted> next"),
    ("tool.exe   -Token   abc", "tool.exe   -Token   <redacted>"),
    ("C:\\pass\\token.exe run", "C:\\pass\\token.exe run"),
    ("tool.exe -Password", "tool.exe -Password"),
])
def test_windows_redaction(spark, line, want):
    assert run(spark, cmdline.redact_windows, [line]) == [want]


def test_posix_redaction(spark):
    args = shlex.split("tool --api-key abc --token=x -k v --secret --secret last")
    got = run(spark, cmdline.redact_argv, [args], "array<string>")[0]
    assert got == shlex.split(
        "tool --api-key '<redacted>' --token='<redacted>' -k v --secret '<redacted>' last")


def test_detail_number_needs_a_number(spark):
    values = ['{"pid":12}', '{"pid":"12"}', '{"pid":1.5}', "{broken", "", '{"pid":null}']
    assert run(spark, lambda c: detail.detail_number(c, "pid"), values) == [
        12, None, 1, None, None, None]


def test_dns_helpers(spark):
    assert run(spark, dns.parse_answers, ["type:  5 a.b;1.2.3.4,", " ; ", "type: 5", "type:5x"]) == [
        ["a.b", "1.2.3.4"], None, None, ["5x"]]
    assert run(spark, dns.query_type_label, ["28", "999", "A"]) == ["AAAA", "999", "A"]
    assert run(spark, dns.is_reverse_name, ["1.in-addr.arpa", "xin-addr.arpa", "ip6.arpa"]) == [
        True, False, True]


def test_addresses(spark):
    cases = {"1.2.3.4": "1.2.3.4", "2001:DB8:0:0:1:0:0:1": "2001:db8::1:0:0:1",
             "::ffff:8.8.8.8": "8.8.8.8", "1:2:3": None, "256.1.1.1": None, "::": "::"}
    assert run(spark, net.canonical_ip, list(cases)) == list(cases.values())
    public = {"8.8.8.8": True, "10.1.1.1": False, "172.20.0.1": False, "172.32.0.1": True,
              "fe80::1": False, "fd00::1": False, "2001:4860::8888": True, "ff02::1": False,
              "example.com": False, "": False}
    assert run(spark, net.is_public_ip, list(public)) == list(public.values())


def test_watch_paths(spark):
    win = {"C:\\Users\\bob\\Startup\\x": True, "\\Device\\HarddiskVolume2\\users\\a\\startup": True,
           "C:\\Users\\a\\b\\Startup": False, "C:\\UsersX\\a\\Startup": False}
    assert run(spark, lambda c: paths.under_watch_windows(c, ["C:\\Users\\*\\Startup\\"]),
               list(win)) == list(win.values())
    assert run(spark, lambda c: paths.under_watch_posix(c, ["/a/b/"]), ["/a/b", "/a/b/c", "/a/bc"]
               ) == [True, True, False]


def test_action_targets(spark):
    rows = spark.createDataFrame([
        ("/tmp/evil -x", "/tmp/evil", True), ("/tmp/evil", "/opt/evil", False),
        ("evil.exe", "C:\\Evil.exe", True), ("", "/bin/a", False), ("a", "", False)],
        "t string, p string, want boolean")
    got = rows.select("want", cmdline.target_matches(F.col("t"), F.col("p"), True).alias("g"))
    assert all(r.want == r.g for r in got.collect())


def test_buckets_floor_below_zero(spark):
    assert run(spark, lambda c: text.bucket_floor(c, 3_600_000), [-1, 0, 3_600_001], "long") == [
        -3_600_000, 0, 3_600_000]


def test_status_never_contradicts_score(spark):
    mix = spark.range(6).selectExpr("id AS c").crossJoin(spark.range(6).selectExpr("id AS m"))
    score = text.risk_score(F.col("c"), F.lit(0), F.col("m"), F.lit(0))
    for r in mix.select(score.alias("s"), text.host_status(score).alias("t")).collect():
        assert r.t == ("critical" if r.s >= 25 else "warning" if r.s >= 10 else "healthy")
