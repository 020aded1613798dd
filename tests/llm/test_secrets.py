import hashlib
import re
import time

from inkwell.llm import secrets

BASE = (("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+"))


def plain(text):
    out = []
    for k, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, text or "", re.ASCII):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 12, "access": 18, "hex": 16}[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)


def test_query_against_plain_scan(spark, documents, odd, none):
    more = spark.createDataFrame([(900, "PASSWORD: 'hunter2hunter2' token=short token: token=abcdefghijkl É AKIA" + "A" * 14 + " 0123456789abcdef0"),
                                  (901, "xAKIAB AKIA" + "Z" * 20 + "é api_key=\"a.b-c_d=e/f+g\" ApiKey : zzzzzzzzzzzz"), (902, "ſecret = abcdefghijklmnop toKen = abcdefghijklmnop")], "doc_id long, text string")
    rows = documents.select("doc_id", "text").union(more).union(odd.select("doc_id", "text"))
    got = secrets.digest(secrets.find_secrets(rows)).collect()
    want = sorted((str(r[0]), plain(r[1])) for r in rows.collect())
    assert sorted((str(r.doc_id), r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == sorted(
        (i, hashlib.sha256(told(s).encode()).hexdigest(), *(sum(k == j for _, k, _ in s) for j in range(3))) for i, s in want)
    assert secrets.find_secrets(none).count() == 0


def test_queries_hold_for_every_match():
    """No candidate is missed: a text with a match meets the rule's trigram query."""
    seen = {"assign": b"Api_Key='abcdefghijkl'", "access": b"AKIA" + b"X" * 16, "github": b"ghp_" + b"a" * 36, "slack": b"xoxb-1234567890", "google": b"AIza" + b"b" * 35,
            "jwt": b"eyJaaaaaaaa.eyJbbbbbbbb.cccccccc", "private_key": b"-----BEGIN RSA PRIVATE KEY-----", "url_login": b"https://me:pw@host", "bearer": b"Bearer abcdefghijklmnopqrst", "hex": b"0123456789abcdef"}
    rules = secrets.Rules()
    found = rules.scan(list(seen.values()))
    for kind, spans in zip(seen, found):
        assert kind in {secrets.RULES[k][0] for _, k, _ in spans}
    assert secrets.trigram_query(rb"[0-9a-f]{16,}") is True
    assert secrets.trigram_query(rb"abcd") == ("and", frozenset({b"abc", b"bcd"}))
    assert secrets.trigram_query(rb"(abc|x?bcd)+") == ("or", frozenset({b"abc", b"bcd", ("and", frozenset({b"xbc", b"bcd"}))}))
    assert rules.scan([b"nothing here", b""]) == [[], []]


def test_added_kinds_at_their_edges():
    """Just long enough and just too short; with something before and after."""
    rules = secrets.Rules()
    kinds = lambda text: [(secrets.RULES[k][0], a, z) for a, k, z in rules.scan([text])[0] if k >= secrets.BASE]
    a = lambda n: b"g" * n
    for text, want in (
            (b"ghp_" + a(36), ("github", 0, 40)), (b"ghp_" + a(35), None), (b"ghx_" + a(40), None), (b"x ghs_" + a(36) + b" y", ("github", 2, 42)),
            (b"xoxb-" + a(10), ("slack", 0, 15)), (b"xoxb-" + a(9), None), (b"xoxz-" + a(20), None),
            (b"AIza" + a(35), ("google", 0, 39)), (b"AIza" + a(34), None), (b"AIza" + a(50), ("google", 0, 39)),
            (b"eyJ" + a(8) + b".eyJ" + a(8) + b"." + a(8), ("jwt", 0, 32)), (b"eyJ" + a(8) + b".eyJ" + a(8) + b"." + a(7), None), (b"eyJ" + a(7) + b".eyJ" + a(8) + b"." + a(8), None),
            (b"xeyJ" + a(8) + b".eyJ" + a(8) + b"." + a(8), None), (b"eyJ" + a(9) + b".eyJ" + a(9) + b".eyJ" + a(9) + b"." + a(8), ("jwt", 0, 38)),
            (b"-----BEGIN PRIVATE KEY-----", ("private_key", 0, 27)), (b"-----BEGIN EC PRIVATE KEY-----", ("private_key", 0, 30)), (b"-----BEGIN PUBLIC KEY-----", None),
            (b"ftp://me:pw@h", ("url_login", 3, 12)), (b"ftp://me@h", None), (b"ftp://h/me:pw@x", None),
            (b"Bearer " + a(20), ("bearer", 0, 27)), (b"Bearer " + a(19), None), (b"BEARER   " + a(20), ("bearer", 0, 29))):
        assert kinds(text) == ([want] if want else []), text


def test_time_grows_with_length():
    rules = secrets.Rules()
    for unit in (b"eyJ", b"eyJabcdefgh.", b"ghp_", b"xoxb-", b"AIza", b"://a", b"://a:", b"bearer ", b"token ", b"-----BEGIN A ", b"A ", b"password=", b"AKIA", b"0a"):
        began = time.perf_counter()
        rules.scan([unit * (2_000_000 // len(unit))])
        assert time.perf_counter() - began < 5, unit


def test_redact():
    assert secrets.redact("a bcd e", [{"start": 2, "end": 5}, {"start": 3, "end": 4}]) == "a [secret] e"
    assert secrets.redact(None, []) is None
