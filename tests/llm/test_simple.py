import hashlib
import random
import re

from syllaspark.llm import exact_dedup as X
from syllaspark.llm import url_filter as U
from syllaspark.llm import warc_audit as W


def test_exact_dedup(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a b", "ab", " a b\n", "é", "日 本", "", None, "\t", "x" * 5000])) for i in range(200)] + [(7, None), (None, "only here"), (None, "ab")]
    df = spark.createDataFrame([(*x, 1, "q") for x in rows], "doc_id long, text string, run int, keep_id string").repartition(7)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    want = sorted(((i, min(groups[norm(t)])[3], len(groups[norm(t)]), i == min(groups[norm(t)])[3], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted((tuple(x) for x in X.exact_dedup(df).collect()), key=str) == want
    kept = X.dedup_filter(df)
    assert kept.columns == df.columns and sorted((x.doc_id, norm(x.text)) for x in kept.collect() if x.doc_id is not None) == sorted({(i, norm(t)) for i, t in rows if i is not None and min(groups[norm(t)])[3] == i})
    assert kept.count() == len(groups)
    assert X.exact_dedup(df.limit(0)).count() == 0


def test_urls(spark):
    urls = ["HTTP://WWW.Example.COM/en/x?q=/fr/#a", "http://a.example.com/en/", "http://example.com/en", "http://b.com", "http://b.com/", "x://net/es/1", "s://a.net/esx", "s://a.net/fr/?", "no scheme", "", None, "a://:80/x", "http://notexample.com/en/", "http://example.com:80/en/", "q?u=http://x.net/fr/", "http://com/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {x.page_id: x for x in U.judge(df, U.RULES).collect()}

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: (len(r.host), len(r.path)), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == brute(u), u
    assert got[0].verdict == "allow" and got[1].verdict == "block" and got[5].rule == "net/es/"
    assert U.judge(df.limit(0), U.RULES).count() == 0
    t = U.Trie([U.Rule("a.com", "/x", "block"), U.Rule("a.com", "/x/y", "allow"), U.Rule("a.com", "/x/y", "block"), U.Rule("", "/", "allow")])
    assert t.find("q.a.com", "/xyz") == ("a.com/x", "block") and t.find("a.com", "/x/yz/1") == ("a.com/x/y", "block") and t.find("b", "/") == ("/", "allow") and t.find("b", "") is None


def audited(spark, ours, theirs, kind="long"):
    frames = (spark.createDataFrame([(*x, 7) for x in rows], f"page_id {kind}, url string, html string, archive_id int").repartition(3) for rows in (ours, theirs))
    return W.audit(*frames)


def brute_audit(ours, theirs):
    """Sorted (page_id, kind, expected, found): multisets of records, what is lost and new of an id paired in order."""
    from collections import Counter

    def sha(u, b):
        b = b or ""
        return hashlib.sha256(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}\r\n\r\n".encode()).hexdigest()

    a, b = (Counter((i, sha(u, t)) for i, u, t in rows) for rows in (ours, theirs))
    out = []
    for i in {k[0] for k in [*a, *b]}:
        lost, new = (sorted(s for (j, s), n in (x - y).items() if j == i for _ in range(n)) for x, y in ((a, b), (b, a)))
        pairs = min(len(lost), len(new)) if i is not None else 0
        out += [(i, "altered", x, y) for x, y in zip(lost[:pairs], new[:pairs], strict=True)]
        out += [(i, "missing", x, None) for x in lost[pairs:]] + [(i, "extra", None, y) for y in new[pairs:]]
    return sorted(out, key=str)


def plain(df):
    return sorted(((x.page_id, x.kind, x.expected_sha256, x.found_sha256) for x in df.collect()), key=str)


def test_audit(spark):
    rows = [(i, f"http://h/{i}", "body é" * (i % 7)) for i in range(0, 9000, 3)] + [(20_000, None, None), (None, "u", "h"), (None, "u", "h"), (None, None, "x" * 300_000)]
    theirs = [(i, u, (b or "") + "!" if i == 300 else b) for i, u, b in rows if i not in (6, 20_000)] + [(10, "x", "new"), (None, "u", "h"), (12, "again", "b")]
    got = audited(spark, rows, theirs)
    assert plain(got) == brute_audit(rows, theirs)
    at = {x.page_id: x for x in got.collect()}
    length = lambda u, b: len(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(b.encode())}\r\n\r\n{b}\r\n\r\n".encode())
    assert at[300].record_offset == sum(length(u, b) for i, u, b in rows if i is not None and i < 300) and at[300].record_length == length(*rows[100][1:])
    assert audited(spark, rows, rows[::-1]).count() == 0
    assert plain(audited(spark, [], rows)) == brute_audit([], rows)


def test_audit_of_repeated_large_and_text_ids(spark, monkeypatch):
    r = random.Random(3)
    big = [(r.randrange(-(1 << 63), 1 << 63), "u", f"b{i}") for i in range(400)]
    ours = big + [(5, "u", "A"), (5, "u", "B"), (6, "u", "A"), (6, "u", "A"), (None, "u", "gone")]
    theirs = big[1:] + [(5, "u", "A"), (5, "u", "C"), (6, "u", "A"), (None, "u", "A")]
    text = lambda rows: [(None if i is None else f"p{i}", u, b) for i, u, b in rows]
    assert plain(audited(spark, text(ours), text(theirs), "string")) == brute_audit(text(ours), text(theirs))
    monkeypatch.setattr(W, "HOT_RECORDS", 20)
    hot = [(9, "u", f"h{i}") for i in range(60)]
    got = plain(audited(spark, ours + hot, theirs + hot[:50] + [(9, "u", "new")]))
    assert [x[1] for x in got if x[0] == 9] == ["extra"] + ["missing"] * 10
    assert [x for x in got if x[0] != 9] == brute_audit(ours, theirs)
