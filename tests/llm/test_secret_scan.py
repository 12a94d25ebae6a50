import hashlib
import random

from lexmill.llm import secret_scan as ss

KEY = "AKIA" + "A1B2" * 4


def test_base_rules():
    assert ss.base_spans(f"Password: 'hunter22' {KEY}") == [("assign", 0, 19), ("access", 21, 41)]
    assert ss.base_spans("secret=token = abcdef") == []  # the short match is dropped, and what it took stays taken
    assert ss.base_spans("é api_key=abcdef " + "a1" * 12 + " " + "a1" * 11) == [("assign", 2, 16), ("hex", 17, 41)]
    assert ss.base_spans("paſſword=abcdefg AKIA123") == []


def test_ledger_scans_once(spark, tmp_path):
    rows = [(1, f"x {KEY}", 9), (2, f"x {KEY}", 9), (3, None, 9), (None, "", 9), (5, "token=abcdefgh", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    path = "file://" + str(tmp_path / "ledger")
    first = ss.digest(ss.join_back(docs, ss.scan_to_ledger(docs, path))).collect()
    got = {r.doc_id: r for r in first}
    assert got[1].n_access == got[2].n_access == 1 and got[1].spans == "access:2:22"
    assert got[3].base_sha256 == got[None].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[5].n_assign == 1
    assert spark.read.parquet(path).count() == 3  # three blobs: copies and empty texts share one
    more = docs.union(spark.createDataFrame([(6, "new", 1)], docs.schema))
    assert ss.scan_blobs(more, spark.read.parquet(path)).count() == 1
    ss.scan_to_ledger(more, path)
    assert spark.read.parquet(path).count() == 4
    assert ss.scan_blobs(more, spark.read.parquet(path), "base-2").count() == 4
    assert ss.digest(ss.join_back(docs.limit(0), ss.scan_blobs(docs.limit(0)))).count() == 0


def test_redact():
    assert ss.redact("a secret b", [("assign", 2, 8), ("hex", 4, 8)]) == "a [assign] b"


LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_spans(text):
    """The base spans by hand, without a pattern."""
    out, n = [], len(text)

    def run(i, of):
        while i < n and text[i] in of:
            i += 1
        return i

    small, i = low(text), 0
    while i < n:
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if small.startswith(name, i):
                k = i + len(name)
                k = k + 1 if text[k : k + 1] in ("'", '"') else k
                k = run(k, " ")
                if text[k : k + 1] in (":", "="):
                    k = run(k + 1, " ")
                    q = k + 1 if text[k : k + 1] in ("'", '"') else k
                    e = run(q, LETTERS)
                    if e > q:
                        end = e
                        if e - q >= 6:
                            out.append((i, 0, e))
                        break
        i = end or i + 1
    for kind, start, of, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < n:
            e = run(i + len(start), of) if text.startswith(start, i) else i
            if e > i + len(start):
                if e - i >= least:
                    out.append((i, kind, e))
                i = e
            else:
                i += 1
    return [(ss.KINDS[k], a, b) for a, k, b in sorted(out)]


def brute_rows(docs):
    out = []
    for i, t in docs:
        found = plain_spans(t or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out.append((i, *(sum(k == x for x, *_ in found) for k in ss.KINDS), hashlib.sha256(told.encode()).hexdigest(), told))
    return sorted(out, key=str)


def test_whole_documents_by_hand(spark, tmp_path):
    rng = random.Random(5)
    bits = ["password", "PassWd", "secret", "token", "api_key", "apikey", "API_KEY", "'", '"', " ", "  ", ":", "=", "AKIA", "A1B2C3D4", "deadbeef01", "abc", "x-y_z", "é", "ſecret", "\n", "0", "f" * 23, "7" * 24]
    docs = [(i, "".join(rng.choices(bits, k=rng.randint(0, 60)))) for i in range(400)] + [(None, None), (None, ""), (3, "token: " + "q" * 9000)]
    df = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, source string").repartition(3)
    got = ss.digest(ss.scan_history(ss.committed(df, 3), "file://" + str(tmp_path / "l"), [1, 2, 3])).collect()
    assert sorted(map(tuple, got), key=str) == brute_rows(docs)
    sf = "/root/testdata/sf0.01"
    rows = ss.op9(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r[:6]) for r in rows), key=str) == brute_rows(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows)


def test_history_reuses_blobs(spark, tmp_path):
    path = "file://" + str(tmp_path / "l")
    rows = [("a/1", 1, "token=abcdefgh"), ("a/2", 1, None), ("a/1", 2, "token=abcdefgi"), ("b/1", 2, "token=abcdefgh"), ("b/2", 3, "token=abcdefgi"), ("b/2", 3, "token=abcdefgi")]
    history = spark.createDataFrame(rows, "path string, commit int, text string")
    got = ss.scan_history(history, path, [1, 2, 3]).collect()
    assert sorted((r.path, r.commit, r.reused, len(r.findings)) for r in got) == [
        ("a/1", 1, False, 1), ("a/1", 2, False, 1), ("a/2", 1, False, 0), ("b/1", 2, True, 1), ("b/2", 3, True, 1), ("b/2", 3, True, 1)
    ]
    assert sorted(r.scan for r in ss.read_ledger(spark, path).collect()) == [1, 1, 2]
    # a scan that raced, or was repeated, adds equal rows, which count once
    ss.scan_blobs(history.where("commit = 1"), None, scan=9).write.mode("append").parquet(path)
    assert sorted(r.scan for r in ss.read_ledger(spark, path).collect()) == [1, 1, 2]
    assert ss.scan_history(history.limit(0), path + "0", [1]).count() == 0
