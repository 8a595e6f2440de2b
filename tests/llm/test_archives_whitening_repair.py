"""Operators 11 to 13 against plain versions, literal cases and odd rows."""

import glob
import gzip
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.llm import queries, repair, warc, whiten

# 11: archives

V1 = b"""filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76
1 0 Alexa Internet
URL IP-address Archive-date Content-type Archive-length

http://a.example/x y 10.0.0.1 19961104142103 text/html 54
HTTP/1.0 200 OK\r
Content-Type: text/html\r
\r
<p>one</p>
not a header line
http://a.example/img 10.0.0.2 1996 image/gif 4
GIF8
dns:a.example 10.0.0.3 19961104142104 text/dns 3
abc
http://a.example/cut 10.0.0.1 19961104142105 text/html 900
HTTP/1.0 200 OK\r
\r
short"""
V2 = b"""filedesc://new.arc 0.0.0.0 19980101000000 text/plain 200 - - 0 new.arc 118
2 0 Someone
URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length

http://b.example/ 10.0.0.9 19980102030405 text/html 404 deadbeef - 99 new.arc 26
HTTP/1.1 404 No\r
\r
missing
"""


def sized(arc):
    """The archive with the declared lengths of its version block and its first record put right."""
    head, _, rest = arc.partition(b"\n")
    about = rest[: rest.index(b"\n\n") + 1]
    return head.rsplit(b" ", 1)[0] + b" %d\n" % len(about) + rest


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data)


def test_arc_headers_by_version(spark, tmp_path):
    write(tmp_path / "arc", "old.arc", sized(V1))
    write(tmp_path / "arc", "new.arc.gz", gzip.compress(sized(V2)))
    got = {r.url: r for r in warc.read_arc(spark, str(tmp_path / "arc")).collect()}
    assert set(got) == {"filedesc://old.arc", "filedesc://new.arc", "http://a.example/x y", "http://a.example/img", "dns:a.example", "http://a.example/cut", "http://b.example/"}
    one = got["http://a.example/x y"]
    assert (one.version, one.ip, one.date, one.mime, bytes(one.payload), one.status) == (1, "10.0.0.1", "19961104142103", "text/html", b"<p>one</p>", None)
    assert bytes(one.header).endswith(b"\r\n\r\n") and one.payload_digest == hashlib.sha256(b"<p>one</p>").hexdigest()
    assert got["http://a.example/img"].header is None and bytes(got["http://a.example/img"].payload) == b"GIF8"
    assert got["http://a.example/cut"].truncated and bytes(got["http://a.example/cut"].payload) == b"short"
    two = got["http://b.example/"]
    assert (two.version, two.status, bytes(two.payload).strip()) == (2, "404", b"missing")

    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), compression="none")
    back = {r.target_uri: r for r in warc.read_warc(spark, str(tmp_path / "warc")).where("record_type <> 'warcinfo'").collect()}
    assert set(back) == set(got)
    assert [back[u].record_type for u in ("filedesc://old.arc", "http://a.example/x y", "http://a.example/img", "dns:a.example")] == ["metadata", "response", "resource", "resource"]
    assert back["http://a.example/x y"].date == "1996-11-04T14:21:03Z" and back["http://a.example/img"].date == "1996-01-01T00:00:00Z"
    assert back["http://a.example/x y"].headers["warc-ip-address"] == "10.0.0.1" and back["http://a.example/img"].headers["content-type"] == "image/gif"
    assert back["http://a.example/cut"].headers["warc-truncated"] == "unspecified"
    for url, r in back.items():
        assert r.declared_digest == f"sha256:{r.payload_digest}" and bytes(r.payload) == bytes(got[url].payload) and not r.truncated
        assert r.headers["warc-block-digest"] == "sha256:" + hashlib.sha256(bytes(r.header or b"") + bytes(r.payload)).hexdigest()
    ids = {r.record_id for r in back.values()}
    assert len(ids) == len(back) and all(i.startswith("<urn:uuid:") and len(i) == 47 for i in ids)
    warc.convert(spark, str(tmp_path / "arc"), str(tmp_path / "again"))
    assert {r.record_id for r in warc.read_warc(spark, str(tmp_path / "again")).where("record_type <> 'warcinfo'").collect()} == ids
    first = sorted(glob.glob(str(tmp_path / "warc" / "part-*")))[0]
    assert open(first, "rb").read().startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_damaged_and_member_by_member_archives(spark, tmp_path):
    data = sized(V1)
    cut = data.index(b"http://a.example/img")
    write(tmp_path / "arc", "members.arc.gz", gzip.compress(data[:cut]) + gzip.compress(data[cut:]))
    write(tmp_path / "arc", "broken.arc.gz", gzip.compress(sized(V2))[:-20])
    write(tmp_path / "arc", "empty.arc", b"")
    urls = [r.url for r in warc.read_arc(spark, str(tmp_path / "arc")).where("archive = 'members.arc.gz'").collect()]
    assert len(urls) == 5
    assert warc.read_arc(spark, str(tmp_path / "arc")).where("archive = 'empty.arc'").count() == 0
    assert warc.read_arc(spark, str(tmp_path / "arc")).where("archive = 'broken.arc.gz'").count() >= 1


HTML = [
    (5, "http://x/5", "<p>" + "long enough to be a revisit " * 9), (3, "http://x/3", "<p>" + "long enough to be a revisit " * 9), (9, None, "<p>" + "long enough to be a revisit " * 9),
    (1, "http://x/a b\nc", "tiny"), (2, "http://x/2", "tiny"), (4, "http://x/4", None), (6, "http://x/6", ""), (7, "http://x/7", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1 \r\nhttp://y 1 2 3 4\n" * 40),
    (8, "http://x/8", "é" * 50), (11, "http://x/8", "é" * 50), (12, "http://x/12", "HTTP/1.1 200 OK\r\n\r\n" * 30), (10, "http://x/10", "ü𝄞 " * 400_000), (None, "http://x/null", "é" * 50),
    (3, "http://x/3", "<p>" + "long enough to be a revisit " * 9),
]


def test_pages_through_archives(spark, tmp_path):
    pages = spark.createDataFrame(HTML, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("key", "payload", "archive", "mime", "offset")})
    got = warc.archive_pages(pages, str(tmp_path))[0].collect()
    none_last = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    assert sorted(((r.key, r.payload_bytes, r.payload_digest) for r in got), key=none_last) == sorted(((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in HTML), key=none_last)
    kinds = {}
    for r in got:
        kinds.setdefault(r.key, []).append((r.record_type, r.refers_to))
    assert sorted(kinds[3], key=str) == [("response", None), ("revisit", 3)]
    assert kinds[5] == kinds[9] == [("revisit", 3)] and kinds[11] == kinds[None] == [("revisit", 8)]
    assert all(kinds[i] == [("response", None)] for i in (1, 2, 4, 6, 7, 8, 10, 12))
    stored = {r.key: r for r in warc.read_warc(spark, f"{tmp_path}/warc").collect() if r.record_type == "response"}
    assert bytes(stored["10"].payload).decode() == HTML[11][2] and bytes(stored["7"].payload).decode() == HTML[7][2]
    revisits = warc.read_warc(spark, f"{tmp_path}/warc").where("record_type = 'revisit'").collect()
    assert len(revisits) == 5 and all(r.payload_bytes == 0 and r.headers["warc-profile"] == warc.REVISIT_PROFILE and r.headers["warc-refers-to-target-uri"] for r in revisits)
    none = warc.archive_pages(pages.limit(0), str(tmp_path / "none"))[0]
    assert none.count() == 0 and none.columns == ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_both_versions_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"http://h/{k}", "text/html; charset=utf-8", f"<p>{k}") for k in range(20)], "key long, url string, mime string, payload string").repartition(3)
    for version in (1, 2):
        warc.write_arc(rows, f"{tmp_path}/v{version}", version, compression="none")
        for name in glob.glob(f"{tmp_path}/v{version}/part-*"):
            assert open(name, "rb").read().startswith(b"filedesc://lanewise.arc 0.0.0.0 20000101000000 text/plain")
        got = warc.read_arc(spark, f"{tmp_path}/v{version}").where("url not like 'filedesc%'").collect()
        assert {(r.key, bytes(r.payload).decode(), r.version, r.status, r.mime) for r in got} == {(str(k), f"<p>{k}", version, "200" if version == 2 else None, "text/html") for k in range(20)}


# 12: whitening


def test_pivoted_cholesky_and_jacobi():
    rng = np.random.default_rng(3)
    for size, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        g = rng.standard_normal((size, rank)) * 10.0 ** rng.integers(-1, 2, rank)
        a = g @ g.T
        low, order = whiten.pivoted_cholesky(a)
        assert low.shape == (size, rank) and np.allclose(low @ low.T, a[np.ix_(order, order)], rtol=1e-12, atol=1e-12 * np.abs(a).max())
        assert np.allclose(low, np.tril(low)) and sorted(order) == list(range(size))
        turned = whiten.one_sided_jacobi(low)
        norms = np.sort((turned**2).sum(0))[::-1]
        assert np.allclose(norms, np.sort(np.linalg.eigvalsh(a))[::-1][:rank], rtol=1e-9)
        unit = turned / np.linalg.norm(turned, axis=0)
        assert np.abs(unit.T @ unit - np.eye(rank)).max() < 1e-12
    assert whiten.pivoted_cholesky(np.zeros((3, 3)))[0].shape == (3, 0)


def plain_whitening(vectors, most=8):
    x = [[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[k] for row in x) for k in range(d)]
    centred = np.array([[float(Fraction(n * row[k] - s[k], n)) for k in range(d)] for row in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return x, s, centred @ u / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("offset", [0.0, 3000.0])
def test_whitening_against_eigh(spark, offset):
    rng = np.random.default_rng(5)
    raw = (rng.standard_normal((300, 12)) * np.linspace(0.2, 3, 12) + offset).astype(np.float32)
    table = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(raw)], "vec_id long, embedding array<float>")
    x, s, want, shares = plain_whitening(raw)
    n, got = len(x), {}
    rows = whiten.whiten(table.repartition(5)).collect()
    for r in rows:
        got.setdefault(r.component, {})[r.vec_id] = r
    assert sorted(got) == list(range(1, 9)) and len(rows) == 8 * n
    for c, own in got.items():
        values = np.array([own[k].whitened for k in range(n)])
        sign = np.sign(values @ want[:, c - 1])
        assert np.abs(values * sign - want[:, c - 1]).max() < 1e-8
        assert abs(own[0].explained - shares[c - 1]) < 1e-10 and own[0].n == n and own[0].identity_error < 1e-8
    for k in range(n):
        assert got[1][k].deviation == sum((n * x[k][j] - s[j]) ** 2 for j in range(12))
    again = whiten.whiten(table.repartition(2)).collect()
    assert {(r.vec_id, r.component): r.deviation for r in rows} == {(r.vec_id, r.component): r.deviation for r in again}


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, None), (4, []), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 2.0, 3.0]), (None, [0.5, 0.25]), (9, [1e30, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("component", "n", "a", "b", "v", "whitened")})
    got = whiten.whiten(table).collect()
    assert sorted(((r.vec_id, r.component) for r in got), key=str) == sorted([(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (None, 1), (None, 2)], key=str)
    assert all(r.n == 4 and r.identity_error < 1e-10 for r in got)
    assert whiten.whiten(table.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "vec_id long, embedding array<double>")
    assert whiten.whiten(same).count() == 0
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten.whiten(flat).collect()} == {1}
    large = spark.createDataFrame([(k, [2.0**40 * (k - 1), float(k * k)]) for k in range(3)], "vec_id long, embedding array<double>")
    out = whiten.whiten(large).collect()
    assert len(out) == 3  # the other direction's variance is below what a double tells
    assert {r.vec_id: r.deviation is None for r in out} == {0: True, 1: False, 2: True}  # beyond a long


# 13: conversation repair


def plain_repair(rows):
    """Rows ``(turn, role, text)`` in order; the cheapest edits by dynamic programming from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        held = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    after = {0: (0, ""), 3: (0, "")}
    for i in range(len(rows), -1, -1):
        best = dict(after) if i == len(rows) else {}
        if i < len(rows):
            role, bad = rows[i][1], faults[i]
            for q in range(4):
                ways = [(after[q][0] + 3, "D" + after[q][1])] if q in after else []
                if bad not in ("blank", "duplicate"):
                    more = int(bad == "truncated")
                    to = step.get((q, role[:1]))
                    ways += [(after[to][0] + more, "K" + after[to][1])] if to in after else []
                    for c in "ua":
                        to = step.get((q, c))
                        ways += [(after[to][0] + 2 + more, "R" + after[to][1])] if to in after else []
                if ways:
                    best[q] = min(ways)
        for _ in range(4):
            for q in range(4):
                for c in "ua":
                    to = step.get((q, c))
                    if to in best:
                        way = (best[to][0] + 2, "I" + best[to][1])
                        best[q] = min(best.get(q, way), way)
        after = best
    cost, audit = after[0]
    q, at, lines = 0, 0, []
    for edit in audit:
        role = "assistant" if q == 2 else "user"
        if edit != "I":
            _, own, text = rows[at]
            at += 1
        if edit == "D":
            continue
        say = (own, text) if edit == "K" else (role, text if edit == "R" else "")
        q = step[q, say[0][:1]]
        lines.append(":".join(say))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(table):
    """Conversations after damage, in order."""
    out = {conv: [] for conv, *_ in table}
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else "".join(c for c in text if c not in ".!?") if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rows in out.items()}


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def held(df):
    rows = df.collect()
    out = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_of_the_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert held(queries.op13_repair(spark, sf_dir)) == {c: plain_repair(rows) for c, rows in plain_damage(table).items()}


def test_repair_of_odd_and_long_conversations(spark, tmp_path):
    rng = random.Random(11)
    table = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Yes."), (1, None, None, None), (2, 3, "user", None), (3, 5, "tool", "x" * 100_000 + "."), (3, 5, "", "?"), (3, 5, "", "?"), (4, 1, "system", "S.")]
    for conv in range(10, 50):
        for turn in range(rng.randrange(1, 12)):
            table.append((conv, rng.choice([turn, turn, turn, None, 7]), rng.choice(["user", "assistant", "system", "unknown", None]), rng.choice(["Yes.", "No", "", " \t", f"word {turn}!", f"word {turn} "])))
    for conv, size in ((100, 700), (101, 130), (102, 64), (103, 65)):
        for turn in range(size):
            table.append((conv, turn * 2, "user" if (turn + rng.randrange(8) // 7) % 2 == 0 else "assistant", f"text {turn}" + rng.choice(".!? ")))
    table += [(104, 4, "user", "same.")] * 300 + [(105, k, "assistant", "") for k in range(200)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    frame = frame.withColumns({c: F.lit("x") for c in ("conv", "at", "symbol", "fault", "what", "mark", "node", "piece")}).repartition(7)
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    want = {c: plain_repair(rows) for c, rows in plain_damage(table).items()}
    got = held(queries.op13_repair(spark, str(tmp_path)))
    assert got == want
    assert want[100][5] > 50 and len(want[100][6]) > 650


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_all(none, none).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "Hi.")], none.schema)
    assert held(repair.repair_all(gone, none)) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("symbols,want", [("", (0, "")), ("ua", (0, "KK")), ("sua", (0, "KKK")), ("s", (3, "D")), ("u", (2, "KI")), ("a", (2, "IK")), ("x", (3, "D")), ("uU", (3, "KR")), ("uu", (2, "KR")), ("ou", (4, "RR"))])
def test_auction_on_literal_cases(symbols, want):
    cost, audit, _ = repair.solve(symbols, repair.ENDS, (repair.NOTHING,))[0]
    rows = [(k, {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}[c.lower()], "" if c == "x" else f"{k}" + ("" if c.isupper() else ".")) for k, c in enumerate(symbols)]
    assert (cost, audit) == plain_repair(rows)[5:7]
    assert (cost, audit) == want


def test_auction_prices_are_optimal_duals():
    rng = random.Random(2)
    for _ in range(200):
        symbols = "".join(rng.choice("suaoSUAx") for _ in range(rng.randrange(0, 30)))
        arcs = repair._arcs(symbols, repair.ENDS)
        price = [0] * len(arcs)
        repair.auction(arcs, price, 0)
        assert all(price[i] <= cost + price[j] for i, own in enumerate(arcs) for _, cost, j in own)
        rows = [(k, {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}[c.lower()], "" if c == "x" else f"{k}" + ("" if c.isupper() else ".")) for k, c in enumerate(symbols)]
        assert (price[0], repair.solve(symbols, repair.ENDS, (0,))[0][1]) == plain_repair(rows)[5:7]
