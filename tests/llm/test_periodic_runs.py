"""Runs of periodic words against a search by definition."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cartwise.llm import periodic_runs as pr
from cartwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def by_definition(w):
    """Every period's maximal stretches of equal words q apart, smallest periods only."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q - i) not in out:
                out[i, j + q - i] = q
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def planted(doc_id, text):
    w = re.findall(r"[^ \t-\r]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digests(doc_id, w, runs):
    best = None
    for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)]
    return (doc_id, len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None, *sha)


def random_words(rnd):
    kind, n = rnd.random(), rnd.randint(0, 90)
    if kind < 0.4:
        return [rnd.choice("ab") for _ in range(n)]
    if kind < 0.6:
        return [rnd.choice("abc") for _ in range(n)]
    out = []
    while len(out) < n:
        root = [rnd.choice("abcdefgh"[:rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 12))]
        out += (root * rnd.randint(1, 7))[:rnd.randint(1, 80)]
        out += [rnd.choice("xyz") for _ in range(rnd.randint(0, 3))]
    return out


def test_runs_of_one_text():
    rnd = random.Random(5)
    for _ in range(1500):
        w = random_words(rnd)
        number = {x: i + 1 for i, x in enumerate(rnd.sample(sorted(set(w)), len(set(w))))}
        assert pr.runs_of([number[x] for x in w]) == by_definition(w), w


def test_many_texts_at_once():
    """The windows lose no run, also where texts stand side by side."""
    rnd = random.Random(6)
    for _ in range(60):
        texts = [random_words(rnd) for _ in range(rnd.randint(0, 25))]
        got = pr.runs_of_texts([[x.encode() for x in w] for w in texts])
        assert [sorted(x) for x in got] == [by_definition(w) for w in texts]


@pytest.mark.parametrize("p", [7, 8, 9, 31, 150])
@pytest.mark.parametrize("extra", [-1, 0, 1, 5])
def test_windows_of_long_periods(p, extra):
    rnd = random.Random(p)
    word = lambda: rnd.randint(1, 60)
    root = [word() for _ in range(p)]
    w = [word() for _ in range(300)] + (root * 5)[:4 * p + extra] + [word() for _ in range(200)]
    got = pr.runs_of_texts([[b"%d" % x for x in w]])[0]
    assert got == by_definition(w) and (extra < 0 or any(q == p for _, _, q in got))


def test_windows_are_narrow():
    """Prose gives no window, a period one that its length bounds."""
    rnd = random.Random(3)
    prose = np.array([rnd.randint(0, 300) for _ in range(20_000)])
    assert sum(e - b for b, e in zip(*pr.windows(prose, len(prose)))) < 200
    prose[5000:9000] = np.tile(prose[5000:5200], 20)
    b, e = pr.windows(prose, len(prose))
    big = [(x, y) for x, y in zip(b, e) if y - x > 1000]
    assert len(big) == 1 and 3700 <= big[0][0] <= 5000 and 9000 <= big[0][1] <= 9020


def test_common_extensions():
    rnd = random.Random(9)
    w = [rnd.randint(1, 3) for _ in range(200)]
    tree = pr.SuffixTree(w)
    i, j = np.array([(a, b) for a in range(201) for b in range(201) if a != b]).T
    want = []
    for a, b in zip(i, j):
        k = 0
        while max(a, b) + k < 200 and w[a + k] == w[b + k]:
            k += 1
        want.append(k)
    assert tree.common(i, j).tolist() == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        w = planted(r.doc_id, r.text)
        want.append(digests(r.doc_id, w, pr.runs_of_texts([[x.encode() for x in w]])[0]))
    got = QUERIES["op12_periodic_runs"](spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                           "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    short = [w for r in docs if len(w := planted(r.doc_id, r.text)) <= 600]
    got = pr.runs_of_texts([[x.encode() for x in w] for w in short])
    assert got == [by_definition(w) for w in short] and any(got)


def test_odd_rows(spark, frame):
    got = {}
    for r in pr.run_digests(pr.find_runs(pr.with_planted_runs(frame))).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    rows = frame.select("doc_id", "text").collect()
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        w = planted(r.doc_id, r.text) if r.doc_id is not None else (r.text or "").split()
        n = len(w)
        runs = [(0, n, 12)] if n == 48_000 else [(0, 48_000, 12)] if n > 1000 else by_definition(w)
        if n > 1000 and zlib.crc32(str(r.doc_id).encode()) % 10 == 0:
            runs = pr.runs_of_texts([[x.encode() for x in w]])[0]
        assert digests(r.doc_id, w, runs)[1:] in got[r.doc_id]


def test_empty_table_and_planted_nulls(spark, nothing):
    assert pr.run_digests(pr.find_runs(pr.with_planted_runs(nothing))).count() == 0
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(ids[0], None), (ids[1], ""), (ids[2], " \t"), (ids[3], "one"), (ids[4], "a b c d e f g")]
    out = dict(pr.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert (out[ids[0]], out[ids[1]], out[ids[2]], out[ids[3]]) == (None, "", " \t", "one")
    assert out[ids[4]].split() == planted(ids[4], "a b c d e f g")
