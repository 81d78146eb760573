"""Hard negatives against all pairs."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.llm import hard_negatives as hn
from cartwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def all_pairs(rows, every=10, k=5):
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    ok = [r for r in rows if r[2] is not None and r[1] is not None
          and all(x is not None and np.isfinite(x) for x in r[1])]
    dims = max((len(r[1]) for r in ok), default=0)
    v = np.array([[*np.floor(256 * np.array(r[1], float)), *[0.0] * (dims - len(r[1]))] for r in ok])
    ids, labels = [r[0] for r in ok], [r[2] for r in ok]
    key = lambda s, j: (-s[j], ids[j] is None, ids[j] or 0)
    out = []
    for a, i in enumerate(ids):
        if i is None or i % every:
            continue
        s = v @ v[a]
        other = [j for j in range(len(ok)) if ids[j] is None or ids[j] != i]
        pos = sorted((j for j in other if labels[j] == labels[a]), key=lambda j: key(s, j))[:k]
        for p in pos:
            neg = sorted((j for j in other if labels[j] != labels[a]
                          and 80 * s[p] <= 100 * s[j] <= 100 * s[p]), key=lambda j: key(s, j))[:k]
            out += [(i, ids[p], r + 1, ids[j], int(s[p]), int(s[j])) for r, j in enumerate(neg)]
    return out


def known(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def vectors(rng, n, kind):
    if kind == "clusters":
        x = rng.normal(size=(n // 40 + 1, 16))[rng.integers(0, n // 40 + 1, n)]
        x = x + 0.2 * rng.normal(size=(n, 16))
    elif kind == "copies":
        x = rng.normal(size=(5, 16))[rng.integers(0, 5, n)]
    else:
        x = rng.normal(size=(n, 16)) * rng.exponential(size=(n, 1))
    return np.floor(64 * x)


@pytest.mark.parametrize("kind", ["clusters", "copies", "norms"])
def test_tree_search(kind):
    """Equal to all scores, with half of the points or less looked at where they cluster."""
    rng = np.random.default_rng(4)
    n = 1500
    x, ids = vectors(rng, n, kind), rng.permutation(n)
    known_, labels = rng.random(n) > 0.05, rng.integers(0, 4, n)
    tree = hn.CoverTree.load(hn.CoverTree.build(x, ids, known_, labels).dump())
    # every point lies below each of its nodes within the radius
    assert sorted([*tree.bucket, *tree.point[tree.fresh]]) == list(range(n))
    for q in range(0, n, 50):
        s = x @ x[q]
        top = float(np.sort(s)[-20])
        spans = [(-np.inf, np.inf), (0.8 * top, top), (top, top), (0.0, 0.3 * top), (5.0, 4.0)]
        for same in (True, False):
            got = tree.search(x[q], ids[q], labels[q], same, 5, spans)
            for (low, high), hits in zip(spans, got):
                ok = ((labels == labels[q]) == same) & (s >= low) & (s <= high)
                ok &= (ids != ids[q]) | ~known_
                want = sorted(np.flatnonzero(ok), key=lambda j: (-s[j], not known_[j], ids[j]))[:5]
                assert [(a, known_[p], ids[p] * known_[p]) for a, p in hits] \
                    == [(s[j], known_[j], ids[j] * known_[j]) for j in want]


def test_search_skips_nodes():
    rng = np.random.default_rng(8)
    x = vectors(rng, 4000, "clusters")
    tree = hn.CoverTree.build(x, np.arange(4000), np.ones(4000, bool), rng.integers(0, 3, 4000))

    class Counted(np.ndarray):
        seen = 0

        def __getitem__(self, k):
            part = np.asarray(self)[k]
            Counted.seen += len(part)
            return part

    tree.vecs, tree.centers = tree.vecs.view(Counted), tree.centers.view(Counted)
    for q in range(40):
        tree.search(x[q], q, 0, True, 5, [(-np.inf, np.inf)])
    assert Counted.seen < 40 * 4000 / 2


def test_embeddings_against_sql(spark):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = duckdb.sql(ORACLES["op13_hard_negatives"])
    got = QUERIES["op13_hard_negatives"](spark, SF)
    assert got.columns == want.columns
    assert known(got.collect()) == known(want.fetchall())


@pytest.mark.parametrize("block,pack,task", [(16, 3, 2), (4096, 256, 64)])
def test_odd_rows(spark, monkeypatch, block, pack, task):
    """Nulls, odd components, ties, repeated rows, ragged vectors and clashing names."""
    for name, value in (("BLOCK_ROWS", block), ("PACK_ROWS", pack), ("PACKS_A_TASK", task)):
        monkeypatch.setattr(hn, name, value)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(i, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(200, 260)]     # ties
    rows += [rows[20], rows[20], rows[31], (30, [0.5] * 6, 1), (30, [0.4] * 6, 1)]
    rows += [(None, [0.3] * 6, 1), (None, [0.3] * 6, 2), (301, None, 1), (310, [0.1] * 6, None),
             (320, [float("nan")] * 6, 1), (330, [float("inf")] * 6, 1), (340, [None] * 6, 1),
             (350, [2.0, 1.0], 0), (360, [], 1), (370, [0.0] * 6, 2)]
    df = spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows],
                               "vec_id long, embedding array<float>, label int, row string, "
                               "id string, salt double")
    as_float = [(i, v and [x and float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    got = hn.mine_hard_negatives(df, df["vec_id"] % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id",
                           "positive_score", "negative_score"]
    assert known(got.collect()) == known(all_pairs(as_float))


def test_no_anchor_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).count() == 0
    none = df.limit(0)
    assert hn.mine_hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0
