import hashlib
import math

import numpy as np
import pytest
from duck import assert_same, connect
from pyspark.sql import functions as F

from framelake.llm import queries, top_k, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, v string, id string, n string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, label, "a", "b", "c") for i, e, label in rows], SCHEMA).repartition(parts)


def random_rows(seed, n, d, sizes=(1.0,), labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d))
    x = centres[r.integers(0, 6, n)] + 0.4 * r.normal(size=(n, d))
    x *= (r.choice(sizes, n) / np.linalg.norm(x, axis=1))[:, None]
    return [(i, [float(c) for c in v], int(r.integers(0, labels))) for i, v in enumerate(x)]


ODD = [
    (None, [0.5, 0.5, 0.25, 0.0], None), (50, None, 1), (51, [0.1, None, 0.2, 0.3], 1), (52, [0.1, float("nan"), 0.2, 0.3], 1),
    (53, [0.1, float("inf"), 0.2, 0.3], 1), (54, [], 1), (55, [1.0, 2.0], 1), (0, [0.5, 0.5, 0.25, 0.0], 1), (0, [0.5, 0.5, 0.25, 0.0], 1),
    (100, [-0.5, 0.25, 0.125, 0.0], None), (100, [-0.25, 0.25, 0.125, 0.0], 2), (7, [0.0, 0.0, 0.0, 0.0], None), (8, [0.5, 0.5, 0.25, 0.0], 2), (9, [1e30, 0.0, 0.0, 0.0], 2),
]


@pytest.mark.parametrize("name", ["op11_top_k", "op13_vector_codes"])
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


# --- top-k search -------------------------------------------------------------------------------


def brute_top(rows, k, every, d):
    """All inner products; of query rows with one id the least vector asks."""
    kept = [(i, [math.floor(256 * c) for c in e]) for i, e, _ in rows if e is not None and len(e) == d and all(c is not None and abs(c) < 1e6 for c in e)]
    ask = {}
    for i, v in kept:
        if i is not None and i % every == 0:
            ask[i] = min(ask.get(i, v), v)
    out = []
    for q, v in ask.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i is None, i or 0) for i, w in kept if i != q)[:k]
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(scored)]
    return sorted(out, key=lambda r: r[:2])


def found_top(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize(("sizes", "coord"), [((1.0,), 0.8), ((0.01, 0.3, 1.0, 4.0, 9.0), 0.8), ((0.01, 0.3, 1.0, 4.0, 9.0), 0.0), ((1.0, 1.02), 2.0)])
def test_top_k_is_exact(spark, monkeypatch, sizes, coord):
    monkeypatch.setattr(top_k, "BUCKET_CELLS", 64 * 8)
    monkeypatch.setattr(top_k, "BLOCK_CELLS", 16 * 8)
    monkeypatch.setattr(top_k, "GROUP_BLOCKS", 2)
    monkeypatch.setattr(top_k, "COORD_FROM", coord)
    rows = random_rows(1, 900, 8, sizes)
    rows += [(1000 + i, rows[3][1], 0) for i in range(200)]  # one vector that many rows share
    assert found_top(top_k.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0)) == brute_top(rows, 5, 10, 8)


def test_top_k_of_odd_rows(spark):
    assert found_top(top_k.top_k(frame(spark, ODD), F.col("vec_id") % 50 == 0)) == brute_top(ODD, 5, 50, 4)
    assert top_k.top_k(frame(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert top_k.top_k(frame(spark, [(0, [1.0], 1)]), F.col("vec_id") % 50 == 0).collect() == []
    copies = [(i % 3, [0.5, 0.25], 1) for i in range(60)]
    assert found_top(top_k.top_k(frame(spark, copies), F.col("vec_id") == 0, k=30)) == brute_top([r for r in copies], 30, 3, 2)


@pytest.mark.parametrize("t", [-0.5, 0.0, 0.3, 0.8, 0.95, 1.0])
def test_coordinates_keep_what_a_cosine_allows(t):
    r = np.random.default_rng(5)
    data = r.integers(-300, 300, (400, 5))
    data[:5] = np.eye(5, dtype=int) * 200
    bucket = top_k.Bucket(np.arange(400), np.ones(400, bool), np.ones(400, int), data)
    for q in (*r.normal(size=(20, 5)), *np.eye(5)):
        q = q / np.linalg.norm(q)
        kept = set(bucket.by_coordinates(q, t, 0.0).tolist())
        assert set(np.flatnonzero(bucket.unit @ q >= t).tolist()) <= kept
        if t == 0.95:
            assert len(kept) < 300


# --- whitening ----------------------------------------------------------------------------------


@pytest.mark.parametrize("span", [(0, 1), (-5, 90), (-(2**35), 2**35), (-(2**60), 2**60)])
def test_bit_slices_give_exact_products(span):
    z = np.random.default_rng(2).integers(*span, (131, 5))
    sums, cross = whitening.scatter(z)
    assert list(sums) == [sum(int(x) for x in c) for c in z.T]
    assert all(cross[i, j] == sum(int(a) * int(b) for a, b in zip(z[:, i], z[:, j], strict=True)) for i in range(5) for j in range(5))


@pytest.mark.parametrize("value", [0, 1, -1, 2**40, -(2**40), 2**80 - 1, -(2**121) + 5, 3**70])
def test_limbs_add_up(value):
    assert sum(x << (whitening.LIMB * k) for k, x in whitening._limbs(value)) == value


def brute_white(rows, m):
    x = {}
    for i, v in rows:
        x.setdefault(i, []).append([math.floor(64 * c) + 1000000 for c in v])
    fit = sorted({tuple(v) for vs in x.values() for v in vs})
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    cov = np.array([[sum((n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit) / n**3 for b in range(d)] for a in range(d)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:m], w[:, ::-1][:, :m]
    return n, s, e, w, np.trace(cov), x


def test_whitening_against_plain_sums(spark):
    rows = random_rows(3, 300, 6, (1.0, 3.0))
    rows += [(400 + i, rows[5][1], 1) for i in range(150)]
    n, s, e, w, trace, x = brute_white([(i, v) for i, v, _ in rows], 16)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 450 * 6 and {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-9
    sign = {}
    for r in got:
        v = np.array(x[r.vec_id][0])
        assert r.deviation == sum((n * int(a) - b) ** 2 for a, b in zip(v, s, strict=True))
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9)
        plain = (v - np.array(s) / n) @ w[:, r.component - 1] / math.sqrt(e[r.component - 1])
        if abs(plain) > 1e-6:
            assert math.isclose(abs(r.whitened), abs(plain), rel_tol=1e-6)
            assert sign.setdefault(r.component, np.sign(plain * r.whitened)) == np.sign(plain * r.whitened)


def test_whitening_of_odd_rows(spark):
    got = whitening.whiten(frame(spark, ODD)).collect()
    ids = sorted((r.vec_id is None, r.vec_id or 0) for r in got if r.component == 1)
    assert ids == [(False, 0), (False, 0), (False, 7), (False, 8), (False, 100), (False, 100), (True, 0)]
    assert {r.component for r in got} == {1, 2, 3, 4} and all(r.whitened == 0 for r in got if r.component == 4)
    assert whitening.whiten(frame(spark, [])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, 0.0, 0.0, 0.0)] * 4


# --- vector codes -------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "d", "high"), [(500, 16, 900), (300, 4, 6), (200, 1, 40), (100, 16, 1 << 26)])
def test_equal_average_search_is_exact(n, d, high):
    r = np.random.default_rng(n)
    parts, book = r.integers(-high, high, (n, d)), r.integers(-high, high, (256, d))
    book[7] = book[99]  # a tie
    parts[:5] = book[99]
    index, best = vector_codes.nearest(parts, book)
    plain = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (best == plain.min(axis=1)).all() and (index == plain.argmin(axis=1)).all()


def test_search_stops_where_sums_are_far(monkeypatch):
    book = np.arange(256)[:, None] * 100 + np.zeros((1, 4), int)
    seen = []
    monkeypatch.setattr(vector_codes, "_within", lambda gap, best, d, old=vector_codes._within: seen.append(len(gap)) or old(gap, best, d))
    vector_codes.nearest(book[100:110] + 1, book)
    assert len(seen) == 2  # one step, both sides


def brute_codes(rows):
    """Plain Lloyd rounds in Python integers."""
    x = [(i, label, [math.floor(1024 * c) for c in v]) for i, v, label in rows]
    x.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = len(x[0][2])
    at = [d * k // 4 for k in range(5)]
    parts = [[r[2][at[p] : at[p + 1]] for r in x] for p in range(4)]
    books = [[list(c) for c in part[:256]] for part in parts]

    def assign(part, book):
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book)) for v in part]

    for _ in range(4):
        for p in range(4):
            at_entry = {}
            for v, (_, e) in zip(parts[p], assign(parts[p], books[p]), strict=True):
                at_entry.setdefault(e, []).append(v)
            for e, vs in at_entry.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    last = [assign(parts[p], books[p]) for p in range(4)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{last[p][k][1]:02x}" for p in range(4)), sum(last[p][k][0] for p in range(4)), r[1]) for k, r in enumerate(x)]
    by_label = {}
    for r in out:
        by_label[r[3]] = by_label.get(r[3], 0) + r[2]
    return sorted(((i, code, error, by_label[label], sha) for i, code, error, label in out), key=str)


def test_codes_against_plain_rounds(spark):
    rows = random_rows(9, 350, 8)
    assert sorted((tuple(r) for r in vector_codes.encode(frame(spark, rows)).collect()), key=str) == brute_codes(rows)


def test_codes_of_odd_rows(spark):
    kept = [r for r in ODD if r[1] is not None and len(r[1]) == 4 and all(c is not None and abs(c) < 1e6 for c in r[1])]
    assert sorted((tuple(r) for r in vector_codes.encode(frame(spark, ODD)).collect()), key=str) == brute_codes(kept)
    assert vector_codes.encode(frame(spark, [])).collect() == []
