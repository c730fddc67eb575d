"""Vector codes, hard negatives and b-bit MinHash against plain loops, and on odd tables."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folio.llm import hard_negatives as H
from folio.llm import minhash as M
from folio.llm import vector_codes as V
from tests.llm.test_llm import DOCS, ODD, union_find

ROWS = "vec_id long, embedding array<float>, label int, vector string, code string, row int, id int, anchor int, score int"
EXTRA = ("v", "c", 1, 2, 3, 4)


def vectors(n, dim, seed, spread=0.3):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, spread) for _ in range(dim)], rnd.choice([0, 0, 0, 1, 2, None])) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.1] * (dim - 1), 1), (n + 2, [float("nan")] * dim, 1), (n + 3, [0.1] * (dim - 1) + [float("inf")], 1)]
    rows += [(rows[3][0], rows[3][1], rows[3][2]), (50, [0.2] * dim, 0), (50, [0.2] * dim, 0), (None, [0.25] * dim, 0)]  # rows again, equal ids, no id
    return [(*r, *EXTRA) for r in rows]


def plain_kept(rows):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    return [(r[0], [math.floor(256 * float(np.float32(x))) for x in r[1]], r[2]) for r in good]


def plain_codes(rows, parts=16, size=64, rounds=2):
    kept = sorted(plain_kept(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    k = len(kept[0][1]) // parts
    cut = lambda v, p: tuple(v[p * k : p * k + k])
    books = [[cut(r[1], p) for r in kept[:size]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            chosen = {}
            for r in kept:
                chosen.setdefault(nearest(cut(r[1], p), books[p])[1], []).append(cut(r[1], p))
            books[p] = [tuple(sum(c) // len(c) for c in zip(*chosen[i])) if i in chosen else e for i, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    found = [[nearest(cut(r[1], p), books[p]) for p in range(parts)] for r in kept]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for r, e in zip(kept, errors):
        total[r[2]] = total.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{i:02x}" for _, i in f), e, total[r[2]], sha) for r, f, e in zip(kept, found, errors))


@pytest.mark.parametrize(("n", "dim", "spread"), [(150, 32, 0.3), (20, 16, 0.3), (120, 48, 0.004), (80, 16, 200.0)])
def test_vector_codes_by_loops(spark, n, dim, spread):
    """Fewer rows than entries, many ties (a few whole numbers), large components."""
    rows = vectors(n, dim, n, spread)
    df = spark.createDataFrame(rows, ROWS)
    for table in (df, df.repartition(5)):
        got = V.vector_codes(table).collect()
        assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_vector_codes_edges(spark):
    df = spark.createDataFrame(vectors(10, 16, 1), ROWS)
    assert V.vector_codes(df.where("false")).count() == 0
    assert V.vector_codes(df.where("vec_id >= 10 and embedding is null")).collect() == []
    mixed = df.unionByName(spark.createDataFrame([(7, [0.1] * 15, 1, *EXTRA), (8, [], 1, *EXTRA), (9, [0.1] * 32, 1, *EXTRA)], ROWS))
    assert V.vector_codes(mixed).count() == V.vector_codes(df).count()
    assert V.vector_codes(mixed).schema == V.vector_codes(df.where("false")).schema
    with pytest.raises(Exception, match="lies beyond"):
        V.vector_codes(df.select("vec_id", F.transform("embedding", lambda x: x + 1e30).alias("embedding"), "label")).collect()


def test_equal_average_search_is_exact():
    rnd = np.random.default_rng(5)
    for spread, size, k in ((2, 64, 4), (2, 64, 1), (50, 33, 3), (1 << 20, 1, 5)):
        entries, x = rnd.integers(-spread, spread + 1, (3, size, k)), rnd.integers(-spread, spread + 1, (200, 3, k))
        index, distance = V.Codebooks(entries).nearest(x)
        every = ((x[:, :, None, :] - entries[None]) ** 2).sum(axis=3)
        assert (distance == every.min(axis=2)).all() and (index == every.argmin(axis=2)).all()


LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


def negatives(table, **options):
    return H.hard_negatives(table, F.col("vec_id") % 50 == 0, F.expr(LABEL), **options).collect()


def plain_negatives(rows, n_positives=5, n_negatives=3):
    kept = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in plain_kept([r for r in rows if r[2] is not None])]
    out = []
    for at, (anchor, x, label) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y)), i is None, i or 0, i, other) for k, (i, y, other) in enumerate(kept) if k != at]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4] == label][:n_positives]:
            inside = [s for s in scored if s[4] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:n_negatives]
            out += [(anchor, p[3], i + 1, s[3], -p[0], -s[0]) for i, s in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "spread", "bytes_"), [(260, 0.3, 8 << 20), (260, 0.3, 200), (160, 0.004, 300), (120, 30.0, 8 << 20), (110, 40000.0, 200)])
def test_hard_negatives_by_loops(spark, n, spread, bytes_):
    """One block and several; ties; scores of each kind of number."""
    rows = vectors(n, 12, n, spread)
    df = spark.createDataFrame(rows, ROWS)
    for table in (df, df.repartition(7)):
        got = negatives(table, block_bytes=bytes_)
        assert sorted(map(tuple, got), key=str) == plain_negatives(rows)


def test_hard_negatives_edges(spark):
    df = spark.createDataFrame(vectors(60, 8, 2), ROWS)
    for few in ("false", "vec_id = 1", "vec_id = 0"):
        assert negatives(df.where(few)) == []
    other = spark.createDataFrame([(61, [0.3] * 7, 1, *EXTRA), (62, [], 1, *EXTRA)], ROWS)
    both = [sorted(map(tuple, negatives(t)), key=str) for t in (df, df.union(other))]
    assert both[0] == both[1] and both[0]
    with pytest.raises(Exception, match="do not fit"):
        negatives(df.select("vec_id", F.transform("embedding", lambda x: x + 1e30).alias("embedding"), "label"))


def test_best_of_groups():
    rnd = np.random.default_rng(1)
    best, seen = H.Best(5, 3), []
    for _ in range(20):
        g, s, i = rnd.integers(0, 5, 40), rnd.integers(0, 9, 40), rnd.integers(0, 1000, 40)
        best.add(g, s, i, i)
        seen += zip(g.tolist(), s.tolist(), i.tolist())
    want = [(g, s, i) for k in range(5) for g, s, i in sorted((x for x in seen if x[0] == k), key=lambda x: (-x[1], x[2]))[:3]]
    assert list(zip(best.group.tolist(), best.score.tolist(), best.id.tolist())) == want


# 13 MinHash
def plain_shingles(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys(map(ord, "\t\n\v\f\r"), " ")).split(" ")
    w = [x for x in w if x]
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {" ".join(w)} if w else set()


def plain_classes(rows, percent=85):
    sets = [plain_shingles(t) for _, t in rows]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top = union_find(pairs, range(len(rows)))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top[k]] = min(i, least.get(top[k], i))
    return sorted(((i, len(sets[k]), least.get(top[k]), i is not None and i == least.get(top[k])) for k, (i, _) in enumerate(rows)), key=str)


def classes(df):
    return sorted(map(tuple, M.minhash_classes(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def copies(seed):
    """Texts of all lengths with near copies of 0 to 30 % changed words, and a shared passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(120)]
    rows = []
    for n in [1, 2, 3, 4, 8, 15, 20, 40, 60, 200, 400, 2500]:
        for _ in range(3):
            text = [word() for _ in range(n)] + (passage if rnd.random() < 0.3 else [])
            for _ in range(4):
                share = rnd.choice([0, 0.005, 0.02, 0.05, 0.3])
                rows.append(" ".join(word() if rnd.random() < share else w for w in text))
    return [(i, t) for i, t in enumerate(rnd.sample(rows, len(rows)))]


def test_minhash_by_loops(spark, monkeypatch):
    rows = copies(3) + [(r[0], r[1]) for r in ODD] + [(1000, "Hello\tWORLD again"), (1001, "hello world"), (1002, "HELLO  world"), (None, "hello world again"), (1003, None)]
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], DOCS)
    want = plain_classes(rows)
    assert sum(not r[3] for r in want) > 40
    assert classes(df) == want
    monkeypatch.setattr(M, "PAIRS", 1)  # every set of two pairs is dealt over parts
    clash = [F.lit(1).alias(c) for c in ("h", "n", "d1", "sig", "bands", "id", "salt", "component")]
    assert classes(df.select("*", *clash).repartition(6)) == want


def test_minhash_of_one_group_of_near_copies(spark):
    """A chain of copies, each unlike those far from it, and sets that share its bands but stay apart."""
    rnd = random.Random(9)
    text = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(150):
        text = list(text)
        for _ in range(4):
            text[rnd.randrange(300)] = f"x{rnd.randrange(5000)}"
        rows.append((i, " ".join(text)))
        if i % 10 == 0:  # about 70 % alike
            rows.append((500 + i, " ".join(w if rnd.random() < 0.95 else "y" for w in text)))
    df = spark.createDataFrame([(*r, "s", "x") for r in rows], DOCS)
    got = classes(df)
    assert got == plain_classes(rows)
    assert len({r[2] for r in got}) > 2


def test_packed_bits_estimate_similarity(spark):
    rnd, rows = random.Random(2), []
    for share in (0.0, 0.3, 0.6, 0.85, 0.95, 1.0):
        for _ in range(30):
            common, own = int(1000 * share), (1000 - int(1000 * share)) // 2
            draw = lambda n: {rnd.getrandbits(64) for _ in range(n)}
            c = draw(common)
            a, b = (np.array(sorted(c | draw(own)), np.uint64) for _ in range(2))
            rows.append((share, *(M.packed(M.minima(x)).tolist() for x in (a, b))))
            lacking = sum(int(x).bit_count() for x in (M.parities(a) ^ M.parities(b)).view(np.uint64))
            assert lacking <= len(set(a.tolist()) ^ set(b.tolist())) and (share < 1 or lacking == 0)
    df = spark.createDataFrame(rows, "share double, a array<bigint>, b array<bigint>")
    out = df.select("share", M.similarity(F.col("a"), F.col("b")).alias("s"), M.different(F.col("a"), F.col("b")).alias("d")).collect()
    for share in {r.share for r in out}:
        assert abs(np.mean([r.s for r in out if r.share == share]) - share) < 0.04
    assert all(r.d <= M.most_different(0.85) for r in out if r.share >= 0.85)
    assert all(r.d > M.most_different(0.85) for r in out if r.share <= 0.3)
    assert all(r.d == 0 for r in out if r.share == 1)


def test_bands_meet_as_often_as_they_should():
    rnd = random.Random(4)
    met = 0
    for _ in range(300):
        c = [rnd.getrandbits(64) for _ in range(170)]
        a, b = (M.bands(M.minima(np.array(sorted(c + [rnd.getrandbits(64) for _ in range(15)]), np.uint64))) for _ in range(2))
        assert len(a) == len(set(a)) == 25
        met += len(set(a) & set(b))
    assert abs(met / 300 / 25 - 0.85**5) < 0.03


def test_minhash_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert M.minhash_classes(empty).collect() == []
    assert M.minhash_dedup(empty).collect() == []
    odd = spark.createDataFrame(ODD, DOCS)
    assert classes(odd) == plain_classes([(r[0], r[1]) for r in ODD])
    ids = odd.select(F.col("doc_id").cast("string"), "text")
    assert {r.doc_id for r in M.minhash_classes(ids).collect()} == {None if r[0] is None else str(r[0]) for r in ODD}
    assert sorted(str(r.doc_id) for r in M.minhash_dedup(odd).collect()) == ["1", "2", "3", "4", "6", "7", "None"]
    values = pa.array([len(M.shingle_hashes("a b c d " * 20000))])
    assert values[0].as_py() == 4
