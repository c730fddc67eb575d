"""The training-data operators against brute force, libraries, round trips and edge cases."""

import hashlib
import itertools
import math
import collections
import random
import tracemalloc

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from folio.llm import chat, ctw, decontaminate, exact_dedup, line_dedup, mixing, quality, simhash, token_counts, warc

DOCS = "doc_id long, text string, source string, extra string"
ODD = [
    (1, None, "a", "x"), (2, "", None, "x"), (3, "  \t ", "b", None), (4, "Hello  world\nagain", "a", "x"), (5, "Hello world again", "a", "x"),
    (5, "Hello world again", "a", "x"), (6, "日本語 のテキスト です\x1c 　 é", "b", "x"), (None, "no id here", "b", "x"), (7, "word " * 5000 + "😀<|endoftext|>end", "a", "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# 1 token counts
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(docs, odd, empty):
    path, lib = public_tokenizers.path("byte_bpe_50k.json"), library()
    for table in (docs, odd):
        texts = {(r.doc_id, r.text) for r in table.collect()}
        want = sorted((str(i), len((t or "").encode()), n, n > 1024) for i, t in texts for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
        assert sorted({(str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(table, path).collect()}) == want
    assert token_counts.token_counts(empty, path).count() == 0
    assert token_counts.token_counts(odd, path).count() == len(ODD)


def test_token_counts_of_random_text():
    lib, counter = library(), token_counts.MergeCounter(*token_counts.read_merges(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(1)
    pools = ["abcdefgh ", "aA1 .,'\n\t", "éüß日本😀​\xa0\x1c\x85 ", "".join(map(chr, range(0x20, 0x250)))]
    for _ in range(400):
        t = "".join(rnd.choices(rnd.choice(pools), k=rnd.randint(0, 60)))
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), repr(t)
    long = "ab" * 20000 + "z" * 30000
    assert counter.count(long) == len(lib.encode(long, add_special_tokens=False).ids)


# 2 simhash
def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in low).split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def check_simhash(table):
    rows = table.collect()
    got = simhash.simhash_classes(table).collect()
    assert len(got) == len(rows)
    fps = {r.text: plain_fingerprint(r.text) for r in rows}
    values = sorted(set(fps.values()))
    comp = union_find([(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3], values)
    first = {}
    for r in rows:
        if r.doc_id is not None:
            first[comp[fps[r.text]]] = min(r.doc_id, first.get(comp[fps[r.text]], r.doc_id))
    want = sorted((str(r.doc_id), f"{fps[r.text]:016x}", str(first.get(comp[fps[r.text]]))) for r in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_simhash(docs, odd, empty):
    check_simhash(docs)
    check_simhash(odd)
    assert simhash.simhash_classes(empty).count() == 0
    assert simhash.simhash_dedup(odd).columns == odd.columns


@pytest.mark.parametrize("dense", [64, 3])
def test_similar_links_of_dense_fingerprints(spark, monkeypatch, dense):
    """A ball around one value, and random values: the links give the components of all pairs."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for _ in range(400)}
    values |= {rnd.getrandbits(64) for _ in range(200)} | {0, 1, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.similar_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert union_find([(r.u, r.v) for r in links], signed) == union_find(near, signed)
    assert all(((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 3 for r in links)


# 3 context-tree weighting
def test_bit_probabilities_by_direct_mixing():
    """Weights and mixed estimates against the recursion, node by node, over a small tree; dealt over subtrees as well."""
    data, depth = b"abracadabra abracadabra\n" * 3, 4
    grams, n = np.unique(ctw.windows(data, depth + 1), return_counts=True)
    levels, _ = ctw.weigh(grams, n, depth, 0)
    counts = [{} for _ in range(depth + 1)]
    for g, k in zip(grams.tolist(), n.tolist()):
        for d in range(depth + 1):
            context = g.to_bytes(depth + 1, "big")[depth - d : depth]
            counts[d].setdefault(context, [0] * 256)[g & 255] += k

    def kt(z, o):
        return sum(math.log(k + 0.5) for k in range(z)) + sum(math.log(k + 0.5) for k in range(o)) - sum(math.log(k + 1) for k in range(z + o))

    def bits(context, prefix, level):
        v, span = counts[len(context)].get(context, [0] * 256), 256 >> level
        at = prefix * span
        return sum(v[at : at + span // 2]), sum(v[at + span // 2 : at + span])

    def log_w(context, prefix, level):
        e = kt(*bits(context, prefix, level))
        if len(context) == depth:
            return e
        deep = sum(log_w(c, prefix, level) for c in counts[len(context) + 1] if c[1:] == context)
        return np.logaddexp(e, deep) - math.log(2)

    def p_one(context, prefix, level):
        out, left = 0.0, 1.0
        for d in range(depth + 1):
            path = context[depth - d :]
            z, o = bits(path, prefix, level)
            stop = 1.0 if d == depth else math.exp(kt(z, o) - math.log(2) - log_w(path, prefix, level))
            out += left * stop * (o + 0.5) / (z + o + 1)
            left *= 1 - stop
        return out

    asked = [b"abra ", b"raca ", b" abrz", b"xxra ", b"zzzzz"]
    packed = np.array([int.from_bytes(a, "big") for a in asked])
    got = ctw.predict(packed, levels)
    for a, have in zip(asked, got):
        want, prefix = 0.0, 0
        for level in range(8):
            bit = a[-1] >> (7 - level) & 1
            p = p_one(a[:-1], prefix, level)
            want += math.log2(p if bit else 1 - p)
            prefix = prefix * 2 + bit
        assert abs(have - want) < 1e-6
    low, up = ctw.weigh(grams, n, depth, 3)
    top, _ = ctw.weigh(*ctw._sum_by(grams & 0xFFFFFF, n), 2, 0, up)
    assert np.allclose(ctw.predict(packed, top + low), got, atol=1e-12)


def test_head_gives_the_values_it_holds_and_names_the_rest():
    rnd = np.random.default_rng(0)
    keys = rnd.permutation(np.unique(rnd.integers(0, 1 << 48, 5000)))
    values = dict(zip(keys.tolist(), rnd.random(len(keys)).tolist()))
    head = ctw.Head(keys, np.array(list(values.values())))
    asked = np.concatenate([keys[:700], keys[:3], [1, 2]])
    total, rest = head.total(asked)
    held = collections.Counter(asked.tolist()) - collections.Counter(rest.tolist())
    assert math.isclose(total, sum(values[k] * m for k, m in held.items()))
    assert {1, 2} <= set(rest.tolist()) and len(rest) < 350
    assert keys[0] in held
    assert ctw.Head(keys[:0], np.zeros(0)).total(asked)[1].tolist() == asked.tolist()


def test_lm_scores(docs, odd, empty):
    import zlib

    for table, words in ((docs, 50), (docs, 10**6), (odd, 10)):
        rows = table.collect()
        got = ctw.lm_scores(table, max_words=words).toPandas()
        train, held = {}, {}
        for r in rows:
            toks = [*ctw.tokens(r.text or ""), b""]
            out = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 == 0
            held.setdefault(str(r.doc_id), (out, len(toks), toks))
            if not out:
                for t in toks:
                    train[t] = train.get(t, 0) + 1
        n, v = sum(train.values()), len(train)
        for g in got.itertuples():
            key = str(None if g.doc_id != g.doc_id else int(g.doc_id))
            out, k, toks = held[key]
            assert (g.held_out, g.n_tokens, g.train_tokens) == (out, k, n)
            assert g.n_known == sum(t in train for t in toks)
            assert math.isclose(g.base_score, sum(math.log10((train.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in toks), rel_tol=1e-9)
            assert g.score < 0
    assert ctw.lm_scores(empty).count() == 0


def plain_ctw(train, texts, depth):
    """log10 P of each text by the definition: the weighted probability with one more bit over that without, bit by bit."""
    stream = lambda t: b" ".join(t.encode().lower().split()) + b"\n"
    counts = {}

    def path(data, at):
        past = (b"\n" * depth + data)[at : at + depth]
        return [past[depth - d :] for d in range(depth + 1)]

    def bits(byte):
        node = 1
        for k in range(7, -1, -1):
            bit = byte >> k & 1
            yield node, bit
            node = 2 * node + bit

    for t in train:
        data = stream(t)
        for at, byte in enumerate(data):
            for c in path(data, at):
                for node, bit in bits(byte):
                    counts.setdefault((c, node), [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    mix = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)
    below, weighted = collections.Counter(), {}
    for c, node in sorted(counts, key=lambda k: -len(k[0])):
        estimate = kt(*counts[c, node])
        weighted[c, node] = estimate if len(c) == depth else mix(estimate, below[c, node])
        if c:
            below[c[1:], node] += weighted[c, node]
    out = []
    for t in texts:
        data, total = stream(t), 0.0
        for at, byte in enumerate(data):
            for node, bit in bits(byte):
                gained = None  # what the node one depth further gains by the bit
                for c in reversed(path(data, at)):
                    a, b = counts.get((c, node), (0, 0))
                    estimate = kt(a + (bit == 0), b + (bit == 1))
                    new = estimate if len(c) == depth else mix(estimate, below[c, node] + gained)
                    gained = new - weighted.get((c, node), 0.0)
                total += gained
        out.append(total / math.log(10))
    return out


def test_scores_by_the_definition(spark, docs):
    """The query's score of whole texts, in and out of training, unseen bytes and contexts among them, whatever is broadcast."""
    rows = sorted((r for r in docs.collect() if r.text and len(r.text) < 2500), key=lambda r: r.doc_id)[:40]
    rows = [(r.doc_id, r.text) for r in rows] + [(10_000 + i, t) for i, t in enumerate(["", "ZZZ \u4e00\u4e01 qqq", "the the the"])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = None
    for windows in (ctw.MAX_WINDOWS, 300, 0):
        got = {r.doc_id: r for r in ctw.lm_scores(table, max_windows=windows).collect()}
        assert any(r.held_out for r in got.values())
        want = want or plain_ctw([t for i, t in rows if not got[i].held_out], [t for _, t in rows], ctw.DEPTH)
        for (i, _), w in zip(rows, want):
            assert abs(got[i].score - w) < 1e-6 * max(1.0, abs(w)), (windows, i)


# 4 WARC
def test_warc(spark, sf_dir):
    big = "x" * 1000
    rows = [(1, "http://a\r\nX: y", big, "e"), (2, None, big, "e"), (3, "u", big, "e"), (4, "u", "small", "e"), (5, "u", "small", "e"), (6, "u", None, "e"), (None, "u", "é" * 700, "e"), (7, "u", "é" * 700, "e"), (3, "u", big, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string")
    got = warc.write_and_read(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [(by[i].record_type, by[i].refers_to) for i in (1, 2, 3, 4, 5, 6, 7)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("response", None), ("response", None)]
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert by[i].payload == (None if by[i].record_type == "revisit" else html or "")
    assert warc.write_and_read(pages.limit(0)).count() == 0
    real = spark.read.parquet(f"{sf_dir}/pages.parquet")
    texts = {r.page_id: r.payload for r in warc.write_and_read(real).collect()}
    assert texts == {r.page_id: r.html for r in real.collect()}


def test_warc_ranges(spark):
    rows = [("a", k * 100, 100) for k in range(5)] + [("a", 100_000, 10), ("b", 0, 7)]
    index = spark.createDataFrame(rows, "path string, offset long, length long")
    got = sorted((r.path, r.start, r.stop, len(r.parts)) for r in warc.coalesced_ranges(index, gap=50, most=250).collect())
    assert got == [("a", 0, 300, 3), ("a", 300, 500, 2), ("a", 100_000, 100_010, 1), ("b", 0, 7, 1)]


# 5 mixing
def water(sizes, weights, share, cap):
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        for i in full or open_:
            out[i] = cap * sizes[i] if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


@pytest.mark.parametrize("case", ["docs", "odd", "even", "one"])
def test_mixing(spark, docs, odd, case):
    made = {"docs": docs, "odd": odd, "even": spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 3}", "") for i in range(300)], DOCS), "one": odd.where("doc_id = 4")}
    table = made[case]
    rows = table.collect()
    got = mixing.mix_sources(table).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(ctw.tokens(r.text or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    want = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2)))
    of = {str(r.doc_id): r.source for r in rows}
    got["source"] = [of[str(None if i != i else int(i))] for i in got["doc_id"]]
    for s in names:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert np.allclose(part["target"], want[s]) and (part["source_size"] == size[s]).all()
        # whole copies: within half of the largest document, and close once there are enough documents
        slack = part["size"].max() / 2 + 1 if case in ("odd", "one") else max(part.loc[part["size"] > 0, "size"].min(), 0.01 * want[s])
        assert abs(part["taken"].sum() - want[s]) <= slack
    again = mixing.mix_sources(table.repartition(3)).toPandas()
    key = lambda d: sorted(zip(d["doc_id"].astype(str), d["taken"]))
    assert key(got) == key(again)


def test_mixing_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0


def test_tilted_rates_solve_the_constraints(spark):
    rnd = random.Random(2)
    rows = [("a", s, rnd.randint(1, 9)) for s in range(1, 60)] + [("b", 10**k, 3) for k in range(6)]
    classes = spark.createDataFrame(rows, "source string, size long, n long")
    total = {s: sum(z * n for a, z, n in rows if a == s) for s in "ab"}
    targets = spark.createDataFrame([(s, total[s], 1.7 * total[s] if s == "a" else 0.3 * total[s]) for s in "ab"], "source string, source_size long, target double")
    got = mixing.tilted_rates(classes, targets).toPandas()
    for s in "ab":
        g = got[got["source"] == s]
        assert math.isclose((g["rate"] * g["n"] * g["size"]).sum(), g["target"].iloc[0], rel_tol=1e-5)
        inner = g[(g["rate"] < 2) & (g["rate"] > 1e-300)]
        slopes = np.log(inner["rate"]) / inner["size"]
        assert np.allclose(slopes, slopes.iloc[0], rtol=1e-6)


# 6 exact dedup
def test_exact(spark, odd, empty):
    rows = odd.collect()
    norm = lambda t: "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t or "")
    squeeze = lambda t: " ".join(x for x in norm(t).split(" ")) if "  " not in norm(t) else squeeze(norm(t).replace("  ", " "))
    texts = [(r.doc_id, squeeze(r.text)) for r in rows]
    want = []
    for i, t in texts:
        ids = [j for j, u in texts if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((str(i), str(keep), len(ids), i is not None and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = [(str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd, salts=2).collect()]
    assert sorted(got) == sorted(want)
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.exact_dedup(odd).columns == odd.columns
    rows = [(1, "same  text", "s", "e"), (None, "same text", "s", "e"), (2, "same text", "s", "e"), (None, "alone", "s", "e"), (None, "alone", "s", "e"), (3, "x", "s", "e")]
    for dedup in (exact_dedup.exact_dedup, simhash.simhash_dedup):
        assert sorted(map(str, dedup(spark.createDataFrame(rows, DOCS)).toPandas()["doc_id"].fillna(-1).astype(int))) == ["-1", "-1", "1", "3"]


# 7 decontamination
ITEMS = [(1, "Alice Smith bought 12 apples for 3 dollars at the market and Alice Smith gave 12 away before noon"), (2, None), (3, "tiny item here"), (4, "")]


def contaminated(spark, texts):
    docs = spark.createDataFrame([(i, t, "s", "e") for i, t in enumerate(texts)], DOCS)
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}


def test_decontamination(spark):
    verbatim = "Intro words. " + ITEMS[0][1] + " More."
    moved = "We know: Boris Jones bought 40 apples for 9 euros at the market and Boris Jones gave 40 away before noon"
    torn = "We know: Boris Jones bought 40 apples for 9 euros at the market and Carla Brown gave 77 away before noon"
    got = contaminated(spark, [verbatim, moved, torn, None, "", "A tiny ITEM, here!", "nothing of the kind is in this clean text about other things", verbatim.upper()])
    assert {k for k in got} == {(0, 1), (1, 1), (5, 3), (7, 1)}
    assert not got[0, 1].reparameterised and got[1, 1].reparameterised and got[1, 1].n_conflicts == 0


def test_decontamination_of_several_copies(spark):
    """Copies with other values beside each other, in one text or in rows of one id, are judged one by one."""
    verbatim = ITEMS[0][1]
    moved = "Boris Jones bought 40 apples for 9 euros at the market and Boris Jones gave 40 away before noon"
    third = "Carla Brown bought 77 apples for 5 pounds at the market and Carla Brown gave 77 away before noon"
    torn = "Boris Jones bought 40 apples for 9 euros at the market and Carla Brown gave 77 away before noon"
    longer = third.replace(" at the market", " at the old market")
    lists = ["a. ".join(["We know: ", x, y, "end"]) for x, y in [(verbatim, moved), (moved, third), (torn, torn), (longer, moved)]]
    got = contaminated(spark, lists)
    assert {k for k in got if k[1] == 1} == {(0, 1), (1, 1), (3, 1)}
    assert all(got[i, 1].n_conflicts == 0 and got[i, 1].share > 0.25 for i in (0, 1, 3))
    rows = spark.createDataFrame([(7, "We know: " + verbatim, "s", "e"), (7, "We know: " + moved, "s", "e"), (8, "clean", "s", "e")], DOCS)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(rows, items).collect()] == [(7, 1)]


def test_decontamination_of_number_heavy_items(spark):
    """Items whose windows are mostly placeholders are found word for word, and only so."""
    texts = ["What is 12 + 35 * 4 - 3 / 2?", "Table: 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16", "42"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    found = ["So: " + texts[0] + " Nobody knows.", "see " + texts[1] + " there"]
    other = ["So: What is 13 + 35 * 4 - 3 / 2? Nobody knows.", "see Table: 21 22 23 24 25 26 27 28 29 30 31 32 33 34 35 36 there", "no number"]
    docs = spark.createDataFrame([(i, t, "s", "e") for i, t in enumerate([*found, *other, "of 42 men"])], DOCS)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(got) == {(0, 0), (1, 1), (5, 2)}
    assert all(r.share == 1 and not r.reparameterised for r in got.values())


def test_reparameterised_items_are_found(spark):
    """Items with other names, numbers and units are found, in nine of ten at least; torn copies and other texts are not. Both join paths agree."""
    rnd = random.Random(14)
    names, places, things, units = ["Ann", "Bert", "Carla", "Dirk", "Elsa", "Fred"], ["Rome", "Paris", "Oslo", "Kyiv"], ["pears", "books", "stones", "lamps", "coins"], ["kg", "miles", "hours", "euros"]
    forms = [
        "{a} travels from {p} to {q} in {n} {u} and pays {m} {v} for the way, while {a} also buys {k} {t}. How much does {a} spend?",
        "A shop in {p} sells {n} {t} for {m} {v} each. {a} and {b} share {k} of them. What does {b} owe {a}?",
        "If {n} plus {m} {u} is what {a} has, and {b} takes {k} {u} away, how many {u} are left for {a}?",
        "Compute {n} * {m} + {k} and tell {a} whether it is more than {n}.",
    ]

    def values():
        a, b = rnd.sample(names, 2)
        p, q = rnd.sample(places, 2)
        n, m, k = rnd.sample(range(2, 500), 3)
        u, v = rnd.sample(units, 2)
        return dict(a=a, b=b, p=p, q=q, n=n, m=m, k=k, u=u, v=v)

    items, rows, want = [], [], set()
    for i in range(40):
        made = rnd.choice(forms).replace("{t}", rnd.choice(things)) + " " + " ".join(rnd.sample("which one of these is it then please say so now".split(), 6))
        items.append((i, made.format(**values())))
        for _ in range(3):
            rows.append((len(rows), "some text before, and " + made.format(**values()) + " and after it", "s", "e"))
            want.add((rows[-1][0], i))
    clean = len(rows)
    rows += [(len(rows) + j, " ".join(rnd.choices("the a of and shop way text more after before many some 12 7 Rome Ann".split(), k=60)), "s", "e") for j in range(40)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert sum((r.doc_id, r.item_id) in want for r in found) >= 0.9 * len(want)
    assert all(r.doc_id < clean for r in found)
    assert sorted(decontaminate.contaminated(docs, bench, broadcast_rows=0).collect()) == sorted(found)


def test_decontamination_edges(spark, odd, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == len(ODD)
    assert decontaminate.decontaminate(odd, items).columns == odd.columns


def test_planted_items_are_found(spark, docs, sf_dir):
    """Every document that holds an item's words in a row, and no other."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bare = lambda t: " " + " ".join("".join(c if c.isalnum() else " " if c.isspace() else "" for c in t.lower()).split()) + " "
    items = {r.item_id: bare(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for b in [bare(r.text)] for i, t in items.items() if t in b}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want


# 8 chat
def legal(roles):
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return len(roles) > 0 and len(roles) % 2 == 0 and all(r == ("user", "assistant")[k % 2] for k, r in enumerate(roles))


def cheapest(roles):
    """Least cost by trying every choice."""
    best = math.inf
    names = chat.ROLES
    for choice in itertools.product(*[[(w, m, ins) for w in names for m in (True, False) for ins in ((), ("user",), ("assistant",), ("user", "assistant"))] for _ in roles]):
        out, cost = [], 0
        for r, (w, merge, ins) in zip(roles, choice):
            cost += 0 if w == r else chat.RELABEL if r in names else chat.NAMING
            if merge:
                if ins or not out or out[-1] != w:
                    break
                cost += chat.MERGE
            else:
                out += [*ins, w]
                cost += chat.INSERT * len(ins)
        else:
            for end in ((), ("assistant",), ("user", "assistant")):
                if legal(out + list(end)):
                    best = min(best, cost + chat.INSERT * len(end))
    return best


def test_chat_costs_are_least(spark):
    rnd = random.Random(5)
    convs = [[rnd.choice(["system", "user", "assistant", "tool", None]) for _ in range(rnd.randint(1, 3))] for _ in range(25)]
    rows = [(c, t, r, f"{c}.{t}", "x") for c, roles in enumerate(convs) for t, r in enumerate(roles)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, block string")).collect()}
    assert len(got) == len(convs)
    for c, roles in enumerate(convs):
        assert got[c].cost == cheapest(roles) == shortest(roles), roles
        assert legal(roles_of(got[c].text))
        assert all(f"{c}.{t}" in got[c].text for t in range(len(roles)))


def roles_of(text):
    return [line[2:-2] for line in text.split("\n") if line[:2] == "<|" and line != "<|end|>"]


def shortest(roles):
    """Least cost over whole sequences of turns, one input turn after the other."""
    best = {(): 0}  # what has been written, cut to what matters: whether there is a turn, and its role
    may = {(): ("system", "user"), ("system",): ("user",), ("user",): ("assistant",), ("assistant",): ("user",)}
    for r in roles:
        after = {}
        for last, cost in best.items():
            for w in chat.ROLES:
                cost_w = cost + (0 if w == r else chat.RELABEL if r in chat.ROLES else chat.NAMING)
                if last == (w,):
                    after[(w,)] = min(after.get((w,), math.inf), cost_w + chat.MERGE)
                frontier, paid = {last}, 0
                for _ in range(3):  # with 0, 1 or 2 empty turns in front
                    if any(w in may[x] for x in frontier):
                        after[(w,)] = min(after.get((w,), math.inf), cost_w + paid)
                        break
                    frontier, paid = {(x,) for f in frontier for x in may[f] if x != "system"}, paid + chat.INSERT
        best = after
    return min(c + {"assistant": 0, "user": chat.INSERT, "system": 2 * chat.INSERT}[last[0]] for last, c in best.items())


def test_chat_table(spark, sf_dir):
    """Every given conversation: one row, least cost, legal roles, every text in order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    want = {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
        want.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(want) and len(got) == chat.format_chats(turns).count()
    for c, rows in want.items():
        assert got[c].cost == shortest([r.role for r in rows]) and legal(roles_of(got[c].text)), c
        assert got[c].n_turns == len(rows)
        at = 0
        for r in rows:
            at = got[c].text.index(r.text or "", at) + len(r.text or "")


def test_chat_rows_do_not_depend_on_partitions(spark, monkeypatch):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", None]), f"t{t}") for c in (1, None, 2) for t in range(300 if c == 1 else 40)]
    turns = spark.createDataFrame([*rows, (3, None, None, None)], "conv_id long, turn int, role string, text string")
    whole = {r.conv_id: r for r in chat.format_chats(turns).collect()}
    assert len(whole) == 4 and legal(roles_of(whole[1].text)) and whole[1].cost == shortest([r[2] for r in rows if r[0] == 1])
    assert [w for w in whole[1].text.split() if w[0] == "t"] == [f"t{t}" for t in range(300)]
    assert chat.format_chats(turns.limit(0)).count() == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for block in (16, 50):
        monkeypatch.setattr(chat, "BLOCK", block)
        for n in ("1", "3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.conv_id: r for r in chat.format_chats(turns.repartition(int(n))).collect()} == whole
    spark.conf.set("spark.sql.shuffle.partitions", before)


# 9 quality
def test_quality_on_unseen_labels(spark):
    """Half of the labels are hidden from the fit and still met."""
    whole = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    got = quality.quality_scores(whole, labels.where(half)).join(labels.where(~half), "doc_id").toPandas()
    bad = (got["quality"] == 0) | (got["toxic"] == 1)
    assert (got.loc[~bad, "kept"]).mean() > 0.99 and (~got.loc[bad, "kept"]).mean() > 0.85


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd, labels).count() == len(ODD)
    assert quality.quality_scores(odd, labels.limit(0)).count() == len(ODD)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_filter(odd, labels).columns == odd.columns


def test_em_estimates_accuracies():
    """Votes made with known accuracies, given labels among them, on junk of two kinds."""
    rnd = np.random.default_rng(4)
    n = 20_000
    kind = rnd.choice([0, 2, 4], n, p=[0.7, 0.2, 0.1])
    patterns = np.zeros((n, 8), int)
    hit = lambda truth, found, false: np.where(rnd.random(n) < np.where(truth, found, false), quality.BAD, quality.GOOD)
    patterns[:, 1], patterns[:, 3] = hit(kind == 2, 0.9, 0.02), hit(kind == 4, 0.7, 0.01)
    patterns[:, 6] = np.where(rnd.random(n) < 0.3, hit(kind > 0, 0.85, 0.05), quality.NONE)
    patterns[:, 7] = quality.NONE
    unique, inverse, counts = np.unique(patterns, axis=0, return_inverse=True, return_counts=True)
    p, _, table = quality.estimate_accuracies(unique, counts.astype(float))
    assert abs(table[1, 2, quality.BAD] - 0.9) < 0.1 and abs(table[6, 2, quality.BAD] - 0.85) < 0.1 and table[6, 0, quality.BAD] < 0.12
    caught = p[inverse.reshape(-1)] > 0.5
    assert caught[kind == 2].mean() > 0.85 and caught[kind == 0].mean() < 0.05


def slow_em(patterns, counts, rounds):
    """The same estimate, loop by loop: P(bad) of each pattern."""
    good, bad, none, kinds = quality.GOOD, quality.BAD, quality.NONE, range(8)
    right = {(j, c): good for j in range(8) for c in kinds}
    right |= {(j, j + 1): bad for j in range(5)} | {(6, c): bad for c in range(1, 7)} | {(5, 7): bad, (7, 7): bad, (6, 7): none}
    p = []
    for x in patterns:
        share = [0.0] * 8
        for j in range(5):
            share[j + 1] = float(x[j] == bad)
        share[7] = (x[5] == bad) + 2.0 * (x[7] == bad)
        if not sum(share):
            share[6 if x[6] == bad else 0] = 1.0
        p.append([(y + 0.02) / (sum(share) + 0.16) for y in share])

    def tables():
        weight = [sum(q[c] * n for q, n in zip(p, counts)) for c in kinds]
        table = {}
        for j in range(8):
            for c in kinds:
                says = lambda v: 10.0 if right[j, c] == none else 18.0 if right[j, c] == v else 2.0  # noqa: E731, B023
                told = {v: (1.0 if v == none else says(v)) + sum(q[c] * n for q, n, x in zip(p, counts, patterns) if x[j] == v) for v in range(3) if j < 6 or v != none}
                table |= {(j, c, v): told[v] / sum(told.values()) if v in told else 1.0 for v in range(3)}
        return [(w + 1) / (sum(weight) + 8) for w in weight], table

    for _ in range(rounds):
        prior, table = tables()
        p = [[prior[c] * math.prod(table[j, c, v] for j, v in enumerate(x)) for c in kinds] for x in patterns]
        p = [[y / sum(q) for y in q] for q in p]
    _, table = tables()
    return [sum(y * (1 - (1 - table[6, c, bad]) * (1 - table[7, c, bad])) for c, y in enumerate(q)) for q in p]


def test_em_by_loops():
    rnd = random.Random(2)
    patterns = sorted({tuple(rnd.choices((0, 1, 2), (6, 2, 1), k=8)) for _ in range(30)})
    counts = [rnd.randint(1, 50) for _ in patterns]
    for rounds in (0, 1, 2, 7):
        p, *_ = quality.estimate_accuracies(np.array(patterns), np.array(counts, float), rounds)
        assert np.allclose(p, slow_em(patterns, counts, rounds), atol=1e-9)


def test_quality_by_hand(spark, docs, sf_dir):
    """Scores of the query against the same model worked out without Spark; without EM they are others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    given = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    toxic = collections.Counter(w for i, (_, t) in given.items() if t == 1 for w in quality.words_of(texts[i]))
    seen = collections.Counter(w for i, (_, t) in given.items() if t is not None for w in quality.words_of(texts[i]))
    share = quality.CUE_SHARE
    cues = frozenset(sorted((w for w, n in toxic.items() if n >= quality.CUE_DOCS and n >= share * seen[w]), key=lambda w: (-toxic[w], w))[: quality.CUES])
    coded = {}
    for i, t in texts.items():
        q, x = given.get(i, (None, None))
        coded[i] = (*quality.votes(t, cues), 2 if q is None else 1 - q, 2 if x is None else x)
    counts = collections.Counter(coded.values())
    p = dict(zip(sorted(counts), slow_em(sorted(counts), [counts[x] for x in sorted(counts)], 120)))
    weak = {i: p[c] for i, c in coded.items()}
    assert all(abs(weak[i] - r.weak_p) < 1e-3 for i, r in got.items())
    ids = sorted(texts)
    slots = [sorted({quality.slot(f) for f in quality.features(texts[i])}) for i in ids]
    w, b = quality.fit_logistic(np.repeat(np.arange(len(ids)), list(map(len, slots))), np.concatenate(slots), np.array([weak[i] for i in ids]), 1 << quality.BITS)
    for i, s in zip(ids, slots):
        assert abs(got[i].p_bad - 1 / (1 + math.exp(-(b + sum(w[x] for x in s))))) < 0.01
    plain = {r.doc_id: r.p_bad for r in quality.quality_scores(docs, labels, rounds=0).collect()}
    assert max(abs(plain[i] - got[i].p_bad) for i in ids) > 0.05


# 10 line dedup
def _brute(rows, threshold):
    lines = {}
    for r in rows:
        for k, raw in enumerate((r.text or "").split("\n")):
            t = " ".join("".join(" " if c in " \t\r\x0b\x0c" else c for c in raw).split(" ")).strip(" ")
            t = " ".join(x for x in t.split(" ") if x)
            if t:
                lines.setdefault(t, []).append((r.doc_id, k))
    sets = {t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else {t} for t in lines}
    index = {}
    for t, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(t)
    pairs = []
    for t, s in sets.items():
        rare = sorted(s, key=lambda x: len(index[x]))[: int(0.2 * len(s)) + 1]
        for u in {u for x in rare for u in index[x] if u < t}:
            common = len(s & sets[u])
            if common >= threshold * (len(s) + len(sets[u]) - common):
                pairs.append((t, u))
    return lines, pairs


def brute_links(rows, threshold=0.8):
    lines, pairs = _brute(rows, threshold)
    return [(min(lines[t]), min(lines[u])) for t, u in pairs]


def brute_lines(rows, threshold=0.8):
    lines, pairs = _brute(rows, threshold)
    comp = union_find(pairs, lines)
    keep = {}
    for t, c in comp.items():
        keep[c] = min([*lines[t], *([keep[c]] if c in keep else [])])
    return set(keep.values())


def test_quality_fit_by_blocks(monkeypatch):
    """Blocks of any size give the same weights to the last bit, and a step needs no copy of all features."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 400, 3000)
    owner, slots, target = np.repeat(np.arange(3000, dtype=np.int32), lengths), rng.integers(0, 5000, lengths.sum()).astype(np.int32), rng.random(3000)
    want, bias = quality.fit_logistic(owner, slots, target, 5000, rounds=5)
    monkeypatch.setattr(quality, "BLOCK", 70)
    tracemalloc.start()
    got, again = quality.fit_logistic(owner, slots, target, 5000, rounds=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (want == got).all() and bias == again and peak < 14 * len(slots)


def test_line_dedup_recall(docs):
    """At least nine of ten of the links that brute force finds, and no other line is dropped."""
    want = brute_lines(docs.collect())
    got = {(r.doc_id, n) for r in line_dedup.kept_lines(docs).collect() for n in r.lines}
    assert want <= got and len(got - want) <= 0.1 * max(1, len(want) // 10)


def test_line_dedup_of_near_copies(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rnd.choices(words, k=40)) for _ in range(20)]
    rows = []
    for i in range(160):
        w = base[i % 20].split()
        w[rnd.randrange(40)] = "changed"
        rows.append((i, " ".join(w) + "\n\n" + " ".join(rnd.choices(words, k=30)), "s", "e"))
    docs = spark.createDataFrame(rows, DOCS)
    got = {(r.doc_id, n) for r in line_dedup.kept_lines(docs).collect() for n in r.lines}
    assert got == brute_lines(docs.collect())


def _similar(a, b):
    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def test_line_links_are_met_by_class(spark):
    """Similar lines share a key: all of them in short lines, nearly all in longer ones, whatever they are made of."""
    rnd = random.Random(9)
    word = lambda lo=2, hi=9: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(lo, hi)))
    rows = [("short", "Read more", "Read more."), ("short", "Share it", "Share it!"), ("short", "Item 00000017", "Item 00000017.")]

    def fill(kind, make, change, n=120):
        while sum(r[0] == kind for r in rows) < n:
            a = make()
            b = change(a)
            if a != b and _similar(a, b):
                rows.append((kind, a, b))

    def one_character(a):
        at = rnd.randrange(len(a))
        return a + "." if rnd.random() < 0.3 else a[:at] + "#" + a[at + 1 :]

    def first_letters(a):
        ws = a.split()
        for at in rnd.sample(range(len(ws)), max(1, len(ws) // 6)):
            ws[at] = rnd.choice("qrstuvwxyz") + ws[at][1:]
        return " ".join(ws)

    for least in (8, 12, 16, 20, 24, 40, 61, 81, 101, 200):
        fill(f"{least}", lambda k=least: " ".join(word() for _ in range(60))[: k + rnd.randrange(3 if k < 60 else 20)], one_character)
    for n in (6, 12, 30):
        fill(f"first letters of {n}", lambda k=n: " ".join(word(9, 13) for _ in range(k)), first_letters)
    fill("code", lambda: word(100, 300), one_character)
    fill("words", lambda: " ".join(word() for _ in range(80)), lambda a: " ".join(w if rnd.random() < 0.96 else word() for w in a.split()))
    keys = lambda c: line_dedup.band_keys(F.col(c), 0.8)
    met = spark.createDataFrame(rows, "k string, a string, b string").groupBy("k").agg(F.avg(F.arrays_overlap(keys("a"), keys("b")).cast("int")).alias("met"))
    recall = {r.k: r.met for r in met.collect()}
    assert all(v == 1 for k, v in recall.items() if k in ("short", "8", "12", "16", "20")), recall
    assert all(v >= 0.9 for v in recall.values()) and sum(recall.values()) / len(recall) >= 0.97, recall


def test_line_links_of_documents(spark):
    """Of the links that brute force finds on the given documents, at least nine of ten join the same component, and no other lines do."""
    whole = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = line_dedup.line_components(whole)
    table = {(int(r.place) >> 31, int(r.place) & (1 << 31) - 1): r.component for r in lines.collect()}
    links = brute_links(whole.collect())
    assert len(links) > 20
    assert sum(table[a] == table[b] for a, b in links) >= 0.9 * len(links)
    sizes = collections.Counter(table.values())
    assert sum(n - 1 for n in sizes.values()) <= len(table) - len(set(union_find(links, table).values()))


def test_line_buckets_that_are_split(spark, monkeypatch):
    """Buckets over the bound are split by wider bands and give the same lines."""
    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(300)]
    base = [rnd.choice(words) for _ in range(40)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rnd.sample(range(40), rnd.choice((1, 2, 3, 6))):
            w[at] = rnd.choice(words)
        rows.append((i, " ".join(w), "s", "e"))
    docs = spark.createDataFrame(rows, DOCS)
    want = brute_lines(docs.collect())
    whole = {(r.doc_id, n) for r in line_dedup.kept_lines(docs).collect() for n in r.lines}
    monkeypatch.setattr(line_dedup, "BUCKET", 4)
    split = {(r.doc_id, n) for r in line_dedup.kept_lines(docs).collect() for n in r.lines}
    assert want <= whole and len(whole - want) <= 2 and want <= split and len(split - want) <= 12


def test_line_dedup_edges(spark, odd, empty):
    rows = [(1, "same line here\n\nother\nsame line here", "s", "e"), (2, "same line here", "s", "e"), (3, None, "s", "e"), (4, "  \n", "s", "e"), (5, "同じ行です\n同じ行です。", "s", "e")]
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: "same line here\n\nother", 3: None, 4: "  \n", 5: "同じ行です\n同じ行です。"}
    assert line_dedup.line_dedup(odd).columns == odd.columns
    named = spark.createDataFrame([("b", "one line\ntwo lines", 1, 2), ("a", "one line", 3, 4), (None, "two lines", 5, 6)], "doc_id string, text string, _kept int, lines int")
    kept = {r.doc_id: (r.text, r._kept, r.lines) for r in line_dedup.line_dedup(named).collect()}
    assert kept == {"a": ("one line", 3, 4), "b": ("two lines", 1, 2)}
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in line_dedup.line_report(named).collect()} == {("a", 1, 0), ("b", 2, 1), (None, 1, 1)}
    long = spark.createDataFrame([(1, "word " * 60_000 + "\nshort", "s", "e"), (2, "word " * 59_999, "s", "e")], DOCS)
    assert {r.doc_id: r.kept for r in line_dedup.line_report(long).collect()} == {1: [0, 1], 2: []}
    assert line_dedup.line_dedup(empty).count() == 0 and line_dedup.line_report(empty).count() == 0
    assert line_dedup.line_report(odd).count() == len(ODD)


# the pipeline
def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, repeated ids, empty and long texts, clashing names, empty tables: every stage keeps the columns and loses no row it should not."""
    import corpus_pipeline

    names = ["doc_id", "text", "source", "kept", "component_id", "size", "row"]
    rows = [(*r, 1, 2, 3) for r in ODD]
    clashing = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string, component_id int, size int, row int")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "something that is in no text at all here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == names, name
        ids = [r.doc_id for r in out.collect()]
        assert all(ids.count(i) <= [r[0] for r in ODD].count(i) for i in ids), name
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0, name
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, clashing, str(tmp_path)).count() == len(ODD) and stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    clashing.drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(ODD)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, sf_dir)
        assert after.columns == docs.columns, name
        assert after.select("doc_id").subtract(at.select("doc_id")).count() == 0
        at = spark.createDataFrame(after.collect(), docs.schema)
        kept.append(at.count())
    assert docs.count() > kept[0] > kept[1] >= kept[2] >= kept[3] > 0
    final = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(final) == kept[-1] and set(final["doc_id"]) == {r.doc_id for r in at.collect()}
