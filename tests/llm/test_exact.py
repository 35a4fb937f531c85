"""Operators with exact results, against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import components, decontamination, mixing, pii, sharding, simhash, substrings, suffixes, topk
from tabloom.llm.common import mix, rolling, sliding_min

BIG = 1 << 62


def order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def tidy(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


# --- shared kernels


def test_rolling_and_sliding():
    x = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x1234567)
    for w in (1, 2, 5, 19, 20, 39, 40):
        want = [sum(int(x[i + j]) * pow(77, j, 1 << 64) for j in range(w)) % (1 << 64) for i in range(len(x) - w + 1)]
        assert rolling(x, w, 77).tolist() == want
        if w <= len(x):
            assert sliding_min(mix(x), w).tolist() == [min(mix(x)[i : i + w].tolist()) for i in range(len(x) - w + 1)]


# --- sharding


def slow_table(names, slots):
    pref = []
    for n in names:
        o, s = sharding._number(f"offset|{n}") % slots, sharding._number(f"skip|{n}") % (slots - 1) + 1
        pref.append([(o + i * s) % slots for i in range(slots)])
    owner, left = {}, slots
    while left:
        for i, p in enumerate(pref):
            slot = next((x for x in p if x not in owner), None)
            if slot is not None:
                owner[slot], left = i, left - 1
    return [owner[i] for i in range(slots)]


def test_sharding_table():
    names = tuple("abcdefg")
    assert list(sharding.lookup_table(names, 101)) == slow_table(names, 101)
    full = sharding.lookup_table(tuple(f"s{i:02}" for i in range(20)), 2003)
    assert max(map(full.count, range(20))) - min(map(full.count, range(20))) <= 1
    less = sharding.lookup_table(tuple(f"s{i:02}" for i in range(19)), 2003)
    assert sum(a != b for a, b in zip(full, less)) < 0.35 * 2003
    for bad in (100, 1):
        with pytest.raises(ValueError):
            sharding.lookup_table(names, bad)


def test_sharding_rows(docs, no_docs, rows):
    got = sharding.assign_shards(docs, shards=7, slots=101).collect()
    assert len(got) == len(rows)
    table = sharding.lookup_table(tuple(f"shard-{i:05d}" for i in range(7)), 101)
    for r in got:
        slot = int(hashlib.md5(str("null" if r.doc_id is None else r.doc_id).encode()).hexdigest()[:15], 16) % 101
        assert (r.shard_slot, r.shard) == (slot, table[slot])
    assert set(docs.columns) <= set(got[0].asDict())
    assert sharding.assign_shards(no_docs).count() == 0
    plan = sharding.assign_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- personal data

SLOW = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def slow_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    fine = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 16 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}
    return {k: [m.span() for m in p.finditer(text) if fine[k](m[0])] for k, p in SLOW.items()}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.b@+-1 29(5é%_", max_size=60))
def test_pii_base(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_pii_base_cards():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["4111111111111111", "1.2.3.4", "+49 30 1234-567", " ", "-", "0", "256.1.1.1", "x@y.z", "4242 4242 4242 4242"]) for _ in range(6))
        assert pii.base_spans(text) == slow_spans(text)


def test_pii_rows(docs, no_docs, rows):
    got = {(r.doc_id, r.text): r for r in pii.detect(docs, ["doc_id", "text"]).collect()}
    for x in rows:
        base = slow_spans(x[1] or "")
        assert [(s.kind, s.start, s.end) for s in got[x[0], x[1]].base] == [(k, *s) for k in pii.KINDS for s in base[k]]
    assert pii.detect(no_docs, ["doc_id"]).count() == 0


def test_pii_long_runs():
    m = pii.cloudpickle.loads(pii.model())
    for piece in (" ", "9", "a", "@", "a@", "1.", "+1 ", "(", "dot ", "- "):
        start = time.time()
        pii.find(piece * 60_000, m)
        assert time.time() - start < 20


def test_pii_adds_and_leaves():
    m = pii.cloudpickle.loads(pii.model())
    assert pii.find("please mail john.doe at example dot com today", m)[1] == [("email", 12, 39)]
    assert pii.find("call me on (415) 555-0134 now", m)[1][0][0] == "phone"
    for clean in ("on 2021-03-04 we met", "version 1.22.3456 is out", "we met at noon on the dot", "total 12345678 items", "plain words only"):
        assert pii.find(clean, m) == ({k: [] for k in pii.KINDS}, [])
    held = pii.examples(1500, seed=99)
    z = pii.margin(m["trees"], np.array([pii.describe(t, k, a, b) for t, k, a, b, _ in held]))
    y = np.array([h[4] for h in held])
    assert ((z > 0) == y).mean() > 0.9


def test_pii_planted_variants(spark):
    """Variants of formats and names that training never saw, planted in whole corpus texts; and what is added to texts without any."""
    m, r = pii.cloudpickle.loads(pii.model()), random.Random(31)
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if x.text and len(x.text.split()) > 20]
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(["Maria", "j.smith", "peter_k", "anne-lou", "QuynhT", "info", "s.o'brien"[:3], "olaf77"])

    def card():
        d = "4" + digits(14)
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    def spaced(d):
        return " ".join(d[i : i + 4] for i in range(0, 16, 4))

    variants = {
        "email": lambda: name() + r.choice([" at ", " [at] ", "(at)", " AT "]) + r.choice(["uni-bonn", "mail", "acme"]) + r.choice([" dot ", "[dot]", " DOT "]) + r.choice(["de", "com", "org"]),
        "email2": lambda: name() + " at mail dot example dot " + r.choice(["com", "net", "fr"]),
        "ip": lambda: r.choice(["[.]", "(.)", " dot ", "[dot]"]).join(str(r.randint(1, 255)) for _ in range(4)),
        "card": lambda: spaced(card()) + " " + spaced(card()),
        "phone": lambda: r.choice(["call ", "phone ", "tel. ", "fax: "]) + r.choice([f"({r.randint(201, 989)}) {r.randint(200, 999)}-{digits(4)}", f"{r.randint(201, 989)}-{r.randint(200, 999)}-{digits(4)}"]),
    }
    told = {}
    for kind, make in variants.items():
        hit = extra = 0
        for k in range(120):
            words, s = r.choice(texts).split(" "), make()
            at = r.randrange(len(words))
            before = " ".join(words[:at]) + " "
            text = before + s + " " + " ".join(words[at:])
            found = [(a, z) for c, a, z in pii.find(text, m)[1] if c == kind.rstrip("2")]
            lo = len(before) + (s.index(" ") + 1 if kind == "phone" else 0)
            inside = [f for f in found if f[0] < len(before) + len(s) and f[1] > lo]
            hit += len(inside) >= (2 if kind == "card" else 1)
            extra += len(found) - len(inside)
        told[kind] = (hit / 120, extra)
    added = sum(len(pii.find(t, m)[1]) for t in texts)
    print("recall and stray spans of planted variants", told, "added to", len(texts), "whole texts:", added)
    assert all(h >= 0.9 for h, _ in told.values()) and sum(e for _, e in told.values()) <= 6 and added <= 3


# --- repeated word windows


def slow_windows(rows, width):
    seen, out = set(), []
    for i, text, *_ in order(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            if key in seen:
                gone[p : p + width] = [True] * width
            seen.add(key)
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [2, 20])
def test_substrings(docs, no_docs, rows, width):
    got = substrings.remove_repeats(docs, width).collect()
    assert tidy(got, "doc_id", "n_words", "n_removed", "kept_text") == slow_windows(rows, width)
    assert substrings.remove_repeats(no_docs).count() == 0


# --- repeated byte strings


def slow_bytes(rows, length):
    first, out = {}, []
    data = [(BIG if x[0] is None else x[0], x[0], (x[1] or "").encode()) for x in order(rows)]
    for k, _, b in data:
        for p in range(len(b) - length + 1):
            first[b[p : p + length]] = min(k, first.get(b[p : p + length], BIG))
    for k, i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < k:
                gone[p : p + length] = b"\1" * length
        out.append((i, len(b), sum(gone), bytes(gone).decode("latin1").count("\0\1") + (gone[:1] == b"\1"), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=repr)


def test_suffix_order():
    r = random.Random(3)
    for trial in range(60):
        s = bytes(r.choice(b"ab" if trial % 2 else b"abcd") for _ in range(r.randint(1, 300)))
        if trial % 3 == 0:
            s = (s[:31] * 12)[: len(s)]
        for need in (1, 4, 10, 50):
            at = suffixes.suffix_order(np.frombuffer(s, np.uint8).astype(np.uint64) + np.uint64(1), need)
            prefixes = [s[i : i + need] for i in at]
            assert sorted(at.tolist()) == list(range(len(s))) and prefixes == sorted(prefixes)


@pytest.mark.parametrize("length,gram", [(50, 16), (12, 5)])
def test_suffixes(docs, no_docs, rows, length, gram):
    got = [{**r.asDict(), "kept": bytes(r.kept)} for r in suffixes.remove_repeats(docs, length, gram).collect()]
    assert tidy(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == slow_bytes(rows, length)
    assert suffixes.remove_repeats(no_docs).count() == 0


def test_suffixes_repetitive(spark):
    r = random.Random(8)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.randint(0, 200))) if i % 3 else "ab" * r.randint(0, 90)) for i in range(40)]
    got = [{**x.asDict(), "kept": bytes(x.kept)} for x in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 14, 5).collect()]
    assert tidy(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == slow_bytes(rows, 14)


# --- top k


def slow_topk(vectors, k, every):
    fine = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in fine:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in fine if c != q)
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk(spark, scale):
    r = random.Random(1)
    vectors = [(i, [r.gauss(0, 1) * scale * (4 if i % 7 == 0 else 1) for _ in range(24)]) for i in range(150)]
    vectors += [(200 + i, vectors[5][1]) for i in range(30)] + [(300, None), (None, [1.0]), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (305, [2.0, -1.0]), (320, [])]
    df = topk.quantised(spark.createDataFrame([(*v, 0, "x") for v in vectors], "vec_id long, embedding array<double>, label int, id string"), "vec_id", "embedding")
    for rows in (8192, 40):
        got = topk.top_k(df.filter("id % 5 = 0").unionByName(df.filter("id = 10")), df, 6, rows, rows).collect()  # equal rows are one query
        assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == slow_topk(vectors, 6, 5)
    few = df.filter("id < 4")
    assert topk.top_k(few, few, 20).count() == 12
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_rows_that_share_an_id(spark):
    vectors = [(20, [2.0, 0.0]), (20, [0.0, 2.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])] + [(i, [float(i), 10.0 - i]) for i in range(1, 10)]
    df = topk.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = topk.top_k(df.filter("id % 20 = 0"), df, 6).collect()
    want = []
    for a in {tuple(v) for i, v in vectors if i == 20}:
        scored = sorted((-sum(int(64 * x) * int(64 * y) for x, y in zip(a, v)), i) for i, v in vectors if i != 20)
        want += [(20, n + 1, i, -s) for n, (s, i) in enumerate(scored[:6])]
    assert sorted((g.query_id, g["rank"], g.vec_id, g.score) for g in got) == sorted(want) and len(got) == 18


# --- decontamination


def slow_hits(rows, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    known = {}
    for name, text in items:
        w = words(text)
        n = min(width, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            known.setdefault(tuple(w[p : p + n]), set()).add("null" if name is None else str(name))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in known}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in known:
                    hit[p : p + n] = [True] * n
                    found |= known[tuple(w[p : p + n])]
        out.append((i, len(w), sum(hit), sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1 << 20, 400])
def test_decontamination(spark, docs, no_docs, rows, most):
    w = rows[0][1].split()
    items = [(1, " ".join(w[5:20])), (2, rows[4][1][10:120].upper()), (2, "one TWO"), (3, ""), (4, None), (None, "a B"), (10, " ".join(w[6:15])), (11, "nowhere to be found in any of these texts at all")]
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, n_words int")
    got = decontamination.contamination(docs, bench, ["doc_id"], most).collect()
    want = slow_hits(rows, items)
    assert tidy(got, "doc_id", "n_words", "n_hit", "items") == want
    kept = decontamination.without_hits(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(1 for x in want if not x[2])
    long = slow_hits(rows, [x for x in items if len((x[1] or "").split()) >= 10])
    assert decontamination.without_hits(docs, bench, 10).count() == sum(1 for x in long if not x[2]) > kept.count()
    assert decontamination.contamination(no_docs, bench, ["doc_id"]).count() == 0
    assert decontamination.without_hits(docs, bench.limit(0)).count() == len(rows)


# --- near duplicates


def slow_fingerprint(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << j for j in range(64) if sum(h >> j & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps, radius=2):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs, no_docs, rows):
    fps = [slow_fingerprint(x[1]) for x in rows]
    roots, low = slow_components(fps), {}
    for root, x in zip(roots, rows):
        low[root] = min(BIG if x[0] is None else x[0], low.get(root, BIG))
    want = sorted(((x[0], np.uint64(f).view(np.int64).item(), None if low[r] == BIG else low[r]) for x, f, r in zip(rows, fps, roots)), key=repr)
    got = simhash.near_duplicates(docs)
    assert tidy(got.collect(), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_pieces(monkeypatch, rows):
    texts = [(x[1] or "").encode() for x in rows]
    whole = suffixes.minimizer_runs(texts, 12, 5)
    covered = lambda r: sorted((i, v) for f, n, v in zip(*map(list, r)) for i in range(f, f + n))
    monkeypatch.setattr(suffixes, "PIECE", 97)
    assert covered(suffixes.minimizer_runs(texts, 12, 5)) == covered(whole)
    for n in (1, 50, 200_000):
        monkeypatch.setattr(simhash, "HASHES", n)
        assert simhash.fingerprints_of(texts).tolist() == [slow_fingerprint(x[1]) for x in rows]


def test_links_are_all_found(spark):
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(300)]
    for _ in range(600):  # chains and dense balls
        f = r.choice(fps)
        for _ in range(r.randint(1, 3)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    roots = slow_components(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    classes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {x.node: x.root for x in components.stars(simhash.links(classes)).collect()}
    groups = {}
    for f, root in zip(fps, roots):
        groups.setdefault(root, set()).add(found.get(signed(f), signed(f)))
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


@pytest.mark.parametrize("most", [40, 7])
def test_only_large_shells_are_split(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_SHELL", most)
    test_links_are_all_found(spark)


def test_close_pairs_by_tree(monkeypatch):
    monkeypatch.setattr(simhash, "LEAF_PAIRS", 64)
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    c = np.unique(np.concatenate([base, base ^ np.uint64(1), base[:50] ^ np.uint64(6), base[:20] ^ np.uint64(7 << 40)]))
    got = {(int(a), int(b)) for x, y in simhash.close_pairs(c, c) for a, b in zip(x, y)}
    x, y = np.nonzero(np.bitwise_count(c[:, None] ^ c[None, :]) <= 2)
    assert got == set(zip(x.tolist(), y.tolist()))


def test_stars_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001), (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components.stars(edges).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {1001: 1000, 1002: 1000}


# --- mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=12), st.integers(1, 300))
def test_mix_plan(sizes, block):
    plan = mixing.plan_mix([(f"s{i:03}", s) for i, s in enumerate(sizes)], block, 7, 1)
    assert all(t <= 2 * s + 1e-6 for t, s in zip(plan["targets"], sizes))
    assert abs(sum(plan["targets"]) - 1.5 * sum(sizes)) < 1e-6 * max(1, sum(sizes))
    draws = list(mixing.shard_draws(plan["slots"], 7, 1))
    assert sum((d for _, d, _ in draws), np.zeros(len(sizes), np.int64)).tolist() == plan["slots"]
    assert [d.sum() for _, d, _ in draws[:-1]] == [7] * (len(draws) - 1)
    before = np.zeros(len(sizes), np.int64)
    for k, (shard, drawn, start) in enumerate(draws):
        assert shard == k and (start == before).all() and (drawn >= 0).all()
        before = before + drawn
    one_by_one = [x for k in range(len(draws)) for x in mixing.shard_draws(plan["slots"], 7, 1, k, k + 1)]
    assert [(k, d.tolist(), b.tolist()) for k, d, b in one_by_one] == [(k, d.tolist(), b.tolist()) for k, d, b in draws]
    for i, (s, t) in enumerate(zip(sizes, plan["targets"])):
        if not s:
            continue
        b, words = plan["blocks"][i], 0
        for slot in range(plan["slots"][i]):
            at = int(mixing.permuted(np.array([slot % b]), b, f"1|{i}|{slot // b}")[0])
            words += min(block, s - at * block) - (plan["cut"][i] if slot == plan["slots"][i] - 1 else 0)
        assert words == int(t)


def test_permutation():
    for n in (1, 2, 5, 64, 1000):
        x = mixing.permuted(np.arange(n), n, "k")
        assert sorted(x.tolist()) == list(range(n)) and mixing.permuted(x, n, "k", inverse=True).tolist() == list(range(n))


def test_draws_of_many_slots():
    slots = [40 * 10**9, 0, 3, 5 * 10**9]
    first = list(mixing.shard_draws(slots, 4096, 1, 0, 2))
    last = list(mixing.shard_draws(slots, 4096, 1, -(-sum(slots) // 4096) - 1))
    assert [d.sum() for _, d, _ in first] == [4096, 4096] and (first[1][2] == first[0][1]).all()
    assert (last[0][1] + last[0][2]).tolist() == slots
    shares = [d[0] / d.sum() for _, d, _ in mixing.shard_draws([3 * 10**6, 10**6], 400, 1)]
    assert abs(np.mean(shares) - 0.75) < 1e-9 and abs(np.std(shares) / (0.75 * 0.25 / 400) ** 0.5 - 1) < 0.05  # as multinomial counts vary


def test_mixing(docs, no_docs, rows):
    got = mixing.mix_sources(docs, block_words=16).collect()
    again = mixing.mix_sources(docs.repartition(3), block_words=16).collect()
    assert tidy(got, "doc_id", "source", "taken") == tidy(again, "doc_id", "source", "taken")
    assert tidy(got, "doc_id", "size") == sorted(((x[0], len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or ""))) for x in rows), key=repr)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    for part in by.values():
        assert sum(r.size for r in part) == part[0].source_size and abs(sum(r.taken for r in part) - part[0].target) < 1
    assert mixing.mix_sources(no_docs).count() == 0
    mixed = mixing.apply_mix(docs, mixing.mix_sources(docs))
    assert mixed.columns == docs.columns
    assert mixing.apply_mix(no_docs, mixing.mix_sources(no_docs)).count() == 0
