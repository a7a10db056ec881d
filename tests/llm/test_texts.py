"""Decontamination, fingerprints, personal data, language model, toxicity."""

import hashlib
import math
import random
from collections import Counter
from zlib import crc32

from hypothesis import given, settings
from hypothesis import strategies as st

from arbora.llm import decontamination as dec
from arbora.llm import pii, simhash, suffix_tree, toxicity

from .helpers import frame, rows, words


def edit_search(p, t):
    """Least edits of p within t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=30), st.text("abc", max_size=60))
def test_myers(p, t):
    mask = {}
    for i, c in enumerate(p):
        mask[c] = mask.get(c, 0) | 1 << i
    assert dec.myers(mask, len(p), t)[0] == edit_search(p, t)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 25)) for i in range(6)] + [(9, None), (10, ""), (11, "short it")]
    docs = []
    for i in range(40):
        t = words(rng, 60)
        if i % 4 == 0:
            hit = list(items[i // 4 % 6][1])
            for _ in range(i % 11):
                hit[rng.randrange(len(hit))] = "x"
            t = f"{t} {''.join(hit)}\n{words(rng, 9)}"
        docs.append((i, t, "en", "s", 0))
    docs += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "a Short  it here", "en", "s", 0), (103, "a short item", "en", "s", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in dec.contaminated(frame(spark, docs, extra=True), bench).collect()}
    want = {}
    for i, t, *_ in docs:
        for k, p in items:
            p, n = dec.normal(p), dec.normal(t)
            if p and len(p) >= dec.PIECE and (d := edit_search(p, n)) <= len(p) // dec.PIECE:
                want[i, k] = d
    want[102, 11] = 0
    assert got == want
    kept = {r["doc_id"] for r in dec.drop_contaminated(frame(spark, docs), bench).collect()}
    assert kept == {d[0] for d in docs} - {i for i, _ in want}
    assert dec.contaminated(frame(spark, docs), bench.limit(0)).count() == 0


def test_simhash_ring(spark):
    data = rows(7, 90) + [(3, "twice", "en", "s", 0)]
    got = simhash.fingerprints(frame(spark, data, extra=True)).collect()
    assert len(got) == len(data)
    order = sorted((r for r in data if r[0] != 3), key=lambda r: -r[0])
    seen = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    for a, b in zip(order, order[1:] + order[:1]):
        if 3 in (a[0] - 1, b[0]) or a[0] == 4:
            continue
        t, nxt = a[1] or "", b[1] or ""
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert seen[a[0]]["n_chars"] == len(t) and seen[a[0]]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert seen[a[0]]["near_next"] == simhash.likeness(simhash.fingerprint(t), simhash.fingerprint(nxt))
    assert simhash.fingerprints(frame(spark, [])).count() == 0
    alone = simhash.fingerprints(frame(spark, [(1, "a b c", "en", "s", 0)])).first()
    assert alone["near_next"] == 1.0


def test_simhash_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_ROWS", 7)
    data = [(i * 3, words(random.Random(i), 9), "en", "s", 0) for i in range(100)]
    order = sorted(data, key=lambda r: -r[0])
    got = {r["doc_id"]: r["edited_sha256"] for r in simhash.fingerprints(frame(spark, data)).collect()}
    for a, b in zip(order, order[1:] + order[:1]):
        h = len(a[1]) // 2
        assert got[a[0]] == hashlib.sha256((a[1][: len(a[1]) - h] + b[1][:h]).encode()).hexdigest()


def test_near_counts_against_brute_force(spark):
    rng = random.Random(13)
    base = words(rng, 300).split()
    data = []
    for i in range(0, 60):
        w = list(base)
        w[rng.randrange(300)] = f"q{i % 20}"
        data.append((i * 50, " ".join(w), "en", "s", 0))
    data += [(7, None, "en", "s", 0), (8, "", "en", "s", 0), (None, " ".join(base), "en", "s", 0), (100, " ".join(base), "en", "s", 0)]
    mark = [simhash.fingerprint(r[1] or "") for r in data]
    want = Counter()
    for (i, *_), a in zip(data, mark):
        want[i, None if i is None or i % 100 else sum((a ^ b).bit_count() <= simhash.RADIUS for b in mark) - 1] += 1
    got = Counter((r["doc_id"], r["n_within"]) for r in simhash.with_near_counts(frame(spark, data, extra=True)).collect())
    assert got == want and max(k or 0 for _, k in got) > 5


def test_radius_search(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(40):
        f = rng.getrandbits(64)
        for _ in range(4):
            fps.add(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {tuple(r) for r in simhash.within_radius(spark.createDataFrame([(f,) for f in signed + signed[:5] + [None]], "fp long"), 3, limit=4).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def test_pii(spark):
    text = "Mail a.b+c@x-y.co.uk, ip 10.0.0.255 and 1.2.3.256; card 4111 1111 1111 1111 call +1 (555) 010-9999. @nobody a@b c@d.e@f.g"
    data = [(1, text, "en", "s", 0), (2, None, "en", "s", 0), (3, "Ünïcode ü@x.de", "en", "s", 0), (4, "é x@y.zz", "en", "s", 0), (4, "é x@y.zz", "en", "s", 0)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, data, extra=True)).collect()}
    r = got[1]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (2, 1, 1, 1)
    assert r["spans"].startswith("email:5:20,ip:25:35,card:") and r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()
    assert got[2]["spans"] == "" and got[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[3]["n_email"] == 0 and got[4]["spans"] == "email:2:8"
    assert pii.personal_data(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("a1.@+- ()0", max_size=40))
def test_base_patterns_are_leftmost(t):
    import re

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert [(a, b) for a, k, b in pii.base_spans(t) if k == 0] == [m.span() for m in email.finditer(t)]
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    assert [(a, b) for a, k, b in pii.base_spans(t) if k == 1] == [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]


def test_disclosing_terms(spark):
    rng = random.Random(1)
    data = [(i, f"{words(rng, 30)} contact Zebulon at boss@corp.org {words(rng, 20)}", "en", "s", 0) for i in range(5)]
    data += [(10 + i, f"contact me {words(rng, 40)}", "en", "s", 0) for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(frame(spark, data)).collect()}
    for i in range(5):
        kinds = [s.split(":") for s in got[i].split(",")]
        assert {data[i][1][int(a) : int(b)] for k, a, b in kinds if k == "term"} == {"Zebulon"}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame(spark, data)).collect()}
    assert "Zebulon" not in clean[0] and "[email]" in clean[0] and clean[10] == data[5][1]


def plain_disclosing(data):
    """Disclosing terms by all counts in memory."""
    import re

    term = re.compile(r"[^\W\d_]{4,}")
    docs, n = [], len(data)
    for _, t, *_ in data:
        t = t or ""
        spans = pii.base_spans(t)
        values = {f"{k}:{t[a:b].lower()}" for a, k, b in spans}
        docs.append((values, {m.group().lower() for m in term.finditer(t) if all(m.end() <= a or m.start() >= b for a, _, b in spans)}, {w.lower() for w in term.findall(t)}))
    n_e, n_te = Counter(), Counter()
    for values, terms, _ in docs:
        n_e.update(values)
        n_te.update((e, t) for e in values for t in terms)
    n_t = Counter(t for _, _, held in docs for t in held)
    out = set()
    for (e, t), k in n_te.items():
        whole = math.log2(n / n_e[e])
        table = [(k, n_t[t], n_e[e]), (n_t[t] - k, n_t[t], n - n_e[e]), (n_e[e] - k, n - n_t[t], n_e[e]), (n - n_t[t] - n_e[e] + k, n - n_t[t], n - n_e[e])]
        ratio = 2 * sum(x * math.log(x * n / (r * c)) for x, r, c in table if x > 0)
        if whole > 0 and math.log2(k * n / (n_t[t] * n_e[e])) >= pii.DISCLOSURE * whole and ratio >= pii.RATIO:
            out.add(t)
    return out


def test_disclosing_terms_against_brute_force(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        t = words(rng, rng.randint(5, 60))
        for _ in range(rng.choice([0, 0, 0, 1, 2, 7])):
            t += f" {rng.choice(['anna', 'berthold', 'cecily', 'rare%d' % i])} of u{rng.randrange(40)}@x.org or 10.0.0.{rng.randrange(60)} " + words(rng, 3)
        data.append((i, t, "en", "s", 0))
    data += [(1000 + i, "Quentin has p.q@corp.example and no other words", "en", "s", 0) for i in range(25)] + [(None, None, "en", "s", 0)]
    docs = frame(spark, data)
    found = pii.found_spans(docs)
    assert {r["t"] for r in pii.disclosing(found, docs).collect()} == (want := plain_disclosing(data)) and "quentin" in want


def test_many_entities_in_a_long_text(spark):
    """Time grows with the text: tens of thousands of addresses in one text."""
    import time

    long = " ".join(f"name{chr(97 + i % 26) * 4} a{i}@x.org" for i in range(30_000))
    began = time.time()
    spans = pii.base_spans(long)
    assert len(spans) == 30_000 and len(list(pii._outside(spans, pii._TERM.finditer(long)))) == 60_000 - 30_000
    assert time.time() - began < 5


def test_terms_of_a_single_text(spark):
    rng = random.Random(6)
    data = [(i, words(rng, 30), "en", "s", 0) for i in range(1200)]
    data += [(4000, "Zebulon lives here. " + " ".join(["abaa"] * 60) + " Write to boss@corp.org", "en", "s", 0)]  # far apart, in one text
    data += [(4001, "the Abaa of call +1 (555) 010-9999 is Quentin", "en", "s", 0), (4002, "ask zebulon and abaa", "en", "s", 0), (4002, "ask abaa", "en", "s", 0)]
    got = {r["doc_id"]: r for r in pii.personal_data(frame(spark, data)).collect() if r["doc_id"] != 4002}

    def terms(i):
        text = next(r[1] for r in data if r[0] == i)
        kinds = [s.rsplit(":", 2) for s in got[i]["spans"].split(",")]
        return {text[int(a) : int(b)] for k, a, b in kinds if k == "term"}

    assert {"Zebulon", "lives"} <= terms(4000) and "abaa" not in terms(4000) and "Quentin" in terms(4001)
    assert all(not got[i]["spans"] for i in range(1200))
    clean = [r["text"] for r in pii.sanitise(frame(spark, data)).where("doc_id >= 4000").orderBy("doc_id", "text").collect()]
    assert "Zebulon" not in clean[0] and "[email]" in clean[0] and "Quentin" not in clean[1] and sorted(clean[2:]) == ["ask  and abaa", "ask abaa"]


def test_language_model(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(["new york city", "los angeles", "a b", "the cat"]) for _ in range(40)), "en", "s", 0) for i in range(80)]
    data += [(200, None, "en", "s", 0), (201, "", "en", "s", 0), (202, "New YORK zzz", "en", "s", 0), (None, "the cat", "en", "s", 0)]
    tok = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda i: crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for r in data if not held(r[0]) for w in tok(r[1]))
    n, v = sum(c.values()), len(c)
    base, better = 0.0, 0.0
    for r in suffix_tree.score(frame(spark, data, extra=True)).collect():
        t = tok(next(x[1] for x in data if x[0] == r["doc_id"]))
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        assert abs(r["base_score"] - want) < 1e-9 * max(1, abs(want)) and r["n_tokens"] == len(t) and r["n_known"] == sum(c[w] > 0 for w in t) and r["train_tokens"] == n
        if r["held_out"]:
            base, better = base + r["base_score"], better + r["score"]
    assert better > base
    assert suffix_tree.score(frame(spark, [])).count() == 0


def plain_suffix_tree(texts):
    """P(token | text before it) of the tree grown over texts, all of it in memory."""
    c = Counter(w for t in texts for w in t)
    n, v = sum(c.values()), len(c)

    def root(x):
        return (c[x] + 1) / (n + v + 1)

    counts = {}
    for t in texts:
        for i in range(len(t)):
            for d in range(1, min(i, 12) + 1):
                counts.setdefault(tuple(t[i - d : i]), Counter())[t[i]] += 1
    kept = {ctx: {w: k for w, k in own.items() if k >= suffix_tree.LEAST} for ctx, own in counts.items()}
    states = set()

    def step(x, ctx, up):
        own = kept[ctx]
        held = sum(own.values())
        rest = sum(counts[ctx].values()) - held + len(own)
        return (own.get(x, 0) + rest * up) / (held + rest)

    def prob(x, before):
        p = root(x)
        for d in range(1, len(before) + 1):
            ctx = tuple(before[-d:])
            if ctx not in states:
                break
            p = step(x, ctx, p)
        return p

    vocabulary = [*c, None]
    for ctx in sorted((s for s in counts if kept[s]), key=len):
        parent = ctx[1:]
        if (sum(counts[ctx].values()) if parent else c[ctx[0]]) < suffix_tree.CONTEXT:
            continue
        if parent and (parent not in states or sum(counts[parent].values()) - max(kept[parent].values()) < suffix_tree.LEAST):
            continue
        if parent and (ctx[:-1] not in states or ctx[-1] not in kept[ctx[:-1]]):
            continue
        up = {w: prob(w, list(parent)) for w in vocabulary}
        down = {w: step(w, ctx, p) for w, p in up.items()}
        assert abs(sum(down.values()) - 1) < 1e-9  # the distribution sums to one
        if sum(p * math.log(p / up[w]) for w, p in down.items()) >= suffix_tree.DIVERGENCE:
            states.add(ctx)
    return prob, states


def test_suffix_tree_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(9))  # in half of the texts
    data = [(i, words(rng, 200) + (f" {passage} end" if i % 2 else "") + " x a b c y z a b c w v b c q", "en", "s", 0) for i in range(90)]
    data += [(300 + i, " ".join(rng.choice("abc") for _ in range(60)), "en", "s", 0) for i in range(20)] + [(400, None, "en", "s", 0)]
    tok = lambda t: (t or "").encode().lower().split() + [b" "]
    held = lambda i: crc32(str(i).encode()) % 7 == 2
    prob, states = plain_suffix_tree([tok(r[1]) for r in data if not held(r[0])])
    assert max(map(len, states)) > 3 and (b"p4",) in states
    text = {r[0]: tok(r[1]) for r in data}
    want = {i: sum(math.log10(prob(x, t[:k])) for k, x in enumerate(t)) for i, t in text.items()}
    monkeypatch.setattr(suffix_tree, "_FLUSH", 3000)
    monkeypatch.setattr(suffix_tree, "_CHUNK", 500)
    for head in (suffix_tree.HEAD, 200, 0):  # all broadcast, the frequent, none
        monkeypatch.setattr(suffix_tree, "HEAD", head)
        for r in suffix_tree.score(frame(spark, data)).collect():
            assert abs(r["score"] - want[r["doc_id"]]) < 1e-5, r
    monkeypatch.setattr(suffix_tree, "_BITS", 1 << 12)  # bitmaps that fill up
    for r in suffix_tree.score(frame(spark, data)).collect():
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-5, r


def test_suffix_tree_by_slices(spark, monkeypatch):
    """Slice by slice, with few codes broadcast and many asked for at once, texts score the
    same, and what is returned joins nothing by code: such joins made 0.75 million rows on
    check_s and 36 million on check_l."""
    rng = random.Random(31)
    data = [(i, words(rng, 60) + " one two three four " + rng.choice(["five six", "seven"]), "en", "s", 0) for i in range(240)]
    data += [(500, " ".join(d[1] for d in data[:40]), "en", "s", 0), (7, data[7][1], "en", "s", 0), (None, "one two", "en", "s", 0), (501, None, "en", "s", 0)]
    docs = frame(spark, data).repartition(11)
    key = lambda r: (r["doc_id"] or "", r["n_tokens"])
    whole = sorted(suffix_tree.score(docs.withColumn("doc_id", docs.doc_id.cast("string"))).collect(), key=key)
    for name, value in (("_SLICED", 0), ("_ALL", 40), ("_RANGE", 4), ("_ASKED", 50), ("_CHUNK", 200), ("_FLUSH", 900), ("_HELD", 300), ("_SPREAD", 16)):
        monkeypatch.setattr(suffix_tree, name, value)
    out = suffix_tree.score(docs.withColumn("doc_id", docs.doc_id.cast("string")))
    assert "Join" not in out._jdf.queryExecution().toString()
    got = sorted(out.collect(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in whole] and len(got) == len(data)
    assert all(abs(g["score"] - w["score"]) < 1e-9 * abs(w["score"]) and abs(g["base_score"] - w["base_score"]) < 1e-9 * abs(w["base_score"]) for g, w in zip(got, whole))
    assert any(r["score"] > r["base_score"] + 1 for r in got)


def test_suffix_tree_asks_once_for_each_length():
    """A place asks for its token and each kept gram that ends there: states have no code of their own."""
    import numpy as np

    flat, n = np.array([11, 12, 13, 11, 12, 13, 11, 12], np.uint64), np.array([5, 3])
    known = [suffix_tree.Bits(9) for _ in range(3)]
    for b in known:
        b.words[:] = np.uint64(2**64 - 1)  # all that can be asked for
    asked = [(len(code), at) for at, code in suffix_tree._looked_up(flat, n, known)]
    assert [k for k, _ in asked] == [8, 6, 4] and asked[2][1].tolist() == [2, 3, 4, 7]
    codes = [c for _, c in suffix_tree._looked_up(flat, n, known)]
    k = int(suffix_tree._K)
    assert codes[2].tolist() == [(int(flat[i]) + k * int(flat[i - 1]) + k * k * int(flat[i - 2])) % 2**64 for i in (2, 3, 4, 7)]


def test_token_codes_are_those_of_words(spark):
    import pyarrow as pa
    import xxhash

    texts = [None, "", "  ", " A b\t\x0bc\x85d ", "Ünï\u00a0x y", "one"]
    got, n = suffix_tree.token_codes(pa.array(texts, pa.string()))
    want = [[xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()] + [int(suffix_tree.END)] for t in texts]
    assert got.tolist() == [c for t in want for c in t] and n.tolist() == [len(t) for t in want]
    assert suffix_tree.token_codes(pa.array([], pa.string()))[0].tolist() == []


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(8)
    bad = ["grumblefoo", "grumblebar", "grumblebaz", "grumblequx"]
    data, labels = [], []
    for i in range(1500):
        w = words(rng, 40).split()
        if i % 8 == 0:
            for k in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        data.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 8 == 0)))
    data += [(2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, (clean := words(rng, 30)) + " grumblezap grumbles grumblezig", "en", "s", 0), (2003, clean, "en", "s", 0)]
    docs, lab = frame(spark, data, extra=True), spark.createDataFrame(labels + [(2000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    held = [i for i in range(1500) if crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == int(i % 8 == 0) for i in held) >= 0.93 * len(held) and sum(got[i]["predicted"] for i in held if i % 8 == 0) >= 0.85 * sum(i % 8 == 0 for i in held)
    assert got[2002]["score"] > 3 * got[2003]["score"]  # forms never seen share n-grams
    assert 0 <= got[2000]["score"] <= 1 and got[2000]["score"] == got[2001]["score"]
    kept = toxicity.drop_toxic(docs, lab)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.toxicity(frame(spark, []), lab).count() == 0
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, data[:5]), lab.limit(0)).collect()} == {0}


def test_very_long_texts(spark):
    """Texts of a megabyte, whole: nothing is cut at any length."""
    rng = random.Random(21)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(100_000))
    item = "a benchmark passage that stands at the very end of a long text and nowhere else"
    data = [(1, base + " " + item, "en", "s", 0), (2, base + " z@y.org 10.1.2.3", "en", "s", 0), (3, "short", "en", "s", 0)]
    docs = frame(spark, data)
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [r["doc_id"] for r in dec.contaminated(docs, bench).collect()] == [1]
    got = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    assert got[2]["n_email"] == got[2]["n_ip"] == 1 and f"email:{len(base) + 1}:" in got[2]["spans"]
    marks = {r["doc_id"]: r for r in simhash.fingerprints(docs).collect()}
    assert marks[1]["n_chars"] == len(data[0][1]) and marks[1]["fingerprint"] == f"{simhash.fingerprint(data[0][1]):016x}"
    tokens = {r["doc_id"]: r["n_tokens"] for r in suffix_tree.score(docs).collect()}
    assert tokens == {i: len(t.split()) + 1 for i, t, *_ in data}
    lab = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, lab).count() == 3
    from arbora.llm import mixing, resharding

    assert {r["doc_id"]: r["size"] for r in mixing.mix(docs).collect()} == {i: len(t.split()) for i, t, *_ in data}
    assert {r["doc_id"]: r["size"] for r in resharding.reshard(docs).collect()} == {i: len(t) + 1 for i, t, *_ in data}


def test_suffix_tree_lets_go_of_shuffles(spark, monkeypatch):
    """What a step has shuffled is gone when the next begins."""
    import time

    tracked, left, tidy = spark._jsc.sc().env().mapOutputTracker().shuffleStatuses(), [], suffix_tree.tidy

    def counted(spark):
        tidy(spark)
        time.sleep(0.3)  # files go in a thread of their own
        left.append(tracked.size())

    docs = frame(spark, [(i, "a b c d " * 9, "en", "s", 0) for i in range(9)])
    tidy(spark)
    time.sleep(2)
    before = tracked.size()
    monkeypatch.setattr(suffix_tree, "tidy", counted)
    assert suffix_tree.score(docs).count() == 9
    assert max(left) <= before + 4  # what is still read; one collection of garbage left 8 on sf0.001
