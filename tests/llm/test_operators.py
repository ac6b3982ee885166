"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re

import pytest

from harvestry.llm import decontaminate, langid, line_dedup, packing, pii, simhash, substring_dedup, token_rollup, url_filter, voronoi
from harvestry.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n long, fp string, line_no int, lang string, source string"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts):
    return [(i, t, 1, "x", 2, "en" if i % 2 else "fr", None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(60)]
    shared = " ".join(r.choice(vocabulary) for _ in range(40))
    out = [None, "", " \n\t ", "one", shared, shared]
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 90))]
        if r.random() < 0.5:
            at = r.randint(0, len(words))
            words[at:at] = shared.split()[r.randint(0, 10) : r.randint(25, 40)]
        out.append("".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in words))
    return out + ["word " * 30_000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(docs, empty, texts):
    words = [SPACE.findall(t or "") for t in texts]
    first, expected = {}, {}
    for i, w in enumerate(words):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected[i] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    for leaves in (2_000_000, 500):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, group_leaves=leaves).collect()}
        assert got == expected
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_line_dedup(docs, empty, texts):
    lines = [(i, n, frozenset(SPACE.findall(x.lower()))) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    expected = {}
    for k, (i, n, s) in enumerate(lines):
        if s and any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:k]):
            expected.setdefault(i, []).append(n)
    assert {r.doc_id: list(r.removed) for r in line_dedup.removals(docs).collect() if r.n_removed} == expected
    clash = docs.withColumnsRenamed({"n": "_id", "fp": "_version", "line_no": "_removed"})
    out = line_dedup.remove_lines(clash)
    assert out.columns == clash.columns
    left = {i: t if i not in expected else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in expected[i]) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.text, r._id, r._version, r._removed) for r in out.collect()} == {i: (t, 1, "x", 2) for i, t in left.items()}
    assert line_dedup.remove_lines(empty).count() == 0


def test_line_dedup_in_dense_groups(spark):
    """Chains of near copies, null and repeated ids, repeated rows: every limit gives what comparing all lines gives."""
    r = random.Random(3)
    base = [[f"w{r.randint(0, 30)}" for _ in range(r.randint(3, 14))] for _ in range(12)]
    data = []
    for i in range(120):
        lines = []
        for _ in range(r.randint(0, 6)):
            line = list(r.choice(base))
            for _ in range(r.randint(0, 3)):
                line[r.randrange(len(line))] = f"w{r.randint(0, 60)}"
            lines.append(" ".join(line))
        data.append((None if i == 7 else i, "\n".join(lines)))
    docs = spark.createDataFrame(data + data[-5:], "doc_id long, text string").repartition(5)
    lines = [(-1 if i is None else i, n, frozenset(x.split())) for i, t in sorted(data, key=lambda d: -1 if d[0] is None else d[0]) for n, x in enumerate(t.split("\n"))]
    expected = {}
    for k, (i, n, s) in enumerate(lines):
        expected.setdefault(i, [])
        if s and any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in lines[:k]):
            expected[i].append(n)
    docs = docs.cache()
    got = {-1 if x.doc_id is None else x.doc_id: list(x.removed) for x in line_dedup.removals(docs).collect()}
    assert got == expected and sum(map(len, got.values())) > 50
    # every line takes part, however short; hot sets and split groups as on large tables
    hot, sets = line_dedup.HOT, line_dedup.HOT_SETS
    line_dedup.HOT, line_dedup.HOT_SETS = 2, 40
    try:
        assert {-1 if x.doc_id is None else x.doc_id: list(x.removed) for x in line_dedup.removals(docs).collect()} == expected
    finally:
        line_dedup.HOT, line_dedup.HOT_SETS = hot, sets
    named = spark.createDataFrame([(str(i), t) for i, t in data if i is not None and i > 99], "doc_id string, text string")
    by_name = [(i, n, s) for i, n, s in lines if i > 99]
    assert line_dedup.removals(named).agg({"n_removed": "sum"}).first()[0] == sum(
        bool(s) and any(5 * len(s & o) >= 4 * len(s | o) for _, _, o in by_name[:k]) for k, (_, _, s) in enumerate(by_name)
    )


def test_simhash(spark, docs, empty, texts):
    import xxhash

    def fingerprint(t):
        w = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fingerprint(t) for t in texts]
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            label[i] = min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", label[i]) for i, f in enumerate(fps)}
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    near = {x ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for x in base for _ in range(12)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in near]
    found = {(p.a, p.b) for p in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    values = sorted(x for (x,) in signed)
    assert found == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert simhash.near_duplicates(empty).count() == 0
    repeated = spark.createDataFrame([(None, "a b", 1), (None, "a b", 1), (3, "A  b", 1)], "doc_id long, text string, fp int")
    assert [(x.doc_id, x.component_id) for x in simhash.near_duplicates(repeated).collect()].count((None, 3)) == 2


def test_simhash_in_a_dense_ball(spark):
    """Hub links connect nearly all of a ball; both rounds give the components of all links."""
    r = random.Random(4)
    centre = r.getrandbits(64)
    ball = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for _ in range(300)} | {r.getrandbits(64) for _ in range(20)}
    values = sorted(x - (1 << 64) if x >> 63 else x for x in ball)
    label = {v: v for v in values}
    find = lambda v: v if label[v] == v else find(label[v])
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and find(a) != find(b):
                label[max(find(a), find(b))] = min(find(a), find(b))
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    hubs = simhash.hub_links(nodes)
    assert hubs.count() < 12 * len(values)
    near = simhash.components(hubs)
    labelled = nodes.join(near, nodes.fp == near.node, "left").selectExpr("fp", "coalesce(label, fp) as label").cache()
    rest = {(x.la, x.lb) for x in simhash.links(labelled).collect()}
    got = {x.fp: x.label for x in labelled.collect()}
    up = {v: v for v in values}
    root = lambda v: v if up[v] == v else root(up[v])
    for a, b in rest:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {v: root(got[v]) for v in values} == {v: find(v) for v in values}


def test_decontaminate(spark, docs, empty, texts):
    items = [(1, " ".join((texts[4] or "").split()[5:25])), (1, "again one"), (2, None), (3, ""), (4, "ONE"), (None, "word word"), (5, "word " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for k, t in items:
        w = decontaminate.words(t)
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n and k is not None else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(k))
    expected = {}
    for i, t in enumerate(texts):
        w, hit, names = decontaminate.words(t), set(), set()
        for win, ks in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    names |= ks
        expected[i] = len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)
    for block in (1 << 25, 60):
        got = decontaminate.digest(decontaminate.contamination(docs, bench, block_bytes=block)).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == expected
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.digest(decontaminate.contamination(docs, bench.limit(0))).where("contaminated").count() == 0


def test_packing(docs, empty, texts):
    out = packing.pack(packing.pieces(docs, tokenizer_path())).collect()
    fill = {}
    for r in out:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len({r.doc_id for r in out}) == len(texts)
    assert packing.pack(packing.pieces(empty, tokenizer_path())).count() == 0


def test_packing_plan():
    r = random.Random(1)
    for _ in range(500):
        capacity = r.choice([5, 10, 17, 40])
        counts = {r.randint(1, capacity): r.randint(1, 9) for _ in range(r.randint(0, 8))}
        fill, seen = {}, {}
        for size, lo, hi, first, per, offset in packing.plan(counts, capacity):
            for k in range(hi - lo):
                fill.setdefault(first + k // per, []).append((offset + k % per * size, size))
                seen[size] = seen.get(size, 0) + 1
        assert seen == counts
        for parts in fill.values():
            parts.sort()
            assert all(o == sum(s for _, s in parts[:i]) for i, (o, _) in enumerate(parts)) and sum(s for _, s in parts) <= capacity


def test_tokenizer_is_exact(texts):
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path())
    r = random.Random(0)
    signs = "abcstrevmldABZ ''\"..,!?-_ \n\t0129éÉßİıĲŉſàÀ×÷Σςé²½文🙂\x1c<|endoftext|>"
    some = [t or "" for t in texts] + ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|> a", "it's we'll ''s"]
    for lo in range(0, len(some), 500):
        part = some[lo : lo + 500]
        assert [x.tolist() for x in fast(part)] == [whole.encode(t, add_special_tokens=False).ids for t in part]


def test_pii(docs, empty, spark):
    text = "a@b.c_d@e.f é 4111 1111 1111 1111, 1.2.3.4 300.1.1.1 +44 20 7946 0958 call +1 (988) 555-2485"
    got = pii.digest(pii.find(spark.createDataFrame([(1, text), (2, None), (2, None)], "doc_id long, text string"))).orderBy("doc_id").collect()
    assert (got[0].n_email, got[0].n_ip, got[0].n_card, got[0].n_phone) == (2, 1, 1, 2) and len(got) == 3
    assert got[0].spans.startswith("email:0:5,email:5:11,ip:35:42,card:14:33")
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty).count() == 0 and pii.find(docs).count() == docs.count()


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")], "host string, path string, verdict string")
    urls = {None: ("", None, "allow"), "x": ("", None, "allow"), "http://A.example.COM/en/1?q": ("a.example.com", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "www.example.com/en/", "allow"), "http://com": ("com", None, "allow"), "http://a.net/es/x#y": ("a.net", "net/es/", "block"), "http://anet/es/": ("anet", None, "allow")}
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(pages, rules).orderBy("page_id").collect()
    assert [(r.host, r.rule, r.verdict) for r in got] == list(urls.values())
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_voronoi(spark):
    r = random.Random(5)
    vectors = [(i, [r.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(4)], i) for i in range(400)]
    vectors[3:6] = [(3, None, 0), (4, [1.0, None, 0.0, 0.0], 0), (5, [float("nan")] * 4, 0)]
    got = {}
    for x in voronoi.nearest(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, rank int")).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    import math

    good = {i: [math.floor(256 * x) for x in v] for i, v, _ in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[i])), i) for i in good if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_language_id(docs, empty, spark):
    data = [(i, ("der und die das nicht ein ich " if i % 2 else "the and of with that this is ") * (1 + i % 5), "de" if i % 2 else "en") for i in range(80)]
    df = spark.createDataFrame(data + [(99, None, "en"), (100, "12 3!", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, langid.fit(df)).collect()}
    assert all(got[i][0] == lang for i, _, lang in data) and got[99] == got[100] == ("und", 0.0)
    assert langid.identify(empty, langid.fit(empty)).count() == 0


def test_rollup_is_idempotent(docs, tmp_path, spark):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    counted = token_rollup.count_documents(docs)
    assert rollup.commit("1", token_rollup.inserts(counted)) and not rollup.commit("1", token_rollup.inserts(counted))
    before = rollup.totals().groupBy().sum("n_tokens").first()[0]
    assert before == counted.groupBy().sum("tokens").first()[0]
    rollup.commit("2", token_rollup.deletes(counted))
    assert rollup.totals().where("n_docs <> 0 or n_tokens <> 0").count() == 0


def test_rollup_compacts_and_revises(docs, empty, tmp_path, spark):
    rollup = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0 and rollup.compact() == 0
    counted = token_rollup.count_documents(docs)
    rollup.commit("1", token_rollup.inserts(counted))
    rollup.commit("2", token_rollup.revisions(counted.where("doc_id % 3 = 0")), token_rollup.deletes(counted.where("doc_id % 3 = 1")))
    expected = {(None, lang, k): [0, 0] for lang in ("en", "fr") for k in token_rollup.TOKENIZERS}
    for r in counted.collect():
        if r.doc_id % 3 != 1:
            expected[None, r.lang, r.tokenizer][0] += 1
            expected[None, r.lang, r.tokenizer][1] += r.revised if r.doc_id % 3 == 0 else r.tokens
    totals = lambda: {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()}
    assert totals() == expected
    assert rollup.compact() == 2 and totals() == expected
    assert not rollup.commit("1", token_rollup.inserts(counted)) and rollup.commit("3", token_rollup.inserts(token_rollup.count_documents(empty))) and totals() == expected
    # a batch that was lost half-way leaves no marker: it is written anew
    (tmp_path / "r" / "batch=4").mkdir()
    assert rollup.commit("4", token_rollup.deletes(counted.where("doc_id % 3 <> 1"))) and rollup.compact() == 2
    assert all(n == 0 for n, _ in totals().values())
