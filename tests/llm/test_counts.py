"""op11 and op12: SQL on the tables, plain Python on rows with nulls, ties and odd separators."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from harvestry.llm import collocations, divergence, queries

DATA = "/root/testdata/sf0.001"
ODD = [
    (1, "Red fox, red FOX; red fox!\nred fox", "en", "a"), (2, "red fox red fox red fox red fox red fox", "en", "a"), (3, "red fox. lazy dog lazy dog\tlazy  dog", "en", "b"),
    (4, None, "en", "b"), (5, "", "en", "c"), (6, "red fox lazy dog" * 3, "en", None), (7, "lazy dog lazy dog red fox", None, "a"), (8, "red\x0bfox red\x0cfox red\rfox", None, None),
    (9, "été Été fox zebra 12fox3zebra", "fr", "a"), (9, "été fox zebra", "fr", "a"), (10, "ete fox zebra", "fr", "b"), (11, "only here", "de", "z"), (12, None, "de", "y"), (13, "red lazy fox " * 12, "en", "a"), (14, "a b c d " * 15, "en", "c"),
    (15, "word " * 5000, "en", "a"), (16, "x" * 200_000 + " red fox", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 7, "n") for r in ODD], "doc_id long, text string, lang string, source string, n int, term string").repartition(3).cache()


def expected_divergence(rows):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        group = (lang or "", source or "")
        groups.add(group)
        counts[group].update(terms)
        docs[group[0]].update(set(terms))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, n in docs[lang].items() if n >= 3)

        def p(*names):
            n = {t: sum(counts[lang, s][t] for s in names) for t in kept}
            return {t: 1 + 10**9 * (c + 1) // (sum(n.values()) + len(kept)) for t, c in n.items()}

        sources = sorted(s for x, s in groups if x == lang)
        mine, whole = p(source), p(*sources)
        pair = [(sum((mine[t] - q) ** 2 // q for t, q in p(s).items()), s) for s in sources if s != source]
        term = [((mine[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found, top in (("pair", pair, None), ("term", term, 200)):
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


def expected_phrases(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f[lang].update(tuple(ws[i : i + k]) for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        dropped = {p[i : i + 2] for p, b in candidates.items() if len(p) == 3 for i in (0, 1) if 100 * b >= 50 * count[p[i : i + 2]]}
        scored = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_divergence_of_odd_rows(spark, odd):
    assert sorted(map(tuple, divergence.audit(odd).collect())) == expected_divergence(ODD)


def test_divergence_salts_long_postings(odd, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 1)
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.audit(odd).collect())) == expected_divergence(ODD)


def test_phrases_of_odd_rows(odd):
    assert sorted(map(tuple, collocations.mine(odd).collect())) == expected_phrases(ODD)


def test_phrases_in_many_buckets(odd, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 40)
    monkeypatch.setattr(collocations, "CHUNK", 64)
    assert sorted(map(tuple, collocations.mine(odd, least=2, top=5, bucket=50).collect())) == expected_phrases(ODD, 2, 5)


def test_longer_phrases(spark):
    """Four words: every cut and every inner phrase of them counts."""
    df = spark.createDataFrame([(1, "a b c d. " * 12 + "a b c. " * 20 + "b c. " * 70, "en")], "doc_id long, text string, lang string")
    got = {r["phrase"]: tuple(r[c] for c in "alr") for r in collocations.mine(df, longest=4).collect()}
    assert got == {"a b c": (32, 32, 102), "b c": (102, 102, 102), "a b c d": (12, 32, 12)}


@pytest.mark.parametrize("operator", [divergence.audit, collocations.mine])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


@pytest.mark.parametrize("name", ["op11_divergence", "op12_collocations"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = queries.queries()[name](spark, DATA)
    expected = con.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, expected.select(*df.columns).fetchall()))
