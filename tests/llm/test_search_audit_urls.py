"""Lexical search, source audit and URL filter against brute force, and their edge cases."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from tilewise.llm import lexical_search, source_audit, url_filter

TERMS = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = regex.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string"
CLASH = ["row", "sketch", "term", "df", "n", "query", "score", "p", "place", "block", "value", "rank", "host", "path", "rule", "verdict", "a", "b"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def clashing(df):
    return df.withColumns({c: F.lit("extra") for c in CLASH})


def prose(rng, n, words):
    return " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % words)


def key(row):
    return tuple((x is not None, x) for x in row)


def same(got, want):
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


# --- lexical search


def searched(docs, items, k=10):
    """Every pair scored."""
    found = [(i, Counter(TERMS.findall(lower(t or "")))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        q = Counter(TERMS.findall(lower(text or "")))
        scored = []
        for i, c in found:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.fixture(scope="module")
def library():
    rng = np.random.default_rng(5)
    docs = [(i, prose(rng, int(rng.integers(1, 120)), 400)) for i in range(150)]
    copy = docs[7][1]
    docs += [(200 + i, copy) for i in range(30)]  # ties beyond the k-th place
    docs += [(7, copy), (7, copy), (None, copy), (None, None), (301, None), (302, ""), (303, " .,\n 	"), (304, "Żółć żółć ŻÓŁĆ W1"), (305, prose(rng, 60_000, 30_000)), (306, "w1 " * 500)]
    items = [(1, copy), (2, docs[3][1] + " " + docs[3][1]), (3, None), (4, ""), (5, "nowhere"), (6, "w1"), (6, "w1 żółć"), (None, docs[9][1].upper()), (8, docs[-2][1][:5000])]
    return docs, items


def test_search_equals_brute_force(spark, library):
    docs, items = library
    d = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    got = lexical_search.search(d, clashing(spark.createDataFrame(items, "item_id long, text string")))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    same(got.collect(), searched(docs, items))


def test_search_in_batches(spark, library, monkeypatch):
    docs, items = library
    monkeypatch.setattr(lexical_search, "BATCH_QUERIES", 2)
    got = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k=3)
    same(got.collect(), searched(docs, items, 3))


def test_search_of_nothing(spark, library):
    docs, items = library
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.search(none, asked).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "--")], "doc_id long, text string"), asked).count() == 0
    assert lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), asked.limit(0)).count() == 0


def test_bounds_are_never_below_scores(library):
    docs, items = library
    import pyarrow as pa

    found = [c for _, t in docs if (c := lexical_search.counted(t))]
    df = Counter(t for c in found for t in c)
    n_docs, n_terms = len(found), sum(sum(c.values()) for c in found)
    for frequent in ({}, dict(df.most_common(40))):
        weights = lexical_search.Weights(frequent, n_docs)
        made = [lexical_search.sketch(c, weights, n_docs, n_terms) for c in found]
        widths = pa.array([len(s) // lexical_search.ROWS for s in made], pa.int32())
        sketches = pa.array([pa.compress(s, lexical_search.CODEC, asbytes=True) for s in made], pa.binary())
        batch = lexical_search.Batch([lexical_search.counted(t) for _, t in items], df, n_docs, n_terms)
        met = 0
        for at, bounds in batch.bounds(widths, sketches):
            for i, own in zip(at, bounds, strict=True):
                adds = batch.scores(found[i])
                assert all(b * batch.unit >= batch.score(j, adds) for j, b in enumerate(own))
                met += 1
        assert met == len(found)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "alpha  Beta," * 50 + "x" * 200 + " end"
    whole = lexical_search.counted(text)
    monkeypatch.setattr(lexical_search, "PIECE", 17)
    assert lexical_search.counted(text) == whole and whole[b"alpha"] == 50 and whole[b"x" * 200] == 1


# --- source audit


def audited(docs, least=30, top=50):
    n, held, langs = Counter(), defaultdict(set), defaultdict(set)
    for k, (_, text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        for t in LETTERS.findall(lower(text or "")):
            n[lang, source, t] += 1
            held[lang, t].add(k)
    out = []
    for lang, sources in langs.items():
        kept = [t for (x, t), d in held.items() if x == lang and len(d) >= least]
        count = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        count[None] = {t: sum(count[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in count.items()}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, rank) for rank, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((p[None][t] - p[s][t], t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, rank) for rank, (v, _, t) in enumerate(terms[:top], 1)]
    return out


def audit_docs():
    rng = np.random.default_rng(8)
    words = [*"alpha Alpha beta gämma 日本語 日本 delta-x omega omegaomegaomegaomega omegaomegaomegaomegb".split(), "z" * 70 + "a", "z" * 70 + "b"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 12)))), ["en", "fr", None][int(rng.integers(3))], ["a", "b", "ä", None, "hot"][min(4, int(rng.integers(8)))]) for i in range(260)]
    return [*rows, rows[3], rows[3], (None, None, "en", "silent"), (1, "", "xx", "one"), (2, "only here", "yy", "one"), (3, None, "yy", "two"), (4, "beta " * 3000, "en", "a")]


def test_audit_equals_brute_force(spark):
    docs = audit_docs()
    d = clashing(spark.createDataFrame(docs, DOCS)).repartition(4)
    for least, top in ((30, 50), (5, 2)):
        got = source_audit.audit(d, least, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        same(got.collect(), audited(docs, least, top))


def test_audit_over_tiles_and_blocks(spark):
    rng = np.random.default_rng(9)
    docs = [(i, prose(rng, 30, 60).translate(str.maketrans("0123456789", "abcdefghij")), "en", f"s{int(rng.integers(23)):02d}") for i in range(150)]
    got = source_audit.audit(spark.createDataFrame(docs, DOCS), 3, tile=5, block_terms=3).collect()
    same(got, audited(docs, 3))


def test_audit_of_nothing(spark):
    assert source_audit.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_slices_have_few_groups(monkeypatch):
    """A term of mixed sources gives a row for each source, however many slices there are."""
    monkeypatch.setattr(source_audit, "SLICE_BYTES", 60)
    n = 40
    b = pa.RecordBatch.from_arrays([pa.array(["en"] * n), pa.array(["a", "b"] * (n // 2)), pa.array(["One two"] * n)], ["lang", "source", "text"])
    rows = [r for x in source_audit._counted(iter([b])) for r in x.to_pylist()]
    total = Counter()
    for r in rows:
        total[r["source"], r["term"]] += r["n"]
    assert total == {(s, t): n // 2 for s in "ab" for t in ("one", "two")}
    slices = -(-n // 8)
    assert len(rows) <= 2 * (slices + 1)


def test_pointers_are_sorted(monkeypatch):
    rng = np.random.default_rng(3)
    terms = [bytes(rng.integers(97, 100, int(n)).astype(np.uint8)) for n in rng.integers(1, 40, 3000)] + [b"q" * 500, b"q" * 500, b"q" * 499 + b"r", b"q" * 64, b"q" * 65] * 3
    data = np.frombuffer(b" ".join(terms) + b"\0" * (source_audit.SHORT + 8), np.uint8)
    length = np.array([len(t) for t in terms])
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    for small in (1, 64, 4096):
        monkeypatch.setattr(source_audit, "SMALL", small)
        order, begins = source_audit.sort_pointers(data, start, length)
        assert [terms[i] for i in order] == sorted(terms)
        assert [terms[order[b]] for b in begins] == sorted(set(terms))


# --- URL filter


def judged(pages, rules, default="allow"):
    out = []
    for page, url in pages:
        m = regex.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        out.append((page, host, path, best and best[3], best[4] if best else default))
    return out


PAGES = [
    (1, "http://example.net/en/a"), (2, "http://a.example.net/de/"), (3, "https://EXAMPLE.com/de/x?y#z"), (4, "https://www.example.com/DE/x"), (5, "http://b.org/fr/"), (6, "http://org/fr/1"), (7, "http://myorg/fr/1"),
    (8, None), (9, ""), (10, "no scheme.net/"), (11, "http://net"), (12, "http://net?/"), (13, "http://x.net:80/"), (14, "http://[bad/x"), (15, "://.net/"), (16, "a://b://c.net/"), (17, "http://ünï.net/ż"), (18, "http://net./"),
    (1, "http://example.net/en/a"), (None, "http://q.net/"), (19, "http://" + "a." * 20_000 + "net/" + "x" * 20_000), (20, "http://new\nline.net/\n"),
]


def test_urls_equal_brute_force(spark):
    rules = [(h, p, v) for v, h, p in url_filter.RULES]
    pages = clashing(spark.createDataFrame(PAGES, "page_id long, url string"))
    got = url_filter.judge(pages, url_filter.rule_table(spark))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    same(got.collect(), judged(PAGES, rules))


def many():
    rng = np.random.default_rng(4)
    host = lambda: ".".join(f"h{int(x)}" for x in rng.integers(0, 30, int(rng.integers(1, 4))))
    path = lambda: "/" + "/".join(f"p{int(x)}" for x in rng.integers(0, 6, int(rng.integers(0, 3))))
    rules = {(host(), path(), ["block", "allow"][int(rng.integers(2))]) for _ in range(1500)} | {("", "", "allow"), ("h1", "", "block")}
    pages = [(i, f"http://{host()}.{host()}{path()}") for i in range(3000)] + PAGES
    return pages, sorted(rules)


def test_cascade_and_join_agree_on_many_rules(spark, monkeypatch):
    pages, rules = many()
    p, r = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    want = judged(pages, rules, "block")
    monkeypatch.setattr(url_filter, "FIRST_HASHES", (1, 1))  # many keys are taken wrongly: several levels
    same(url_filter.judge(p, r, "block").collect(), want)
    same(url_filter.judge(p, r, "block", most_bits=64).collect(), want)


def test_cascade_has_levels(spark):
    pages, rules = many()
    listed = spark.createDataFrame(sorted({(h, p) for h, p, _ in rules}), url_filter.KEYS)
    addresses = url_filter.addresses_of(spark.createDataFrame(pages, "page_id long, url string")).select("host", "path")
    reach = url_filter.Reach(sorted({len(p) for _, p, _ in rules}), max(len(h) for h, _, _ in rules))
    cascade = url_filter.cascade_of(listed, addresses, reach)
    known = {(h, p) for h, p, _ in rules}
    asked = known | {k for r in addresses.collect() for k in reach.keys(r.host, r.path)}
    assert len(cascade.levels) > 1 and len(asked) > len(known)
    assert all((k in cascade) == (k in known) for k in asked)


def test_urls_of_nothing(spark):
    pages, none = spark.createDataFrame(PAGES, "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    same(url_filter.judge(pages, none).collect(), judged(PAGES, []))
