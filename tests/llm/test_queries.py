"""The registered queries over a whole table: against DuckDB where they have SQL, else against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import decontaminate, lm, pii, queries, secrets
from tessera.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return {d: t or "" for d, t in duck.sql("select doc_id, text from documents").fetchall()}


@pytest.fixture(scope="module")
def library():
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    return lib


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert Counter(tuple(map(str, r)) for r in got.select(*cols).collect()) == Counter(tuple(map(str, r)) for r in want.select(*cols).fetchall())


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def test_op1(spark, texts):
    def base(t):
        out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d[::-1])) % 10 == 0:
                out.append((m.start(), m.end(), "card"))
        out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))

    rows = queries.op1_pii(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, x in want) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))


def test_op3(spark, texts):
    kinds = list(secrets.RULES)

    def base(t):
        out = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
        out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        return sorted(out, key=lambda s: (s[0], kinds.index(s[2])))

    rows = queries.op3_secrets(spark, SF).collect()
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for r in rows:
        want = base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, x in want) for k in secrets.BASE_KINDS]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        own = [s for s in r.spans.split(",") if s and s.split(":")[0] in secrets.BASE_KINDS]
        assert ",".join(own) == joined(want)


def test_op4(spark, texts, library):
    rows = queries.op4_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op5(spark, duck, texts):
    """Every item against every whole text, without pieces: the least edit distance to any part of the text."""
    items = [(i, decontaminate.normalised(t)) for i, t in duck.sql("select item_id, text from benchmark where text is not null").fetchall()]
    want = set()
    for d, t in texts.items():
        s = decontaminate.normalised(t)
        want |= {(d, i, n) for i, p in items if p and (n := decontaminate.myers(p, s)) <= decontaminate.budget(len(p))}
    assert want and {tuple(r) for r in queries.op5_decontamination(spark, SF).collect()} == want


def test_leaks_ties_and_clashes(spark):
    docs = spark.createDataFrame([(1, "a long enough benchmark line to find", 9), (1, "a long enough benchmark line to find", 9)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, "a long enough benchmark line to find"), (6, "a long enough benchmark line to find")], "item_id long, text string")
    assert Counter(map(tuple, decontaminate.find_leaks(docs, items).collect())) == Counter({(1, 5, 0): 2, (1, 6, 0): 2})
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns


def test_op6(spark, texts, library):
    rows = sorted(queries.op6_packed_ids(spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(rows, sorted(texts)):
        ids = [*library.encode(texts[d], add_special_tokens=False).ids, 2]
        assert tuple(r)[:4] == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(rows) == len(texts)


def test_op8_scores(spark):
    """A small corpus, every term of the model recomputed by plain counting."""
    r = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(600)]
    p = 1 / np.arange(1, 601)
    docs = {i: " ".join(r.choice(vocabulary, 40, p=p / p.sum())) for i in range(120)}
    spark_docs = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {x.doc_id: x for x in lm.lm_scores(spark_docs).collect()}
    train = {d: t for d, t in docs.items() if zlib.crc32(str(d).encode()) % 10}
    c = Counter(w for t in train.values() for w in t.encode().split())
    top = sorted(c, key=lambda w: (-c[w], w))
    index = lm.WordIndex(top)
    unit = [*lm.units_of(index), lm.END_UNIT]

    def walk(table):
        for t in train.values():
            line = [-1, *[index[w] for w in t.encode().split()], -1]
            yield from ((table[a], table[b]) for a, b in zip(line, line[1:]))

    bigrams = np.zeros((lm.UNITS, lm.UNITS))
    for a, b in walk(unit):
        bigrams[a, b] += 1
    units = lm.exchange(bigrams)
    first = [*(units[u] for u in unit[:-1]), lm.CLASSES - 1]
    pairs = np.zeros((lm.CLASSES, lm.CLASSES))
    for a, b in walk(first):
        pairs[a, b] += 1
    gains, of = lm.context_gains(pairs), list(first)
    for i in range(lm.TOP_WORDS, len(top)):
        total = np.zeros(lm.CLASSES)
        for t in train.values():
            line = [-1, *[index[w] for w in t.encode().split()], -1]
            for k, x in enumerate(line):
                if x == i:
                    total += gains[first[line[k + 1]]] + gains[lm.CLASSES + first[line[k - 1]]]
        of[i] = int(np.where(np.isinf(total), -1e30, total).argmax())
    final = np.zeros((lm.CLASSES, lm.CLASSES))
    for a, b in walk(of):
        final[a, b] += 1
    distinct = Counter(of[i] for i in range(len(top)))
    single = (final.sum(0) + 1) / (final.sum() + lm.CLASSES)
    for d, t in docs.items():
        line = [-1, *[index[w] for w in t.encode().split()], -1]
        want = 0.0
        for a, b, w in zip(line, line[1:], [*t.encode().split(), b"\n"]):
            x, y = of[a], of[b]
            want += math.log10((final[x, y] + lm.KAPPA * single[y]) / (final[x].sum() + lm.KAPPA))
            if b >= 0:
                want += math.log10((c[w] + lm.ALPHA) / (final[:, y].sum() + lm.ALPHA * (distinct[y] + 1)))
        assert got[d].score == pytest.approx(want, rel=1e-9), d
    held = [d for d in docs if got[d].held_out]
    assert sum(got[d].score for d in held) > 1.2 * sum(got[d].base_score for d in held)
    untrained = spark.createDataFrame([(d, t) for d, t in docs.items() if d not in train], "doc_id long, text string")
    assert {(x.n_known, x.train_tokens) for x in lm.lm_scores(untrained).collect()} == {(0, 0)}


def test_op8_rare_words_get_classes_too(spark, monkeypatch):
    """However few words are broadcast, and however texts are chunked, every training word has the class of its own contexts."""
    r = np.random.default_rng(1)
    p = 1 / np.arange(1, 1501)
    rows = [(i, " ".join(f"w{k}" for k in r.choice(1500, r.integers(0, 60), p=p / p.sum()))) for i in range(200)] + [(None, "w1 new new w2"), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = {x.doc_id: x for x in lm.lm_scores(docs).collect()}
    monkeypatch.setattr(lm, "FREQUENT", 400)
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 300, raising=False)
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(rows)
    for x in got:
        assert tuple(x)[:5] == tuple(want[x.doc_id])[:5]
        assert tuple(x)[5:] == pytest.approx(tuple(want[x.doc_id])[5:], rel=1e-9), x


def test_exchange_ends_where_no_move_helps():
    r = np.random.default_rng(7)
    hidden = r.integers(0, 90, lm.UNITS)
    n = r.poisson(r.dirichlet(np.ones(90) * 0.05, 90)[hidden][:, hidden] * 40).astype(float)
    cls = lm.exchange(n)

    def likelihood(c):
        m = np.eye(lm.CLASSES)[c]
        g = m.T @ n @ m
        f = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
        return f(g) - f(g.sum(0)) - f(g.sum(1))

    best = likelihood(cls)
    for u in r.choice(lm.UNITS - 1, 40, replace=False):
        for k in range(lm.CLASSES - 1):
            moved = cls.copy()
            moved[u] = k
            assert likelihood(moved) <= best + 1e-6


#: The rules of op9's contract.
CONTRACT = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_url_rules_are_the_contracts(spark, tmp_path):
    odd = ["http://a.net/de/1", "http://net/de/", "http://casino-win.example.net/de/7", "HTTP://WWW.Example.NET/de/8?x", "http://notexample.net/de/8", "http://example.net/de/9#/de/8", "http://a.net/DE/1", "http://.net/de/", "http://a.net./de/1", "http://a.net:80/de/1"]
    odd += ["http://x.com/en/7", "http://example.com/en/7", "http://spam.example.com/en/71", "http://spam.example.com/en/8", "http://a.com?/en/", "http://x.org/es/", "http://org/es", "http://ads.org/xx/", "x://y://a.net/de/", "://net/de/\nz", "http://", "no scheme", "", None]
    pages = spark.createDataFrame(list(enumerate(odd)), "page_id long, url string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in queries.op9_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == len(odd)
    for i, url in enumerate(odd):
        rest = url.partition("://")[2] if url else ""
        raw, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = raw.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in CONTRACT if ("." + host).endswith("." + r[0]) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0] + best[1]), url
        assert best is None or got[i].verdict == best[2], url
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert set(con.sql(queries.ORACLES["op9_url_filter"]).fetchall()) == {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.values()}


def test_empty_tables(spark):
    from tessera.llm import jaccard, urls

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert lm.lm_scores(none).count() == 0 and jaccard.keep_one(none).count() == 0
    links, members = jaccard.similar_pairs(none)
    assert links.count() == 0 and members.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], urls.LIST_SCHEMA)
    assert urls.url_verdicts(pages, rules, urls.listed_by_words(pages, ("x",))).count() == 0


def test_similar_pairs(spark, texts):
    from tessera.llm import jaccard

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    links, members = jaccard.similar_pairs(docs)
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    node = {r.doc_id: r.node for r in members.collect()}
    want = {tuple(sorted((node[a], node[b]))) for a in sets for b in sets if a < b and sets[a] and sets[a] != sets[b] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want and {(r.x, r.y) for r in links.collect()} == want
