import math
import random

import duckdb
import pyarrow as pa
from ledgerflow.llm import license_scan as ls


def holds(text, shingles_of_window, contained=0.8):
    """Templates of which a window of so many shingles, at any start at all, holds enough."""
    own = ls.shingles(ls.words_of(text or ""))
    out = set()
    for g in ls.groups(ls.TEMPLATES):
        size = shingles_of_window(g)
        for name, want in zip(g.names, g.sets, strict=True):
            least = math.ceil(contained * len(want) - 1e-9)
            at = [i for i, x in enumerate(own) if x in want]  # only these can begin or end a best window
            if any(len({x for x in own[a : a + size] if x in want}) >= least for a in at):
                out.add(name)
    return out


def must(text):
    return holds(text, lambda g: 2 * g.block + 1)


def may(text):
    return holds(text, lambda g: 3 * g.block)


def planted():
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consectetur elit sed".split()) for _ in range(n))
    texts = []
    for t in ls.TEMPLATES.values():
        texts += [t, t.upper(), filler(33) + " " + t + "\n" + filler(50) + t, filler(3) + " ".join(t.split())]
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(filler(17) + " " + " ".join(w) + " " + filler(9))
        texts.append(" ".join(t.split()[: len(t.split()) // 2]))
    return texts


def test_matches_brute_force():
    texts = planted() + [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet' limit 120").fetchall()] + [None, "", "mit"]
    got = [set() for _ in texts]
    for doc, name, share, a, e in ls.scan_texts(pa.chunked_array([pa.array(texts)]), ls.groups(ls.TEMPLATES), 0.8):
        got[doc].add(name)
        assert 0.8 <= share <= 1 and 0 <= a < e <= len(ls.words_of(texts[doc]))
    assert all(must(t) <= g <= may(t) for t, g in zip(texts, got, strict=True))
    assert sum(map(len, got)) >= 5 * len(ls.TEMPLATES) - 6
    assert all(got[6 * i] >= {name} for i, name in enumerate(ls.TEMPLATES))


def test_bands_keep_their_promise():
    for g in ls.groups(ls.TEMPLATES):
        for s in g.sets:
            held = math.ceil(0.8 * len(s))
            assert (1 - held / (3 * g.block + len(s) - held)) ** g.bands <= ls.MISS


def test_query_and_awkward_rows(spark, awkward, sf):
    rows = ls.query(spark, sf).collect()
    texts = dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.license)
    assert all(must(t) <= found.get(d, set()) <= may(t) for d, t in texts.items()) and found
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(planted())], "License int, text string")
    count = ls.scan(docs).count()
    ls.MOST_TEMPLATES, most = 5, ls.MOST_TEMPLATES
    assert ls.scan(docs).count() == count
    ls.MOST_TEMPLATES = most
    assert ls.scan(awkward).count() == 0 and ls.scan(awkward.limit(0)).count() == 0 and ls.scan(awkward, templates={}).count() == 0
