import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from conftest_llm import odd_rows, prose, with_clashes
from veriform.llm import graph, simhash


def fingerprint(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall("[^\x20\x09-\x0d]+", folded)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """Least id over links of at most 3 bits, by comparing all pairs."""
    ids = {}
    for i, f in pairs:
        ids.setdefault(f, []).append(i)
    fps = list(ids)
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for a, f in enumerate(fps):
        known = [i for i in ids[f] if i is not None]
        least.setdefault(root(a), []).extend(known)
    return {f: min(least[root(a)], default=None) for a, f in enumerate(fps)}


def check(docs):
    rows = docs.collect()
    want = [(r["doc_id"], fingerprint(r["text"])) for r in rows]
    comp = components(want)
    got = simhash.simhash_components(docs).select("id", "fp", "component").collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got), key=key) == sorted(((i, f, comp[f]) for i, f in want), key=key)


def test_odd_rows_and_clashing_columns(make_docs, rng):
    check(with_clashes(make_docs(odd_rows(rng))))


def test_near_copies(make_docs, rng):
    rows = []
    for i in range(60):
        w = prose(rng, 400).split()
        for j in range(4):
            v = list(w)
            for _ in range(j):
                v[rng.randrange(len(v))] = "changed"
            rows.append((i * 10 + j, " ".join(v)))
    check(make_docs(rows))


def test_empty_table(make_docs):
    assert simhash.simhash_components(make_docs([])).count() == 0
    assert simhash.one_per_component(make_docs([])).count() == 0


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for n in (1, 2, 3, 3, 3, 4, 5):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {frozenset((r["a"] % (1 << 64), r["b"] % (1 << 64))) for r in simhash.fingerprint_links(df).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3}


def test_golay_decodes_up_to_three_errors():
    golay, rng = simhash.Golay(), random.Random(1)
    v = np.array([rng.getrandbits(23) for _ in range(2000)])
    words = v ^ golay.leader[golay.syndrome[0, v & 255] ^ golay.syndrome[1, v >> 8 & 255] ^ golay.syndrome[2, v >> 16]]
    assert max(int(x).bit_count() for x in v ^ words) <= 3
    assert len(set((words >> 11).tolist())) <= 4096
    assert (golay.index(words ^ 0b10000100000000000000001) == words >> 11).all()


def test_one_of_each_group_stays(make_docs, rng):
    rows = odd_rows(rng)
    docs = with_clashes(make_docs(rows))
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    root = {(r["id"], r["h"]): r["root"] for r in simhash.simhash_components(docs).collect()}
    groups = [root[r["doc_id"], r["h2"]] for r in kept.select("*", F.xxhash64("text").alias("h2")).collect()]
    assert sorted(groups) == sorted(set(root.values()))


def test_unrelated_texts_without_ids_or_with_one_id_stay(make_docs, rng):
    texts = [prose(rng, 100) for _ in range(8)]
    near = texts[6].upper()
    rows = [(None, t) for t in texts[:3]] + [(None, texts[0])] + [(1, texts[3]), (1, texts[4]), (2, texts[4])] + [(5, texts[5]), (5, texts[6]), (6, near), (None, texts[7]), (4, texts[7])]
    assert fingerprint(near) == fingerprint(texts[6])
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_per_component(make_docs(rows)).collect()]
    want = [(None, t) for t in texts[:3]] + [(1, texts[3]), (1, texts[4]), (5, texts[5]), (5, texts[6]), (4, texts[7])]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(300)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    got = {r["node"]: r["root"] for r in graph.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000} | {2000 + i: 1000 for i in range(300)} | {6000: 6000, 6001: 6000}
