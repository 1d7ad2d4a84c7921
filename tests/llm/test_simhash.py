from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import xxhash

from vellum.llm import graph, simhash
from tests.llm.helpers import Groups, empty, odd, words


def plain(text, size=4):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = [(i, plain(t)) for i, t in rows]
    groups, least = Groups(), {}
    for a, b in combinations({f for _, f in fps}, 2):
        if (a ^ b).bit_count() <= 4:
            groups.join(a, b)
    for i, f in fps:
        if i is not None:
            root = groups.root(f)
            least[root] = min(least.get(root, i), i)
    wanted = Counter((i, f"{f:016x}", least.get(groups.root(f))) for i, f in fps)
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == wanted


def test_documents(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(spark):
    check(odd(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (words(a.lower()), words(b.lower()))]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_similar_texts_by_recall_and_precision(spark):
    """Pairs of a text and its copy with some words replaced: those of similarity 0.8 or more link, mostly, and no others."""
    draw, rows, alike = random.Random(11), [], {}
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(5))
    for k in range(600):
        w = [word() for _ in range(draw.choice((40, 120, 400)))]
        copy = list(w)
        for _ in range(max(1, int(draw.choice((0.005, 0.01, 0.02, 0.03, 0.06)) * len(w)))):
            copy[draw.randrange(len(w))] = word()
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(copy))]
        alike[k] = jaccard(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    root = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    hit = {k: root[2 * k + 1] == 2 * k for k in alike}
    assert not any(hit[k] for k, j in alike.items() if j < 0.8) and all(root[2 * k] == 2 * k for k in alike)
    near = lambda low, high: [hit[k] for k, j in alike.items() if low <= j < high]
    assert sum(near(0.8, 1.0)) >= 0.9 * len(near(0.8, 1.0)) and sum(near(0.9, 1.0)) >= 0.95 * len(near(0.9, 1.0))


def test_recall_at_the_threshold_itself(spark):
    """Pairs whose similarity is 0.80 to 0.82, and no more."""
    draw, rows = random.Random(12), []
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrst") for _ in range(5))
    while len(rows) < 2 * 700:
        w = [word() for _ in range(draw.choice((60, 150, 400, 900)))]
        copy = list(w)
        while jaccard(" ".join(w), " ".join(copy)) > 0.82:
            copy[draw.randrange(len(w))] = word()
        if jaccard(" ".join(w), " ".join(copy)) >= 0.8:
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(copy))]
    root = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(root[k + 1] == k for k in range(0, len(rows), 2)) >= 0.9 * len(rows) / 2


def test_a_large_group_of_near_copies_gives_few_pairs(spark):
    draw = random.Random(2)
    base = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        w[draw.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]
    ids = simhash._shingled(docs, "doc_id", "text", "check bigint, parts array<bigint>", simhash.wide_parts)
    assert simhash.wide_candidates(ids.drop("id")).count() < 400 * 40


def test_every_link_is_found(spark):
    draw, fps = random.Random(5), set()
    for _ in range(60):
        x = draw.getrandbits(64)
        fps.add(x)
        for n in range(1, 7):
            fps.add(x ^ sum(1 << b for b in draw.sample(range(64), n)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    wanted = {tuple(sorted((signed(a), signed(b)))) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4}
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp bigint")
    assert {tuple(r) for r in simhash.links(nodes).collect()} == wanted and len(wanted) >= 240


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {500: 400, 450: 400}
