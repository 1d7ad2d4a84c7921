from __future__ import annotations

import random
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import pytest

from vellum.llm import passages as P
from tests.llm.helpers import Groups, empty, odd, words


def test_compact_windows_equal_brute_force():
    draw = np.random.default_rng(2)
    for n in (1, 5, 12, 60, 200):
        a, b = (draw.integers(1, 40, m).astype(np.uint64) * np.uint64(8) for m in (n, max(1, n // 2)))
        flat, zero = np.concatenate([a, [np.uint64(0)], b, [np.uint64(0)]]), len(a)
        got = {tuple(r) for r in P.compact_windows(flat, np.array([zero, len(flat) - 1]), 5).tolist()}
        wanted = set()
        for t, v in enumerate((a, b)):
            for i in range(len(v)):
                first, last = i, i
                while first > 0 and v[first - 1] > v[i]:
                    first -= 1
                while last + 1 < len(v) and v[last + 1] >= v[i]:
                    last += 1
                if last - first + 1 >= 5:
                    wanted.add((t, i, first, last))
        assert got == wanted


def corpus(spark, copies=1):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    shared, near = text(60), text(100)
    changed = list(near)
    changed[50] = "other"
    rows = [(1, text(300) + shared + text(40)), (2, text(10) + shared), (3, near + text(200)), (4, text(80) + changed), (5, text(400)), (6, text(30) + text(30)), (7, shared[:45] + text(100))]
    rows += [(100 + i, shared + text(5)) for i in range(copies)]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")


def test_planted_passages(spark):
    found = P.repeated_passages(corpus(spark)).collect()
    pairs = {(r.doc_id, r.other_id): r for r in found}
    assert pairs.keys() == {(2, 1), (4, 3), (100, 1)}
    r = pairs[2, 1]
    assert (r.start, r.n_words, r.other_start, r.similarity) == (10, 60, 300, 1.0)
    assert pairs[4, 3].similarity >= 0.8 and pairs[4, 3].n_words >= 95


def test_copies_are_linked_once_each(spark):
    found = P.repeated_passages(corpus(spark, 50)).collect()
    assert {r.doc_id for r in found} == {2, 4, *range(100, 150)} and len(found) == 52


def test_codes_of_a_batch_are_those_of_each_text():
    texts = ["", "a b", "a b c d e", None, "x", "a b c d e f  g", "A B c\td e f g h", ""]
    codes, sizes = P.shingle_codes(pa.array([t and t.encode() for t in texts], pa.binary()), P.SHINGLE)
    assert sizes.tolist() == [0, 0, 1, 0, 0, 3, 4, 0]
    assert codes[0] == codes[1] == codes[4] and len(set(codes.tolist())) == 4 and (codes[1:4] == codes[4:7]).all()


def test_odd_rows(spark):
    found = P.repeated_passages(odd(spark))
    assert found.columns == ["doc_id", "start", "n_words", "other_id", "other_start", "similarity"]
    assert {(r.doc_id, r.other_id) for r in found.collect()} == set()
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(1, long, "a"), (1, long + " more", "b"), (2, long, "c"), (2, long, "c"), (None, long, "d")]
    ids = {(r.doc_id, r.other_id) for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string, other_id string")).collect()}
    assert ids == {(2, 1)}
    assert P.repeated_passages(empty(spark)).count() == 0


def test_a_partial_copy_at_the_lowest_id_hides_no_passage(spark):
    draw, rows, wanted = random.Random(4), [], set()
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    for k in range(0, 400, 4):
        shared = text(60)
        edited = list(shared)
        edited[20], edited[40] = "other", "words"
        low = shared[:45] if k % 8 else edited
        rows += [(k, text(30) + low + text(30)), (k + 1, text(9) + shared + text(20)), (k + 2, text(20) + shared), (k + 3, shared + text(7))]
        wanted |= {k + 2, k + 3}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    found = {(r.doc_id, r.other_id) for r in P.repeated_passages(docs).where("similarity = 1 and n_words = 60").collect()}
    assert wanted <= {i for i, _ in found}  # recall 1 of equal passages, by construction
    assert all(i // 4 == j // 4 for i, j in found)


def test_what_the_least_text_holds_in_part_hides_nothing(spark):
    """Two texts share 60 words of which the least text has the first 48; found by construction, not by chance."""
    draw, rows = random.Random(14), []
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    for k in range(0, 450, 3):
        shared = text(60)
        rows += [(k, text(30) + shared[:48] + text(30)), (k + 1, text(9) + shared + text(20)), (k + 2, text(20) + shared)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    found = {(r.doc_id, r.other_id) for r in P.repeated_passages(docs).where("similarity = 1 and n_words >= 60").collect()}
    assert found == {(k + 2, k + 1) for k in range(0, 450, 3)}


def check_links(docs, least):
    """Texts that share a stretch of 51 words, by brute force over whole texts: all but the first of each are in the result, with an earlier
    text, and those that reach each other in all pairs do so in the links as well."""
    holders, wanted, got = {}, Groups(), Groups()
    for r in sorted(docs.collect()):
        w = [x.lower() for x in words(r.text)]
        for i in range(len(w) - 50):
            holders.setdefault(hash(tuple(w[i : i + 51])), []).append(r.doc_id)
    texts = set()
    for ids in holders.values():
        for i in set(ids) - {min(ids)}:
            wanted.join(min(ids), i)
            texts.add(i)
    found = P.repeated_passages(docs).collect()
    for r in found:
        got.join(r.doc_id, r.other_id)
    assert len(texts) >= least and len(texts - {r.doc_id for r in found}) == 0
    assert all(got.root(i) == got.root(wanted.root(i)) for i in texts)


@pytest.mark.parametrize(("size", "least"), [("sf0.001", 20), ("sf0.01", 100)])
def test_links_against_all_pairs(spark, sf, size, least):
    check_links(spark.read.parquet(f"{sf.replace('sf0.001', size)}/documents.parquet").where("text is not null").select("doc_id", "text"), least)


def test_holders_of_parts_in_every_order(spark):
    """Texts that hold the start, the middle, the end or all of a passage, by all orders of their ids."""
    draw, rows = random.Random(21), []
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    parts = {"start": (0, 60), "middle": (20, 74), "end": (31, 90), "all": (0, 90), "few": (14, 64)}
    for order in [*permutations(parts), *permutations(("start", "middle", "all"))]:
        shared = text(90)
        rows += [(len(rows) + k, " ".join(text(draw.randrange(5, 40)) + shared[slice(*parts[name])] + text(draw.randrange(5, 40)))) for k, name in enumerate(order)]
    check_links(spark.createDataFrame(rows, "doc_id bigint, text string"), 250)


def test_near_passages_against_all_pairs(spark):
    """Passages of 120 words with one to three replaced, among them repeats in one very long text: nine in ten of those of 0.8 or more are found."""
    draw, rows, alike = random.Random(22), [], set()
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    long = text(20_000)
    for k in range(300):
        shared = long[60 * k + 100 : 60 * k + 220] if k % 10 == 0 else text(120)
        edited = list(shared)
        for at in draw.sample(range(120), 1 + k % 3):
            edited[at] = "other"
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if len(shingles(shared) & shingles(edited)) >= 0.8 * len(shingles(shared) | shingles(edited)):
            alike.add(2 * k + 1)
        rows += [(2 * k, " ".join(text(20) + (shared if k % 10 else text(60)) + text(30))), (2 * k + 1, " ".join(text(25) + edited + text(15)))]
    rows.append((-1, " ".join(long)))
    found = {r.doc_id for r in P.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).where("similarity >= 0.8").collect()}
    assert len(alike) > 150 and len(alike & found) >= 0.9 * len(alike)


def test_similar_passages_behind_unlike_ones_are_of_one_class(spark):
    """Two texts share a similar passage of which the two least texts hold edited forms that are like nothing; and one line of 44 words stands in many texts, of
    which two have more in common. Every pair that is similar by brute force is of one class, and no other."""
    draw, rows = random.Random(31), []
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    for _ in range(40):
        shared = text(60)
        forms = [list(shared) for _ in range(3)]
        for form, places in zip(forms, ((14, 44), (15, 43), (29,)), strict=True):
            for at in places:
                form[at] = word()
        rows += [text(20) + forms[0] + text(20), text(20) + forms[1] + text(9), text(7) + shared + text(30), text(11) + forms[2] + text(30)]
    line, tail = text(40), text(20)
    rows += [text(30) + line + text(30) for _ in range(2 * P.FEW)]
    rows += [text(30) + line + tail[:6] + [word()] + tail[7:] + text(30) for _ in range(2)]
    texts = [" ".join(t) for t in rows]
    codes, sizes = P.shingle_codes(pa.array([t.encode() for t in texts], pa.binary()), P.SHINGLE)
    parts = np.split(codes.astype(np.uint32), np.cumsum(sizes)[:-1])
    wanted = {(i, j) for i, j in combinations(range(len(parts)), 2) if P.common_stretches(parts[i], parts[j]) or P.common_stretches(parts[j], parts[i])}
    found = P.passage_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)).collect()
    classes = {r.doc_id: r.class_id for r in found}
    assert len(wanted) > 40 and all(classes.get(i, i) == classes.get(j, j) for i, j in wanted)
    assert {(r.other_id, r.doc_id) for r in found} <= wanted


def test_a_run_that_fails_as_a_whole_is_split():
    draw = np.random.default_rng(3)
    fresh = lambda n: draw.integers(1, 1 << 32, n).astype(np.uint32)
    shared = [fresh(47) for _ in range(4)]
    x, y = (np.concatenate([np.concatenate([s, fresh(18)]) for s in shared]) for _ in range(2))
    assert [h[0] for h in P.common_stretches(x, y)] == [0, 65, 130, 195]
    assert all(h[3] >= 0.8 for h in P.common_stretches(x, y))
    near = fresh(120)
    long, other = np.concatenate([near, fresh(9), shared[0]]), np.concatenate([near, fresh(40), shared[0]])
    assert [(h[0], h[1] >= 119) for h in P.common_stretches(long, other)][0] == (0, True)


def periodic(draw, n):
    """Texts of codes as lists of words that repeat give: stretches of one to six codes over and over, of the same few for all."""
    loops = [draw.integers(1, 9, draw.integers(1, 7)).astype(np.uint32) for _ in range(n)]
    return np.concatenate([np.tile(loop, 300)[: draw.integers(20, 220)] for loop in loops])


def test_repeating_codes_are_split_no_further_than_a_passage_can_be(monkeypatch):
    """What is not looked at gives no passage; codes that repeat in one text and not in the other were looked at thousands of times."""
    draw = np.random.default_rng(8)
    ranks = draw.integers(0, 30, 400)
    assert P.distinct_counts(ranks).tolist() == [len(set(ranks[i : i + P.LEAST].tolist())) for i in range(400 - P.LEAST + 1)]
    pairs = [(periodic(draw, 5), periodic(draw, 3)) for _ in range(60)]
    looks, similar = [], P._similar
    monkeypatch.setattr(P, "_similar", lambda *a: looks.append(1) or similar(*a))
    x = np.concatenate([np.tile(np.array([k, k + 1], np.uint32), 60) for k in range(0, 20, 2)])
    y = np.concatenate([np.array([k, k + 1] * 4 + list(range(100 + 10 * k, 112 + 10 * k)), np.uint32) for k in range(0, 20, 2)])
    assert P.common_stretches(x, y) == [] and len(looks) < 10
    found = [P.common_stretches(*pair) for pair in pairs]
    monkeypatch.setattr(P._Sets, "possible", lambda *a: True)
    assert found == [P.common_stretches(*pair) for pair in pairs] and sum(map(len, found)) > 20


def test_a_text_with_many_keys_is_looked_at_once(spark, monkeypatch):
    """Texts with a common line of 44 words meet in several values of the line; their shingles are counted once for each text, not for each value."""
    draw = random.Random(32)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    line = text(44)
    docs = spark.createDataFrame([(i, " ".join(text(30) + line + text(30))) for i in range(3 * P.FEW)], "doc_id bigint, text string")
    made, stored = {}, P.stored
    monkeypatch.setattr(P, "stored", lambda df, name: made.setdefault(name, stored(df, name)))
    assert P.passage_classes(docs).count() == 0
    assert 0 < made["around"].count() <= 3 * P.FEW * (44 + 60 - 4)
