from __future__ import annotations

from vellum.llm import perspectives as P
from vellum.llm.queries import QUERIES, SQL

COLUMNS = "conv_id bigint, turn bigint, role string, text string, part string, viewer int"


def test_equals_its_twin(same):
    same(QUERIES["op2_perspective_rotation"], SQL["op2_perspective_rotation"])


def test_masks_cover_what_the_speaker_said(spark):
    rows = [(1, 0, "system", "be kind", "", 0), (1, 1, "ann", "hi <|im_end|>", "", 0), (1, 2, "bob", "yo", "", 0), (1, 3, "ann", "é😀", "", 0)]
    found = {r.speaker: r for r in P.rotate(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found.keys() == {"ann", "bob"}
    for who, said in (("ann", ["hi < |im_end|>", "é😀"]), ("bob", ["yo"])):
        r = found[who]
        spans = [tuple(map(int, s.split("-"))) for s in r["mask"].split(",")]
        assert [r.rendered[a:z] for a, z in spans] == said and r.n_masked == sum(map(len, said))
    assert "<|im_start|>user name=bob\nyo<|im_end|>" in found["ann"].rendered


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, None), (1, 1, "a", "x", "", 0), (1, 1, "a", "x", "", 0), (1, 1, "b", "", "", 0), (2, 1, "system", "only", "", 0), (3, 500, "a", "y" * 50_000, "", 0), (4, 1, "a\nb", "z", "", 0), (4, 2, "c", "", "", 0)]
    found = P.rotate(spark.createDataFrame(rows, COLUMNS)).collect()
    assert {(r.conv_id, r.speaker) for r in found} == {(None, "unknown"), (1, "a"), (1, "b"), (3, "a"), (4, "a\nb"), (4, "c")}
    assert {r.n_turns for r in found if r.conv_id == 1} == {3}
    assert "user name=a b\nz" in next(r.rendered for r in found if r.speaker == "c")
    assert P.rotate(spark.createDataFrame([], COLUMNS)).count() == 0


def plain(rows):
    """(conversation, viewer) -> (whole rendering, spans), one turn after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, s, x) for c, t, s, x, *_ in rows if c == conv)
        for viewer in {s for _, s, _ in turns} - {"system"}:
            text, spans = "", []
            for _, s, x in turns:
                text += f"<|im_start|>{'system' if s == 'system' else 'assistant' if s == viewer else 'user name=' + s}\n"
                if s == viewer:
                    spans.append(f"{len(text)}-{len(text) + len(x)}")
                text += f"{x}<|im_end|>\n"
            out[conv, viewer] = text, ",".join(spans)
    return out


def test_parts_join_to_the_whole_dialogue(spark, duck):
    rows = [(1, i, f"u{i % 3}", f"t{i}" * (i % 5), "", 0) for i in range(65)]
    rows += [(2, i, "system" if i % 50 == 0 else f"u{i % 2}", f"é{i}", "", 0) for i in range(1000)]
    rows += [(3, 0, f"u{i % 3}", f"t{i}", "", 0) for i in range(700)]  # one turn number
    rows += [(4, 1, "a", "again", "", 0)] * 300 + [(4, 2, "b", "end", "", 0)]  # one row
    rows += [(5, 0, "a", "x", "", 0), (5, 1, "b", "y", "", 0)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    made = P.rotate(df).orderBy("part").collect()
    whole = {}
    for r in made:
        text, spans, n, parts = whole.get((r.conv_id, r.speaker), ("", [], 0, set()))
        whole[r.conv_id, r.speaker] = text + r.rendered, spans + ([r["mask"]] if r["mask"] else []), n + 1, parts | {r.n_parts}
    assert {k: (text, ",".join(spans)) for k, (text, spans, _, _) in whole.items()} == plain(rows)
    assert all(parts == {n} for _, _, n, parts in whole.values())
    assert {c: n for (c, _), (_, _, n, _) in whole.items()} == {1: 2, 2: 16, 3: 11, 4: 1, 5: 1}
    con = duck.cursor()
    con.register("given", df.toPandas())
    wanted = con.execute(P.SQL.replace("FROM conversations", "FROM given") + " ORDER BY part").fetchall()
    assert sorted(map(tuple, made)) == sorted(wanted)
