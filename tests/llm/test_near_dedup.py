"""What near dedup compares: no pair twice, a row for each document of a node, no pair left out."""

import itertools

from officium.llm import near_dedup


def test_a_node_of_tried_pairs_is_not_compared_again(spark, monkeypatch):
    """Two documents that meet, and are alike but not linked, were tried when one was the other's star."""
    words = [f"w{i}" for i in range(200)]
    other = [w if i % 14 or not i else f"x{i}" for i, w in enumerate(words)]
    written, plain = {}, near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, name, *more: written.update({name: plain(df, name, *more)}) or written[name])
    rows = near_dedup.near_dedup(spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string"), words=2).collect()
    assert [r["component_id"] for r in sorted(rows)] == [1, 2]
    assert written["candidates"].count() == 0


def test_tiles_are_places_of_a_document_and_leave_no_pair_out(spark, monkeypatch):
    """Tiles are dealt after the sketches are looked up, so a lookup makes a row for each document of a node."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    comp = {i: 0 if i < 20 else i // 3 for i in range(31)}
    large = spark.createDataFrame([(7, i, 9, 7, c, 31, 0, 11) for i, c in comp.items()], "node long, rep long, n long, root long, comp long, size long, main long, rest long")
    rows = near_dedup._tiles(large).collect()
    assert len(rows) == 31
    places = {r["rep"]: dict(r["places"]) for r in rows}
    for a, b in itertools.combinations(comp, 2):
        met = [n for n in places[a].keys() & places[b].keys() if places[a][n] < 0 or places[a][n] != places[b][n]]
        assert len(met) == 1 or comp[a] == comp[b], (a, b, met)
