"""The graph's build and its queries take all of their input."""

from pathlib import Path

import pytest
from oracle import assert_same

from starloom.operators import documents, graph, graph_store
from starloom.queries import catalog


def test_a_paper_is_linked_to_every_star_that_it_names(spark):
    names = spark.createDataFrame([(f"HD {i}", f"s{i}") for i in range(1, 13)] + [("GJ 9", "g9"), ("LHS 4", "l4")], "name string, source_id string")
    stars = spark.createDataFrame([("s1",)], "source_id string")
    papers = spark.createDataFrame([("1", " ".join(f"HD {i}, HD{i}" for i in range(1, 13)) + " gj 9 and LHS 4"), ("2", "HD 3"), ("3", None)], "arxiv_id string, abstract string")
    found = documents.link_stars_papers(papers, stars, names).select("source_id", "arxiv_id").collect()
    assert sorted(map(tuple, found)) == sorted([(f"s{i}", "1") for i in range(1, 13)] + [("g9", "1"), ("l4", "1"), ("s3", "2")])


def test_entity_links_go_beyond_the_fifth_name(spark, sf_dir, tmp_path):
    for f in Path(sf_dir).glob("*.parquet"):
        if f.name != "documents.parquet":
            (tmp_path / f.name).symlink_to(f)
    docs = spark.createDataFrame([(3, "HD 1 HD 2 HD 3 HD 4 HD 5 HD 48907, HD48917"), (4, "HD 48927")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'web' AS source", "CAST(length(text) AS BIGINT) AS n_chars")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (tmp_path / "sql").mkdir()  # DuckDB takes files, not folders
    for f in tmp_path.glob("*.parquet"):
        (tmp_path / "sql" / f.name).symlink_to(next(f.glob("*.parquet")) if f.name == "documents.parquet" else f)
    found = catalog.graph_build(spark, str(tmp_path))
    assert {r.step: r.created for r in found.collect()}["entity_links"] == 3
    assert_same(found, catalog.ORACLES["graph_build"], str(tmp_path / "sql"))


def _joined_rows(df):
    """Rows that the joins of a query gave, the most of any; the query is run."""
    most, rows = 0, df.collect()
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif "Join" in node.nodeName():
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most, rows


@pytest.mark.parametrize(("chunk", "share"), [(16384, 4096), (3, 2), (1, 1000), (1000, 1)])
def test_pairs_of_a_large_cluster_come_of_arrays(spark, monkeypatch, chunk, share):
    monkeypatch.setattr(graph, "CHUNK", chunk, raising=False)
    monkeypatch.setattr(graph, "SHARE", share, raising=False)
    n = 120 if chunk > 1000 else 25
    member = {(f"s{i}", c) for i in range(n) for c in ("a", "b", "c") if c == "a" or i % 7 == 0 or (c == "b" and i % 3 == 0)}
    covers = {(f"p{i}", c) for i in range(n) for c in ("a", "b", "d") if c == "a" or i % 5 == 0}
    mention = {(f"s{i}", f"p{i % 9}") for i in range(0, n, 10)}
    rows = [("Star", s, "MEMBER_OF", "Cluster", c) for s, c in member] + [("Paper", p, "COVERS", "Cluster", c) for p, c in covers] + [("Star", s, "MENTIONED_IN", "Paper", p) for s, p in mention]
    edges = spark.createDataFrame(rows, "src_type string, src string, rel string, dst_type string, dst string")
    stars = spark.createDataFrame([(f"s{i}", float(i)) for i in range(n)], "source_id string, phot_g_mean_mag double")
    papers = spark.createDataFrame([(f"p{i}", None if i % 2 else f"t{i}") for i in range(n)], "arxiv_id string, title string")
    asked = stars.where("phot_g_mean_mag < 60").select("source_id")
    stars_of = {f"s{i}" for i in range(min(n, 60))}
    most, found = _joined_rows(graph.related_stars(edges, stars, asked, 2, None))
    meets = {(a, b) for a, c in member | mention for b, d in member | mention if c == d and a != b and a in stars_of}
    assert sorted((x.source_id, x.related_id, x.phot_g_mean_mag) for x in found) == sorted((a, b, float(b[1:])) for a, b in meets)
    assert chunk < 1000 or 0 < most < len(meets) / 2
    direct = {x for x in mention if x[0] in stars_of}
    around = {(s, p) for s, c in member if s in stars_of for p, d in covers if c == d} - direct
    most, found = _joined_rows(graph.papers_of_star(edges, papers, asked.union(asked.limit(1)), cluster_context=True))
    want = [(s, p, kind, None if int(p[1:]) % 2 else f"t{p[1:]}") for pairs, kind in ((direct, "direct"), (around, "cluster_context")) for s, p in pairs]
    assert sorted(map(str, ((x.source_id, x.arxiv_id, x.link_type, x.title) for x in found))) == sorted(map(str, want))
    assert chunk < 1000 or 0 < most < len(around) / 2


def test_nodes_are_written_once_and_only_new_ones(spark, tmp_path, monkeypatch):
    def twice(*_):
        raise AssertionError("nodes were written apart first")

    path = graph_store.create_store(spark, str(tmp_path / "g"))
    monkeypatch.setattr(graph_store, "durable", twice)
    batch = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    more = batch.union(spark.createDataFrame([("c",)], "k string"))
    assert [graph_store.add_nodes(path, kind, df, "k") for kind, df in (("Star", batch), ("Star", batch), ("Paper", batch), ("Star", more), ("Star", more))] == [2, 0, 2, 1, 0]
    assert sorted(map(tuple, graph_store.read_nodes(spark, path).collect())) == [("Paper", "a"), ("Paper", "b"), ("Star", "a"), ("Star", "b"), ("Star", "c")]
