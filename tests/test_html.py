import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pagewarden.operators.checks import with_facts
from pagewarden.plans.scorecard import with_nodes
from pagewarden.sources.batches import BATCH_BYTES, PART_BYTES, PART_ROWS, parts, small_batches
from pagewarden.sources.html import MAX_BYTES, decoded, node_arrays, node_parts, page_parts, parse, sent
from pagewarden.sources.structured_data import data_parts, page_data


def tags(html):
    return [n["tag"] for n in parse(html) if not n["tag"].startswith("#")]


def node(html, tag):
    return next(n for n in parse(html) if n["tag"] == tag)


def text(html):
    return "".join(n["text"] for n in parse(html) if n["tag"] == "#text")


def test_nested_set_covers_subtrees():
    nodes = parse("<div><p>a<b>c</b></p><p>d</p></div><i>e</i>")
    div = next(n for n in nodes if n["tag"] == "div")
    inside = [n["text"] for n in nodes[div["id"] + 1 : div["end"] + 1] if n["tag"] == "#text"]
    assert inside == ["a", "c", "d"]


def test_raw_text_is_not_markup():
    assert tags("<script>var a = '<p>';</script><template><p></p></template><noscript><img></noscript>") == ["script", "template", "noscript"]
    assert tags("<style>p{}") == ["style"]
    assert text("<title>a &amp; b</title><script>a &amp; b</script>") == "a & ba &amp; b"


def test_implied_ends_close_the_current_element_only():
    assert [n["parent"] for n in parse("<ul><li>a<li>b</ul>") if n["tag"] == "li"] == [0, 0]
    assert node("<p>a<div>b</div>", "div")["parent"] == -1
    nodes = parse("<p><b>x<p>y")
    assert [n["parent"] for n in nodes if n["tag"] == "p"] == [-1, 1]


def test_tags_and_attributes():
    n = node("""<A HREF='x' href="y" data-a=1 checked title="a &lt; b"/>""", "a")
    assert n["attrs"] == {"href": "x", "data-a": "1", "checked": "", "title": "a < b"}
    assert tags("<div/><p>x") == ["div", "p"] and node("<div/><p>x", "p")["parent"] == -1
    assert tags("</p>a</x>") == [] and tags("<!doctype html><!-- <p> --><i>") == ["i"] and tags("<!-- <p>") == []


def test_head_ends_with_the_first_tag_that_is_not_its_own():
    assert node("<html><head><title>t</title><div>x", "div")["parent"] == 0
    assert tags("<html><head></head><head><body><body>") == ["html", "head", "body"]


def test_lines_hiding_and_boilerplate():
    nodes = parse("<body>\n<div hidden>a<i>b</i></div>\n<nav>c</nav><p style='display: none'>d</p></body>")
    assert node("\n\n<p>", "p")["line"] == 3
    seen = [n["text"] for n in nodes if n["tag"] == "#text" and n["hidden_by"] <= 0 and n["boiler"] <= 0]
    assert "".join(seen).split() == []
    assert [n["text"] for n in nodes if n["tag"] == "#text" and n["boiler"] > 0] == ["c"]


def test_entities_are_decoded_once():
    assert decoded("&amp;lt; &#65;&#x42; &copy &nope; &#0;") == "&lt; AB © &nope; &#0;"


def test_null_and_empty():
    assert parse(None) is None and parse("") == []


def test_pages_are_parsed_in_parts_of_bounded_size():
    own = ["<p>a</p>", None, "", "<p>" + "b" * (PART_BYTES // 2) + "</p>", "<i>c</i>" * 4] * 150 + ["<p>d</p>"] * (3 * PART_ROWS)
    out = list(node_parts(iter([pa.array(own[:7], pa.string()), pa.array(own[7:], pa.string())])))
    assert [x.as_py() for part in out for x in part] == [x.as_py() for x in node_arrays([parse(x) for x in own])]
    at = 0
    for part in out:
        held = own[at : (at := at + len(part))]
        assert len(held) <= PART_ROWS and (len(held) == 1 or sum(len(x or "") for x in held) <= PART_BYTES)


def test_authors_are_found_in_parts_of_bounded_size():
    own = [f'<meta name="author" content="Ann {i}">' if i % 5 else None for i in range(3 * PART_ROWS + 1)] + ["<p>" + "b" * (PART_BYTES // 2) + "</p>"] * 3
    out = list(page_parts(iter([(pa.array(own, pa.string()), pa.array(["https://s.example/"] * len(own)))])))
    assert [len(part) for part in out] == [PART_ROWS] * 3 + [2, 1, 1]
    assert [x["nodes"] for part in out for x in part.to_pylist()] == node_arrays([parse(x) for x in own]).to_pylist()
    assert [x["author"]["name"] for part in out for x in part.to_pylist()] == [f"Ann {i}" if i % 5 else None for i in range(3 * PART_ROWS + 1)] + [None] * 3


def test_structured_data_is_read_in_parts_of_bounded_size():
    own = [[f'{{"@type": "Person", "name": "n{i}"}}'] if i % 4 else None for i in range(2 * PART_ROWS + 7)] + [['"' + "b" * (PART_BYTES // 2) + '"']] * 3
    lines = [None if x is None else [1] for x in own]
    out = list(data_parts(iter([(pd.Series(own), pd.Series(lines))])))
    assert [len(part) for part in out] == [PART_ROWS] * 2 + [8, 1, 1]
    assert [n for part in out for n in part["nodes"]] == [page_data(x, y)["nodes"] for x, y in zip(own, lines)]


def test_parts_hold_every_row_once():
    assert list(parts(np.array([], dtype=int))) == []
    assert list(parts(np.array([5, 0, 20, 3, 3, 3, 0]), 6, 3)) == [(0, 2), (2, 3), (3, 5), (5, 7)]


def test_rows_of_many_parts_stay_whole(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    html = """concat('<title>t', id, '</title><script type="application/ld+json">{"@type": "Person", "name": "n', id, '"}</script>')"""
    pages = spark.range(0, 1300, 1, 1).selectExpr("id AS page_id", "concat('https://s.example/', id) AS url", f"CASE WHEN id % 7 <> 3 THEN {html} END AS html")
    got = with_facts(with_nodes(pages, author=True)).select("page_id", "title", "author.name", F.coalesce("ld.blocks", F.lit(0)).alias("blocks")).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert {r["page_id"]: (r["title"], r["name"], r["blocks"]) for r in got} == {i: (f"t{i}", f"n{i}", 1) if i % 7 != 3 else ("", None, 0) for i in range(1300)}


def peak(run):
    tracemalloc.start()
    try:
        held = run()
        return tracemalloc.get_traced_memory()[1], held
    finally:
        tracemalloc.stop()


def test_objects_of_a_dense_page_stay_small():
    most, nodes = peak(lambda: parse("<p>x" * 5000))
    assert len(nodes) == 15000 and most / len(nodes) < 500


def test_objects_of_a_part_go_before_the_next():
    page, url = "<p>x" * 200, "https://s.example/"
    taken = lambda n: peak(lambda: [len(x) for x in page_parts(iter([(pa.array([page] * n), pa.array([url] * n))]))])
    taken(1)
    one, many = taken(PART_ROWS), taken(3 * PART_ROWS)
    assert many[1] == [PART_ROWS] * 3 and many[0] < 1.3 * one[0]


def test_no_more_of_a_page_is_sent_to_a_worker_than_is_read(spark):
    pages = spark.createDataFrame([(0, "é<p>"), (1, "<p>" + "b" * (3 * MAX_BYTES)), (2, "é" * (MAX_BYTES + 5)), (3, None), (4, "")], "id int, html string")
    for row in pages.select("html", sent(F.col("html")).alias("sent")).collect():
        assert len(row["sent"] or "") <= MAX_BYTES and parse(row["sent"]) == parse(row["html"])


def test_batch_sizes_set_with_units_are_read(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    for said, then in (("64m", BATCH_BYTES), ("1GB", BATCH_BYTES), ("1m", 1 << 20), ("4096", 4096)):
        spark.conf.set(key, said)
        small_batches(spark)
        assert spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) == then
    spark.conf.set(key, before)
