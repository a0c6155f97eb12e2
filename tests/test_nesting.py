import json

from pyspark.sql import functions as F

from platewright.operators.nesting import flatten_array, flatten_json, flatten_xml, json_nodes, parent_label, table_of, xml_nodes

LISTS = ("links", "sources", "quotes")


def paths(nodes):
    return sorted(n[2] for n in nodes)


def test_json_shapes():
    deep = {"links": [{"a": 1, "sources": {"s": 1, "quotes": [{"f": 1}, {"f": 2}]}}, {"sources": None}, 7, None]}
    want = ["links:1", "links:1/sources:1", "links:1/sources:1/quotes:1", "links:1/sources:1/quotes:2", "links:2"]
    assert paths(json_nodes(json.dumps(deep), LISTS)) == want
    packed = {"links": json.dumps(json.dumps(deep["links"]))}
    assert paths(json_nodes(json.dumps(packed), LISTS)) == want
    assert paths(json_nodes('{"links": {"a": null}}', LISTS)) == ["links:1"]
    for bad in (None, "", " ", "{", '{"links": ', "[1]", "3", '{"links": "x"}', '{"links": null}'):
        assert json_nodes(bad, LISTS) == []


def test_xml_paths_and_broken_text():
    text = "<T xmlns:t='u'><text><t:body><div><p>a</p><div><figure/><figure><figDesc>x</figDesc></figure></div></div><p/></t:body><back><div/></back></text></T>"
    got = xml_nodes(text, "body", ("div", "figure", "p"))
    assert [n[2] for n in got] == ["div:1", "div:1/p:1", "div:1/div:1", "div:1/div:1/figure:1", "div:1/div:1/figure:2", "p:1"]
    assert [n[0] for n in got] == ["1", "1.1", "1.2", "1.2.1", "1.2.2", "2"]
    for bad in (None, "", "  ", text[:-9], "no xml", "<a><b></a>"):
        assert xml_nodes(bad, "body", ("div",)) == []


def test_every_parent_exists_and_labels_order_the_document(spark):
    deep = "<body>" + "<div><p>x</p>" * 300 + "</div>" * 300 + "</body>"
    docs = spark.createDataFrame([(1, deep), (2, "<body><p/></body>"), (2, "<body><p/></body>"), (3, None), (4, "")], "id bigint, xml string").withColumn("dewey", F.lit("clash"))
    nodes = flatten_xml(docs, "id", "xml", "body", ("div", "p"))
    assert nodes.count() == 602
    child, parent = nodes.alias("c"), nodes.alias("p")
    lost = child.where("c.parent is not null").join(parent, F.expr("c.row_id = p.row_id and c.parent = p.dewey"), "left_anti")
    assert lost.count() == 0
    assert nodes.where("depth = 301").count() == 1  # the innermost paragraph
    assert flatten_xml(docs.limit(0), "id", "xml", "body", ("div",)).count() == 0


def test_arrays_and_tables(spark):
    df = spark.sql("select 1L as id, array(named_struct('a', 1, 'b', cast(null as string)), null, named_struct('a', 2, 'b', 'x')) as e union all select 2L, null union all select 3L, array()")
    got = flatten_array(df, "id", "e", "e").orderBy("dewey").collect()
    assert [(r.row_id, r.path, r.attributes) for r in got] == [(1, "e:1", {"a": "1"}), (1, "e:2", {"a": "2", "b": "x"})]
    nodes = flatten_json(spark.createDataFrame([(1, '{"links": [{"a": 1}]}')], "id bigint, j string"), "id", "j", LISTS)
    assert table_of(nodes, "links").first().attributes == {"a": "1"}
    labels = spark.createDataFrame([("1.12.3",), ("4",)], "d string").select(parent_label(F.col("d")))
    assert [r[0] for r in labels.collect()] == ["1.12", None]
