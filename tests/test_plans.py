import pytest
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.plans import paths, pipeline
from tessera.sources import elements

XML = """<Volume Path="/v"><Block Name="TEM" Path="TEM">
<Section Number="1" Path="0001"><Channel Name="TEM" Path="TEM"><Filter Name="Raw8" BitsPerPixel="8"/><Filter Name="Leveled"/></Channel></Section>
<Section Number="2" Path="0002"><Channel Name="Registered" Path="R"><Filter Name="Raw8"/></Channel></Section>
<Section Number="3" Path="0003"><Channel Name="Empty" Path="E"/><Channel Name="TEM" Path="TEM"><Filter Name="Leveled"/></Channel></Section>
</Block></Volume>"""


@pytest.fixture(scope="module")
def tree(spark):
    return elements.parsed(spark.createDataFrame([("v", XML)], "file string, text string")).cache()


def names(df, attr="Name"):
    return sorted(r["attrs"].get(attr) for r in df.collect())


def test_paths(tree):
    root = tree.where("parent is null")
    assert names(paths.find_all(root, tree, "Block/Section[@Number>1]"), "Number") == ["2", "3"]
    assert names(paths.find_all(root, tree, "Block/Section/Channel/Filter[@Name='Leveled']")) == ["Leveled", "Leveled"]
    assert names(paths.find_all(root, tree, "Block/*/Channel[@Name='TEM']/..", "s"), "Number") == ["1", "3"]
    first = paths.find(tree.where("tag = 'Section'"), tree, "Channel/Filter", "section")
    assert names(first) == ["Leveled", "Raw8", "Raw8"]
    assert paths.find(root, tree, "Block/Nothing").count() == 0
    with pytest.raises(ValueError):
        paths.parse("a[b")


def test_ancestors(tree):
    inherited = paths.inherited_attribute(tree, "Number").join(tree.where("tag = 'Filter'").select("id"), "id", "left_semi")
    assert sorted(r["value"] for r in inherited.collect()) == ["1", "1", "2", "3"]
    full = paths.full_paths(tree).join(tree.where("tag = 'Channel'").select("id"), "id", "left_semi")
    assert sorted(r["full_path"] for r in full.collect()) == ["/v/TEM/0001/TEM", "/v/TEM/0002/R", "/v/TEM/0003/E", "/v/TEM/0003/TEM"]
    assert paths.nearest_ancestor(tree, "Section").count() == 8


CATALOGUE = """<PipelineManager><Pipeline Name="List"><Arguments><Argument flag="-Channels" dest="Channels" default="(?!Registered)"/><Argument dest="Sections"/></Arguments>
<Iterate XPath="Block/Section" VariableName="SectionNode"><RequireSetMembership Attribute="Number" List="#Sections"/>
<Iterate XPath="Channel" VariableName="ChannelNode"><RequireMatch Attribute="Name" RegEx="#Channels"/>
<Select XPath="Filter[@Name='Leveled']" VariableName="FilterNode"/>
<PythonCall Function="listed" Filter="#FilterNode" Level="4"><Parameters><Entry Name="x" Value="1.5"/></Parameters></PythonCall></Iterate></Iterate></Pipeline>
<Pipeline Name="Another"/></PipelineManager>"""


@pipeline.function
def listed(rows, elements, Filter, Level, parameters, **kwargs):
    assert parameters == {"x": 1.5} and Level == 4
    section = elements.select(F.col("id").alias("SectionNode"), F.col("attrs")["Number"].alias("number"))
    return rows.join(section, "SectionNode").select("number", F.col(Filter).alias("filter"))


def test_pipeline(tree):
    catalogue = pipeline.Catalogue(CATALOGUE)
    assert catalogue.names() == ["Another", "List"]
    (made,) = pipeline.run(catalogue.pipeline("List"), tree)
    assert sorted(r["number"] for r in made.collect()) == ["1", "3"]
    (made,) = pipeline.run(catalogue.pipeline("List"), tree, {"Sections": [2, 3]})
    assert sorted(r["number"] for r in made.collect()) == ["3"]
    with pytest.raises(pipeline.PipelineError):
        catalogue.pipeline("None")


def test_values():
    assert values.integer_list("1, 3,5-7,9") == [1, 3, 5, 6, 7, 9]
    assert values.number_pair("256") == (256, 256) and values.number_pair("256, 128") == (256, 128)
    assert [values.typed(x) for x in ("true", "3", "3.5", "x", 4)] == [True, 3, 3.5, "x", 4]
    v = {"Block": "TEM", "BlockNode": {"Name": "B"}, "N": 4}
    assert values.substituted("a/#BlockNode.Name/#N", v) == "a/B/4" and values.substituted("#N", v) == 4 and values.substituted("#Blockx", v) == "TEMx"
    with pytest.raises(KeyError):
        values.substituted("#Missing", v)
    scope = values.Scope({"a": 1}).bind("b", 2)
    assert scope.with_call({"c": "#a", "d": "#b-x"}, {"p": "3"}).keywords() == {"a": 1, "b": 2, "c": 1, "d": "2-x", "parameters": {"p": 3}}
