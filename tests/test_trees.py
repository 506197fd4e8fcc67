"""Large JSON trees in files, read by several tasks."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rotorline.plans import fixtures as fx
from rotorline.sources.tables import explode_tree
from rotorline.sources.trees import _pieces, read_trees

from conftest import rows

NOTE = T.StructType([T.StructField("text", T.StringType()), T.StructField("list", T.ArrayType(T.StringType()))])
NODE = T.StructType([T.StructField("motorId", T.StringType()), T.StructField("temperature", T.DoubleType()), T.StructField("note", NOTE)])
SIZES = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def split(spark):
    """Call it with the bytes of a split."""
    before = {k: spark.conf.get(k) for k in SIZES}
    yield lambda n: [spark.conf.set(k, str(v)) for k, v in zip(SIZES, (n, 1))]
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def entries(df):
    return rows(explode_tree(df, NODE))


def nasty(i):
    return {"motorId": f'M"{i}\\', "temperature": i / 2,
            "note": {"text": '}{ ]"\\" ' * (i % 4) + "é}" * (i % 3), "list": ["{", "}", "\\", '"'][: i % 5]}}


def test_one_tree_in_any_splits_is_the_tree(spark, split, tmp_path):
    tree = {f'k"}}{i}': nasty(i) for i in range(60)}
    for layout in ({"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}):
        text = json.dumps(tree, **layout)
        path = write(tmp_path / f"tree{len(layout)}", text)
        want = entries(spark.createDataFrame([(text,)], "value string"))
        assert len(want) == 60
        split(331)
        assert entries(read_trees(spark, path)) == want
    split(331)
    assert entries(read_trees(spark, path, most_listed=0)) == want


def test_one_file_is_read_by_several_tasks(spark, split, tmp_path):
    path = write(tmp_path / "tree", json.dumps({str(i): nasty(i) for i in range(400)}))
    split(4096)
    used = _pieces(spark, path).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 4
    small = read_trees(spark, path)
    assert small.count() == 400 and small.agg(F.max(F.length("value"))).first()[0] < 400


def test_other_values_blanks_and_several_trees(spark, split, tmp_path):
    cases = {
        '{"a":{"motorId":"x"},"b":null}': [("a", "x"), ("b", None)],
        '{"b":null,"a":{"motorId":"x"}}': [("a", "x"), ("b", None)],
        ' {"a" : {"motorId" : "x"} , "b" : {} } \n': [("a", "x"), ("b", None)],
        '{"a":{"motorId":"x"}}\n{"a":{"motorId":"y"}}\n\n': [("a", "x"), ("a", "y")],
        '{"a":{"motorId":"x"},"a":{"motorId":"x"}}': [("a", "x"), ("a", "x")],
        "{}": [], "null": [], "": [], "\n": [],
    }
    for i, (text, want) in enumerate(cases.items()):
        path = write(tmp_path / f"case{i}", text)
        for size in (7, 1000):
            split(size)
            assert rows(explode_tree(read_trees(spark, path), NODE), "id", "motorId") == sorted(want, key=repr), text


@pytest.mark.parametrize("text", [
    '{"a":{"motorId":"x"},"b":{"motorId":"y', '{"a":{"motorId":"x"},"b":{"temperature":12', '{"a":{"motorId":"x"},"b":1',
    '{"a":{"motorId":"x"}', '{"a":{"motorId":"x"}}}',
])
def test_a_cut_off_tree_is_an_error(spark, split, tmp_path, text):
    split(7)
    with pytest.raises(PySparkException, match="cut off"):
        read_trees(spark, write(tmp_path / "tree", text)).collect()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=st.dictionaries(st.text('a}{"\\,:é', max_size=6), st.fixed_dictionaries({"motorId": st.text('b}{"\\[]é', max_size=12)}), max_size=12),
       size=st.integers(9, 80))
def test_any_tree_any_split(spark, split, tmp_path, tree, size):
    text = json.dumps(tree)
    split(size)
    path = write(tmp_path / f"tree{abs(hash((text, size)))}", text)
    assert rows(explode_tree(read_trees(spark, path), NODE), "id", "motorId") == sorted(((k, v["motorId"]) for k, v in tree.items()), key=repr)


def test_many_files_are_the_frame(spark, folder):
    trees = fx.tree(spark, "/root/testdata/sf0.001")
    trees.write.text(folder("trees"))
    assert rows(explode_tree(read_trees(spark, folder("trees")), fx.TREE_NODE)) == rows(explode_tree(trees, fx.TREE_NODE))
