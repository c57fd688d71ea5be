"""Stored containers and SQL functions."""

import pytest

from millrace.functions import sql
from millrace.operators import codecs as K
from millrace.sources import containers

VALUES = {1: b"line one\n" * 400, 2: b"", 3: bytes(range(256)) * 3}


@pytest.fixture
def values(spark):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in VALUES.items()], "id int, data binary")


def test_stored_containers(spark, values, tmp_path):
    path = f"{tmp_path}/packed"
    containers.write(values, "id", "data", path, 9)
    assert {r.id: bytes(r.content) for r in containers.read(spark, path, "id").collect()} == VALUES
    info = {r.id: r for r in containers.inspect(spark, path, "id").collect()}
    assert all(info[k].valid and info[k].original_size == len(v) for k, v in VALUES.items()) and info[1].packed_size < 100
    same = containers.compare(values, containers.read(spark, path, "id").withColumnRenamed("content", "data"), "id", "data")
    assert all(r.same for r in same.collect())


def test_container_files(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(K.frame(0, 5, K.lzma_pack(b"hello")))
    (tmp_path / "bad.bin").write_bytes(b"something else entirely")
    assert [bytes(r.content) for r in containers.read_files(spark, str(tmp_path)).collect()] == [b"hello"]
    assert sorted(r.valid for r in containers.inspect_files(spark, str(tmp_path)).collect()) == [False, True]


def test_compare_finds_differences_and_gaps(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, data string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, data string")
    assert {r.id: r.same for r in containers.compare(a, b, "id", "data").collect()} == {1: True, 2: False, 3: None, 4: None}


def test_sql_functions(spark, values):
    assert set(sql.register(spark)) == {"mr_tokens", "mr_clean", "mr_zigzag", "mr_enum_bits", "mr_pack", "mr_unpack"}
    r = spark.sql("SELECT mr_tokens('Große Éléphants, a x') AS t, mr_clean('  a  b ') AS c, mr_zigzag(-1L) AS z, mr_enum_bits(5L) AS b").first()
    assert (r.t, r.c, r.z, r.b) == (["große", "éléphants"], "a b", 1, 4)
    values.createOrReplaceTempView("stored")
    back = spark.sql("SELECT id, mr_unpack(mr_pack(data, 'bwt'), 'bwt') AS data FROM stored").collect()
    assert {r.id: bytes(r.data) for r in back} == VALUES
