import pytest

from reelspark.sources.quoted import quoted_records, read_quoted_csv

TEXT = ('movieId,title,plot\n1,"A ""quoted"" one","two\nlines, and ""more""\n\nafter a blank"\n2,plain,x\n'
        '3,"","ends with a quote"""\n4,N/A,"\n\n\n"\n5,é東,"ünï\ncode"\n6,last,"no newline at\nthe end"')


def _read(spark, path, **how):
    return sorted(map(repr, read_quoted_csv(spark, str(path), **how).collect()))


def _whole(spark, path, **how):
    return sorted(map(repr, spark.read.csv(str(path), header=True, multiLine=True, escape='"', **how).collect()))


@pytest.fixture
def split_bytes(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in keys}

    def set_(n):
        for k, x in zip(keys, (n, 0, 1), strict=True):
            spark.conf.set(k, str(x))

    yield set_
    for k, x in before.items():
        spark.conf.unset(k) if x is None else spark.conf.set(k, x)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_every_split_offset(spark, tmp_path, split_bytes, end):
    """However the file is split, also inside of quotes, escapes and characters of several bytes."""
    path = tmp_path / "films.csv"
    path.write_bytes(TEXT.replace("\n", end).encode())
    want = _whole(spark, path)
    assert len(want) == 6
    size = len(path.read_bytes())
    for n in ([1, 2, 3, 5, 8, 13, 29, 47, size - 1] if end == "\n" else [3, 17]):
        split_bytes(n)
        assert quoted_records(spark, str(path)).rdd.getNumPartitions() > 1 or n > 40
        assert _read(spark, path) == want, n
    split_bytes(1 << 20)
    assert _read(spark, path, null_value="N/A") == _whole(spark, path, nullValue="N/A")


def test_folders_of_files(spark, tmp_path, split_bytes):
    (tmp_path / "all").mkdir()
    for n in range(3):
        (tmp_path / "all" / f"{n}.csv").write_text(TEXT.replace("plain", f"plain {n}"))
    split_bytes(40)
    assert _read(spark, tmp_path / "all") == _whole(spark, tmp_path / "all")
    (tmp_path / "all" / "9.csv").write_text("title,movieId,plot\nx,1,y\n")
    with pytest.raises(ValueError, match="header"):
        _read(spark, tmp_path / "all")


def test_a_quote_that_is_never_closed(spark, tmp_path, split_bytes):
    path = tmp_path / "open.csv"
    path.write_text('a,b\n1,2\n3,"open\n4,5\n6,7\n')
    split_bytes(5)
    got = [r.record for r in quoted_records(spark, str(path)).collect()]
    assert sorted(got) == ["1,2", '3,"open\n4,5\n6,7', "a,b"]
