"""Parsers of one's own over lines in order."""

from motifloom.sources import records

CONTENT = "junk\nrecord 1\nitem a b\n\nitem c\nend\nitem lost\nrecord 2\nrecord 3\nitem  x\nstop\nrecord 9\nitem y\n"


def listed(df):
    return sorted((r["tran_id"], r["items"]) for r in df.collect())


def test_records_over_several_lines(spark, tmp_path):
    """The state of a parser begins anew with each file, whatever the splits; a file may end inside a record."""
    (tmp_path / "a").write_text(CONTENT)
    (tmp_path / "b").write_text("item z\nrecord 4\nitem q\nitem r")
    expected = [(1, ["a b", "c"]), (2, []), (3, ["x"]), (4, ["q", "r"])]
    assert listed(records.parsed(records.lines(spark, str(tmp_path)), records.Blocks, records.Blocks.SCHEMA)) == expected
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert listed(records.parsed(records.lines(spark, str(tmp_path)), records.Blocks, records.Blocks.SCHEMA)) == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_in_sql_and_over_any_rows(spark):
    rows = [(g, i, line) for g in ("p", None) for i, line in enumerate(["record 7", "item a", None, "item b", "end"])]
    df = spark.createDataFrame(rows, "g string, i int, value string")
    assert listed(records.parsed(df, records.Blocks, records.Blocks.SCHEMA, part="g", order=("i",))) == [(7, ["a", "b"])] * 2
    records.register(spark, "blocks", records.Blocks, records.Blocks.SCHEMA)
    found = spark.sql("select tran_id, items from blocks(table(select * from {t}) partition by g order by i)", t=df)
    assert listed(found) == [(7, ["a", "b"])] * 2
    assert listed(records.parsed(df.where("false"), records.Blocks, records.Blocks.SCHEMA, part="g", order=("i",))) == []
