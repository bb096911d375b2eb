"""VOTables in splits against the reader of whole files."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import readers, scans

HEAD = '<?xml version="1.0"?><VOTABLE xmlns="http://www.ivoa.net/xml/VOTable/v1.3"><INFO name="QUERY_STATUS" value="{status}"/><RESOURCE>'
TABLE = '<TABLE ID="i" name="{name}"><DESCRIPTION>a table</DESCRIPTION><FIELD ID="x" name="a" unit="d"/><GROUP><FIELDref ref="x"/></GROUP>\n<FIELD name="b&amp;c" datatype="char"><DESCRIPTION>d</DESCRIPTION></FIELD><DATA><TABLEDATA>{rows}</TABLEDATA></DATA></TABLE>'


def line(k):
    text = ["plain", "a &lt; b &amp;amp; c", "", "乳腺 &#x1F600;&#233;", "two\nlines  "][k % 5]
    return f"\n<TR><TD>{k}</TD>" + ("<TD/>" if text == "" else f'<TD class="x">{text}</TD>') + "</TR>"


def document(*tables, status="OK"):
    return HEAD.format(status=status) + "".join(TABLE.format(name=n, rows="".join(map(line, rows))) for n, rows in tables) + "</RESOURCE></VOTABLE>"


def test_splits_against_whole_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(document(("first", range(700)), ("t", range(3000)), ("last", range(5))))
    (tmp_path / "b.xml").write_text(document(("t", range(3)), ("none", [])))
    (tmp_path / "c.xml").write_text(document(("none", []), ("t", []), ("u", range(4))))
    (tmp_path / "d.xml").write_text(document(("t", range(9))))
    whole = readers.votable(spark.read.format("binaryFile").load(str(tmp_path)), "t")
    want = sorted((r["path"].rsplit("/", 1)[1], r["source_row"], sorted(r["row"].items())) for r in whole.collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "4096", "30000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = scans.votable_rows(spark, str(tmp_path), "t")
            assert sorted((r["path"].rsplit("/", 1)[1], r["source_row"], sorted(r["row"].items())) for r in rows.collect()) == want
            if size == "4096":
                assert scans._records(spark, str(tmp_path / "a.xml")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {w[0] for w in want} == {"a.xml", "b.xml", "d.xml"} and len(want) == 3012


@pytest.mark.parametrize(("content", "said"), [
    (document(("u", range(2))), "no table t"), (document(("t", range(2)), status="overflow"), "query status"), (document(("t", range(2))).replace("<TD>1</TD>", ""), "row 2 has 1 cells"),
    (document(("t", range(2))).replace("plain", "<b>x</b>"), "cells for"),
])
def test_faults(spark, tmp_path, content, said):
    (tmp_path / "a.xml").write_text(content)
    with pytest.raises(Exception, match=said):
        scans.votable_rows(spark, str(tmp_path), "t").collect()


def test_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(k, ["<x> & 'y'", None, "", "a\r\nb", "]]>"][k % 5]) for k in range(500)], "k long, `v w` string").repartition(4)
    scans.write_votables(df, f"{tmp_path}/out", "t")
    rows = scans.votable_rows(spark, f"{tmp_path}/out", "t")
    got = sorted((int(r["row"]["k"]), r["row"]["v w"]) for r in rows.collect())
    assert got == sorted((r["k"], r["v w"] or "") for r in df.collect())
    whole = readers.votable(spark.read.format("binaryFile").load(f"{tmp_path}/out/part-*"), "t")
    assert sorted((int(r["row"]["k"]), r["row"]["v w"]) for r in whole.collect()) == got
    assert rows.filter(F.col("source_row") == 1).count() == rows.select("path").distinct().count()
