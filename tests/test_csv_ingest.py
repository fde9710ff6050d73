import pytest

from febrile.sources.csv_scan import (assert_required_columns, profile_feature_columns, require_features,
                                      scan_csv_inferred)


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)


def test_na_tokens_and_types(spark, scratch):
    p = scratch + "/obs.csv"
    _write(p, "Region,Temp,Count,Kind,outbreak_label,fever_type\n"
              "A,30.5,3,x,1,Viral\nB,nan,4,NA,0,nan\nC,,5,null,,None\nD,31,6,y,1,Dengue\n")
    df = scan_csv_inferred(spark, p)
    types = dict(df.dtypes)
    assert types["Temp"] == "double" and types["Count"] == "bigint" and types["Kind"] == "string"
    assert types["outbreak_label"] == "double"          # has a missing value
    rows = {r["Region"]: r for r in df.collect()}
    assert rows["B"]["Temp"] is None and rows["B"]["Kind"] is None and rows["B"]["fever_type"] is None
    assert rows["C"]["fever_type"] is None and rows["C"]["outbreak_label"] is None
    num, cat = profile_feature_columns(df, ["Region", "outbreak_label", "fever_type"])
    assert num == ["Temp", "Count"] and cat == ["Kind"]


def test_required_columns_and_features(spark):
    df = spark.createDataFrame([("A", 1)], "Region string, outbreak_label int")
    with pytest.raises(ValueError, match="fever_type"):
        assert_required_columns(df, ["Region", "outbreak_label", "fever_type"])
    with pytest.raises(ValueError):
        require_features([], [])


def test_quotes_line_breaks_suffixes_and_booleans(spark, scratch):
    p = scratch + "/odd.csv"
    _write(p, 'Region,Note,Code,Flag,Gap,X\n'
              'A,"say ""hi"", ok",12D,True,True,1e3\n'
              'B,"two\nlines, one field",20F,False,,-.5\n'
              'C,plain,7L,True,False, 2 \n')
    df = scan_csv_inferred(spark, p)
    assert dict(df.dtypes) == {"Region": "string", "Note": "string", "Code": "string", "Flag": "boolean", "Gap": "string",
                               "X": "double"}
    rows = {r["Region"]: r for r in df.collect()}
    assert rows["A"]["Note"] == 'say "hi", ok' and rows["B"]["Note"] == "two\nlines, one field"
    assert [rows[k]["Code"] for k in "ABC"] == ["12D", "20F", "7L"] and rows["B"]["Flag"] is False
    assert [rows[k]["X"] for k in "ABC"] == [1000.0, -0.5, 2.0]
    assert profile_feature_columns(df, ["Region"])[0] == ["Flag", "X"]


def test_rows_follow_the_order_of_the_files(spark, scratch):
    import os
    os.makedirs(scratch + "/many")
    for name, rows in (("1", ["a", "b"]), ("2", ["c", "d", "e", "f"]), ("3", ["g", "h", "i"])):
        _write(f"{scratch}/many/part-{name}.csv", "K,V\n" + "".join(f"{r},{'x' * 50 * int(name)}\n" for r in rows))
    df = scan_csv_inferred(spark, scratch + "/many", order_col="row_seq")
    assert "".join(r["K"] for r in df.orderBy("row_seq").collect()) == "abcdefghi"


def _rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _as_before(spark, path, df):
    """What one task a file reads, typed like ``df``."""
    from pyspark.sql import functions as F

    from febrile.sources.csv_scan import CSV_OPTIONS, na_normalised
    whole = na_normalised(spark.read.options(**CSV_OPTIONS).csv(path))
    return whole.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in df.dtypes])


NOTES = ["plain", "two\nlines", 'says ""so""', 'ends ""', '""', "", ",", "\n", "\n\n\na\n", 'a"",""b\n"",', "\r\nx", "é\n字",
         "nan", " ", "\n\r\n", '""\n""', "x" * 300 + "\n" + "y" * 300]


def _big_file(path, rows, end="\n"):
    with open(path, "w", newline="") as f:
        f.write(f'K,"no{end}te",V{end}')
        for k in range(rows):
            f.write(f'{k},"{NOTES[k % len(NOTES)]}",{k}.5{end}')
            if k % 40 == 0:
                f.write(end)                      # an empty line is no record


def _written_notes(rows):
    notes = [n.replace('""', '"') for n in NOTES]
    return [None if n in ("", "nan") else n for n in (notes[k % len(notes)] for k in range(rows))]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("block", [700, 100_000_000])
def test_one_file_with_line_breaks_is_cut_into_many_blocks(spark, scratch, end, block):
    from febrile.sources.csv_scan import record_lines
    p = f"{scratch}/blocks-{block}-{len(end)}.csv"
    _big_file(p, 400, end)
    with_conf = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k, None) for k in with_conf}
    try:
        for k, v in with_conf.items():
            spark.conf.set(k, v)
        df = scan_csv_inferred(spark, p, order_col="row_seq")
        got = [tuple(r) for r in df.orderBy("row_seq").drop("row_seq").collect()]
        blocks = record_lines(spark, p)[1].count()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert dict(df.drop("row_seq").dtypes) == {"K": "bigint", "no\nte": "string", "V": "double"}
    assert [r[0] for r in got] == list(range(400))
    assert all(r[1] == note for r, note in zip(got, _written_notes(400), strict=True))
    one_break = lambda rows: sorted([(k, n and n.replace("\r\n", "\n"), v) for k, n, v in rows], key=repr)
    whole = _as_before(spark, p, df.drop("row_seq")).collect()   # this reader makes one break of \r\n in such files
    assert one_break(got) == one_break(whole)
    assert blocks > 20 if block == 700 else blocks >= 1


def test_quotes_inside_plain_fields_are_read_file_by_file(spark, scratch):
    p = scratch + "/loose.csv"
    _write(p, 'K,Size,Note\n1,5" pipe,a\n2,6" pipe,"b\nc"\n3,7,d\n')
    df = scan_csv_inferred(spark, p, order_col="row_seq")
    assert [tuple(r)[1:] for r in df.orderBy("row_seq").collect()] == [(1, '5" pipe', "a"), (2, '6" pipe', "b\nc"), (3, "7", "d")]
    _write(p, 'K,Note\n1,a\n2,"never closed\n3,c\n')
    df = scan_csv_inferred(spark, p)
    assert _rows_of(df) == _rows_of(_as_before(spark, p, df))


def test_short_long_and_no_records(spark, scratch):
    from pyspark.sql import types as T
    p = scratch + "/odd-rows.csv"
    _write(p, '\n\na b,c.d,c.d\n1\n2,x,y,z\n"","",""\n3,"p ""q""",r')
    df = scan_csv_inferred(spark, p)
    assert df.count() == 4 and _rows_of(df) == _rows_of(_as_before(spark, p, df))
    _write(p, "a,b\n")
    assert scan_csv_inferred(spark, p).columns == ["a", "b"] and scan_csv_inferred(spark, p).count() == 0
    _write(p, "a,b\n1,2\n")
    typed = T.StructType([T.StructField("b", T.IntegerType()), T.StructField("a", T.StringType())])
    assert [tuple(r) for r in scan_csv_inferred(spark, p, typed).collect()] == [(2, "1")]
