"""The import files stay within the limits of an upload however many part rows there are."""

from conftest import make_contacts
from pyspark.sql import functions as F

from rolodeck.operators import importing as I
from rolodeck.sources import csvio
from rolodeck.sources import import_fixture as X

N = 320_000


def test_no_row_is_lost_to_a_file_limit(spark, tmp_path):
    p = F.col("id")
    spark.range(1, N + 1).select(
        p.alias("p_partkey"), F.concat(F.lit("red "), p.cast("string")).alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("STANDARD POLISHED COPPER").alias("p_type")
    ).write.parquet(f"{tmp_path}/part.parquet")
    contacts = make_contacts(spark, [{"id": 1, "first": "a", "last": "b"}])
    files, rows = X.import_files(spark, str(tmp_path)), X.import_rows(spark, str(tmp_path), contacts)
    assert files.count() == 18 and rows.select("file", "row_number").distinct().count() == N
    chars = F.aggregate("cells", F.lit(0), lambda n, c: n + F.length(c) + 3)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("chars"), F.min("row_number").alias("first"), F.max("row_number").alias("last")).collect()
    assert all(r["n"] <= X.FILE_ROWS < I.MAX_ROWS and r["chars"] < csvio.MAX_BYTES and r["first"] >= 1 and r["last"] <= X.FILE_ROWS for r in sizes)
    assert {r["mode"] for r in files.filter("file = 'import-10.csv' OR file = 'import-17.csv'").collect()} == {"update"}
    assert I.review(rows, files, contacts).count() == N


def test_an_oversize_file_fails(spark):
    header = spark.createDataFrame([("big.csv", 1, 0, "create", "big.csv", X.CREATE_HEADER, False)], "file string, job_id long, account_id int, mode string, filename string, header array<string>, invalid boolean")
    cells = F.array(F.lit("a"), F.lit("b"), F.concat(F.lit("x"), F.col("id").cast("string"), F.lit("@y.test")), *[F.lit("")] * 4)
    rows = spark.range(1, I.MAX_ROWS + 2).select(F.lit("big.csv").alias("file"), F.lit(1).cast("long").alias("job_id"), F.lit(0).alias("account_id"), F.lit("create").alias("mode"), F.col("id").alias("row_number"), cells.alias("cells"), F.lit(False).alias("invalid"))
    contacts = make_contacts(spark, [{"id": 1, "first": "a", "last": "b"}])
    assert I.review(rows, header, contacts).count() == 0
    assert I.review(rows.filter(F.col("row_number") <= I.MAX_ROWS), header, contacts).count() == I.MAX_ROWS
