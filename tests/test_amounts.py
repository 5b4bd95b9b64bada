"""Amounts at the edge of u64, and instruction fields read from the JSON once."""

from decimal import Decimal

from pyspark.sql import functions as F

from assetlens.sources import transactions as X


def test_amounts_fit_u64(spark):
    texts = ["0", " 17 ", "9" * 19, "18446744073709551615", "18446744073709551616", "9" * 20, "0" * 19 + "5", "1" * 21, "-1", "1.0", "", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select(X._amount(F.col("t")).cast("string"))
    assert [r[0] for r in d.collect()] == ["0", "17", "9" * 19, "18446744073709551615", None, None, "5", None, None, None, None, None]


def test_each_field_of_an_instruction_is_read_once(spark):
    tokens = "array<struct<account:string,owner:string,asset:string,decimals:int,pre:decimal(20,0),post:decimal(20,0)>>"
    ixs = "array<struct<path:string,program_id:string,type:string,info:string>>"
    a, b = "a" * 32, "b" * 32
    info = f'{{"source":"{a}","destination":"{b}","tokenAmount":{{"amount":"12"}}}}'
    norm = spark.createDataFrame([([(a, "W" * 32, "M" * 32, 6, Decimal(1), Decimal(2))], [("0", X.TOKEN_PROGRAMS[0], "transferChecked", info)])], f"tokens {tokens}, ixs {ixs}")
    f = X.facts(norm, ["token_transfers"]).select("token_transfers")
    got = f.first()[0][0].asDict()
    assert (got["asset"], got["src_owner"], got["dst_owner"], int(got["amount"])) == ("M" * 32, "W" * 32, None, 12)
    assert f._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 5
