"""Round trips through the file formats: tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebed.functions.text import ascii_lower
from orebed.plans.base import query, table
from orebed.plans.relational import chat_lines
from orebed.sources import readers, writers
from orebed.storage import new_path


@query("scan_text_parse", "SELECT split_part(strftime(ts, '%Y-%m-%d'), ' ', 1) AS day, 'User ' || user_id AS sender, count(*) AS n FROM events GROUP BY ALL")
def scan_text_parse(spark: SparkSession, sf: str) -> DataFrame:
    from orebed.functions.text import parse_chat_line

    path = new_path(spark, "lines")
    writers.write_text(chat_lines(spark, sf), "line", path)
    fields = parse_chat_line(F.col("value"))
    return readers.read_lines(spark, path).where(F.contains("value", F.lit("from"))).select(fields["date"].alias("day"), fields["sender"].alias("sender")).groupBy("day", "sender").agg(F.count("*").alias("n"))


@query("scan_csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path, c = new_path(spark, "csv"), table(spark, sf, "customer")
    writers.write_csv(c, path)
    return readers.read_csv(spark, path, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("scan_csv_headerless", "SELECT p_type AS name, count(*) AS n FROM part GROUP BY 1")
def scan_csv_headerless(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "tsv")
    writers.write_counts(table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")), path)
    return spark.read.csv(path, schema="name string, n bigint", sep="\t")


@query("scan_spaced", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def scan_spaced(spark: SparkSession, sf: str) -> DataFrame:
    path, li = new_path(spark, "spaced"), table(spark, sf, "lineitem")
    writers.write_text(li.select(F.concat_ws("  ", F.lit(""), *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))).alias("v")), "v", path)
    return readers.read_spaced(spark, path, [("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_returnflag", "string")])


@query("scan_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def scan_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    writers.write_json_records(table(spark, sf, "conversations"), path)
    return readers.read_json_lines(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("scan_json_nested", "SELECT n_name AS name, n_regionkey AS region FROM nation")
def scan_json_nested(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "nested")
    writers.write_text(writers.json_array(table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), encoded_twice=True), "value", path)
    return readers.read_json_array(spark, path, "name:string,region:int")


@query("corpus_lower_ascii", "SELECT doc_id, md5(lower(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'))) AS digest FROM documents")
def corpus_lower_ascii(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(ascii_lower(F.col("text")).cast("binary")).alias("digest"))
