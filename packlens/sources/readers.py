"""Files as tables: JSON, CSV, marked-up text, binary files, a seeded generator; CSV and JSON sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.plans.dialect import statement
from packlens.plans.lineage import folder
from packlens.plans.registry import query
from packlens.sources.facts import with_facts

statement("s5_json_documents", lambda d: f"SELECT event_id, CAST({'get_json_object' if d.spark else 'json_extract'}(props, '$.k') AS BIGINT) AS k FROM <events>")


def _path(spark: SparkSession, kind: str) -> str:
    return f"{folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query("s6_csv_round_trip", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file with a header, read with its schema."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = _path(spark, "csv")
    part.write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema=part.schema)


def paged_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with the page that a <<<PAGE n>>> line set for what follows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    page = F.regexp_extract("line", r"^<<<PAGE (\d+)>>>$", 1)
    marked = files.withColumn("mark", F.when(page != "", page.cast("int")))
    return marked.selectExpr("*", "last_value(mark, true) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS page").where("mark IS NULL").drop("mark")


@query("s7_paged_text", "SELECT n_regionkey + 1 AS page, count(*) AS lines FROM nation GROUP BY 1")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    by_page = nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), "\n").alias("body"))
    path = _path(spark, "text")
    by_page.select(F.concat(F.lit("<<<PAGE "), F.col("n_regionkey") + 1, F.lit(">>>\n"), "body").alias("value")).coalesce(1).write.text(path)
    return paged_text(spark, path).where("line <> ''").groupBy("page").agg(F.count(F.lit(1)).alias("lines"))


@query("s9_binary_files")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files once per content, by their digest."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{{region,nation,benchmark}}.parquet")
    return files.select(F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes")).dropDuplicates(["digest"])


@query("s12_synthetic_scans")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded generator: 260 scans of 16 products, 10 brands and 6 districts over 75 days."""

    def pick(salt: str, n: int):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    return spark.range(260).select(F.col("id").alias("scan_id"), pick("sku", 16).alias("sku_id"), F.concat(F.lit("Brand "), pick("sku", 16) % 10).alias("brand"), F.concat(F.lit("District "), pick("district", 6)).alias("district"), F.date_add(F.lit("2026-07-01").cast("date"), pick("day", 75)).alias("captured_on"), (pick("risk", 100) < 8 + 6 * (pick("sku", 16) % 10)).alias("non_compliant"))


@query("d6_csv_sink", "SELECT o_orderkey AS scan_id, coalesce(CAST(s AS VARCHAR), '') AS sku_id FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS s FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows, header from the columns, unknown as empty."""
    orders, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    skus = items.groupBy("l_orderkey").agg(F.min("l_partkey").alias("sku_id"))
    rows = orders.join(skus, orders["o_orderkey"] == skus["l_orderkey"], "left").select(F.col("o_orderkey").alias("scan_id"), "sku_id")
    path = _path(spark, "export")
    rows.write.csv(path, header=True, nullValue="", emptyValue="")
    return spark.read.csv(path, header=True, schema="scan_id long, sku_id string").fillna("", ["sku_id"])


statement(
    "d7_paged_json",
    lambda d: f"""WITH page AS (SELECT o_orderkey FROM <orders> ORDER BY o_orderkey LIMIT 20 OFFSET 40), n AS (SELECT count(*) AS total FROM <orders>)
    SELECT concat('{{"total":', max(total), ',"limit":20,"offset":40,"rows":[', {d.joined("""concat('{"id":', o_orderkey, '}')""", "o_orderkey", ",")}, ']}}') AS envelope FROM page CROSS JOIN n""",
)
statement("d8_summary_tables", lambda d: f"{with_facts(d)} SELECT 'district' AS section, district AS name, count(*) AS scans, count_if(non_compliant) AS non_compliant FROM facts GROUP BY district UNION ALL SELECT 'category', category, count(*), count_if(non_compliant) FROM facts GROUP BY category")
statement("d9_report_model", lambda d: f"{with_facts(d)} SELECT scan_id, status, count(*) AS findings, {d.joined('rule_id', 'line, part, supp', ',')} AS rules FROM verdicts WHERE counts GROUP BY scan_id, status")
statement("d11_latest_correction", lambda d: f"SELECT user_id, {'max_by(event_type, event_id)' if d.spark else 'arg_max(event_type, event_id)'} AS latest, count(DISTINCT event_type) AS kinds FROM <events> GROUP BY user_id")
statement("d12_expired", lambda d: f"SELECT o_orderkey FROM <orders> WHERE {d.plus_days('CAST(o_orderdate AS DATE)', '365')} < DATE '1998-01-01'")


@query("d10_access_log", "SELECT c_custkey AS user_id, 'export' AS action FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey, 'view' FROM customer WHERE c_custkey % 10 = 1")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended, never rewritten."""
    users = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    path = _path(spark, "log")
    users.where("user_id % 10 = 0").withColumn("action", F.lit("export")).write.mode("append").parquet(path)
    users.where("user_id % 10 = 1").withColumn("action", F.lit("view")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
