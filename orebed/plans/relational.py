"""Scans, filters, joins, aggregates and windows on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebed.functions import text as T
from orebed.operators import relational as R
from orebed.plans.base import BUSINESSES, COUNTRIES, HISTORY, RATINGS, businesses, countries, history, query, ratings, table

#: Names for people, made of part names, as "Last, First".
ROSTER = "roster AS (SELECT p_partkey AS id, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS listed, p_brand AS place FROM part)"


def roster(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("p_name", " ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.get(w, 1), F.lit(", "), F.get(w, 0)).alias("listed"), F.col("p_brand").alias("place"))


@query("project_filter", "SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def project_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_name")


@query("join_inner", "SELECT n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return countries(spark, sf)


@query("distinct_dims", "SELECT DISTINCT c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def distinct_dims(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where(F.col("c_mktsegment").isNotNull() & (F.col("c_mktsegment") != "")).select("c_mktsegment", "c_nationkey").distinct()
    return c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name").distinct()


@query("having_topk", "SELECT c_nationkey, round(avg(c_acctbal), 4) AS mean_balance, count(*) AS cnt FROM customer GROUP BY c_nationkey HAVING count(*) >= 20 ORDER BY cnt DESC, c_nationkey LIMIT 1")
def having_topk(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("mean_balance"), F.count("*").alias("cnt"))
    return g.where("cnt >= 20").orderBy(F.desc("cnt"), "c_nationkey").limit(1)


@query("review_summary", f"""WITH {RATINGS},
u AS (SELECT user_id AS k, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, k LIMIT 10),
b AS (SELECT business_id AS k, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, k LIMIT 10)
SELECT count(*) AS n_review, count(*) FILTER (WHERE dt >= '1998-01-01' AND dt < '1999-01-01') AS n_review_1998,
  count(DISTINCT user_id) AS n_user, count(DISTINCT business_id) AS n_business,
  (SELECT string_agg('[' || k || ', ' || n || ']', ', ' ORDER BY n DESC, k) FROM u) AS top10_user,
  (SELECT string_agg('[' || k || ', ' || n || ']', ', ' ORDER BY n DESC, k) FROM b) AS top10_business
FROM ratings""")
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by user, by business and by year come from one pre-aggregate; the lists of ten are bounded."""
    pre = ratings(spark, sf).groupBy("user_id", "business_id").agg(F.count("*").alias("n"), F.count_if((F.col("dt") >= "1998-01-01") & (F.col("dt") < "1999-01-01")).alias("n98"))
    whole = pre.agg(F.sum("n").alias("n_review"), F.sum("n98").alias("n_review_1998"))

    def by(key: str, name: str) -> DataFrame:
        g = pre.groupBy(F.col(key).alias("k")).agg(F.sum("n").alias("n"))
        best = g.orderBy(F.desc("n"), "k").limit(10).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k"))).alias("t"))
        text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("["), x.k.cast("string"), F.lit(", "), (-x.m).cast("string"), F.lit("]"))), ", ")
        return g.agg(F.count("*").alias(f"n_{name}")).join(best.select(text.alias(f"top10_{name}")))

    return whole.join(by("user_id", "user")).join(by("business_id", "business"))


def _top10(key: str) -> str:
    return f"WITH {RATINGS} SELECT {key}, count(*) AS n FROM ratings GROUP BY 1 ORDER BY n DESC, {key} LIMIT 10"


@query("top10_users", _top10("user_id"))
def top10_users(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(ratings(spark, sf), "user_id")


@query("top10_business", _top10("business_id"))
def top10_business(spark: SparkSession, sf: str) -> DataFrame:
    return R.top(ratings(spark, sf), "business_id")


@query("avg_stars_by_city", f"WITH {RATINGS}, {BUSINESSES} SELECT city, round(avg(stars), 6) AS mean_stars FROM ratings JOIN businesses USING (business_id) GROUP BY city ORDER BY mean_stars DESC, city")
def avg_stars_by_city(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by business before any join: neither orders nor users are needed, and the join sees one row a business."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    pre = li.groupBy(F.col("l_suppkey").alias("business_id")).agg(F.sum(F.lit(1) + F.col("l_quantity").cast("int") % 5).alias("s"), F.count("*").alias("n"))
    return pre.join(businesses(spark, sf), "business_id").groupBy("city").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_stars")).orderBy(F.desc("mean_stars"), "city")


@query("group_count", "SELECT role, count(text) AS n FROM conversations GROUP BY role")
def group_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role").agg(F.count("text").alias("n"))


@query("group_count_sorted", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY 1")
def group_count_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy("p_type")


@query("count_forward_fill", """WITH x AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role END AS speaker FROM conversations),
f AS (SELECT last_value(speaker IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS speaker FROM x)
SELECT speaker, count(*) AS n FROM f WHERE speaker IS NOT NULL GROUP BY 1""")
def count_forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("speaker"))
    return R.forward_fill(lines, "speaker", ["conv_id"], ["turn"]).where("speaker IS NOT NULL").groupBy("speaker").agg(F.count("*").alias("n"))


@query("anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("not_in_null_aware", """SELECT s_suppkey, s_name, CAST(0 AS INTEGER) AS with_null FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier WHERE s_nationkey NOT IN (SELECT CASE WHEN c_nationkey <> 3 THEN c_nationkey END FROM customer WHERE c_acctbal > 9000)""")
def not_in_null_aware(spark: SparkSession, sf: str) -> DataFrame:
    """The second half has a null among the keys and so gives nothing."""
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    plain = R.not_in(s, "s_nationkey", c.where("c_acctbal > 9900").select("c_nationkey"), "c_nationkey")
    nulls = R.not_in(s, "s_nationkey", c.where("c_acctbal > 9000").select(F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("k")), "k")
    return plain.select("s_suppkey", "s_name", F.lit(0).alias("with_null")).unionByName(nulls.select("s_suppkey", "s_name", F.lit(1).alias("with_null")))


@query("semi_join", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    rich = table(spark, sf, "customer").where("c_acctbal > 9900").select("c_nationkey")
    return table(spark, sf, "supplier").join(rich, F.col("s_nationkey") == F.col("c_nationkey"), "left_semi").select("s_suppkey", "s_name")


@query("fk_violations", """SELECT 'orders.o_custkey' AS fk, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)""")
def fk_violations(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    keys = [("orders", "o_custkey", t("customer"), "c_custkey"), ("lineitem", "l_orderkey", t("orders"), "o_orderkey"), ("labels", "doc_id", t("documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("d")), "d")]
    out = [R.missing_keys(t(f), k, d.select(dk), dk).agg(F.lit(f"{f}.{k}").alias("fk"), F.count("*").alias("n")) for f, k, d, dk in keys]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("name_flip", f"WITH {ROSTER} SELECT id, trim(split_part(listed, ',', 2)) || ' ' || trim(split_part(listed, ',', 1)) AS name FROM roster")
def name_flip(spark: SparkSession, sf: str) -> DataFrame:
    return roster(spark, sf).select("id", T.flip_name(F.col("listed")).alias("name"))


@query("search_person_token", f"WITH {ROSTER} SELECT id, listed FROM roster WHERE list_has_any(string_split(lower(replace(listed, ',', '')), ' '), ['ring', 'red'])")
def search_person_token(spark: SparkSession, sf: str) -> DataFrame:
    return roster(spark, sf).where(R.any_token(F.replace("listed", F.lit(","), F.lit("")), ["Ring", "RED"])).select("id", "listed")


@query("search_person_like", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '% ring' OR lower(p_name) LIKE 'ring %' OR lower(p_name) LIKE '% red' OR lower(p_name) LIKE 'red %'")
def search_person_like(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(R.first_or_last_token(F.col("p_name"), ["Ring", "Red"])).select("p_partkey", "p_name")


@query("search_message", "SELECT conv_id, turn, text FROM conversations WHERE lower(role) = 'user' AND conv_id = 7")
def search_message(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").where((F.lower("role") == "user") & (F.col("conv_id") == 7)).select("conv_id", "turn", "text")


@query("search_message_status", """WITH asked AS (SELECT unnest(['Customer#000000001', 'customer#000000003', 'Nobody']) AS who),
n AS (SELECT c_custkey, c_name, count(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT who, coalesce(n.n, 0) AS n, CASE WHEN c_custkey IS NULL THEN 'not found' WHEN n.n = 0 THEN 'quiet' ELSE 'found' END AS status
FROM asked LEFT JOIN n ON lower(c_name) = lower(who)""")
def search_message_status(spark: SparkSession, sf: str) -> DataFrame:
    """Who is asked for decides what is read: customers are filtered before their orders are joined."""
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, ["Customer#000000001", "customer#000000003", "Nobody"]))).alias("who"))
    people = table(spark, sf, "customer").select("c_custkey", F.lower("c_name").alias("lname"))
    known = asked.join(people, F.lower("who") == F.col("lname"), "left")
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    got = known.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("who", "c_custkey").agg(F.count("o_orderkey").alias("n"))
    return got.select("who", "n", F.when(F.col("c_custkey").isNull(), "not found").when(F.col("n") == 0, "quiet").otherwise("found").alias("status"))


_LOG = "e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') || ' at the hour ' || strftime(ts, '%H:%M') || ' PM from User ' || user_id || ' to ' || event_type || ': value ' || event_id || CASE WHEN event_id % 3 = 0 THEN ': more' ELSE '' END AS line FROM events)"


def chat_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines made of events; every third message holds a further colon."""
    e = table(spark, sf, "events")
    tail = F.when(F.col("event_id") % 3 == 0, F.lit(": more")).otherwise("")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" at the hour "), F.date_format("ts", "HH:mm"), F.lit(" PM from User "), F.col("user_id").cast("string"), F.lit(" to "), "event_type", F.lit(": value "), F.col("event_id").cast("string"), tail)
    return e.select("event_id", line.alias("line"))


@query("log_parse", f"""WITH {_LOG} SELECT event_id, split_part(line, ' ', 1) AS date, split_part(line, ' ', 5) || split_part(line, ' ', 6) AS time,
  trim(regexp_extract(line, 'from (.*?) to', 1)) AS sender, trim(regexp_extract(line, ' to(.*?):', 1)) AS receiver, trim(split_part(line, ':', 3)) AS message FROM e""")
def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    fields = T.parse_chat_line(F.col("line"))
    return chat_lines(spark, sf).select("event_id", *(c.alias(n) for n, c in fields.items()))


@query("active_cases", f"WITH {HISTORY} SELECT country, day, confirmed - recovered - deaths AS current FROM history")
def active_cases(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).select("country", "day", (F.col("confirmed") - F.col("recovered") - F.col("deaths")).alias("current"))


_SUMS = "CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(recovered) AS BIGINT) AS recovered, CAST(sum(deaths) AS BIGINT) AS deaths"


def _sums() -> list:
    return [F.sum(c).alias(c) for c in ("confirmed", "recovered", "deaths")]


@query("sum_by_dim", f"WITH {HISTORY}, {COUNTRIES} SELECT continent, {_SUMS} FROM history JOIN countries USING (country) GROUP BY continent")
def sum_by_dim(spark: SparkSession, sf: str) -> DataFrame:
    by_country = history(spark, sf).groupBy("country").agg(*_sums())
    return by_country.join(countries(spark, sf), "country").groupBy("continent").agg(*_sums())


@query("info_card", f"""WITH {HISTORY}, {COUNTRIES}, g AS (SELECT continent, {_SUMS} FROM history JOIN countries USING (country) GROUP BY continent)
SELECT 'continent: ' || continent || chr(10) || 'confirmed: ' || confirmed || chr(10) || 'recovered: ' || recovered || chr(10) || 'deaths: ' || deaths || chr(10) || 'current: ' || (confirmed - recovered - deaths) AS card FROM g""")
def info_card(spark: SparkSession, sf: str) -> DataFrame:
    d = sum_by_dim(spark, sf).withColumn("current", F.col("confirmed") - F.col("recovered") - F.col("deaths"))
    return d.select(F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in ("continent", "confirmed", "recovered", "deaths", "current"))).alias("card"))


@query("history_by_country", f"WITH {HISTORY} SELECT day, confirmed, recovered, deaths FROM history WHERE country = 'NATION_3' AND day BETWEEN '1997-01-01' AND '1998-12-31' ORDER BY day")
def history_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).where((F.col("country") == "NATION_3") & F.col("day").between("1997-01-01", "1998-12-31")).select("day", "confirmed", "recovered", "deaths").orderBy("day")


@query("history_by_location", f"WITH {HISTORY}, {COUNTRIES} SELECT day, {_SUMS} FROM history JOIN countries USING (country) WHERE country IN ('NATION_1', 'NATION_2') AND day BETWEEN '1997-01-01' AND '1998-12-31' GROUP BY day")
def history_by_location(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).where(F.col("country").isin("NATION_1", "NATION_2") & F.col("day").between("1997-01-01", "1998-12-31")).groupBy("day").agg(*_sums())


@query("history_by_continent", f"WITH {HISTORY}, {COUNTRIES} SELECT day, {_SUMS} FROM history JOIN countries USING (country) WHERE continent = 'ASIA' GROUP BY day")
def history_by_continent(spark: SparkSession, sf: str) -> DataFrame:
    there = countries(spark, sf).where("continent = 'ASIA'").select("country")
    return history(spark, sf).join(there, "country", "left_semi").groupBy("day").agg(*_sums())


@query("series_assemble", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) FILTER (WHERE o_orderstatus = 'O') AS confirmed, count(*) FILTER (WHERE o_orderstatus = 'F') AS recovered, count(*) FILTER (WHERE o_orderstatus = 'P') AS deaths FROM orders GROUP BY 1")
def series_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Three series of one key in one pass: a pivot instead of two joins."""
    return table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(m) for s, m in (("O", "confirmed"), ("F", "recovered"), ("P", "deaths"))))


@query("recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS label FROM orders")
def recode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).alias("label"))


@query("factorize", "WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1) SELECT p_brand, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code FROM f")
def factorize(spark: SparkSession, sf: str) -> DataFrame:
    """Codes by first appearance: only one row a label reaches the window."""
    f = table(spark, sf, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("first"))
    return f.select("p_brand", (F.row_number().over(Window.orderBy("first")) - 1).alias("code"))


@query("unpivot_metrics", """WITH m AS (SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean, round(max(c_acctbal), 4) AS most, round(min(c_acctbal), 4) AS least FROM customer GROUP BY 1)
SELECT c_mktsegment, metric, value FROM m UNPIVOT (value FOR metric IN (mean, most, least))""")
def unpivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_acctbal")
    m = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(c), 4).alias("mean"), F.round(F.max(c), 4).alias("most"), F.round(F.min(c), 4).alias("least"))
    return m.unpivot("c_mktsegment", ["mean", "most", "least"], "metric", "value")


@query("dense_index", "WITH d AS (SELECT DISTINCT c_name FROM customer) SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS index FROM d")
def dense_index(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_index(table(spark, sf, "customer"), "c_name")


@query("union_all", "SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))


@query("set_ops", """WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.09)
SELECT 'union' AS op, k FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    a, b = li.where("l_quantity > 49").select(F.col("l_suppkey").alias("k")), li.where("l_discount > 0.09").select(F.col("l_suppkey").alias("k"))
    named = lambda op, d: d.select(F.lit(op).alias("op"), "k")
    return named("union", a.union(b).distinct()).unionByName(named("intersect", a.intersect(b))).unionByName(named("except", a.subtract(b)))


@query("stratified_head_split", "WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) SELECT vec_id, label, CASE WHEN k <= 30 THEN 'train' ELSE 'test' END AS part FROM r")
def stratified_head_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.when(R.head_by_group("label", ["vec_id"], 30), "train").otherwise("test").alias("part"))


@query("sliding_windows", "SELECT item_id, CAST(i AS INTEGER) AS at, substr(lower(text), CAST(i AS INTEGER) + 1, 20) AS given, substr(lower(text), CAST(i AS INTEGER) + 21, 1) AS following FROM benchmark, range(length(text) - 20) AS r(i)")
def sliding_windows(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(R.sliding_windows(F.lower("text"), 21)).alias("at", "w"))
    return b.select("item_id", "at", F.substring("w", 1, 20).alias("given"), F.substring("w", 21, 1).alias("following"))


@query("char_vocab", """WITH c AS (SELECT DISTINCT unnest(string_split(lower(text), '')) AS ch FROM benchmark), v AS (SELECT ch, CAST(row_number() OVER (ORDER BY ascii(ch)) - 1 AS INTEGER) AS code, count(*) OVER () AS n FROM c)
SELECT ch, code, round(code / n, 8) AS scaled FROM v""")
def char_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary is bounded by the characters there are; it is counted before it is ordered."""
    c = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "")).alias("ch")).distinct()
    w = Window.orderBy(F.ascii("ch"))
    v = c.select("ch", (F.row_number().over(w) - 1).alias("code"), F.count("*").over(Window.partitionBy()).alias("n"))
    return v.select("ch", "code", F.round(F.col("code") / F.col("n"), 8).alias("scaled"))


@query("rating_averages", f"""WITH {RATINGS} SELECT CASE WHEN grouping(user_id) = 0 THEN 'user' WHEN grouping(business_id) = 0 THEN 'business' ELSE 'all' END AS kind,
  coalesce(user_id, business_id, -1) AS id, round(avg(stars), 6) AS mean FROM ratings GROUP BY GROUPING SETS ((user_id), (business_id), ())""")
def rating_averages(spark: SparkSession, sf: str) -> DataFrame:
    """All three levels from one pass over the ratings, pre-aggregated by pair so that the sets expand few rows."""
    pre = ratings(spark, sf).groupBy("user_id", "business_id").agg(F.sum("stars").alias("s"), F.count("*").alias("n"))
    g = pre.groupingSets([[F.col("user_id")], [F.col("business_id")], []], F.col("user_id"), F.col("business_id"))
    g = g.agg(F.grouping_id().alias("g"), (F.sum("s") / F.sum("n")).alias("m"))
    kind = F.when(F.col("g") == 1, "user").when(F.col("g") == 2, "business").otherwise("all")
    return g.select(kind.alias("kind"), F.coalesce("user_id", "business_id", F.lit(-1).cast("long")).alias("id"), F.round("m", 6).alias("mean"))


@query("summary_stats", """SELECT round(avg(l_extendedprice), 4) AS mean, round(max(l_extendedprice) - min(l_extendedprice), 4) AS range, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
  round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25), 4) AS iqr FROM lineitem""")
def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles by position over range partitions: no task holds all prices."""
    x = F.col("l_extendedprice")
    d = table(spark, sf, "lineitem").select(x)
    q = R.quantiles(d, "l_extendedprice", [0.25, 0.5, 0.75]).agg(*(F.max(F.when(F.col("share") == p, F.col("value"))).alias(n) for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))))
    s = d.agg(F.avg(x).alias("mean"), (F.max(x) - F.min(x)).alias("range")).crossJoin(F.broadcast(q))  # one row each
    return s.select(*(F.round(c, 4).alias(c) for c in ("mean", "range", "q1", "median", "q3")), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"))


@query("feature_join_default", f"""WITH {RATINGS},
u AS (SELECT user_id, count(*) AS review_count, round(avg(stars), 6) AS average_stars FROM ratings WHERE dt < '1995-03-01' GROUP BY 1),
b AS (SELECT business_id, count(*) AS business_reviews, round(avg(stars), 6) AS business_stars FROM ratings WHERE dt < '1995-01-03' GROUP BY 1),
d AS (SELECT round(avg(stars), 6) AS mean FROM ratings)
SELECT DISTINCT r.user_id, r.business_id, coalesce(review_count, 0) AS review_count, coalesce(average_stars, mean) AS average_stars,
  coalesce(business_reviews, 0) AS business_reviews, coalesce(business_stars, mean) AS business_stars
FROM ratings r LEFT JOIN u USING (user_id) LEFT JOIN b USING (business_id), d WHERE r.dt >= '2001-07-01'""")
def feature_join_default(spark: SparkSession, sf: str) -> DataFrame:
    """Users and businesses without early reviews get the overall mean and zero counts."""
    r = ratings(spark, sf)
    u = r.where("dt < '1995-03-01'").groupBy("user_id").agg(F.count("*").alias("review_count"), F.round(F.avg("stars"), 6).alias("average_stars"))
    b = r.where("dt < '1995-01-03'").groupBy("business_id").agg(F.count("*").alias("business_reviews"), F.round(F.avg("stars"), 6).alias("business_stars"))
    mean = r.agg(F.round(F.avg("stars"), 6)).scalar()
    asked = r.where("dt >= '2001-07-01'").select("user_id", "business_id").distinct()
    d = asked.join(u, "user_id", "left").join(b, "business_id", "left").withColumn("mean", mean)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return d.select("user_id", "business_id", zero("review_count"), F.coalesce("average_stars", "mean").alias("average_stars"), zero("business_reviews"), F.coalesce("business_stars", "mean").alias("business_stars"))
