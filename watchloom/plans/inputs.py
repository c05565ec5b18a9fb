"""Maps the given tables onto the shapes the operators read, row for row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDED_SOURCES = ("lb", "cdn", "app", "gke", "nginx", "cloudsql", "node_metrics")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prop_k() -> Column:
    return F.get_json_object("props", "$.k")


def source_of() -> Column:
    out = F.when(F.col("event_id") % 7 == 0, SEEDED_SOURCES[0])
    for i, name in enumerate(SEEDED_SOURCES[1:-1], start=1):
        out = out.when(F.col("event_id") % 7 == i, name)
    return out.otherwise(SEEDED_SOURCES[-1])


def status_of() -> Column:
    user = F.col("user_id") % 4
    failed = F.when(user == 0, 401).when(user == 1, 404).when(user == 2, 500).otherwise(503)
    return F.when(F.col("event_type") != "error", 200).otherwise(failed)


def ip_of() -> Column:
    return F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), F.col("user_id") % 17)


def host_of(prefix: str = "host-") -> Column:
    return F.concat(F.lit(prefix), F.col("user_id") % 5)


def as_events(raw: DataFrame) -> DataFrame:
    """The events table (batch or stream) in the common event shape."""
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        source_of().alias("source"),
        host_of().alias("host"),
        F.concat(F.lit("event-"), F.col("event_id")).alias("message"),
        status_of().alias("status"),
        (F.col("value") * 10).alias("latency_ms"),
        (prop_k().cast("bigint") * 100).alias("bytes"),
        ip_of().alias("src_ip"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/"), prop_k()).alias("path"),
        F.concat(F.lit("agent/"), F.col("user_id") % 3).alias("user_agent"),
        "user_id",
        "event_type",
        "value",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


def _seconds_text() -> Column:
    return F.concat(F.col("user_id") % 9, F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))


def access_line() -> Column:
    """A web access line; 10 % log '-' for the size."""
    size = F.when(F.col("event_id") % 10 == 0, F.lit("-")).otherwise((prop_k().cast("bigint") * 100).cast("string"))
    return F.concat(
        ip_of(),
        F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0000] "GET /'),
        F.col("event_type"),
        F.lit("/"),
        prop_k(),
        F.lit(' HTTP/1.1" '),
        status_of(),
        F.lit(" "),
        size,
        F.lit(' "-" "agent/'),
        F.col("user_id") % 3,
        F.lit('" rt='),
        _seconds_text(),
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("garbage "), F.col("event_type"))).otherwise(access_line()).alias("line"),
    )


def _iso() -> Column:
    return F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def lb_record() -> Column:
    """Load-balancer JSON; some rows lack the latency or the size."""
    latency = F.when(F.col("event_id") % 20 == 0, F.lit("")).otherwise(F.concat(F.lit(',"latency":"'), _seconds_text(), F.lit('s"')))
    size = F.when(F.col("event_id") % 15 == 0, F.lit("")).otherwise(F.concat(F.lit(',"responseSize":'), prop_k()))
    return F.concat(
        F.lit('{"timestamp":"'), _iso(),
        F.lit('","httpRequest":{"requestUrl":"/'), F.col("event_type"),
        F.lit('","status":'), status_of(), latency,
        F.lit(',"remoteIp":"'), ip_of(), F.lit('"'), size,
        F.lit('},"resource":{"labels":{"backend_service_name":"bs-'), F.col("user_id") % 5, F.lit('"}}}'),
    )


def lb_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", lb_record().alias("rec"))


def waf_record() -> Column:
    """Firewall JSON; some rows lack the policy or the status."""
    policy = F.when(F.col("event_id") % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"enforcedSecurityPolicy":{"name":"policy-'), F.col("user_id") % 3,
                 F.lit('","outcome":"'), F.when(F.col("event_type") == "error", "DENY").otherwise("ACCEPT"), F.lit('"},'))
    )
    status = F.when(F.col("event_id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit('"status":'), status_of(), F.lit(",")))
    return F.concat(
        F.lit('{"timestamp":"'), _iso(), F.lit('","jsonPayload":{'), policy,
        F.lit('"statusDetails":"'), F.col("event_type"), F.lit('"},"httpRequest":{'), status,
        F.lit('"remoteIp":"'), ip_of(), F.lit('","requestUrl":"/'), F.col("event_type"),
        F.lit('","userAgent":"agent/'), F.col("user_id") % 3, F.lit('"}}'),
    )


def waf_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", waf_record().alias("rec"))


def app_record() -> Column:
    """Application JSON that uses either spelling of each field."""
    odd = F.col("event_id") % 2 == 1
    severity = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"severity":"'), F.when(F.col("event_type") == "error", "warn").otherwise("info"), F.lit('",')))
        .when(F.col("event_id") % 3 == 1, F.lit('"severity":"","level":"debug",'))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.when(odd, F.lit('{"ts":"')).otherwise(F.lit('{"ts":"","timestamp":"')), _iso(), F.lit('",'),
        F.when(odd, F.concat(F.lit('"host":"h-'), F.col("user_id") % 5, F.lit('",'))).when(F.col("event_id") % 4 == 0, F.concat(F.lit('"pod":"pod-'), F.col("user_id") % 5, F.lit('",'))).otherwise(F.lit("")),
        F.when(odd, F.lit('"message":"did ')).otherwise(F.lit('"msg":"did ')), F.col("event_type"), F.lit('",'),
        severity,
        F.lit('"latency_ms":'), F.col("event_id") % 500, F.lit(',"status":'), status_of(),
        F.lit(',"user":"user-'), F.col("user_id"), F.lit('","path":"/'), F.col("event_type"),
        F.lit('","attrs":{"k":'), prop_k(), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}}'),
    )


def app_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", app_record().alias("rec"))


def slow_record() -> Column:
    """Slow-query JSON: the text is in textPayload, in message, or missing."""
    text = F.concat(F.lit("SELECT "), F.col("event_type"), F.lit(" LIMIT "), prop_k())
    payload = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"textPayload":"'), text, F.lit('",')))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit('"textPayload":"","message":"'), text, F.lit('",')))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.lit('{"timestamp":"'), _iso(), F.lit('",'), payload, F.lit('"resource":{"labels":{'),
        F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"database_id":"db-'), F.col("user_id") % 4, F.lit('"'))),
        F.lit("}}}"),
    )


def slow_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", slow_record().alias("rec"))


def broken(record: Column, stamp: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """The record, but of forty one without text, one cut short and one with an unreadable time."""
    turn = F.floor(F.col("event_id") / 8) % 40
    return (
        F.when(turn == 1, F.lit(None).cast("string"))
        .when(turn == 2, F.substr(record, F.lit(1), F.lit(12)))
        .when(turn == 3, F.replace(record, F.date_format("ts", stamp), F.lit("yesterday")))
        .otherwise(record)
    )


MIXED = ("nginx", "lb", "cloud_armor", "app", "cloudsql", "kafka", "pager", "lb")


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table of records of several sources, some broken, some of a source without a parser, some of an unknown one."""
    turn = F.col("event_id") % 8
    source = F.element_at(F.array(*[F.lit(x) for x in MIXED]), (turn + 1).cast("int"))
    made = {"nginx": access_line(), "lb": lb_record(), "cloud_armor": waf_record(), "app": app_record(), "cloudsql": slow_record()}
    rec = F.lit("anything")
    for name, column in made.items():
        rec = F.when(F.col("source") == name, broken(column, "dd/MMM/yyyy:HH:mm:ss" if name == "nginx" else "yyyy-MM-dd'T'HH:mm:ss")).otherwise(rec)
    wrong = F.when((turn == 7) & (F.col("event_id") % 3 == 0), F.replace(F.col("rec"), F.lit('"status":'), F.lit('"status":"up","was":'))).otherwise(F.col("rec"))
    rows = table(spark, sf_dir, "events").withColumn("source", source).withColumn("rec", rec)
    return rows.select("event_id", "source", wrong.alias("rec"))


def app_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text messages in the application's five log formats, by event type."""
    user = F.concat(F.lit("'user-"), F.col("user_id"), F.lit("'"))
    login = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("login failed: user_not_found username="), user, F.lit(" src_ip="), ip_of())).when(
        F.col("user_id") % 3 == 1,
        F.concat(F.lit("login failed: wrong_password username="), user, F.lit(" src_ip="), ip_of(), F.lit(" failed_logins="), F.col("event_id") % 7),
    ).otherwise(F.concat(F.lit("login success username="), user, F.lit(" src_ip="), ip_of()))
    access = F.concat(F.lit("GET /"), F.col("event_type"), F.lit("/"), prop_k(), F.lit(" -> "), status_of(), F.lit(" ("), F.col("event_id") % 900, F.lit("."), F.col("event_id") % 10, F.lit("ms)"))
    job = F.concat(
        F.when(F.col("user_id") % 2 == 0, "job ok").otherwise("job failed"),
        F.lit(" job_id=j-"), F.col("event_id"), F.lit(" job_type=mail-"), F.col("user_id") % 3,
        F.lit(" elapsed="), F.col("user_id") % 9, F.lit("."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("s"),
    )
    order = F.concat(
        F.lit("order placed order_id="), F.col("event_id"), F.lit(" user_id="), F.col("user_id"),
        F.lit(" total="), F.col("event_id") % 400, F.lit("."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"),
        F.lit(" payment="), F.when(F.col("event_id") % 2 == 0, "card").otherwise("cash"),
    )
    message = F.when(F.col("event_type") == "error", login).when(F.col("event_type") == "signup", job).when(F.col("event_type") == "purchase", order).otherwise(access)
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", message.alias("message"))
