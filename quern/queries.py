"""One query per operator over the benchmark tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text, timing
from .operators import ledger, loader, monitor, prefix, splitter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CHUNKS = 10
RUN = 101


def query(sql: str | None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- ranges and loads

RANGES = splitter.integer_ranges([1000, 2000, 3000])
_CASE = "CASE WHEN o_orderkey < 1000 THEN 'r0' WHEN o_orderkey BETWEEN 1000 AND 2000 THEN 'r1' WHEN o_orderkey BETWEEN 2001 AND 3000 THEN 'r2' WHEN o_orderkey > 3000 THEN 'r3' END"


@query(f'SELECT {_CASE} AS "range", count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS sum_key, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders WHERE {_CASE} IS NOT NULL GROUP BY 1')
def split_key_range(spark, sf_dir):
    rows = splitter.labelled(table(spark, sf_dir, "orders"), "o_orderkey", RANGES)
    return rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("sum_key"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


_YEARS = [datetime(y, 1, 1) for y in range(1993, 1999)]


@query("SELECT CASE WHEN o_orderdate IS NULL THEN 'none' " + " ".join(f"WHEN o_orderdate < TIMESTAMP '{y}-01-01' THEN 'r{i}'" for i, y in enumerate(range(1993, 1999))) + " ELSE 'r6' END AS \"range\", count(*) AS n FROM orders GROUP BY 1")
def split_date_range(spark, sf_dir):
    """Half-open years and a bucket for nulls: every row is in one range."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("d"))
    ranges = splitter.half_open_ranges([F.lit(y).cast("timestamp_ntz") for y in _YEARS])
    return splitter.labelled(rows, "d", ranges, missing="none").groupBy("range").agg(F.count(F.lit(1)).alias("n"))


@query(" UNION ALL ".join(f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey {p}" for p in ("< 1000", "BETWEEN 1000 AND 2000", "BETWEEN 2001 AND 3000", "> 3000")))
def load_union_all(spark, sf_dir):
    return loader.union_all(splitter.ranged_scans(table(spark, sf_dir, "orders"), "o_orderkey", RANGES)).select("o_orderkey", "o_custkey", "o_totalprice")


# ---- chunks

_EXT = """WITH g AS (SELECT l_suppkey AS relative_fno, l_partkey, count(*) AS blocks FROM lineitem GROUP BY 1, 2),
ext AS (SELECT relative_fno, CAST(sum(blocks) OVER (PARTITION BY relative_fno ORDER BY l_partkey) - blocks AS BIGINT) AS block_id, CAST(blocks AS BIGINT) AS blocks FROM g),
cums AS (SELECT *, CAST(sum(blocks) OVER (ORDER BY relative_fno, block_id) AS BIGINT) AS cum, CAST(sum(blocks) OVER () AS BIGINT) AS total FROM ext),
chunked AS (SELECT *, ((100 * cum - 1) * 10) // (100 * total) AS grp FROM cums),
chunks AS (SELECT grp, min(relative_fno) AS first_fno, arg_min(block_id, (relative_fno, block_id)) AS first_block, max(relative_fno) AS last_fno,
  arg_max(block_id + blocks - 1, (relative_fno, block_id)) AS last_block, CAST(sum(blocks) AS BIGINT) AS sum_blocks FROM chunked GROUP BY grp)
"""


def extents(spark, sf_dir) -> DataFrame:
    """Contiguous extents made of lineitem: a file for each supplier, an extent for each part in it."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").repartition("l_suppkey")  # groups and windows share this shuffle; few lines share a group
    g = lines.groupBy(F.col("l_suppkey").alias("relative_fno"), "l_partkey").agg(F.count(F.lit(1)).alias("blocks"))
    ends = F.sum("blocks").over(W.partitionBy("relative_fno").orderBy("l_partkey"))
    return g.select("relative_fno", (ends - F.col("blocks")).alias("block_id"), "blocks")


def chunked(spark, sf_dir) -> DataFrame:
    return splitter.chunk_by_weight(extents(spark, sf_dir), CHUNKS)


@query(_EXT + "SELECT relative_fno, block_id, blocks, cum, total, grp FROM chunked")
def chunk_by_weight(spark, sf_dir):
    return chunked(spark, sf_dir).select("relative_fno", "block_id", "blocks", "cum", "total", "grp")


@query(_EXT + "SELECT * FROM chunks")
def distinct_chunks(spark, sf_dir):
    return splitter.chunk_table(chunked(spark, sf_dir))


@query(_EXT + "SELECT grp, '(obj, fno, blk, row) BETWEEN (' || n_nationkey || ', ' || first_fno || ', ' || first_block || ', 0) AND (' || n_nationkey || ', ' || last_fno || ', ' || last_block || ', 10000)' AS predicate FROM chunks, nation WHERE n_nationkey = 7")
def render_chunk_predicate(spark, sf_dir):
    one = table(spark, sf_dir, "nation").where("n_nationkey = 7").select(F.col("n_nationkey").alias("data_object_id"))
    return splitter.chunk_table(chunked(spark, sf_dir)).crossJoin(F.broadcast(one)).select("grp", splitter.chunk_predicate(F.col("data_object_id")).alias("predicate"))


@query(_EXT + "SELECT c.grp, count(*) AS n, CAST(sum(e.blocks) AS BIGINT) AS weight FROM ext e JOIN chunks c ON row(e.relative_fno, e.block_id) >= row(c.first_fno, c.first_block) AND row(e.relative_fno, e.block_id) <= row(c.last_fno, c.last_block) GROUP BY 1")
def scan_by_chunk(spark, sf_dir):
    rows = splitter.in_chunks(extents(spark, sf_dir), splitter.chunk_table(chunked(spark, sf_dir)))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("blocks").alias("weight"))


@query(_EXT + "SELECT relative_fno, block_id, cum FROM cums")
def win_running_sum(spark, sf_dir):
    return prefix.running_sum(extents(spark, sf_dir), ["relative_fno", "block_id"], "blocks").select("relative_fno", "block_id", "cum")


@query(_EXT + "SELECT relative_fno, block_id, total FROM cums")
def win_total_sum(spark, sf_dir):
    rows = extents(spark, sf_dir)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("blocks").alias("total")))).select("relative_fno", "block_id", "total")


_WHOLE_SQL = "OVER (PARTITION BY grp ORDER BY relative_fno, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


@query(_EXT + f"SELECT relative_fno, block_id, grp, first_value(relative_fno) {_WHOLE_SQL} AS first_fno, first_value(block_id) {_WHOLE_SQL} AS first_block FROM chunked")
def win_first_value(spark, sf_dir):
    return splitter.with_ends(chunked(spark, sf_dir)).select("relative_fno", "block_id", "grp", "first_fno", "first_block")


@query(_EXT + f"SELECT relative_fno, block_id, grp, last_value(relative_fno) {_WHOLE_SQL} AS last_fno, last_value(block_id + blocks - 1) {_WHOLE_SQL} AS last_block FROM chunked")
def win_last_value(spark, sf_dir):
    return splitter.with_ends(chunked(spark, sf_dir)).select("relative_fno", "block_id", "grp", "last_fno", "last_block")


@query(_EXT + "SELECT relative_fno, block_id, grp, CAST(sum(blocks) OVER (PARTITION BY grp) AS BIGINT) AS sum_blocks FROM chunked")
def win_partition_sum(spark, sf_dir):
    rows = chunked(spark, sf_dir)
    return rows.join(F.broadcast(rows.groupBy("grp").agg(F.sum("blocks").alias("sum_blocks"))), "grp").select("relative_fno", "block_id", "grp", "sum_blocks")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS roworder FROM orders")
def row_ordinal(spark, sf_dir):
    return prefix.ordinal(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "roworder")


@query("SELECT o_orderkey, (SELECT coalesce(max(o_orderkey) + 1, 1) FROM orders) - 1 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def assign_ids(spark, sf_dir):
    return ledger.assign_ids(table(spark, sf_dir, "orders").select("o_orderkey"), items(spark, sf_dir), "o_orderkey")


@query(_EXT + "SELECT grp, first_fno, last_fno, n_nationkey AS data_object_id, n_name AS object_name FROM chunks, (SELECT * FROM nation WHERE upper(n_name) = upper('nation_7') OR n_nationkey = 7) o")
def cross_join_lookup(spark, sf_dir):
    one = table(spark, sf_dir, "nation").where((F.upper("n_name") == F.upper(F.lit("nation_7"))) | (F.col("n_nationkey") == 7))
    chunks = splitter.chunk_table(chunked(spark, sf_dir)).select("grp", "first_fno", "last_fno")
    return chunks.crossJoin(F.broadcast(one.select(F.col("n_nationkey").alias("data_object_id"), F.col("n_name").alias("object_name"))))


# ---- filters and scalars

@query("SELECT p_partkey, p_type FROM part WHERE p_type = upper('economy')")
def case_fold_filter(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_type") == F.upper(F.lit("economy"))).select("p_partkey", "p_type")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE coalesce(o_orderstatus, '') NOT IN ('F', 'P')")
def status_in_filter(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(~ledger.status_in(F.col("o_orderstatus"), ("F", "P"))).select("o_orderkey", "o_orderstatus")


@query("SELECT doc_id, contains(text, 'password') OR contains(text, 'token') AS hit FROM documents")
def substring_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.contains("text", F.lit("password")) | F.contains("text", F.lit("token"))).alias("hit"))


_NAMED = "SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages"


def hosts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.get(F.split(F.get(F.split("url", "://"), F.lit(1)), "/"), F.lit(0)).alias("host"))


_SHORT = f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN host ELSE split_part(host, '.', 1) || '.' || split_part(host, '.', 2) END AS name FROM ({_NAMED})"


@query(f"SELECT page_id, name FROM ({_SHORT}) WHERE len(string_split(name, '.')) = 2 AND starts_with(name, 'blog') OR ends_with(name, '.net') AND NOT starts_with(name, 'www.')")
def name_prefix_filter(spark, sf_dir):
    """Names of two to four segments: two of them and the first begins with a prefix, or another end."""
    name = F.when(F.col("page_id") % 3 == 0, F.col("host")).otherwise(F.substring_index("host", ".", 2)).alias("name")
    other = F.endswith("name", F.lit(".net")) & ~F.startswith("name", F.lit("www."))
    return hosts(spark, sf_dir).select("page_id", name).where(text.has_run_prefix(F.col("name"), "blog") | other)


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(url, '(?i)/EN/(\\d+)', 1), '') AS BIGINT), -1) AS number FROM pages")
def regex_capture(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(text.captured(F.col("url"), r"(?i)/EN/(\d+)").try_cast("bigint"), F.lit(-1)).alias("number"))


@query(f"SELECT page_id, CASE WHEN contains(host, '.') THEN split_part(host, '.', 1) END AS namespace FROM ({_NAMED})")
def namespace_extract(spark, sf_dir):
    return hosts(spark, sf_dir).select("page_id", text.namespace_of(F.col("host")).alias("namespace"))


@query(r"SELECT conv_id, turn, regexp_replace('  ' || text || chr(9), '^\s+|\s+$', '', 'g') AS stripped FROM conversations")
def string_trim(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.stripped(F.concat(F.lit("  "), F.col("text"), F.lit("\t"))).alias("stripped"))


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) = 1 AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def coalesce_default(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))


TEMPLATE = "READ (~QUERYTEXT~) INTO 'QUERY,~TARGETTABLE~';"


@query(f"SELECT p_partkey, replace(replace('{TEMPLATE.replace(chr(39), chr(39) * 2)}', '~QUERYTEXT~', 'SELECT * FROM ~TARGETTABLE~ WHERE p = ' || p_partkey), '~TARGETTABLE~', p_name) AS program FROM part")
def template_render(spark, sf_dir):
    sql = F.concat(F.lit("SELECT * FROM ~TARGETTABLE~ WHERE p = "), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.render_template(F.lit(TEMPLATE), sql, F.col("p_name")).alias("program"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = upper('household') AND c_acctbal >= 1000")
def parameterized_sql(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return spark.sql("SELECT c_custkey, c_acctbal FROM {t} WHERE c_mktsegment = upper(:segment) AND c_acctbal >= :least", args={"segment": "household", "least": 1000}, t=df)


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS stamp FROM events")
def timestamp_format(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timing.stamp_text(F.col("ts")).alias("stamp"))


@query("SELECT event_id, epoch_us(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '%Y-%m-%d %H:%M:%S.%f')) AS micros FROM events")
def timestamp_parse(spark, sf_dir):
    parsed = F.to_timestamp_ntz(timing.stamp_text(F.col("ts")), F.lit(timing.STAMP))
    return table(spark, sf_dir, "events").select("event_id", timing.micros_between(F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), parsed).alias("micros"))


@query("SELECT event_id, strftime(ts + INTERVAL 20 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS due FROM events")
def timestamp_add(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", timing.stamp_text(timing.plus_seconds(F.col("ts"), F.lit(20))).alias("due"))


_DURATION = """WITH d AS (SELECT user_id, date_diff('microsecond', min(ts), max(ts)) AS us FROM events GROUP BY user_id),
p AS (SELECT user_id, us, us // 3600000000 AS h, (us % 3600000000) // 60000000 AS m, us % 60000000 AS s FROM d)
SELECT user_id, CASE WHEN h > 0 THEN h || ' hours, ' ELSE '' END || CASE WHEN m > 0 THEN m || ' minutes ' || CASE WHEN h > 0 THEN ', ' ELSE ' and ' END ELSE '' END
  || CASE WHEN s > 0 THEN (s // 1000000) || ' seconds' ELSE '' END AS duration FROM p"""


@query(_DURATION)
def duration_format(spark, sf_dir):
    spans = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.select("user_id", timing.duration_text(timing.micros_between(F.col("a"), F.col("b"))).alias("duration"))


@query("SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 20 SECOND, true) AS due FROM events")
def throttle_gap(spark, sf_dir):
    last = F.lag("ts").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(timing.plus_seconds(last, F.lit(20)) <= F.col("ts"), F.lit(True)).alias("due"))


# ---- ledger

_LEDGER = """WITH ledger AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS roworder, 100 + o_orderkey % 3 AS uniquerunid,
  'SELECT * FROM S.T WHERE k = ''' || o_orderkey || '''' AS query, 'job_' || (100 + o_orderkey % 3) || '_' || (o_orderkey % 50 + 1) || '.App' AS appname, 'D.T' AS targettbl,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'RUNNING' END AS status,
  'job_' || (100 + o_orderkey % 3) || '_' || (o_orderkey % 50 + 1) AS namespace, o_orderdate AS started_datetime,
  CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 90 SECOND END AS finished_datetime, CAST(NULL AS VARCHAR) AS notes, o_orderkey % 2 = 0 AS iscurrentrow FROM orders)
"""
_STAMPS = "strftime(started_datetime, '%Y-%m-%d %H:%M:%S.%f') AS started_datetime, strftime(finished_datetime, '%Y-%m-%d %H:%M:%S.%f') AS finished_datetime"
_COLUMNS = f"id, roworder, uniquerunid, query, appname, targettbl, status, namespace, {_STAMPS}, notes, iscurrentrow"


def shown(rows: DataFrame) -> DataFrame:
    """A ledger with its timestamps as text."""
    return rows.withColumns({c: timing.stamp_text(F.col(c)) for c in ("started_datetime", "finished_datetime")})


def items(spark, sf_dir) -> DataFrame:
    """A ledger of all twelve columns made of orders."""
    o = prefix.ordinal(table(spark, sf_dir, "orders"), ["o_orderkey"], "roworder")
    key = F.col("o_orderkey")
    run = F.lit(100) + key % 3
    space = F.concat(F.lit("job_"), run.cast("string"), F.lit("_"), (key % 50 + 1).cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "RUNNING")
    return o.select(
        key.alias("id"), "roworder", run.alias("uniquerunid"), F.concat(F.lit("SELECT * FROM S.T WHERE k = '"), key.cast("string"), F.lit("'")).alias("query"), F.concat(space, F.lit(".App")).alias("appname"),
        F.lit("D.T").alias("targettbl"), status.alias("status"), space.alias("namespace"), F.col("o_orderdate").cast("timestamp_ntz").alias("started_datetime"),
        F.when(F.col("o_orderstatus") == "F", timing.plus_seconds(F.col("o_orderdate").cast("timestamp_ntz"), F.lit(90))).alias("finished_datetime"), F.lit(None).cast("string").alias("notes"), (key % 2 == 0).alias("iscurrentrow"))


@query("""SELECT * FROM (VALUES ('id', 'bigint'), ('roworder', 'bigint'), ('uniquerunid', 'bigint'), ('query', 'string'), ('appname', 'string'), ('targettbl', 'string'), ('status', 'string'),
 ('namespace', 'string'), ('started_datetime', 'timestamp'), ('finished_datetime', 'timestamp'), ('notes', 'string'), ('iscurrentrow', 'boolean')) t(name, type)""")
def ledger_schema(spark, sf_dir):
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in ledger.LEDGER], "name string, type string")


@query(_LEDGER + f"SELECT {_COLUMNS} FROM ledger UNION ALL SELECT {_COLUMNS.replace('id, ', 'id + 1000000, ', 1)} FROM ledger WHERE status = 'NEW'")
def ledger_append(spark, sf_dir):
    rows = items(spark, sf_dir)
    return shown(ledger.append(rows, rows.where("status = 'NEW'").withColumn("id", F.col("id") + 1_000_000)))


@query(_LEDGER + f"SELECT {_COLUMNS} FROM ledger WHERE id = 777")
def ledger_point_lookup(spark, sf_dir):
    return shown(ledger.lookup(items(spark, sf_dir), 777))


@query(_LEDGER + f"SELECT {_COLUMNS} FROM ledger WHERE iscurrentrow AND uniquerunid = {RUN}")
def ledger_filter_current_run(spark, sf_dir):
    return shown(ledger.rows_where(items(spark, sf_dir), f"iscurrentrow = True AND uniquerunid = {RUN}"))


_CHANGES = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 'FAILED' END AS status, o_orderdate + INTERVAL 20 SECOND AS finished_datetime, o_orderpriority AS notes FROM orders WHERE o_orderkey % 5 = 0"


def changes(spark, sf_dir) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(key % 5 == 0).select(key.alias("id"), F.when(key % 10 == 0, "FAILED").alias("status"), timing.plus_seconds(F.col("o_orderdate").cast("timestamp_ntz"), F.lit(20)).alias("finished_datetime"), F.col("o_orderpriority").alias("notes"))


@query(_LEDGER + f", s AS ({_CHANGES}) SELECT {_COLUMNS} FROM (SELECT l.* REPLACE (coalesce(s.status, l.status) AS status, coalesce(s.finished_datetime, l.finished_datetime) AS finished_datetime, coalesce(s.notes, l.notes) AS notes) FROM ledger l LEFT JOIN s USING (id))")
def ledger_update_by_id(spark, sf_dir):
    """Every change is there twice, once without a status, and counts once."""
    own = changes(spark, sf_dir)
    return shown(ledger.update_by_id(items(spark, sf_dir), own.unionByName(own.withColumn("status", F.lit(None).cast("string")))))


_SOURCE = f"SELECT l.* REPLACE (id + 7 AS id, 'FAILED' AS status) FROM ledger l WHERE uniquerunid = {RUN}"


@query(_LEDGER + f", s AS ({_SOURCE}) SELECT {_COLUMNS} FROM s UNION ALL SELECT {_COLUMNS} FROM ledger WHERE id NOT IN (SELECT id FROM s)")
def ledger_merge_upsert(spark, sf_dir):
    rows = items(spark, sf_dir)
    new = ledger.rows_where(rows, f"uniquerunid = {RUN}").withColumns({"id": F.col("id") + 7, "status": F.lit("FAILED")})
    return shown(ledger.merge_upsert(rows, new.unionByName(new)))


_CLEARED = f"SELECT l.* REPLACE (CASE WHEN uniquerunid = {RUN} THEN false ELSE iscurrentrow END AS iscurrentrow) FROM ledger l"


@query(_LEDGER + f"SELECT {_COLUMNS} FROM ({_CLEARED})")
def ledger_clear_run(spark, sf_dir):
    return shown(ledger.clear_run(items(spark, sf_dir), RUN))


@query(_LEDGER + f", s AS (SELECT l.* REPLACE ('FAILED' AS status) FROM ledger l WHERE uniquerunid = {RUN}) SELECT {_COLUMNS} FROM ({_CLEARED} UNION ALL SELECT s.* REPLACE (true AS iscurrentrow) FROM s)")
def ledger_new_version(spark, sf_dir):
    """Extension: slowly changing rows."""
    rows = items(spark, sf_dir)
    return shown(ledger.new_version(rows, rows.where(F.col("uniquerunid") == RUN).withColumn("status", F.lit("FAILED"))))


@query(_LEDGER + "SELECT id, roworder, status FROM ledger WHERE coalesce(status, '') NOT IN ('RUNNING', 'COMPLETED', 'FAILED', 'COMPLETED-FAILEDDROP') ORDER BY roworder, id")
def pending_queue(spark, sf_dir):
    return ledger.pending(items(spark, sf_dir)).select("id", "roworder", "status")


@query(_LEDGER + "SELECT id, roworder, status FROM ledger WHERE coalesce(status, '') NOT IN ('RUNNING', 'COMPLETED', 'FAILED', 'COMPLETED-FAILEDDROP') ORDER BY roworder, id LIMIT 1")
def next_pending(spark, sf_dir):
    return ledger.next_pending(items(spark, sf_dir)).select("id", "roworder", "status")


_USED = "used AS (SELECT DISTINCT CAST(split_part(namespace, '_', 3) AS BIGINT) AS n FROM ledger WHERE status = 'RUNNING' AND id % 50 <> 11)"


@query(_LEDGER + f", {_USED}, c AS (SELECT 11 AS running) SELECT CAST(CASE WHEN running + 1 IN (SELECT n FROM used) THEN (SELECT min(i) FROM range(2, 1000) r(i) WHERE i NOT IN (SELECT n FROM used)) ELSE running + 1 END AS BIGINT) AS slot FROM c")
def first_free_slot(spark, sf_dir):
    used = items(spark, sf_dir).where("status = 'RUNNING' AND id % 50 <> 11").select(F.get(F.split("namespace", "_"), F.lit(2)).alias("n"))
    return ledger.first_free(used, "n", 11)


@query(_LEDGER + f"SELECT CAST(count_if(status = 'RUNNING' AND starts_with(appname, 'job_{RUN}_')) AS BIGINT) AS running FROM ledger")
def count_running(spark, sf_dir):
    return items(spark, sf_dir).agg(F.count_if((F.col("status") == "RUNNING") & text.has_run_prefix(F.col("appname"), f"job_{RUN}_")).alias("running"))


@query(_LEDGER + "SELECT coalesce(bool_or(coalesce(status, '') NOT IN ('COMPLETED', 'FAILED', 'COMPLETED-FAILEDDROP')), false) AS any_not_done FROM ledger")
def any_not_done(spark, sf_dir):
    return ledger.any_not_done(items(spark, sf_dir))


@query("SELECT coalesce(max(o_orderkey) + 1, 1) AS next_id FROM orders")
def next_id(spark, sf_dir):
    return ledger.next_id(items(spark, sf_dir))


_FOLD = """WITH r AS (SELECT user_id, event_id, event_type, bool_or(event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS failed FROM events)
SELECT user_id, NOT bool_or(event_type = 'error') AS ok, coalesce(string_agg(event_type || ';', '' ORDER BY event_id) FILTER (failed), '') AS message FROM r GROUP BY user_id"""


@query(_FOLD)
def failure_message_agg(spark, sf_dir):
    result = F.struct("event_id", F.when(F.col("event_type") == "error", "Failure").otherwise("Success").alias("executionStatus"), F.col("event_type").alias("failureMessage"))
    by_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(result)).alias("results"))
    return by_user.select("user_id", monitor.folded_results(F.col("results")).alias("f")).select("user_id", "f.ok", "f.message")


@query(_LEDGER + "SELECT id, namespace FROM ledger WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = id AND c_mktsegment IN ('BUILDING', 'HOUSEHOLD'))")
def exists_semi_join(spark, sf_dir):
    alive = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD")).select(F.col("c_custkey").alias("id"))
    return items(spark, sf_dir).join(alive, "id", "left_semi").select("id", "namespace")


@query("SELECT DISTINCT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0")
def insert_ignore_duplicates(spark, sf_dir):
    """What customers, each offered twice, add to a target that has every third of them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return loader.insert_ignore(rows.where("k % 3 = 0"), rows.unionByName(rows), ["k"])


@query("SELECT c_custkey AS k, c_name AS v, CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END AS segment FROM customer")
def evolve_columns(spark, sf_dir):
    """Rows with a column that the target hasn't yet: it is added, null in the old rows."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.col("c_mktsegment").alias("segment"))
    return loader.evolved(rows.where("k % 2 = 0").drop("segment"), rows.where("k % 2 = 1"))


def derby(spark, sf_dir) -> tuple[str, dict[str, str]]:
    """An own database of the driver, on its disk until it ends, holding customers."""
    import atexit
    import shutil
    import tempfile

    from .sources import jdbc

    folder = tempfile.mkdtemp(prefix="quern-derby-")
    atexit.register(shutil.rmtree, folder, True)
    url, driver = f"jdbc:derby:{folder}/db;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.table_sink(table(spark, sf_dir, "customer").selectExpr("c_custkey AS K", "c_nationkey AS N", "c_acctbal AS B"), url, "CUSTOMER", **driver)
    return url, driver


@query("SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_nationkey < 12")
def jdbc_query_scan(spark, sf_dir):
    """A table written in batches over JDBC and read back by a query of the source."""
    from .sources import jdbc

    url, driver = derby(spark, sf_dir)
    return jdbc.query_source(spark, url, "SELECT K, B FROM CUSTOMER WHERE N < 12", **driver).select(F.col("K").alias("k"), F.col("B").alias("b"))


@query("SELECT c_nationkey AS n, count(*) AS c, min(c_custkey) AS low, max(c_custkey) AS high FROM customer GROUP BY 1")
def jdbc_ranged_load(spark, sf_dir):
    """Key ranges of a JDBC table, a partition each, appended in batches to another one and read again."""
    from .sources import jdbc

    url, driver = derby(spark, sf_dir)
    jdbc.table_sink(jdbc.ranged_source(spark, url, "CUSTOMER", "K", splitter.integer_ranges([50, 700, 1400]), **driver), url, "COPY", **driver)
    rows = jdbc.query_source(spark, url, "SELECT * FROM COPY", **driver)
    return rows.groupBy(F.col("N").alias("n")).agg(F.count(F.lit(1)).alias("c"), F.min("K").alias("low"), F.max("K").alias("high"))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def column_map_projection(spark, sf_dir):
    target = spark.range(1).select(text.split_target(F.lit("DW.CUST ColumnMap(name=c_name, id=c_custkey, balance=c_acctbal) KeyColumns(id)")).alias("t")).first().t
    return loader.mapped(table(spark, sf_dir, "customer"), target["columns"], target["keys"])


@query("SELECT * FROM (VALUES (1, 'A.T', 'NEW'), (2, 'B.T', NULL), (3, 'it''s', 'RUNNING')) t(id, targettbl, status)")
def inline_union_all(spark, sf_dir):
    return spark.sql("SELECT 1 AS id, 'A.T' AS targettbl, 'NEW' AS status UNION ALL SELECT * FROM VALUES (2, 'B.T', NULL), (3, 'it''s', 'RUNNING')")


# ---- monitoring

@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_APP = """'{"entityType":"APPLICATION","fullName":"job_101_' || (s_suppkey % 50 + 1) || '.App","statusChange":"' || CASE s_suppkey % 3 WHEN 0 THEN 'QUIESCED' WHEN 1 THEN 'RUNNING' ELSE 'CREATED' END || '","rate":"' || s_suppkey || '"}'"""
_SNAPSHOT = f"""WITH snaps AS (SELECT s_suppkey AS id, CASE s_suppkey % 9
  WHEN 0 THEN '[{{"output":{{"applications":[' || {_APP} || '],"clusterNodes":[{{"entityType":"NODE","fullName":"N' || s_suppkey || '","version":"5"}},{{"entityType":"NODE","name":"x"}}],"search":{{"rx":"1","tx":"2"}}}}}}]'
  WHEN 1 THEN '[{{"output":{{"applications":[{{"entityType":"APPLICATION","fullName":null}}]}}}}]'
  WHEN 2 THEN '[{{"output":{{"applications":[]}}}}]'
  WHEN 3 THEN '[{{"output":{{}}}}]'
  WHEN 4 THEN '{{"output":1}}'
  WHEN 5 THEN 'no json'
  WHEN 6 THEN '[{{"output":{{"applications":[' || {_APP} || ',{{"fullName":"job_101_9.Untyped"}}],"clusterNodes":[{{"entityType":"NODE","name":"a","fullName":"b","version":"5"}}]}}}}]'
  WHEN 7 THEN '[{{"output":{{"applications":[' || {_APP} || ',"text"]}}}}]'
  ELSE '[]' END AS j FROM supplier),
checked AS (SELECT *, CASE WHEN json_valid(j) THEN j END AS v FROM snaps),
valids AS (SELECT id, j, v, coalesce(json_type(v) = 'ARRAY' AND json_type(v, '$[0].output.applications') = 'ARRAY'
  AND len(list_filter(json_extract(v, '$[0].output.applications[*]'), lambda a: json_extract_string(a, '$.fullName') IS NULL)) = 0, false) AS valid FROM checked)
"""


def snapshots(spark, sf_dir) -> DataFrame:
    """Snapshots of all shapes, valid and not, made of suppliers."""
    key = F.col("s_suppkey")
    state = F.element_at(F.array(F.lit("QUIESCED"), F.lit("RUNNING"), F.lit("CREATED")), (key % 3 + 1).cast("int"))
    app = F.format_string('{"entityType":"APPLICATION","fullName":"job_101_%d.App","statusChange":"%s","rate":"%d"}', key % 50 + 1, state, key)
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shapes = (
        put('[{"output":{"applications":[', app, '],"clusterNodes":[{"entityType":"NODE","fullName":"N', key.cast("string"), '","version":"5"},{"entityType":"NODE","name":"x"}],"search":{"rx":"1","tx":"2"}}}]'),
        F.lit('[{"output":{"applications":[{"entityType":"APPLICATION","fullName":null}]}}]'), F.lit('[{"output":{"applications":[]}}]'), F.lit('[{"output":{}}]'), F.lit('{"output":1}'), F.lit("no json"),
        put('[{"output":{"applications":[', app, ',{"fullName":"job_101_9.Untyped"}],"clusterNodes":[{"entityType":"NODE","name":"a","fullName":"b","version":"5"}]}}]'),
        put('[{"output":{"applications":[', app, ',"text"]}}]'), F.lit("[]"))
    return table(spark, sf_dir, "supplier").select(key.alias("id"), F.element_at(F.array(*shapes), (key % 9 + 1).cast("int")).alias("j"))


SNAPSHOT = monitor.Snapshot


@query(_SNAPSHOT + "SELECT id, valid FROM valids")
def monitor_validate(spark, sf_dir):
    return snapshots(spark, sf_dir).select("id", SNAPSHOT("j").valid().alias("valid"))


_APPS = "apps AS (SELECT id, json_extract_string(a, '$.fullName') AS name, json_extract_string(a, '$.statusChange') AS state FROM (SELECT id, unnest(json_extract(v, '$[0].output.applications[*]')) AS a FROM valids WHERE valid) WHERE json_extract_string(a, '$.entityType') IS NOT NULL)"


@query(_SNAPSHOT + f", {_APPS} SELECT id, name, state, CASE WHEN contains(name, '.') THEN split_part(name, '.', 1) END AS namespace FROM apps")
def monitor_explode(spark, sf_dir):
    return SNAPSHOT("j").open_apps(snapshots(spark, sf_dir), "id").select("id", F.col("fullName").alias("name"), F.col("statusChange").alias("state"), "namespace")


@query(_SNAPSHOT + """SELECT id, coalesce(json_extract_string(n, '$.name'), json_extract_string(n, '$.fullName')) AS name, json_extract_string(n, '$.version') AS version
FROM (SELECT id, unnest(json_extract(v, '$[0].output.clusterNodes[*]')) AS n FROM valids WHERE valid) WHERE json_extract_string(n, '$.entityType') IS NOT NULL AND json_extract_string(n, '$.version') IS NOT NULL""")
def monitor_nodes(spark, sf_dir):
    return SNAPSHOT("j").open_nodes(snapshots(spark, sf_dir), "id").select("id", "name", "version")


@query(_SNAPSHOT + "SELECT id, json_extract_string(v, '$[0].output.search.rx') AS rx, json_extract_string(v, '$[0].output.search.tx') AS tx FROM valids WHERE valid AND json_type(v, '$[0].output.search') = 'OBJECT'")
def monitor_es(spark, sf_dir):
    return SNAPSHOT("j").open_store(snapshots(spark, sf_dir), "id").select("id", "rx", "tx")


@query(_LEDGER + ", s AS (" + _SNAPSHOT + f", {_APPS} SELECT DISTINCT split_part(name, '.', 1) AS namespace FROM apps WHERE state IN ('QUIESCED', 'COMPLETED')) SELECT id, namespace FROM ledger WHERE status = 'RUNNING' AND namespace IN (SELECT namespace FROM s)")
def monitor_match_join(spark, sf_dir):
    apps = SNAPSHOT("j").open_apps(snapshots(spark, sf_dir), "id")
    return monitor.finished_items(items(spark, sf_dir), apps.drop("id")).select("id", "namespace")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) || ',end' AS parts FROM events GROUP BY user_id")
def array_append(spark, sf_dir):
    by_user = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    return by_user.select("user_id", F.array_join(F.array_append(F.col("e.event_type"), F.lit("end")), ",").alias("parts"))


_QUEUE = "SELECT p_partkey + 1 AS roworder, 'SELECT * FROM A.T WHERE s = \"' || p_name || '\"' AS query, ' B.T' AS targettbl FROM part WHERE p_partkey % 4 <> 0"


@query(_QUEUE)
def scan_queue_file(spark, sf_dir):
    """Queue lines made of parts: quoted, with doubled quotes, extra columns and blank lines."""
    from .sources.queue_file import scan_queue

    line = F.concat(F.lit('"SELECT * FROM A.T WHERE s = ""'), F.col("p_name"), F.lit('"""| B.T||||||'))
    lines = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("line"), F.when(F.col("p_partkey") % 4 == 0, "").otherwise(line).alias("value"))
    return scan_queue(lines)
