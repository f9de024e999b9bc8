"""Jobs as tables: command choice, status, inputs, summaries, the best stage of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeplan.functions import geo
from ridgeplan.runtime import materialize, numbered

MOST_JOBS, QUICK_CELLS = 3, 1_600


def command(trade_off: Column, cells: Column) -> Column:
    """Parameters of a job by its trade-off: 100 is a quick plan, 1 keeps proportions, else the original grid."""
    quick = F.struct(F.lit("quick").alias("mode"), F.lit(QUICK_CELLS).cast("long").alias("target"), F.lit(0.0).alias("percent"))
    scaled = F.struct(F.lit("proportional").alias("mode"), geo.rescale_target(cells).alias("target"), geo.removal_percent(cells).alias("percent"))
    whole = F.struct(F.lit("original").alias("mode"), cells.cast("long").alias("target"), geo.removal_percent(cells).alias("percent"))
    return F.when(trade_off == 100, quick).when((trade_off == 1) | (cells > geo.LARGEST_GRID), scaled).otherwise(whole)


def job_status(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """(user_id, job_id, finished) of users' job arrays."""
    return jobs.select("user_id", F.explode("jobs").alias("job_id")).join(done.select("job_id").distinct().withColumn("finished", F.lit(True)), "job_id", "left").select("user_id", "job_id", F.coalesce("finished", F.lit(False)).alias("finished"))


def users_with_flags(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """(user_id, jobs) with ``job:1`` or ``job:0``, comma-joined."""
    flagged = job_status(jobs, done).withColumn("text", F.concat("job_id", F.lit(":"), F.col("finished").cast("int").cast("string")))
    listed = flagged.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list("text")), ",").alias("jobs"))
    return jobs.select("user_id").join(listed, "user_id", "left").select("user_id", F.coalesce("jobs", F.lit("")).alias("jobs"))


def add_job(jobs: Column, job: Column) -> Column:
    """The array with one more job, unless the user has as many as allowed."""
    return F.when(F.size(jobs) < MOST_JOBS, F.array_append(jobs, job)).otherwise(jobs)


def remove_job(jobs: Column, job: Column) -> Column:
    return F.array_remove(jobs, job)


def input_rows(sites: DataFrame, source: DataFrame, links: DataFrame) -> DataFrame:
    """A job's input as tagged rows."""
    tag = lambda df, kind: df.withColumn("kind", F.lit(kind))
    return tag(sites, "sink").unionByName(tag(source, "source"), allowMissingColumns=True).unionByName(tag(links, "line"), allowMissingColumns=True)


def job_summary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per job: cost, towers (nodes), links (edges), relays (intermediate nodes)."""
    e = edges.groupBy("job_id").agg(F.sum("pair_cost").alias("cost"), F.count(F.lit(1)).alias("links"))
    n = nodes.groupBy("job_id").agg(F.count(F.lit(1)).alias("towers"), F.count(F.when(F.col("kind") == "intermediate", 1)).alias("relays"))
    return e.join(n, "job_id", "full_outer").select("job_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("cost", "towers", "links", "relays")])


def final_solutions(files: DataFrame) -> DataFrame:
    """(job_id, name): the best result file of each job: final_2_2, then final_1_2, then the last output_i."""
    number = F.regexp_extract("name", r"^output_(\d+)$", 1).try_cast("int")
    rank = F.when(F.col("name") == "final_2_2", 0).when(F.col("name") == "final_1_2", 1).when(number.isNotNull(), 2)
    w = Window.partitionBy("job_id").orderBy("rank", F.desc("number"), "name")
    ranked = files.withColumn("rank", rank).withColumn("number", number).filter("rank IS NOT NULL")
    return ranked.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("job_id", "name")


def next_ids(existing: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Fresh rows with node ids after the largest existing one (two-level numbering, no single task)."""
    top = F.broadcast(existing.agg(F.coalesce(F.max("node"), F.lit(-1)).alias("top")))  # one row
    salted = fresh.withColumn("salt", F.floor(F.col(order) / 1_000_000))
    sizes = salted.groupBy("salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("salt", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = salted.join(before, "salt").withColumn("rn", F.row_number().over(Window.partitionBy("salt").orderBy(order)))
    return numbered.join(top).select(*fresh.columns, (F.col("top") + F.col("before") + F.col("rn")).alias("node"))


def kept_order(edges: DataFrame) -> DataFrame:
    """Edges with ``place``: flow ascending, then the text "tail,head"; ranges of that order are numbered one by one."""
    text = F.concat_ws(",", F.col("tail").cast("string"), F.col("head").cast("string"))
    ordered = edges.withColumn("__text", text).repartitionByRange("flow", "__text").sortWithinPartitions("flow", "__text").withColumn("__ord", F.monotonically_increasing_id())
    return numbered(materialize(ordered, "ordered"), "__ord", "place").drop("__text", "__ord")


def one_source(nodes: DataFrame) -> DataFrame:
    """(job_id, n_sources, ok): a job needs exactly one source."""
    n = F.count(F.when(F.col("kind") == "source", 1))
    return nodes.groupBy("job_id").agg(n.alias("n_sources"), (n == 1).alias("ok"))


def local_ids(nodes: DataFrame) -> DataFrame:
    """(node, local): distinct nodes numbered from 0 in ascending order."""
    ordered = nodes.select("node").distinct().repartitionByRange("node").sortWithinPartitions("node").withColumn("__ord", F.monotonically_increasing_id())
    return numbered(materialize(ordered, "nodes"), "__ord", "local").select("node", (F.col("local") - 1).alias("local"))


def to_local(rows: DataFrame, ids: DataFrame, column: str = "node") -> DataFrame:
    """Rows with ``local``, -1 for a node that has none."""
    return rows.join(ids.withColumnRenamed("node", column), column, "left").withColumn("local", F.coalesce("local", F.lit(-1).cast("long")))
