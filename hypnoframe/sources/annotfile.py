"""Annotation files, per-epoch stage files, XML events and sample lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def _time(c: Column) -> Column:
    """Elapsed seconds, or elapsed hh:mm:ss, as nanoseconds."""
    p = F.split(c, ":")
    hms = F.element_at(p, 1).try_cast("double") * 3600 + F.element_at(p, 2).try_cast("double") * 60 + F.try_element_at(p, F.lit(3)).try_cast("double")
    return F.round(F.when(c.contains(":"), hms).otherwise(c.try_cast("double")) * NS).cast("long")


def read(spark: SparkSession, path: str, epoch_s: float = 30.0) -> DataFrame:
    """Tab-separated rows: class, instance, channel, start, stop[, meta], or class, instance, start, stop, or class, start, stop.

    Lines that start with # are headers.  ``e:n`` is the n-th epoch; ``.`` and ``.`` are
    untimed (0, 0); a stop of ``...`` or ``-`` is the next start in the file.
    """
    lines = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[a-z]+)?$", 1).alias("id"), F.monotonically_increasing_id().alias("k"), F.split("value", "\t").alias("f"), "value")
    d = lines.where("value not like '#%' and length(trim(value)) > 0 and f[0] != 'class'").withColumn("n", F.size("f"))
    at = lambda i: F.try_element_at("f", F.lit(i))
    start = F.when(F.col("n") >= 5, at(4)).when(F.col("n") == 4, at(3)).otherwise(at(2))
    stop = F.when(F.col("n") >= 5, at(5)).when(F.col("n") == 4, at(4)).otherwise(at(3))
    d = d.select("id", "k", at(1).alias("class"), F.when(F.col("n") >= 4, at(2)).otherwise(at(1)).alias("inst"), F.when(F.col("n") >= 5, at(3)).otherwise(".").alias("ch"), start.alias("a"), stop.alias("b"), F.when(F.col("n") >= 6, at(6)).alias("m"))
    e = F.regexp_extract("a", r"^e:(\d+)", 1).try_cast("long")
    s = F.when(F.col("a") == ".", F.lit(0)).when(e.isNotNull(), ((e - 1) * epoch_s * NS).cast("long")).otherwise(_time(F.col("a")))
    d = d.withColumn("start_ns", s)
    following = F.lead("start_ns").over(Window.partitionBy("id").orderBy("k"))
    t = F.when(F.col("b") == ".", F.lit(0)).when(F.col("b").isin("...", "-"), following).when(e.isNotNull() & F.col("b").startswith("e:"), (F.regexp_extract("b", r"^e:(\d+)", 1).try_cast("long") * epoch_s * NS).cast("long")).otherwise(_time(F.col("b")))
    meta = F.when(F.col("m").contains("="), F.str_to_map("m", F.lit(";"), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    out = d.withColumn("stop_ns", t).select("id", "class", "inst", "ch", "start_ns", "stop_ns", meta.alias("meta")).where("start_ns is not null and stop_ns is not null")
    return out.dropDuplicates(["id", "class", "inst", "ch", "start_ns", "stop_ns"])


def read_stages(spark: SparkSession, path: str, epoch_s: float = 30.0) -> DataFrame:
    """One label per line and epoch."""
    n = round(epoch_s * NS)
    d = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[a-z]+)?$", 1).alias("id"), F.monotonically_increasing_id().alias("k"), F.trim("value").alias("class")).where("length(class) > 0")
    e = F.row_number().over(Window.partitionBy("id").orderBy("k")).cast("long")
    return d.select("id", "class", F.col("class").alias("inst"), F.lit(".").alias("ch"), ((e - 1) * n).alias("start_ns"), (e * n).alias("stop_ns"), F.create_map().cast("map<string,string>").alias("meta"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature lists: start and stop (ns), label, then key=value fields; a key alone has an empty value.

    The class is the file's name, the instance the label. A line of fewer than three
    fields goes; one with a start that is no number or after its stop is an error.
    """
    d = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[a-z]+)?$", 1).alias("class"), F.split("value", "\t").alias("f"), "value").where("size(f) >= 3")
    a, b = F.col("f")[0].try_cast("long"), F.col("f")[1].try_cast("long")
    bad = a.isNull() | b.isNull() | (a > b)
    start = F.when(bad, F.raise_error(F.concat(F.lit("bad feature line: "), "value"))).otherwise(a)
    pairs = F.transform(F.slice("f", 4, F.greatest(F.size("f") - 3, F.lit(0))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.when(x.contains("="), F.substr(x, F.instr(x, F.lit("=")) + 1)).otherwise("").alias("v")))
    # a key that comes again counts as it came last
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return d.select("class", F.col("f")[2].alias("inst"), F.lit(".").alias("ch"), start.alias("start_ns"), b.alias("stop_ns"), last.alias("meta"))


def build_sample_list(spark: SparkSession, folder: str) -> DataFrame:
    """id, edf, annots (array) of the recordings below a folder, annotation files matched by name; listed by Spark, so any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    # sorted lists: an id may have several annotation files
    d = files.select("path", F.regexp_extract("path", r"([^/]+?)(-nsrr|-profusion)?\.([A-Za-z.]+)$", 1).alias("id"), F.lower(F.regexp_extract("path", r"\.(edf\.gz|[A-Za-z]+)$", 1)).alias("kind"))
    edf = F.col("kind").isin("edf", "edfz", "edf.gz")
    note = F.col("kind").isin("annot", "eannot", "stages", "xml", "ftr", "tsv")
    g = d.where(edf | note).groupBy("id").agg(F.min(F.when(edf, F.col("path"))).alias("edf"), F.array_sort(F.collect_list(F.when(note, F.col("path")))).alias("annots"))
    return g.where("edf is not null").select("id", "edf", "annots")


def validated(samples: DataFrame, found: DataFrame) -> DataFrame:
    """``samples`` with ``ok``, whether its files are among ``found`` (path), and ``missing``, the ones that aren't; ids that come twice aren't ok."""
    want = samples.select("id", F.explode(F.concat(F.array("edf"), "annots")).alias("path")).distinct()
    gone = want.join(found.select("path").distinct(), "path", "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("path")).alias("missing"))
    twice = samples.groupBy("id").agg((F.count("*") > 1).alias("twice"))
    j = samples.join(gone, "id", "left").join(twice, "id")
    return j.withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))).withColumn("ok", (F.size("missing") == 0) & ~F.col("twice")).drop("twice")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """ScoredEvent elements (EventConcept, Start, Duration)."""
    x = spark.read.format("xml").option("rowTag", "ScoredEvent").schema("EventConcept string, SignalLocation string, Start double, Duration double").load(path)
    x = x.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[a-z]+)?$", 1).alias("id"), F.col("EventConcept").alias("class"), F.coalesce("SignalLocation", F.lit(".")).alias("ch"), F.round(F.col("Start") * NS).cast("long").alias("start_ns"), F.round((F.col("Start") + F.col("Duration")) * NS).cast("long").alias("stop_ns"))
    return x.select("id", "class", F.col("class").alias("inst"), "ch", "start_ns", "stop_ns", F.create_map().cast("map<string,string>").alias("meta"))


def write(annots: DataFrame, path: str) -> None:
    """Rows class, instance, channel, start, stop (seconds), meta; a folder of tab-separated files, one per recording."""
    meta = F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    d = annots.select("id", "class", "inst", "ch", F.format_string("%.6f", F.col("start_ns") / NS).alias("start"), F.format_string("%.6f", F.col("stop_ns") / NS).alias("stop"), F.when(F.length(meta) > 0, meta).otherwise(".").alias("meta"))
    d.repartition("id").sortWithinPartitions("id", "start").write.mode("overwrite").partitionBy("id").csv(path, sep="\t")


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """id, edf, annots (array) of a tab-separated sample list."""
    d = spark.read.text(path).select(F.split("value", "\t").alias("f")).where("size(f) >= 2")
    return d.select(F.element_at("f", 1).alias("id"), F.element_at("f", 2).alias("edf"), F.filter(F.split(F.coalesce(F.try_element_at("f", F.lit(3)), F.lit("")), ","), lambda x: ~x.isin("", ".")).alias("annots"))


def repath(samples: DataFrame, old: str, new: str) -> DataFrame:
    put = lambda c: F.when(c.startswith(old), F.concat(F.lit(new), c.substr(len(old) + 1, 10_000))).otherwise(c)
    return samples.withColumns({"edf": put(F.col("edf")), "annots": F.transform("annots", put)})
