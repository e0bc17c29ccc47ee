"""JSON documents, logs and window lists as sources; JSON, subtitle text and log lines as sinks.

Schemas are declared, never inferred. Writers use Spark's commit protocol, so a file is there whole
or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEATMAP = "schema_version int, source string, synthetic boolean, video_id string, duration_seconds double, points array<struct<start_time:double,end_time:double,value:double>>"
SEGMENT = "array<struct<start:string,end:string,text:string,speaker:string,speaker_id:string,speakerId:string,importance:int>>"
PEAKS = "schema_version int, source string, algorithm string, algorithm_version int, video_id string, duration_seconds double, peaks array<struct<rank:bigint,peak_time:double,start_time:double,end_time:double,raw_value:double,smoothed_value:double,prominence:double>>"


def read_heatmaps(spark: SparkSession, path: str) -> DataFrame:
    """One row for each point of the documents at ``path``; malformed documents and unknown schema versions raise."""
    return heatmap_rows(spark.read.text(path, wholetext=True))


def heatmap_rows(raw: DataFrame, value: str = "value") -> DataFrame:
    """(video_id, idx, start_time, end_time, value, duration_seconds) of heatmap documents as JSON texts."""
    docs = known_version(raw.select(F.from_json(value, HEATMAP, {"mode": "FAILFAST"}).alias("d")).select("d.*"))
    return docs.select("video_id", "duration_seconds", F.posexplode("points").alias("idx", "p")).select("video_id", F.col("idx").cast("long").alias("idx"), "p.*", "duration_seconds")


def known_version(docs: DataFrame, version: int = 1) -> DataFrame:
    """``docs``, whose reading raises at another schema version."""
    right = F.col("schema_version").eqNullSafe(F.lit(version))
    return docs.where(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))).cast("boolean")))


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each peak of the documents at ``path``, for ``candidates.peak_violations``; malformed documents and unknown versions raise."""
    docs = known_version(spark.read.schema(PEAKS).json(path, multiLine=True, mode="FAILFAST"))
    return docs.select("video_id", "duration_seconds", F.explode("peaks").alias("p")).select("video_id", "p.*", "duration_seconds")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, idx, start, end, text, speaker, importance) of documents that are a list, or an object with ``segments``. A byte-order mark is skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return transcript_rows(raw, "path")


def transcript_rows(raw: DataFrame, key: str) -> DataFrame:
    listed = F.from_json("value", SEGMENT)
    inner = F.from_json("value", f"segments {SEGMENT}")["segments"]
    return raw.select(key, F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)).alias("idx", "s")).select(key, "idx", "s.*").withColumn("speaker", first_present("speaker", "speaker_id", "speakerId")).drop("speaker_id", "speakerId")


ALIASES = ("top_windows", "windows", "selected_windows", "selected_clips", "clips")


def window_rows(raw: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """(key, idx, start, end, summary): clip windows of JSON in any of the shapes in use.

    A list; else the first of five keys that holds a list; else decisions, by their aliases; else
    adjustments. Windows of the last two without start or end are dropped.
    """
    v = F.col("v")
    has = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")).startswith("ARRAY")
    pick = F.when(F.schema_of_variant(v).startswith("ARRAY"), v)
    for k in (*ALIASES, "decisions", "cutter_adjustments"):
        pick = pick.when(has(k), F.try_variant_get(v, f"$.{k}", "variant"))
    shape = F.when(F.schema_of_variant(v).startswith("ARRAY"), "list")
    for k in ALIASES:
        shape = shape.when(has(k), "list")
    shape = shape.when(has("decisions"), "decision").when(has("cutter_adjustments"), "adjustment")
    made = raw.select(key, F.try_parse_json(value).alias("v")).select(key, F.to_json(pick).alias("items"), shape.alias("shape"))
    names = ["start", "end", "final_start", "final_end", "heatmap_start", "heatmap_end"]
    item = "array<struct<" + ",".join(f"{n}:double" for n in names) + ",summary:string,summary_after:string,reason:string,summary_before:string,source_window:struct<start:double,end:double,summary:string>>>"
    rows = made.select(key, "shape", F.posexplode(F.from_json("items", item)).alias("idx", "w")).where("w is not null")
    d, listed = F.col("shape") == "decision", F.col("shape") == "list"
    bound = lambda n: F.when(listed, F.col(f"w.{n}")).when(d, F.coalesce(f"w.final_{n}", f"w.{n}", f"w.heatmap_{n}")).otherwise(F.coalesce(f"w.final_{n}", f"w.{n}", f"w.source_window.{n}"))
    summary = F.when(listed, F.col("w.summary")).when(d, first_present("w.summary_after", "w.reason", "w.summary_before")).otherwise(F.col("w.source_window.summary"))
    out = rows.select(key, "idx", "shape", bound("start").alias("start"), bound("end").alias("end"), summary.alias("summary"))
    return out.where("shape = 'list' or (start is not null and end is not null)").drop("shape")


def first_present(*columns: str) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def first_source(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the source with the least ``priority`` that a key has."""
    return rows.withColumn("__p", F.min("priority").over(Window.partitionBy(key))).where("priority = __p").drop("__p")


def preferred_file(files: DataFrame, folder: str) -> DataFrame:
    """Per folder the newest path, by (modified, length, path) of binaryFile metadata."""
    return files.groupBy(folder).agg(F.max_by("path", F.struct("modified", "length", "path")).alias("path"))


def log_tail(lines: DataFrame, n: int, key: str = "path", order: str = "line") -> DataFrame:
    """The last ``n`` lines (1 to 1000) of each log."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return lines.withColumn("__n", last).where(F.col("__n") <= max(1, min(1000, n))).drop("__n")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def subtitle_script(events: DataFrame) -> DataFrame:
    """(doc_id, script): the dialogue lines of each clip in the subtitle format, in order."""
    from spanloom.functions.timecode import ass_time

    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_cs")), F.lit(","), ass_time(F.col("end_cs")), F.lit(",Default,,0,0,0,,"), escaped(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("start_cs", "end_cs", line.alias("line"))))
    return events.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("script"))


def escaped(text: Column) -> Column:
    """Backslashes, braces and line ends as the subtitle format wants them."""
    for a, b in (("\r\n", "\n"), ("\r", "\n"), ("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def append_lines(lines: DataFrame, path: str) -> None:
    """Adds the lines (value) to a log folder, secrets replaced."""
    from spanloom.functions.text import redacted

    lines.select(redacted(F.col("value")).alias("value")).write.mode("append").text(path)


def save_table(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a table of the project store and reads it back: a new version beside the last one, then a pointer to it.

    ``df`` may be derived from the version it replaces; a job that fails leaves that one in place.
    """
    import uuid

    spark = df.sparkSession
    path = f"{folder}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.createDataFrame([(path,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/_current")
    return load_table(spark, folder, name)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The last saved version of a table."""
    return spark.read.parquet(spark.read.text(f"{folder}/{name}/_current").first()[0])


def dotenv(lines: DataFrame, key: str = "path", order: str = "line") -> DataFrame:
    """(key, name, value): settings of NAME=value lines, the last of each name; comments, blank lines and an 'export ' before the name go, and so do quotes around a value."""
    t = F.regexp_replace(F.trim("value"), r"^export\s+", "")
    name, value = F.trim(F.substring_index(t, "=", 1)), F.trim(F.regexp_replace(t, r"^[^=]*=", ""))
    bare = F.regexp_replace(value, r"^(?:\"(.*)\"|'(.*)')$", "$1$2")
    rows = lines.where((t != "") & ~t.startswith("#") & F.contains(t, F.lit("=")) & (name != "")).select(key, name.alias("name"), bare.alias("value"), F.col(order).alias("__o"))
    return rows.groupBy(key, "name").agg(F.max(F.struct("__o", "value")).alias("x")).select(key, "name", "x.value")


STYLE = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"


def script_header(styles: list[str], title: str = "Subtitles", width: int = 1080, height: int = 1920) -> str:
    """What stands before a subtitle script's dialogue: information, styles, and the events' columns."""
    info = ["[Script Info]", f"Title: {title}", "ScriptType: v4.00+", "WrapStyle: 2", "ScaledBorderAndShadow: yes", "Collisions: Normal", f"PlayResX: {width}", f"PlayResY: {height}"]
    return "\n".join([*info, "", "[V4+ Styles]", STYLE, *styles, "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"])


def style_line(name: str, colour: str, size: int = 68, outline: str = "&H00000000", bold: int = -1, alignment: int = 2, font: str = "DejaVu Sans") -> str:
    return f"Style: {name},{font},{size},{colour},&H00000000,{outline},&H00000000,{bold},0,0,0,100,100,0,0,1,5,2,{alignment},90,90,360,1"


def full_script(events: DataFrame, styles: list[str]) -> DataFrame:
    """(doc_id, script): whole subtitle files, header and dialogue."""
    return subtitle_script(events).withColumn("script", F.concat(F.lit(script_header(styles) + "\n"), F.col("script")))
