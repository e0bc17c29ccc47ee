"""Time codes: parsers of the different consumers, formatters, quantization, segment ids.

The parsers are not interchangeable; each keeps its consumer's rules. All return seconds as double,
or null where the consumer rejects the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FLOAT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def _number(part: Column, pattern: str = _FLOAT) -> Column:
    return F.when(part.rlike(pattern), F.trim(part).cast("double"))


def _clean(text: Column) -> Column:
    return F.replace(F.trim(text), F.lit(","), F.lit("."))


def _clock(parts: Column, head: str) -> Column:
    """Seconds from one, two or three parts; all but the last match ``head``."""
    n, p = F.size(parts), lambda i: F.get(parts, F.lit(i))
    return (
        F.when(n == 1, _number(p(0)))
        .when(n == 2, _number(p(0), head) * 60 + _number(p(1)))
        .when(n == 3, _number(p(0), head) * 3600 + _number(p(1), head) * 60 + _number(p(2)))
    )


def parse_checker(text: Column) -> Column:
    """Seconds, MM:SS or HH:MM:SS; whole minutes and hours."""
    return _clock(F.split(_clean(text), ":"), _INT)


def parse_cutter(text: Column) -> Column:
    """As the checker's, but empty parts are dropped first."""
    return _clock(F.filter(F.split(_clean(text), ":"), lambda x: x != ""), _INT)


def parse_base(text: Column) -> Column:
    """Fractions in any part; of four parts and more, only the first is read."""
    parts = F.split(_clean(text), ":")
    good = F.forall(parts, lambda x: x.rlike(_FLOAT))
    return F.when(good, F.coalesce(_clock(parts, _FLOAT), _number(F.get(parts, F.lit(0)))))


def parse_subtitler(text: Column) -> Column:
    """[H:]MM:SS with two-digit seconds; bare seconds are rejected."""
    t = _clean(text)
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{2}(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    hours = F.when(part(1) == "", F.lit("0")).otherwise(part(1)).cast("double")
    return F.when(t.rlike(pattern), hours * 3600 + F.when(part(2) == "", "0").otherwise(part(2)).cast("double") * 60 + F.when(part(3) == "", "0").otherwise(part(3)).cast("double"))


def parse_strict(text: Column) -> Column:
    """As the checker's, without negative times."""
    made = parse_checker(text)
    return F.when(made >= 0, made)


def centiseconds(seconds: Column) -> Column:
    """Half-up centiseconds of a double, by its shortest decimal form."""
    return (F.round(seconds.cast("string").cast("decimal(30,12)"), 2) * 100).cast("long")


def hms(cs: Column) -> Column:
    """HH:MM:SS.cc, hours only if there are any."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m, s, c = F.floor(cs / 360000), F.floor(F.pmod(cs, F.lit(360000)) / 6000), F.floor(F.pmod(cs, F.lit(6000)) / 100), F.pmod(cs, F.lit(100))
    return F.concat(F.when(h > 0, F.concat(two(h), F.lit(":"))).otherwise(""), two(m), F.lit(":"), two(s), F.lit("."), two(c))


def ass_time(cs: Column) -> Column:
    """H:MM:SS.cc of subtitle files."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), two(F.floor(F.pmod(cs, F.lit(360000)) / 6000)), F.lit(":"), two(F.floor(F.pmod(cs, F.lit(6000)) / 100)), F.lit("."), two(F.pmod(cs, F.lit(100))))


def file_stamp(cs: Column) -> Column:
    """MM-SS for file names, whole seconds."""
    s = F.floor(cs / 100)
    return F.concat(F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))


def segment_id(start_cs: Column, end_cs: Column) -> Column:
    """seg_v1_ and the SHA-256 of the sorted, compact JSON of the range."""
    return F.concat(F.lit("seg_v1_"), F.sha2(F.concat(F.lit('{"end_centiseconds":'), end_cs.cast("string"), F.lit(',"segment_id_version":1,"start_centiseconds":'), start_cs.cast("string"), F.lit("}")), 256))


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length that two intervals share, 0 if they only touch."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def filename_range(name: Column) -> Column:
    """Struct (start, end) in seconds of segment_N_M-SS_f_M-SS_f file names; null parts if it is none."""
    pattern = r"segment_\d+_(\d+)-(\d{2}_\d+)_(\d+)-(\d{2}_\d+)"
    part = lambda i: F.replace(F.nullif(F.regexp_extract(name, pattern, i), F.lit("")), F.lit("_"), F.lit(".")).cast("double")
    return F.struct((part(1) * 60 + part(2)).alias("start"), (part(3) * 60 + part(4)).alias("end"))


def iso_instant(text: Column) -> Column:
    """Instant of an ISO time; Z and offsets are read, UTC is assumed without one, null if it is none."""
    t = F.regexp_replace(F.trim(text), "[zZ]$", "+00:00")
    return F.try_to_timestamp(F.when(t.rlike(r"[+-]\d{2}:\d{2}$"), t).otherwise(F.concat(t, F.lit("+00:00"))))


def parse_api(text: Column) -> Column:
    """Two or three parts of any fractions, or a number; negative and infinite times are rejected."""
    t = F.trim(text)
    parts = F.split(F.replace(t, F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    made = F.when(n == 1, _number(t)).when((n == 2) | (n == 3), _clock(parts, _FLOAT))
    return F.when(made >= 0, made)


def parse_web(text: Column) -> Column:
    """As the service's, but an empty part counts as 0 and only the first comma is a point; other numbers of parts must be a bare number."""
    number = lambda x: F.when(F.trim(x) == "", F.lit(0.0)).otherwise(_number(x))
    parts = F.split(F.regexp_replace(F.trim(text), "^([^,]*),", "$1."), ":")
    n, p = F.size(parts), lambda i: number(F.get(parts, F.lit(i)))
    made = F.when(n == 2, p(0) * 60 + p(1)).when(n == 3, p(0) * 3600 + p(1) * 60 + p(2)).otherwise(number(text))
    return F.when(made >= 0, made)


def _two(c: Column) -> Column:
    return F.lpad(c.cast("long").cast("string"), 2, "0")


def checker_time(seconds: Column) -> Column:
    """[HH:]MM:SS.cc of a double, negative ones as 0; hours only if there are any."""
    cs = F.greatest(F.lit(0).cast("long"), centiseconds(seconds))
    return F.when(seconds.isNotNull(), hms(cs))


def tenths_time(tenths: Column) -> Column:
    """HH:MM:SS.t of whole tenths."""
    s = F.floor(tenths / 10)
    return F.concat(F.lpad(F.floor(s / 3600).cast("string"), F.greatest(F.lit(2), F.length(F.floor(s / 3600).cast("string"))), F.lit("0")), F.lit(":"), _two(F.pmod(F.floor(s / 60), F.lit(60))), F.lit(":"), _two(F.pmod(s, F.lit(60))), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def position(seconds: Column) -> Column:
    """HH:MM:SS.t of a double, tenths half up; '-' for none."""
    return F.coalesce(tenths_time(F.floor(seconds * 10 + 0.5)), F.lit("-"))


def duration(seconds: Column) -> Column:
    """MM:SS.t of a double, minutes above 59 too; '-' for none."""
    t = F.floor(seconds * 10 + 0.5)
    m = F.floor(t / 600).cast("string")
    return F.coalesce(F.concat(F.lpad(m, F.greatest(F.lit(2), F.length(m)), F.lit("0")), F.lit(":"), _two(F.pmod(F.floor(t / 10), F.lit(60))), F.lit("."), F.pmod(t, F.lit(10)).cast("string")), F.lit("-"))


def short_seconds(seconds: Column) -> Column:
    """M:SS.t from a minute on, else S.ts; '-' for none."""
    m = F.floor(seconds / 60)
    rest = F.round((seconds - m * 60).cast("string").cast("decimal(20,9)"), 1).cast("decimal(10,1)").cast("string")
    return F.coalesce(F.when(m > 0, F.concat(m.cast("string"), F.lit(":"), F.lpad(rest, 4, "0"))).otherwise(F.concat(rest, F.lit("s"))), F.lit("-"))


def run_stamp(project: Column, job: Column, at: Column) -> Column:
    """project-P-job-J-yyyyMMddTHHmmssZ of a timestamp without zone, taken as UTC."""
    return F.concat(F.lit("project-"), project.cast("string"), F.lit("-job-"), job.cast("string"), F.lit("-"), F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"))
