"""Text functions over transcripts: tokens, scores, labels, repairs, redaction, classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
PROFANITY = ("cholera", "fuck", "ja pierdole", "jebac", "jebie", "jprdl", "kurde", "kurwa", "pierdole", "wtf")
EMPHASIS = ("ale", "czemu", "jak", "look", "nice", "patrz", "serio", "teraz", "uwaga", "what", "wow")
CONNECTORS = ("a", "ale", "and", "bo", "but", "czy", "do", "i", "lub", "na", "o", "od", "or", "u", "w", "z", "za", "że")
NAMES = ("adam", "ania", "bartek", "dawid", "ewa", "jan", "kamil", "kasia", "maciek", "marek", "michal", "michał", "olaf", "pawel", "paweł", "piotr", "tomek")
WORD = r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*"
CHECKER_WORD = "[0-9A-Za-zÀ-žąćęłńóśźżĄĆĘŁŃÓŚŹŻ]+"
ARTIFACT = r"(?iu)(```|^\s*json\b|transkrypcj[aię]|nie mogę|nie jestem w stanie|brak dźwięku|w załączonym audio)"
STRONG = r"[.!?…][\"'”’)]*$"
SOFT = r"[,;:][\"'”’)]*$"
MID_THOUGHT = ("and", "but", "so", "because", "ale", "bo", "wiec", "czyli")
UNFINISHED = ("and", "but", "because", "so", "ale", "bo", "wiec")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once, however often ``f`` uses it: inside lambdas Spark evaluates every use again."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def compact(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({pattern})"), 1)


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def importance(text: Column, seconds: Column) -> Column:
    """1 to 5, from 3: swearing (as substrings), exclamations, emphasis (as tokens), brevity; less for long monologues."""
    t = compact(text)
    low, n = F.lower(t), F.size(tokens(t))
    one = lambda c: F.when(c, 1).otherwise(0)
    swears = one(F.greatest(*[F.contains(low, F.lit(w)) for w in PROFANITY]))
    score = 3 + swears + one((_count(t, "!") >= 1) | (_count(t, "?") >= 2)) + one(F.arrays_overlap(tokens(t), F.array(*map(F.lit, EMPHASIS)))) + one((seconds > 0) & (seconds <= 2) & (n <= 6)) - one((n >= 22) & (seconds > 9))
    return F.when(t == "", 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), score)))


def chaos(text: Column, seconds: Column, confidence: Column | None = None) -> Column:
    """Fast or slashed speech, or an unsure speaker."""
    t = compact(text)
    fast = F.size(tokens(t)) / F.greatest(seconds, F.lit(0.01)) >= 4.8
    unsure = F.coalesce(confidence < 0.55, F.lit(False)) if confidence is not None else F.lit(False)
    return F.when((t == "") | (seconds <= 0), False).otherwise(unsure | fast | (_count(t, "/") >= 2))


def speaker_label(raw: Column) -> Column:
    """'Speaker n' by the first number, or by the letter after 'speaker '; other names are kept behind 'Speaker '."""
    t = F.trim(F.coalesce(raw, F.lit("")))
    number = F.regexp_extract(t, r"(\d+)", 1)
    letter = F.upper(F.regexp_extract(t, r"(?i)^speaker (?:.*\s)?([A-Za-z])$", 1))
    return (
        F.when(t == "", "Speaker 0")
        .when(number != "", F.concat(F.lit("Speaker "), F.regexp_replace(number, r"^0+(?=\d)", "")))
        .when(letter != "", F.concat(F.lit("Speaker "), (F.ascii(letter) - 65).cast("string")))
        .otherwise(F.concat(F.lit("Speaker "), t))
    )


def subtitle_text(text: Column, capitalize: bool = False) -> Column:
    """White space, ranges, spacing around signs; the first letter raised if asked for."""
    t = compact(text)
    for pattern, new in (
        (r"(?<=\d)\s+-\s+(?=\d)", "–"), (r"\s+([,.;:!?%…])", "$1"), (r"([(\[{„“])\s+", "$1"),
        (r"\s+([)\]}”])", "$1"), (r"([,;:!?])(?=\p{L})", "$1 "), (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, new)
    t = F.trim(t)
    if not capitalize:
        return t

    def raised(t):
        head = F.regexp_extract(t, r"^([^\p{L}]*)\p{L}", 1)
        at = F.length(head) + 1
        return F.when(t.rlike(r"\p{L}"), F.concat(head, F.upper(F.substring(t, at, F.lit(1))), F.substring(t, at + 1, F.length(t)))).otherwise(t)

    return bound(t, raised)


def is_connector(word: Column) -> Column:
    return F.lower(F.btrim(word, F.lit(".,;:!?…\"'„“”’()[]{}"))).isin(*CONNECTORS)


def wrapped(text: Column, width: int = 24) -> Column:
    """Two lines at the cheapest split: 20 per character of overflow, 12 for a connector at the line's end, and the imbalance."""
    none = F.lit(None).cast("struct<cost:int,left:int>")

    def cheapest(s):
        """The least (cost, length of the first line) of all splits, in one walk over the words that holds numbers only."""

        def step(a, word):
            i, left = a["i"] + 1, a["left"] + 1 + F.length(word)
            right, joins = s["chars"] - 1 - left, is_connector(word)
            lone = ((i == 1) & joins) | ((i == s["n"] - 1) & s["last_joins"])
            cost = 20 * (F.greatest(F.lit(0), left - width) + F.greatest(F.lit(0), right - width)) + F.when(joins, 12).otherwise(0) + F.abs(left - right)
            best = F.least(a["best"], F.when((i < s["n"]) & ~lone, F.struct(cost.alias("cost"), left.alias("left"))))
            return F.struct(i.alias("i"), left.alias("left"), best.alias("best"))

        start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("left"), none.alias("best"))
        return F.aggregate(s["words"], start, step, lambda a: a["best"])

    def cut(s):
        at = lambda best: F.concat(F.substring(s["t"], F.lit(1), best["left"]), F.lit("\n"), F.substring(s["t"], best["left"] + 2, s["chars"]))
        whole = F.when((s["n"] > 1) & (s["chars"] > width), bound(cheapest(s), at))
        return F.coalesce(whole, s["t"])

    def parts(t):
        words = F.split(t, " ")
        return F.struct(t.alias("t"), F.length(t).alias("chars"), words.alias("words"), F.size(words).alias("n"), is_connector(F.element_at(words, -1)).alias("last_joins"))

    return bound(bound(subtitle_text(text), parts), cut)


#: Limits of a merged cue: words, characters, characters of one of its two lines.
MOST_WORDS, MOST_CHARS, LINE = 7, 49, 24


def fits_cue(text: Column) -> Column:
    """Whether a text can be one cue: not empty, few enough words and characters, and each of its wrapped lines short enough."""

    def fits(t):
        lines = lambda x: (F.size(x) <= 2) & F.forall(x, lambda y: F.length(y) <= LINE)
        return (t != "") & (F.size(F.split(t, " ")) <= MOST_WORDS) & (F.length(t) <= MOST_CHARS) & bound(F.split(wrapped(t), "\n"), lines)

    return bound(subtitle_text(text), fits)


def subtitle_label(raw: Column) -> Column:
    """A subtitle's speaker: 'Speaker n' for 'speaker' with a number or one letter as the last word, 'Default' for what does not start with 'speaker '."""
    t = F.trim(F.regexp_replace(F.coalesce(F.nullif(raw, F.lit("")), F.lit("Default")), r"(?U)\s+", " "))
    tail = F.substring_index(t, " ", -1)
    label = F.when(tail.rlike(r"^[0-9]+$"), F.concat(F.lit("Speaker "), F.regexp_replace(tail, r"^0+(?=[0-9])", ""))).when(tail.rlike("^[A-Za-z]$"), F.concat(F.lit("Speaker "), (F.ascii(F.upper(tail)) - 65).cast("string"))).otherwise(t)
    return F.when(F.lower(t).startswith("speaker "), label).otherwise("Default")


def without_repeats(text: Column) -> Column:
    """Neighbouring words that are equal but for case and signs, once."""

    def words(t):
        plain = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}_ ]+", ""))
        return F.struct(F.split(t, " ").alias("words"), F.split(plain, " ").alias("plain"))

    def kept(s):
        # A word that goes is equal to the one before it, so the last one kept always has the plain form of the one before.
        at = lambda i: F.get(s["plain"], i)
        return F.array_join(F.filter(s["words"], lambda w, i: (at(i) == "") | ~at(i).eqNullSafe(at(i - 1))), " ")

    return bound(bound(compact(text), words), kept)


def repaired(text: Column) -> Column:
    """(text, fixes): white space, doubled words, first letter, common names, final stop, in this order."""
    before = r"(?iuU)(^|[\s\"'(\[])\b"

    def named(t):
        out = t
        for name in NAMES:
            out = F.regexp_replace(out, rf"{before}{name}\b", f"$1{name.capitalize()}")
        return F.when(t.rlike(rf"{before}(?:{'|'.join(NAMES)})\b"), out).otherwise(t)

    steps = {
        "whitespace": compact,
        "duplicate_words": without_repeats,
        "sentence_capitalization": lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))),
        "name_capitalization": named,
        "terminal_punctuation": lambda t: F.when((t != "") & ~F.right(t, F.lit(1)).isin(".", "!", "?", "…"), F.concat(t, F.lit("."))).otherwise(t),
    }

    texts = F.array(F.coalesce(text, F.lit("")))
    for step in steps.values():
        texts = bound(texts, lambda a: F.array_append(a, bound(F.element_at(a, -1), step)))  # noqa: B023

    def told(a):
        fixes = F.array(*[F.when(F.get(a, F.lit(i)) != F.get(a, F.lit(i + 1)), name) for i, name in enumerate(steps)])
        return F.struct(F.element_at(a, -1).alias("text"), F.filter(fixes, lambda x: x.isNotNull()).alias("fixes"))

    return bound(texts, told)


def redacted(text: Column) -> Column:
    """Secrets in assignments, query strings and bearer headers, replaced."""
    t = F.regexp_replace(text, r"(?i)(gemini_api_key|google_api_key|api[_-]?key|password|secret|token)\s*=\s*([^\s,;]+)", "$1=<redacted>")
    t = F.regexp_replace(t, r"(?i)([?&](?:api[_-]?key|key|token|access_token|signature|sig|authorization)=)([^&\s\"']+)", "$1<redacted>")
    return F.regexp_replace(t, r"(?i)(authorization\s*:\s*bearer\s+)([^\s,;]+)", "$1<redacted>")


# Stages by what a log line contains, first match wins.
STAGE_MARKS = (
    ("generating_candidates", ("analysis-only", "podcast clip analysis", "analiza podcast")),
    ("validating_transcript", ("ai subtitler checker", "subtitle checker", "sprawdzane audio", "validating transcript")),
    ("transcribing", ("transkrypc", "transcrib", "faster-whisper")),
    ("downloading", ("pobier", "download", "yt-dlp")),
    ("generating_candidates", ("podcast profile", "content classifier", "klasyfikacja", "content type")),
    ("importing_candidates", ("importing candidate", "import candidates", "sqlite import")),
    ("reviewing_with_ai", ("gemini review", "reviewing boundaries", "reviewing with ai")),
    ("ready", ("workflow uko", "workflow completed", "ready")),
    ("cancelled", ("cancelled", "anulowano")),
    ("failed", ("unexpected error", "nieoczekiwany", " błąd", " blad", "error")),
)


def log_stage(line: Column) -> Column:
    low = F.lower(F.coalesce(line, F.lit("")))
    out = F.lit(None).cast("string")
    for stage, marks in reversed(STAGE_MARKS):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        out = F.when(hit, stage).otherwise(out)
    return out


def parsed_bool(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "tak", "yes", "1"), True).when(low.isin("false", "nie", "no", "0"), False)


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(compact(text)), r"^([\p{L}\p{N}_]+)", 1)


def starts_mid_thought(text: Column) -> Column:
    return first_word(text).isin(*MID_THOUGHT)


def ends_unfinished(text: Column) -> Column:
    t = compact(text)
    return (t == "") | F.right(t, F.lit(1)).isin(",", ":", ";", "-") | first_word(F.substring_index(t, " ", -1)).isin(*UNFINISHED)


def safe_filename(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def file_size(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(F.round((size / 1024).cast("decimal(20,6)"), 1).cast("string"), F.lit(" KB"))).otherwise(F.concat(F.round((size / 1048576).cast("decimal(20,6)"), 1).cast("string"), F.lit(" MB")))


# Kinds of correction messages by what they contain, first match wins.
CORRECTIONS = (
    ("duration", (("must not exceed",), ("duration", "90"))), ("end", (("end must stay",), ("end after the allowed",))), ("start", (("start must stay",), ("start before the allowed",))),
    ("order", (("reversed",), ("end must be greater",))), ("pair", (("allowed_boundary_pairs",), ("boundary pair",))), ("id", (("unknown",), ("ineligible",))),
)


def correction_kind(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("invalid")
    for kind, ways in reversed(CORRECTIONS):
        hit = F.lit(False)
        for marks in ways:
            both = F.lit(True)
            for m in marks:
                both = both & F.contains(low, F.lit(m))
            hit = hit | both
        out = F.when(hit, kind).otherwise(out)
    return out


def json_object(text: Column) -> Column:
    """The JSON object in free text as a variant, null if there is none: code fences go, then what stands outside the outer braces, then trailing commas."""
    bare = F.trim(F.regexp_replace(text, r"(?s)```(?:json)?\s*(.*?)\s*```", "$1"))
    inner = F.regexp_replace(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), r",\s*([}\]])", "$1")
    return F.coalesce(F.try_parse_json(F.when(bare.startswith("{"), bare)), F.try_parse_json(F.nullif(inner, F.lit(""))))


# Modes and their other spellings.
LAYOUT_MODES = ("auto", "speaker_face_crop")
CHECKER_MODES = {"off": 0, "local_only": 0, "limited": 2, "full": 8}
AI_MODES = ("local_only", "gemini_optional", "gemini_enabled")
SPEAKER_MODES = {"single": "single", "multi": "multi", "single_speaker": "single", "single-speaker": "single", "single speaker": "single", "multi_speaker": "multi", "multi-speaker": "multi", "multiple": "multi", "multiple_speakers": "multi"}


def _low(text: Column, default: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(text, F.lit("")), F.lit(default))))


def layout_mode(text: Column, known: tuple[str, ...] = LAYOUT_MODES) -> Column:
    """A known layout mode; auto for anything else."""
    t = _low(text, "auto")
    return F.when(t.isin(*known), t).otherwise("auto")


def checker_mode(text: Column) -> Column:
    """A known checker mode, local_only if none is given; null for an unknown one."""
    t = _low(text, "local_only")
    return F.when(t.isin(*CHECKER_MODES), t)


def checker_samples(mode: Column, full: int = CHECKER_MODES["full"]) -> Column:
    """How many samples a checker mode listens to."""
    table = F.create_map(*[F.lit(x) for k, n in {**CHECKER_MODES, "full": max(1, full)}.items() for x in (k, n)])
    return F.try_element_at(table, mode)


def ai_mode(text: Column) -> Column:
    """A known mode of outside help, gemini_optional if none is given; null for an unknown one."""
    t = _low(text, "gemini_optional")
    return F.when(t.isin(*AI_MODES), t)


def speaker_mode(text: Column) -> Column:
    """single, multi or unknown, through other spellings."""
    table = F.create_map(*[F.lit(x) for kv in SPEAKER_MODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _low(text, "unknown")), F.lit("unknown"))


# Failure categories and what may be said about them.
FAILURES = {
    "boundary_validation": "Boundary validation failed.", "structured_output": "Structured provider output was invalid.", "provider_output": "Provider response did not contain supported model output.",
    "provider_compatibility": "Provider compatibility error (HTTP 400).", "quota": "Provider quota error (HTTP 429).", "provider_timeout": "Provider request timed out.",
}
_ERRORS = {"BoundaryOptionSelectionError": "boundary_validation", "ReviewProviderExtractionError": "provider_output", "ReviewProviderOutputError": "structured_output", "ReviewProviderCompatibilityError": "provider_compatibility", "ReviewProviderQuotaError": "quota", "ReviewProviderTimeoutError": "provider_timeout"}


def failure_category(error: Column) -> Column:
    """The category of an error's type name; provider for any other."""
    table = F.create_map(*[F.lit(x) for kv in _ERRORS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, error), F.lit("provider"))


def failure_detail(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, category), F.lit("Gemini provider request failed."))


# Labels of states.
STATUS_LABELS = {
    "created": "Created", "queued": "Queued", "running": "Running", "ready": "Ready", "failed": "Failed", "cancelled": "Cancelled", "draft": "Draft", "accepted": "Accepted", "rejected": "Rejected",
    "not_rendered": "Not rendered", "completed": "Rendered", "completed_with_warnings": "Rendered with warnings", "render_ready": "Ready", "adjust_boundaries": "Adjusted", "manual_review": "Manual review",
    "local_stub": "Local stub", "gemini": "Gemini",
}


def status_label(value: Column) -> Column:
    """What a state is called; unknown ones without underscores, none as Unknown."""
    table = F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv])
    return F.when(F.coalesce(value, F.lit("")) == "", "Unknown").otherwise(F.coalesce(F.try_element_at(table, value), F.replace(value, F.lit("_"), F.lit(" "))))


def percent_label(value: Column) -> Column:
    """Whole percent from 0 to 100, half up; 0% for what is no number."""
    v = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.concat(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.coalesce(v, F.lit(0.0)) + 0.5))).cast("string"), F.lit("%"))


def progress_percent(value: Column) -> Column:
    """Progress inside 0 to 100; null stays."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def review_progress(index: Column, total: Column, started: Column) -> Column:
    """Progress of the review, 85 to 95 by the clips that are done; a clip that has only started is not."""
    i, n = F.greatest(F.lit(1), index), F.greatest(F.lit(1), total)
    return 85.0 + (10.0 * F.when(started, i - 1).otherwise(i)) / n


def source_url(text: Column, most: int = 2048) -> Column:
    """A trimmed absolute http or https URL of bounded length; null for anything else."""
    t = F.trim(text)
    return F.when(t.rlike(r"^(?i:https?)://[^/?#\s]") & (F.length(t) <= most), t)


# What is emphasized in subtitles.
KEYWORDS = r"\d+\s*(?:zl|pln|euro|usd|dollar)|\b[A-ZÀ-ŽĄĆĘŁŃÓŚŹŻ][a-zà-žąćęłńóśźż]+\b|(?:wow|super|fantastycz|niesamowit|genialn|straszn|okropn)"


def emphasized(text: Column, style: Column, pattern: str = KEYWORDS, colour: str = "&H0000FF00") -> Column:
    """Words of the pattern in subtitle markup: bold and coloured, then back to the style."""
    return F.regexp_replace(text, F.lit(f"(?iu)({pattern})"), F.concat(F.lit("{\\\\b1\\\\c" + colour + "&}$1{\\\\r"), style, F.lit("}")))


def text_list(value: Column) -> Column:
    """Trimmed texts of a variant that is a list, or of one text; nothing for null."""
    kind = F.schema_of_variant(value)
    one, many = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "array<string>")
    items = F.when(kind.startswith("ARRAY"), many).when(kind == "STRING", F.array(one))
    return F.coalesce(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))


def checked_answer(answer: Column) -> Column:
    """Struct of a model's answer (variant) with its types set right: flags by words, confidence inside 0 to 1, lists of words."""
    get = lambda k: F.try_variant_get(answer, f"$.{k}", "string")
    part = lambda k: F.try_variant_get(answer, f"$.{k}", "variant")
    sure = F.coalesce(get("confidence").try_cast("double"), F.lit(0.0))
    return F.struct(
        parsed_bool(get("matches_audio")).alias("matches_audio"), parsed_bool(get("timing_ok")).alias("timing_ok"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"),
        F.trim(F.coalesce(get("heard_text"), F.lit(""))).alias("heard_text"), text_list(part("hallucinated_words")).alias("hallucinated_words"), text_list(part("missing_words")).alias("missing_words"),
    )


def enums_for_constants(schema: Column) -> Column:
    """A JSON schema's text with every scalar "const" as an "enum" of one value."""
    scalar = r'"const"\s*:\s*("(?:[^"\\\\]|\\\\.)*"|-?\d+(?:\.\d+)?|true|false|null)'
    return F.regexp_replace(schema, scalar, '"enum":[$1]')


def json_string(text: Column) -> Column:
    """A text as it stands between the quotes of an ASCII JSON document: signs escaped, all beyond ASCII as \\uXXXX, surrogates in pairs."""
    four = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def one(c):
        n = F.ascii(c).cast("long")
        high = n - 0x10000
        pair = F.concat(four(F.lit(0xD800).cast("long") + F.shiftright(high, 10)), four(F.lit(0xDC00).cast("long") + high.bitwiseAND(F.lit(0x3FF).cast("long"))))
        out = F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(n == 10, "\\n").when(n == 13, "\\r").when(n == 9, "\\t").when(n == 8, "\\b").when(n == 12, "\\f")
        return out.when(n > 0xFFFF, pair).when((n < 32) | (n > 126), four(n)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


# Names whose values are secrets whatever they are.
SECRET_KEY = r"(?i)(api[_-]?key|password|secret|token|authorization)"


def redacted_metadata(entries: Column) -> Column:
    """A map of texts without secrets: values of secret names, and secrets inside other values."""
    return F.transform_values(entries, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("<redacted>")).otherwise(redacted(v)))
