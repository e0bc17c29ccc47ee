"""Project store: filters, counts, latest rows, upserts, deletes, pairing of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.operators.scan import scan

ACTIVE = ("queued", "running")


def latest(rows: DataFrame, key: str, *order: str, where: Column | None = None) -> DataFrame:
    """The last row of each key by the columns of ``order``, as one aggregation (no sort of a key's rows)."""
    rows = rows.where(where) if where is not None else rows
    rest = [c for c in rows.columns if c != key and c not in order]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("x")).select(key, "x.*")


def status_counts(jobs: DataFrame) -> DataFrame:
    """(project_id, total, active, completed, failed, cancelled)."""
    one = lambda c, n: F.count_if(c).alias(n)
    s = F.col("status")
    return jobs.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), one(s.isin(*ACTIVE), "active"), one(s == "completed", "completed"), one(s == "failed", "failed"), one(s == "cancelled", "cancelled"))


def status_view(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each project with its latest job, counts, and the latest job's id as error only if that job failed."""
    last = latest(jobs, "project_id", "created_at", "job_id").select("project_id", "job_id", "status")
    made = projects.join(last, "project_id", "left").join(status_counts(jobs), "project_id", "left").na.fill(0, ["total", "active", "completed", "failed", "cancelled"])
    return made.withColumn("error_job", F.when(F.col("status") == "failed", F.col("job_id"))).withColumn("status", F.coalesce("status", F.lit("created")))


def upserted(table: DataFrame, incoming: DataFrame, key: str, columns: list[str], guard: Column | None = None, guarded: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``incoming`` merged: new keys added, given columns replaced, ``guarded`` ones only where ``guard`` (over t.*) holds.

    order: columns of ``incoming`` that tell which of the rows of one key is the last, the one that
    counts; without them the greatest row does. Null keys are left out of ``incoming``.
    """
    incoming = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in columns])
    t, i = table.alias("t"), incoming.alias("i")
    both = t.join(i, F.col(f"t.{key}") == F.col(f"i.{key}"), "full")
    mine, theirs = F.col(f"t.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()

    def value(c):
        free = theirs & ((~mine | guard) if c in guarded and guard is not None else F.lit(True))
        return F.when(free, F.col(f"i.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return both.select(F.coalesce(f"t.{key}", f"i.{key}").alias(key), *[value(c) for c in columns])


def sparse_update(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns c replaced where changes has set_c; a null that is set differs from one that is not given."""
    both = table.alias("t").join(changes.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "left")
    return both.select(F.col(f"t.{key}").alias(key), *[F.when(F.coalesce(f"u.set_{c}", F.lit(False)), F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in columns])


def cascaded(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not deleted."""
    return child.join(gone.select(key), key, "left_anti")


def nulled(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Children with the reference to a deleted parent set to null."""
    g = gone.select(F.col(key).alias("__gone")).distinct()
    return child.join(g, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def export_pairs(artifacts: DataFrame, reach_s: int = 60) -> DataFrame:
    """(project_id, pair, raw_id, subtitled_id): raw and subtitled outputs of one attempt.

    Newest first, an output joins the pair before it if that lacks its kind and is within reach of
    it; a pair takes two at most, so the fold must remember the open pair. Within a project.
    """
    order = F.struct((-F.col("at_s")).alias("n"), (-F.col("artifact_id")).alias("a"), F.col("artifact_type").alias("k"))
    made = artifacts.groupBy("project_id").agg(F.array_sort(F.collect_list(order)).alias("s"))
    fits = f"a.open and a.kind <> s[i].k and s[i].n - a.n <= {reach_s}"
    state = {"k": ("-1", "if(z, a.k, a.k + 1)"), "open": ("false", "not z"), "n": ("0L", "s[i].n"), "kind": ("''", "s[i].k")}
    fold = scan("s", "int", "if(z, a.k, a.k + 1)", state, fits)
    rows = made.withColumn("g", F.expr(fold)).select("project_id", F.posexplode_outer(F.arrays_zip("s", "g")).alias("i", "x")).where("x is not null")
    out = rows.groupBy("project_id", F.col("x.g").cast("long").alias("pair")).agg(F.max(F.when(F.col("x.s.k") == "raw", -F.col("x.s.a"))).alias("raw_id"), F.max(F.when(F.col("x.s.k") == "subtitled", -F.col("x.s.a"))).alias("subtitled_id"))
    return out


def folded_state(events: DataFrame) -> DataFrame:
    """(project_id, state, progress, n) of (project_id, seq, event, progress): what a project's events add up to.

    A cancel absorbs all after it; a finish counts only if no later event reopens; progress never
    falls. Batch twin of ``spanloom.streaming.events.project_states``.
    """
    cancel = F.min(F.when(F.col("event") == "cancelled", F.col("seq"))).over(Window.partitionBy("project_id"))
    live = events.withColumn("cancel", cancel).where("cancel is null or seq <= cancel")
    return live.groupBy("project_id").agg(F.max(F.struct("seq", "event")).alias("x"), F.max("progress").alias("progress"), F.count(F.lit(1)).alias("n")).select("project_id", F.col("x.event").alias("state"), "progress", "n")


def appended(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` and ``rows``; running it raises if a key occurs twice."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    both = table.unionByName(rows, allowMissingColumns=True).withColumn("__n", n)
    return both.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)).drop("__n")


def transitioned(jobs: DataFrame, changes: DataFrame, key: str = "job_id", expected: tuple[str, ...] = ACTIVE) -> DataFrame:
    """``jobs`` with the status of ``changes`` (key, status) where it is an expected one and no cancel is asked for, and changed; its count is the number of rows updated."""
    c = changes.select(key, F.col("status").alias("__new"))
    made = jobs.join(c, key, "left")
    hit = F.coalesce(F.col("__new").isNotNull() & F.col("status").isin(*expected) & ~F.coalesce("cancel_requested", F.lit(False)), F.lit(False))
    return made.withColumn("changed", hit).withColumn("status", F.when(F.col("changed"), F.col("__new")).otherwise(F.col("status"))).drop("__new")


def bounds_set(clips: DataFrame, changes: DataFrame, errors) -> DataFrame:
    """``clips`` with the bounds of ``changes`` (doc_id, new_start_cs, new_end_cs) and boundary_source 'user' where ``errors(start, end)`` is ''; the errors stay beside the others."""
    made = clips.join(changes, "doc_id", "left")
    asked = F.col("new_start_cs").isNotNull() & F.col("new_end_cs").isNotNull()
    made = made.withColumn("errors", F.when(asked, errors(F.col("new_start_cs"), F.col("new_end_cs"))).otherwise(""))
    ok = asked & (F.col("errors") == "")
    pick = lambda new, old: F.when(ok, new).otherwise(F.col(old)).alias(old)
    rest = [c for c in clips.columns if c not in ("start_cs", "end_cs", "boundary_source")]
    return made.select(*rest, pick(F.col("new_start_cs"), "start_cs"), pick(F.col("new_end_cs"), "end_cs"), pick(F.lit("user"), "boundary_source"), "errors")


def statuses_set(clips: DataFrame, changes: DataFrame, key: str = "doc_id", allowed: tuple[str, ...] = ("draft", "accepted", "rejected")) -> DataFrame:
    """``clips`` with the statuses of ``changes`` (key, status) that are allowed, whatever their case; rejected is true where one is not."""
    want = F.lower(F.trim("__new"))
    made = clips.join(changes.select(key, F.col("status").alias("__new")), key, "left")
    return made.withColumn("status", F.when(want.isin(*allowed), want).otherwise(F.col("status"))).withColumn("rejected", F.coalesce(~want.isin(*allowed), F.lit(False))).drop("__new")


def renders_recorded(clips: DataFrame, results: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(clips with render_status and outputs of ``results``, artifact rows (key, artifact_type, path)).

    results: key, status, raw_outputs, subtitled_outputs. A result without a status is completed.
    """
    r = results.select(key, F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("completed")).alias("__s"), *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("raw_outputs", "subtitled_outputs")])
    made = clips.join(r, key, "left").withColumn("render_status", F.coalesce("__s", "render_status")).drop("__s")
    one = lambda c, t: r.select(key, F.lit(t).alias("artifact_type"), F.explode(c).alias("path"))
    return made, one("raw_outputs", "raw").unionByName(one("subtitled_outputs", "subtitled"))


def orphans_failed(jobs: DataFrame, workers: DataFrame) -> DataFrame:
    """``jobs`` with the active ones of projects without a worker (project_id) failed, and recovered."""
    w = workers.select("project_id").distinct().withColumn("__w", F.lit(True))
    made = jobs.join(w, "project_id", "left").withColumn("recovered", F.col("status").isin(*ACTIVE) & F.col("__w").isNull() & ~F.coalesce("cancel_requested", F.lit(False))).drop("__w")
    return made.withColumn("status", F.when(F.col("recovered"), "failed").otherwise(F.col("status")))


#: States of a task in the order in which one stands for its run.
TASK_STATES = ("up_for_retry", "restarting", "up_for_reschedule", "running", "failed", "queued", "scheduled")


def current_task(tasks: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, task, state) of (run, ordinal, task, state): the first task by the states' order, else the last that succeeded; runs with neither have nulls."""
    rank = F.array_position(F.array(*map(F.lit, TASK_STATES)), F.col("state"))
    first = F.min(F.when(rank > 0, F.struct(rank.alias("r"), "ordinal", "task", "state")))
    last = F.max(F.when(F.col("state") == "success", F.struct("ordinal", "task", "state")))
    made = tasks.groupBy(run).agg(first.alias("a"), last.alias("z"))
    return made.select(run, F.coalesce("a.task", "z.task").alias("task"), F.coalesce("a.state", "z.state").alias("state"))


def reconciled(jobs: DataFrame, runs: DataFrame, baselines: dict[str, float]) -> DataFrame:
    """(job_id, status, stage, progress) of jobs after a look at their runs.

    jobs: job_id, status, stage, progress, cancel_requested; runs: job_id, run_state, task_stage
    (null without a task), task_state, try_number, max_tries. Cancelled jobs stay; a success is
    ready at 100; a failed run, or a task that failed beyond its tries, fails the job at its stage;
    otherwise it runs if the run does or a task is known, and progress never falls below its own or
    the stage's baseline.
    """
    table = F.create_map(*[F.lit(x) for kv in baselines.items() for x in kv])
    r = jobs.join(runs, "job_id", "left")
    stage = F.coalesce("task_stage", F.lit("waiting"))
    spent = F.coalesce((F.col("task_state") == "failed") & (F.col("try_number") > F.col("max_tries")), F.lit(False))
    still = F.coalesce("cancel_requested", F.lit(False)) | (F.col("status") == "cancelled") | F.col("run_state").isNull()
    gone, won, lost = F.col("run_state").isin("cancelled", "canceled"), F.col("run_state") == "success", (F.col("run_state") == "failed") | spent
    own = F.coalesce("progress", F.lit(0.0))
    status = F.when(still, F.col("status")).when(gone, "cancelled").when(won, "completed").when(lost, "failed").when((F.col("run_state") == "running") | F.col("task_stage").isNotNull(), "running").otherwise("queued")
    return r.select(
        "job_id", status.alias("status"), F.when(still, F.col("stage")).when(gone, "cancelled").when(won, "ready").otherwise(stage).alias("stage"),
        F.when(still | gone, own).when(won, 100.0).when(lost, own).otherwise(F.greatest(own, F.coalesce(F.try_element_at(table, stage), F.lit(0.0)))).alias("progress"),
    )


# How often a stage is tried again.
RETRIES = {"prepare_workspace": 0, "download_source": 1, "detect_heatmap_peaks": 1, "transcribe": 1, "validate_transcript": 0, "generate_candidates": 1, "import_candidates": 2, "review_boundaries": 0, "mark_ready": 1}


def after_failure(task: Column, attempt: Column) -> Column:
    """What follows a failed attempt (from 1) of a task: 'retrying' while its budget lasts, else 'failed'."""
    table = F.create_map(*[F.lit(x) for kv in RETRIES.items() for x in kv])
    return F.when(attempt < F.coalesce(F.try_element_at(table, task), F.lit(0)) + 1, "retrying").otherwise("failed")


def overdue(jobs: DataFrame, now: Column, limits: dict[str, int], default: int) -> DataFrame:
    """``jobs`` (kind, started, status) with timed_out: running for more seconds than their kind may."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    limit = F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(default))
    return jobs.withColumn("timed_out", F.coalesce((F.col("status") == "running") & (F.timestamp_diff("SECOND", F.col("started"), now) > limit), F.lit(False)))


def adjustments_logged(log: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, entries): each log's adjustments by segment_index, those of ``entries`` in place of older ones, sorted.

    log and entries: key, segment_index and the same further columns; of an index that ``entries``
    has twice the greatest row counts. A missing index sorts as 0.
    """
    rest = [c for c in log.columns if c not in (key, "segment_index")]
    row = F.struct(F.coalesce("segment_index", F.lit(0)).alias("at"), "segment_index", *rest)
    both = log.select(key, "segment_index", row.alias("r"), F.lit(0).alias("g")).unionByName(entries.select(key, "segment_index", row.alias("r"), F.lit(1).alias("g")))
    last = both.groupBy(key, "segment_index").agg(F.max(F.struct("g", "r")).alias("x"))
    return last.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x.r")), lambda x: F.struct(x["segment_index"].alias("segment_index"), *[x[c].alias(c) for c in rest])).alias("entries"))


def exports(artifacts: DataFrame, present: DataFrame, parents: DataFrame, types: tuple[str, ...], key: str = "artifact_id", parent: str = "project_id") -> DataFrame:
    """Artifacts of the types that are present, with what their parent has; an artifact without a parent stays."""
    return artifacts.where(F.col("artifact_type").isin(*types)).join(present.select(key), key, "left_semi").join(parents, parent, "left")


def key_sets_compared(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two frames has, 'missing' from found or 'unexpected' there."""
    k, f = known.select(key).distinct(), found.select(key).distinct()
    return k.join(f, key, "left_anti").select(key, F.lit("missing").alias("side")).unionByName(f.join(k, key, "left_anti").select(key, F.lit("unexpected").alias("side")))


# Columns that name paths and are not shown.
PATHS = ("workspace_path", "source_video_path", "transcript_path", "candidate_source_path", "raw_outputs", "subtitled_outputs", "last_render_output_dir", "output_dir", "windows_file", "cutting_log", "logs")


def public(rows: DataFrame, paths: tuple[str, ...] = PATHS) -> DataFrame:
    """``rows`` without the columns that name paths."""
    return rows.drop(*[c for c in rows.columns if c in paths])


def with_children(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """``parents`` with the number of rows of each child frame that refer to it, under the child's name."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return out.na.fill(0, list(children))


def preferred(artifacts: DataFrame, key: str, order: tuple[str, ...] = ("subtitled", "raw")) -> DataFrame:
    """(key, artifact_id, artifact_type): of each key's artifacts the first of the preferred types, else any; the newest, then the greatest id, of equals."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("artifact_type"))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    best = F.min(F.struct(rank.alias("r"), (-F.col("at_s")).alias("t"), (-F.col("artifact_id")).alias("i"), "artifact_type"))
    return artifacts.groupBy(key).agg(best.alias("x")).select(key, (-F.col("x.i")).alias("artifact_id"), F.col("x.artifact_type").alias("artifact_type"))


def newest(artifacts: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest artifacts (a report), by time, then id."""
    return artifacts.orderBy(F.desc("at_s"), F.desc("artifact_id")).limit(most)
