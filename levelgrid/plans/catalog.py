"""Projects, revisions and job state as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from levelgrid.functions.numbering import running
from levelgrid.session import settle

KEEP = 20
RECENT = 10
EXPIRY_S = 600


def apply_saves(current: DataFrame, saves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts) of compare-and-set saves in order of arrival.

    `current` has plan_id, revision; `saves` has plan_id, save_id, ts, if_match.
    The first save whose if_match is the current revision is accepted and makes
    the next one; later saves are judged against that. An accepted save is
    followed by the first later one that matches the revision it made, so saves
    form chains; doubling finds those on the chain of the current revision in
    rounds that grow with the logarithm of its length. A conflict carries the
    revision that the save met (NULL for a plan that is not known).
    """
    keyed = settle(saves.select("plan_id", F.struct("ts", "save_id").alias("at"), F.col("if_match").cast("bigint").alias("if_match")))
    base = current.select("plan_id", F.col("revision").cast("bigint").alias("revision"))
    # Who waits for a revision, and who would make the next one from it.
    kind = keyed.schema["at"].dataType
    targets = keyed.select("plan_id", F.col("if_match").alias("rev"), "at", F.col("at").alias("offer"), F.lit(False).alias("asks"))
    asking = keyed.select("plan_id", (F.col("if_match") + 1).alias("rev"), "at", F.lit(None).cast(kind).alias("offer"), F.lit(True).alias("asks"))
    heads = base.select("plan_id", F.col("revision").alias("rev"), F.lit(None).cast(kind).alias("at"), F.lit(None).cast(kind).alias("offer"), F.lit(True).alias("asks"))
    met = settle(running(targets.unionByName(asking).unionByName(heads), ["plan_id", "rev"], "at", "offer", "nxt", ahead=True).filter("asks and nxt is not null"))
    jumps = [met.filter("at is not null").select("plan_id", "at", "nxt")]
    while not jumps[-1].isEmpty():
        far = jumps[-1].select("plan_id", F.col("at").alias("nxt"), F.col("nxt").alias("far"))
        jumps.append(settle(jumps[-1].join(far, ["plan_id", "nxt"]).select("plan_id", "at", F.col("far").alias("nxt"))))
    taken = settle(met.filter("at is null").select("plan_id", F.col("nxt").alias("at")))
    for jump in reversed(jumps[:-1]):
        taken = settle(taken.unionByName(taken.join(jump, ["plan_id", "at"]).select("plan_id", F.col("nxt").alias("at"))))
    judged = keyed.join(taken.withColumn("ok", F.lit(True)), ["plan_id", "at"], "left")
    judged = judged.withColumn("made", F.when(F.col("ok"), F.col("if_match") + 1))
    judged = settle(running(judged, ["plan_id"], "at", "made", "before"))
    accepted = judged.filter("ok").select("plan_id", "at.save_id", F.col("made").alias("revision"))
    lost = judged.filter("ok is null").join(base, "plan_id", "left")
    met_revision = F.coalesce("before", "revision").alias("current_revision")
    return accepted, lost.select("plan_id", "at.save_id", "if_match", met_revision)


def retain_revisions(revisions: DataFrame, keep: int = KEEP, key: str = "project_id") -> DataFrame:
    """The newest revisions of every project.

    Spark limits a ranked window before the shuffle (top rows per task and
    key), so a project with very many revisions is not gathered whole.
    """
    w = W.partitionBy(key).orderBy(F.col("revision").desc())
    return revisions.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def recent_projects(touches: DataFrame, projects: DataFrame, top: int = RECENT) -> DataFrame:
    """The last touched projects that still exist, most recent first."""
    last = touches.groupBy("project_id").agg(F.max("ts").alias("ts"))
    return last.join(projects.select("project_id").distinct(), "project_id", "left_semi").orderBy(F.col("ts").desc(), "project_id").limit(top)


def latest_by_source(projects: DataFrame) -> DataFrame:
    """Newest project of every external file version that still has its source."""
    kept = projects.filter("has_source and file_id is not null and version_id is not null")
    return kept.groupBy("file_id", "version_id").agg(
        F.max_by("project_id", F.struct("created_at", "project_id")).alias("project_id"), F.max("created_at").alias("created_at")
    )


def describe(projects: DataFrame, plans: DataFrame) -> DataFrame:
    """Project metadata with revision and storey summaries; `plans` is keyed by plan_id."""
    summary = plans.select(
        F.col("plan_id").alias("project_id"), "revision",
        F.transform("levels", lambda v: F.struct(v["id"].alias("id"), v["name"].alias("name"), v["elevation"].alias("elevation"))).alias("levels"),
    )
    return projects.join(summary, "project_id")


def strip_legacy_shells(plans: DataFrame) -> DataFrame:
    """Old empty import shells (they carry issues) lose their levels and issues."""
    lists = ["vertices", "walls", "openings", "columns", "stairs", "rooms", "separators", "fixtures", "texts", "dimensions"]
    empty = F.forall("levels", lambda v: sum((F.coalesce(F.size(v[n]), F.lit(0)) for n in lists), F.lit(0)) == 0)
    shell = F.coalesce(
        (F.col("detection.source.format") == "glb") & (F.size("levels") > 0) & (F.size("detection.issues") > 0) & empty, F.lit(False)
    )
    none = lambda c: F.slice(c, F.lit(1), F.lit(0))
    return plans.withColumns(
        {
            "levels": F.when(shell, none(F.col("levels"))).otherwise(F.col("levels")),
            "detection": F.when(shell, F.struct(F.col("detection.source").alias("source"), none(F.col("detection.issues")).alias("issues"))).otherwise(F.col("detection")),
        }
    )


def import_status(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """State shown for every project; `jobs` has project_id, state, progress, error, `live` has
    project_id, job_id. A running job that is not alive was interrupted."""
    m = jobs.join(live, "project_id", "left")
    alive = F.col("job_id").isNotNull()
    cut = (F.col("state") == "running") & ~alive
    known = F.col("state").isin("running", "done", "error", "cancelled")
    state = F.when(cut, "error").when(F.coalesce(known, F.lit(False)), F.col("state")).when(alive, "running").otherwise("none")
    error = F.when(cut, "The import was interrupted.").when(F.coalesce(known, F.lit(False)), F.coalesce("error", F.lit(""))).otherwise("")
    return m.select(
        "project_id", state.alias("import_state"), error.alias("import_error"), F.when(state == "running", F.col("job_id")).alias("job_id"),
        F.coalesce("progress", F.lit(0)).alias("import_progress"),
    )


def active_runs(runs: DataFrame, now) -> DataFrame:
    """Runs that are not expired, one running per project (the first to start).

    `runs` has run_id, project_id, state, started, finished (timestamps).
    """
    now = F.lit(now).cast("timestamp")
    age = now.cast("double") - F.col("finished").cast("timestamp").cast("double")
    fresh = runs.filter(~F.coalesce((F.col("state") == "done") & (age > EXPIRY_S), F.lit(False)))
    first = fresh.filter("state = 'running'").groupBy("project_id").agg(F.min(F.struct("started", "run_id")).alias("_f"))
    out = fresh.join(first, "project_id", "left")
    return out.filter((F.col("state") != "running") | (F.col("_f.run_id") == F.col("run_id"))).drop("_f")
