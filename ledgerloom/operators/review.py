"""Reviews that the engine decides by itself, numeric rechecks, stale versions, evidence and titles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .approvals import approvals as all_approvals
from .folds import P, is_type, kind, last, seq

#: Words in a title that make a task numeric.
NUMERIC_WORDS = ["计算", "统计", "权重", "比率", "胜率", "均值", "检验", "概率", "金额", "算", "汇总", "指标"]


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Whether any of the words is in the text; no words let everything through."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(not words)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def is_numeric(title: Column | str) -> Column:
    title = F.col(title) if isinstance(title, str) else title
    return F.coalesce((title != "") & contains_any(title, NUMERIC_WORDS), F.lit(False))


def parse_verdict(answer: Column | str) -> Column:
    """struct(verdict, note) of a model's answer; CHECK and the answer's beginning if it has none."""
    verdict = F.nullif(F.regexp_extract(answer, r'"verdict"\s*:\s*"([A-Z]+)"', 1), F.lit(""))
    note = F.when(F.rlike(answer, F.lit(r'"note"\s*:\s*"[^"]*"')), F.regexp_extract(answer, r'"note"\s*:\s*"([^"]*)"', 1)).otherwise(F.substring(answer, 1, 160))
    return F.struct(F.coalesce(verdict, F.lit("CHECK")).alias("verdict"), note.alias("note"))


def recheck(log: DataFrame, answers: DataFrame) -> DataFrame:
    """(task_id, verdict, note, checked, idempotency_key) for every task that was created.

    ``answers(task_id, file_ref, answer)`` are what a model said of the deliverables. SKIP for a
    task that is not numeric, NA without a deliverable or an answer on the latest one.
    """
    tasks = log.groupBy("task_id").agg(
        last(P + "title", is_type("task.created")).alias("title"),
        F.max(F.when(is_type("task.created"), seq())).alias("made"),
        last(P + "file_ref", is_type("deliverable.submitted") & (F.coalesce(P + "file_ref", F.lit("")) != "")).alias("file_ref"),
    )
    rows = tasks.where("made IS NOT NULL AND task_id IS NOT NULL").join(answers, ["task_id", "file_ref"], "left").withColumn("p", parse_verdict("answer"))
    numeric, given = is_numeric("title"), F.col("answer").isNotNull()
    verdict = F.when(~numeric, "SKIP").when(F.col("file_ref").isNull() | ~given, "NA").otherwise(F.col("p.verdict"))
    key = F.when(numeric & given, F.concat(F.lit("auto:recheck:"), "task_id", F.lit(":"), "file_ref"))
    return rows.select("task_id", verdict.alias("verdict"), F.when(numeric & given, F.col("p.note")).alias("note"), (numeric & given).alias("checked"), key.alias("idempotency_key"))


def auto_review(log: DataFrame, rechecks: DataFrame | None = None) -> DataFrame:
    """(task_id, review_id, verdict, next_state, idempotency_key): open reviews that need no person.

    Only tasks in review whose latest request is undecided, and whose reviewer, if any, is a
    registered agent. Numeric tasks pass on a recheck that says PASS and are left to people
    otherwise; others pass with a deliverable whose file is there, and go back without one.
    """
    submitted = is_type("deliverable.submitted") & (F.coalesce(P + "file_ref", F.lit("")) != "")
    reviewer = is_type("agent.assigned") & (F.coalesce(P + "role", F.lit("owner")) == "reviewer")
    named = is_type("review.requested") & (F.coalesce(P + "review_id", F.lit("")) != "")
    state = log.where(F.col("task_id").isNotNull()).groupBy("task_id").agg(
        F.coalesce(last(P + "to", is_type("task.state_changed")), F.lit("todo")).alias("status"),
        F.coalesce(last(P + "title", is_type("task.created")), F.lit("")).alias("title"),
        last(P + "agent", reviewer).alias("reviewer"),
        last(F.struct(F.col(P + "file_ref").alias("ref"), F.coalesce(P + "file_missing", F.lit(False)).alias("missing")), submitted).alias("latest"),
        last(P + "review_id", named).alias("review_id"),
    )
    decided = log.where(is_type("review.decided")).select("task_id", F.col(P + "review_id").alias("review_id"))
    agents = log.where(is_type("agent.registered")).select(F.col(P + "name").alias("reviewer"), F.lit(True).alias("builtin")).distinct()
    rows = state.where("status = 'in_review' AND review_id IS NOT NULL").join(decided, ["task_id", "review_id"], "left_anti")
    rows = rows.join(agents, "reviewer", "left").where(F.col("builtin") | (F.coalesce("reviewer", F.lit("")) == ""))
    if rechecks is None:
        rows = rows.withColumn("recheck", F.lit(None).cast("string"))
    else:
        rows = rows.join(rechecks.select("task_id", F.col("verdict").alias("recheck")), "task_id", "left")
    by_rule = F.when(F.col("latest").isNotNull() & ~F.col("latest.missing"), "pass").otherwise("needs_changes")
    verdict = F.when(is_numeric("title"), F.when(F.col("recheck") == "PASS", "pass")).otherwise(by_rule)
    rows = rows.withColumn("verdict", verdict).where("verdict IS NOT NULL")
    next_state = F.when(F.col("verdict") == "pass", "completed").otherwise("in_progress")
    return rows.select("task_id", "review_id", "verdict", next_state.alias("next_state"), F.concat(F.lit("review:dec:"), "review_id").alias("idempotency_key"))


#: Whole numbers of the log that make a block of changes.
CHANGES = 1 << 16
_SIGNED = "task_id string, block long, plain long, at array<long>, to array<long>"


def _map_of(expected: list[int | None]) -> tuple[int, list[int], list[int]]:
    """What a block of changes makes of a version, as a function: by default it adds the changes that expect none.

    Counted from the version at the block's start and without those changes, a guarded change adds
    one if it finds what it expects. Read from the end, each takes what it leads to from those behind it.
    """
    plain, guarded = 0, []
    for e in expected:
        if e is None:
            plain += 1
        else:
            guarded.append(e - plain)
    to: dict[int, int] = {}
    for d in reversed(guarded):
        to[d] = to.get(d + 1, d + 1)
    at = sorted(x for x in to if x >= 0)
    return plain, at, [to[x] for x in at]


_MAP = pa.schema([("task_id", pa.string()), ("block", pa.int64()), ("plain", pa.int64()), ("at", pa.list_(pa.int64())), ("to", pa.list_(pa.int64()))])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The functions of all blocks of a partition, whose rows come in order: one pass, whatever the number of blocks."""
    key, expected = None, []
    for batch in batches:
        out = []
        for now in zip(*(batch.column(c).to_pylist() for c in ("task_id", "block", "expected_version"))):
            if now[:2] != key:
                if key:
                    out.append((*key, *_map_of(expected)))
                key, expected = now[:2], []
            expected.append(now[2])
        yield pa.RecordBatch.from_pylist([dict(zip(_MAP.names, x)) for x in out], schema=_MAP)
    if key:
        yield pa.RecordBatch.from_pylist([dict(zip(_MAP.names, (*key, *_map_of(expected))))], schema=_MAP)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The version at each block's start: a task's maps come in order, and one at a time is looked up."""
    task, version = object(), 0
    for batch in batches:
        out = []
        at, to = (batch.column(c).flatten().to_numpy() for c in ("at", "to"))
        end = 0
        for now, plain, n in zip(*(batch.column(c).to_pylist() for c in ("task_id", "plain", "n"))):
            version = version if now == task else 0
            task = now
            out.append(version)
            i = end + int(np.searchsorted(at[end : end + n], version))
            end += n
            version = (int(to[i]) if i < end and at[i] == version else version) + plain
        yield pa.RecordBatch.from_arrays([batch.column("task_id"), batch.column("block"), pa.array(out, pa.int64())], names=["task_id", "block", "entry"])


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The changes of each block, one after another; a row with the version at its start comes before them."""
    version = 0
    for batch in batches:
        versions, accepted = [], []
        for entry, expected in zip(batch.column("entry").to_pylist(), batch.column("expected_version").to_pylist()):
            if entry is not None:
                version = entry
                continue
            fits = expected is None or expected == version
            versions.append(version)
            accepted.append(fits)
            version += fits
        own = batch.filter(batch.column("entry").is_null())
        cols = [own.column(c) for c in ("task_id", "log_seq", "to", "expected_version")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(versions, pa.int64()), pa.array(accepted, pa.bool_())], names=["task_id", "log_seq", "to", "expected_version", "version", "accepted"])


def versioned(changes: DataFrame, block: int = CHANGES) -> DataFrame:
    """Which of the state changes (task_id, log_seq, to, expected_version) go through, with ``version`` before each.

    A change that expects another version than the task has is refused and leaves the version as it
    is; one that expects none always goes through. Every accepted change counts the version up by
    one, so what a change finds depends on all before it. A block of changes is therefore taken as a
    function of the version at its start; all blocks are read at once, then their functions are
    applied in order, one lookup for each block, and all blocks are replayed at once. Blocks lie in
    order in their partitions, so that very many small ones cost no more than their rows. Tasks without
    a change that expects a version, and changes without a task or a place in the log, are left out.
    """
    rows = changes.select(F.col("task_id").cast("string").alias("task_id"), F.col("log_seq").cast("bigint").alias("log_seq"), "to", F.col("expected_version").cast("bigint").alias("expected_version"))
    has = rows.where("expected_version IS NOT NULL").select("task_id").distinct()
    rows = rows.where("log_seq IS NOT NULL").join(has, "task_id", "left_semi").withColumn("block", F.expr(f"log_seq DIV {block}"))
    parts = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("task_id", "block", "log_seq", "expected_version").repartition(parts, "task_id", "block").sortWithinPartitions("task_id", "block", "log_seq")
    maps = ordered.select("task_id", "block", "expected_version").mapInArrow(_maps, _SIGNED).withColumn("n", F.size("at"))
    entries = maps.repartition(parts, "task_id").sortWithinPartitions("task_id", "block").mapInArrow(_entered, "task_id string, block long, entry long")
    both = rows.withColumn("entry", F.lit(None).cast("bigint")).unionByName(entries, allowMissingColumns=True)
    both = both.repartition(parts, "task_id", "block").sortWithinPartitions("task_id", "block", F.col("entry").isNull(), "log_seq")
    return both.mapInArrow(_replayed, "task_id string, log_seq long, to string, expected_version long, version long, accepted boolean")


def stale_versions(changes: DataFrame) -> DataFrame:
    """The changes that came too late: they expected a version that the task no longer had."""
    return versioned(changes).where(~F.col("accepted")).select("task_id", "log_seq", "expected_version", "version")


def append_only(before: DataFrame, after: DataFrame, key: str = "log_seq") -> DataFrame:
    """(key, change): events of an earlier state of a log that a later one no longer has, or has otherwise."""
    digest = lambda df: F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    old, new = before.select(key, digest(before).alias("old")), after.select(key, digest(after).alias("new"))
    both = old.join(new, key, "left").where(F.col("new").isNull() | (F.col("new") != F.col("old")))
    return both.select(key, F.when(F.col("new").isNull(), "deleted").otherwise("updated").alias("change"))


def last_transfer(log: DataFrame) -> DataFrame:
    """(task_id, agent, log_seq) of each task's last transfer, the one that a new transfer is held against."""
    moved = log.where(is_type("agent.transferred") & F.col("task_id").isNotNull())
    return moved.groupBy("task_id").agg(F.max_by(F.col(P + "agent"), seq()).alias("agent"), F.max("log_seq").alias("log_seq"))


def find_key(log: DataFrame, key: str) -> DataFrame:
    """The first event with an idempotency key; the filter reaches the scan."""
    return log.where(F.col("idempotency_key") == key).orderBy("log_seq").limit(1)


def pending_with_titles(log: DataFrame, signer: str) -> DataFrame:
    """Undecided approvals that list ``signer``, with the titles of their project and task; newest first."""
    titles = lambda event, key, name: log.where(is_type(event)).groupBy(key).agg(F.max_by(P + "title", seq()).alias(name))
    mine = all_approvals(log).where(F.col("decision").isNull() & F.array_contains("signers", signer))
    both = mine.join(titles("project.created", "project_id", "p"), "project_id", "left").join(titles("task.created", "task_id", "t"), "task_id", "left")
    rows = both.select("approval_id", "requested_ts", F.coalesce("p", F.lit("")).alias("project_title"), F.coalesce("t", F.lit("")).alias("task_title"))
    return rows.orderBy(F.desc("requested_ts"), "approval_id")


def resolve_titles(drafts: DataFrame) -> DataFrame:
    """(batch, task_id, depends_on): titles in ``depends_on`` become ids of the same batch.

    Unknown titles and a task's own go; of equal titles the last one counts, as for the task itself.
    ``drafts`` has batch, pos, task_id, title and depends_on.
    """
    ids = drafts.groupBy("batch", "title").agg(F.max_by("task_id", "pos").alias("dep"))
    own = drafts.join(ids.withColumnRenamed("dep", "own"), ["batch", "title"])
    asked = own.select("batch", "pos", "own", F.posexplode_outer("depends_on").alias("k", "title"))
    met = asked.join(ids, ["batch", "title"], "left").withColumn("dep", F.when(F.col("dep") != F.col("own"), F.col("dep")))
    kept = F.array_sort(F.collect_list(F.when(F.col("dep").isNotNull(), F.struct("k", "dep"))))
    return met.groupBy("batch", "pos", F.col("own").alias("task_id")).agg(F.transform(kept, lambda x: x.dep).alias("depends_on"))


def evidence(files: DataFrame) -> DataFrame:
    """Of (file_ref, content): length, first digits of the hash, a preview, and whether the file is missing."""
    there = F.col("content").isNotNull()
    return files.select(
        "file_ref",
        F.length("content").alias("content_len"),
        F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, 16).alias("content_hash"),
        F.substring("content", 1, 500).alias("preview"),
        (~there).alias("file_missing"),
    )


def users_by_name(log: DataFrame) -> DataFrame:
    """Registered users by their last registration, in the order of their names."""
    rows = log.where(kind() == "user.registered").select(F.col("user_id"), F.coalesce(P + "name", "user_id").alias("name"), "log_seq")
    return rows.groupBy("user_id").agg(F.max_by("name", "log_seq").alias("name")).orderBy("name", "user_id")
