"""Context of sessions: the nearest folder above a working folder that holds a mark, and the files there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import absolute_paths, cleaned_path

# Names that make a folder a root of context; the first two are documents of instructions.
MARKS = ["AGENTS.md", "CLAUDE.md", ".git", ".evolve"]
INSTRUCTIONS = MARKS[:2]


def ancestors(folder: Column) -> Column:
    """depth and folder of a folder and of all above it; / is the last."""
    parts = F.split(F.regexp_replace(folder, "/+$", ""), "/")
    above = lambda n: F.struct(n.alias("depth"), F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("folder"))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), above)


def context_roots(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """trace_id, cwd, root of each working folder of a session: the longest marked folder that holds it, else itself; null for a null one.

    sessions: trace_id, cwd; files: folder, name. Each different folder is looked up once, in
    an equality join of its ancestors with the marked folders, and the deepest match counts.
    """
    marked = files.filter(F.col("name").isin(*MARKS)).select("folder").distinct()
    folders = sessions.filter("cwd is not null").select("cwd").distinct()
    above = folders.select("cwd", F.inline(ancestors(F.col("cwd"))))
    best = above.join(marked, "folder").groupBy("cwd").agg(F.max_by("folder", "depth").alias("marked"))
    return sessions.select("trace_id", "cwd").distinct().join(best, "cwd", "left").select("trace_id", "cwd", F.coalesce("marked", "cwd").alias("root"))


def context_index(roots: DataFrame, files: DataFrame) -> DataFrame:
    """root, sessions, files, instruction_docs of each root of context_roots()."""
    own = roots.filter("root is not null").groupBy("root").agg(F.countDistinct("trace_id").alias("sessions"))
    there = files.groupBy(F.col("folder").alias("root")).agg(F.count("*").alias("files"), F.count_if(F.col("name").isin(*INSTRUCTIONS)).alias("instruction_docs"))
    none = F.lit(0).cast("long")
    return own.join(there, "root", "left").select("root", "sessions", F.coalesce("files", none).alias("files"), F.coalesce("instruction_docs", none).alias("instruction_docs"))


# How much a path says for a repository, by where it was told.
WEIGHTS = {"none": 0, "span-path": 5, "ref-cwd": 50, "repaired-cwd": 90, "span-workdir": 100}


def repo_paths(texts: DataFrame) -> DataFrame:
    """trace_id, source, path: the different paths of texts (trace_id, source, text). A message may name several, a folder is one itself."""
    paths = F.when(F.col("source") == "span-path", absolute_paths("text")).otherwise(F.array(cleaned_path(F.col("text"))))
    return texts.select("trace_id", "source", F.explode(paths).alias("path")).filter(F.col("path").startswith("/")).distinct()


def best_repos(paths: DataFrame, files: DataFrame) -> DataFrame:
    """trace_id, repo, score: of the repositories (deepest folder with .git) that hold a session's paths the one that they say most for, ties to the first by name."""
    marked = files.filter("name = '.git'").select("folder").distinct()
    above = paths.select("path").distinct().select("path", F.inline(ancestors(F.col("path"))))
    repo = above.join(marked, "folder").groupBy("path").agg(F.max_by("folder", "depth").alias("repo"))
    weight = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), F.col("source")), F.lit(0))
    scores = paths.join(repo, "path").groupBy("trace_id", "repo").agg(F.sum(weight).cast("long").alias("score"))
    best = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.desc("score"), "repo"))
    return scores.withColumn("best", best).filter("best = 1").select("trace_id", "repo", "score")
