"""Version control: commits, changed files, blame and trees, as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from codemill.functions.scalars import safe_git_ref
from codemill.settings import BLAME_COMMITS, BLAME_FILES

#: The fields of a commit and what parts them.
COMMIT_FORMAT = "%H\x1f%h\x1f%an\x1f%ae\x1f%aI\x1f%at\x1f%s\x1f%b"
HEADER = "^[0-9a-f]{40}\x1f"
ENTRY = r"^([0-9a-f]{40}) (\d+) (\d+)(?: (\d+))?$"
COMMIT_SCHEMA = "hash string, abbreviated string, author string, email string, date string, timestamp long, subject string, body string, files array<string>"
CHURN_COMMITS = 5000


def git(repo: str, *args: str) -> str:
    """Output of a git command; ValueError with its message where git fails or the folder is no repository."""
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, errors="replace", check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]} in {repo}: {done.stderr.strip() or 'failed'}")
    return done.stdout


def parse_log(raw: DataFrame) -> DataFrame:
    """repo and the columns of COMMIT_SCHEMA, and n (order in the log), of raw logs (repo, raw) as git log -z writes them.

    A NUL-parted token that begins as a commit starts one, the tokens behind it are its files; the newline that git puts before
    the first of them is not part of it. timestamp is in milliseconds, 0 where it is no number; an empty body is null."""
    tokens = raw.select("repo", F.posexplode(F.split("raw", "\x00")).alias("pos", "token")).where("token <> ''")
    w = Window.partitionBy("repo").orderBy("pos")
    head = F.col("token").rlike(HEADER)
    rows = tokens.withColumn("n", F.sum(head.cast("int")).over(w)).where("n > 0").withColumn("head", head)
    f = F.split("token", "\x1f", 8)
    body = F.rtrim(F.regexp_replace(F.coalesce(F.get(f, F.lit(7)), F.lit("")), r"\s+\z", ""))
    commit = F.max(F.when(F.col("head"), F.struct(
        F.get(f, F.lit(0)).alias("hash"), F.get(f, F.lit(1)).alias("abbreviated"), F.get(f, F.lit(2)).alias("author"), F.get(f, F.lit(3)).alias("email"), F.get(f, F.lit(4)).alias("date"),
        F.coalesce(F.expr("try_cast(get(split(token, '\\u001f', 8), 5) as bigint)") * 1000, F.lit(0).cast("long")).alias("timestamp"), F.coalesce(F.get(f, F.lit(6)), F.lit("")).alias("subject"), F.when(body != "", body).alias("body")))).alias("c")
    files = F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", F.regexp_replace("token", r"\A\n", "").alias("file"))))), lambda x: x["file"])
    return rows.groupBy("repo", "n").agg(commit, files.alias("files")).select("repo", "n", "c.*", "files")


class GitLog(DataSource):
    """format("git-log"): the commits of a repository. Options: path, limit (50), query, author, since, until, file, files."""

    @classmethod
    def name(cls) -> str:
        return "git-log"

    def schema(self) -> str:
        return COMMIT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _LogReader(dict(self.options))


class _LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        o = self.options
        args = ["log", "-z", "-i", "-n", o.get("limit", "50"), f"--format={COMMIT_FORMAT}"]
        args += ["--name-only"] if o.get("files", "true") == "true" else []
        args += [f"--{k}={o[v]}" for k, v in (("grep", "query"), ("author", "author"), ("since", "since"), ("until", "until")) if o.get(v)]
        args += ["--extended-regexp"] if o.get("query") or o.get("author") else []
        current: list | None = None
        import re

        for token in git(o["path"], *args, *(["--", o["file"]] if o.get("file") else [])).split("\0"):
            if not token:
                continue
            if re.match(HEADER, token):
                if current:
                    yield tuple(current)
                p = token.split("\x1f", 7) + [""] * 8
                current = [*p[:5], int(p[5]) * 1000 if p[5].isdigit() else 0, p[6], p[7].rstrip() or None, []]
            elif current:
                current[8].append(token.removeprefix("\n"))
        if current:
            yield tuple(current)


def commits(spark: SparkSession, repo: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitLog)
    return spark.read.format("git-log").options(path=repo, **options).load()


def search_commits(rows: DataFrame, query: str | None = None, author: str | None = None, since: str | None = None, until: str | None = None, path: str | None = None, limit: int = 50) -> DataFrame:
    """Commits whose subject or body, author or address match the patterns (without case), newest first; truncated says that
    the limit was reached."""
    if query:
        rows = rows.where(F.concat_ws("\n", "subject", "body").rlike("(?i)" + query))
    if author:
        rows = rows.where(F.concat_ws(" ", "author", "email").rlike("(?i)" + author))
    if since:
        rows = rows.where(F.col("timestamp") >= F.unix_timestamp(F.lit(since).cast("timestamp")) * 1000)
    if until:
        rows = rows.where(F.col("timestamp") <= F.unix_timestamp(F.lit(until).cast("timestamp")) * 1000)
    if path:
        rows = rows.where(F.exists("files", lambda f: (f == path) | F.startswith(f, F.lit(path.rstrip("/") + "/"))))
    top = rows.orderBy(F.col("timestamp").desc(), "hash").limit(limit)
    return top.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) >= limit)


def churn(rows: DataFrame, root: str | None = None, most: int = CHURN_COMMITS) -> DataFrame:
    """filePath, churn: the commits that touched each file, of the newest most commits; paths are put under root, where given."""
    newest = rows.orderBy(F.col("timestamp").desc(), "hash").limit(most)
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("file")) if root else F.col("file")
    return newest.select("hash", F.explode("files").alias("file")).distinct().groupBy(path.alias("filePath")).agg(F.count("*").alias("churn"))


def parse_blame(raw: DataFrame) -> DataFrame:
    """filePath, line, sha, author, author_time (ms) of porcelain blames (filePath, raw). A commit's headers stand at its first
    line only; the other lines take them from there."""
    lines = raw.select("filePath", F.posexplode(F.split("raw", "\r?\n")).alias("pos", "text"))
    w = Window.partitionBy("filePath").orderBy("pos")
    entry = F.regexp_extract("text", ENTRY, 1)
    rows = lines.withColumn("sha", F.when(entry != "", entry)).withColumn("n", F.sum((entry != "").cast("int")).over(w)).where("n > 0")
    value = lambda key: F.max(F.when(F.startswith("text", F.lit(key + " ")), F.substring("text", F.lit(len(key) + 2), F.length("text"))))
    each = rows.groupBy("filePath", "n").agg(F.max("sha").alias("sha"), F.max(F.when(F.col("sha").isNotNull(), F.regexp_extract("text", ENTRY, 3).cast("int"))).alias("line"), value("author").alias("a"), value("author-time").alias("t"))
    own = Window.partitionBy("filePath", "sha")
    return each.select("filePath", "line", "sha", F.coalesce(F.max("a").over(own), F.lit("")).alias("author"), F.coalesce(F.max(F.expr("try_cast(t as bigint)")).over(own) * 1000, F.lit(0).cast("long")).alias("author_time"))


def blame_summary(lines: DataFrame, *by: str) -> DataFrame:
    """Of each group of blame lines: lastAuthor and lastCommitDate of the newest (ties: the lower line of the file), the number
    of commits up to BLAME_COMMITS, and whether there are more. Groups without any author and time are left out."""
    last = F.max_by(F.struct("author", "author_time"), F.struct("author_time", "line")).alias("last")
    n = F.countDistinct("sha")
    rows = lines.groupBy(*by).agg(last, F.least(n, F.lit(BLAME_COMMITS)).alias("distinctCommits"), (n > BLAME_COMMITS).alias("distinctTruncated"))
    date = F.when(F.col("last.author_time") > 0, F.date_format(F.timestamp_millis("last.author_time"), "yyyy-MM-dd")).otherwise("")
    return rows.where("last.author <> '' or last.author_time > 0").select(*by, F.col("last.author").alias("lastAuthor"), date.alias("lastCommitDate"), "distinctCommits", "distinctTruncated")


def with_blame(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits (query_id, rank, rec_id, filePath, startLine, endLine) with the summary of their lines, of all the file's lines where
    none falls into theirs; only the first BLAME_FILES files of a query are looked at, blameSkipped tells the others."""
    first = hits.groupBy("query_id", "filePath").agg(F.min("rank").alias("r"))
    first = first.withColumn("blameSkipped", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "filePath")) > BLAME_FILES).drop("r")
    rows = hits.join(first, ["query_id", "filePath"])
    own = lines.join(rows.where("not blameSkipped").select("query_id", "rec_id", "filePath", "startLine", "endLine"), "filePath")
    inside = blame_summary(own.where("line between startLine and endLine"), "query_id", "rec_id")
    whole = blame_summary(own, "query_id", "rec_id").join(inside.select("query_id", "rec_id"), ["query_id", "rec_id"], "left_anti")
    return rows.join(inside.unionByName(whole), ["query_id", "rec_id"], "left")


def tree(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """path, content of every file at a ref."""
    names = [n for n in git(repo, "ls-tree", "-r", "-z", "--name-only", safe_git_ref(ref)).split("\0") if n]
    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(64, len(names) // 50 + 1)))

    @F.pandas_udf("string")
    def show(path: pd.Series) -> pd.Series:
        return pd.Series([git(repo, "show", f"{ref}:{p}") for p in path])

    return paths.withColumn("content", show("path"))


def commit_time(repo: str, ref: str) -> int:
    """Milliseconds of the commit that a ref (an annotated tag too) leads to."""
    return int(git(repo, "log", "-1", "--format=%ct", safe_git_ref(ref) + "^{commit}").strip()) * 1000


def tracked_files(spark: SparkSession, repo: str) -> DataFrame:
    return spark.createDataFrame([(f"{repo.rstrip('/')}/{n}",) for n in git(repo, "ls-files", "-z").split("\0") if n], "path string")
