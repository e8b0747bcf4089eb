"""One disposition per listed entry, over all repositories at once.

Policy runs on metadata only, written once; directories are judged first (they are few), their subtrees pruned by an
ancestor anti-join, and only surviving files meet the file rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.paths import ancestors, basename_posix, dirname_posix
from ..functions.text import hash_text
from ..options import ChunkOptions, DiscoveryOptions
from ..session import staged
from .chunking import chunk_files
from .ignore import decide, load_ignore_files, parse_ignore_files
from .secrets import redact_secrets

KEY = ["repository_id", "relative_path"]
# Messages.
TRUNCATED = "Stopped after {limit} files; the repository has more. This index is incomplete. Narrow the root or raise the limit."
UNREADABLE = "Directory could not be read."
UNREADABLE_FILE = "File could not be read."
SYMLINK = "Symbolic link; not followed."
NESTED = "Nested repository with its own .git; register it separately."
UNRECOGNISED = "Unrecognised file type."


def nested_repositories(files: DataFrame) -> DataFrame:
    """Directories below a root that hold an entry named ``.git``."""
    here = files.filter(basename_posix(F.col("relative_path")) == ".git").select("repository_id", dirname_posix(F.col("relative_path")).alias("relative_path"))
    return here.filter("relative_path <> ''").distinct()


def prune_subtrees(files: DataFrame, pruned: DataFrame) -> DataFrame:
    """Rows that lie under none of the pruned directories (repository_id, relative_path)."""
    under = (
        files.select(*KEY, F.explode(ancestors(F.col("relative_path"))).alias("dir"))
        .join(pruned.select("repository_id", F.col("relative_path").alias("dir")), ["repository_id", "dir"], "left_semi")
        .select(*KEY)
        .distinct()
    )
    return files.join(under, KEY, "left_anti")


def _matched() -> Column:
    return F.concat(F.lit("Matched `"), F.trim("rule"), F.lit("`."))


def discover(files: DataFrame, options: DiscoveryOptions = DiscoveryOptions()) -> DataFrame:
    """(repository_id, relative_path, entry_type, size_bytes, text) to one row per entry with status, reason, origin, language, truncated.

    ``files`` lists every entry; text is needed for ignore files only. Status is ``indexable`` or ``skipped``; kept directories
    give no row, unreadable ones are skipped. Of the indexable files of a repository the ``max_files`` of smallest paths stay;
    ``truncated`` tells limit and message on every row of a repository with more, and is null elsewhere.
    """
    name = basename_posix(F.col("relative_path"))
    rule_text = F.when(name.isin(*options.ignore_file_names), F.col("text")).alias("text")
    listing = staged(files.select(*KEY, "entry_type", "size_bytes", rule_text), "listing")
    meta = listing.drop("text")
    rules = staged(parse_ignore_files(load_ignore_files(listing, options)), "rules")
    dirs = decide(meta.filter("entry_type in ('dir', 'unreadable')").withColumn("is_dir", F.lit(True)), rules)
    built_in = F.when(~F.col("explicitly_included"), P.directory_exclusion(name)["message"])
    nested = nested_repositories(meta).withColumn("nested", F.lit(True))
    closed = F.when(F.col("ignored"), _matched()).otherwise(F.coalesce(built_in, F.when(F.col("nested"), F.lit(NESTED))))
    unread = closed.isNull() & (F.col("entry_type") == "unreadable")
    judged = staged(dirs.join(nested, KEY, "left").select(
        *KEY, "entry_type", "size_bytes",
        F.when(unread, F.lit(UNREADABLE)).otherwise(closed).alias("reason"),
        F.when(F.col("ignored"), F.col("rule_origin")).when(unread, "boundary").otherwise("default").alias("origin"),
    ).filter("reason is not null"), "judged")
    alive = staged(prune_subtrees(meta.filter("entry_type in ('file', 'symlink', 'unreadable_file')"), judged), "alive")
    links = alive.filter("entry_type = 'symlink'").select(*KEY, "entry_type", "size_bytes", F.lit(SYMLINK).alias("reason"), F.lit("boundary").alias("origin"), F.lit(None).cast("string").alias("language"))
    found = decide(alive.filter("entry_type <> 'symlink'").withColumn("is_dir", F.lit(False)), rules).withColumn("name", name)
    found = found.withColumns({"barred": P.file_exclusion_of(F.col("name")), "language": P.detect_language(F.col("name"))})
    found = found.withColumn("held", F.when(~F.col("explicitly_included") | (F.col("barred.category") == "secret-bearing"), F.col("barred.message")))
    unknown = F.when(F.col("language").isNull(), F.lit(UNRECOGNISED))
    lost = F.when(F.col("entry_type") == "unreadable_file", F.lit(UNREADABLE_FILE))
    reason = F.when(F.col("ignored"), _matched()).otherwise(F.coalesce("held", unknown, lost, P.oversize_reason(F.col("size_bytes"), options.max_file_bytes)))
    origin = F.when(F.col("ignored"), F.col("rule_origin")).when(F.col("held").isNotNull() | F.col("language").isNull(), F.lit("default")).when(lost.isNotNull(), "boundary").otherwise("size")
    verdicts = found.select(*KEY, "entry_type", "size_bytes", reason.alias("reason"), origin.alias("origin"), "language")
    skipped = prune_subtrees(judged, judged).withColumn("language", F.lit(None).cast("string"))
    out = skipped.union(links).union(verdicts).select(
        *KEY, "entry_type", "size_bytes",
        F.when(F.col("reason").isNull(), "indexable").otherwise("skipped").alias("status"),
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("origin")).alias("origin"),
        F.when(F.col("reason").isNull(), F.col("language")).alias("language"),
    )
    return cap_files(staged(out, "dispositions"), options.max_files)


def cap_files(files: DataFrame, limit: int = DiscoveryOptions().max_files) -> DataFrame:
    """At most ``limit`` indexable files per repository (smallest paths), with ``truncated`` (limit, message) on every row of a cut one.

    A repository is cut when anything is left to look at after that many files, even if it would have been skipped. Rows whose ``status`` says skipped never count. Repositories are counted first (one row each); only those over the limit
    are ranked, so a window never sorts the others.
    """
    wanted = F.col("status") == "indexable" if "status" in files.columns else F.lit(True)
    counts = files.groupBy("repository_id").agg(F.count_if(wanted).alias("n"), F.max(F.when(wanted, F.col("relative_path"))).alias("last"), F.max("relative_path").alias("end"))
    message = TRUNCATED.format(limit=limit)
    cut = F.when((F.col("n") > limit) | (F.col("n") == limit) & (F.col("end") > F.col("last")), F.struct(F.lit(limit).alias("limit"), F.lit(message).alias("message"))).alias("truncated")
    marked = files.join(counts.select("repository_id", cut), "repository_id").select(*files.columns, "truncated")
    free = F.col("truncated").isNull() if "status" not in files.columns else F.col("truncated").isNull() | (F.col("status") != "indexable")
    place = F.row_number().over(Window.partitionBy("repository_id").orderBy("relative_path"))
    over = marked.filter(~free).withColumn("place", place).filter(F.col("place") <= limit).drop("place")
    return marked.filter(free).unionByName(over)


def index_status(files: DataFrame) -> DataFrame:
    """Adds ``status``: binary, minified or indexed, the first that holds; an indexed text comes redacted."""
    status = F.when(F.col("text").isNull() | P.looks_binary(F.encode("text", "UTF-8")), "binary").when(P.looks_minified(F.col("text")), "minified").otherwise("indexed")
    return files.withColumn("status", status).withColumn("text", F.when(F.col("status") == "indexed", redact_secrets(F.col("text"))).otherwise(F.col("text")))


def ingest(files: DataFrame, options: DiscoveryOptions = DiscoveryOptions(), chunking: ChunkOptions = ChunkOptions()) -> tuple[DataFrame, DataFrame]:
    """The chained path of a listing with text: discover, drop binary and minified files, redact, chunk.

    Returns every disposition (the statuses of :func:`discover`, with binary, minified or indexed for indexable files, and the
    hash of the redacted text of indexed ones) and the chunks of the indexed ones.
    """
    found = staged(discover(files, options), "discovered")
    return ingest_texts(found, files.filter("entry_type = 'file'").select(*KEY, "text", F.lit(True).alias("opened")), chunking)


def ingest_texts(found: DataFrame, texts: DataFrame, chunking: ChunkOptions = ChunkOptions()) -> tuple[DataFrame, DataFrame]:
    """The second half of :func:`ingest`: dispositions and the texts of their indexable files (repository_id, relative_path, text, opened).

    A file that could not be opened after all is skipped; one without text although opened was binary.
    """
    read = found.filter("status = 'indexable'").drop("status").join(texts, KEY)
    read = index_status(read.filter("opened")).drop("opened").unionByName(read.filter("not opened").drop("opened").withColumn("status", F.lit("skipped")))
    gone = F.col("status") == "skipped"
    read = read.withColumns({"reason": F.when(gone, UNREADABLE_FILE).otherwise(F.col("reason")), "origin": F.when(gone, "boundary").otherwise(F.col("origin")), "language": F.when(~gone, F.col("language"))})
    read = staged(read.withColumn("content_hash", F.when(F.col("status") == "indexed", hash_text(F.col("text")))), "read")
    skipped = found.filter("status = 'skipped'").withColumn("content_hash", F.lit(None).cast("string"))
    chunks = chunk_files(read.filter("status = 'indexed'").drop("content_hash"), chunking)
    return read.select(*found.columns, "content_hash").unionByName(skipped), chunks
