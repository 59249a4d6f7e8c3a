"""Enumeration over ``files(path, content)``: manifests, repository roots, headings, interpreter lines, tree digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from .memo import digest_of


def manifests_in(files: DataFrame, directory: str = "") -> DataFrame:
    return files.where(P.is_inside(F.col("path"), directory) & T.is_manifest(F.col("path"))).select("path")


def git_boundaries(files: DataFrame, directory: str = "") -> DataFrame:
    """Directories with an entry named ``.git``, as a file or as a directory."""
    marked = F.when(P.basename(F.col("path")) == ".git", P.parent(F.col("path"))).when(F.col("path").rlike(r"(^|/)\.git/"), F.regexp_extract("path", r"^(.*?)/?\.git/", 1))
    return files.select(marked.alias("dir")).where(F.col("dir").isNotNull() & P.is_inside(F.col("dir"), directory)).distinct()


def lines(files: DataFrame, content: str = "content", carry: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row a line, numbered from 1, without line ends."""
    return files.select(*carry, F.posexplode(F.split(content, "\n")).alias("n", "line")).select(*carry, (F.col("n") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def doc_headings(files: DataFrame, directory: str = "", by: tuple[str, ...] = ("path",)) -> DataFrame:
    """``(path, line_no, level, text)`` of headings outside fenced blocks of files whose name says that they describe.

    Only such files are split into lines; the running parity of fences goes within a file.
    """
    chosen = files.where(P.is_inside(F.col("path"), directory) & T.is_readme(F.col("path")))
    w = Window.partitionBy(*by).orderBy("line_no")
    ls = lines(chosen, carry=by).withColumn("fence", T.is_fence(F.col("line"))).withColumn("opened", F.sum(F.col("fence").cast("int")).over(w))
    kept = ls.where(~F.col("fence") & (F.col("opened") % 2 == 0) & T.heading_text(F.col("line")).isNotNull())
    return kept.select(*by, "line_no", T.heading_level(F.col("line")).alias("level"), T.heading_text(F.col("line")).alias("text"))


def shebangs(files: DataFrame, directory: str = "") -> DataFrame:
    return files.where(P.is_inside(F.col("path"), directory) & F.startswith("content", F.lit("#!"))).select("path", T.shebang(F.col("content")).alias("interpreter"))


def under(files: DataFrame, dirs: DataFrame, dir_col: str = "dir", itself: bool = True) -> DataFrame:
    """Files paired with each of ``dirs`` that holds them, the empty root included: ancestors are exploded and joined by equality."""
    spread = files.withColumn(dir_col, F.explode(F.concat(F.array(F.lit("")), P.ancestors(F.col("path"), itself))))
    return spread.join(dirs, dir_col)


def tree_sha(files: DataFrame, dirs: DataFrame, relative: bool = True) -> DataFrame:
    """``(dir, content_sha)``: SHA-256 over every file's path length (8 bytes, little-endian), path and content digest, in path order.

    With ``relative``, paths are taken from the directory, so that moving it keeps the digest. Contents are digested before
    rows spread over the directories above; a directory's rows come sorted to one task, which carries nothing but the
    digest's state from row to row.
    """
    short = files.select("path", F.unhex(F.sha2("content", 256)).alias("sha"))
    held = under(short, dirs.select("dir").distinct(), itself=False)
    p = F.expr("CASE WHEN dir = '' THEN path ELSE substr(path, length(dir) + 2) END") if relative else F.col("path")
    rows = held.select("dir", p.alias("p"), "sha").repartition("dir").sortWithinPartitions("dir", F.split("p", "/"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        here, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for d, path, sha in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if d != here:
                    if state is not None:
                        done.append((here, state.hexdigest()))
                    here, state = d, hashlib.sha256()
                raw = path.encode()
                state.update(len(raw).to_bytes(8, "little") + raw + sha)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["dir", "content_sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here]), pa.array([state.hexdigest()])], names=["dir", "content_sha"])

    return rows.mapInArrow(run, "dir string, content_sha string")


def tree_inputs(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """``(dir, digest)`` of what ``tree_sha`` reads for each directory: paths and contents below it, in no order, so without a sort."""
    short = files.select("path", F.sha2("content", 256).alias("sha"))
    return digest_of(under(short, dirs.select("dir").distinct(), itself=False), "dir", F.col("path"), F.col("sha"))


def elided(files: DataFrame, limit: int = 1 << 20, sniff: int = 8192) -> DataFrame:
    """Large and binary contents are emptied, their rows stay and say so."""
    big = F.octet_length("content") > limit
    binary = F.instr(F.substring(F.col("content").cast("string"), 1, sniff), "\0") > 0
    gone = big | binary
    return files.withColumn("elided", gone).withColumn("content", F.when(gone, F.lit("")).otherwise(F.col("content")))


def without_subtree(files: DataFrame, directory: str, root: str = "") -> DataFrame:
    """Files outside ``directory``; it is ignored when it is the root or lies elsewhere."""
    if directory == root or (root and not directory.startswith(root + "/")):
        return files
    return files.where(~P.is_inside(F.col("path"), directory))


def upserts(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Rows of ``new`` that are new or whose content differs."""
    known = old.select(key, F.sha2(content, 256).alias("_sha"))
    return new.withColumn("_sha", F.sha2(content, 256)).join(known, [key, "_sha"], "left_anti").drop("_sha")


def list_dir(files: DataFrame, directory: str) -> DataFrame:
    """Entries right below a directory with their kind."""
    prefix = directory + "/" if directory else ""
    rest = F.expr(f"substr(path, {len(prefix) + 1})")
    inside = files.where(F.startswith("path", F.lit(prefix)))
    kind = F.max(F.when(F.contains(rest, F.lit("/")), "dir").otherwise("a-file"))
    return inside.groupBy(F.substring_index(rest, "/", 1).alias("name")).agg(F.replace(kind, F.lit("a-"), F.lit("")).alias("kind"))


def glob_files(files: DataFrame, glob: str, most: int | None = 1000) -> DataFrame:
    """Paths that match; ``*`` stays within a component. ``most`` is the tool's own limit, in path order."""
    found = files.where(P.matches_glob(F.col("path"), glob, crosses_slash=False)).select("path").distinct()
    return found.orderBy("path").limit(most) if most is not None else found


def grep(files: DataFrame, pattern: str, most: int | None = 100, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """Lines that match, by file and number. Files without a match are not split."""
    hit = lines(files.where(F.col("content").rlike(pattern)), carry=by).where(F.col("line").rlike(pattern))
    return hit.orderBy(*by, "line_no").limit(most) if most is not None else hit


def read_budgeted(requests: DataFrame, budget: int = 1 << 20, cap: int = 64 << 10) -> DataFrame:
    """Reads of one conversation in order ``seq``: each at most ``cap`` bytes, all together at most ``budget``.

    ``requests``: ``session, seq, size``. Adds ``granted`` and ``truncated``.
    """
    want = F.least(F.col("size"), F.lit(cap))
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(want).over(w), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(want, F.lit(budget) - before))
    return requests.withColumn("granted", granted.cast("long")).withColumn("truncated", F.col("granted") < F.col("size"))


def by_path(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of ``wanted(path)``; paths that aren't there give nothing. One or a few paths reach the scan as a filter through the join's key."""
    return files.join(wanted.select("path").distinct(), "path", "left_semi")
