"""The carve loop, semi-naive: a round looks only at what the round before added.

Directories are classified, digested and placed once, in the round that brings them; later rounds add to those tables, and
an earlier directory is placed anew only where a new one comes to lie between it and its parent. Edges are asked for only where
a library's depth leaves the matter to the hint, and only among the components below it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..functions import text as X
from ..operators import candidates as C
from ..operators import edges as D
from ..operators import enumerate as E
from ..operators import graph as G
from ..operators import propose as Q
from ..operators import recurse as R
from ..operators import tree as T
from ..operators.memo import Memo
from ..operators.settle import settle

Ask = Callable[[DataFrame], DataFrame]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def signals(files: DataFrame) -> DataFrame:
    """The files that classification looks at: manifests, descriptions, marks of repositories, scripts."""
    path = F.col("path")
    return files.where(X.is_manifest(path) | X.is_readme(path) | path.rlike(r"(^|/)\.git(/|$)") | F.startswith("content", F.lit("#!")))


def surface_requests(live: DataFrame) -> DataFrame:
    """``(key, prompt, inputs)``: each component's request for a description of its surface."""
    own = {"COMPONENT_ID": F.col("id"), "COMPONENT_KIND": F.col("kind"), "CONTENT_SHAS": F.col("path_segments.content_sha"), "PATH_SEGMENTS": F.col("path_segments.path")}
    return live.select(F.col("id").alias("key"), F.lit("surface").alias("prompt"), F.to_json(F.struct(*[c.alias(k) for k, c in sorted(own.items())]), {"ignoreNullFields": "false"}).alias("inputs"))


def surfaces(live: DataFrame, pins: DataFrame, ask) -> DataFrame:
    """``(id, surface)`` of every component: its pin's, else the answer's; a surface without content whose notes tell what failed.

    A pinned surface is written as text in YAML or JSON; one that can't be read as a surface counts as none.
    """
    fixed = pins.where((F.col("field") == "surface") & (F.col("variant") == "value")).select(F.col("key").alias("id"), D.parse_surface(F.col("value")).alias("pinned")).where("pinned is not null").dropDuplicates(["id"])
    fixed = settle(fixed)
    answered = ask.with_errors(surface_requests(live.join(fixed, "id", "left_anti")))
    said = answered.select(F.col("key").alias("id"), D.parse_surface(F.col("response")).alias("said"), "response", "error")
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("no answer: "), "error")).when(F.col("response").isNull(), "no answer").otherwise("the answer is no surface: it must be an object that names known roles only")
    rows = live.select("id").join(fixed, "id", "left").join(said, "id", "left")
    return rows.select("id", F.coalesce("pinned", "said", D.no_surface(why)).alias("surface"))


class Carving:
    """The state of the loop. ``classify(files, dirs)`` gives ``dir, source, answer, manifests, headings``; ``build`` a tree from what is known.

    ``rows`` has, for each round, how many directories were classified, digested and placed, and for how many libraries edges were asked.
    """

    def __init__(self, files: DataFrame, fixed_dirs: DataFrame, classify: Callable[[DataFrame, DataFrame], DataFrame], build: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], pins: DataFrame, ask, max_depth: int, memo: Memo | None = None):
        self.memo = memo
        self.files, self.classify, self.build, self.pins, self.ask, self.max_depth = files, classify, build, pins, ask, max_depth
        self.signals = settle(signals(files))
        self.base = settle(C.candidate_dirs(self.signals, fixed_dirs))
        spark = files.sparkSession
        self.verdicts: list[DataFrame] = []
        self.own = [spark.createDataFrame([], "dir string")]
        self.shas = [spark.createDataFrame([], "dir string, content_sha string")]
        self.lines = [spark.createDataFrame([], "dir string, up string")]
        self.found = [spark.createDataFrame([], "dir string, parent_dir string")]
        self.subs = [spark.createDataFrame([], "dir string, sub_dir string")]
        self.looked = [spark.createDataFrame([], "dir string")]
        self.rows: list[dict] = []
        self.hashed = 0
        self.components: DataFrame | None = None

    def _judge(self, dirs: DataFrame) -> int:
        """Classify those of ``dirs`` that aren't yet."""
        new = dirs.select("dir").distinct()
        new = settle(new.join(_union(self.verdicts).select("dir"), "dir", "left_anti") if self.verdicts else new)
        n = new.count()
        if n or not self.verdicts:
            self.verdicts.append(settle(self.classify(self.signals, new)))
        return n

    def _place(self, own: DataFrame) -> tuple[int, int]:
        """Digests and nearest ancestors of new components' directories, and of earlier ones that come to lie below them."""
        new = settle(own.select("dir").join(_union(self.own), "dir", "left_anti"))
        if not (n := new.count()):
            return 0, 0
        self.shas.append(settle(self._digests(new)))
        below = settle(_union(self.lines).join(new.where("dir <> ''").select(F.col("dir").alias("up")), "up").groupBy("dir").agg(F.max_by("up", F.length("up")).alias("parent_dir")))
        self.own.append(new)
        every = _union(self.own).where("dir <> ''")
        first = settle(T.nearest_ancestor(new, every))
        self.lines.append(settle(new.select("dir", F.explode(P.ancestors(F.col("dir"))).alias("up"))))
        self.found += [below, first]
        return n, n + below.count()

    def _digests(self, dirs: DataFrame) -> DataFrame:
        """Tree digests; with a memo, of those directories only below which something changed since the last run."""
        if self.memo is None:
            return E.tree_sha(self.files, dirs)
        out = self.memo.through("tree-sha", E.tree_inputs(self.files, dirs), "dir", lambda missing: E.tree_sha(self.files, missing)).select("dir", "content_sha")
        self.hashed += self.memo.computed
        return out

    def tree(self, back: DataFrame) -> DataFrame:
        dirs = settle(self.base.select("dir").union(back.select(F.col("sub_dir").alias("dir"))).distinct())
        judged = self._judge(dirs)
        classified = _union(self.verdicts).join(dirs, "dir", "left_semi")
        own = classified.where("answer.is_boundary").select("dir")
        digested, placed = self._place(own)
        # of several, the longest lies nearest
        nearest = _union(self.found).groupBy("dir").agg(F.max_by("parent_dir", F.length("parent_dir")).alias("parent_dir"))
        self.components = self.build(classified, _union(self.shas), nearest)
        self.rows.append({"classified": judged, "digested": digested, "placed": placed, "hinted": 0})
        return self.components

    def hints(self, live: DataFrame, above: DataFrame, depth: DataFrame) -> DataFrame:
        """``id`` of the libraries too deep to be carved as such whose descendants' edges fall into two parts.

        Only they are asked about: the surfaces of their descendants, and one request for each library's edges.
        """
        deep = live.join(depth, "id").where(F.col("kind").isin(*vocab.LIBRARY_KINDS) & (F.col("depth") >= vocab.LIBRARY_DEPTH_CAP) & (F.col("depth") < self.max_depth)).select(F.col("id").alias("grp"))
        members = above.select(F.col("ancestor").alias("grp"), F.col("id").alias("node")).join(deep, "grp")
        few = members.groupBy("grp").agg(F.count("*").alias("n")).where((F.col("n") >= G.LEAST_CUT) & (F.col("n") <= G.MOST_CUT))
        members = settle(members.join(few.select("grp"), "grp"))
        if members.isEmpty():
            return members.select(F.col("grp").alias("id"))
        self.rows[-1]["hinted"] = few.count()
        inside = settle(live.join(members.select(F.col("node").alias("id")).distinct(), "id", "left_semi"))
        told = settle(surfaces(inside, self.pins, self.ask))
        asked = Q.records(members.select(F.col("grp").alias("request"), F.col("node").alias("id")), told)
        answers = self.ask(asked.select(F.col("request").alias("key"), F.lit("edges").alias("prompt"), "inputs"))
        edges = settle(Q.edges_of(answers.select(F.col("key").alias("request"), "response")).select(F.col("participants")[0].alias("src"), F.col("participants")[1].alias("dst")).where("src <> dst"))
        return settle(G.best_bisection(members, edges).select(F.col("grp").alias("id")))

    def step(self, back: DataFrame) -> DataFrame:
        """Pairs ``(id, sub_dir)`` that this round proposes."""
        components = self.tree(back)
        none = components.sparkSession.createDataFrame([], "id string, sub_dir string")
        if self.max_depth <= 0:
            return none
        live = settle(components.where("not deleted"))
        # depth and kind decide first; only what they leave open is looked at
        above = T.closure(live.select("id", "parent"))
        depth = settle(T.depths(live.select("id", "parent"), above))
        hint = self.hints(live, above, depth).withColumn("hint", F.lit(True))
        verdict = live.join(depth, "id").join(hint, "id", "left").withColumn("v", R.policy(F.col("kind"), F.col("depth"), F.lit(self.max_depth), F.coalesce("hint", F.lit(False))))
        # members of a workspace show by their manifests
        open_ = settle(verdict.where((F.col("v") != "stop") & ~F.col("kind").isin(*vocab.RECURSE_KINDS)).select("id", "hint", F.explode("path_segments.path").alias("dir")))
        new = settle(open_.select("dir").distinct().join(_union(self.looked), "dir", "left_anti"))
        if not new.isEmpty():
            self.subs.append(settle(R.immediate_subdirs(self.files, new.select(F.col("dir").alias("id"), "dir")).select(F.col("id").alias("dir"), "sub_dir")))
            self.looked.append(new)
        subs = open_.join(_union(self.subs), "dir").select("id", "sub_dir").distinct().join(open_.select("id", F.col("dir").alias("sub_dir")), ["id", "sub_dir"], "left_anti")
        names = self.pins.where("variant = 'suppress_children'").select(F.col("key").alias("id"), F.explode("children").alias("name"))
        subs = settle(R.without_suppressed(subs, names))
        self.rows[-1]["classified"] += self._judge(subs.select(F.col("sub_dir").alias("dir")))
        judged = _union(self.verdicts).select("dir", "answer.kind", "answer.is_boundary")
        kept = R.subcarve(subs, judged, open_.where("hint").select("id").distinct()).where("carve")
        return kept.select("id", F.explode("kept").alias("sub_dir"))
