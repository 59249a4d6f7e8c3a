"""The whole pipeline over a file tree: enumerate, classify, build the tree, carve deeper, describe, relate, project."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import candidates as C
from ..operators import classify as K
from ..operators import edges as D
from ..operators import project as J
from ..operators import propose as Q
from ..operators import recurse as R
from ..operators import tree as T
from ..operators.memo import Memo
from ..operators.settle import settle
from ..respond import cache as M
from ..respond.core import Budget, BudgetExceeded, Canned, Responder, SetupError
from ..respond.progress import Finished, Phase, Progress, Rounds, Silent, Started, Surface
from ..sources import files as FS
from ..sources import tables as S
from .carve import Carving, surfaces


@dataclass
class Options:
    """``budget`` None: as many tokens as it takes. ``overrides`` False: authored pins, additions and subsystems are ignored.

    ``parallel``: calls at a time, by default as many as the session has slots. ``recarve``: earlier components are forgotten, so
    that ids are given anew. ``stages``: a folder, reached by all machines, of digests and answers of
    rules that later runs over a changed tree reuse.
    """

    max_depth: int = 8
    budget: int | None = None
    dry_run: bool = False
    overrides: bool = True
    respect_gitignore: bool = True
    parallel: int | None = None
    recarve: bool = False
    stages: str | None = None


@dataclass
class Result:
    components: DataFrame
    externals: DataFrame
    edges: DataFrame
    subsystems: DataFrame
    cache: DataFrame
    summary: dict = field(default_factory=dict)


class Ask:
    """Answers requests through the cache; what is missing goes to the responder, in executors and under one budget.

    ``keep`` is given the cache before a run ends for want of tokens or of a responder that works.
    """

    def __init__(self, spark: SparkSession, responder: Responder, cache: DataFrame, budget: Budget, progress: Progress, parallel: int | None = None, keep: Callable[[DataFrame], None] | None = None):
        self.spark, self.responder, self.budget, self.progress, self.parallel, self.keep = spark, responder, budget, progress, parallel, keep
        self.store = M.ResponseCache(cache, settle)
        self.by_prompt: dict[str, int] = {}
        self.failed = spark.createDataFrame([], "prompt string, inputs string, error string")

    @property
    def cache(self) -> DataFrame:
        return self.store.entries

    def __call__(self, requests: DataFrame) -> DataFrame:
        """``requests(key, prompt, inputs)`` to ``(key, response)``; failed ones are missing. Running out of budget is an error."""
        asked = M.keyed(requests, self.responder)
        missing = settle(self.store.missing(asked))
        if n := missing.count():
            done = 0

            def told(prompt: str, inputs: str, ok: bool) -> None:
                nonlocal done
                done += 1
                self.by_prompt[prompt] = self.by_prompt.get(prompt, 0) + ok
                if prompt == "surface":
                    what = json.loads(inputs)
                    self.progress.on_event(Surface(what["COMPONENT_ID"], max(what["PATH_SEGMENTS"] or [""], key=len), done, n))

            listened = prompt_events(self.progress)
            got = settle(M.answer_within(missing, self.responder, self.budget, parallel=self.parallel, told=told if listened else None))
            if not listened:
                self.by_prompt |= {r["prompt"]: self.by_prompt.get(r["prompt"], 0) + r["n"] for r in got.groupBy("prompt").agg(F.count("response").alias("n")).collect()}
            self.store.record(got)
            if not (bad := got.where("response is null")).isEmpty():
                self.failed = self.failed.union(bad.select("prompt", "inputs", "error"))
            for kind, what in (("SetupError", SetupError), ("BudgetExceeded", BudgetExceeded)):
                if (lost := got.where(F.startswith("error", F.lit(f"{kind}:"))).first()) is not None:
                    if self.keep is not None:
                        self.keep(self.cache)
                    raise what(lost["error"].removeprefix(f"{kind}: "))
        return requests.join(self.store.found(asked).select("prompt", "inputs", "response"), ["prompt", "inputs"]).select("key", "response")


    def with_errors(self, requests: DataFrame) -> DataFrame:
        """``(key, response, error)`` of all requests."""
        known = self(requests)
        why = self.failed.groupBy("prompt", "inputs").agg(F.max("error").alias("error"))
        return requests.join(known, "key", "left").join(why, ["prompt", "inputs"], "left").select("key", "response", "error")


def prompt_events(progress: Progress) -> bool:
    """Whether anyone listens, so that each request has to be told on the driver."""
    return not isinstance(progress, Silent)


def _inputs(**columns):
    """Key-sorted JSON with nulls kept, as cache keys need it."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns.items())]), {"ignoreNullFields": "false"})


def ruled(files: DataFrame, dirs: DataFrame, memo: Memo | None = None) -> DataFrame:
    """Signals and the rules' answer for each directory; with a memo, computed for those only whose signals changed since the last run."""
    if memo is None:
        return K.classify_by_rules(C.bundles(files, dirs), files)

    def fresh(missing: DataFrame) -> DataFrame:
        near = settle(C.files_below(files, missing))
        return K.classify_by_rules(C.bundles(near, missing), near)

    return memo.through(K.KEPT_AS, C.bundle_inputs(files, dirs), "dir", fresh)


def classify(files: DataFrame, dirs: DataFrame, pins: DataFrame, additions: DataFrame, ask: Ask, memo: Memo | None = None) -> DataFrame:
    """``dir, source, answer, manifests, headings`` of all candidates."""
    bundled = settle(ruled(files, dirs, memo))
    pinned = settle(K.by_pins(dirs, pins, additions))
    left = K.undecided(bundled, pinned)
    req = left.select(F.col("dir").alias("key"), F.lit("classify").alias("prompt"), _inputs(DIR_RELATIVE=F.col("dir"), RATIONALE_BUNDLE=F.struct(*[Q.by_name(F.col(c), left.schema[c].dataType).alias(c) for c in ("headings", "is_git_root", "manifests", "shebangs")])).alias("inputs"))
    answers = ask(req).select(F.col("key").alias("dir"), K.parse_answer(F.col("response")).alias("model"))
    return K.cascade(bundled, pinned, answers).join(bundled.select("dir", "manifests", "headings"), "dir")


def build_tree(classified: DataFrame, sha: DataFrame, nearest: DataFrame, additions: DataFrame, prior: DataFrame, pins: DataFrame) -> DataFrame:
    """Components with ids and parents, from their directories' digests and nearest ancestors; prior ones without a successor as tombstones."""
    yes = classified.where("answer.is_boundary")
    own = settle(yes.select("dir", "answer", "manifests", "headings"))
    up = nearest.withColumnRenamed("parent_dir", "found")
    has_root = not own.where("dir = ''").isEmpty()
    parent = F.when(F.col("dir") == "", F.lit(None)).otherwise(F.coalesce("found", F.lit("" if has_root else None).cast("string")))
    placed = settle(own.join(up, "dir", "left").join(sha, "dir", "left").withColumn("parent_dir", parent).withColumn("depth", P.depth(F.col("dir"))).withColumn("slug", P.leaf_slug(F.col("dir"))))
    # equal content keeps its id, wherever it moved to
    live_prior = prior.where("not deleted").select("id", F.explode("path_segments.content_sha").alias("content_sha"))
    renamed = T.match_renames(live_prior, placed.where("content_sha is not null").select(F.col("dir").alias("key"), "content_sha")).where("state = 'matched'").select(F.col("live_key").alias("dir"), F.col("prior_id").alias("carried"))
    renamed = settle(renamed.groupBy("dir").agg(F.min("carried").alias("carried")))
    fixed = additions.select(F.col("id").alias("id")).union(renamed.select(F.col("carried")))
    fresh = T.allocate_ids(placed.select("dir", "parent_dir", "depth", "slug"), fixed)
    named = fresh.join(renamed, "dir", "left").select("dir", F.coalesce("carried", "id").alias("id"))
    ids = settle(named)
    anchors = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: F.struct(h["path"].alias("path"), h["text"].alias("heading")))
    a = F.col("answer")
    rows = placed.join(ids, "dir").join(ids.select(F.col("dir").alias("parent_dir"), F.col("id").alias("parent")), "parent_dir", "left").select(
        "id", "parent", a["kind"].alias("kind"), a["lifecycle_roles"].alias("lifecycle_roles"), a["language"].alias("language"), a["build_system"].alias("build_system"), a["role"].alias("role"),
        F.array(F.struct(F.col("dir").alias("path"), F.coalesce("content_sha", F.lit("")).alias("content_sha"))).alias("path_segments"), "manifests",
        F.coalesce(anchors, F.array().cast("array<struct<path:string,heading:string>>")).alias("doc_anchors"), a["evidence_grade"].alias("evidence_grade"), a["evidence_fields"].alias("evidence_fields"), a["rationale"].alias("rationale"), F.lit(False).alias("deleted"),
    )
    off = pins.where("variant = 'suppress'").select(F.col("key").alias("id"))
    rows = settle(T.with_additions(rows, additions.withColumn("deleted", F.lit(False)), off))
    rows = settle(T.suppress_children(rows, pins.where("variant = 'suppress_children'").select("key", "children")).select(*rows.columns))
    if not T.on_cycles(rows.select("id", "parent")).isEmpty():
        raise ValueError("the components' parents form a cycle")
    return settle(rows.unionByName(T.tombstones(prior, rows).select(*rows.columns)))


def index(spark: SparkSession, root: str, out_dir: str, responder: Responder | None = None, options: Options = Options(), now: str | None = None, progress: Progress | None = None) -> Result:
    """Analyse the tree under ``root`` and write four YAML files and the response cache to ``out_dir``.

    A second run over an unchanged tree asks nothing and writes the same bytes. When the budget runs out, nothing but
    the answers so far is written. ``progress`` is told what happens.
    """
    began, progress = time.monotonic(), progress or Silent()
    progress.on_event(Started(root))
    progress.on_event(Phase("seed"))
    responder = responder or Canned({})
    where = lambda n: os.path.join(out_dir, n)
    prior_file = S.load_yaml(where("components.yaml"), "components")
    prior = settle(S.table(spark, [] if options.recarve else prior_file.get("components", []), S.COMPONENT).na.fill(False, ["deleted"]))
    overrides = S.load_yaml(where("components.overrides.yaml"), "overrides") if options.overrides else {}
    pins = settle(S.pins_table(spark, overrides))
    additions = settle(S.table(spark, overrides.get("additions", []), S.COMPONENT))
    own = S.load_yaml(where("subsystems.overrides.yaml"), "subsystems") if options.overrides else {}
    subs = S.table(spark, own.get("subsystems", []), S.SUBSYSTEM)
    errors = [r.asDict() for r in J.validate_pins(pins).union(J.validate_additions(additions)).where("severity = 'error'").collect()]
    if errors:
        raise ValueError(f"overrides: {errors}")
    files = settle(FS.with_text(FS.read_tree(spark, root, options.respect_gitignore, out_dir)))
    budget = Budget(options.budget)

    def keep(cache: DataFrame) -> None:
        os.makedirs(out_dir, exist_ok=True)
        S.save_cache(cache, where("response-cache.json"))

    ask = Ask(spark, responder, settle(S.load_cache(spark, where("response-cache.json"))), budget, progress, options.parallel, keep)
    add_dirs = additions.select(F.col("path_segments")[0]["path"].alias("dir")).where("dir is not null")
    named = additions.select("id", F.col("path_segments")[0]["path"].alias("dir"))
    memo = Memo(spark, options.stages) if options.stages else None
    carving = Carving(
        files, add_dirs,
        lambda some, dirs: classify(some, dirs, pins, named, ask, memo),
        lambda classified, sha, nearest: build_tree(classified, sha, nearest, additions, prior, pins),
        pins, ask, options.max_depth, memo,
    )
    progress.on_event(Phase("fixedpoint"))
    size = lambda: carving.components.where("not deleted").count() if carving.components is not None else 0
    _, rounds = R.fixedpoint(carving.step, spark.createDataFrame([], "id string, sub_dir string"), hooks=Rounds(progress, size))
    components = carving.components
    progress.on_event(Phase("project"))
    live = settle(components.where("not deleted"))
    told = settle(surfaces(live, pins, ask))
    progress.on_event(Phase("edges"))
    edges = settle(propose_edges(told, ask))
    externals = settle(J.externals(J.npm_externals(files).unionByName(J.cargo_externals(files))).withColumn("homepage", F.lit(None).cast("string")).withColumn("url", F.lit(None).cast("string")))
    members = subs.select(F.col("id").alias("subsystem"), F.posexplode("members").alias("ord", "member"))
    paths_of = components.select("id", "deleted", F.col("path_segments.path").alias("paths"))
    lost = [tuple(r) for r in J.unresolved_members(members, paths_of).collect()]
    clash = [r["id"] for r in J.collisions(subs, paths_of).collect()]
    if lost or clash:
        raise ValueError(f"subsystems: unknown members {lost}, ids of components {clash}")
    evidence = J.subsystem_evidence(members, paths_of)
    found = subs.drop("members").join(J.subsystems(evidence).withColumnRenamed("subsystem", "id"), "id")
    seen = evidence.groupBy(F.col("subsystem").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "matched_via"))).alias("e")).select("id", F.transform("e", lambda e: F.struct(e["id"].alias("id"), e["matched_via"].alias("matched_via"))).alias("member_evidence"))
    subsystems = found.join(seen, "id")
    summary = {"components": live.count(), "externals": externals.count(), "edges": edges.count(), "calls": ask.store.calls, "errors": ask.store.errors, "tokens_used": budget.used, "token_budget": options.budget, "iterations": rounds, "rounds": carving.rows, "hashed": carving.hashed, "ruled": memo.counts[K.KEPT_AS] if memo else 0, "written": not options.dry_run}
    result = Result(components, externals, edges, subsystems, ask.cache, summary)
    keep(ask.cache)
    if not options.dry_run:
        write_outputs(result, root, out_dir, now or S.utc_now())
    progress.on_event(Finished(summary["components"], ask.store.calls, budget.used, options.budget, time.monotonic() - began, dict(ask.by_prompt)))
    return result


def propose_edges(told: DataFrame, ask: Ask) -> DataFrame:
    """Edges among components of these surfaces: of one request where all fit, else of a request for each pack of blocks that share a token."""
    asked = Q.records(Q.requests_for(told), told)
    answers = ask(asked.select(F.col("request").alias("key"), F.lit("edges").alias("prompt"), "inputs"))
    return Q.edges_of(answers.select(F.col("key").alias("request"), "response")).select(*[f.split()[0] for f in S.EDGE.split(", ")])


def write_outputs(r: Result, root: str, out_dir: str, now: str) -> None:
    """Four files; each keeps its old time when nothing else in it changed."""
    for name, kind, key, rows in (
        ("components.yaml", "components", "components", S.rows_of(r.components, "id")),
        ("external-components.yaml", "externals", "externals", S.rows_of(r.externals, "id")),
        ("related-components.yaml", "related", "edges", S.rows_of(r.edges.withColumn("_k", D.edge_key()), "_k")),
        ("subsystems.yaml", "subsystems", "subsystems", S.rows_of(r.subsystems, "id")),
    ):
        for row in rows:
            row.pop("_k", None)
        path = os.path.join(out_dir, name)
        old = S.load_yaml(path, kind)
        body = {"schema_version": S.VERSIONS[kind], "root": root, "generated_at": now, key: rows}
        if {**old, "generated_at": ""} == {**body, "generated_at": ""} and old.get("generated_at"):
            body["generated_at"] = old["generated_at"]
        S.write_yaml(path, body)
