"""Classification: pins, then deterministic rules, then a model's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import paths as P
from ..functions.manifests import cargo_shape, package_shape

#: Names kept results of the rules; to be raised with any change to the rules or to the signals that they read.
KEPT_AS = "rules-1"

FIELDS = ("kind", "language", "build_system", "lifecycle_roles", "role", "evidence_grade", "evidence_fields", "rationale", "is_boundary")


def answer(kind: str | Column, language: str | None, build: str | None, roles: list[str], fields: list[str], why: str, grade: str = "strong", boundary: bool = True) -> Column:
    lit = lambda x, t="string": F.lit(x).cast(t)
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    values = (lit(kind) if isinstance(kind, str) else kind, lit(language), lit(build), arr(roles), lit(None), lit(grade), arr(fields), lit(why), lit(boundary, "boolean"))
    return F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)])


def rules(cargo: Column, package: Column, pyproject: Column, git_root: Column, has_manifest: Column, near_readme: Column) -> list[tuple[str, Column, Column]]:
    """``(name, condition, answer)`` in order; the first that holds decides."""
    # The evidence that each rule names.
    run = ["build", "runtime"]
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return [
        ("cargo-workspace", cargo["has_workspace"], answer("workspace", "rust", "cargo", ["build"], ["Cargo.toml:[workspace]"], "a crate manifest that gathers other crates")),
        ("cargo-bin", cargo["has_bin"], answer("rust-cli", "rust", "cargo", run, ["Cargo.toml:[[bin]]"], "a crate manifest that builds a program")),
        ("cargo-lib", cargo["has_lib"], answer("rust-library", "rust", "cargo", run, ["Cargo.toml:[lib]"], "a crate manifest that builds a library and no program")),
        ("package-json-bin", package["has_bin"], answer("node-cli", "javascript", "npm", run, ["package.json:bin"], "a package that installs a command")),
        ("package-json-library", package["has_main"] | package["has_exports"], answer("node-library", "javascript", "npm", run, ["package.json:main|exports"], "a package with an entry point and no command")),
        ("pyproject-toml", pyproject, answer("python-library", "python", "pyproject", run, ["pyproject.toml"], "a Python project file")),
        ("bare-git-no-manifests", git_root & no(has_manifest) & no(near_readme), answer("non-component", None, None, [], [".git"], "a bare repository root: neither manifest nor readme says what it is", boundary=False)),
    ]


def by_rules(table: list[tuple[str, Column, Column]]) -> Column:
    """The first rule's answer; null when none holds."""
    out = F.when(F.coalesce(table[0][1], F.lit(False)), table[0][2])
    for _, holds, then in table[1:]:
        out = out.when(F.coalesce(holds, F.lit(False)), then)
    return out


def classify_by_rules(bundles: DataFrame, files: DataFrame) -> DataFrame:
    """``dir`` with ``rule``: the answer of the rule table, null where it has none.

    Only manifests that rules look at are read.
    """
    own = files.where(P.basename(F.col("path")).isin("Cargo.toml", "package.json", "pyproject.toml"))
    text = lambda name: F.max(F.when(P.basename(F.col("path")) == name, F.col("content")))
    texts = own.groupBy(P.parent(F.col("path")).alias("dir")).agg(text("Cargo.toml").alias("cargo"), text("package.json").alias("package"), F.max(P.basename(F.col("path")) == "pyproject.toml").alias("pyproject"))
    shaped = bundles.join(texts, "dir", "left").withColumn("c", F.when(F.col("cargo").isNotNull(), cargo_shape("cargo"))).withColumn("p", F.when(F.col("package").isNotNull(), package_shape(F.col("package"))))
    table = rules(F.col("c"), F.col("p"), F.col("pyproject"), F.col("is_git_root"), F.size("manifests") > 0, F.col("near_headings") > 0)
    return shaped.select(*bundles.columns, by_rules(table).alias("rule"))


def pin_keys(dirs: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """``(dir, prio, key)``: the names by which a pin may call a directory, best first, each once."""
    d = F.col("dir")
    forms = F.array(d, P.basename(d), P.slug_path(d), P.slug(P.basename(d)))
    out = dirs.select("dir", F.posexplode(forms).alias("prio", "key"))
    if additions is not None:
        out = out.union(additions.join(dirs, "dir").select("dir", F.lit(4).alias("prio"), F.col("id").alias("key")))
    return out.where("key is not null and key <> ''").groupBy("dir", "key").agg(F.min("prio").alias("prio"))


def by_pins(dirs: DataFrame, pins: DataFrame, additions: DataFrame | None = None) -> DataFrame:
    """``(dir, pin)``: the answer of the first key that has pins; ``pins``: ``key, field, variant, value``."""
    value = lambda f: F.max(F.when((F.col("field") == f) & (F.col("variant") == "value"), F.col("value")))
    shaped = pins.groupBy("key").agg(
        value("kind").alias("kind"), value("language").alias("language"), value("build_system").alias("build_system"), value("role").alias("role"),
        F.array_sort(F.collect_set(F.concat(F.lit("pin:"), "field"))).alias("fields"), F.coalesce(F.max((F.col("field") == "suppress") & (F.col("variant") == "suppress")), F.lit(False)).alias("off"),
    )
    kind = F.when(F.col("kind").isin(*vocab.KINDS), F.col("kind")).otherwise("non-component")
    values = (kind, F.col("language"), F.col("build_system"), F.array().cast("array<string>"), F.col("role"), F.lit("strong"), F.col("fields"), F.lit("set by hand"), ~F.col("off"))
    made = shaped.select("key", F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)]).alias("pin"))
    hit = pin_keys(dirs, additions).join(made, "key")
    return hit.groupBy("dir").agg(F.min_by("pin", "prio").alias("pin"))


def parse_answer(text: Column) -> Column:
    """A model's JSON answer with defaults; null when it isn't an object or its kind is unknown."""
    g = lambda k: F.get_json_object(text, f"$.{k}")
    arr = lambda k: F.coalesce(F.from_json(g(k), "array<string>"), F.array().cast("array<string>"))
    grade = F.when(g("evidence_grade").isin(*vocab.GRADES), g("evidence_grade")).otherwise("medium")
    values = (g("kind"), g("language"), g("build_system"), F.filter(arr("lifecycle_roles"), lambda x: x.isin(*vocab.LIFECYCLES)), g("role"), grade, arr("evidence_fields"), F.coalesce(g("rationale"), F.lit("")), F.coalesce(g("is_boundary").cast("boolean"), g("kind") != "non-component"))
    return F.when(g("kind").isin(*vocab.KINDS), F.struct(*[v.alias(n) for v, n in zip(values, FIELDS, strict=True)]))


def unknown(why: str) -> Column:
    return answer("non-component", None, None, [], [], why, grade="weak", boundary=False)


def cascade(bundled: DataFrame, pinned: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``dir, source, answer``: pin, else rule, else the model's answer, else unknown.

    ``bundled`` has ``rule``; ``answers`` are ``(dir, model)``, asked only for what is left.
    """
    out = bundled.select("dir", "rule").join(pinned, "dir", "left")
    out = out.join(answers, "dir", "left") if answers is not None else out.withColumn("model", F.lit(None).cast(out.schema["rule"].dataType))
    source = F.when(F.col("pin").isNotNull(), "pin").when(F.col("rule").isNotNull(), "rule").when(F.col("model").isNotNull(), "model").otherwise("unknown")
    return out.select("dir", source.alias("source"), F.coalesce("pin", "rule", "model", unknown("no answer")).alias("answer"))


def undecided(bundled: DataFrame, pinned: DataFrame) -> DataFrame:
    """Candidates that neither a pin nor a rule decides: those to ask a model about."""
    return bundled.where("rule is null").join(pinned, "dir", "left_anti")
