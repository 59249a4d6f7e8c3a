"""Registered queries against their SQL on the small tables, and the whole pipeline on a file tree."""

import math
import os

import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(registry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_number_formats_beyond_the_small_tables(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("create table orders as select x as o_orderkey, x as o_custkey, TIMESTAMP '1995-01-01' as o_orderdate from (select unnest(range(9950, 1100000, 50)) as x union all select unnest([-65, 4611686018427387905, NULL]))")
    c.sql(f"copy orders to '{tmp_path}/orders.parquet'")
    got = registry.queries()["number_formats"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(c.sql(registry.oracle_sql()["number_formats"]).fetchall(), key=repr)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "internal", "crossing", "density"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_index_of_a_tree(spark, tmp_path):
    from lodestone.plans.index import Options, index

    root, out = str(tmp_path / "r"), str(tmp_path / "o")
    for p, body in {"mylib/Cargo.toml": '[package]\n[lib]\n[dependencies]\nserde="1"\n', "mylib/README.md": "# mylib\n", "mycli/Cargo.toml": "[package]\n[[bin]]\nname='c'\n", "mycli/src/main.rs": "x"}.items():
        os.makedirs(os.path.dirname(os.path.join(root, p)), exist_ok=True)
        with open(os.path.join(root, p), "w") as f:
            f.write(body)
    index(spark, root, out, options=Options(dry_run=True))
    assert not os.path.exists(f"{out}/components.yaml")
    r = index(spark, root, out)
    assert {(x["id"], x["kind"]) for x in r.components.collect()} == {("mylib", "rust-library"), ("mycli", "rust-cli")}
    assert [x["id"] for x in r.externals.collect()] == ["crate:serde"]
    names = ("components.yaml", "external-components.yaml", "related-components.yaml", "subsystems.yaml")
    before = [open(f"{out}/{n}", "rb").read() for n in names]
    index(spark, root, out, now="2030-01-01T00:00:00Z")
    assert before == [open(f"{out}/{n}", "rb").read() for n in names]


def test_init_and_validate(spark, tmp_path, capsys):
    from lodestone.cli import TEMPLATES, main, validate

    assert main(["init", str(tmp_path)]) == 0 and main(["init", str(tmp_path)]) == 0
    assert sorted(os.listdir(tmp_path)) == sorted(TEMPLATES)
    assert validate(spark, str(tmp_path)) == 0
    (tmp_path / "components.overrides.yaml").write_text("schema_version: 1\npins: {a: {kind: {value: rust-binary}, hue: {value: red}}}\n")
    assert validate(spark, str(tmp_path)) == 1
    said = capsys.readouterr().out
    assert "did you mean rust-cli?" in said and "(1 error(s), 1 warning(s))" in said
