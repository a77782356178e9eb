"""Every registered query with SQL agrees with DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import cairnway.source_queries  # noqa: F401  registers its queries
from cairnway.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("the test tables are not here")
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(str, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    found = con.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert ours == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_refreshed_state_sees_large_ids(spark, con, tmp_path):
    big = 1_000_000_000
    con.execute(f"copy (select * replace (doc_id + {big} as doc_id) from documents where doc_id < 200) to '{tmp_path}/documents.parquet' (format parquet)")
    with duckdb.connect() as own:
        own.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
        want = own.execute(f"select doc_id from documents where doc_id % 10 = 3 and doc_id >= {big}").fetchall()
        other = set(TABLES) - {"documents"}
        for t in other:
            own.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        expected = sorted(map(str, own.execute(f"select path, status, note from ({ORACLES['refreshed_state']})").fetchall()))
    got = QUERIES["refreshed_state"](spark, str(tmp_path)).select("path", "status", "note").collect()
    assert want and sorted(str(tuple(r)) for r in got) == expected


def test_entry_file_names_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5


def test_entry_works_without_the_optional_subpackage():
    """A fresh interpreter in which the optional subpackage cannot be imported."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import sys; sys.modules['cairnway.llm'] = None; import __spark_entry__ as e; q = e.queries();"
        "assert 'depth' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    )
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)


def test_a_missing_library_is_not_taken_for_a_missing_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['pyarrow'] = None; import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert done.returncode and "pyarrow" in done.stderr


def test_reading_order_by_brute_force(spark, con):
    """Every repository's passes in the greedy order of a re-sorting loop, paired tests behind what they test, other tests last."""
    sql = ORACLES["layer_classify"].replace("SELECT path, layer FROM lay", "SELECT path, file, repo_id, fan_in, fan_out, layer FROM lay")
    layers = ["foundation", "core", "features", "integration", "entry"]
    edges = con.execute("SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) WHERE dst > 0 AND dst < src").fetchall()
    files = {}
    for path, file, repo, fan_in, fan_out, layer in con.execute(sql).fetchall():
        folder, stem = file.split("/")[1], file.split("/")[-1].rsplit(".", 1)[0]
        natural = "utility" if folder == "utils" else "contracts" if stem in ("types", "interfaces", "models", "schema", "constants") or (fan_in >= 3 and fan_out <= 1) else "data_flow"
        files[path] = (repo, f"{file}#{path}", stem, natural, (layers.index(layer) + 1, -fan_in, f"{file}#{path}"))
    want = {}
    for repo in {f[0] for f in files.values()}:
        own = {p: f for p, f in files.items() if f[0] == repo}
        plain = {p: f for p, f in own.items() if not f[2].startswith("test_")}
        tests, out, placed = {p: f for p, f in own.items() if p not in plain}, [], set()
        impls = {}
        for f in plain.values():
            impls[f[2]] = min(impls.get(f[2], f[1]), f[1])
        behind = {}
        for f in sorted(tests.values(), key=lambda f: f[1]):
            behind.setdefault(impls.get(f[2].removeprefix("test_")), []).append(f[1])
        for natural in ("contracts", "data_flow", "utility"):
            group = {p: f for p, f in plain.items() if f[3] == natural}
            waits = {p: {b for a, b in edges if a == p and b in group} for p in group}
            while ready := sorted((group[p][4], p) for p in group if p not in placed and waits[p] <= placed):
                placed.add(ready[0][1])
                name = group[ready[0][1]][1]
                out += [name, *behind.get(name, [])]
        want[repo] = out + behind.get(None, [])
    got = {}
    for r in QUERIES["reading_order"](spark, SF).orderBy("repo_id", "index").collect():
        got.setdefault(r.repo_id, []).append(r.path)
    assert got == want
