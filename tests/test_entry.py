import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["entity"]
    assert df.count() > 0


def test_registry_contract():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    for name in q:
        assert name.split("_")[0][0] in "abcdefghijkop", name


def test_import_without_jvm_or_jars(tmp_path):
    """A fresh process that loads PySpark from a zip (no jars beside it) and
    has no session can read the registry."""
    import os
    import pathlib
    import subprocess
    import sys
    import zipfile

    import pyspark

    home = pathlib.Path(pyspark.__file__).parent
    zips = sorted((home / "python" / "lib").glob("*.zip"))
    if not any(z.name == "pyspark.zip" for z in zips):
        z = tmp_path / "pyspark.zip"
        with zipfile.ZipFile(z, "w") as f:
            for p in home.rglob("*.py"):
                f.write(p, pathlib.Path("pyspark") / p.relative_to(home))
        zips.append(z)
    repo = pathlib.Path(E.__file__).parent
    path = os.pathsep.join([str(repo), *map(str, zips)])
    out = subprocess.run(
        [sys.executable, "-c", "import pyspark, __spark_entry__ as e; "
         "assert '.zip' in pyspark.__file__, pyspark.__file__; "
         "print(len(e.queries()), len(e.oracle_sql()))"],
        env={**os.environ, "PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, m = map(int, out.stdout.split()[-2:])
    assert n >= 50 and m >= 46
