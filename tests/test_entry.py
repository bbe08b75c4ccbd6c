import json

import __spark_entry__ as entry
from lodeframe.__main__ import main
from lodeframe.functions.expressions import Ref
from lodeframe.plans import relations as R


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 140


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "q.sql").write_text("CREATE VIEW asia AS SELECT r_regionkey AS k FROM region WHERE r_name = 'ASIA'; SELECT n_name FROM nation JOIN asia ON n_regionkey = k WHERE n_nationkey < 5")
    assert main(["--sql-file", str(tmp_path / "q.sql"), "--tables", "/root/testdata/sf0.001"]) == 0
    assert "NATION_2" in capsys.readouterr().out
    plan = R.Filter(R.Read("region", ("r_name", "r_regionkey")), Ref(1) > 3, (0,))
    (tmp_path / "p.json").write_text(json.dumps(R.to_dict(plan)))
    main(["--plan-file", str(tmp_path / "p.json"), "--tables", "/root/testdata/sf0.001", "--parquet", str(tmp_path / "out")])
    assert [r.r_name for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["MIDDLE EAST"]
