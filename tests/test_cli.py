import tempfile

from conftest import SF_SMALL


def test_cli_lists_and_runs(spark, capsys):
    from dayspan.__main__ import main
    assert main(["--list"]) == 0
    listed = capsys.readouterr().out
    assert "daily_absence_rate (oracle)" in listed and "forest_scored (rows only)" in listed
    out = tempfile.mkdtemp(prefix="dayspan-cli-")
    assert main(["expand_days", "--data", SF_SMALL, "--out", out]) == 0
    assert spark.read.parquet(f"{out}/expand_days").count() == 40731
